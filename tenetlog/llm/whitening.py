"""Whitened leading components of integer-scaled embeddings.

Vectors become whole numbers, so their sums and second moments are exact and do not depend
on how rows are dealt to tasks. Spark sums them over the distinct vectors. The driver gets
only a matrix of dimension x dimension and finds its leading eigenpairs by FEAST: inertia
counts fence off intervals that hold known numbers of eigenvalues, a quadrature of complex
shifted solves around each interval projects a few vectors onto its eigenspace, Rayleigh-Ritz
extracts the pairs, and the count says whether any is missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenetlog.llm import common

SCALE = 256
COMPONENTS = 4
NODES = 8            # quadrature points on the upper half of a contour
FEAST_ROUNDS = 40
BLOCK_ROWS = 4096    # rows of a task that are multiplied at once
_WIDE = 2**62


# --- eigenpairs of one small matrix ---

def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a matrix similar to the symmetric ``v``, by Householder reflections."""
    a = v.copy()
    d = len(a)
    for k in range(d - 2):
        x = a[k + 1:, k].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.linalg.norm(x)
        a[k + 1:] -= 2 * np.outer(x, x @ a[k + 1:])
        a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ x, x)
    return np.diag(a).copy(), np.diag(a, 1).copy()


def inertia(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """Number of eigenvalues below ``shift``: negative pivots of the shifted matrix's LDL' factors."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    count, pivot = 0, 1.0
    for k, a in enumerate(diagonal):
        pivot = a - shift - (side[k - 1] ** 2 / pivot if k else 0.0)
        if abs(pivot) < tiny:
            pivot = -tiny
        count += pivot < 0
    return count


def fences(diagonal: np.ndarray, side: np.ndarray, k: int) -> list[tuple[float, float, int]]:
    """Intervals (low, high, count), highest first, that hold the k largest eigenvalues and what ties with the last.

    Each of the k + 1 largest eigenvalues is bisected by inertia counts; an interval ends where
    two neighbours are clearly apart, and its bounds lie in the gaps.
    """
    d = len(diagonal)
    radius = np.zeros(d)
    radius[:-1] += np.abs(side)
    radius[1:] += np.abs(side)
    least, most = float((diagonal - radius).min()), float((diagonal + radius).max())
    span = max(most - least, abs(most), np.finfo(float).tiny)
    least, most = least - 0.01 * span, most + 0.01 * span
    enclosed = []
    for j in range(1, min(k + 1, d) + 1):
        low, high = least, enclosed[-1][1] if enclosed else most
        while high - low > 1e-12 * span:
            middle = (low + high) / 2
            if d - inertia(diagonal, side, middle) >= j:
                low = middle
            else:
                high = middle
        enclosed.append((low, high))
    found, top, held = [], most, 0
    for j, (low, high) in enumerate(enclosed):
        following = enclosed[j + 1][1] if j + 1 < len(enclosed) else least
        if low - following > 1e-6 * span or j + 1 == d:
            bottom = (low + following) / 2 if j + 1 < d else least
            count = d - inertia(diagonal, side, bottom) - held
            found.append((bottom, top, count))
            top, held = bottom, held + count
            if held >= k:
                return found
    # The last wanted eigenvalue and the one after it are too close to part: take all down to a gap.
    j = held
    bottom = enclosed[-1][0]
    while True:
        bottom -= 1e-6 * span
        count = d - inertia(diagonal, side, bottom)
        if bottom <= least or count == d - inertia(diagonal, side, bottom - 1e-6 * span):
            break
    found.append((max(bottom, least), top, count - j))
    return found


def feast(v: np.ndarray, low: float, high: float, count: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in (low, high), falling, and unit eigenvectors of the symmetric ``v``.

    ``count`` is the inertia count of the interval. Each round filters a subspace by Gauss
    quadrature around the circle over the interval and solves the projected problem, until
    residuals reach rounding. Raises if the interval does not yield ``count`` pairs.
    """
    d = len(v)
    rng = np.random.default_rng(seed)
    basis = rng.standard_normal((d, min(d, count + max(4, count // 2))))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    angles = np.pi / 2 * (1 - nodes)
    middle, radius = (low + high) / 2, (high - low) / 2
    scale = np.abs(v).sum(axis=1).max()
    best = None
    for _ in range(FEAST_ROUNDS):
        filtered = np.zeros_like(basis)
        for angle, weight in zip(angles, weights):
            turn = radius * np.exp(1j * angle)
            solved = np.linalg.solve((middle + turn) * np.eye(d) - v, basis.astype(complex))
            filtered += weight / 2 * (turn * solved).real
        q, _ = np.linalg.qr(filtered)
        values, small = np.linalg.eigh(q.T @ v @ q)
        basis = q @ small
        inside = (values > low) & (values < high)
        if inside.sum() != count:
            continue
        pairs = basis[:, inside]
        residual = np.linalg.norm(v @ pairs - pairs * values[inside], axis=0).max()
        if best is not None and residual >= 0.5 * best[0]:
            break
        best = (residual, values[inside][::-1].copy(), pairs[:, ::-1].copy())
        if residual <= 4 * np.finfo(float).eps * scale:
            break
    if best is None or best[0] > 1e-9 * scale:
        raise ArithmeticError(f"{count} eigenvalues lie in ({low}, {high}); FEAST did not find them all")
    return best[1], best[2] / np.linalg.norm(best[2], axis=0)


def leading(v: np.ndarray, k: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues, falling, and their eigenvectors; fewer where ``v`` has lower rank."""
    d = len(v)
    if d == 0 or not v.any():
        return np.zeros(0), np.zeros((d, 0))
    diagonal, side = tridiagonal(v)
    values, vectors = [], []
    for low, high, count in fences(diagonal, side, min(k, d)):
        e, p = feast(v, low, high, count)
        values.append(e)
        vectors.append(p)
    e, p = np.concatenate(values)[:k], np.concatenate(vectors, axis=1)[:, :k]
    positive = e > d * np.finfo(float).eps * np.trace(v)
    return e[positive], p[:, positive]


# --- sums over the distinct vectors ---

def _rows(column: pa.Array, d: int) -> np.ndarray:
    """A list column of whole numbers as a matrix, short rows filled up with 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == d).all():
        return flat.reshape(len(lengths), d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def _exact(x: np.ndarray, rows: int) -> np.ndarray:
    """``x`` as Python integers where products summed over so many rows might pass 64 bits."""
    top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    return x if top * top * max(rows, 1) * x.shape[1] < _WIDE else x.astype(object)


def _totals(parts: DataFrame, keys: list[str]) -> dict:
    """Exact sums of the tasks' partial sums, by key; their number is bounded by the dimensions."""
    total = parts.groupBy(*keys).agg(F.sum("value").cast("string").alias("value")).collect()
    return {tuple(r[k] for k in keys): int(r["value"]) for r in total}


def first_moments(fitted: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and their sum in each dimension, as Python integers."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(d, object)
        for batch in batches:
            x = _rows(batch.column(0), d)
            n, sums = n + len(x), sums + _exact(x, len(x)).sum(axis=0).astype(object)
        yield _values(range(-1, d), [n, *sums])

    found = _totals(fitted.select("x").mapInArrow(partial, "i int, value decimal(38,0)"), ["i"])
    return found.get((-1,), 0), np.array([found.get((i,), 0) for i in range(d)], object)


def _values(i, values) -> pa.RecordBatch:
    import decimal
    return pa.RecordBatch.from_arrays(
        [pa.array(list(i), pa.int32()), pa.array([decimal.Decimal(int(v)) for v in values], pa.decimal128(38, 0))], names=["i", "value"])


def covariance(fitted: DataFrame, n: int, sums: np.ndarray) -> np.ndarray:
    """Covariance with divisor n, each entry exact before it is rounded once.

    Vectors are centred on the whole number nearest to the mean before they are multiplied;
    the rest of the mean is taken off in whole-number arithmetic.
    """
    d = len(sums)
    centre = [(2 * int(s) + n) // (2 * n) for s in sums] if n else []
    upper = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(upper[0]), object)
        wide = any(abs(c) >= 2**31 for c in centre)
        for batch in batches:
            x = _rows(batch.column(0), d)
            for start in range(0, len(x), BLOCK_ROWS):
                part = x[start:start + BLOCK_ROWS]
                y = part.astype(object) - np.array(centre, object) if wide else part - np.array(centre, np.int64)
                y = _exact(y, len(y)) if y.dtype != object else y
                # Products below 2^53 are exact in floating point, where multiplication is fast.
                if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * len(y) < 2**53:
                    square = np.rint(y.astype(float).T @ y.astype(float)).astype(np.int64)
                else:
                    square = y.T @ y
                total = total + square[upper].astype(object)
        yield _values(range(len(total)), total)

    found = _totals(fitted.select("x").mapInArrow(partial, "i int, value decimal(38,0)"), ["i"]) if n else {}
    rest = [int(s) - n * c for s, c in zip(sums, centre)]
    v = np.zeros((d, d))
    for k, (i, j) in enumerate(zip(*upper)):
        v[i, j] = v[j, i] = (n * found.get((k,), 0) - rest[i] * rest[j]) / (n * n) if n else 0.0
    return v


def _projected(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes


def identity_error(fitted: DataFrame, mean: np.ndarray, axes: np.ndarray, n: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    d, k = axes.shape
    if not (n and k):
        return 0.0

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, squares = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(_rows(batch.column(0), d), mean, axes)
            sums, squares = sums + w.sum(axis=0), squares + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int32()), pa.array([*sums, *squares.ravel()], pa.float64())],
                                         names=["i", "value"])

    rows = fitted.select("x").mapInArrow(partial, "i int, value double").groupBy("i").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(k + k * k)
    for r in rows:
        total[r["i"]] = r["value"]
    means = total[:k] / n
    return float(np.abs(total[k:].reshape(k, k) / n - np.outer(means, means) - np.eye(k)).max())


# --- the operator ---

def whole_numbers(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): vectors without null or non-finite entries, scaled and rounded down."""
    c = F.col("embedding").cast("array<double>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    finite = F.forall("c", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(F.col("c").isNotNull() & finite).select(
        "vec_id", F.transform("c", lambda e: F.floor(e * scale).cast("long")).alias("x"))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error, deviation_decimal).

    Vectors that are null or hold null or non-finite entries give no rows; repeated rows and
    null ids give rows of their own; other columns are ignored. Vectors shorter than the longest
    are filled up with 0. Components without variance (equal vectors, one vector, low rank) are
    left out; an empty table gives no rows. ``deviation`` is null where it passes 64 bits, as it
    does for very long tables; ``deviation_decimal`` holds it then too.
    """
    spark = embeddings.sparkSession
    whole = whole_numbers(embeddings, scale)
    d = whole.agg(F.max(F.size("x"))).first()[0] or 0
    if whole.where(F.size("x") < d).limit(1).count():
        whole = whole.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), d - F.size("x"))))
    fitted = common.stored(whole.select("x").distinct(), "whitening-fit")
    n, sums = first_moments(fitted, d)
    v = covariance(fitted, n, sums)
    e, p = leading(v, components)
    axes = p / np.sqrt(e)
    mean = np.array([int(s) / n for s in sums], float) if n else np.zeros(d)
    error = identity_error(fitted, mean, axes, n)
    common.drop_stored(fitted)
    explained = e / np.trace(v) if len(e) else e
    k = len(e)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal
        for batch in batches:
            x = _rows(batch.column(1), d)
            if not (len(x) and k):
                continue
            top = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))), 1)
            if (2 * top * n) ** 2 * d < _WIDE:
                far = ((n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
            else:
                far = ((n * x.astype(object) - sums) ** 2).sum(axis=1).tolist()
            narrow = [f if f < 2**63 else None for f in far]
            long_form = [decimal.Decimal(f) if f < 10**38 else None for f in far]
            each = lambda values, kind: pa.array([f for f in values for _ in range(k)], kind)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                 pa.array(np.full(m * k, n), pa.int64()), each(narrow, pa.int64()),
                 pa.array(_projected(x, mean, axes).ravel(), pa.float64()), pa.array(np.tile(explained, m), pa.float64()),
                 pa.array(np.full(m * k, error), pa.float64()), each(long_form, pa.decimal128(38, 0))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_decimal"])

    return whole.select("vec_id", "x").mapInArrow(
        rows, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, "
              "deviation_decimal decimal(38,0)")
