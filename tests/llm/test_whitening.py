from fractions import Fraction

import numpy as np
import pytest

from tenetlog.llm import whitening


@pytest.mark.parametrize("d", [1, 2, 5, 40])
@pytest.mark.parametrize("kind", ["random", "equal", "one apart", "rank one", "wide"])
def test_leading_pairs_equal_dense_solver(d, kind):
    a = np.random.default_rng(d).standard_normal((d, d))
    q, _ = np.linalg.qr(a)
    v = {"random": a @ a.T, "equal": 3 * np.eye(d), "one apart": np.diag([5.0] + [1.0] * (d - 1)), "rank one": np.outer(a[0], a[0]),
         "wide": (q * np.geomspace(1e6, 1e-3, d)) @ q.T}[kind]
    v = (v + v.T) / 2
    e, p = whitening.leading(v)
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert len(e) == (1 if kind == "rank one" else min(4, d))
    assert np.allclose(e, want[:len(e)], rtol=1e-9, atol=1e-12 * want[0])
    assert np.abs(v @ p - p * e).max() <= 1e-12 * np.abs(v).max() * d
    assert np.allclose(p.T @ p, np.eye(len(e)), atol=1e-9)


def test_inertia_counts_and_a_missed_pair_raises():
    v = np.diag([1.0, 2.0, 3.0, 4.0])
    v[0, 3] = v[3, 0] = 0.5
    diagonal, side = whitening.tridiagonal(v)
    for shift in (0.0, 1.5, 2.5, 3.5, 9.0):
        assert whitening.inertia(diagonal, side, shift) == (np.linalg.eigvalsh(v) < shift).sum()
    with pytest.raises(ArithmeticError):
        whitening.feast(v, 1.5, 3.5, 3)


def reference(vectors):
    """Fractions and a dense solver over plain lists."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in vectors
            if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (d - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(x[k] for x in fit) for k in range(d)]
    v = np.array([[float(sum((x[i] - Fraction(sums[i], n)) * (x[j] - Fraction(sums[j], n)) for x in fit) / n) for j in range(d)] for i in range(d)])
    e, p = np.linalg.eigh(v)
    return kept, n, sums, v, e[::-1], p[:, ::-1]


def test_rows_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    vectors = [(k, (rng.standard_normal(6) * [3, 2, 1.5, 1, .7, .2]).tolist()) for k in range(60)]
    vectors += [(100, vectors[0][1]), (0, vectors[0][1]), (None, vectors[3][1]), (101, None), (102, [1.0, None] * 3), (103, [float("nan")] * 6),
                (104, [float("inf")] * 6), (105, [1.0, 2.0]), (106, []), (107, [300.0] * 6)]
    table = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id int, embedding array<float>, n string")
    rows = whitening.whiten(table).collect()
    kept, n, sums, v, e, p = reference(vectors)
    assert len(rows) == 4 * len(kept)
    assert {r.n for r in rows} == {n} and len({r.identity_error for r in rows}) == 1 and 0 <= rows[0].identity_error < 1e-9
    for c in range(1, 5):
        mine = [r for r in rows if r.component == c]
        assert mine[0].explained == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9)
        ideal = {}
        for i, x in kept:
            ideal.setdefault(i, []).append((sum((n * a - s) ** 2 for a, s in zip(x, sums)), float((np.array(x) - np.array(sums) / n) @ p[:, c - 1]) / e[c - 1] ** .5))
        for sign in (1, -1):
            same = all(any(r.deviation == dev and r.whitened == pytest.approx(sign * w, rel=1e-7, abs=1e-9) for dev, w in ideal[r.vec_id]) for r in mine)
            if same:
                break
        assert same
        assert all(r.deviation_decimal == r.deviation for r in mine)


def test_degenerate_tables(spark):
    make = lambda rows: whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).count() == 0
    assert make([(1, None), (2, [])]).count() == 0
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]).count() == 0
    two = make([(1, [0.0, 2.0]), (2, [1.0, 2.0])]).collect()
    assert [(r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in two] == [(1, 2, 256**2, 1.0, 1.0)] * 2
    huge = make([(1, [1e12, 0.0]), (2, [-1e12, 3e11]), (3, [0.0, 5e11])]).collect()
    assert len(huge) == 6 and all(r.deviation is None and r.deviation_decimal > 0 for r in huge if r.vec_id < 3)
