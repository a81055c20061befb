"""Quality rules: fixed rules, and an isolation forest over rule statistics.

Trees split a bounded sample of rows at random; rows that few splits separate are
anomalous. The threshold on the anomaly score is calibrated on all labelled rows: the least
score that at most ``CLEAN_LOSS`` of the rows labelled good reach. A document is kept if
no fixed rule fails and its score stays below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenetlog.llm import common

# Bound of the fit: rows from which the trees draw theirs.
SAMPLE_ROWS = 20_000
BINS = 4_096             # counts that one step of the search for the threshold brings to the driver
TREES, TREE_ROWS, DEPTH = 100, 256, 10
CLEAN_LOSS = 0.002
MIN_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("word_length", "symbol_share", "mark_share")
STATISTICS = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "features array<float>")


def _table(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL = _table(SYMBOLS)
_START = np.array([b & 0xC0 != 0x80 for b in range(256)])            # first bytes of UTF-8 characters
_MARK = _table(bytes(b for b in range(33, 127) if not chr(b).isalnum()))


def statistics_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts (one row per text, columns ``COUNTS``) and features of some texts."""
    w = common.Words(texts)
    raw = np.frombuffer(w.buffer, np.uint8)
    bounds = np.stack([w.offsets[:-1], w.offsets[1:]], 1)

    def per_doc(mask):
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[bounds[:, 1]] - total[bounds[:, 0]]

    first = _START[raw] & ~common._IS_BREAK[raw]
    n_words = np.diff(w.ranges)
    counts = np.zeros((len(texts), 5), np.int64)
    counts[:, 0], counts[:, 1], counts[:, 2] = n_words, per_doc(first), per_doc(_SYMBOL[raw])
    counts[:, 3] = [_repeated_lines(t) for t in texts]
    counts[:, 4] = _repeated_words(w)
    chars = np.maximum(counts[:, 1], 1)
    features = np.stack([counts[:, 1] / np.maximum(n_words, 1), counts[:, 2] / chars, per_doc(_MARK[raw]) / chars], 1)
    return counts, features.astype(np.float32)


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def _repeated_words(w: common.Words) -> np.ndarray:
    """Words in three-word windows found twice or more in their text."""
    docs = np.repeat(np.arange(len(w), dtype=np.uint64), np.diff(w.ranges))
    owner = common.mixed(docs + np.uint64(1))
    covered = np.zeros(len(docs) + 1, np.int64)
    if len(docs) >= 3:
        grams = common.gram_hashes(w.hashes, 3) ^ owner[:-2]
        at = np.flatnonzero(docs[2:] == docs[:-2])
        order = at[np.argsort(grams[at], kind="stable")]
        value = grams[order]
        twice = np.zeros(len(value), bool)
        same = value[1:] == value[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        np.add.at(covered, hit, 1)
        after = np.zeros(len(docs) + 4, np.int64)
        np.add.at(after, hit + 3, 1)
        covered = np.cumsum(covered - after[:len(docs) + 1]) > 0
    total = np.concatenate(([0], np.cumsum(covered[:len(docs)])))
    return total[w.ranges[1:]] - total[w.ranges[:-1]]


def statistics(docs: DataFrame) -> DataFrame:
    """Counts and features of every whole text; null or empty texts have zeros."""
    names = [c.split()[0] for c in STATISTICS.split(", ")]

    def run(batches):
        for ids, texts in common.chunks(batches):
            counts, features = statistics_of(texts)
            flat = pa.array(features.ravel())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * features.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *map(pa.array, counts.T.copy()), rows], names=names)

    return common.keyed(docs).mapInArrow(run, STATISTICS)


class Forest:
    """Isolation trees as arrays: feature, split value, children, and the path length at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, depth: int = DEPTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.norm = max(_expected_path(min(tree_rows, len(rows))), 1e-9)
        self.trees = [self._grow(rows[rng.permutation(len(rows))[:tree_rows]], depth, rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def _grow(rows, depth, rng):
        nodes = []

        def grow(part, level):
            k = len(nodes)
            nodes.append([-1, 0.0, 0, 0, level + _expected_path(len(part))])
            spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 and level < depth else ()
            if len(spread):
                f = int(rng.choice(spread))
                cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
                left = part[:, f] <= cut
                nodes[k][:2] = f, cut
                nodes[k][2] = grow(part[left], level + 1)
                nodes[k][3] = grow(part[~left], level + 1)
            return k

        grow(rows.astype(float), 0)
        return [np.array(c) for c in zip(*nodes)]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for rows that few splits separate."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for feature, cut, left, right, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            while (inner := feature[at] >= 0).any():
                f = np.maximum(feature[at], 0)
                at = np.where(inner, np.where(rows[each, f] <= cut[at], left[at], right[at]), at)
            total += path[at]
        return 2.0 ** -(total / max(len(self.trees), 1) / self.norm)


def _expected_path(n: int) -> float:
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > REPEAT_PERCENT * counts[:, 0])


def bounded(df: DataFrame, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows, chosen by a hash of the id; all of them if there are fewer."""
    share = min(1.0, rows / max(df.count(), 1))
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20)) <= int(share * (1 << 20)))


def fit(stats: DataFrame, labels: DataFrame | None) -> tuple[Forest, float]:
    """Forest and threshold. Without labelled good rows the threshold is above every score."""
    passed = stats.where(~((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))))
    sample = bounded(passed, SAMPLE_ROWS, 11).select("features").toPandas()
    forest = Forest(np.array(sample["features"].tolist(), float).reshape(len(sample), len(FEATURES)))
    if labels is None:
        return forest, 2.0
    good = (labels.where("quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
            .join(passed, "doc_id"))
    model = stats.sparkSession.sparkContext.broadcast(forest)      # TREES * TREE_ROWS * 2 nodes at most

    def run(batches):
        for batch in batches:
            features = batch.column(0).flatten().to_numpy().reshape(len(batch), len(FEATURES))
            yield pa.RecordBatch.from_arrays([pa.array(model.value.score(features) if len(batch) else np.zeros(0))], names=["score"])

    scores = common.stored(good.select("features").mapInArrow(run, "score double"), "quality-scores")
    n = scores.count()
    if not n:
        return forest, 2.0
    above = np.nextafter(order_statistic(scores, min(n - 1, int(np.ceil((1 - CLEAN_LOSS) * n)))), 2)
    return forest, float(above)


def order_statistic(scores: DataFrame, k: int) -> float:
    """The k-th least ``score``, from 0, exactly: counts of ever narrower ranges, ``BINS`` at a time."""
    low, high, below = *scores.agg(F.min("score"), F.max("score")).first(), 0
    while low < high:
        place = F.least(F.floor((F.col("score") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = (scores.where(F.col("score").between(low, high)).groupBy(place.alias("bin"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).orderBy("bin").collect())
        for b in bins:
            if below + b["n"] > k:
                low, high = b["low"], b["high"]
                break
            below += b["n"]
    return low


def judge(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(doc_id, counts, base_failed, kept, anomaly), one row per input row.

    Null and empty texts have no words and fail; repeated rows are judged alike; labels of
    unknown ids count for nothing; an empty table gives no rows.
    """
    stats = common.stored(statistics(docs), "quality-statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))     # TREES * TREE_ROWS * 2 nodes at most

    def run(batches):
        forest, threshold = model.value
        for batch in batches:
            counts = np.stack([c.to_numpy() for c in batch.columns[1:6]], 1)
            features = batch.column(6).flatten().to_numpy().reshape(len(counts), len(FEATURES))
            score = forest.score(features) if len(counts) else np.zeros(0)
            failed = base_failed(counts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(failed), pa.array(~failed & (score < threshold)), pa.array(score)],
                names=["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])

    return stats.mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, kept boolean, anomaly double")


def passing(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``docs`` without the rows that the rules reject; rows are judged one by one, other columns pass through."""
    stats = common.stored(statistics(docs), "quality-statistics")
    model = docs.sparkSession.sparkContext.broadcast(fit(stats, labels))
    common.drop_stored(stats)
    at = docs.columns.index("text")

    def run(batches):
        forest, threshold = model.value
        for batch in batches:
            kept = []
            for _, texts in common.chunks([pa.RecordBatch.from_arrays([pa.nulls(len(batch)), batch.column(at)], names=["k", "t"])]):
                counts, features = statistics_of(texts)
                kept.append(~base_failed(counts) & (forest.score(features) < threshold))
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
