"""Benchmark decontamination: rare n-gram seeds join passages to test items, alignment scores them.

Seeds are the ``SEED``-word runs of an item that few items hold; an item that those hardly
cover uses its least-held runs as well. A bit map of fixed size tells tasks which runs of a
document may be seeds; around those, passages are cut, and a join of their runs with the
seed table gives (passage, item) candidates. A word-level Smith-Waterman alignment scores
each candidate; the share of the item's best possible score decides.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from tenetlog.llm import common

SEED = 3
# A run is rare if at most this share of the items (or two items) hold it, and never more than RUN_HOLDERS items.
RARE_SHARE, RUN_HOLDERS = 0.01, 20
# Least share of an item's words under its rare runs. A copy that passes keeps THRESHOLD of the words
# or more, so with over 1 - THRESHOLD a part of what it keeps lies under rare runs.
COVERED = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.6
ITEMS = "row long, words binary, n_words int, seeds array<long>"
_BREAKS = bytes(c if c >= 0x80 or chr(c).isalnum() else 32 for c in range(256)).lower()


def plain(text: bytes) -> bytes:
    """Lower-case ASCII letters and digits and all non-ASCII characters; the rest separates words."""
    return text.translate(_BREAKS)


def item_rows(items: DataFrame) -> DataFrame:
    """(row, item_id, text): a key of its own for each distinct pair of an id and a sequence of plain words.

    A row without an id is left out only if its words have an id in another row, which reports them.
    """
    cells = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def words(batches):
        for ids, texts in common.chunks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(
                [b" ".join(plain(t).split()).decode() for t in texts], pa.string())], names=["item_id", "text"])

    pairs = common.stored(cells.mapInArrow(words, "item_id long, text string").distinct(), "benchmark-pairs")
    named, nameless = pairs.where("item_id is not null"), pairs.where("item_id is null")
    rows = named.unionByName(nameless.join(named.select("text").distinct(), "text", "left_anti"))
    return common.stored(rows.select(F.monotonically_increasing_id().alias("row"), "item_id", "text"), "benchmark-rows")


def item_table(items: DataFrame) -> DataFrame:
    """(row, item_id, words, n_words, seeds) of every item row with a word.

    Seeds are the rare runs. Where those cover less than
    ``COVERED`` of an item's words, the least-held run over each other word is a seed too, so
    an item made of common runs alone has seeds as well. An item of fewer than ``SEED`` words
    has one seed, itself, and is met only by documents that consist of it.
    """
    rows = item_rows(items)

    def runs_of(batches):
        for ids, texts in common.chunks(batches):
            w = common.Words([plain(t) for t in texts])
            runs = [_runs(w.hashes[a:b]).view(np.int64) for a, b in zip(w.ranges[:-1], w.ranges[1:])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([b" ".join(plain(t).split()) for t in texts], pa.binary()),
                 pa.array(np.diff(w.ranges).astype(np.int32)), pa.array(runs, pa.list_(pa.int64()))], names=["row", "words", "n_words", "runs"])

    table = common.stored(rows.select("row", "text").mapInArrow(runs_of, "row long, words binary, n_words int, runs array<long>")
                          .where("n_words > 0"), "benchmark-words")
    limit = max(2, min(RUN_HOLDERS, int(RARE_SHARE * table.count())))
    placed = table.select("row", F.posexplode("runs").alias("place", "run"))
    holders = placed.select("row", "run").distinct().groupBy("run").agg(F.count(F.lit(1)).alias("holders"))
    rated = placed.join(holders, "run").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "holders"))).alias("r"))
    chosen = table.join(rated.select("row", F.col("r.holders").alias("holders")), "row").select("row", "words", "n_words", "runs", "holders")

    def seeds(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(5)]
            found = [np.unique(np.array(runs, np.int64)[seed_places(np.array(held), n, limit)]) for n, runs, held in zip(*columns[2:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int64()))],
                                             names=["row", "words", "n_words", "seeds"])

    return common.stored(chosen.mapInArrow(seeds, ITEMS).join(rows.select("row", "item_id"), "row"), "benchmark-items")


def _runs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of a text's words; a text of fewer than ``SEED`` words is one run."""
    return common.gram_hashes(hashes, min(SEED, max(len(hashes), 1)))


def seed_places(holders: np.ndarray, n_words: int, limit: int) -> np.ndarray:
    """Which runs of an item, told by how many items hold each, are its seeds."""
    chosen = holders <= limit
    length = n_words - len(holders) + 1
    covered = np.zeros(n_words, bool)
    for k in range(length):
        covered[k:k + len(holders)] |= chosen
    if covered.sum() < COVERED * n_words:
        for word in np.flatnonzero(~covered):
            over = np.arange(max(0, word - length + 1), min(word, len(holders) - 1) + 1)
            chosen[over[holders[over].argmin()]] = True
    return np.flatnonzero(chosen)


def passages(docs: DataFrame, packed: np.ndarray, reach: int) -> DataFrame:
    """(doc_id, first, words, seeds) of stretches within ``reach`` words of a run that may be a seed."""
    schema = "doc_id long, first int, words binary, seeds array<long>"
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches):
        for ids, texts in common.chunks(batches):
            w = common.Words([plain(t) for t in texts])
            grams = common.gram_hashes(w.hashes, SEED)
            at = np.flatnonzero(common.in_map(shared.value, grams))
            owner = np.searchsorted(w.ranges, at, side="right") - 1
            inside = at + SEED <= w.ranges[owner + 1]
            at, owner = at[inside], owner[inside]
            cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (np.diff(at) > reach))) if len(at) else np.zeros(0, np.int64)
            rows = []
            for k in np.flatnonzero((np.diff(w.ranges) > 0) & (np.diff(w.ranges) < SEED)):
                whole = _runs(w.hashes[w.ranges[k]:w.ranges[k + 1]])
                if common.in_map(shared.value, whole).any():
                    rows.append((ids[k], 0, b" ".join(plain(texts[k]).split()), whole.view(np.int64).tolist()))
            for k, (a, b) in enumerate(zip(cut, np.append(cut[1:], len(at)))):
                o = owner[a]
                first, last = max(at[a] - reach, w.ranges[o]), min(at[b - 1] + SEED + reach, w.ranges[o + 1])
                text = b" ".join(w.buffer[w.starts[first]:w.ends[last - 1]].split())
                rows.append((ids[o], int(first - w.ranges[o]), text, np.unique(grams[at[a:b]]).view(np.int64).tolist()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))], names=[c.split()[0] for c in schema.split(", ")])

    return common.keyed(docs).mapInArrow(run, schema)


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the passage place where it ends (exclusive)."""
    step = np.arange(len(passage) + 1) * -GAP
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        row = np.zeros(len(passage) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(passage == word, MATCH, MISMATCH), above[1:] + GAP)
        row = np.maximum(np.maximum.accumulate(np.maximum(row, 0) + step) - step, 0)    # gaps along the passage
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
        above = row
    return best, end


def score(item: list[bytes], passage: list[bytes], threshold: float) -> tuple[float, int, int] | None:
    """(share of the best possible score, first, end place in the passage), if the share reaches the threshold."""
    need = threshold * MATCH * len(item)
    numbers: dict[bytes, int] = {}
    a = np.array([numbers.setdefault(x, len(numbers)) for x in item])
    b = np.array([numbers.get(x, -1) for x in passage])
    # No alignment matches more words than both have in common.
    common_words = np.minimum(np.bincount(a), np.bincount(b[b >= 0], minlength=len(numbers))).sum()
    if MATCH * common_words < need:
        return None
    best, end = align(a, b)
    if best < need:
        return None
    _, back = align(a[::-1], b[:end][::-1])
    return best / (MATCH * len(item)), end - back, end


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, first_word, n_words): each pair of a document and an item it holds.

    ``score`` is the alignment score over the item's best possible one, at least
    ``threshold``; the place counts plain words. Null or empty texts hold nothing; rows of
    one id count as one document and give one row per item, the best; items of fewer
    than three words match only documents that consist of those words. Each text of an ``item_id`` that occurs more than once is
    an item of its own, reported under that id. Null ids are reported as null; so are items
    without an id, unless the same words have one.
    """
    spark: SparkSession = docs.sparkSession
    table = item_table(items)
    seeds = table.select("row", F.explode("seeds").alias("seed"))
    reach = table.agg(F.max("n_words")).first()[0] or 1
    found = passages(docs, common.bit_map(seeds.select(F.col("seed").alias("hash")).distinct()), reach)
    found = common.stored(found.withColumn("passage", F.monotonically_increasing_id()), "benchmark-passages")
    met = (found.select("passage", F.explode("seeds").alias("seed")).join(seeds, "seed")
           .select("passage", "row").distinct())
    pairs = (met.join(found.select("passage", "doc_id", "first", "words"), "passage")
             .join(table.select("row", "item_id", F.col("words").alias("item")), "row"))
    schema = "doc_id long, item_id long, score double, first_word long, n_words long"

    def run(batches):
        known: dict = {}
        for batch in batches:
            rows = []
            for doc, row, item_id, first, words, item in zip(*[batch.column(k).to_pylist() for k in range(6)]):
                key = (row, words)
                if key not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[key] = score(item.split(), words.split(), threshold)
                if known[key]:
                    share, start, end = known[key]
                    rows.append((doc, item_id, share, first + start, end - start))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=[c.split()[0] for c in schema.split(", ")])

    hits = pairs.select("doc_id", "row", "item_id", "first", "words", "item").mapInArrow(run, schema)
    best = hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", (-F.col("first_word")).alias("at"), "n_words")).alias("b"))
    return best.select("doc_id", "item_id", "b.score", (-F.col("b.at")).alias("first_word"), "b.n_words")


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Documents that hold no item. Rows of one id go or stay together; so do rows without an id."""
    leaks = contaminated(docs, items, threshold).select(F.col("doc_id").alias("_leak")).distinct()
    leaks = common.stored(leaks, "benchmark-leaks")
    return docs.join(leaks, docs["doc_id"].cast("long").eqNullSafe(leaks["_leak"]), "left_anti")
