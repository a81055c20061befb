"""Substring dedup: repeated word windows, found by FM-indexes over content shards.

1. Every window of ``window`` words is named by its minimizer, the leftmost least hash of
   its ``GRAM``-word runs: equal windows have equal minimizers at equal places. Windows in
   a row with one minimizer form a segment. Minimizers that occur once in the corpus
   can't belong to a repeated window; only segments of the others go on.
2. Segments are sharded by minimizer, so equal windows meet in one shard. Equal segments
   collapse to one with a count; where the count is over one, all its windows repeat.
3. A shard indexes its distinct segments once: a Burrows-Wheeler transform in a wavelet
   matrix of packed bits. The windows of single segments are streamed through it by
   backward search; a window whose whole length still has two occurrences repeats.
4. The repeated windows return to their texts as intervals.

Texts are told apart by a 128-bit content hash, so copies of a text are searched once; all
windows of a text that occurs twice repeat. A minimizer with more than ``HOT`` occurrences
is not one shard's work: each of its windows is grouped by its own 128-bit hash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenetlog.llm import common

WINDOW, GRAM = 35, 8
HOT = 2_000              # occurrences from which a minimizer's windows are grouped one by one
SHARD_WORDS = 250_000    # words that one FM-index holds, about
LANES = 16_384           # windows that are searched side by side
_EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def runs(w: common.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of a chunk: (owning text, first window, number of windows, minimizer); windows count by words of the chunk."""
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    gram = min(GRAM, window)
    span = window - gram + 1
    if len(w.hashes) < window:
        return nothing
    grams = common.gram_hashes(w.hashes, gram)
    windows = np.lib.stride_tricks.sliding_window_view(grams, span)
    least = np.concatenate([windows[k:k + 65_536].argmin(1) for k in range(0, len(windows), 65_536)]) + np.arange(len(windows))
    owner = np.repeat(np.arange(len(w)), np.diff(w.ranges))
    first = np.flatnonzero(owner[window - 1:] == owner[:len(owner) - window + 1])
    if not len(first):
        return nothing
    place = least[first]
    begins = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (owner[first[1:]] != owner[first[:-1]])))
    count = np.diff(np.append(begins, len(first)))
    return owner[first[begins]], first[begins], count, grams[place[begins]]


def text_hash(column: str = "text"):
    return F.xxhash64(F.lit(1), column).alias("h1"), F.xxhash64(F.lit(2), column).alias("h2")


def summaries(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, h1, h2, n_words, whole_sha256, minimizers) of every whole text."""
    schema = "doc_id long, h1 long, h2 long, n_words long, whole_sha256 string, minimizers array<long>"

    def run(batches):
        for batch in batches:
            for at, texts in common.chunks([pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(1)], names=["k", "t"])]):
                w = common.Words(texts)
                owner, _, _, found = runs(w, window)
                ends = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                sha = [hashlib.sha256(b" ".join(w.words_of(k))).hexdigest() for k in range(len(texts))]
                rows = batch.select([0, 2, 3]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.diff(w.ranges)), pa.array(sha),
                     pa.ListArray.from_arrays(pa.array(ends), pa.array(found.view(np.int64)))],
                    names=[c.split()[0] for c in schema.split(", ")])

    return common.keyed(docs).select("doc_id", "text", *text_hash()).mapInArrow(run, schema)


def segments(texts: DataFrame, window: int) -> DataFrame:
    """Segments of texts (h1, h2, text, wanted: array of (minimizer, hot)).

    ``part`` holds a segment's words; of a hot minimizer there is one row per window, without
    words, and ``mini`` is the window's hash. ``mini`` and ``other`` are 128 bits of content.
    """
    schema = "h1 long, h2 long, start int, count int, mini long, other long, part binary"

    def run(batches):
        for batch in batches:
            wanted = batch.column(3).to_pylist()
            for at, raw in common.chunks([pa.RecordBatch.from_arrays([pa.array(range(len(batch))), batch.column(2)], names=["k", "t"])]):
                w = common.Words(raw)
                owner, first, count, mini = runs(w, window)
                pick = {(k, x["mini"]): x["hot"] for k, t in enumerate(at) for x in wanted[t]}
                hot = [pick.get(x) for x in zip(owner.tolist(), mini.view(np.int64).tolist())]
                # A second hash family for the other 64 bits.
                second = common.mixed(w.hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
                one, two = common.gram_hashes(w.hashes, window), common.gram_hashes(second, window)
                rows = []
                for k, (is_hot, o, f, n, m) in enumerate(zip(hot, owner.tolist(), first.tolist(), count.tolist(), mini.view(np.int64).tolist())):
                    if is_hot is None:
                        continue
                    inside = f - int(w.ranges[o])
                    if is_hot:
                        rows += [(at[o], inside + j, 1, a, b, None) for j, (a, b) in enumerate(zip(
                            one[f:f + n].view(np.int64).tolist(), two[f:f + n].view(np.int64).tolist()))]
                    else:
                        part = b" ".join(w.buffer[w.starts[f]:w.ends[f + n + window - 2]].split())
                        rows.append((at[o], inside, n, m, None, part))
                if rows:
                    where, start, n, m, other, part = zip(*rows)
                    other = [int.from_bytes(hashlib.blake2b(p, digest_size=8).digest(), "little", signed=True) if p is not None else x
                             for p, x in zip(part, other)]
                    source = batch.select([0, 1]).take(pa.array(where))      # never the text, which is long
                    yield pa.RecordBatch.from_arrays(
                        [source.column(0), source.column(1), pa.array(start, pa.int32()), pa.array(n, pa.int32()), pa.array(m, pa.int64()),
                         pa.array(other, pa.int64()), pa.array(part, pa.binary())], names=[c.split()[0] for c in schema.split(", ")])

    return texts.select("h1", "h2", "text", "wanted").mapInArrow(run, schema)


class FmIndex:
    """Backward search over sequences of symbols >= 1; a 0 ends each sequence."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """``depth``: length of the longest pattern; suffixes are ordered by that many symbols."""
        n = len(symbols)
        self.n, self.top = n, int(symbols.max(initial=0))
        _, rank = np.unique(symbols, return_inverse=True)
        step, order = 1, np.argsort(rank, kind="stable")
        while step < depth and int(rank.max(initial=0)) < n - 1:
            later = np.zeros(n, np.int64)
            later[:n - step] = rank[step:] + 1
            key = rank.astype(np.int64) * (n + 1) + later
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            step *= 2
        counts = np.bincount(symbols, minlength=self.top + 2)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self._build(symbols[order - 1])
        self.origin = self._follow(np.zeros(self.top + 1, np.int64), np.arange(self.top + 1))

    def _build(self, bwt: np.ndarray) -> None:
        self.levels = []
        for level in reversed(range(max(1, self.top.bit_length()))):
            bits = ((bwt >> level) & 1).astype(np.uint8)
            packed = np.packbits(np.append(bits, np.zeros(64 - len(bits) % 64, np.uint8)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32)
            self.levels.append((level, packed, before, len(bits) - int(bits.sum())))
            bwt = np.concatenate([bwt[bits == 0], bwt[bits == 1]])

    def _follow(self, at: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Places after all levels of the wavelet matrix, for places ``at`` and the path of ``symbols``."""
        for level, packed, before, zeros in self.levels:
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[block] + np.bitwise_count(packed[block] & mask)
            at = np.where((symbols >> level) & 1, zeros + ones, at - ones)
        return at

    def extend(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns that have one more symbol in front."""
        base = self.first[symbols] - self.origin[symbols]
        return self._follow(low, symbols) + base, self._follow(high, symbols) + base

    def matches(self, text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
        """For each last place: how many symbols before and at it, up to ``length``, occur together at least twice."""
        found = np.zeros(len(ends), np.int64)
        for k in range(0, len(ends), LANES):
            alive = np.arange(k, min(k + LANES, len(ends)))
            symbols = text[ends[alive]]
            low, high = self.first[symbols], self.first[symbols + 1]
            for step in range(1, length + 1):
                more = high - low >= 2
                alive, low, high = alive[more], low[more], high[more]
                found[alive] = step
                if step == length or not len(alive):
                    break
                low, high = self.extend(low, high, text[ends[alive] - step])
        return found


def shard_masks(parts: list[bytes], counts: list[int], window: int) -> list[int]:
    """Of each distinct segment of a shard: bit k is set if its window k occurs twice or more."""
    w = common.Words(parts)
    _, symbols = np.unique(w.hashes, return_inverse=True)
    sizes = np.diff(w.ranges)
    text = np.zeros(len(symbols) + len(parts), np.int64)
    place = np.arange(len(symbols)) + np.repeat(np.arange(len(parts)), sizes)
    text[place] = symbols + 1
    masks = [(1 << int(n - window + 1)) - 1 if c > 1 else 0 for n, c in zip(sizes, counts)]
    single = [k for k, c in enumerate(counts) if c == 1]
    if single and len(parts) > 1:
        index = FmIndex(text, window)
        starts = w.ranges[:-1] + np.arange(len(parts))
        ends = np.concatenate([np.arange(starts[k] + window - 1, starts[k] + sizes[k]) for k in single])
        owner = np.repeat(single, sizes[single] - window + 1)
        for k, end in zip(owner[hit := index.matches(text, ends, window) >= window].tolist(), ends[hit].tolist()):
            masks[k] |= 1 << (end - int(starts[k]) - window + 1)
    return masks


def repeated_windows(parts: DataFrame, window: int) -> DataFrame:
    """(mini, other, mask) of segments and hot windows that hold repeated windows."""
    distinct = common.stored(parts.groupBy("mini", "other", "part").agg(F.count(F.lit(1)).alias("n")), "segments-distinct")
    hot = distinct.where("part is null and n > 1").select("mini", "other", F.lit(1).cast("long").alias("mask"))
    size = distinct.agg(F.sum(F.octet_length("part"))).first()[0] or 0
    shards = max(1, int(size / 6 // SHARD_WORDS) + 1)

    def run(batches):
        held = [b for b in batches if len(b)]
        if held:
            shard = pa.Table.from_batches(held)
            masks = shard_masks(shard["part"].to_pylist(), shard["n"].to_pylist(), window)
            yield from pa.table({"mini": shard["mini"], "other": shard["other"], "mask": pa.array(masks, pa.int64())}).to_batches()

    indexed = (distinct.where("part is not null").repartition(shards, "mini").select("mini", "other", "part", "n")
               .mapInArrow(run, "mini long, other long, mask long").where("mask <> 0"))
    return hot.unionAll(indexed)


def kept_words(texts: DataFrame, window: int) -> DataFrame:
    """(h1, h2, n_removed, kept) from (h1, h2, text, found: array of (start, mask))."""
    schema = "h1 long, h2 long, n_removed long, kept string"

    def run(batches):
        for batch in batches:
            removed, kept = [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = text.encode("utf-8", "surrogatepass").split()
                cover = np.zeros(len(words) + 1, np.int64)
                start = np.array([x["start"] for x in found], np.int64)
                mask = np.array([x["mask"] for x in found], np.int64)
                for bit in range(window):
                    at = start[(mask >> bit) & 1 == 1] + bit
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                stays = np.cumsum(cover[:-1]) == 0
                removed.append(int(len(words) - stays.sum()))
                kept.append(b" ".join([words[k] for k in np.flatnonzero(stays)]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=["h1", "h2", "n_removed", "kept"])

    return texts.select("h1", "h2", "text", "found").mapInArrow(run, schema)


def find_repeats(docs: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(rows, changed): a summary row per input row, and (h1, h2, n_removed, kept) of texts that lose words but stay single.

    ``rows``: doc_id, h1, h2, n_words, whole_sha256, copies (rows with that text).
    """
    if window > 62:
        raise ValueError("a segment's windows must fit the bits of a LONG")
    rows = common.stored(summaries(docs, window), "segments-rows")
    texts = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.any_value("minimizers").alias("minimizers"))
    texts = common.stored(texts, "segments-texts")
    each = texts.select("h1", "h2", F.explode("minimizers").alias("mini"))
    often = each.groupBy("mini").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mini", (F.col("n") > HOT).alias("hot"))
    wanted = (each.distinct().join(often, "mini").groupBy("h1", "h2").agg(F.collect_list(F.struct("mini", "hot")).alias("wanted")))
    held = (common.keyed(docs).select("text", *text_hash()).join(wanted, ["h1", "h2"]).dropDuplicates(["h1", "h2"]))
    held = common.stored(held.select("h1", "h2", "text", "wanted"), "segments-held")
    parts = common.stored(segments(held, window), "segments-parts")
    masks = common.stored(repeated_windows(parts, window), "segments-masks")
    single = texts.where("copies = 1").select("h1", "h2")
    found = (parts.select("h1", "h2", "start", "mini", "other").join(masks, ["mini", "other"]).join(single, ["h1", "h2"], "left_semi")
             .groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "mask")).alias("found")))
    changed = common.stored(kept_words(held.select("h1", "h2", "text").join(found, ["h1", "h2"]), window), "segments-changed")
    for done in (held, parts, masks):
        common.drop_stored(done)
    return rows.drop("minimizers").join(texts.select("h1", "h2", "copies"), ["h1", "h2"]), changed


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row.

    Null texts have no words. Every row is a document, repeated rows and ids included, so
    rows with equal texts repeat each other. An empty table gives no rows.
    """
    rows, changed = find_repeats(docs, window)
    copied = (F.col("copies") > 1) & (F.col("n_words") >= window)
    return (rows.join(changed, ["h1", "h2"], "left")
            .select("doc_id", "n_words",
                    F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                    F.when(copied, F.lit(_EMPTY_SHA)).when(F.col("kept").isNull(), F.col("whole_sha256"))
                    .otherwise(F.sha2(F.col("kept").cast("binary"), 256)).alias("kept_sha256")))


def cleaned(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated windows taken out of the texts; texts without any stay as they are."""
    rows, changed = find_repeats(docs, window)
    emptied = (rows.where((F.col("copies") > 1) & (F.col("n_words") >= window)).select("h1", "h2").distinct()
               .withColumn("kept", F.lit("")))
    new = common.stored(changed.select("h1", "h2", "kept").unionAll(emptied), "segments-new")
    named = docs.withColumn("_h1", text_hash()[0]).withColumn("_h2", text_hash()[1])
    new = new.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("kept").alias("_kept"))
    return (named.join(new, ["_h1", "_h2"], "left").withColumn("text", F.coalesce("_kept", "text"))
            .drop("_h1", "_h2", "_kept").select(*docs.columns))
