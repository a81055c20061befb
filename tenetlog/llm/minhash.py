"""Near-duplicates: circulant MinHash, banding, and exact Jaccard verification.

One permutation places a shingle's hash on a circle of ``UNIVERSE`` cells, a second one
ranks the cells; coordinate k of a signature is the least rank after turning the ranks by
k cells. So one contiguous slice of the second permutation holds all coordinates of a
shingle. ``ROWS`` coordinates make a band; with ``BANDS`` of them a pair of similarity
0.8 meets in some band but for about four pairs in ten million, and more similar ones
surely.

Rows with equal shingle sets are one node, whatever their ids: a node is told by its set,
so rows that share an id but not a text are judged each on its own. In each bucket the least node is compared with
all others, on full sets. Nodes of a bucket that are still in different components after
that are compared with each other too, so no pair that met in a bucket stays unjudged
unless both are connected already.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.llm import common
from tenetlog.llm.components import components

BANDS, ROWS = 48, 6
UNIVERSE = 1 << 20
PERCENT = 80
CLASS_WORDS = 16       # words of 64 bits that say which hash classes a set touches
SLICE = 256            # shingles whose coordinates are reduced at once
SIGNATURES = "doc_id long, n_shingles long, text_hash long, set_a long, set_b long, bands array<long>"


class Permutations:
    """The two permutations; made from a fixed seed in each worker, never shipped."""

    def __init__(self):
        rng = np.random.default_rng(4711)
        self.place = rng.permutation(UNIVERSE).astype(np.int32)
        rank = rng.permutation(UNIVERSE).astype(np.int32)
        count = BANDS * ROWS
        self.turned = np.lib.stride_tricks.sliding_window_view(np.concatenate([rank, rank[:count - 1]]), count)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        at = self.place[(shingles >> np.uint64(44)).astype(np.int64)]
        least = self.turned[at[:SLICE]].min(0)
        for k in range(SLICE, len(at), SLICE):
            np.minimum(least, self.turned[at[k:k + SLICE]].min(0), out=least)
        return least


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text; fewer words than a shingle has make one."""
    w = common.Words([t.lower() for t in texts])      # bytes: lower() changes A-Z alone
    grams = common.gram_hashes(w.hashes, words)
    found = []
    for first, end in zip(w.ranges[:-1], w.ranges[1:]):
        if end - first >= words:
            values = np.sort(grams[first:end - words + 1])
            found.append(values[np.append(True, values[1:] != values[:-1])])
        elif end > first:
            found.append(common.gram_hashes(w.hashes[first:end], end - first))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def _set_sums(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit sums that together tell a set from others."""
    return [np.array([(common.mixed(s + np.uint64(c)).sum(dtype=np.uint64) if len(s) else 0) for s in sets], np.uint64).view(np.int64)
            for c in (1, 2)]


def _text_hashes(texts: list[bytes]) -> pa.Array:
    """What ``xxhash64`` of Spark gives for the same texts; a null text counts as the empty one."""
    return pa.array(np.array([xxhash.xxh64_intdigest(t, seed=42) for t in texts], np.uint64).view(np.int64))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    names = [c.split()[0] for c in SIGNATURES.split(", ")]
    salt = common.mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
    turn = np.uint64(0x9E3779B97F4A7C15)

    def run(batches):
        hashing = Permutations()
        for ids, texts in common.chunks(batches):
            sets = shingle_sets(texts, words)
            full = [k for k, s in enumerate(sets) if len(s)]
            rank = np.array([hashing.signature(sets[k]) for k in full], np.uint64).reshape(len(full), BANDS, ROWS)
            band = np.tile(salt, (len(full), 1))
            for r in range(ROWS):
                band = band * turn + rank[:, :, r] + np.uint64(1)
            sizes = np.array([len(s) for s in sets], np.int64)
            sums = _set_sums(sets)
            ends = np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes), _text_hashes(texts), *map(pa.array, sums),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(common.mixed(band).view(np.int64).ravel()))], names=names)

    return common.keyed(docs).mapInArrow(run, SIGNATURES)


def sets_of(docs: DataFrame, words: int, ids_map: np.ndarray) -> DataFrame:
    """(doc_id, set_a, set_b, shingles, bits): full sets as sorted 64-bit hashes, and which hash classes they touch.

    Of the documents whose ids may be in ``ids_map``: others pass too, and more of them the fuller it is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ids_map)

    def passing(batches):
        for batch in batches:
            hashes = batch.column(2).to_numpy().view(np.uint64)
            yield batch.filter(pa.array(common.in_map(shared.value, hashes)))

    def run(batches):
        for ids, texts in common.chunks(passing(batches)):
            sets = shingle_sets(texts, words)
            sums = _set_sums(sets)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            classes = np.zeros((len(sets), 64 * CLASS_WORDS), np.uint8)
            for k, s in enumerate(sets):
                classes[k, (s >> np.uint64(20)) % np.uint64(64 * CLASS_WORDS)] = 1
            bits = np.packbits(classes, axis=1).view(np.int64).reshape(len(sets), CLASS_WORDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * CLASS_WORDS), pa.array(bits.ravel()))],
                names=["doc_id", "set_a", "set_b", "shingles", "bits"])

    return common.keyed(docs).withColumn("hash", F.xxhash64("doc_id")).mapInArrow(
        run, "doc_id long, set_a long, set_b long, shingles array<long>, bits array<long>")


def similar_sizes(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(left, "a").join(right, "b")
            .where(both * 100 >= (F.size("_a") + F.size("_b") - both) * PERCENT).select("a", "b"))


def _clustered(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, text_hash, component, component_id), one row per input row.

    ``component`` names the component of a row with shingles; ``component_id`` is its least
    document id. Both are null where there is none.
    """
    rows = common.stored(signatures(docs, words), "minhash-signatures")
    sets_seen = ["set_a", "set_b", "n_shingles"]
    filled = rows.where("n_shingles > 0 and doc_id is not null")
    # Nodes are numbered in the order of their least ids, so the least node of a bucket is its first document.
    # The numbers are fixed once they are written.
    nodes = common.stored(filled.groupBy(*sets_seen).agg(F.min("doc_id").alias("doc_id")).repartitionByRange("doc_id", "set_a")
                          .sortWithinPartitions("doc_id", "set_a", "set_b").withColumn("node", F.monotonically_increasing_id()), "minhash-nodes")
    signed = filled.groupBy(*sets_seen).agg(F.any_value("bands").alias("bands")).join(nodes.drop("doc_id"), sets_seen)
    places = common.stored(signed.select("node", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")), "minhash-bands")
    pivots = places.groupBy("key").agg(F.min(F.struct("node", "n")).alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = common.stored(places.join(pivots, "key").select("key", "node", "n", "members", F.col("pivot.node").alias("p"),
                                                             F.col("pivot.n").alias("pn")), "minhash-shared")
    common.drop_stored(places)
    wanted = common.stored(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "set_a", "set_b"),
                           "minhash-wanted")
    # No text is shuffled: a map of fixed size tells tasks which texts may be wanted, the join which ones are.
    ids_map = common.bit_map(wanted.select(F.xxhash64("doc_id").alias("hash")))
    own = ["doc_id", "set_a", "set_b"]      # one shuffle for the join and for repeated rows
    sets = common.stored(sets_of(docs, words, ids_map).join(wanted, own).dropDuplicates(own)
                         .select("node", "shingles", "bits"), "minhash-sets")
    tested = shared.where((F.col("node") != F.col("p")) & similar_sizes(F.col("n"), F.col("pn"))).select(
        F.col("p").alias("a"), F.col("node").alias("b")).distinct()
    links = common.stored(verified(tested, sets), "minhash-links")
    labels = common.stored(components(links), "minhash-labels")
    more = common.stored(verified(_open_pairs(shared, labels, sets), sets), "minhash-links")
    if not more.isEmpty():
        labels = common.stored(components(links.unionAll(more)), "minhash-labels")
    common.drop_stored(sets)
    least = labels.join(nodes.select("node", "doc_id"), "node").groupBy("label").agg(F.min("doc_id").alias("least"))
    named = (nodes.select("node", "set_a", "set_b", "doc_id").join(labels.join(least, "label"), "node", "left")
             .select("set_a", "set_b", F.coalesce("label", "node").alias("component"), F.coalesce("least", "doc_id").alias("component_id")))
    # Rows without shingles have no set; their zero sums meet no node.
    return rows.drop("bands").join(named, ["set_a", "set_b"], "left").select(
        "doc_id", "n_shingles", "text_hash", *[F.when(F.col("n_shingles") > 0, F.col(c)).alias(c) for c in ("component", "component_id")])


def cluster(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    ``component_id`` is the least id reachable over links. Null and empty texts, and texts
    without words, have no shingles and stay alone. Rows of one id with equal texts give
    equal rows; with different texts each is linked by its own, so a component may hold one of
    them only. A row without an id has the component of the documents with its shingles, or none.
    An empty table gives no rows. The result does not depend on the order of the rows.
    """
    return _clustered(docs, words).select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _open_pairs(shared: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of one bucket that no comparison has judged, no path connects, and counts don't rule out.

    Two bounds of the intersection: shingles that no other such node has can't be common
    to a pair; nor can those of a hash class that the other set does not touch.
    """
    of_pivot = labels.select(F.col("node").alias("p"), F.col("label").alias("main"))
    rows = (shared.where("members > 2").join(labels, "node", "left").join(of_pivot, "p", "left")
            .select("key", "node", "p", "n", F.coalesce("label", "node").alias("label"), F.coalesce("main", "p").alias("main")))
    undecided = rows.where("label <> main").select("key").distinct()
    rest = common.stored(rows.where("node <> p").join(undecided, "key").select("key", "node", "n", "label", "main"), "minhash-open")
    held = rest.select("node").distinct().join(sets, "node").select("node", F.explode("shingles").alias("shingle"))
    alone = held.groupBy("shingle").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("holders")).where("holders = 1")
    bits = [f"bits{k}" for k in range(CLASS_WORDS)]
    classes = sets.select("node", *[F.col("bits")[k].alias(c) for k, c in enumerate(bits)])
    most = (rest.join(alone.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "node", "left")
            .withColumn("most", F.col("n") - F.coalesce("own", F.lit(0))).where(F.col("most") * 100 >= F.col("n") * PERCENT)
            .join(classes, "node").select("key", "node", "n", "label", "main", "most", *bits))
    other = most.select("key", *[F.col(c).alias(f"_{c}") for c in ("node", "n", "label", "most", *bits)])
    absent = lambda x, y: reduce(lambda a, b: a + b, [F.bit_count(F.col(x + c).bitwiseAND(F.bitwise_not(F.col(y + c)))) for c in bits])
    reaches = lambda both: both * (100 + PERCENT) >= (F.col("n") + F.col("_n")) * PERCENT
    # Nodes of the pivot's component need no comparison with each other: they are connected.
    met = most.where("label <> main").join(other, "key").where(
        (F.col("label") != F.col("_label")) & reaches(F.col("most")) & reaches(F.col("_most"))
        & reaches(F.col("n") - absent("", "_")) & reaches(F.col("_n") - absent("_", "")))
    return met.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def one_of_each(docs: DataFrame, words: int = 5) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the one with the least id.

    Rows without an id or without words stay. Where several rows of a component have its
    least id, the text with the least hash stays, once. Rows that share an id but are no copies
    of each other are judged each on its own. An empty table gives no rows.
    """
    judged = _clustered(docs, words).where("doc_id is not null and component is not null")
    place = F.struct("doc_id", "text_hash")
    first = judged.groupBy("component").agg(F.min(place).alias("first"))
    copies = common.stored(judged.groupBy("component", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("rows"))
                           .join(first, "component").where((place != F.col("first")) | (F.col("rows") > 1))
                           .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_text"), (place == F.col("first")).alias("_first")),
                           "minhash-copies")
    same = (docs["doc_id"].cast("long") == F.col("_id")) & (
        F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))) == F.col("_text"))
    left = docs.join(copies, same, "left_anti")
    twice = copies.where("_first")
    if twice.isEmpty():
        return left
    again = docs.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"])
    return left.unionAll(again)
