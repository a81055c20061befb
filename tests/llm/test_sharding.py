import itertools
import random
import zlib
from collections import defaultdict

from tenetlog.llm import sharding


def test_minimax_equals_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        shards = rng.randint(1, 5)
        best = min(max(sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cut, len(sizes))))
                   for n in range(min(shards, len(sizes))) for cut in itertools.combinations(range(1, len(sizes)), n))
        starts = sharding.minimax(sizes, shards)
        assert len(starts) <= shards
        assert max(sum(sizes[a:b]) for a, b in itertools.pairwise((*starts, len(sizes)))) == best


def test_the_smallest_shard_is_as_large_as_it_can_be():
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randint(1, 9) for _ in range(rng.randint(1, 8))]
        used = min(rng.randint(1, 5), len(sizes))
        parts = [[sum(sizes[a:b]) for a, b in itertools.pairwise((0, *cut, len(sizes)))] for cut in itertools.combinations(range(1, len(sizes)), used - 1)]
        least = min(max(p) for p in parts)
        starts = sharding.minimax(sizes, used)
        load = [sum(sizes[a:b]) for a, b in itertools.pairwise((*starts, len(sizes)))]
        assert (max(load), min(load)) == (least, max(min(p) for p in parts if max(p) == least)) and len(load) == used


def test_a_hot_block_stands_alone():
    found = sharding.plan([(k, 10) for k in range(100)] + [(100, 5000)], 11)
    load = defaultdict(int)
    for block, shard in found.items():
        load[shard] += 5000 if block == 100 else 10
    assert sorted(load.values()) == [100] * 10 + [5000]


def test_the_last_shard_is_no_remainder():
    rng = random.Random(4)
    for shards in (3, 10, 40):
        sizes = [rng.randint(1, 100) for _ in range(1000)]
        starts = sharding.minimax(sizes, shards)
        load = [sum(sizes[a:b]) for a, b in itertools.pairwise((*starts, len(sizes)))]
        assert len(load) == shards and max(load) - sum(sizes) / shards <= 100 and sum(sizes) / shards - min(load) <= 100


def check(rows, texts, shards):
    slots, of_text, load = defaultdict(list), {}, defaultdict(int)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.law == "bytes" and r.grown_shard is None
        assert r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(raw))
        assert of_text.setdefault(texts[r.doc_id], r.shard) == r.shard and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_ties_nulls_and_copies(docs_of):
    texts = ["same"] * 50 + [None, None, "", "", "é"] + [f"text {k}" for k in range(100)]
    rows = sharding.shard_table(docs_of(texts), 7).collect()
    assert len(rows) == len(texts)
    check(rows, texts, 7)
    assert sharding.shard_table(docs_of([])).count() == 0
    assert len({r.slot for r in sharding.shard_table(docs_of([(1, "a")] * 9 + [(None, None)])).collect() if r.doc_id}) == 9


def test_given_documents_are_near_equal(spark, sf):
    docs = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    load = check(sharding.shard_table(docs).collect(), texts, 40)
    mean, group = sum(load.values()) / 40, max(len((t or "").encode()) + 16 for t in texts.values())
    assert len(load) == 40 and max(load.values()) - mean <= group and mean - min(load.values()) <= group
    assert 0.75 * mean < min(load.values()) and max(load.values()) < 1.25 * mean       # groups hold up to 0.7 of the mean
