import random
import re

import pytest

from tenetlog.llm import components, minhash


def shingles(text, n):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} - {()}


def brute(texts, n):
    """Component of each id, comparing every pair that shares a shingle."""
    sets = {k: shingles(t, n) for k, t in texts.items()}
    where, label = {}, {k: k for k in sets}
    for k, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(k)

    def root(k):
        while label[k] != k:
            k = label[k]
        return k
    for a, b in {(a, b) for ks in where.values() for a in ks for b in ks if a < b}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {k: root(k) for k in label}, {k: len(s) for k, s in sets.items()}


def check(rows, texts, n):
    component, sizes = brute(texts, n)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], component[r.doc_id], component[r.doc_id] == r.doc_id)


@pytest.mark.parametrize("n", [4, 5])
def test_small_texts_equal_brute_force(docs_of, n):
    rng = random.Random(n)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [None, "", "  \n", None, "one", "ONE", "one two", "one two three four", "é É", "É é", "é É"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([6, 20, 120, 400]))]
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    chain = [word() for _ in range(200)]
    for k in range(12):
        chain[k * 6:k * 6 + 3] = [word() for _ in range(3)]
        texts.append("\t".join(chain).upper())
    check(minhash.cluster(docs_of(texts), n).collect(), dict(enumerate(texts)), n)


def test_every_pair_of_a_bucket_is_judged(docs_of):
    """Copies around two centres that are no copies of each other, in one bucket or many."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(150)]
    texts = []
    for spots in ((10, 40, 80), (20, 60, 100)):
        centre = list(base)
        for s in spots:
            centre[s:s + 5] = [f"c{rng.random()}" for _ in range(5)]
        for _ in range(30):
            copy = list(centre)
            copy[rng.randrange(150)] = f"d{rng.random()}"
            texts.append(" ".join(copy))
    check(minhash.cluster(docs_of(texts)).collect(), dict(enumerate(texts)), 4)


def test_repeated_rows_and_empty_table(docs_of):
    rows = minhash.cluster(docs_of([(7, "a b c d e f")] * 3 + [(9, "A B C D E F"), (None, "x y z w"), (None, None)])).collect()
    assert len(rows) == 6 and sum(r.component_id == 7 for r in rows) == 4
    assert minhash.cluster(docs_of([])).count() == 0


def test_row_order_does_not_matter(docs_of):
    """One id with different texts, of which one has a near copy."""
    rng = random.Random(12)
    a, b = ([f"{x}{k}" for k in range(120)] for x in "ab")
    near = b[:60] + ["new"] + b[61:]
    rows = [(1, " ".join(a)), (1, " ".join(b)), (4, " ".join(near)), (6, " ".join(a)), (8, None), (8, "")]
    want = sorted([(1, 1), (1, 1), (4, 1), (6, 1), (8, 8), (8, 8)])
    for _ in range(3):
        rng.shuffle(rows)
        docs = docs_of(rows)
        assert sorted((r.doc_id, r.component_id) for r in minhash.cluster(docs).collect()) == want
        assert sorted((r.doc_id, r.text or "") for r in minhash.one_of_each(docs).collect()) == sorted(
            [(1, " ".join(a)), (1, " ".join(b)), (8, ""), (8, "")])


def test_one_row_of_copies_that_share_an_id(docs_of):
    words = [f"w{k}" for k in range(90)]
    low, up, other = " ".join(words), " ".join(words).upper(), " ".join(words[::-1])
    rows = [(3, low), (3, low), (3, up), (3, other), (5, up), (None, low), (2, "\t" + other)]
    kept = {}
    for order in (rows, rows[::-1]):
        found = [(r.doc_id, r.text) for r in minhash.one_of_each(docs_of(order)).collect()]
        kept[len(kept)] = sorted(found, key=repr)
    assert kept[0] == kept[1]
    assert len(kept[0]) == 3 and (None, low) in kept[0] and (2, "\t" + other) in kept[0]


def test_text_hash_is_the_one_of_spark(spark, docs_of):
    from pyspark.sql import functions as F
    docs = docs_of(["", "a", "abcdefg", "é" * 5, "x" * 31, "x" * 32, "words and more words " * 40])
    want = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    assert {r.doc_id: r.text_hash for r in minhash.signatures(docs, 4).collect()} == want


def test_text_above_a_chunk(docs_of):
    """A text larger than what is handled at once, with a near copy."""
    long = " ".join(f"w{k}" for k in range(400_000))
    assert len(long) > minhash.common.CHUNK_BYTES
    rows = minhash.cluster(docs_of([(5, long), (9, "short text of a few words"), (2, long + " and an end")])).collect()
    assert {(r.doc_id, r.component_id) for r in rows} == {(5, 2), (9, 9), (2, 2)}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(minhash.cluster(docs).collect(), {r.doc_id: r.text for r in docs.collect()}, 4)


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(200, 200 + k) for k in range(1, 40)] + [(5, 5)] + [
        (rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: v for k, v in label.items() if k != 5}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
