import random

import numpy as np
import pytest

from tenetlog.llm import decontamination as dc

MEDIUM = "/root/testdata/sf0.01"


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 5, rng.integers(1, 15)) for _ in range(2))
        best, end = dc.align(a, b)
        assert best == brute_align(a, b) == brute_align(a, b[:end])


@pytest.fixture
def items(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "of", "and", f"q{rng.randrange(4000)}"]) for _ in range(rng.randrange(15, 50))) for _ in range(40)]
    return texts, spark.createDataFrame([*enumerate(texts), (100, None), (101, ""), (102, "the of"), (103, texts[0]), (None, texts[1])],
                                        "item_id long, text string")


def test_planted_copies(docs_of, items):
    texts, table = items
    rng = random.Random(6)
    noise = lambda n: " ".join(rng.choice(["the", "of", "and", f"z{rng.randrange(9000)}"]) for _ in range(n))
    docs, truth = [None, "", "the of and the", noise(3000)], set()
    for k, t in enumerate(texts):
        words = t.split()
        for form in range(4):
            copy = list(words)
            if form == 1:
                copy = [w.upper() + "," for w in copy]
            if form == 2:
                for _ in range(len(copy) // 8):
                    copy[rng.randrange(len(copy))] = "changed"
            if form == 3:
                del copy[len(copy) // 2]
                copy.insert(3, "extra")
            truth.add((len(docs), k))
            docs.append(f"{noise(rng.randrange(300))}\n{' '.join(copy)} {noise(rng.randrange(300))}")
        docs.append(noise(50) + " " + " ".join(words[:len(words) // 3]) + " " + noise(50))
    rows = dc.contaminated(docs_of(docs), table).collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert {f for f in found if f[1] != 103} == truth and {f[0] for f in found if f[1] == 103} == {f[0] for f in found if f[1] == 0}
    assert all(dc.THRESHOLD <= r.score <= 1 for r in rows)
    r = next(r for r in rows if (r.doc_id, r.item_id) == (4, 0))
    assert r.score == 1 and docs[4].split()[r.first_word:r.first_word + r.n_words] == texts[0].split()
    kept = dc.without_leaks(docs_of(docs), table)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {f[0] for f in found} and kept.columns == docs_of([]).columns


def test_repeated_rows_null_ids_and_empty_tables(docs_of, items):
    texts, table = items
    rows = dc.contaminated(docs_of([(1, texts[3])] * 3 + [(None, texts[4]), (2, "fine")]), table).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 3), (None, 4)} and len(rows) == 2
    assert dc.contaminated(docs_of([]), table).count() == 0
    assert dc.contaminated(docs_of(texts), table.limit(0)).count() == 0


def test_clashing_and_null_item_ids(spark, docs_of, items):
    texts, _ = items
    rows = [(1, texts[0]), (1, texts[0]), (1, texts[0].upper() + "!"), (2, texts[1]), (2, texts[2]), (None, texts[3]), (None, texts[4]),
            (5, texts[5]), (None, texts[5])]
    table = spark.createDataFrame(rows, "item_id long, text string")
    docs = docs_of([*texts[:6], texts[6], f"{texts[1]} {texts[2]}"])
    found = dc.contaminated(docs, table).collect()
    assert sorted((r.doc_id, r.item_id or 0) for r in found) == [(0, 1), (1, 2), (2, 2), (3, 0), (4, 0), (5, 5), (7, 2)]
    assert all(r.score == 1 for r in found) and [r.doc_id for r in dc.without_leaks(docs, table).collect()] == [6]


def test_given_documents_equal_brute_force(spark):
    docs, items = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "benchmark"))
    bench = {r.item_id: dc.plain(r.text.encode()).split() for r in items.collect()}
    want = set()
    for r in docs.collect():
        words = dc.plain((r.text or "").encode()).split()
        grams = {tuple(words[k:k + 3]) for k in range(len(words) - 2)}
        for item, b in bench.items():
            if sum(tuple(b[k:k + 3]) in grams for k in range(len(b) - 2)) >= 2 and dc.score(b, words, dc.THRESHOLD):
                want.add((r.doc_id, item))
    assert {(r.doc_id, r.item_id) for r in dc.contaminated(docs, items).collect()} == want and want


def test_items_of_common_words_and_short_items(spark, docs_of):
    """Copies whose rare words all changed, and items shorter than a run; aligned pairs by brute force."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(60)]
    items = []
    for _ in range(60):
        words = [rng.choice(common) for _ in range(24)]
        for k in rng.sample(range(24), 4):
            words[k] = f"rare{rng.randrange(10 ** 6)}"
        items.append(words)
    items += [["two", "words"], ["one"], list("abc") * 6]
    docs = [" ".join(w if w.startswith("c") or rng.random() < 0.05 else "new" for w in b) for b in items]
    docs[60:] = ["Two, words!", "one", " ".join("abc" * 6), "two words more", "one two", "words two", "abc"]
    for b in items[:60]:
        copy = list(b)
        for k in rng.sample(range(24), rng.randrange(1, 7)):
            copy[k] = "edit"
        docs.append(" ".join(rng.choice(common) for _ in range(40)) + " " + " ".join(copy))
    table = spark.createDataFrame([(k, " ".join(b)) for k, b in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in dc.contaminated(docs_of(docs), table).collect()}
    want = {(d, i) for d, t in enumerate(docs) for i, b in enumerate(items)
            if (len(b) >= dc.SEED or dc.plain(t.encode()).split() == [w.encode() for w in b])
            and dc.score([w.encode() for w in b], dc.plain(t.encode()).split(), dc.THRESHOLD)}
    assert found <= want and len(found) >= 0.97 * len(want) > 100
    assert {(60, 60), (61, 61), (62, 62)} <= found and not {d for d, _ in found} & set(range(63, 67))


def test_seed_places_cover_items_without_rare_runs():
    few, many, limit = 1, 6, 5
    assert dc.seed_places(np.array([few] * 8), 10, limit).tolist() == list(range(8))
    assert dc.seed_places(np.array([many]), 2, limit).tolist() == [0]
    held = np.array([many, many + 3, many + 1, many, many + 9, many + 9, many + 2, many])
    covered = {w for p in dc.seed_places(held, 10, limit) for w in range(p, p + 3)}
    assert covered == set(range(10))
    assert dc.seed_places(np.array([few] * 6 + [many, many]), 10, limit).tolist() == list(range(6))
