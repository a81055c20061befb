import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tenetlog.llm import spelling


def plain_words(docs, least=7, every=31):
    found = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            if len(word) >= least:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def plain_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(words):
    out = {}
    near_of = {w: [v for v in words if abs(len(v) - len(w)) < 2 and plain_near(w, v)] for w in words}
    for w, n in words.items():
        best = min(near_of[w], key=lambda v: (-words[v], v), default=None)
        out[w] = best if best is not None and words[best] >= 10 * n else None
    rows = set()
    for w, n in words.items():
        root = w
        while out[root] is not None:
            root = out[root]
        rows.add((w, out[w], root, n, len(near_of[w]), words[out[w]] if out[w] else None))
    return rows


def edited(rng, word):
    k, c = rng.randrange(len(word)), rng.choice("abcxyzéÖ")
    return rng.choice([word[:k] + word[k + 1:], word[:k] + c + word[k + 1:], word[:k] + c + word[k:]])


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 11))) for _ in range(n)]
    words += [edited(rng, rng.choice(words)) for _ in range(3 * n)]
    chain = ["hundredfold", "hundredfald", "hundrexfald", "xundrexfald"]
    texts = [" ".join(c for k, c in enumerate(chain) for _ in range(3000 // 12**k or 2))]
    return [(k, t) for k, t in enumerate(texts + [", ".join(rng.choices(words, k=80)) + rng.choice(" 1-×÷") + "WORDS\tbetween" for _ in range(40)])]


def rows_of(df):
    return {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in df.collect()}


@pytest.mark.parametrize("limits", [{}, {"CELL_WORDS": 4, "LEAF": 2}, {"CELL_WORDS": 8, "FULL_CELL": 5}, {"FULL_CELL": 0}])
def test_equals_all_pairs(docs_of, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(spelling, name, value)
    docs = corpus(3) + [(None, "nothing nothing"), (7, None), (8, ""), (9, "repeated " * 3), (9, "repeated " * 3)]
    got = spelling.variants(docs_of(docs))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_words(docs))
    assert rows_of(got) == want and got.count() == len(want)
    assert max(Counter(root for w, f, root, *_ in want if f).values()) >= 2 and any(f and root != f for _, f, root, *_ in want)


def test_given_documents_equal_deletion_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = plain_words([(r.doc_id, r.text) for r in docs.collect()])
    of_form = {}
    for w in words:
        for f in {w, *(w[:k] + w[k + 1:] for k in range(len(w)))}:
            of_form.setdefault(f, set()).add(w)
    pairs = {(a, b) for group in of_form.values() for a in group for b in group if a != b and plain_near(a, b)}
    count = Counter(a for a, _ in pairs)
    rows = spelling.variants(docs).collect()
    assert {r.word: (r.n, r.n_near) for r in rows} == {w: (n, count[w]) for w, n in words.items()} and sum(count.values()) > 100


def test_words_of_the_same_letters_and_long_words():
    rng = random.Random(5)
    same = sorted({"".join(rng.sample("abcdefgh", 8)) for _ in range(300)})
    other = sorted({w.replace("a", "x", 1) for w in same[:150]} | {edited(rng, w) for w in same[:50]})
    for queries, words in ((same, [w for w in other if len(w) == 8]), (same, [w for w in other if len(w) == 9]), (["q" * 90], ["q" * 91]),
                           (["q" * 90, "q" * 89 + "r"], ["q" * 90, "q" * 88 + "rr"])):
        found = {(int(a), int(b)) for i, j in spelling.near_pairs(queries, words) for a, b in zip(i, j)}
        assert found == {(a, b) for a, p in enumerate(queries) for b, q in enumerate(words) if plain_near(p, q)}


def test_cells_in_reach_hold_all_counts_within_it():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (400, spelling.DIMENSIONS)).astype(np.int32)
    tree = spelling.splits(x, 5)
    cell = spelling.own_cell(tree, x)
    assert np.bincount(cell).max() < 40
    moved = x.copy()
    moved[:, 3] += 1
    moved[:, 5] -= x[:, 5] > 0
    for row, c in zip(moved[:50], range(50)):
        near = {int(cell[k]) for k in range(400) if np.maximum(x[k] - row, 0).sum() <= 1 and np.maximum(row - x[k], 0).sum() <= 1}
        assert near <= set(spelling.cells_in_reach(tree, row[None], 1, 1)[1].tolist()), c
    i, j = spelling.cells_in_reach(tree, moved, 1, 1)
    assert set(zip(range(400), cell.tolist())) <= set(zip(i.tolist(), j.tolist()))


def test_empty_table(docs_of):
    assert spelling.variants(docs_of([])).count() == 0
