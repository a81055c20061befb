import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tenetlog.llm import substrings


def brute(texts, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[k:k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k + j for k in range(len(w) - window + 1) if seen[tuple(w[k:k + window])] > 1 for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(docs, texts, ids=None, window=35):
    got = sorted((r.doc_id is None, r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.digest(docs, window).collect())
    ids = ids or list(range(len(texts)))
    want = sorted((i is None, i, *row) for i, row in zip(ids, brute(texts, window)))
    assert got == want


def made(seed, window):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "a", f"w{rng.randrange(3000)}", "é", "漢"])
    passage = [[word() for _ in range(rng.randrange(window - 3, 3 * window))] for _ in range(6)]
    texts = [None, "", " \n", "one", " ".join(passage[0]), " ".join(passage[0]), "  ".join(passage[1]), "\n".join(passage[1])]
    for _ in range(40):
        parts = [[word() for _ in range(rng.randrange(0, 2 * window))] for _ in range(3)]
        text = parts[0] + rng.choice(passage) + parts[1] + rng.choice(passage)[:rng.randrange(1, 2 * window)] + parts[2]
        if rng.random() < 0.4:
            text[rng.randrange(len(text))] = word()
        texts.append(rng.choice([" ", "\t", "\n "]).join(text))
    texts.append(" ".join(["la"] * 5 * window))
    texts.append(" ".join(["x y"] * window + [word() for _ in range(9)] + ["x y"] * window))
    return texts


@pytest.mark.parametrize("window,hot", [(35, 2000), (35, 3), (10, 2000), (5, 2)])
def test_small_texts_equal_brute_force(docs_of, monkeypatch, window, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = made(window, window)
    check(docs_of(texts), texts, window=window)


def test_many_shards(docs_of, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 50)
    texts = made(9, 35)
    check(docs_of(texts), texts)


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    long = " ".join(f"w{k}" for k in range(40))
    check(docs_of([(1, long), (1, long), (None, "a b"), (None, "a b")]), [long, long, "a b", "a b"], [1, 1, None, None])
    assert substrings.digest(docs_of([])).count() == 0


def test_cleaned_keeps_columns_and_clean_texts(docs_of):
    shared = " ".join(f"s{k}" for k in range(50))
    docs = docs_of([f"alpha  {shared}\nbeta", f"gamma {shared} delta", "left   alone", None, shared, shared])
    rows = {r.doc_id: r for r in substrings.cleaned(docs).collect()}
    assert substrings.cleaned(docs).columns == docs.columns
    assert [rows[k].text for k in range(6)] == ["alpha beta", "gamma delta", "left   alone", None, "", ""]


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    check(docs, [r.text for r in rows], [r.doc_id for r in rows])


def test_index_counts_equal_brute_force():
    rng = np.random.default_rng(6)
    text = rng.integers(1, 5, 700)
    text[[100, 333, 699]] = 0
    index = substrings.FmIndex(text, 12)
    ends = np.array([e for e in range(12, 700) if (text[e - 11:e + 1] > 0).all()])
    low = index.first[text[ends]]
    high = index.first[text[ends] + 1]
    for step in range(1, 12):
        low, high = index.extend(low, high, text[ends - step])
        patterns = Counter(tuple(text[k:k + step + 1]) for k in range(700 - step))
        assert (high - low).tolist() == [patterns[tuple(text[e - step:e + 1])] for e in ends]
    got = index.matches(text, ends, 12)
    for e, n in zip(ends, got):
        most = max(j for j in range(1, 13) if sum((text[k:k + j] == text[e - j + 1:e + 1]).all() for k in range(701 - j)) > 1)
        assert n == most
