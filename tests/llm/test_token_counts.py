import random

import numpy as np
import pytest

from tenetlog.llm import token_counts
from tenetlog.llm.queries import tokenizer_file

TEXTS = [None, "", " \n", "hello world", "é 漢字 🙂", "a" * 50_000, "hello hello\thello", "x\x00y \x7f"]


def greedy(word, pieces, longest):
    at = n = 0
    while at < len(word):
        size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at:at + k] in pieces), 0)
        if not size:
            return 1
        at, n = at + size, n + 1
    return n


@pytest.mark.parametrize("seed", range(6))
def test_random_vocabularies_equal_greedy_matching(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 2 else "abc"
    pieces = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))).encode() for _ in range(rng.randrange(2, 25))}
    if seed > 2:
        pieces |= {c.encode() for c in letters}
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))).encode() for _ in range(500)]
    raw = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    got = token_counts.Automaton(sorted(pieces)).count(raw, np.cumsum(sizes) - sizes, sizes, prefix=b"")
    assert got.tolist() == [greedy(w, pieces, 7) for w in words]


def check(rows, texts, pieces):
    known = set(pieces)
    longest = max(map(len, pieces))
    memo = {}
    assert len(rows) == len(texts)
    for r in rows:
        words = (texts[r.doc_id] or "").encode().split()
        for w in words:
            if w not in memo:
                memo[w] = greedy(b" " + w, known, longest)
        assert (r.n_words, r.n_tokens, r.n_bytes) == (len(words), sum(memo[w] for w in words), len((texts[r.doc_id] or "").encode()))


def test_documents(spark, sf, docs_of):
    pieces = token_counts.byte_pieces(tokenizer_file()[0])
    assert len(pieces) == 50_256
    check(token_counts.count_tokens(docs_of(TEXTS), pieces).collect(), dict(enumerate(TEXTS)), pieces)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(token_counts.count_tokens(docs, pieces).collect(), {r.doc_id: r.text for r in docs.collect()}, pieces)
    assert token_counts.count_tokens(docs_of([]), pieces).count() == 0
    assert token_counts.count_tokens(docs_of([(1, "a")] * 2 + [(None, "b")]), pieces).count() == 3
