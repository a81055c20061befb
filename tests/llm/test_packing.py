import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tenetlog.llm import packing
from tenetlog.llm.queries import tokenizer_file

TEXTS = ["", None, "Hello world", "a  b", " lead", "trail ", "x\n\ny z", "it's 42 o'clock!!", "<|endoftext|> here", "é ñ ß 漢字 🙂",
         "  odd　space", "word " * 3000 + "end", "Hello world", "tab\tand\r\nlines \n", "x" * 5000]


def check(rows, texts):
    whole = Tokenizer.from_file(tokenizer_file()[0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for k, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(by_doc[k], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding


def test_pieces_are_exact_and_unpadded(docs_of):
    assert check(packing.pack_table(docs_of(TEXTS), *tokenizer_file()).collect(), TEXTS) == 0


def test_empty_table(docs_of):
    assert packing.pack_table(docs_of(TEXTS).limit(0), *tokenizer_file()).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert check(packing.pack_table(docs.repartition(3), *tokenizer_file()).collect(), texts) == 0


@pytest.mark.parametrize("limits", [(64, 3, 60), (64, 64, 20), (16, 1, 16)])
def test_every_limit_holds(limits):
    lengths = [int(n) for n in np.random.default_rng(1).integers(1, 200, 300)]
    pieces = packing.Packer(limits).pack(lengths)
    used = defaultdict(lambda: np.zeros(3))
    for _, _, length, sequence, _, loss in pieces:
        used[sequence] += (length, 1, loss)
    assert all((u <= limits).all() for u in used.values())
    assert sum(p[2] for p in pieces) == sum(lengths)


def test_tasks_of_a_worker_share_one_encoder(docs_of):
    """Each task once read the vocabulary and encoded every unit anew."""
    tokenizer_json, pattern = open(tokenizer_file()[0], encoding="utf-8").read(), tokenizer_file()[1]
    assert packing.worker_encoder(tokenizer_json, pattern) is packing.worker_encoder(tokenizer_json, pattern)
    assert check(packing.pack_table(docs_of(TEXTS * 4).repartition(16), tokenizer_file()[0], pattern).collect(), TEXTS * 4) == 0
