"""Packing: documents into token sequences, by vector bin packing with the dot-product heuristic.

An item is what is left of a document after whole sequences were cut off it; its vector
is (tokens, 1 segment, loss-bearing tokens). An open sequence takes, of the items that
fit in every dimension, the one whose vector has the greatest dot product with what the
sequence has left. If none fits, the greatest item is cut to what is left. One sequence
is open at a time and passes from batch to batch, so only a partition's last sequence
can stay short; it is cut into lengths that are powers of two, which need no padding.

Each task packs what it reads: no shuffle, and memory is bounded by one batch.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tenetlog.llm import common

TOKENS, SEGMENTS, LOSS_TOKENS = 1024, 512, 1024
END_ID = 0
CACHE_UNITS = 400_000
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "loss_tokens long")


class Encoder:
    """Ids of whole texts under a byte-level BPE vocabulary, little-endian 32-bit.

    A space between two non-space characters always begins a pre-token, so text between
    such spaces encodes by itself; each such unit is encoded once and kept. Texts where
    spaces meet other white space, or that may hold special tokens, go through the
    tokenizer whole.
    """

    def __init__(self, tokenizer_json: str, pattern: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        of_char = {c: b for b, c in _byte_characters().items()}
        ranks = {bytes(of_char[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.uneven = re.compile(r" \s|\s |^\s|\s$")
        self.first: dict[str, bytes] = {}
        self.later: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        if self.special is not None and self.special.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not text or self.uneven.search(text):
            return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()
        units = text.split(" ")
        known = self.later
        if len(known) > CACHE_UNITS:
            known.clear()
        head = np.array(self.fast.encode_ordinary(units[0]), "<u4").tobytes()
        try:
            return head + b"".join(map(known.__getitem__, units[1:]))
        except KeyError:
            encode = self.fast.encode_ordinary
            for unit in units[1:]:
                if unit not in known:
                    known[unit] = np.array(encode(" " + unit), "<u4").tobytes()
            return head + b"".join(map(known.__getitem__, units[1:]))


@lru_cache(maxsize=1)
def worker_encoder(tokenizer_json: str, pattern: str) -> Encoder:
    """One encoder for all tasks of a Python worker: its units are encoded once, not once a task."""
    return Encoder(tokenizer_json, pattern)


def _byte_characters() -> dict[int, str]:
    """The printable stand-in of every byte in byte-level vocabularies: visible Latin-1 stays, the rest moves up."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Packer:
    """Places pieces [item, start, length, sequence, offset, loss tokens] of one batch; one sequence is open at a time.

    An item is its place in the list of lengths. All tokens of a piece but its first bear loss.
    """

    def __init__(self, limits=(TOKENS, SEGMENTS, LOSS_TOKENS)):
        self.limits = np.array(limits, float)
        self.whole = min(int(limits[0]), int(limits[2]) + 1)
        self.count = 0                       # sequences begun so far
        self.close()

    def close(self) -> None:
        self.room, self.offset, self.open = self.limits.copy(), 0, []

    def place(self, item: int, start: int, length: int) -> list:
        self.count += not self.open
        piece = [item, start, length, self.count - 1, self.offset, length - 1]
        self.open.append(piece)
        self.offset += length
        self.room -= (length, 1, length - 1)
        if self.room[0] < 1 or self.room[1] < 1:
            self.close()
        return piece

    def pack(self, lengths: list[int]) -> list[list]:
        done, pools = [], {}
        for k, n in enumerate(lengths):
            start = 0
            while n - start >= self.whole:
                done.append([k, start, self.whole, self.count, 0, self.whole - 1])
                self.count += 1
                start += self.whole
            if n > start:
                pools.setdefault(n - start, []).append((k, start))
        # Items of one length have one vector, so the search runs over lengths, not items.
        sizes = np.arange(self.whole + 1, dtype=float)
        left = np.zeros(len(sizes), np.int64)
        for n, items in pools.items():
            left[n] = len(items)
        vectors = np.stack([sizes, np.ones_like(sizes), np.maximum(sizes - 1, 0)], 1)
        remaining = int(left.sum())
        while remaining:
            fits = (left > 0) & (vectors <= self.room).all(1)
            if fits.any():
                pick = length = int(np.where(fits, vectors @ (self.room / self.limits**2), -1).argmax())
            else:
                pick, length = int(np.flatnonzero(left)[-1]), int(min(self.room[0], self.room[2] + 1))
                if length < 1:
                    self.close()
                    continue
            item, start = pools[pick].pop()
            done.append(self.place(item, start, length))
            left[pick] -= 1
            if pick > length:
                pools.setdefault(pick - length, []).append((item, start + length))
                left[pick - length] += 1
            else:
                remaining -= 1
        return done


def pack_table(docs: DataFrame, tokenizer_path: str, pattern: str, limits=(TOKENS, SEGMENTS, LOSS_TOKENS)) -> DataFrame:
    """One row per piece.

    Null text: empty, which is one end id. Every row of ``docs`` is a document, repeated
    ids included; a null id stays null. An empty table gives no rows. Other columns are
    not read.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast((f.read(), pattern))   # bounded by the vocabulary file

    def run(batches):
        encoder = worker_encoder(*vocabulary.value)
        task = TaskContext.get()
        base = (task.partitionId() if task else 0) << 32
        carry = Carry(limits)
        for ids, texts in common.chunks(batches):
            coded = [encoder.ids(t.decode("utf-8", "surrogatepass")) + b"\0\0\0\0" for t in texts]
            yield from carry.batch(ids, coded, base)
        yield from carry.end(base)

    return common.keyed(docs).mapInArrow(run, SCHEMA)


class Carry:
    """Pieces as Arrow rows. The open sequence's pieces wait until it is full or the partition ends."""

    def __init__(self, limits):
        self.limits = limits
        self.sequence = 0
        self.open: list[tuple] = []      # (doc_id, start, ids, doc_tokens)

    def batch(self, ids, coded, base):
        packer = Packer(self.limits)
        items = [(d, s, c, n) for d, s, c, n in self.open]
        items += [(d, 0, c, len(c) // 4) for d, c in zip(ids, coded)]
        pieces = packer.pack([len(c) // 4 for _, _, c, _ in items])
        last = {id(p) for p in packer.open}
        self.open = []
        rows = []
        for p in pieces:
            item, start, length, sequence, offset, loss = p
            doc, skipped, raw, total = items[item]
            cut = raw[4 * start:4 * (start + length)]
            if id(p) in last:
                self.open.append((doc, skipped + start, cut, total))
            else:
                rows.append((doc, skipped + start, length, zlib.crc32(cut), total, base + self.sequence + sequence, offset, loss))
        self.sequence += packer.count - bool(packer.open)
        yield from _arrow(rows)

    def end(self, base):
        """The last sequence, cut into powers of two."""
        total, rows, pieces = sum(len(c) // 4 for _, _, c, _ in self.open), [], list(self.open)
        for bit in reversed(range(total.bit_length())):
            size, offset = total & (1 << bit), 0
            while offset < size:
                doc, start, raw, tokens = pieces.pop(0)
                take = min(size - offset, len(raw) // 4)
                cut = raw[:4 * take]
                rows.append((doc, start, take, zlib.crc32(cut), tokens, base + self.sequence, offset, take - 1))
                offset += take
                if len(raw) > len(cut):
                    pieces.insert(0, (doc, start + take, raw[4 * take:], tokens))
            self.sequence += bool(size)
        yield from _arrow(rows)


def _arrow(rows):
    if rows:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
