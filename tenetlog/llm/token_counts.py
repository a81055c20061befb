"""Token counts: greedy longest-match word pieces, counted by a linear automaton.

The vocabulary is a trie. Each node has a failure link, and the number of pieces that
greedy matching has certainly taken when it follows that link; so a word's pieces are
counted in one pass over its bytes and never built. The distinct words of a chunk go
through the automaton side by side.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tenetlog.llm import common
from tenetlog.llm.packing import _byte_characters

BEGIN = b" "           # put before each word; pieces that begin a word begin with it
NONE = -1


class Automaton:
    """Arrays over trie nodes; node 0 is the root. Transitions sit in an open hash table of (node, byte) keys."""

    def __init__(self, pieces: list[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    ends.append(False)
                at = children[at][byte]
            ends[at] = at != 0
        fail, popped = np.full(len(children), NONE, np.int32), np.zeros(len(children), np.int32)
        queue = deque([0])
        while queue:
            parent = queue.popleft()
            for byte, node in children[parent].items():
                queue.append(node)
                if ends[node]:
                    fail[node], popped[node] = 0, 1
                    continue
                at, taken = fail[parent], popped[parent]
                while at != NONE and byte not in children[at]:
                    taken += popped[at]
                    at = fail[at]
                if at != NONE:
                    fail[node], popped[node] = children[at][byte], taken
        self.fail, self.popped = fail, popped
        self.bits = max(4, (2 * len(children)).bit_length())
        self.keys = np.full(1 << self.bits, NONE, np.int64)
        self.targets = np.zeros(1 << self.bits, np.int32)
        pairs = np.array([(node << 8 | byte, child) for node, c in enumerate(children) for byte, child in c.items()], np.int64).reshape(-1, 2)
        slots = self._slot(pairs[:, 0])
        while len(pairs):
            free = self.keys[slots] == NONE
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            put = np.zeros(len(pairs), bool)
            put[first] = True
            put &= free
            self.keys[slots[put]], self.targets[slots[put]] = pairs[put, 0], pairs[put, 1]
            pairs, slots = pairs[~put], (slots[~put] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Children of nodes, or NONE."""
        keys = nodes.astype(np.int64) << 8 | symbols
        slots = self._slot(keys)
        found = self.keys[slots]
        child = np.where(found == keys, self.targets[slots], NONE)
        open_ = np.flatnonzero((found != keys) & (found != NONE))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            child[open_[hit]] = self.targets[slots[open_[hit]]]
            open_ = open_[~hit & (found != NONE)]
        return child

    def count(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, prefix: bytes = BEGIN) -> np.ndarray:
        """Pieces of each byte span, ``prefix`` before it; a span that the vocabulary can't spell counts as one."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[order], lengths[order]
        node = np.zeros(len(starts), np.int64)
        total = np.zeros(len(starts), np.int64)
        lost = np.zeros(len(starts), bool)
        for k in range(int(lengths[0]) + len(prefix) if len(lengths) else 0):
            if k < len(prefix):
                live = np.flatnonzero(~lost)
                symbols = np.full(len(live), prefix[k], np.int64)
            else:
                reach = int(np.searchsorted(-lengths, -(k - len(prefix)), side="left"))      # spans longer than k
                live = np.flatnonzero(~lost[:reach])
                symbols = raw[starts[live] + (k - len(prefix))].astype(np.int64)
            while len(live):
                child = self.step(node[live], symbols)
                moved = child != NONE
                node[live[moved]] = child[moved]
                live, symbols = live[~moved], symbols[~moved]
                total[live] += self.popped[node[live]]
                link = self.fail[node[live]]
                lost[live[link == NONE]] = True
                live, symbols, link = live[link != NONE], symbols[link != NONE], link[link != NONE]
                node[live] = link
        live = np.flatnonzero(~lost & (node != 0))
        while len(live):
            total[live] += self.popped[node[live]]
            link = self.fail[node[live]]
            lost[live[link == NONE]] = True
            node[live] = np.maximum(link, 0)
            live = live[link > 0]
        total[lost] = 1
        out = np.empty(len(total), np.int64)
        out[order] = total
        return out


def byte_pieces(tokenizer_path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes, special tokens left out."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    of_char = {c: b for b, c in _byte_characters().items()}
    return [bytes(of_char[c] for c in token) for token in spec["model"]["vocab"] if token not in special]


def count_tokens(docs: DataFrame, pieces: list[bytes]) -> DataFrame:
    """(doc_id, n_words, n_tokens, n_bytes), one row per input row.

    Null and empty texts have none of them. Repeated rows are counted alike; an empty
    table gives no rows. A word the vocabulary can't spell is one token.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(pieces))      # bounded by the vocabulary

    def run(batches):
        for ids, texts in common.chunks(batches):
            w = common.Words(texts)
            _, first, back = np.unique(w.hashes, return_index=True, return_inverse=True)
            raw = np.frombuffer(w.buffer, np.uint8)
            each = automaton.value.count(raw, w.starts[first], (w.ends - w.starts)[first])[back]
            total = np.concatenate([[0], np.cumsum(each)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(np.diff(w.ranges)), pa.array(total[w.ranges[1:]] - total[w.ranges[:-1]]),
                 pa.array([len(t) for t in texts], pa.int64())], names=["doc_id", "n_words", "n_tokens", "n_bytes"])

    return common.keyed(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_bytes long")
