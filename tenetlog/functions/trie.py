"""Digest of a compressed binary trie over hashed keys (small per-batch helpers).

A leaf's digest comes in ready-made (it is a column expression); a branch splits
at the first differing bit. A subtree's digest does not depend on what is above
it, so the same fold combines leaves and sub-roots.
"""

from __future__ import annotations

from hashlib import sha256

BITS = 256


def format_tag(namespace: str, name: str) -> str:
    return f"{namespace}-{name}"


def empty_digest(namespace: str) -> str:
    return sha256(f'{{"format":"{namespace}-map/1","kind":"empty"}}'.encode()).hexdigest()


def branch_digest(namespace: str, bit: int, route: int, left: str, right: str) -> str:
    kept = (route >> (BITS - bit)) << (BITS - bit)
    return sha256(f'{{"bit":{bit},"format":"{namespace}-map/1","kind":"branch","left":"{left}",'
                  f'"prefix":"{kept:064x}","right":"{right}"}}'.encode()).hexdigest()


def split_bit(a: int, b: int) -> int:
    return BITS - (a ^ b).bit_length()


def fold_sorted(namespace: str, entries, on_branch=None):
    """Digest of route-sorted ``(route, digest)`` pairs with distinct routes.

    Neighbouring routes give every branch: a branch closes when the next split
    is higher up. ``on_branch(bit, route, left, right)`` sees each branch.
    """
    if not entries:
        return empty_digest(namespace)
    open_left = []  # (split bit, digest of everything left of the split)
    current, previous = entries[0][1], entries[0][0]

    def close(limit):
        nonlocal current
        while open_left and open_left[-1][0] > limit:
            bit, left = open_left.pop()
            digest = branch_digest(namespace, bit, previous, left, current)
            if on_branch is not None:
                on_branch(bit, previous, left, current)
            current = digest

    for route, digest in entries[1:]:
        bit = split_bit(previous, route)
        close(bit)
        open_left.append((bit, current))
        current, previous = digest, route
    close(-1)
    return current


class GrowingTrie:
    """Root after every upsert: only the changed path is hashed again."""

    __slots__ = ("namespace", "root")

    def __init__(self, namespace: str):
        self.namespace = namespace
        self.root = None  # leaf: [-1, route, digest]; branch: [bit, route, digest, left, right]

    def digest(self) -> str:
        return empty_digest(self.namespace) if self.root is None else self.root[2]

    def _branch(self, bit, route, left, right):
        return [bit, route, branch_digest(self.namespace, bit, route, left[2], right[2]), left, right]

    def upsert(self, route: int, digest: str) -> str:
        leaf, path, node = [-1, route, digest], [], self.root
        while node is not None and node[0] >= 0 and split_bit(node[1], route) >= node[0]:
            right = (route >> (BITS - 1 - node[0])) & 1
            path.append((node, right))
            node = node[4] if right else node[3]
        if node is None:
            fresh = leaf
        else:
            bit = split_bit(node[1], route)
            if bit == BITS:
                fresh = leaf
            elif (route >> (BITS - 1 - bit)) & 1:
                fresh = self._branch(bit, route, node, leaf)
            else:
                fresh = self._branch(bit, route, leaf, node)
        for parent, right in reversed(path):
            left_child, right_child = (parent[3], fresh) if right else (fresh, parent[4])
            fresh = self._branch(parent[0], parent[1], left_child, right_child)
        self.root = fresh
        return fresh[2]
