"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

One edit changes the letter counts of a word by at most two in all: an exchanged letter is
one less and one more, an inserted letter one more. For each word length a k-d tree splits
the space of letter counts into cells. A word lies in one cell and is sent, as a query, to
each cell of its own length and of the next length that holds counts within reach. Each cell
is a group of its own: a tree over its words answers the queries by pruning boxes, and the
order of letters decides about what is left.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tenetlog.llm import common

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
DIMENSIONS = 32             # a to z, and six for all other letters together
CELL_WORDS = 8_000          # words a cell is meant to hold
LEVELS = 10                 # of splits in a length's tree, at most; deeper search happens inside a cell
SAMPLE_WORDS = 20_000       # words of a length that choose its splits, about; all words are dealt by them
FULL_CELL = 400_000         # words and queries of a cell that are compared in one task
LEAF = 16                   # letter counts in a leaf of a cell's own tree
QUERIES = 2_000             # queries of a cell that descend together
_PENDING = 200_000          # distinct words a task counts before it hands them on
_WIDE_WORD = 64             # longer words are compared one by one instead of as rows of a matrix
_BYTE_SUM = np.uint64(0x0101010101010101)


# --- words ---

def counted(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n): letter runs of all texts, ASCII capitals lowered.

    Where ``every`` divides the checksum of id and run, one letter of the run is left out.
    A null id counts as the empty text.
    """
    run = re.compile(_RUN.pattern[:-1] + f"{{{least_length},}}")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                prefix = b"" if doc_id is None else str(doc_id).encode()
                for word, n in Counter(run.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                    h = zlib.crc32(b"%b:%b" % (prefix, word.encode()))
                    if h % every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1:]
                        if len(word) < least_length:
                            continue
                    found[word] += n
                if len(found) > _PENDING:
                    yield handed()
                    found.clear()
        yield handed()

    return (common.keyed(docs).where(F.col("text").isNotNull()).mapInArrow(partial, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count))


def letter_counts(words: list[str]) -> np.ndarray:
    """One row of ``DIMENSIONS`` counts per word, in bytes unless a word is very long.

    Letters that share a dimension only shorten distances.
    """
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    kind = np.int8 if lengths.max(initial=0) <= 100 else np.int32
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    letter = points - ord("a")
    other = (letter < 0) | (letter >= 26)
    letter[other] = 26 + points[other] % (DIMENSIONS - 26)
    owner = np.repeat(np.arange(len(words)), lengths)
    return np.bincount(owner * DIMENSIONS + letter, minlength=len(words) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(kind)


def excess(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row, how many letters ``a`` has above ``b`` in all."""
    over = np.maximum(a - b, 0)
    if over.dtype != np.int8:
        return over.sum(1)
    # A row's total is below 128, so eight bytes can be added at once without a carry.
    eight = over.view(np.uint64)
    return ((eight[:, 0] + eight[:, 1] + eight[:, 2] + eight[:, 3]) * _BYTE_SUM) >> np.uint64(56)


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows; row numbers in the order of their group; where each group starts in that order, and the end."""
    whole = np.ascontiguousarray(x).view(np.uint64)
    order = np.lexsort(whole.T)
    fresh = np.append(True, (whole[order[1:]] != whole[order[:-1]]).any(1))
    starts = np.flatnonzero(fresh)
    return x[order[starts]], order, np.append(starts, len(x))


# --- the tree that deals words to cells ---

# A split: (dimension, bound, tree if at most, tree if above); a cell: its number.
Tree = tuple | int


def splits(counts: np.ndarray, levels: int) -> Tree:
    """Tree of at most 2^levels cells; each split is the most even one over all dimensions, the first of equals."""
    cells = iter(range(1 << levels))

    def grow(x: np.ndarray, left: int) -> Tree:
        best = None
        if left and len(x) > 1:
            for k in range(x.shape[1]):
                values, sizes = np.unique(x[:, k], return_counts=True)
                if len(values) > 1:
                    below = np.cumsum(sizes)[:-1]
                    at = int(np.abs(2 * below - len(x)).argmin())
                    uneven = abs(2 * int(below[at]) - len(x))
                    if best is None or uneven < best[0]:
                        best = (uneven, k, int(values[at]))
        if best is None:
            return next(cells)
        _, k, bound = best
        low = x[:, k] <= bound
        return k, bound, grow(x[low], left - 1), grow(x[~low], left - 1)

    return grow(counts, levels)


def own_cell(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The cell of each row."""
    out = np.zeros(len(x), np.int32)
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not isinstance(node, tuple):
            out[rows] = node
        elif len(rows):
            k, bound, low, high = node
            goes = x[rows, k] <= bound
            todo += [(low, rows[goes]), (high, rows[~goes])]
    return out


def cells_in_reach(tree: Tree, x: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) for all cells with counts that have at most so many letters more and so many less."""
    rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    none = np.zeros(len(x), np.int32)
    # A node, its bounds by dimension, the rows that reach it, and the letters each must gain and lose to get there.
    todo = [(tree, {}, {}, np.arange(len(x)), none, none)]
    while todo:
        node, low, high, at, gained, lost = todo.pop()
        if not len(at):
            continue
        if not isinstance(node, tuple):
            rows.append(at)
            cells.append(np.full(len(at), node, np.int32))
            continue
        k, bound, left, right = node
        q = x[at, k].astype(np.int32)
        fewer = lost + np.maximum(q - bound, 0) - np.maximum(q - high.get(k, 2**30), 0)
        near = fewer <= less
        todo.append((left, low, high | {k: bound}, at[near], gained[near], fewer[near]))
        further = gained + np.maximum(bound + 1 - q, 0) - np.maximum(low.get(k, 0) - q, 0)
        near = further <= more
        todo.append((right, low | {k: bound + 1}, high, at[near], further[near], lost[near]))
    return np.concatenate(rows), np.concatenate(cells)


def fit_trees(vocabulary: DataFrame) -> dict[int, Tree]:
    """A tree for each length with more words than a cell is meant to hold; other lengths are one cell.

    Splits are chosen by a bounded sample; how many levels there are, by all words.
    """
    length = F.length("word")
    sizes = dict(vocabulary.groupBy(length.alias("length")).count().where(F.col("count") > CELL_WORDS).collect())
    if not sizes:
        return {}
    shares = {k: min(1.0, SAMPLE_WORDS / n) for k, n in sizes.items()}
    share = F.element_at(F.create_map(*[F.lit(v) for pair in shares.items() for v in pair]), length)
    sample = vocabulary.where(length.isin(*shares) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share * (1 << 20)))
    of_length = defaultdict(list)
    for r in sample.select("word").collect():
        of_length[len(r.word)].append(r.word)
    return {k: splits(letter_counts(words), min(LEVELS, int(np.ceil(np.log2(sizes[k] / CELL_WORDS)))))
            for k, words in of_length.items()}


DEALT = "length int, cell int, role int, word string, n long"
_OWN, _SAME, _SHORTER = 0, 1, 2     # a word of the cell; a query of the same length; a query that is one letter shorter


def dealt(vocabulary: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """Each word in its own cell, and as a query in each cell within reach."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                x = letter_counts(list(words[at]))
                tree = trees.get(length, 0)
                own = own_cell(tree, x)
                who, cell = cells_in_reach(tree, x, 1, 1)
                elsewhere = cell != own[who]
                longer, longer_cell = cells_in_reach(trees.get(length + 1, 0), x, 1, 0)
                for target, role, source, cells in ((length, _OWN, np.arange(len(at)), own), (length, _SAME, who[elsewhere], cell[elsewhere]),
                                                    (length + 1, _SHORTER, longer, longer_cell)):
                    if len(source):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(source), target, np.int32)), pa.array(cells.astype(np.int32)),
                             pa.array(np.full(len(source), role, np.int32)), pa.array(words[at[source]].tolist(), pa.string()),
                             pa.array(n[at[source]])], names=["length", "cell", "role", "word", "n"])
    return vocabulary.select("word", "n").mapInArrow(rows, DEALT)


# --- search inside a cell ---

class Boxes:
    """k-d tree over distinct letter counts with the tight box of every node."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        self.low, self.high, self.children, self.spans = [], [], [], []
        self._grow(0, len(x))
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.children, self.spans = np.array(self.children), np.array(self.spans)

    def _grow(self, start: int, end: int) -> int:
        node = len(self.spans)
        part = self.x[self.order[start:end]]
        low, high = part.min(0), part.max(0)
        self.low.append(low)
        self.high.append(high)
        self.spans.append((start, end))
        self.children.append((-1, -1))
        if end - start > LEAF:
            # The most even split between two counts of one letter, so that the two boxes do not touch.
            bounds = np.unique(np.quantile(np.arange(int(low.min()), int(high.max())), np.linspace(0, 1, 8), method="nearest"))
            below = np.array([(part <= b).sum(0) for b in bounds])
            uneven = np.where((below > 0) & (below < len(part)), np.abs(2 * below - len(part)), 2 * len(part))
            b, k = np.unravel_index(uneven.argmin(), uneven.shape)
            if uneven[b, k] == 2 * len(part):       # counts too far apart for these bounds
                k = int((high - low).argmax())
                goes = part[:, k] < high[k]
            else:
                goes = part[:, k] <= bounds[b]
            members = self.order[start:end]
            self.order[start:end] = np.concatenate((members[goes], members[~goes]))
            middle = start + int(goes.sum())
            self.children[node] = (self._grow(start, middle), self._grow(middle, end))
        return node

    def within(self, queries: np.ndarray, more: int, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (query, row) with at most so many letters more and so many less."""
        reach = lambda q, low, high: (excess(low, q) <= more) & (excess(q, high) <= less)
        for first in range(0, len(queries), QUERIES):
            at = np.arange(first, min(first + QUERIES, len(queries)))
            node = np.zeros(len(at), np.int64)
            while len(at):
                near = reach(queries[at], self.low[node], self.high[node])
                at, node = at[near], node[near]
                leaf = self.children[node, 0] < 0
                q, span = at[leaf], self.spans[node[leaf]]
                sizes = span[:, 1] - span[:, 0]
                q = np.repeat(q, sizes)
                place = np.repeat(span[:, 0] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(q)) if len(q) else q
                row = self.order[place]
                exact = reach(queries[q], self.x[row], self.x[row])
                yield q[exact], row[exact]
                at, node = np.concatenate((at[~leaf], at[~leaf])), self.children[node[~leaf]].T.ravel()


def forms(word: str, shorter: bool) -> Iterator[tuple]:
    """What a word shares with those one edit away: itself if it is the shorter one, or its rest without a letter."""
    if shorter:
        yield word, -1
    else:
        yield from ((word[:k] + word[k + 1:], k) for k in range(len(word)))


class Letters:
    """Whether a query becomes a word, as long or one letter longer, by one edit; all letters are below U+0100."""

    def __init__(self, queries: list[str], words: list[str]):
        self.queries, self.words = queries, words
        self.n, self.m = len(queries[0]), len(words[0])
        if self.m <= _WIDE_WORD:
            self.a, self.b = (np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), -1) for texts in (queries, words))

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n, m = self.n, self.m
        if m > _WIDE_WORD:
            return np.array([self._holds(self.queries[p], self.words[q]) for p, q in zip(i, j)], bool)
        p, q = self.a[i], self.b[j]
        if n == m:
            return np.count_nonzero(p != q, axis=1) == 1
        # Letters alike from the start and from the end must cover the query.
        before, after = p == q[:, :n], (p == q[:, 1:])[:, ::-1]
        first = np.where(before.all(1), n, before.argmin(1))
        return first + np.where(after.all(1), n, after.argmin(1)) >= n

    def _holds(self, p: str, q: str) -> bool:
        at = next((k for k in range(self.n) if p[k] != q[k]), self.n)
        return p[at:] == q[at + 1:] if self.m > self.n else at < self.n and p[at + 1:] == q[at + 1:]


def near_pairs(queries: list[str], words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (query, word) that are one edit apart; words are as long as queries or one letter longer."""
    if not queries or not words:
        return
    longer = len(words[0]) > len(queries[0])
    q_counts, q_members, q_from = grouped(letter_counts(queries))
    w_counts, w_members, w_from = grouped(letter_counts(words))
    q_counts = q_counts.astype(w_counts.dtype)
    letters = Letters(queries, words)
    for q, w in Boxes(w_counts).within(q_counts, 1, 0 if longer else 1):
        q_size, w_size = q_from[q + 1] - q_from[q], w_from[w + 1] - w_from[w]
        pairs = q_size * w_size
        many = pairs > 4096
        for g, h in zip(q[many], w[many]):          # many words of the same letters: matched by what an edit leaves
            of_form = defaultdict(list)
            for k in w_members[w_from[h]:w_from[h + 1]].tolist():
                for form in ({f: None for f, _ in forms(words[k], False)} if longer else forms(words[k], False)):
                    of_form[form].append(k)
            found = [(p, k) for p in q_members[q_from[g]:q_from[g + 1]].tolist()
                     for form in ([queries[p]] if longer else forms(queries[p], False)) for k in of_form.get(form, ()) if queries[p] != words[k]]
            if found:
                i, j = np.array(found).T
                yield i, j
        q, w, q_size, w_size, pairs = q[~many], w[~many], q_size[~many], w_size[~many], pairs[~many]
        for start, end in _portions(pairs, 200_000):
            size = pairs[start:end]
            each = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(w_size[start:end], size)
            i = q_members[np.repeat(q_from[q[start:end]], size) + each // wide]
            j = w_members[np.repeat(w_from[w[start:end]], size) + each % wide]
            right = letters.near(i, j)
            yield i[right], j[right]


def _portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about ``limit`` in all."""
    if len(sizes):
        mark = np.cumsum(sizes) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(mark)) + 1, [len(sizes)]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


FOUND = "word string, n_near long, best struct<less:long,word:string>"


def _search(group: pa.Table) -> pa.Table:
    """Near words of one cell: for each word how many, and the most frequent (first of equals)."""
    role, n = group.column("role").to_numpy(), group.column("n").to_numpy()
    texts = group.column("word").to_pylist()
    own, same, shorter = (np.flatnonzero(role == r) for r in (_OWN, _SAME, _SHORTER))
    texts_of = lambda rows: [texts[k] for k in rows]
    a, b = [], []
    asking = np.concatenate((own, same))
    for i, j in near_pairs(texts_of(asking), texts_of(own)):
        a.append(asking[i])
        b.append(own[j])
    for i, j in near_pairs(texts_of(shorter), texts_of(own)):
        a += [shorter[i], own[j]]
        b += [own[j], shorter[i]]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    rank = np.zeros(len(texts), np.int64)
    found = np.unique(b).tolist()
    rank[np.array(sorted(found, key=texts.__getitem__), np.int64)] = np.arange(len(found))
    by = np.lexsort((rank[b], -n[b], a))
    a, b = a[by], b[by]
    who, first, count = np.unique(a, return_index=True, return_counts=True)
    best = pa.StructArray.from_arrays([pa.array(-n[b[first]], pa.int64()), pa.array(texts_of(b[first]), pa.string())], names=["less", "word"])
    return pa.table([pa.array(texts_of(who), pa.string()), pa.array(count, pa.int64()), best], names=["word", "n_near", "best"])


def _by_form(rows: DataFrame) -> DataFrame:
    """Near words in cells with too many words for a task: joined on what an edit leaves of them.

    A form and its place are shared by no more words than there are letters.
    """
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for row, (role, word) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                keys = list(forms(word, role == _SHORTER))
                if role == _OWN:                     # met by shorter queries at no place in particular
                    keys += [(f, -1) for f in dict.fromkeys(f for f, _ in keys)]
                at += [row] * len(keys)
                found += keys
            table = pa.Table.from_batches([batch]).take(pa.array(at, pa.int64()))
            table = table.append_column("form", pa.array([f for f, _ in found], pa.string())).append_column(
                "place", pa.array([k for _, k in found], pa.int32()))
            yield from table.to_batches()

    keys = ["length", "cell", "form", "place"]
    spread_rows = rows.select("length", "cell", "role", "word", "n").mapInArrow(spread, f"{DEALT}, form string, place int")
    words = spread_rows.where(F.col("role") == _OWN).select(*keys, F.col("word").alias("w"), F.col("n").alias("m"))
    asking = spread_rows.where((F.col("role") == _SHORTER) | (F.col("place") >= 0))
    pairs = asking.join(words, keys).where("word <> w")
    back = pairs.where(F.col("role") == _SHORTER).select(F.col("w").alias("word"), F.col("word").alias("w"), F.col("n").alias("m"))
    both = pairs.select("word", "w", "m").unionByName(back)
    return both.select("word", F.lit(1).cast("long").alias("n_near"), F.struct((-F.col("m")).alias("less"), F.col("w").alias("word")).alias("best"))


def near_words(vocabulary: DataFrame, full: int | None = None) -> DataFrame:
    """(word, n_near, best): words with a near word, how many they have, and the most frequent of them."""
    full = FULL_CELL if full is None else full
    rows = common.stored(dealt(vocabulary, fit_trees(vocabulary)), "spelling-cells")
    crowded = rows.groupBy("length", "cell").count().where(F.col("count") > full).select("length", "cell")
    keys = crowded.collect()            # no more than one cell for each ``full`` dealt words
    found = rows
    if keys:
        crowd = F.struct("length", "cell").isin(*[F.struct(F.lit(r.length).alias("length"), F.lit(r.cell).alias("cell")) for r in keys])
        found = rows.where(~crowd)
    found = found.groupBy("length", "cell").applyInArrow(_search, FOUND)
    if keys:
        found = found.unionByName(_by_form(rows.where(crowd)))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(docs: DataFrame, least_length: int = 7, least_count: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word; form is null where no near word is ``times`` as frequent.

    Null and empty texts hold no words; repeated rows and ids count again; other columns are
    ignored. Among near words of equal n the form is the first in code-point order. An empty
    table gives no rows.
    """
    vocabulary = common.stored(counted(docs, least_length, least_count, every), "spelling-words")
    best = F.col("best")
    is_form = -best["less"] >= times * F.col("n")
    rows = common.stored(vocabulary.join(near_words(vocabulary), "word", "left").select(
        "word", F.when(is_form, best["word"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(is_form, -best["less"]).alias("form_n")), "spelling-forms")
    # Each step to a form multiplies n, so the number of steps is known; each round doubles those taken.
    most, steps = rows.agg(F.max("n")).first()[0] or 1, 0
    while times > 1 and least_count * times ** (steps + 1) <= most:
        steps += 1
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    taken = 1
    while taken < steps:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        roots = common.stored(roots.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "spelling-roots")
        taken *= 2
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
