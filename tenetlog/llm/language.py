"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are no letters becomes one gap. All
n-grams of one to three characters of a text, gaps included, are hashed into a fixed
number of buckets. Counts per language and bucket are summed by Spark over a bounded
sample of labelled rows; their log-probabilities, a matrix of ``BUCKETS`` rows and one
column per language, are broadcast. Scoring adds the matrix rows of a text's n-grams.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.llm import common

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
# Bound of the fit: labelled documents that are counted, about; chosen by a hash of the id.
SAMPLE_DOCUMENTS = 10_000
CHUNK = 1_000_000
UNKNOWN = "und"


class Grams:
    """Buckets of the n-grams of a chunk of texts. Letters are looked up once per distinct character."""

    def __init__(self):
        self.code = np.zeros(0x110000, np.int32)    # 0: no letter
        self.seen = np.zeros(0x110000, bool)

    def of(self, texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Per order (buckets, owning text), and whether each text has a letter."""
        joined = "\n".join(t.decode("utf-8", "replace").replace("\n", " ").lower() for t in texts)
        chars = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        fresh = np.unique(chars[~self.seen[chars]])
        self.seen[fresh] = True
        self.code[fresh] = [c if chr(c).isalpha() else 0 for c in fresh.tolist()]
        owner = np.cumsum(chars == 10) - 1
        code = self.code[chars]
        keep = np.append(True, (code[1:] > 0) | (code[:-1] > 0) | (owner[1:] != owner[:-1]))
        code, owner = code[keep].astype(np.uint64), owner[keep]
        letters = np.bincount(owner[code > 0], minlength=len(texts) + 1)[:len(texts)] > 0
        found, value = [], np.zeros(len(code), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            value = value[:len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:] + np.uint64(n)
            if n in ORDERS:
                inside = owner[n - 1:] == owner[:len(code) - n + 1]
                inside &= (code[n - 1:] > 0) if n == 1 else True
                bucket = (value[inside] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
                found.append((bucket.astype(np.int32), owner[:len(code) - n + 1][inside]))
        return found, letters


def count_grams(rows: DataFrame) -> DataFrame:
    """(lang, bucket, n) of labelled rows, already summed within each task's chunks."""
    def run(batches):
        grams, total = Grams(), {}
        for langs, texts in common.chunks(batches, CHUNK):
            found, _ = grams.of(texts)
            names = sorted(set(langs))
            which = np.array([names.index(x) for x in langs])
            for buckets, owner in found:
                flat = np.bincount(which[np.minimum(owner, len(langs) - 1)] * BUCKETS + buckets, minlength=len(names) * BUCKETS)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + flat[k * BUCKETS:(k + 1) * BUCKETS]
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                                              pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])

    return (rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def fit(docs: DataFrame, training: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probability matrix and log-priors from labelled rows where ``training`` holds."""
    labelled = docs.where(training & F.col("lang").isNotNull())
    by_lang = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    share = min(1.0, SAMPLE_DOCUMENTS / max(sum(by_lang.values()), 1))
    chosen = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(21)), F.lit(1 << 20)) <= int(share * (1 << 20))
    counts = count_grams(labelled.where(chosen).select("lang", F.col("text").cast("string").alias("text"))).toPandas()
    names = sorted(counts["lang"].unique())
    matrix = np.full((BUCKETS, len(names)), SMOOTHING)
    matrix[counts["bucket"], [names.index(x) for x in counts["lang"]]] += counts["n"]
    prior = np.array([by_lang[x] for x in names], float)
    return names, np.log(matrix / matrix.sum(0)).astype(np.float32), np.log(prior / prior.sum()) if len(names) else prior


def predict(docs: DataFrame, training: Column, held_out: Column) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per input row.

    ``score`` is the posterior of the prediction. Null texts, texts without a letter, and
    every text if no labelled row was there to learn from give ``und`` with score 0.
    Repeated rows get equal predictions; an empty table gives no rows. ``training`` and
    ``held_out`` are conditions on ``doc_id``; nothing else of a row is used but its text.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, training))     # BUCKETS rows, one column per language

    def run(batches):
        names, matrix, prior = model.value
        grams = Grams()
        for ids, texts in common.chunks(batches, CHUNK):
            found, letters = grams.of(texts)
            score = np.tile(prior, (len(ids), 1))
            for buckets, owner in found:
                edge = np.searchsorted(owner, np.arange(len(ids) + 1))
                full = np.flatnonzero(edge[1:] > edge[:-1])
                if len(full) and names:
                    for k in range(len(names)):
                        column = np.ascontiguousarray(matrix[:, k])
                        score[full, k] += np.add.reduceat(column[buckets[:edge[-1]]], edge[full], dtype=np.float64)
            known = letters & bool(names)
            best = score.argmax(1) if names else np.zeros(len(ids), int)
            share = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1) if names else np.zeros(len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([names[b] if k else UNKNOWN for b, k in zip(best, known)], pa.string()),
                 pa.array(np.where(known, share, 0.0))], names=["doc_id", "lang_pred", "score"])

    return (common.keyed(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
