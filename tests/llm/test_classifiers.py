import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tenetlog.llm import common, language, rule_ensemble

MEDIUM = "/root/testdata/sf0.01"
TEXTS = [None, "", "12 !? 34", "é", "the of and to in the and", "x" * 200_000, "THE!! OF!! AND!!", "the of and to in the and", "\n\n\n"]


def remainder(doc_id, n):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def test_language_of_given_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    rows = entry.queries()["op1_language_id"](spark, MEDIUM).collect()
    assert len(rows) == len(truth) and all(r.held_out == (remainder(r.doc_id, 3) == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edge_cases(spark, docs_of):
    train = docs_of([(k, "le la les une des et dans") for k in range(20)] + [(k, "the of and to in") for k in range(20, 40)]).withColumn(
        "lang", F.when(F.col("doc_id") < 20, "fr").otherwise("en"))
    docs = train.unionByName(docs_of([(100 + k, t) for k, t in enumerate(TEXTS)] + [(104, TEXTS[4]), (None, "les des")]))
    rows = language.predict(docs, F.col("doc_id") < 40, F.col("doc_id") > 40).collect()
    assert len(rows) == 40 + len(TEXTS) + 2
    found = {r.doc_id: (r.lang_pred, r.score) for r in rows}
    assert all(found[100 + k] == ("und", 0.0) for k in (0, 1, 2, 8))
    assert found[104][0] == found[106][0] == "en" and found[None][0] == "fr"
    assert {r.lang_pred for r in language.predict(docs, F.lit(False), F.lit(True)).collect()} == {"und"}
    assert language.predict(docs_of([]), F.lit(True), F.lit(True)).count() == 0


def test_gram_scores_equal_brute_force():
    text = "Ab c1d é"
    found, letters = language.Grams().of([text.encode(), b"", b"zz"])
    assert letters.tolist() == [True, False, True]
    per_text = [[len(o[o == k]) for _, o in found] for k in range(3)]
    assert per_text == [[5, 8, 7], [0, 0, 0], [2, 2, 1]]     # of " ab c d é", "", " zz", each without its end gap


def test_quality_of_given_documents(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = entry.queries()["op3_quality_classifier"](spark, MEDIUM).collect()
    assert len(rows) == 1000
    assert all(r.held_out == (remainder(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9


def test_quality_edge_cases(spark, docs_of):
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (6, 0, 1), (None, 1, 0), (7, None, 0), (99, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    docs = docs_of(TEXTS + [(None, "a")] + [(4, TEXTS[4])])
    rows = rule_ensemble.classify(docs, labels, F.lit(True), F.lit(False)).collect()
    assert len(rows) == len(TEXTS) + 2 and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rule_ensemble.classify(docs, labels.limit(0), F.lit(True), F.lit(False)).collect()} == {0.5}
    assert rule_ensemble.classify(docs_of([]), labels, F.lit(True), F.lit(False)).count() == 0


def test_compiled_rules_equal_numpy(spark, docs_of):
    rng = np.random.default_rng(2)
    x = rng.random((400, len(rule_ensemble.STATISTICS)))
    y = (x[:, 0] > 0.5) & (x[:, 3] <= 0.4)
    rules = rule_ensemble.grow_rules(x, y)
    truth = np.column_stack([rule_ensemble.holds(r, x) for r in rules]).astype(float)
    bias, weights = rule_ensemble.lasso(truth, y.astype(float))
    assert 0 < np.count_nonzero(np.abs(weights) > 1e-4) < len(rules) / 2
    table = spark.createDataFrame(x.tolist(), list(rule_ensemble.STATISTICS))
    got = np.sort([r[0] for r in table.select(rule_ensemble.compiled(bias, list(zip(weights.tolist(), rules)))).collect()])
    want = np.sort(1 / (1 + np.exp(-(bias + truth @ weights))))
    assert got == pytest.approx(want, abs=1e-9)
    assert np.mean((1 / (1 + np.exp(-(bias + truth @ weights))) > 0.5) == y) > 0.97


def test_remainders(spark):
    rows = spark.createDataFrame([(1,), (12345,), (None,)], "doc_id long").select(
        "doc_id", common.id_remainder(F.col("doc_id"), 5).alias("r")).collect()
    assert all(r.r == remainder(r.doc_id, 5) for r in rows)
