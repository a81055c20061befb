import re
from collections import Counter, defaultdict

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from .test_minhash import brute

MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def outputs(spark):
    """Rows of each stage's input and output, the last stage's included."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    found = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.common.stored(stage(spark, docs, MEDIUM), "test-stage")
        found.append(docs.collect())
    return found


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_stages_keep_columns(outputs):
    assert all(set(rows[0].asDict()) == set(outputs[0][0].asDict()) for rows in outputs[:-1])


def test_quality_stage_keeps_good_documents(spark, outputs):
    kept = {r.doc_id for r in outputs[1]}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    long = {r.doc_id for r in outputs[0] if len(words(r.text)) >= 50}
    good = [d for d in long if quality.get(d) == 1]
    assert sum(d in kept for d in good) > 0.97 * len(good) and not any(len(words(r.text)) < 50 for r in outputs[1])


def test_one_of_each_group_stays(outputs):
    component, _ = brute({r.doc_id: r.text for r in outputs[1]}, 5)
    assert sorted(r.doc_id for r in outputs[2]) == sorted({*component.values()})


def test_no_window_repeats_that_was_there(outputs):
    before = {r.doc_id: words(r.text) for r in outputs[2]}
    seen = Counter(tuple(w[k:k + 35]) for w in before.values() for k in range(len(w) - 34))
    assert sorted(before) == sorted(r.doc_id for r in outputs[3])
    for r in outputs[3]:
        w = before[r.doc_id]
        gone = {k + j for k in range(len(w) - 34) if seen[tuple(w[k:k + 35])] > 1 for j in range(35)}
        assert words(r.text) == [x for k, x in enumerate(w) if k not in gone]


def test_no_item_is_left(spark, outputs):
    items = [r.text for r in spark.read.parquet(f"{MEDIUM}/benchmark.parquet").collect()]
    left = {r.doc_id for r in outputs[4]}
    holds = {r.doc_id for r in outputs[3] if any(t in r.text for t in items)}
    assert holds and not holds & left and len(left) > 0.85 * len(outputs[3])


def test_every_document_is_packed(outputs):
    pieces = defaultdict(int)
    for r in outputs[5]:
        pieces[r.doc_id] += r.length
    assert set(pieces) == {r.doc_id for r in outputs[4]}
    assert all(pieces[r.doc_id] == r.doc_tokens for r in outputs[5])


def test_run_equals_stages(spark, outputs):
    got = entry.queries()["pipeline"](spark, MEDIUM).collect()
    assert sum(r.length for r in got) == sum(r.length for r in outputs[5]) and {r.doc_id for r in got} == {r.doc_id for r in outputs[5]}


def test_odd_rows_pass_all_stages(spark, docs_of):
    docs = docs_of([None, "", "a", (None, None), (None, "b " * 60), (3, " ".join(f"w{k}" for k in range(80))),
                    (3, " ".join(f"w{k}" for k in range(80))), (4, " ".join(f"v{k}" for k in range(80)))])
    for rows in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[1:4]:
            rows = stage(spark, rows, MEDIUM)
            assert rows.columns == docs.columns
        corpus_pipeline.STAGES[4][1](spark, rows, MEDIUM).collect()
        assert corpus_pipeline.STAGES[0][1](spark, rows, MEDIUM).columns == docs.columns
    rows = corpus_pipeline.near_duplicates(spark, docs, MEDIUM).collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1, 2, 3, 4] and len(rows) == 7
