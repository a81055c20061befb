import re
from collections import Counter

import numpy as np
import pytest

from tenetlog.llm import quality_rules

TEXTS = [None, "", " \n ", "a b c a b c", "a a a a", "x", "line one\nline one\n\n\nline two\nline one ", "é ß # $ <> 🙂",
         "w1 w2 w3 " * 40, " ".join(f"u{k}" for k in range(60)), "a\x0bb\x0cc\rd", "a b c\x00a b c", "same words here " * 30000]


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[k:k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, dup, repeat = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)


def test_small_texts(spark, docs_of):
    labels = spark.createDataFrame([(9, 1, 0), (9, 1, 0), (None, 1, 0), (999, 0, 1)], "doc_id long, quality int, toxic int")
    check(quality_rules.judge(docs_of(TEXTS), labels).collect(), TEXTS)
    check(quality_rules.judge(docs_of(TEXTS), None).collect(), TEXTS)
    check(quality_rules.judge(docs_of(TEXTS), labels.limit(0)).collect(), TEXTS)
    assert quality_rules.judge(docs_of([]), labels).count() == 0
    assert quality_rules.judge(docs_of([(1, "a")] * 3 + [(None, "b")]), labels).count() == 4


def test_given_documents(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.judge(docs, labels).collect()
    check(rows, {r.doc_id: r.text for r in docs.collect()})
    mark = {r.doc_id: r.quality for r in labels.collect()}
    rest = [r for r in rows if not r.base_failed and r.doc_id in mark]
    assert np.mean([r.kept for r in rest if mark[r.doc_id] == 1]) > 0.98
    assert np.mean([r.kept for r in rest if mark[r.doc_id] == 0]) < 0.2


def test_lonely_rows_score_higher():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.normal(0, 1, (2000, 3)), [[9, 9, 9], [-8, 7, 9]]])
    score = quality_rules.Forest(rows).score(rows)
    assert score[-2:].min() > np.quantile(score[:-2], 0.999)


@pytest.mark.parametrize("bins", [4_096, 3])
def test_order_statistic_equals_sorting(spark, monkeypatch, bins):
    monkeypatch.setattr(quality_rules, "BINS", bins)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.random(400), np.full(300, 0.5), [0.5 + 1e-16, 0.5 + 2e-16, 1e-300, 1.0]])
    scores = spark.createDataFrame([(float(v),) for v in values], "score double").cache()
    for k in (0, 1, 350, 600, len(values) - 2, len(values) - 1):
        assert quality_rules.order_statistic(scores, k) == np.sort(values)[k]
