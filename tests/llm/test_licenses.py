import re

from tenetlog.llm import licenses

TEXTS = [None, "", "?!", "MIT License", "the mit license, and the MIT--License", "Gnu General Public License v3.0 or later",
         "Licensed under the Apache License, Version 2.0 (the License)", "cc by", "CC BY-SA 4.0", "CC-BY cc by cc by nc 4.0",
         "mit licensed éà MIT LICENSE é", "gpl", "İ Mit License", "under the terms of the mit license",
         "gnu general public\nlicense apache\tlicense mit license cc by", "x " * 5000 + "mit license " * 500,
         "permission is hereby granted, free of charge, to any person obtaining a copy", "BSD 3-Clause License"]


def words(text):
    low = (text or "").translate(str.maketrans(*licenses.LOWER))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def base(text):
    w = words(text)
    places = [(k, label) for phrase, label in licenses.BASE.items() for k in range(len(w))
              if w[k:k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return (len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def method(text):
    """Labels of the intervals that no other interval contains, one rule after the other."""
    norm = "# " + "".join(w + " " for w in words(text))
    found = [(m.start(1), -m.end(1), r[3], r[0], r[2], r[4]) for r in licenses.rules() if f" {r[1]}" in norm
             for m in re.finditer(f"( {r[5]})(?= )", norm)]
    kept = [f for f in found if not any((g[0] <= f[0] and g[1] <= f[1]) and (g[:2] != f[:2] or g < f) for g in found if g != f)]
    return {f[4] for f in kept}, max((f[5] for f in kept), default=0.0)


def check(rows, texts):
    assert len(rows) == len(texts)
    for r in rows:
        want = base(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, texts[r.doc_id][:80]
        labels, sure = method(texts[r.doc_id])
        have = labels | set(filter(None, want[4].split(",")))
        assert r.labels == ",".join(sorted(have)), (texts[r.doc_id] or "")[:80]
        assert r.score == max(sure, 0.5 if want[1] else 0.0)


def test_small_texts(docs_of):
    check(licenses.scan(docs_of(TEXTS)).collect(), TEXTS)
    rows = {r.doc_id: r.labels for r in licenses.scan(docs_of(TEXTS)).collect()}
    assert rows[5] == "gpl,gpl-3" and rows[6] == "apache,apache-2.0" and rows[8] == "cc-by,cc-by-sa-4.0" and rows[17] == "bsd-3-clause"


def test_repeated_rows_and_empty_table(docs_of):
    assert licenses.scan(docs_of([(1, "mit license")] * 3 + [(None, "cc by")])).count() == 4
    assert licenses.scan(docs_of([])).count() == 0


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(licenses.scan(docs).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_rules_and_plan(spark, sf, docs_of):
    assert len(licenses.rules()) > 200 and len({r[0] for r in licenses.rules()}) == len(licenses.rules())
    plan = licenses.scan(docs_of(TEXTS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
