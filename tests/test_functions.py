import json
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tenetlog.functions import canonical as C, instants, jsontext, literals, trie

SPELLINGS = [
    "2024-01-01T10:00:00Z", "20240101T10Z", "2024-W01-1T10:00:00,123+05:30:15", "2024W017T10Z", "2024-W01T10Z",
    "2024-01-01 10:00:00.123456789-19:00", "2024-01-01T1000+0530", "2024-01-01T10:00:00+2359", "2024-01-01T10:00:00.Z",
    "2024-01-01T100000.5Z", "0001-01-01T00:00:00+23:00", "2020-W53-5T10:00Z", "1969-12-31T23:59:59.999999Z",
    "2024-01-01T10:00:00-00:00", "2024-01-01X10:00Z", "2024-01-01T10:00:00+00:00:00.5",
    "2024-01-01T10:00:00z", "2024-01-01", "2024-01-01T10:00:00", "2024-W53-1T00:00Z", "2024-02-30T00:00:00Z",
    "2024-01-01T10:00:00+24:00", "2024-01-01T10:60Z", "2024-01-01T10:00:60Z", "2024-01-01T10:0000Z", "junk", "",
    "2024-01-01T10:00:00+05:3015", "2024-W00-1T10:00Z", "2024-1-01T10:00:00Z",
]


def _python_us(text):
    try:
        value = datetime.fromisoformat(text)
    except ValueError:
        return None, "not ISO8601"
    if value.tzinfo is None:
        return None, "timezone offset"
    return (value - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1), None


def test_instants_match_iso_parsing(spark):
    rows = spark.createDataFrame([(t,) for t in SPELLINGS], "t string").select(
        "t", instants.instant_us(F.col("t")).alias("us"), instants.timestamp_problem(F.col("t"), "x").alias("problem")).collect()
    for row in rows:
        us, why = _python_us(row.t)
        assert row.us == us, row.t
        assert (row.problem is None) == (why is None) and (why or "") in (row.problem or ""), row.t


TEXTS = ["", 'a"b\\c', "\x00\x0b\x1f\x7f\n\t", "é/ß", "é", "漢字😀", "\\u000B", " ", None]


def test_json_text_matches_python(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for row in df.select("t", C.json_string(F.col("t")).alias("j"), C.json_object(z=C.json_string(F.col("t")), a="[1]").alias("o")).collect():
        assert row.j == json.dumps(row.t, ensure_ascii=False)
        assert row.o == json.dumps({"a": [1], "z": row.t}, ensure_ascii=False, separators=(",", ":"))


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-2**70, 2**70) | st.floats(allow_nan=False, allow_infinity=False)
                      | st.text(max_size=8), lambda v: st.lists(v, max_size=3) | st.dictionaries(st.text(max_size=4), v, max_size=3), max_leaves=8)


@settings(max_examples=60, deadline=None)
@given(VALUES)
def test_strict_value_keeps_ordinary_json(value):
    try:
        text = json.dumps(value)
        text.encode()
        json.dumps(value, ensure_ascii=False).encode()
    except UnicodeEncodeError:
        return
    assert jsontext.strict_value(text) == value


@pytest.mark.parametrize("text", ['{"a":1,"a":2}', '{"b":{"a":1,"a":1}}', "[NaN]", "[Infinity]", "[1e999]", '["\\ud800"]', "{", ""])
def test_strict_value_refuses(text):
    with pytest.raises(ValueError):
        jsontext.strict_value(text)


def test_blob_names(spark):
    row = spark.range(1).select(C.git_blob_hash(F.encode(F.lit("hello\n"), "UTF-8"), F.lit(40)).alias("a"),
                                C.git_blob_hash(F.encode(F.lit(""), "UTF-8"), F.lit(40)).alias("b")).first()
    # Well-known blob names of "hello\n" and of the empty file.
    assert row.a == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert row.b == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


def naive_root(ns, entries):
    """Split by bit from the top; independent of the library's neighbour fold."""
    from hashlib import sha256
    if not entries:
        return trie.empty_digest(ns)

    def build(items, bit):
        if len(items) == 1:
            return items[0][1]
        while True:
            left = [e for e in items if not e[0] >> (255 - bit) & 1]
            right = [e for e in items if e[0] >> (255 - bit) & 1]
            if left and right:
                break
            bit += 1
        masked = items[0][0] >> (256 - bit) << (256 - bit) if bit else 0
        body = {"format": f"{ns}-map/1", "kind": "branch", "bit": bit, "prefix": f"{masked:064x}",
                "left": build(left, bit + 1), "right": build(right, bit + 1)}
        return sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return build(entries, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**256 - 1), st.integers(0, 2**256 - 1)), max_size=30))
def test_trie_fold_and_growth(pairs):
    grown, current = trie.GrowingTrie("n"), {}
    for route, digest in pairs:
        current[route] = f"{digest:064x}"
        assert grown.upsert(route, current[route]) == naive_root("n", sorted(current.items()))
    assert trie.fold_sorted("n", sorted(current.items())) == naive_root("n", sorted(current.items()))


def test_literal_spans():
    data = "# Tïtle\r\n\r\nStatus: one\r\n two\r\n\r\n- **Implementation:** done\n```\n# not this\n```\nDate: 1 May\n".encode()
    got = literals.scan(data)
    assert [(l["property_id"], l["value"], l["start_line"], l["end_line"]) for l in got["literals"]] == [
        ("adr.title.literal", "Tïtle", 1, 1), ("adr.status.literal", "one\r\n two", 3, 4),
        ("adr.implementation.literal", "done\n```", 6, 7)]
    for item in got["literals"]:
        assert data[item["start_byte"]:item["end_byte"]].decode() == item["value"]
    assert got["dates"] == ["1 May"]


@pytest.mark.parametrize("data", [
    b"\xef\xbb\xbf# t\n", b"\xff\n", b"# a\n\n# b\n", b"Status: \n", b"**Status**: x\n", b"- Status: x\n", b"Status:x\n",
    b"```\nopen\n", b"# a\nStatus: b\nStatus: c\n", b"Status: a\nImplementation: b\n", b"Implementation:\n",
])
def test_literal_refusals(data):
    with pytest.raises(literals.Refused):
        literals.scan(data)
