"""Canonical JSON and hashes as column expressions.

Canonical JSON has sorted keys, no spaces and unescaped non-ASCII text. Every
builder here stays in the JVM; arbitrary JSON is in ``jsontext``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tenetlog.schema import HASHED_FIELDS

# Control characters that Spark's JSON writer spells with upper-case hex digits.
_UPPER_HEX = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")
UNIT_SEPARATOR = "\x1f"


def _lower_escapes(text: Column) -> Column:
    fixed = text
    for code in _UPPER_HEX:
        # An even run of backslashes before it means a real escape.
        fixed = F.regexp_replace(fixed, r"(?<!\\)((?:\\\\)*)\\u00" + code, r"$1\\u00" + code.lower())
    return fixed


def rarely(text: Column, work) -> Column:
    """Apply ``work`` outside generated code: for long expressions on rare rows."""
    return F.element_at(F.transform(F.array(text), work), 1)


def _quoted(text: Column) -> Column:
    array = F.to_json(F.array(text))
    return _lower_escapes(F.substring(array, F.lit(2), F.length(array) - 2))


def json_string(col: Column) -> Column:
    """Quoted JSON string; JSON ``null`` for NULL."""
    plain = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return (F.when(col.isNull(), F.lit("null"))
            .when(~col.rlike(r'[\x00-\x1f"\\]'), F.concat(F.lit('"'), col, F.lit('"')))    # most texts need no escape
            .when(col.rlike(r"[\x00-\x1f]"), rarely(col, _quoted))
            .otherwise(F.concat(F.lit('"'), plain, F.lit('"'))))


def json_strings(array: Column) -> Column:
    """JSON array of strings, order kept."""
    return json_array_of(F.transform(array, json_string))


def json_object(**members: Column | str) -> Column:
    """Object whose member values are JSON texts already; keys are sorted."""
    parts, literal = [], "{"
    for i, name in enumerate(sorted(members)):
        literal += ("," if i else "") + f'"{name}":'
        value = members[name]
        if isinstance(value, str):
            literal += value
            continue
        parts += [F.lit(literal), value]
        literal = ""
    parts.append(F.lit(literal + "}"))
    return F.concat(*parts)


def json_array(*items: Column) -> Column:
    parts = [F.lit("[")]
    for i, item in enumerate(items):
        parts += ([F.lit(",")] if i else []) + [item]
    return F.concat(*parts, F.lit("]"))


def json_array_of(texts: Column) -> Column:
    """Array whose elements are JSON texts already."""
    return F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))


def canonical_set(texts: Column) -> Column:
    """Distinct canonical texts in UTF-8 byte order."""
    return F.array_sort(F.array_distinct(texts))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def valid_hash(col: Column) -> Column:
    return F.coalesce(col.rlike(r"\A[0-9a-f]{64}\z"), F.lit(False))


def packed(text: Column) -> Column:
    """A text in bytes, lossless; a SHA-256 digest takes half the room of its 64 digits."""
    return F.when(valid_hash(text), F.concat(F.unhex(F.lit("00")), F.unhex(text))).otherwise(
        F.concat(F.unhex(F.lit("01")), F.encode(text, "UTF-8")))


def unpacked(data: Column) -> Column:
    rest = F.substring(data, F.lit(2), F.octet_length(data) - 1)
    return F.when(F.substring(data, 1, 1) == F.unhex(F.lit("00")), F.lower(F.hex(rest))).otherwise(rest.cast("string"))


def payload_hash(payload: Column) -> Column:
    return sha256(payload)


def idempotency_key(actor: Column, occurred_at: Column, payload: Column) -> Column:
    return sha256(F.concat_ws(UNIT_SEPARATOR, actor, occurred_at, payload))


def event_material(prefix: str = "") -> Column:
    """Canonical text of the eleven hashed envelope fields."""
    return json_object(**{name: json_string(F.col(prefix + name)) for name in HASHED_FIELDS})


def event_hash(material: Column, prev: Column) -> Column:
    return sha256(F.concat(material, F.coalesce(prev, F.lit(""))))


def dependency_hash(hashes: Column) -> Column:
    """Hash of an array of event hashes: sorted, duplicates kept."""
    return sha256(json_strings(F.array_sort(hashes)))


def pair_key(subject: Column, prop: Column) -> Column:
    return json_array(json_string(subject), json_string(prop))


def subject_scope(repository: Column, path: Column) -> Column:
    return F.concat(F.lit("repo-path:"), json_array(json_string(repository), json_string(path)))


def actor_of(source: Column) -> Column:
    return F.get_json_object(source, "$.actor_id")


def git_blob_hash(data: Column, width: Column) -> Column:
    """Native blob name of BINARY content: 40 hex digits (SHA-1) or 64 (SHA-256)."""
    header = F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(data).cast("string")), "UTF-8"),
                      F.unhex(F.lit("00")))
    content = F.concat(header, data)
    return F.when(width == 40, F.sha1(content)).otherwise(F.sha2(content, 256))


def route(key: Column) -> Column:
    """Routing digits of a map key: hash of the key's JSON text."""
    return sha256(json_string(key))
