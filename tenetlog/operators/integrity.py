"""Checks of stored rows: one violation row per broken rule.

Row checks are one projection over the log. The chain and recorded-time checks
need only the row before, found inside position segments.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.functions import canonical as C, instants, jsontext
from tenetlog.operators.segments import predecessor
from tenetlog.schema import EVENT_SCHEMA_VERSION, EVENT_TYPES, ORIGINS, VERIFIABILITY


def _absent(col: Column) -> Column:
    return F.coalesce(col == "", F.lit(True))


def _is_object(text: Column) -> Column:
    return F.coalesce(F.json_object_keys(text).isNotNull(), F.lit(False))


def string_member(document: Column, name: str) -> Column:
    """Value of a top-level member when it is a JSON string, else NULL."""
    variant = F.try_parse_json(document)
    member = F.try_variant_get(variant, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == "STRING", F.try_variant_get(variant, f"$.{name}", "string"))


# A source in canonical form without options; its actor, if that needs no escape.
_PLAIN_SOURCE = r'\A\{"actor_id":"([ -~&&[^"\\]]++)","config":\{\}\}\z'


def _source_checks(source: Column) -> list[tuple[str, Column, str]]:
    other = ~F.coalesce(source.rlike(_PLAIN_SOURCE), F.lit(False))      # most sources need no parsing
    actor_ok = F.coalesce(source.rlike(r'"actor_id":"'), F.lit(False)) & ~_absent(C.actor_of(source))
    config = F.get_json_object(source, "$.config")
    return [
        ("source", other & ~_is_object(source), "source must be an object"),
        ("source.actor_id", other & _is_object(source) & ~actor_ok, "source.actor_id must be a nonempty string"),
        ("source.config", other & config.isNotNull() & ~_is_object(config), "source.config must be an object"),
    ]


def _refs_checks(refs: Column) -> list[tuple[str, Column, str]]:
    parsed = F.from_json(refs, "array<string>")
    is_array = F.coalesce(F.json_array_length(refs) >= 0, F.lit(False))
    bad_item = F.exists(parsed, lambda r: r.isNull() | (r == ""))
    only_texts = refs.rlike(r'^\[\s*+(?:{t}\s*+(?:,\s*+{t}\s*+)*+)?+\]$'.replace("{t}", r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'))
    return [
        ("entity_refs", refs.isNotNull() & ~is_array, "entity_refs must be an array"),
        ("entity_refs", refs.isNotNull() & is_array & (~only_texts | F.coalesce(bad_item, F.lit(False))),
         "entity reference must be a nonempty string"),
    ]


def envelope_checks() -> list[tuple[str, Column, str]]:
    """(check, broken, message) over envelope columns."""
    c = F.col
    checks = [
        ("schema_version", ~c("schema_version").eqNullSafe(EVENT_SCHEMA_VERSION), "unsupported event schema_version"),
        ("event_type", ~F.coalesce(c("event_type").isin(*EVENT_TYPES), F.lit(False)), "unsupported event_type"),
        ("origin_type", ~F.coalesce(c("origin_type").isin(*ORIGINS), F.lit(False)), "unknown origin_type"),
    ]
    checks += [(n, _absent(c(n)), f"{n} must be a nonempty string")
               for n in ("event_id", "source_class", "occurred_at", "recorded_at")]
    checks += [(n, ~_absent(c(n)) & instants.instant_us(c(n)).isNull(), f"invalid {n}")
               for n in ("occurred_at", "recorded_at")]
    checks += _source_checks(c("source")) + _refs_checks(c("entity_refs"))
    checks += [(n, ~C.valid_hash(c(n)), f"{n} must be a SHA-256 hex digest")
               for n in ("idempotency_key", "payload_hash", "event_hash")]
    checks += [("prev_event_hash", c("prev_event_hash").isNotNull() & ~C.valid_hash(c("prev_event_hash")),
                "prev_event_hash must be a SHA-256 hex digest"),
               ("envelope_hash", ~C.event_hash(C.event_material(), c("prev_event_hash")).eqNullSafe(c("event_hash")),
                "envelope hash mismatch")]
    return checks


def payload_checks(canonical: Column) -> list[tuple[str, Column, str]]:
    """Checks of the joined payload row; ``canonical`` is its canonical text."""
    c = F.col
    present = c("payload_event_id").isNotNull()
    agrees = present & c("payload_row_hash").eqNullSafe(c("payload_hash"))
    readable = agrees & ~F.coalesce(c("redacted"), F.lit(False)) & c("ciphertext").isNotNull()
    is_object = readable & _is_object(c("ciphertext"))
    key = C.idempotency_key(C.actor_of(c("source")), c("occurred_at"), canonical)
    return [
        ("payload", ~present, "missing payload row"),
        ("payload", present & ~agrees, "envelope/payload identity or hash mismatch"),
        ("payload", agrees & F.coalesce(c("redacted"), F.lit(False)), "redacted payload replay is not implemented"),
        ("payload", agrees & ~F.coalesce(c("redacted"), F.lit(False)) & c("ciphertext").isNull(),
         "missing payload content"),
        ("payload", readable & ~is_object, "event payload must be an object"),
        ("payload_hash", is_object & ~C.payload_hash(canonical).eqNullSafe(c("payload_hash")), "payload hash mismatch"),
        ("idempotency_key", is_object & ~key.eqNullSafe(c("idempotency_key")),
         "idempotency key does not match contents"),
    ]


def pack(checks) -> Column:
    """Array of {check, message} for the broken ones; rows without any, the most, build none."""
    found = F.array_compact(F.array(*[
        F.when(broken, F.struct(F.lit(name).alias("check"), F.lit(text).alias("message")))
        for name, broken, text in checks]))
    some = reduce(lambda a, b: a | b, [F.coalesce(broken, F.lit(False)) for _, broken, _ in checks])
    return F.when(some, found).otherwise(F.array().cast("array<struct<check:string,message:string>>"))


def unpack(df: DataFrame, problems: Column, location: Column) -> DataFrame:
    return (df.select(F.explode(problems).alias("_p"), location.cast("string").alias("location"))
            .select(F.col("_p.check").alias("check"), "location", F.col("_p.message").alias("message")))


def canonical_payload(exact: bool) -> Column:
    """Canonical form of the stored payload, whatever its spelling; hashes are over that form.

    Most payloads are stored in canonical form. An expression recognises those that
    surely are: compact, keys in order, no escapes and no fractions, whose spelling may
    vary. Only the others go through Python. ``exact`` sends all of them.
    """
    text = F.col("ciphertext")
    if exact:
        return jsontext.canonical_json(text)
    plain = _surely_canonical(text)
    return F.when(plain, text).otherwise(jsontext.canonical_json(F.when(~plain, text)))


def _surely_canonical(text: Column) -> Column:
    return F.coalesce((F.to_json(F.try_parse_json(text)) == text) & ~text.rlike(r'\\u|[0-9][.eE]'), F.lit(False))


def surely_sound() -> Column:
    """Rows in the common spelling that break no check, told by one cheap condition.

    A digest that equals the one computed needs no check of its letters, and a source in
    canonical form without options is read by one pattern. All other rows are false here
    and are left to the checks themselves.
    """
    c, text = F.col, F.col("ciphertext")
    actor = F.regexp_extract(c("source"), _PLAIN_SOURCE, 1)
    refs = F.when(c("entity_refs").isNull(), F.lit(True)).otherwise(
        ~reduce(lambda a, b: a | b, [broken for _, broken, _ in _refs_checks(c("entity_refs"))]))
    parts = [
        c("schema_version") == EVENT_SCHEMA_VERSION, c("event_type").isin(*EVENT_TYPES), c("origin_type").isin(*ORIGINS),
        c("event_id") != "", c("source_class") != "", actor != "",
        instants.instant_us(c("occurred_at")).isNotNull(), instants.instant_us(c("recorded_at")).isNotNull(), refs,
        c("prev_event_hash").isNull() | C.valid_hash(c("prev_event_hash")),
        C.event_hash(C.event_material(), c("prev_event_hash")) == c("event_hash"),
        c("payload_event_id").isNotNull(), c("payload_row_hash") == c("payload_hash"), ~F.coalesce(c("redacted"), F.lit(False)),
        text.startswith("{"), C.payload_hash(text) == c("payload_hash"),
        C.idempotency_key(actor, c("occurred_at"), text) == c("idempotency_key"), _surely_canonical(text)]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def row_violations(joined: DataFrame, *, exact: bool = False) -> DataFrame:
    """Envelope and payload checks of each joined row.

    Rows that are surely sound go no further; the others go on to Python and to every check.
    """
    rows = (joined if exact else joined.where(~surely_sound())).withColumn("_canonical", canonical_payload(exact))
    return unpack(rows, pack(envelope_checks() + payload_checks(F.col("_canonical"))), F.col("event_id"))


def link_columns(events: DataFrame) -> DataFrame:
    """Each event with its predecessor's hash, chain and recorded instant."""
    timed = events.withColumn("recorded_us", instants.instant_us(F.col("recorded_at")))
    return predecessor(timed, {"_hash": "event_hash", "_chain": "chain_id", "_us": "recorded_us", "_pos": "log_position"})


def link_violations(events: DataFrame) -> DataFrame:
    """Broken hash links and recorded times that step back along the log."""
    linked = link_columns(events)
    expected = F.when(F.col("_chain") == F.col("chain_id"), F.col("_hash"))
    checks = [
        ("chain", ~F.col("prev_event_hash").eqNullSafe(expected),
         "event predecessor does not match the preceding log event"),
        ("recorded_at", F.coalesce(F.col("recorded_us") < F.col("_us"), F.lit(False)),
         "recorded_at precedes previous event"),
        ("position", (F.col("log_position") > 1) & F.col("_pos").isNull(), "log position has no predecessor"),
    ]
    return unpack(linked, pack(checks), F.col("event_id"))


def duplicate_violations(events: DataFrame) -> DataFrame:
    """Event IDs and idempotency keys that occur twice."""
    found = []
    for name in ("event_id", "idempotency_key"):
        found.append(events.groupBy(F.col(name).alias("location")).agg(F.count(F.lit(1)).alias("n"))
                     .where("n > 1").select(F.lit("event_schema").alias("check"), "location",
                                            F.lit(f"duplicate {name}").alias("message")))
    return reduce(DataFrame.unionByName, found)


def orphan_violations(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Payload rows without an event, or several for one event."""
    counts = payloads.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))
    return (counts.join(events.select("event_id", F.lit(True).alias("_known")).distinct(), "event_id", "left")
            .where(F.col("_known").isNull() | (F.col("n") > 1))
            .select(F.lit("payload_hash").alias("check"), F.col("event_id").alias("location"),
                    F.when(F.col("_known").isNull(), "orphan payload row").otherwise("several payload rows").alias("message")))


def log_violations(joined: DataFrame, *, exact: bool = False) -> DataFrame:
    """Everything that makes a log unreadable, over the whole log."""
    return (row_violations(joined, exact=exact)
            .unionByName(link_violations(joined))
            .unionByName(duplicate_violations(joined)))


def value_domain_checks() -> list[tuple[str, Column, str]]:
    """Admission rules of value payloads; never applied to stored history."""
    value, label = string_member(F.col("ciphertext"), "value"), string_member(F.col("ciphertext"), "verifiability")
    return [
        ("value", value.isNull(), "value must be a JSON string"),
        ("verifiability", ~F.coalesce(label.isin(*VERIFIABILITY), F.lit(False)), "unknown verifiability"),
    ]


def request_checks() -> list[tuple[str, Column, str]]:
    """Shape of a submitted request, before any position is assigned."""
    problem = instants.timestamp_problem(F.col("occurred_at"), "occurred_at")
    return [
        ("occurred_at", problem.isNotNull(), "occurred_at has no instant"),
        *_source_checks(F.col("source")),
        ("redaction", F.col("redacted") | F.col("ciphertext").isNull() | F.col("canonical_entity_id").isNotNull(),
         "redaction or canonical key binding is not implemented"),
        ("payload", F.col("ciphertext").isNotNull() & ~_is_object(F.col("ciphertext")), "event payload must be an object"),
    ]


def unsupported_events(log: DataFrame, supported, projector: str) -> DataFrame:
    return log.where(~F.col("event_type").isin(*supported)).select(
        F.lit("event_type").alias("check"), F.col("event_id").alias("location"),
        F.concat(F.lit(f"projector {projector} refuses "), F.col("event_type")).alias("message"))
