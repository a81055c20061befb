"""Logs as tables: requests, stored events and payloads, and scans over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.functions import canonical as C, instants
from tenetlog.operators.chains import hash_chain
from tenetlog.operators.segments import predecessor
from tenetlog.schema import (ENVELOPE_FIELDS, EVENT_SCHEMA_VERSION, MENTION, OBSERVATION,
                             REQUEST_FIELDS, LogError)

# Positions per hash chain. Chains are independent, so assignment and checks of
# different chains run in parallel; one root over the chain tips seals the log.
CHAIN_POSITIONS = 64
PAYLOAD_FIELDS = ("payload_hash", "canonical_entity_id", "ciphertext", "redacted")


def chain_of(position: Column, positions: int = CHAIN_POSITIONS) -> Column:
    return F.floor((position - 1) / F.lit(positions)).cast("long")


def prepare_requests(df: DataFrame, *, event_type: Column, occurred_at: Column, actor_id: Column,
                     source_class: Column, payload: Column, event_id: Column, origin_type: Column | None = None,
                     config: Column | None = None, entity_refs: Column | None = None) -> DataFrame:
    """Request rows from semantic columns; the other columns of ``df`` are kept.

    ``payload`` and ``config`` are canonical JSON texts, ``entity_refs`` an array.
    """
    source = C.json_object(actor_id=C.json_string(actor_id), config=config if config is not None else "{}")
    refs = F.lit(None).cast("string") if entity_refs is None else F.when(
        entity_refs.isNotNull(), C.json_strings(entity_refs))
    return df.select(
        "*", event_id.cast("string").alias("event_id"), F.lit(EVENT_SCHEMA_VERSION).alias("schema_version"),
        event_type.alias("event_type"), occurred_at.alias("occurred_at"), source.alias("source"),
        source_class.alias("source_class"),
        (F.lit("observed") if origin_type is None else origin_type).alias("origin_type"),
        refs.alias("entity_refs"), F.lit(None).cast("string").alias("canonical_entity_id"),
        payload.alias("ciphertext"), F.lit(False).alias("redacted"))


def mention_payload(mention_id: Column, subject_id: Column, text: Column) -> Column:
    return C.json_object(link_state='"constitutive"', mention_id=C.json_string(mention_id),
                         subject_id=C.json_string(subject_id), text=C.json_string(text))


def prepare_mentions(df: DataFrame, *, actor_id, source_class, occurred_at, event_id, config=None) -> DataFrame:
    """Mention requests from rows with mention_id, subject_id and text."""
    return prepare_requests(
        df, event_type=F.lit(MENTION), occurred_at=occurred_at, actor_id=actor_id,
        source_class=source_class, event_id=event_id, config=config,
        payload=mention_payload(F.col("mention_id"), F.col("subject_id"), F.col("text")),
        entity_refs=F.array("subject_id"))


def claim_json(belief_id, claim_candidate_id, mention_id, property_id, subject_id, value_json, verifiability) -> Column:
    return C.json_object(
        belief_id=C.json_string(belief_id), claim_candidate_id=C.json_string(claim_candidate_id),
        mention_id=C.json_string(mention_id), property_id=C.json_string(property_id),
        subject_id=C.json_string(subject_id), value=value_json, verifiability=C.json_string(verifiability))


def prepare_observations(claims: DataFrame, current: DataFrame) -> DataFrame:
    """Fill in the current belief of each claim and report claims that cannot go on.

    ``claims``: one row per claim with subject_id, property_id and a nullable
    belief_id. ``current``: (subject_id, property_id, belief_id), unique pairs.
    Adds ``problem``; a submitted belief is never redirected.
    """
    known = current.select("subject_id", "property_id", F.col("belief_id").alias("_current"))
    joined = claims.join(known, ["subject_id", "property_id"], "left")
    problem = (F.when(F.col("_current").isNotNull() & F.col("belief_id").isNotNull()
                      & (F.col("belief_id") != F.col("_current")),
                      "submitted belief_id differs from current belief")
               .when(F.col("_current").isNull() & F.col("belief_id").isNull(),
                     "new belief requires a retained recorded belief_id"))
    return (joined.withColumn("problem", problem)
            .withColumn("belief_id", F.coalesce("_current", "belief_id"))
            .select(*claims.columns, "problem"))


def assign(requests: DataFrame, *, recorded_at: Column | None = None, chain: Column | None = None,
           tips: DataFrame | None = None) -> DataFrame:
    """Events with positions become stored rows: hashes, keys and chain links.

    Needs ``log_position`` (dense). ``tips`` (chain_id, seed) continue chains. A ``chain``
    of the caller's own may be of any length; the log's own chains are short.
    """
    rows = requests
    if recorded_at is not None:
        rows = rows.withColumn("recorded_at", recorded_at)
    if chain is None:
        return assign_in_chain(rows.withColumn("chain_id", chain_of(F.col("log_position"))), tips)
    rows = _hashed(rows.withColumn("chain_id", chain.cast("long")))
    material = C.event_material()
    links = hash_chain(rows.select("log_position", "chain_id", material.alias("_material")), ["chain_id"],
                       first=F.col("_material"), before=F.col("_material"), after=F.lit(""), seeds=tips)
    hashed = rows.join(links.select("log_position", F.col("chain_hash").alias("event_hash")), "log_position")
    linked = predecessor(hashed, {"_prev": "event_hash", "_prev_chain": "chain_id"})
    prev = F.when(F.col("_prev_chain") == F.col("chain_id"), F.col("_prev"))
    if tips is not None:
        linked = linked.join(tips, "chain_id", "left")
        prev = F.coalesce(prev, F.col("seed"))
    return linked.withColumn("prev_event_hash", prev).select(
        "log_position", "chain_id", *ENVELOPE_FIELDS, "canonical_entity_id", "ciphertext", "redacted")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("payload_hash", C.payload_hash(F.col("ciphertext"))).withColumn(
        "idempotency_key", C.idempotency_key(C.actor_of(F.col("source")), F.col("occurred_at"), F.col("ciphertext")))


def assign_in_chain(requests: DataFrame, tips: DataFrame | None = None) -> DataFrame:
    """Like ``assign`` for the log's own short chains (``chain_id`` given), in one shuffle at most.

    A chain's rows meet in one bounded array, so the links need no later join.
    """
    rows = _hashed(requests).withColumn("_material", C.event_material())
    names = ["log_position", "_material"] + [c for c in rows.columns if c not in ("log_position", "_material", "chain_id")]
    grouped = rows.groupBy("chain_id").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("_rows"))
    seed = F.lit(None).cast("string")
    if tips is not None:
        grouped, seed = grouped.join(tips, "chain_id", "left"), F.col("seed")
    # The seed, then each row's hash over its text and the hash before.
    links = F.aggregate(F.transform("_rows", lambda row: row["_material"]), F.array(seed), lambda done, text: F.concat(
        done, F.array(F.sha2(F.concat(text, F.coalesce(F.element_at(done, -1), F.lit(""))), 256))))
    out = (grouped.withColumn("_links", links)
           .select("chain_id", "_links", F.posexplode("_rows").alias("_i", "_row")))
    return out.select(
        F.col("_row.log_position").alias("log_position"), "chain_id",
        *[F.col("_row." + f).alias(f) for f in ENVELOPE_FIELDS if f not in ("prev_event_hash", "event_hash")],
        F.element_at("_links", F.col("_i") + 1).alias("prev_event_hash"),
        F.element_at("_links", F.col("_i") + 2).alias("event_hash"),
        *[F.col("_row." + f).alias(f) for f in ("canonical_entity_id", "ciphertext", "redacted")])


def split(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored form: the event table and the payload table."""
    events = log.select("log_position", "chain_id", *ENVELOPE_FIELDS)
    payloads = log.select("event_id", "payload_hash", "canonical_entity_id", "ciphertext", "redacted")
    return events, payloads


def join_payloads(events: DataFrame, payloads: DataFrame) -> DataFrame:
    """Events with their payload row; absent payloads stay as NULLs."""
    right = payloads.select(
        F.col("event_id").alias("payload_event_id"), F.col("payload_hash").alias("payload_row_hash"),
        "canonical_entity_id", "ciphertext", "redacted")
    return events.join(right, F.col("event_id") == F.col("payload_event_id"), "left")


def inline(log: DataFrame) -> DataFrame:
    """The joined form of a log whose payload columns already sit in the row."""
    return log.withColumn("payload_event_id", F.col("event_id")).withColumn(
        "payload_row_hash", F.col("payload_hash"))


def after(log: DataFrame, position: int, limit: int | None = None) -> DataFrame:
    """Events after a position; positions are dense, so a limit is a range."""
    rows = log.where(F.col("log_position") > position)
    return rows if limit is None or limit < 0 else rows.where(F.col("log_position") <= position + limit)


def recorded_until(log: DataFrame, as_of: str | Column) -> DataFrame:
    """Inclusive recorded-time cutoff, compared as instants.

    Stored logs carry the instant as ``recorded_us``, which reaches the scan.
    """
    cutoff = F.lit(instants.literal_us(as_of)) if isinstance(as_of, str) else instants.instant_us(as_of)
    return log.where(_recorded_us(log) <= cutoff)


def _recorded_us(log: DataFrame) -> Column:
    return F.col("recorded_us") if "recorded_us" in log.columns else instants.instant_us(F.col("recorded_at"))


def events_since(log: DataFrame, since: str, limit: int | None = None) -> DataFrame:
    """Envelopes recorded from a time on, in log order; ``limit`` is the report's top N."""
    start = F.lit(instants.literal_us(since, "since"))
    rows = (log.where(_recorded_us(log) >= start)
            .select("log_position", *ENVELOPE_FIELDS).orderBy("log_position"))
    return rows if limit is None else rows.limit(limit)


def tip(log: DataFrame) -> DataFrame:
    """One row: the latest event (no rows for an empty log)."""
    packed = F.struct("log_position", "event_id", "event_hash", "recorded_at")
    return log.agg(F.max_by(packed, "log_position").alias("t")).where("t is not null").select("t.*")


def chain_tips(log: DataFrame) -> DataFrame:
    return log.groupBy("chain_id").agg(F.max_by("event_hash", "log_position").alias("tip_hash"))


def retained_pairs(log: DataFrame, event_ids: DataFrame) -> DataFrame:
    """Named events with the hash of the row before each, found by position."""
    named = log.join(event_ids.select("event_id"), "event_id", "left_semi")
    before = log.select((F.col("log_position") + 1).alias("log_position"), F.col("chain_id").alias("_c"),
                        F.col("event_hash").alias("_h"))
    joined = named.join(before, "log_position", "left")
    stored_prev = F.when(F.col("_c") == F.col("chain_id"), F.col("_h"))
    return (joined.withColumn("predecessor_ok", F.col("prev_event_hash").eqNullSafe(stored_prev))
            .drop("_c", "_h"))


def by_idempotency_key(log: DataFrame, keys: DataFrame) -> DataFrame:
    return log.join(keys.select("idempotency_key"), "idempotency_key", "left_semi")


def semantic_struct() -> Column:
    """What a retry must repeat: every field that does not depend on position."""
    return F.struct(*REQUEST_FIELDS, "canonical_entity_id", "ciphertext", "redacted")


def same_content(log: DataFrame) -> DataFrame:
    """Payload hashes stated by more than one event, with counts of independent sources."""
    return (log.groupBy("payload_hash")
            .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("source_class").alias("source_classes"),
                 F.min("log_position").alias("first_position"))
            .where("events > 1"))


def require_clean(violations: DataFrame, what: str, shown: int = 5) -> None:
    """Refuse when any violation exists; only a few examples reach the driver."""
    found = violations.limit(shown).collect()
    if found:
        raise LogError(f"{what}: " + "; ".join(f"{r['check']}@{r['location']}: {r['message']}" for r in found))
