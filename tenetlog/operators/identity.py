"""Entities, mentions, links and claim candidates as tables derived from a log.

No winner is selected: a belief is a container, its candidates are rows. Nested
forms are built only where a commitment or a named read needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.functions import canonical as C, instants
from tenetlog.operators import integrity
from tenetlog.schema import (CORRECTION, ENVELOPE_FIELDS, EXPIRY, MENTION, OBSERVATION, REPLACEMENT, VERIFIABILITY)

# JSON string; possessive, so long texts match without recursion.
_TEXT = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
NONEMPTY_TEXT = r'"(?!")[^"\\]*+(?:\\.[^"\\]*+)*+"'
# A claim in canonical form: exactly seven members, all but the value texts.
CLAIM_SHAPE = (r'^\{"belief_id":' + _TEXT + r',"claim_candidate_id":' + _TEXT + r',"mention_id":' + _TEXT
               + r',"property_id":' + _TEXT + r',"subject_id":' + _TEXT + r',"value":([\s\S]*),"verifiability":'
               + _TEXT + r"\}$")
MENTION_SHAPE = (r'^\{"link_state":' + _TEXT + r',"mention_id":' + _TEXT + r',"subject_id":' + _TEXT
                 + r',"text":' + _TEXT + r"\}$")
CLAIM_FIELDS = ("belief_id", "claim_candidate_id", "mention_id", "property_id", "subject_id", "verifiability")
_CLAIM_TYPE = ", ".join(f"{f} string" for f in CLAIM_FIELDS)
# The JSON reader refuses texts of more than 20,000,000 characters unless it is told otherwise.
WHOLE_TEXTS = {"maxStringLen": str(2**31 - 1)}
CLAIM_EVENTS = (OBSERVATION, CORRECTION, REPLACEMENT)


def mentions(log: DataFrame) -> DataFrame:
    """Mention events with their parsed payload; one row gives entity, mention and link."""
    parsed = F.from_json("ciphertext", "mention_id string, subject_id string, text string, link_state string", WHOLE_TEXTS)
    return (log.where(F.col("event_type") == MENTION).withColumn("_m", parsed)
            .select("*", "_m.mention_id", "_m.subject_id", "_m.text", "_m.link_state").drop("_m"))


def entity_table(log: DataFrame) -> DataFrame:
    return mentions(log).select(
        "subject_id", F.lit("current").alias("lifecycle_status"),
        F.col("mention_id").alias("constituting_mention_id"), "event_id",
        F.array().cast("array<string>").alias("predecessors"), "log_position")


def mention_table(log: DataFrame) -> DataFrame:
    return mentions(log).select("mention_id", "text", "subject_id", "event_id", "log_position")


def link_table(log: DataFrame) -> DataFrame:
    return mentions(log).select(
        "mention_id", "subject_id", F.lit("constitutive").alias("link_state"),
        F.lit(None).cast("double").alias("entity_link_confidence"), "event_id", "log_position")


def may_claim() -> Column:
    """False where a payload states no claim for sure: without the word there is no such member, unless an escape spells it."""
    return F.contains("ciphertext", F.lit("claim")) | F.contains("ciphertext", F.lit("\\"))


def claims(log: DataFrame, projector: str = "1", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per claim, with the envelope columns of its event.

    ``ordinal`` is the claim's place in its event; ``value_json`` its exact value;
    ``keep`` names further columns of the log to go along.
    """
    events = CLAIM_EVENTS if projector == "3" else (OBSERVATION,)
    raw = F.when(F.col("event_type") == OBSERVATION,
                 F.from_json("ciphertext", "claims array<string>")["claims"]).otherwise(
        F.array(F.get_json_object("ciphertext", "$.claim")))
    kept = ["log_position", "chain_id", "event_id", "event_type", "occurred_at", "recorded_at", "source",
            "source_class", "origin_type", "entity_refs", "event_hash", "alive", *keep]
    rows = (log.where(F.col("event_type").isin(*events))
            .select(*[c for c in kept if c in log.columns], F.posexplode_outer(raw).alias("ordinal", "claim_json")))
    parsed = rows.withColumn("_c", F.from_json("claim_json", _CLAIM_TYPE))
    return (parsed.select("*", *[F.col(f"_c.{f}").alias(f) for f in CLAIM_FIELDS],
                          F.regexp_extract("claim_json", CLAIM_SHAPE, 1).alias("value_json"))
            .drop("_c"))


def resolved_claims(log: DataFrame, projector: str = "1") -> DataFrame:
    """Claims joined with the mention they name (unique per mention_id).

    A mention that many claims name is a skewed key of the large side only;
    adaptive skew splitting copies the one mention row, not the claims.
    """
    known = mentions(log).select(
        F.col("mention_id").alias("_m"), F.col("subject_id").alias("link_subject_id"),
        F.col("text").alias("mention_text"), F.col("event_id").alias("link_event_id"),
        F.col("log_position").alias("link_position"))
    c = claims(log, projector)
    return c.join(known, c.mention_id == known["_m"], "left").drop("_m")


def candidates(log: DataFrame, projector: str = "1") -> DataFrame:
    """Claim candidates with support, basis and provenance path."""
    r = resolved_claims(log, projector)
    path = F.array(F.array(
        F.struct(F.col("link_event_id").alias("event_id"), "mention_id", "subject_id",
                 F.lit(None).cast("string").alias("belief_id"), F.lit(None).cast("string").alias("claim_candidate_id")),
        F.struct("event_id", F.lit(None).cast("string").alias("mention_id"),
                 F.lit(None).cast("string").alias("subject_id"), "belief_id", "claim_candidate_id")))
    empty = F.array().cast("array<string>")
    return r.select(
        "claim_candidate_id", "belief_id", "mention_id", "subject_id", "property_id", "value_json", "verifiability",
        F.when(F.col("origin_type") == "observed", "verified").alias("verification_state"),
        F.lit("direct_observation").alias("basis_kind"), F.array("event_id").alias("basis_event_ids"),
        F.array("event_id").alias("supporting_events"), empty.alias("opposing_events"),
        empty.alias("superseding_events"), empty.alias("restrictions"), empty.alias("predecessors"),
        "occurred_at", "recorded_at", "source", "source_class", "origin_type", path.alias("provenance_paths"),
        "event_id", "event_hash", "link_event_id", "link_position", "mention_text", "log_position", "ordinal")


def beliefs(log: DataFrame, as_of: str, projector: str = "1") -> DataFrame:
    """Container headers: one row per belief with counts of its collections.

    A belief's subject and property are part of the grouping key, so filters on them
    reach the scan; the ceiling of one container per belief is checked at admission.
    An expiry changes the header's time and nothing else.
    """
    c = candidates(log, projector)
    counted = c.groupBy("belief_id", "subject_id", "property_id").agg(
        F.lit("current").alias("lifecycle_status"), F.lit("no_authoritative_head").alias("resolution_status"),
        F.count(F.lit(1)).alias("candidate_count"), F.countDistinct("event_id").alias("evidence_count"),
        F.countDistinct("mention_id").alias("identity_count"),
        F.max(F.struct("log_position", "recorded_at")).alias("_last"))
    if projector == "3":
        ended = expiries(log).groupBy("belief_id").agg(F.max(F.struct("log_position", "recorded_at")).alias("_ended"))
        counted = counted.join(ended, "belief_id", "left").withColumn("_last", F.greatest("_last", "_ended")).drop("_ended")
    return (counted.withColumn("updated_at", F.col("_last.recorded_at")).drop("_last")
            .withColumn("projected_as_of", F.lit(as_of)))


def expiries(log: DataFrame) -> DataFrame:
    """Expiry events with the belief they name."""
    return (log.where(F.col("event_type") == EXPIRY)
            .withColumn("belief_id", F.get_json_object("ciphertext", "$.belief_id")))


def dependencies(log: DataFrame, projector: str = "1") -> DataFrame:
    """(belief_id, event_id): a belief depends on its claims' events, on the mention
    events behind them, and on the expiries that name it."""
    r = resolved_claims(log, projector)
    found = r.select("belief_id", F.explode(F.array("event_id", "link_event_id")).alias("event_id"))
    if projector == "3":
        found = found.unionByName(expiries(log).select("belief_id", "event_id"))
    return found.distinct()


def evidence(cands: DataFrame) -> DataFrame:
    """Distinct supporting events per belief."""
    return (cands.select("belief_id", F.explode("supporting_events").alias("event_id")).distinct()
            .groupBy("belief_id").agg(F.count(F.lit(1)).alias("evidence_count")))


def merge_candidates(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of one candidate ID become one: only provenance paths may differ.

    ``records``: claim_candidate_id, content (canonical text without the paths)
    and path (canonical text). Returns merged rows and violations.
    """
    grouped = records.groupBy("claim_candidate_id").agg(
        F.min("content").alias("content"), F.max("content").alias("_other"),
        F.array_sort(F.collect_set("path")).alias("provenance_paths"))
    bad = grouped.where(F.col("content") != F.col("_other")).select(
        F.lit("candidate").alias("check"), F.col("claim_candidate_id").alias("location"),
        F.lit("inconsistent records for one candidate identity").alias("message"))
    return grouped.where(F.col("content") == F.col("_other")).drop("_other"), bad


def identity_ceiling(links: DataFrame) -> DataFrame:
    """Constitutive links carry no confidence, so the ceiling is NULL; others are reported."""
    checks = [
        ("link_state", ~F.col("link_state").eqNullSafe("constitutive"),
         "non-constitutive confidence treatment is not decided"),
        ("entity_link_confidence", F.col("entity_link_confidence").isNotNull(),
         "constitutive links have no epistemic confidence"),
    ]
    return integrity.unpack(links, integrity.pack(checks), F.col("mention_id"))


def container_conflicts(headers: DataFrame) -> DataFrame:
    """More than one current belief for a (subject, property) pair."""
    return (headers.where(F.col("lifecycle_status") == "current").groupBy("subject_id", "property_id")
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            .select(F.lit("container").alias("check"), C.pair_key(F.col("subject_id"), F.col("property_id")).alias("location"),
                    F.lit("duplicate current belief").alias("message")))


def current_beliefs(log: DataFrame, projector: str = "1") -> DataFrame:
    """(subject_id, property_id) -> belief_id, first writer."""
    return (claims(log, projector).groupBy("subject_id", "property_id")
            .agg(F.min_by("belief_id", F.struct("log_position", "ordinal")).alias("belief_id")))


def mention_checks() -> list[tuple[str, Column, str]]:
    link = F.get_json_object("ciphertext", "$.link_state")
    c = F.col
    return [
        ("fields", ~F.coalesce(c("ciphertext").rlike(MENTION_SHAPE), F.lit(False)),
         "mention requires exactly four text fields"),
        *[(n, F.coalesce(c(n) == "", F.lit(True)), f"{n} must be a nonempty string")
          for n in ("mention_id", "subject_id", "text")],
        ("link_state", ~link.eqNullSafe("constitutive"), "bootstrap requires explicit constitutive link_state"),
        ("entity_refs", c("entity_refs").isNotNull()
         & ~(F.array_distinct(F.from_json("entity_refs", "array<string>")) == F.array("subject_id")),
         "entity_refs do not match recorded subject associations"),
    ]


def claim_checks() -> list[tuple[str, Column, str]]:
    """Checks of one claim row that need nothing but the row."""
    c = F.col
    return [
        ("claims", c("claim_json").isNull(), "observation requires nonempty explicitly scoped claims"),
        ("fields", c("claim_json").isNotNull() & ~c("claim_json").rlike(CLAIM_SHAPE),
         "claim requires exactly seven fields in canonical form"),
        *[(n, c("claim_json").isNotNull() & F.coalesce(c(n) == "", F.lit(True)), f"{n} must be a nonempty string")
          for n in ("belief_id", "claim_candidate_id", "mention_id", "property_id", "subject_id")],
        ("verifiability", c("claim_json").isNotNull() & ~F.coalesce(c("verifiability").isin(*VERIFIABILITY), F.lit(False)),
         "unknown verifiability"),
        ("origin", ~c("origin_type").eqNullSafe("observed"), "origin has no decided verification state"),
    ]


# --- canonical JSON of records (used by commitments and dependencies) ---

def entity_json(at: str = "") -> Column:
    """From mention-event columns; ``at`` is the path of the struct that holds them."""
    return C.json_object(constituting_mention_id=C.json_string(F.col(at + "mention_id")),
                         event_id=C.json_string(F.col(at + "event_id")), lifecycle_status='"current"', predecessors="[]",
                         subject_id=C.json_string(F.col(at + "subject_id")))


def mention_json(at: str = "") -> Column:
    return C.json_object(event_id=C.json_string(F.col(at + "event_id")), mention_id=C.json_string(F.col(at + "mention_id")),
                         subject_id=C.json_string(F.col(at + "subject_id")), text=C.json_string(F.col(at + "text")))


def link_json(at: str = "") -> Column:
    return C.json_object(entity_link_confidence="null", event_id=C.json_string(F.col(at + "event_id")),
                         link_state='"constitutive"', mention_id=C.json_string(F.col(at + "mention_id")),
                         subject_id=C.json_string(F.col(at + "subject_id")))


def identity_record_json(at: str = "") -> Column:
    return C.json_object(entity=entity_json(at), link=link_json(at), mention=mention_json(at))


def dependency_json(at: str = "") -> Column:
    """Full copy of an event, from log columns."""
    envelope = C.json_object(**{f: C.json_string(F.col(at + f)) for f in ENVELOPE_FIELDS})
    return C.json_object(envelope=envelope, event_hash=C.json_string(F.col(at + "event_hash")),
                         event_id=C.json_string(F.col(at + "event_id")), payload=F.col(at + "ciphertext"))


def candidate_json(live_status: Column | None = None, ended_by: Column | None = None) -> Column:
    """Canonical candidate from ``candidates`` columns; projector 3 adds its status."""
    s = {f: C.json_string(F.col(f)) for f in (
        "belief_id", "claim_candidate_id", "mention_id", "property_id", "subject_id", "verifiability",
        "verification_state", "occurred_at", "recorded_at", "source_class", "origin_type")}
    own = C.json_array(C.json_string(F.col("event_id")))
    path = C.json_array(C.json_array(
        C.json_object(event_id=C.json_string(F.col("link_event_id")), mention_id=s["mention_id"], subject_id=s["subject_id"]),
        C.json_object(belief_id=s["belief_id"], claim_candidate_id=s["claim_candidate_id"],
                      event_id=C.json_string(F.col("event_id")))))
    ended = "[]" if ended_by is None else F.when(ended_by.isNull(), F.lit("[]")).otherwise(
        C.json_array(C.json_string(ended_by)))
    members = dict(s, value=F.col("value_json"), source=F.col("source"), supporting_events=own, opposing_events="[]",
                   superseding_events=ended, restrictions="[]", predecessors="[]", provenance_paths=path,
                   verification_basis=C.json_object(event_ids=own, kind='"direct_observation"'))
    if live_status is not None:
        members["live_status"] = C.json_string(live_status)
    return C.json_object(**members)


def event_violations(log: DataFrame, projector: str = "1") -> DataFrame:
    """Violations of stored identity events that need joins: association,
    freshness of IDs, container binding and entity references."""
    from tenetlog.operators.admission import identity_problems
    found = identity_problems(log.withColumn("alive", F.lit(True)), projector)
    return integrity.unpack(found.join(log.select("log_position", "event_id"), "log_position"), F.col("problems"), F.col("event_id"))


REFS_DIFFER = "entity_refs do not match recorded subject associations"


def refs_differ(log: DataFrame, projector: str = "1", keep: tuple[str, ...] = ()) -> DataFrame:
    """(log_position, event_id, keep) of observation events whose entity_refs differ from the subjects they touch."""
    touched = claims(log, projector, keep).groupBy("log_position", "event_id", "entity_refs", *keep).agg(
        F.array_sort(F.collect_set("subject_id")).alias("subjects"))
    refs = F.array_sort(F.array_distinct(F.from_json("entity_refs", "array<string>")))
    return touched.where(F.col("entity_refs").isNotNull() & ~(refs == F.col("subjects"))).select("log_position", "event_id", *keep)


def refs_match(log: DataFrame, projector: str = "1") -> DataFrame:
    """Violations of ``refs_differ``."""
    return refs_differ(log, projector).select(
        F.lit("entity_refs").alias("check"), F.col("event_id").alias("location"), F.lit(REFS_DIFFER).alias("message"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def timed(df: DataFrame) -> DataFrame:
    return df.withColumn("occurred_us", instants.instant_us(F.col("occurred_at")))
