"""Correction, replacement and expiry of claim candidates (projector 3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tenetlog.functions import canonical as C, instants
from tenetlog.operators import identity, integrity
from tenetlog.schema import CORRECTION, EXPIRY, REPLACEMENT, TRANSITIONS, LogError

TRANSITION_EVENTS = tuple(TRANSITIONS)


def relation_of(event_type: Column) -> Column:
    return F.when(event_type == CORRECTION, TRANSITIONS[CORRECTION][1]).when(
        event_type == REPLACEMENT, TRANSITIONS[REPLACEMENT][1]).when(event_type == EXPIRY, TRANSITIONS[EXPIRY][1])


def status_of(relation: Column) -> Column:
    status = None
    for name, rel in TRANSITIONS.values():
        status = F.when(relation == rel, name) if status is None else status.when(relation == rel, name)
    return status


def transitions(log: DataFrame) -> DataFrame:
    """Transition events with parsed belief, targets and basis."""
    parsed = F.from_json("ciphertext", "belief_id string, claim struct<belief_id:string,claim_candidate_id:string>, "
                                       "targets array<string>, basis struct<kind:string,statement:string>")
    return (log.where(F.col("event_type").isin(*TRANSITION_EVENTS)).withColumn("_t", parsed)
            .withColumn("belief_id", F.coalesce("_t.claim.belief_id", "_t.belief_id"))
            .withColumn("new_candidate_id", F.col("_t.claim.claim_candidate_id"))
            .withColumn("targets", F.col("_t.targets")).withColumn("basis_kind", F.col("_t.basis.kind"))
            .withColumn("statement", F.col("_t.basis.statement")).drop("_t"))


def target_rows(log: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per (transition, target); ``keep`` names further columns of the log to go along."""
    return transitions(log).select(
        "log_position", "event_id", "event_type", "occurred_at", "recorded_at", "belief_id", "new_candidate_id", *keep,
        F.explode("targets").alias("target_candidate_id"))


def relations(log: DataFrame) -> DataFrame:
    """First ending of each candidate: target, event, relation, position."""
    first = F.min_by(F.struct("event_id", "event_type", "log_position"), F.col("log_position")).alias("e")
    return target_rows(log).groupBy("target_candidate_id").agg(first).select(
        "target_candidate_id", F.col("e.event_id").alias("event_id"),
        relation_of(F.col("e.event_type")).alias("relation"), F.col("e.log_position").alias("log_position"))


def endings(log: DataFrame) -> DataFrame:
    """Ended candidates: the event, relation and position of the ending, and the status it gives."""
    return relations(log).select(
        F.col("target_candidate_id").alias("claim_candidate_id"), F.col("event_id").alias("ending_event_id"),
        F.col("relation").alias("ending_relation"), F.col("log_position").alias("ending_position")).withColumn(
        "live_status", status_of(F.col("ending_relation")))


def candidates_with_endings(log: DataFrame) -> DataFrame:
    """Candidates with live_status and the event that ended them, if any."""
    joined = identity.candidates(log, "3").join(endings(log).drop("live_status"), "claim_candidate_id", "left")
    return (joined.withColumn("live_status", F.coalesce(status_of(F.col("ending_relation")), F.lit("live")))
            .withColumn("superseding_events", F.when(F.col("ending_event_id").isNull(), F.array().cast("array<string>"))
                        .otherwise(F.array("ending_event_id"))))


def candidate_sets(cands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live candidates, and retained ones with their ending."""
    return cands.where(F.col("ending_relation").isNull()), cands.where(F.col("ending_relation").isNotNull())


def set_sizes(cands: DataFrame) -> DataFrame:
    return cands.groupBy("belief_id").agg(
        F.count_if(F.col("live_status") == "live").alias("live"),
        F.count_if(F.col("live_status") != "live").alias("retained"))


def ending_violations(cands: DataFrame, stored_relations: DataFrame) -> DataFrame:
    """Stored candidates against stored relations: live means no ending, and the
    status and superseding event must be those of the relation."""
    ends = stored_relations.select(F.col("target_candidate_id").alias("claim_candidate_id"),
                                   F.col("event_id").alias("_event"), F.col("relation").alias("_relation"))
    joined = cands.select("claim_candidate_id", "live_status", "superseding_events").join(ends, "claim_candidate_id", "left")
    c = F.col
    bad_live = c("_relation").isNull() & ((c("live_status") != "live") | (F.size("superseding_events") > 0))
    bad_end = c("_relation").isNotNull() & (
        ~c("live_status").eqNullSafe(status_of(c("_relation"))) | ~(c("superseding_events") == F.array("_event")))
    return integrity.unpack(joined, integrity.pack([
        ("ending", bad_live, "candidate ending relation is missing"),
        ("ending", bad_end, "candidate differs from ending relation")]), c("claim_candidate_id"))


def transition_checks() -> list[tuple[str, Column, str]]:
    """Shape of a transition payload, from ``transitions`` columns."""
    c = F.col
    keys = F.when(c("event_type") == EXPIRY, F.array(*map(F.lit, ("basis", "belief_id", "targets")))).otherwise(
        F.array(*map(F.lit, ("basis", "claim", "targets"))))
    own = F.array_sort(F.array_distinct(F.json_object_keys("ciphertext")))
    basis = F.array_sort(F.array_distinct(F.json_object_keys(F.get_json_object("ciphertext", "$.basis"))))
    kind = F.when(c("event_type") == CORRECTION, "stated_error").otherwise("stated")
    canonical_order = F.array_sort(F.transform(F.array_distinct("targets"), C.json_string))
    texts_only = F.get_json_object("ciphertext", "$.targets").rlike(
        r"^\[{t}(?:,{t})*+\]$".replace("{t}", identity.NONEMPTY_TEXT))
    claim = F.get_json_object("ciphertext", "$.claim")
    return [
        ("fields", ~F.coalesce(own == keys, F.lit(False)), "transition requires its exact fields"),
        ("claim", (c("event_type") != EXPIRY) & ~F.coalesce(claim.rlike(identity.CLAIM_SHAPE), F.lit(False)),
         "transition claim requires exactly seven fields"),
        ("belief_id", F.coalesce(c("belief_id") == "", F.lit(True)), "belief_id must be a nonempty string"),
        ("basis", ~F.coalesce(basis == F.array(F.lit("kind"), F.lit("statement")), F.lit(False)),
         "basis requires kind and statement"),
        ("basis", ~c("basis_kind").eqNullSafe(kind), "transition requires its stated basis kind"),
        ("basis", F.coalesce(c("statement") == "", F.lit(True)), "statement must be a nonempty string"),
        ("targets", ~F.coalesce(texts_only, F.lit(False))
         | ~F.coalesce(F.transform("targets", C.json_string) == canonical_order, F.lit(False)),
         "targets require nonempty distinct canonically sorted IDs"),
    ]


def target_verdicts(log: DataFrame, cands: DataFrame | None = None) -> DataFrame:
    """Eligibility of each target, judged at the transition's position.

    Joins run on the target candidate; a candidate is a unique row there.
    ``alive`` (if present) restricts the earlier endings that count.
    """
    cands = identity.candidates(log, "3") if cands is None else cands
    t = target_rows(log)
    if "alive" in log.columns:
        t = t.join(log.select("log_position", "alive"), "log_position")
    else:
        t = t.withColumn("alive", F.lit(True))
    first_end = t.where("alive").groupBy("target_candidate_id").agg(F.min("log_position").alias("first_end"))
    about = cands.select(
        F.col("claim_candidate_id").alias("target_candidate_id"), F.col("belief_id").alias("c_belief"),
        F.col("log_position").alias("c_position"), F.col("occurred_at").alias("c_occurred_at"),
        F.col("source").alias("c_source"), F.col("basis_kind").alias("c_basis"),
        (F.size("predecessors") + F.size("restrictions") + F.size("opposing_events")).alias("c_restricting"))
    joined = t.join(about, "target_candidate_id", "left").join(first_end, "target_candidate_id", "left")
    c = F.col
    known = c("c_position").isNotNull() & (c("c_position") < c("log_position"))
    return joined.withColumn("problems", integrity.pack([
        *target_checks(known, F.coalesce(c("first_end") < c("log_position"), F.lit(False)), c("c_belief"), is_report(c("c_source")),
                       instants.instant_us(c("c_occurred_at")), instants.instant_us(c("occurred_at"))),
        ("dependency", known & ((c("c_basis") != "direct_observation") | (c("c_restricting") > 0)),
         "transition dependency is undecided"),
    ]))


def is_report(source: Column) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(F.get_json_object(source, "$.config")), "report_vocabulary"), F.lit(False))


def target_checks(known: Column, ended: Column, belief: Column, report: Column, target_us: Column, own_us: Column) -> list[tuple[str, Column, str]]:
    """Checks of a (transition, target) row against the target: its belief, whether it is report-scoped, and its instant."""
    c = F.col
    backdated = (c("event_type") == CORRECTION) & (own_us < target_us)
    return [
        ("target", ~known, "unknown target candidate"),
        ("live", known & ended, "target candidate is no longer live"),
        ("scope", known & (belief != c("belief_id")), "targets must share the exact belief scope"),
        ("report", known & report, "report-scoped transitions refuse"),
        ("backdated", known & F.coalesce(backdated, F.lit(False)), "correction occurred_at precedes target recording event"),
    ]


def reverse_dependencies(cands: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets that any candidate names as predecessor or restriction."""
    named = cands.select(F.explode(F.array_union("predecessors", "restrictions")).alias("target_candidate_id"))
    return targets.join(named, "target_candidate_id", "left_semi")


def candidate_details(cands: DataFrame, names: DataFrame) -> DataFrame:
    return cands.join(names.select("claim_candidate_id"), "claim_candidate_id", "left_semi")


def require_transition_projector(version: str) -> None:
    if version != "3":
        raise ValueError("ending relations require explicit projector 3")


def without_transitions(log: DataFrame) -> DataFrame:
    """Refuse to read a log with transitions under projectors 1 and 2."""
    found = log.where(F.col("event_type").isin(*TRANSITION_EVENTS)).select("event_id").limit(1).collect()
    if found:
        raise LogError(f"projector does not support the transition {found[0][0]!r}")
    return log
