"""Named reads, relations between views, and replay over explicit cutoffs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, functions as F

from tenetlog.operators import identity, integrity, transitions, values
from tenetlog.schema import MENTION, OBSERVATION, TRANSITIONS, LogError, UnsupportedError, require_projector
from tenetlog.sources.log import inline, recorded_until, require_clean

SUPPORTED = {
    "0": values.VALUE_EVENTS,
    "1": (MENTION, OBSERVATION),
    "2": (MENTION, OBSERVATION),
    "3": (MENTION, OBSERVATION, *TRANSITIONS),
}


def _checked(log: DataFrame, as_of: str, version: str, verify: bool) -> DataFrame:
    """Visible part of a log, after the checks a replay must make over all of it."""
    require_projector(version)
    visible = recorded_until(log, as_of)
    if verify:
        require_clean(integrity.log_violations(inline(log)), "log")
        require_clean(integrity.unsupported_events(visible, SUPPORTED[version], version), "replay")
        bad = values.replay_refusals(visible) if version == "0" else identity.event_violations(visible, version)
        require_clean(bad, "replay")
    return visible


def project(log: DataFrame, as_of: str, version: str, *, verify: bool = True) -> DataFrame:
    """All beliefs at a cutoff under an explicit projector version."""
    visible = _checked(log, as_of, version, verify)
    if version == "0":
        return values.fold(visible, as_of).drop("undecided")
    return identity.beliefs(visible, as_of, version)


def snapshot(log: DataFrame, as_of: str, version: str, *, verify: bool = True) -> dict[str, DataFrame]:
    """Record tables by kind, mention-only subjects included."""
    require_projector(version, ("1", "2", "3"))
    visible = _checked(log, as_of, version, verify)
    cands = transitions.candidates_with_endings(visible) if version == "3" else identity.candidates(visible, version)
    return {"beliefs": identity.beliefs(visible, as_of, version), "entities": identity.entity_table(visible),
            "mentions": identity.mention_table(visible), "entity_links": identity.link_table(visible),
            "claim_candidates": cands, "events": visible}


def apply_delta(prior: DataFrame, delta: DataFrame, key: str, position: str = "log_position") -> DataFrame:
    """Next prefix of a record table: the latest row per key wins."""
    names = [c for c in prior.columns if c != key]
    both = prior.unionByName(delta.select(*prior.columns))
    return both.groupBy(key).agg(F.max_by(F.struct(*names), position).alias("v")).select(key, "v.*")


def of_subject(beliefs: DataFrame, subject_id: str, property_id: str | None = None) -> DataFrame:
    rows = beliefs.where(F.col("subject_id") == subject_id)
    return rows if property_id is None else rows.where(F.col("property_id") == property_id)


def current_belief(beliefs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Current belief of each (subject_id, property_id); two for one pair are refused."""
    found = beliefs.where(F.col("lifecycle_status") == "current").join(
        pairs.select("subject_id", "property_id").distinct(), ["subject_id", "property_id"], "left_semi")
    require_clean(identity.container_conflicts(found), "snapshot")
    return found


def candidate_values(cands: DataFrame, names: DataFrame) -> DataFrame:
    return cands.join(names.select("claim_candidate_id").distinct(), "claim_candidate_id", "right").select(
        "claim_candidate_id", "value_json")


def scalar_value(beliefs: DataFrame, belief_id: str):
    """A container has no single value: always refused, with the reason."""
    row = beliefs.where(F.col("belief_id") == belief_id).select("candidate_count").first()
    if row is None:
        raise KeyError(belief_id)
    if row[0] > 1:
        raise LogError("scalar belief request refuses multiple candidates")
    raise UnsupportedError("use a named claim candidate; the scalar read of a belief is not decided")


class StaleViewWarning(UserWarning):
    pass


def warn_if_stale(status: DataFrame) -> DataFrame:
    """Raw identity read: the records, with a warning when any of them may be behind."""
    if status.where(F.coalesce(F.col("stale"), F.lit(False))).limit(1).count():
        warnings.warn(StaleViewWarning("view is stale; absence is not authoritative"), stacklevel=2)
    return status


def events_of(log: DataFrame, as_of: str) -> DataFrame:
    return recorded_until(log, as_of).orderBy("log_position")


# --- comparison of views ---

def differences(expected: DataFrame, stored: DataFrame, key: str, check: str = "coverage",
                ignore: tuple[str, ...] = ("projected_as_of",)) -> DataFrame:
    """Violations where two views differ, by key; evaluation time is not content."""
    names = [c for c in expected.columns if c != key and c not in ignore]

    def packed(df, out):
        return df.select(key, F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256).alias(out))

    joined = packed(expected, "_e").join(packed(stored, "_s"), key, "full")
    return joined.where(~F.col("_e").eqNullSafe(F.col("_s"))).select(
        F.lit(check).alias("check"), F.col(key).cast("string").alias("location"),
        F.when(F.col("_s").isNull(), "missing from stored view").when(F.col("_e").isNull(), "not derivable from log")
        .otherwise("stored content differs from log").alias("message"))


def row_set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with different multiplicity, both ways."""
    columns = a.columns
    return (a.exceptAll(b.select(*columns)).withColumn("side", F.lit("left"))
            .unionByName(b.select(*columns).exceptAll(a).withColumn("side", F.lit("right"))))


def not_equivalent(log: DataFrame) -> DataFrame:
    """Candidates on which projectors 2 and 3 disagree over a transition-free log,
    lineage and the status ``live`` aside."""
    two = identity.candidates(log, "2")
    three = transitions.candidates_with_endings(log)
    dead = three.where("live_status <> 'live'").select(
        F.lit("equivalence").alias("check"), F.col("claim_candidate_id").alias("location"),
        F.lit("transition-free candidate must be live").alias("message"))
    return differences(two, three.select(*two.columns), "claim_candidate_id", "equivalence").unionByName(dead)
