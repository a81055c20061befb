"""Values per belief: the head is the event with the greatest source instant,
ties going to the later log position; every event counts as support.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenetlog.functions import instants
from tenetlog.operators import integrity
from tenetlog.operators.chains import hash_chain
from tenetlog.operators.segments import (SEGMENT_ROWS, neighbour, ordinals, running_max, segment_of)
from tenetlog.schema import CORRECTION, OBSERVATION, RESOLUTION_BASIS
from tenetlog.session import cut_lineage
from tenetlog.sources.log import recorded_until, require_clean

VALUE_EVENTS = (OBSERVATION, CORRECTION)


def value_events(log: DataFrame) -> DataFrame:
    """Parsed value events: payload members and the source instant."""
    parsed = F.from_json("ciphertext", "belief_id string, value string, verifiability string")
    return (log.where(F.col("event_type").isin(*VALUE_EVENTS))
            .withColumn("_p", parsed)
            .withColumn("belief_id", F.col("_p.belief_id")).withColumn("value", F.col("_p.value"))
            .withColumn("verifiability", F.col("_p.verifiability"))
            .withColumn("occurred_us", instants.instant_us(F.col("occurred_at"))).drop("_p"))


def _basis() -> Column:
    return F.when(F.col("head.event_type") == CORRECTION, RESOLUTION_BASIS[CORRECTION]).otherwise(
        RESOLUTION_BASIS[OBSERVATION])


def fold(log: DataFrame, as_of: str) -> DataFrame:
    """One row per belief at a recorded-time cutoff, in a single aggregation.

    Support is counted here; its members are rows of ``support``, because a hot
    belief's members do not fit one row. A head of another origin than
    ``observed`` has no decided state: such rows carry ``undecided``.
    """
    events = value_events(recorded_until(log, as_of))
    order = F.struct("occurred_us", "log_position")
    head = F.struct("value", "occurred_at", "origin_type", "verifiability", "event_type", "event_id")
    grouped = events.groupBy("belief_id").agg(
        F.max_by(head, order).alias("head"), F.count(F.lit(1)).alias("support_count"),
        F.count_if(F.col("event_type") == CORRECTION).alias("superseding_count"),
        F.max_by("recorded_at", "log_position").alias("updated_at"))
    return grouped.select(
        "belief_id", F.col("head.value").alias("current_value"), F.col("head.occurred_at").alias("value_occurred_at"),
        F.when(F.col("head.origin_type") == "observed", "verified").alias("verification_state"),
        F.col("head.verifiability").alias("verifiability"), F.col("head.origin_type").alias("display_origin"),
        F.col("head.event_id").alias("head_event_id"), "support_count", "superseding_count",
        _basis().alias("resolution_basis"), F.lit(as_of).alias("projected_as_of"), "updated_at",
        (F.col("head.origin_type") != "observed").alias("undecided"))


def replay(log: DataFrame, as_of: str) -> DataFrame:
    """``fold`` after checking the whole log; refuses what a replay must refuse."""
    require_clean(integrity.log_violations(log), "log")
    visible = recorded_until(log, as_of)
    require_clean(integrity.unsupported_events(visible, VALUE_EVENTS, "0"), "replay")
    require_clean(replay_refusals(visible), "replay")
    return fold(log, as_of).drop("undecided")


def replay_refusals(log: DataFrame) -> DataFrame:
    """Backdated corrections, and events that set a value from an undecided origin.

    A late event of another origin never sets the value, so it is only support.
    """
    events = value_events(log)
    prior = running_max(events, ["belief_id"], F.col("occurred_us"), "prior_us")
    late = F.col("occurred_us") < F.col("prior_us")
    checks = [
        ("backdated", F.coalesce(late & (F.col("event_type") == CORRECTION), F.lit(False)),
         "correction occurred_at predates the value it corrects"),
        ("origin", ~F.coalesce(late, F.lit(False)) & (F.col("origin_type") != "observed"),
         "origin has no decided verification state"),
    ]
    return integrity.unpack(prior, integrity.pack(checks), F.col("event_id"))


def support(log: DataFrame, as_of: str) -> DataFrame:
    """Support members in log order, one row each."""
    events = value_events(recorded_until(log, as_of)).select("belief_id", "log_position", "event_id", "event_type")
    ranked = ordinals(events, ["belief_id"], "ordinal")
    return ranked.select("belief_id", "ordinal", "log_position", "event_id",
                         (F.col("event_type") == CORRECTION).alias("superseding"))


def support_segments(log: DataFrame, as_of: str, size: int = SEGMENT_ROWS) -> DataFrame:
    """Support and superseding arrays per (belief, position segment).

    Arrays of a belief in segment order are its whole set; each holds at most
    ``size`` members.
    """
    events = value_events(recorded_until(log, as_of))
    member = F.struct("log_position", "event_id", (F.col("event_type") == CORRECTION).alias("c"))
    grouped = (events.groupBy("belief_id", segment_of(F.col("log_position"), size).cast("long").alias("segment"))
               .agg(F.array_sort(F.collect_list(member)).alias("m")))
    return grouped.select(
        "belief_id", "segment", F.transform("m", lambda x: x["event_id"]).alias("supporting_events"),
        F.transform(F.filter("m", lambda x: x["c"]), lambda x: x["event_id"]).alias("superseding_events"))


def lineage(log: DataFrame, as_of: str, *, seeds: DataFrame | None = None, **options) -> DataFrame:
    """Hash lineage per belief: each event's hash folded in log order."""
    events = value_events(recorded_until(log, as_of)).select("belief_id", "log_position", "event_hash")
    chained = hash_chain(events, ["belief_id"], first=F.col("event_hash"), before=F.lit(""),
                         after=F.col("event_hash"), final_only=True, seeds=seeds, **options)
    return chained.withColumnRenamed("chain_hash", "view_version_hash")


def named_beliefs(log: DataFrame, as_of: str, names: DataFrame) -> DataFrame:
    """Full rows of named beliefs, one per position segment that holds support.

    In segment order the arrays of a belief's rows are its whole sets; a belief of few
    events has one row, and no row holds more than a segment's members.
    """
    parsed = value_events(log).join(names.select("belief_id"), "belief_id", "left_semi")
    mine = log.join(parsed.select("log_position"), "log_position", "left_semi")
    heads = fold(mine, as_of).drop("undecided")
    joined = heads.join(support_segments(mine, as_of), "belief_id").join(lineage(mine, as_of), "belief_id")
    return joined.select(
        "belief_id", "segment", "current_value", "value_occurred_at", "verification_state", "verifiability", "display_origin",
        "supporting_events", F.array().cast("array<string>").alias("opposing_events"), "superseding_events",
        "resolution_basis", "view_version_hash", "projected_as_of", "updated_at")


def prior_instants(log: DataFrame) -> DataFrame:
    """Value events with the greatest earlier source instant of their belief."""
    return running_max(value_events(log), ["belief_id"], F.col("occurred_us"), "prior_us")


def backdated_corrections(log: DataFrame) -> DataFrame:
    return prior_instants(log).where((F.col("event_type") == CORRECTION) & (F.col("occurred_us") < F.col("prior_us")))


def history(log: DataFrame) -> DataFrame:
    """Head of each belief after each of its events, with its validity interval.

    ``valid_to_us`` is the recorded instant of the belief's next event (NULL:
    still valid). Equal bounds mean the row was never visible to a cutoff.
    """
    events = (value_events(log).withColumn("recorded_us", instants.instant_us(F.col("recorded_at")))
              .select("belief_id", "log_position", "event_id", "value", "occurred_us", "recorded_us"))
    order = F.struct("occurred_us", "log_position", "value", "event_id")
    followed = neighbour(events, ["belief_id"], {"valid_to_us": "recorded_us"}, forward=True)
    bounded = running_max(followed, ["belief_id"], order, "head", inclusive=True, base=events)
    return bounded.select("belief_id", "log_position", F.col("head.value").alias("current_value"),
                          F.col("head.event_id").alias("head_event_id"),
                          F.col("recorded_us").alias("valid_from_us"), "valid_to_us")


def positions_at(log: DataFrame, times: DataFrame) -> DataFrame:
    """Log position in force at each instant of ``times`` (as_of_us).

    Events collapse to one row per recorded instant, then meet the requested
    instants inside one-minute buckets; earlier buckets contribute their last
    position. Buckets over buckets are days, of which there are few.
    """
    minute, day = 60_000_000, 86_400_000_000
    stamps = (log.groupBy(instants.instant_us(F.col("recorded_at")).alias("us"))
              .agg(F.max("log_position").alias("pos")))
    asked = times.select(F.col("as_of_us").alias("us")).distinct().withColumn("pos", F.lit(None).cast("long"))
    rows = stamps.unionByName(asked).withColumn("_minute", F.floor(F.col("us") / minute))
    local = F.max("pos").over(Window.partitionBy("_minute").orderBy("us"))
    minutes = rows.groupBy("_minute").agg(F.max("pos").alias("top")).withColumn(
        "_day", F.floor(F.col("_minute") * minute / day))
    days = (minutes.groupBy("_day").agg(F.max("top").alias("dtop"))
            .withColumn("_dcarry", F.max("dtop").over(
                Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1))))
    carried = (minutes.withColumn("_mcarry", F.max("top").over(
                   Window.partitionBy("_day").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)))
               .join(days.select("_day", "_dcarry"), "_day")
               .select("_minute", F.greatest("_mcarry", "_dcarry").alias("_carry")))
    placed = (rows.withColumn("_local", local).join(carried, "_minute", "left")
              .withColumn("log_position", F.greatest("_local", "_carry")))
    return (placed.join(times.select(F.col("as_of_us").alias("us")).distinct(), "us", "left_semi")
            .groupBy(F.col("us").alias("as_of_us")).agg(F.max("log_position").alias("log_position")))


def values_as_of(log: DataFrame, requests: DataFrame) -> DataFrame:
    """Belief value for each (belief_id, as_of_us) request.

    Requests become marks in the belief's own position order, so each row is
    compared with its predecessors only and no pair of rows is enumerated.
    """
    placed = cut_lineage(requests.join(positions_at(log, requests), "as_of_us", "left"))  # read twice
    marks = (placed.where(F.col("log_position").isNotNull()).select("belief_id", "log_position").distinct()
             .select("belief_id", (F.col("log_position") * 2 + 1).alias("at"),
                     F.lit(None).cast("struct<us:bigint,pos:bigint,value:string,event_id:string>").alias("head"),
                     F.lit(True).alias("mark")))
    events = value_events(log).select(
        "belief_id", (F.col("log_position") * 2).alias("at"),
        F.struct(F.col("occurred_us").alias("us"), F.col("log_position").alias("pos"), "value", "event_id").alias("head"),
        F.lit(False).alias("mark"))
    headed = running_max(events.unionByName(marks), ["belief_id"], F.col("head"), "best", inclusive=True,
                         position="at")
    found = headed.where("mark").select("belief_id", F.floor(F.col("at") / 2).alias("log_position"),
                                        F.col("best.value").alias("current_value"),
                                        F.col("best.event_id").alias("head_event_id"))
    return placed.join(found, ["belief_id", "log_position"], "left").select(
        *requests.columns, "current_value", "head_event_id")
