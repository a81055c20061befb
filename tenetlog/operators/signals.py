"""Decisions over views that the contract specifies: gates, scores, alerts, discovery."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from tenetlog.functions import jsontext

# Gate size, state ordinals, score weights and alert thresholds.
MIN_SOURCE_CLASSES = 2
STATE_ORDINAL = {"quarantined": 0, "questioned": 1, "unverified": 2, "verified": 3}
WEIGHTS = {"age": 1, "refs": 2, "single_source": 3, "low_conf_source": 3}
CONTRADICTION_MULTIPLE = 2.0
FALSE_POSITIVE_FRACTION = 0.05
# Allowed state changes: from, to, needs a world oracle, allowed offline.
STATE_CHANGES = (
    ("unverified", "verified", True, False),
    ("unverified", "questioned", False, True),
    ("verified", "questioned", False, True),
    ("questioned", "verified", True, False),
    ("questioned", "quarantined", False, True),
    ("quarantined", "questioned", True, False),
)
PAGE_SIZE, MAX_PAGE_SIZE = 100, 1_000


def corroborated(log: DataFrame, minimum: int = MIN_SOURCE_CLASSES) -> DataFrame:
    """Contents stated by enough distinct source classes.

    Distinct (content, class) pairs first, so a hot content shuffles as few rows
    as it has classes.
    """
    pairs = log.groupBy("payload_hash", "source_class").agg(F.count(F.lit(1)).alias("n"))
    return (pairs.groupBy("payload_hash").agg(F.count(F.lit(1)).alias("source_classes"), F.sum("n").alias("events"))
            .where(F.col("source_classes") >= minimum))


def claim_scalar(state: Column) -> Column:
    ordinal = None
    for name, value in STATE_ORDINAL.items():
        ordinal = F.when(state == name, value) if ordinal is None else ordinal.when(state == name, value)
    return ordinal / F.lit(3.0)


def effective_confidence(state: Column, link_confidences: Column) -> Column:
    """The weakest link: least of the claim's scalar and its links' confidences."""
    return F.least(claim_scalar(state), F.array_min(link_confidences))


def state_change_allowed(changes: DataFrame) -> DataFrame:
    """Judge rows of (from_state, to_state, has_world_oracle, offline). Any state may be redacted."""
    rules = changes.sparkSession.createDataFrame(
        list(STATE_CHANGES), "from_state string, to_state string, _oracle boolean, _offline boolean")
    joined = changes.join(F.broadcast(rules), ["from_state", "to_state"], "left")  # six fixed rows
    ok = (F.col("_oracle").isNotNull() & (~F.col("_oracle") | F.col("has_world_oracle"))
          & (F.col("_offline") | ~F.col("offline")))
    return joined.withColumn("allowed", F.when(F.col("to_state") == "redacted", True).otherwise(ok)).drop("_oracle", "_offline")


def audit_priority(days: Column, references: Column, single_source: Column, low_confidence: Column) -> Column:
    return (days * WEIGHTS["age"] + references * WEIGHTS["refs"]
            + single_source.cast("int") * WEIGHTS["single_source"] + low_confidence.cast("int") * WEIGHTS["low_conf_source"])


def audit_queue(scored: DataFrame, key: str, top: int) -> DataFrame:
    return scored.orderBy(F.col("priority").desc(), F.col(key)).limit(top)


def every_day(daily: DataFrame, counts: list[str]) -> DataFrame:
    """``daily`` with a row of zeros for each absent day between its first and last one."""
    days = daily.agg(F.min("day").alias("first"), F.max("day").alias("last")).where("first is not null").select(
        F.explode(F.sequence("first", "last", F.expr("interval 1 day"))).alias("day"))
    return days.join(daily, "day", "left").fillna(0, counts)


def contradiction_alerts(daily: DataFrame, multiple: float = CONTRADICTION_MULTIPLE) -> DataFrame:
    """Days whose open contradictions exceed a multiple of the week before.

    ``daily``: (day, open_contradictions). Absent days count as days without any, so a
    gap lowers the average; the window is bounded by the calendar.
    """
    w = Window.orderBy(F.unix_date("day")).rangeBetween(-7, -1)
    return (every_day(daily, ["open_contradictions"])
            .withColumn("trailing_average", F.avg("open_contradictions").over(w))
            .withColumn("alert", F.coalesce(F.col("open_contradictions") > F.col("trailing_average") * multiple, F.lit(False))))


def intake_alerts(daily: DataFrame, fraction: float = FALSE_POSITIVE_FRACTION, days: int = 7) -> DataFrame:
    """Days on which false positives of the last ``days`` days exceed a fraction of their intake.

    ``daily``: (day, false_positives, intake); absent days had neither.
    """
    w = Window.orderBy(F.unix_date("day")).rangeBetween(1 - days, 0)
    wrong, taken = F.sum("false_positives").over(w), F.sum("intake").over(w)
    return every_day(daily, ["false_positives", "intake"]).withColumn("alert", wrong > taken * fraction)


# --- discovery ---

def _page_size(size) -> int:
    if isinstance(size, bool) or not isinstance(size, int) or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"page_size must be an integer from 1 to {MAX_PAGE_SIZE}")
    return size


def _page(rows: DataFrame, keys: list[str], after: list[str] | None, size: int) -> DataFrame:
    """One page in UTF-8 byte order of the keys; ``has_more`` from one extra row."""
    size = _page_size(size)
    if after is not None:
        later = F.lit(False)
        for i in range(len(keys)):
            same = F.lit(True)
            for j in range(i):
                same = same & (F.col(keys[j]) == after[j])
            later = later | (same & (F.col(keys[i]) > after[i]))
        rows = rows.where(later)
    page = rows.orderBy(*keys).limit(size + 1)
    numbered = page.withColumn("_n", F.row_number().over(Window.orderBy(*keys)))  # at most 1,001 rows
    return (numbered.withColumn("has_more", F.max("_n").over(Window.partitionBy()) > size)
            .where(F.col("_n") <= size).drop("_n"))


def list_subjects(entities: DataFrame, *, lifecycle="all", page_size=PAGE_SIZE, after=None) -> DataFrame:
    return _page(_alive(entities, lifecycle).select("subject_id", "lifecycle_status"), ["subject_id"], after, page_size)


def _alive(rows: DataFrame, lifecycle: str) -> DataFrame:
    if lifecycle not in ("all", "current"):
        raise ValueError("lifecycle must be 'all' or 'current'")
    return rows if lifecycle == "all" else rows.where(F.col("lifecycle_status") == "current")


def _scoped(rows: DataFrame, **scope) -> DataFrame:
    for name, value in scope.items():
        if value is not None:
            if not isinstance(value, str) or not value:
                raise ValueError(f"{name} must be a nonempty string")
            rows = rows.where(F.col(name) == value)
    return rows


def _with_lifecycle(mentions: DataFrame, entities: DataFrame, lifecycle: str) -> DataFrame:
    joined = mentions.select("mention_id", "text", "subject_id", "event_id").join(
        entities.select("subject_id", "lifecycle_status"), "subject_id")
    return _alive(joined, lifecycle)


def list_mentions(mentions: DataFrame, entities: DataFrame, *, subject_id=None, lifecycle="all",
                  page_size=PAGE_SIZE, after=None) -> DataFrame:
    return _page(_scoped(_with_lifecycle(mentions, entities, lifecycle), subject_id=subject_id), ["mention_id"], after, page_size)


def find_mention(mentions: DataFrame, entities: DataFrame, text: str, mode: str, *, subject_id=None,
                 lifecycle="all", page_size=PAGE_SIZE, after=None) -> DataFrame:
    """Exact or prefix match of literal text; no wildcard or normalisation."""
    if not isinstance(text, str) or not text:
        raise ValueError("invalid_query: text must be nonempty")
    if mode not in ("exact", "prefix"):
        raise ValueError("mode must be 'exact' or 'prefix'")
    hit = F.col("text") == text if mode == "exact" else F.col("text").startswith(F.lit(text))
    rows = _scoped(_with_lifecycle(mentions.where(hit), entities, lifecycle), subject_id=subject_id)
    return _page(rows, ["text", "mention_id"], after, page_size)


def list_properties(beliefs: DataFrame, *, subject_id=None, lifecycle="all", page_size=PAGE_SIZE, after=None) -> DataFrame:
    rows = _scoped(_alive(beliefs, lifecycle), subject_id=subject_id).select("property_id").distinct()
    return _page(rows, ["property_id"], after, page_size)


def list_beliefs(beliefs: DataFrame, *, subject_id=None, property_id=None, lifecycle="all",
                 page_size=PAGE_SIZE, after=None) -> DataFrame:
    rows = _scoped(_alive(beliefs, lifecycle), subject_id=subject_id, property_id=property_id)
    return _page(rows.select("belief_id", "subject_id", "property_id", "lifecycle_status"), ["belief_id"], after, page_size)


def scope_known(entities: DataFrame, subject_id: str) -> bool:
    """False means ``unknown_scope``, which is not an empty page."""
    return entities.where(F.col("subject_id") == subject_id).limit(1).count() > 0


def encode_cursor(query: dict, genesis: dict, prefix: dict, last_key: list[str], format_tag: str) -> str:
    """Opaque continuation: unpadded base64url of canonical JSON, keys as hex bytes."""
    body = {"format": format_tag, "query": query, "genesis": genesis, "prefix": prefix,
            "last_key": [k.encode().hex() for k in last_key]}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(token: str, query: dict, format_tag: str) -> dict:
    """Refuses tokens of another query, another format or another spelling."""
    try:
        raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4)).decode()
        body = jsontext.strict_value(raw)
        keys = [bytes.fromhex(k).decode() for k in body["last_key"]]
        again = encode_cursor(body["query"], body["genesis"], body["prefix"], keys, body["format"])
    except (ValueError, KeyError, TypeError, AttributeError) as exc:
        raise ValueError("invalid cursor") from exc
    if again != token or body["format"] != format_tag or body["query"] != query:
        raise ValueError("cursor does not belong to this query")
    return {**body, "last_key": keys}


def strict_refusals(payloads: DataFrame, key: str, text: str) -> DataFrame:
    """Payload texts that strict JSON refuses: every fault with its path."""
    judged = payloads.select(key, jsontext.strict_json(F.col(text)).alias("_s")).where("_s.error is not null")
    whole = F.array(F.struct(F.lit("$").alias("path"), F.col("_s.error").alias("reason")))
    return (judged.select(key, F.explode(F.coalesce("_s.faults", whole)).alias("_f"))
            .select(F.lit("payload").alias("check"), F.col(key).alias("location"), F.col("_f.path").alias("path"),
                    F.col("_f.reason").alias("message")))
