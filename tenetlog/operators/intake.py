"""First check of raw observations, before they become requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tenetlog.functions import canonical as C, instants
from tenetlog.operators import integrity
from tenetlog.schema import VERIFIABILITY

# Required members, in the order in which a missing one is reported.
REQUIRED = ("belief_id", "value", "verifiability", "occurred_at", "source", "source_class")


def screen(raw: DataFrame) -> DataFrame:
    """Add accepted, stage_reached and reason to rows with a JSON ``document``.

    ``domain`` marks documents whose value or label breaks the admission domain:
    those are errors of the caller rather than ordinary rejections.
    """
    doc = F.col("document")
    keys = F.json_object_keys(doc)
    reason = F.when(keys.isNull(), "document must be an object")
    for name in REQUIRED:
        text = F.get_json_object(doc, f"$.{name}")
        missing = ~F.array_contains(keys, name)
        if name not in ("value", "verifiability"):
            missing = missing | text.isNull() | (text == "")
        reason = reason.when(missing, f"missing field: {name}")
    value, label = integrity.string_member(doc, "value"), integrity.string_member(doc, "verifiability")
    domain = (F.when(value.isNull(), "value must be a JSON string")
              .when(~F.coalesce(label.isin(*VERIFIABILITY), F.lit(False)), "unknown verifiability"))
    actor = C.actor_of(F.get_json_object(doc, "$.source"))
    time_problem = instants.timestamp_problem(F.get_json_object(doc, "$.occurred_at"), "occurred_at")
    reason = (reason.when(domain.isNotNull(), domain)
              .when(F.coalesce(actor == "", F.lit(True)), "source.actor_id required")
              .otherwise(time_problem))
    out = raw.withColumn("reason", reason)
    return (out.withColumn("accepted", F.col("reason").isNull()).withColumn("stage_reached", F.lit(1))
            .withColumn("domain", F.coalesce(F.col("reason").isin("value must be a JSON string", "unknown verifiability"),
                                             F.lit(False))))
