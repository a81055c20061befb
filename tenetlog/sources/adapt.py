"""Logs derived from the star-schema and event tables.

Every rule here has the same form in ``plans.sqltext`` so that results can be
compared. Keys of the tables are dense from 0, which gives dense positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tenetlog.functions import canonical as C
from tenetlog.schema import (CORRECTION, EXPIRY, MENTION, OBSERVATION, REPLACEMENT, VERIFIABILITY)
from tenetlog.sources.log import (assign_in_chain, chain_of, claim_json, mention_payload, prepare_requests)

START = "2024-02-01 00:00:00"
# Offsets used to spell source times: text and minutes.
OFFSETS = (("Z", 0), ("+00:00", 0), ("+05:45", 345), ("-05:30", -330))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def recorded_text(second: Column) -> Column:
    """UTC text of START plus whole seconds, without using the session time zone."""
    start = F.lit(START).cast("timestamp_ntz")
    return F.date_format(start + F.make_dt_interval(secs=second.cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _occurred_text(ts: Column, key: Column) -> Column:
    text = None
    for i, (suffix, minutes) in enumerate(OFFSETS):
        local = F.date_format(ts.cast("timestamp_ntz") + F.expr(f"INTERVAL '{minutes}' MINUTE"),
                              "yyyy-MM-dd'T'HH:mm:ss")
        spelled = F.concat(local, F.lit(suffix))
        text = F.when(key % 4 == i, spelled) if text is None else text.when(key % 4 == i, spelled)
    return text


def _by_chain(df: DataFrame, position: Column) -> DataFrame:
    """Shuffle the narrow source rows by chain, before the wide texts are built."""
    return df.withColumn("chain_id", chain_of(position)).repartition("chain_id")


def value_requests(spark: SparkSession, sf_dir: str, *, submitted: bool = False) -> DataFrame:
    """One value request per row of ``events``; positions follow event_id.

    ``submitted=False`` gives a log that is valid as it is: corrections sit only
    on rows that are not late. ``submitted=True`` gives requests of which some
    must be refused: backdated corrections, bad labels, other origins, retries.
    """
    e = _by_chain(table(spark, sf_dir, "events").drop("props"), F.col("event_id") + 1)
    n = F.col("event_id")
    occurred = F.col("ts").cast("timestamp_ntz") - F.make_dt_interval(hours=(n % 7).cast("int"))
    correction = (n % 5 == 4) if submitted else (n % 14 == 0)
    cents = F.floor(F.col("value") * 100).cast("long").cast("string")
    label = F.element_at(F.array(*[F.lit(v) for v in VERIFIABILITY]), (n % 4 + 1).cast("int"))
    if submitted:
        label = F.when(n % 97 == 13, F.lit("unknowable")).otherwise(label)
    belief = F.concat(F.lit("user:"), F.col("user_id").cast("string"), F.lit("/property:"), F.col("event_type"))
    base = e.select(
        (n + 1).alias("log_position"), "chain_id", n.alias("n"), belief.alias("belief_id"), cents.alias("value"),
        label.alias("verifiability"), F.col("user_id").cast("string").alias("user_text"),
        _occurred_text(occurred, n).alias("occurred"), correction.alias("is_correction"))
    payload = C.json_object(belief_id=C.json_string(F.col("belief_id")), value=C.json_string(F.col("value")),
                            verifiability=C.json_string(F.col("verifiability")))
    origin = F.when(F.col("n") % 89 == 7, "user_stated").otherwise("observed") if submitted else None
    event_id = F.concat(F.lit("e-"), F.col("n").cast("string"))
    rows = prepare_requests(
        base, event_type=F.when(F.col("is_correction"), CORRECTION).otherwise(OBSERVATION),
        occurred_at=F.col("occurred"), actor_id=F.concat(F.lit("u"), F.col("user_text")),
        source_class=F.concat(F.lit("class"), (F.col("n") % 3).cast("string")),
        origin_type=origin, payload=payload, event_id=event_id)
    rows = rows.withColumn("recorded_at", recorded_text(F.floor(F.col("n") / 2)))
    return rows.drop("is_correction", "occurred", "user_text")


def value_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored log of values, hashes and chain links included."""
    return assign_in_chain(value_requests(spark, sf_dir).drop("n", "belief_id", "value", "verifiability"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer")


def _mention_rows(spark, sf_dir):
    c = _by_chain(_customers(spark, sf_dir), F.col("c_custkey") + 1).select("chain_id",
        (F.col("c_custkey") + 1).alias("log_position"),
        F.concat(F.lit("s-"), F.col("c_custkey").cast("string")).alias("subject_id"),
        F.concat(F.lit("m-"), F.col("c_custkey").cast("string")).alias("mention_id"),
        F.col("c_name").alias("text"), F.col("c_nationkey").cast("string").alias("nation"))
    payload = mention_payload(F.col("mention_id"), F.col("subject_id"), F.col("text"))
    rows = prepare_requests(
        c, event_type=F.lit(MENTION), occurred_at=recorded_text(F.col("log_position")),
        actor_id=F.concat(F.lit("nation-"), F.col("nation")), source_class=F.lit("register"),
        payload=payload, event_id=F.concat(F.lit("em-"), F.substring("subject_id", 3, 20)),
        entity_refs=F.array("subject_id"))
    return rows.withColumn("recorded_at", recorded_text(F.col("log_position")))


def _order_rows(spark, sf_dir):
    """Orders with their log position: after all mentions."""
    count = _customers(spark, sf_dir).agg(F.count(F.lit(1)).alias("mentions"))
    o = table(spark, sf_dir, "orders").crossJoin(F.broadcast(count))  # one row
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    position = F.col("mentions") + F.col("o_orderkey") + 1
    return _by_chain(o, position).select(
        position.alias("log_position"), "chain_id", F.col("o_orderkey").alias("n"),
        key.alias("key"), cust.alias("cust"), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("status"),
        F.floor(F.col("o_totalprice") * 100).cast("long").cast("string").alias("cents"))


_COLUMNS = ("log_position", "chain_id", "event_id", "schema_version", "event_type", "occurred_at", "source",
            "source_class", "origin_type", "entity_refs", "canonical_entity_id", "ciphertext", "redacted",
            "recorded_at")


def _claim(ordinal: int, prop: Column, belief_suffix: Column, value_json: Column) -> Column:
    return claim_json(
        belief_id=F.concat(F.lit("b-"), F.col("cust"), F.lit("-"), belief_suffix),
        claim_candidate_id=F.concat(F.lit("c-"), F.col("key"), F.lit(f"-{ordinal}")),
        mention_id=F.concat(F.lit("m-"), F.col("cust")), property_id=prop,
        subject_id=F.concat(F.lit("s-"), F.col("cust")), value_json=value_json,
        verifiability=F.lit("externally_checkable"))


def _finish_orders(rows: DataFrame, event_type: Column, payload: Column) -> DataFrame:
    out = prepare_requests(
        rows, event_type=event_type, occurred_at=recorded_text(F.col("log_position")),
        actor_id=F.concat(F.lit("desk-"), F.substring("priority", 1, 1)), source_class=F.lit("order_book"),
        payload=payload, event_id=F.concat(F.lit("eo-"), F.col("key")))
    return out.withColumn("recorded_at", recorded_text(F.col("log_position"))).select(*_COLUMNS)


def identity_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One mention per customer, then one observation per order.

    Each order claims its price under its priority; every third also claims the
    order status as an integer-valued property, so some events have two claims.
    """
    o = _order_rows(spark, sf_dir)
    price = _claim(1, F.col("priority"), F.col("priority"), C.json_string(F.col("cents")))
    status = _claim(2, F.lit("status"), F.lit("status"), F.col("status_code"))
    rows = o.withColumn("status_code", F.when(F.col("status") == "F", "1").when(F.col("status") == "O", "2").otherwise("3"))
    claims = F.when(F.col("n") % 3 == 0, C.json_array(price, status)).otherwise(C.json_array(price))
    orders = _finish_orders(rows, F.lit(OBSERVATION), C.json_object(claims=claims))
    return _mention_rows(spark, sf_dir).select(*_COLUMNS).unionByName(orders)


def identity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_in_chain(identity_requests(spark, sf_dir))


def transition_requests(spark: SparkSession, sf_dir: str, *, submitted: bool = False) -> DataFrame:
    """The identity log with endings: within a customer's priority, by sequence.

    Every 7th order expires the candidate before it, every 4th replaces it and
    every 5th corrects it. What follows an expiry is a plain observation, so the
    log is valid. ``submitted=True``
    leaves the rules in force after an expiry, so those must be refused.
    """
    o = _order_rows(spark, sf_dir)
    w = Window.partitionBy("cust", "priority").orderBy("n")
    rows = (o.withColumn("seq", F.row_number().over(w))
            .withColumn("prior_key", F.lag("key").over(w)).repartition("chain_id"))
    follows_expiry = (F.col("seq") > 7) & ((F.col("seq") - 1) % 7 == 0)
    plain = (F.col("seq") == 1) if submitted else (F.col("seq") == 1) | follows_expiry
    kind = (F.when(plain, OBSERVATION)
            .when(F.col("seq") % 7 == 0, EXPIRY)
            .when(F.col("seq") % 4 == 0, REPLACEMENT)
            .when(F.col("seq") % 5 == 0, CORRECTION).otherwise(OBSERVATION))
    rows = rows.withColumn("kind", kind)
    claim = _claim(1, F.col("priority"), F.col("priority"), C.json_string(F.col("cents")))
    targets = F.concat(F.lit('["c-'), F.col("prior_key"), F.lit('-1"]'))
    stated = '{"kind":"stated","statement":"superseded by a later order"}'
    error = '{"kind":"stated_error","statement":"entry error"}'
    belief = C.json_string(F.concat(F.lit("b-"), F.col("cust"), F.lit("-"), F.col("priority")))
    payload = (F.when(F.col("kind") == OBSERVATION, C.json_object(claims=C.json_array(claim)))
               .when(F.col("kind") == EXPIRY, C.json_object(basis=stated, belief_id=belief, targets=targets))
               .when(F.col("kind") == REPLACEMENT, C.json_object(basis=stated, claim=claim, targets=targets))
               .otherwise(C.json_object(basis=error, claim=claim, targets=targets)))
    orders = _finish_orders(rows, F.col("kind"), payload)
    return _mention_rows(spark, sf_dir).select(*_COLUMNS).unionByName(orders)


def transition_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_in_chain(transition_requests(spark, sf_dir))


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pinned artifacts: a title, a status line and the text.

    Some state their status twice, leave a fence open, or use a markup that is
    not a declaration: those must refuse.
    """
    d = table(spark, sf_dir, "documents")
    n = F.col("doc_id")
    ending = (F.when(n % 11 == 3, "\n\nStatus: again\n").when(n % 13 == 5, "\n\n```\nopen\n")
              .when(n % 17 == 2, "\n\n**Status:** bold\n").otherwise("\n\nDate: 2024-01-01\n"))
    text = F.concat(F.lit("# "), F.col("source"), F.lit("\n\nStatus: "), F.col("lang"), F.lit("\n\n"), F.col("text"), ending)
    rows = d.select(
        F.col("doc_id").alias("n"), F.lit("library").alias("repository"),
        F.lit("0123456789abcdef0123456789abcdef01234567").alias("revision"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.encode(text, "UTF-8").alias("data"))
    return rows.withColumn("blob", C.git_blob_hash(F.col("data"), F.lit(40)))
