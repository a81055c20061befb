"""Steps whose time or memory grew too fast with the log."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenetlog.operators import values
from tenetlog.operators.segments import dense_positions
from tenetlog.session import configure, cut_lineage
from tenetlog.sources import adapt, log as L, store
from tenetlog.sources.store import LogStore

END = "9999-12-31T00:00:00Z"


@pytest.fixture(scope="module")
def log(spark, sf):
    return cut_lineage(adapt.value_log(spark, sf).where("log_position <= 300"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _requests(log):
    return log.drop("chain_id", "idempotency_key", "payload_hash", "prev_event_hash", "event_hash")


def test_hashes_of_chains_and_lineages_take_no_python(log):
    """Python once held the whole chains of a batch of 10,000 keys."""
    half = log.where("log_position <= 100")
    made = (L.assign(_requests(log)), values.lineage(log, END), store.merge_values({}, half, END)["beliefs"])
    assert not any("Python" in _plan(df) for df in made)


def test_chains_go_on_from_their_tips(log):
    whole = sorted(map(tuple, log.select("log_position", "prev_event_hash", "event_hash").collect()))
    tips = L.chain_tips(log.where("log_position <= 100")).where("chain_id = 1").select("chain_id", F.col("tip_hash").alias("seed"))
    late = L.assign(_requests(log.where("log_position > 100")), tips=tips)
    assert sorted(map(tuple, late.select("log_position", "prev_event_hash", "event_hash").collect())) == whole[100:]


def test_a_submit_numbers_and_admits_its_rows_once(spark, log, tmp_path, monkeypatch):
    """The rows to append were numbered and judged anew for each of their hashes."""
    monkeypatch.setattr(LogStore, "appends", lambda self, state, rows: iter([rows]))
    kept = LogStore(spark, str(tmp_path / "store"))
    requests = _requests(log).withColumnRenamed("log_position", "order").drop("recorded_at")
    _, (rows,) = kept.submission(requests, "2024-03-01T00:00:00Z", "0")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [row_number") == 1 and "Python" not in plan
    assert rows.count() == rows.select("log_position").distinct().count()

def test_python_gets_whole_texts_in_small_batches(spark):
    """10,000 documents at a time once stood in a Python worker."""
    configure(spark)

    @F.pandas_udf("long")
    def rows(texts: pd.Series) -> pd.Series:
        return texts * 0 + len(texts)

    assert spark.range(3000).coalesce(1).agg(F.max(rows("id"))).first()[0] <= 500


def test_positions_are_dealt_to_many_tasks(spark):
    """65,536 whole rows of neighbouring positions once met in one task."""
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        placed = dense_positions(spark.range(0, 120_000, 2).withColumnRenamed("id", "order"), "order", start=5)
        most = placed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        wrong = placed.where(F.col("log_position") != F.col("order") / 2 + 6).count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert most <= 20_000 and wrong == 0
