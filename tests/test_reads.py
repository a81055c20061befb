"""Refusals and warnings of named reads, and alerts over days that a table lacks."""
import datetime
import warnings

import pytest

from tenetlog.operators import reads, signals
from tenetlog.schema import LogError, UnsupportedError

DAY = datetime.date(2024, 1, 1)


def test_scalar_read_is_always_refused(spark):
    beliefs = spark.createDataFrame([("one", 1), ("two", 2)], "belief_id string, candidate_count long")
    with pytest.raises(KeyError):
        reads.scalar_value(beliefs, "none")
    with pytest.raises(LogError):
        reads.scalar_value(beliefs, "two")
    with pytest.raises(UnsupportedError):
        reads.scalar_value(beliefs, "one")


def test_stale_rows_warn(spark):
    rows = spark.createDataFrame([("a", None), ("b", True)], "id string, stale boolean")
    with pytest.warns(reads.StaleViewWarning):
        reads.warn_if_stale(rows)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert reads.warn_if_stale(rows.where("id = 'a'")).count() == 1


def test_delta_keeps_the_latest_row(spark):
    schema = "key string, log_position long, value string"
    prior = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], schema)
    delta = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], schema)
    got = {tuple(r) for r in reads.apply_delta(prior, delta, "key").select("key", "log_position", "value").collect()}
    assert got == {("a", 1, "x"), ("b", 3, None), ("c", 4, "z")}


def test_unknown_scope_is_not_an_empty_page(spark):
    entities = spark.createDataFrame([("s",)], "subject_id string")
    assert signals.scope_known(entities, "s") and not signals.scope_known(entities, "t")


def test_absent_days_count_as_zero(spark):
    # Seven days with one contradiction, then a gap of five days, then one.
    days = [*range(7), 12]
    daily = spark.createDataFrame([(DAY + datetime.timedelta(k), 1) for k in days], "day date, open_contradictions long")
    rows = {(r["day"] - DAY).days: r["alert"] for r in signals.contradiction_alerts(daily).collect()}
    assert sorted(rows) == list(range(13)) and [k for k, alert in rows.items() if alert] == [12]


def test_intake_alert_sums_the_window(spark):
    rows = [(DAY, 0, 100), (DAY + datetime.timedelta(2), 6, 10), (DAY + datetime.timedelta(9), 0, 1)]
    daily = spark.createDataFrame(rows, "day date, false_positives long, intake long")
    alerts = {(r["day"] - DAY).days for r in signals.intake_alerts(daily).collect() if r["alert"]}
    assert alerts == set(range(2, 9))       # 6 of 110, later 6 of 10, until the window has passed
    assert signals.intake_alerts(daily.limit(0)).count() == 0
