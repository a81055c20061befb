"""Sound rows are told by one condition; every other row meets every check."""
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tenetlog.operators import integrity
from tenetlog.session import cut_lineage
from tenetlog.sources import adapt, log as L

DAMAGE = {
    "event_id": "", "schema_version": "1", "event_type": "unknown", "occurred_at": "2024-13-01T00:00:00Z", "recorded_at": None,
    "source": '{"actor_id":"","config":{}}', "source_class": "", "origin_type": "heard", "payload_hash": "x", "idempotency_key": "0" * 64,
    "entity_refs": '["a",""]', "prev_event_hash": "A" * 64, "event_hash": "0" * 64, "ciphertext": '{"b":1,"a":2}', "payload_event_id": None,
    "payload_row_hash": "0" * 64, "redacted": True}


@pytest.fixture(scope="module")
def joined(spark, sf):
    logs = [make(spark, sf).where("log_position <= 200") for make in (adapt.value_log, adapt.identity_log)]
    return cut_lineage(L.inline(logs[0].unionByName(logs[1])))


def test_sound_rows_do_not_reach_python(joined, monkeypatch):
    """All rows once went to Python and met each check in uncompiled code."""
    @F.pandas_udf("string")
    def refuse(texts: pd.Series) -> pd.Series:
        assert not len(texts)
        return texts

    monkeypatch.setattr(integrity.jsontext, "canonical_json", refuse)
    assert integrity.row_violations(joined).count() == 0


def test_every_damaged_field_meets_every_check(joined):
    """The condition leaves out no violation that the checks alone find."""
    rows, k = joined, (F.col("log_position") - 1) % (len(DAMAGE) + 2)
    for i, (name, value) in enumerate(DAMAGE.items()):
        kind = dict(joined.dtypes)[name]
        rows = rows.withColumn(name, F.when(k == i, F.lit(value).cast(kind)).otherwise(F.col(name)))
    rows = cut_lineage(rows.withColumn("ciphertext", F.when(k == len(DAMAGE), F.concat(F.lit(" "), "ciphertext")).otherwise(F.col("ciphertext"))))
    got, want = (sorted(map(repr, integrity.row_violations(rows, exact=e).collect())) for e in (False, True))
    sound = rows.where(integrity.surely_sound() & (k < len(DAMAGE))).count()
    assert got == want and got and sound == 0
