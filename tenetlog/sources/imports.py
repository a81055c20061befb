"""Import runs: prepared requests are kept before any is submitted, so that a run
can be resumed with the same IDs."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from tenetlog.operators import integrity, reports
from tenetlog.schema import REQUEST_FIELDS, LogError
from tenetlog.sources.log import require_clean
from tenetlog.sources.store import LogStore

_REQUESTS = "order long, " + ", ".join(f"{f} string" for f in REQUEST_FIELDS) + \
    ", canonical_entity_id string, ciphertext string, redacted boolean"
_ASSOCIATIONS = "scope string, mention_id string, subject_id string"


def _path(store: LogStore, run_id: str) -> str:
    if not isinstance(run_id, str) or not re.fullmatch("[A-Za-z0-9][A-Za-z0-9_.-]*", run_id):
        raise ValueError("run_id must be one safe path component")
    return f"{store.root}/imports/run={run_id}"


def save(store: LogStore, run_id: str, requests: DataFrame, associations: DataFrame, projector: str) -> None:
    """Keep a prepared run; a kept run is never replaced."""
    reports.require_report_projector(projector)
    path = _path(store, run_id)
    columns = [c.split()[0] for c in _REQUESTS.split(", ")]
    requests.select(*columns).write.mode("error").parquet(f"{path}/requests/projector={projector}")
    associations.write.mode("error").parquet(f"{path}/associations")


def load(store: LogStore, run_id: str, projector: str) -> tuple[DataFrame, DataFrame]:
    """(requests, associations) of a kept run, validated; another projector's run is refused."""
    reports.require_report_projector(projector)
    path = _path(store, run_id)
    try:
        requests = store.spark.read.schema(_REQUESTS).parquet(f"{path}/requests/projector={projector}")
    except AnalysisException as exc:
        raise LogError(f"run {run_id!r} is not kept for projector {projector}") from exc
    associations = store.spark.read.schema(_ASSOCIATIONS).parquet(f"{path}/associations")
    require_clean(integrity.unpack(requests, integrity.pack(integrity.request_checks()), F.col("event_id")), "import run")
    require_clean(associations.groupBy("scope").count().where("count > 1").select(
        F.lit("association").alias("check"), F.col("scope").alias("location"),
        F.lit("duplicate association scope").alias("message")), "import run")
    return requests, associations


def retained(store: LogStore) -> DataFrame:
    """Associations of all kept runs."""
    try:
        found = store.spark.read.schema(_ASSOCIATIONS).option("basePath", f"{store.root}/imports").parquet(
            f"{store.root}/imports/run=*/associations")
    except AnalysisException:
        return store.spark.createDataFrame([], _ASSOCIATIONS)
    return found.select("scope", "mention_id", "subject_id").distinct()


def resume(store: LogStore, run_id: str, clock: str, projector: str) -> DataFrame:
    """Submit a kept run, again if need be, publish it and check that it is complete."""
    requests, associations = load(store, run_id, projector)
    store.publish(clock, projector)
    verdicts = store.submit(requests, clock, projector)
    store.publish(clock, projector)
    log = store.log()
    require_clean(reports.association_violations(log, associations), "import")
    require_clean(reports.completion_violations(log, requests, projector), "import")
    return verdicts
