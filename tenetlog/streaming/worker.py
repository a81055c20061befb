"""Structured Streaming around a store: submit requests, publish views.

The position of a view is the truth about what was applied; the stream's own
checkpoint only decides which files to look at. A micro-batch that is delivered
again finds its events applied and changes nothing. Old source times are never
dropped by a watermark: a late event is support, whenever it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from tenetlog.functions import instants
from tenetlog.operators.admission import now_text
from tenetlog.sources.store import LogStore


def live_as_of(store: LogStore, clock: Callable[[], str] = now_text) -> str:
    """The clock, or the log tip when a clamped tip is ahead of it."""
    now, last = clock(), store.manifest().recorded_at
    return now if last is None else max((now, last), key=instants.literal_us)


def publish_stream(store: LogStore, projector: str, checkpoint: str, *, as_of: str | None = None,
                   max_files: int | None = None) -> StreamingQuery:
    """Follow the store's commits and publish up to each batch's last event.

    Runs over what is there and stops (``availableNow``). A commit is one file, so a stream
    never sees rows of an append that is still being written.
    """
    reader = store.spark.readStream.schema("log_position long").option("pathGlobFilter", "*.json")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.json(f"{store.root}/commits")

    def apply(batch: DataFrame, _batch_id: int) -> None:
        last = batch.agg(F.max("log_position")).first()[0]
        if last is not None:
            store.publish(as_of or live_as_of(store), projector, up_to=last)

    return (stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def submit_stream(store: LogStore, requests: DataFrame, projector: str, checkpoint: str, *,
                  clock: Callable[[], str] = now_text, verdicts: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Admit a stream of requests (with an ``order`` column) batch by batch:
    publish what is pending, append, publish again."""

    def take(batch: DataFrame, _batch_id: int) -> None:
        store.publish(live_as_of(store, clock), projector)
        judged = store.submit(batch, clock(), projector)
        if verdicts is not None:
            verdicts(judged)
        store.publish(live_as_of(store, clock), projector)

    return (requests.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def record(store: LogStore, requests: DataFrame, projector: str, clock: str) -> DataFrame:
    """Submit one batch and publish it; returns the verdicts."""
    store.publish(live_as_of(store, lambda: clock), projector)
    judged = store.submit(requests, clock, projector)
    store.publish(live_as_of(store, lambda: clock), projector)
    return judged
