"""Keyed tables kept by a stream: every micro-batch merges into the next snapshot, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from taxloom.sources import stores

Merge = Callable[[DataFrame | None, DataFrame], DataFrame]


def merge_stream(stream: DataFrame, folder: str, checkpoint: str, keys: list[str], merge: Merge, trigger: dict | None = None,
                 prepared: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> StreamingQuery:
    """Runs ``merge(old rows of the touched buckets or None, prepared batch)`` per micro-batch; rows are known by ``keys``.

    The version written is the batch id plus one, and a version that is complete is not written again, so
    a batch replayed after a failure changes nothing. Only the buckets of the batch's keys are read and written.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        stores.merge_snapshot(prepared(batch), folder, batch_id + 1, keys, merge)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def append_stream(stream: DataFrame, folder: str, checkpoint: str, job: Callable[[DataFrame], DataFrame],
                  trigger: dict | None = None) -> StreamingQuery:
    """Appends ``job(batch)`` of every micro-batch under its own batch folder (rewritten on replay)."""

    def step(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()
