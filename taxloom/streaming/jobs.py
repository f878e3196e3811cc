"""The streaming jobs.

Arrival order decides and nothing is dropped as late: the tables here are keyed states, not windows.
Only the expiry job has a watermark, and only to know when an expiry has passed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from taxloom import constants as C
from taxloom.operators import invoices, notes, sessions
from taxloom.plans.ingest import prose_points
from taxloom.sources import stores
from taxloom.streaming.snapshots import append_stream, merge_stream

_MESSAGE = T.StructType([T.StructField("seq", T.LongType()), T.StructField("role", T.StringType()),
                         T.StructField("content", T.StringType())])
_HISTORY = T.StructType([T.StructField("thread_id", T.LongType()), *_MESSAGE.fields])


class _BoundedHistory(StatefulProcessor):
    """Keeps the newest messages of a thread and emits what it keeps."""

    def __init__(self, cap: int):
        self.cap = cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.messages = handle.getListState("messages", _MESSAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(m) for m in self.messages.get()] if self.messages.exists() else []
        for batch in rows:
            kept += list(batch[["seq", "role", "content"]].itertuples(index=False, name=None))
            kept = sorted(kept)[-self.cap:]  # bounded between Arrow batches too
        kept = [(int(s), r, c) for s, r, c in kept]
        self.messages.put(kept)
        yield pd.DataFrame([(key[0], *m) for m in kept], columns=["thread_id", "seq", "role", "content"])

    def close(self) -> None:
        pass


def bounded_history(messages: DataFrame, cap: int = C.CHAT_HISTORY_MESSAGES) -> DataFrame:
    """Stream of ``thread_id, seq, role, content``: after each micro-batch, the kept messages of the threads
    it touched. Needs the RocksDB state store."""
    return messages.groupBy("thread_id").transformWithStateInPandas(
        _BoundedHistory(cap), _HISTORY, outputMode="Update", timeMode="None")


MEMORY = "user_id string, customer_name string, customer_context string, issue_summary string, created_at timestamp, updated_at timestamp"
MEMORY_KEYS = ["user_id", "customer_name"]


def merge_memories(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Context appended, issue overwritten."""
    return notes.upsert_memories(batch.sparkSession.createDataFrame([], MEMORY) if old is None else old, batch)


def memory_stream(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Customer memories kept as a keyed table."""
    return merge_stream(updates, folder, checkpoint, MEMORY_KEYS, merge_memories)


def merge_profiles(old: DataFrame | None, batch: DataFrame) -> DataFrame:
    """A value that is given overwrites, null leaves the old one."""
    fresh = sessions.merged_profiles(batch)
    if old is None:
        return fresh
    fields = [c for c in fresh.columns if c != "user_id"]
    new = fresh.select("user_id", *[F.col(c).alias(f"new_{c}") for c in fields])
    return old.join(new, "user_id", "full_outer").select("user_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in fields])


def profile_stream(updates: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """User profiles kept as a keyed table."""
    return merge_stream(updates, folder, checkpoint, ["user_id"], merge_profiles)


_EXPIRED = T.StructType([T.StructField("batch_id", T.StringType()), T.StructField("user_id", T.StringType()),
                         T.StructField("expires_at", T.TimestampType())])
_OWNED = T.StructType([T.StructField("user_id", T.StringType()), T.StructField("expires_at", T.TimestampType())])


class _Expiry(StatefulProcessor):
    """Remembers a batch until its expiry passes, then reports and forgets it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.batch = handle, handle.getValueState("batch", _OWNED)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for user_id, expires_at in batch[["user_id", "expires_at"]].itertuples(index=False, name=None):
                self.batch.update((user_id, expires_at.to_pydatetime()))
                self.handle.registerTimer(int(expires_at.timestamp() * 1000))
        yield pd.DataFrame(columns=["batch_id", "user_id", "expires_at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = self.batch.exists() and int(self.batch.get()[1].timestamp() * 1000) <= expiredTimerInfo.getExpiryTimeInMs()
        if due:  # a batch stored again with a later expiry has a timer of its own for that
            user_id, expires_at = self.batch.get()
            self.batch.clear()
            yield pd.DataFrame([(key[0], user_id, pd.Timestamp(expires_at))], columns=["batch_id", "user_id", "expires_at"])
        else:
            yield pd.DataFrame(columns=["batch_id", "user_id", "expires_at"])

    def close(self) -> None:
        pass


def expired_batches(batches: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Stream of stored batches (``batch_id, user_id, created_at, expires_at``) to those whose expiry has passed,
    judged by the newest ``created_at`` seen."""
    return batches.withWatermark("created_at", delay).groupBy("batch_id").transformWithStateInPandas(
        _Expiry(), _EXPIRED, outputMode="Append", timeMode="EventTime")


def invoice_stream(arriving: DataFrame, folder: str, checkpoint: str, as_of, tolerance=C.MISMATCH_TOLERANCE) -> StreamingQuery:
    """Checks invoices as they arrive (each is judged on its own)."""
    return append_stream(arriving, folder, checkpoint, lambda batch: invoices.check_invoices(batch, as_of, None, tolerance))


def arriving_points(documents: DataFrame) -> DataFrame:
    return prose_points(documents).withColumn("run_ts", F.current_timestamp())


def merge_points(old: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """Points by id; those of the later run win."""
    return stores.upsert_chunks(fresh.limit(0) if old is None else old, fresh)


def ingest_stream(documents: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Chunks arriving documents into points; a document that comes again replaces its points by id."""
    return merge_stream(documents, folder, checkpoint, ["id"], merge_points, prepared=arriving_points)
