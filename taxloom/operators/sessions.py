"""Conversation state as queries over an append-only message table ``thread_id, seq, role, content``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from taxloom import constants as C
from taxloom.functions.text import intent, language, stated_name


def newest(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of every thread (a ranked limit, applied before the shuffle as well)."""
    w = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    return messages.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= n).drop("age")


def spoken(messages: DataFrame) -> DataFrame:
    """Messages of people and assistants; other kinds are dropped."""
    role = F.when(F.col("role").isin("user", "human"), "user").when(F.col("role").isin("assistant", "ai"), "assistant")
    return messages.withColumn("role", role).filter(F.col("role").isNotNull())


def wire_window(messages: DataFrame, n: int = C.WIRE_MESSAGES) -> DataFrame:
    """What a model gets to see: of the last n messages, the spoken ones."""
    return spoken(newest(messages, n))


def last_user_message(messages: DataFrame) -> DataFrame:
    asked = spoken(messages).filter(F.col("role") == "user")
    return asked.groupBy("thread_id").agg(F.max_by("content", "seq").alias("content"), F.max("seq").alias("seq"))


def session_view(messages: DataFrame, cap: int = C.CHAT_HISTORY_MESSAGES, window: int = C.WIRE_MESSAGES) -> DataFrame:
    """Per thread: last question, its language and intent, a stated name, history and window sizes."""
    kept = newest(messages, cap)
    last = last_user_message(kept).select(
        "thread_id", "content", language(F.col("content")).alias("language"), intent(F.col("content")).alias("intent"),
        stated_name(F.col("content")).alias("user_name"))
    sizes = kept.groupBy("thread_id").agg(F.count(F.lit(1)).alias("history_size"))
    wire = wire_window(kept, window).groupBy("thread_id").agg(F.count(F.lit(1)).alias("window_size"))
    return sizes.join(last, "thread_id", "left").join(wire, "thread_id", "left")


def merged_profiles(updates: DataFrame, fields=("user_name", "email", "preferred_language", "preferred_tone",
                                                 "last_activity_summary")) -> DataFrame:
    """Profiles from updates ``user_id, seq, <fields>``: per field the newest value that is not null."""
    return updates.groupBy("user_id").agg(*[
        F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in fields])
