"""Queries of dictation streams: a user's events stand for frames and for tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans.grouped_queries import streamed
from chronoloom.plans.registry import query
from chronoloom.streaming import dictation

#: Half a second to a second a frame; a gap of 12 hours ends a session.
SETTINGS = {"hard": 160_000, "silence": 20_000, "least": 48_000, "overlap": 32_000, "shortest": 8_000, "longest": 16_000}
IDLE, LATENESS = 43_200.0, "1 hour"


def frames(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.col("ts").cast("timestamp").alias("time"), F.col("event_id").alias("frame"), (8_000 + F.col("event_id") * 7919 % 8_001).alias("size"), (F.col("value") >= 8).alias("voiced"))


def tokens(events: DataFrame) -> DataFrame:
    """Event types as tokens, in chunks of six hours; those of a chunk's last hour are heard again in the next, some seconds later and in capitals."""
    second = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    own = F.struct(F.floor(second / 21_600).alias("chunk"), F.col("event_type").alias("text"), second.alias("start"))
    again = F.struct((F.floor(second / 21_600) + 1).alias("chunk"), F.upper("event_type").alias("text"), (second + F.col("event_id") % 40).alias("start"))
    both = F.explode(F.when(second % 21_600 >= 18_000, F.array(own, again)).otherwise(F.array(own))).alias("t")
    timed = events.select("user_id", "event_id", F.ceil(F.col("value") * 20).alias("length"), both).filter("length > 0")
    return timed.select("user_id", "t.chunk", "t.text", "t.start", (F.col("t.start") + F.col("length")).alias("end"))


@query()
def dictation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each user's frames from a stream, with what is fed again after a hard cut."""
    return streamed(spark, sf_dir, "events", lambda events: dictation.chunk_stream(frames(events), "user_id", idle=IDLE, lateness=LATENESS, **SETTINGS))


@query()
def merged_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of overlapping chunks from a stream, each once."""
    return streamed(spark, sf_dir, "events", lambda events: dictation.merge_stream(tokens(events), "user_id", horizon=86_400))
