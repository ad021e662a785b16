"""Structured Streaming operators, and the same results from a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoloom.streaming.folds import SpeechSessions

REGION = "start long, end long, score double"
STATE = "start long, last long, score double, ready_start long, ready_end long, ready_score double, clock long"


def _frames(df: DataFrame, key: str) -> DataFrame:
    """Columns that both folds read; a frame whose `final` is true ends its session."""
    final = F.col("final") if "final" in df.columns else F.lit(False)
    return df.select(key, "start", "end", "score", final.alias("final"))


def speech_sessions_stream(frames: DataFrame, key: str, **settings: float) -> DataFrame:
    """Regions per session from a stream of frames (key, start, end, score, final), each as soon as it is certain.

    Frames of a micro-batch are put in order; one older than the session's clock is an error, as lateness isn't
    allowed. A session's state is a few numbers, whatever its length.
    """
    kind = df_kind(frames, key)

    def fold(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session = SpeechSessions(**settings)
        if state.exists:
            session.restore(tuple(state.get))
        out, ended = [], False
        for row in pd.concat(list(batches)).sort_values(["start", "end"]).itertuples(index=False):
            out += session.push(int(row.start), int(row.end), float(row.score))
            ended |= bool(row.final)
        if ended:
            out += session.flush()
            state.remove()
        else:
            state.update(session.state())
        yield pd.DataFrame([(*name, *r) for r in out], columns=[key, "start", "end", "score"])

    return _frames(frames, key).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {REGION}", STATE, "append", GroupStateTimeout.NoTimeout)


def speech_sessions_batch(frames: DataFrame, key: str, **settings: float) -> DataFrame:
    """The same fold over whole sessions; a session's frames meet in one task, as they do in the stream."""
    kind = df_kind(frames, key)

    def fold(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        session, out = SpeechSessions(**settings), []
        for row in pdf.sort_values(["start", "end"]).itertuples(index=False):
            out += session.push(int(row.start), int(row.end), float(row.score))
        out += session.flush()
        return pd.DataFrame([(*name, *r) for r in out], columns=[key, "start", "end", "score"])

    return _frames(frames, key).groupBy(key).applyInPandas(fold, f"{key} {kind}, {REGION}")


def df_kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def windowed_counts(events: DataFrame, *, width: str = "1 hour", lateness: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Counts and sums per event type in tumbling windows, final once the watermark has passed a window."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    out = timed.groupBy(F.window("_time", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def replay(events: DataFrame, job: str, order: str, *, after: int = 0, kept: int = 512) -> DataFrame:
    """The newest `kept` events of each job, those after a cursor, numbered within their job."""
    from pyspark.sql import Window

    back = Window.partitionBy(job).orderBy(F.desc(order))
    return events.withColumn("_age", F.row_number().over(back)).filter((F.col("_age") <= kept) & (F.col(order) > after)).drop("_age")


def expired_sessions(events: DataFrame, key: str, *, idle: str = "30 minutes", lateness: str = "10 minutes", time: str = "ts") -> DataFrame:
    """(key, first, n): sessions of a stream that ended as nothing came for `idle`, once the watermark has passed their end."""
    timed = events.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", lateness)
    closed = timed.groupBy(F.session_window("_time", idle).alias("s"), key).agg(F.count("*").alias("n"))
    return closed.select(key, F.col("s.start").alias("first"), "n")
