"""Queries of ordered folds and of streams: events of a user stand for frames, observations and cues."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators import intervals, stitching
from chronoloom.plans.interval_queries import ISLANDS, SPANS, spans
from chronoloom.plans.registry import query, table
from chronoloom.streaming import sessions


@query(
    SPANS
    + """, voiced AS (SELECT * FROM ok WHERE value >= 20), a AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 900 THEN 0 ELSE 1 END AS fresh FROM voiced),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM a), c AS (SELECT user_id, greatest(0, min(s) - 60) AS s, max(e) + 60 AS e, max(value) AS value FROM b GROUP BY user_id, run HAVING max(e) - min(s) >= 600)"""
    + ISLANDS.format(k="user_id", t="c")
    + """ SELECT user_id, s AS "start", e AS "end", value AS score FROM islands"""
)
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of loud frames that the stream's fold gives, from a batch: merged by slices, not folded key by key."""
    frames = spans(spark, sf_dir).withColumnRenamed("value", "score")
    return intervals.sessions(frames, ["user_id"], active=F.col("score") >= 20, silence=900, least=600, pad=60).select("user_id", "start", "end", "score")


def streamed(spark: SparkSession, sf_dir: str, name: str, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a streaming operator gives over all rows of a table, read as a stream; the output lies in the shared folder."""
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-shared-')}/stream-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, name).schema
    out = operator(spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]"))  # a pattern fits a file and a folder
    run = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query(
    """SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
    WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL"""
)
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts from a stream of the events table; windows that the watermark has passed at its end."""
    found = streamed(spark, sf_dir, "events", sessions.windowed_counts)
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS run FROM m)
    SELECT user_id, min(ts) AS first, count(*) AS n FROM r GROUP BY user_id, run HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def expired_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user in a stream of events that ended for want of events."""
    found = streamed(spark, sf_dir, "events", lambda events: sessions.expired_sessions(events, "user_id"))
    return found.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


@query(
    SPANS
    + """, o AS (SELECT user_id, s AS "start", event_type AS label, least(1.0, value / 20) AS confidence FROM spans), p AS (SELECT *, lag(label) OVER w AS bl, lag(confidence) OVER w AS bc, sum(CASE WHEN confidence >= 0.6 THEN 1 ELSE 0 END) OVER (w ROWS UNBOUNDED PRECEDING) AS sures FROM o WINDOW w AS (PARTITION BY user_id ORDER BY "start", label, confidence)),
    d AS (SELECT *, CASE WHEN confidence >= 0.6 AND (sures = 1 OR bl = label AND bc >= 0.6) THEN label END AS decided FROM p)
    SELECT user_id, "start", label, confidence, coalesce(last_value(decided IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY "start", label, confidence ROWS UNBOUNDED PRECEDING), '') AS route FROM d"""
)
def label_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as language observations; a change needs two sure ones in a row."""
    seen = spans(spark, sf_dir).select("user_id", "start", F.col("event_type").alias("label"), F.least(F.lit(1.0), F.col("value") / 20).alias("confidence"))
    return stitching.routed(seen, "user_id")


@query()
def cue_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's time cut at events, errors first."""
    found = spans(spark, sf_dir).filter("end > start")
    first = found.groupBy("user_id").agg(F.min("start").alias("first"), (F.max("end") - F.min("start")).alias("total"))
    cues = found.join(first, "user_id").select("user_id", (F.col("end") - F.col("first")).alias("sample"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("priority"), F.col("value").alias("confidence"))
    return stitching.chunks(cues, first.select("user_id", "total"), "user_id", target=86_400, least=43_200, most=129_600)


@query()
def speaker_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in windows of 20, their labels as local speakers of a recording of 200."""
    found = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 200).alias("recording"), F.floor(F.col("vec_id") % 200 / 20).alias("window"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("vector")
    )
    cells = found.select("recording", "window", "label", F.posexplode("vector").alias("dim", "v"))
    mean = cells.groupBy("recording", "window", "label", "dim").agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    gathered = F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"])
    local = mean.groupBy("recording", "window", "label").agg(gathered.alias("vector"), F.max("n").cast("double").alias("weight"))
    return stitching.track_speakers(local, "recording").withColumn("score", F.round("score", 6))


@query("SELECT conv_id, count(*) AS segments, sum(length(text))::BIGINT AS chars FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id")
def window_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments of windows that overlap; a turn is in two of them."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").filter("text is not null")
    twice = turns.withColumn("window", F.explode(F.array(F.col("turn"), F.col("turn") + 1)))
    seen = twice.select("conv_id", "window", (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 900).alias("end"), "text", F.lit(0.5).alias("score"))
    return stitching.drop_window_duplicates(seen, "conv_id").groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"))


@query(
    """SELECT conv_id, sum(CASE WHEN length(text) < 4 THEN 2 ELSE 1 END)::BIGINT AS segments, sum(length(text) + 1 + CASE WHEN length(text) < 4 THEN length(text) ELSE 0 END)::BIGINT AS chars
    FROM (SELECT DISTINCT conv_id, turn, text FROM conversations WHERE text IS NOT NULL) GROUP BY conv_id"""
)
def window_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in two windows, the second of which heard a letter more: texts of four letters are alike enough to be one, and the longer reading stays."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").filter("text is not null")
    copies = F.array(F.struct(F.col("turn").alias("window"), F.col("text").alias("said")), F.struct((F.col("turn") + 1).alias("window"), F.concat("text", F.lit("!")).alias("said")))
    twice = turns.withColumn("copy", F.explode(copies)).select("conv_id", "turn", "copy.window", F.col("copy.said").alias("text"))
    seen = twice.select("conv_id", "window", (F.col("turn") * 1000).alias("start"), (F.col("turn") * 1000 + 900).alias("end"), "text", F.lit(0.5).alias("score"))
    return stitching.drop_window_duplicates(seen, "conv_id").groupBy("conv_id").agg(F.count("*").alias("segments"), F.sum(F.length("text")).alias("chars"))


@query(
    SPANS
    + """ SELECT user_id, event_id, s, e, max(value) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_peak,
    round(avg(value) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS recent_mean FROM spans"""
)
def rolling_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    last = Window.partitionBy("user_id").orderBy("start", "event_id").rowsBetween(-2, 0)
    found = spans(spark, sf_dir)
    return found.select("user_id", "event_id", F.col("start").alias("s"), F.col("end").alias("e"), F.max("value").over(last).alias("recent_peak"), F.round(F.avg("value").over(last), 6).alias("recent_mean"))


@query(
    """WITH f AS (SELECT user_id, event_id // 40 AS frame, value - 0.3 AS x, row_number() OVER (PARTITION BY user_id, event_id // 40 ORDER BY event_id) AS n, lag(value - 0.3) OVER (PARTITION BY user_id, event_id // 40 ORDER BY event_id) AS before FROM events)
    SELECT user_id, frame, count(*) AS samples, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS offset_mean, count(*) FILTER (WHERE abs(x) >= 0.65) AS clipped, count(*) FILTER (WHERE x * before < 0) AS crossings FROM f GROUP BY user_id, frame"""
)
def signal_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, level, offset, clipping and zero crossings of framed values."""
    from pyspark.sql import Window

    framed = table(spark, sf_dir, "events").select("user_id", "event_id", F.floor(F.col("event_id") / 40).alias("frame"), (F.col("value") - 0.3).alias("x"))
    order = Window.partitionBy("user_id", "frame").orderBy("event_id")
    marked = framed.withColumn("before", F.lag("x").over(order))
    return marked.groupBy("user_id", "frame").agg(
        F.count("*").alias("samples"), F.round(F.max(F.abs("x")), 6).alias("peak"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.round(F.avg("x"), 6).alias("offset_mean"),
        F.count_if(F.abs("x") >= 0.65).alias("clipped"), F.count_if(F.col("x") * F.col("before") < 0).alias("crossings"),
    )
