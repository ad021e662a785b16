"""Queries of sinks: exports of every form, and evaluation runs committed whole."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.plans.registry import query, table
from chronoloom.sources import exports
from chronoloom.sources.runs import RunStore

_CLOCK = "lpad(({0} // 16000 // 3600)::VARCHAR, 2, '0') || ':' || lpad(({0} // 16000 // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({0} // 16000 % 60)::VARCHAR, 2, '0') || '.000'"


@query(
    f"""WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn * 32000 AS a, turn * 32000 + 16000 AS b, role, turn % 4 = 1 AS coarse,
        CASE WHEN turn % 3 = 0 AND trim(coalesce(text, '')) <> '' THEN 'user' WHEN turn % 3 = 1 THEN 'smart' ELSE 'faithful' END AS resolved, CASE WHEN turn % 3 = 0 THEN coalesce(text, '') WHEN turn % 3 = 1 THEN 'smart, ' || coalesce(text, '') ELSE coalesce(text, '') END AS text FROM conversations),
    r AS (SELECT *, {_CLOCK.format("a")} AS ca, {_CLOCK.format("b")} AS cb FROM s),
    f AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY n) || chr(10) AS txt, string_agg('## ' || ca || ' · ' || role || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS md,
        '{",".join(exports.CSV_COLUMNS)}' || chr(10) || string_agg('t' || turn || ',' || a || ',' || b || ',' || ca || ',' || cb || ',' || role || ',en,user,' || resolved || ',' || 'word' || ',' || CASE WHEN coarse THEN 'True' ELSE 'False' END || ',' || CASE WHEN regexp_matches(text, '[",\\r\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, chr(10) ORDER BY n) || chr(10) AS csv,
        to_json({{'records': list({{'coarse_timing': coarse, 'end': cb, 'end_sample': b, 'language': 'en', 'requested_layer': 'user', 'resolved_layer': resolved, 'segment_ids': ['t' || turn], 'speaker': role, 'start': ca, 'start_sample': a, 'text': text, 'timing_quality': 'word'}} ORDER BY n), 'requested_layer': 'user', 'schema_version': 1, 'timeline': 'absolute_int64_samples_at_16000_hz'}})::VARCHAR || chr(10) AS json,
        string_agg(n || chr(10) || replace(ca, '.', ',') || ' --> ' || replace(cb, '.', ',') || chr(10) || CASE WHEN coarse THEN '[粗时间] ' ELSE '' END || text, chr(10) || chr(10) ORDER BY n) AS srt,
        'WEBVTT' || chr(10) || chr(10) || string_agg(ca || ' --> ' || cb || chr(10) || CASE WHEN coarse THEN '[粗时间] ' ELSE '' END || text, chr(10) || chr(10) ORDER BY n) || chr(10) AS vtt FROM r GROUP BY conv_id)
    SELECT conv_id, form, md5(content) AS digest FROM f UNPIVOT (content FOR form IN (txt, md, csv, json, srt, vtt))"""
)
def export_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation in every form, by its users' layer; two of three turns have no text of a user's own."""
    turns, text = table(spark, sf_dir, "conversations"), F.coalesce("text", F.lit(""))
    layer = lambda no, value: F.when(F.col("turn") % 3 == no, value)
    segments = turns.select(
        "conv_id", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("segment_id"), (F.col("turn") * 32_000).alias("start"), (F.col("turn") * 32_000 + 16_000).alias("end"), F.col("role").alias("speaker"), F.lit("en").alias("language"),
        text.alias("faithful"), layer(1, F.concat(F.lit("smart, "), text)).alias("smart"), layer(0, text).alias("user"), F.lit("word").alias("timing_quality"), (F.col("turn") % 4 == 1).alias("coarse_timing"),
    )
    forms = [exports.render_export(segments, "conv_id", f, "user").select("conv_id", F.lit(f).alias("form"), F.md5("content").alias("digest")) for f in exports.FORMS]
    return reduce(DataFrame.unionByName, forms)


@query(
    """WITH i AS (SELECT event_type AS run_id, event_id, value, user_id FROM events), k AS (SELECT run_id, row_number() OVER (ORDER BY run_id) AS no FROM (SELECT DISTINCT run_id FROM i))
    SELECT run_id, CASE WHEN no = 1 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN no = 1 THEN 'out_of_memory' END AS error_code, CASE WHEN no > 1 THEN count(*) ELSE 0 END AS items, CASE WHEN no > 1 THEN round(avg(value), 6) END AS value_mean,
    CASE WHEN no > 1 THEN round(avg(value * 2) FILTER (WHERE user_id % 2 = 0), 6) END AS even_mean, CASE WHEN no > 1 THEN count(DISTINCT user_id) ELSE 0 END AS models FROM i JOIN k USING (run_id) GROUP BY run_id, no"""
)
def persisted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each type of event, the first of which fails; its events are the items. Read back from the committed headers and items."""
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-shared-')}/runs-{uuid.uuid4().hex}"
    store, events = RunStore(spark, root), table(spark, sf_dir, "events")
    kinds = sorted(r["event_type"] for r in events.select("event_type").distinct().collect())  # a few types
    text = lambda c: F.create_map(F.lit("id"), F.col(c).cast("string"))
    metrics = F.map_concat(F.create_map(F.lit("value"), "value"), F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("even"), F.col("value") * 2)).otherwise(F.create_map().cast("map<string,double>")))
    for no, kind in enumerate(kinds):
        store.start(kind, "v1", {"seed": "1"})
        if no == 0:
            store.fail(kind, "out_of_memory")
            continue
        own = events.filter(F.col("event_type") == kind)
        store.complete(kind, "v1", {"hardware": "cpu"}, own.select(F.col("event_id").cast("string").alias("item_id"), F.col("user_id").cast("string").alias("model_id"), F.lit("r1").alias("model_revision"), text("event_id").alias("gold"), text("user_id").alias("prediction"), metrics.alias("metrics")))
    models = store.items().groupBy("run_id").agg(F.count_distinct("model_id").alias("models"))
    told = store.runs().join(models, "run_id", "left")
    return told.select("run_id", "status", "error_code", F.coalesce("items", F.lit(0).cast("long")).alias("items"), F.round(F.col("metrics")["value"], 6).alias("value_mean"), F.round(F.col("metrics")["even"], 6).alias("even_mean"), F.coalesce("models", F.lit(0).cast("long")).alias("models"))
