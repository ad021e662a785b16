"""Queries of scans with contract checks, and of small functions that other queries don't show."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import scores
from chronoloom.functions import text as texts
from chronoloom.operators import intervals, stitching
from chronoloom.plans.interval_queries import SPANS, spans
from chronoloom.plans.registry import query, table
from chronoloom.sources import gold

_KANA = "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097)))


def written(spark: SparkSession, df: DataFrame) -> str:
    """A folder of JSON lines in the shared folder."""
    root = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='spark-shared-')}/scan-{uuid.uuid4().hex}"
    df.write.json(root)
    return root


@query(
    """WITH g AS (SELECT 'i' || event_id AS item_id, 'a' || user_id AS audio, CASE WHEN user_id % 9 = 0 AND event_id % 2 = 0 THEN 'test' ELSE 'train' END AS split, event_id * 100 AS a, event_id * 100 + floor(value)::BIGINT AS b, CASE WHEN event_id % 11 = 0 THEN '' ELSE event_type END AS text, event_id % 22 = 0 AS silent FROM events),
    d AS (SELECT * FROM g UNION ALL SELECT * FROM g WHERE a % 9700 = 0),
    f AS (SELECT 'repeated id' AS fault FROM d GROUP BY item_id HAVING count(*) > 1 UNION ALL SELECT 'audio in several splits' FROM d WHERE audio IN (SELECT audio FROM d GROUP BY audio HAVING count(DISTINCT split) > 1)
        UNION ALL SELECT 'span out of order' FROM d WHERE NOT a < b UNION ALL SELECT 'empty text' FROM d WHERE text = '' AND NOT silent)
    SELECT fault, count(*) AS items FROM f GROUP BY fault"""
)
def gold_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as gold items, written as JSON lines, scanned and checked."""
    events = table(spark, sf_dir, "events")
    start = F.col("event_id") * 100
    items = events.select(
        F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("item_id"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("audio"),
        F.when((F.col("user_id") % 9 == 0) & (F.col("event_id") % 2 == 0), "test").otherwise("train").alias("split"), start.alias("start_sample"), (start + F.floor("value")).alias("end_sample"),
        F.when(F.col("event_id") % 11 == 0, "").otherwise(F.col("event_type")).alias("text"), F.when(F.col("event_id") % 22 == 0, F.array(F.lit("silence"))).alias("tags"),
    )
    path = written(spark, items.unionByName(items.filter("start_sample % 9700 = 0")))
    return gold.gold_faults(gold.read_gold(spark, path)).groupBy("fault").agg(F.count("*").alias("items"))


@query(
    """WITH p AS (SELECT event_id // 2 AS i, event_type AS m, CASE WHEN event_id % 7 = 0 THEN 'main' WHEN event_id % 13 = 0 THEN upper(md5(event_type)) || 'ABCDEFAB' ELSE md5(event_type) || '01234567' END AS r FROM events)
    SELECT fault, count(*) AS items FROM (SELECT 'repeated' AS fault FROM p GROUP BY i, m, r HAVING count(*) > 1 UNION ALL SELECT 'revision' FROM p WHERE NOT regexp_matches(r, '^[0-9a-f]{40}$')) GROUP BY fault"""
)
def prediction_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as predictions, written as JSON lines, scanned and checked."""
    revision = F.when(F.col("event_id") % 7 == 0, "main").when(F.col("event_id") % 13 == 0, F.concat(F.upper(F.md5("event_type")), F.lit("ABCDEFAB"))).otherwise(F.concat(F.md5("event_type"), F.lit("01234567")))
    items = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 2).cast("string").alias("item_id"), F.col("event_type").alias("model_id"), revision.alias("model_revision"), F.lit("x").alias("text"))
    return gold.prediction_faults(gold.read_predictions(spark, written(spark, items))).groupBy("fault").agg(F.count("*").alias("items"))


@query(
    SPANS
    + """, cuts AS (SELECT user_id, s AS cut FROM ok UNION SELECT user_id, e FROM ok), atoms AS (SELECT user_id, cut AS s, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS e FROM cuts)
    SELECT a.user_id, a.s AS start_s, a.e AS end_s, string_agg(DISTINCT o.event_type, '+' ORDER BY o.event_type) AS labels FROM atoms a JOIN ok o ON a.user_id = o.user_id AND o.s < a.e AND o.e > a.s GROUP BY ALL HAVING count(DISTINCT o.event_type) >= 2"""
)
def concurrent_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans with two labels or more, cut wherever any span begins or ends."""
    found = intervals.concurrent(spans(spark, sf_dir), ["user_id"], "event_type", merged=False)
    return found.select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), F.array_join("labels", "+").alias("labels"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM conversations WHERE text IS NOT NULL), p AS (SELECT *, list_concat([translate(x, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') for x in w[greatest(len(w) - turn % 5, 0) + 1 :]], w[1 : 3]) AS v FROM t)
    SELECT conv_id, turn, list_max([n for n in range(0, least(len(w), len(v), 64) + 1) if n = 0 OR [lower(x) for x in w[len(w) - n + 1 :]] = [lower(x) for x in v[1 : n]]])::INTEGER AS shared FROM p"""
)
def suffix_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words at the end of a turn begin what follows: up to four of them in capitals, then its first three."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w"))
    last = F.least(F.col("turn") % 5, F.size("w")).cast("int")
    following = F.concat(F.transform(F.slice("w", F.size("w") - last + 1, last), lambda x: F.translate(x, string.ascii_lowercase, string.ascii_uppercase)), F.slice("w", 1, 3))
    return turns.select("conv_id", "turn", stitching.suffix_overlap(F.col("w"), following).alias("shared"))


@query(f"SELECT doc_id, md5(translate(translate(text, 'aeiou', 'アエイオウ'), '{_KANA[0]}', '{_KANA[1]}')) AS folded FROM documents")
def folded_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose vowels are written in Katakana, folded to Hiragana."""
    written_so = F.translate("text", "aeiou", "アエイオウ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(texts.fold_kana(written_so)).alias("folded"))


@query("SELECT event_id, round(CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END, 9) AS sigmoid, round(greatest(0, least(1, x / 10)), 9) AS clamped FROM (SELECT event_id, (value - 20)::DOUBLE AS x FROM events)")
def score_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the sigmoid, and clamped to a share."""
    x = F.col("value") - 20
    return table(spark, sf_dir, "events").select("event_id", F.round(scores.sigmoid(x), 9).alias("sigmoid"), F.round(scores.clamp(x / 10), 9).alias("clamped"))
