"""Queries of timed phrases: a turn is a phrase of its conversation, its words timed with jitter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import phrases
from chronoloom.plans.registry import query, table


def turns_as_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text, start, end, timed, words): a word each 400 samples, every 13th a second early; each third turn also has the first two words of the next."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    cut = F.regexp_extract_all("text", F.lit(r"\S+\s*"), F.lit(0))
    told = turns.withColumn("own", cut).withColumn("next", F.coalesce(F.lead("own").over(w), F.array().cast("array<string>"))).withColumn("lost", F.coalesce(F.lag(F.col("turn") % 3 == 0).over(w), F.lit(False)))
    kept = F.when(F.col("lost"), F.slice("own", 3, F.greatest(F.size("own"), F.lit(1)))).otherwise(F.col("own"))
    texts = F.when(F.col("turn") % 3 == 0, F.concat(kept, F.slice("next", 1, 2))).otherwise(kept)
    begin = F.col("turn") * 1_000_000
    at = lambda i: begin + 400 * i.cast("long") - F.when(i % 13 == 7, 16_000).otherwise(0)
    words = F.transform(texts, lambda x, i: F.struct(x.alias("text"), at(i).alias("start"), (at(i) + 390 + F.when(i % 5 == 3, 200).otherwise(0)).alias("end")))
    return told.select("conv_id", "turn", "text", begin.alias("start"), (begin + 400 * (F.size("own") + 2) + 600).alias("end"), (F.col("turn") % 2 == 0).alias("timed"), words.alias("words"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS own FROM conversations),
    l AS (SELECT *, lead(own) OVER w AS nxt, coalesce(lag(turn % 3 = 0) OVER w, FALSE) AS lost, row_number() OVER w AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, len(own) AS words, md5(array_to_string(own, '')) AS digest FROM l"""
)
def returned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that hang on the turn before come back, so that each turn has the words of its text."""
    found = phrases.returned_words(turns_as_phrases(spark, sf_dir), "conv_id", "turn")
    return found.select("conv_id", "turn", F.size("words").cast("long").alias("words"), F.md5(F.array_join(F.transform("words", lambda w: w["text"]), "")).alias("digest"))


@query()
def sentence_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns split at sentence ends, after words have come back, with the times of their first and last words put in order."""
    found = phrases.sentence_phrases(phrases.returned_words(turns_as_phrases(spark, sf_dir), "conv_id", "turn"))
    return found.select("conv_id", "turn", "part", F.md5("text").alias("digest"), "start", "end", F.size("words").alias("words"))
