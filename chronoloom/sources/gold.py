"""Scans with fixed schemas: gold and prediction items as JSON lines, course terms as CSV, plain materials."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import ship

WORD = "array<struct<text:string,start_sample:bigint,end_sample:bigint,speaker:string>>"
SPEAKER = "array<struct<speaker:string,start_sample:bigint,end_sample:bigint>>"
GOLD = (
    f"item_id string, audio string, scenario string, split string, language string, start_sample bigint, end_sample bigint, text string, speaker string, terms array<string>, "
    f"term_vocabulary array<string>, tags array<string>, entities map<string,array<string>>, words {WORD}, sentence_boundaries array<bigint>, speaker_spans {SPEAKER}, voiced_spans array<array<bigint>>"
)
PREDICTION = (
    f"item_id string, model_id string, model_revision string, text string, confidence double, quality_features array<double>, words {WORD}, sentence_boundaries array<bigint>, speaker_spans {SPEAKER}, "
    "voiced_spans array<array<bigint>>, runtime_seconds double, load_seconds double, peak_vram_mb double, peak_ram_mb double, interim_latency_ms double, commit_latency_ms double, "
    "preemption_resume_ms double, cross_window_speakers array<string>, provenance_coverage double"
)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold items; a line that doesn't parse fails the scan."""
    return spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PREDICTION).option("mode", "FAILFAST").json(path)


def gold_faults(gold: DataFrame) -> DataFrame:
    """(item_id, fault): repeated ids, audio in several splits, spans that aren't ordered, empty text without the silence tag."""
    repeated = gold.groupBy("item_id").count().filter("count > 1").select("item_id", F.lit("repeated id").alias("fault"))
    leaks = gold.groupBy("audio").agg(F.count_distinct("split").alias("n")).filter("n > 1").select("audio")
    leaked = gold.join(leaks, "audio", "left_semi").select("item_id", F.lit("audio in several splits").alias("fault"))
    order = gold.filter("not (0 <= start_sample and start_sample < end_sample)").select("item_id", F.lit("span out of order").alias("fault"))
    silent = gold.filter("text = '' and not coalesce(array_contains(tags, 'silence'), false)").select("item_id", F.lit("empty text").alias("fault"))
    return repeated.unionByName(leaked).unionByName(order).unionByName(silent)


def prediction_faults(predictions: DataFrame) -> DataFrame:
    """(item_id, fault): repeated (item, model, revision), and revisions that aren't 40 hex digits."""
    repeated = predictions.groupBy("item_id", "model_id", "model_revision").count().filter("count > 1").select("item_id", F.lit("repeated").alias("fault"))
    return repeated.unionByName(predictions.filter("not model_revision rlike '^[0-9a-f]{40}$'").select("item_id", F.lit("revision").alias("fault")))


def read_terms(spark: SparkSession, path: str, language: str) -> DataFrame:
    """Course terms from CSV with a header: reading defaults to the term, aliases split at | or ;, unconfirmed weights are at most 0.3."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    if "canonical" not in [c.lstrip("﻿") for c in raw.columns]:
        raise ValueError("the header lacks canonical")
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    col = lambda name: F.col(name) if name in raw.columns else F.lit(None).cast("string")
    confirmed = F.lower(F.coalesce(col("confirmation"), F.lit(""))).isin("confirmed", "true", "1", "yes")
    weight = F.try_to_number(col("weight"), F.lit("9.999")).cast("double") if "weight" in raw.columns else F.lit(None).cast("double")
    return raw.filter(F.trim("canonical") != "").select(
        F.trim("canonical").alias("canonical"),
        F.coalesce(F.nullif(F.trim(col("reading")), F.lit("")), F.trim("canonical")).alias("reading"),
        F.filter(F.transform(F.split(F.coalesce(col("aliases"), F.lit("")), "[;|]"), lambda a: F.trim(a)), lambda a: a != "").alias("aliases"),
        F.coalesce(col("language"), F.lit(language)).alias("language"),
        F.when(confirmed, F.coalesce(weight, F.lit(1.0))).otherwise(F.least(F.lit(0.3), F.coalesce(weight, F.lit(0.2)))).alias("weight"),
        confirmed.alias("confirmed"),
    )


def read_material(spark: SparkSession, path: str, most: int = 2_000_000) -> DataFrame:
    """(path, text): whole text files, each cut to `most` characters."""
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.substring("value", 1, most).alias("text"))


def _slide_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, content in batch.itertuples(index=False):
            try:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = sorted(n for n in archive.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml"))
                    texts = [node.text for n in names for node in ElementTree.fromstring(archive.read(n)).iter() if node.tag.endswith("}t") and node.text]
                rows.append((path, "\n".join(texts), None))
            except (zipfile.BadZipFile, ElementTree.ParseError) as e:
                rows.append((path, "", f"unreadable: {e}"))
        yield pd.DataFrame(rows, columns=["path", "text", "fault"])


def read_slides(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, fault) of presentations: the text nodes of their slides, one a line, slides in order of their files' names.

    A file that isn't a presentation has the empty text and a fault. Files are read by Spark and opened in its tasks.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_slide_texts, "path string, text string, fault string")
