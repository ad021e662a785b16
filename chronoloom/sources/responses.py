"""Scans of JSON responses of recognisers: phrases in milliseconds, segments in samples, and what makes a response valid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = """struct<phrases:array<struct<text:string,offsetMilliseconds:double,durationMilliseconds:double,locale:string,speaker:string,
words:array<struct<text:string,offsetMilliseconds:double,durationMilliseconds:double>>>>,combinedPhrases:array<struct<text:string>>>"""
SEGMENTS = "struct<model:string,segments:array<struct<start:bigint,end:bigint,text:string,speaker:string,confidence:double,words:array<struct<text:string,start:bigint,end:bigint>>>>>"
#: Samples in a millisecond; score of a segment without one of its own, with and without text. Fixed values.
PER_MS, SCORED, UNSCORED = 16, 0.55, 0.35


def _span(item: Column, duration: Column) -> Column:
    """The samples of an item, null unless they are a span inside the duration; halves round to even."""
    left = F.bround(item["offsetMilliseconds"] * PER_MS).cast("long")
    right = F.least(duration, F.bround((item["offsetMilliseconds"] + item["durationMilliseconds"]) * PER_MS).cast("long"))
    fits = (item["offsetMilliseconds"] >= 0) & (item["durationMilliseconds"] >= 0) & (left < right)
    return F.when(fits, F.struct(left.alias("start"), right.alias("end")))


def phrases(df: DataFrame, payload: str, duration: Column, language: Column) -> DataFrame:
    """A row per phrase with text: df's other columns, no, text, start, end, timed, language, speaker, words (those with valid spans).

    A phrase without a valid span is kept untimed, at 0; a locale that isn't known gives way to the language. A response
    whose phrases have no text gives its combined ones as one untimed phrase.
    """
    others = [c for c in df.columns if c != payload]
    read = df.select(*others, duration.alias("duration__"), language.alias("language__"), F.from_json(payload, PHRASES).alias("r__"))
    spoken = F.filter("r__.phrases", lambda p: F.trim(p["text"]) != "")
    words = lambda p: F.filter(F.transform(p["words"], lambda w: F.struct(w["text"].alias("text"), _span(w, F.col("duration__")).alias("span"))), lambda w: w["span"].isNotNull())

    def one(p: Column) -> Column:
        span, locale = _span(p, F.col("duration__")), F.split_part(p["locale"], F.lit("-"), F.lit(1))
        known = F.when(locale.isin("ja", "zh", "en"), locale).otherwise(F.when(F.col("language__").isin("ja", "zh", "en"), F.col("language__")).otherwise("auto_mixed"))
        zero = F.lit(0).cast("long")
        return F.struct(
            F.trim(p["text"]).alias("text"), F.coalesce(span["start"], zero).alias("start"), F.coalesce(span["end"], zero).alias("end"), span.isNotNull().alias("timed"), known.alias("language"),
            p["speaker"].alias("speaker"), F.coalesce(words(p), F.array()).alias("words"),
        )

    whole = F.trim(F.array_join(F.transform("r__.combinedPhrases", lambda p: p["text"]), "\n"))
    lone = F.struct(whole.alias("text"), F.lit(None).cast("double").alias("offsetMilliseconds"), F.lit(None).cast("double").alias("durationMilliseconds"), F.col("language__").alias("locale"), F.lit(None).cast("string").alias("speaker"))
    lone = F.struct(*(lone[c].alias(c) for c in ("text", "offsetMilliseconds", "durationMilliseconds", "locale", "speaker")), F.array().cast("array<struct<text:string,offsetMilliseconds:double,durationMilliseconds:double>>").alias("words"))
    all_ = F.when(F.size(spoken) > 0, spoken).when(whole != "", F.array(lone))
    return read.select(*others, F.posexplode(F.transform(all_, one)).alias("no", "p__")).select(*others, "no", "p__.*")


def with_segments(df: DataFrame, payload: str, name: str = "response") -> DataFrame:
    """df with the parsed response in place of its payload."""
    return df.withColumn(name, F.from_json(payload, SEGMENTS)).drop(payload)


def response_faults(response: Column, model: Column, start: Column, end: Column, text: Column) -> Column:
    """What makes a response invalid: another model; no segments; segments out of the window or order, or without speaker; words out of their segment or order; for an alignment, not one segment of the whole span with the text unchanged."""
    parts = response["segments"]
    ordered = lambda xs: F.forall(F.zip_with(xs, F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), lambda a, b: b.isNull() | (b["start"] >= a["start"])), lambda x: F.coalesce(x, F.lit(True)))
    words = F.flatten(F.transform(parts, lambda s: F.transform(s["words"], lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), (w["start"] >= s["start"]).alias("after"), (w["end"] <= s["end"]).alias("before")))))
    one = F.get(parts, 0)
    rules = {
        "model": ~response["model"].eqNullSafe(model),
        "empty": F.size(parts) <= 0,
        "window": ~F.forall(parts, lambda s: (s["start"] >= start) & (s["end"] <= end) & (s["start"] < s["end"])),
        "order": ~ordered(parts),
        "speaker": F.exists(parts, lambda s: s["speaker"].isNull()),
        "words": ~F.forall(words, lambda w: w["after"] & w["before"] & (w["start"] < w["end"])) | ~ordered(words),
        "alignment": ~((F.size(parts) == 1) & (one["start"] == start) & (one["end"] == end) & one["text"].eqNullSafe(text)),
    }
    return F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(True)), F.lit(n)) for n, rule in rules.items())))


def segment_scores(response: Column) -> Column:
    """Each segment's confidence, or what it counts without one."""
    return F.transform(response["segments"], lambda s: F.coalesce(s["confidence"], F.when(F.trim(s["text"]) != "", SCORED).otherwise(UNSCORED)))


def shifted_segments(response: Column, offset: Column) -> Column:
    """Segments and their words moved from local to absolute samples."""
    word = lambda w: w.withField("start", w["start"] + offset).withField("end", w["end"] + offset)
    return F.transform(response["segments"], lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset).withField("words", F.transform(s["words"], word)))
