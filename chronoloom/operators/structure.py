"""Structure of a recording: health of its segments, tokens of a core, pieces of a retry, choices as codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import gates, intervals

#: Names of languages. Fixed values.
LANGUAGES = {"zh": "zh", "chinese": "zh", "中文": "zh", "ja": "ja", "japanese": "ja", "日本語": "ja", "en": "en", "english": "en"}


def language_code(name: Column, more: dict[str, str] | None = None) -> Column:
    """The code of a language's name, null for others."""
    table = F.create_map(*(F.lit(x) for pair in (LANGUAGES | (more or {})).items() for x in pair))
    return F.try_element_at(table, F.lower(F.trim(name)))


def speaker_bounds(choice: Column, most: int) -> Column:
    """A choice of a number of speakers as "least..most"; any other choice as all there may be."""
    bounds = {"1": "1..1", "2": "2..2", "3-4": "3..4", "5+": f"5..{most}"}
    out = F.lit(f"1..{most}")
    for said, meant in bounds.items():
        out = F.when(choice == said, meant).otherwise(out)
    return out


def duplicates(segments: DataFrame, keys: list[str], key: str) -> DataFrame:
    """(keys, duplicates): segments that a later one of the same text overlaps. segments: keys, key, start, end, text."""
    named = segments.filter("text != ''").select(*keys, "text", "start", "end", key)
    pairs = intervals.overlap_join(named, named, [*keys, "text"])
    later = F.struct("r_start", "r_end", f"r_{key}") > F.struct("l_start", "l_end", f"l_{key}")
    return pairs.filter(later).select(*keys, f"l_{key}").distinct().groupBy(*keys).agg(F.count("*").alias("duplicates"))


def health(segments: DataFrame, speech: DataFrame, keys: list[str], key: str) -> DataFrame:
    """Per keys: speech, covered, coverage (1 without speech), segments, speakers, duplicates, empty. segments: keys, key, start, end, speaker, text, empty."""
    every = segments.select(*keys).unionByName(speech.filter("end > start").select(*keys)).distinct()
    counts = segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.countDistinct("speaker").alias("speakers"), F.count_if("empty").alias("empty"))
    parts = [intervals.union_length(speech, keys, "speech"), intervals.intersection_length(segments, speech, keys, "covered"), counts, duplicates(segments, keys, key)]
    for part in parts:
        every = every.join(part, keys, "left")
    names = ["speech", "covered", "segments", "speakers", "duplicates", "empty"]
    out = every.select(*keys, *(F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in names))
    return out.withColumn("coverage", F.round(F.when(F.col("speech") > 0, F.col("covered") / F.col("speech")).otherwise(1.0), 6))


def with_anomalies(told: DataFrame, *, most_speakers: int, unit: int) -> DataFrame:
    """told with `anomalies`: what calls for a fallback; unit: a second in units of the timeline."""
    some = F.col("segments") > 0
    return told.withColumn(
        "anomalies",
        gates.found(
            {
                "speech_without_segments": (F.col("speech") >= 2 * unit) & ~some,
                "low_coverage": (F.col("speech") >= 5 * unit) & (F.col("coverage") < 0.35),
                "excess_speakers": F.col("speakers") > most_speakers,
                "duplicates": some & (F.col("duplicates") > 0.25 * F.col("segments")),
                "mostly_empty": some & (F.col("empty") >= 0.8 * F.col("segments")),
            }
        ),
    )


def core_tokens(tokens: Column, start: Column, end: Column) -> Column:
    """Tokens (word, s, e) whose middle lies in [start, end), clipped to it."""
    inside = F.filter(tokens, lambda t: (F.floor((t["s"] + t["e"]) / 2) >= start) & (F.floor((t["s"] + t["e"]) / 2) < end) & (t["s"] < end) & (t["e"] > start))
    return F.transform(inside, lambda t: F.struct(t["word"].alias("word"), F.greatest(t["s"], start).alias("s"), F.least(t["e"], end).alias("e")))


def merge_pieces(pieces: DataFrame, keys: list[str], order: str, text: str, tokens: Column, confidence: Column) -> DataFrame:
    """Per keys the texts that aren't blank joined in order, tokens added, their peak, the mean known confidence; how many pieces, first and last."""
    own = pieces.select(*keys, F.col(order).alias("order__"), F.trim(text).alias("text__"), tokens.alias("tokens__"), confidence.alias("confidence__"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text__") != "", F.struct("order__", "text__")))), lambda t: t["text__"]), " ")
    return own.groupBy(*keys).agg(
        F.nullif(joined, F.lit("")).alias("text"), F.sum("tokens__").alias("tokens"), F.max("tokens__").alias("peak"), F.avg("confidence__").alias("confidence"), F.count("*").alias("pieces"), F.min("order__").alias("first"), F.max("order__").alias("last")
    )


def stability(tokens: Column, final: Column, unstable: int = 2) -> Column:
    """Tokens with whether they are stable: all of a final result, of another all but the last ones."""
    return F.transform(tokens, lambda t, i: F.struct(t.alias("token"), (final | (i < F.size(tokens) - unstable)).alias("stable")))
