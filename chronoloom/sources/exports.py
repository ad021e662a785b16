"""Renderings of timed records: plain text, Markdown, CSV columns, SubRip and WebVTT, one content per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.timeline import clock


def _joined(df: DataFrame, key: str, order: str, part: Column, separator: str, head: str = "", tail: str = "") -> DataFrame:
    """The parts of each key in order, as one content."""
    gathered = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("p")))).alias("_parts"))
    body = F.array_join(F.transform("_parts", lambda x: x["p"]), separator)
    return gathered.select(key, F.concat(F.lit(head), body, F.lit(tail)).alias("content"))


def render_text(df: DataFrame, key: str, order: str = "n") -> DataFrame:
    """Texts with a blank line between them and a line end after the last."""
    return _joined(df, key, order, F.col("text"), "\n\n", tail="\n")


def render_markdown(df: DataFrame, key: str, order: str = "n") -> DataFrame:
    """A section per record, headed by its start and speaker."""
    head = F.concat(F.lit("## "), clock(F.col("start")), F.when(F.col("speaker").isNotNull(), F.concat(F.lit(" · "), "speaker")).otherwise(""))
    return _joined(df, key, order, F.concat(head, F.lit("\n\n"), "text"), "\n\n", tail="\n")


def render_srt(df: DataFrame, key: str, order: str = "n") -> DataFrame:
    """Numbered cues with commas before the milliseconds."""
    time = lambda c: F.translate(clock(F.col(c)), ".", ",")
    cue = F.concat(F.col(order).cast("string"), F.lit("\n"), time("start"), F.lit(" --> "), time("end"), F.lit("\n"), "text")
    return _joined(df, key, order, cue, "\n\n")


def render_vtt(df: DataFrame, key: str, order: str = "n") -> DataFrame:
    cue = F.concat(clock(F.col("start")), F.lit(" --> "), clock(F.col("end")), F.lit("\n"), "text")
    return _joined(df, key, order, cue, "\n\n", head="WEBVTT\n\n", tail="\n")


def write_csv(df: DataFrame, path: str) -> None:
    """Records as CSV with a header; arrays are joined by a pipe."""
    flat = [F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.option("header", True).option("lineSep", "\n").csv(path)


#: Columns of an export as CSV. Fixed values.
CSV_COLUMNS = ["segment_ids", "start_sample", "end_sample", "start", "end", "speaker", "language", "requested_layer", "resolved_layer", "timing_quality", "coarse_timing", "text"]
#: Texts that each layer falls back to, in order; a blank user text counts as none.
LAYERS = {"faithful": ["faithful"], "smart": ["smart", "faithful"], "user": ["user", "smart", "faithful"]}


def _field(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(F.regexp_like(text, F.lit('[",\\r\\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def render_csv(df: DataFrame, key: str, order: str = "n") -> DataFrame:
    """Records with CSV_COLUMNS as one CSV content, ids joined by a pipe, lines ended by \\n; fields are quoted where they must be."""
    shown = [F.array_join(c, "|") if c == "segment_ids" else F.initcap(F.col(c).cast("string")) if c == "coarse_timing" else F.col(c) for c in CSV_COLUMNS]
    line = F.array_join(F.array(*(_field(c) for c in shown)), ",")
    return _joined(df, key, order, line, "\n", head=",".join(CSV_COLUMNS) + "\n", tail="\n")


def render_json(df: DataFrame, key: str, order: str = "n") -> DataFrame:
    """Records as one JSON document with its schema's version and timeline."""
    record = F.struct(*(F.col(c) for c in sorted(CSV_COLUMNS)))
    told = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), record.alias("r")))).alias("all"), F.first("requested_layer").alias("layer"))
    document = F.struct(F.transform("all", lambda x: x["r"]).alias("records"), F.col("layer").alias("requested_layer"), F.lit(1).alias("schema_version"), F.lit("absolute_int64_samples_at_16000_hz").alias("timeline"))
    return told.select(key, F.concat(F.to_json(document, {"ignoreNullFields": "false"}), F.lit("\n")).alias("content"))


def records(segments: DataFrame, key: str, layer: str) -> DataFrame:
    """Records of segments (key, segment_id, start, end, speaker, language, faithful, smart, user, timing_quality, coarse_timing), numbered by start and id.

    The text is that of the layer or, where it is blank, of the next that it falls back to; the last one's counts even if blank.
    """
    names = LAYERS[layer]
    some = lambda c: F.when(F.trim(F.col(c)) != "", F.col(c)) if c == "user" else F.when(F.col(c) != "", F.col(c))
    text = F.coalesce(*(some(c) for c in names), F.lit(""))
    resolved = F.coalesce(*(F.when(some(c).isNotNull(), c) for c in names), F.lit(names[-1]))
    number = F.row_number().over(Window.partitionBy(key).orderBy("start", "segment_id"))
    return segments.select(
        key, number.alias("n"), F.array(F.col("segment_id").cast("string")).alias("segment_ids"), F.col("start").alias("start_sample"), F.col("end").alias("end_sample"), clock(F.col("start")).alias("start"), clock(F.col("end")).alias("end"),
        "speaker", "language", F.lit(layer).alias("requested_layer"), resolved.alias("resolved_layer"), "timing_quality", "coarse_timing", text.alias("text"),
    )


def render_export(segments: DataFrame, key: str, form: str, layer: str) -> DataFrame:
    """(key, content) of segments in one form: txt, md, csv, json, srt or vtt; coarse times are marked in cues.

    Segments are ordered by start and id whatever order they come in; a window numbers those of one recording. An unknown form or layer is an error.
    """
    if form not in FORMS or layer not in LAYERS:
        raise ValueError(f"no export of form {form} and layer {layer}")
    told = records(segments, key, layer)
    if form in ("csv", "json", "txt"):
        return {"csv": render_csv, "json": render_json, "txt": render_text}[form](told, key)
    cues = told.withColumns({"start": F.col("start_sample"), "end": F.col("end_sample")})
    if form == "md":
        return render_markdown(cues, key)
    marked = cues.withColumn("text", F.when(F.col("coarse_timing"), F.concat(F.lit("[粗时间] "), "text")).otherwise(F.col("text")))
    return {"srt": render_srt, "vtt": render_vtt}[form](marked, key)


FORMS = ("txt", "md", "csv", "json", "srt", "vtt")
