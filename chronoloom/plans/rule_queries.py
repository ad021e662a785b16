"""Queries of rules and gates, over documents as candidates, events as words in time, and turns as responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as texts
from chronoloom.operators import evaluation, gates, intervals, lineage, neighbours, structure
from chronoloom.plans.interval_queries import ISLANDS, SPANS, of_type, spans
from chronoloom.plans.registry import query, table
from chronoloom.sources import responses

SIGNALS = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, n_chars, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE length(coalesce(text, '')) / 12.0 END::DOUBLE AS voiced, (doc_id % 100) / 100.0::DOUBLE AS speech, (doc_id % 31)::DOUBLE AS snr,
    doc_id % 17 = 0 AS far, CASE WHEN doc_id % 4 > 0 THEN (doc_id % 10) / 10.0::DOUBLE END AS quiet, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 20) / 20.0::DOUBLE END AS calibrated, regexp_replace(coalesce(text, ''), '[\s\p{Z}]', '', 'g') AS v FROM documents),
 i AS (SELECT *, list_filter([
    CASE WHEN contains(text, chr(65533)) THEN 'unicode_replacement_character' END, CASE WHEN contains(text, '??') THEN 'consecutive_question_placeholders' END,
    CASE WHEN len(regexp_extract_all(text, '\p{Cc}')) > len(regexp_extract_all(text, '[\n\t]')) THEN 'illegal_control_character' END,
    CASE WHEN lang = 'en' AND len(regexp_extract_all(text, '\p{L}')) - len(regexp_extract_all(text, '\p{Latin}')) > 0.2 * len(regexp_extract_all(text, '\p{L}')) THEN 'manual_language_script_mismatch' END,
    CASE WHEN length(v) >= 8 AND len(regexp_extract_all(v, '[.,!?;:。、！？；：「」『』（）()\[\]{}“”‘’"]')) / greatest(length(v), 1)::DOUBLE > 0.35 THEN 'abnormal_punctuation_density' END,
    CASE WHEN len(regexp_extract_all(text, '\(')) <> len(regexp_extract_all(text, '\)')) OR len(regexp_extract_all(text, '\[')) <> len(regexp_extract_all(text, '\]')) OR len(regexp_extract_all(text, '\{')) <> len(regexp_extract_all(text, '\}'))
        OR len(regexp_extract_all(text, '（')) <> len(regexp_extract_all(text, '）')) OR len(regexp_extract_all(text, '「')) <> len(regexp_extract_all(text, '」')) OR len(regexp_extract_all(text, '『')) <> len(regexp_extract_all(text, '』')) THEN 'unpaired_parenthesis_or_quote' END,
    CASE WHEN length(v) >= 12 AND NOT regexp_matches(v, '[.!?。！？]$') THEN 'missing_sentence_end_punctuation' END,
    CASE WHEN regexp_matches(text, '(?i)(?:\d{8,}|(?:\b(?:kg|mg|ml|km|cm|mm|hz|khz|mhz|gb|mb)\b\s*){3,})') THEN 'numeric_or_unit_anomaly' END,
    CASE WHEN voiced >= 4 AND text <> '' AND length(v) / greatest(voiced, 0.1) < 0.25 THEN 'text_length_and_voiced_duration_mismatch' END,
    CASE WHEN voiced >= 1 AND length(v) = 0 THEN 'empty_text_while_speech_present' END, CASE WHEN length(v) >= 8 AND speech < 0.05 AND coalesce(quiet >= 0.8, TRUE) THEN 'long_text_during_silence' END,
    CASE WHEN snr < 10 THEN 'low_snr' END, CASE WHEN far THEN 'far_field_audio' END, CASE WHEN calibrated < 0.55 THEN 'low_calibrated_quality' END], lambda x: x IS NOT NULL) AS issues FROM d)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what would be known of their sound, from their numbers, and their issues."""
    share = lambda m: (F.col("doc_id") % m) / F.lit(float(m))
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", text.alias("text"), "lang", F.when(F.col("doc_id") % 9 == 0, 0.0).otherwise(F.length(text) / F.lit(12.0)).alias("voiced"), share(100).alias("speech"), (F.col("doc_id") % 31).cast("double").alias("snr"),
        (F.col("doc_id") % 17 == 0).alias("far"), F.when(F.col("doc_id") % 4 > 0, share(10)).alias("quiet"), F.when(F.col("doc_id") % 3 > 0, share(20)).alias("calibrated"),
    )
    rules = gates.text_rules(F.col("text"), F.col("voiced"), F.coalesce(texts.script_mismatch(F.col("text"), F.col("lang")), F.lit(False)))
    rules |= gates.acoustic_rules(F.col("text"), F.col("voiced"), F.col("speech"), F.col("quiet"), F.col("snr"), F.col("far"))
    return docs.withColumn("issues", gates.found(rules | {"low_calibrated_quality": F.col("calibrated") < 0.55}))


PENALTY = "(list_sum([CASE x " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gates.PENALTIES.items()) + " END for x in issues if x <> 'low_calibrated_quality']))"


@query(
    SIGNALS
    + f""" SELECT doc_id, array_to_string(issues, ',') AS issues, round(least(greatest(0.0, 1 - coalesce({PENALTY}, 0)::DOUBLE), coalesce(calibrated, 1)), 6) AS score,
    len([x for x in issues if x IN ({", ".join(f"'{x}'" for x in gates.HARD)})]) = 0 AS valid FROM i"""
)
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of text and sound with their penalties, and whether one of them rejects the candidate."""
    scored = F.filter("issues", lambda i: i != "low_calibrated_quality")
    return signals(spark, sf_dir).select("doc_id", F.array_join("issues", ",").alias("issues"), gates.gate_score(scored, F.col("calibrated")).alias("score"), (~gates.blocked(F.col("issues"))).alias("valid"))


@query(
    SIGNALS
    + r""", r AS (SELECT *, CASE WHEN voiced > 0 THEN length(v) / voiced ELSE 0 END AS ratio FROM i)
    SELECT doc_id, array_to_string([x for x in [CASE WHEN length(text) / 20.0 >= 30 THEN 'segment_reaches_safe_duration_limit' END, CASE WHEN NOT (snr / 25 BETWEEN 0.5 AND 1) THEN 'transcript_coverage_unreasonable' END,
        CASE WHEN list_contains(issues, 'empty_text_while_speech_present') THEN 'missing_text_present' END,
        CASE WHEN voiced <= 0 OR list_has_any(issues, ['empty_text_while_speech_present', 'unicode_replacement_character', 'consecutive_question_placeholders', 'illegal_control_character', 'manual_language_script_mismatch', 'text_length_and_voiced_duration_mismatch']) THEN 'abnormal_character_or_quality_signal' END,
        CASE WHEN lang IS DISTINCT FROM 'en' THEN 'language_mismatch' END, CASE WHEN NOT (ratio BETWEEN 0.2 AND 24) THEN 'text_to_voiced_duration_ratio_abnormal' END, CASE WHEN trim(text) = '' THEN 'empty_final_text' END] if x IS NOT NULL], ',') AS reasons FROM r"""
)
def alignment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a document may not be aligned with its sound: 20 characters a second, English ones only."""
    docs = signals(spark, sf_dir)
    why = gates.alignment_reasons(F.length("text") / F.lit(20.0), F.lit(45.0), F.col("snr") / 25, F.col("voiced"), F.col("issues"), F.col("text"), F.col("lang"), F.when(F.col("lang") == "en", "en").otherwise("xx"))
    return docs.select("doc_id", F.array_join(why, ",").alias("reasons"))


@query(
    """WITH m AS (SELECT source, round(greatest(0, least(1, 1 - avg(1 - quality)))::DOUBLE, 6) AS reliability FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT doc_id, reliability, round(reliability * coalesce(CASE WHEN doc_id % 3 > 0 THEN (doc_id % 20) / 20.0::DOUBLE END, 0.5) * (0.5 + 0.5 * ((doc_id % 100) / 100.0::DOUBLE)) * CASE WHEN doc_id % 5 = 0 THEN 1.15 ELSE 1 END * CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END, 6)::DOUBLE AS weight FROM documents JOIN m USING (source)"""
)
def vote_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's reliability from its labels, and each document's weight in a vote; a fifth count as glossary terms, an eleventh as illegal."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    models = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("source").agg(F.round(gates.reliability(F.avg(1 - F.col("quality"))), 6).alias("reliability"))
    confidence = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 20) / F.lit(20.0))
    weight = evaluation.vote_weight(F.col("reliability"), confidence, (F.col("doc_id") % 100) / F.lit(100.0), F.col("doc_id") % 5 == 0, F.col("doc_id") % 11 != 0)
    return docs.join(models, "source").select("doc_id", "reliability", F.round(weight, 6).alias("weight"))


@query(
    """SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'P' THEN 'status' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'kind' END, CASE WHEN NOT regexp_matches(md5(o_orderkey::VARCHAR), '^[0-9a-e]') THEN 'hash' END, CASE WHEN o_totalprice > 300000 THEN 'memory' END, 'passed') AS outcome FROM orders"""
)
def evidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that a record fails, of status, kind, hash and size."""
    rules = {"status": F.col("o_orderstatus") == "P", "kind": F.col("o_orderpriority") == "5-LOW", "hash": ~F.regexp_like(F.md5(F.col("o_orderkey").cast("string")), F.lit("^[0-9a-e]")), "memory": F.col("o_totalprice") > 300000}
    return table(spark, sf_dir, "orders").select("o_orderkey", F.coalesce(*(F.when(rule, name) for name, rule in rules.items()), F.lit("passed")).alias("outcome"))


ENDS = ", ua AS (SELECT * FROM ok WHERE event_type = (SELECT min(event_type) FROM events)), ub AS (SELECT * FROM ok WHERE event_type = (SELECT max(event_type) FROM events))"
COMMON = """, cuts AS (SELECT user_id, s AS cut FROM ua UNION SELECT user_id, e FROM ua UNION SELECT user_id, s FROM ub UNION SELECT user_id, e FROM ub),
    atoms AS (SELECT user_id, cut AS s, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS e FROM cuts),
    flags AS (SELECT a.user_id, a.s, a.e, EXISTS (SELECT 1 FROM ua WHERE ua.user_id = a.user_id AND ua.s <= a.s AND ua.e >= a.e) AS inside, EXISTS (SELECT 1 FROM ub WHERE ub.user_id = a.user_id AND ub.s <= a.s AND ub.e >= a.e) AS spoken FROM atoms a WHERE e IS NOT NULL),
    cover AS (SELECT user_id, coalesce(sum(e - s) FILTER (WHERE spoken), 0)::BIGINT AS speech, coalesce(sum(e - s) FILTER (WHERE spoken AND inside), 0)::BIGINT AS covered FROM flags GROUP BY user_id)"""


def two_kinds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the first event type by name, as segments, and of the last, as speech."""
    found = spans(spark, sf_dir)
    first, last = found.agg(F.min("event_type"), F.max("event_type")).first()
    return of_type(found, first), of_type(found, last)


@query(
    SPANS
    + ENDS
    + COMMON
    + """, seg AS (SELECT user_id, count(*) AS segments, count(DISTINCT floor(value)) AS speakers, count(*) FILTER (WHERE value < 1) AS empty FROM ua GROUP BY user_id),
    dup AS (SELECT a.user_id, count(*) AS n FROM ua a WHERE EXISTS (SELECT 1 FROM ua b WHERE b.user_id = a.user_id AND floor(b.value) = floor(a.value) AND (b.s, b.e, b.event_id) > (a.s, a.e, a.event_id) AND b.s < a.e AND a.s < b.e) GROUP BY a.user_id),
    m AS (SELECT cover.user_id, speech, covered, round(CASE WHEN speech > 0 THEN covered / speech::DOUBLE ELSE 1 END, 6) AS coverage, coalesce(segments, 0) AS segments, coalesce(speakers, 0) AS speakers, coalesce(n, 0) AS duplicates, coalesce(empty, 0) AS empty FROM cover LEFT JOIN seg USING (user_id) LEFT JOIN dup USING (user_id))
    SELECT *, array_to_string([x for x in [CASE WHEN speech >= 2 AND segments = 0 THEN 'speech_without_segments' END, CASE WHEN speech >= 5 AND coverage < 0.35 THEN 'low_coverage' END, CASE WHEN speakers > 20 THEN 'excess_speakers' END,
        CASE WHEN duplicates > 0.25 * segments THEN 'duplicates' END, CASE WHEN segments > 0 AND empty >= 0.8 * segments THEN 'mostly_empty' END] if x IS NOT NULL], ',') AS anomalies FROM m"""
)
def structure_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of speech by segments, speakers, duplicates and empties of each user, and what is wrong with them. An event's speaker, and text, is its value's whole part."""
    segments, speech = two_kinds(spark, sf_dir)
    named = segments.filter("end > start").select("user_id", "event_id", "start", "end", F.floor("value").alias("speaker"), F.floor("value").cast("string").alias("text"), (F.col("value") < 1).alias("empty"))
    told = structure.health(named, speech, ["user_id"], "event_id")
    return structure.with_anomalies(told, most_speakers=20, unit=1).withColumn("anomalies", F.array_join("anomalies", ","))


@query(SPANS + ENDS + COMMON + ", tok AS (SELECT user_id, count(*) AS n, sum(e - s) AS total FROM ua GROUP BY user_id), life AS (SELECT user_id, max(e) - min(s) AS long FROM ok GROUP BY user_id) SELECT user_id, round(CASE WHEN speech > 0 THEN least(1, covered / speech::DOUBLE) WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END, 6) AS coverage, round(least(1, coalesce(total, 0) / greatest(long, 1)::DOUBLE), 6) AS speech_ratio FROM life LEFT JOIN cover USING (user_id) LEFT JOIN tok USING (user_id)")
def speech_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of speech that tokens cover, 1 without speech if there are tokens; and the sum of tokens against the whole time, 1 at most."""
    tokens, speech = two_kinds(spark, sf_dir)
    life = spans(spark, sf_dir).filter("end > start").groupBy("user_id").agg((F.max("end") - F.min("start")).alias("long"))
    told = tokens.filter("end > start").groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = life.join(intervals.union_length(speech, ["user_id"], "speech"), "user_id", "left").join(intervals.intersection_length(tokens, speech, ["user_id"], "covered"), "user_id", "left").join(told, "user_id", "left")
    coverage = F.when(zero("speech") > 0, F.least(F.lit(1.0), zero("covered") / F.col("speech"))).when(zero("n") > 0, 1.0).otherwise(0.0)
    return out.select("user_id", F.round(coverage, 6).alias("coverage"), F.round(F.least(F.lit(1.0), zero("total") / F.greatest("long", F.lit(1))), 6).alias("speech_ratio"))


@query(
    SPANS
    + """, n AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM spans), t AS (SELECT user_id, count(*) AS words, sum(greatest(0, e - nxt))::BIGINT AS overlap, sum(e - s)::BIGINT AS spoken, bool_and(nxt IS NULL OR nxt >= s) AS monotonic FROM n GROUP BY user_id)
    SELECT *, overlap / greatest(spoken, 1)::DOUBLE > 0.25 AS excessive FROM t"""
)
def word_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much words overlap the next one, against all they last, and whether they begin in order."""
    words = neighbours.with_neighbours(spans(spark, sf_dir).select("user_id", "event_id", "start", "end"), ["user_id"], ["event_id"], ["start"], F.floor(F.col("event_id") / 5000))
    after = F.col("after.start")
    sums = words.groupBy("user_id").agg(
        F.count("*").alias("words"), F.sum(F.greatest(F.lit(0), F.when(after.isNotNull(), F.col("end") - after))).alias("overlap"), F.sum(F.col("end") - F.col("start")).alias("spoken"), F.bool_and(after.isNull() | (after >= F.col("start"))).alias("monotonic")
    )
    return sums.withColumn("excessive", F.col("overlap") / F.greatest("spoken", F.lit(1)) > 0.25)


@query(
    """WITH n AS (SELECT event_id, event_type, value, lag(event_type) OVER w AS b, lead(event_type) OVER w AS a FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, CASE WHEN value < 12 AND coalesce(b, a) = coalesce(a, b) THEN coalesce(b, a) ELSE event_type END AS label FROM n"""
)
def smoothed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A short event takes the label of its neighbours if they agree."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    seen = neighbours.with_neighbours(events, ["user_id"], ["event_id"], ["event_type"], F.floor(F.col("event_id") / 5000))
    before, after = F.col("before.event_type"), F.col("after.event_type")
    agree = (F.col("value") < 12) & (F.coalesce(before, after) == F.coalesce(after, before))
    return seen.select("event_id", F.when(agree, F.coalesce(before, after)).otherwise(F.col("event_type")).alias("label"))


@query(
    """WITH m AS (SELECT *, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM m)
    SELECT user_id, run::BIGINT AS run, min(event_id) AS first_event, any_value(event_type) AS label, round(coalesce(avg(value) FILTER (WHERE value >= 10), 0), 6) AS confidence, count(*) AS windows FROM r GROUP BY user_id, run"""
)
def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of one label, with the mean of their reliable values, 0 without one."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    part = F.floor(F.col("event_id") / 5000)
    seen = neighbours.with_neighbours(events, ["user_id"], ["event_id"], ["event_type"], part)
    marked = lineage.cut(seen.withColumn("new", (~F.coalesce(F.col("before.event_type") == F.col("event_type"), F.lit(False))).cast("long")).drop("before", "after"))
    runs = neighbours.with_running_sum(marked, ["user_id"], ["event_id"], "new", part, "run")
    reliable = F.avg(F.when(F.col("value") >= 10, F.col("value")))
    return runs.groupBy("user_id", "run").agg(F.min("event_id").alias("first_event"), F.first("event_type").alias("label"), F.round(F.coalesce(reliable, F.lit(0.0)), 6).alias("confidence"), F.count("*").alias("windows"))


@query(
    SPANS
    + """, p AS (SELECT user_id, event_id, e - s AS long, s + k * 4000 AS ps, least(e, s + (k + 1) * 4000) AS pe FROM ok, range(0, 64) r(k) WHERE e - (s + k * 4000) >= 1000)
    SELECT user_id, ps, pe FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY long DESC, event_id, ps) AS n FROM p) WHERE n <= 3"""
)
def support_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three pieces of 4,000 seconds of a user's longest spans; a piece lasts 1,000 at least."""
    found = spans(spark, sf_dir).filter("end - start >= 1000")
    cuts = F.explode(F.sequence(F.col("start"), F.col("end") - 1000, F.lit(4000).cast("long"))).alias("ps")
    pieces = found.select("user_id", "event_id", (F.col("end") - F.col("start")).alias("long"), "end", cuts)
    order = Window.partitionBy("user_id").orderBy(F.desc("long"), "event_id", "ps")
    ranked = pieces.withColumn("n", F.row_number().over(order)).filter("n <= 3")
    return ranked.select("user_id", "ps", F.least("end", F.col("ps") + 4000).alias("pe"))


@query(
    """SELECT event_id, greatest(32000, least(round_even((event_id * 0.25 + 0.03125) * 16, 0)::BIGINT, 36000)) AS s, least(36000, round_even((event_id * 0.25 + value) * 16, 0)::BIGINT) AS e, least(2048, greatest(64, ceil(16 * value)::BIGINT + 32)) AS most_tokens, greatest(128, ceil(40 * value)::BIGINT) AS most_chars,
    round(value * 10 / greatest(1, event_id % 60), 6) AS rtf FROM events WHERE least(36000, round_even((event_id * 0.25 + value) * 16, 0)::BIGINT) > greatest(32000, least(round_even((event_id * 0.25 + 0.03125) * 16, 0)::BIGINT, 36000))"""
)
def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds as samples, halves to even, clipped to a window, empty ones dropped; limits of decoding by duration, and the real-time factor."""
    events = table(spark, sf_dir, "events")
    at = F.col("event_id") * 0.25
    start = F.greatest(F.lit(32000), F.least(F.bround((at + 0.03125) * 16).cast("long"), F.lit(36000)))
    end = F.least(F.lit(36000), F.bround((at + F.col("value")) * 16).cast("long"))
    tokens = F.least(F.lit(2048), F.greatest(F.lit(64), F.ceil(16 * F.col("value")) + 32))
    return events.select("event_id", start.alias("s"), end.alias("e"), tokens.alias("most_tokens"), F.greatest(F.lit(128), F.ceil(40 * F.col("value"))).alias("most_chars"), F.round(F.col("value") * 10 / F.greatest(F.lit(1), F.col("event_id") % 60), 6).alias("rtf")).filter("e > s")


@query("SELECT vec_id, round(greatest(0, least(1, list_sum([x::DOUBLE for x in embedding]) / len(embedding) + 0.5)), 5) AS probability, round(least(1, len(embedding) / 96.0::DOUBLE), 6) AS signal_quality FROM embeddings")
def vector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of a nested array, moved by a half and clamped to [0, 1], and a quality that grows with its length up to 1."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.flatten(F.array("embedding")).alias("v"))
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size("v")
    return vectors.select("vec_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean + 0.5)), 5).alias("probability"), F.round(F.least(F.lit(1.0), F.size("v") / F.lit(96.0)), 6).alias("signal_quality"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type || CASE WHEN event_id % 3 = 1 THEN ',laugh ' || event_type ELSE '' END END AS sounds FROM events""")
def sound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in brackets that are neither speakers nor numbers."""
    kind = F.col("event_type")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[S1] a [12.5] b ["), F.col("user_id").cast("string"), F.lit("]"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("[S02][ "), kind, F.lit(" ] x [laugh "), kind, F.lit("]")))
    said = said.otherwise(F.concat(F.lit("["), kind, F.lit("] [] [ ] [7]")))
    names = F.transform(F.regexp_extract_all(said, F.lit(r"\[([^\[\]]*)\]"), F.lit(1)), lambda n: F.trim(n))
    kept = F.filter(names, lambda n: (n != "") & ~n.rlike(r"^S\d+$") & n.try_cast("double").isNull())
    return table(spark, sf_dir, "events").select("event_id", F.array_join(kept, ",").alias("sounds"))


@query(
    """SELECT doc_id, CASE lower(trim(lang || ' ')) WHEN 'en' THEN 'en' WHEN 'english' THEN 'en' WHEN 'de' THEN 'de' WHEN 'ja' THEN 'ja' WHEN 'zh' THEN 'zh' END AS code, CASE doc_id % 5 WHEN 0 THEN '1..1' WHEN 1 THEN '2..2' WHEN 2 THEN '3..4' WHEN 3 THEN '5..12' ELSE '1..12' END AS speakers FROM documents"""
)
def mapped_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of languages as codes, null for others, and choices of a number of speakers as bounds."""
    code = structure.language_code(F.concat(F.col("lang"), F.lit(" ")), {"de": "de"})
    choice = F.element_at(F.array(*map(F.lit, ["1", "2", "3-4", "5+", "auto"])), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"), structure.speaker_bounds(choice, 12).alias("speakers"))


WORDS = r"regexp_extract_all(text, '[\p{L}\p{N}]+')"


@query(
    rf"""WITH w AS (SELECT conv_id, turn, text, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) - 1 AS i FROM conversations WHERE text IS NOT NULL),
    v AS (SELECT *, i * 400.25 - CASE WHEN i % 7 = 6 THEN 1e6 ELSE 0 END AS off, length(word) * 40.0 AS long FROM w), s AS (SELECT *, round_even(off * 16, 0)::BIGINT AS l, least(200000, round_even((off + long) * 16, 0)::BIGINT) AS r FROM v)
    SELECT conv_id, turn, count(*) FILTER (WHERE off >= 0 AND l < r) AS words, coalesce(sum(l) FILTER (WHERE off >= 0 AND l < r), 0)::BIGINT AS starts, coalesce(max(r) FILTER (WHERE off >= 0 AND l < r), 0) AS last_end, turn % 3 <> 1 AS timed, CASE turn % 2 WHEN 0 THEN 'en' ELSE 'auto_mixed' END AS language FROM s GROUP BY conv_id, turn"""
)
def phrase_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as responses of a recogniser, read back: words and spans in samples; every seventh word, and every third phrase, has no valid span."""
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", found.alias("w")).filter(F.size("w") > 0)
    word = lambda w, i: F.struct(w.alias("text"), (i * 400.25 - F.when(i % 7 == 6, 1e6).otherwise(0.0)).alias("offsetMilliseconds"), (F.length(w) * 40.0).alias("durationMilliseconds"))
    phrase = F.struct(
        F.array_join("w", " ").alias("text"), F.when(F.col("turn") % 3 == 1, -1.0).otherwise(0.0).alias("offsetMilliseconds"), F.lit(500.0).alias("durationMilliseconds"), F.when(F.col("turn") % 2 == 0, "en-US").otherwise("fr-FR").alias("locale"),
        F.lit("S").alias("speaker"), F.transform("w", word).alias("words"),
    )
    payload = F.to_json(F.struct(F.array(phrase).alias("phrases")))
    read = responses.phrases(turns.select("conv_id", "turn", payload.alias("payload")), "payload", F.lit(200000).cast("long"), F.lit("fr"))
    sums = lambda f: F.coalesce(F.aggregate("words", F.lit(0).cast("long"), f), F.lit(0))
    return read.select(
        "conv_id", "turn", F.size("words").cast("long").alias("words"), sums(lambda s, w: s + w["span"]["start"]).alias("starts"), sums(lambda s, w: F.greatest(s, w["span"]["end"])).alias("last_end"), "timed", "language"
    )


@query(
    """WITH t AS (SELECT conv_id, turn, role, text, turn * 1000 AS s, turn * 1000 + length(text) AS e FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, array_to_string([x for x in [CASE WHEN role = 'system' THEN 'model' END, CASE WHEN length(text) = 0 OR turn = 3 AND length(text) <= 10 THEN 'window' END, CASE WHEN turn = 2 THEN 'speaker' END, CASE WHEN turn = 5 THEN 'words' END, CASE WHEN turn = 4 THEN 'alignment' END] if x IS NOT NULL], ',') AS faults,
    CASE WHEN turn % 2 = 0 THEN 0.9 WHEN trim(text) <> '' THEN 0.55 ELSE 0.35 END AS score, s + 7 AS shifted FROM t"""
)
def segment_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as responses of one segment each, read back, with what is wrong with them, their score and their start moved by seven samples."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").withColumns({"s": F.col("turn") * 1000, "e": F.col("turn") * 1000 + F.length("text")})
    word = F.struct(F.lit("w").alias("text"), F.when(F.col("turn") == 5, F.col("s") - 1).otherwise(F.col("s")).alias("start"), F.col("e").alias("end"))
    segment = F.struct(
        F.col("s").alias("start"), F.col("e").alias("end"), F.when(F.col("turn") == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.when(F.col("turn") != 2, "S").alias("speaker"),
        F.when(F.col("turn") % 2 == 0, 0.9).alias("confidence"), F.when(F.length("text") > 0, F.array(word)).otherwise(F.array()).alias("words"),
    )
    payload = F.to_json(F.struct(F.when(F.col("role") == "system", "other").otherwise("m").alias("model"), F.array(segment).alias("segments")))
    read = responses.with_segments(turns.select("conv_id", "turn", "s", "e", "text", payload.alias("payload")), "payload")
    faults = responses.response_faults(F.col("response"), F.lit("m"), F.col("s"), F.col("e"), F.col("text"))
    return read.select("conv_id", "turn", F.array_join(faults, ",").alias("faults"), F.get(responses.segment_scores(F.col("response")), F.lit(0)).alias("score"), F.get(responses.shifted_segments(F.col("response"), F.lit(7)), F.lit(0))["start"].alias("shifted"))


@query(
    rf"""WITH w AS (SELECT conv_id, turn, unnest({WORDS}) AS word, generate_subscripts({WORDS}, 1) - 1 AS i FROM conversations WHERE text IS NOT NULL), t AS (SELECT *, i * 6400 AS s, i * 6400 + length(word) * 640 AS e FROM w)
    SELECT conv_id, turn, count(*) AS words, string_agg(word, ' ' ORDER BY i) AS core, min(greatest(s, 20000)) AS first_start, max(least(e, 90000)) AS last_end FROM t WHERE (s + e) // 2 >= 20000 AND (s + e) // 2 < 90000 AND s < 90000 AND e > 20000 GROUP BY conv_id, turn"""
)
def core_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of a turn whose middle lies in its core, clipped to it."""
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    timed = F.transform(found, lambda w, i: F.struct(w.alias("word"), (i * 6400).alias("s"), (i * 6400 + F.length(w) * 640).alias("e")))
    core = structure.core_tokens(timed, F.lit(20000), F.lit(90000))
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", core.alias("c")).filter(F.size("c") > 0)
    return turns.select(
        "conv_id", "turn", F.size("c").cast("long").alias("words"), F.array_join(F.transform("c", lambda t: t["word"]), " ").alias("core"), F.array_min(F.transform("c", lambda t: t["s"])).cast("long").alias("first_start"),
        F.array_max(F.transform("c", lambda t: t["e"])).cast("long").alias("last_end"),
    )


@query(
    """SELECT conv_id, turn // 2 AS piece, string_agg(trim(text), ' ' ORDER BY turn) FILTER (WHERE trim(text) <> '') AS text, sum(length(text))::BIGINT AS tokens, max(length(text)) AS peak, round(avg(turn % 7) FILTER (WHERE turn % 3 > 0), 6) AS confidence, count(*) = 2 AND max(turn) - min(turn) = 1 AS whole FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn // 2"""
)
def merged_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of a retried span joined in order, their counts added, their peak, the mean of the confidences that are known, and whether they cover the span."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").withColumn("piece", F.floor(F.col("turn") / 2))
    told = structure.merge_pieces(turns, ["conv_id", "piece"], "turn", "text", F.length("text"), F.when(F.col("turn") % 3 > 0, F.col("turn") % 7))
    return told.select("conv_id", "piece", "text", "tokens", F.col("peak").cast("long").alias("peak"), F.round("confidence", 6).alias("confidence"), ((F.col("pieces") == 2) & (F.col("last") - F.col("first") == 1)).alias("whole"))


@query(
    """WITH c AS (SELECT source, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents), s AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY doc_id) AS upto FROM c)
    SELECT doc_id, (upto // 320 - (upto - n) // 320)::BIGINT AS frames, (upto % 320)::BIGINT AS carried FROM s"""
)
def byte_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 320 bytes that each document completes in its source's stream, and the bytes carried over."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n"))
    sums = neighbours.with_running_sum(docs, ["source"], ["doc_id"], "n", F.floor(F.col("doc_id") / 5000))
    return sums.select("doc_id", (F.floor(F.col("upto") / 320) - F.floor((F.col("upto") - F.col("n")) / 320)).alias("frames"), (F.col("upto") % 320).alias("carried"))


@query(
    rf"""SELECT conv_id, turn, len({WORDS}) AS tokens, greatest(0, len({WORDS}) - CASE WHEN turn % 2 = 0 THEN 0 ELSE 2 END) AS stable FROM conversations WHERE text IS NOT NULL"""
)
def stable_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a partial result: its last two may still change unless it is final (even turns)."""
    found = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    told = structure.stability(found, F.col("turn") % 2 == 0)
    return table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.size(told).cast("long").alias("tokens"), F.size(F.filter(told, lambda t: t["stable"])).cast("long").alias("stable"))
