"""Queries over whole texts: densities, scripts, punctuation, repetition, terms, redaction, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as texts
from chronoloom.operators import repetition
from chronoloom.plans.registry import query, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")


@query(
    """SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens, len(regexp_extract_all(text, '[.,;:!?*%#&]')) AS marks, len(regexp_extract_all(text, '[A-Z]')) AS capitals,
    round(len(regexp_extract_all(text, '[.,;:!?*%#&]'))::DOUBLE / nullif(length(text), 0), 6) AS mark_share, regexp_matches(text, '(?i)\\d+\\s*(kg|km|cm|mm|ms|gb|mb|%)') AS units FROM documents"""
)
def text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    marks = "[.,;:!?*%#&]"
    return documents(spark, sf_dir).select(
        "doc_id", F.length("text").cast("long").alias("chars"), count(r"[^\x20\x09-\x0D]+").alias("tokens"), count(marks).alias("marks"), count("[A-Z]").alias("capitals"),
        F.round(texts.share(marks, F.col("text")), 6).alias("mark_share"), F.col("text").rlike(r"(?i)\d+\s*(kg|km|cm|mm|ms|gb|mb|%)").alias("units"),
    )


@query("SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '\\p{Latin}')) AS latin, len(regexp_extract_all(text, '\\p{L}')) - len(regexp_extract_all(text, '\\p{Latin}')) > 0.2 * len(regexp_extract_all(text, '\\p{L}')) AND lang = 'en' AS mismatch FROM documents")
def script_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda p: F.regexp_count("text", F.lit(p)).cast("long")
    mismatch = texts.script_mismatch(F.col("text"), F.col("lang"))
    return documents(spark, sf_dir).select("doc_id", count(r"\p{L}").alias("letters"), count(r"\p{IsLatin}").alias("latin"), mismatch.alias("mismatch"))


@query(
    """SELECT doc_id, length(replace(text, '(', '')) = length(replace(text, ')', '')) AND length(replace(text, '[', '')) = length(replace(text, ']', '')) AND length(replace(text, '{', '')) = length(replace(text, '}', '')) AS balanced FROM documents"""
)
def bracket_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", texts.pairs_balanced(F.col("text")).alias("balanced"))


@query(
    """SELECT doc_id, length(list_reduce(list_concat([''], regexp_extract_all(text, '[\\(\\)\\[\\]\\{\\}]')), lambda s, c: CASE WHEN c IN ('(', '[', '{') THEN s || c WHEN right(s, 1) = CASE c WHEN ')' THEN '(' WHEN ']' THEN '[' ELSE '{' END THEN left(s, length(s) - 1) ELSE '!' || s END))::BIGINT AS unpaired
    FROM documents WHERE text IS NOT NULL"""
)
def bracket_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", texts.unpaired(F.col("text")).alias("unpaired"))


@query(
    """WITH s AS (SELECT doc_id, trim(unnest(regexp_split_to_array(text, '[.?!\\n]')), ' ') AS s FROM documents), k AS (SELECT doc_id, lower(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')) AS s FROM s WHERE regexp_matches(s, '[\\p{L}\\p{N}]')),
    c AS (SELECT doc_id, s, count(*) AS n FROM k WHERE length(s) >= 3 GROUP BY ALL) SELECT doc_id, sum(n)::BIGINT AS sentences, max(n) AS most_repeated FROM c GROUP BY doc_id"""
)
def repeated_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = documents(spark, sf_dir).select("doc_id", F.explode(texts.sentences(F.col("text"))).alias("s"))
    key = F.lower(F.regexp_replace("s", r"[^\p{L}\p{N}]", ""))
    counts = cut.select("doc_id", key.alias("s")).filter("length(s) >= 3").groupBy("doc_id", "s").agg(F.count("*").alias("n"))
    return counts.groupBy("doc_id").agg(F.sum("n").alias("sentences"), F.max("n").alias("most_repeated"))


@query(
    """WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    g AS (SELECT doc_id, i, array_to_string(w[i:i+2], ' ') AS g, len(w) AS n FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS times FROM g)
    SELECT doc_id, any_value(n) AS words, max(times) AS most, round(count(*) FILTER (WHERE times >= 4)::DOUBLE / (any_value(n) - 2), 6) AS repeated_share FROM c GROUP BY doc_id"""
)
def ngram_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(spark, sf_dir).select("doc_id", repetition.ngram_repeats(F.col("text"), 3, 4).alias("r")).filter("r is not null")
    return found.select("doc_id", "r.words", "r.most", F.round(F.col("r.repeated") / (F.col("r.words") - 2), 6).alias("repeated_share"))


@query()
def decode_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loop signals of a text."""
    return repetition.inspect_loops(documents(spark, sf_dir), "text").select("doc_id", "suffix_period", "token_loop", "character_loop", "compression", "looping")


@query(
    """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL)
    SELECT lang, term, n, round(least(0.3, 0.12 + 0.02 * n), 6)::DOUBLE AS weight FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS k FROM c) WHERE k <= 32"""
)
def term_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = documents(spark, sf_dir).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term"))
    counts = words.groupBy("lang", "term").agg(F.count("*").alias("n"))
    top = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "term"))).filter("k <= 32").drop("k")
    return top.withColumn("weight", F.round(F.least(F.lit(0.3), 0.12 + 0.02 * F.col("n")), 6))


@query("SELECT source, sum(CASE WHEN length(p) > 0 THEN (length(text) - length(replace(text, p, ''))) // length(p) ELSE 0 END)::BIGINT AS hits, p AS part FROM documents, (SELECT unnest(['the', 'ment', 'ción', 'ung', '***']) AS p) GROUP BY source, p")
def occurrence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["the", "ment", "ción", "ung", "***"]
    rows = documents(spark, sf_dir).select("source", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), texts.occurrences(F.col("text"), F.lit(p)).alias("n")) for p in parts))).alias("x"))
    return rows.groupBy("source", F.col("x.part").alias("part")).agg(F.sum("x.n").alias("hits"))


@query(
    """SELECT doc_id, length(regexp_replace(text, '(?i)(bearer\\s+\\S+|hf_[a-z0-9]{16,}|token\\s*=\\s*\\S+)', '[REDACTED]', 'g')) AS chars, md5(regexp_replace(text, '(?i)(bearer\\s+\\S+|hf_[a-z0-9]{16,}|token\\s*=\\s*\\S+)', '[REDACTED]', 'g')) AS digest,
    regexp_matches(text, '(?i)(bearer\\s+\\S+|hf_[a-z0-9]{16,}|token\\s*=\\s*\\S+)') AS changed FROM documents"""
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = texts.redacted(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.length(clean).cast("long").alias("chars"), F.md5(clean).alias("digest"), F.col("text").rlike(texts.SECRET).alias("changed"))


@query("SELECT doc_id, length(regexp_replace(text, '\\p{P}', '', 'g')) AS off, length(text) - len(regexp_extract_all(text, '\\p{P}')) + len(regexp_extract_all(text, '[.?!。！？]')) AS sentence_end FROM documents")
def punctuation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = lambda mode: F.length(texts.punctuated(F.col("text"), mode)).cast("long").alias(mode)
    return documents(spark, sf_dir).select("doc_id", size("off"), size("sentence_end"))


@query(
    """WITH m AS (SELECT d.source, l.quality, unnest(regexp_extract_all(text, '[.,;:!?]')) AS mark FROM documents d JOIN labels l USING (doc_id)), c AS (SELECT source, mark, count(*) FILTER (WHERE quality = 1) AS a, count(*) FILTER (WHERE quality = 0) AS b FROM m GROUP BY ALL)
    SELECT source, sum(least(a, b))::BIGINT AS common, sum(a)::BIGINT AS good, sum(b)::BIGINT AS poor, round(CASE WHEN sum(a) + sum(b) = 0 THEN 1.0 ELSE 2.0 * sum(least(a, b)) / (sum(a) + sum(b)) END, 6)::DOUBLE AS f1 FROM c GROUP BY source"""
)
def punctuation_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    marks = joined.select("source", "quality", F.explode(F.regexp_extract_all("text", F.lit("[.,;:!?]"), F.lit(0))).alias("mark"))
    counts = marks.groupBy("source", "mark").agg(F.count_if(F.col("quality") == 1).alias("a"), F.count_if(F.col("quality") == 0).alias("b"))
    both = counts.groupBy("source").agg(F.sum(F.least("a", "b")).alias("common"), F.sum("a").alias("good"), F.sum("b").alias("poor"))
    return both.withColumn("f1", F.round(F.when(F.col("good") + F.col("poor") == 0, 1.0).otherwise(2 * F.col("common") / (F.col("good") + F.col("poor"))), 6))


@query("SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id::VARCHAR || '}') AS parameter_hash FROM events")
def parameter_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("parameter_hash"))


@query(
    """SELECT d.doc_id, count(*) AS terms, string_agg(b.item_id::VARCHAR, ',' ORDER BY b.item_id) AS items FROM documents d JOIN benchmark b ON contains(lower(d.text), lower(b.text)) WHERE length(b.text) > 0 GROUP BY d.doc_id"""
)
def glossary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage as it is; inner words of each passage file it in an index."""
    from chronoloom.operators.glossary import contained_terms

    found = contained_terms(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), text="text", term="text", term_id="item_id", key="doc_id")
    return found.groupBy("doc_id").agg(F.count("*").alias("terms"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, count(*) AS cues, md5(string_agg(n::VARCHAR || chr(10) || lpad(((n * 2 - 2) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((n * 2 - 2) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(((n * 2 - 2) % 60)::VARCHAR, 2, '0') || ',000' || ' --> ' || lpad(((n * 2) // 3600)::VARCHAR, 2, '0') || ':' || lpad(((n * 2) // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(((n * 2) % 60)::VARCHAR, 2, '0') || ',000' || chr(10) || role || ': ' || text, chr(10) || chr(10) ORDER BY n)) AS srt,
    md5(string_agg(role || ': ' || text, chr(10) || chr(10) ORDER BY n) || chr(10)) AS txt FROM c GROUP BY conv_id"""
)
def exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.sources.exports import render_srt, render_text

    turns = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long"))
    cues = turns.select("conv_id", "n", ((F.col("n") * 2 - 2) * 16000).alias("start"), (F.col("n") * 32000).alias("end"), F.concat("role", F.lit(": "), "text").alias("text"))
    srt, plain = render_srt(cues, "conv_id"), render_text(cues, "conv_id")
    counts = cues.groupBy("conv_id").agg(F.count("*").alias("cues"))
    return counts.join(srt.select("conv_id", F.md5("content").alias("srt")), "conv_id").join(plain.select("conv_id", F.md5("content").alias("txt")), "conv_id")


@query()
def transcript_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns of one role as competing hypotheses of one text: columns, votes by reliability and confidence, support."""
    from chronoloom.operators.consensus import confusion_network
    from chronoloom.operators.evaluation import vote_weight
    from chronoloom.operators.gates import reliability

    confidence = F.when(F.col("turn") % 3 > 0, (F.col("turn") % 10 + 1) / F.lit(10.0))
    weight = vote_weight(reliability(F.when(F.col("role") == "user", 0.2).otherwise(0.1)), confidence, F.lit(1.0), F.lit(False), F.lit(True))
    turns = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), "role").alias("segment"), F.col("turn").alias("candidate"), "text", weight.alias("weight"))
    return confusion_network(turns.filter("text is not null"), "segment", "candidate", "text", "weight")


@query()
def sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linguistic sentences of whole texts; their spans part the text without loss."""
    from chronoloom.operators.readability import with_sentence_spans

    found = with_sentence_spans(documents(spark, sf_dir), "text").select("doc_id", F.explode("spans").alias("s"))
    return found.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.col("s.end") - F.col("s.start")).alias("longest"), F.sum(F.col("s.end") - F.col("s.start")).alias("chars"))


@query(
    """WITH t AS (SELECT conv_id, turn, role, coalesce(length(text), 0) AS n, lag(role) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    h AS (SELECT *, sum(CASE WHEN before IS NULL OR before <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS hard FROM t),
    s AS (SELECT *, greatest((row_number() OVER w - 1) // 6, coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 300) AS soft FROM h WINDOW w AS (PARTITION BY conv_id, hard ORDER BY turn)),
    p AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY hard, soft) AS paragraph FROM s)
    SELECT conv_id, paragraph, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns FROM p GROUP BY conv_id, paragraph"""
)
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation grouped into paragraphs."""
    from chronoloom.operators.readability import paragraph_groups

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text", (F.col("turn") * 20000).cast("long").alias("start"), (F.col("turn") * 20000 + 16000).cast("long").alias("end"))
    grouped = paragraph_groups(turns, "conv_id", "turn")
    return grouped.groupBy("conv_id", "paragraph").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("turns"))


@query()
def subtitle_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subtitle cues of every turn, words timed evenly."""
    from chronoloom.operators.subtitles import subtitle_cues as cues

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") * 160_000).cast("long").alias("start"), (F.col("turn") * 160_000 + 144_000).cast("long").alias("end"))
    return cues(turns, ["conv_id", "turn"]).select("conv_id", "turn", "cue", "start", "end", F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("lines"))
