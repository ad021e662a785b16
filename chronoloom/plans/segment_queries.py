"""Queries of segments: marks from pauses, records as documents, splits, links between windows, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.functions import normal, scores
from chronoloom.functions import text as texts
from chronoloom.operators import evaluation, intervals, marks, repetition, stitching, terminology
from chronoloom.plans.interval_queries import ISLANDS, SPANS, spans
from chronoloom.plans.metric_queries import DISTANCE, PAIRS, WORD, capital_scores, entity_recall, pairs, safety_rates
from chronoloom.plans.registry import ORACLE_SQL, query, table


@query(
    r"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM conversations WHERE text <> ''),
    k AS (SELECT *, NOT regexp_matches(ch, '[\p{P}\p{Z}\s]') AS lex, sum(CASE WHEN regexp_matches(ch, '[\p{P}\p{Z}\s]') THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos) AS n FROM c),
    e AS (SELECT *, bool_or(regexp_matches(ch, '\p{P}')) OVER (PARTITION BY conv_id, turn, n) AS has FROM k)
    SELECT conv_id, turn, md5(string_agg(ch || CASE WHEN lex AND NOT has THEN CASE WHEN n % 31 = 0 THEN '?' WHEN n % 17 = 0 THEN '.' WHEN n % 9 = 0 THEN ',' ELSE '' END ELSE '' END, '' ORDER BY pos)) AS marked FROM e GROUP BY conv_id, turn"""
)
def boundary_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with marks at pauses: 300 ms after every ninth character, another speaker after every 17th, a rising voice after every 31st. A text of marks alone stays."""
    turns = table(spark, sf_dir, "conversations").filter("text != ''").select("conv_id", "turn", "text")
    due = F.transform(
        F.sequence(F.lit(1), F.length("text")),
        lambda n: marks.acoustic_mark(F.when(n % 9 == 0, 300).otherwise(0), n % 17 == 0, n % 31 == 0, comma=",", stop=".", question="?"),
    )
    return turns.select("conv_id", "turn", F.md5(marks.with_marks(F.col("text"), due)).alias("marked"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, to_json({'conv_id': conv_id, 'role': role, 'tokens': [{'start': 1600 * length(w), 'text': w} for w in regexp_extract_all(text, '[\p{L}\p{N}]+')]})::VARCHAR AS doc FROM conversations WHERE text IS NOT NULL)
    SELECT conv_id, turn, sha256(doc) AS sha256, octet_length(encode(doc))::BIGINT AS size FROM t"""
)
def turn_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as JSON records with nested tokens, registered by digest and size."""
    tokens = F.transform(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.struct((1600 * F.length(w)).alias("start"), w.alias("text")))
    records = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.to_json(F.struct("conv_id", "role", tokens.alias("tokens"))).alias("doc"))
    return records.select("conv_id", "turn", F.sha2("doc", 256).alias("sha256"), F.octet_length("doc").cast("long").alias("size"))


@query(
    """WITH t AS (SELECT conv_id, turn, text, length(text) // 2 AS cut FROM conversations WHERE length(text) > 1), p AS (SELECT conv_id, turn, 0 AS part, left(text, cut) AS text, turn * 10000 AS "start", turn * 10000 + cut AS "end" FROM t UNION ALL SELECT conv_id, turn, 1, substr(text, cut + 1), turn * 10000 + cut, turn * 10000 + length(text) FROM t)
    SELECT conv_id, turn, part, md5(text) AS digest, "start", "end" FROM p"""
)
def split_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns split in two at the middle; the parts touch and keep the text."""
    turns = table(spark, sf_dir, "conversations").filter("length(text) > 1").withColumns({"cut": F.floor(F.length("text") / 2).cast("int"), "at": F.col("turn") * 10000})
    part = lambda no, text, start, end: F.struct(F.lit(no).alias("part"), text.alias("text"), start.alias("start"), end.alias("end"))
    middle, end = F.col("at") + F.col("cut"), F.col("at") + F.length("text")
    both = F.array(part(0, F.left("text", F.col("cut")), F.col("at"), middle), part(1, F.substr("text", F.col("cut") + 1), middle, end))
    return turns.select("conv_id", "turn", F.explode(both).alias("p")).select("conv_id", "turn", F.col("p.part").cast("long").alias("part"), F.md5("p.text").alias("digest"), "p.start", "p.end")


@query(
    """SELECT user_id, epoch_us(ts) // 86400000000 AS day, count(*) AS segments, CASE WHEN count(DISTINCT event_type) = 1 THEN min(event_type) END AS source, CASE WHEN count(DISTINCT event_type) = 1 THEN string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) END AS text,
    CASE WHEN count(DISTINCT event_type) = 1 THEN round(avg(value), 6) END AS confidence FROM events GROUP BY user_id, epoch_us(ts) // 86400000000"""
)
def coarse_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's segments of a user as one candidate, if they have one source."""
    day = F.datediff(F.col("ts").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    lone = F.countDistinct("event_type") == 1
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("event_id")), lambda x: x.cast("string")), " ")
    return table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(
        F.count("*").alias("segments"), F.when(lone, F.min("event_type")).alias("source"), F.when(lone, joined).alias("text"), F.when(lone, F.round(F.avg("value"), 6)).alias("confidence")
    )


def _wide() -> str:
    parts = [ORACLE_SQL[n] for n in ("capital_scores", "entity_recall", "safety_rates")]
    return f"""SELECT c.conv_id, c.turn, c.f1 AS capitals, e.recall AS entities, e.expected, s.omission_rate, s.invalid_rate
    FROM ({parts[0]}) c JOIN ({parts[1]}) e ON c.conv_id = e.conv_id AND c.turn = e.turn JOIN ({parts[2]}) s ON c.conv_id = s.conv_id AND c.turn = s.turn"""


@query(_wide())
def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of an item side by side."""
    entities = entity_recall(spark, sf_dir).select("conv_id", "turn", F.col("recall").alias("entities"), "expected")
    wide = capital_scores(spark, sf_dir).select("conv_id", "turn", F.col("f1").alias("capitals")).join(entities, ["conv_id", "turn"]).join(safety_rates(spark, sf_dir), ["conv_id", "turn"])
    return wide.select("conv_id", "turn", "capitals", "entities", "expected", "omission_rate", "invalid_rate")


@query(SPANS + ISLANDS.format(k="event_type, user_id", t="ok") + ", u AS (SELECT event_type, user_id, sum(e - s) AS n FROM islands GROUP BY ALL) SELECT event_type, sum(n)::BIGINT AS seconds, count(*) AS recordings, bool_and(n >= 1800) AS enough FROM u GROUP BY event_type")
def gold_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds that the labelled spans of each type cover, recording by recording, and whether each has half an hour."""
    union = intervals.union_length(spans(spark, sf_dir), ["event_type", "user_id"], "n")
    return union.groupBy("event_type").agg(F.sum("n").alias("seconds"), F.count("*").alias("recordings"), F.bool_and(F.col("n") >= 1800).alias("enough"))


@query(SPANS + " SELECT a.user_id, count(*) AS pairs, sum(least(a.e, b.e) - greatest(a.s, b.s))::BIGINT AS shared, count(*) FILTER (WHERE b.s >= a.s AND b.e <= a.e) AS contained FROM ok a JOIN ok b ON a.user_id = b.user_id AND a.event_type < b.event_type AND a.s < b.e AND b.s < a.e GROUP BY a.user_id")
def overlap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spans of two types that overlap, what they share, and how many hold the other."""
    found = spans(spark, sf_dir).select("user_id", "event_type", "start", "end")
    pairs = intervals.overlap_join(found, found, ["user_id"]).filter("l_event_type < r_event_type")
    return pairs.groupBy("user_id").agg(F.count("*").alias("pairs"), F.sum("shared").alias("shared"), F.count_if((F.col("r_start") >= F.col("l_start")) & (F.col("r_end") <= F.col("l_end"))).alias("contained"))


@query(
    r"""WITH t AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+') AS w FROM conversations),
    f AS (SELECT *, [lower(w[i]) = 'que' AND w[i + 1] = ' ' AND lower(w[i + 2]) = 'la' for i in range(1, len(w) + 1)] AS two FROM t),
    r AS (SELECT conv_id, turn, text, [CASE WHEN coalesce(two[i], FALSE) THEN 'QUE LA' WHEN i > 1 AND coalesce(two[i - 1], FALSE) OR i > 2 AND coalesce(two[i - 2], FALSE) THEN '' WHEN lower(w[i]) = 'the' THEN 'The' WHEN lower(w[i]) = 'que' THEN 'Que' ELSE w[i] END for i in range(1, len(w) + 1)] AS o,
        len([x for x in range(1, len(w) + 1) if coalesce(two[x], FALSE) OR lower(w[x]) IN ('the', 'que')]) AS changes FROM f)
    SELECT conv_id, turn, CASE WHEN text IS NOT NULL THEN md5(array_to_string(o, '')) END AS corrected, coalesce(changes, 0) AS changes FROM r"""
)
def corrected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the names of nations, and words that stand for them, put as terms."""
    nations = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("alias"), F.initcap("n_name").alias("canonical"))
    few = spark.createDataFrame([("the", "The"), ("que la", "QUE LA"), ("que", "Que")], "alias string, canonical string")
    lists = nations.unionByName(few).select(F.lit(1).alias("rank"), "canonical", F.array("alias").alias("aliases"), F.lit(None).cast("string").alias("language"), F.lit("course").alias("source"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lit("en").alias("language"))
    told = terminology.corrected(turns, lists, ["conv_id", "turn"])
    return told.select("conv_id", "turn", F.md5("corrected").alias("corrected"), F.size("diffs").cast("long").alias("changes"))


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM benchmark), c AS (SELECT w, count(*) AS n FROM w WHERE length(w) >= 4 GROUP BY w),
    ok AS (SELECT w, CASE WHEN length(w) % 3 = 0 THEN 'en' END AS language FROM c WHERE (length(w) % 2 = 0 OR n % 5 / 4.0::DOUBLE >= 0.75) AND (n >= 2 OR length(w) > 5)),
    t AS (SELECT doc_id, text, lang, regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+') AS p FROM documents),
    k AS (SELECT DISTINCT doc_id, lang, lower(x) AS x FROM (SELECT doc_id, lang, unnest(p) AS x FROM t) JOIN ok ON ok.w = lower(x) AND (ok.language IS NULL OR ok.language = lang)), m AS (SELECT doc_id, list(x) AS known FROM k GROUP BY doc_id)
    SELECT t.doc_id, CASE WHEN text IS NOT NULL THEN md5(array_to_string(CASE WHEN known IS NULL THEN p ELSE [CASE WHEN list_contains(known, lower(x)) THEN upper(x) ELSE x END for x in p] END, '')) END AS corrected,
    coalesce(len([x for x in p if list_contains(known, lower(x))]), 0) AS changes FROM t LEFT JOIN m USING (doc_id)"""
)
def term_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the benchmark's words put as terms in capitals, those that evidence supports: long enough words are heard by their reading, others emitted twice."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w")).filter(F.length("w") >= 4)
    counted = words.groupBy("w").agg(F.count("*").alias("n"))
    size, none = F.length("w"), F.lit(None).cast("string")
    terms = counted.select(F.upper("w").alias("canonical"), F.lit(1).alias("rank"), F.col("w").alias("reading"), F.array("w").alias("aliases"), F.when(size % 3 == 0, "en").alias("language"), (F.col("n") % 5 / 4.0).alias("weight"), (size % 2 == 0).alias("confirmed"), none.alias("source"))
    heard = F.when(size > 5, F.concat(F.lit("x"), F.substring("w", 2, 1000)))  # one letter of six or more is amiss
    evidence = counted.select(F.upper("w").alias("canonical"), F.when(F.col("n") >= 2, F.array("w")).alias("emitted"), heard.alias("observed"), F.lit(0.9).alias("support"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("lang").alias("language"))
    told = terminology.corrected(docs, terminology.supported(terms, evidence), ["doc_id"])
    return told.select("doc_id", F.md5("corrected").alias("corrected"), F.size("diffs").cast("long").alias("changes"))


@query(
    """WITH t AS (SELECT conv_id, role AS speaker, 'L' || (turn % 3)::VARCHAR AS label, 2.0 * length(text) / (2 * length(text) + 1) AS alike FROM conversations WHERE length(trim(text)) > 0), e AS (SELECT *, least(1, round(0.75 * alike + 0.25 * (700 / 900.0::DOUBLE), 6)) AS evidence FROM t WHERE alike >= 0.82)
    SELECT conv_id, label, speaker, evidence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, label ORDER BY evidence DESC, speaker) AS n FROM e) WHERE n = 1"""
)
def same_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speakers of one window known again in the next, which hears each turn a little later and with one character more."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").withColumn("start", F.col("turn") * 1000)
    before = turns.select("conv_id", "start", (F.col("start") + 900).alias("end"), "text", F.col("role").alias("speaker"))
    after = turns.select("conv_id", (F.col("start") + 200).alias("start"), (F.col("start") + 1100).alias("end"), F.concat("text", F.lit("!")).alias("text"), F.concat(F.lit("L"), (F.col("turn") % 3).cast("string")).alias("label"))
    return stitching.overlap_links(before, after, ["conv_id"], bucket=10_000).withColumn("evidence", F.round("evidence", 6))


@query(
    r"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+(?:[''’-][A-Za-z]+)*|\d+(?:[.,]\d+)?|[\p{L}\p{N}]') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(w) AS tokens, md5(array_to_string(w, ' ')) AS digest FROM t"""
)
def surface_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as they are shown."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", normal.normalised(F.col("text")).alias("t"), F.coalesce("lang", F.lit("")).alias("lang"))
    told = docs.select("doc_id", normal.surface_tokens(F.col("t"), F.col("lang")).alias("w"))
    return told.select("doc_id", F.size("w").cast("long").alias("tokens"), F.md5(F.array_join("w", " ")).alias("digest"))


_MARKS = normal.FORMATTING.replace("'", "''")


@query(
    f"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM conversations WHERE text <> ''),
    n AS (SELECT *, coalesce(lag(ch) OVER w, '') AS b, coalesce(lead(ch) OVER w, '') AS a FROM c WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)),
    k AS (SELECT *, NOT regexp_matches(ch, '[\\s\\p{{Z}}]') AND (NOT contains('{_MARKS}', ch) OR ch = '.' AND regexp_matches(a, '\\p{{Nd}}') OR ch IN (',', ':') AND regexp_matches(b, '\\p{{Nd}}') AND regexp_matches(a, '\\p{{Nd}}')
        OR ch IN (chr(39), '’') AND regexp_matches(b, '[\\p{{L}}\\p{{N}}]') AND regexp_matches(a, '[\\p{{L}}\\p{{N}}]')) AS kept FROM n)
    SELECT conv_id, turn, count(*) FILTER (WHERE kept) AS characters, md5(coalesce(string_agg(ch, '' ORDER BY pos) FILTER (WHERE kept), '')) AS digest FROM k GROUP BY conv_id, turn"""
)
def lexical_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a turn says without white space and formatting marks."""
    told = table(spark, sf_dir, "conversations").filter("text != ''").select("conv_id", "turn", normal.lexical_characters(F.col("text")).alias("t"))
    return told.select("conv_id", "turn", F.length("t").cast("long").alias("characters"), F.md5("t").alias("digest"))


@query("SELECT user_id, event_id // 40 AS frame, sqrt(avg(value * value)) >= 12 AS voiced, count(*) AS samples FROM events GROUP BY user_id, event_id // 40")
def voiced_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the level of each frame of a user passes the gate."""
    level = F.sqrt(F.avg(F.col("value") * F.col("value")))
    return table(spark, sf_dir, "events").groupBy("user_id", F.floor(F.col("event_id") / 40).alias("frame")).agg((level >= 12).alias("voiced"), F.count("*").alias("samples"))


@query(
    SPANS
    + """, seg AS (SELECT * FROM ok WHERE event_type = (SELECT min(event_type) FROM events)), oth AS (SELECT * FROM ok WHERE event_type <> (SELECT min(event_type) FROM events)),
    p AS (SELECT a.event_id, b.event_type AS speaker, sum(least(a.e, b.e) - greatest(a.s, b.s)) AS n FROM seg a JOIN oth b ON a.user_id = b.user_id AND a.s < b.e AND b.s < a.e GROUP BY ALL), d AS (SELECT event_id, max({'n': n, 'l': speaker})['l'] AS speaker FROM p GROUP BY event_id)
    SELECT seg.event_id, coalesce(speaker, seg.event_type) AS speaker, round(CASE WHEN speaker IS NULL THEN value ELSE least(value, 10) END, 6) AS score FROM seg LEFT JOIN d USING (event_id)"""
)
def attributed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the first type by name take the label that overlaps them most, and their score is capped if one does."""
    found = spans(spark, sf_dir).filter("end > start")
    first = found.agg(F.min("event_type")).first()[0]
    segments, others = found.filter(F.col("event_type") == first), found.filter(F.col("event_type") != first)
    best = intervals.dominant(segments.select("user_id", "event_id", "start", "end"), others, ["user_id"], "event_type", summed=True).select(F.col("l_event_id").alias("event_id"), F.col("event_type").alias("speaker"))
    told = segments.join(best, "event_id", "left")
    return told.select("event_id", F.coalesce("speaker", "event_type").alias("speaker"), F.round(F.when(F.col("speaker").isNull(), F.col("value")).otherwise(F.least("value", F.lit(10.0))), 6).alias("score"))


_SNAPS = "WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS w FROM conversations WHERE text IS NOT NULL), s1 AS (SELECT *, w[1:6] AS a FROM t WHERE len(w) >= 8), s2 AS (SELECT *, list_concat(a, w[5:6]) AS b FROM s1), s3 AS (SELECT *, list_concat(b, w[4:6]) AS c FROM s2), s4 AS (SELECT *, list_concat(c, CASE WHEN turn % 2 = 1 THEN w[7:8] ELSE w[3:5] END) AS d FROM s3)"


@query(_SNAPS + " SELECT conv_id, turn, len(list_filter(d[len(c) + 1:], lambda x: NOT list_contains(c[greatest(len(c) - 11, 1):], x))) = 0 AS stalled FROM s4")
def prefix_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether four growing readings of a turn stopped bringing anything new."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("w")).filter(F.size("w") >= 8)
    a = F.slice("w", 1, 6)
    b = F.concat(a, F.slice("w", 5, 2))
    c = F.concat(b, F.slice("w", 4, 3))
    d = F.concat(c, F.when(F.col("turn") % 2 == 1, F.slice("w", 7, 2)).otherwise(F.slice("w", 3, 3)))
    return turns.select("conv_id", "turn", normal.novelty_stalled([a, b, c, d]).alias("stalled"))


@query(
    PAIRS
    + rf", u AS (SELECT conv_id, turn, regexp_extract_all(ref, '{WORD}') AS a, regexp_extract_all(hyp, '{WORD}') AS b FROM p)"
    + DISTANCE
    + " SELECT conv_id, turn, len(a) AS reference, len(b) AS hypothesis, distance, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE distance / greatest(len(a), len(b))::DOUBLE END, 6) AS rate FROM m"
)
def cased_error_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors where case counts, and sentences without their marks."""
    both = pairs(spark, sf_dir).select("conv_id", "turn", texts.words(F.col("ref")).alias("a"), texts.words(F.col("hyp")).alias("b"))
    measured = both.select("conv_id", "turn", F.size("a").alias("reference"), F.size("b").alias("hypothesis"), evaluation.token_distance(F.col("a"), F.col("b")).alias("distance"))
    return measured.withColumn("rate", F.round(scores.normalised_distance(F.col("distance"), F.col("reference"), F.col("hypothesis")), 6))


@query(
    r"""WITH t AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM conversations WHERE text IS NOT NULL),
    g AS (SELECT conv_id, turn, len(w) AS n, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM t, range(3, 11) s(k), range(1, len(w) - k + 2) r(i)), c AS (SELECT conv_id, turn, n, k, g, count(*) AS times FROM g GROUP BY ALL),
    s AS (SELECT conv_id, turn, n, k, max(times) AS most, sum(times) FILTER (WHERE times >= 2) AS repeated FROM c GROUP BY ALL)
    SELECT conv_id, turn, max(most) AS most, round(max(coalesce(repeated, 0) / (n - k + 1)::DOUBLE), 6) AS repeated_share FROM s GROUP BY conv_id, turn"""
)
def fragment_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments of three to ten tokens of a turn: how often the most frequent occurs, and the largest share of fragments of a length that occur again."""
    turns = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text")
    sizes = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), repetition.ngram_repeats(F.col("text"), k, 2).alias("r")) for k in range(3, 11)))).alias("x")
    told = turns.select("conv_id", "turn", sizes).filter("x.r is not null")
    share = F.col("x.r.repeated") / (F.col("x.r.words") - F.col("x.k") + 1)
    return told.groupBy("conv_id", "turn").agg(F.max("x.r.most").alias("most"), F.round(F.max(share), 6).alias("repeated_share"))
