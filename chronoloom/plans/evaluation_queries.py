"""Queries that score and rank: a document's source is a model, its language a task, labels are gold, embeddings are voices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import scores
from chronoloom.operators import evaluation, intervals, neighbours
from chronoloom.plans.interval_queries import SPANS, spans
from chronoloom.plans.metric_queries import DISTANCE, WORD
from chronoloom.plans.registry import query, table

PENALTIES = {"empty": 1.0, "short": 0.3, "shouting": 0.4, "symbols": 0.5, "no_sentence": 0.15}


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")


@query(
    """WITH m AS (SELECT lang, source, avg(quality) AS quality, avg(toxic) AS toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, source),
    s AS (SELECT *, round(0.7 * quality + 0.3 * (1 - toxic), 6) AS score, n >= 3 AND quality >= 0.5 AS eligible, concat_ws(',', CASE WHEN n < 3 THEN 'coverage' END, CASE WHEN quality < 0.5 THEN 'quality' END) AS violations FROM m)
    SELECT lang, source, score, eligible, violations, row_number() OVER (PARTITION BY lang ORDER BY eligible DESC, score DESC, source) AS rank FROM s"""
)
def model_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = labelled(spark, sf_dir).groupBy("lang", "source").agg(F.avg("quality").alias("quality"), F.avg("toxic").alias("toxic"), F.count("*").alias("n"))
    score = F.round(0.7 * F.col("quality") + 0.3 * (1 - F.col("toxic")), 6)
    out = evaluation.ranked(models, ["lang"], score=score, violations={"coverage": F.col("n") < 3, "quality": F.col("quality") < 0.5}, key="source")
    return out.select("lang", "source", "score", "eligible", F.array_join("violations", ",").alias("violations"), F.col("rank").cast("long").alias("rank"))


@query("SELECT source, round(avg(pow(least(1.0, n_chars / 4000.0::DOUBLE) - quality, 2)), 6) AS brier, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source")
def brier_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0))
    return labelled(spark, sf_dir).groupBy("source").agg(F.round(evaluation.brier(p, F.col("quality")), 6).alias("brier"), F.count("*").alias("n"))


@query()
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("doc_id") % 10 < 6, "train").when(F.col("doc_id") % 10 < 8, "validation").otherwise("test")
    samples = labelled(spark, sf_dir).select("lang", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("x"), "quality", part.alias("part"))
    return evaluation.calibrated(samples, ["lang"], score="x", label="quality", split="part")


@query(
    """SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(list_sort(list(value))[1 + floor((count(value) - 1) * 0.95)::BIGINT], 6) AS p95_cut,
    count(*) FILTER (WHERE value >= 1) AS slow, round(max(value), 6) AS peak FROM events GROUP BY event_type"""
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value is not null")
    ranked = neighbours.ranked_values(events, ["event_type"], "value")
    half = neighbours.quantiles(ranked, ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    # the truncated index picks a row of the sorted values
    cut = ranked.filter(F.col("upto") >= F.floor((F.col("total") - 1) * F.lit(0.95)) + 1).groupBy("event_type").agg(F.round(F.min("value"), 6).alias("p95_cut"))
    base = events.groupBy("event_type").agg(F.count_if(F.col("value") >= 1).alias("slow"), F.round(F.max("value"), 6).alias("peak"))
    return base.join(half, "event_type").join(cut, "event_type").select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "p95_cut", "slow", "peak")


@query(
    """SELECT l_returnflag, round(sum(l_quantity)::DOUBLE / greatest(sum(l_extendedprice), 1e-9), 8) AS rtf, max(l_discount)::DOUBLE AS peak, round(quantile_cont(l_extendedprice::DOUBLE, 0.5), 4) AS p50,
    round(quantile_cont(l_extendedprice::DOUBLE, 0.95), 4) AS p95, 1.0::DOUBLE AS observed FROM lineitem GROUP BY l_returnflag"""
)
def performance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", *(F.col(c).cast("double").alias(c) for c in ("l_quantity", "l_extendedprice", "l_discount")))
    out = evaluation.performance(lines, ["l_returnflag"], busy="l_quantity", length="l_extendedprice", latency="l_extendedprice", peak="l_discount")
    return out.select("l_returnflag", F.round("rtf", 8).alias("rtf"), "peak", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "observed")


@query(
    """WITH r AS (SELECT DISTINCT event_type, user_id % 7 AS record FROM events), all_ AS (SELECT event_type, count(*) AS records FROM r GROUP BY event_type),
    v AS (SELECT event_type, user_id % 7 AS record, 'h' || hour(ts)::VARCHAR AS metric, avg(value) AS value FROM events WHERE value > 0.1 GROUP BY ALL)
    SELECT event_type, metric, round(avg(value), 6) AS mean FROM v JOIN all_ USING (event_type) GROUP BY event_type, metric, records HAVING count(*) = records"""
)
def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("record", F.col("user_id") % 7)
    records = events.groupBy("event_type").agg(F.countDistinct("record").alias("records"))
    values = events.filter("value > 0.1").groupBy("event_type", "record", F.concat(F.lit("h"), F.hour("ts").cast("string")).alias("metric")).agg(F.avg("value").alias("value"))
    return evaluation.shared_mean(values.join(records, "event_type"), ["event_type"]).select("event_type", "metric", F.round("mean", 6).alias("mean"))


@query(
    """WITH g AS (SELECT source, lang, avg(quality) AS q, avg(toxic) AS t FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
    SELECT source, bool_and(q >= 0.5) AS quality_ok, bool_and(t <= 0.5) AS toxic_ok, bool_and(q >= 0.5 AND t <= 0.5) AS passed, count(*) AS langs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS names FROM g GROUP BY source"""
)
def release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = labelled(spark, sf_dir).groupBy("source", "lang").agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"))
    good, mild = F.col("q") >= 0.5, F.col("t") <= 0.5
    return by.groupBy("source").agg(
        F.bool_and(good).alias("quality_ok"), F.bool_and(mild).alias("toxic_ok"), F.bool_and(good & mild).alias("passed"), F.count("*").alias("langs"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("names")
    )


@query(
    """WITH f AS (SELECT doc_id, text = '' AS empty, length(text) < 40 AS short, len(regexp_extract_all(text, '[A-Z]')) > 0.5 * length(text) AS shouting, len(regexp_extract_all(text, '[*%#&$|]')) > 0.05 * length(text) AS symbols, NOT regexp_matches(text, '[.!?]') AS no_sentence FROM documents),
    s AS (SELECT *, 1.0 - (empty::INT * 1.0 + short::INT * 0.3 + shouting::INT * 0.4 + symbols::INT * 0.5 + no_sentence::INT * 0.15) AS raw FROM f)
    SELECT doc_id, concat_ws(',', CASE WHEN empty THEN 'empty' END, CASE WHEN short THEN 'short' END, CASE WHEN shouting THEN 'shouting' END, CASE WHEN symbols THEN 'symbols' END, CASE WHEN no_sentence THEN 'no_sentence' END) AS issues,
    round(greatest(0.0, least(1.0, raw)), 6)::DOUBLE AS score, CASE WHEN greatest(0.0, least(1.0, raw)) < 0.62 THEN 'tertiary' WHEN greatest(0.0, least(1.0, raw)) < 0.82 THEN 'secondary' ELSE 'accept' END AS route FROM s"""
)
def quality_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, n = F.col("text"), F.length("text")
    rules = {
        "empty": text == "",
        "short": n < 40,
        "shouting": F.regexp_count(text, F.lit("[A-Z]")) > 0.5 * n,
        "symbols": F.regexp_count(text, F.lit("[*%#&$|]")) > 0.05 * n,
        "no_sentence": ~text.rlike("[.!?]"),
    }
    found = table(spark, sf_dir, "documents").select("doc_id", F.array_compact(F.array(*(F.when(r, F.lit(k)) for k, r in rules.items()))).alias("issues"))
    score = F.round(evaluation.issue_score(F.col("issues"), PENALTIES), 6)
    route = F.when(F.col("score") < 0.62, "tertiary").when(F.col("score") < 0.82, "secondary").otherwise("accept")
    return found.withColumn("score", score).select("doc_id", F.array_join("issues", ",").alias("issues"), "score", route.alias("route"))


@query(
    """WITH v AS (SELECT user_id, event_type AS token, sum(round(value * 1000)::BIGINT) AS w FROM events GROUP BY ALL)
    SELECT user_id, token, round(w::DOUBLE / total, 6) AS support FROM (SELECT *, sum(w) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, token DESC) AS n FROM v) WHERE n = 1 AND total > 0"""
)
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    ballots = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("token"), F.round(F.col("value") * 1000).cast("long").alias("weight"))
    return evaluation.votes(ballots, ["user_id"], "token", "weight").select("user_id", "token", F.round("support", 6).alias("support"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


@query(
    """WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS dim, 1 + vec_id % 3 AS w FROM embeddings), c AS (SELECT label, dim, sum(v * w) / sum(w) AS v FROM x GROUP BY label, dim)
    SELECT label, (dim - 1)::BIGINT AS dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY label)), 6) AS value FROM c"""
)
def weighted_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = vectors(spark, sf_dir).select("label", (1 + F.col("vec_id") % 3).alias("w"), F.posexplode("embedding").alias("dim", "v"))
    mean = cells.groupBy("label", "dim").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("v"))
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy("label")))
    return mean.select("label", F.col("dim").cast("long").alias("dim"), F.round(F.col("v") / norm, 6).alias("value"))


@query(
    """SELECT q.vec_id AS vec_id, b.vec_id AS other, round(list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id
    WHERE q.vec_id % 50 = 0 AND list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3"""
)
def cosine_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector against all; the asked side goes to the scan in blocks of a bounded number of vectors."""
    from chronoloom.operators.vectors import similar_to

    found = vectors(spark, sf_dir)
    return similar_to(found.filter("vec_id % 50 = 0"), found, key="vec_id", vector="embedding", least=0.3).select("vec_id", "other", F.round("similarity", 6).alias("similarity"))


@query()
def greedy_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user's first half against those of the other, one to one by shared hours of day."""
    found = spans(spark, sf_dir).filter("end > start").withColumn("hour", F.floor(F.col("start") % 86400 / 3600)).withColumn("half", F.col("event_id") % 2)
    side = lambda h, name: found.filter(F.col("half") == h).groupBy("user_id", "hour", F.col("event_type").alias(name)).agg(F.sum(F.col("end") - F.col("start")).alias(f"{name}_n"))
    pairs = side(0, "left").join(side(1, "right"), ["user_id", "hour"]).groupBy("user_id", "left", "right").agg(F.sum(F.least("left_n", "right_n")).alias("weight"))
    return evaluation.greedy_pairs(pairs, ["user_id"], "left", "right", "weight")


@query(
    SPANS
    + """, r AS (SELECT user_id, event_type AS speaker, s, e FROM ok WHERE event_id % 2 = 0), h AS (SELECT user_id, event_type AS speaker, s, e FROM ok WHERE event_id % 2 = 1),
    cuts AS (SELECT user_id, s AS cut FROM r UNION SELECT user_id, e FROM r UNION SELECT user_id, s FROM h UNION SELECT user_id, e FROM h),
    atoms AS (SELECT user_id, cut AS s, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS e FROM cuts),
    nr AS (SELECT a.user_id, a.s, any_value(a.e) AS e, count(DISTINCT r.speaker) AS n FROM atoms a JOIN r ON r.user_id = a.user_id AND r.s < a.e AND r.e > a.s GROUP BY a.user_id, a.s),
    nh AS (SELECT a.user_id, a.s, any_value(a.e) AS e, count(DISTINCT h.speaker) AS n FROM atoms a JOIN h ON h.user_id = a.user_id AND h.s < a.e AND h.e > a.s GROUP BY a.user_id, a.s),
    b AS (SELECT a.user_id, a.s, any_value(a.e) AS e, count(DISTINCT r.speaker) AS n FROM atoms a JOIN r ON r.user_id = a.user_id AND r.s < a.e AND r.e > a.s JOIN h ON h.user_id = a.user_id AND h.s < a.e AND h.e > a.s AND h.speaker = r.speaker GROUP BY a.user_id, a.s),
    w AS (SELECT a.user_id, a.e - a.s AS len, coalesce(nr.n, 0) AS r, coalesce(nh.n, 0) AS h, coalesce(b.n, 0) AS b FROM atoms a LEFT JOIN nr ON nr.user_id = a.user_id AND nr.s = a.s LEFT JOIN nh ON nh.user_id = a.user_id AND nh.s = a.s LEFT JOIN b ON b.user_id = a.user_id AND b.s = a.s WHERE a.e IS NOT NULL)
    SELECT user_id, sum(len * greatest(0, r - h))::BIGINT AS missed, sum(len * greatest(0, h - r))::BIGINT AS false_alarm, sum(len * (least(r, h) - b))::BIGINT AS confusion, sum(len * r)::BIGINT AS reference,
    round(sum(len * (greatest(r, h) - b))::DOUBLE / greatest(1, sum(len * r)), 6) AS der FROM w GROUP BY user_id"""
)
def diarization_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chronoloom.operators.speakers import diarization_errors

    found = spans(spark, sf_dir).withColumnRenamed("event_type", "speaker")
    out = diarization_errors(found.filter("event_id % 2 = 0"), found.filter("event_id % 2 = 1"), ["user_id"])
    return out.withColumn("der", F.round("der", 6))


@query(
    SPANS
    + """, m AS (SELECT user_id, event_type, s, e, event_id % 2 AS side FROM ok), cuts AS (SELECT user_id, event_type, s AS cut FROM m UNION SELECT user_id, event_type, e FROM m),
    atoms AS (SELECT user_id, event_type, cut AS s, lead(cut) OVER (PARTITION BY user_id, event_type ORDER BY cut) AS e FROM cuts),
    f AS (SELECT a.user_id, a.event_type, a.s, any_value(a.e) AS e, bool_or(side = 0) AS r, bool_or(side = 1) AS h FROM atoms a JOIN m ON m.user_id = a.user_id AND m.event_type = a.event_type AND m.s < a.e AND m.e > a.s GROUP BY a.user_id, a.event_type, a.s),
    j AS (SELECT user_id, event_type, 1 - coalesce(sum(e - s) FILTER (WHERE r AND h), 0)::DOUBLE / sum(e - s) AS error, bool_or(r) AS has_r FROM f GROUP BY user_id, event_type) SELECT user_id, round(avg(error), 6) AS jer, count(*) AS speakers FROM j WHERE has_r GROUP BY user_id"""
)
def jaccard_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)
    key = ["user_id", "event_type"]
    ref, hyp = found.filter("event_id % 2 = 0"), found.filter("event_id % 2 = 1")
    speakers = ref.filter("end > start").select(*key).distinct()
    joined = speakers.join(intervals.union_length(found, key, "either"), key).join(intervals.intersection_length(ref, hyp, key), key, "left")
    error = 1 - F.coalesce("common", F.lit(0)) / F.col("either")
    return joined.groupBy("user_id").agg(F.round(F.avg(error), 6).alias("jer"), F.count("*").alias("speakers"))


@query(
    """WITH w AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS words, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations),
    p AS (SELECT conv_id, turn, words AS a, list_distinct(regexp_extract_all(lower(nxt), '[a-z]+')) AS b FROM w WHERE nxt IS NOT NULL),
    c AS (SELECT conv_id, turn, len(list_intersect(a, b)) AS tp, len(b) - len(list_intersect(a, b)) AS fp, len(a) - len(list_intersect(a, b)) AS fn FROM p)
    SELECT conv_id, turn, tp, fp, fn, round(2 * (tp::DOUBLE / greatest(1, tp + fp)) * (tp::DOUBLE / greatest(1, tp + fn)) / greatest(1e-12, tp::DOUBLE / greatest(1, tp + fp) + tp::DOUBLE / greatest(1, tp + fn)), 6) AS f1 FROM c"""
)
def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(order)).filter("next is not null").select("conv_id", "turn", found("text").alias("a"), found("next").alias("b"))
    tp = F.size(F.array_intersect("a", "b")).cast("long")
    counted = pairs.select("conv_id", "turn", tp.alias("tp"), (F.size("b") - tp).alias("fp"), (F.size("a") - tp).alias("fn"))
    p, r = scores.precision(F.col("tp"), F.col("fp")), scores.recall(F.col("tp"), F.col("fn"))
    return counted.withColumn("f1", F.round(scores.f1(p, r), 6))


@query(
    rf"""WITH c AS (SELECT conv_id, turn, text AS ref, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS hyp FROM conversations), u AS (SELECT conv_id, turn, coalesce(regexp_extract_all(ref, '{WORD}'), []) AS a, regexp_extract_all(hyp, '{WORD}') AS b FROM c WHERE hyp IS NOT NULL)"""
    + DISTANCE
    + """ SELECT conv_id, turn, len(a) AS reference, len(b) AS hypothesis, distance, round(CASE WHEN len(a) > 0 THEN distance / len(a)::DOUBLE WHEN len(b) > 0 THEN 1 ELSE 0 END, 6) AS wer,
    round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 0 ELSE distance / greatest(len(a), len(b))::DOUBLE END, 6) AS normalised FROM m"""
)
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each turn against those of the next one of its conversation."""
    from chronoloom.functions.text import words

    order = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(order)).filter("next is not null")
    split = pairs.select("conv_id", "turn", words(F.col("text")).alias("a"), words(F.col("next")).alias("b"))
    measured = split.select("conv_id", "turn", F.size("a").alias("reference"), F.size("b").alias("hypothesis"), evaluation.token_distance(F.col("a"), F.col("b")).alias("distance"))
    wer = scores.error_rate(F.col("distance"), F.col("reference"), F.col("hypothesis"))
    return measured.withColumn("wer", F.round(wer, 6)).withColumn("normalised", F.round(scores.normalised_distance(F.col("distance"), F.col("reference"), F.col("hypothesis")), 6))
