"""Queries over spans: an event of a user lasts from its second for ceil(600 value) seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import timeline
from chronoloom.operators import intervals
from chronoloom.plans.registry import query, table

SPANS = "WITH spans AS (SELECT event_id, user_id, event_type, value, epoch_us(ts)//1000000 AS s, epoch_us(ts)//1000000 + ceil(value*600)::BIGINT AS e FROM events), ok AS (SELECT * FROM spans WHERE e > s)"
ISLANDS = """, marked AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {t}),
 numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM marked),
 islands AS (SELECT {k}, min(s) AS s, max(e) AS e, max(value) AS value FROM numbered GROUP BY {k}, island)"""
#: Events of this value or more count as speech.
SPEECH = 0.5


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", start.alias("start"), (start + F.ceil(F.col("value") * 600)).alias("end"))


def of_type(df: DataFrame, kind: str) -> DataFrame:
    return df.filter(F.col("event_type") == kind)


@query(SPANS + ISLANDS.format(k="user_id", t="ok") + " SELECT user_id, sum(e - s)::BIGINT AS covered, count(*) AS islands FROM islands GROUP BY user_id")
def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge_spans(spans(spark, sf_dir), ["user_id"])
    return merged.groupBy("user_id").agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("islands"))


@query(SPANS + ISLANDS.format(k="user_id, event_type", t="ok") + " SELECT user_id, event_type, s AS start_s, e AS end_s, value FROM islands")
def interval_merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge_spans(spans(spark, sf_dir), ["user_id", "event_type"], score="value")
    return merged.select("user_id", "event_type", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "value")


@query(
    SPANS + ISLANDS.format(k="user_id", t="ok") + """ SELECT user_id, e AS gap_start, nxt AS gap_end, e + (nxt - e)//2 AS middle, CASE WHEN nxt - e <= 3600 THEN 'pause' ELSE 'break' END AS kind
    FROM (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt FROM islands) WHERE nxt IS NOT NULL"""
)
def gap_midpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.gaps(spans(spark, sf_dir), ["user_id"])
    kind = F.when(F.col("end") - F.col("start") <= 3600, "pause").otherwise("break")
    return found.select("user_id", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), "middle", kind.alias("kind"))


BY_TYPE = """, ua AS (SELECT * FROM ok WHERE event_type = (SELECT min(event_type) FROM events)), ub AS (SELECT * FROM ok WHERE event_type = (SELECT max(event_type) FROM events))"""


def _two_types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Spans of the first and the last event type by name, found by a filter on the aggregate."""
    found = spans(spark, sf_dir)
    ends = found.agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"))
    both = found.crossJoin(F.broadcast(ends))
    return both.filter("event_type = a").drop("a", "b"), both.filter("event_type = b").drop("a", "b")


@query(
    SPANS
    + BY_TYPE
    + """, cuts AS (SELECT user_id, s AS cut FROM ua UNION SELECT user_id, e FROM ua UNION SELECT user_id, s FROM ub UNION SELECT user_id, e FROM ub),
    atoms AS (SELECT user_id, cut AS s, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS e FROM cuts)
    SELECT user_id, sum(e - s)::BIGINT AS common FROM atoms WHERE e IS NOT NULL AND EXISTS (SELECT 1 FROM ua WHERE ua.user_id = atoms.user_id AND ua.s <= atoms.s AND ua.e >= atoms.e)
    AND EXISTS (SELECT 1 FROM ub WHERE ub.user_id = atoms.user_id AND ub.s <= atoms.s AND ub.e >= atoms.e) GROUP BY user_id"""
)
def interval_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.intersection_length(*_two_types(spark, sf_dir), ["user_id"])


@query(
    SPANS
    + BY_TYPE
    + """, cuts AS (SELECT user_id, s AS cut FROM ua UNION SELECT user_id, e FROM ua UNION SELECT user_id, s FROM ub UNION SELECT user_id, e FROM ub),
    atoms AS (SELECT user_id, cut AS s, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS e FROM cuts)
    SELECT ua.event_id, sum(atoms.e - atoms.s)::BIGINT AS left_over FROM ua JOIN atoms ON ua.user_id = atoms.user_id AND atoms.s >= ua.s AND atoms.e <= ua.e
    WHERE NOT EXISTS (SELECT 1 FROM ub WHERE ub.user_id = atoms.user_id AND ub.s <= atoms.s AND ub.e >= atoms.e) GROUP BY ua.event_id"""
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _two_types(spark, sf_dir)
    return intervals.subtract(a.select("user_id", "event_id", "start", "end"), b, ["user_id"]).groupBy("event_id").agg(F.sum(F.col("end") - F.col("start")).alias("left_over"))


@query(
    SPANS
    + """, cuts AS (SELECT user_id, s AS cut FROM ok UNION SELECT user_id, e FROM ok), atoms AS (SELECT user_id, cut AS s, lead(cut) OVER (PARTITION BY user_id ORDER BY cut) AS e FROM cuts),
    sets AS (SELECT a.user_id, a.s, a.e, string_agg(DISTINCT o.event_type, '+' ORDER BY o.event_type) AS labels, count(DISTINCT o.event_type) AS n FROM atoms a JOIN ok o ON a.user_id = o.user_id AND o.s < a.e AND o.e > a.s GROUP BY ALL),
    two AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(labels) OVER w = labels THEN 0 ELSE 1 END AS fresh FROM sets WHERE n >= 2 WINDOW w AS (PARTITION BY user_id ORDER BY s)),
    runs AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM two)
    SELECT user_id, labels, min(s) AS start_s, max(e) AS end_s FROM runs GROUP BY user_id, labels, run"""
)
def overlap_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.concurrent(spans(spark, sf_dir), ["user_id"], "event_type")
    return found.select("user_id", F.array_join("labels", "+").alias("labels"), F.col("start").alias("start_s"), F.col("end").alias("end_s"))


HOURS = ", hours AS (SELECT DISTINCT user_id, s//3600*3600 AS hs, s//3600*3600 + 3600 AS he FROM ok), pairs AS (SELECT h.*, o.event_type, o.value, o.s, o.e, least(o.e, he) - greatest(o.s, hs) AS shared FROM hours h JOIN ok o ON h.user_id = o.user_id AND o.s < he AND o.e > hs)"


def hours(df: DataFrame) -> DataFrame:
    start = F.floor(F.col("start") / 3600) * 3600
    return df.filter("end > start").select("user_id", start.alias("start"), (start + 3600).alias("end")).distinct()


@query(
    SPANS
    + HOURS
    + """ SELECT user_id, hs AS hour_s, shared, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hs ORDER BY shared DESC, value DESC, event_type DESC) AS n FROM pairs) WHERE n = 1"""
)
def dominant_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)
    return intervals.dominant(hours(found), found, ["user_id"], "event_type", confidence="value").select("user_id", F.col("l_start").alias("hour_s"), "shared", "event_type")


@query(
    SPANS
    + HOURS
    + """, sums AS (SELECT user_id, hs, event_type, sum(shared)::BIGINT AS shared FROM pairs GROUP BY ALL)
    SELECT user_id, hs AS hour_s, shared, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, hs ORDER BY shared DESC, event_type DESC) AS n FROM sums) WHERE n = 1"""
)
def dominant_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)
    return intervals.dominant(hours(found), found, ["user_id"], "event_type", summed=True).select("user_id", F.col("l_start").alias("hour_s"), "shared", "event_type")


@query(SPANS + HOURS + " SELECT user_id, hs AS hour_s, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS labels FROM pairs WHERE shared >= 250 GROUP BY user_id, hs")
def overlap_with_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)
    met = intervals.overlap_labels(hours(found), found, ["user_id"], "event_type", 250)
    return met.select("user_id", F.col("l_start").alias("hour_s"), F.array_join("labels", "+").alias("labels"))


@query(SPANS + HOURS + " SELECT user_id, hs AS hour_s, round(least(1.0, sum(shared)::DOUBLE / 3600), 6) AS coverage FROM pairs GROUP BY user_id, hs")
def coverage_summed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)
    return intervals.summed_coverage(hours(found), found, ["user_id"]).select("user_id", F.col("l_start").alias("hour_s"), F.round("coverage", 6).alias("coverage"))


@query(
    SPANS
    + ISLANDS.format(k="user_id", t="ok")
    + """ SELECT h.user_id, h.hs AS hour_s, round(sum(least(i.e, h.hs + 3600) - greatest(i.s, h.hs))::DOUBLE / 3600, 6) AS coverage
    FROM (SELECT DISTINCT user_id, s//3600*3600 AS hs FROM ok) h JOIN islands i ON h.user_id = i.user_id AND i.s < h.hs + 3600 AND i.e > h.hs GROUP BY ALL"""
)
def coverage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir)
    met = intervals.overlap_join(hours(found), intervals.merge_spans(found, ["user_id"]), ["user_id"])
    return met.groupBy("user_id", F.col("l_start").alias("hour_s")).agg(F.round(F.sum("shared") / 3600, 6).alias("coverage"))


@query(
    SPANS
    + """ SELECT event_id, user_id, coalesce(nxt - e, 700) AS pause, coalesce(nt <> event_type, FALSE) AS changed
    FROM (SELECT *, lead(s) OVER w AS nxt, lead(event_type) OVER w AS nt FROM spans WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id))"""
)
def asof_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("start", "event_id")
    changed = F.coalesce(F.lead("event_type").over(order) != F.col("event_type"), F.lit(False))
    return spans(spark, sf_dir).select("event_id", "user_id", F.coalesce(F.lead("start").over(order) - F.col("end"), F.lit(700).cast("long")).alias("pause"), changed.alias("changed"))


@query(
    SPANS
    + """ SELECT event_id, user_id, coalesce(max(CASE WHEN value < 0.5 THEN s END) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS last_quiet,
    greatest(0, coalesce(s - lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id), 0)) AS pause_before FROM spans"""
)
def asof_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("start", "event_id")
    quiet = F.max(F.when(F.col("value") < SPEECH, F.col("start"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    pause = F.greatest(F.lit(0).cast("long"), F.coalesce(F.col("start") - F.lag("end").over(order), F.lit(0).cast("long")))
    return spans(spark, sf_dir).select("event_id", "user_id", F.coalesce(quiet, F.lit(-1).cast("long")).alias("last_quiet"), pause.alias("pause_before"))


@query(
    SPANS
    + """, f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached, lag(e) OVER (PARTITION BY user_id ORDER BY s, event_id) AS before FROM spans)
    SELECT user_id, count(*) FILTER (WHERE e <= s) AS empty_spans, count(*) FILTER (WHERE s < reached) AS overlaps_any, count(*) FILTER (WHERE s < before) AS overlaps_last FROM f GROUP BY user_id"""
)
def timeline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("start", "event_id")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans(spark, sf_dir).withColumn("reached", reached).withColumn("before", F.lag("end").over(order))
    return marked.groupBy("user_id").agg(
        F.count_if(F.col("end") <= F.col("start")).alias("empty_spans"), F.count_if(F.col("start") < F.col("reached")).alias("overlaps_any"), F.count_if(F.col("start") < F.col("before")).alias("overlaps_last")
    )


@query(
    SPANS
    + """, voiced AS (SELECT * FROM ok WHERE value >= 0.5),
    a AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) < 900 THEN 0 ELSE 1 END AS fresh FROM voiced),
    b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM a),
    c AS (SELECT user_id, greatest(0, min(s) - 60) AS s, max(e) + 60 AS e, max(value) AS value FROM b GROUP BY user_id, run HAVING max(e) - min(s) >= 600)"""
    + ISLANDS.format(k="user_id", t="c")
    + " SELECT user_id, s AS start_s, e AS end_s, value AS score FROM islands"
)
def speech_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = spans(spark, sf_dir).withColumnRenamed("value", "score")
    found = intervals.sessions(frames, ["user_id"], active=F.col("score") >= SPEECH, silence=900, least=600, pad=60)
    return found.select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"), "score")


TOTALS = ", totals AS (SELECT user_id, max(e) - min(s) AS total FROM ok GROUP BY user_id)"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans(spark, sf_dir).filter("end > start").groupBy("user_id").agg((F.max("end") - F.min("start")).alias("total"))


@query(
    SPANS
    + TOTALS
    + """ SELECT DISTINCT user_id, start_s, least(start_s + 172800, total) AS end_s FROM (SELECT user_id, total, unnest(CASE WHEN total > 172800 THEN list_concat(generate_series(0, total - 172800, 86400), [total - 172800]) ELSE [0::BIGINT] END) AS start_s FROM totals)"""
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.sliding_windows(totals(spark, sf_dir), width=172_800, step=86_400)
    return found.select("user_id", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query(
    SPANS
    + TOTALS
    + """, n AS (SELECT user_id, total, unnest(generate_series(0, greatest(1, ceil((total - 3600)::DOUBLE / 429600)::BIGINT) - 1)) AS ordinal FROM totals)
    SELECT user_id, ordinal, CASE WHEN least(ordinal*429600 + 433200, total) - ordinal*429600 < 144000 THEN greatest(0, least(ordinal*429600 + 433200, total) - 144000) ELSE ordinal*429600 END AS start_s, least(ordinal*429600 + 433200, total) AS end_s FROM n"""
)
def structure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = intervals.bounded_windows(totals(spark, sf_dir), width=433_200, shared=3_600, least=144_000)
    return found.select("user_id", "ordinal", F.col("start").alias("start_s"), F.col("end").alias("end_s"))


@query(
    SPANS
    + """ SELECT event_id, part, s + ((e - s) * part)//4 AS start_s, s + ((e - s) * (part + 1))//4 AS end_s FROM ok, (SELECT unnest([0, 1, 2, 3]) AS part)"""
)
def even_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spans(spark, sf_dir).filter("end > start").select("event_id", F.explode(timeline.parts(F.col("start"), F.col("end"), 4)).alias("p"))
    return cut.select("event_id", "p.part", F.col("p.start").alias("start_s"), F.col("p.end").alias("end_s"))


@query(
    SPANS
    + """, r AS (SELECT min(s) AS lo, max(e) - min(s) AS len FROM ok), b AS (SELECT o.*, unnest(generate_series(((s - lo) * 256)//len, least(255, ((e - 1 - lo) * 256)//len))) AS bin FROM ok o, r)
    SELECT bin, count(DISTINCT event_type) AS labels, count(DISTINCT user_id) AS users FROM b GROUP BY bin"""
)
def timeline_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir).filter("end > start")
    reach = found.agg(F.min("start").alias("lo"), (F.max("end") - F.min("start")).alias("len"))
    at = lambda x: F.floor((x - F.col("lo")) * 256 / F.col("len"))
    placed = found.crossJoin(F.broadcast(reach)).withColumn("bin", F.explode(F.sequence(at(F.col("start")), F.least(F.lit(255).cast("long"), at(F.col("end") - 1)))))
    return placed.groupBy("bin").agg(F.countDistinct("event_type").alias("labels"), F.countDistinct("user_id").alias("users"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, date_diff('day', ts::DATE, (SELECT max(ts)::DATE FROM events)) <= 7 AS recent FROM events GROUP BY ALL")
def calendar_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = F.broadcast(events.agg(F.max("day").alias("last")))
    counts = events.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return counts.crossJoin(last).select(F.col("day").cast("string").alias("day"), "event_type", "n", (F.datediff("last", "day") <= 7).alias("recent"))


@query(
    """WITH x AS (SELECT event_id, (value * 1600000)::BIGINT AS sample FROM events), m AS (SELECT event_id, sample, (sample*2 + 16)//32 AS ms FROM x)
    SELECT event_id, sample, ms, lpad((ms//3600000)::VARCHAR, 2, '0') || ':' || lpad((ms//60000%60)::VARCHAR, 2, '0') || ':' || lpad((ms//1000%60)::VARCHAR, 2, '0') || '.' || lpad((ms%1000)::VARCHAR, 3, '0') AS clock FROM m"""
)
def sample_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = F.round(F.col("value") * 1_600_000).cast("long")
    named = table(spark, sf_dir, "events").select("event_id", sample.alias("sample"))
    return named.select("event_id", "sample", timeline.milliseconds(F.col("sample")).alias("ms"), timeline.clock(F.col("sample")).alias("clock"))


@query(
    SPANS
    + """, q AS (SELECT event_id, user_id, s, e FROM ok WHERE event_id % 50 = 0), d AS (SELECT q.event_id, o.event_id AS other, greatest(0, greatest(q.s, o.s) - least(q.e, o.e)) AS distance FROM q JOIN ok o ON q.user_id = o.user_id AND o.event_id <> q.event_id)
    SELECT event_id, min(distance)::BIGINT AS distance, count(*) FILTER (WHERE distance = least_) AS nearest FROM (SELECT *, min(distance) OVER (PARTITION BY event_id) AS least_ FROM d) GROUP BY event_id"""
)
def nearest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(spark, sf_dir).filter("end > start")
    return intervals.nearest(found.filter("event_id % 50 = 0").select("user_id", "event_id", "start", "end"), found, ["user_id"], "event_id")
