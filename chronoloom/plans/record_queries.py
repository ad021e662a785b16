"""Queries on versioned records, reference guards, provenance and candidate links, over the order tables and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.operators import versions
from chronoloom.plans.registry import query, table


@query(
    """WITH b AS (SELECT o_orderkey, o_orderkey % 3 AS version, o_orderstatus AS status FROM orders), c AS (SELECT l_orderkey AS o_orderkey, l_linenumber % 3 AS expected, l_linestatus || l_returnflag AS status FROM lineitem WHERE l_linenumber < 4),
    n AS (SELECT b.o_orderkey, b.version, b.status, min(c.status) FILTER (WHERE c.expected = b.version) AS fresh, count(c.expected) AS asks FROM b LEFT JOIN c ON b.o_orderkey = c.o_orderkey GROUP BY ALL)
    SELECT o_orderkey, version + CASE WHEN fresh IS NULL THEN 0 ELSE 1 END AS version, coalesce(fresh, status) AS status, CASE WHEN fresh IS NOT NULL THEN 'applied' WHEN asks > 0 THEN 'stale' ELSE 'kept' END AS outcome FROM n"""
)
def versioned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines ask to change their order's status, each expecting a version."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("version"), F.col("o_orderstatus").alias("status"))
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber < 4")
    changes = lines.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") % 3).cast("long").alias("expected"), F.concat("l_linestatus", "l_returnflag").alias("status"))
    return versions.versioned_update(base, changes, ["o_orderkey"], "status")


@query(
    """WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, turn, CASE WHEN role = 'system' OR turn % 4 < 2 THEN 'edit' WHEN turn % 4 = 2 THEN 'undo' ELSE 'redo' END AS act FROM conversations),
    f AS (SELECT conv_id, 0::BIGINT AS n, []::BIGINT[] AS done, []::BIGINT[] AS gone FROM (SELECT DISTINCT conv_id FROM l) UNION ALL
        SELECT f.conv_id, l.n, CASE WHEN act = 'edit' THEN list_append(done, l.turn) WHEN act = 'undo' AND len(done) > 0 THEN done[1:len(done) - 1] WHEN act = 'redo' AND len(gone) > 0 THEN list_append(done, gone[len(gone)]) ELSE done END,
        CASE WHEN act = 'edit' THEN [] WHEN act = 'undo' AND len(done) > 0 THEN list_append(gone, done[len(done)]) WHEN act = 'redo' AND len(gone) > 0 THEN gone[1:len(gone) - 1] ELSE gone END FROM f JOIN l ON l.conv_id = f.conv_id AND l.n = f.n + 1)
    SELECT conv_id, done[len(done)] AS turn, len(done) AS edits, len(gone) AS undone FROM f WHERE (conv_id, n) IN (SELECT (conv_id, count(*)) FROM l GROUP BY conv_id)"""
)
def undo_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a log of edits, undos and redos."""
    act = F.when((F.col("role") == "system") | (F.col("turn") % 4 < 2), "edit").when(F.col("turn") % 4 == 2, "undo").otherwise("redo")
    log = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("at"), act.alias("act"), "turn")
    return versions.undo_redo(log, "conv_id", "at", "act", "turn")


@query(
    """WITH c AS (SELECT o_custkey AS c_custkey, o_orderpriority AS priority, o_orderkey, o_totalprice FROM orders WHERE o_custkey % 5 <> 0),
    stored AS (SELECT DISTINCT o_custkey AS c_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS n FROM c WHERE c_custkey NOT IN (SELECT c_custkey FROM stored)) WHERE n = 1"""
)
def submitted_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order of each customer who has no urgent one."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_custkey").alias("c_custkey")
    return versions.submit_once(orders.filter("o_orderpriority = '1-URGENT'").select(key), orders.filter("o_custkey % 5 != 0").select(key, "o_orderkey", "o_totalprice"), "c_custkey", "o_orderkey")


@query(
    """WITH doomed AS (SELECT p_partkey FROM part WHERE p_size % 7 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')), p AS (SELECT * FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM doomed))
    SELECT p_brand, count(*) AS parts, sum(n)::BIGINT AS lines FROM p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM doomed) GROUP BY 1) l ON l.l_partkey = p.p_partkey GROUP BY p_brand"""
)
def cascade_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of some sizes go with their lines, unless one was returned."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    parts, left = versions.cascade(table(spark, sf_dir, "part"), F.col("p_size") % 7 == 0, lines, "p_partkey", lines.filter("l_returnflag = 'R'"))
    counts = left.groupBy("p_partkey").agg(F.count("*").alias("n"))
    return parts.join(counts, "p_partkey", "left").groupBy("p_brand").agg(F.count("*").alias("parts"), F.sum("n").alias("lines"))


@query(
    """WITH fresh AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS quantity FROM lineitem WHERE l_shipdate >= (SELECT max(l_shipdate) - INTERVAL 200 DAY FROM lineitem)), r AS (SELECT l_orderkey, l_linenumber, l_quantity AS quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM fresh) UNION ALL SELECT * FROM fresh)
    SELECT l_orderkey, count(*) AS lines, sum(quantity) AS quantity FROM r GROUP BY l_orderkey"""
)
def replaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order with late lines keeps only those, doubled: its rows are replaced as a whole."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("quantity"), "l_shipdate")
    last = lines.agg(F.max("l_shipdate").alias("last"))
    late = lines.join(F.broadcast(last), F.col("l_shipdate") >= F.col("last") - F.expr("INTERVAL 200 DAYS"))  # one row
    fresh = late.select("l_orderkey", "l_linenumber", (F.col("quantity") * 2).alias("quantity"))
    out = versions.replace_keys(lines.drop("l_shipdate"), fresh, ["l_orderkey"])
    return out.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("quantity").alias("quantity"))


@query("SELECT o_orderkey, coalesce(lag(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey), 0) AS supersedes FROM orders")
def candidate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order with the one of the same customer and priority that came before it, 0 for the first."""
    orders = table(spark, sf_dir, "orders")
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderdate", "o_orderkey"))
    return orders.select("o_orderkey", F.coalesce(before, F.lit(0)).alias("supersedes"))


@query(
    """WITH touched AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R' OR l_linestatus IS NULL OR l_discount > 0.09)
    SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM touched) THEN o_totalprice ELSE 0.0 END AS price, o_orderkey NOT IN (SELECT l_orderkey FROM touched) AS imported FROM orders"""
)
def guarded_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders are imported anew (price 0) only if none of their lines was touched."""
    touched = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' or l_linestatus is null or l_discount > 0.09").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("touched", F.lit(True))
    told = table(spark, sf_dir, "orders").join(touched, "o_orderkey", "left")
    return told.select("o_orderkey", F.when(F.col("touched"), F.col("o_totalprice")).otherwise(0.0).alias("price"), F.col("touched").isNull().alias("imported"))


@query(
    """WITH c AS (SELECT DISTINCT sha256('{"lang":"' || lang || '","source":"' || source || '"}') AS k, lang FROM documents WHERE doc_id % 2 = 0 AND lang IS NOT NULL AND source IS NOT NULL)
    SELECT d.doc_id, sha256('{"lang":"' || d.lang || '","source":"' || d.source || '"}') AS cache_key, c.k IS NOT NULL AS hit FROM documents d LEFT JOIN c ON c.k = sha256('{"lang":"' || d.lang || '","source":"' || d.source || '"}') WHERE d.lang IS NOT NULL AND d.source IS NOT NULL"""
)
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests found in a cache by the digest of their canonical JSON; the others are still to do."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    asked = docs.select("doc_id", F.sha2(F.to_json(F.struct("lang", "source")), 256).alias("cache_key"))
    stored = asked.filter("doc_id % 2 = 0").select("cache_key").distinct().withColumn("stored", F.lit(True))
    return asked.join(stored, "cache_key", "left").select("doc_id", "cache_key", F.col("stored").isNotNull().alias("hit"))


@query("SELECT lang, 'und,' || string_agg(DISTINCT source, ',' ORDER BY source) AS vocabulary, 1 + count(DISTINCT source) AS size FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang")
def vocabularies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed vocabulary and the sources seen, in order, each once."""
    docs = table(spark, sf_dir, "documents").filter("lang is not null and source is not null")
    both = F.array_distinct(F.concat(F.array(F.lit("und")), F.array_sort(F.collect_set("source"))))
    return docs.groupBy("lang").agg(both.alias("v")).select("lang", F.array_join("v", ",").alias("vocabulary"), F.size("v").cast("long").alias("size"))


@query(
    """WITH u AS (SELECT user_id, epoch_us(ts) // 60000000 AS minute, event_type AS kind, 1 AS rank, event_id, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT user_id, epoch_us(ts) // 60000000, 'any', 2, event_id, value FROM events WHERE event_id % 2 = 1)
    SELECT user_id, minute, kind, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, minute, kind ORDER BY rank DESC, event_id DESC) AS n FROM u) WHERE n = 1"""
)
def cue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of two kinds of sources, the last one for each (user, minute, kind)."""
    minute = F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("minute")
    events = table(spark, sf_dir, "events")
    side = lambda odd, kind: events.filter(F.col("event_id") % 2 == odd).select("user_id", minute, kind.alias("kind"), F.lit(odd).alias("rank"), "event_id", "value")
    both = side(0, F.col("event_type")).unionByName(side(1, F.lit("any")))
    return both.groupBy("user_id", "minute", "kind").agg(F.max_by("value", F.struct("rank", "event_id")).alias("value"))


@query(
    """WITH p AS (SELECT n_nationkey, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1), s AS (SELECT s_nationkey AS n_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1)
    SELECT r_name, count(*) AS nations, bool_and(coalesce(customers, 0) >= 40 AND coalesce(suppliers, 0) >= 3) AS consistent, count(*) FILTER (WHERE coalesce(suppliers, 0) < 3) AS stale FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN p USING (n_nationkey) LEFT JOIN s USING (n_nationkey) GROUP BY r_name"""
)
def consistent_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region holds only if each of its nations has enough customers and suppliers: one that doesn't rejects them all."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    suppliers = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    nations = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left")
    few = F.coalesce("suppliers", F.lit(0)) < 3
    fine = (F.coalesce("customers", F.lit(0)) >= 40) & ~few
    told = table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return told.groupBy("r_name").agg(F.count("*").alias("nations"), F.bool_and(fine).alias("consistent"), F.count_if(few).alias("stale"))


@query(
    """WITH r AS (SELECT source, row_number() OVER (ORDER BY sum(n_chars) DESC, source) - 1 AS pos FROM documents WHERE source IS NOT NULL GROUP BY source), c AS (SELECT source, list(DISTINCT lang) AS langs, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source)
    SELECT source, pos FROM r JOIN c USING (source) WHERE (list_contains(langs, 'de') OR list_contains(langs, 'auto')) AND n >= 20"""
)
def capable_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that cover a language (or any) and are large enough, with their place in the ranking."""
    about = table(spark, sf_dir, "documents").filter("source is not null").groupBy("source").agg(F.sum("n_chars").alias("chars"), F.collect_set("lang").alias("langs"), F.count("*").alias("n"))
    ranked = about.withColumn("pos", (F.row_number().over(Window.orderBy(F.desc("chars"), "source")) - 1).cast("long"))  # a row per source
    return ranked.filter((F.array_contains("langs", "de") | F.array_contains("langs", "auto")) & (F.col("n") >= 20)).select("source", "pos")


@query(
    """SELECT l_orderkey, count(*) AS segments, sum(l_quantity) AS quantity, count(*) FILTER (WHERE l_shipdate > o_orderdate) AS timed FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linestatus = 'O' AND l_returnflag <> 'R' AND o_orderstatus <> 'F' AND l_shipdate > o_orderdate GROUP BY l_orderkey"""
)
def active_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active, not deleted, final rows with a span of positive length; only the columns of the summary are read."""
    live = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O' and l_returnflag != 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", "l_shipdate")
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus != 'F'").select("o_orderkey", "o_orderdate")
    kept = live.join(open_, "o_orderkey").filter("l_shipdate > o_orderdate")
    return kept.groupBy(F.col("o_orderkey").alias("l_orderkey")).agg(F.count("*").alias("segments"), F.sum("l_quantity").alias("quantity"), F.count("*").alias("timed"))


@query("SELECT p_partkey, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') AS adopted, p_size % 2 = 0 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_linestatus = 'F') AS deleted FROM part")
def adopted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that final rows cite are adopted; a deletion (even sizes) takes only the others."""
    cited = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("cited", F.lit(True))
    told = table(spark, sf_dir, "part").join(cited, "p_partkey", "left").withColumn("adopted", F.col("cited").isNotNull())
    return told.select("p_partkey", "adopted", ((F.col("p_size") % 2 == 0) & ~F.col("adopted")).alias("deleted"))


@query(
    """WITH s AS (SELECT l_orderkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber % 2 AS kind, max({'n': l_linenumber, 'd': l_discount})['d'] AS last FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber % 2)
    SELECT l_orderkey, count(*) AS sources, round(sum(last), 4) AS reliability, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'mixed:' || string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) ELSE min(l_returnflag) END AS label FROM s GROUP BY l_orderkey"""
)
def provenance_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of an order by a key of four parts, the last row of each, and a label that tells if they are mixed."""
    lines = table(spark, sf_dir, "lineitem").withColumn("kind", F.col("l_linenumber") % 2)
    last = lines.groupBy("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "kind").agg(F.max_by("l_discount", F.struct("l_linenumber", "l_discount")).alias("last"))
    flags = F.array_sort(F.collect_set("l_returnflag"))
    label = F.when(F.size(flags) > 1, F.concat(F.lit("mixed:"), F.array_join(flags, "+"))).otherwise(F.min("l_returnflag"))
    return last.groupBy("l_orderkey").agg(F.count("*").alias("sources"), F.round(F.sum("last"), 4).alias("reliability"), label.alias("label"))


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(least(1, 0.75 + 0.025 * least(count(*), 10)), 6) AS weight FROM customer GROUP BY ALL")
def history_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight of a confirmed term by how often it was used."""
    weight = F.least(F.lit(1.0), 0.75 + 0.025 * F.least(F.count("*"), F.lit(10)))
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.round(weight, 6).alias("weight"))


@query(
    """WITH h AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS back FROM orders)
    SELECT o_custkey, max(o_orderkey) FILTER (WHERE back = 1) AS applied, coalesce(max(o_orderkey) FILTER (WHERE back = 2), 0) AS rolled_back_to, count(*) AS versions FROM h GROUP BY o_custkey"""
)
def ranking_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of an append-only history and the one that a rollback returns to, 0 if there is none."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    back = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    last = orders.withColumn("back", back).filter("back <= 2").groupBy("o_custkey").agg(F.max(F.when(F.col("back") == 1, F.col("o_orderkey"))).alias("applied"), F.coalesce(F.max(F.when(F.col("back") == 2, F.col("o_orderkey"))), F.lit(0)).alias("rolled_back_to"))
    return last.join(orders.groupBy("o_custkey").agg(F.count("*").alias("versions")), "o_custkey")


DAYS = "SELECT l_suppkey, l_returnflag AS label, datediff('day', DATE '1970-01-01', l_shipdate::DATE) AS s, datediff('day', DATE '1970-01-01', l_shipdate::DATE) + 1 AS e FROM lineitem"


@query(
    f"""WITH d AS (SELECT DISTINCT * FROM ({DAYS})), one AS (SELECT l_suppkey, max(label) AS label, s, e FROM d GROUP BY l_suppkey, s, e),
    m AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(label) OVER w = label THEN 0 ELSE 1 END AS fresh FROM one WINDOW w AS (PARTITION BY l_suppkey ORDER BY s, e)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY s, e) AS run FROM m)
    SELECT l_suppkey, any_value(label) AS label, min(s) AS "start", max(e) AS "end", count(*) AS parts FROM n GROUP BY l_suppkey, run"""
)
def merged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of shipping of a supplier that follow one another with the same label, merged."""
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long")
    days = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", day.alias("start")).agg(F.max("l_returnflag").alias("label")).withColumn("end", F.col("start") + 1)
    return versions.merge_adjacent(days, ["l_suppkey"], "label", 90).select("l_suppkey", "label", "start", "end", "parts")
