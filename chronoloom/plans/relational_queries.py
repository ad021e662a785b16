"""Queries over rows with states: orders stand for jobs, their lines for checkpoints, customers for recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as texts
from chronoloom.operators import relational
from chronoloom.plans.registry import query, table


@query("SELECT o_orderkey, c_name, o_orderstatus, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus NOT IN ('F')")
def queue_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.filter(~F.col("o_orderstatus").isin("F")).join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice")


@query("SELECT o_orderkey, o_orderstatus, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) AS has_large FROM orders")
def orders_with_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    large = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.with_exists(table(spark, sf_dir, "orders"), large, ["o_orderkey"], "has_large").select("o_orderkey", "o_orderstatus", "has_large")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.05 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'))")
def parts_not_superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    cheap = table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").join(open_, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(cheap, "p_partkey", "left_anti").select("p_partkey")


@query("SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return relational.latest(orders, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey"))


@query("SELECT s.o_orderstatus, p.o_orderpriority, count(o.o_orderkey) AS n FROM (SELECT DISTINCT o_orderstatus FROM orders) s CROSS JOIN (SELECT DISTINCT o_orderpriority FROM orders) p LEFT JOIN orders o ON o.o_orderstatus = s.o_orderstatus AND o.o_orderpriority = p.o_orderpriority AND o.o_totalprice > 400000 GROUP BY ALL")
def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    stages = orders.select("o_orderstatus").distinct().crossJoin(F.broadcast(orders.select("o_orderpriority").distinct()))
    key = F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("stage")
    counted = relational.counts_over(orders.filter("o_totalprice > 400000").select(key), "stage", stages.select(key))
    return counted.select(F.split_part("stage", F.lit("|"), F.lit(1)).alias("o_orderstatus"), F.split_part("stage", F.lit("|"), F.lit(2)).alias("o_orderpriority"), "n")


@query("SELECT o_orderkey, round(coalesce(avg((l_linestatus = 'F')::INT), 1.0), 6) AS progress FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def order_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = relational.progress(table(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_linestatus") == "F").withColumnRenamed("l_orderkey", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left").select("o_orderkey", F.round(F.coalesce("progress", F.lit(1.0)), 6).alias("progress"))


@query("SELECT l_orderkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey")
def first_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    return relational.first_open(lines, ["l_orderkey"], F.col("l_linestatus") == "O", F.col("l_linenumber")).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, o_orderdate, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100")
def order_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], limit=50, offset=100)


@query("SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n = 1")
def next_dispatchable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_orderdate", "o_orderstatus")
    return relational.first_open(orders, ["o_orderpriority"], F.col("o_orderstatus") == "O", F.col("o_orderdate"), F.col("o_orderkey")).select("o_orderpriority", "o_orderkey")


@query(
    """WITH q AS (SELECT n_nationkey, n_name, n_nationkey * 10 AS position FROM nation), w AS (SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) AS no FROM nation WHERE n_regionkey IN (1, 3)),
    f AS (SELECT position, row_number() OVER (ORDER BY position) AS no FROM q WHERE n_nationkey IN (SELECT n_nationkey FROM w)), d AS (SELECT w.n_nationkey, f.position FROM w JOIN f USING (no))
    SELECT q.n_nationkey, q.n_name, coalesce(d.position, q.position)::BIGINT AS position FROM q LEFT JOIN d USING (n_nationkey)"""
)
def queue_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    queue = nation.select("n_nationkey", "n_name", (F.col("n_nationkey") * 10).cast("long").alias("position"))
    wanted = nation.filter("n_regionkey in (1, 3)").select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n_name"))).alias("rank"))
    return relational.reorder(queue, wanted, key="n_nationkey", position="position")


LAYERS = "WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN CASE WHEN turn % 3 = 0 THEN '  ' ELSE text END END AS u, CASE WHEN role <> 'system' THEN CASE WHEN turn % 4 = 1 THEN '' ELSE text END END AS s, 'f:' || role AS f FROM conversations)"


@query(LAYERS + " SELECT conv_id, turn, CASE WHEN trim(u) <> '' THEN u WHEN s <> '' THEN s ELSE f END AS a, coalesce(u, s, f) AS b, CASE WHEN u IS NOT NULL THEN 'user' WHEN s IS NOT NULL THEN 'smart' ELSE 'faithful' END AS b_layer, coalesce(u, nullif(s, ''), f) AS c FROM t")
def text_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("role") == "user", F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")))
    smart = F.when(F.col("role") != "system", F.when(F.col("turn") % 4 == 1, "").otherwise(F.col("text")))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", user.alias("u"), smart.alias("s"), F.concat(F.lit("f:"), "role").alias("f"))
    b, layer = texts.layer_as_set(F.col("u"), F.col("s"), F.col("f"))
    return turns.select("conv_id", "turn", texts.layer_not_blank(F.col("u"), F.col("s"), F.col("f")).alias("a"), b.alias("b"), layer.alias("b_layer"), texts.layer_coalesced(F.col("u"), F.col("s"), F.col("f")).alias("c"))


@query("SELECT event_id, value, value IS NULL OR value < 0.82 AS low_confidence, value IS NULL AS unscored FROM events WHERE value IS NULL OR value < 0.82")
def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.col("value").isNull() | (F.col("value") < 0.82)
    return table(spark, sf_dir, "events").filter(low).select("event_id", "value", low.alias("low_confidence"), F.col("value").isNull().alias("unscored"))


@query("SELECT event_type, json_keys(props::JSON)[1] AS first_key, count(*) AS n FROM events GROUP BY ALL")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.element_at(F.json_object_keys("props"), 1)
    return table(spark, sf_dir, "events").groupBy("event_type", first.alias("first_key")).agg(F.count("*").alias("n"))


@query(
    """WITH old AS (SELECT source, lang, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL), new AS (SELECT source, lang, min(doc_id) AS first_doc, count(*) AS n FROM documents WHERE doc_id % 2 = 1 GROUP BY ALL)
    SELECT coalesce(o.source, w.source) AS source, coalesce(o.lang, w.lang) AS lang, CASE WHEN w.source IS NULL OR coalesce(o.n >= 10, FALSE) THEN o.first_doc ELSE w.first_doc END AS first_doc,
    CASE WHEN w.source IS NULL OR coalesce(o.n >= 10, FALSE) THEN o.n ELSE w.n END AS n FROM old o FULL JOIN new w ON o.source = w.source AND o.lang = w.lang"""
)
def upsert_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    side = lambda odd: docs.filter(F.col("doc_id") % 2 == odd).groupBy("source", "lang").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))
    return relational.upsert(side(0), side(1), ["source", "lang"], keep=F.col("n") >= 10)


@query("SELECT c.conv_id, count(*) AS turns, string_agg(role || ':' || length(text)::VARCHAR, '|' ORDER BY turn) AS payload FROM conversations c GROUP BY c.conv_id")
def conversation_nest(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    nested = relational.nest(turns.select("conv_id").distinct(), turns, "conv_id", "turn", ["turn", "role", "text"], "turns_of")
    payload = F.array_join(F.transform("turns_of", lambda t: F.concat_ws(":", t["role"], F.length(t["text"]).cast("string"))), "|")
    return nested.select("conv_id", F.size("turns_of").cast("long").alias("turns"), payload.alias("payload"))


@query("SELECT s_suppkey, coalesce(n.n_name, s_nationkey::VARCHAR) AS shown FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 <> 0) n ON s_nationkey = n_nationkey")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "nation").filter("n_nationkey % 3 != 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("shown"))
    return relational.with_display_name(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), names, "s_nationkey", "shown").select("s_suppkey", "shown")


@query(
    """WITH t AS (SELECT conv_id, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, count(before) AS links, count(*) FILTER (WHERE before <> role) AS switches, round(coalesce(count(*) FILTER (WHERE before <> role)::DOUBLE / nullif(count(before), 0), 0), 6) AS switch_rate FROM t GROUP BY conv_id"""
)
def speaker_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.switches(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "role").withColumn("switch_rate", F.round("switch_rate", 6))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("n <= 3")
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]), ">").alias("roles"))


@query(
    """WITH b AS (SELECT conv_id, turn, text, 240 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM conversations)
    SELECT conv_id, turn, right(text, least(room, length(text))::INT) AS text FROM b WHERE room > 0"""
)
def bounded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.bounded_suffix(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), ["conv_id"], "turn", "text", 240)


@query("SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, CASE WHEN count(DISTINCT role) > 1 THEN 'mixed' ELSE min(role) END AS role, bool_or(length(text) > 200) AS long_turn FROM conversations GROUP BY conv_id")
def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.countDistinct("role") > 1, "mixed").otherwise(F.min("role"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), role.alias("role"), F.bool_or(F.length("text") > 200).alias("long_turn"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) - 1 AS siblings FROM orders")
def shared_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    counts = orders.groupBy("o_custkey").agg((F.count("*") - 1).alias("siblings"))
    return orders.join(counts, "o_custkey").select("o_orderkey", "siblings")


@query(
    """WITH g AS (SELECT DISTINCT source, lang FROM documents), need AS (SELECT g.source, g.lang, l.toxic FROM g CROSS JOIN (SELECT DISTINCT toxic FROM labels) l),
    have AS (SELECT DISTINCT d.source, d.lang, l.toxic FROM documents d JOIN labels l USING (doc_id)) SELECT source, lang, toxic, 'missing' AS fault FROM (SELECT * FROM need EXCEPT SELECT * FROM have) WHERE (source, lang) IN (SELECT (source, lang) FROM have)"""
)
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    have = table(spark, sf_dir, "documents").join(labels, "doc_id").select("source", "lang", "toxic")
    return relational.missing_keys(labels, have, ["source", "lang"], "toxic")


@query(
    """SELECT o_orderkey, o_totalprice, CASE WHEN l.n IS NULL THEN 'no_lines' WHEN o_orderstatus = 'P' AND l.shipped < l.n THEN 'resume' WHEN o_orderstatus = 'O' THEN 'start' ELSE 'done' END AS plan
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_linestatus = 'F') AS shipped FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey"""
)
def recovery_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.count_if(F.col("l_linestatus") == "F").alias("shipped"))
    plan = F.when(F.col("n").isNull(), "no_lines").when((F.col("o_orderstatus") == "P") & (F.col("shipped") < F.col("n")), "resume").when(F.col("o_orderstatus") == "O", "start").otherwise("done")
    return table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", "o_totalprice", plan.alias("plan"))


@query("SELECT coalesce(max(o_orderkey), 0) + 1 AS next_position, count(*) AS jobs, count(*) FILTER (WHERE o_orderstatus = 'O') AS open_jobs, sum(o_custkey)::BIGINT AS check_sum FROM orders")
def queue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").agg(
        (F.coalesce(F.max("o_orderkey"), F.lit(0)) + 1).alias("next_position"), F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "O").alias("open_jobs"), F.sum("o_custkey").alias("check_sum")
    )


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 12 AND event_id > 100")
def event_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("n", F.row_number().over(newest)).filter("n <= 12 and event_id > 100").select("event_id", "user_id", "event_type")
