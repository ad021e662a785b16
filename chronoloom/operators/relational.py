"""Views over rows with states, versions and events: latest rows, queues, pages, upserts, nested payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The row of each key that is largest by `order`; counted within tasks first, so large keys don't gather."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max(F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))).alias("_best"))
    return best.select(*keys, *(F.col(f"_best._row.{c}").alias(c) for c in rest))


def with_exists(df: DataFrame, other: DataFrame, on: Sequence[str], name: str) -> DataFrame:
    """A flag that says whether `other` has a row of the same key."""
    seen = other.select(*on).distinct().withColumn(name, F.lit(True))
    return df.join(seen, list(on), "left").withColumn(name, F.coalesce(name, F.lit(False)))


def page(df: DataFrame, order: Sequence[Column], *, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset to offset + limit by an order that tells all rows apart, with the number of all rows as total; limit is 1 to 100."""
    limit = min(100, max(1, limit))
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def counts_over(df: DataFrame, value: str, domain: DataFrame, *, name: str = "n") -> DataFrame:
    """How many rows have each value of a one-column domain, 0 for those that none has."""
    found = df.groupBy(value).agg(F.count("*").alias("_n"))
    return domain.join(found, value, "left").select(value, F.coalesce("_n", F.lit(0)).cast("long").alias(name))


def progress(df: DataFrame, keys: Sequence[str], done: Column) -> DataFrame:
    """Share of a key's rows that are done."""
    return df.groupBy(*keys).agg(F.avg(done.cast("int")).alias("progress"))


def first_open(df: DataFrame, keys: Sequence[str], open_: Column, *order: Column) -> DataFrame:
    """The first row of each key that is open, by the order of the columns given."""
    rest = [c for c in df.columns if c not in keys]
    key = F.struct(*(o.alias(f"_{i}") for i, o in enumerate(order)), F.struct(*rest).alias("_row"))
    best = df.filter(open_).groupBy(*keys).agg(F.min(key).alias("_best"))
    return best.select(*keys, *(F.col(f"_best._row.{c}").alias(c) for c in rest))


def upsert(table: DataFrame, changes: DataFrame, keys: Sequence[str], *, keep: Column | None = None) -> DataFrame:
    """table with changes by key; rows of table where `keep` holds stay as they are."""
    rest = [c for c in table.columns if c not in keys]
    held = F.coalesce(keep, F.lit(False)) if keep is not None else F.lit(False)
    old = table.select(*keys, F.struct(*rest).alias("_old"), held.alias("_held"))
    new = changes.select(*keys, F.struct(*rest).alias("_new"))
    row = F.when(F.col("_held") | F.col("_new").isNull(), F.col("_old")).otherwise(F.col("_new"))
    return old.join(new, list(keys), "full").select(*keys, row.alias("_row")).select(*keys, "_row.*")


def reorder(queue: DataFrame, wanted: DataFrame, *, key: str, position: str) -> DataFrame:
    """Deal the positions of the wanted keys, in ascending order, to these keys in the order that `wanted` (key, rank) gives.

    A queue is split by nothing, so its positions pass one window: it holds the entries that a person reorders.
    """
    free = queue.join(wanted, key, "left_semi").select(F.col(position).alias("_position"), F.row_number().over(Window.orderBy(position)).alias("_no"))
    asked = wanted.select(key, F.row_number().over(Window.orderBy("rank")).alias("_no"))
    dealt = asked.join(free, "_no").select(key, "_position")
    return queue.join(dealt, key, "left").withColumn(position, F.coalesce("_position", position)).drop("_position")


def nest(parents: DataFrame, children: DataFrame, on: str, order: str, columns: Sequence[str], name: str) -> DataFrame:
    """parents with an ordered array of their children's columns, empty where there are none."""
    gathered = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in columns if c != order)))).alias(name))
    empty = F.array().cast(gathered.schema[name].dataType)
    return parents.join(gathered, on, "left").withColumn(name, F.coalesce(name, empty))


def with_display_name(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """df with a display name by key, the key itself where there is none."""
    return df.join(names.select(key, F.col(name).alias("_name")), key, "left").withColumn(name, F.coalesce(F.col("_name"), F.col(key).cast("string"))).drop("_name")


def missing_keys(gold: DataFrame, found: DataFrame, group: Sequence[str], key: str) -> DataFrame:
    """Gold keys without a row in a group of `found`, for all groups that it has, with what kind of fault: missing or unknown.

    Only the groups that lack a key are paired with the gold keys, so what is made grows with what is missing.
    """
    keys = gold.select(key).distinct()
    have = found.select(*group, key).distinct()
    known = have.join(keys, key, "left_semi")
    counts = known.groupBy(*group).agg(F.count("*").alias("held__"))
    total = keys.agg(F.count("*").alias("all__"))
    lacking = found.select(*group).distinct().join(counts, list(group), "left").join(F.broadcast(total), F.coalesce("held__", F.lit(0)) < F.col("all__"))
    missing = lacking.select(*group).crossJoin(keys).join(have, [*group, key], "left_anti").select(*group, key).withColumn("fault", F.lit("missing"))
    unknown = have.join(gold.select(key).distinct(), key, "left_anti").select(*group, key).withColumn("fault", F.lit("unknown"))
    return missing.unionByName(unknown)


def bounded_suffix(df: DataFrame, keys: Sequence[str], order: str, text: str, budget: int) -> DataFrame:
    """The last texts of each key within a budget of characters; the one that exceeds it keeps its end."""
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    used = F.coalesce(F.sum(F.length(text)).over(back.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = df.withColumn("_left", budget - used).filter("_left > 0")
    return out.withColumn(text, F.right(F.col(text), F.least(F.col("_left"), F.length(text)).cast("int"))).drop("_left")


def switches(df: DataFrame, keys: Sequence[str], order: str, label: str) -> DataFrame:
    """Links between neighbouring rows of a key, how many of them change the label, and their share (0 without links)."""
    step = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumn("_link", F.lag(label).over(step).isNotNull()).withColumn("_change", F.lag(label).over(step) != F.col(label))
    out = marked.groupBy(*keys).agg(F.count_if("_link").alias("links"), F.count_if("_change").alias("switches"))
    return out.withColumn("switch_rate", F.coalesce(F.col("switches") / F.nullif("links", F.lit(0)), F.lit(0.0)))
