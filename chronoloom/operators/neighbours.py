"""The rows before and after a row, and order statistics, without a window over a whole key."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators.lineage import cut


def same(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[f"{k}__of"]) for k in keys))


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str], part: Column) -> DataFrame:
    """df with structs `before` and `after`: the given columns of the rows before and after in the order, null at the ends of a key.

    part grows with the order and cuts a key into slices. Windows run within slices; only each slice's first and last row
    meet in a window over the key, so a key with a large share of the rows is spread over many tasks.
    """
    whole, place = F.struct(*columns), F.struct(*order)
    sliced = df.withColumn("slice__", part)
    ends = sliced.groupBy(*keys, "slice__").agg(F.min_by(whole, place).alias("first__"), F.max_by(whole, place).alias("last__"))
    across = Window.partitionBy(*keys).orderBy("slice__")
    ends = ends.select(*(F.col(k).alias(f"{k}__of") for k in [*keys, "slice__"]), F.lag("last__").over(across).alias("earlier__"), F.lead("first__").over(across).alias("later__"))
    joined = sliced.join(ends, same([*keys, "slice__"], sliced, ends))
    within = Window.partitionBy(*keys, "slice__").orderBy(*order)
    out = joined.withColumn("before", F.coalesce(F.lag(whole).over(within), "earlier__")).withColumn("after", F.coalesce(F.lead(whole).over(within), "later__"))
    return out.select(*df.columns, "before", "after")


def ranked_values(df: DataFrame, keys: list[str], value: str, bins: int = 1024) -> DataFrame:
    """(keys, value, n, upto, total): each value of a key that isn't null, how many rows have it, how many have it or less, and all rows.

    Rows are counted per value first, then ranked within bins of even width; only the bins' sums meet in a
    window over the key.
    """
    counted = cut(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n")))  # read several times
    span = counted.groupBy(*keys).agg(F.min(value).alias("low__"), F.max(value).alias("high__"), F.sum("n").alias("total"))
    span = span.select(*(F.col(k).alias(f"{k}__of") for k in keys), "low__", "high__", "total")
    width = (F.col("high__") - F.col("low__")) / bins
    binned = counted.join(span, same(keys, counted, span)).withColumn("bin__", F.when(width > 0, F.floor((F.col(value) - F.col("low__")) / width)).otherwise(0))
    binned = binned.select(*counted.columns, "total", "bin__")
    sums = binned.groupBy(*keys, "bin__").agg(F.sum("n").alias("n__"))
    earlier = F.sum("n__").over(Window.partitionBy(*keys).orderBy("bin__").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*(F.col(k).alias(f"{k}__of") for k in [*keys, "bin__"]), F.coalesce(earlier, F.lit(0)).alias("earlier__"))
    joined = binned.join(sums, same([*keys, "bin__"], binned, sums))
    own = F.sum("n").over(Window.partitionBy(*keys, "bin__").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn("upto", F.col("earlier__") + own).select(*keys, value, "n", "upto", "total")


def quantiles(ranked: DataFrame, keys: list[str], value: str, shares: dict[str, float], *, upto: Column | None = None) -> DataFrame:
    """Per key the interpolated quantiles of ranked_values, by name. `upto`: of the first so many rows only."""
    total = F.col("total") if upto is None else upto
    found = []
    for name, share in shares.items():
        place = (total - 1) * F.lit(share)
        low = F.floor(place)
        at = lambda rank: F.min(F.when(F.col("upto") >= rank + 1, F.col(value)))
        found += [at(low).alias(f"{name}__low"), at(F.least(low + 1, total - 1)).alias(f"{name}__high"), F.first(place - low).alias(f"{name}__part")]
    out = ranked.groupBy(*keys).agg(*found)
    between = lambda n: F.col(f"{n}__low") + (F.col(f"{n}__high") - F.col(f"{n}__low")) * F.col(f"{n}__part")
    return out.select(*keys, *(between(name).alias(name) for name in shares))


#: Slices whose sums or maxima meet in one window; more of a key meet in several, and those windows' totals in another.
SLICES = 1024


def carried(slices: DataFrame, keys: list[str], value: str, agg: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str = "earlier__") -> DataFrame:
    """slices, a row for each (keys, slice__), with agg of a value over the earlier slices of the key.

    A window gets up to SLICES slices, or the groups of so many, but never all slices of a large key.
    """
    back = Window.unboundedPreceding
    within = Window.partitionBy(*keys, "group__").orderBy("slice__")
    inside = slices.withColumn("group__", F.floor(F.col("slice__") / SLICES)).withColumn("inside__", agg(F.col(value)).over(within.rowsBetween(back, -1)))
    groups = inside.groupBy(*keys, "group__").agg(agg(F.col(value)).alias("of_group__"))
    groups = groups.withColumn("before_group__", agg(F.col("of_group__")).over(Window.partitionBy(*keys).orderBy("group__").rowsBetween(back, -1)))
    groups = groups.select(*(F.col(k).alias(f"{k}__of") for k in [*keys, "group__"]), "before_group__")
    return inside.join(groups, same([*keys, "group__"], inside, groups)).select(*slices.columns, join(F.col("before_group__"), F.col("inside__")).alias(name))


def _running(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column, agg: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str, last: int) -> DataFrame:
    """df with agg of a value over the rows of its key before it in the order (last -1) or up to it (last 0)."""
    sliced = df.withColumn("slice__", part)
    slices = carried(sliced.groupBy(*keys, "slice__").agg(agg(F.col(value)).alias("of_slice__")), keys, "of_slice__", agg, join)
    slices = slices.select(*(F.col(k).alias(f"{k}__of") for k in [*keys, "slice__"]), "earlier__")
    within = agg(F.col(value)).over(Window.partitionBy(*keys, "slice__").orderBy(*order).rowsBetween(Window.unboundedPreceding, last))
    return sliced.join(slices, same([*keys, "slice__"], sliced, slices)).select(*df.columns, join(F.col("earlier__"), within).alias(name))


def with_running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column, name: str = "upto") -> DataFrame:
    """df with the sum of a value over the rows of its key up to it in the order; slices as in with_neighbours."""
    return _running(df, keys, order, value, part, F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), name, 0)


def with_running_max(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column, name: str = "most", *, before: bool = False) -> DataFrame:
    """df with the largest value over the rows of its key up to it in the order, or (before) those before it, null without any; slices as in with_neighbours."""
    return _running(df, keys, order, value, part, F.max, F.greatest, name, -1 if before else 0)


def with_latest(df: DataFrame, keys: list[str], order: list[str], value: str, part: Column, name: str = "latest") -> DataFrame:
    """df with the last value of its key up to each row that isn't null, null before the first; slices as in with_neighbours."""
    sliced = df.withColumn("slice__", part)
    some = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = sliced.groupBy(*keys, "slice__").agg(F.max_by(value, some).alias("last__"))
    earlier = F.last("last__", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("slice__").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*(F.col(k).alias(f"{k}__of") for k in [*keys, "slice__"]), earlier.alias("earlier__"))
    own = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys, "slice__").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return sliced.join(ends, same([*keys, "slice__"], sliced, ends)).select(*df.columns, F.coalesce(own, "earlier__").alias(name))
