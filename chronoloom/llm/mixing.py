"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import WORD_CLASS, cut_lineage, if_small, text_or_empty, unused

#: A source's words are repeated at most so many times.
MOST_REPEATS = 3
#: Weights dealt to the sources by code point, over and over.
WEIGHTS = (1, 2, 3)
#: Draws that a source chooses among: a key's hash of so many values, times an odd number of each draw's own.
DRAWS, VALUES, FACTOR = 128, 1 << 28, 97612893


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_CLASS)).cast("long")


def exact(value: Column | str) -> Column:
    """A whole number whose products with others of its kind don't overflow."""
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(19,0)")


def source_targets(sizes: DataFrame, most_repeats: int = MOST_REPEATS) -> DataFrame:
    """Target words per source: (source, source_size, weight) -> also target and rate.

    The targets share the sum of all sizes by weight; none exceeds most_repeats times its source's
    size, and what is over goes to the others by weight until none is above. Filling sources in the
    order of size/weight reaches that fixed point at once: a source is full if its share of what the
    earlier ones leave would exceed its bound. One row per source passes through the window.
    """
    bound = F.lit(most_repeats) * F.col("source_size")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    filled = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = (
        sizes.withColumn("_words", F.sum("source_size").over(everything) - F.coalesce(F.sum(bound).over(filled), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(rest))
        .withColumn("_full", exact("weight") * exact("_words") >= exact(bound) * exact("_weights"))
    )
    # the share of a source that isn't full is the one left by all the full ones
    open_words = F.max(F.when(~F.col("_full"), F.struct("_weights", "_words"))).over(everything)
    share = (exact("weight") * exact(open_words["_words"])).cast("double") / open_words["_weights"]
    return left.withColumn("target", F.when(F.col("_full"), bound.cast("double")).otherwise(share.cast("double"))).drop("_words", "_weights", "_full")


def draw_hash(key: Column, seed: str) -> Column:
    """A whole number below VALUES that depends on key and seed alone, the same in every engine that has MD5."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long")


def _drawn(hashed: Column, draw: Column, rate: Column) -> Column:
    """Whether a document with this hash gets one copy more in a draw, which has the probability of the rate's fraction."""
    factor = (2 * draw.cast("long") + 1) * FACTOR % VALUES
    return hashed * factor % VALUES / F.lit(float(VALUES)) < rate - F.floor(rate)


def nearest_draws(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """targets (source, source_size, target, rate) with `draw`: of the DRAWS draws the one whose words are nearest to the target, the first of equal ones.

    sized: (source, size, hashed). One aggregate takes the words of all draws; each task sums a source's draws before they shuffle.
    """
    rated = sized.join(if_small(targets.select(F.col("source").alias("of"), "rate")), F.col("source").eqNullSafe(F.col("of")))
    each = rated.select("source", "size", "hashed", "rate", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw"))
    extra = F.sum(F.when(_drawn(F.col("hashed"), F.col("draw"), F.col("rate")), F.col("size")).otherwise(0))
    sums = each.groupBy(F.col("source").alias("of"), "draw").agg(extra.alias("extra"))
    off = F.abs((F.floor("rate") * F.col("source_size") + F.col("extra")).cast("double") - F.col("target"))
    best = targets.join(sums, F.col("source").eqNullSafe(F.col("of"))).groupBy("source", "source_size", "target", "rate")
    return best.agg(F.min_by("draw", F.struct(off.alias("off"), "draw")).alias("draw"))


def plan_mixture(
    docs: DataFrame, *, weights: DataFrame | None = None, most_repeats: int = MOST_REPEATS, seed: str = "mix", text: str = "text", source: str = "source", key: str = "doc_id"
) -> DataFrame:
    """Every row of docs with size, source_size, target, rate and copies; columns so named are replaced, others stay, whatever their names.

    size counts words (null text: 0); null is a source like any other, the last one. The rate of a
    source is target/source_size; a row gets floor(rate) copies and one more if its hash, seeded by
    `seed` and its key, falls below the fraction. Of DRAWS draws each source takes the one whose words
    come nearest to its target, so that one long document doesn't lead it astray. Rows that repeat a key share its fate; an empty
    table gives no rows; a source without words has target 0 and rate 0. weights: a table
    (source, weight) in place of the default 1, 2, 3, 1, ... by code point.
    """
    kept = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies")]
    size = word_count(text_or_empty(text))
    sized = cut_lineage(docs.select(F.col(source).alias("source"), size.alias("size"), draw_hash(F.col(key), seed).alias("hashed")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
        sizes = sizes.withColumn("weight", F.array(*map(F.lit, WEIGHTS))[(turn - 1) % len(WEIGHTS)].cast("long"))
    else:
        sizes = sizes.join(weights.select(F.col("source").alias("of"), "weight"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = cut_lineage(source_targets(sizes, most_repeats).select("source", "source_size", "target", rate.alias("rate")))
    targets = if_small(cut_lineage(nearest_draws(sized, targets)))
    of, draw = unused(docs, "of_source", "draw")
    told = targets.select(F.col("source").alias(of), "source_size", "target", "rate", F.col("draw").alias(draw))
    planned = docs.select(*kept, size.alias("size")).join(told, F.col(source).eqNullSafe(F.col(of)))
    extra = _drawn(draw_hash(F.col(key), seed), F.col(draw), F.col("rate"))
    return planned.withColumn("copies", F.floor("rate") + extra.cast("long")).drop(of, draw)


def emit_mixture(planned: DataFrame) -> DataFrame:
    """Each planned row as often as its copies say, numbered by copy_no from 1."""
    return planned.filter("copies > 0").withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
