"""Algebra of half-open spans (start, end) per key on an integer timeline.

Merging works within slices of the timeline, across which only their largest ends and counts of islands are carried, so a key
that holds a large share of all spans is spread over many tasks. Range joins meet in time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.timeline import overlap
from chronoloom.operators import neighbours
from chronoloom.operators.lineage import cut
from chronoloom.operators.versions import merge_adjacent

#: Width of the timeline's slices and of join buckets, in units of the timeline.
SLICE = 86_400
#: Most rows of a key that a window over the whole key may get.
WINDOW = 50_000


def _islands(df: DataFrame, keys: list[str], extra: list[str], gap: Column, score: str | None) -> DataFrame:
    order = Window.partitionBy(*keys, *extra).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col("start") <= reached + gap, 0).otherwise(1))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    best = [F.max(score).alias(score)] if score else []
    return numbered.groupBy(*keys, *extra, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *best).drop("_island")


def merge_spans(df: DataFrame, keys: list[str], *, gap: int = 0, score: str | None = None, slice_width: int = SLICE, window_rows: int = WINDOW) -> DataFrame:
    """Islands of spans that touch or lie at most `gap` apart; with `score`, its largest value in each.

    Empty spans (end <= start) are left out. Islands are found within slices first. If a count shows that no key has over window_rows of these,
    a window over the key joins them; else only the slices' largest ends and last beginnings are carried on, and no task gets a whole key.
    """
    cols = [*keys, "start", "end", *([score] if score else [])]
    spans = df.filter("end > start").select(*cols).withColumn("slice__", F.floor(F.col("start") / slice_width))
    best = [F.max(score).alias(score)] if score else []
    sliced = [*keys, "slice__"]
    first = cut(_islands(spans, keys, ["slice__"], F.lit(gap), score))
    if (first.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) <= window_rows:
        return _islands(first.drop("slice__"), keys, [], F.lit(gap), score)
    # what earlier slices reach takes in the islands that begin there; they belong to the island that began last before their slice
    reached = neighbours.carried(first.groupBy(*sliced).agg(F.max("end").alias("to__")), keys, "to__", F.max, F.greatest).select(*(F.col(k).alias(f"{k}__of") for k in sliced), "earlier__")
    taken = F.col("start") <= F.col("earlier__") + gap
    marked = cut(first.join(reached, neighbours.same(sliced, first, reached), "left").select(*first.columns, F.when(F.coalesce(taken, F.lit(False)), None).otherwise(F.col("start")).alias("from__")))
    own = marked.filter("from__ is not null").select(*cols, "from__")
    begun = neighbours.carried(marked.groupBy(*sliced).agg(F.max("from__").alias("begun__")), keys, "begun__", F.max, F.greatest).select(*(F.col(k).alias(f"{k}__of") for k in sliced), "earlier__")
    rest = marked.filter("from__ is null")
    later = rest.join(begun, neighbours.same(sliced, rest, begun)).select(*cols, F.col("earlier__").alias("from__"))
    return own.unionByName(later).groupBy(*keys, "from__").agg(F.min("start").alias("start"), F.max("end").alias("end"), *best).drop("from__")


def union_length(df: DataFrame, keys: list[str], name: str = "covered") -> DataFrame:
    """Length of the union of each key's spans."""
    return merge_spans(df, keys).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], *, bucket: int = SLICE) -> DataFrame:
    """Pairs of spans of a key that share a positive length, with columns l_* and r_* and `shared`.

    Both sides go into every time bucket that they touch; a pair is kept in the first bucket of both.
    """

    def spread(df: DataFrame, mark: str) -> DataFrame:
        named = df.filter("end > start").select(*keys, *(F.col(c).alias(f"{mark}_{c}") for c in df.columns if c not in keys))
        first, last = F.floor(F.col(f"{mark}_start") / bucket), F.floor((F.col(f"{mark}_end") - 1) / bucket)
        return named.withColumn("_bucket", F.explode(F.sequence(first, last)))

    pairs = spread(left, "l").join(spread(right, "r"), [*keys, "_bucket"])
    first = F.floor(F.greatest("l_start", "r_start") / bucket)
    shared = overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end"))
    return pairs.filter(F.col("_bucket") == first).withColumn("shared", shared).filter("shared > 0").drop("_bucket")


def intersection_length(left: DataFrame, right: DataFrame, keys: list[str], name: str = "common") -> DataFrame:
    """Length of what the unions of both sides share, per key that both have in common."""
    pairs = overlap_join(merge_spans(left, keys), merge_spans(right, keys), keys)
    return pairs.groupBy(*keys).agg(F.sum("shared").alias(name))


def subtract(left: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """The pieces of each left span that no hole covers; left keeps its columns, with start and end cut."""
    rest = [c for c in left.columns if c not in (*keys, "start", "end")]
    spans = left.filter("end > start").withColumn("_id", F.xxhash64(*left.columns)).withColumn("_no", F.row_number().over(Window.partitionBy(*left.columns).orderBy(F.lit(1))))
    cut = overlap_join(spans, merge_spans(holes, keys), keys).select(
        *keys, *(F.col(f"l_{c}").alias(c) for c in ("start", "end", *rest)), F.col("l__no").alias("_no"), F.greatest("l_start", "r_start").alias("_from"), F.least("l_end", "r_end").alias("_to")
    )
    same = [*keys, "start", "end", *rest, "_no"]
    order = Window.partitionBy(*same).orderBy("_from")
    before = F.coalesce(F.lag("_to").over(order), F.col("start"))
    pieces = cut.select(*same, before.alias("_begin"), F.col("_from").alias("_stop")).unionByName(
        cut.groupBy(*same).agg(F.max("_to").alias("_begin")).withColumn("_stop", F.col("end"))
    )
    whole = spans.join(cut.select(*same).distinct(), same, "left_anti").select(*keys, "start", "end", *rest)
    kept = pieces.filter("_stop > _begin").select(*keys, F.col("_begin").alias("start"), F.col("_stop").alias("end"), *rest)
    return whole.unionByName(kept)


def atomic_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end) between neighbouring boundaries of a key's spans, found by slices of the timeline."""
    cuts = spans.select(*keys, F.explode(F.array("start", "end")).alias("at")).distinct()
    seen = neighbours.with_neighbours(cuts, keys, ["at"], ["at"], F.floor(F.col("at") / SLICE))
    return seen.select(*keys, F.col("at").alias("start"), F.col("after.at").alias("end")).filter("end is not null")


def sweep(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Atomic spans between neighbouring boundaries of a key, with the sorted distinct labels active in each (at least one)."""
    spans = df.filter("end > start")
    met = overlap_join(atomic_spans(spans, keys), spans.select(*keys, "start", "end", label), keys)
    return met.groupBy(*keys, F.col("l_start").alias("start"), F.col("l_end").alias("end")).agg(F.array_sort(F.collect_set(f"r_{label}")).alias("labels"))


def concurrent(df: DataFrame, keys: list[str], label: str, *, merged: bool = True) -> DataFrame:
    """Maximal spans with two or more active labels; with merged, neighbours with equal labels are one."""
    atoms = sweep(df, keys, label).filter(F.size("labels") >= 2)
    if not merged:
        return atoms
    return merge_adjacent(cut(atoms), keys, "labels", SLICE).select(*keys, "labels", "start", "end")


def gaps(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between neighbouring islands of a key: start, end, and the sample in their middle."""
    islands = neighbours.with_neighbours(merge_spans(df, keys).select(*keys, "start", "end"), keys, ["start"], ["start"], F.floor(F.col("start") / SLICE))
    out = islands.select(*keys, F.col("end").alias("start"), F.col("after.start").alias("end")).filter("end is not null")
    return out.withColumn("middle", F.col("start") + F.floor((F.col("end") - F.col("start")) / 2).cast("long"))


def dominant(left: DataFrame, right: DataFrame, keys: list[str], label: str, *, summed: bool = False, confidence: str | None = None) -> DataFrame:
    """For each left span the right label with the most overlap; spans without any are left out.

    By single spans, ties go to the higher confidence and then the larger label; summed, overlaps add up per label
    and ties go to the larger label.
    """
    pairs = overlap_join(left, right, keys)
    own = [*keys, *(f"l_{c}" for c in left.columns if c not in keys)]
    if summed:
        pairs = pairs.groupBy(*own, f"r_{label}").agg(F.sum("shared").alias("shared"))
    rank = [F.col("shared"), *([F.col(f"r_{confidence}")] if confidence and not summed else []), F.col(f"r_{label}")]
    best = pairs.groupBy(*own).agg(F.max(F.struct(*(c.alias(f"_{i}") for i, c in enumerate(rank)))).alias("_best"))
    return best.select(*own, F.col("_best._0").alias("shared"), F.col(f"_best._{len(rank) - 1}").alias(label))


def overlap_labels(left: DataFrame, right: DataFrame, keys: list[str], label: str, least: int) -> DataFrame:
    """Labels that share with a left span at least its own length or `least`, whichever is shorter."""
    pairs = overlap_join(left, right, keys).filter(F.col("shared") >= F.least(F.col("l_end") - F.col("l_start"), F.lit(least)))
    own = [*keys, *(f"l_{c}" for c in left.columns if c not in keys)]
    return pairs.groupBy(*own).agg(F.array_sort(F.collect_set(f"r_{label}")).alias("labels"))


def summed_coverage(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Share of each left span that right spans cover, doubly covered parts counted twice, at most 1."""
    pairs = overlap_join(left, right, keys)
    own = [*keys, *(f"l_{c}" for c in left.columns if c not in keys)]
    total = pairs.groupBy(*own).agg(F.sum("shared").alias("_sum"))
    return total.withColumn("coverage", F.least(F.lit(1.0), F.col("_sum") / (F.col("l_end") - F.col("l_start")))).drop("_sum")


def sessions(frames: DataFrame, keys: list[str], *, active: Column, silence: int, least: int, pad: int, score: str = "score") -> DataFrame:
    """Regions of active frames: a silence of at least `silence` parts them, those shorter than `least` go, the rest is
    padded (not below 0) and merged where it touches, keeping the largest score."""
    regions = merge_spans(frames.filter(active), keys, gap=silence - 1, score=score)
    padded = regions.filter(F.col("end") - F.col("start") >= least).select(*keys, F.greatest(F.lit(0).cast("long"), F.col("start") - pad).alias("start"), (F.col("end") + pad).alias("end"), score)
    return merge_spans(padded, keys, score=score)


def sliding_windows(totals: DataFrame, *, width: int, step: int, total: str = "total") -> DataFrame:
    """Windows of `width` every `step` from 0, the last one ending at the total; a shorter total is one window."""
    starts = F.when(F.col(total) > width, F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.col(total) - width, F.lit(step).cast("long")), F.array(F.col(total) - width))))
    starts = F.coalesce(starts, F.array(F.lit(0).cast("long")))
    return totals.filter(F.col(total) > 0).withColumn("start", F.explode(starts)).withColumn("end", F.least(F.col("start") + width, F.col(total)))


def bounded_windows(totals: DataFrame, *, width: int, shared: int, least: int, total: str = "total") -> DataFrame:
    """Windows of `width` that share `shared` with the one before; a tail under `least` is pulled back to that length."""
    step = width - shared
    count = F.greatest(F.lit(1).cast("long"), F.ceil((F.col(total) - shared) / step))
    numbered = totals.filter(F.col(total) > 0).withColumn("ordinal", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    end = F.least(F.col("ordinal") * step + width, F.col(total))
    start = F.col("ordinal") * step
    return numbered.withColumn("end", end).withColumn("start", F.when(F.col("end") - start < least, F.greatest(F.lit(0).cast("long"), F.col("end") - least)).otherwise(start))


def nearest(asked: DataFrame, found: DataFrame, keys: list[str], name: str, *, slice_width: int = SLICE) -> DataFrame:
    """(name, distance, nearest): how far the nearest span of `found` with another name is from each asked one, and how many are that near; without any, none.

    Both: (keys, name, start, end). Spans that overlap or touch are at 0. Overlaps meet in time buckets; the last end before and the first
    start after are looked up on one timeline of each key, cut into slices.
    """
    spans = found.filter("end > start")
    both = overlap_join(asked.select(*keys, name, "start", "end"), spans.select(*keys, name, "start", "end"), keys)
    over = both.filter(F.col(f"l_{name}") != F.col(f"r_{name}")).groupBy(F.col(f"l_{name}").alias(name)).agg(F.count("*").alias("over__"))

    def beside(edge: str, own: str, sign: int) -> DataFrame:
        """(name, gap, count) of the closest edge on one side."""
        edges = spans.groupBy(*keys, (sign * F.col(edge)).alias("at__")).agg(F.count("*").alias("count__"))
        marks = edges.select(*keys, "at__", F.lit(0).alias("kind__"), F.lit(None).cast(asked.schema[name].dataType).alias(name), F.struct("at__", "count__").alias("edge__"))
        questions = asked.select(*keys, (sign * F.col(own)).alias("at__"), F.lit(1).alias("kind__"), name, F.lit(None).cast(marks.schema["edge__"].dataType).alias("edge__"))
        seen = neighbours.with_latest(marks.unionByName(questions), keys, ["at__", "kind__", name], "edge__", F.floor(F.col("at__") / slice_width), "latest__")
        return seen.filter("kind__ = 1").select(name, (F.col("at__") - F.col("latest__.at__")).alias(f"{edge}_gap__"), F.col("latest__.count__").alias(f"{edge}_count__"))

    told = asked.select(name).join(over, name, "left").join(beside("end", "start", 1), name).join(beside("start", "end", -1), name)
    far = F.when(F.col("over__") > 0, 0).otherwise(F.least("end_gap__", "start_gap__"))
    at = lambda edge: F.when(F.col(f"{edge}_gap__") == F.col("distance"), F.col(f"{edge}_count__")).otherwise(0)
    count = F.coalesce("over__", F.lit(0)) + at("end") + at("start")
    return told.withColumn("distance", far.cast("long")).filter("distance is not null").select(name, "distance", count.alias("nearest"))
