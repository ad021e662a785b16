"""Merging and running values across slices equal plain loops, and large keys are spread."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import intervals, neighbours


def merged(rows, gap):
    out = []
    for k, a, b, v in sorted(r for r in rows if r[2] > r[1]):
        if out and out[-1][0] == k and a <= out[-1][2] + gap:
            out[-1] = (k, out[-1][1], max(out[-1][2], b), max(out[-1][3], v))
        else:
            out.append((k, a, b, v))
    return sorted(out)


@pytest.mark.parametrize("gap", [0, 7])
@pytest.mark.parametrize("window_rows", [0, 10_000])
def test_merge_spans(spark, gap, window_rows):
    draw = random.Random(5)
    rows = [(k, a, a + draw.choice([-1, 0, 1, 3, 20, 400]), draw.randrange(100)) for k in "ab" for a in (draw.randrange(0, 4000) for _ in range(400))] + [("c", 5, 9000, 1), ("c", 7, 8, 3), ("c", 8995, 9001, 2)]
    df = spark.createDataFrame(rows, "k string, start long, end long, v int")
    got = intervals.merge_spans(df, ["k"], gap=gap, score="v", slice_width=50, window_rows=window_rows).select("k", "start", "end", "v").collect()
    assert sorted(map(tuple, got)) == merged(rows, gap)
    assert intervals.merge_spans(df.limit(0), ["k"], window_rows=window_rows).count() == 0


def test_no_task_gets_a_large_key(spark):
    """20,000 spans that don't touch, a third of them one key's: after merging in slices no partition of the last step holds twice the mean."""
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 400).alias("k"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 3).alias("end"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = intervals.merge_spans(df, ["k"], slice_width=1000, window_rows=0)
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20_000 and max(sizes) < 2 * sum(sizes) / 4


def test_running_values(spark):
    draw = random.Random(6)
    rows = [(k, i, draw.randrange(50) if draw.random() < 0.8 else None) for k in ("a", None) for i in range(700)]
    df = spark.createDataFrame(rows, "k string, i long, v int")
    part = F.floor(F.col("i") / 3)
    most = neighbours.with_running_max(df, ["k"], ["i"], "v", part, "m", before=True)
    total = neighbours.with_running_sum(df, ["k"], ["i"], "v", part, "s")
    for k in ("a", None):
        values = [v for key, _, v in rows if key == k]
        so_far = [max((x for x in values[:i] if x is not None), default=None) for i in range(700)]
        assert [r["m"] for r in most.filter(F.col("k").eqNullSafe(F.lit(k))).orderBy("i").collect()] == so_far
        assert [r["s"] for r in total.filter(F.col("k").eqNullSafe(F.lit(k))).orderBy("i").collect()] == [sum(x or 0 for x in values[: i + 1]) for i in range(700)]
