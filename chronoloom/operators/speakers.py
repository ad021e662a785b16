"""Speaker labels on a timeline: diarization errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.intervals import atomic_spans, overlap_join


def diarization_errors(reference: DataFrame, hypothesis: DataFrame, keys: list[str], speaker: str = "speaker") -> DataFrame:
    """Missed, falsely found and confused speaker time per key, and their share of the reference's.

    Both sides are cut into atomic spans between neighbouring boundaries; in each, the distinct speakers of either side are
    compared by name.
    """
    r, h = (df.filter("end > start").select(*keys, "start", "end", speaker) for df in (reference, hypothesis))
    both = r.withColumn("_side", F.lit("r")).unionByName(h.withColumn("_side", F.lit("h")))
    met = overlap_join(atomic_spans(both, keys), both, keys)
    by = met.groupBy(*keys, "l_start", "l_end", f"r_{speaker}").agg(F.bool_or(F.col("r__side") == "r").alias("r"), F.bool_or(F.col("r__side") == "h").alias("h"))
    counts = by.groupBy(*keys, "l_start", "l_end").agg(F.count_if("r").alias("r"), F.count_if("h").alias("h"), F.count_if(F.col("r") & F.col("h")).alias("b"))
    length, zero = F.col("l_end") - F.col("l_start"), F.lit(0).cast("long")
    out = counts.groupBy(*keys).agg(
        F.sum(length * F.greatest(zero, F.col("r") - F.col("h"))).alias("missed"),
        F.sum(length * F.greatest(zero, F.col("h") - F.col("r"))).alias("false_alarm"),
        F.sum(length * (F.least("r", "h") - F.col("b"))).alias("confusion"),
        F.sum(length * F.col("r")).alias("reference"),
    )
    wrong = F.col("missed") + F.col("false_alarm") + F.col("confusion")
    return out.withColumn("der", wrong / F.greatest(F.lit(1), F.col("reference")))
