"""What a Python worker holds while terms are put doesn't grow with the words of all texts."""

import os
import re
from pathlib import Path

import psutil
from pyspark.sql import functions as F

from chronoloom.operators import terminology


def peaks():
    """The most memory that each worker has had, in MB."""
    found = {}
    for p in psutil.Process(os.getpid()).children(recursive=True):
        try:
            if "pyspark.daemon" in p.cmdline():
                found[p.pid] = int(re.search(r"VmHWM:\s+(\d+)", Path(f"/proc/{p.pid}/status").read_text())[1]) / 1024
        except (OSError, TypeError, psutil.Error):
            pass
    return found


def test_two_million_words_in_a_task(spark):
    texts = spark.range(0, 2000, 1, 1).select(F.col("id").alias("k"), F.repeat(F.lit("alpha bravo "), 500).alias("text"), F.lit("en").alias("language"))
    terms = spark.createDataFrame([(1, "ALPHA", ["alpha"], None, None)], "rank int, canonical string, aliases array<string>, language string, source string")
    before = peaks()
    got = terminology.corrected(texts, terms, ["k"]).agg(F.count_if(F.col("corrected") == F.repeat(F.lit("ALPHA bravo "), 500)).alias("n"), F.sum(F.size("diffs")).alias("diffs")).first()
    assert (got["n"], got["diffs"]) == (2000, 1_000_000)
    assert max(mb - before.get(pid, 0) for pid, mb in peaks().items()) < 400
