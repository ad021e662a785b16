"""Runs are committed whole, once, and only if their items are whole."""

import pytest
from pyspark.sql import functions as F

from chronoloom.sources import exports
from chronoloom.sources.runs import ITEM, RunStore


def test_runs(spark, tmp_path):
    store = RunStore(spark, str(tmp_path / "store"))
    good = spark.createDataFrame([("i1", "m", "r", {"a": "b"}, {"a": "c"}, {"wer": 0.5}), ("i2", "m", "r", {}, {}, {"wer": 0.25, "cer": 1.0})], ITEM)
    store.start("one", "v1", {"seed": "1"})
    with pytest.raises(ValueError, match="already"):
        store.start("one", "v1", {})
    with pytest.raises(ValueError, match="manifest"):
        store.complete("one", "v2", {}, good)
    with pytest.raises(ValueError, match="lack"):
        store.complete("one", "v1", {}, good.withColumn("gold", F.when(F.col("item_id") == "i1", F.col("gold"))))
    assert store.runs().first()["status"] == "running" and store.items().count() == 0  # the attempt that failed is not seen
    store.complete("one", "v1", {"hardware": "x"}, good)
    with pytest.raises(ValueError, match="not running"):
        store.complete("one", "v1", {}, good)
    with pytest.raises(ValueError, match="not running"):
        store.fail("one", "late")
    store.start("two", "v1", {})
    store.fail("two", "out_of_memory")
    with pytest.raises(ValueError, match="does not exist"):
        store.fail("three", "x")
    with pytest.raises(ValueError, match="error code"):
        store.fail("two", "")
    got = {r["run_id"]: r for r in store.runs().collect()}
    assert got["one"]["metrics"] == {"wer": 0.375, "cer": 1.0} and got["one"]["parameters"] == {"seed": "1", "hardware": "x"} and got["one"]["items"] == 2
    assert (got["two"]["status"], got["two"]["error_code"]) == ("failed", "out_of_memory")
    assert sorted((r["run_id"], r["item_id"]) for r in store.items().collect()) == [("one", "i1"), ("one", "i2")]


def test_unknown_exports(spark):
    for form, layer in (("pdf", "user"), ("txt", "raw")):
        with pytest.raises(ValueError):
            exports.render_export(spark.range(1), "id", form, layer)
