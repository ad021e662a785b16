"""Evaluation runs: a run's header and its items become visible together, or not at all.

A folder holds `items/<attempt>`, written by Spark, and `runs/<run>/<state>.json`. A state is written beside and renamed, which fails where it exists
already; the final one names the items' attempt, so items of an attempt that wasn't committed are never read. The rename is atomic on HDFS and local
disks; a store without atomic renames needs a committer of its own.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "item_id string, model_id string, model_revision string, gold map<string,string>, prediction map<string,string>, metrics map<string,double>"
HEADER = "run_id string, status string, manifest_version string, parameters map<string,string>, metrics map<string,double>, error_code string, attempt string, items long"


class RunStore:
    """Runs below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root
        self.jvm = spark.sparkContext._jvm

    def _path(self, *parts: str) -> object:
        return self.jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self) -> object:
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _commit(self, run: str, state: str, header: dict) -> None:
        """Write a state whole and give it its name, unless the run has it already."""
        files, draft, final = self._files(), self._path("runs", run, f".{uuid.uuid4().hex}"), self._path("runs", run, f"{state}.json")
        out = files.create(draft, False)
        out.write(bytearray(json.dumps(header, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, rename)
        except Exception as e:
            files.delete(draft, False)
            raise ValueError(f"run {run} is {state} already") from e

    def _state(self, run: str, state: str) -> dict | None:
        files, path = self._files(), self._path("runs", run, f"{state}.json")
        if not files.exists(path):
            return None
        stream = files.open(path)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def start(self, run: str, manifest_version: str, parameters: dict[str, str]) -> None:
        """A new running run; an error if there is one of that name."""
        self._commit(run, "running", {"run_id": run, "status": "running", "manifest_version": manifest_version, "parameters": parameters})

    def _running(self, run: str) -> dict:
        header = self._state(run, "running")
        if header is None:
            raise ValueError(f"run {run} does not exist")
        if self._state(run, "final"):
            raise ValueError(f"run {run} is not running")
        return header

    def complete(self, run: str, manifest_version: str, parameters: dict[str, str], items: DataFrame) -> None:
        """Write the items (columns of ITEM), and commit them with the header: parameters added, the mean of every metric, and how many there are.

        An error, with nothing visible, if the run isn't running or is of another manifest, or an item lacks gold, prediction or metrics. Of two writers one wins.
        """
        header = self._running(run)
        if header["manifest_version"] != manifest_version:
            raise ValueError(f"run {run} is of another manifest")
        attempt = uuid.uuid4().hex
        folder = f"{self.root}/items/{attempt}"
        items.select("item_id", "model_id", "model_revision", "gold", "prediction", "metrics").write.parquet(folder)
        written = self.spark.read.schema(ITEM).parquet(folder)
        total, whole = written.agg(F.count("*"), F.count_if(F.col("gold").isNotNull() & F.col("prediction").isNotNull() & F.col("metrics").isNotNull())).first()
        if whole < total:
            raise ValueError(f"{total - whole} items lack gold, prediction or metrics")
        means = written.select(F.explode("metrics").alias("name", "value")).filter("value is not null").groupBy("name").agg(F.avg("value").alias("mean")).collect()  # a row for each kind of metric
        self._commit(run, "final", {**header, "status": "completed", "parameters": {**header["parameters"], **parameters}, "metrics": {r["name"]: r["mean"] for r in means}, "attempt": attempt, "items": total})

    def fail(self, run: str, error_code: str) -> None:
        """Close a running run by an error."""
        if not error_code:
            raise ValueError("a failure needs an error code")
        self._commit(run, "final", {**self._running(run), "status": "failed", "error_code": error_code})

    def runs(self) -> DataFrame:
        """Headers, a row for each run, its final state or else that it runs."""
        states = self.spark.read.schema(HEADER).json(f"{self.root}/runs/*/*.json")
        return states.groupBy("run_id").agg(F.max_by(F.struct(*(c.split()[0] for c in HEADER.split(", ")[1:])), F.when(F.col("status") == "running", 0).otherwise(1)).alias("s")).select("run_id", "s.*")

    def items(self) -> DataFrame:
        """Items of completed runs, with their run_id; those of uncommitted attempts aren't among them."""
        done = self.runs().filter("status = 'completed'").select("run_id", "attempt")
        files = self.spark.read.schema(ITEM).option("recursiveFileLookup", True).parquet(f"{self.root}/items").withColumn("attempt", F.regexp_extract(F.input_file_name(), r"/items/([0-9a-f]{32})/", 1))
        return files.join(F.broadcast(done), "attempt").drop("attempt")
