"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.session import ship

#: White space of the text contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Most rows, and bytes of them, of a table that may be broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one is set only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there; Spark's cleaner drops it when unused."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Ready the session for Python code on long texts: smaller Arrow batches, and the package on the executors."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(rows))


def if_small(df: DataFrame, limit: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if a count shows at most `limit` rows of at most `most_bytes`, else df as it is.

    Bytes are those of the rows as JSON. Call it on a table that is cut from its lineage, as the count runs its plan.
    """
    rows = F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))))
    count, size = df.limit(limit + 1).agg(F.count("*"), F.coalesce(F.sum(rows), F.lit(0))).first()
    return F.broadcast(df) if count <= limit and size <= most_bytes else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of an operator's own that none of df's columns has, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def unit_hash(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on key and salt alone, the same in every engine that has MD5."""
    text = F.concat(F.lit(salt), F.coalesce(key.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
