"""Similarity of vectors: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block.
BLOCK = 1_000


def _blocks(df: DataFrame, key: str, vector: str, mark: str) -> DataFrame:
    """Rows of about BLOCK keys and vectors, dealt by hash."""
    count = df.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / BLOCK)).cast("long").alias("_count"))
    number = F.pmod(F.xxhash64(key), F.col("_count"))
    lists = (F.collect_list(F.col(c)).alias(f"{mark}_{n}") for c, n in ((key, "key"), ("_v", "vector")))
    dealt = df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias("_v")).crossJoin(F.broadcast(count))
    return dealt.groupBy(number.alias(f"{mark}_block")).agg(*lists).drop(f"{mark}_block")


def similar_to(asked: DataFrame, others: DataFrame, *, key: str, vector: str, least: float) -> DataFrame:
    """(key, other, similarity) for cosine similarities of at least `least` between the asked vectors and all others.

    Both sides are dealt into blocks, every asked block meets every other block, and a task multiplies the two
    matrices; only pairs that pass leave it. Vectors without length match nothing, nor does a row match itself.
    """
    kind = others.schema[key].dataType.simpleString()

    def unit(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        rows = lists.flatten()
        data = np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)
        norm = np.sqrt((data * data).sum(1))
        return data / np.where(norm > 0, norm, 1)[:, None], norm > 0

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked_key, asked_vector, other_key, other_vector = (batch.column(c).slice(i, 1) for c in range(4))
                a, a_some = unit(asked_vector)
                b, b_some = unit(other_vector)
                ask, row = (np.asarray(k.flatten()) for k in (asked_key, other_key))
                close = a @ b.T
                x, y = np.nonzero((close >= least) & a_some[:, None] & b_some[None, :] & (ask[:, None] != row[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ask[x]), pa.array(row[y]), pa.array(close[x, y])], ["k", "o", "s"])

    met = _blocks(asked, key, vector, "a").crossJoin(_blocks(others, key, vector, "b"))
    found = met.select("a_key", "a_vector", "b_key", "b_vector").mapInArrow(multiply, f"k {kind}, o {kind}, s double")
    return found.select(F.col("k").alias(key), F.col("o").alias("other"), F.col("s").alias("similarity"))
