"""Exact deduplication in two passes over a Bloom filter of repeated hashes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import SPACE_CLASS, bounded_batches, cut_lineage, if_small, shared_dir, text_or_empty, unused
from chronoloom.llm.text_arrays import mix

#: Bits of the filter per row, and the most bits a filter may have (64 MB); more rows are taken in several ranges of hashes.
BITS_PER_ROW, MOST_BITS = 16, 1 << 29
#: The hash functions' seeds.
PROBES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Bits that are merged by one task.
BLOCK = 1 << 20
#: Rows from which a group of equal texts is joined by broadcast; there are fewer such groups than rows divided by this.
LARGE = 100_000


def normalised(text: str = "text") -> Column:
    """The text with each run of white space as one space; null is empty."""
    return F.regexp_replace(text_or_empty(text), SPACE_CLASS, " ")


def slots(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bit that each hash function gives each hash; bits is a power of two."""
    shift = np.uint64(64 - (bits.bit_length() - 1))
    return [mix(hashes.view(np.uint64) ^ np.uint64(p)) >> shift for p in PROBES]


def set_bits(hashed: DataFrame, bits: int, least: int) -> np.ndarray:
    """The filter's bits, packed: those that `least` rows or more of hashed (hash) set.

    Each task sends its set bits as one list for each block of the filter, so records that shuffle are
    counted in blocks and not in rows, and a hash that a task meets often is sent once. The
    finished bits, bits/8 bytes of them, come to the driver.
    """
    bounded_batches(hashed.sparkSession)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate([np.zeros(0, np.int64), *(b.column(0).to_numpy() for b in batches)])
        slot, times = np.unique(np.concatenate(slots(hashes, bits)), return_counts=True)
        block, offset = slot // np.uint64(BLOCK), (slot % np.uint64(BLOCK)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(slot) else np.zeros(0, np.int64)
        for a, b in zip(at, np.append(at[1:], len(slot))[: len(at)], strict=True):
            often = times[a:b] >= least
            fields = [pa.array([int(block[a])], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (offset[a:b][~often], offset[a:b][often]))]
            yield pa.RecordBatch.from_arrays(fields, ["block", "few", "often"])

    def merge(lists: pd.DataFrame) -> pd.DataFrame:
        count = np.zeros(min(BLOCK, bits), np.uint32)
        for few, often in zip(lists["few"], lists["often"], strict=True):
            count[np.frombuffer(few, np.uint32)] += 1
            count[np.frombuffer(often, np.uint32)] += least
        return pd.DataFrame({"block": lists["block"].iloc[:1], "bits": [np.packbits(count >= least, bitorder="little").tobytes()]})

    lists = hashed.select("hash").mapInArrow(sketch, "block long, few binary, often binary")
    out = np.zeros(bits // 8, np.uint8)
    for block, found in lists.groupBy("block").applyInPandas(merge, "block long, bits binary").collect():
        part = np.frombuffer(found, np.uint8)
        out[block * BLOCK // 8 : block * BLOCK // 8 + len(part)] = part
    return out


def maybe_in(df: DataFrame, hash_column: Column, packed: np.ndarray) -> Column:
    """Whether all bits of a hash are set. The filter is broadcast: MOST_BITS/8 bytes at most."""
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def probe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for hashes in batches:
            found = np.ones(len(hashes), bool)
            for slot in slots(hashes.to_numpy(zero_copy_only=False), 8 * len(shared.value)):
                found &= (shared.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield pa.array(found)

    return probe(hash_column)


def _power(bits: int) -> int:
    return 1 << max(10, (bits - 1).bit_length())


def _hashed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, sha, hash) of each row."""
    return docs.select(F.col(key).alias("key"), F.sha2(normalised(text), 256).alias("sha")).withColumn("hash", F.xxhash64("sha"))


def _in_ranges(hashed: DataFrame, most_bits: int, work: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """work(rows, bits) over all rows, or, where a filter for them would exceed most_bits, over one range of hashes after another.

    Equal texts have equal hashes, so a range is complete in itself. The ranges' results lie in the shared folder.
    """
    spark = hashed.sparkSession
    needed = _power(BITS_PER_ROW * max(hashed.count(), 1))
    ranges = max(1, needed // most_bits)
    if ranges == 1:
        return work(hashed, needed)
    folder = f"{shared_dir(spark)}/exact-dedup-{uuid.uuid4().hex}"
    hashed.sortWithinPartitions("hash").write.parquet(f"{folder}/hashes")
    width = 2**64 // ranges
    for i in range(ranges):
        first = i * width - 2**63
        part = spark.read.parquet(f"{folder}/hashes").filter(F.col("hash").between(first, first + width - 1))
        work(part, most_bits).write.mode("append").parquet(f"{folder}/found")
    return spark.read.parquet(f"{folder}/found")


def _split(hashed: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose text can't be repeated, and the others."""
    marked = cut_lineage(hashed.withColumn("maybe", maybe_in(hashed, F.col("hash"), set_bits(hashed, bits, 2))))
    return marked.filter(~F.col("maybe")), marked.filter("maybe")


def _groups(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (sha, key) the rows, and per sha the key that stays, how many rows have it, and all rows."""
    keyed = candidates.groupBy("sha", "hash", "key").agg(F.count("*").alias("rows"))
    first = F.min(F.struct(F.col("key").isNull().alias("no"), "key", "rows"))
    best = keyed.groupBy("sha", "hash").agg(first.alias("first"), F.sum("rows").alias("size"))
    return keyed, best.select("sha", "hash", F.col("first.key").alias("keep"), F.col("first.rows").alias("keep_rows"), "size")


def _join_groups(rows: DataFrame, groups: DataFrame, on: str, size: str = "size") -> DataFrame:
    """rows with their groups' columns. Groups that few rows and bytes hold are broadcast, else those of LARGE rows or more, so that none lies in one task."""
    groups = cut_lineage(groups)
    small = if_small(groups)
    if small is not groups:
        return rows.join(small, on)
    large = F.broadcast(groups.filter(F.col(size) >= LARGE))
    return rows.join(large, on).unionByName(rows.join(large.select(on), on, "left_anti").join(groups.filter(F.col(size) < LARGE), on))


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256; other columns are left out.

    Texts are equal when their normalised forms are (by SHA-256); a null text is empty, and empty
    texts are copies of one another. The smallest key stays, null counting as the largest; of rows
    that share both text and key one is kept. An empty table gives an empty result. Only rows that
    the filter calls possibly repeated shuffle; their groups are counted per (text, key) first, so a
    large group isn't gathered in one task.
    """

    def mark(hashed: DataFrame, bits: int) -> DataFrame:
        alone, candidates = _split(hashed, bits)
        keyed, best = _groups(candidates)
        keyed = cut_lineage(keyed)
        each = _join_groups(keyed, best.drop("hash"), "sha").withColumn("no", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
        kept = F.col("key").eqNullSafe(F.col("keep")) & (F.col("no") == 1)
        copies = each.select("key", "keep", "size", kept.alias("kept"), "sha")
        return alone.select("key", F.col("key").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(True).alias("kept"), "sha").unionByName(copies)

    found = _in_ranges(cut_lineage(_hashed(docs, key, text)), most_bits, mark)
    return found.select(F.col("key").alias(key), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of docs that mark_copies keeps, with all their columns, whatever their names.

    The groups of repeated texts are found as there. Few groups are then broadcast, and no row of docs shuffles; many
    are made a Bloom filter of most_bits at most, and only the rows that it lets through are joined. Where
    several rows share both the text and the key that stays one of them is picked.
    """

    def repeated(hashed: DataFrame, bits: int) -> DataFrame:
        return _groups(_split(hashed, bits)[1])[1].filter("size > 1")

    groups = cut_lineage(_in_ranges(cut_lineage(_hashed(docs, key, text)), most_bits, repeated))
    sha, keep, rows, size, possible = unused(docs, "sha", "keep", "keep_rows", "group_rows", "possible")
    named = groups.select(F.col("sha").alias(sha), F.col("keep").alias(keep), F.col("keep_rows").alias(rows), F.col("size").alias(size))
    whole = docs.withColumn(sha, F.sha2(normalised(text), 256))
    small = if_small(named)
    if small is not named:
        passed = whole.limit(0)
        joined = whole.join(small, sha, "left")
    else:
        packed = set_bits(groups, min(most_bits, _power(BITS_PER_ROW * groups.count())), 1)
        told = whole.withColumn(possible, maybe_in(whole, F.xxhash64(sha), packed))
        passed, through = (told.filter(x).drop(possible) for x in (~F.col(possible), F.col(possible)))
        matched = _join_groups(through, named, sha, size)
        joined = matched.unionByName(through.join(F.broadcast(named.filter(F.col(size) >= LARGE).select(sha)), sha, "left_anti").join(named.select(sha), sha, "left_anti"), allowMissingColumns=True)
    stays = joined.filter(F.col(rows).isNull() | F.col(key).eqNullSafe(F.col(keep)))
    single = stays.filter(F.coalesce(F.col(rows), F.lit(1)) == 1).select(*docs.columns)
    out = single if small is not named else single.unionByName(passed.select(*docs.columns))
    if groups.filter("keep_rows > 1").isEmpty():
        return out
    return out.unionByName(stays.filter(F.col(rows) > 1).dropDuplicates([sha]).select(*docs.columns))
