"""Hard negatives by exact inner-product search, with one candidate list for each cluster of anchors.

For a cluster the candidates of a block are sorted once by an upper bound of their scores, from the angle to the
cluster's centroid; every anchor of the cluster walks that list until no later candidate can matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage, if_small

#: About how many anchors make a cluster, most clusters, and most anchors that centroids are fitted on.
PER_CLUSTER, MOST_CLUSTERS, SAMPLE = 128, 256, 4096
#: About how many candidates make a block, how many anchors walk it together, and how many blocks meet an anchor group in one task.
BLOCK, GROUP, SEGMENT = 4096, 512, 64
#: Candidates of a list that are scored in one step, and what angles and bounds are widened by for rounding.
STEP, SLACK = 512, 1e-6
#: Whole numbers below this are exact as doubles.
EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def floored(vector: Column, scale: int = 256) -> Column:
    """Whole-number components floor(scale * x); those beyond a long become the nearest long."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * float(scale)).cast("double"))


def _matrix(lists: pa.Array, dims: int = 0) -> np.ndarray:
    """[row, component]; shorter vectors are filled with 0."""
    lengths = np.diff(lists.offsets.to_numpy())
    flat = np.asarray(lists.flatten(), np.float64)
    dims = max(dims, int(lengths.max(initial=0)))
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((x * x).sum(1))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def _fill(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.pad(x, ((0, 0), (0, dims - x.shape[1])))


def fit_centroids(vectors: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of spherical k-means from evenly spread starts."""
    unit, _ = _unit(vectors)
    centroids = unit[np.linspace(0, len(unit) - 1, max(1, min(count, len(unit)))).astype(int)] if len(unit) else np.zeros((1, vectors.shape[1]))
    for _ in range(rounds):
        of = np.argmax(unit @ centroids.T, 1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, unit)
        fresh, norm = _unit(sums)
        centroids = np.where(norm[:, None] > 0, fresh, centroids)
    return centroids


def _angles(units: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ centroid, -1, 1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows, as longs; those beyond a long become the nearest long."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    return np.clip(np.array(whole, object).reshape(len(a), len(b)), -(2**63), 2**63 - 1).astype(np.int64)


@dataclass
class Block:
    key: np.ndarray
    label: np.ndarray
    vector: np.ndarray


@dataclass
class Asks:
    """For each ask the member it is of, the scores it wants, and a score that its k-th best is known to reach."""

    of: np.ndarray
    low: np.ndarray
    high: np.ndarray
    least: np.ndarray


def walk(members: Block, asks: Asks, centroid: np.ndarray, block: Block, same: bool, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, row of the block, score): for each ask its first k rows of the block, by score and then key.

    A row counts if its label is (same) or isn't (not same) that of the ask's member, and its score lies in the ask's range and
    isn't below `least`. All members share the block's order by upper bound and stop when the bound shows that no later row matters.
    """
    dims = max(members.vector.shape[1], block.vector.shape[1], len(centroid))
    a, b, centre = _fill(members.vector, dims), _fill(block.vector, dims), _fill(centroid[None, :], dims)[0]
    (a_unit, a_norm), (b_unit, b_norm) = _unit(a), _unit(b)
    spread = _angles(a_unit, centre).max(initial=0)
    bound = b_norm * np.cos(np.maximum(0, _angles(b_unit, centre) - spread - SLACK))
    order = np.argsort(-bound, kind="stable")
    ask, row, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    need = np.maximum(asks.low, asks.least)
    for begin in range(0, len(order), STEP):
        reach = bound[order[begin]] * a_norm
        open_asks = np.flatnonzero(need <= reach[asks.of] + np.abs(reach[asks.of]) * SLACK + SLACK)
        if not len(open_asks):
            break
        own, at = np.unique(asks.of[open_asks], return_inverse=True)
        chunk = order[begin : begin + STEP]
        found = products(a[own], b[chunk])
        fits = (members.label[own][:, None] == block.label[chunk][None, :]) == same
        fits &= members.key[own][:, None] != block.key[chunk][None, :]
        found, fits = found[at], fits[at]
        x, y = np.nonzero(fits & (found >= need[open_asks][:, None]) & (found <= asks.high[open_asks][:, None]))
        ask, row, score = np.concatenate((ask, open_asks[x])), np.concatenate((row, chunk[y])), np.concatenate((score, found[x, y]))
        rank = np.lexsort((block.key[row], -score, ask))
        ask, row, score = ask[rank], row[rank], score[rank]
        place = np.arange(len(ask)) - np.searchsorted(ask, ask)
        last = place == k - 1
        need[ask[last]] = np.maximum(need[ask[last]], score[last])
        ask, row, score = (v[place < k] for v in (ask, row, score))
    return ask, row, score


def _dealt(rows: DataFrame, centroids: np.ndarray, most: int, mark: str, *more: str) -> DataFrame:
    """Blocks of about `most` rows of one nearest centroid: (block, cluster, radius, norm, and lists of the columns)."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, norm = _unit(_matrix(batch.column("vector"), shared.value.shape[1]))
            near = unit @ _fill(shared.value, unit.shape[1]).T
            of = np.argmax(near, 1)
            angle = np.arccos(np.clip(near[np.arange(len(of)), of], -1, 1))
            columns = [*batch.columns, pa.array(of, pa.int32()), pa.array(angle), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "cluster", "angle", "norm"])

    names = ["key", "label", "vector", *more]
    kinds = ", ".join(f"{n} {rows.schema[n].dataType.simpleString()}" for n in names)
    placed = cut_lineage(rows.select(*names).mapInArrow(place, f"{kinds}, cluster int, angle double, norm double"))
    parts = placed.groupBy("cluster").agg(F.ceil(F.count("*") / most).alias("parts"))
    numbered = placed.join(F.broadcast(parts), "cluster").withColumn("part", F.pmod(F.xxhash64("key"), "parts"))
    lists = [F.collect_list(n).alias(f"{mark}_{n}") for n in names]
    blocks = numbered.groupBy("cluster", "part").agg(F.max("angle").alias("radius"), F.max("norm").alias("norm"), *lists)
    return cut_lineage(blocks.select(F.concat_ws("-", "cluster", "part").alias(mark), F.col("cluster").alias(f"{mark}_cluster"), F.col("radius").alias(f"{mark}_radius"), F.col("norm").alias(f"{mark}_norm"), *(f"{mark}_{n}" for n in names)))


def _meet(groups: DataFrame, blocks: DataFrame, pairs: DataFrame, centroids: np.ndarray, same: bool, k: int) -> DataFrame:
    """(key, ask, other, score, positive): what the walks of the pairs (g, b) find. A group meets at most some SEGMENT blocks in a task."""
    shared = groups.sparkSession.sparkContext.broadcast(centroids)

    def lists(batch: pa.RecordBatch, i: int, name: str) -> pa.Array:
        return batch.column(name).slice(i, 1).flatten()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                members, block = (Block(np.asarray(lists(batch, i, f"{s}_key")), np.asarray(lists(batch, i, f"{s}_label")), _matrix(lists(batch, i, f"{s}_vector"))) for s in "gb")
                per_member = lists(batch, i, "g_asks")
                of = np.repeat(np.arange(len(per_member)), np.diff(per_member.offsets.to_numpy()))
                flat = per_member.flatten()
                low, high, least = (np.asarray(flat.field(f)) for f in ("low", "high", "least"))
                ask, row, score = walk(members, Asks(of, low, high, least), shared.value[batch.column("g_cluster")[i].as_py()], block, same, k)
                told = [pa.array(members.key[of[ask]]), flat.field("ask").take(pa.array(ask)), pa.array(block.key[row]), pa.array(score)]
                yield pa.RecordBatch.from_arrays(told, ["key", "ask", "other", "score"])

    segments = max(1, -(-blocks.count() // SEGMENT))
    segment = F.pmod(F.xxhash64("b"), F.lit(segments)).alias("segment")
    sides = groups.withColumn("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(segments - 1).cast("long")))) if segments > 1 else groups.withColumn("segment", F.lit(0).cast("long"))
    met = blocks.join(pairs.select("g", "b", segment), "b").join(if_small(sides, 10_000), ["g", "segment"])
    wanted = ["g_cluster", "g_key", "g_label", "g_vector", "g_asks", "b_key", "b_label", "b_vector"]
    return met.select(*wanted).mapInArrow(search, "key long, ask long, other long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("key", "ask").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(asked: DataFrame, blocks: DataFrame, centroids: np.ndarray, same: bool, k: int) -> DataFrame:
    """(key, ask, other, score, rank): for each ask of asked (key, label, vector, asks: array of (ask, low, high)) its first k candidates.

    Anchors first walk the blocks of their own cluster. The k-th scores found there bound from below what matters, so other blocks are
    met only if their bound reaches it.
    """
    told = asked.withColumn("asks", F.transform("asks", lambda x: F.struct(x["ask"].alias("ask"), x["low"].alias("low"), x["high"].alias("high"), F.lit(-EXACT * 1024).alias("least"))))
    groups = _dealt(told, centroids, GROUP, "g", "asks")
    block_marks, group_marks = blocks.select("b", "b_cluster", "b_radius", "b_norm"), groups.select("g", "g_cluster")
    home = group_marks.join(block_marks, F.col("g_cluster") == F.col("b_cluster"))
    near = cut_lineage(_first(_meet(groups, blocks, home, centroids, same, k), k).drop("rank"))
    if len(centroids) == 1:
        return _first(near, k)
    reached = near.groupBy("key", "ask").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k)
    least = reached.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("ask", F.lit(-1).cast("long")), "least"))).alias("reached"))
    raised = F.transform("asks", lambda x: x.withField("least", F.coalesce(F.element_at("reached", F.coalesce(x["ask"], F.lit(-1).cast("long"))).cast("double"), x["least"])))
    groups = _dealt(told.join(least, "key", "left").withColumn("asks", raised), centroids, GROUP, "g", "asks")
    # what a group needs of a candidate of length 1, by its member that needs least
    shared = groups.sparkSession.sparkContext.broadcast(centroids)

    def needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                norm = _unit(_matrix(batch.column("g_vector").slice(i, 1).flatten(), shared.value.shape[1]))[1]
                per_member = batch.column("g_asks").slice(i, 1).flatten()
                of = np.repeat(np.arange(len(per_member)), np.diff(per_member.offsets.to_numpy()))
                flat = per_member.flatten()
                need = np.maximum(np.asarray(flat.field("low")), np.asarray(flat.field("least")))
                out.append(float((need / np.where(norm[of] > 0, norm[of], np.inf)).min(initial=np.inf)))
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("g_cluster"), batch.column("g_radius"), pa.array(out)], ["g", "g_cluster", "g_radius", "need"])

    marks = groups.select("g", "g_cluster", "g_radius", "g_vector", "g_asks").mapInArrow(needs, "g string, g_cluster int, g_radius double, need double")
    between = np.arccos(np.clip(centroids @ centroids.T, -1, 1))
    apart = asked.sparkSession.createDataFrame([(i, j, float(between[i, j])) for i in range(len(between)) for j in range(len(between)) if i != j], "g_cluster int, b_cluster int, apart double")
    bound = F.col("b_norm") * F.cos(F.greatest(F.lit(0.0), F.col("apart") - F.col("g_radius") - F.col("b_radius") - 3 * SLACK))
    pairs = marks.join(F.broadcast(apart), "g_cluster").join(block_marks, "b_cluster").filter(bound + F.abs(bound) * SLACK + SLACK >= F.col("need"))
    return _first(near.unionByName(_meet(groups, blocks, cut_lineage(pairs.select("g", "b")), centroids, same, k)), k)


def hard_negatives(
    rows: DataFrame, anchor: Column, *, key: str = "vec_id", label: str = "label", vector: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, per_cluster: int = PER_CLUSTER, block: int = BLOCK
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vector holds whole numbers; scores are inner products, exact within a long. For each row where `anchor` holds, its positives are its
    first rows of the same label, by score and then key; the negatives of each are the first rows of another label whose score
    lies between least and most per cent of the positive's. Rows with a null key or label or an unusable vector take no part; of rows
    that repeat a key that with the smallest label and vector does; shorter vectors are filled with 0. An anchor without positives, or
    a positive without negatives, gives no rows, as does an empty table. Keys and labels are whole numbers; other columns are left out.
    """
    spark = rows.sparkSession
    bounded_batches(spark, 64)
    fit = rows.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & usable(F.col(vector)))
    named = fit.select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = cut_lineage(named.groupBy("key").agg(F.min(F.struct("label", "vector", "anchor")).alias("row")).select("key", "row.*"))
    anchors = own.filter("anchor")
    count = anchors.count()
    sample = anchors.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("vector").toArrow().column(0).combine_chunks()
    centroids = fit_centroids(_matrix(sample), min(MOST_CLUSTERS, -(-count // per_cluster)))
    blocks = _dealt(own, centroids, block, "b")
    wide = EXACT * 1024
    whole = F.struct(F.lit(None).cast("long").alias("ask"), F.lit(-wide).alias("low"), F.lit(wide).alias("high"))
    best = cut_lineage(search(anchors.select("key", "label", "vector", F.array(whole).alias("asks")), blocks, centroids, True, positives))
    # whole scores s with least * p <= 100 * s <= most * p
    score = F.col("score").cast("decimal(38,0)")
    low, high = (F.expr(f"cast({side}(cast(score as decimal(20,0)) * {share} / 100) as double)") for side, share in (("ceil", least), ("floor", most)))
    asks = best.select("key", F.struct(F.col("other").alias("ask"), low.alias("low"), high.alias("high")).alias("one")).filter("one.low <= one.high").groupBy("key").agg(F.collect_list("one").alias("asks"))
    found = search(anchors.select("key", "label", "vector").join(asks, "key"), blocks, centroids, False, negatives)
    pairs = best.select("key", F.col("other").alias("ask"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["key", "ask"]).select(F.col("key").alias("anchor_id"), F.col("ask").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
