"""Near-duplicate groups by DartMinHash signatures of weighted word shingles and a banded join."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage, if_small, unused
from chronoloom.llm.components import connected_components
from chronoloom.llm.text_arrays import MULTIPLIER, chunks, mix, utf8, words

#: Words of a shingle, and the weighted Jaccard similarity from which texts are near duplicates.
SHINGLE, SIMILAR = 5, 0.8
#: Coordinates of a signature and coordinates of a band: at 0.8, one pair in 300,000 shares no band.
COORDINATES, BAND = 96, 4
#: log2 of the first rank level's upper end.
_FIRST_LEVEL = -6


def shingles(data: np.ndarray, starts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words, with the row of each; a shorter text is one shingle."""
    hashes, row = words(data, starts)
    if not len(hashes):
        return hashes, row
    count = np.bincount(row, minlength=len(starts) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    runs = np.maximum(count - size + 1, (count > 0).astype(np.int64))
    run_row = np.repeat(np.arange(len(count)), runs)
    at = np.arange(len(run_row)) - np.repeat(np.cumsum(runs) - runs, runs) + first[run_row]
    out = np.zeros(len(at), np.uint64)
    last = first[run_row] + count[run_row]
    for j in range(size):
        there = at + j < last
        out[there] = out[there] * MULTIPLIER + hashes[(at + j)[there]]
    return mix(out), run_row


def cells(element: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit cells of weighted elements: the c-th time that a row has an element is a cell of its own."""
    key = mix(element ^ mix(row.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    key, element, row = key[order], element[order], row[order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    times = np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))
    return mix(element + times.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)), row


@cache
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of a Poisson variable, as far as they differ from 1."""
    term, total, out = math.exp(-mean), 0.0, []
    for n in range(int(mean + 12 * math.sqrt(mean) + 20)):
        total += term
        out.append(total)
        term *= mean / (n + 1)
    return np.array(out)


def dart_signatures(cell: np.ndarray, row: np.ndarray, rows: int, k: int = COORDINATES) -> np.ndarray:
    """The earliest dart of each coordinate, one signature of k numbers per row (infinite for a row without cells).

    Darts fall on each unit cell as a Poisson process in rank, seeded by the cell alone and thrown level by
    level of rank, [0, 1/64), [1/64, 1/32), ...; a dart's hash gives its coordinate. A row takes levels
    until about k (ln k + 2) darts are expected on its cells, and further ones while a coordinate is
    empty, so a signature costs O(weight + k log k). Two rows agree in a coordinate with the probability of
    their weighted Jaccard similarity.
    """
    out = np.full(rows * k, np.inf)
    weight = np.bincount(row, minlength=rows)
    need = k * (math.log(k) + 2) / np.maximum(weight, 1)
    level, low = _FIRST_LEVEL, 0.0
    active = weight > 0
    while active.any():
        high = 2.0**level
        inside = active[row]
        on, of = cell[inside], row[inside]
        seed = mix(on ^ np.uint64((level - _FIRST_LEVEL + 1) * 0x2545F4914F6CDD1D & (2**64 - 1)))
        thrown = np.searchsorted(_poisson(high - low), (seed >> np.uint64(11)).astype(np.float64) / 2**53, "right")
        hit = np.flatnonzero(thrown)
        thrown = thrown[hit]
        number = np.arange(thrown.sum()) - np.repeat(np.cumsum(thrown) - thrown, thrown)
        dart = mix(np.repeat(seed[hit], thrown) + (number.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)
        rank = low + (high - low) * ((dart >> np.uint64(11)).astype(np.float64) / 2**53)
        coordinate = ((dart & np.uint64(0x7FF)) * np.uint64(k) >> np.uint64(11)).astype(np.int64)
        np.minimum.at(out, np.repeat(of[hit], thrown) * k + coordinate, rank)
        low, level = high, level + 1
        active &= (high < need) | np.isinf(out.reshape(rows, k)).any(axis=1)
    return out.reshape(rows, k)


def bands(signature: np.ndarray, size: int = BAND) -> np.ndarray:
    """One 64-bit key per band of `size` coordinates, different for equal values in different bands."""
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), -1, size)
    key = np.broadcast_to(np.arange(bits.shape[1], dtype=np.uint64), bits.shape[:2])
    for j in range(size):
        key = mix(key * MULTIPLIER + bits[:, :, j])
    return key


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), pa.array(values.view(np.int64)))


def text_bands(text: Column) -> Column:
    return F.arrow_udf(_text_bands, "struct<node:bigint,bands:array<bigint>>")(text)


def text_cells(text: Column) -> Column:
    return F.arrow_udf(_text_cells, "array<bigint>")(text)


def _text_bands(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A 64-bit hash of the text's words in their order, and its band keys (none for a text without words)."""
    for texts in batches:
        data, starts = utf8(texts)
        sums, keys, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in chunks(starts):
            part, own = data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]
            hashes, row = words(part, own)
            count = np.bincount(row, minlength=b - a)
            place = np.arange(len(hashes)) - (np.cumsum(count) - count)[row]
            whole = np.zeros(b - a, np.uint64)
            np.add.at(whole, row, mix(hashes + place.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
            sums.append(mix(whole ^ count.astype(np.uint64)))
            signature = dart_signatures(*cells(*shingles(part, own)), b - a)
            some = count > 0
            keys.append(bands(signature[some]).ravel())
            lengths.append(some * (COORDINATES // BAND))
        yield pa.StructArray.from_arrays([pa.array(np.concatenate(sums).view(np.int64)), _lists(np.concatenate(keys), np.concatenate(lengths))], ["node", "bands"])


def _text_cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """64-bit hashes of the unit cells of a text's shingles; two texts share as many as their counted shingles meet."""
    for texts in batches:
        data, starts = utf8(texts)
        found, lengths = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for a, b in chunks(starts):
            cell, row = cells(*shingles(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]))
            found.append(cell[np.argsort(row, kind="stable")])
            lengths.append(np.bincount(row, minlength=b - a))
        yield _lists(np.concatenate(found), np.concatenate(lengths))


#: About how many candidate pairs are dealt into a part; a text's cells are sent to a part once, however many of its pairs lie there.
PAIRS_PER_PART = 2000


def _live(buckets: DataFrame) -> DataFrame:
    """(key, node, members): the buckets that hold two nodes or more."""
    return buckets.join(buckets.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "key")


def _paired(pairs: DataFrame) -> DataFrame:
    """Distinct (a, b, home) of pairs (home, away): a is the lesser end, home the end that the pair is dealt by."""
    return pairs.groupBy(F.least("home", "away").alias("a"), F.greatest("home", "away").alias("b")).agg(F.min("home").alias("home"))


def _stars(live: DataFrame) -> DataFrame:
    """First candidate pairs: each member of a bucket with the bucket's centres.

    A bucket's first centre is its member that meets the most others over all its buckets, which in a large group of
    near copies is the one most of them are close to; the second is a random one. Thus a bucket of n gives 2n pairs at
    most. A pair's home is the member, so that a centre's pairs spread over all parts.
    """
    met = live.groupBy("node").agg(F.sum("members").alias("met"))
    centre = live.join(met, "node").groupBy("key").agg(
        F.max_by("node", F.struct("met", -F.col("node"))).alias("hub"), F.min_by("node", F.struct(F.xxhash64("key", "node"), "node")).alias("other")
    )
    edges = live.select("key", F.col("node").alias("home")).join(centre, "key")
    return _paired(edges.select("home", F.explode(F.array("hub", "other")).alias("away")).filter("home != away"))


def _open_nodes(live: DataFrame, components: DataFrame) -> DataFrame:
    """(node, component) of the nodes in buckets that span several components; an unlinked node is a component of its own."""
    state = live.select("key", "node").join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    spans = state.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("key")
    return state.join(spans, "key", "left_semi").select("node", "component").distinct()


def _across(open_nodes: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Candidate pairs of open nodes in different components; none that is `similar` is missing.

    Two sets of n and m cells that are similar share a cell within the first n - ceil(similar n) + 1 of the one and the like
    of the other, when both are ordered by how many open nodes have a cell. Rare cells come first, so a passage that
    many texts share makes no pairs, and cells of one text only count as places taken. What is joined are the cells
    of those prefixes which lie in several components, with pairs ruled out whose sizes or places leave no room for
    enough shared cells.
    """
    held = open_nodes.join(sets, "node").select("node", "component", F.size("cells").alias("n"), "cells")
    rows = held.select("node", F.explode("cells").alias("cell"))
    often = cut_lineage(rows.groupBy("cell").agg(F.count("*").alias("texts")).filter("texts > 1"))
    common = rows.join(if_small(often), "cell").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("texts", "cell"))).alias("common"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(similar) - 1e-9) + 1
    single = F.col("n") - F.size("common")
    prefix = common.join(held.drop("cells"), "node").withColumn("room", F.greatest((length - single).cast("int"), F.lit(0)))
    placed = prefix.select("node", "component", "n", single.alias("single"), F.posexplode(F.slice("common", 1, F.col("room"))).alias("at", "c"))
    placed = cut_lineage(placed.select(F.col("c.cell").alias("cell"), "node", "component", "n", (F.col("single") + F.col("at")).alias("at")))
    spans = placed.groupBy("cell").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low != high").select("cell")
    some = placed.join(spans, "cell", "left_semi")
    left, right = (some.select("cell", *(F.col(c).alias(f"{c}_{side}") for c in ("node", "component", "n", "at"))) for side in "ab")
    met = left.join(right, "cell").filter("node_a < node_b and component_a != component_b")
    # of a similar pair the first shared cell leaves room for enough others after it in both
    most = 1 + F.least(F.col("n_a") - F.col("at_a") - 1, F.col("n_b") - F.col("at_b") - 1)
    met = met.filter(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similar - 1e-9).filter(most >= (F.col("n_a") + F.col("n_b")) * similar / (1 + similar) - 1e-9)
    swap = F.xxhash64("node_a", "node_b") % 2 == 0
    return _paired(met.select(F.when(swap, F.col("node_a")).otherwise(F.col("node_b")).alias("home"), F.when(swap, F.col("node_b")).otherwise(F.col("node_a")).alias("away")))


def _measured(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least `similar`; pairs meet cells in the part of their home. pairs must be cut from their lineage, as they are counted."""
    parts = max(1, -(-pairs.count() // PAIRS_PER_PART))
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("home"), F.lit(parts)).alias("part"))
    needed = dealt.select("part", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node").repartition(parts, "part")
    left, right = (needed.select("part", F.col("node").alias(end), F.col("cells").alias(f"cells_{end}")) for end in "ab")
    shared = F.size(F.array_intersect("cells_a", "cells_b"))  # a text's cells are distinct but for a chance hash
    joined = dealt.repartition(parts, "part").join(right, ["part", "b"]).join(left, ["part", "a"])
    return joined.filter(shared >= (F.size("cells_a") + F.size("cells_b") - shared) * similar - 1e-9).select("a", "b")


def near_links(texts: DataFrame, nodes: DataFrame, similar: float) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that tie the groups together, and components (node, component).

    texts: (key, row, text); nodes: (node, first (key, row), bands). The buckets' stars link most of a group. Every pair that
    lies across two components of a bucket is then a candidate of an exact prefix join, so two texts that share a band are
    in one component if they are similar. Similar pairs inside a component that the stars didn't measure are no links.
    """
    texts.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    live = cut_lineage(_live(nodes.select("node", F.explode("bands").alias("key"))))
    involved = nodes.select("node", "first.key", "first.row").join(live.select("node").distinct(), "node", "left_semi")
    found = texts.join(if_small(cut_lineage(involved)), ["key", "row"]).select("node", text_cells(F.col("text")).alias("cells"))
    sets = cut_lineage(found.dropDuplicates(["node"]))  # rows that repeat key and text give the same cells
    links = cut_lineage(_measured(cut_lineage(_stars(live)), sets, similar))
    open_nodes = cut_lineage(_open_nodes(live, connected_components(links)))
    links = links.unionByName(cut_lineage(_measured(cut_lineage(_across(open_nodes, sets, similar)), sets, similar)))
    return links, connected_components(links)


def _classes(docs: DataFrame, similar: float, key: str, text: str) -> DataFrame:
    """A row per row of docs: key, row (hash of its text), class_id, class_row, copies, class_size.

    The row with the smallest key, then the smallest hash, stands for its class: class_id and class_row are its own.
    """
    bounded_batches(docs.sparkSession)
    own = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    rows = own.select("key", "row", text_bands(F.col("text")).alias("t")).select("key", "row", "t.node", "t.bands")
    rows = cut_lineage(rows)
    some = F.col("key").isNotNull() & (F.size("bands") > 0)
    nodes = rows.filter(some).groupBy("node").agg(F.min(F.struct("key", "row")).alias("first"), F.count("*").alias("copies"), F.first("bands").alias("bands"))
    nodes = cut_lineage(nodes)
    _, found = near_links(own, nodes, similar)
    linked = cut_lineage(nodes.drop("bands").join(found, "node"))
    groups = if_small(cut_lineage(linked.groupBy("component").agg(F.min("first").alias("head"), F.sum("copies").alias("class_size"))))
    classed = linked.join(groups, "component").select("node", "head", "copies", "class_size")
    single = nodes.join(found, "node", "left_anti").select("node", F.col("first").alias("head"), "copies", F.col("copies").alias("class_size"))
    copied = single.filter("copies > 1").unionByName(classed)
    # a text of one row that is in no group needs no join
    full = if_small(cut_lineage(copied))
    one = F.lit(1).cast("long")
    told = rows.select("key", "row", F.when(some, F.col("node")).alias("node")).join(full, "node", "left")
    return told.select(
        "key", "row", F.coalesce("head.key", "key").alias("class_id"), F.coalesce("head.row", "row").alias("class_row"), F.coalesce("copies", one).alias("copies"), F.coalesce("class_size", one).alias("class_size")
    )


def near_duplicates(docs: DataFrame, *, similar: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, class_id, copies, class_size.

    Texts of the same words are copies; copies counts their rows. A class holds the texts that are tied, directly or over
    others, by weighted Jaccard similarity of their 5-word shingles of at least `similar`; class_id is its smallest key and
    class_size counts its rows. A text of under five words is one shingle; one without words (null, empty) and a
    row without a key are in no class: class_id is the key, copies and class_size 1. Rows that share a key but not the
    text are documents of their own. Texts are told apart by a 64-bit hash of their words. An empty table gives no rows.
    """
    return _classes(docs, similar, key, text).select(F.col("key").alias(key), "class_id", "copies", "class_size")


def drop_near_duplicates(docs: DataFrame, *, similar: float = SIMILAR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stand for their class, and those that are in none, with all their columns.

    One row of each class stays: of rows that repeat both the key and the text that stand for it, one is picked.
    """
    key_name, row_name = unused(docs, "key", "row")
    found = cut_lineage(_classes(docs.select(key, text), similar, key, text).filter("class_size > 1"))
    stays = F.col("key").eqNullSafe(F.col("class_id")) & (F.col("row") == F.col("class_row"))
    named = lambda df: if_small(cut_lineage(df.select(F.col("key").alias(key_name), F.col("row").alias(row_name)).distinct()))
    on = (F.col(key) == F.col(key_name)) & (F.xxhash64(text) == F.col(row_name))
    kept = docs.join(named(found.filter(~stays)), on, "left_anti")
    again = named(found.filter(stays).groupBy("key", "row").count().filter("count > 1"))
    if again.isEmpty():
        return kept
    return kept.join(again, on, "left_anti").unionByName(kept.join(again, on, "left_semi").dropDuplicates([key, text]))
