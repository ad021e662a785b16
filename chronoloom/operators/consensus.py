"""Consensus over competing hypotheses of a segment: alignment, columns, votes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.evaluation import votes

_TOKEN = re.compile(r"[\w'’]+|[^\w\s]")
#: Shares of the vote below which a column is in doubt, or falls back to the anchor.
DOUBT, FALLBACK = 0.67, 0.45


def _costs(before: np.ndarray, first: int, a: np.ndarray, b: np.ndarray) -> Iterator[np.ndarray]:
    """The rows of edit costs after `before`, one for each token of a; first: that token's place in the whole text, from 1."""
    step = np.arange(len(b) + 1, dtype=np.int32)
    for i, token in enumerate(a, first):
        best = np.minimum(before[1:] + 1, before[:-1] + (b != token))
        before = np.minimum.accumulate(np.concatenate((np.array([i], np.int32), best)) - step) + step
        yield before


def align(anchor: list[str], other: list[str]) -> list[tuple[int | None, int | None]]:
    """Global alignment by edit distance; of equal paths a pair goes before a deletion before an insertion.

    Every so many rows of costs one is kept, and the rows between two of them are made again when the way back comes through, so memory
    is some 2 sqrt(n) rows: 25 MB for two texts of 20,000 tokens.
    """
    n, m = len(anchor), len(other)
    ids = {t: i for i, t in enumerate(dict.fromkeys([*anchor, *other]))}
    a, b = np.array([ids[t] for t in anchor], np.int32), np.array([ids[t] for t in other], np.int32)
    stride = max(1, int(n**0.5))
    row = np.arange(m + 1, dtype=np.int32)
    kept = [row]
    for i, row in enumerate(_costs(row, 1, a, b), 1):
        if i % stride == 0:
            kept.append(row)
    path, i, j = [], n, m
    while i or j:
        base = max(0, (i - 1) // stride) * stride
        block = [kept[base // stride], *_costs(kept[base // stride], base + 1, a[base:i], b)]
        while (i > base or (i == base == 0)) and (i or j):
            here = block[i - base]
            if i and j and here[j] == block[i - base - 1][j - 1] + (a[i - 1] != b[j - 1]):
                i, j = i - 1, j - 1
                path.append((i, j))
            elif i and here[j] == block[i - base - 1][j] + 1:
                i -= 1
                path.append((i, None))
            else:
                j -= 1
                path.append((None, j))
    return path[::-1]


def columns(texts: list[tuple[object, list[str]]]) -> list[tuple[int, int, object, str]]:
    """(position, insertion, candidate, token) of all hypotheses around the longest one, the first of equal ones; a
    hypothesis without a token in a column votes for the empty one."""
    anchor = max(range(len(texts)), key=lambda k: (len(texts[k][1]), -k))
    found: dict[tuple[int, int], dict[object, str]] = {(i + 1, 0): {texts[anchor][0]: t} for i, t in enumerate(texts[anchor][1])}
    for k, (name, tokens) in enumerate(texts):
        if k == anchor:
            continue
        at, extra = 0, 0
        for i, j in align(texts[anchor][1], tokens):
            at, extra = (i + 1, 0) if i is not None else (at, extra + 1)
            if j is not None:
                found.setdefault((at, extra), {})[name] = tokens[j]
    return [(at, extra, name, cast.get(name, "")) for (at, extra), cast in sorted(found.items()) for name, _ in texts]


def confusion_network(df: DataFrame, segment: str, candidate: str, text: str, weight: str | None = None) -> DataFrame:
    """(segment, position, insertion, token, support, state): the winning token of each aligned column.

    Each candidate has one vote a column, of its weight (1 without one; a null weight counts nothing); state tells whether the support is certain, in doubt, or so low that a reviewer
    decides. A segment's hypotheses meet in one task: they are a few texts of one stretch of speech.
    """
    kind = df.schema[segment].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(candidate)
        rows = columns([(c, _TOKEN.findall(t)) for c, t in zip(ordered[candidate], ordered[text], strict=True)])
        out = pd.DataFrame(rows, columns=["position", "insertion", "candidate", "token"])
        out.insert(0, segment, pdf[segment].iloc[0])
        return out

    cast = df.select(segment, candidate, text).groupBy(segment).applyInPandas(run, f"{segment} {kind}, position long, insertion long, candidate {df.schema[candidate].dataType.simpleString()}, token string")
    if weight is None:
        cast = cast.withColumn("weight", F.lit(1.0))
    else:
        cast = cast.join(df.groupBy(segment, candidate).agg(F.coalesce(F.max(weight), F.lit(0.0)).alias("weight")), [segment, candidate])
    won = votes(cast, [segment, "position", "insertion"], "token", "weight")
    state = F.when(F.col("support") < FALLBACK, "review").when(F.col("support") < DOUBT, "doubt").otherwise("certain")
    return won.withColumn("support", F.round("support", 6)).withColumn("state", state)
