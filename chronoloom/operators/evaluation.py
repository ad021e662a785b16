"""Gold against predictions: scores, aggregates, calibration, constraint-first ranking, gates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import neighbours
from chronoloom.functions.scores import clamp

#: Steps, first rate and ridge of the gradient descent that fits a sigmoid; bins that a score's samples are pooled in.
STEPS, RATE, RIDGE, BINS = 800, 0.2, 0.001, 10_000


def brier(probability: Column, label: Column) -> Column:
    return F.avg(F.pow(probability - label, F.lit(2)))


def shared_mean(df: DataFrame, keys: Sequence[str], metric: str = "metric", value: str = "value", records: str = "records") -> DataFrame:
    """Means of the metrics that all of a key's records have; df has a row per record and metric, with the number of records."""
    kept = df.groupBy(*keys, metric).agg(F.count(value).alias("_n"), F.max(records).alias("_all"), F.avg(value).alias("mean"))
    return kept.filter("_n = _all").select(*keys, metric, "mean")


def performance(df: DataFrame, keys: Sequence[str], *, busy: str, length: str, latency: str, peak: str) -> DataFrame:
    """Ratio of sums as real-time factor, largest peak, interpolated percentiles of the latencies there are, and how many there are."""
    out = df.groupBy(*keys).agg((F.sum(busy) / F.greatest(F.sum(length), F.lit(1e-9))).alias("rtf"), F.max(peak).alias("peak"), (F.count(latency) / F.count("*")).alias("observed"))
    half = neighbours.quantiles(neighbours.ranked_values(df, list(keys), latency), list(keys), latency, {"p50": 0.5, "p95": 0.95})
    return out.join(half, list(keys), "left").select(*keys, "rtf", "peak", "p50", "p95", "observed")


def ranked(df: DataFrame, within: Sequence[str], *, score: Column, violations: dict[str, Column], key: str) -> DataFrame:
    """Candidates ranked by score, those without violations first; violations are named in an array."""
    faults = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in violations.items())))
    out = df.withColumn("score", score).withColumn("violations", faults).withColumn("eligible", F.size("violations") == 0)
    order = Window.partitionBy(*within).orderBy(F.desc("eligible"), F.desc("score"), key)
    return out.withColumn("rank", F.row_number().over(order))


def pooled(scores: pd.Series, labels: pd.Series, weights: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that go down: the least score of each step and its value."""
    frame = pd.DataFrame({"s": scores, "w": weights, "y": labels * weights}).groupby("s").sum().reset_index()
    left, total, mass = [], [], []
    for s, w, y in frame.itertuples(index=False):
        left.append(s)
        total.append(y)
        mass.append(w)
        while len(left) > 1 and total[-2] * mass[-1] >= total[-1] * mass[-2]:
            y, w = total.pop(), mass.pop()
            left.pop()
            total[-1] += y
            mass[-1] += w
    return np.array(left), np.array(total) / np.array(mass)


def isotonic(edges: np.ndarray, values: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The step function: the value of the last step at or below a score, that of the first step below all."""
    return values[np.maximum(np.searchsorted(edges, scores, "right") - 1, 0)]


def sigmoid_fit(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Slope and offset by full-batch gradient descent with a falling rate; the slope alone is held by a ridge."""
    a, b, share = 0.0, 0.0, weights / weights.sum()
    for i in range(STEPS):
        off = (1 / (1 + np.exp(-np.clip(a * x + b, -60, 60))) - y) * share
        rate = RATE / np.sqrt(1 + i / 100)
        a, b = a - rate * ((off * x).sum() + RIDGE * a), b - rate * off.sum()
    return a, b


CALIBRATION = "method string, edges array<double>, values array<double>, train_rows long, validation_brier double, test_brier double"


def calibrated(samples: DataFrame, keys: Sequence[str], *, score: str, label: str, split: str) -> DataFrame:
    """Per key a calibration fitted on its train split; the method with the least Brier score on the validation split wins
    (ties by name), and the test split tells its score. Keys that lack a split have no row.

    Scores of a split are pooled by value (rounded to 1/BINS of its unit) before they gather, so a key's task sees a
    bounded number of rows.
    """
    value = F.round(F.col(score) * BINS) / BINS
    counts = samples.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*keys, F.col(split).alias("_split"), value.alias("_x")).agg(F.count("*").alias("_n"), F.sum(label).alias("_y"))
    names = list(keys)

    def fit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = {s: pdf[pdf["_split"] == s].sort_values("_x") for s in ("train", "validation", "test")}
        if any(p.empty for p in parts.values()):
            return pd.DataFrame(columns=[*names, "method", "edges", "values", "train_rows", "validation_brier", "test_brier"])
        t = parts["train"]
        x, y, n = t["_x"].to_numpy(), (t["_y"] / t["_n"]).to_numpy(), t["_n"].to_numpy(float)
        edges, values = pooled(t["_x"], t["_y"] / t["_n"], t["_n"])
        slope, offset = sigmoid_fit(x, y, n)
        methods = {"isotonic": lambda s: isotonic(edges, values, s), "platt": lambda s: 1 / (1 + np.exp(-(slope * s + offset)))}

        def loss(method: str, part: pd.DataFrame) -> float:
            p, hit, rows = methods[method](part["_x"].to_numpy()), part["_y"].to_numpy(float), part["_n"].to_numpy(float)
            return float((hit * (1 - p) ** 2 + (rows - hit) * p**2).sum() / rows.sum())

        best = min(methods, key=lambda m: (loss(m, parts["validation"]), m))
        shape = (edges.tolist(), values.tolist()) if best == "isotonic" else ([slope], [offset])
        return pd.DataFrame([[*key, best, *shape, int(n.sum()), loss(best, parts["validation"]), loss(best, parts["test"])]], columns=[*names, "method", "edges", "values", "train_rows", "validation_brier", "test_brier"])

    head = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in samples.select(*keys).schema)
    return counts.groupBy(*keys).applyInPandas(fit, f"{head}, {CALIBRATION}")


def greedy_pairs(pairs: DataFrame, keys: Sequence[str], left: str, right: str, weight: str) -> DataFrame:
    """One-to-one pairs of labels per key, largest weight first, ties by left and right label.

    Rounds take every pair that is the best of both its labels; such pairs are what a sequential pass would take,
    so few rounds do, each a window over the pairs that are left.
    """
    from chronoloom.operators.lineage import cut

    names = [*keys, left, right, weight]
    rest, taken = cut(pairs.groupBy(*keys, left, right).agg(F.max(weight).alias(weight)).select(*names)), None
    while not rest.isEmpty():
        order = [F.desc(weight), F.asc(left), F.asc(right)]
        first = lambda side: F.row_number().over(Window.partitionBy(*keys, side).orderBy(*order)) == 1
        best = cut(rest.withColumn("_l", first(left)).withColumn("_r", first(right)).filter("_l and _r").select(*names))
        taken = best if taken is None else taken.unionByName(best)
        rest = cut(rest.join(best.select(*keys, left), [*keys, left], "left_anti").join(best.select(*keys, right), [*keys, right], "left_anti"))
    return rest if taken is None else taken


def votes(df: DataFrame, keys: Sequence[str], token: str, weight: str) -> DataFrame:
    """The token with the largest sum of weights per key, and its share; of equal sums the empty token wins, then the larger one."""
    sums = df.groupBy(*keys, token).agg(F.sum(weight).alias("_w"))
    best = sums.groupBy(*keys).agg(F.max(F.struct("_w", (F.col(token) == "").alias("_e"), F.col(token).alias("_t"))).alias("_b"), F.sum("_w").alias("_all"))
    return best.select(*keys, F.col("_b._t").alias(token), (F.col("_b._w") / F.col("_all")).alias("support"))


def vote_weight(reliability: Column, confidence: Column, coverage: Column, glossary: Column, legal: Column) -> Column:
    """Reliability by confidence (0.5 where unknown) by half to full weight of coverage, 15 % more for glossary terms, 0 for illegal tokens."""
    weight = reliability * F.coalesce(confidence, F.lit(0.5)) * (0.5 + 0.5 * clamp(coverage))
    return weight * F.when(glossary, 1.15).otherwise(1.0) * legal.cast("double")


def issue_score(issues: Column, penalties: dict[str, float]) -> Column:
    """1 less the penalties of the issues, within 0 and 1."""
    known = F.create_map(*(F.lit(x) for pair in penalties.items() for x in pair))
    return clamp(F.aggregate(issues, F.lit(1.0), lambda s, i: s - F.coalesce(F.try_element_at(known, i), F.lit(0.0))))


def edit_distance(left: Sequence[object], right: Sequence[object]) -> int:
    """Levenshtein distance of two sequences, two rows at a time over numpy arrays."""
    if not left or not right:
        return max(len(left), len(right))
    ids = {t: i for i, t in enumerate(dict.fromkeys([*left, *right]))}
    b = np.array([ids[t] for t in right])
    row = np.arange(len(b) + 1)
    step = np.arange(len(b) + 1)
    for i, t in enumerate(left, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (b != ids[t]))
        row = np.minimum.accumulate(np.concatenate(([i], best)) - step) + step
    return int(row[-1])


def token_distance(left: Column, right: Column) -> Column:
    """Levenshtein distance of two arrays of tokens; a null array is as an empty one."""

    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([edit_distance([] if x is None else list(x), [] if y is None else list(y)) for x, y in zip(a, b, strict=True)], dtype="int64")

    return F.pandas_udf(distance, "long")(left, right)
