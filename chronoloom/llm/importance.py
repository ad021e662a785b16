"""Quality classification by importance resampling.

Two generative models over hashed n-grams, one of target text and one of all raw text, give each
document a log ratio; a Gumbel top-k draw without replacement takes the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage, unit_hash
from chronoloom.llm.text_arrays import MULTIPLIER, chunks, mix, utf8, words

#: Buckets of each family of n-grams: byte trigrams, words, pairs of words; one more counts pairs of the same word.
BUCKETS = 1 << 16
FAMILIES, REPEAT, EVENTS = 3, 3 * BUCKETS, 3 * BUCKETS + 1
#: Most labelled documents that the target model and the threshold are fitted on.
LABELLED = 20_000
#: What is added to a bucket's count in the target, and to the count that the raw text lets expect; weight of a neutral prior in a document's mean.
SMOOTHING, NEUTRAL = 1.0, 20.0
#: The Gumbel noise is scaled by so much before it is added to the mean log ratio, as if a document had 1/TEMPERATURE independent n-grams.
TEMPERATURE = 0.02


def _events(data: np.ndarray, starts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the buckets of its n-grams and the row of each. A pair of equal words is one event, whatever the word, as each such pair is rare."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    if len(data) >= 3:
        key = data[:-2].astype(np.uint32) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:].astype(np.uint32) << np.uint32(16)
        grams = (key * np.uint32(2654435761)) >> np.uint32(16)
        whole = row[:-2] == row[2:]
        grams, gram_row = grams[whole].astype(np.int64), row[:-2][whole]
    else:
        grams, gram_row = np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes, of = words(data, starts)
    low = np.uint64(BUCKETS - 1)
    single = (mix(hashes) & low).astype(np.int64) + BUCKETS
    both = of[1:] == of[:-1]
    one, two = hashes[:-1][both], hashes[1:][both]
    pairs = np.where(one == two, REPEAT, (mix(one * MULTIPLIER + two) & low).astype(np.int64) + 2 * BUCKETS)
    return [(grams, gram_row), (single, of), (pairs, of[1:][both])]


@dataclass(frozen=True)
class RatioModel:
    """log p_target - log p_raw of every bucket."""

    log_ratio: np.ndarray

    def score(self, texts: pa.Array) -> np.ndarray:
        """Sum over the families of the mean log ratio of a text's n-grams, pulled to 0 for short texts; NaN without n-grams."""
        data, starts = utf8(texts)
        out = np.zeros(len(texts))
        for a, b in chunks(starts):
            some = np.zeros(b - a, bool)
            for event, row in _events(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]):
                n = np.bincount(row, minlength=b - a)
                out[a:b] += np.bincount(row, self.log_ratio[event], b - a) / (n + NEUTRAL)
                some |= n > 0
            out[a:b][~some] = np.nan
        return out


def event_counts(docs: DataFrame, text: str, target: Column) -> DataFrame:
    """(bucket, raw, target): n-grams in all rows and in those where target holds, summed over all tasks."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, chosen = np.zeros(EVENTS, np.int64), np.zeros(EVENTS, np.int64)
        for batch in batches:
            data, starts = utf8(batch.column(0))
            flags = np.asarray(batch.column(1).fill_null(False))
            for a, b in chunks(starts):
                flag = flags[a:b]
                for event, row in _events(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]):
                    raw += np.bincount(event, minlength=EVENTS)
                    if flag.any():
                        chosen += np.bincount(event[flag[row]], minlength=EVENTS)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(chosen[seen])], ["bucket", "raw", "target"])

    parts = docs.select(F.col(text).alias("text"), target.alias("target")).mapInArrow(count, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def labelled_sample(labels: DataFrame, most: int = LABELLED, key: str = "doc_id") -> DataFrame:
    """At most `most` labelled keys in hash order: (label_key, good, fit); conflicting labels of a key: the lowest."""
    one = labels.filter(F.col(key).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(key).alias("label_key")).agg(F.min("quality").alias("quality"))
    first = one.orderBy(F.xxhash64("label_key"), "label_key").limit(most)
    return first.select("label_key", (F.col("quality") >= 1).alias("good"), (F.pmod(F.xxhash64("label_key", F.lit(1)), F.lit(2)) == 0).alias("fit"))


def fit_ratio(docs: DataFrame, sample: DataFrame, key: str = "doc_id", text: str = "text") -> RatioModel:
    """The raw model counts every document, the target model those of the sample labelled good for fitting.

    The sample is broadcast, as LABELLED bounds it. Its counts, one row per bucket, come to the driver. A bucket's
    ratio is that of its count in the target to the count that the raw text lets expect, both smoothed, so that
    rare n-grams say little.
    """
    wanted = F.broadcast(sample.filter("good and fit").select("label_key"))
    marked = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(wanted, F.col("key") == F.col("label_key"), "left")
    raw, target = np.zeros(EVENTS), np.zeros(EVENTS)
    for bucket, r, t in event_counts(marked, "text", F.col("label_key").isNotNull()).collect():
        raw[bucket], target[bucket] = r, t
    ratio = np.zeros(EVENTS)
    for i in range(FAMILIES):
        part = slice(i * BUCKETS, (i + 1) * BUCKETS + (i == FAMILIES - 1))
        if target[part].sum():
            expected = raw[part] * (target[part].sum() / raw[part].sum())
            ratio[part] = np.log((target[part] + SMOOTHING) / (expected + SMOOTHING))
    return RatioModel(ratio)


def with_log_ratio(docs: DataFrame, model: RatioModel, text: str = "text", name: str = "log_ratio") -> DataFrame:
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(shared.value.score(texts), from_pandas=True)

    return docs.withColumn(name, score(F.col(text)))


def best_cut(scores: list[tuple[float, bool]]) -> float:
    """The cut with the best mean of both classes' recalls; in the middle of the gap it falls into."""
    if len({good for _, good in scores}) < 2:
        return float("-inf")
    value, good = (np.array(x) for x in zip(*sorted(scores), strict=True))
    kept = 1 - np.concatenate(([0], np.cumsum(good))) / good.sum()
    dropped = np.concatenate(([0], np.cumsum(~good))) / (~good).sum()
    edge = np.concatenate(([True], value[1:] > value[:-1], [True]))
    best = int(np.argmax(np.where(edge, kept + dropped, -1)))
    return float("-inf") if best == 0 else float("inf") if best == len(value) else float((value[best - 1] + value[best]) / 2)


def kth_largest(df: DataFrame, name: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a column, by histograms of `bins` bins that narrow in on it."""
    low, high, rows = df.agg(F.min(name), F.max(name), F.count(name)).first()
    if k <= 0 or not rows:
        return float("inf")
    if k >= rows:
        return low
    inside, above = df.filter(F.col(name).isNotNull()), 0
    while True:
        width = (high - low) / bins
        if width <= 0 or low + width == low or inside.limit(bins + 1).count() <= bins:
            break
        bin_no = F.least(F.floor((F.col(name) - low) / width), F.lit(bins - 1)).cast("int")
        for number, count, least, most in sorted(inside.groupBy(bin_no.alias("bin")).agg(F.count("*"), F.min(name), F.max(name)).collect(), reverse=True):
            if above + count >= k:
                low, high = least, most
                inside = df.filter((F.col(name) >= low) & (F.col(name) <= high))
                break
            above += count
    if low == high:
        return low
    return inside.orderBy(F.desc(name)).limit(k - above).agg(F.min(name)).first()[0]


def gumbel(key: Column, seed: str) -> Column:
    u = unit_hash(key, seed) + F.lit(0.5 / 2**52)
    return -F.log(-F.log(u))


def resample(
    docs: DataFrame, labels: DataFrame, *, take: int | None = None, temperature: float = TEMPERATURE, seed: str = "gumbel", most_labelled: int = LABELLED, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with log_ratio, gumbel_score and kept (columns so named are replaced).

    kept marks the `take` rows with the largest gumbel_score = log_ratio + temperature * Gumbel noise,
    the noise seeded by the key. Without `take` it is the number of documents whose log ratio
    reaches the cut that best parts the held-out half of the labelled sample; without labels of both
    kinds all documents with text are taken. A text without n-grams (null, empty, white space of under three bytes) has a null log_ratio and isn't kept. Rows that repeat key and text share their score, and
    all that tie with the last one taken are taken. An empty table gives no rows.
    """
    names = [c for c in docs.columns if c not in ("log_ratio", "gumbel_score", "kept")]
    docs = docs.select(*names)
    sample = cut_lineage(labelled_sample(labels, most_labelled, key))
    model = fit_ratio(docs, sample, key, text)
    own = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    narrow = with_log_ratio(own, model).select("key", "log_ratio").join(F.broadcast(sample), F.col("key") == F.col("label_key"), "left")
    narrow = cut_lineage(narrow.withColumn("gumbel_score", F.col("log_ratio") + F.lit(temperature) * gumbel(F.col("key"), seed)))
    if take is None:
        held_out = narrow.filter("not fit and log_ratio is not null").groupBy("key").agg(F.min("log_ratio"), F.first("good"))
        cut = best_cut([(score, good) for _, score, good in held_out.collect()])  # a row per label of the sample at most
        take = narrow.filter(F.col("log_ratio") >= cut).count()
    least = kth_largest(narrow, "gumbel_score", take)
    scored = with_log_ratio(docs, model, text).withColumn("gumbel_score", F.col("log_ratio") + F.lit(temperature) * gumbel(F.col(key), seed))
    return scored.withColumn("kept", F.coalesce(F.col("gumbel_score") >= F.lit(least), F.lit(False)))
