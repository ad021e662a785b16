"""Language identification: the family first, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage, unit_hash, unused
from chronoloom.llm.text_arrays import chunks, utf8

#: Hash buckets of the byte 1- to 4-grams, and about how many documents of each language are learned from.
BUCKETS, PER_LANGUAGE = 4096, 800
#: Penalty of a margin violation, and passes of the solver over the sample.
PENALTY, PASSES = 1.0, 20
#: Families of close languages. Fixed values; any other language is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "cs", "sk", "pl"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indo-aryan": ["hi", "ur", "bn", "mr", "ne", "pa", "gu"],
}
UNDETERMINED = "und"


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language.split("-")[0].lower() in members), language)


def _grams(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams that begin at each byte, with their rows, for n from 1 to 4."""
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    key = np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        size = len(data) - n + 1
        if size <= 0:
            return
        key = (key[:size] << np.uint32(8)) | data[n - 1 :]
        whole = row[:size] == row[n - 1 :]
        yield ((key * np.uint32(2654435761) + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) >> np.uint32(20))[whole], row[:size][whole]


@dataclass(frozen=True)
class Machine:
    """One pair of classes: a weight per bucket and an offset; a positive margin speaks for the first."""

    pair: tuple[str, str]
    weights: np.ndarray
    offset: float


def fit_machine(pair: tuple[str, str], x: np.ndarray, y: np.ndarray) -> Machine:
    """A linear SVM with squared hinge loss by dual coordinate descent, on columns scaled to unit spread."""
    scale = 1 / (x.std(axis=0) + 1e-4)
    mean = x.mean(axis=0)
    z = np.hstack([(x - mean) * scale / np.sqrt(x.shape[1]), np.ones((len(x), 1))]).astype(np.float32)
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    slack = share / PENALTY
    norm = (z * z).sum(axis=1) + slack
    alpha, w, order = np.zeros(len(x)), np.zeros(z.shape[1], np.float32), np.random.default_rng(7)
    for _ in range(PASSES):
        for i in order.permutation(len(x)):
            step = max(-alpha[i], (1 - y[i] * float(z[i] @ w) - slack[i] * alpha[i]) / norm[i])
            if step:
                alpha[i] += step
                w += np.float32(step * y[i]) * z[i]
    weights = w[:-1] * scale / np.sqrt(x.shape[1])
    return Machine(pair, weights.astype(np.float32), float(w[-1] - mean @ weights))


@dataclass(frozen=True)
class LanguageModel:
    """Machines between families and, within each, between languages."""

    languages: tuple[str, ...]
    machines: tuple[Machine, ...]

    def margins(self, texts: pa.Array) -> np.ndarray:
        """[row, machine]"""
        data, starts = utf8(texts)
        table = np.stack([m.weights for m in self.machines], 1) if self.machines else np.zeros((BUCKETS, 0), np.float32)
        out = np.zeros((len(texts), len(self.machines)))
        for a, b in chunks(starts):
            for grams, row in _grams(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]):
                n = np.bincount(row, minlength=b - a)
                for j in range(table.shape[1]):
                    out[a:b, j] += np.bincount(row, table[grams, j], b - a) / np.maximum(n, 1)
        return out + np.array([m.offset for m in self.machines])

    @staticmethod
    def _vote(names: list[str], machines: dict[tuple[str, str], np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
        """The class with the most won pairs, then the largest sum of margins; and how sure its closest pair is."""
        wins, total = np.zeros((rows, len(names))), np.zeros((rows, len(names)))
        closest = np.full((rows, len(names)), np.inf)
        for i, j in combinations(range(len(names)), 2):
            margin = machines[names[i], names[j]]
            for k, m in ((i, margin), (j, -margin)):
                wins[:, k] += m > 0
                total[:, k] += m
                closest[:, k] = np.minimum(closest[:, k], m)
        best = np.lexsort((total.T, wins.T), axis=0)[-1] if rows else np.zeros(0, np.int64)
        sure = np.clip(closest[np.arange(rows), best], -30, 30)
        return best, 1 / (1 + np.exp(-2 * sure))

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.languages:
            return np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
        margins = self.margins(texts)
        by_pair = {m.pair: margins[:, j] for j, m in enumerate(self.machines)}
        families = sorted({family(x) for x in self.languages})
        which, score = self._vote([f"family:{f}" for f in families], by_pair, len(texts))
        out = np.empty(len(texts), object)
        for i, f in enumerate(families):
            members = sorted(x for x in self.languages if family(x) == f)
            rows = np.flatnonzero(which == i)
            best, sure = self._vote(members, {k: v[rows] for k, v in by_pair.items()}, len(rows))
            out[rows] = np.array(members, object)[best]
            score[rows] *= sure
        return out, score


def held_out(key: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its key as text is divisible by 5; a null key counts as 0."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit_languages(docs: DataFrame, *, per_language: int = PER_LANGUAGE, key: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Learn from about per_language documents of each language, taken by hash from those not held out.

    Each machine is trained in a task of its own, which gets the sampled feature vectors of its two classes; a family gives as
    many documents as a language does. Only counts per language and the machines, of 16 KB each, come to the driver: one for each two families
    and for each two languages of a family. All languages are learned. Rows without a language or a letter are left out; none at all gives an empty model. Rows that repeat are learned each.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key)).filter(F.col(text).rlike(r"\p{L}"))
    counts = known.groupBy(F.col(lang).alias("lang")).count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return LanguageModel((), ())
    families = sorted({family(x) for x in languages})
    classes = [(r["lang"], per_language / r["count"], 1 / sum(family(x) == family(r["lang"]) for x in languages)) for r in counts]
    pairs = [(f"family:{one}", f"family:{other}", x, 1.0 if family(x) == one else -1.0) for one, other in combinations(families, 2) for x in languages if family(x) in (one, other)]
    pairs += [(one, other, x, 1.0 if x == one else -1.0) for one, other in combinations(languages, 2) if family(one) == family(other) for x in (one, other)]
    if not pairs:
        return LanguageModel(tuple(languages), ())

    @F.arrow_udf("binary")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, starts = utf8(texts)
            out = np.zeros((len(texts), BUCKETS), np.float32)
            for a, b in chunks(starts):
                for grams, row in _grams(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a]):
                    n = np.bincount(row, minlength=b - a)
                    seen = np.bincount(row * BUCKETS + grams, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS)
                    out[a:b] += (seen / np.maximum(n, 1)[:, None]).astype(np.float32)
            yield pa.array([x.tobytes() for x in out], pa.binary())

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "lang", "x"], na_position="first")
        x = np.stack([np.frombuffer(v, np.float32) for v in rows["x"]])
        machine = fit_machine((rows["one"].iloc[0], rows["other"].iloc[0]), x, rows["y"].to_numpy(float))
        return pd.DataFrame({"one": [machine.pair[0]], "other": [machine.pair[1]], "weights": [machine.weights.tobytes()], "bias": [machine.offset]})

    shares = F.broadcast(spark.createDataFrame(classes, "lang string, share double, kin double"))
    sides = F.broadcast(spark.createDataFrame(pairs, "one string, other string, lang string, y double"))
    named = known.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).join(shares, "lang")
    sample = named.filter(unit_hash(F.col("key"), "language") < F.col("share")).select("key", "lang", "kin", features(F.lower("text")).alias("x"))
    dealt = cut_lineage(sample).join(sides, "lang").filter(~F.col("one").startswith("family:") | (unit_hash(F.col("key"), "family") < F.col("kin")))
    trained = dealt.groupBy("one", "other").applyInPandas(train, "one string, other string, weights binary, bias double").collect()
    machines = {(r["one"], r["other"]): Machine((r["one"], r["other"]), np.frombuffer(r["weights"], np.float32), r["bias"]) for r in trained}
    # a class of which no document was drawn leaves a machine that never decides
    none = np.zeros(BUCKETS, np.float32)
    names = sorted({(one, other) for one, other, *_ in pairs})
    return LanguageModel(tuple(languages), tuple(machines.get(p, Machine(p, none, 0.0)) for p in names))


def with_language(docs: DataFrame, model: LanguageModel, *, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns so named are replaced; others stay, whatever their names), from the text alone.

    A null text or one without a letter is `und` with score 0, and so is every text for an empty model. The
    score multiplies how sure the closest decisions of both levels are.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found, score = shared.value.predict(texts)
            yield pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    letter, told = unused(docs, "letter", "told")
    out = docs.select(*kept, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias(letter), predict(F.lower(F.col(text))).alias(told))
    return out.select(*kept, F.when(F.col(letter), F.col(told)["lang_pred"]).otherwise(UNDETERMINED).alias("lang_pred"), F.when(F.col(letter), F.col(told)["score"]).otherwise(0.0).alias("score"))
