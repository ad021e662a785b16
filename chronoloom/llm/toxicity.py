"""Toxicity by two Kneser-Ney models of spelling, one of toxic and one of ordinary text, over shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage, if_small, unit_hash, unused
from chronoloom.llm.importance import best_cut
from chronoloom.llm.language_id import held_out
from chronoloom.llm.text_arrays import chunks, mix

#: Letters of context before the predicted one, and the discount of each count.
CONTEXT, DISCOUNT = 5, 0.75
#: What stands before a word's first letter and after its last.
BEFORE, AFTER = "\x01", "\x02"
#: Slots of the table that is broadcast (27 MB), how many of them one task fills, and most events beside the slots (12 MB).
SLOTS, PART, BESIDE = 1 << 21, 1 << 17, 1 << 20
#: Steps of one in a log ratio and in a word's evidence. Sums of whole steps are the same in any order.
RATIO_STEPS, WORD_STEPS = 1 << 23, 1 << 32
#: Most labelled documents that the cut is set on, and the share of the labelled ones from which they come.
CALIBRATION, SHARE = 20_000, 0.25
#: Words that a text's sum is divided by besides its own, so that a short text needs more than one odd word.
NEUTRAL = 8.0
#: The share of a toxic text's words that are drawn from the toxic model, the others being ordinary.
MIXED = 0.01
#: Multipliers of the letters of context, nearest first, and of the predicted letter. An event's number is their sum.
FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(CONTEXT)], np.uint64)
LETTER = np.uint64(0xD6E8FEB86659FD93)


def letters_only(text: str) -> Column:
    """The text's words, runs of letters in lower case, each followed by a space; null is empty."""
    return F.concat(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "), F.lit(" "))


def event_counts(marked: DataFrame) -> DataFrame:
    """(context, letter, toxic, plain) from marked (words, is_toxic): how often each letter, or the word's end, follows its CONTEXT letters.

    Words are counted first, so that each distinct one is taken apart once.
    """
    words = marked.select(F.explode(F.split("words", " ")).alias("word"), "is_toxic").filter("word != ''")
    counted = words.groupBy("word").agg(F.count(F.when(F.col("is_toxic"), 1)).alias("toxic"), F.count(F.when(~F.col("is_toxic"), 1)).alias("plain"))
    padded = counted.select(F.concat(F.lit(BEFORE * CONTEXT), "word", F.lit(AFTER)).alias("word"), "toxic", "plain")
    each = padded.select("*", F.explode(F.sequence(F.lit(1), F.length("word") - CONTEXT)).alias("at"))
    event = each.select(F.substring(F.col("word"), F.col("at"), F.lit(CONTEXT)).alias("context"), F.substring(F.col("word"), F.col("at") + CONTEXT, F.lit(1)).alias("letter"), "toxic", "plain")
    return event.groupBy("context", "letter").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def shared_backoff(events: DataFrame, letters: int) -> DataFrame:
    """(context, letter, p) with one letter of context less than events: the interpolated Kneser-Ney model of both classes together.

    A count is the number of different letters before the context, on each level down to no context; below that all of `letters` are alike.
    """
    levels = [events.select("context", "letter")]
    for _ in range(CONTEXT):
        levels.append(cut_lineage(levels[-1].groupBy(F.substring("context", 2, CONTEXT).alias("context"), "letter").agg(F.count("*").alias("n"))))
    lower = None
    for counts in reversed(levels[1:]):
        totals = counts.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        level = counts.join(totals, "context")
        if lower is None:
            level = level.withColumn("below", F.lit(1.0 / max(1, letters)))
        else:
            shorter = lower.select(F.col("context").alias("shorter"), "letter", F.col("p").alias("below"))
            level = level.withColumn("shorter", F.substring("context", 2, CONTEXT)).join(shorter, ["shorter", "letter"])
        p = (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * F.col("below")) / F.col("total")
        lower = level.select("context", "letter", p.alias("p"))
    return lower


def log_ratios(events: DataFrame) -> DataFrame:
    """(context, letter, weight, ratio): log p_toxic - log p_plain of each event seen; letter '' holds for any unseen one after the context.

    A class discounts its own counts and fills up with the shared model, so that what a class has not met says nothing by itself.
    weight is how often the event was met.
    """
    letters = events.select("letter").distinct().count()
    of = events.groupBy("context").agg(*(x for c in ("toxic", "plain") for x in (F.sum(c).alias(f"{c}_all"), F.count(F.when(F.col(c) > 0, 1)).alias(f"{c}_kinds"))), F.sum(F.col("toxic") + F.col("plain")).alias("weight"))

    def left(c: str) -> Column:
        """The share that a class leaves to the shared model."""
        return F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0)

    def chance(c: str) -> Column:
        own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0)
        return own + left(c) * F.col("p")

    shared = shared_backoff(events, letters).select(F.col("context").alias("shorter"), "letter", "p")
    seen = events.withColumn("shorter", F.substring("context", 2, CONTEXT)).join(shared, ["shorter", "letter"]).join(of.drop("weight"), "context")
    told = seen.select("context", "letter", (F.col("toxic") + F.col("plain")).alias("weight"), (F.log(chance("toxic")) - F.log(chance("plain"))).alias("ratio"))
    return told.unionByName(of.select("context", F.lit("").alias("letter"), "weight", (F.log(left("toxic")) - F.log(left("plain"))).alias("ratio")))


def _slot(tags: np.ndarray, slots: int) -> np.ndarray:
    return (tags >> np.uint64(64 - (slots.bit_length() - 1))).astype(np.int64)


@dataclass(frozen=True)
class LogRatios:
    """Log ratios in steps: by slot, each with its event's hash, and beside the slots those of more events, by ascending hash.

    A slot's flags: 1 if events of it are beside the slots, 2 if some are in neither place. Only of the latter a look-up may stay open.
    """

    tags: np.ndarray
    ratios: np.ndarray
    flags: np.ndarray
    beside: np.ndarray
    beside_ratios: np.ndarray
    mixed: float = MIXED

    @property
    def whole(self) -> bool:
        """Whether all events are in the table."""
        return not (self.flags & 2).any()

    def look_up(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ratio of each event (0 if not in the table), whether it is in the table, and whether it may be one that was left out."""
        tag = mix(numbers)
        slot = _slot(tag, len(self.tags))
        known = self.tags[slot] == tag
        ratio = np.where(known, self.ratios[slot], 0).astype(np.int64)
        other = np.flatnonzero(~known)
        flags = self.flags[slot[other]]
        at = other[(flags & 1) > 0]
        place = np.searchsorted(self.beside, tag[at])
        found = self.beside[np.minimum(place, len(self.beside) - 1)] == tag[at] if len(at) else np.zeros(0, bool)
        ratio[at[found]], known[at[found]] = self.beside_ratios[place[found]], True
        left = np.zeros(len(tag), bool)
        left[other] = (flags & 2) > 0
        return ratio, known, left & ~known

    def _events(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For words that are each followed by a space: the place of each event's letter, how many letters of its word lie before, its ratio or that of its context, and whether that is open."""
        space = letters == 32
        at = np.arange(len(letters))
        behind = np.concatenate(([-1], np.maximum.accumulate(np.where(space, at, -1))))[:-1] if len(letters) else at
        into = at - behind - 1  # letters of the word that lie before each position
        event = ~(space & (into == 0))
        context = np.zeros(len(letters), np.uint64)
        for i, factor in enumerate(FACTORS):
            before = np.full(len(letters), ord(BEFORE), np.uint64)
            if i + 1 < len(letters):
                inside = into[i + 1 :] > i
                before[i + 1 :][inside] = letters[: -i - 1][inside]
            context += before * factor
        ratio, known, left = self.look_up((context + np.where(space, ord(AFTER), letters).astype(np.uint64) * LETTER)[event])
        ratio[~known], _, unsure = self.look_up(context[event][~known])
        left[~known] |= unsure
        return at[event], into[event], ratio, left

    def evidence(self, sums: np.ndarray) -> np.ndarray:
        """A word's sum becomes the evidence of a text that is toxic in part."""
        return np.rint(np.log1p(self.mixed * np.expm1(np.minimum(sums / RATIO_STEPS, 50))) * WORD_STEPS).astype(np.int64)

    def sums(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[dict[str, int]]]:
        """Of each text of letters_only: the evidence of its words but the open ones, the number of all its words, and the open ones with their numbers."""
        sums, count, left = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [{} for _ in range(len(words))]
        points, starts = _points(words)
        for a, b in chunks(starts):
            letters = points[starts[a] : starts[b]]
            at, into, ratio, unsure = self._events(letters)
            if not len(at):
                continue
            ends = np.flatnonzero(letters[at] == 32)  # a word's events end with the space after it
            first = np.concatenate(([0], ends[:-1] + 1))
            opened = np.logical_or.reduceat(unsure, first)
            total = np.concatenate(([0], np.cumsum(np.where(opened, 0, self.evidence(np.add.reduceat(ratio, first))))))
            bounds = np.searchsorted(at[ends], starts[a : b + 1] - starts[a])
            sums[a:b], count[a:b] = np.diff(total[bounds]), np.diff(bounds)
            which = np.flatnonzero(opened)
            for row, end, size in zip(np.searchsorted(bounds, which, "right") - 1, at[ends[which]], into[ends[which]], strict=True):
                word = _text(letters[end - size : end])
                left[a + row][word] = left[a + row].get(word, 0) + 1
        return sums, count, left

    def means(self, words: pa.Array) -> np.ndarray:
        """The evidence of each text's words by their number, for texts of letters_only and a whole table; 0 without words."""
        sums, count, _ = self.sums(words)
        return sums / WORD_STEPS / (count + NEUTRAL)

    def open_events(self, words: pa.Array) -> Iterator[tuple[str, int, str, str, int]]:
        """(word, settled, context, letter, otherwise) of each open event of the words: the sum of the word's other ratios, and the context's ratio if that is in the table."""
        points, _ = _points(pa.array([f"{w} " for w in words.to_pylist()], pa.string()))
        at, into, ratio, unsure = self._events(points)
        ends = np.flatnonzero(points[at] == 32)
        first = np.concatenate(([0], ends[:-1] + 1))
        settled = np.add.reduceat(np.where(unsure, 0, ratio), first) if len(at) else ratio
        of = np.searchsorted(ends, np.flatnonzero(unsure))
        for k, i, otherwise in zip(of, into[unsure], ratio[unsure], strict=True):
            word = words[k].as_py()
            padded = BEFORE * CONTEXT + word + AFTER
            yield word, int(settled[k]), padded[i : i + CONTEXT], padded[i + CONTEXT], int(otherwise)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of texts, and where each text begins (one more for the end)."""
    each = texts.to_pylist()
    return np.frombuffer("".join(each).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate(([0], np.cumsum(np.array([len(x) for x in each], np.int64))))


def _text(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le", "surrogatepass")


@dataclass(frozen=True)
class ToxicityModel:
    """The table, broadcast once, the logistic map of a text's mean to a score, and the events that the table has no room for."""

    table: Broadcast
    cut: float
    slope: float
    rest: DataFrame | None = None


def event_numbers(contexts: list[str], letters: list[str]) -> np.ndarray:
    """The number of each event, as LogRatios has it."""
    points = np.frombuffer("".join(contexts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, CONTEXT).astype(np.uint64)
    last = np.array([ord(x) if x else 0 for x in letters], np.uint64)
    return (points[:, ::-1] * FACTORS).sum(1, dtype=np.uint64) + last * LETTER


def fill_table(ratios: DataFrame, slots: int = SLOTS, beside: int = BESIDE) -> LogRatios:
    """The table of bounded size. Of events that meet in a slot the one met most often has it (ties: the smallest hash), at most `beside` others, those met most often, stand beside.

    What has no room is in left_out; with_mean joins it. slots is a power of 2, 2 at least.
    """
    part = min(PART, slots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tag = mix(event_numbers(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(_slot(tag, slots)), pa.array(tag.view(np.int64)), batch.column(2), batch.column(3)], ["slot", "tag", "weight", "ratio"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        tags, values, flags = np.zeros(part, np.uint64), np.zeros(part, np.int32), np.zeros(part, np.uint8)
        at = rows["slot"].to_numpy() % part
        tags[at], values[at], flags[at] = rows["tag"].to_numpy().view(np.uint64), rows["ratio"], rows["flags"]
        return pd.DataFrame({"part": rows["slot"].iloc[:1] // part, "tags": [tags.tobytes()], "ratios": [values.tobytes()], "flags": [flags.tobytes()]})

    placed = ratios.select("context", "letter", "weight", in_steps("ratio")).mapInArrow(place, "slot long, tag long, weight long, ratio int")
    rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("weight"), "tag"))
    ranked = cut_lineage(placed.select("*", rank.alias("rank"), F.floor(F.log2("weight")).alias("level")))
    # the others come in from the highest power of 2 in their weight down, as long as there is room for all of a power
    least, room = 64, beside
    for level, n in sorted(ranked.filter("rank > 1").groupBy("level").count().collect(), reverse=True):
        room -= n
        if room < 0:
            break
        least = level
    flag = F.when(F.col("rank") == 1, 0).when(F.col("level") >= least, 1).otherwise(2)
    first = F.col("rank") == 1
    kept = ranked.groupBy("slot").agg(F.max(F.when(first, F.col("tag"))).alias("tag"), F.max(F.when(first, F.col("ratio"))).alias("ratio"), F.bit_or(flag).alias("flags"))
    tags, values, flags = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.zeros(slots, np.uint8)
    for p, *found in kept.groupBy(F.floor(F.col("slot") / part).alias("part")).applyInPandas(gather, "part long, tags binary, ratios binary, flags binary").collect():
        for to, data in zip((tags, values, flags), found, strict=True):
            to[p * part : (p + 1) * part] = np.frombuffer(data, to.dtype)
    others = ranked.filter(flag == 1).select("tag", "ratio").toArrow()
    more = np.asarray(others.column("tag"), np.int64).view(np.uint64)
    order = np.argsort(more)
    return LogRatios(tags, values, flags, more[order], np.asarray(others.column("ratio"), np.int32)[order])


def in_steps(ratio: str) -> Column:
    return F.rint(F.col(ratio) * RATIO_STEPS).cast("int").alias(ratio)


def left_out(ratios: DataFrame, table: Broadcast) -> DataFrame:
    """(context, letter, ratio in steps): the rows of ratios that the table has no room for."""

    def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = table.value.look_up(event_numbers(batch.column(0).to_pylist(), batch.column(1).to_pylist()))[1]
            yield batch.filter(pa.array(~known))

    return cut_lineage(ratios.select("context", "letter", in_steps("ratio")).mapInArrow(missing, "context string, letter string, ratio int"))


def open_words(words: DataFrame, table: Broadcast, rest: DataFrame) -> DataFrame:
    """(word, evidence) of words with events that the table leaves open: those are joined with rest, the others looked up."""

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if rows := list(table.value.open_events(batch.column(0))):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["word", "settled", "context", "letter", "otherwise"])

    @F.arrow_udf("long")
    def evidence(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for sums in batches:
            yield pa.array(table.value.evidence(np.asarray(sums, np.int64)))

    event = words.select("word").mapInArrow(take_apart, "word string, settled long, context string, letter string, otherwise long")
    own, unseen = rest.select("context", "letter", F.col("ratio").alias("own")), rest.filter("letter = ''").select("context", F.col("ratio").alias("unseen"))
    told = event.join(own, ["context", "letter"], "left").join(unseen, "context", "left")
    sums = told.groupBy("word").agg((F.max("settled") + F.sum(F.coalesce("own", "unseen", "otherwise"))).alias("sum"))
    return sums.select("word", evidence("sum").alias("evidence"))


def with_mean(docs: DataFrame, table: Broadcast, name: str, text: str, rest: DataFrame | None = None) -> DataFrame:
    """docs with the mean log ratio of each text. A table without room for all events needs the rest of them, from left_out.

    Then words with an event that may be in the rest are told by joins, each distinct one once, and their evidence is added by text. The
    results are those of a table with room for all.
    """
    bounded_batches(docs.sparkSession, 500)

    @F.arrow_udf("double")
    def mean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            yield pa.array(table.value.means(words))

    @F.arrow_udf("struct<sum:long,words:long,open:array<struct<word:string,n:long>>>")
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for words in batches:
            sums, count, left = table.value.sums(words)
            of_row = [[{"word": w, "n": n} for w, n in x.items()] for x in left]
            yield pa.StructArray.from_arrays([pa.array(sums), pa.array(count), pa.array(of_row, pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())])))], ["sum", "words", "open"])

    if table.value.whole:
        return docs.withColumn(name, mean(letters_only(text)))
    if rest is None:
        raise ValueError("the table has no room for all events: give the rest, from left_out")
    read = read.asNondeterministic()  # else Spark would run it for a filter and again for the columns
    digest, told, more = unused(docs, "digest", "told", "more")
    of_text = F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    lists = docs.select(of_text.alias(digest), read(letters_only(text))["open"].alias("open")).filter(F.size("open") > 0).groupBy(digest).agg(F.first("open").alias("open"))
    lists = cut_lineage(lists.select(digest, "open", F.monotonically_increasing_id().alias("id")))  # rows of words carry the id, a quarter of a digest
    each = lists.select("id", F.explode("open").alias("one")).select("id", "one.word", "one.n")
    evidence = cut_lineage(open_words(each.select("word").distinct(), table, rest))
    added = each.join(if_small(evidence), "word").groupBy("id").agg(F.sum(F.col("n") * F.col("evidence")).alias(more))
    added = lists.select("id", digest).join(added, "id").select(digest, more)
    out = docs.withColumns({digest: of_text, told: read(letters_only(text))}).join(if_small(cut_lineage(added)), digest, "left")
    total = F.col(f"{told}.sum") + F.coalesce(F.col(more), F.lit(0))
    return out.withColumn(name, total / F.lit(float(WORD_STEPS)) / (F.col(f"{told}.words") + NEUTRAL)).drop(digest, told, more)


def calibrate(means: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The cut with the best mean of both classes' recalls, and the slope there that makes the labels likeliest."""
    if toxic.all() or not toxic.any():
        return 0.0, 1.0
    cut = best_cut(list(zip(means.tolist(), toxic.tolist(), strict=True)))
    cut = cut if np.isfinite(cut) else 0.0
    x, sign = means - cut, np.where(toxic, 1.0, -1.0)
    slopes = np.geomspace(0.1, 1e4, 200)
    return cut, float(slopes[np.argmin([np.logaddexp(0, -s * x * sign).mean() for s in slopes])])


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", toxic: str = "toxic", most: int = CALIBRATION, slots: int = SLOTS, beside: int = BESIDE) -> ToxicityModel:
    """Models counted on the labelled documents that are not held out, and a cut set on a share of them left for that.

    Conflicting labels of a key: the largest. Only the table, of bounded size, and at most `most` scores come to the driver; events that it
    has no room for stay distributed. Without labels of both kinds every score is near 0.5 or below it.
    """
    bounded_batches(docs.sparkSession, 20_000)
    share = unit_hash(F.col("label_key"), "toxicity")
    known = labels.filter(F.col(key).isNotNull() & F.col(toxic).isNotNull() & ~held_out(key)).groupBy(F.col(key).alias("label_key")).agg((F.max(toxic) >= 1).alias("is_toxic"))
    known = cut_lineage(known.withColumn("share", share))
    texts = docs.select(F.col(key).alias("label_key"), F.col(text).alias("text"))
    own = texts.join(if_small(known), "label_key")
    events = cut_lineage(event_counts(own.filter(F.col("share") >= SHARE).select(letters_only("text").alias("words"), "is_toxic")))
    ratios = cut_lineage(log_ratios(events))
    table = docs.sparkSession.sparkContext.broadcast(fill_table(ratios, slots, beside))
    rest = None if table.value.whole else left_out(ratios, table)
    left = cut_lineage(known.filter(F.col("share") < SHARE).orderBy("share", "label_key").limit(most))
    scored = with_mean(texts.join(F.broadcast(left), "label_key").select("text", "is_toxic"), table, "mean", "text", rest).select("mean", "is_toxic").toArrow()
    cut, slope = calibrate(np.asarray(scored.column("mean"), float), np.asarray(scored.column("is_toxic"), bool))
    return ToxicityModel(table, cut, slope, rest)


def with_toxicity(docs: DataFrame, model: ToxicityModel, *, text: str = "text") -> DataFrame:
    """docs with score and predicted (columns so named are replaced; others stay, whatever their names), from the text alone.

    A null text, or one without letters, has the mean 0, like one that speaks for neither class. Whole texts of any length are scored; rows
    that repeat a text share its score; an empty table gives no rows.
    """
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    (mean,) = unused(docs, "mean")
    slope, cut = F.lit(model.slope), F.lit(model.cut)
    score = 1 / (1 + F.exp(-F.least(F.greatest(slope * (F.col(mean) - cut), F.lit(-500.0)), F.lit(500.0))))
    return with_mean(docs.select(*kept), model.table, mean, text, model.rest).select(*kept, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
