"""One reading's marks, surface and times put on another's letters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.functions import normal
from chronoloom.operators import neighbours
from chronoloom.operators.lineage import cut
from chronoloom.operators.marks import MARK as MARKS
from chronoloom.operators.marks import head_and_units, put
from chronoloom.operators.repetition import computed_once

#: What is neither mark nor blank, and what is.
LETTER, MARK = r"[^\p{P}\p{Z}\s]", r"[\p{P}\p{Z}\s]"
#: Letters on each side of a boundary that tell its place, and the fewest of both.
SIDE, LEAST = 4, 4


def letters(text: Column) -> Column:
    return F.regexp_replace(text, MARK, "")


def boundaries(text: Column) -> Column:
    """array of (at, mark): the marks of a text that stand after its first `at` letters, in order, without blanks."""
    units = F.regexp_extract_all(text, F.lit(f"{MARK}*{LETTER}"), F.lit(0))
    runs = F.transform(F.concat(units, F.array(F.regexp_extract(text, rf"{MARK}*\z", 0))), lambda u: F.regexp_replace(u, r"[^\p{P}]", ""))
    return F.filter(F.transform(runs, lambda m, i: F.struct(i.alias("at"), m.alias("mark"))), lambda b: b["mark"] != "")


def _folded(text: Column) -> Column:
    """Letters for comparison: their compatibility forms where these are as many, so that places stay."""
    wide = normal.normalised(text)
    return F.when(F.length(wide) == F.length(text), wide).otherwise(text)


def certain_marks(reading: str, source: str, target: str, owners: Sequence, candidate: object) -> Iterator[tuple[int, str]]:
    """(place in the target, mark) of a reading's marks whose place is certain, between letters that are the reading's own."""
    head, units = head_and_units(reading)
    for at, run in enumerate([head, *(u[1:] for u in units)]):
        mark = "".join(MARKS.findall(run))
        if not mark:
            continue
        place = at
        if source != target:
            left = source[max(0, at - SIDE) : at]
            anchor = left + source[at : at + SIDE]
            if len(anchor) < LEAST or source.count(anchor) != 1 or target.count(anchor) != 1:
                continue
            found = target.find(anchor)
            if (not at and found) or (at == len(source) and found + len(anchor) != len(target)):
                continue
            place = found + len(left)
        beside = owners[max(0, place - 1) : place + 1]
        if len(beside) and all(o == candidate for o in beside):
            yield place, mark


def native_marks(texts: DataFrame, readings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, restored, sources): the marks of readings put into the texts whose letters were taken from them.

    texts: (keys, text, owners), owners being the reading that gave each letter; readings: (keys, candidate, rank, reading). A reading that gave all letters
    and has the same ones is taken whole (the first by rank). Otherwise a mark passes if its place is certain: the letters of both are equal, or the
    up to four letters on both sides of it, four at least, occur once in the reading and once in the text (at an end only at that end); and if the
    letters beside it are its reading's own. Of marks for one place the first by rank and then place wins, and a mark that is there already stays. No letter changes.
    sources: array of (candidate, boundaries), by candidate. A text whose owners don't fit its letters, or a null one, stays as it is with no sources.
    """
    target = texts.select(*keys, "text", "owners", letters(F.col("text")).alias("plain__")).withColumn("target__", _folded(F.col("plain__")))
    source = readings.filter("reading is not null").select(*keys, "candidate", "rank", "reading", letters(F.col("reading")).alias("own__")).withColumn("source__", _folded(F.col("own__")))
    met = target.filter(F.size("owners") == F.length("target__")).join(source, keys)
    s, t, owners = F.col("source__"), F.col("target__"), F.col("owners")
    whole = (F.size(owners) > 0) & (F.col("plain__") == F.col("own__")) & F.forall(owners, lambda o: o == F.col("candidate"))

    @F.pandas_udf("array<struct<at:int,mark:string>>")
    def adopted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            yield pd.Series([[{"at": at, "mark": mark} for at, mark in certain_marks(*row)] for row in zip(*columns, strict=True)], dtype=object)

    told = met.select(*keys, "candidate", "rank", F.when(whole, F.col("reading")).alias("reading"), F.coalesce(whole, F.lit(False)).alias("whole"), F.size(boundaries(F.col("reading"))).alias("all"), adopted("reading", s, t, "owners", "candidate").alias("adopted"))
    told = cut(told)  # read several times
    exact = told.filter("whole").groupBy(*keys).agg(F.min_by(F.struct("reading", "candidate", "all"), F.struct("rank", "candidate")).alias("exact"))
    each = told.select(*keys, "candidate", "rank", F.posexplode("adopted").alias("no", "b")).select(*keys, "candidate", "rank", "no", "b.at", "b.mark")
    first = each.groupBy(*keys, "at").agg(F.min_by("mark", F.struct("rank", "candidate", "no")).alias("mark"))
    marks = first.groupBy(*keys).agg(F.collect_list(F.struct("at", "mark")).alias("marks"))
    counts = each.groupBy(*keys, "candidate").agg(F.count("*").alias("boundaries")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("candidate", "boundaries"))).alias("sources"))
    out = texts.select(*keys, "text").join(exact, keys, "left").join(marks, keys, "left").join(counts, keys, "left")

    @F.pandas_udf("string")
    def restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, found in batches:
            yield pd.Series([t if t is None or m is None else put(t, {int(x["at"]): x["mark"] for x in m}) for t, m in zip(texts, found, strict=True)], dtype=object)

    one = F.array(F.struct(F.col("exact.candidate").alias("candidate"), F.col("exact.all").cast("long").alias("boundaries")))
    none = F.array().cast("array<struct<candidate:" + readings.schema["candidate"].dataType.simpleString() + ",boundaries:bigint>>")
    sources = F.when(F.col("exact").isNotNull(), one).otherwise(F.coalesce("sources", none))
    return out.select(*keys, F.coalesce("exact.reading", restored("text", "marks")).alias("restored"), sources.alias("sources"))


def column_spans(columns: DataFrame, keys: list[str], order: str, desired: str, *, start: str = "start", end: str = "end", width: int = 1000) -> DataFrame:
    """columns with `column_start` and `column_end`: whole-number spans that fill [start, end) of their key without gaps, each at least 1 long.

    Columns meet in the middle between the places they desire, as far as the others leave room; places are put in order by moving later ones back, and
    null ones are spread evenly. A range shorter than its columns gives null. Order values are whole numbers, distinct in a key; places and
    bounds are carried across slices of `width` of them as running maxima, so no task gets a whole key.
    """
    part = F.floor(F.col(order) / width)
    marked = neighbours.with_running_sum(columns.withColumn("one__", F.lit(1).cast("long")), keys, [order], "one__", part, "no__")
    total = columns.groupBy(*keys).agg(F.count("*").alias("all__")).select(*(F.col(k).alias(f"{k}__of") for k in keys), "all__")
    # each step reads what is before it twice, so lineage is cut between them
    known = cut(marked.join(total, neighbours.same(keys, marked, total)).select(*marked.columns, "all__", (F.col("no__") - 1).alias("i__")))
    length = F.col(end) - F.col(start)
    even = F.col(start) + F.floor(length * F.col("no__") / (F.col("all__") + 1))
    inside = F.greatest(F.col(start) + F.col("i__"), F.least(F.coalesce(F.col(desired), even), F.col(end) - (F.col("all__") - F.col("i__"))))
    # c(i) = max(c(i - 1) + 1, inside(i)) is i + the running maximum of inside(i) - i
    placed = cut(neighbours.with_running_max(known.withColumn("ahead__", inside - F.col("i__")), keys, [order], "ahead__", part, "most__").withColumn("centre__", F.col("most__") + F.col("i__")))
    seen = neighbours.with_neighbours(placed, keys, [order], ["centre__"], part)
    middle = F.floor((F.col("before.centre__") + F.col("centre__")) / 2)
    bound = F.when(F.col("i__") == 0, F.col(start)).otherwise(F.least(middle, F.col(end) - (F.col("all__") - F.col("i__"))))
    bounded = cut(seen.withColumn("bound__", bound - F.col("i__")).drop("before", "after"))
    begun = cut(neighbours.with_running_max(bounded, keys, [order], "bound__", part, "reach__").withColumn("from__", F.col("reach__") + F.col("i__")))
    last = neighbours.with_neighbours(begun, keys, [order], ["from__"], part)
    fits = length >= F.col("all__")
    return last.select(*columns.columns, F.when(fits, F.col("from__")).cast("long").alias("column_start"), F.when(fits, F.coalesce("after.from__", F.col(end))).cast("long").alias("column_end"))


def surfaced(tokens: Column, text: Column) -> Column:
    """Timed tokens (array of structs with text, start, end) with the text's marks and blanks on them, if their letters are the text's; else as they are.

    A token ends where the next one's first letter begins; a token without letters goes, its surface staying on the token before it.
    """
    flat = F.array_join(F.transform(tokens, lambda t: t["text"]), "")
    head = F.regexp_extract(text, rf"\A{MARK}*", 0)

    def put(units: Column) -> Column:
        kind = "struct<text:string,start:bigint,end:bigint>"
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(state: Column, t: Column) -> Column:
            size = F.length(letters(t["text"]))
            own = F.array_join(F.slice(units, state["at"] + 1, size), "")
            piece = F.struct(F.when(F.size(state["out"]) == 0, F.concat(head, own)).otherwise(own).alias("text"), t["start"].cast("long").alias("start"), t["end"].cast("long").alias("end"))
            return F.struct((state["at"] + size).alias("at"), F.concat(state["out"], F.array(piece)).alias("out"))

        return F.filter(F.aggregate(tokens, begin, step, lambda x: x["out"]), lambda t: t["text"] != "")

    same = letters(flat) == letters(text)
    return F.when((F.size(tokens) > 0) & same, computed_once(F.regexp_extract_all(text, F.lit(f"{LETTER}{MARK}*"), F.lit(0)), put)).otherwise(tokens)


def subdivided(tokens: Column, language: Column, *, most: int = 18) -> Column:
    """Timed tokens cut into words (English) or, where they have over `most` letters, characters (other languages), which share their time evenly.

    A token shorter than its pieces stays whole.
    """

    def pieces_of(token: Column) -> Column:
        words = F.regexp_extract_all(token["text"], F.lit(r"\S+\s*"), F.lit(0))
        characters = F.filter(F.split(token["text"], ""), lambda c: c != "")
        pieces = F.when(language == "en", words).otherwise(characters)
        many = F.when(language == "en", F.size(pieces) > 1).otherwise(F.length(letters(token["text"])) > most)
        length, n = token["end"] - token["start"], F.size(pieces)
        at = lambda i: (token["start"] + F.floor(length * i / n)).cast("long")
        parts = F.transform(pieces, lambda p, i: F.struct(p.alias("text"), at(i).alias("start"), at(i + 1).alias("end")))
        return F.when(many & (length >= n), parts).otherwise(F.array(F.struct(token["text"].alias("text"), token["start"].alias("start"), token["end"].alias("end"))))

    return F.flatten(F.transform(tokens, pieces_of))
