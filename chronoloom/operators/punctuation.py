"""Punctuation by language: what a text has, a proposal, pauses in speech and a tagger's labels, in the order that a language trusts them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.operators.marks import MARK, acoustic_mark, head_and_units, put as put_marks
from chronoloom.operators.projection import letters

#: Marks of a Chinese text that has its own, marks that a Japanese text takes over, and pairs that are balanced there. Fixed values.
CHINESE, JAPANESE, PAIRS = "，。！？、；：", "、。？！", {"「": "」", "（": "）", "(": ")"}
#: Largest share of changed letters of a Japanese proposal, least confidence of a label, most marks a letter. Fixed values.
DIVERGED, SURE, DENSE = 0.25, 0.7, 0.35


def _balanced(text: str) -> str:
    """The text without closing brackets that close nothing, and with those that are missing at its end."""
    missing, out = [], []
    for c in text:
        if c in PAIRS:
            missing.append(PAIRS[c])
        elif missing and c == missing[-1]:
            missing.pop()
        elif c in PAIRS.values():
            continue
        out.append(c)
    return "".join([*out, *reversed(missing)])


def _moved(proposal: str, n: int) -> dict[int, str]:
    """A proposal's marks at the same share of the way through n letters; of several for one place the last."""
    head, units = head_and_units(proposal)
    runs = [head, *(u[1:] for u in units)]
    return {min(n, round(i * n / len(units))): found[-1] for i, run in enumerate(runs) if units and (found := [c for c in run if c in JAPANESE])}


def _japanese(text: str, proposal: str | None, heard: dict[int, str], tagged: dict[int, str]) -> tuple[str, str]:
    n = len(head_and_units(text)[1])
    moved = _moved(proposal, n) if proposal else {}
    due = {**heard, **moved} or tagged
    put = _balanced(put_marks(text, due))
    if len(MARK.findall(put)) > DENSE * max(1, n):
        return _balanced(put_marks(text, heard)), "acoustic fallback" if heard else "fallback"
    parts = {"native": any(c in JAPANESE for c in text), "projection": moved, "acoustic": heard, "tagger": not heard and not moved and tagged}
    return put, "+".join(k for k, v in parts.items() if v) or "fallback"


def _entries(values: object) -> dict[int, str]:
    return {} if values is None else {int(v["at"]): v["mark"] for v in values}


def _heard(spoken: Column, n: Column, comma: str, stop: str, question: str) -> Column:
    """(at, mark) of boundaries in speech, array of (after, pause, changed, rising), within n letters; a boundary that calls for no mark gives none."""
    entry = lambda b: F.struct(b["after"].cast("int").alias("at"), acoustic_mark(b["pause"], b["changed"], b["rising"], comma=comma, stop=stop, question=question).alias("mark"))
    return F.filter(F.transform(spoken, entry), lambda e: e["mark"].isNotNull() & (e["at"] <= n))


def _blank(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s", "") == ""


def chinese(text: Column, proposal: Column, spoken: Column) -> Column:
    """(text, source): a text with marks of its own keeps them, else a proposal with the same letters is taken, else the text stays; then pauses put marks where none are.

    A blank text stays as it is, a null one is null.
    """
    own, fits = F.regexp_like(text, F.lit(f"[{CHINESE}]")), F.coalesce(letters(proposal) == letters(text), F.lit(False))
    source = F.when(own, "native").when(fits, "proposal").when(proposal.isNotNull(), "fallback, proposal rejected").otherwise("fallback")
    heard = _heard(spoken, F.length(letters(text)), "，", "。", "？")

    @F.pandas_udf("string")
    def put(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, due in batches:
            yield pd.Series([None if t is None else put_marks(t, _entries(d)) for t, d in zip(texts, due, strict=True)], dtype=object)

    told = F.struct(put(F.when(own | ~fits, text).otherwise(proposal), heard).alias("text"), F.concat(source, F.when(F.size(heard) > 0, "+acoustic").otherwise("")).alias("source"))
    return F.when(_blank(text), F.struct(text.alias("text"), F.lit("empty").alias("source"))).when(text.isNotNull(), told)


def japanese(text: Column, proposal: Column, spoken: Column, labels: Column) -> Column:
    """(text, source): marks of a proposal whose letters differ little, at the same share of the way; pauses where it has none; without either a tagger's sure labels (array of (after, mark, confidence)).

    Brackets are balanced. If marks get too dense, only those of pauses are put. Marks that the text has stay. A blank text stays as it is, a null one is null.
    """
    n, m = F.length(letters(text)), F.length(letters(proposal))
    near = F.levenshtein(letters(proposal), letters(text)) <= DIVERGED * F.greatest(n, m, F.lit(1))
    sure = F.transform(F.filter(labels, lambda x: (x["confidence"] >= SURE) & (x["after"] <= n)), lambda x: F.struct(x["after"].cast("int").alias("at"), x["mark"].alias("mark")))

    @F.pandas_udf("text string, source string")
    def put(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            rows = [(None, None) if t is None else _japanese(t, p, _entries(h), _entries(x)) for t, p, h, x in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=["text", "source"])

    told = put(text, F.when(near, proposal), _heard(spoken, n, "、", "。", "？"), sure)
    return F.when(_blank(text), F.struct(text.alias("text"), F.lit("empty").alias("source"))).when(text.isNotNull(), told)
