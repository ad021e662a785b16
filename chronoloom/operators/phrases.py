"""Timed phrases of a recording: word times put in order, words returned to their phrase, phrases split at sentences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, pairwise

import pandas as pd
from pyspark.sql import DataFrame

from chronoloom.functions.normal import FORMATTING
from chronoloom.operators.readability import sentence_cuts

#: Characters of the next phrase's words that must go on where the returned ones end. Fixed value.
RESYNC = 8
WORDS = "array<struct<text:string,start:bigint,end:bigint>>"
_FORMAT = "".join(re.escape(c) for c in FORMATTING if c not in ".,:'’")
_DROPPED = re.compile(rf"\.(?!\d)|(?<!\d)[,:]|[,:](?!\d)|(?<![^\W_])['’]|['’](?![^\W_])|[{_FORMAT}]|\s")
Word = tuple[str, int, int]


def said(text: str) -> list[int]:
    """Places of the characters that are said: all but white space and marks, decimal points, times and apostrophes kept."""
    gone = {m.start() for m in _DROPPED.finditer(text)}
    return [i for i in range(len(text)) if i not in gone]


def content(text: str) -> str:
    return _DROPPED.sub("", text)


def ordered_times(words: list[Word], within: tuple[int, int] | None = None) -> list[Word]:
    """Words whose times don't go back. A word that begins inside the one before cuts it; one that begins no later than it follows it.

    Words left without duration share the time of the word before them evenly, at the beginning that of the word after; if no word lasts they stay.
    """
    texts, starts, ends = [w[0] for w in words], [], []
    for _, start, end in words:
        if within:
            start, end = (min(max(x, within[0]), within[1]) for x in (start, end))
        if starts and starts[-1] < start < ends[-1]:
            ends[-1] = start
        elif starts and start < ends[-1]:
            start = ends[-1]
        starts.append(start)
        ends.append(max(start, end))
    at = 0
    for lasts, run in groupby([a < b for a, b in zip(starts, ends, strict=True)]):
        n = len(list(run))
        if not lasts and (at or at + n < len(words)):
            first, last = (at - 1, at + n) if at else (0, n + 1)
            a, b, count = starts[first], ends[last - 1], last - first
            for k in range(count):
                starts[first + k], ends[first + k] = a + (b - a) * k // count, a + (b - a) * (k + 1) // count
        at += n
    return list(zip(texts, starts, ends, strict=True))


def pass_on(text: str, words: list[Word], next_text: str, next_words: list[Word]) -> tuple[list[Word], list[Word]] | None:
    """Own words and the next phrase's, after words beyond the own text have gone there; None where the texts don't bear that out.

    A word that lies across the border is cut there.
    """
    own, keep = content(text), len(words)
    joined = lambda ws: content("".join(w[0] for w in ws))
    while keep and len(joined(words[:keep])) > len(own):
        keep -= 1
    stay, go = words[:keep], words[keep:]
    if not go:
        return None
    lack = len(own) - len(joined(stay))
    places = said(go[0][0])
    if 0 < lack < len(places):
        token, start, end = go[0]
        stay, go = [*stay, (token[: places[lack]], start, end)], [(token[places[lack] :], start, end), *go[1:]]
    head, rest = joined(go), content(next_text)
    fits = joined(stay) == own and rest.startswith(head) and rest.startswith(joined(next_words)[:RESYNC], len(head))
    return (stay, [*go, *next_words]) if fits else None


def split_words(text: str, words: list[Word], within: tuple[int, int] | None) -> list[tuple[str, int, int, list[Word]]] | None:
    """(text, start, end, words) of the sentences of a phrase, as far as words end where they do; None where words and text don't agree."""
    places, spans = said(text), []  # spans: (from, to, start, end) of each word in the text
    letters, at, after = "".join(text[i] for i in places), 0, 0
    last = None
    for token, start, end in ordered_times(words, within):
        bare = content(token)
        if not token.strip() or start >= end or (last is not None and start < last):
            return None
        last = end
        if bare:
            if not letters.startswith(bare, at):
                return None
            at += len(bare)
            spans.append((places[at - len(bare)], places[at - 1] + 1, start, end))
        else:  # a mark with a time of its own counts if the text has it before the next letter
            found = text.find(token.strip(), after, places[at] if at < len(places) else len(text))
            if found < 0:
                continue
            spans.append((found, found + len(token.strip()), start, end))
        after = spans[-1][1]
    if at < len(places) or not spans:
        return None
    cuts = sorted({b for _, b in sentence_cuts(text)})
    out, begin, first = [], 0, 0
    for no, span in enumerate(spans):
        following = spans[no + 1][0] if no + 1 < len(spans) else len(text)
        here = [c for c in cuts if span[1] <= c <= following]
        if not here:
            continue
        edges = [begin, *(s[0] for s in spans[first + 1 : no + 1]), here[-1]]
        own = [(text[a:b].strip(), s[2], s[3]) for (a, b), s in zip(pairwise(edges), spans[first : no + 1], strict=True)]
        out.append((text[begin : here[-1]].strip(), own[0][1], own[-1][2], own))
        begin, first = here[-1], no + 1
    return out if begin == len(text) else None


def _words(value: object) -> list[Word]:
    return [] if value is None else [(w["text"], int(w["start"]), int(w["end"])) for w in value]


def _records(words: list[Word]) -> list[dict]:
    return [{"text": t, "start": a, "end": b} for t, a, b in words]


def returned_words(phrases: DataFrame, key: str, order: str) -> DataFrame:
    """phrases (key, order, text, words) with words that hang on the phrase before put to the one whose text has them.

    A phrase passes its surplus on before the next one is looked at, so the phrases of a recording meet in one task, in order; a recording is some
    90 minutes at most. Null texts and words are empty.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(order)
        texts, words = [t or "" for t in rows["text"]], [_words(w) for w in rows["words"]]
        for i in range(len(texts) - 1):
            words[i], words[i + 1] = pass_on(texts[i], words[i], texts[i + 1], words[i + 1]) or (words[i], words[i + 1])
        return rows.assign(words=[_records(w) for w in words])

    return phrases.groupBy(key).applyInPandas(run, phrases.schema)


def sentence_phrases(phrases: DataFrame) -> DataFrame:
    """phrases (text, start, end, timed, words, ...) split at sentence ends that words bear out: other columns as they are, `part` counts from 0.

    A phrase whose words don't agree with its text stays whole, without words. A timed phrase's words lie within it. A null text is empty.
    """
    names = phrases.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                within = (int(row["start"]), int(row["end"])) if row["timed"] else None
                parts = split_words(row["text"] or "", _words(row["words"]), within)
                if parts is None:
                    out.append({**row, "words": [], "part": 0})
                else:
                    out += [{**row, "text": t, "start": a, "end": b, "timed": True, "words": _records(w), "part": no} for no, (t, a, b, w) in enumerate(parts)]
            yield pd.DataFrame(out, columns=[*names, "part"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in phrases.schema.fields)
    return phrases.mapInPandas(run, f"{schema}, part long")
