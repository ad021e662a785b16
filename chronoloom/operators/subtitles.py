"""Subtitle cues from timed texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Words and characters of a cue, characters of a line, and the fewest samples per character.
MOST_WORDS, MOST_CHARS, LINE, PACE = 16, 72, 36, 700
_UNIT = re.compile(r"\d[\d.,]*\Z")


def wrap(words: list[str], width: int = LINE) -> str:
    """One line, or two of the most even length that fit; more than fits goes to the second."""
    whole = " ".join(words)
    if len(whole) <= width or len(words) < 2:
        return whole
    cut = min(range(1, len(words)), key=lambda i: (max(len(" ".join(words[:i])), len(" ".join(words[i:]))), i))
    return " ".join(words[:cut]) + "\n" + " ".join(words[cut:])


def cut_cues(words: list[str]) -> list[tuple[int, int]]:
    """(first, end) of the words of each cue: closed at a sentence's end or when full; a number stays with the word after it."""
    out, first, size = [], 0, 0
    for i, word in enumerate(words):
        full = i - first >= MOST_WORDS or size + len(word) > MOST_CHARS
        if i > first and full:
            end = i - 1 if i - first > 1 and _UNIT.fullmatch(words[i - 1]) else i
            out.append((first, end))
            first, size = end, sum(len(w) + 1 for w in words[end:i])
        size += len(word) + 1
        if word[-1] in ".!?。！？":
            out.append((first, i + 1))
            first, size = i + 1, 0
    if first < len(words):
        out.append((first, len(words)))
    return out


def subtitle_cues(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cue, start, end, text) of timed texts (start, end in samples); words share their text's time evenly.

    A cue lasts at least PACE samples a character, but never into the next one. Texts without words have no cues.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.itertuples(index=False):
                words = (row.text or "").split()
                cues = cut_cues(words)
                at = lambda i, row=row, n=len(words): row.start + (row.end - row.start) * i // n
                for no, (a, b) in enumerate(cues):
                    text = wrap(words[a:b])
                    limit = at(cues[no + 1][0]) if no + 1 < len(cues) else row.end
                    rows.append((*(getattr(row, k) for k in keys), no + 1, at(a), min(limit, max(at(b), at(a) + PACE * len(text))), text))
            yield pd.DataFrame(rows, columns=[*keys, "cue", "start", "end", "text"])

    return df.select(*keys, "text", "start", "end").mapInPandas(run, f"{kinds}, cue long, start long, end long, text string")
