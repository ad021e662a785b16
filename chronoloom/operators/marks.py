"""Marks put into texts."""

from __future__ import annotations

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoloom.operators.repetition import computed_once

#: A letter with the marks and blanks that follow it, and a mark.
UNIT, MARK = regex.compile(r"[^\p{P}\p{Z}\t-\r][\p{P}\p{Z}\t-\r]*"), regex.compile(r"\p{P}")
#: Pauses in milliseconds from which a comma or a full stop is due. Fixed values.
COMMA_PAUSE, STOP_PAUSE = 250, 700


def acoustic_mark(pause: Column, speaker_changed: Column, rising: Column, *, comma: str, stop: str, question: str) -> Column:
    """The mark that a boundary in speech calls for, null for none."""
    return F.when(rising, question).when(speaker_changed | (pause >= STOP_PAUSE), stop).when(pause >= COMMA_PAUSE, comma)


def with_marks(text: Column, mark: Column) -> Column:
    """The text with marks put in after its n-th character that is neither mark nor blank; mark: array of the mark due after each, null for none.

    A mark that stands there already wins. No character changes.
    """
    units = F.regexp_extract_all(text, F.lit(r"[\p{P}\p{Z}\s]*[^\p{P}\p{Z}\s]"), F.lit(0))
    tail = F.regexp_extract(text, r"[\p{P}\p{Z}\s]*\z", 0)

    def put(parts: Column) -> Column:
        nexts = F.concat(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(tail))
        free = F.transform(nexts, lambda p: ~F.regexp_like(F.regexp_extract(p, r"\A[\p{P}\p{Z}\s]*", 0), F.lit(r"\p{P}")))
        due = F.zip_with(F.slice(mark, 1, F.greatest(F.size(parts), F.lit(1))), free, lambda m, f: F.when(f, m))
        return F.concat(F.array_join(F.zip_with(parts, due, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""), tail)

    return F.when(F.size(units) == 0, text).otherwise(computed_once(units, put))


def head_and_units(text: str) -> tuple[str, list[str]]:
    """What stands before the first letter, and each letter with what follows it."""
    units = UNIT.findall(text)
    return text[: len(text) - sum(map(len, units))], units


def put(text: str, due: dict[int, str]) -> str:
    """The text with marks put in after so many letters, 0 being before the first; where marks stand already they stay."""
    head, units = head_and_units(text)
    out = [head if MARK.search(head) else due.get(0, "") + head]
    for n, u in enumerate(units, 1):
        out.append(u if MARK.search(u) else u[0] + due.get(n, "") + u[1:])
    return "".join(out)
