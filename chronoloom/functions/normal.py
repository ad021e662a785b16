"""Column functions that normalise text for comparison, and judge its characters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space by Unicode's property, for Java's expressions.
SPACE = r"(?U)\s"


def _compatible(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if x is None else unicodedata.normalize("NFKC", x).casefold() for x in texts.to_pylist()], pa.string())


def _normalised(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def _caseless(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if x is None else x.casefold() for x in texts.to_pylist()], pa.string())


def compatible(text: Column) -> Column:
    """NFKC and case folding, which Spark has no function for."""
    return F.arrow_udf(_compatible, "string")(text)


def normalised(text: Column) -> Column:
    """NFKC alone."""
    return F.arrow_udf(_normalised, "string")(text)


def caseless(text: Column) -> Column:
    """Case folding alone."""
    return F.arrow_udf(_caseless, "string")(text)


def unspaced(text: Column) -> Column:
    """Without white space: the units of an exact comparison by characters."""
    return F.regexp_replace(text, SPACE, "")


def unpunctuated(folded: Column) -> Column:
    """A folded text without white space and punctuation: the units of a tolerant comparison by characters."""
    return F.regexp_replace(folded, r"(?U)[\p{P}\s]", "")


def alphanumeric(folded: Column) -> Column:
    """A folded text's letters and numbers alone."""
    return F.regexp_replace(folded, r"[^\p{L}\p{N}]", "")


def comparable(text: Column) -> Column:
    """Case-folded, without what isn't part of a word."""
    return F.regexp_replace(caseless(text), r"[^\p{L}\p{M}\p{N}_]", "")


def invalid_characters(text: Column) -> Column:
    """Replacement characters, controls but line feed and tab, surrogates and unassigned code points."""
    return F.regexp_count(text, F.lit(r"[�\p{Cc}\p{Cs}\p{Cn}&&[^\n\t]]"))


def legal_tokens(tokens: Column, language: Column) -> Column:
    """The tokens whose letters all belong to the scripts of the language; a token without letters is legal."""
    other = F.when(language == "ja", r"[\p{L}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsLatin}]]")
    other = other.when(language == "zh", r"[\p{L}&&[^\p{IsHan}\p{IsLatin}]]").otherwise(r"[\p{L}&&[^\p{IsLatin}]]")
    return F.filter(tokens, lambda t: ~F.regexp_like(t, other))


def joined_tokens(tokens: Column, language: Column) -> Column:
    """Tokens as running text: no blanks in Chinese and Japanese, elsewhere none before a mark."""
    spaced = F.trim(F.regexp_replace(F.array_join(tokens, " "), r"\s+([.,!?;:])", "$1"))
    return F.when(language.isin("zh", "ja"), F.array_join(tokens, "")).otherwise(spaced)


def pieces(text: Column) -> Column:
    """Sentences of a text with their terminator, those with something but marks and white space."""
    found = F.regexp_extract_all(text, F.lit(r"[^.?!。！？]*[.?!。！？]|[^.?!。！？]+\z"), F.lit(0))
    return F.filter(found, lambda s: F.regexp_replace(s, r"(?U)[\p{P}\s]", "") != "")


def sentence_present(sentence: Column, whole: Column, least: float = 0.9) -> Column:
    """Whether a whole text has a sentence in it, or is like it to the share `least`; both without marks and white space, in one case.

    The edit distance is taken only where the lengths let it be small.
    """
    room = F.length(sentence) * F.lit(1 - least) + 1e-9
    near = F.when(F.abs(F.length(sentence) - F.length(whole)) <= room, F.levenshtein(sentence, whole) <= room).otherwise(False)
    return (sentence == "") | F.contains(whole, sentence) | near


def capital_hits(reference: Column, hypothesis: Column) -> tuple[Column, Column, Column]:
    """Letters in the same place that are capitals in both texts, and the capitals of the hypothesis and of the reference."""
    letters = [F.filter(F.split(x, ""), lambda c: c.rlike(r"\p{L}")) for x in (reference, hypothesis)]
    both = F.size(F.filter(F.zip_with(*letters, lambda a, b: a.rlike(r"\p{Lu}") & b.rlike(r"\p{Lu}")), lambda x: x))
    return both, *(F.regexp_count(x, F.lit(r"\p{Lu}")) for x in (hypothesis, reference))


def pronounced(text: Column, readings: dict[str, str]) -> Column:
    """The text with written forms put as their readings, longer forms first."""
    for written in sorted(readings, key=lambda w: (-len(w), w)):
        text = F.replace(text, F.lit(written), F.lit(readings[written]))
    return text


def surface_tokens(compatible_text: Column, language: Column) -> Column:
    """Tokens as they are shown. Chinese and Japanese: each character of their scripts, and runs of other letters, numbers, apostrophes, hyphens and stops; else words, numbers and single letters."""
    script = r"\u3400-\u9fff\u3040-\u30ff"
    mixed = F.regexp_extract_all(compatible_text, F.lit(rf"[{script}]|(?:[\p{{L}}\p{{N}}'’\-.&&[^{script}]])+"), F.lit(0))
    words = F.regexp_extract_all(compatible_text, F.lit(r"[A-Za-z]+(?:['’-][A-Za-z]+)*|\d+(?:[.,]\d+)?|[\p{L}\p{N}]"), F.lit(0))
    return F.when(language.isin("zh", "ja"), mixed).otherwise(words)


#: Marks that only format a text. Fixed values.
FORMATTING = "。！？.!?,，、;；:：\"'“”‘’「」『』【】（）()[]{}《》〈〉…"
_PLAIN = "".join("\\" + c if c in "[]{}()" else c for c in FORMATTING if c not in ".,:'’")


def lexical_characters(text: Column) -> Column:
    """The text without white space and marks, but with stops before digits, commas and colons between digits, and apostrophes within words."""
    drop = rf"\.(?!\p{{Nd}})|(?<!\p{{Nd}})[,:]|[,:](?!\p{{Nd}})|(?<![\p{{L}}\p{{N}}])['’]|['’](?![\p{{L}}\p{{N}}])|[{_PLAIN}]|(?U)\s"
    return F.regexp_replace(text, drop, "")


def novelty_stalled(snapshots: list[Column]) -> Column:
    """Whether four successive token lists bring nothing new: they differ by one token at most, or each goes on from the one before with tokens of its last twelve only."""
    sizes = F.array(*(F.size(s) for s in snapshots))
    flat = F.array_max(sizes) - F.array_min(sizes) <= 1
    steps = []
    for before, now in zip(snapshots, snapshots[1:], strict=False):
        n = F.size(before)
        added = F.slice(now, n + 1, F.greatest(F.size(now) - n, F.lit(0)))
        recent = F.slice(before, F.greatest(n - 11, F.lit(1)), F.lit(12))
        steps.append((F.size(now) > n) & (F.slice(now, F.lit(1), n) == before) & (F.size(F.array_except(added, recent)) == 0))
    return flat | (steps[0] & steps[1] & steps[2])
