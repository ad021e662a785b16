"""Column functions on text: layers, tokens, punctuation, scripts, repetition, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that must open and close equally often. Fixed values.
PAIRS = [("(", ")"), ("[", "]"), ("{", "}")]
WORD = r"\d+(?:[.,]\d+)*|[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)?"
#: Secrets that are blotted out. Fixed values.
SECRET = r"(?i)(bearer\s+\S+|hf_[a-z0-9]{16,}|token\s*=\s*\S+)"
PUNCTUATION = r"\p{P}"


def layer_not_blank(user: Column, smart: Column, faithful: Column) -> Column:
    """The user's text unless blank, else the smart one unless empty, else the faithful one."""
    return F.when(F.trim(user) != "", user).when(smart != "", smart).otherwise(faithful)


def layer_as_set(user: Column, smart: Column, faithful: Column) -> tuple[Column, Column]:
    """The user's text even if empty, else the smart one even if empty, else the faithful one; and which it is."""
    text = F.when(user.isNotNull(), user).when(smart.isNotNull(), smart).otherwise(faithful)
    return text, F.when(user.isNotNull(), "user").when(smart.isNotNull(), "smart").otherwise("faithful")


def layer_coalesced(user: Column, smart: Column, faithful: Column) -> Column:
    """The user's text unless null, else the smart one unless empty, else the faithful one."""
    return F.coalesce(user, F.when(smart != "", smart), faithful)


def words(text: Column) -> Column:
    """Numbers with separators, or runs of letters and digits with one inner apostrophe."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lexical(text: Column) -> Column:
    """Without punctuation and white space."""
    return F.regexp_replace(text, r"[\p{P}\p{Z}\s]", "")


def punctuation(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PUNCTUATION), F.lit(0))


def sentences(text: Column) -> Column:
    """Pieces that end at a terminator or a line's end, trimmed, those with letters or digits only."""
    cut = F.split(text, r"[.?!。！？\n]")
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: s.rlike(r"[\p{L}\p{N}]"))


def pairs_balanced(text: Column) -> Column:
    """Whether each kind of bracket opens and closes equally often."""
    same = [F.length(F.replace(text, F.lit(a), F.lit(""))) == F.length(F.replace(text, F.lit(b), F.lit(""))) for a, b in PAIRS]
    return same[0] & same[1] & same[2]


def unpaired(text: Column) -> Column:
    """Brackets without a partner, by a stack: closing ones that don't fit the last open one, and open ones left."""
    signs = F.regexp_extract_all(text, F.lit(r"[\(\)\[\]\{\}]"), F.lit(0))
    start = F.struct(F.lit("").alias("open"), F.lit(0).alias("bad"))
    partner = lambda c: F.when(c == ")", "(").when(c == "]", "[").when(c == "}", "{")

    def step(state: Column, c: Column) -> Column:
        top = F.right(state["open"], F.lit(1))
        fits = (state["open"] != "") & (top == partner(c))
        shorter = F.substring(state["open"], F.lit(1), F.length(state["open"]) - 1)
        opened = F.when(c.isin("(", "[", "{"), F.concat(state["open"], c)).when(fits, shorter).otherwise(state["open"])
        return F.struct(opened.alias("open"), (state["bad"] + F.when(c.isin("(", "[", "{") | fits, 0).otherwise(1)).alias("bad"))

    return F.aggregate(signs, start, step, lambda s: s["bad"] + F.length(s["open"]))


def occurrences(text: Column, part: Column) -> Column:
    """How often part occurs in text without overlap; 0 for an empty part."""
    count = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, count).otherwise(0).cast("long")


def redacted(text: Column) -> Column:
    return F.regexp_replace(text, SECRET, "[REDACTED]")


def punctuated(text: Column, mode: str) -> Column:
    """automatic: as it is; off: without punctuation; sentence_end: only . ? ! and their wide forms stay."""
    if mode == "automatic":
        return text
    return F.regexp_replace(text, PUNCTUATION if mode == "off" else r"(?![.?!。！？])\p{P}", "")


def share(pattern: str, text: Column) -> Column:
    """Matches of a pattern per character; null for an empty text."""
    return F.regexp_count(text, F.lit(pattern)) / F.when(F.length(text) > 0, F.length(text))


def script_mismatch(text: Column, language: Column) -> Column:
    """ja: six letters or more, 60 % of them Han and no kana; en: over 20 % not Latin; zh: over 35 % kana. Fixed values."""
    count = lambda p: F.regexp_count(text, F.lit(p))
    letters, han, kana, latin = count(r"\p{L}"), count(r"\p{IsHan}"), count(r"[\p{IsHiragana}\p{IsKatakana}]"), count(r"\p{IsLatin}")
    return (
        F.when(language == "ja", (letters >= 6) & (han >= 0.6 * letters) & (kana == 0))
        .when(language == "en", letters - latin > 0.2 * letters)
        .when(language == "zh", kana > 0.35 * letters)
        .otherwise(False)
    )


def fold_kana(text: Column) -> Column:
    """Katakana as Hiragana: U+30A1 to U+30F6 moved by 0x60."""
    return F.translate(text, "".join(map(chr, range(0x30A1, 0x30F7))), "".join(map(chr, range(0x3041, 0x3097))))
