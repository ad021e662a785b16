"""Repetition in decoded text: n-gram counts, loops of tokens and characters, compression."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOKENS = re.compile(r"[^\x20\x09-\x0D]+")
_LOOP = re.compile(r"(.{3,10}?)\1{3}", re.S)


def computed_once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row, also where it stands inside functions over arrays."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ngram_repeats(text: Column, size: int, often: int) -> Column:
    """A struct (words, most, repeated): a text's tokens, how often its most frequent run of `size` tokens occurs, and how many of its runs occur `often` times or more; null for a text of fewer tokens.

    Runs are counted within the row, so none of them leaves its text.
    """

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for value in texts.to_pylist():
                items = _TOKENS.findall(value or "")
                times = Counter(zip(*(items[i:] for i in range(size)), strict=False)).values() if len(items) >= size else None
                rows.append(None if times is None else {"words": len(items), "most": max(times), "repeated": sum(n for n in times if n >= often)})
            yield pa.array(rows, pa.struct([(n, pa.int64()) for n in ("words", "most", "repeated")]))

    return F.arrow_udf(count, "struct<words:bigint,most:bigint,repeated:bigint>")(text)


def has_token_loop(items: list[str], widest: int = 12, times: int = 4) -> bool:
    """Whether a unit of 1 to `widest` tokens follows itself `times` times anywhere; linear in the tokens for each width."""
    for width in range(1, widest + 1):
        run = 0
        for i in range(width, len(items)):
            run = run + 1 if items[i] == items[i - width] else 0
            if run >= width * (times - 1):
                return True
    return False


def repeated_suffix(items: list[str], times: int = 4) -> int | None:
    """The shortest period of which the last tokens are `times` repetitions; None if there is none.

    The lengths to which the reversed tokens match themselves when shifted tell it, in linear time.
    """
    s, n = items[::-1], len(items)
    same, left, right = [0] * n, 0, 0
    for i in range(1, n):
        if i < right:
            same[i] = min(right - i, same[i - left])
        while i + same[i] < n and s[same[i]] == s[i + same[i]]:
            same[i] += 1
        if i + same[i] > right:
            left, right = i, i + same[i]
        if i * times <= n and same[i] >= i * (times - 1):
            return i
    return None


def _signals(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch:
            text = text or ""
            raw = text.encode()
            letters = re.sub(r"[\W_]+", "", text)
            items = text.split()
            rows.append((repeated_suffix(items), has_token_loop(items), _LOOP.search(letters) is not None, len(zlib.compress(raw)) / len(raw) if raw else 1.0))
        yield pd.DataFrame(rows, columns=["suffix_period", "token_loop", "character_loop", "compression"]).astype({"suffix_period": "Int32"})


def inspect_loops(df: DataFrame, text: str, *, least_compression: float = 0.2) -> DataFrame:
    """df with suffix_period, token_loop, character_loop, compression, looping; a null text shows no loop."""
    signals = F.pandas_udf(_signals, "suffix_period int, token_loop boolean, character_loop boolean, compression double")
    out = df.withColumn("_s", signals(F.col(text))).select(*df.columns, "_s.*")
    return out.withColumn("looping", F.col("suffix_period").isNotNull() | F.col("token_loop") | (F.col("compression") < least_compression))
