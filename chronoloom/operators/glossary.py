"""Terms of a glossary in texts, by an index of word and character runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.repetition import computed_once

#: Words of a long term, and characters of a short one, that file it in the index, at most.
WORDS, CHARACTERS = 3, 8


def _runs(words: Column, size: int) -> Column:
    """Hashes of the runs of `size` words."""
    at = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(size), F.array_join(F.slice(words, i, size), " ")))


def _pieces(text: Column, size: int) -> Column:
    """Hashes of the runs of `size` characters."""
    at = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.lit(-size), F.substr(text, i, F.lit(size))))


def _split(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]+")


def filed_terms(terms: DataFrame, *, term: str, term_id: str) -> DataFrame:
    """(id, term, size, filed): terms that aren't empty, in lower case, each under one hash that a text with it must have.

    The inner words of a term are whole words of any text that holds it: a term of three words or more is filed under the
    middle ones, size counting them. A shorter one is filed under its first characters, with their number below zero as size.
    """
    known = terms.filter(F.length(term) > 0).select(F.col(term_id).alias("id"), F.lower(term).alias("term"))
    inner = F.size(_split(F.col("term"))) - 2
    size = F.when(inner > 0, F.least(F.lit(WORDS), inner)).otherwise(-F.least(F.lit(CHARACTERS), F.length("term")))
    sized = known.withColumn("size", size)
    middle = F.slice(_split(F.col("term")), F.floor((inner - F.col("size")) / 2).cast("int") + 2, F.greatest(F.col("size"), F.lit(0)))
    by_word = F.xxhash64(F.col("size"), F.array_join(middle, " "))
    return sized.withColumn("filed", F.when(F.col("size") > 0, by_word).otherwise(F.xxhash64(F.col("size"), F.substr("term", F.lit(1), -F.col("size")))))


def contained_terms(docs: DataFrame, terms: DataFrame, *, text: str, term: str, term_id: str, key: str) -> DataFrame:
    """(key, term_id) for each term that a text holds, in lower case; null and empty terms are in none.

    Texts and terms meet by an equal join on hashed runs; only runs of the sizes that the terms are filed under are made, and
    each text sends a run once. What meets is then looked for in the text itself.
    """
    filed = filed_terms(terms, term=term, term_id=term_id)
    sizes = sorted(r["size"] for r in filed.select("size").distinct().collect())  # WORDS + CHARACTERS at most
    low = docs.select(F.col(key).alias("key"), F.lower(text).alias("text")).filter("text is not null")
    if not sizes:
        return docs.select(key, F.lit(None).cast(terms.schema[term_id].dataType).alias(term_id)).limit(0)
    by_word = computed_once(_split(F.col("text")), lambda words: F.concat(F.array().cast("array<bigint>"), *(_runs(words, s) for s in sizes if s > 0)))
    by_piece = computed_once(F.col("text"), lambda whole: F.concat(F.array().cast("array<bigint>"), *(_pieces(whole, -s) for s in sizes if s < 0)))
    runs = F.concat(by_word, by_piece)
    met = low.select("key", F.explode(F.array_distinct(runs)).alias("filed")).join(filed.select("filed", "id"), "filed").select("key", "id").distinct()
    found = met.join(low, "key").join(filed.select("id", "term"), "id").filter(F.contains("text", "term"))
    return found.select(F.col("key").alias(key), F.col("id").alias(term_id)).distinct()
