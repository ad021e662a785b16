"""Spelling variants: each word's most frequent neighbour at one edit, found by probing edits in Bloom filters."""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage
from chronoloom.llm.text_arrays import INVERSE, MULTIPLIER, mix

#: Runs of letters that are words, and the shortest word and the least number of occurrences.
LETTERS, SHORTEST, LEAST = r"[A-Za-zÀ-ÿ]+", 5, 3
#: One occurrence of this many, by hash, loses a letter.
ONE_IN = 97
#: Bits of the filters per word, and the most bits of all filters (64 MB); more words raise the share of false positives only.
BITS_PER_WORD, MOST_BITS = 20, 1 << 29
#: Words of this length or longer share a filter; each shorter length has one of its own.
LONGEST = 64
#: 64-bit blocks of the filters that one task merges, and about how many edits are probed at once.
PART, AT_ONCE = 1 << 17, 1 << 20


def word_counts(docs: DataFrame, *, key: str = "doc_id", text: str = "text", one_in: int = ONE_IN, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of all texts, with how often they occur.

    A word is a maximal run of LETTERS with A-Z in lower case. Where one_in divides the crc32 of `<key>:<run>`, the letter at crc32 % length is
    deleted; a null key is written as nothing. Null texts have no words; each row of docs counts, repeated ones too.
    """
    lower = F.translate(F.col(text), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0))).alias("run"))
    hashed = runs.filter(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _shard(length: Column) -> Column:
    return F.least(length, F.lit(LONGEST))


@dataclass(frozen=True)
class Filters:
    """Bloom filters of words, one for each length; a word's bits lie in one block of 64."""

    offset: np.ndarray  # of each shard's first block
    size: np.ndarray  # blocks of each shard
    blocks: np.ndarray

    @staticmethod
    def layout(counts: dict[int, int], most_bits: int = MOST_BITS) -> Filters:
        """No block is set yet. Shards get room in proportion to their words."""
        wanted = np.array([counts.get(i, 0) * BITS_PER_WORD / 64 for i in range(LONGEST + 1)])
        size = np.ceil(wanted * min(1.0, most_bits / 64 / max(wanted.sum(), 1))).astype(np.int64)
        return Filters(np.concatenate(([0], np.cumsum(size)[:-1])), size, np.zeros(0, np.uint64))

    def places(self, hashes: np.ndarray, shard: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each hash and its bits there; the shard must not be empty."""
        h = mix(hashes)
        at = ((h >> np.uint64(32)) * np.asarray(self.size[shard], np.uint64)) >> np.uint64(32)
        bits = np.zeros(len(h), np.uint64)
        for i in range(5):
            bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
        return at.astype(np.int64) + self.offset[shard], bits

    def may_hold(self, hashes: np.ndarray, shard: int) -> np.ndarray:
        if not self.size[shard]:
            return np.zeros(hashes.shape, bool)
        at, bits = self.places(hashes.ravel(), shard)
        return ((self.blocks[at] & bits) == bits).reshape(hashes.shape)


def _powers(length: int) -> np.ndarray:
    out = np.full(length + 1, MULTIPLIER, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _letters(words: list[str], length: int) -> np.ndarray:
    """[word, position] code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), length).astype(np.uint64)


def _by_length(words: list[str]) -> Iterator[tuple[int, list[int]]]:
    lengths = np.array([len(w) for w in words])
    for length in np.unique(lengths).tolist():
        yield length, np.flatnonzero(lengths == length).tolist()


def hashes(letters: np.ndarray) -> np.ndarray:
    """A polynomial of the letters, so that an edit's hash follows from its word's in a step."""
    return (letters * _powers(letters.shape[1])[:-1]).sum(1, dtype=np.uint64)


def build_filters(vocabulary: DataFrame, most_bits: int = MOST_BITS) -> Filters:
    """Filters of all words. Tasks send the blocks they set, merged by part; at most most_bits come to the driver."""
    bounded_batches(vocabulary.sparkSession, 20_000)
    counts = {r["shard"]: r["count"] for r in vocabulary.groupBy(_shard(F.length("word")).alias("shard")).count().collect()}
    empty = Filters.layout(counts, most_bits)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, rows in _by_length(words):
                found.append(empty.places(hashes(_letters([words[i] for i in rows], length)), min(length, LONGEST)))
        at, bits = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        at, bits = at[order], bits[order]
        for part in np.unique(at // PART).tolist():
            a, b = np.searchsorted(at, (part * PART, (part + 1) * PART))
            fields = [pa.array([part], pa.int64()), pa.array([(at[a:b] - part * PART).astype(np.uint32).tobytes()], pa.binary()), pa.array([bits[a:b].tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, ["part", "at", "bits"])

    def merge(lists: pd.DataFrame) -> pd.DataFrame:
        blocks = np.zeros(PART, np.uint64)
        for at, bits in zip(lists["at"], lists["bits"], strict=True):
            np.bitwise_or.at(blocks, np.frombuffer(at, np.uint32), np.frombuffer(bits, np.uint64))
        return pd.DataFrame({"part": lists["part"].iloc[:1], "blocks": [blocks.tobytes()]})

    lists = vocabulary.select("word").mapInArrow(sketch, "part long, at binary, bits binary")
    blocks = np.zeros(int(empty.size.sum()), np.uint64)
    for part, found in lists.groupBy("part").applyInPandas(merge, "part long, blocks binary").collect():
        own = blocks[part * PART : (part + 1) * PART]
        own[:] = np.frombuffer(found, np.uint64)[: len(own)]
    return Filters(empty.offset, empty.size, blocks)


def probe(words: list[str], alphabet: np.ndarray, filters: Filters) -> Iterator[tuple[int, str]]:
    """(index of a word, edit) for the edits that the filters may hold: deletions, and replacements by a later letter of the alphabet.

    Insertions and replacements by an earlier letter are the other words' deletions and replacements. Edits of a word are
    different from each other: of equal letters in a row the first is deleted.
    """
    for length, rows in _by_length(words):
        power = _powers(length)
        step = max(1, AT_ONCE // (length * max(1, len(alphabet))))
        for begin in range(0, len(rows), step):
            own = rows[begin : begin + step]
            letters = _letters([words[i] for i in own], length)
            terms = letters * power[:-1]
            whole = terms.sum(1, dtype=np.uint64)
            if length > SHORTEST:
                before = np.cumsum(terms, 1, dtype=np.uint64)
                shorter = (before - terms) + (whole[:, None] - before) * INVERSE
                first = np.ones(letters.shape, bool)
                first[:, 1:] = letters[:, 1:] != letters[:, :-1]
                for i, p in np.argwhere(first & filters.may_hold(shorter, min(length - 1, LONGEST))).tolist():
                    word = words[own[i]]
                    yield own[i], word[:p] + word[p + 1 :]
            for p in range(length):
                i, x = np.nonzero(alphabet[None, :] > letters[:, p, None])
                edited = whole[i] + (alphabet[x] - letters[i, p]) * power[p]
                held = filters.may_hold(edited, min(length, LONGEST))
                for j, letter in zip(i[held].tolist(), alphabet[x[held]].tolist(), strict=True):
                    word = words[own[j]]
                    yield own[j], word[:p] + chr(letter) + word[p + 1 :]


def near_words(vocabulary: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, n, near, near_n): each two words that differ by one inserted, deleted or replaced letter, in both orders.

    Only edits that the broadcast filters may hold shuffle; the join with the vocabulary removes those that are no words. As the
    alphabet is that of LETTERS, no word has more than some 180 neighbours a letter.
    """
    spark = vocabulary.sparkSession
    filters = build_filters(vocabulary, most_bits)
    seen = vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter != ''").distinct().collect()
    alphabet = np.array(sorted(ord(r["letter"]) for r in seen), np.uint64)
    shared = spark.sparkContext.broadcast((alphabet, filters))

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1)
            found = list(probe(words, *shared.value))
            own = pa.array([i for i, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), n.take(own), pa.array([e for _, e in found], pa.string())], ["word", "n", "near"])

    maybe = vocabulary.select("word", "n").mapInArrow(edits, "word string, n long, near string")
    met = maybe.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    both = F.explode(F.array(F.struct("word", "n", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return met.select(both.alias("pair")).select("pair.*")


def follow(links: DataFrame) -> DataFrame:
    """(word, root): where the chain word -> form -> ... of links (word, form) ends; chains must not be closed.

    Each round doubles how far a word has got, so rounds grow as the logarithm of the longest chain.
    """
    at = cut_lineage(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")))
    while not at.filter("open").isEmpty():
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.filter("open").join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        at = cut_lineage(at.filter("not open").unionByName(moved))
    return at.select("word", "root")


def spelling_variants(docs: DataFrame, *, key: str = "doc_id", text: str = "text", ratio: int = 2, most_bits: int = MOST_BITS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of word_counts, whatever else docs holds.

    form is the near word of the largest n (ties: the smallest in code-point order) if its n is at least ratio times the word's, else null;
    root is where forms lead to, the word itself if nowhere; n_near counts the near words. As n grows along forms, they never close a
    circle. Null and empty texts have no words; repeated rows count each; no words give no rows.
    """
    vocabulary = cut_lineage(word_counts(docs, key=key, text=text))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    near = near_words(vocabulary, most_bits).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = vocabulary.join(near, "word", "left")
    large = -F.col("best.less") >= ratio * F.col("n")
    told = cut_lineage(joined.select("word", F.when(large, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, -F.col("best.less")).alias("form_n")))
    roots = follow(told.filter("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
