"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by kept offsets."""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, unused
from chronoloom.llm.text_arrays import chunks, utf8

#: The public vocabulary that ranks are read from on the driver, unless a caller names another file.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Classes of code points.
OTHER, LETTER, NUMBER, SPACE = range(4)
#: White space by Unicode's property. Fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of a Unicode version later than Python's table. First, last, class.
LATER = [
    (0x1C89, 0x1C8A, LETTER), (0xA7CB, 0xA7CD, LETTER), (0xA7DA, 0xA7DC, LETTER), (0x105C0, 0x105F3, LETTER), (0x10D40, 0x10D49, NUMBER),
    (0x10D4A, 0x10D65, LETTER), (0x10D6F, 0x10D85, LETTER), (0x10EC2, 0x10EC4, LETTER), (0x11380, 0x11389, LETTER), (0x1138B, 0x1138B, LETTER),
    (0x1138E, 0x1138E, LETTER), (0x11390, 0x113B5, LETTER), (0x113B7, 0x113B7, LETTER), (0x113D1, 0x113D1, LETTER), (0x113D3, 0x113D3, LETTER),
    (0x116D0, 0x116E3, NUMBER), (0x11BC0, 0x11BE0, LETTER), (0x11BF0, 0x11BF9, NUMBER), (0x13460, 0x143FA, LETTER), (0x16100, 0x1611D, LETTER),
    (0x16130, 0x16139, NUMBER), (0x16D40, 0x16D6C, LETTER), (0x16D70, 0x16D79, NUMBER), (0x18CFF, 0x18CFF, LETTER), (0x1CCF0, 0x1CCF9, NUMBER),
    (0x1E5D0, 0x1E5ED, LETTER), (0x1E5F0, 0x1E5F0, LETTER), (0x1E5F1, 0x1E5FA, NUMBER),
]
#: Endings that an apostrophe forms a piece with. Fixed values.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: States of the scan: the piece so far is open to symbols; it isn't; one or two letters of an ending are due.
SYMBOLS, CLOSED, ONE_DUE, TWO_DUE = range(4)
#: Stands for the rank of neighbours that don't merge.
NO_RANK = 1 << 30
#: Pieces whose ids a Python worker remembers.
CACHED = 200_000


@cache
def class_table() -> np.ndarray:
    """The class of every code point."""
    table = np.fromiter(({"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    table[WHITE_SPACE] = SPACE
    for first, last, kind in LATER:
        table[first : last + 1] = kind
    return table


def _function(*to: int) -> int:
    """A function from state to state as one byte, two bits for each."""
    return sum(state << 2 * i for i, state in enumerate(to))


@cache
def _then() -> np.ndarray:
    """[f, g]: the function that does f and then g."""
    f = np.arange(256)
    image = np.stack([f >> 2 * i & 3 for i in range(4)])
    return sum((f[None, :] >> 2 * image[i][:, None] & 3) << 2 * i for i in range(4)).astype(np.uint8)


def scan(functions: np.ndarray, start: int, width: int = 256) -> np.ndarray:
    """The state before each function when all are applied in order, by composing them associatively.

    Blocks of `width` are composed side by side, column by column; then the blocks' own functions by
    doubling distances; each state is its block's entry state sent through the block's prefix.
    """
    n = len(functions)
    identity = _function(0, 1, 2, 3)
    blocks = -(-n // width)
    padded = np.full(blocks * width, identity, np.uint8)
    padded[:n] = functions
    prefix = np.ascontiguousarray(padded.reshape(blocks, width).T)
    then = _then()
    for j in range(1, width):
        prefix[j] = then[prefix[j - 1], prefix[j]]
    whole, step = prefix[-1].copy(), 1
    while step < blocks:
        whole[step:] = then[whole[:-step], whole[step:]]
        step *= 2
    entry = np.concatenate(([start], whole[:-1] >> np.uint8(2 * start) & 3)).astype(np.uint8)
    after = prefix >> (2 * entry)[None, :] & 3
    states = np.vstack([entry[None, :], after[:-1]])
    return states.T.ravel()[:n]


def piece_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each code point; first marks the first code point of each text.

    Letters, numbers, other symbols and white space form runs; one blank goes with the run that follows it;
    of several white-space characters before other text the last stands apart; an apostrophe that
    would start a piece takes one of ENDINGS with it. Only the last needs the state of the piece before it,
    which the scan gives.
    """
    n = len(codes)
    kind = class_table()[codes]
    ends = np.append(first[1:], True)
    after = np.append(kind[1:], SPACE)
    after[ends] = SPACE
    blank, space, quote = codes == 0x20, kind == SPACE, codes == 0x27
    leads = blank & ~ends & (after != SPACE)
    due = np.zeros(n, np.uint8)
    at = np.flatnonzero(quote & ~ends)
    one, two = codes[at + 1], np.where(at + 2 < n, codes[np.minimum(at + 2, n - 1)], 0)
    two = np.where(ends[at + 1], 0, two)
    for text in ENDINGS:
        fits = (one == ord(text[0])) & ((len(text) == 1) | (two == ord(text[-1])))
        due[at[fits]] = len(text)
    # a blank that leads on to symbols, and symbols, leave the piece open to symbols
    step = np.full(n, _function(CLOSED, CLOSED, CLOSED, ONE_DUE), np.uint8)
    step[kind == OTHER] = _function(SYMBOLS, SYMBOLS, SYMBOLS, SYMBOLS)
    step[leads & (after == OTHER)] = _function(SYMBOLS, SYMBOLS, SYMBOLS, SYMBOLS)
    step[due == 1] = _function(SYMBOLS, ONE_DUE, ONE_DUE, ONE_DUE)
    step[due == 2] = _function(SYMBOLS, TWO_DUE, TWO_DUE, TWO_DUE)
    # a text starts closed: its first function takes every state to what it takes CLOSED to
    step[first] = (step[first] >> 2 * CLOSED & 3) * _function(1, 1, 1, 1)
    state = scan(step, CLOSED)
    state[first] = CLOSED
    before = np.concatenate(([SPACE], kind[:-1]))
    led = np.concatenate(([False], leads[:-1]))
    now = np.append(state[1:], CLOSED)
    now[-1] = step[-1] >> 2 * state[-1] & 3
    starts = kind != before
    starts |= space & (before == SPACE) & ~ends & (after != SPACE)
    starts &= ~led
    # what an ending takes in doesn't start a piece; the letter after it does
    taken = (state >= ONE_DUE) & (kind == LETTER)
    closing = np.concatenate(([False], taken[:-1] & (now[:-1] < ONE_DUE)))
    starts[taken] = False
    starts |= closing & (state == CLOSED)
    starts[first] = True
    return starts


class BytePairs:
    """Ids of byte pieces by a table of ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.known = ranks, {}
        self.tokens = dict(zip(ranks.values(), ranks, strict=True))
        self.names = {i: str(i) for i in ranks.values()}
        self.single = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        pairs = sorted((ranks[t[:i]] << 20 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.pair_keys, self.pair_ranks = (np.array(x, np.int64) for x in zip(*pairs, strict=True)) if pairs else (np.array([-1]), np.array([NO_RANK]))
        self.of_bytes = self._rank(self.single[:, None], self.single[None, :])

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbours, NO_RANK where they don't merge or one is -1."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], NO_RANK).astype(np.int32)

    def merge(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Merge neighbours of the lowest rank, the leftmost first, until none has a rank.

        Pieces of similar length go side by side: a step merges one pair of each of them.
        """
        out: list[tuple[int, ...]] = [()] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = (whole,)
            elif len(piece) > 128:
                out[i] = self._merge_long(piece)
            else:
                by_width.setdefault(-(-len(piece) // 4) * 4, []).append(i)
        for width, rows in by_width.items():
            self._merge_side_by_side([pieces[i] for i in rows], np.array(rows), width, out)
        return out

    def _merge_side_by_side(self, pieces: list[bytes], rows: np.ndarray, width: int, out: list[tuple[int, ...]]) -> None:
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        columns = np.arange(width)
        there = columns < np.fromiter(map(len, pieces), np.int64, len(pieces))[:, None]
        ids = np.where(there, self.single[raw], np.int32(-1))
        ranks = np.full(ids.shape, NO_RANK, np.int32)
        ranks[:, :-1] = np.where(there[:, 1:], self.of_bytes[raw[:, :-1], raw[:, 1:]], NO_RANK)
        while len(rows):
            at = ranks.argmin(axis=1)
            line = np.arange(len(rows))
            least = ranks[line, at]
            done = least == NO_RANK
            if done.any():
                for i, found in zip(rows[done].tolist(), ids[done].tolist(), strict=True):
                    out[i] = tuple(found[: found.index(-1)] if found[-1] < 0 else found)
                going = ~done
                rows, ids, ranks, at, least = rows[going], ids[going], ranks[going], at[going], least[going]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            ids[line, at] = least
            shift = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, shift, 1), np.take_along_axis(ranks, shift, 1)
            ids[:, -1], ranks[:, -1] = -1, NO_RANK
            ranks[line, at] = self._rank(ids[line, at], np.where(at + 1 < width, ids[line, np.minimum(at + 1, width - 1)], -1))
            inner = np.flatnonzero(at > 0)
            ranks[inner, at[inner] - 1] = self._rank(ids[inner, at[inner] - 1], ids[inner, at[inner]])

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """The same by a heap over linked parts, for pieces whose length squared would hurt."""
        ranks, n = self.ranks, len(piece)
        end, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if end[i] < 0 or end[i] >= n or end[end[i]] != stop:
                continue
            j = end[i]
            end[i], end[j] = stop, -1
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if prev[i] >= 0 and (r := ranks.get(piece[prev[i] : stop])) is not None:
                heapq.heappush(heap, (r, prev[i], stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Per text its ids, and the offset in code points at which each piece starts."""
        joined = "".join(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(lengths) - lengths
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        first = np.zeros(len(codes), bool)
        first[begin[lengths > 0]] = True
        cuts = np.flatnonzero(piece_starts(codes, first)) if len(codes) else np.zeros(0, np.int64)
        bounds = np.searchsorted(cuts, np.append(begin, len(codes))).tolist()
        starts = cuts.tolist()
        pieces = [joined[a:b] for a, b in pairwise([*starts, len(codes)])]
        known = self.known
        new = list({p for p in pieces if p not in known})
        if new:
            if len(known) + len(new) > CACHED:
                known.clear()
                new = list(set(pieces))
            known.update(zip(new, self.merge([p.encode() for p in new]), strict=True))
        out = []
        for a, b, start in zip(bounds[:-1], bounds[1:], begin.tolist(), strict=True):
            ids = list(chain.from_iterable(map(known.__getitem__, pieces[a:b])))
            out.append((ids, [x - start for x in starts[a:b]]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def piece_tokens(self, text: str, starts: list[int]) -> list[int]:
        """The number of the first token of each piece of a text that has just been encoded."""
        sizes = [len(self.known[text[a:b]]) for a, b in pairwise([*starts, len(text)])]
        return list(accumulate(sizes, initial=0))[:-1]

    def decode_span(self, ids: list[int], starts: list[int], tokens: list[int], first: int, last: int) -> bytes:
        """The bytes of the code points [first, last) of a text: the pieces' offsets find the ids, so only theirs are decoded."""
        if first >= last or not starts:
            return b""
        a, b = bisect_right(starts, max(first, 0)) - 1, bisect_left(starts, last)
        ends = tokens[b] if b < len(tokens) else len(ids)
        return self.decode(ids[tokens[a] : ends]).decode()[max(first, 0) - starts[a] : last - starts[a]].encode()


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """A rank file, one base64 token and its rank a line; by default that of VOCABULARY."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def _shared(spark: SparkSession, rank_file: str | None):  # noqa: ANN202
    """The ranks on every executor; a vocabulary is some 50,000 entries whatever the corpus."""
    bounded_batches(spark)
    ranks, made = spark.sparkContext.broadcast(read_ranks(rank_file)), {}

    def coder() -> BytePairs:
        if not made:
            made[0] = BytePairs(ranks.value)
        return made[0]

    return coder


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    _, starts = utf8(texts)
    for a, b in chunks(starts, 1 << 21):
        yield [x or "" for x in texts.slice(a, b - a).to_pylist()]


def with_tokens(docs: DataFrame, *, text: str = "text", rank_file: str | None = None, name: str = "tokens") -> DataFrame:
    """docs with a struct (ids, piece_starts, piece_tokens): token ids, and the code point and token at which each piece starts.

    A null or empty text has no tokens; a column of that name is replaced; every other row and column
    stays as it is.
    """
    coder = _shared(docs.sparkSession, rank_file)

    @F.arrow_udf("struct<ids:array<int>,piece_starts:array<int>,piece_tokens:array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = []
            for part in _parts(texts):
                for value, (ids, starts) in zip(part, coder().encode(part), strict=True):
                    found.append((ids, starts, coder().piece_tokens(value, starts)))
            kind = pa.list_(pa.int32())
            yield pa.StructArray.from_arrays([pa.array([x[i] for x in found], kind) for i in (0, 1, 2)], ["ids", "piece_starts", "piece_tokens"])

    return docs.withColumn(name, encode(F.col(text)))


def with_decoded(docs: DataFrame, ids: str = "ids", *, rank_file: str | None = None, name: str = "decoded") -> DataFrame:
    """docs with the bytes of an array of token ids; null has no bytes."""
    coder = _shared(docs.sparkSession, rank_file)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            yield pa.array([coder().decode(x or []) for x in lists.to_pylist()], pa.binary())

    return docs.withColumn(name, decode(F.col(ids)))


def with_decoded_span(docs: DataFrame, first: Column, last: Column, *, tokens: str = "tokens", rank_file: str | None = None, name: str = "decoded") -> DataFrame:
    """docs with the bytes of a span of code points [first, last) of each encoded text, found by the offsets that with_tokens kept.

    The whole text isn't decoded. A span beyond the text is cut to it; an empty one, null bounds and null tokens have no bytes.
    """
    coder = _shared(docs.sparkSession, rank_file)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for lists, begin, end in batches:
            rows = zip(lists.to_pylist(), begin.to_pylist(), end.to_pylist(), strict=True)
            yield pa.array([coder().decode_span(x["ids"], x["piece_starts"], x["piece_tokens"], a, b) if x and a is not None and b is not None else b"" for x, a, b in rows], pa.binary())

    return docs.withColumn(name, decode(F.col(tokens), first.cast("long"), last.cast("long")))


def token_digests(docs: DataFrame, *, text: str = "text", rank_file: str | None = None) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, for checks of a whole corpus (columns so named are replaced).

    Texts are encoded as by with_tokens and their ids decoded again within one task, so the ids needn't
    be stored; a null text is as an empty one.
    """
    coder = _shared(docs.sparkSession, rank_file)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = []
            for part in _parts(texts):
                names = coder().names
                for ids, _ in coder().encode(part):
                    named = " ".join(map(names.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(named.encode()).hexdigest(), hashlib.sha256(coder().decode(ids)).hexdigest()))
            kinds = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], [*kinds])

    kept = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    [found] = unused(docs, "digests")
    return docs.select(*kept, digest(F.col(text)).alias(found)).select(*kept, f"{found}.*")
