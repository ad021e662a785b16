import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.llm import byte_bpe, queries

tiktoken = pytest.importorskip("tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def pair():
    ranks = byte_bpe.read_ranks()
    return byte_bpe.BytePairs(ranks), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts(pair):
    own, other = pair
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "'", "'s", "'ll", "'l", "l", "re", "a", "é", "1", "٣", "!", "''", "\t", "\xa0", "　", "'d", "v", "中", "😀", "\x1c", "\x85", "'S", "m", "t"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    for text, (ids, starts) in zip(texts, own.encode(texts), strict=True):
        assert ids == other.encode_ordinary(text) and own.decode(ids) == text.encode()
        assert starts == sorted(set(starts)) and (not text or starts[0] == 0)


@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_any_text(pair, text):
    assert pair[0].encode([text])[0][0] == pair[1].encode_ordinary(text)


def test_long_pieces(pair):
    own, other = pair
    for text in ("a" * 3000, "ab1" * 2000, "!" * 999, "thequick" * 400, " " * 500 + "x", "é" * 700):
        assert own.encode([text])[0][0] == other.encode_ordinary(text)


def test_classes_equal_the_library():
    """Whether a code point joins a letter, a number or a symbol, for all of them."""
    ranks = {bytes([i]): i for i in range(256)}
    for lead in b"a1!":
        ranks |= {bytes([lead, i]): len(ranks) + i - 128 for i in range(128, 256)}
    other = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    points = [c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000]
    joined = [np.array([x[0] != ord(p) for x in other.encode_ordinary_batch([p + chr(c) for c in points])]) for p in "a1!"]
    want = np.select(joined, [byte_bpe.LETTER, byte_bpe.NUMBER, byte_bpe.OTHER], byte_bpe.SPACE)
    assert (byte_bpe.class_table()[points] == want).all()


def test_scan_is_a_fold():
    rng = np.random.default_rng(0)
    functions = rng.integers(0, 256, 5000).astype(np.uint8)
    state, want = 1, []
    for f in functions.tolist():
        want.append(state)
        state = f >> 2 * state & 3
    assert byte_bpe.scan(functions, 1, width=64).tolist() == want
    assert byte_bpe.scan(functions[:3], 2).tolist()[0] == 2


def test_query_against_the_library(spark, small, pair):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.op9_byte_bpe(spark, small).collect():
        ids = pair[1].encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_hard_rows(hard, none):
    rows = byte_bpe.with_decoded(byte_bpe.with_tokens(hard), "tokens.ids").collect()
    assert len(rows) == hard.count() and all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in rows)
    for first, last in ((0, 5), (3, 11), (-2, 4), (7, 7), (2, 10**6), (None, 3)):
        spans = byte_bpe.with_decoded_span(byte_bpe.with_tokens(hard), F.lit(first), F.lit(last)).collect()
        assert all(bytes(r["decoded"]).decode() == ("" if first is None else (r["text"] or "")[max(first, 0) : last]) for r in spans)
    digests = hard.selectExpr("*", "'mine' as digests", "'mine' as ids_sha256")
    assert {r["digests"] for r in byte_bpe.token_digests(digests).collect()} == {"mine"}
    assert byte_bpe.token_digests(none).count() == 0 and byte_bpe.with_tokens(none).count() == 0
