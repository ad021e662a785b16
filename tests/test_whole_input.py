"""Queries on rows that the given tables lack, against plain Python."""

import hashlib
import re
import unicodedata

import pytest

from chronoloom import plans


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """A long conversation and short ones, and documents with wide marks."""
    folder = str(tmp_path_factory.mktemp("wide"))
    turns = [("a", t, "user" if t % 2 == 0 else "assistant", f"turn {t} {chr(97 + t % 26) * 40}") for t in range(2000)] + [("b", t, "user", f"text {t} {'xyz'[t] * 30}") for t in range(3)] + [("c", 5, "user", "alone")]
    docs = [(1, "これは文です。本当？はい！終わり、です"), (2, "One, two. Three!"), (3, None), (4, ""), (5, "混ぜ. た。mixed?")]
    spark.createDataFrame(turns, "conv_id string, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    spark.createDataFrame([(*d, "xx", "s") for d in docs], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    return folder, turns, docs


def test_each_turn_stays_once(spark, wide):
    folder, turns, _ = wide
    got = {r["conv_id"]: (r["segments"], r["chars"]) for r in plans.QUERIES["window_duplicates"](spark, folder).collect()}
    assert got == {k: (len(own := {(t, x) for c, t, _, x in turns if c == k}), sum(len(x) for _, x in own)) for k in "abc"}


def test_long_conversations_are_exported(spark, wide):
    folder, turns, _ = wide
    clock = lambda s: f"{s // 3600:02}:{s // 60 % 60:02}:{s % 60:02},000"
    want = {}
    for k in "abc":
        own = [f"{role}: {x}" for c, _, role, x in turns if c == k]
        srt = "\n\n".join(f"{n}\n{clock(2 * n - 2)} --> {clock(2 * n)}\n{x}" for n, x in enumerate(own, 1))
        want[k] = (len(own), hashlib.md5(srt.encode()).hexdigest(), hashlib.md5(("\n\n".join(own) + "\n").encode()).hexdigest())
    assert {r["conv_id"]: (r["cues"], r["srt"], r["txt"]) for r in plans.QUERIES["exports"](spark, folder).collect()} == want


def test_wide_marks_are_counted(spark, wide):
    folder, _, docs = wide
    mark = lambda c: unicodedata.category(c)[0] == "P"
    want = {k: (None, None) if x is None else (sum(not mark(c) for c in x), sum(not mark(c) or bool(re.match("[.?!。！？]", c)) for c in x)) for k, x in docs}
    assert {r["doc_id"]: (r["off"], r["sentence_end"]) for r in plans.QUERIES["punctuation_modes"](spark, folder).collect()} == want
