"""Similarity of texts against difflib, and what overlapping windows cost."""

import random
import time
from difflib import SequenceMatcher

import pytest

from chronoloom import plans
from chronoloom.operators import stitching


def test_equals_difflib_where_it_counts():
    draw = random.Random(4)
    for _ in range(3000):
        a, b = ("".join(draw.choice("ab c") for _ in range(draw.randrange(12))) for _ in range(2))
        b = draw.choice([b, a, a + b, b + a, a[1:] + b[:1], a[: len(a) // 2] + "d" + a[len(a) // 2 :]])
        least, want = draw.choice([0.5, 0.82, 0.88]), SequenceMatcher(None, a, b, autojunk=False).ratio()
        got = stitching.similarity(a, b, least)
        assert got == want or (want <= got < least), (a, b)


@pytest.mark.parametrize("a,b,want", [("said in both", "said in both", 1.0), ("heard", "heard!", 10 / 11), ("...heard", "heard", 10 / 13), ("abcdefgh", "ijklmnop", 0.0)])
def test_no_search_for_what_is_seen_at_once(monkeypatch, a, b, want):
    def search(*_):
        raise AssertionError("searched")

    monkeypatch.setattr(SequenceMatcher, "find_longest_match", search)
    assert stitching.similarity(a, b, 0.75) == want


def asked(spark, folder, name, texts):
    """Rows of a query on turns of one conversation, and the seconds that it took."""
    rows = [("a", t, "user", x) for t, x in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    begun = time.monotonic()
    return [tuple(r) for r in plans.QUERIES[name](spark, str(folder)).collect()], time.monotonic() - begun


LONG = "ab" * 40_000


def test_same_speakers_of_long_turns(spark, tmp_path):
    found, seconds = asked(spark, tmp_path, "same_speakers", [LONG, "other"])
    assert sorted(r[:3] for r in found) == [("a", "L0", "user"), ("a", "L1", "user")] and seconds < 60
