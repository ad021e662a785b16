"""Segments of overlapping windows, many runs at once, against a fold of each recording as a whole."""

import random
import time
from difflib import SequenceMatcher

import pytest

from chronoloom import plans
from chronoloom.operators import stitching

SEGMENTS = "k string, window long, start long, end long, text string, score double"
LONG = "ab" * 40_000


def plain(rows):
    """What stays of the segments of a recording."""
    kept = []
    for row in sorted(rows, key=lambda r: (r[1], r[0], r[2], r[3], r[4])):
        for i, other in enumerate(kept):
            shared = min(row[2], other[2]) - max(row[1], other[1])
            ratio = SequenceMatcher(None, row[3], other[3], autojunk=False).ratio()
            if row[0] != other[0] and other[2] > row[1] and shared > 0 and (ratio == 1 or ratio >= 0.88 and shared / max(1, min(row[2] - row[1], other[2] - other[1])) >= 0.15):
                kept[i] = max(other, row, key=lambda r: (r[4], len(r[3]), -r[0]))
                break
        else:
            kept.append(row)
    return kept


def test_runs_are_folded_as_recordings_are(spark):
    draw, rows = random.Random(9), []
    for k in range(40):
        for n in range(60):
            start = 40_000 * n + draw.randrange(60_000)
            text = draw.choice(["well known words", "well known word", "other", "", "yes", "yess", "a longer text of words"])
            rows += [(f"k{k}", w, start, start + draw.choice([900, 50_000]), text + draw.choice(["", "", "!"]), draw.choice([0.25, 0.5])) for w in draw.choice([(n,), (n, n + 1)])]
    got = stitching.drop_window_duplicates(spark.createDataFrame(rows, SEGMENTS), "k").collect()
    assert sorted(map(tuple, got)) == sorted((k, *r) for k in {r[0] for r in rows} for r in plain([r[1:] for r in rows if r[0] == k]))


@pytest.mark.parametrize("name,chars", [("window_duplicates", 2 * len(LONG) + 3), ("window_variants", 2 * len(LONG) + 2 + 3 + 4)])
def test_long_turns_heard_twice(spark, tmp_path, name, chars):
    rows = [("a", 0, LONG), ("a", 1, LONG), ("a", 2, "abc")]
    spark.createDataFrame(rows, "conv_id string, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    begun = time.monotonic()
    found = [tuple(r) for r in plans.QUERIES[name](spark, str(tmp_path)).collect()]
    assert found == [("a", 3 if name == "window_duplicates" else 4, chars)] and time.monotonic() - begun < 60


def test_a_run_is_no_group_of_its_own(spark):
    """A group costs Python some milliseconds, however few its rows are."""
    df = spark.createDataFrame([("a", 0, 0, 900, "said", 0.5)], SEGMENTS)
    plan = stitching.drop_window_duplicates(df, "k")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
