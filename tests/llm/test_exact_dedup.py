import hashlib
import re
from collections import defaultdict

import pytest

from chronoloom.llm import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(key)
    out = []
    for text, keys in groups.items():
        keys.sort(key=lambda k: (k is None, k or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(k, keys[0], len(keys), i == 0, digest) for i, k in enumerate(keys)]
    return sorted(map(str, out))


@pytest.mark.parametrize("bits", [128, 1024, exact_dedup.MOST_BITS])
def test_hard_rows(hard, bits):
    got = [tuple(r) for r in exact_dedup.mark_copies(hard, most_bits=bits).collect()]
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert sorted(map(str, got)) == brute(rows)
    kept = exact_dedup.drop_copies(hard, most_bits=bits)
    assert kept.columns == hard.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(g[0]) for g in got if g[3])


def test_large_groups(spark):
    rows = [(i, f"text {i % 7 if i % 3 else i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(map(str, (tuple(r) for r in exact_dedup.mark_copies(df).collect()))) == brute(rows)


def test_most_rows_pass_without_a_shuffle(spark):
    df = spark.range(5000).selectExpr("id as doc_id", "concat('t', if(id < 10, 0, id)) as text")
    hashed = exact_dedup._hashed(df, "doc_id", "text")
    alone, candidates = exact_dedup._split(hashed, 1 << 17)
    assert candidates.filter("key < 10").count() == 10
    assert candidates.count() < 300 and alone.count() + candidates.count() == 5000


@pytest.mark.parametrize("broadcast", [True, False])
def test_many_ranges_and_large_groups(spark, monkeypatch, broadcast):
    rows = [(i % 1900 if i % 5 else None, f"text {i % 7 if i % 3 == 0 else i % 1500}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as sha", "1 as keep", "2 as _possible", "text as group_rows").repartition(5)
    if not broadcast:
        monkeypatch.setattr(exact_dedup, "if_small", lambda df: df)
        monkeypatch.setattr(exact_dedup, "LARGE", 100)
    got = [tuple(r) for r in exact_dedup.mark_copies(df, most_bits=1 << 14).collect()]
    assert sorted(map(str, got)) == brute(rows)
    kept = exact_dedup.drop_copies(df, most_bits=1 << 14)
    assert kept.columns == df.columns and {r["sha"] for r in kept.collect()} == {"mine"}
    assert sorted((r["doc_id"] or -1, r["text"]) for r in kept.collect()) == sorted((g[0] or -1, t) for g, t in [(g, next(t for k, t in rows if hashlib.sha256(t.encode()).hexdigest() == g[4])) for g in got if g[3]])


def test_empty(none):
    assert exact_dedup.mark_copies(none).count() == 0 and exact_dedup.drop_copies(none).count() == 0
