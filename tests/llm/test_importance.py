import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.llm import importance, queries


def test_scores_equal_a_plain_loop():
    ratio = np.random.default_rng(1).normal(size=importance.EVENTS)
    texts = ["", "ab", "the the cat", "één twee twee drie", None, "a b c d " * 50]
    got = importance.RatioModel(ratio).score(pa.array(texts))
    bits, size = 2**64 - 1, importance.BUCKETS

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & bits
        x = (x ^ x >> 27) * 0x94D049BB133111EB & bits
        return x ^ x >> 31

    def word(w):
        return mix(sum((c + 1) * 0x9E3779B97F4A7C15**i for i, c in enumerate(w.encode())) & bits)

    for text, score in zip(texts, got, strict=True):
        data, w = (text or "").encode(), [word(x) for x in (text or "").split()]
        grams = [((data[i] | data[i + 1] << 8 | data[i + 2] << 16) * 2654435761 % 2**32) >> 16 for i in range(len(data) - 2)]
        pairs = [importance.REPEAT if a == b else 2 * size + mix(a * 0x9E3779B97F4A7C15 + b & bits) % size for a, b in zip(w, w[1:], strict=False)]
        families = [grams, [size + mix(x) % size for x in w], pairs]
        if not any(families):
            assert math.isnan(score)
            continue
        assert abs(score - sum(sum(ratio[e] for e in f) / (len(f) + importance.NEUTRAL) for f in families)) < 1e-9


def test_kth_largest(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.gauss(0, 1), 0.5, -2.0]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").checkpoint()
    for k in (1, 2, 17, 1500, 2999, 3000, 5000):
        assert importance.kth_largest(df, "v", k, bins=8) == sorted(values, reverse=True)[min(k, len(values)) - 1]
    assert importance.kth_largest(df, "v", 0) == float("inf")


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op3_importance(spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    good = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 1]
    poor = [got[r["doc_id"]]["kept"] for r in labels if r["quality"] == 0]
    assert sum(good) >= 0.98 * len(good) and sum(poor) <= 0.1 * len(poor)


def test_take_is_a_top_k(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    for temperature in (importance.TEMPERATURE, 1.0):
        rows = importance.resample(docs, labels, take=100, temperature=temperature).collect()
        kept = [r["gumbel_score"] for r in rows if r["kept"]]
        assert len(kept) == 100 and min(kept) >= max(r["gumbel_score"] for r in rows if not r["kept"] and r["gumbel_score"] is not None)
        # the draw takes others than the hundred largest ratios
        assert {r["doc_id"] for r in rows if r["kept"]} != {r["doc_id"] for r in sorted(rows, key=lambda r: -(r["log_ratio"] or -9))[:100]}
        for r in rows:
            assert r["log_ratio"] is None or abs(r["gumbel_score"] - r["log_ratio"] - temperature * noise(r["doc_id"])) < 1e-9


def noise(key):
    """The seeded Gumbel noise in plain Python."""
    u = int(hashlib.md5(f"gumbel{key}".encode()).hexdigest()[:13], 16) / 2**52 + 0.5 / 2**52
    return -math.log(-math.log(u))


def test_query_equals_a_plain_model(spark, small):
    """Counts, ratios, cut and take by dictionaries over the whole table."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    sample = {r["label_key"]: (r["good"], r["fit"]) for r in importance.labelled_sample(spark.read.parquet(f"{small}/labels.parquet")).collect()}
    raw, target = Counter(), Counter()
    events = {}
    for key, text in docs:
        data = np.frombuffer((text or "").encode(), np.uint8)
        events[key] = [e.tolist() for e, _ in importance._events(data, np.array([0, len(data)]))]
        for i, family in enumerate(events[key]):
            raw.update((i, e) for e in family)
            if sample.get(key) == (True, True):
                target.update((i, e) for e in family)
    share = [sum(n for (f, _), n in target.items() if f == i) / max(1, sum(n for (f, _), n in raw.items() if f == i)) for i in range(3)]
    score = {k: sum(sum(math.log((target[i, e] + 1) / (raw[i, e] * share[i] + 1)) for e in f) / (len(f) + importance.NEUTRAL) for i, f in enumerate(fs)) if any(fs) else None for k, fs in events.items()}
    cut = importance.best_cut([(score[k], good) for k, (good, fit) in sample.items() if not fit and score.get(k) is not None])
    take = sum(s is not None and s >= cut for s in score.values())
    drawn = sorted((s + importance.TEMPERATURE * noise(k) for k, s in score.items() if s is not None), reverse=True)
    got = {r["doc_id"]: r for r in queries.op3_importance(spark, small).collect()}
    assert got.keys() == score.keys() and all(s is None and got[k]["log_ratio"] is None or abs(got[k]["log_ratio"] - s) < 1e-9 for k, s in score.items())
    assert sum(r["kept"] for r in got.values()) == take and min(r["gumbel_score"] for r in got.values() if r["kept"]) == pytest.approx(drawn[take - 1])


def test_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1, 0), (9, 0, 0), (9, 1, 0), (None, 1, 0), (6, None, 1)], "doc_id long, quality int, toxic int")
    out = importance.resample(hard, labels)
    rows = out.collect()
    assert len(rows) == hard.count() and out.columns.count("kept") == 1
    assert all(not r["kept"] and r["log_ratio"] is None for r in rows if r["text"] in (None, ""))
    assert importance.resample(none, labels).count() == 0
    assert importance.resample(hard, labels.limit(0)).filter("kept").count() == sum(1 for r in rows if r["log_ratio"] is not None)
