import numpy as np
from pyspark.sql import functions as F

from chronoloom.llm import hard_negatives as hn
from chronoloom.llm import queries

SCHEMA = "vec_id long, embedding array<double>, label int, rank string, score string"


def plain(rows, anchor, positives=5, negatives=10):
    """All pairs in Python integers."""
    best = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        best[key] = min(best.get(key, (label, vector)), (label, vector))
    out = set()
    for a, (label, vector) in best.items():
        if not anchor(a):
            continue
        scored = sorted((-sum(int(x) * int(y) for x, y in zip(vector, v, strict=False)), k, other) for k, (other, v) in best.items() if k != a)
        for p, positive, other in [s for s in scored if s[2] == label][:positives]:
            fits = [(-s, k) for s, k, o in scored if o != label and 30 * -p <= 100 * -s <= 90 * -p]
            out |= {(a, positive, i + 1, k, -p, s) for i, (s, k) in enumerate(fits[:negatives])}
    return out


def found(df):
    rows = df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(set(map(tuple, rows))) == len(rows)
    return set(map(tuple, rows))


def test_query_equals_all_pairs(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    floored = [(r["vec_id"], [np.floor(256.0 * x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in rows]
    assert found(queries.op13_hard_negatives(spark, small)) == plain(floored, lambda k: k % 100 == 0)


def test_clusters_ties_and_repeats(spark):
    """Anchors in several clusters, blocks that one cluster's bound rules out, many equal scores, and rows that repeat."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(6, 12)) * 60
    rows = [(i, [float(round(x)) for x in centres[i % 6] + draw.normal(size=12) * (3 if i % 2 else 25)], int(draw.integers(3))) for i in range(900)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(40)] + [(5, rows[5][1], rows[5][2]), (7, rows[8][1], rows[7][2])]
    rows += [(2000, [0.0] * 12, 0), (2010, [-1.0, 2.0], 1), (2020, [], 2), (2030, [-90.0] * 12, 7), (2040, [90.0] * 12, 7)]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], SCHEMA)
    want = plain(rows, lambda k: k % 10 == 0)
    assert len(want) > 500
    assert found(hn.hard_negatives(df, F.col("vec_id") % 10 == 0, per_cluster=8, block=64)) == want
    assert found(hn.hard_negatives(df, F.col("vec_id") % 10 == 0)) == want


def test_rows_without_part(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [4.0, 0.0], 1), (2, [3.0, 9.0], 2), (3, None, 2), (4, [3.0, None], 2), (5, [3.0, float("nan")], 2), (6, [3.0, float("inf")], 2), (7, [3.0, 0.0], None), (None, [3.0, 0.0], 2), (200, [5.0, 5.0], 9)]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], SCHEMA)
    assert found(hn.hard_negatives(df, F.col("vec_id") % 100 == 0)) == {(100, 1, 1, 2, 4, 3)} == plain(rows, lambda k: k % 100 == 0)
    assert hn.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert hn.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0


def test_walk_stops_once_certified(monkeypatch):
    """Members near the centroid look at the front of their list only."""
    draw = np.random.default_rng(5)
    centre = np.zeros(16)
    centre[0] = 1.0
    members = hn.Block(np.arange(20), np.zeros(20, int), np.round(centre * 500 + draw.normal(size=(20, 16)) * 5))
    far = np.round(draw.normal(size=(20_000, 16)) * 60)
    close = np.round(centre * 500 + draw.normal(size=(200, 16)) * 20)
    block = hn.Block(np.arange(100, 20_300), np.zeros(20_200, int), np.concatenate((far, close)))
    scored, products = [], hn.products
    monkeypatch.setattr(hn, "products", lambda a, b: scored.append(a.shape[0] * b.shape[0]) or products(a, b))
    asks = hn.Asks(np.arange(20), np.full(20, -1e15), np.full(20, 1e15), np.full(20, -1e15))
    ask, row, score = hn.walk(members, asks, centre, block, True, 5)
    assert sum(scored) < 0.2 * 20 * 20_200
    whole = products(members.vector, block.vector)
    for i in range(20):
        order = np.lexsort((block.key, -whole[i]))[:5]
        assert row[ask == i].tolist() == order.tolist() and score[ask == i].tolist() == whole[i][order].tolist()


def test_large_components_stay_exact():
    a, b = np.array([[2.0**40, 1.0]]), np.array([[2.0**20, 3.0], [2.0**62, 0.0]])
    assert hn.products(a, b).tolist() == [[2**60 + 3, 2**63 - 1]]
