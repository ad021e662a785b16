import random
from collections import Counter, defaultdict

import numpy as np

from chronoloom.llm import components, dart_minhash


def shingle_counts(text):
    w = (text or "").split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def similarity(a, b):
    shared = sum((a & b).values())
    return shared / (sum(a.values()) + sum(b.values()) - shared)


def classes(rows, least=0.8):
    """Brute force: every pair of texts that share a shingle."""
    counts, by, parent = {k: shingle_counts(t) for k, t in rows}, defaultdict(set), {k: k for k, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, c in counts.items():
        for s in c:
            by[s].add(k)
    for k, c in counts.items():
        for o in {o for s in c for o in by[s] if o < k}:
            if similarity(c, counts[o]) >= least:
                a, b = sorted((root(k), root(o)))
                parent[b] = a
    return {k: root(k) for k in parent}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.6, 0.9):
        common = rng.integers(0, 2**63, 400).astype(np.uint64)
        sides = [np.concatenate([common, rng.integers(0, 2**63, int(400 * (1 / share - 1) / 2)).astype(np.uint64)]) for _ in range(2)]
        found = []
        for _ in range(12):
            sides = [s * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1) for s in sides]
            cell, row = dart_minhash.cells(np.concatenate(sides), np.repeat([0, 1], [len(s) for s in sides]))
            s = dart_minhash.dart_signatures(cell, row, 2)
            found.append((s[0] == s[1]).mean())
        assert np.isfinite(s).all() and abs(np.mean(found) - share) < 0.05


def test_weights_count():
    element = np.array([5] * 3 + [7] + [5] * 1 + [7] * 3, np.uint64)
    cell, row = dart_minhash.cells(element, np.array([0] * 4 + [1] * 4))
    a, b = set(cell[row == 0].tolist()), set(cell[row == 1].tolist())
    assert len(a) == len(b) == 4 and len(a & b) == 2


def test_a_row_of_any_weight_is_full():
    for n in (1, 2, 50, 100_000):
        cell, row = dart_minhash.cells(np.arange(n, dtype=np.uint64), np.zeros(n, np.int64))
        assert np.isfinite(dart_minhash.dart_signatures(cell, row, 1)).all()


def test_against_brute_force(spark):
    for folder in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
        want = classes([tuple(r) for r in docs.collect()])
        assert {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(docs).collect()} == want


def test_large_group_of_near_copies(spark):
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        w = list(base)
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(150)] = f"n{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(80))) for i in range(50)]
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows)


def test_large_group_without_a_centre(spark):
    rng = random.Random(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for i in range(120):  # twins change the same three places, so they are at 0.81; others share their buckets at about 0.66
        places = [5 + rng.randrange(8) * 5 + 45 * j for j in range(3)]
        for twin in (0, 1):
            w = list(base)
            for at in places:
                w[at] = f"n{i}x{twin}x{at}"
            rows.append((2 * i + twin, " ".join(w)))
    want = classes(rows)
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 1 and got == want


def test_hard_rows(hard, none):
    rows = dart_minhash.near_duplicates(hard).collect()
    assert len(rows) == hard.count()
    assert {r["class_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    assert all(r["class_id"] == r["doc_id"] for r in rows if r["doc_id"] not in (1, 2))
    kept = dart_minhash.drop_near_duplicates(hard)
    ids = sorted(str(r["doc_id"]) for r in hard.collect() if r["doc_id"] not in (2, 8))
    assert kept.columns == hard.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted([*ids, "8"])
    assert dart_minhash.near_duplicates(none).count() == 0 and dart_minhash.drop_near_duplicates(none).count() == 0


def test_keys_with_several_texts(spark):
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, one), (1, two), (2, two), (3, three), (3, three), (4, one + " more"), (None, one)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as row", "3 as node", "4 as _KEY")
    got = sorted((r["class_id"] or 0, r["class_size"]) for r in dart_minhash.near_duplicates(df).collect())
    assert got == [(0, 1), (1, 2), (1, 2), (1, 2), (1, 2), (3, 2), (3, 2)]
    kept = sorted(((r["doc_id"] or 0), r["text"]) for r in dart_minhash.drop_near_duplicates(df).collect())
    assert kept == [(0, one), (1, one), (1, two), (3, three)]


def test_recall_by_similarity(spark):
    rng, rows, pairs = random.Random(9), [], []
    for i in range(600):  # pairs of 60 words at similarities from 0.8 upwards
        w = [f"w{rng.randint(0, 10**7)}" for _ in range(60)]
        v = list(w)
        if i % 3:
            v[rng.choice([0, 1, 2]) if i % 3 == 1 else 57 + rng.randrange(3)] = "x"
        else:
            v[5] = "x"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
        pairs.append(similarity(shingle_counts(rows[-2][1]), shingle_counts(rows[-1][1])))
    got = {r["doc_id"]: r["class_id"] for r in dart_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 1.01)):
        band = [got[2 * i + 1] == 2 * i for i, s in enumerate(pairs) if low <= s < high]
        assert band and sum(band) >= 0.99 * len(band)


def test_components(spark):
    links = [(1, 2), (3, 2), (10, 11), (12, 11), (5, 5), *((i, i + 1) for i in range(100, 160))]
    found = dict(components.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in found.items() if k < 100} == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10}
    assert {v for k, v in found.items() if k >= 100} == {100} and len(found) == 67
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
