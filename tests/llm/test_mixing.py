import random

from chronoloom.llm import mixing


def fill(sizes, weights, most=3):
    """Targets by resharing until no source is above its bound."""
    total, full = sum(sizes), set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        left = total - sum(most * sizes[i] for i in full)
        w = sum(weights[i] for i in rest)
        over = [i for i in rest if left * weights[i] > most * sizes[i] * w]
        if not over:
            return [most * sizes[i] if i in full else left * weights[i] / w for i in range(len(sizes))]
        full |= set(over)


def test_targets_equal_resharing(spark):
    rng = random.Random(3)
    for _ in range(8):
        sizes = [rng.choice([0, 1, 5, 50, 900, 10_000]) for _ in range(rng.randint(1, 12))]
        sizes[0] = max(sizes[0], 1)
        names = sorted(f"s{i}" for i in range(len(sizes)))
        rows = [(n, s, 1 + i % 3) for i, (n, s) in enumerate(zip(names, sizes, strict=True))]
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long, weight long")).collect()}
        for (n, _, _), t in zip(rows, fill(sizes, [r[2] for r in rows]), strict=True):
            assert abs(got[n] - t) < 1e-6 * max(1, t)


def test_hard_rows(hard, none):
    planned = mixing.plan_mixture(hard)
    rows = planned.collect()
    assert len(rows) == hard.count() and [c for c in planned.columns if c == "size"] == ["size"]
    assert sum({r["source"]: r["target"] for r in rows}.values()) == sum(r["size"] for r in rows)
    assert all(0 <= r["copies"] <= 3 for r in rows)
    assert {r["size"] for r in rows if r["text"] is None or not r["text"].strip()} == {0}
    assert len({r["copies"] for r in rows if r["doc_id"] == 8}) == 1
    emitted = mixing.emit_mixture(planned).collect()
    assert len(emitted) == sum(r["copies"] for r in rows)
    assert sorted(map(str, planned.collect())) == sorted(map(str, rows))
    assert mixing.plan_mixture(none).count() == 0


def test_taken_words_are_near_their_targets(spark):
    for folder, near in (("sf0.01", 0.02), ("sf0.1", 0.002)):
        planned = mixing.plan_mixture(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "source", "text"))
        for r in planned.selectExpr("source", "target", "size * copies as n").groupBy("source", "target").sum("n").collect():
            assert abs(r["sum(n)"] - r["target"]) <= near * r["target"], r


def test_clashing_names(hard):
    docs = hard.selectExpr("*", "'s' as of_source", "'d' as _DRAW", "'d' as draw", "'c' as hashed", "'w' as weight")
    planned = mixing.plan_mixture(docs)
    assert {(r["of_source"], r["draw"], r["_DRAW"], r["hashed"], r["weight"]) for r in planned.collect()} == {("s", "d", "d", "c", "w")}


def test_no_python_in_plan(hard):
    plan = mixing.emit_mixture(mixing.plan_mixture(hard))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
