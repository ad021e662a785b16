import hashlib
import tempfile

import pytest

from chronoloom.llm import queries, shards


@pytest.fixture
def root():
    return tempfile.mkdtemp(prefix="spark-store-")


def test_round_trip_and_versions(spark, hard, root):
    store = shards.ShardStore(spark, root, target=1 << 20, fan_in=4)
    assert store.version() == 0 and store.shards() == []
    for part in range(5):
        store.append(hard.filter(f"coalesce(doc_id, 0) % 5 = {part}").repartition(2))
    before = store.version()
    old = store.shards(before)
    rows = sorted(map(str, store.read().collect()))
    assert rows == sorted(map(str, hard.collect()))
    after = store.compact()
    assert after > before and len(store.shards()) < len(old) and sorted(map(str, store.read().collect())) == rows
    assert sorted(map(str, store.read(old).collect())) == rows
    assert store.vacuum() == 0
    assert store.vacuum(older_than=0, keep=1) >= len(old) and sorted(map(str, store.read().collect())) == rows
    assert sum(s.rows for s in store.shards()) == hard.count()


def test_of_two_writers_one_fails(spark, hard, root):
    store = shards.ShardStore(spark, root)
    store.append(hard)
    with pytest.raises(shards.CommitConflict):
        store._commit(1, [], [])
    assert store.version() == 1 and len(store.read().collect()) == hard.count()


def test_a_slower_append_goes_on_top(spark, root):
    store, other = (shards.ShardStore(spark, root) for _ in "ab")
    one, two = (spark.range(a, a + 5).toDF("doc_id") for a in (0, 100))
    write = store._write

    def slow(df, by=None):
        new = write(df, by)
        other.append(two)
        return new

    store._write = slow
    store.append(one)
    assert store.version() == 2 and sorted(r[0] for r in store.read().collect()) == [*range(5), *range(100, 105)]


def test_compaction_beside_another_writer(spark, root):
    store, other = (shards.ShardStore(spark, root, fan_in=2) for _ in "ab")
    for i in range(4):
        store.append(spark.range(i, i + 1).toDF("doc_id"))
    write = store._write

    def slow(df, by=None):
        new = write(df, by)
        store._write = write
        other.append(spark.range(50, 51).toDF("doc_id"))
        other.compact()
        return new

    store._write = slow
    store.compact()
    assert sorted(r[0] for r in store.read().collect()) == [0, 1, 2, 3, 50]


def test_columns_of_all_arrivals_stay(spark, root):
    store = shards.ShardStore(spark, root, fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    store.append(spark.createDataFrame([(2, "b", 7, "c")], "doc_id long, text string, extra int, arrival string"))
    store.append(spark.createDataFrame([(9,)], "other long"))
    store.tier = lambda shard: 1
    store.compact()
    assert len(store.shards()) == 1
    got = sorted(str(tuple(r)) for r in store.read().select("doc_id", "text", "extra", "arrival", "other").collect())
    assert got == sorted(map(str, [(1, "a", None, None, None), (2, "b", 7, "c", None), (None, None, None, None, 9)]))


def test_vacuum_leaves_a_writers_shards(spark, root):
    store = shards.ShardStore(spark, root)
    store.append(spark.range(3).toDF("doc_id"))
    new = store._write(spark.range(10, 13).toDF("doc_id"))
    shards.ShardStore(spark, root).vacuum()
    store._commit(2, new, [])
    assert store.read().count() == 6


def test_manifests_hold_changes(spark, root, monkeypatch):
    monkeypatch.setattr(shards, "FULL", 4)
    store, want = shards.ShardStore(spark, root, fan_in=3), {}
    for i in range(7):
        store.append(spark.range(i, i + 1).toDF("doc_id"))
        if i % 3 == 2:
            store.compact()
        want[store.version()] = sorted(s.path for s in store.shards())
    for version, paths in want.items():
        assert sorted(s.path for s in store.shards(version)) == paths
    store.vacuum(older_than=0, keep=2)
    assert sorted(s.path for s in store.shards()) == want[store.version()] and sorted(r[0] for r in store.read().collect()) == list(range(7))


def test_tiers_and_plan(spark, root):
    store = shards.ShardStore(spark, root, target=128, fan_in=4)
    shard = lambda i, size: shards.Shard(f"shards/x/{i}", 1, size, i)
    assert [store.tier(shard(0, s)) for s in (500, 64, 63, 17, 15, 4, 3)] == [0, 0, 1, 1, 2, 3, 3]
    store.shards = lambda version=None: [shard(i, 10) for i in range(30)] + [shard(99, 100)]
    groups = store.plan()
    assert all(sum(s.size for s in g) <= 128 for g in groups) and sum(map(len, groups)) in (29, 30)


def test_empty_store(spark, none, root):
    store = shards.load_in_waves(spark, root, none)
    assert store.version() > 0 and shards.shard_rows(store).count() == 0


def test_query_against_brute_force(spark, small):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op5_shards(spark, small).collect()
    assert len(rows) == len(texts) and all(r["text_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in rows)
