"""Dictation streams equal their batch and plain loops."""

import pytest

from chronoloom.plans import dictation_queries as queries
from chronoloom.streaming import dictation


def test_chunks():
    fold = dictation.Chunks()
    out = [x for _ in range(1250) for x in fold.push(320, True)]
    assert out == [(0, 0, 0, 400_000, "hard_limit", 368_000, 32_000)]
    out = [x for i in range(250) for x in fold.push(320, i < 200)]
    assert out == [(1, 368_000, 400_000, 474_560, "semantic_endpoint", None, 0)]
    assert fold.release() == [(2, 442_560, 474_560, fold.at, "release", None, 0)] and fold.release() == []
    silent = dictation.Chunks()
    assert not [x for _ in range(1249) for x in silent.push(320, False)]  # no endpoint without a voice
    with pytest.raises(ValueError):
        fold.push(319, True)


def test_merge():
    merge = dictation.TokenMerge()
    assert merge.push([("one", 0, 10), ("two", 10, 20)]) == [("one", 0, 10), ("two", 10, 20)]
    assert merge.push([("TWO", 12, 21), ("two", 20, 30), ("six", 15, 19), ("new", 19, 25)]) == [("two", 20, 30), ("new", 19, 25)]
    assert merge.push([]) == []


def test_streams_equal_batches(spark, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    last = events.selectExpr("unix_micros(cast(max(ts) as timestamp)) / 1e6").first()[0]
    streamed = sorted(map(tuple, queries.dictation_chunks(spark, small).collect()), key=str)
    batch = sorted(map(tuple, dictation.chunk_batch(queries.frames(events), "user_id", idle=queries.IDLE, until=last - 3600, **queries.SETTINGS).collect()), key=str)
    assert streamed == batch and {r[5] for r in streamed} == {"hard_limit", "semantic_endpoint", "release"}
    assert any(r[7] for r in streamed)
    merged = sorted(map(tuple, queries.merged_tokens(spark, small).collect()))
    assert merged == sorted(map(tuple, dictation.merge_batch(queries.tokens(events), "user_id", horizon=86_400).collect()))
    want = []
    rows = queries.tokens(events).collect()
    for user in {r["user_id"] for r in rows}:
        kept, chunks = [], sorted({r["chunk"] for r in rows if r["user_id"] == user})
        for chunk in chunks:
            reach = max((t[2] for t in kept), default=-1)
            for r in sorted((r for r in rows if (r["user_id"], r["chunk"]) == (user, chunk)), key=lambda r: (r["start"], r["end"], r["text"])):
                shared = [t for t in kept if t[1] < r["end"] and r["start"] < t[2]]
                if not any(t[0].lower() == r["text"].lower() for t in shared) and not (r["end"] <= reach and shared):
                    kept.append((r["text"], r["start"], r["end"]))
        want += [(user, *t) for t in kept]
    assert merged == sorted(want) and 0 < len(want) < len(rows)


def test_state_lasts_over_micro_batches(spark, small, tmp_path):
    """The same chunks when frames come in several files."""
    events = spark.read.parquet(f"{small}/events.parquet").orderBy("ts")
    cut = [r["ts"] for r in events.select("ts").collect()]
    third, two = cut[len(cut) // 3], cut[2 * len(cut) // 3]
    for i, part in enumerate((events.filter(events.ts < third), events.filter((events.ts >= third) & (events.ts < two)), events.filter(events.ts >= two))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = dictation.chunk_stream(queries.frames(source), "user_id", idle=queries.IDLE, lateness=queries.LATENESS, **queries.SETTINGS)
        out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("user_id", "no", "context_start", "core_start", "end", "reason", "replay_start", "replayed").collect()), key=str)
    assert got == sorted(map(tuple, queries.dictation_chunks(spark, small).collect()), key=str)
