import random
from collections import defaultdict

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronoloom.functions import scores, text, timeline
from chronoloom.operators import consensus, evaluation, intervals, readability, relational, repetition, stitching, subtitles
from chronoloom.sources import exports, gold
from chronoloom.streaming import folds, sessions


def spans_of(spark, rows):
    return spark.createDataFrame(rows, "k string, start long, end long, label string")


@pytest.fixture(scope="module")
def cover():
    rng = random.Random(8)
    return [(rng.choice("ab"), s := rng.randint(0, 400), s + rng.randint(0, 40), rng.choice("xyz")) for _ in range(120)]


def cells(rows, k, **only):
    return {t for key, s, e, label in rows if key == k and only.get("label", label) == label for t in range(s, e)}


def test_union_intersection_subtraction(spark, cover):
    df = spans_of(spark, cover)
    got = {r["k"]: r["covered"] for r in intervals.union_length(df, ["k"]).collect()}
    assert got == {k: len(cells(cover, k)) for k in "ab"}
    small = intervals.merge_spans(df, ["k"], slice_width=7).groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.count("*").alias("c")).collect()
    assert {r["k"]: r["n"] for r in small} == got
    x, y = df.filter("label = 'x'"), df.filter("label = 'y'")
    both = {r["k"]: r["common"] for r in intervals.intersection_length(x, y, ["k"]).collect()}
    assert both == {k: n for k in "ab" if (n := len(cells(cover, k, label="x") & cells(cover, k, label="y")))}
    left = intervals.subtract(x, y, ["k"])
    for k in "ab":
        want = sum(len(set(range(s, e)) - cells(cover, k, label="y")) for key, s, e, label in cover if key == k and label == "x")
        assert sum(r["end"] - r["start"] for r in left.filter(F.col("k") == k).collect()) == want


def test_overlap_join_equals_all_pairs(spark, cover):
    df = spans_of(spark, cover)
    got = sorted((r["k"], r["l_start"], r["l_end"], r["r_start"], r["r_end"], r["shared"]) for r in intervals.overlap_join(df.filter("label='x'"), df.filter("label='z'"), ["k"], bucket=16).collect())
    want = sorted((k, s, e, a, b, min(e, b) - max(s, a)) for k, s, e, l in cover if l == "x" for j, a, b, m in cover if (j, m) == (k, "z") and min(e, b) > max(s, a))
    assert got == want


def test_concurrent_spans(spark, cover):
    got = defaultdict(set)
    for r in intervals.concurrent(spans_of(spark, cover), ["k"], "label").collect():
        for t in range(r["start"], r["end"]):
            got[r["k"], t] = set(r["labels"])
    for k in "ab":
        for t in range(450):
            want = {l for key, s, e, l in cover if key == k and s <= t < e}
            assert got.get((k, t), set()) == (want if len(want) > 1 else set())


def test_windows(spark):
    totals = spark.createDataFrame([("a", 100), ("b", 30), ("c", 0), ("d", 205)], "k string, total long")
    got = defaultdict(list)
    for r in intervals.sliding_windows(totals, width=50, step=20).orderBy("start").collect():
        got[r["k"]].append((r["start"], r["end"]))
    assert got == {"a": [(0, 50), (20, 70), (40, 90), (50, 100)], "b": [(0, 30)], "d": [(s, s + 50) for s in (*range(0, 156, 20), 155) if s <= 155]}
    bounded = defaultdict(list)
    for r in intervals.bounded_windows(totals, width=100, shared=10, least=40).orderBy("ordinal").collect():
        bounded[r["k"]].append((r["start"], r["end"]))
    assert bounded == {"a": [(0, 100)], "b": [(0, 30)], "d": [(0, 100), (90, 190), (165, 205)]}


def test_timeline_functions(spark):
    row = spark.range(1).select(timeline.clock(F.lit(16000 * 3661 + 8)).alias("c"), timeline.milliseconds(F.lit(8)).alias("h"), timeline.samples(F.lit(3)).alias("s"), timeline.parts(F.lit(0), F.lit(10), 3).alias("p")).first()
    assert (row["c"], row["h"], row["s"], [(p["start"], p["end"]) for p in row["p"]]) == ("01:01:01.001", 1, 48, [(0, 3), (3, 6), (6, 10)])


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(text.words(F.lit("It's 1,234.5 o’clock a_b"))) == ["It's", "1,234.5", "o’clock", "a", "b"]
    assert one(text.unpaired(F.lit("(a [b) c] )"))) == 1
    assert one(text.redacted(F.lit("x Bearer abc hf_0123456789abcdefg"))) == "x [REDACTED] [REDACTED]"
    assert one(text.punctuated(F.lit("a, b. c!"), "sentence_end")) == "a b. c!" and one(text.punctuated(F.lit("a, b."), "off")) == "a b"
    assert one(text.occurrences(F.lit("aaaa"), F.lit("aa"))) == 2 and one(text.fold_kana(F.lit("カタ"))) == "かた"
    assert one(text.sentences(F.lit("One 1. Two! …\nthree"))) == ["One 1", "Two", "three"]
    layers = [one(f) for f in (text.layer_not_blank(F.lit(" "), F.lit("s"), F.lit("f")), text.layer_as_set(F.lit(""), F.lit("s"), F.lit("f"))[0], text.layer_coalesced(F.lit(None), F.lit(""), F.lit("f")))]
    assert layers == ["s", "", "f"]


def test_scores(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(scores.error_rate(F.lit(0), F.lit(0), F.lit(0))) == 0 and one(scores.error_rate(F.lit(2), F.lit(0), F.lit(2))) == 1
    assert one(scores.f1(F.lit(0.0), F.lit(0.0))) == 0 and abs(one(scores.sigmoid(F.lit(-800.0)))) < 1e-300
    assert one(scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == -1
    assert one(scores.truncated_percentile(F.array(*map(F.lit, [1000, 900, 100])), 0.95)) == 900


@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_edit_distance(a, b):
    table = [[max(i, j) if not (i and j) else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = min(table[i - 1][j] + 1, table[i][j - 1] + 1, table[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
    assert evaluation.edit_distance(a, b) == table[-1][-1]
    path = consensus.align(a, b)
    assert [i for i, _ in path if i is not None] == list(range(len(a))) and [j for _, j in path if j is not None] == list(range(len(b)))
    assert sum(i is None or j is None or a[i] != b[j] for i, j in path) == table[-1][-1]


def test_greedy_pairs(spark):
    rng = random.Random(2)
    rows = [(k, f"l{i}", f"r{j}", rng.randint(0, 5)) for k in "ab" for i in range(5) for j in range(4)]
    got = sorted(tuple(r) for r in evaluation.greedy_pairs(spark.createDataFrame(rows, "k string, l string, r string, w long"), ["k"], "l", "r", "w").collect())
    want, used = [], set()
    for k, left, right, w in sorted(rows, key=lambda x: (x[0], -x[3], x[1], x[2])):
        if (k, left) not in used and (k, right) not in used:
            used |= {(k, left), (k, right)}
            want.append((k, left, right, w))
    assert got == sorted(want)


def test_isotonic_and_votes(spark):
    edges, values = evaluation.pooled(pd.Series([1.0, 2.0, 3.0, 4.0]), pd.Series([0.0, 1.0, 0.0, 1.0]), pd.Series([1.0] * 4))
    assert edges.tolist() == [1, 2, 4] and values.tolist() == [0, 0.5, 1]
    df = spark.createDataFrame([("k", "", 1.0), ("k", "a", 1.0), ("k", "b", 0.5)], "k string, t string, w double")
    assert evaluation.votes(df, ["k"], "t", "w").first()["t"] == ""


def test_repetition():
    assert repetition.repeated_suffix("x a b a b a b a b".split()) == 2 and repetition.repeated_suffix("a a a".split()) is None
    assert repetition.has_token_loop("q w e q w e q w e q w e z".split()) and not repetition.has_token_loop("q w e q w e q w e z".split())


@settings(max_examples=60)
@given(st.text(alphabet="ab .!?\n1", max_size=60))
def test_sentences_part_the_text(value):
    cuts = readability.sentence_cuts(value)
    assert "".join(value[a:b] for a, b in cuts) == value and all(a < b for a, b in cuts)


def test_sentences_keep_abbreviations():
    value = "Dr. Smith paid 3.5 dollars. He left! Really?"
    assert [value[a:b].strip() for a, b in readability.sentence_cuts(value)] == ["Dr. Smith paid 3.5 dollars.", "He left!", "Really?"]


@pytest.mark.parametrize(
    "value,pieces",
    [
        ("Take item x. Next one.", ["Take item x.", "Next one."]), ("the U.S. It sold.", ["the U.S. It sold."]), ("By J. Smith. And J. said", ["By J. Smith.", "And J.", "said"]), ("at 3 p.m. we left", ["at 3 p.m. we left"]),
        ("v1.2 and a.b, x.Y.", ["v1.2 and a.b, x.Y."]), ('He said "no!" Then?! Yes', ['He said "no!"', "Then?!", "Yes"]), ("はい。いいえ！」次", ["はい。", "いいえ！」", "次"]), ("a\n \nb\nc", ["a", "b\nc"]), (" . x", [".", "x"]), ("Fig. 3 vs. no. 4... End", ["Fig. 3 vs. no. 4...", "End"]),
    ],
)
def test_sentence_rules(value, pieces):
    cuts = readability.sentence_cuts(value)
    assert [value[a:b].strip() for a, b in cuts] == pieces and "".join(value[a:b] for a, b in cuts) == value


def test_subtitles_cover_all_words():
    words = ("word " * 40 + "costs 12 dollars. Next").split()
    cues = subtitles.cut_cues(words)
    assert [w for a, b in cues for w in words[a:b]] == words and all(b - a <= subtitles.MOST_WORDS for a, b in cues)


def frames(rng):
    at, out = 0, []
    for _ in range(200):
        at += rng.choice([0, 100, 5000])
        out.append((at, at + 500, rng.random()))
        at += 500
    return out


def test_session_fold_equals_the_window_form(spark):
    rng = random.Random(6)
    rows = [(k, *f) for k in ("a", "b") for f in frames(rng)]
    df = spark.createDataFrame(rows, "k string, start long, end long, score double")
    settings_ = {"threshold": 0.5, "silence": 900, "least": 700, "pad": 150}
    fold = sorted(map(tuple, sessions.speech_sessions_batch(df, "k", **settings_).collect()))
    window = intervals.sessions(df, ["k"], active=F.col("score") >= 0.5, silence=900, least=700, pad=150)
    assert fold == sorted((r["k"], r["start"], r["end"], r["score"]) for r in window.collect()) and fold


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(k, *f, False) for k in ("a", "b") for f in frames(rng)] + [(k, 10**7, 10**7, 0.0, True) for k in ("a", "b")]
    schema = "k string, start long, end long, score double, final boolean"
    for part in range(3):
        chunk = [r for i, r in enumerate(sorted(rows, key=lambda r: r[1])) if i * 3 // len(rows) == part]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = sessions.speech_sessions_stream(stream, "k", threshold=0.5, silence=900, least=700, pad=150)
    run = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    batch = sessions.speech_sessions_batch(spark.createDataFrame(rows, schema), "k", threshold=0.5, silence=900, least=700, pad=150)
    assert got == sorted(map(tuple, batch.collect()))


def test_folds():
    router = folds.Router()
    assert [router.push(*x) for x in [("en", 0.9), ("de", 0.9), (None, None), ("de", 0.9), ("en", 0.5), ("en", 0.9)]] == ["en", "en", "en", "de", "de", "de"]
    chunker, out = folds.Chunker(limit=1000, least=300, pause=200), []
    for i in range(30):
        out += chunker.push(i * 100, 100, i not in (4, 5, 6))
    out += chunker.flush()
    assert [o[:2] for o in out] == [(0, 600), (600, 1600), (1600, 2600), (2600, 3000)]
    with pytest.raises(ValueError, match="frame"):
        folds.Chunker().push(0, 10, True) or (c := folds.Chunker()).push(0, 10, True) or c.push(20, 10, True)
    prefix = folds.StablePrefix(hold=100)
    assert prefix.push([("a", 0, 50, True), ("b", 50, 90, False)], 200) == [("a", 0, 50)] and prefix.flush() == [("b", 50, 90)]


def test_stitching(spark):
    rows = [("r", 0, 0, 100, "hello there my friend", 0.5), ("r", 1, 10, 100, "hello there my friend", 0.9), ("r", 1, 200, 300, "something else", 0.5)]
    kept = stitching.drop_window_duplicates(spark.createDataFrame(rows, "k string, window long, start long, end long, text string, score double"), "k").collect()
    assert sorted((r["window"], r["start"]) for r in kept) == [(1, 10), (1, 200)]
    assert stitching.boundary_overlap("a b C d".split(), "c D e".split()) == 2
    tracks = [("r", 0, "A", [1.0, 0.0], 1.0), ("r", 0, "B", [0.0, 1.0], 1.0), ("r", 1, "X", [0.1, 0.9], 1.0), ("r", 1, "Y", [0.9, 0.1], 1.0)]
    got = {(r["window"], r["label"]): r["speaker"] for r in stitching.track_speakers(spark.createDataFrame(tracks, "k string, window long, label string, vector array<double>, weight double"), "k").collect()}
    assert got[1, "X"] == got[0, "B"] and got[1, "Y"] == got[0, "A"]
    assert stitching.chunk_ends(100, [(28, 1, 0.5), (33, 0, 0.1), (64, 1, 0.9)], 30, 20, 40) == [33, 64, 100]


def test_scans_and_exports(spark, tmp_path):
    (tmp_path / "terms.csv").write_text("﻿canonical,reading,aliases,weight,confirmation\nAlpha,,a;b |c,0.9,confirmed\nBeta,be,,0.9,\n ,x,,,\n")
    terms = {r["canonical"]: r for r in gold.read_terms(spark, str(tmp_path / "terms.csv"), "en").collect()}
    assert set(terms) == {"Alpha", "Beta"} and terms["Alpha"]["aliases"] == ["a", "b", "c"] and (terms["Alpha"]["weight"], terms["Beta"]["weight"]) == (0.9, 0.3)
    items = spark.createDataFrame([("i", "a.wav", "train", 0, 5, "x"), ("i", "a.wav", "test", 5, 5, "")], "item_id string, audio string, split string, start_sample long, end_sample long, text string").withColumn("tags", F.array().cast("array<string>"))
    assert {r["fault"] for r in gold.gold_faults(items).collect()} == {"repeated id", "audio in several splits", "span out of order", "empty text"}
    cues = spark.createDataFrame([("k", 2, 16000, 32000, "b", None), ("k", 1, 0, 16000, "a", "S")], "k string, n long, start long, end long, text string, speaker string")
    assert exports.render_srt(cues, "k").first()["content"] == "1\n00:00:00,000 --> 00:00:01,000\na\n\n2\n00:00:01,000 --> 00:00:02,000\nb"
    assert exports.render_vtt(cues, "k").first()["content"].startswith("WEBVTT\n\n00:00:00.000") and "· S" in exports.render_markdown(cues, "k").first()["content"]


def test_relational(spark):
    base = spark.createDataFrame([(1, "a", True), (2, "b", False)], "k long, v string, held boolean")
    new = spark.createDataFrame([(1, "A", False), (2, "B", False), (3, "C", False)], "k long, v string, held boolean")
    assert {r["k"]: r["v"] for r in relational.upsert(base, new, ["k"], keep=F.col("held")).collect()} == {1: "a", 2: "B", 3: "C"}
    assert relational.page(base, [F.col("k")], limit=500).first()["total"] == 2
