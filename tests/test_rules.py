"""Operators that work by slices, and those on texts, against plain Python."""

import random
import re
import subprocess
import sys
import zipfile
from collections import defaultdict
from pathlib import Path

from pyspark.sql import functions as F

from chronoloom.operators import evaluation, gates, glossary, marks, neighbours, repetition, stitching, structure, versions
from chronoloom.sources import gold, responses
from chronoloom.streaming import folds


def logs(seed=1, keys="ab", n=300):
    rng = random.Random(seed)
    return [(k, at, rng.choice([None, 1.0, 2.0, 3.0, 5.5]), rng.choice("xyz")) for k in keys for at in sorted(rng.sample(range(2000), n))]


def test_slices_give_what_windows_over_keys_give(spark):
    rows = logs()
    df, part = spark.createDataFrame(rows, "k string, at long, v double, l string"), F.floor(F.col("at") / 37)
    of = defaultdict(list)
    for k, at, v, label in rows:
        of[k].append((at, v, label))
    for r in neighbours.with_neighbours(df, ["k"], ["at"], ["l"], part).collect():
        i = [x[0] for x in of[r["k"]]].index(r["at"])
        want = [of[r["k"]][j][2] if 0 <= j < len(of[r["k"]]) else None for j in (i - 1, i + 1)]
        assert [r["before"] and r["before"]["l"], r["after"] and r["after"]["l"]] == want
    for r in neighbours.with_running_sum(df.fillna(0), ["k"], ["at"], "v", part).collect():
        assert abs(r["upto"] - sum(v or 0 for at, v, _ in of[r["k"]] if at <= r["at"])) < 1e-9
    for r in neighbours.with_latest(df, ["k"], ["at"], "v", part).collect():
        assert r["latest"] == next((v for at, v, _ in reversed(of[r["k"]]) if at <= r["at"] and v is not None), None)


def test_ranks_and_quantiles(spark):
    rng = random.Random(3)
    values = {k: [rng.choice([rng.random(), 0.5, -3.0]) for _ in range(n)] for k, n in (("a", 200), ("b", 1), ("c", 7))}
    df = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k string, v double")
    ranked = neighbours.ranked_values(df, ["k"], "v", bins=5)
    for r in ranked.collect():
        own = values[r["k"]]
        assert (r["n"], r["upto"], r["total"]) == (own.count(r["v"]), sum(x <= r["v"] for x in own), len(own))
    for r in neighbours.quantiles(ranked, ["k"], "v", {"q": 0.3}).collect():
        own, at = sorted(values[r["k"]]), 0.3 * (len(values[r["k"]]) - 1)
        low = int(at)
        assert abs(r["q"] - (own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low))) < 1e-9


def test_routes_equal_the_streams_fold(spark):
    rng = random.Random(5)
    rows = [(k, at, rng.choice(["en", "de", None]), rng.choice([0.2, 0.7, 0.9, None])) for k in "ab" for at in range(0, 900, 3)]
    df = spark.createDataFrame(rows, "k string, start long, label string, confidence double")
    for needed in (2, 3):
        want = {}
        for k in "ab":
            router = folds.Router(needed)
            want |= {(k, at): router.push(label, sure) for key, at, label, sure in rows if key == k}
        assert {(r["k"], r["start"]): r["route"] for r in stitching.routed(df, "k", needed=needed, slice_width=100).collect()} == want


def test_adjacent_spans(spark):
    rows = [("k", s, s + 1, rng) for s, rng in [(0, "a"), (1, "a"), (2, "b"), (4, "b"), (5, "b"), (6, "b"), (100, "a")]]
    got = versions.merge_adjacent(spark.createDataFrame(rows, "k string, start long, end long, l string"), ["k"], "l", 2).orderBy("start").collect()
    assert [(r["l"], r["start"], r["end"], r["parts"]) for r in got] == [("a", 0, 2, 2), ("b", 2, 3, 1), ("b", 4, 7, 3), ("a", 100, 101, 1)]


def test_marks(spark):
    due = F.array(*(F.lit(x) for x in (None, ",", None, ".", "?")))
    texts = ["abcde", "ab, cde", "a b  c", "", "!?", "…abcdefg"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").orderBy("i").select(marks.with_marks(F.col("t"), due)).collect()]
    assert got == ["ab,cd.e?", "ab, cd.e?", "a b,  c", "", "!?", "…ab,cd.e?fg"]


def test_glossary_equals_a_plain_search(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "ga", "délta", "x"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(200, None), (201, "ALPHA Beta\nga")]
    terms = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))[rng.randint(0, 2) :]) for i in range(60)] + [(90, ""), (91, None), (92, "Beta\nGA"), (93, "a b")]
    got = glossary.contained_terms(spark.createDataFrame(texts, "i long, t string"), spark.createDataFrame(terms, "j long, term string"), text="t", term="term", term_id="j", key="i")
    assert {tuple(r) for r in got.collect()} == {(i, j) for i, t in texts for j, x in terms if t and x and x.lower() in t.lower()}


def test_repeats_of_runs(spark):
    texts = ["a b c a b c a b c a b c", "a b", "x x x x x x", None, ""]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").orderBy("i").select(repetition.ngram_repeats(F.col("t"), 3, 4)).collect()]
    assert [g and tuple(g) for g in got] == [(12, 4, 4), None, (6, 4, 4), None, None]


def test_responses(spark):
    payloads = [
        '{"phrases":[{"text":" hi there ","offsetMilliseconds":0.5,"durationMilliseconds":100,"locale":"ja-JP","words":[{"text":"hi","offsetMilliseconds":0,"durationMilliseconds":10},{"text":"no","offsetMilliseconds":-1,"durationMilliseconds":5}]},{"text":" "},{"text":"late","offsetMilliseconds":1e9,"durationMilliseconds":1}]}',
        '{"combinedPhrases":[{"text":"one"},{"text":"two"}]}',
        "broken",
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "i long, payload string")
    got = [(r["i"], r["text"], r["start"], r["end"], r["timed"], r["language"], len(r["words"])) for r in responses.phrases(df, "payload", F.lit(16000).cast("long"), F.lit("en")).orderBy("i", "no").collect()]
    assert got == [(0, "hi there", 8, 1608, True, "ja", 1), (0, "late", 0, 0, False, "en", 0), (1, "one\ntwo", 0, 0, False, "en", 0)]
    bad = spark.createDataFrame([('{"model":"m","segments":[{"start":5,"end":9,"text":"t","speaker":"s","words":[]},{"start":3,"end":20,"text":"u","words":[{"text":"w","start":2,"end":4}]}]}',), ("{}",)], "payload string")
    faults = [r[0] for r in responses.with_segments(bad, "payload").select(responses.response_faults(F.col("response"), F.lit("m"), F.lit(0), F.lit(10), F.lit("t"))).collect()]
    assert faults == [["window", "order", "speaker", "words", "alignment"], ["model", "empty", "window", "order", "speaker", "words", "alignment"]]


def test_gates(spark):
    issues = F.array(F.lit("characters_per_voiced_second_exceeded"), F.lit("repeated_sentence"))
    row = spark.range(1).select(gates.blocked(issues).alias("a"), gates.blocked(F.slice(issues, 1, 1)).alias("b"), gates.gate_score(F.slice(issues, 2, 1), F.lit(0.5)).alias("c"), evaluation.vote_weight(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0), F.lit(False), F.lit(True)).alias("d")).first()
    assert tuple(row) == (False, True, 0.5, 0.25)
    codes = spark.createDataFrame([("English ",), ("日本語",), ("xx",), (None,)], "n string").select(structure.language_code(F.col("n"))).collect()
    assert [r[0] for r in codes] == ["en", "ja", None, None]


def test_slides(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.pptx", "w") as z:
        for n, words in ((2, ["Second"]), (1, ["First", "&amp; more"]), (10, ["Tenth"])):
            z.writestr(f"ppt/slides/slide{n}.xml", "<p xmlns:a=\"u\">" + "".join(f"<a:t>{w}</a:t>" for w in words) + "</p>")
    (tmp_path / "b.pptx").write_bytes(b"no archive")
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["fault"]) for r in gold.read_slides(spark, str(tmp_path / "*.pptx")).collect()}
    assert got["a.pptx"] == ("First\n& more\nTenth\nSecond", None) and got["b.pptx"][0] == "" and re.match("unreadable", got["b.pptx"][1])


def test_the_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=Path(__file__).resolve().parent.parent)
    assert done.returncode == 0 and int(done.stdout) > 100, done.stderr
