import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.llm import queries
from chronoloom.llm import toxicity as tx


def plain_ratios(words):
    """(context, letter) -> log ratio by plain counting; letter '' for any unseen one. words: (word, is_toxic)."""
    counts = {True: Counter(), False: Counter()}
    for word, toxic in words:
        w = tx.BEFORE * tx.CONTEXT + word + tx.AFTER
        for i in range(tx.CONTEXT, len(w)):
            counts[toxic][w[i - tx.CONTEXT : i], w[i]] += 1
    seen = set(counts[True]) | set(counts[False])
    letters = len({x for _, x in seen})
    level, levels = seen, []
    for _ in range(tx.CONTEXT):
        n = Counter((c[1:], x) for c, x in level)
        levels.append(n)
        level = set(n)

    def shared(context, x, depth=0):
        if depth == len(levels):
            return 1 / letters
        own = {k: n for k, n in levels[depth].items() if k[0] == context}
        total = sum(own.values())
        return (max(own.get((context, x), 0) - tx.DISCOUNT, 0) + tx.DISCOUNT * len(own) * shared(context[1:], x, depth + 1)) / total

    of = {c: defaultdict(Counter) for c in (True, False)}
    for c in counts:
        for (h, x), n in counts[c].items():
            of[c][h][x] = n

    def left(c, h):
        return tx.DISCOUNT * len(of[c][h]) / sum(of[c][h].values()) if of[c][h] else 1.0

    def chance(c, h, x):
        total = sum(of[c][h].values())
        return (max(of[c][h][x] - tx.DISCOUNT, 0) / total if total else 0.0) + left(c, h) * shared(h[1:], x)

    out = {(h, x): math.log(chance(True, h, x)) - math.log(chance(False, h, x)) for h, x in seen}
    return out | {(h, ""): math.log(left(True, h)) - math.log(left(False, h)) for h in {h for h, _ in seen}}


def plain_mean(text, ratios):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    total = 0.0
    for word in words:
        w = tx.BEFORE * tx.CONTEXT + word + tx.AFTER
        events = [(w[i - tx.CONTEXT : i], w[i]) for i in range(tx.CONTEXT, len(w))]
        found = sum(ratios.get(e, ratios.get((e[0], ""), 0.0)) for e in events)
        total += math.log1p(tx.MIXED * math.expm1(min(found, 50)))
    return total / (len(words) + tx.NEUTRAL)


TOXIC = ["you utter blockhead, go away", "BLOCKHEAD! what a blockish head", "a blockhead writes this", None]
PLAIN = ["a block of wood lies on the head of the pier", "they go away and write", "überall 12 Wörter, so what", "", "the heads of the blocks"]


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(t, True) for t in TOXIC] + [(t, False) for t in PLAIN]
    events = tx.event_counts(spark.createDataFrame(rows, "text string, is_toxic boolean").select(tx.letters_only("text").alias("words"), "is_toxic"))
    return tx.log_ratios(events).cache()


def test_ratios_equal_plain_counting(learned):
    want = plain_ratios([(w, toxic) for texts, toxic in ((TOXIC, True), (PLAIN, False)) for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower())])
    got = {(r["context"], r["letter"]): r["ratio"] for r in learned.collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_means_equal_plain_sums(spark, learned):
    table = spark.sparkContext.broadcast(tx.fill_table(learned))
    ratios = {(r["context"], r["letter"]): r["ratio"] for r in learned.collect()}
    texts = [*TOXIC, *PLAIN, " \n", "blocky blockheads", "x", "head" * 5000, "ein Wort 中文 ÉTÉ", "block " * 3000]
    rows = tx.with_mean(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), table, "mean", "text").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert math.isclose(r["mean"], plain_mean(r["text"], ratios), abs_tol=1e-5), r


def test_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op12_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(p for t, p in held if t) >= 0.85 * sum(t for t, _ in held)
    assert sum(p for t, p in held if not t) <= 0.03 * sum(not t for t, _ in held)


def test_held_out_labels_are_not_read(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("toxic", F.when(tx.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (tx.fit_toxicity(docs, x) for x in (labels, other))
    assert (a.cut, a.slope) == (b.cut, b.slope) and (a.table.value.ratios == b.table.value.ratios).all() and (a.table.value.tags == b.table.value.tags).all()


def test_hard_rows(spark, hard, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 0), (7, 1), (7, 0), (8, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    model = tx.fit_toxicity(hard, labels)
    rows = tx.with_toxicity(hard, model).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows) and {r["kept"] for r in rows} == {"old"}
    assert len({r["score"] for r in rows if not re.search(r"[^\W\d_]", r["text"] or "")}) == 1
    assert tx.with_toxicity(none, model).count() == 0
    empty = tx.fit_toxicity(none, labels.limit(0))
    assert {r["score"] for r in tx.with_toxicity(hard, empty).collect()} == {0.5}


def test_events_that_share_a_slot_are_all_kept(spark):
    """Words whose events meet in a slot of the table count in full, the rarer ones too."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(3000)})
    padded = {w: tx.BEFORE * tx.CONTEXT + w + tx.AFTER for w in words}
    events = [(w, p[i : i + tx.CONTEXT], p[i + tx.CONTEXT]) for w, p in padded.items() for i in range(len(w) + 1)]
    slots = tx.mix(tx.event_numbers([c for _, c, _ in events], [x for *_, x in events])) >> np.uint64(64 - 21)
    by_slot = defaultdict(dict)
    for (w, c, x), slot in zip(events, slots.tolist(), strict=True):
        by_slot[slot].setdefault((c, x), w)
    met = [list(x.values()) for x in by_slot.values() if len(x) > 1][:30]
    assert len(met) == 30
    texts = [" ".join(w[0] for w in met), " ".join(w[1] for w in met)]
    rows = spark.range(60).select(F.col("id").alias("doc_id"), tx.held_out("id").alias("held"), (tx.unit_hash(F.col("id"), "toxicity") >= tx.SHARE).alias("counted")).collect()
    docs = spark.createDataFrame([(r["doc_id"], texts[r["doc_id"] % 2]) for r in rows], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    model = tx.fit_toxicity(docs, labels)
    ratios = plain_ratios([(w, r["doc_id"] % 2 == 1) for r in rows if not r["held"] and r["counted"] for w in texts[r["doc_id"] % 2].split()])
    each = spark.createDataFrame([(w,) for pair in met for w in pair], "text string")
    for r in tx.with_mean(each, model.table, "mean", "text").collect():
        assert math.isclose(r["mean"], plain_mean(r["text"], ratios), abs_tol=1e-5), r


@pytest.mark.parametrize(("slots", "beside"), [(2, 0), (16, 9), (64, 1 << 20)])
def test_means_do_not_depend_on_the_room(spark, learned, slots, beside):
    whole = spark.sparkContext.broadcast(tx.fill_table(learned))
    table = spark.sparkContext.broadcast(tx.fill_table(learned, slots, beside))
    rest = tx.left_out(learned, table)
    assert len(table.value.tags) == slots and len(table.value.beside) <= beside
    placed = len({*table.value.tags[table.value.tags > 0].tolist(), *table.value.beside.tolist()})
    assert placed + rest.count() == learned.count() and table.value.whole == (rest.count() == 0) == (beside > 9)
    texts = [*TOXIC, *PLAIN, *TOXIC, " \n", "blocky blockheads blocky", "x", "head" * 5000, "ein Wort 中文 ÉTÉ", "block " * 3000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    want = {r["i"]: r["mean"] for r in tx.with_mean(docs, whole, "mean", "text").collect()}
    rows = tx.with_mean(docs, table, "mean", "text", rest)
    assert rows.columns == ["i", "text", "mean"] and {r["i"]: r["mean"] for r in rows.collect()} == want and rows.count() == len(texts)
    if not table.value.whole:
        with pytest.raises(ValueError, match="rest"):
            tx.with_mean(docs, table, "mean", "text")


def test_scores_do_not_depend_on_the_room(spark, small, hard, none):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    one, other = tx.fit_toxicity(docs, labels), tx.fit_toxicity(docs, labels, slots=1 << 10, beside=1 << 9)
    assert one.rest is None and other.rest.count() > 0 and (one.cut, one.slope) == (other.cut, other.slope)
    for rows in (docs, hard, none):
        a, b = (Counter((r["doc_id"], r["text"], r["score"], r["predicted"]) for r in tx.with_toxicity(rows, m).collect()) for m in (one, other))
        assert a == b and sum(a.values()) == rows.count()
