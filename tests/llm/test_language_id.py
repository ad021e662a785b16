import math
import zlib
from itertools import combinations

import pyarrow as pa

from chronoloom.llm import language_id as lid
from chronoloom.llm import queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op4_language(spark, folder).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_hard_rows(hard, none):
    model = lid.fit_languages(hard)
    rows = lid.with_language(hard, model).collect()
    assert len(rows) == hard.count()
    for r in rows:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == lid.UNDETERMINED and r["score"] == 0) if not letters else r["lang_pred"] in model.languages
    empty = lid.fit_languages(none)
    assert empty.languages == () and lid.with_language(none, model).count() == 0
    assert {r["lang_pred"] for r in lid.with_language(hard, empty).collect()} == {lid.UNDETERMINED}


def test_prediction_reads_the_text_alone(spark, hard):
    model = lid.fit_languages(hard)
    a = sorted(map(str, lid.with_language(hard.select("text"), model).collect()))
    b = sorted(map(str, lid.with_language(hard.select("doc_id", "lang", "text"), model).select("text", "lang_pred", "score").collect()))
    assert a == b


def test_families():
    assert (lid.family("de"), lid.family("pt-BR"), lid.family("xx")) == ("germanic", "romance", "xx")


def plain_prediction(model, text):
    """The votes of both levels by loops over the bytes."""
    data = text.lower().encode()
    margins = {}
    for m in model.machines:
        total = m.offset
        for n in range(1, 5):
            grams = [data[i : i + n] for i in range(len(data) - n + 1)]
            buckets = [(int.from_bytes(g, "big") * 2654435761 + n * 0x9E3779B9) % 2**32 >> 20 for g in grams]
            total += sum(float(m.weights[b]) for b in buckets) / max(1, len(buckets))
        margins[m.pair] = total

    def vote(names):
        wins, sums, close = ({x: 0 for x in names}, {x: 0.0 for x in names}, {x: 30.0 for x in names})
        for a, b in combinations(names, 2):
            for x, m in ((a, margins[a, b]), (b, -margins[a, b])):
                wins[x] += m > 0
                sums[x] += m
                close[x] = min(close[x], m)
        best = max(names, key=lambda x: (wins[x], sums[x]))
        return best, 1 / (1 + math.exp(-2 * max(-30.0, close[best])))

    family, sure = vote(sorted({f"family:{lid.family(x)}" for x in model.languages}))
    language, more = vote(sorted(x for x in model.languages if f"family:{lid.family(x)}" == family))
    return language, sure * more


def test_predictions_equal_plain_votes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = lid.fit_languages(docs)
    texts = [r["text"][:400] for r in docs.limit(25).collect()] + ["a", "Die", "el la de que", "ünd ñ"]
    found, score = model.predict(pa.array([t.lower() for t in texts]))
    for t, language, s in zip(texts, found, score, strict=True):
        want, sure = plain_prediction(model, t)
        assert language == want and abs(s - sure) < 1e-4


def test_many_languages_are_all_learned(spark):
    """Seventy languages, each with letters of its own; the rarest is learned too."""
    rows = [(i * 70 + k, " ".join([chr(0x100 + 3 * k) * 3, chr(0x101 + 3 * k) * 2] * 4), f"x{k:02}") for k in range(70) for i in range(3 if k == 69 else 8)]
    model = lid.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == tuple(f"x{k:02}" for k in range(70)) and len(model.machines) == 70 * 69 // 2
    assert model.predict(pa.array([rows[-1][1].lower()]))[0][0] == "x69"
