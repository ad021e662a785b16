"""Word times in order, words returned to their phrase, phrases split at sentences."""

from hypothesis import given, settings
from hypothesis import strategies as st

from chronoloom.operators import phrases
from chronoloom.plans import phrase_queries


def test_times():
    t = phrases.ordered_times
    assert t([("a", 0, 10), ("b", 5, 20), ("c", 20, 30)]) == [("a", 0, 5), ("b", 5, 20), ("c", 20, 30)]
    # a word before its predecessor follows it and shares its time, as do all that are left without duration
    assert t([("a", 100, 200), ("b", 50, 90), ("c", 60, 70), ("d", 300, 400)]) == [("a", 100, 133), ("b", 133, 166), ("c", 166, 200), ("d", 300, 400)]
    assert t([("a", 5, 5), ("b", 5, 9)]) == [("a", 5, 7), ("b", 7, 9)]
    assert t([("a", 5, 5), ("b", 5, 5)]) == [("a", 5, 5), ("b", 5, 5)] and t([]) == []
    assert t([("a", 0, 50), ("b", 40, 90)], (10, 60)) == [("a", 10, 40), ("b", 40, 60)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60), st.integers(0, 60)), max_size=9))
def test_times_never_go_back(words):
    out = phrases.ordered_times(words)
    assert [w[0] for w in out] == [w[0] for w in words]
    assert all(a <= b for _, a, b in out) and all(x[2] <= y[1] for x, y in zip(out, out[1:], strict=False))


def test_words_return():
    w = lambda *texts: [(x, i, i + 1) for i, x in enumerate(texts)]
    stay, go = phrases.pass_on("Eins zwei.", w("Eins ", "zwei. ", "Drei "), "Drei vier!", w("vier!"))
    assert [x[0] for x in stay] == ["Eins ", "zwei. "] and [x[0] for x in go] == ["Drei ", "vier!"]
    stay, go = phrases.pass_on("是0.003。", [("是", 0, 1), ("、0.003。0.997", 1, 2)], "0.997です", [("です", 3, 4)])
    assert [x[0] for x in stay] == ["是", "、0.003。"] and go[0] == ("0.997", 1, 2)
    assert phrases.pass_on("Eins.", w("Eins. "), "Zwei", w("Zwei")) is None
    assert phrases.pass_on("Eins.", w("Eins. ", "Drei "), "Zwei", w("Zwei")) is None  # the next text doesn't have it
    assert phrases.pass_on("Eins.", w("Eins. ", "Zwei "), "Zwei drei vier", w("vier")) is None  # what follows doesn't go on there


def test_sentences():
    words = [("He ", 0, 10), ("left. ", 10, 20), ("Dr. ", 20, 30), ("Who? ", 30, 40)]
    assert phrases.split_words("He left. Dr. Who?", words, None) == [("He left.", 0, 20, [("He", 0, 10), ("left.", 10, 20)]), ("Dr. Who?", 20, 40, [("Dr.", 20, 30), ("Who?", 30, 40)])]
    assert [x[0] for x in phrases.split_words("Ja. Nein", [("Ja. Nein", 0, 10)], None)] == ["Ja. Nein"]  # no time for a border within a word
    assert [x[:3] for x in phrases.split_words("はい。次", [("はい", 0, 5), ("。", 5, 6), ("次", 6, 9)], None)] == [("はい。", 0, 6), ("次", 6, 9)]
    assert phrases.split_words("He left", [("She ", 0, 1), ("left", 1, 2)], None) is None and phrases.split_words("He left", [("He ", 0, 1)], None) is None
    assert phrases.split_words("He", [("He", 5, 5)], None) is None and phrases.split_words("", [], None) is None


def test_queries_against_rows(spark, small):
    given_phrases = phrase_queries.turns_as_phrases(spark, small)
    rows = sorted(given_phrases.collect(), key=lambda r: (r["conv_id"], r["turn"]))
    plain = lambda ws: [(w["text"], w["start"], w["end"]) for w in ws]
    want, words = {}, [plain(r["words"]) for r in rows]
    for i, (a, b) in enumerate(zip(rows, rows[1:], strict=False)):
        if a["conv_id"] == b["conv_id"]:
            words[i], words[i + 1] = phrases.pass_on(a["text"], words[i], b["text"], words[i + 1]) or (words[i], words[i + 1])
    for r, ws in zip(rows, words, strict=True):
        parts = phrases.split_words(r["text"], ws, (r["start"], r["end"]) if r["timed"] else None)
        for no, part in enumerate(parts or [(r["text"], r["start"], r["end"], [])]):
            want[r["conv_id"], r["turn"], no] = (part[1], part[2], len(part[3]))
    got = phrase_queries.sentence_phrases(spark, small).collect()
    assert {(r["conv_id"], r["turn"], r["part"]): (r["start"], r["end"], r["words"]) for r in got} == want and len(got) == len(want)
    assert sum(r["part"] > 0 for r in got) > 20


def test_hard_rows(spark):
    schema = f"k string, n long, text string, start long, end long, timed boolean, words {phrases.WORDS}, part_of string"
    rows = [("a", 1, None, 0, 9, True, None, "x"), ("a", 2, "", 0, 9, False, [], "x"), (None, 1, "One. Two.", 0, 9, None, [("One. ", 0, 4), ("Two.", 4, 9)], "y")]
    df = spark.createDataFrame(rows, schema)
    got = phrases.sentence_phrases(phrases.returned_words(df, "k", "n")).collect()
    assert sorted((r["text"] or "", r["part"]) for r in got) == [("", 0), ("", 0), ("One.", 0), ("Two.", 1)]
    assert phrases.sentence_phrases(phrases.returned_words(df.limit(0), "k", "n")).count() == 0
