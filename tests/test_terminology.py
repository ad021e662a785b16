"""Evidence, matching and choice of terms against a search by expressions over all aliases."""

import random
import re

import pytest

from chronoloom.operators import terminology

TERMS = "rank int, canonical string, reading string, aliases array<string>, language string, weight double, confirmed boolean, source string"
TEXTS = "k int, text string, language string"


def plain(text, language, terms):
    found = []
    for rank, canonical, _, aliases, own, _, _, source in terms:
        if own not in (None, language):
            continue
        for alias in sorted(filter(None, aliases), key=len, reverse=True):
            whole = language == "en" or re.match("[A-Za-z0-9]", alias)
            pattern = re.compile(rf"(?<!\w){re.escape(alias)}(?!\w)", re.I) if whole else re.compile(re.escape(alias))
            found += [(m.start(), m.end(), alias, canonical, f"course-term:{own or language or ''}:{canonical}", source) for m in pattern.finditer(text)]
    chosen = []
    for m in sorted(found, key=lambda m: (m[0], m[0] - m[1])):
        if not chosen or m[0] >= chosen[-1][1]:
            chosen.append(m)
    out, at = "", 0
    for start, end, _, canonical, *_ in chosen:
        out, at = out + text[at:start] + canonical, end
    return out + text[at:], chosen


def test_against_expressions(spark):
    terms = [
        (1, "Straßenbahn", "", ["straße", "strasse bahn"], "de", 1.0, True, "a"), (2, "C++", "", ["c plus plus", "c++", "cpp"], None, 1.0, True, "a"), (3, "機械学習", "", ["機械", "機会学習", "械学"], "ja", 1.0, True, "b"),
        (4, "New York", "", ["new york", "new york city", "york"], "en", 1.0, True, None), (5, "aba", "", ["a b a", "ab"], None, 1.0, True, "c"), (6, ".NET", "", [".net", "++"], "en", 1.0, True, "c"), (7, "Ünï", "", ["été", "ΟΔΟΣ"], None, 1.0, True, "d"), (8, "x", "", ["", "york"], None, 1.0, True, "d"),
    ]
    texts = [
        "Die Straße und STRASSE BAHN, straßen", "c++ und C PLUS PLUS cpp; cppx c+++", "機会学習と機械学習、械学", "New York City, in NEW YORK; york yorks", "a b a b a ab abab", "we use .NET and x.net ++ ok a++", "L'Été déjà été ÉTÉ οδοσ ΟΔΟΣ", "", "İstanbul straße york İ york", None, "york", "new  york new york",
    ]
    draw = random.Random(8)
    texts += ["".join(draw.choice(["a", " ", "b", "ab", "york", "new york", ".net", "機", "械学", "c++", "Straße", "é"]) for _ in range(30)) for _ in range(60)]
    rows = [(i, t, draw.choice(["de", "en", "ja", None]) if i > 11 else ["de", "de", "ja", "en", None, "en", "fr", "en", "de", "en", "fr", "en"][i]) for i, t in enumerate(texts)]
    got = terminology.corrected(spark.createDataFrame(rows, TEXTS), spark.createDataFrame(terms, TERMS), ["k"]).collect()
    assert len(got) == len(rows)
    for r in got:
        _, text, language = rows[r["k"]]
        if text is None:
            assert r["corrected"] is None and r["diffs"] == []
        else:
            want, diffs = plain(text, language, terms)
            assert r["corrected"] == want, (text, language)
            assert [(d["start"], d["end"], d["before"].casefold(), d["after"], d["rule"], d["source"]) for d in r["diffs"]] == [(a, b, x.casefold(), *rest) for a, b, x, *rest in diffs]


@pytest.mark.parametrize(
    "weight,confirmed,emitted,observed,support,passes",
    [(0.5, True, ["abd"], None, None, True), (0.75, False, ["term"], None, None, True), (0.7, False, ["term"], None, None, False), (1.0, False, ["other"], None, None, False), (1.0, None, [], "readinh", 0.8, True), (1.0, None, [], "readinh", 0.79, False), (1.0, None, None, "reXXing", 0.9, False), (None, True, ["x"], "", 1.0, False)],
)
def test_evidence(spark, weight, confirmed, emitted, observed, support, passes):
    terms = spark.createDataFrame([(1, "term", "Reading", ["abd"], None, weight, confirmed, None), (2, "unheard", "u", ["v"], None, 1.0, True, None)], TERMS)
    evidence = spark.createDataFrame([("term", emitted, observed, support)], "canonical string, emitted array<string>, observed string, support double")
    assert [r["canonical"] for r in terminology.supported(terms, evidence).collect()] == (["term"] if passes else [])
