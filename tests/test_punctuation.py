"""Punctuation by language against plain rules in Python."""

import re
import unicodedata

import pytest

from chronoloom.operators.punctuation import _balanced
from chronoloom.plans import projection_queries as queries


def mark(c):
    return unicodedata.category(c)[0] in "PZ" or c.isspace()


def bare(text):
    return "".join(c for c in text if not mark(c))


def put(text, due):
    there, n = set(), 0
    for c in text:
        if not mark(c):
            n += 1
        elif not c.isspace() and unicodedata.category(c)[0] == "P":
            there.add(n)
    out, n = due.get(0, "") if 0 not in there else "", 0
    for c in text:
        out += c
        if not mark(c):
            n += 1
            out += due.get(n, "") if n not in there else ""
    return out


def spoken(rows, n, comma, stop, question):
    due = {}
    for r in rows or []:
        if r["after"] <= n:
            m = question if r["rising"] else stop if r["changed"] or r["pause"] >= 700 else comma if r["pause"] >= 250 else None
            due |= {r["after"]: m} if m else {}
    return due


def chinese(r):
    text = r["text"]
    fits = r["proposal"] is not None and bare(r["proposal"]) == bare(text)
    base = text if re.search("[，。！？、；：]", text) or not fits else r["proposal"]
    return put(base, spoken(r["spoken"], len(bare(base)), "，", "。", "？"))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def balance(text):
    pairs, stack, out = {"「": "」", "（": "）", "(": ")"}, [], ""
    for c in text:
        if c in pairs.values():
            if not stack or stack[-1] != c:
                continue
            stack.pop()
        elif c in pairs:
            stack.append(pairs[c])
        out += c
    return out + "".join(reversed(stack))


def japanese(r):
    text, n, due = r["text"], len(bare(r["text"])), {}
    if r["proposal"]:
        m = len(bare(r["proposal"]))
        if distance(bare(r["proposal"]), bare(text)) / max(n, m, 1) <= 0.25 and m:
            at = 0
            for c in r["proposal"]:
                if c in "、。？！":
                    due[min(n, round(at * n / m))] = c
                at += not mark(c)
    heard = spoken(r["spoken"], n, "、", "。", "？")
    due = heard | due
    if not due:
        due = {x["after"]: x["mark"] for x in r["labels"] if x["confidence"] >= 0.7 and x["after"] <= n}
    out = balance(put(text, due))
    if sum(unicodedata.category(c)[0] == "P" for c in out) / max(1, len(bare(out))) > 0.35:
        out = balance(put(text, heard))
    return out


def test_query_equals_plain_rules(spark, small):
    cases = {(r["conv_id"], r["turn"]): r for r in queries.punctuation_cases(spark.read.parquet(f"{small}/conversations.parquet")).collect()}
    got = queries.language_punctuation(spark, small).collect()
    assert len(got) == len(cases)
    for r in got:
        case = cases[r["conv_id"], r["turn"]]
        if (case["text"] or "").strip():
            assert r["chinese"] == chinese(case), case
            if len(case["text"]) < 1500:
                assert r["japanese"] == japanese(case), case
    assert len({r["chinese_source"] for r in got}) >= 4 and len({r["japanese_source"] for r in got}) >= 4


@pytest.mark.parametrize("text,want", [("「a」）", "「a」"), ("(「a)", "(「a」)"), ("）（", "（）"), ("", ""), ("a(b", "a(b)")])
def test_balance(text, want):
    assert _balanced(text) == want == balance(text)
