import re
import zlib
from collections import Counter

import numpy as np
import pytest

from chronoloom.llm import queries, spelling


def plain(rows, ratio=2):
    """word -> (form, root, n, n_near, form_n) by trying all edits."""
    counts = Counter()
    for key, text in rows:
        for run in re.findall(spelling.LETTERS, text or ""):
            run = "".join(x.lower() if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % spelling.ONE_IN == 0 else run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= spelling.SHORTEST and n >= spelling.LEAST}
    letters = sorted(set("".join(known)))
    out = {}
    for w, n in known.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + x + w[i + j :] for i in range(len(w) + 1) for j in (0, 1) for x in letters}
        near = [u for u in edits if u in known and u != w]
        form = min(near, key=lambda u: (-known[u], u), default=None)
        form = form if form and known[form] >= ratio * n else None
        out[w] = [form, w, n, len(near), known.get(form)]
    for w, row in out.items():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query_equals_plain_edits(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    assert found(queries.op11_spelling(spark, small)) == plain(map(tuple, docs.collect()))


def test_chains_ties_and_letters(spark):
    words = ["sprachen"] * 9 + ["spracher"] * 9 + ["sprache"] * 30 + ["sprach"] * 12 + ["spraech"] * 5 + ["Straße"] * 6 + ["strasse"] * 3 + ["sträße"] * 3 + ["ÀÉÎÕÜ"] * 3 + ["àéîõü"] * 3
    words += ["aaaaa"] * 3 + ["aaaaaa"] * 40 + ["a×b÷c"] * 3 + ["chain"] * 200 + ["chaim"] * 80 + ["cheim"] * 30 + ["cleim"] * 10 + ["four"] * 50
    docs = spark.createDataFrame([(i % 7 or None, f"{w} 12,{w}_" if i % 2 else w) for i, w in enumerate(words)], "doc_id long, text string")
    got = found(spelling.spelling_variants(docs))
    assert got == plain(map(tuple, docs.collect()))
    assert got["cleim"][1] == "chain" and got["aaaaa"][0] == "aaaaaa" and got["ÀÉÎÕÜ"][0] is None


def test_full_filters_change_nothing(spark, small):
    """With hardly any room every edit looks like a word; the join puts that right."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(20)
    assert found(spelling.spelling_variants(docs, most_bits=1 << 12)) == found(spelling.spelling_variants(docs))


def test_filters_hold_all_words():
    words = sorted({f"w{'xyz'[i % 3]}{i}" for i in range(5000)})
    filters = spelling.Filters.layout(Counter(map(len, words)))
    blocks = np.zeros(int(filters.size.sum()), np.uint64)
    for length, rows in spelling._by_length(words):
        at, bits = filters.places(spelling.hashes(spelling._letters([words[i] for i in rows], length)), length)
        np.bitwise_or.at(blocks, at, bits)
    filters = spelling.Filters(filters.offset, filters.size, blocks)
    for length, rows in spelling._by_length(words):
        assert filters.may_hold(spelling.hashes(spelling._letters([words[i] for i in rows], length)), length).all()
        other = spelling.hashes(spelling._letters([words[i][::-1] for i in rows], length))
        assert filters.may_hold(other, length).mean() < 0.05


def test_hard_rows(hard, none):
    assert found(spelling.spelling_variants(hard)) == plain((r["doc_id"], r["text"]) for r in hard.collect())
    assert spelling.spelling_variants(none).count() == 0


@pytest.mark.parametrize("links,roots", [([], {}), ([("a", "b")], {"a": "b"}), ([(f"{i:03}", f"{i + 1:03}") for i in range(50)], {f"{i:03}": "050" for i in range(50)})])
def test_follow(spark, links, roots):
    assert dict(map(tuple, spelling.follow(spark.createDataFrame(links, "word string, form string")).collect())) == roots
