"""Terms put for their aliases where evidence allows it, found by joins of words and letters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.lineage import cut

#: What a word's letters are, and from which weight on an unconfirmed term is trusted. Fixed values.
WORD, TRUSTED = r"[\p{L}\p{N}_]", 0.75
#: Largest distance of a reading that is heard from the term's, and the least support of it. Fixed values.
READING, SUPPORT = 0.2, 0.8
#: Most forms that are broadcast; more are joined by a shuffle.
BROADCAST = 100_000
#: What is known of an alias, in this order, and what is told of each that was met.
FORM = ["alias", "low", "anywhere", "rank", "canonical", "term_language", "source"]
DIFF = {"start": "int", "end": "int", "before": "string", "after": "string", "rule": "string", "source": "string"}
#: Texts that a task searches at once.
TEXTS = 200


def folded(text: Column) -> Column:
    """Lower case letter by letter, so that every place stays where it is; a letter whose lower case is longer stays as it is."""
    lower = F.lower(text)
    each = F.array_join(F.transform(F.split(text, ""), lambda c: F.when(F.length(F.lower(c)) == F.length(c), F.lower(c)).otherwise(c)), "")
    return F.translate(F.when(F.length(lower) == F.length(text), lower).otherwise(each), "ςſ", "σs")


def supported(terms: DataFrame, evidence: DataFrame) -> DataFrame:
    """The terms that may be put: trusted ones (confirmed, or of enough weight) of which a form was emitted, or whose reading was heard with enough support.

    terms: (canonical, reading, aliases, weight, confirmed) and more; evidence: (canonical, emitted, observed, support). Without evidence none.
    """
    proof = evidence.groupBy("canonical").agg(F.flatten(F.collect_list("emitted")).alias("emitted__"), F.max_by("observed", F.coalesce("support", F.lit(-1.0))).alias("observed__"), F.max("support").alias("support__"))
    met = terms.join(proof, "canonical")
    emitted = F.arrays_overlap(F.array_append("aliases", F.col("canonical")), "emitted__")
    far = F.levenshtein(F.lower("reading"), F.lower("observed__")) / F.greatest(F.length("reading"), F.length("observed__"), F.lit(1))
    heard = (F.col("observed__") != "") & (far <= READING) & (F.col("support__") >= SUPPORT)
    trusted = F.coalesce(F.col("confirmed"), F.lit(False)) | F.coalesce(F.col("weight") >= TRUSTED, F.lit(False))
    return met.filter(trusted & (F.coalesce(emitted, F.lit(False)) | F.coalesce(heard, F.lit(False)))).select(*terms.columns)


def candidates(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, forms): the aliases that the texts (keys, plain, text, language) may hold, as they share a unit with the text.

    Units are the text's distinct runs of letters, for aliases that are met as whole words, or else its distinct characters; an alias is filed under
    its first one. A term of another language than the text's is none of them. Nothing of a text but its units goes through the join.
    """
    forms = terms.filter("canonical is not null").select("rank", "canonical", F.col("language").alias("term_language"), F.col("source").cast("string").alias("source"), F.explode("aliases").alias("alias")).filter("alias != ''").distinct()
    forms = cut(forms.withColumns({"low": folded(F.col("alias")), "anywhere": ~F.col("alias").rlike(r"\A[A-Za-z0-9]")}))
    count, loose = forms.agg(F.count("*"), F.count_if("anywhere")).first()
    hint = F.broadcast if count <= BROADCAST else lambda df: df
    fits = F.col("term_language").isNull() | (F.col("term_language") == F.col("language"))
    english, run = F.col("language").eqNullSafe("en"), F.regexp_extract("low", rf"{WORD}+", 0)

    def met(units: Column, first: Column, kinds: Column) -> DataFrame:
        asked = texts.select(*keys, "language", F.explode(F.array_distinct(units)).alias("unit"))
        return asked.join(hint(forms.withColumns({"unit": first, "run": run})), "unit").filter(fits & kinds).select(*keys, F.struct(*FORM).alias("form"))

    found = met(F.regexp_extract_all("plain", F.lit(rf"{WORD}+"), F.lit(0)), F.when(run != "", run), ~F.col("anywhere") | english)
    if loose:
        found = found.unionByName(met(F.split("text", ""), F.when(F.col("anywhere"), F.substring("alias", 1, 1)), ~english | (F.col("run") == "")))
    return found.groupBy(*keys).agg(F.collect_list("form").alias("forms"))


def places(plain: str, text: str, english: bool, forms: list[tuple]) -> Iterator[tuple[int, int, tuple]]:
    """(start, end, form) of every form in a text; places of a form don't overlap, the leftmost first. plain is the folded text, as long as the text."""
    words: dict[str, list] = {}
    first: dict[str, list] = {}
    for form in forms:
        alias, low, anywhere = form[:3]
        run = re.search(r"\w+", low)
        if run and (english or not anywhere):
            words.setdefault(run[0], []).append((low, run.start(), plain, True, form))
        else:
            first.setdefault(alias[0], []).append((alias, 0, text, english, form))
    reached = dict.fromkeys(forms, 0)
    letter = re.compile(r"\w").match
    starts = re.finditer(f"[{''.join(map(re.escape, first))}]", text) if first else ()
    for files, units in ((words, re.finditer(r"\w+", plain) if words else ()), (first, starts)):
        for unit in units:
            for written, lead, inside, whole, form in files.get(unit[0], ()):
                start = unit.start() - lead
                end = start + len(written)
                if start >= reached[form] and inside.startswith(written, start) and not (whole and (start and letter(inside, start - 1) or letter(inside, end))):
                    reached[form] = end
                    yield start, end, form


def chosen(plain: str, text: str, language: str | None, forms: list[tuple]) -> tuple[str, list[tuple]]:
    """A text with terms put for what is chosen of the forms' places, and what was put where."""
    known = lambda x: (x is not None, x)
    rule = lambda canonical, own: f"course-term:{(language or '') if own is None else own}:{canonical}"
    found = [(start, start - end, known(form[3]), form[0], form[4], rule(form[4], form[5]), known(form[6]), end) for start, end, form in places(plain, text, language == "en", forms)]
    parts, diffs, at = [], [], 0
    for start, _, _, alias, canonical, told, source, end in sorted(found):
        if start >= at:
            parts += [text[at:start], canonical]
            diffs.append((start, end, alias, canonical, told, source[1]))
            at = end
    return "".join([*parts, text[at:]]), diffs


def corrected(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, corrected, diffs): texts (keys, text, language) with terms put for aliases, and what was put where.

    terms: (rank, canonical, aliases, language, source), those that are supported. An alias that begins with an ASCII letter or digit, and any alias in an
    English text, is met as a whole word in any case; another one as it is written anywhere. A term of another language than the text's isn't met, nor is
    one without a name. Matches of one alias don't overlap, the leftmost first. Of matches the leftmost is taken, of these the longest, of these the first by
    rank; they don't overlap. diffs: array of (start, end, before, after, rule, source) in order, places from 0, before being the alias. A null text stays
    null, one without matches as it is; both have no diffs. Keys are unique.

    A text meets its candidates once and is searched in a task, a few texts at a time, so what a task holds doesn't grow with the number of its words.
    """
    some = texts.filter("text != ''").select(*keys, folded(F.col("text")).alias("plain"), "text", "language")
    plain = F.when(F.col("forms").isNotNull(), folded(F.col("text"))).alias("plain")
    joined = texts.join(candidates(some, terms, keys), keys, "left").select(*keys, "text", plain, "language", "forms")
    out = ", ".join([*(f"`{k}` {t}" for k, t in texts.select(*keys).dtypes), "corrected string", f"diffs array<struct<{','.join(f'`{n}`:{t}' for n, t in DIFF.items())}>>"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.string()) for n, t in DIFF.items()]))
        for whole in batches:
            for begin in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(begin, TEXTS)
                text, plain, language, forms = (batch.column(c) for c in ("text", "plain", "language", "forms"))
                each = iter(zip(*(x.to_pylist() for x in forms.flatten().flatten()), strict=True))
                sizes = [n or 0 for n in pc.list_value_length(forms).to_pylist()]
                rows = [chosen(p, t, g, list(islice(each, n))) if n else (t, []) for t, p, g, n in zip(text.to_pylist(), plain.to_pylist(), language.to_pylist(), sizes, strict=True)]
                told = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], kind)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *told], [*keys, "corrected", "diffs"])

    return joined.mapInArrow(put, out)
