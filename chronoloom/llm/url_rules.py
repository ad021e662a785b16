"""URL filters: given host and path rules, and association rules mined from labelled URLs."""

from __future__ import annotations

import math
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import cut_lineage, if_small, unused

#: Pruning of mined rules: least number and share of labelled URLs that are bad and have a combination, share of bad ones among those that have it, how much more than overall.
LEAST, SUPPORT, CONFIDENCE, LIFT = 20, 0.002, 0.6, 1.5
#: Most tokens of a combination, and of a set that FP-growth gets; a URL with more tokens gives several sets.
LONGEST, MOST = 4, 12
#: What a table of rules has.
RULES = "tokens array<string>, anchor string, confidence double, support double"


@dataclass(frozen=True)
class HostRule:
    """A rule like `example.org/es/` with its verdict."""

    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


def url_host(url: str = "url") -> Column:
    """From after the first :// to the next /, ? or #, with A-Z lower-cased; empty for null or no ://."""
    host = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def match_rule(rules: list[HostRule], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.rule), r.rule)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        found, verdict = F.when(fits, F.lit(r.rule)).otherwise(found), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return found, verdict


def url_tokens(url: str = "url") -> Column:
    """Sorted distinct tokens of a URL: h: labels of the host, p: words of the path, q: names of the query; no bare numbers."""
    words = lambda column, mark, cut: F.transform(F.filter(F.split(column, cut), lambda t: (t != "") & ~t.rlike(r"^\d+$")), lambda t: F.concat(F.lit(mark), t))
    query = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)\A[^?#]*\?([^#]*)", 1)
    names = F.regexp_replace(F.lower(query), r"=[^&]*", "")
    return F.array_sort(F.array_distinct(F.concat(words(url_host(url), "h:", r"[.:@\-]"), words(F.lower(url_path(url)), "p:", r"[^\p{L}\p{N}]+"), words(names, "q:", "&"))))


def _matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of sets (tokens, ...) with each rule (anchor, rule, ...) that has all its tokens in it, found under the rule's anchor."""
    found = sets.withColumn("anchor", F.explode("tokens")).join(if_small(cut_lineage(rules)), "anchor")
    return found.filter(F.size(F.array_except("rule", "tokens")) == 0).drop("anchor")


def token_sets(longest: int, most: int = MOST) -> Callable[[Column], Column]:
    """Of an array of distinct tokens sets of at most about `most`, such that any `longest` tokens are together in one."""

    @F.arrow_udf("array<array<string>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        size = max(1, most // longest)
        for batch in batches:
            out = []
            for tokens in batch.to_pylist():
                groups = [tokens[i : i + size] for i in range(0, len(tokens), size)]
                out.append([[t for g in some for t in g] for some in combinations(groups, min(longest, len(groups)))] if len(tokens) > most else [tokens])
            yield pa.array(out, pa.list_(pa.list_(pa.string())))

    return cut


def mine_rules(
    labelled: DataFrame, *, least: int = LEAST, support: float = SUPPORT, confidence: float = CONFIDENCE, lift: float = LIFT, longest: int = LONGEST, url: str = "url", bad: str = "bad"
) -> DataFrame:
    """(tokens, anchor, confidence, support): token combinations of labelled URLs that foretell a bad one.

    labelled: (url, bad); rows with a null in either are left out, rows that repeat count each. FP-growth finds the combinations of up
    to `longest` tokens in the bad URLs that `least` of them and a share of `support` of all labelled URLs have. A URL of over MOST tokens is
    given as several sets that together hold each of its combinations, as the number of those of any length would double with each token; it
    may then count more than once there. All labelled URLs that have a combination are counted exactly afterwards, and it is a rule if it
    reaches confidence and lift and none of its parts is as sure. No token is left out.
    anchor is a rule's rarest token, under which the index files it. Nothing labelled bad gives no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(url).isNotNull() & F.col(bad).isNotNull()).select(url_tokens(url).alias("tokens"), F.col(bad).alias("bad"))
    sets = cut_lineage(rows.groupBy("tokens").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad")))
    total, bads = sets.agg(F.sum("n"), F.sum("bad")).first()
    if not bads:
        return spark.createDataFrame([], RULES)
    rare = max(least, math.ceil(support * total - 1e-9))
    single = sets.select(F.explode("tokens").alias("token"), "n", "bad").groupBy("token").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).filter(F.col("bad") >= rare)
    single = if_small(cut_lineage(single))
    held = sets.filter("bad > 0").select("tokens", F.col("bad").alias("times"), F.explode("tokens").alias("token")).join(single.select("token"), "token")
    told = held.groupBy("tokens", "times").agg(F.array_sort(F.collect_list("token")).alias("all"))
    each = told.select(F.explode(token_sets(longest)(F.col("all"))).alias("items"), "times")
    items = cut_lineage(each.select("items", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("items"))
    count = items.count()
    if not count:
        return spark.createDataFrame([], RULES)
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, (rare - 0.5) / count)).fit(items).freqItemsets.filter(F.size("items") <= longest)
    parts = found.select(F.array_sort("items").alias("rule"), F.explode("items").alias("token"))
    candidates = parts.join(single, "token").groupBy("rule").agg(F.min_by("token", F.struct("n", "token")).alias("anchor"))
    counted = _matches(sets, candidates.select("anchor", "rule", F.col("anchor").alias("first"))).groupBy("rule", "first").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ratio = F.col("bad") / F.col("n")
    good = cut_lineage(counted.filter((F.col("bad") >= rare) & (ratio >= confidence) & (ratio >= lift * bads / total)).select("rule", "first", ratio.alias("sure"), (F.col("bad") / F.lit(total)).alias("share")))
    masks = F.sequence(F.lit(1), F.pow(F.lit(2), F.size("rule")).cast("int") - 2)
    part = F.transform(masks, lambda m: F.filter("rule", lambda t, i: F.getbit(m.cast("long"), i) == 1))
    parts = good.filter(F.size("rule") > 1).select("rule", "sure", F.explode(part).alias("part"))
    known = good.select(F.col("rule").alias("part"), F.col("sure").alias("part_sure"))
    redundant = parts.join(known, "part").filter("part_sure >= sure").select("rule").distinct()
    kept = good.join(redundant, "rule", "left_anti")
    return cut_lineage(kept.select(F.col("rule").alias("tokens"), F.col("first").alias("anchor"), F.col("sure").alias("confidence"), F.col("share").alias("support")))


def judge_urls(pages: DataFrame, rules: list[HostRule], mined: DataFrame, *, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, mined_confidence (columns so named are replaced; others stay, whatever their names).

    The longest fitting host rule decides; else a URL is blocked if a mined rule has all its tokens in it, found by
    the rules' anchors, and allowed if none has. Equal token sets are matched once. A null URL, or
    one without ://, has empty host and path, and no rule. Rows that repeat are judged alike.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "mined_confidence")]
    named = pages.select(*kept, url_host(url).alias("host"), url_path(url).alias("path"))
    own_verdict, own_tokens, own_sure = unused(named, "rule_verdict", "url_tokens", "surest")
    found, verdict = match_rule(rules, F.col("host"), F.col("path"))
    named = named.withColumns({"rule": found, own_verdict: verdict, own_tokens: url_tokens(url)})
    sets = named.filter("rule is null").select(F.col(own_tokens).alias("tokens")).distinct()
    index = mined.select("anchor", F.col("tokens").alias("rule"), F.col("confidence").alias("sure"))
    surest = _matches(sets, index).groupBy(F.col("tokens").alias(own_tokens)).agg(F.max("sure").alias(own_sure))
    told = named.join(if_small(cut_lineage(surest)), own_tokens, "left")
    judged = F.coalesce(F.col(own_verdict), F.when(F.col(own_sure).isNotNull(), "block").otherwise("allow"))
    return told.select(*kept, "host", "path", "rule", judged.alias("verdict"), F.when(F.col("rule").isNull(), F.col(own_sure)).alias("mined_confidence"))
