"""Main text of HTML pages as the maximum-scoring run of words and tags."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import bounded_batches, cut_lineage

#: Most labelled pages that the weights are learned from.
LABELLED = 2000
# fixed values: elements whose text isn't shown, that have no end, that begin a block, that label a page's content for learning
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "svg", "select", "button", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTENT = {"article", "main"}
#: Prior of kinds that no labelled page has: tags, and names of elements, that stand for other things than content. Fixed values.
ASIDE_TAGS = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"}
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "contentinfo", "cookie", "cookies", "consent", "copyright", "dfp", "disclaimer", "disqus",
    "feedback", "footer", "gdpr", "header", "legal", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "paywall", "popup", "promo", "recommended", "related", "replies", "respond", "search",
    "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "teaser", "teasers", "toolbar", "trending", "widget",
}
#: Names of readers' comments, which hold no article, however long they are; names that are also words of prose, which a paragraph or heading without links may have. Fixed values.
READERS, PROSE = {"comment", "comments", "disqus", "feedback", "replies", "respond"}, {"banner", "header", "menu", "related", "search", "share", "sharing", "social"}
PARAGRAPHS = {"blockquote", "caption", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "pre", "td", "th"}
#: Parts that leave the meaning of a name to its other parts, those that tell of a layout around the content ("has-sidebar"), and tags around a whole page. Fixed values.
NEUTRAL_NAMES = {"area", "bar", "block", "box", "buttons", "container", "form", "inner", "item", "left", "link", "links", "list", "posts", "reader", "right", "section", "signup", "site", "slot", "strip", "top", "wrap", "wrapper"}
LAYOUT_NAMES, WRAPPERS = {"has", "have", "with", "without", "no", "layout"}, {"html", "body"}
#: Elements that hold parts of a page rather than a paragraph. Fixed values.
CONTAINERS = {"article", "body", "center", "div", "html", "main", "section", "table", "tbody", "td", "tr"}
#: Weights: of a word of content, bounds of a tag's, of a word beside the content; what outweighs a count of none; words a kind must have to be learned.
WORD, TAG_BOUNDS, BESIDE, PSEUDO, ENOUGH = 1.0, (-1.0, -0.1), -3.0, 1.0, 10

_END = re.compile(r"[>\"']")
_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS, _CAPITAL = re.compile(r"[^a-z0-9]+"), re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _tag_end(page: str, at: int) -> int:
    """Where the tag that begins before `at` ends: its first > outside of quoted values; -1 if a quote stays open."""
    while m := _END.search(page, at):
        if m[0] == ">":
            return m.start()
        at = m.end()
        if page[max(m.start() - 8, 0) : m.start()].rstrip().endswith("="):
            at = page.find(m[0], at) + 1
            if not at:
                return -1
    return -1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", text, "") in page order; what isn't shown is left out.

    Every character is looked at a bounded number of times: after the last > all is text, and once a quote stays open to
    the end of the page, tags end at their first >.
    """
    at, text, last, quotes = 0, 0, page.rfind(">"), True
    while 0 <= (open_ := page.find("<", at)) < max(last, 0):
        begin = page[open_ + 1]
        if begin in "!?":
            if page.startswith("<!--", open_):
                end = page.find("-->", open_ + 4) + 3
                end = end if end > 2 else len(page)
            elif page.startswith("<![CDATA[", open_):
                end = page.find("]]>", open_ + 9) + 3
                end = end if end > 2 else len(page)
            else:
                end = page.find(">", open_) + 1
            if open_ > text:
                yield "text", page[text:open_], ""
            at = text = end
            continue
        name = _NAME.match(page, open_ + 1)
        if not name:
            at = open_ + 1
            continue
        end = _tag_end(page, name.end()) if quotes else page.find(">", name.end())
        if end < 0:
            quotes = False
            end = page.find(">", name.end())
        if open_ > text:
            yield "text", page[text:open_], ""
        at = text = end + 1
        tag, attributes = name[1].lower(), page[name.end() : end]
        if begin == "/":
            yield "close", tag, ""
        elif tag in RAW:
            if not attributes.endswith("/"):
                closing = _RAW_END[tag].search(page, at)
                at = text = page.find(">", closing.end()) + 1 or len(page) if closing else len(page)
        else:
            yield "open", tag, attributes
    rest = page[text:]
    if "<!--" in rest:
        rest = rest[: rest.index("<!--")]
    if rest:
        yield "text", rest, ""


def _is_aside_name(name: str) -> bool:
    """Whether the prior takes an element of this name for something beside the content: by its last part, or by all of its parts."""
    parts = [p for p in _PARTS.split(name) if p]
    if not parts or LAYOUT_NAMES & set(parts):
        return False
    return parts[-1] in ASIDE_NAMES or bool(ASIDE_NAMES & set(parts)) and all(p in ASIDE_NAMES or p in NEUTRAL_NAMES for p in parts)


def word_count(text: str) -> int:
    return len((html.unescape(text) if "&" in text else text).split())


@dataclass
class Tree:
    """The tokens of a page, (what, value, number of the element that they lie in), and its elements in page order.

    kinds: what an element may be known by: its tag if it sections the page, and its names. own: words of its own text,
    words: all inside it. A parent comes before its children. Elements that wrap the page's title and most of its words have no names but those of
    comments, as they lie around the content, nor are such forms any; no kinds has a header that holds the title, or stands between other words of its
    parent and holds a heading, and no list or form. A paragraph or heading without links has no name that is a word of prose too.
    """

    tokens: list[tuple[str, str, int]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    kinds: list[list[str]] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    words: list[int] = field(default_factory=list)


def parse(page: str) -> Tree:
    """The tree of a page, in time linear in its length."""
    tree, stack, open_of = Tree(), [], {}
    title, busy, links, headings = None, set(), set(), set()

    def close_down_to(depth: int) -> None:
        while len(stack) > depth:
            open_of[tree.tags[stack.pop()]].pop()

    for what, value, attributes in tokens(page):
        if what == "open":
            if value == "p" and stack and tree.tags[stack[-1]] == "p":
                close_down_to(len(stack) - 1)
            number = len(tree.tags)
            if value == "h1" and title is None:
                title = number
            if value in ("ul", "ol", "nav", "form", "menu"):
                busy.add(number)
            elif value == "a":
                links.add(number)
            elif len(value) == 2 and value[0] == "h" and value[1] in "123456":
                headings.add(number)
            if value not in VOID:
                tree.parents.append(stack[-1] if stack else -1)
                tree.tags.append(value)
                names = [n for groups in _NAMES.findall(attributes) for v in groups for n in _CAPITAL.sub("-", v).lower().split()] if "=" in attributes else []
                tree.kinds.append([*([value] if value in ASIDE_TAGS else []), *(f".{n}" for n in names)])
                tree.own.append(0)
                open_of.setdefault(value, []).append(len(stack))
                stack.append(number)
        elif what == "close":
            if open_of.get(value):
                close_down_to(open_of[value][-1])
        elif stack:
            tree.own[stack[-1]] += word_count(value)
        tree.tokens.append((what, value, stack[-1] if stack else -1))
    loose = sum(word_count(value) for what, value, e in tree.tokens if what == "text" and e < 0)
    tree.words = list(tree.own)
    lists, linked, headed = ([e in found for e in range(len(tree.tags))] for found in (busy, links, headings))
    for e in range(len(tree.tags) - 1, -1, -1):
        if tree.parents[e] >= 0:
            tree.words[tree.parents[e]] += tree.words[e]
            for flags in (lists, linked, headed):
                flags[tree.parents[e]] |= flags[e]
    total = loose + sum(n for n, p in zip(tree.words, tree.parents, strict=True) if p < 0)
    above, e = set(), -1 if title is None else title
    while e >= 0:
        above.add(e)
        e = tree.parents[e]
    for e, tag in enumerate(tree.tags):
        parent = tree.parents[e]
        among = headed[e] and not linked[e] and parent >= 0 and tree.tags[parent] not in WRAPPERS and tree.words[parent] > 2 * tree.words[e]
        heads = (e in above or among) and not lists[e] and (tag == "header" or any(k.endswith("header") for k in tree.kinds[e]))
        if heads:
            tree.kinds[e] = []
        elif tag in WRAPPERS or 2 * tree.words[e] > total and (title is None or e in above):
            tree.kinds[e] = [k for k in tree.kinds[e] if k[0] == "." and tag not in WRAPPERS and READERS & set(_PARTS.split(k)) or k[0] != "." and k != "form"]
        elif tag in PARAGRAPHS and not linked[e]:
            tree.kinds[e] = [k for k in tree.kinds[e] if k[1:] not in PROSE]
    return tree


def is_aside(kind: str, weights: dict[str, float]) -> bool:
    """By the learned weights, and by the prior for a kind that has none."""
    known = weights.get(kind)
    return known < 0 if known is not None else kind in ASIDE_TAGS or kind[0] == "." and _is_aside_name(kind[1:])


def beside(tree: Tree, weights: dict[str, float]) -> list[bool]:
    """Of each element, whether it or one around it is beside the content."""
    out: list[bool] = []
    for parent, kinds in zip(tree.parents, tree.kinds, strict=True):
        out.append(parent >= 0 and out[parent] or any(is_aside(k, weights) for k in kinds))
    return out


def count_page(page: str) -> Counter[tuple[str, bool]]:
    """(feature, inside): words by kind of element and tags, inside and outside of the elements that label the content; nothing if none does.

    An article or main element labels it if neither it nor one around it is beside it by the prior.
    """
    tree, out = parse(page), Counter()
    aside = beside(tree, {})
    inside: list[bool] = []
    for e, parent in enumerate(tree.parents):
        inside.append(parent >= 0 and inside[parent] or tree.tags[e] in CONTENT and not aside[e])
    if not any(inside):
        return out
    held = [[0, 0] for _ in tree.tags]
    for what, value, e in tree.tokens:
        lies = e >= 0 and inside[e]
        if what == "text":
            n = word_count(value)
            out["word", lies] += n
            if e >= 0:
                held[e][lies] += n
        elif what == "open" and value not in CONTENT:
            out[f"<{value}", lies] += 1
    for e in range(len(held) - 1, -1, -1):
        for lies in (False, True):
            for k in set(tree.kinds[e]):
                out[k, lies] += held[e][lies]
            if tree.parents[e] >= 0:
                held[tree.parents[e]][lies] += held[e][lies]
    return out


def learn_weights(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Weights of tags, within TAG_BOUNDS, by log odds of being inside the content, and of kinds of elements: BESIDE or 0.

    A kind of ENOUGH words is beside the content if nine tenths of them are; others are left to the prior.
    """
    total = {i: PSEUDO + sum(n for (f, x), n in counts.items() if x == i and f[0] == "<") for i in (True, False)}
    out = {}
    for f in {f for f, _ in counts}:
        a, b = counts.get((f, True), 0), counts.get((f, False), 0)
        if f[0] == "<":
            odds = math.log((a + PSEUDO) / total[True]) - math.log((b + PSEUDO) / total[False])
            out[f] = min(max(odds, TAG_BOUNDS[0]), TAG_BOUNDS[1])
        elif f != "word" and a + b >= ENOUGH:
            out[f] = BESIDE if b > 9 * a else 0.0
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """(start, end) of the run with the largest sum, found in one scan; of equal ones the one that ends first. (0, 0) if no sum is positive."""
    best, span, score, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        score += x
        if score > best:
            best, span = score, (start, i + 1)
        if score <= 0:
            score, start = 0.0, i + 1
    return span


def content_container(tree: Tree, aside: list[bool]) -> int:
    """The innermost container that holds more than half of the page's words which aren't beside the content; -1 if none does."""
    net = [0 if a else n for a, n in zip(aside, tree.own, strict=True)]
    for e in range(len(net) - 1, -1, -1):
        if tree.parents[e] >= 0:
            net[tree.parents[e]] += net[e]
    total = sum(n for n, p in zip(net, tree.parents, strict=True) if p < 0)
    return max((e for e, n in enumerate(net) if 2 * n > total and tree.tags[e] in CONTAINERS), default=-1)


def token_scores(tree: Tree, aside: list[bool], weights: dict[str, float]) -> list[float]:
    """A text counts WORD for each of its words, in an element beside the content BESIDE; a tag its weight, 0 if it labels content.

    An element beside the content but inside the container of most words interrupts the content, it doesn't end it: it counts 0.
    """
    root = content_container(tree, aside)
    within = [False] * len(tree.tags)
    for e in range(max(root, 0), len(within)):
        within[e] = e == root or tree.parents[e] >= 0 and within[tree.parents[e]]
    out = []
    for what, value, e in tree.tokens:
        between = e >= 0 and aside[e] and within[e] and not aside[root]
        if value in CONTENT and what != "text" or between:
            out.append(0.0)
        elif what == "text":
            out.append(word_count(value) * (BESIDE if e >= 0 and aside[e] else WORD))
        else:
            out.append(weights.get(f"<{value}", TAG_BOUNDS[1]) if what == "open" else TAG_BOUNDS[1])
    return out


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best-scoring run, one a line; the empty string for a page without such words.

    Only the scores decide: elements that label content for learning are not looked at. Within the run, elements
    beside the content are left out. Time grows linearly with the page; broken markup (open tags, quotes, comments) costs no more.
    """
    tree = parse(page or "")
    aside = beside(tree, weights)
    span = slice(*best_run(token_scores(tree, aside, weights)))
    blocks, block = [], []
    for what, value, e in tree.tokens[span]:
        if what != "text":
            if value in BLOCK:
                blocks.append(block)
                block = []
            elif value == "br":
                block.append(" ")
        elif e < 0 or not aside[e]:
            block.append(value)
    lines = (" ".join(html.unescape("".join(b)).split()) for b in [*blocks, block])
    return "\n".join(line for line in lines if line)


def fit_weights(pages: DataFrame, *, most: int = LABELLED, key: str = "page_id", page: str = "html") -> dict[str, float]:
    """Weights from at most `most` labelled pages, the first by hash of their key.

    A page labels itself if it marks its content by one of the CONTENT elements. Without such pages the prior alone
    tells. The counts of the sample come to the driver.
    """
    bounded_batches(pages.sparkSession)
    marked = pages.filter(F.col(page).rlike("(?i)<(" + "|".join(sorted(CONTENT)) + r")[\s>]"))
    first = cut_lineage(marked.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(most))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, bool]] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                seen.update(count_page(value))
        yield pa.RecordBatch.from_pydict({"feature": pa.array([f for f, _ in seen], pa.string()), "inside": pa.array([i for _, i in seen], pa.bool_()), "n": pa.array(list(seen.values()), pa.int64())})

    sample = marked.join(F.broadcast(first), key, "left_semi").select(page)
    rows = sample.mapInArrow(count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n")).collect()
    return learn_weights({(f, i): n for f, i, n in rows})


def with_main_text(pages: DataFrame, weights: dict[str, float], *, page: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text as a column (one of that name is replaced); other columns stay, whatever their names.

    A null or empty page, and one without a word of content, has the empty text. Long and broken pages are read whole,
    in linear time. Rows that repeat a page get the same text; an empty table gives no rows.
    """
    bounded_batches(pages.sparkSession)

    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([main_text(x, weights) for x in values.to_pylist()], pa.string())

    return pages.withColumn(name, extract(F.col(page)))
