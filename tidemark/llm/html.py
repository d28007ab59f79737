"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Words score by the probability that their container holds article text, tags
score negative, and a linear scan finds the contiguous run of highest sum, which is the content region. The weights
come from labelled pages: pages with one ``article`` element say which words are inside. The element itself is no feature,
so the weights hold for pages without it. A container's features are its element, its class, id and role names and the
share of its words in links; a logistic model drawn towards ``PRIOR`` is fitted to them. Containers of the region that are
improbable (advert, form, notice, comments ...) are left out of the text.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import own_columns

#: About so many labelled pages are used for the weights, chosen by a hash of the page.
SAMPLE = 4000

# Element names of HTML by their role.
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes")
SIDE_TAGS = ("head", "title", "nav", "aside", "header", "footer", "form", "menu", "dialog")
CONTROLS = ("button", "select", "datalist", "object", "svg", "canvas", "audio", "video")
CONTAINERS = ("html", "body", "main", "article", "section", "div", "td", "th", "table", "ul", "ol", "dl", "center", "figure", "details", "hgroup", "address")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary",
    "table", "tbody", "tfoot", "thead", "title", "tr", "ul",
)
MAIN = ("article", "main")
# End of the fixed values.

#: What is believed of a name before any page is seen. A name of several words counts if each of them is here or in PLACES.
SIDE_WORDS = (
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies",
    "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "outbrain", "pagination", "popup", "promo", "promoted",
    "replies", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "topbar",
)
PLACES = ("area", "bar", "bottom", "box", "buttons", "container", "form", "global", "left", "list", "main", "page", "post", "primary", "reader", "right", "secondary", "section", "site", "thread", "top", "user", "wrap", "wrapper")
SIDE_ROLES = ("alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search")

_SIDE_TAGS, _CONTROLS, _CONTAINERS, _BLOCKS, _SIDE_WORDS, _PLACES, _SIDE_ROLES = map(frozenset, (SIDE_TAGS, CONTROLS, CONTAINERS, BLOCKS, SIDE_WORDS, PLACES, SIDE_ROLES))
#: Elements that say nothing by themselves, and the labels.
_SILENT = frozenset(("html", "body", "div", "section", *MAIN))
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:/>|>.*?(?:</(?P=raw)\s*[^>]*>|\Z))"
    r"|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_NAME_PARTS = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")

#: Weights before any page is seen: of no feature at all, of an element, name or role of a side container, of many links.
BIAS, SIDE_TAG, SIDE_NAME, LINKS = 1.5, -4.0, -3.0, -1.0
#: A tag costs TAG, and TAG_OUTSIDE more the more often it stands outside. Improbable words cost this share of their score.
TAG, TAG_OUTSIDE, OUTSIDE = -0.02, -0.08, 0.1
#: Pull towards the prior in the fit, against a mean loss in which inside and outside weigh the same.
PULL, STEPS = 0.05, 400


class Node:
    """A container: its parent, its features that none above it has, and its words, in all and in links."""

    __slots__ = ("parent", "tag", "features", "within", "words", "linked", "own", "logit")

    def __init__(self, parent, tag, features, within):
        self.parent, self.tag, self.features, self.within = parent, tag, features, within
        self.words = self.linked = self.own = 0
        self.logit = 0.0

    def dense(self) -> bool:
        return 2 * self.linked > self.words


class Event:
    """A run of text with its container, or a tag."""

    __slots__ = ("text", "tag", "end", "node", "words")

    def __init__(self, text, tag, end, node):
        self.text, self.tag, self.end, self.node = text, tag, end, node
        self.words = 0 if tag else len(text.split())


def _features(tag: str, rest: str) -> list[str]:
    out = [] if tag in _SILENT else [tag]
    for name, *values in _NAMED.findall(rest):
        value, name = "".join(values).lower() if name.lower() not in ("class", "id") else "".join(values), name.lower()
        if name in ("class", "id"):
            out += [f"{name}={word}" for word in value.split()]
        elif name == "role":
            out.append(f"role={value.strip()}")
        elif name == "hidden" or value == "true":
            out.append("hidden")
    return out


@functools.lru_cache(1 << 16)
def prior(feature: str) -> float:
    """Weight of a feature before any page is seen."""
    name, is_named, value = feature.partition("=")
    if not is_named:
        return LINKS if feature == "links" else SIDE_TAG if feature in _SIDE_TAGS or feature in _CONTROLS or feature == "hidden" else 0.0
    if name == "role":
        return SIDE_TAG if value in _SIDE_ROLES else 0.0
    parts = {p.lower() for p in _NAME_PARTS.split(value) if p}
    return SIDE_NAME if parts & _SIDE_WORDS and parts <= _SIDE_WORDS | _PLACES else 0.0


def events(page: str) -> tuple[list[Event], list[Node]]:
    """Linear scan of a page. Containers nest by their end tags; an end tag without its start is passed over.

    A control that is not closed ends at the next block or container. A side container that is not closed does not swallow
    the first ``article`` or ``main``.
    """
    out: list[Event] = []
    root = Node(None, "", [], False)
    nodes, stack, active = [root], [root], Counter()
    opened: Counter = Counter()
    at, met, links = 0, False, 0

    def close(depth: int):
        while len(stack) > depth:
            gone = stack.pop()
            active.subtract(gone.features)
            opened[gone.tag] -= 1
            gone.parent.words += gone.words
            gone.parent.linked += gone.linked

    def text(piece: str):
        event = Event(piece, "", False, stack[-1])
        stack[-1].words += event.words
        stack[-1].own += event.words
        stack[-1].linked += event.words if links else 0
        out.append(event)

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        end, rest = bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if tag == "a":
            links = 0 if end else 1
        elif tag in _BLOCKS:
            links = 0
        if tag in _BLOCKS and tag not in ("option", "legend") and stack[-1].tag in _CONTROLS:
            close(len(stack) - 1)
        if tag in _CONTAINERS or tag in _SIDE_TAGS or tag in _CONTROLS:
            if end:
                if opened[tag]:
                    close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif not rest.endswith("/") or tag not in _CONTROLS:
                names = _features(tag, rest) if rest.strip(" /") else [] if tag in _SILENT else [tag]
                side = any(prior(f) < 0 for f in names)
                if tag in MAIN and not side and not met:
                    met = True
                    close(next((i for i, n in enumerate(stack) if any(prior(f) < 0 for f in n.features)), len(stack)))
                elif tag == "body":
                    close(next((i for i, n in enumerate(stack) if n.tag == "head"), len(stack)))
                within = stack[-1].within or tag in MAIN
                if tag == "header" and stack[-1].within:
                    names = [f for f in names if not prior(f) < 0]  # it holds the article's title
                fresh = [f for f in dict.fromkeys(names) if not active[f]]
                active.update(fresh)
                opened[tag] += 1
                stack.append(Node(stack[-1], tag, fresh, within))
                nodes.append(stack[-1])
        out.append(Event("", tag, end, stack[-1]))
    if at < len(page):
        text(page[at:])
    close(1)
    return out, nodes


def labelled_counts(page: str) -> Counter:
    """(features of the container or a tag, inside the article?) -> words or tags, for a page with one article element; else empty."""
    found, _ = events(page)
    starts = [i for i, e in enumerate(found) if e.tag == "article" and not e.end]
    ends = [i for i, e in enumerate(found) if e.tag == "article" and e.end]
    out: Counter = Counter()
    if len(starts) == len(ends) == 1 and starts[0] < ends[0]:
        words: Counter = Counter()
        for i, e in enumerate(found):
            inside = starts[0] < i < ends[0]
            if e.tag:
                out[f"<{e.tag}", inside] += 1
            elif e.words:
                words[e.node, inside] += e.words
        for (node, inside), n in words.items():
            names, above = {"links"} if node.dense() else set(), node
            while above is not None:
                names.update(above.features)
                above = above.parent
            out["\x1f".join(sorted(names)), inside] += n
    return out


def weigh(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Feature -> weight: a logistic model of the containers, drawn towards the prior, and what a tag costs.

    Inside and outside words weigh the same in all, whatever their numbers.
    """
    weights = {}
    for tag in {f for f, _ in counts if f.startswith("<")}:
        inside, outside = counts.get((tag, True), 0), counts.get((tag, False), 0)
        weights[tag] = TAG + TAG_OUTSIDE * outside / (inside + outside)
    rows = sorted((f, i, n) for (f, i), n in counts.items() if not f.startswith("<"))
    total = {side: sum(n for _, i, n in rows if i == side) for side in (True, False)}
    if not all(total.values()):
        return weights
    paths = [["", *f.split("\x1f")] if f else [""] for f, _, _ in rows]
    names = {name: k for k, name in enumerate(sorted({name for path in paths for name in path}))}
    start = np.array([BIAS if not name else prior(name) for name in names])
    label = np.array([float(i) for _, i, _ in rows])
    share = np.array([n / total[i] / 2 for _, i, n in rows])
    row = np.repeat(np.arange(len(rows)), [len(path) for path in paths])
    column = np.array([names[name] for path in paths for name in path])
    fitted, step = start.copy(), 1.0 / (PULL + max(len(path) for path in paths) / 4)
    for _ in range(STEPS):
        probable = 1 / (1 + np.exp(-np.bincount(row, fitted[column], len(rows))))
        slope = np.bincount(column, (share * (probable - label))[row], len(names))
        fitted -= step * (slope + PULL * (fitted - start))
    return weights | dict(zip(names, fitted.tolist()))


def best_run(scores: list[float]) -> tuple[int, int]:
    """First and last + 1 of the contiguous run of highest sum (the earliest and shortest of equal ones); (0, 0): none."""
    best, run, start, found = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, found = run, (start, i + 1)
    return found


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """Blocks of the content region, each with single spaces, joined by two line feeds."""
    found, nodes = events(page or "")
    for node in nodes:  # parents come first
        node.logit = (node.parent.logit if node.parent else weights.get("", BIAS)) + sum(weights[f] if f in weights else prior(f) for f in node.features)
    links = weights.get("links", LINKS)
    inside = {node: math.tanh((node.logit + (links if node.dense() else 0.0)) / 2) for node in nodes if node.own}
    scores = []
    for e in found:
        if e.tag:
            scores.append(weights.get(f"<{e.tag}", TAG))
        else:
            score = e.words * inside[e.node] if e.words else 0.0
            scores.append(score if score > 0 else OUTSIDE * score)
    first, last = best_run(scores)
    blocks: list[list[str]] = [[]]
    for e in found[first:last]:
        if e.tag:
            if e.tag in _BLOCKS:
                blocks.append([])
            elif e.tag in ("br", "td", "th", "img", "input"):
                blocks[-1].append(" ")
        elif not e.words or inside[e.node] > 0:
            blocks[-1].append(e.text)
    return "\n\n".join(text for b in blocks if (text := " ".join(html.unescape("".join(b)).split())))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            counts.update(labelled_counts(page))
    rows = [(f, i, n) for (f, i), n in counts.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))], ["feature", "inside", "n"])


def learn_weights(pages: DataFrame, sample: int = SAMPLE) -> dict[str, float]:
    """Weights from about ``sample`` different pages that have an article element. Features are bounded by those pages."""
    labelled = own_columns(pages, html="string").where(F.col("html").contains("<article"))
    mark = F.xxhash64("html")
    n = labelled.agg(F.approx_count_distinct(mark)).first()[0]
    picked = labelled.where(F.pmod(mark, F.lit(1 << 30)) < (1 << 30) * min(1.0, sample / max(1, n))).distinct()
    rows = picked.mapInArrow(_count_batches, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weigh({(r.feature, r.inside): r.n for r in rows})


def _text_batches(weights: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, weights) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract(pages: DataFrame, weights: dict[str, float] | None = None, sample: int = SAMPLE) -> DataFrame:
    """page_id, url, text for every row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without a positive run, have an empty text. Repeated rows and null ids or urls are
    kept; other columns are not read; an empty table gives no rows. Pages without any article element to learn from
    use the prior weights. A page is worked on whole.
    """
    weights = learn_weights(pages, sample) if weights is None else weights
    return own_columns(pages, page_id="long", url="string", html="string").mapInArrow(_text_batches(weights), "page_id long, url string, text string")


def op2_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


#: For pages with one article element and the character references that these tables have.
OP2_SQL = r"""
with body as (select page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*)</article>', 1) as b from pages),
parts as (select page_id, url, row_number() over () as r, regexp_split_to_array(regexp_replace(b, '<br */?>', ' ', 'g'), '</?(?:p|h[1-6]|div|li|ul|ol|section|blockquote|pre)(?:\s[^>]*)?>') as p from body),
clean as (select page_id, url, r, list_filter(list_transform(p, lambda x: trim(regexp_replace(
  regexp_replace(replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&amp;?', '&', 'g'),
  '\s+', ' ', 'g'))), lambda x: x <> '') as p from parts)
select page_id, url, array_to_string(p, chr(10) || chr(10)) as text, cast(length(array_to_string(p, chr(10) || chr(10))) as bigint) as n_chars from clean
"""
