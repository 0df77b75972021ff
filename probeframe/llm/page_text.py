"""Main text of web pages by a maximum-scoring subsequence (operator 10).

A page is a row of blocks of words and of tags.  Words score positive or, where
labelled pages have such words outside of their article, negative; tags score
negative.  A word's score is the log-odds of a logistic regression over what
stands around it (elements, names in class, id and role, links), a tag's follows
from where labelled pages have it.  A linear scan finds all contiguous regions
of maximal sum (Ruzzo and Tompa 1999).  Regions that go on in the same element
after an interruption, however long, are one; that with the highest sum is the
text, without its blocks that score negative by themselves.  Only scripts,
styles and markup are removed by rule.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeframe.llm._shared import small_batches

#: Labelled pages that weights are learned from, at most, and their length; kinds of surroundings that count.
TRAIN_PAGES, TRAIN_CHARS, KINDS = 1500, 200_000, 2000
#: Words that the sample counts as against the prior, steps of the fit, and bounds of a word's score.
TRAIN_WEIGHT, STEPS, MOST = 2000.0, 300, 3.0
#: Elements by their part in HTML.
RAW = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
MARKS = {"article", "main"}
#: Elements that hold a part of a text: it is at home in the element around them.
HELD = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre", "figure", "figcaption", "address"}
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What the regression holds before it sees a page, by surrounding; an unknown one weighs nothing.
PRIOR = (
    {"bias": 1.0, "inside": 1.0, "outside": -2.0, "in:p": 0.5, "in:h1": 1.0, "in:a": -1.0, "in:header": -1.5}
    | {f"in:{n}": -4.0 for n in ("nav", "footer", "aside", "form", "button", "select", "option", "textarea", "label", "dialog", "menu", "fieldset", "datalist", "head")}
    | {f"is:{n}": -4.0 for n in (
        "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion", "sidebar", "side", "menu", "nav", "navbar", "navigation",
        "breadcrumb", "breadcrumbs", "footer", "masthead", "topbar", "toolbar", "comment", "comments", "disqus", "replies", "reply", "cookie", "cookies", "consent", "notice", "notification", "alert",
        "popup", "modal", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "search", "complementary", "contentinfo",
    )}
)
#: A surrounding whose prior is this low marks words of a labelled page as no article text.
UNFIT = -3.0
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
SPACE = re.compile(r"\s+")
NAMES = re.compile(r"[^\W\d_]+")


@dataclass
class Weights:
    """``of``: log-odds by surrounding; ``tags``: scores of tags, all negative."""

    of: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    tags: dict[str, float] = field(default_factory=dict)

    def tag(self, name: str) -> float:
        return self.tags.get(name, -0.3)


@dataclass
class Place:
    """An open element: its name, what is around its words (as features), the article that is, and the element around it."""

    name: str
    around: frozenset[str]
    article: Place | None = None
    parent: Place | None = None

    @property
    def marked(self) -> bool:
        return self.article is not None

    def home(self) -> Place:
        """The article that the place is in, or else the nearest element that isn't just part of a text."""
        if self.article is not None:
            return self.article
        at = self
        while at.parent is not None and (at.name in INLINE or at.name in HELD):
            at = at.parent
        return at


def pieces(page: str) -> Iterator[tuple[str, str, Place]]:
    """``(tag, text, place)`` in page order: a tag with an empty text, or a text with an empty tag.

    Unclosed elements end where their parent does; a page may break off
    anywhere.  Scripts and styles have no text.
    """
    root = Place("body", frozenset())
    stack: list[Place] = []
    open_names: Counter = Counter()

    def pop() -> str:
        name = stack.pop().name
        open_names[name] -= 1
        return name

    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        here = stack[-1] if stack else root
        text = m["cdata"] if m["cdata"] is not None else m["text"]
        if text is not None:
            yield "", entities.unescape(text), here
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if m["close"]:
            if open_names[name]:
                while pop() != name:
                    pass
            yield name, "", here
            continue
        while stack and stack[-1].name in INLINE and name in CLOSED_BY and any(p.name in CLOSED_BY[name] for p in stack[-4:]):
            pop()  # an inline element left open doesn't hold the next block
        while stack and stack[-1].name in CLOSED_BY.get(name, ()):
            pop()
        here = stack[-1] if stack else root
        yield name, "", here
        if name in RAW and not m["attrs"].endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
        if name not in VOID and not m["attrs"].endswith("/"):
            own = {f"is:{n.lower()}" for g in NAMED.findall(m["attrs"]) for n in NAMES.findall(next(filter(None, g), ""))} if name not in ("html", "body") else set()
            if name not in MARKS and name not in ("html", "body") and (name not in INLINE or name == "a"):
                own.add(f"in:{name}")
            new = Place(name, here.around | own, here.article, here)
            if name in MARKS and new.article is None:
                new.article = new
            stack.append(new)
            open_names[name] += 1


@dataclass
class Block:
    """Text between two block tags, by the places of its parts; or a tag."""

    tag: str = ""
    parts: list[tuple[str, Place]] = field(default_factory=list)

    def text(self) -> str:
        return SPACE.sub(" ", "".join(t for t, _ in self.parts)).strip()


def blocks(page: str) -> list[Block]:
    row, parts = [], []
    for tag, text, place in pieces(page):
        if not tag or tag == "br":
            parts.append((text or " ", place))
        elif tag not in INLINE:
            if parts:
                row.append(Block(parts=parts))
                parts = []
            row.append(Block(tag))
    return [*row, Block(parts=parts)]


def _odds(weights: dict[str, float], around: frozenset[str], known: dict, side: float = 0.0) -> float:
    """A word's score: all that speaks for it, up to a bound, and all that speaks against it, so that a sidebar within an article stays one."""
    if (around, side) not in known:
        found = [weights.get("bias", 0.0), side, *(weights.get(f, 0.0) for f in around)]
        known[around, side] = max(-MOST, min(MOST, sum(f for f in found if f > 0)) + sum(f for f in found if f < 0))
    return known[around, side]


def is_marked(row: list[Block], weights: dict[str, float], known: dict) -> bool:
    """Whether the page's marked articles hold most of the words that score positive by all else."""
    found = [0, 0]
    for b in row:
        for text, place in b.parts:
            if _odds(weights, place.around, known) > 0:
                found[place.marked] += len(text.split())
    return found[1] > found[0]


def maximal_regions(scores: list[float]) -> list[tuple[int, int, float]]:
    """``first, end, sum`` of all disjoint regions of maximal sum, in order (Ruzzo and Tompa 1999), in linear time.

    Each region's sum can't be raised by making it longer or shorter, and every
    positive score is in one.
    """
    found: list[list[float]] = []  # first, end, sum before the region, sum up to its end
    back: list[int] = []  # for each region the nearest before it whose sum before is smaller, or -1
    total = 0.0
    for i, score in enumerate(scores):
        before, total = total, total + score
        if score <= 0:
            continue
        new = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                j = back[j]
            if j < 0 or found[j][3] >= new[3]:
                found.append(new)
                back.append(j)
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:], back[j:]
    return [(int(a), int(b), after - before) for a, b, before, after in found]


def joined(row: list[Block], scores: list[float], regions: list[tuple[int, int, float]]) -> list[tuple[list[int], float]]:
    """Regions that have an element in common at their ends, together: their blocks of positive score, and the sum."""
    home = lambda i: next(p for t, p in row[i].parts if t.strip()).home()
    out: list[tuple[list[int], float]] = []
    held: dict[int, int] = {}  # the element in which a joined region ends, to that region
    for a, b, total in regions:
        own = [i for i in range(a, b) if scores[i] > 0]
        first, last = home(own[0]), home(own[-1])
        at = held.get(id(first))
        if at is None:
            at = len(out)
            out.append((own, total))
        else:
            out[at] = (out[at][0] + own, out[at][1] + total)
        held[id(last)] = at
    return out


def extract(page: str, weights: Weights) -> str:
    """The text of the best region: its blocks in page order, one to a line, white space within a block as one space."""
    row, known = blocks(page), {}
    side = (weights.of.get("outside", 0.0), weights.of.get("inside", 0.0)) if is_marked(row, weights.of, known) else (0.0, 0.0)
    scores = []
    for b in row:
        if b.tag:
            scores.append(weights.tag(b.tag))
        else:
            scores.append(sum(len(t.split()) * _odds(weights.of, p.around, known, side[p.marked]) for t, p in b.parts))
    found = joined(row, scores, maximal_regions(scores))
    best = max(found, key=lambda f: f[1])[0] if found else []  # the first of equal ones
    lines = (row[i].text() for i in best)
    return "\n".join(line for line in lines if line)


def counts_of(page: str) -> Counter:
    """Of a labelled page: words by surroundings and tags by name, in its article and outside.

    Words count once with the article's mark and once as if there were none,
    so that all else learns to tell without it.  A page whose articles hold few
    of its words is no label.
    """
    row, found = blocks(page), Counter()
    if not is_marked(row, PRIOR, {}):
        return found
    for i, b in enumerate(row):
        for text, place in b.parts:
            n = len(text.split())
            if n:
                fit = place.marked and not any(PRIOR.get(f, 0.0) <= UNFIT for f in place.around)
                found["words " + " ".join(sorted(place.around)), fit] += n
                found["words " + " ".join(sorted(place.around | {"inside" if place.marked else "outside"})), fit] += n
        if b.tag:
            around = [p for x in row[max(0, i - 1) : i + 2] for _, p in x.parts]
            found[f"tag {b.tag}", bool(around) and all(p.marked for p in around)] += 1
    return found


def weights_from(counts: Counter) -> Weights:
    """The regression's most likely weights, given the counts and :data:`PRIOR`; without counts the prior.

    A tag costs the more the oftener it stands outside of articles.
    """
    kinds = sorted({k for k, _ in counts})
    tags = {}
    for kind in kinds:
        if kind.startswith("tag "):
            outside, inside = counts[kind, False], counts[kind, True]
            tags[kind[4:]] = -0.1 - 0.5 * outside / (inside + outside)
    words = [k for k in kinds if k.startswith("words ")]
    if not words:
        return Weights(dict(PRIOR), tags)
    names = sorted({f for k in words for f in k[6:].split()} | {"bias"} | set(PRIOR))
    place = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(words), len(names)))
    for i, k in enumerate(words):
        x[i, [place[f] for f in ("bias", *k[6:].split())]] = 1
    fit, unfit = (np.array([counts[k, side] for k in words], float) for side in (True, False))
    share = TRAIN_WEIGHT / max(TRAIN_WEIGHT, (fit + unfit).sum())
    prior = np.array([PRIOR.get(f, 0.0) for f in names])
    w = prior.copy()
    for _ in range(STEPS):  # Newton's method on a bounded table
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (fit * (1 - p) - unfit * p)) - (w - prior)
        bend = (x * (share * (fit + unfit) * p * (1 - p))[:, None]).T @ x + np.eye(len(names))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return Weights(dict(zip(names, w.tolist(), strict=True)), tags)


def learn_weights(pages: DataFrame, html: str = "html") -> Weights:
    """Weights from a bounded sample of pages that mark their article, chosen by hash.

    The sample's bound is found on the hashes alone, and its pages are read and
    counted where they are; equal pages count once.
    """
    rows = pages.select(F.col(html).alias("html")).filter(F.col("html").rlike("(?i)<(article|main)[\\s>]") & (F.length("html") <= TRAIN_CHARS)).withColumn("h", F.xxhash64("html"))
    last = rows.select("h").distinct().orderBy("h").limit(TRAIN_PAGES).agg(F.max("h")).first()[0]
    if last is None:
        return weights_from(Counter())
    sample = rows.filter(F.col("h") <= last).dropDuplicates(["h"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            total: Counter = Counter()
            for page in batch["html"]:
                total.update(counts_of(page))
            yield pd.DataFrame([(k, i, n) for (k, i), n in total.items()], columns=["kind", "inside", "n"])

    found = sample.select("html").mapInPandas(count, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    # a page's author may invent names, so only the commonest kinds count
    return weights_from(Counter({(r["kind"], r["inside"]): r["n"] for r in found.orderBy(F.desc("n"), "kind", "inside").limit(KINDS).collect()}))


def page_texts(pages: DataFrame, weights: Weights | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A null page is an empty one; a page without a region, and an empty page,
    have an empty text.  Of regions with the same score the first is taken.  A
    page of any length is read whole; only the sample for the weights leaves
    out pages beyond :data:`TRAIN_CHARS`.  Rows that repeat stay rows; other
    columns are not read.  Without ``weights`` they are learned from the table's
    own labelled pages, or are the prior if it has none.
    """
    small_batches(pages.sparkSession)
    weights = learn_weights(pages, html) if weights is None else weights

    @F.pandas_udf("string")
    def text_of(found: pd.Series) -> pd.Series:
        return pd.Series([extract(page, weights) for page in found], dtype=object)

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_of(F.coalesce(F.col(html), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
