"""Maximal regions by definition, and articles with interruptions of any length."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from probeframe.llm import page_text


def by_definition(scores):
    """The best region, then those before and after it, each the shortest of equal sum, the first of equals."""

    def found(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[2] + 1e-12 or (abs(total - best[2]) < 1e-12 and j + 1 - i < best[1] - best[0])):
                    best = (i, j + 1, total)
        return [] if best is None else found(a, best[0]) + [best] + found(best[1], b)

    return found(0, len(scores))


def test_maximal_regions_are_those_of_the_definition():
    rng = random.Random(1)
    for _ in range(1500):
        scores = [rng.choice([-3, -2, -1, 1, 2, 3, 0.5, -0.25]) * rng.random() for _ in range(rng.randint(0, 14))]
        got = page_text.maximal_regions(scores)
        want = by_definition(scores)
        assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want])
    assert page_text.maximal_regions([]) == page_text.maximal_regions([-1.0, 0.0]) == [] and page_text.maximal_regions([1.0, 1.0]) == [(0, 2, 2.0)]


@pytest.fixture(scope="module")
def weights(spark):
    return page_text.learn_weights(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def words(k, n=20):
    return " ".join(f"{k}word{i} of text" for i in range(n))


@pytest.mark.parametrize("n", [5, 20, 60, 150, 400, 2000])
@pytest.mark.parametrize("junk", ["<div class='ad'>{}</div>", "<nav><a href=x>{}</a></nav>", "<aside><p>{}</p></aside>", "<form><label>{}</label></form>", "<div class='ad'><p>{}</p><p>{}</p></div><script>{}</script>"])
@pytest.mark.parametrize("wrap", ["article", "main", "div"])
def test_interrupted_articles_are_whole(weights, n, junk, wrap):
    between = junk.replace("{}", "buy this now " * n)
    page = f"<html><body><header>Site</header><{wrap}><h1>Title</h1><p>{words('a')}</p>{between}<p>{words('b')}</p>{between}<ul><li>{words('c')}</li></ul></{wrap}><footer>foot words</footer></body></html>"
    assert page_text.extract(page, weights) == f"Title\n{words('a')}\n{words('b')}\n{words('c')}"


def test_scan_keeps_apart_what_lies_in_other_elements(weights):
    junk = "<div class='ad'>" + "buy this now " * 300 + "</div>"
    far = f"<div class='teasers'><p>{words('t', 8)}</p></div>{junk}"  # words that score positive, far from the article
    page = f"<html><body>{far}<div class='c'><p>{words('a')}</p>{junk}<p>{words('b')}</p></div>{junk}<div><p>{words('u', 8)}</p></div></body></html>"
    signs = "\n".join(b.text() for b in page_text.blocks(page) if not b.tag and b.text() and page_text._odds(weights.of, b.parts[0][1].around, {}) > 0)
    got = page_text.extract(page, weights)
    assert got == f"{words('a')}\n{words('b')}" and words("t", 8) in signs and words("u", 8) in signs  # by its sign alone each block would stay


def test_equal_regions_and_clashing_columns(spark):
    weights = page_text.Weights()
    junk = "<nav>" + "menu " * 200 + "</nav>"
    page = f"<html><body><div><p>{words('a')}</p></div>{junk}<div><p>{words('b')}</p></div></body></html>"
    assert page_text.extract(page, weights) == words("a")
    rows = spark.createDataFrame([(1, "u", page, "x", 7, "y"), (None, None, None, None, None, None)], "page_id long, url string, html string, text string, n_chars int, article string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.page_texts(rows, weights).collect()}
    assert got == {1: (words("a"), len(words("a"))), None: ("", 0)}
    assert page_text.page_texts(rows.filter(F.lit(False)), weights).columns == ["page_id", "url", "text", "n_chars"]
