"""Shared shingles by a prefix of rare ones against counting them all."""

from __future__ import annotations

import random

from probeframe.operators import overlap


def shingles(text):
    w = (text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_similar_against_all_pairs(spark):
    rng = random.Random(3)
    hot = "all rights are reserved by the owner of this page and of its text"  # in a third of the documents, and in items
    word = lambda: f"w{rng.randint(0, 40)}"
    items = [" ".join(word() for _ in range(rng.choice([3, 8, 20, 40]))) for _ in range(30)]
    items += [hot, f"{hot} {items[3]}", items[5], "", None, "one", "a b c d e"]
    docs = []
    for i in range(240):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if i % 3 == 0:
            parts.append(hot)
        if i % 4 == 0:
            w = (items[rng.randrange(30)]).split()
            for _ in range(rng.choice([0, 0, 1])):
                w[rng.randrange(len(w))] = "changed"
            parts.insert(rng.randint(0, len(parts)), " ".join(w))
        docs.append(" ".join(parts))
    docs += ["", None, "one", "a b c d e", "a b c d"]
    left = spark.createDataFrame(list(enumerate(docs)), "doc_id int, text string").repartition(4)
    right = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    for least in (0.8, 0.5, 1.0):
        want = {}
        for d, x in enumerate(docs):
            for i, y in enumerate(items):
                a, b = shingles(x), shingles(y)
                if b and len(a & b) / len(b) >= least:
                    want[d, i] = (len(a & b), len(a & b) / len(a | b), len(a & b) / len(b))
        got = {(r["doc_id"], r["item_id"]): (r["shared"], r["jaccard"], r["held"]) for r in overlap.similar(left, right, least).collect()}
        assert got == want and len(want) > 60
    again = overlap.similar(left.union(left), right).groupBy("doc_id", "item_id", "shared").count().collect()
    assert {r["count"] for r in again} == {2}
    assert overlap.similar(left.limit(0), right).count() == overlap.similar(left, right.limit(0)).count() == 0
