"""A join that a key with a third of the rows doesn't hold up."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from probeframe.operators import audit, overlap
from probeframe.operators.joins import join_counted


def test_popular_texts(spark):
    rng = random.Random(1)
    texts = [rng.choice(["hot text", "hot text", f"t{rng.randint(0, 900)}", None, ""]) for _ in range(4000)]
    docs = spark.createDataFrame([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id int, text string, source string").repartition(8)
    first, n = {}, {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
        n[t] = n.get(t, 0) + 1
    got = {r["doc_id"]: (r["n_copies"], r["first_id"]) for r in overlap.exact_copies(docs).collect()}
    assert got == {i: (n[t], first[t]) for i, t in enumerate(texts) if t is not None}
    seen, want = {}, {}
    for i, t in enumerate(texts):
        if t is not None and seen.setdefault((i % 3, t), i) != i:
            want[i] = seen[i % 3, t]
    again = audit.duplicates(docs, "source", "text", "doc_id")
    assert again.columns == ["doc_id", "text", "source", "first"] and {r["doc_id"]: r["first"] for r in again.filter("text is not null").collect()} == want
    assert overlap.exact_copies(docs.filter("false")).count() == audit.duplicates(docs.filter("false"), "source", "text", "doc_id").count() == 0


def test_heavy_keys_are_not_shuffled(spark):
    rows = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), "id")
    out = join_counted(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n")
    assert out.count() == 30000 and out.filter("k = -1 and n = 10000").count() == 10000
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and out.filter("k <> -1").agg(F.max("n")).first()[0] == 1
