"""The pipeline's stages on awkward rows, and its whole against the operators one by one."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from probeframe.llm import line_spread, near_copies, source_mix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, key int, `a.b` string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "row", "key", "a.b"]


def made():
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("aeinrst"), 5))
    rows = []
    for i in range(120):
        text = "\n".join(" ".join(word() for _ in range(12)) for _ in range(3)) + "\nshared footer line"
        rows.append([i, text + (" wretchling dunderhead" if i % 10 == 3 else ""), "en", f"s{i % 11}" if i % 7 else None, 0])
    rows[50][1] = rows[20][1]  # an exact copy
    rows[51][1] = rows[21][1] + " more"  # a near one
    rows += [[200, None, None, None, None], [201, "", "en", "s1", 0], [202, "word " * 30000, "en", "s2", 150000], [202, "word " * 30000, "en", "s2", 150000], [None, "no id here", None, "s3", 10]]
    return [(*r, 7.0, "r", 1, "x") for r in rows]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("docs")
    labels = [(i, 0, int(i % 10 == 3)) for i in range(120)]
    pq.write_table(pa.table({"doc_id": [r[0] for r in labels], "quality": [r[1] for r in labels], "toxic": [r[2] for r in labels]}), where / "labels.parquet")
    columns = list(zip(*made(), strict=True))
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.string()]
    pq.write_table(pa.table({n: pa.array(c, t) for n, c, t in zip(COLUMNS, columns, types, strict=True)}), where / "documents.parquet")
    return str(where)


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_awkward_rows(spark, folder, stage):
    name, function = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(made(), SCHEMA)
    out, none = function(spark, docs, folder), function(spark, docs.limit(0), folder)
    assert none.count() == 0
    if stage < 4:
        assert out.columns == none.columns == COLUMNS
        kept = out.select("score", "row", "key", "`a.b`").distinct().collect()
        assert [tuple(r) for r in kept] == [(7.0, "r", 1, "x")]


def test_toxic_rows_go_and_clean_ones_stay(spark, folder):
    docs = spark.createDataFrame(made(), SCHEMA)
    left = corpus_pipeline.drop_toxic(spark, docs, folder).select("doc_id").collect()
    ids = [r["doc_id"] for r in left]
    assert not {i for i in ids if i is not None and i < 120 and i % 10 == 3} and len(ids) >= 0.97 * (len(made()) - 12)
    assert ids.count(202) == 2 and None in ids and 200 in ids


def test_the_whole_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    step = corpus_pipeline.drop_toxic(spark, docs, folder)
    step = line_spread.remove_spread_lines(step)
    texts = [r["text"] for r in step.select("text").collect() if r["text"]]
    assert sum("shared footer line" in t.split("\n") for t in texts) == 1
    step = near_copies.keep_one(step)
    assert {r["doc_id"] for r in step.select("doc_id").collect()} & {20, 50, 21, 51} == {20, 21}
    want = source_mix.mixed_texts(step).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    out = corpus_pipeline.run(spark, folder)
    got = out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and out.filter("not parity").count() == 0


def test_near_dedup_compares_what_fingerprints_link(spark, monkeypatch):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "A b c d e f g h"), (4, "q r s t u v w x y z"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    mark = {r["doc_id"]: r["m"] for r in docs.select("doc_id", F.xxhash64("text").alias("m")).collect()}
    pairs = {(r["a"], r["b"]) for r in near_copies.fingerprint_pairs(docs).collect()}
    assert pairs == {tuple(sorted((mark[1], mark[3]))), tuple(sorted((mark[5], mark[6])))}
    met = []
    monkeypatch.setattr(near_copies, "fingerprint_pairs", lambda d, *a, real=near_copies.fingerprint_pairs: met.append(1) or real(d, *a))
    assert {r["doc_id"] for r in near_copies.keep_one(docs).collect()} == {1, 4, 5} and met
