"""JSON in and out, and results as a stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from probeframe.operators import gaps, selection
from probeframe.sources import json_files
from probeframe.sources.result_log import ResultLog
from probeframe.streaming import results as stream

ITEMS = [
    {"item_id": "i1", "question": "How many?", "answer": 5, "variants": [{"item_id": "i1_v0", "question": "How many now?", "answer": 6.5}, {"item_id": "i1_v1", "question": "And now?", "answer": 7}]},
    {"item_id": "i2", "question": "é 字", "answer": 1.5, "variants": []}, {"item_id": "i3", "question": None, "answer": None},
]


def result(item, original, right, trial=0, **more):
    return {"item_id": item, "trial": trial, "is_original": original, "extracted": 1.0, "expected": 1.0, "correct": right} | more


def test_datasets(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"metadata": {"n": 3}, "items": ITEMS}, indent=2, ensure_ascii=False))
    items = json_files.read_items(spark, str(tmp_path / "d.json"))
    flat = json_files.flatten(items).orderBy("parent_id", "variant_no").collect()
    assert [(r["parent_id"], r["item_id"], r["answer"], r["is_original"]) for r in flat] == [("i1", "i1", 5.0, True), ("i1", "i1_v0", 6.5, False), ("i1", "i1_v1", 7.0, False), ("i2", "i2", 1.5, True), ("i3", "i3", None, True)]
    assert tuple(json_files.totals(items).first()) == (3, 2)
    json_files.write_item_lines(items, str(tmp_path / "lines"))
    assert sorted(map(str, json_files.read_item_lines(spark, str(tmp_path / "lines")).collect())) == sorted(map(str, items.collect()))
    again = json_files.nested(json_files.flatten(items).filter("not is_original").drop("is_original"), items.select("item_id", "question", "answer"))
    assert {r["item_id"]: [v["item_id"] for v in r["variants"]] for r in again.collect()} == {"i1": ["i1_v0", "i1_v1"], "i2": [], "i3": []}
    (tmp_path / "bad.json").write_text('{"metadata": {}}')
    with pytest.raises(ValueError, match="no list of items"):
        json_files.read_items(spark, str(tmp_path / "bad.json"))


def test_documents_are_laid_out_as_by_json_dump(spark, tmp_path):
    rows = [(f"i{n}", None if n % 3 else 'é "x"\n字', n / 4, [{"item_id": f"i{n}_v0", "answer": None, "extra": n}] * (n % 4)) for n in range(300)]
    frame = spark.createDataFrame(rows, "item_id string, question string, answer double, variants array<struct<item_id:string,answer:double,extra:int>>").repartitionByRange(7, "answer").sortWithinPartitions("answer")
    head = {"metadata": {"n": 300, "by": ["a", "é"]}, "seed": 42}
    for ascii_ in (True, False):
        path = tmp_path / f"d{ascii_}.json"
        json_files.write_document(frame, str(path), head=head, ensure_ascii=ascii_)
        want = head | {"items": [{"item_id": i, "question": q, "answer": a, "variants": v} for i, q, a, v in rows]}
        assert path.read_text() == json.dumps(want, indent=2, ensure_ascii=ascii_)
    read = json_files.read_items(spark, str(tmp_path / "dTrue.json"))
    assert sorted((r["item_id"], r["question"], r["answer"], len(r["variants"])) for r in read.collect()) == sorted((i, q, a, len(v)) for i, q, a, v in rows)
    json_files.write_document(frame.filter("false"), str(tmp_path / "dTrue.json"))
    assert json.loads((tmp_path / "dTrue.json").read_text()) == {"items": []} and not [f for f in tmp_path.iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]
    json_files.write_report(spark.createDataFrame([("m", 0.5)], "model string, delta double"), str(tmp_path / "r.json"), {"model": "m"})
    assert json.loads((tmp_path / "r.json").read_text()) == {"model": "m", "rows": [{"model": "m", "delta": 0.5}]}


def test_results_give_the_same_report_as_rows(spark, tmp_path):
    runs = {m: {f"{i}_{k}_t{t}": result(f"i{i}", k == 0, (i * 3 + k + t + n) % 4 != 0, t) for i in range(6) for k in range(3) for t in range(2)} for n, m in enumerate(("mA", "mB"))}
    for m, raw in runs.items():
        (tmp_path / f"results_{m}.json").write_text(json.dumps({"model": m, "trials": 2, "n_results": len(raw), "raw_results": raw}, indent=2))
    (tmp_path / "results_unnamed.json").write_text(json.dumps({"raw_results": {"x": result("i0", True, True)}}))
    paths = [str(tmp_path / "results_mA.json"), str(tmp_path / "results_mB.json"), str(tmp_path / "absent.json")]
    read = json_files.read_results(spark, paths)
    rows = spark.createDataFrame([(m, k, r["item_id"], r["is_original"], r["correct"]) for m, raw in runs.items() for k, r in raw.items()], "model string, key string, item_id string, is_original boolean, correct boolean")
    report = lambda df: sorted(map(tuple, gaps.model_gaps(gaps.item_gaps(df)).collect()))
    assert read.count() == 72 and report(read) == report(rows)
    json_files.write_results(json_files.read_results(spark, paths), str(tmp_path / "again"))
    for m, raw in runs.items():
        made = json.loads((tmp_path / "again" / f"results_{m}.json").read_text())
        assert made["model"] == m and made["n_results"] == len(raw) and {k: {f: v[f] for f in raw[k]} for k, v in made["raw_results"].items()} == raw
    odd = spark.createDataFrame([("a/b é", 'k"1', 1.5), (None, "k", None)], "model string, key string, expected double")
    json_files.write_results(odd, str(tmp_path / "odd"))
    assert {tuple(r) for r in json_files.read_results(spark, [str(tmp_path / "odd" / "*.json")]).select("model", "key", "expected").collect()} == {("a/b é", 'k"1', 1.5), ("null", "k", None)}
    glob = json_files.read_results(spark, [str(tmp_path / "results_*.json")])
    assert {r["model"] for r in glob.select("model").distinct().collect()} == {"mA", "mB", "results_unnamed"}
    assert json_files.read_results(spark, [str(tmp_path / "no*.json")]).count() == 0


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("m", "k1", True), ("m", "k2", False), ("n", "k1", True), ("n", "k1", True)], "model string, key string, correct boolean")
    for _ in range(2):
        json_files.append_results(rows, str(tmp_path / "r"))
    json_files.append_results(spark.createDataFrame([("m", "k3", True)], rows.schema), str(tmp_path / "r"))
    assert sorted(tuple(r) for r in ResultLog(spark, str(tmp_path / "r")).read().select("model", "key", "correct").collect()) == [("m", "k1", True), ("m", "k2", False), ("m", "k3", True), ("n", "k1", True)]
    calls = []
    make = lambda: calls.append(1) or rows
    assert json_files.reuse_or_make(spark, str(tmp_path / "once"), make).count() == json_files.reuse_or_make(spark, str(tmp_path / "once"), make).count() == 4 and len(calls) == 1


def test_stream_of_results(spark, tmp_path):
    rows = spark.createDataFrame([("m", "k1", True, "2024-01-01 00:10:00"), ("m", "k1", True, "2024-01-01 00:10:00"), ("m", "k2", False, "2024-01-01 00:20:00"), ("n", "k1", None, "2024-01-01 02:00:00")], "model string, key string, correct boolean, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    log = ResultLog(spark, str(tmp_path / "out"))
    stream.sink(stream.once(source()), log, str(tmp_path / "c1")).awaitTermination(120)
    assert sorted((r["model"], r["key"]) for r in log.read().collect()) == [("m", "k1"), ("m", "k2"), ("n", "k1")]
    query = stream.accuracy_by_window(source()).writeStream.format("memory").queryName("acc").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r["model"], r["n"], round(r["accuracy"], 4)) for r in spark.table("acc").collect()) == [("m", 3, 0.6667), ("n", 1, 0.0)]


def test_shuffle_and_union(spark):
    rows = spark.createDataFrame([(i,) for i in range(500)], "id int")
    a, b, c = (selection.seeded_shuffle(rows, "id", s).orderBy("position").collect() for s in (1, 1, 2))
    order = [r["id"] for r in a]
    assert [r["position"] for r in a] == list(range(500)) and order == [r["id"] for r in b] and order != [r["id"] for r in c] and order != sorted(order)
    assert selection.any_of(rows, rows.filter("id < 5"), spark.createDataFrame([(900,)], "id int")).count() == 501


def test_items_of_a_laid_out_document_are_read_in_splits(spark, tmp_path):
    rows = [(f"i{i}", 'a "},\n    {" b\n  ],', float(i), [(f"i{i}_v{j}", float(j)) for j in range(i % 3)]) for i in range(200)]
    items = spark.createDataFrame(rows, "item_id string, question string, answer double, variants array<struct<item_id:string,answer:double>>")
    path = str(tmp_path / "d.json")
    json_files.write_document(items, path, head={"metadata": {"list": [1, {"a": 2}]}})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        read = json_files.read_items(spark, path)
        assert read.rdd.getNumPartitions() > 5
        got = [(r["item_id"], r["question"], r["answer"], [(v["item_id"], v["answer"]) for v in r["variants"]]) for r in read.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(got) == sorted(rows)
    json_files.write_document(items.limit(1), path)
    assert json_files.read_items(spark, path).count() == 1
    json_files.write_document(items.limit(2), path, indent=4)  # another layout is read whole
    assert json_files.read_items(spark, path).count() == 2


def test_documents_of_results_are_read_in_splits(spark, tmp_path):
    models = ["mA", "a/b é", "x{1}"]
    rows = [(m, f'{i}_"q\n    }},\n    "', f"i{i}", i % 2 == 0, "},\n é") for m in models for i in range(400)]
    made = spark.createDataFrame(rows, "model string, key string, item_id string, correct boolean, response string")
    folder = str(tmp_path / "r")
    json_files.write_results(made, folder)
    (tmp_path / "r" / "results_own.json").write_text(json.dumps({"raw_results": {"k": {"item_id": "z"}, "n": {}, "l": {"item_id": "y"}}}, indent=2))
    (tmp_path / "r" / "results_flat.json").write_text(json.dumps({"model": "flat", "raw_results": {"k": {"item_id": "w"}}}))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = json_files.read_results(spark, [f"{folder}/results_*.json", f"{folder}/absent.json"], split_from=1)
        got = [tuple(r) for r in read.select("model", "key", "item_id", "correct", "response").collect()]
        splits = read.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    own = [("results_own", "k", "z", None, None), ("results_own", "n", None, None, None), ("results_own", "l", "y", None, None), ("flat", "k", "w", None, None)]
    assert sorted(got, key=str) == sorted(rows + own, key=str)
    assert splits > 20
