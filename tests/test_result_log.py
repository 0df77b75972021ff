"""The results' log: killed writes, two writers, replaced rows, and streams that deliver rows again."""

from __future__ import annotations

import random
import threading

import pytest
from pyspark.sql import functions as F

from probeframe.operators import gaps
from probeframe.sources.result_log import Conflict, ResultLog
from probeframe.streaming import results as stream

SCHEMA = "model string, key string, correct boolean, ts timestamp, note string"


def frame(spark, rows):
    made = spark.createDataFrame([(m, k, c, "2024-01-01 00:00:00", n) for m, k, c, n in rows], SCHEMA.replace("ts timestamp", "ts string"))
    return made.withColumn("ts", F.col("ts").cast("timestamp"))


def held(log):
    return sorted(((r["model"] or "", r["key"] or "", r["correct"], r["note"]) for r in log.read().collect()), key=str)


def test_merge_adds_replaces_and_keeps(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "t"), buckets=4)
    assert log.read() is None and log.snapshot().version == -1 and log.compact() == -1
    assert log.merge(frame(spark, [("m", "a", True, "x"), ("m", "b", False, None), (None, None, None, "n"), ("m", "a", True, "x")])) == 0
    first = log.snapshot()
    assert held(log) == sorted([("m", "a", True, "x"), ("m", "b", False, None), ("", "", None, "n")], key=str)
    log.merge(frame(spark, [("m", "a", True, "x"), (None, None, None, "n")]))  # nothing new: a commit without a folder
    assert len(log.snapshot().folders) == 1 and not log.snapshot().updates
    log.merge(frame(spark, [("m", "b", True, "later"), ("n", "a", True, "y")]))
    want = sorted([("m", "a", True, "x"), ("m", "b", True, "later"), ("n", "a", True, "y"), ("", "", None, "n")], key=str)
    assert held(log) == want and log.snapshot().updates
    assert log.read(first).count() == 3  # an older snapshot still reads as it was
    log.compact()
    assert held(log) == want and len(log.snapshot().folders) == 1 and not log.snapshot().updates
    assert log.vacuum() >= 2 and held(log) == want
    log.merge(frame(spark, [("m", "b", True, "later")]))
    assert held(log) == want
    log.merge(spark.createDataFrame([], SCHEMA))
    assert held(log) == want


def test_killed_write_is_never_seen(spark, tmp_path, monkeypatch):
    log = ResultLog(spark, str(tmp_path / "t"), buckets=4)
    log.merge(frame(spark, [("m", "a", True, "x")]), "app", 0)
    with monkeypatch.context() as m:
        m.setattr(ResultLog, "_create", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            log.merge(frame(spark, [("m", "b", True, "x")]), "app", 1)
    assert held(log) == [("m", "a", True, "x")] and len(list(log.orphans())) == 1
    log.merge(frame(spark, [("m", "b", True, "x")]), "app", 1)  # the run again
    log.merge(frame(spark, [("m", "b", False, "other")]), "app", 1)  # a batch that is committed already
    assert held(log) == [("m", "a", True, "x"), ("m", "b", True, "x")]
    assert log.vacuum() == 1 and held(log) == [("m", "a", True, "x"), ("m", "b", True, "x")]


def test_interleaved_writers_store_a_key_once(spark, tmp_path, monkeypatch):
    one, two = (ResultLog(spark, str(tmp_path / "t"), buckets=4) for _ in range(2))
    create, calls = ResultLog._create, []

    def late(self, path, text):
        if self is one and not calls:  # the other writer commits between this one's look and its commit
            calls.append(1)
            two.merge(frame(spark, [("m", "a", True, "x"), ("m", "c", True, "x")]))
        create(self, path, text)

    monkeypatch.setattr(ResultLog, "_create", late)
    one.merge(frame(spark, [("m", "a", True, "x"), ("m", "b", True, "x")]))
    assert held(one) == [("m", k, True, "x") for k in "abc"] and one.snapshot().version == 1 and not one.snapshot().updates
    with pytest.raises(Conflict):
        create(one, f"{one.path}/log/{1:020d}.json", "{}")


def test_writers_at_once(spark, tmp_path):
    errors = []

    def write(i):
        try:
            ResultLog(spark, str(tmp_path / "t"), buckets=4).merge(frame(spark, [("m", f"k{j}", True, "x") for j in range(i, i + 4)]))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=write, args=(i,)) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    log = ResultLog(spark, str(tmp_path / "t"))
    assert not errors and held(log) == [("m", f"k{j}", True, "x") for j in range(7)] and log.snapshot().version == 3


def test_stream_that_delivers_again(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"m{i % 2}", f"i{i % 7}_v{v}_t{t}", f"i{i % 7}", v == 0, rng.random() < 0.6, f"2024-01-01 00:{t:02d}:{i:02d}") for i in range(14) for v in range(3) for t in range(2)]
    schema = "model string, key string, item_id string, is_original boolean, correct boolean, ts string"
    whole = spark.createDataFrame(rows, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    batches = [rows[:50], rows[30:70] + rows[:10], rows[60:] + rows[5:45]]  # each has rows of those before, the last all that is left
    source = lambda: spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    log, counts = ResultLog(spark, str(tmp_path / "out"), buckets=4), ResultLog(spark, str(tmp_path / "counts"), ("model", "item_id"), buckets=4)
    for i, batch in enumerate(batches):  # a start from the checkpoint for each
        spark.createDataFrame(batch, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.sink(source() if i % 2 else stream.once(source()), log, str(tmp_path / f"c{i % 2}"), app=f"app{i % 2}").awaitTermination(180)
        stream.upsert(stream.item_counts(source()), counts, str(tmp_path / "c"), app="counts").awaitTermination(180)
    report = lambda df: {r["model"]: [round(x, 9) if isinstance(x, float) else x for x in r] for r in df.collect()}
    want = report(gaps.model_gaps(gaps.item_gaps(whole)))
    assert log.read().count() == len(rows) and report(gaps.model_gaps(gaps.item_gaps(log.read()))) == want
    assert counts.snapshot().updates and report(stream.report(counts.read())) == want


def test_new_rows_and_stored_hashes_are_shuffled_once(spark, tmp_path):
    log = ResultLog(spark, str(tmp_path / "once"))
    rows = spark.createDataFrame([("m", "k1", 1), ("m", None, 2), (None, "k2", 3)], "model string, key string, v int")
    log.merge(rows)
    later = spark.createDataFrame([("m", None, 2), ("m", "k1", 5), (None, "k2", 3), ("n", "k", None)], rows.schema)
    met = log._keyed(later, log._stored(log.snapshot(), ["model", "key", "__bucket", "__hash", "__version"]))
    assert "Join" not in met._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["model"], r["key"]): r["__was"] == r["__hash"] if r["__was"] else None for r in met.collect()} == {("m", None): True, ("m", "k1"): False, (None, "k2"): True, ("n", "k"): None}
    log.merge(later)
    assert sorted(map(tuple, log.read().select("model", "key", "v").collect()), key=str) == sorted([("m", None, 2), ("m", "k1", 5), (None, "k2", 3), ("n", "k", None)], key=str)
