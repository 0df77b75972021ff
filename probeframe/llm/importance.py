"""Resampling documents towards a target's distribution (operator 11).

Two Arrow passes over the texts.  The first makes one vector of bucket counts a
partition (``numpy.bincount``), merged by ``treeReduce``, so the driver gets a
few vectors of fixed length.  The second gathers each feature's gain, the log
ratio of target to source frequency, from a broadcast of that fixed length and
sums documents with weighted bin counts.  Gumbel noise turns the k highest
scores into a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.llm._shared import bounded_batches, materialize, terms_of

#: Buckets of hashed features; shortest and longest run of words that is a feature.
BUCKETS, RUNS = 10_000, (1, 1)
#: Words of a document that may be drawn; percent of those that are; text before the id in the noise's hash.
LEAST_WORDS, PERCENT, SEED = 20, 10, "2024:"
#: Levels of the tree that merges the partitions' vectors.
DEPTH = 3
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition.
_ROW_BITS = 33


def buckets_of(words: list[bytes], runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every feature of a document, repeats included."""
    features = words if runs == (1, 1) else [b" ".join(words[i : i + k]) for k in range(runs[0], runs[1] + 1) for i in range(len(words) - k + 1)]
    return np.fromiter(map(zlib.crc32, features), np.int64, len(features)) % buckets


def bucket_counts(texts: DataFrame, text: str = "text", runs: tuple[int, int] = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all ``texts`` by bucket; null and empty texts have none, an empty table gives zeros."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            found = [buckets_of(terms_of(t), runs, buckets) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            if found:
                total += np.bincount(np.concatenate(found), minlength=buckets)
        yield pa.RecordBatch.from_pydict({"counts": pa.array([total.tobytes()], pa.binary())})

    spark = texts.sparkSession
    with bounded_batches(spark):
        vectors = texts.select(F.col(text).cast("string")).mapInArrow(counted, "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
        none = spark.sparkContext.parallelize([0], 1).map(lambda _: np.zeros(buckets, np.int64))
        return vectors.union(none).treeReduce(np.add, DEPTH)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the natural log of each bucket's smoothed target frequency over its source frequency, rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t)))))


def weigh(docs: DataFrame, gain: np.ndarray, doc_id: str = "doc_id", text: str = "text", runs: tuple[int, int] = RUNS) -> DataFrame:
    """``doc_id, mark, n_words, n_features, weight`` of every row, a written table; ``mark`` is a hash of the text.

    Sums of whole gains are exact in doubles up to 2^53.
    """
    spark = docs.sparkSession
    shared, buckets = spark.sparkContext.broadcast(gain), len(gain)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for batch in batches:
            words = [terms_of(t) for t in batch.column(2).cast(pa.binary()).to_pylist()]
            found = [buckets_of(w, runs, buckets) for w in words]
            sizes = np.array([len(f) for f in found], np.int64)
            rows = np.repeat(np.arange(len(found)), sizes)
            gathered = of[np.concatenate(found)] if found else np.zeros(0)
            weight = np.bincount(rows, weights=gathered, minlength=len(found)).astype(np.int64)
            made = {"n_words": np.array([len(w) for w in words], np.int64), "n_features": sizes, "weight": weight}
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, made.values())], ["doc_id", "mark", *made])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).cast("string").alias("text"))
    with bounded_batches(spark):
        return materialize(rows.mapInArrow(summed, "doc_id long, mark long, n_words long, n_features long, weight long"), "weights")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of sha256 of seed and id; a null id counts as ``null``."""
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.log(-F.log((drawn.cast("double") + 0.5) / 4294967296)))


def ranked(scored: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored``, a written table, with ``rank``: 1 for the highest score, up to the drawn share of the rows of enough words; else null.

    Ties go to the smaller id, null last.  Rows are sorted by range over all
    tasks and written; a row's rank is its place in its range plus the rows of
    the ranges before, one figure a range.  No task holds more than a range.
    """
    kept = F.col("n_words") >= least_words
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("row")]
    # equal rows are told apart by where they stand, so that copies of one row don't fill a range
    eligible = scored.filter(kept).withColumn("row", F.monotonically_increasing_id())
    placed = eligible.repartitionByRange(*order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "placed")
    span = F.shiftright("at", _ROW_BITS).alias("span")
    sizes = materialize(placed.groupBy(span).agg(F.count("*").alias("n")), "spans")
    drawn = (sizes.agg(F.sum("n")).first()[0] or 0) * percent // 100
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shuffle partition
    starts = sizes.select("span", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    placed = placed.withColumn("span", span).join(F.broadcast(starts), "span").withColumn("rank", F.when(rank <= drawn, rank))
    rest = scored.filter(~kept).withColumn("rank", F.lit(None).cast("long"))
    return placed.select(rest.columns).union(rest)


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", runs: tuple[int, int] = RUNS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED) -> DataFrame:
    """``doc_id, mark, n_words, n_features, weight, score, rank`` of every row of ``docs``; ``rank`` is null for rows that aren't drawn.

    Null and empty texts have no features and weight 0; rows that repeat are
    rows of their own, each drawn for itself; an empty ``docs`` gives an empty
    result, an empty ``target`` counts as no features.  Other columns aren't read.
    """
    gain = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    weighed = weigh(docs, gain, doc_id, text, runs)
    return ranked(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), least_words, percent)


def drawn_documents(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn rows with the columns of ``docs``; ``found`` is the result of :func:`resample`.

    Rows of equal id and text stand for each other: each drawn one gives a row.
    """
    drawn = found.filter("rank is not null").select(F.col("doc_id").alias("__doc"), F.col("mark").alias("__mark"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("mark"))
    one = rows.groupBy("id", "mark").agg(F.first("row").alias("row"))
    met = drawn.hint("merge").join(one, F.col("id").eqNullSafe(F.col("__doc")) & (F.col("mark") == F.col("__mark")))
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns])
