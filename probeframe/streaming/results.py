"""Results as a stream: a table with one row a key, running gaps, accuracy by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from probeframe.operators import gaps
from probeframe.sources.result_log import ResultLog


def once(results: DataFrame, time: str = "ts", late: str = "1 day", keys: tuple[str, ...] = ("model", "key")) -> DataFrame:
    """``results`` without those delivered again within ``late`` of event time, across batches; state older than that goes.

    A result that comes later than ``late`` behind the newest is dropped, as
    every stateful operator on a watermark does: set it to the longest delay of
    a first delivery.  So are, from the second batch on, times before 1970 or null.
    """
    return results.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def sink(results: DataFrame, log: ResultLog, checkpoint: str, app: str = "results", **trigger) -> StreamingQuery:
    """Merges each micro-batch into ``log`` by its keys, in one commit a batch.

    A batch that runs again after a failure is known by ``app`` and its number
    and changes nothing; a result delivered again in any later batch finds its
    key stored, however late.  Put :func:`once` before it to spare the log what
    comes again soon.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        log.merge(batch, app, batch_id)

    return results.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def item_counts(results: DataFrame, time: str = "ts", late: str = "1 day") -> DataFrame:
    """Running counts of each model and item, each result counted once: for :func:`upsert` in update mode.

    The counts are those of ``gaps.item_counts``; state is one row an item and
    model, and one a result until ``late`` has passed.
    """
    return gaps.item_counts(once(results, time, late))


def upsert(counts: DataFrame, log: ResultLog, checkpoint: str, app: str = "counts", **trigger) -> StreamingQuery:
    """The rows that a batch changes, stored in place of the former ones; ``log`` has the keys ``model, item_id``."""

    def store(batch: DataFrame, batch_id: int) -> None:
        log.merge(batch, app, batch_id)

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def report(counts: DataFrame) -> DataFrame:
    """The report of each model from stored counts, as ``gaps.model_gaps`` gives it for the results themselves."""
    return gaps.model_gaps(gaps.gaps_of_counts(counts))


def accuracy_by_window(results: DataFrame, time: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """``model, begin, n, accuracy`` of each model and window of time; rows later than ``late`` are dropped, a null ``correct`` is wrong."""
    right = F.coalesce(F.col("correct"), F.lit(False)).cast("double")
    rows = results.withWatermark(time, late).groupBy("model", F.window(time, width).alias("w"))
    return rows.agg(F.count("*").alias("n"), F.avg(right).alias("accuracy")).select("model", F.col("w.start").alias("begin"), "n", "accuracy")
