"""Accuracy gaps between original items and their variants.

One conditional aggregation by (model, item), then one by model: both combine
on the map side, so a model or item with a third of all responses is one
partial row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.functions import verdicts

FLAG = 0.5
Z95 = 1.96


def item_gaps(responses: DataFrame) -> DataFrame:
    """``model, item_id, p_orig, p_iso, n_orig, n_var, delta``; items with both kinds of response only. A null ``correct`` is wrong."""
    right = F.coalesce(F.col("correct"), F.lit(False)).cast("double")
    original = F.col("is_original")
    rows = responses.groupBy("model", "item_id").agg(
        F.avg(F.when(original, right)).alias("p_orig"),
        F.avg(F.when(~original, right)).alias("p_iso"),
        F.count(F.when(original, 1)).alias("n_orig"),
        F.count(F.when(~original, 1)).alias("n_var"),
    )
    return rows.filter("n_orig > 0 and n_var > 0").withColumn("delta", F.col("p_orig") - F.col("p_iso"))


def item_counts(responses: DataFrame) -> DataFrame:
    """The counts behind pooled accuracy: right and all responses of originals and variants."""
    right = F.coalesce(F.col("correct"), F.lit(False)).cast("long")
    original = F.col("is_original")
    return responses.groupBy("model", "item_id").agg(
        F.sum(F.when(original, right).otherwise(0)).alias("right_orig"), F.count(F.when(original, 1)).alias("n_orig"),
        F.sum(F.when(~original, right).otherwise(0)).alias("right_var"), F.count(F.when(~original, 1)).alias("n_var"),
    )


def gaps_of_counts(counts: DataFrame) -> DataFrame:
    """:func:`item_gaps` from :func:`item_counts`."""
    both = counts.filter("n_orig > 0 and n_var > 0").withColumns({"p_orig": F.col("right_orig") / F.col("n_orig"), "p_iso": F.col("right_var") / F.col("n_var")})
    return both.select("model", "item_id", "p_orig", "p_iso", "n_orig", "n_var", (F.col("p_orig") - F.col("p_iso")).alias("delta"))


def standard_error(delta: Column, sample: bool) -> Column:
    """Of the mean; with n-1 (``sample``) or n degrees; 0 for a single item."""
    n = F.count(delta)
    spread = F.stddev_samp(delta) if sample else F.stddev_pop(delta)
    return F.when(n > 1, spread / F.sqrt(n)).otherwise(F.lit(0.0))


def variance_weighted(delta: Column) -> Column:
    """Mean gap weighted by each item's variance; two points have variance delta^2 / 4, so it is sum(d^3) / sum(d^2)."""
    cubes, squares = F.sum(delta * delta * delta), F.sum(delta * delta)
    return F.when(squares > 0, cubes / squares).otherwise(F.lit(0.0))


def model_gaps(items: DataFrame) -> DataFrame:
    """One row per model: accuracies as means of item means, gap, errors, interval, weighted gap, flags, verdict."""
    d = F.col("delta")
    rows = items.groupBy("model").agg(
        F.count("*").alias("n_items"), F.avg("p_orig").alias("acc_orig"), F.avg("p_iso").alias("acc_iso"), F.avg(d).alias("delta"),
        standard_error(d, True).alias("se"), standard_error(d, False).alias("se_pop"), variance_weighted(d).alias("delta_irt"),
        F.sum((d > FLAG).cast("long")).alias("n_flagged"),
    )
    return rows.select(
        "*", (F.col("delta") - Z95 * F.col("se")).alias("ci_low"), (F.col("delta") + Z95 * F.col("se")).alias("ci_high"),
        (F.col("n_flagged") / F.col("n_items")).alias("flagged_share"), verdicts.by_gap(F.col("delta")).alias("archetype"),
    )


def pooled_gaps(counts: DataFrame) -> DataFrame:
    """Accuracies as right over all responses of the items that have both kinds."""
    kept = counts.filter("n_orig > 0 and n_var > 0").groupBy("model").agg(
        F.count("*").alias("n_items"), F.sum("right_orig").alias("ro"), F.sum("n_orig").alias("no"), F.sum("right_var").alias("rv"), F.sum("n_var").alias("nv")
    )
    orig, iso = F.col("ro") / F.col("no"), F.col("rv") / F.col("nv")
    return kept.select("model", "n_items", orig.alias("acc_orig"), iso.alias("acc_iso"), (orig - iso).alias("delta"))


#: Attempts of a slice of :func:`running_accuracy`, on the average.
SLICE_ROWS = 8192


def running_accuracy(attempts: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Accuracy of each model over its attempts so far, in the order of (ts, event_id).

    Prefix sums in two levels: within slices of a model's time, and over the
    slices' totals.  Seconds are counted first and cut into slices by how many
    attempts came before them, so a burst is cut up to the second and the
    number of slices grows with the rows.
    """
    rows = attempts.withColumn("second", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)).withColumn("right", F.coalesce(F.col("correct"), F.lit(False)).cast("long"))
    seconds = rows.groupBy("model", "second").agg(F.count("*").alias("n"), F.sum("right").alias("r"))
    # the seconds' own sums, again in two levels: by day and within the day
    day = F.floor(F.col("second") / 86_400)
    days = seconds.groupBy("model", day.alias("day")).agg(F.sum("n").alias("n"), F.sum("r").alias("r"))
    before = Window.partitionBy("model").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    days = days.select("model", "day", F.coalesce(F.sum("n").over(before), zero).alias("n_day"), F.coalesce(F.sum("r").over(before), zero).alias("r_day"))
    inside = Window.partitionBy("model", "day").orderBy("second").rowsBetween(Window.unboundedPreceding, -1)
    placed = seconds.withColumn("day", day).join(days, ["model", "day"])
    placed = placed.select(
        "model", "second", (F.col("n_day") + F.coalesce(F.sum("n").over(inside), zero)).alias("n0"), (F.col("r_day") + F.coalesce(F.sum("r").over(inside), zero)).alias("r0")
    )
    joined = rows.join(placed, ["model", "second"]).withColumn("slice", F.floor(F.col("n0") / slice_rows))
    first = Window.partitionBy("model", "slice").orderBy("second", "ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    base = Window.partitionBy("model", "slice")
    done = F.min("n0").over(base) + F.count("*").over(first)
    right = F.min("r0").over(base) + F.sum("right").over(first)
    return joined.select("model", "event_id", done.alias("n_done"), (right / done).alias("accuracy"))


def histogram(items: DataFrame, low: float = -0.5, high: float = 1.0, bins: int = 20) -> DataFrame:
    """Counts of gaps by bin; values outside are dropped, the last bin is closed on the right."""
    width = (high - low) / bins
    inside = items.filter(F.col("delta").between(low, high))
    at = F.least(F.floor((F.col("delta") - low) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy("model", at.alias("bin")).agg(F.count("*").alias("n"))


def extraction_rates(answers: DataFrame) -> DataFrame:
    """Share of responses with an extracted answer, of originals and of variants; 0 where there are none."""
    got, original = F.col("extracted").isNotNull().cast("double"), F.col("is_original")
    return answers.groupBy("model").agg(
        F.coalesce(F.avg(F.when(original, got)), F.lit(0.0)).alias("rate_orig"), F.coalesce(F.avg(F.when(~original, got)), F.lit(0.0)).alias("rate_var")
    )
