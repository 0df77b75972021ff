"""Joins that a popular key doesn't hold up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probeframe.operators.scratch import written

#: Keys that can each hold over a thousandth of all rows: the proven bound of the broadcast.
MOST_HEAVY = 1000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """``rows`` joined with ``counted``, which has each of their keys once and in ``n`` the number of rows that have it.

    Keys with more than a thousandth of the rows, of which there can't be over a
    thousand, meet their rows by broadcast where these are; all others by a
    shuffle, in which then no key weighs more than a thousandth.  The plan is the
    same at every size.  Null keys match nothing.
    """
    counted = written(counted)
    share = (counted.agg(F.sum(n)).first()[0] or 0) / MOST_HEAVY
    heavy = counted.filter(F.col(n) > share).withColumn("__heavy", F.lit(True))
    added = [c for c in counted.columns if c not in keys]
    flagged = rows.join(F.broadcast(heavy), keys, "left")
    hot = flagged.filter("__heavy").drop("__heavy")
    cold = flagged.filter("__heavy is null").drop("__heavy", *added).join(counted.filter(F.col(n) <= share), keys)
    return hot.unionByName(cold)
