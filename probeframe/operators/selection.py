"""Which rows count: newer over older results, resumed schedules, chosen sets, strides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of one slice of an order; positions are prefix sums over slices, so no task sorts the table.
SLICE_ROWS = 4096


def prefer_newer(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the columns of both sides' schema: the newer row where there is one; null keys are dropped."""
    values = [c for c in old.columns if c not in keys]
    pack = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pack(old, "older").join(pack(new, "newer"), keys, "full_outer").dropna(subset=keys)
    return both.select(*keys, F.coalesce("newer", "older").alias("x"), F.col("newer").isNotNull().alias("is_newer")).select(*keys, "x.*", "is_newer")


def schedule(items: DataFrame, trials: int) -> DataFrame:
    """Every item once for each trial, with the key that names the response."""
    return items.select("*", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")).withColumn("key", F.concat("item_id", F.lit("_t"), F.col("trial").cast("string")))


def not_done(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return planned.join(done.select(*keys), keys, "left_anti")


def within(rows: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(ids.select(*keys), keys, "left_semi")


def switch_source(first: DataFrame, second: DataFrame, clean: DataFrame, regenerated: DataFrame, expected: DataFrame, is_right) -> DataFrame:
    """Results of clean items from ``first`` as stored; of regenerated ones from ``second``, judged anew against ``expected(item_id, expected)``.

    Without a current expected value the stored one counts.
    """
    kept = within(first, clean, ["item_id"]).select("item_id", "extracted", "expected", "correct", F.lit("first").alias("origin"))
    redone = within(second, regenerated, ["item_id"]).join(expected.withColumnRenamed("expected", "now"), "item_id", "left")
    want = F.coalesce("now", "expected")
    redone = redone.select("item_id", "extracted", want.alias("expected"), is_right(F.col("extracted"), want).alias("correct"), F.lit("second").alias("origin"))
    return kept.unionByName(redone)


def positions(rows: DataFrame, group: str, order: str, at: str = "position") -> DataFrame:
    """``rows`` with their place, from 0, in the order of (``group``, ``order``), both whole numbers without nulls.

    Slices of ``order`` within a group are counted and summed up; only rows of
    one slice are sorted together.  The summing window holds one row a slice.
    """
    sliced = rows.withColumn("__slice", F.floor(F.col(order) / SLICE_ROWS))
    sums = sliced.groupBy(group, "__slice").agg(F.count("*").alias("__n"))
    by_group = sums.groupBy(group).agg(F.sum("__n").alias("__g"))
    groups = by_group.withColumn("__before", F.sum("__g").over(Window.orderBy(group)) - F.col("__g")).drop("__g")
    inner = Window.partitionBy(group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).drop("__n").join(groups, group)
    nth = F.row_number().over(Window.partitionBy(group, "__slice").orderBy(order)) - 1
    placed = sliced.withColumn("__nth", nth).join(sums, [group, "__slice"])
    return placed.withColumn(at, (F.col("__before") + F.col("__in") + F.col("__nth")).cast("long")).drop("__slice", "__nth", "__before", "__in")


def stride_sample(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """``n`` rows at an even stride through the order of (``group``, ``order``); all of them if there are no more."""
    placed = positions(rows, group, order)
    step = F.greatest(F.lit(1), F.floor(F.col("total") / n))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return placed.crossJoin(F.broadcast(total)).filter((F.col("position") % step == 0) & (F.col("position") < step * n)).drop("total")


def seeded_shuffle(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """``rows`` with ``shuffle_key`` and their ``position``, from 0, in the order of a hash of ``key`` and ``seed``; the same at every run.

    Positions are prefix sums over the hash's first 16 bits, so no task sorts the table; ``key`` is unique.
    """
    keyed = rows.withColumn("shuffle_key", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))), 256))
    keyed = keyed.withColumn("__part", F.substring("shuffle_key", 1, 4))
    sums = keyed.groupBy("__part").agg(F.count("*").alias("__n"))
    sums = sums.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__base"))  # 65,536 rows at most
    nth = F.row_number().over(Window.partitionBy("__part").orderBy("shuffle_key", key)) - 1
    return keyed.withColumn("__nth", nth).join(sums, "__part").withColumn("position", F.col("__base") + F.col("__nth")).drop("__part", "__nth", "__base")


def with_least(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The keys that have ``n`` rows or more."""
    return rows.groupBy(key).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") >= n)


def answer_invariant(items: DataFrame, variants: DataFrame, key: str) -> DataFrame:
    """The items all of whose variants have one answer, the item's own; ``items`` and ``variants`` have ``key`` and ``answer``."""
    one = variants.groupBy(key).agg(F.min("answer").alias("low"), F.max("answer").alias("high")).filter("low = high")
    return items.join(one, key).filter(F.col("answer") == F.col("low")).select(key, "answer")


def any_of(*ids: DataFrame) -> DataFrame:
    """The ids that at least one of the tables has."""
    found = ids[0]
    for more in ids[1:]:
        found = found.union(more)
    return found.distinct()


def tagged(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``rejected_by``: the name of the first rule that a row breaks, null for none."""
    found = F.lit(None).cast("string")
    for name, broken in reversed(rules.items()):
        found = F.when(F.coalesce(broken, F.lit(False)), name).otherwise(found)
    return rows.withColumn("rejected_by", found)
