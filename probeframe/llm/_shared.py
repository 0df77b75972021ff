"""Scratch tables, checked broadcasts and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; the bound is checked by a count first.
BROADCAST_ROWS = 50_000
#: Keys that can hold over a thousandth of all rows: the proven bound of :func:`meet`'s broadcast.
HEAVY_KEYS = 1000
#: The run of white space that separates words in the contracts.
WORD = r"[^\x20\x09-\x0D]+"
#: A term: a run of letters and digits of ASCII and of all other characters; A-Z count as a-z.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is made once and set as the
    session's checkpoint folder, but only for a local master (tests, a laptop).
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="probeframe-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/probeframe/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes ``df`` to the shared folder and returns a scan of it.

    It cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches that go to Python: texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


@contextmanager
def bounded_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> Iterator[None]:
    """While it lasts, Arrow batches that go to Python hold so many rows and bytes at most; jobs must run inside."""
    names = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def terms_of(raw: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, as :data:`TERM` has them; null has none."""
    return raw.translate(_TERM_BYTES).split() if raw else []


def term_column(text: Column) -> Column:
    """The terms of a text as an array, in order; null for a null text."""
    return cased_terms(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def cased_terms(text: Column) -> Column:
    """The same in the text's own case.  Split and not extracted: extraction copies the text for every match."""
    return F.filter(F.split(text, _BETWEEN), lambda t: t != "")


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, marked for broadcast only if a count proves it has at most ``rows`` rows.

    Give it a materialized table: the count reads it.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def meet(rows: DataFrame, table: DataFrame, keys: list[str], heavy: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, which has each of its ``keys`` once; ``rows`` is a written table.

    Keys that hold more than a thousandth of the rows, of which there can't be
    over a thousand, meet their row of ``table`` by broadcast; all others by a
    merge join, in which then no key weighs more than a thousandth.  The plan
    is the same at every size.  ``heavy`` is the table of those keys if it is
    known already.  With ``how="left"`` rows without a match stay.  Null keys
    match nothing.
    """
    if heavy is None:
        share = rows.count() / HEAVY_KEYS
        heavy = materialize(rows.groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > share).select(*keys), "heavy")
    heavy = heavy.select(*keys).join(table.withColumn("__met", F.lit(True)), keys, "left").withColumn("__heavy", F.lit(True))
    added = [c for c in table.columns if c not in keys]
    flagged = rows.join(F.broadcast(materialize(heavy, "heavy_rows")), keys, "left")
    hot = flagged.filter("__heavy").filter(F.lit(True) if how == "left" else F.col("__met")).drop("__met", "__heavy")
    cold = flagged.filter("__heavy is null").drop("__met", "__heavy", *added).hint("merge").join(table, keys, how)
    return hot.unionByName(cold)


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def connected_components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, root)`` for every id that occurs in ``links(a, b)``; root is the smallest id reachable.

    Alternating large-star and small-star steps over grouped minima; every
    round is written to the shared folder, and the number of rounds grows with
    the logarithm of the longest chain.  No vertex gathers its neighbours: each
    step is a minimum and a join, so a vertex with very many links stays spread.
    """
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    vertices = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).distinct()
    parents = materialize(vertices.select("id", F.col("id").alias("root")), "roots")
    for _ in range(rounds):
        # every vertex takes the least root in its neighbourhood ...
        both = edges.union(edges.select("v", "u"))
        seen = both.join(parents.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("root").alias("least"))
        hooked = parents.join(seen, parents.id == seen.u, "left").select(
            "id", "root", F.least("root", F.coalesce("least", "root")).alias("low")
        )
        # ... its old root too, so that whole trees hook at once, and then the root's root
        hooked = materialize(hooked, "low")
        moved = materialize(hooked.groupBy("root").agg(F.min("low").alias("to")), "moved")
        step = hooked.join(moved, "root", "left").select("id", F.col("root").alias("was"), F.least("low", "to").alias("mid"))
        step = materialize(step, "hooked")
        up = step.select(F.col("id").alias("mid"), F.col("mid").alias("top"))
        following = materialize(
            step.join(up, "mid", "left").select("id", "was", F.least("mid", F.coalesce("top", "mid")).alias("root")), "roots"
        )
        changed = following.filter("root <> was").limit(1).count()
        parents = following.select("id", "root")
        if not changed:
            return parents
    raise RuntimeError(f"components did not settle in {rounds} rounds")
