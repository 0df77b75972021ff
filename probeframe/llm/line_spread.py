"""Line dedup by the number of sites that carry a line (operator 5); DataFrame functions only.

Every line hash gets a HyperLogLog sketch of its sites, merged by aggregation.
A line whose estimate is clearly above or below the threshold is decided by its
sketch; lines near it get exact distinct counts.  Lines that spread over the
threshold are boilerplate and go everywhere but at their first occurrence, so
that text shared by whole documents stays in the collection once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeframe.llm._shared import HEAVY_KEYS, materialize, meet

#: Distinct sites from which a line is boilerplate; log2 of the sketch's registers.
MIN_SITES, LOG_REGISTERS = 8, 10
#: Standard errors of the sketch within which a line counts as near the threshold.
NEAR_ERRORS = 4
BLANKS = "[ \\t\\x0B\\f\\r]+"


def normal(line: Column) -> Column:
    """A line as it is compared: trimmed of blanks; case and inner blanks count."""
    return F.regexp_replace(line, f"^{BLANKS}|{BLANKS}$", "")


def lines_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``doc, mark, site, pos, line_hash`` for each line that isn't blank.

    A line's identity is two independent 64-bit hashes, as one pair.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc"), F.xxhash64(text).alias("mark"),
        F.coalesce(F.concat(F.lit("s"), F.col(site)), F.lit("none")).alias("site"),
        F.posexplode(F.transform(F.split(F.col(text), "\n"), normal)).alias("pos", "line"),
    )
    return rows.filter("line <> ''").select("doc", "mark", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Every occurrence ``h1, h2, doc, mark, pos, first`` of a line on ``min_sites`` sites or more; ``lines`` is a written table.

    One aggregation makes sketches, counts and first occurrences.  A line that
    occurs fewer times than ``min_sites`` can't spread so far and is left out
    before its sketch is read.  A hot line costs one partial sketch per task,
    and its occurrences meet their verdict where they are (:func:`meet`).
    """
    sketched = lines.groupBy("h1", "h2").agg(
        F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc", "mark", "pos")).alias("first")
    )
    error = 1.04 / (1 << LOG_REGISTERS) ** 0.5 * NEAR_ERRORS
    low, high = min_sites * (1 - error) - 1, min_sites * (1 + error) + 1
    many = F.col("n") > lines.count() / HEAVY_KEYS
    estimated = sketched.filter((F.col("n") >= min_sites) | many).select("h1", "h2", "first", many.alias("many"), F.hll_sketch_estimate("sketch").alias("estimate"))
    estimated = materialize(estimated.filter((F.col("estimate") >= low) | F.col("many")), "sketches")
    heavy = estimated.filter("many").select("h1", "h2")
    hits = materialize(meet(lines, estimated.filter(F.col("estimate") >= low).select("h1", "h2", "first", "estimate"), ["h1", "h2"], heavy), "hits")
    near = hits.filter(F.col("estimate") <= high)
    counted = near.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    near = meet(near, materialize(counted.select("h1", "h2"), "counted"), ["h1", "h2"], heavy)
    columns = ["h1", "h2", "doc", "mark", "pos", "first"]
    return hits.filter(F.col("estimate") > high).select(*columns).union(near.select(*columns))


def _without(parts: Column, gone: Column) -> Column:
    """``parts`` without the places ``gone`` (from 0, ascending): the slices between them, so the cost is linear."""
    edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(parts)))
    between = F.transform(F.sequence(F.lit(1), F.size(gone) + 1), lambda i: F.slice(parts, F.element_at(edges, i) + 2, F.element_at(edges, i + 1) - F.element_at(edges, i) - 1))
    return F.flatten(between)


def remove_spread_lines(docs: DataFrame, min_sites: int = MIN_SITES, doc_id: str = "doc_id", text: str = "text", site: str = "source") -> DataFrame:
    """``docs`` with its columns; ``text`` loses the boilerplate lines, ``n_chars``, if present, is counted anew.

    Every row stays, a text all of whose lines went becomes empty; null texts
    stay null; a null site counts as one site.  The first occurrence is that
    with the smallest (id, hash of text, line number).  Rows that repeat are
    treated alike.  Lines that stay keep their bytes and order.  Lines are split
    and hashed once; texts meet their lost lines by one merge join at any size.
    """
    lines = materialize(lines_of(docs, doc_id, text, site), "lines")
    hits = spread_lines(lines, min_sites).filter(~F.struct("doc", "mark", "pos").eqNullSafe(F.col("first")))
    gone = hits.groupBy(F.col("doc").alias("__doc"), F.col("mark").alias("__mark")).agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    gone = materialize(gone, "gone")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    same = F.col(f"row.{doc_id}").eqNullSafe(F.col("__doc")) & (F.xxhash64(f"row.{text}") == F.col("__mark"))
    joined = rows.hint("merge").join(gone, same, "left")
    kept = F.array_join(_without(F.split(F.col(f"row.{text}"), "\n"), F.col("gone")), "\n")
    new_text = F.when(F.col("gone").isNull(), F.col(f"row.{text}")).otherwise(kept)
    made = joined.select("row", new_text.alias("made"))
    new = {text: F.col("made"), "n_chars": F.length("made").cast("long")}
    return made.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
