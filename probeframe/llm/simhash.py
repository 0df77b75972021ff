"""SimHash near-dedup by tiled exact comparison (operator 8).

Distinct fingerprints are grouped by the population counts of their four
quarters.  Two fingerprints that differ in r bits have counts that differ by r
at most in sum, so only tiles whose counts are that near are compared, each pair
of tiles by numpy's exclusive-or and bit count.  A pair of tiles gives a
spanning forest of its links, never all pairs of a group; components follow by
grouped minima.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.llm._shared import broadcast_if_small, connected_components, materialize, small_batches

#: Bits that linked fingerprints may differ in; words of a shingle; fingerprints of a tile.
RADIUS, SHINGLE, TILE = 3, 3, 4096
SEED = 42


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """A text's fingerprint, unsigned: a bit is 1 if set in over half of the shingles' hashes.

    ``bytes.lower`` and ``bytes.split`` touch exactly A-Z and the six ASCII
    blanks.  Long texts are counted by pieces, so memory is bounded by the text.
    """
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = [b" ".join(t) for t in zip(*(tokens[i:] for i in range(words)), strict=False)]
    counts = np.zeros(64, np.int64)
    for a in range(0, len(shingles), 16384):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[a : a + 16384]], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * counts > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, fp`` of every row, a written table; ``fp`` is the fingerprint as a signed long, ``mark`` a hash of the text."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))

    return materialize(docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), of(F.coalesce(F.col(text), F.lit(""))).alias("fp")), "fingerprints")


def _quarter(fp: Column, k: int) -> Column:
    return F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(F.lit(65535)))


def _cell(quarters: list[Column]) -> Column:
    return sum(q * 17**k for k, q in enumerate(quarters))


def links_within(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``a, b``: links that connect every two distinct fingerprints of ``fps(fp)`` within ``radius`` bits, directly or by others so linked."""
    quarters = [_quarter(F.col("fp"), k).cast("int") for k in range(4)]
    placed = fps.select("fp", *[q.alias(f"q{k}") for k, q in enumerate(quarters)]).withColumn("cell", _cell([F.col(f"q{k}") for k in range(4)]))
    # at most 17^4 cells, whatever the input: their table may be broadcast
    cells = materialize(placed.groupBy("cell", "q0", "q1", "q2", "q3").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "cells")
    tiles = placed.join(F.broadcast(cells.select("cell", "tiles")), "cell").withColumn("tile", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("tiles")).cast("int"))
    tiles = materialize(tiles.groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")), "tiles")

    # every unordered pair of cells whose counts differ by the radius at most: half of the offsets
    steps = [o for o in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, o)) <= radius and o >= (0, 0, 0, 0)]
    offsets = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(o)]) for o in steps])
    near = cells.select("cell", "tiles", *[f"q{k}" for k in range(4)], F.explode(offsets).alias("o"))
    moved = [F.col(f"q{k}") + F.col(f"o.d{k}") for k in range(4)]
    for q in moved:
        near = near.filter(q.between(0, 16))
    near = near.select(F.col("cell").alias("cell_a"), F.col("tiles").alias("n_a"), _cell(moved).alias("cell_b"))
    pairs = near.join(F.broadcast(cells.select(F.col("cell").alias("cell_b"), F.col("tiles").alias("n_b"))), "cell_b")
    pairs = pairs.select("cell_a", "cell_b", "n_b", F.explode(F.sequence(F.lit(0), F.col("n_a") - 1)).alias("tile_a"))
    pairs = pairs.select("cell_a", "cell_b", "tile_a", F.explode(F.sequence(F.lit(0), F.col("n_b") - 1)).alias("tile_b"))
    pairs = pairs.filter((F.col("cell_a") != F.col("cell_b")) | (F.col("tile_a") <= F.col("tile_b")))
    side = lambda s: tiles.select(F.col("cell").alias(f"cell_{s}"), F.col("tile").alias(f"tile_{s}"), F.col("fps").alias(f"fps_{s}"))
    # the planner takes exploded sequences for small; pairs of tiles grow with the square of the tiles
    loaded = pairs.hint("merge").join(side("a"), ["cell_a", "tile_a"]).hint("merge").join(side("b"), ["cell_b", "tile_b"]).select("fps_a", "fps_b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [forest(a.view(np.uint64), b.view(np.uint64), radius) for a, b in zip(batch["fps_a"], batch["fps_b"], strict=True)]
            found = [f for f in found if len(f)]
            edges = np.concatenate(found).view(np.int64) if found else np.zeros((0, 2), np.int64)
            yield pd.DataFrame({"a": edges[:, 0], "b": edges[:, 1]})

    return loaded.mapInPandas(compare, "a long, b long")


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Edges (x, y) that connect what ``a`` and ``b`` link within ``radius``: one for each fingerprint with a link."""
    near_rows = []
    for at in range(0, len(a), 512):
        close = np.bitwise_count(a[at : at + 512, None] ^ b[None, :]) <= radius
        close &= a[at : at + 512, None] != b[None, :]
        i, j = np.nonzero(close)
        if len(i):
            near_rows.append(np.stack([i + at, j + len(a)]))
    if not near_rows:
        return np.zeros((0, 2), np.uint64)
    x, y = np.concatenate(near_rows, axis=1)
    values = np.concatenate([a, b])
    _, label = np.unique(values, return_inverse=True)  # a fingerprint that is on both sides is one vertex
    first = np.full(label.max() + 1, len(values))
    np.minimum.at(first, label, np.arange(len(values)))
    x, y = label[x], label[y]
    root = np.arange(label.max() + 1)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    linked = np.unique(np.concatenate([x, y]))
    linked = linked[root[linked] != linked]
    return np.stack([values[first[linked]], values[first[root[linked]]]], axis=1)


def components(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, fp, root, component_id`` of every row.

    ``component_id`` is the smallest id reachable by links, the row's own
    included (null ids are passed over; null if there is no other), ``root``
    the component's smallest fingerprint.  A null text is empty; a text without
    words has fingerprint zero, which links like any other.  Rows that repeat
    stay rows; other columns are not read.
    """
    rows = fingerprints(docs, words, doc_id, text)
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(links_within(distinct, radius))
    of = distinct.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of = materialize(of, "classes")
    least = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    of = materialize(of.join(least, "root").select("fp", "root", "component_id"), "members")
    return rows.join(broadcast_if_small(of), "fp").select("doc_id", "mark", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """One row of each component, with the columns of ``docs``: that with the smallest id, then the smallest hash of the text."""
    return one_of_each(docs, components(docs, radius, words))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The same for any components ``found(doc_id, mark, root)`` of ``docs``."""
    kept = found.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    kept = materialize(kept.select(F.col("best.doc_id").alias("__doc"), F.col("best.mark").alias("__mark")), "kept")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("key", F.coalesce(F.col("row.doc_id").cast("string"), F.lit("null"))).withColumn("mark", F.xxhash64("row.text"))
    rows = rows.join(broadcast_if_small(kept), (F.col("key") == F.coalesce(F.col("__doc").cast("string"), F.lit("null"))) & (F.col("mark") == F.col("__mark")), "left_semi")
    again = F.row_number().over(Window.partitionBy("key", "mark").orderBy("key"))
    return rows.withColumn("nth", again).filter("nth = 1").select(*[F.col("row")[c].alias(c) for c in docs.columns])
