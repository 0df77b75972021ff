"""Graphs as tables of nodes and edges: levels, depth, order, topology, by iterated joins.

``nodes(graph, node)`` and ``edges(graph, source, target)`` hold any number of
graphs of any size; a graph is never gathered.  Each round handles one level of
all graphs at once, so there are as many rounds as the deepest graph has levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeframe.operators.scratch import written


def tables_of(graphs: DataFrame, graph: str = "graph", nodes: str = "nodes") -> tuple[DataFrame, DataFrame]:
    """Nodes ``graph, node, place, op`` and edges ``graph, source, target`` of graphs that are arrays; nodes are named n0, n1, ... by place.

    A reference that occurs twice in a node is one edge; one that points nowhere is none.  Graphs have names of their own.
    """
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    each = graphs.select(F.col(graph).alias("graph"), F.size(nodes).alias("size"), F.posexplode(nodes).alias("place", "n"))
    edges = each.select("graph", "size", "place", F.explode(F.array_distinct("n.refs")).alias("r")).filter("r >= 0 and r < size")
    return each.select("graph", name(F.col("place")).alias("node"), "place", "n.op"), edges.select("graph", name(F.col("r")).alias("source"), name(F.col("place")).alias("target"))


def levels(nodes: DataFrame, edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """``graph, node, level``: the edges on the longest path to each node; nodes on a cycle or behind one are left out.

    In every round the nodes that wait for none go, and what pointed from them
    goes with them.  Only what is left is written for the next round.  Repeated
    rows count once; an edge whose source is no node keeps its target waiting.
    """
    left = nodes.select("graph", "node")
    waits = written(edges.select("graph", "source", "target"))
    parts: list[DataFrame] = []
    for level in range(rounds):
        # one grouping tells of every node left whether an edge still points to it
        both = left.select("graph", "node", F.lit(True).alias("own"), F.lit(False).alias("held")).union(waits.select("graph", "target", F.lit(False), F.lit(True)))
        marked = written(both.groupBy("graph", "node").agg(F.max("own").alias("own"), F.max("held").alias("held")).filter("own").drop("own"))
        ready = marked.filter("not held").select("graph", "node")
        if ready.isEmpty():
            break
        parts.append(ready.withColumn("level", F.lit(level)))
        left = marked.filter("held").select("graph", "node")
        if left.isEmpty():
            break
        waits = written(waits.join(ready.withColumnRenamed("node", "source"), ["graph", "source"], "left_anti"))
    else:
        raise RuntimeError(f"the deepest graph has more than {rounds} levels")
    out = nodes.select("graph", "node").limit(0).withColumn("level", F.lit(0))
    for part in parts:
        out = out.union(part)
    return out


def depths(levelled: DataFrame) -> DataFrame:
    """``graph, depth``: the edges on the longest path of each graph."""
    return levelled.groupBy("graph").agg(F.max("level").alias("depth"))


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``graph, n_nodes, n_edges``: rows of both tables by graph, in one grouping; a graph needs a node."""
    both = nodes.select("graph", F.lit(1).alias("n"), F.lit(0).alias("e")).union(edges.select("graph", F.lit(0), F.lit(1)))
    return both.groupBy("graph").agg(F.sum("n").alias("n_nodes"), F.sum("e").alias("n_edges")).filter("n_nodes > 0")


def _bits(*columns: Column) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)


def signatures(nodes: DataFrame, edges: DataFrame, place: str = "place") -> DataFrame:
    """``graph, n_nodes, n_edges, topology``: graphs of one topology, nodes compared by their place, have one signature.

    The signature sums two 64-bit hashes of each edge's pair of places, so it is
    aggregated like a count, whatever the graph's size.
    """
    at = nodes.select("graph", "node", F.col(place).alias("p"))
    pairs = edges.join(at.select("graph", F.col("node").alias("source"), F.col("p").alias("s")), ["graph", "source"]).join(at.select("graph", F.col("node").alias("target"), F.col("p").alias("t")), ["graph", "target"])
    first, second = _bits(F.col("s"), F.col("t"))
    summed = pairs.groupBy("graph").agg(F.count("*").alias("n_edges"), F.sum(first.cast("decimal(38,0)")).alias("h1"), F.sum(second.cast("decimal(38,0)")).alias("h2"))
    sized = nodes.groupBy("graph").agg(F.count("*").alias("n_nodes"))
    text = F.concat_ws(":", F.col("n_nodes").cast("string"), F.coalesce("n_edges", F.lit(0)).cast("string"), F.coalesce(F.col("h1").cast("string"), F.lit("")), F.coalesce(F.col("h2").cast("string"), F.lit("")))
    return sized.join(summed, "graph", "left").select("graph", "n_nodes", F.coalesce("n_edges", F.lit(0)).cast("long").alias("n_edges"), F.substring(F.sha2(text, 256), 1, 16).alias("topology"))


def orders(nodes: DataFrame, edges: DataFrame, rounds: int = 100_000) -> DataFrame:
    """``graph, node, position``: dependency order; of those ready the first by text (n10 before n2).  Nodes on a cycle are left out.

    Which node comes next depends on all before, so a round places one node of
    every graph: for many graphs of moderate size.
    """
    left = written(nodes.select("graph", "node").distinct())
    waits = written(edges.select("graph", "source", "target").distinct())
    parts: list[DataFrame] = []
    for position in range(rounds):
        held = waits.select("graph", F.col("target").alias("node")).distinct()
        first = written(left.join(held, ["graph", "node"], "left_anti").groupBy("graph").agg(F.min("node").alias("node")))
        if not first.limit(1).count():
            break
        parts.append(first.withColumn("position", F.lit(position)))
        left = written(left.join(first, ["graph", "node"], "left_anti"))
        waits = written(waits.join(first.withColumnRenamed("node", "source"), ["graph", "source"], "left_anti"))
    else:
        raise RuntimeError(f"the largest graph has more than {rounds} nodes")
    out = nodes.select("graph", "node").limit(0).withColumn("position", F.lit(0))
    for part in parts:
        out = out.union(part)
    return out
