"""Approximate nearest neighbours by learned partitions (operator 7).

A bounded sample's neighbour graph is cut into balanced parts; a small network
learns to tell a vector's part from its coordinates.  Every row goes to its most
probable part; a query goes to the several most probable ones, and the rows
there are ranked by the exact inner product.  The number of parts grows with the
rows; beyond :data:`ONE_LEVEL` parts, each of the first level's learns its own
split into as many again.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.llm._shared import broadcast_if_small, materialize, meet

#: Vectors that a router learns from, at least and for each of its parts; neighbours in the graph; hidden units.
SAMPLE, SAMPLE_OF_PART, GRAPH_K, HIDDEN = 4000, 16, 10, 64
#: Rows of a cell and queries of a block: what one task compares at a time.
CELL_ROWS, BLOCK_QUERIES = 8192, 4096
#: Parts at least, rows of a part on the average (a cell full: each probe of a query gives its nearest, so smaller parts
#: give more rows to merge), and parts that one router tells apart at most.
LEAST_PARTS, PART_ROWS, ONE_LEVEL = 8, CELL_ROWS, 256
#: Share of the sample's true neighbours that the probed parts must hold.
AIM = 0.95


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        hidden = np.maximum(x / np.where(norm > 0, norm, 1) @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def parts(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self.logits(x), axis=1, kind="stable")[:, :n]


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    near = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 500):
        scores = x[a : a + 500] @ x.T
        scores[np.arange(len(scores)), np.arange(a, a + len(scores))] = -np.inf
        near[a : a + 500] = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return near


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, sweeps: int = 8, slack: float = 1.1) -> np.ndarray:
    """A part for every vector: halved along main axes, then refined on the graph.

    In a sweep a vector moves to the part that most of its neighbours are in,
    if that part has room (``slack`` times its fair share).
    """
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        rows = groups.pop()
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for g, rows in enumerate(groups):
        part[rows] = g
    sizes, room = np.bincount(part, minlength=parts), slack * len(x) / parts
    for _ in range(sweeps):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < room and sizes[part[i]] > 1:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def fit_router(x: np.ndarray, parts: int, k: int, aim: float = AIM, seed: int = 5, epochs: int = 60) -> Router:
    """Cuts the sample's graph, trains the network and sets the number of probes.

    The network's aim for a vector is the spread of its neighbours over the
    parts.  Probes are the fewest with which a vector's ``k`` neighbours in the
    sample are found in share ``aim``; a full table's neighbours are nearer
    than a sample's and easier to route to.
    """
    rng = np.random.default_rng(seed)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = x / np.where(norm > 0, norm, 1)
    k = min(k, len(x) - 1)
    if parts < 2 or k < 1:
        d = x.shape[1] if x.ndim == 2 else 1
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = neighbour_graph(x, max(k, min(GRAPH_K, len(x) - 1)))
    part = balanced_parts(unit, near[:, :GRAPH_K], parts)
    aims = np.zeros((len(x), parts))
    np.add.at(aims, (np.repeat(np.arange(len(x)), near.shape[1]), part[near].ravel()), 1.0)
    aims[np.arange(len(x)), part] += near.shape[1]
    aims /= aims.sum(1, keepdims=True)
    d = x.shape[1]
    net = Router(rng.normal(0, (2 / d) ** 0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, (HIDDEN, parts)), np.zeros(parts), parts)
    params = [net.w1, net.b1, net.w2, net.b2]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), 256):
            rows = order[a : a + 256]
            hidden = np.maximum(unit[rows] @ net.w1 + net.b1, 0)
            logits = hidden @ net.w2 + net.b2
            p = np.exp(logits - logits.max(1, keepdims=True))
            error = (p / p.sum(1, keepdims=True) - aims[rows]) / len(rows)
            back = (error @ net.w2.T) * (hidden > 0)
            t += 1
            for value, (m, v), g in zip(params, moments, (unit[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                value -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    home, ranked = net.parts(x, 1)[:, 0], net.parts(x, parts)
    where = np.empty_like(ranked)
    np.put_along_axis(where, ranked, np.arange(parts)[None, :].repeat(len(x), 0), 1)
    found_at = np.take_along_axis(where, home[near], 1)  # the probe at which each neighbour is met
    share = np.cumsum(np.bincount(found_at.ravel(), minlength=parts)) / found_at.size
    net.probes = min(parts, int(np.searchsorted(share, aim) + 1))
    return net


def valid(v: Column) -> Column:
    inf = float("inf")
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(inf))) & F.exists(v, lambda x: x != 0), F.lit(False))


def usable_vectors(table: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``row, vec_id, v, h1, h2`` of every row with an id and a finite vector that isn't zero, in double precision; a written table.

    ``row`` is the row's own key, ``h1, h2`` its vector's: rows may share an id or a vector.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & valid(F.col("v")))
    return materialize(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2")), "vectors")


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """``h1, h2, v, n, ids, rows``: every distinct vector, its length, and the ``most`` of its rows with the smallest ids.

    No more of them can be among a query's ``most`` nearest, as all score alike.
    """
    by = Window.partitionBy("h1", "h2").orderBy("vec_id", "row")
    some = rows.withColumn("copy", F.row_number().over(by)).filter(F.col("copy") <= most)
    copies = F.sort_array(F.collect_list(F.struct("vec_id", "row"))).alias("copies")
    found = some.groupBy("h1", "h2").agg(F.first("v").alias("v"), copies)
    return materialize(found.select("h1", "h2", "v", F.size("v").alias("n"), F.col("copies.vec_id").alias("ids"), F.col("copies.row").alias("rows")), "distinct")


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """Vectors as a router takes them: cut or filled up to its width."""
    return np.stack([v if len(v) == width else np.pad(v[:width], (0, max(0, width - len(v)))) for v in map(np.asarray, vectors)])


def first_level(found: DataFrame, router: Router, probes: int) -> DataFrame:
    """``found`` with ``part``: a row for each of the ``probes`` most probable parts."""
    shared, width = found.sparkSession.sparkContext.broadcast(router), len(router.w1)

    @F.pandas_udf("array<int>")
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in batches:
            yield pd.Series(list(shared.value.parts(_matrix(v, width), probes).astype(np.int32)) if len(v) else [], dtype=object)

    return found.withColumn("part", F.explode(route("v")))


def second_routers(index: DataFrame, parts: int, k: int, width: int, aim: float) -> DataFrame:
    """``part, router``: of each part, a router that a bounded sample of its rows taught."""
    some = index.filter(F.size("v") == width).withColumn("nth", F.row_number().over(Window.partitionBy("part").orderBy("h1", "h2"))).filter(F.col("nth") <= SAMPLE_OF_PART * parts)

    def teach(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows["v"])
        router = fit_router(x, min(parts, max(1, len(x) // (SAMPLE_OF_PART - 1))), k, aim)
        return pd.DataFrame({"part": [rows["part"].iloc[0]], "router": [pickle.dumps(router)]})

    return materialize(some.select("part", "v").groupBy("part").applyInPandas(teach, "part int, router binary"), "routers")


def second_level(found: DataFrame, routers: DataFrame, all_probes: bool) -> DataFrame:
    """``found`` with ``sub``, the place within its part; a part's rows meet its router by cells of bounded size."""
    cells = materialize(found.groupBy("part").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("cells")), "cells")
    spread = found.join(F.broadcast(cells), "part").withColumn("cell", F.pmod(F.xxhash64("h1", F.lit(5)), F.col("cells")).cast("int")).drop("cells")
    # a row for each part, whose number is a root of the rows'
    routers = routers.join(F.broadcast(cells), "part").select("part", "router", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)

    def place(rows: pd.DataFrame, taught: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop(columns="cell")
        if not len(rows) or not len(taught):
            return rows.assign(sub=np.zeros(len(rows), np.int32))
        router = pickle.loads(taught["router"].iloc[0])
        ranked = router.parts(_matrix(rows["v"], len(router.w1)), router.probes if all_probes else 1)
        again = rows.loc[rows.index.repeat(ranked.shape[1])]
        return again.assign(sub=ranked.ravel().astype(np.int32))

    return spread.groupBy("part", "cell").cogroup(routers.groupBy("part", "cell")).applyInPandas(place, f"{schema}, sub int")


def ranked(k: int):
    """Compares a cell of vectors with a block of queries: of each query, the ``k`` rows with the highest products."""

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            right = right.assign(least=[i[0] for i in right["ids"]], row=[r[0] for r in right["rows"]]).sort_values(["least", "row"], kind="stable")
            ids, rows, cand, q = right["ids"].to_numpy(), right["rows"].to_numpy(), np.stack(right["v"]), np.stack(left["v"])
            keys, keep = left[["h1", "h2"]].to_numpy(), min(k, len(right))
            for a in range(0, len(q), 256):
                rough = q[a : a + 256] @ cand.T
                least = -np.partition(-rough, keep - 1, axis=1)[:, keep - 1] - 1e-9 * (1 + np.abs(rough).max(1))
                for i, scores in enumerate(rough):
                    some = np.flatnonzero(scores >= least[i])
                    exact = (cand[some] * q[a + i]).cumsum(1)[:, -1]  # one order of addition for every row
                    for j in np.argsort(-exact, kind="stable")[:k]:  # vectors are by id: ties go to the smaller
                        out += [(*keys[a + i], exact[j], *copy) for copy in zip(ids[some[j]], rows[some[j]], strict=True)]
        return pd.DataFrame(out, columns=["h1", "h2", "score", "vec_id", "row"]).astype({"h1": "int64", "h2": "int64", "vec_id": "int64", "row": "int64", "score": "float64"})

    return nearest


def search(table: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found for every query row, its own row left out, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``.  All rows are candidates: rows
    that share an id are rows of their own, with one answer each if they are
    queries.  Rows without an id and vectors that are null, zero or not finite
    take no part, nor does a vector against a query of another length.  An empty
    table gives no rows.  A vector that repeats is compared once, as candidate
    and as query; a part with many rows is cut into cells and its queries into
    blocks, and rows go only to blocks that their own part has.
    """
    rows = usable_vectors(table, vec_id, vector)
    every = distinct_vectors(rows, k + 1)
    asked = materialize(rows.filter(is_query).select("h1", "h2", F.col("row").alias("own"), F.col("vec_id").alias("query_id")), "queries")
    n = every.count()
    if not n or not asked.limit(1).count():
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = every.groupBy("n").count().orderBy(F.desc("count"), "n").first()["n"]
    wanted = max(LEAST_PARTS, n // PART_ROWS)
    first = wanted if wanted <= ONE_LEVEL else int(np.ceil(wanted**0.5))
    second = -(-wanted // first)
    size = max(SAMPLE, SAMPLE_OF_PART * first)
    x = np.stack(every.filter(F.col("n") == width).select("v", "h1", "h2").orderBy("h1", "h2").limit(size).toPandas()["v"])  # a bounded sample
    aim = AIM if second == 1 else AIM**0.5
    router = fit_router(x, first if len(x) >= 50 * LEAST_PARTS else 1, k, aim)

    index = materialize(first_level(every, router, 1), "index")
    queries = first_level(every.join(asked.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "v", "n"), router, router.probes)
    if second > 1:
        routers = second_routers(index, second, k, width, aim)
        index = materialize(second_level(index, routers, False), "second_index")
        queries = second_level(queries, routers, True)
    else:
        index, queries = index.withColumn("sub", F.lit(0)), queries.withColumn("sub", F.lit(0))
    queries = materialize(queries, "probes")

    leaf = ["n", "part", "sub"]
    count = lambda t, of, name: t.groupBy(*leaf).agg(F.ceil(F.count("*") / of).cast("int").alias(name))
    leaves = materialize(count(index, CELL_ROWS, "cells").join(count(queries, BLOCK_QUERIES, "blocks"), leaf), "leaves")
    leaves = broadcast_if_small(leaves, 1_000_000)
    salt = lambda m: F.pmod(F.xxhash64("h1", F.lit(3)), F.col(m)).cast("int")
    every_one = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    held = index.join(leaves, leaf).withColumn("cell", salt("cells")).select("ids", "rows", "v", *leaf, "cell", every_one("blocks").alias("block"))
    queries = queries.join(leaves, leaf).withColumn("block", salt("blocks")).select("h1", "h2", "v", *leaf, "block", every_one("cells").alias("cell"))
    keys = [*leaf, "cell", "block"]
    found = queries.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(ranked(k + 1), "h1 long, h2 long, score double, vec_id long, row long")
    by = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id", "row")
    best = found.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k + 1)
    best = materialize(best.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "row", "score"))).alias("best")), "best")
    others = F.slice(F.filter("best", lambda x: x["row"] != F.col("own")), 1, k)
    answers = meet(asked, best, ["h1", "h2"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
