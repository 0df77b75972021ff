"""Ranked lexical search over a tiered index (operator 13).

The index has a row for each segment of documents: its dictionary and, by tier,
the postings of every term.  A term's postings are in the order of their impact:
tier 0 holds the highest, the next tier more, the last the rest, each in columns
of its own, so that a search reads no tier that it doesn't ask for.  For each
term and tier the segment keeps a residual bound: the largest impact below.

A search scores all items by tier 0.  An item is proven if no document outside of
what was read can reach its k-th best score so far; its candidates are then
scored in full.  Items that lack the proof fall through to the next tier, at the
last of which all scores are exact.  Nothing is approximate at any size.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from probeframe.llm._shared import BROADCAST_ROWS, bounded_batches, cased_terms, materialize, term_column, terms_of

#: Documents and terms at which a segment is full.
SEGMENT_DOCS, SEGMENT_TERMS = 2048, 1 << 20
#: A term's share of postings in the tiers up to each but the last, and the least number of them in a segment.
SHARES, LEAST_POSTINGS = (1 / 16, 1 / 4), (64, 256)
TIERS = len(SHARES) + 1
#: Best documents of an item; items and their terms in a block, which is what a broadcast holds.
MOST, BLOCK_ITEMS, BLOCK_TERMS = 50, 512, 200_000
#: Fixed values of the score: a posting's scale, weight of a document's length against the mean in percent, weight of it against tf.
SCALE, LENGTH_PERCENT, SATURATION = 1_000_000_000, 50, 20

_ARRAYS = ["terms", "ids", "missing", "m", "df", "rest", *[f"{c}{k}" for k in range(TIERS) for c in ("ends", "docs", "tf")]]
_SCHEMA = "segment long, " + ", ".join(f"{c} binary" for c in _ARRAYS)


@dataclass
class Index:
    """``table`` of segments, ``n_docs`` with a term at least, and the terms of all of them."""

    table: DataFrame
    n_docs: int
    n_terms: int


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A posting's impact: its score for a weight of one."""
    return SCALE * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + SATURATION * m)


class _Segment:
    """Documents of a segment being built."""

    def __init__(self, n_docs: int, n_terms: int, most_docs: int, least: tuple[int, ...]) -> None:
        self.n_docs, self.n_terms, self.most_docs, self.least = n_docs, n_terms, most_docs, least
        self.code = defaultdict(count().__next__)
        self.ids, self.sizes, self.codes, self.size = [], [], [], 0

    def add(self, doc_id: int | None, raw: bytes | None) -> None:
        words = terms_of(raw)
        if words:
            self.codes.append(np.fromiter(map(self.code.__getitem__, words), np.int64, len(words)))
            self.ids.append(doc_id)
            self.sizes.append(len(words))
            self.size += len(words)

    @property
    def full(self) -> bool:
        return len(self.ids) >= self.most_docs or self.size >= SEGMENT_TERMS

    def row(self) -> dict[str, bytes]:
        names = sorted(self.code)
        place = np.empty(len(names), np.int64)
        place[[self.code[t] for t in names]] = np.arange(len(names))
        sizes = np.array(self.sizes, np.int64)
        m = 100 - LENGTH_PERCENT + LENGTH_PERCENT * sizes * self.n_docs // self.n_terms
        keys, tf = np.unique(place[np.concatenate(self.codes)] * len(sizes) + np.repeat(np.arange(len(sizes)), sizes), return_counts=True)
        term, doc = keys // len(sizes), keys % len(sizes)
        impact = impacts(tf, m[doc])
        order = np.lexsort((-impact, term))
        term, doc, tf, impact = term[order], doc[order], tf[order], impact[order]
        df = np.bincount(term, minlength=len(names))
        start = np.cumsum(df) - df
        at = np.arange(len(term)) - start[term]
        upto = [np.minimum(df, np.maximum(least, np.ceil(df * share).astype(np.int64))) for share, least in zip(SHARES, self.least, strict=True)] + [df]
        rest = [np.where(u < df, impact[np.minimum(start + u, len(impact) - 1)], 0) for u in upto[:-1]]
        out = {
            "terms": b" ".join(names), "ids": np.array([i or 0 for i in self.ids], np.int64), "missing": np.array([i is None for i in self.ids], bool),
            "m": m, "df": df.astype(np.int32), "rest": np.array(rest, np.int32),
        }
        low = np.zeros(len(names), np.int64)
        for k, high in enumerate(upto):
            inside = (at >= low[term]) & (at < high[term])
            out |= {f"ends{k}": np.cumsum(high - low).astype(np.int32), f"docs{k}": doc[inside].astype(np.int32), f"tf{k}": tf[inside].astype(np.int32)}
            low = high
        return {c: v if isinstance(v, bytes) else v.tobytes() for c, v in out.items()}


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_docs: int = SEGMENT_DOCS, least_postings: tuple[int, ...] = LEAST_POSTINGS) -> Index:
    """The index of all rows of ``docs``, written to the shared folder.

    Counts of documents and terms come first, JVM-side; the second scan makes
    segments of documents that lie together, without a shuffle.  Texts without
    a term, null ones too, aren't in the index; a null id stays null; rows that
    repeat are documents of their own; other columns aren't read.
    """
    sized = docs.select(F.size(cased_terms(F.col(text))).cast("long").alias("n"))
    n_docs, n_terms = sized.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n"))), F.lit(0).cast("long"))).first()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = (TaskContext.get().partitionId() << 33) if TaskContext.get() else 0
        number, building = count(part), _Segment(n_docs, n_terms, segment_docs, least_postings)

        def closed() -> pa.RecordBatch:
            row = building.row()
            return pa.RecordBatch.from_arrays([pa.array([next(number)], pa.int64()), *[pa.array([row[c]], pa.binary()) for c in _ARRAYS]], ["segment", *_ARRAYS])

        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                building.add(i, raw)
                if building.full:
                    yield closed()
                    building = _Segment(n_docs, n_terms, segment_docs, least_postings)
        if building.ids:
            yield closed()

    with bounded_batches(docs.sparkSession):
        table = materialize(docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(segments, _SCHEMA), "index")
    return Index(table, n_docs, n_terms)


@dataclass
class _Block:
    """Some items: their ids, the items of each term, and the terms' weights."""

    item_ids: list[int | None] = field(default_factory=list)
    items: dict[bytes, list[int]] = field(default_factory=lambda: defaultdict(list))
    weight: dict[bytes, int] = field(default_factory=dict)
    size: int = 0

    def of(self, active: list[int]) -> _Block:
        """The same block for some of its items only."""
        kept, chosen = _Block(self.item_ids, {}, self.weight, self.size), set(active)
        for t, items in self.items.items():
            if few := [q for q in items if q in chosen]:
                kept.items[t] = few
        return kept


def _blocks(items: DataFrame, item_id: str, text: str) -> Iterator[_Block]:
    """Items in blocks of bounded size; rows come to the driver one partition at a time, never more than that and a block."""
    block = _Block()
    for row in items.select(F.col(item_id).cast("long"), F.array_distinct(term_column(F.col(text)))).toLocalIterator():
        for t in row[1] or ():
            block.items[t.encode()].append(len(block.item_ids))
        block.item_ids.append(row[0])
        block.size += len(row[1] or ())
        if len(block.item_ids) >= BLOCK_ITEMS or block.size >= BLOCK_TERMS:
            yield block
            block = _Block()
    if block.item_ids:
        yield block


class _Reader:
    """A segment as it is read: where a term's postings are in the tiers up to ``last``."""

    def __init__(self, row: dict, last: int) -> None:
        get = lambda c, kind: np.frombuffer(row[c], kind)
        self.names, self.last = row["terms"].split(b" "), last
        if "rest" in row:
            self.rest = get("rest", np.int32).reshape(TIERS - 1, -1)
        if "df" in row:
            self.df = get("df", np.int32)
        if "m" in row:
            self.m = get("m", np.int64)
            self.ids, self.missing = get("ids", np.int64), get("missing", bool)
            self.tiers = [tuple(get(f"{c}{k}", np.int32) for c in ("ends", "docs", "tf")) for k in range(last + 1)]

    def find(self, term: bytes) -> int:
        """The term's place in the dictionary, -1 if absent."""
        at = bisect_left(self.names, term)
        return at if at < len(self.names) and self.names[at] == term else -1

    def postings(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a term and their impacts, in the tiers that were read; a document occurs once."""
        found = [(docs[slice(ends[at - 1] if at else 0, ends[at])], tf[slice(ends[at - 1] if at else 0, ends[at])]) for ends, docs, tf in self.tiers]
        docs, tf = (np.concatenate(x) for x in zip(*found, strict=True))
        return docs, impacts(tf, self.m[docs])

    def residual(self, at: int) -> int:
        return int(self.rest[self.last, at]) if self.last < TIERS - 1 else 0


def _columns(last: int) -> list[str]:
    return ["segment", "terms", "ids", "missing", "m", "rest", *[f"{c}{k}" for k in range(last + 1) for c in ("ends", "docs", "tf")]]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _scores(seg: _Reader, block: _Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By item and document what the postings read give, the residuals of terms not met there taken together, and the items' residuals in all."""
    shape = len(block.item_ids), len(seg.ids)
    score, met, bound = np.zeros(shape, np.int64), np.zeros(shape, np.int64), np.zeros(shape[0], np.int64)
    for term, items in block.items.items():
        at = seg.find(term)
        if at >= 0:
            docs, impact = seg.postings(at)
            where, w, rest = np.ix_(items, docs), block.weight[term], seg.residual(at)
            score[where] += w * impact
            if rest:
                met[where] += w * rest
                bound[items] += w * rest
    return score, met, bound


def _document_frequencies(index: Index, block: _Block) -> dict[bytes, int]:
    """Documents that hold each of the block's terms."""
    shared = index.table.sparkSession.sparkContext.broadcast(list(block.items))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = defaultdict(int)
        for row in _rows(batches):
            seg = _Reader(row, -1)
            for term in shared.value:
                if (at := seg.find(term)) >= 0:
                    total[term] += int(seg.df[at])
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.binary()), "df": pa.array(list(total.values()), pa.int64())})

    rows = index.table.select("terms", "df").mapInArrow(counted, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r["term"]): r["df"] for r in rows}


def _best(index: Index, block: _Block, last: int, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the tiers up to ``last`` give: each item's best, ``q, item_id, doc_id, score``; ``q, bound``, what a document outside of
    them can reach; and ``segment, reach``, what by item one in that segment can.
    """
    shared = index.table.sparkSession.sparkContext.broadcast(block)
    schema = "q long, item_id long, doc_id long, score long, bound long, segment long, reach array<long>"

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        none = np.zeros(0, np.int64)
        best = {q: (none, none.astype(bool), none) for items in block.items.values() for q in items}
        bounds, reaches = np.zeros(len(block.item_ids), np.int64), []
        for row in _rows(batches):
            seg = _Reader(row, last)
            score, met, bound = _scores(seg, block)
            bounds = np.maximum(bounds, bound)
            if last < TIERS - 1:
                reaches.append((row["segment"], np.where(score > 0, score - met, -1).max(1) + bound))
            for q, (ids, missing, had) in best.items():
                low = had[-1] if len(had) == most else 1
                new = np.flatnonzero(score[q] >= low)
                if len(new) > most:  # at least the most-th largest, ties included
                    new = new[score[q, new] >= np.partition(score[q, new], len(new) - most)[len(new) - most]]
                if len(new):
                    ids, missing, had = np.concatenate([ids, seg.ids[new]]), np.concatenate([missing, seg.missing[new]]), np.concatenate([had, score[q, new]])
                    order = np.lexsort((ids, missing, -had))[:most]
                    best[q] = ids[order], missing[order], had[order]
        found = [
            {"q": q, "item_id": block.item_ids[q], "doc_id": None if m else int(i), "score": int(s)} for q, (ids, missing, had) in best.items() for i, m, s in zip(ids, missing, had, strict=True)
        ]
        found += [{"q": int(q), "bound": int(bounds[q])} for q in np.flatnonzero(bounds)]
        found += [{"segment": s, "reach": r.tolist()} for s, r in reaches]
        kinds = pa.schema([*[(c, pa.int64()) for c in ("q", "item_id", "doc_id", "score", "bound", "segment")], ("reach", pa.list_(pa.int64()))])
        yield pa.RecordBatch.from_pylist(found, kinds)

    with bounded_batches(index.table.sparkSession):
        found = materialize(index.table.select(*_columns(last)).mapInArrow(searched, schema), "best")
    bound = found.filter("bound is not null").groupBy("q").agg(F.max("bound").alias("bound"))
    return _top(found.filter("score is not null").select("q", "item_id", "doc_id", "score"), most), bound, found.filter("segment is not null").select("segment", "reach")


def _top(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of every item, with their ``rank``; there are few for each task that found some."""
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _in_full(index: Index, block: _Block, last: int, least: dict[int, int], reaches: DataFrame, most: int) -> DataFrame:
    """Exact scores of the proven items' candidates: documents that may reach ``least``, found in the tiers up to ``last``.

    Each segment is scored where it is, so the index isn't shuffled.  Segments
    without a candidate aren't read if those with one are few enough to be
    broadcast, which a count checks; else all are.
    """
    spark = index.table.sparkSession
    shared = spark.sparkContext.broadcast((block, least))
    wanted = F.array(*[F.lit(least.get(q)).cast("long") for q in range(len(block.item_ids))])  # null for items that aren't asked for
    held = materialize(reaches.filter(F.exists(F.zip_with("reach", wanted, lambda r, w: r >= w), lambda x: F.coalesce(x, F.lit(False)))).select("segment"), "held")
    table = index.table.select(*_columns(TIERS - 1))
    if held.count() <= BROADCAST_ROWS:
        table = table.join(F.broadcast(held), "segment", "left_semi")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        for row in _rows(batches):
            upper = _Reader(row, last)
            score, met, bound = _scores(upper, block)
            may = {q: np.flatnonzero((score[q] > 0) & (score[q] + bound[q] - met[q] >= low)) for q, low in least.items()}
            may = {q: docs for q, docs in may.items() if len(docs)}
            seg = _Reader(row, TIERS - 1)
            score = _scores(seg, block.of(list(may)))[0]
            for q, docs in may.items():
                docs = docs[score[q, docs] >= least[q]]  # the best are that good at least
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q] * n, pa.int64()), pa.array([block.item_ids[q]] * n, pa.int64()), pa.array(seg.ids[docs], pa.int64(), mask=seg.missing[docs]), pa.array(score[q, docs], pa.int64())],
                    ["q", "item_id", "doc_id", "score"],
                )

    with bounded_batches(spark):
        found = materialize(table.mapInArrow(scored, "q long, item_id long, doc_id long, score long"), "scored")
    return _top(found, most)


def search(index: Index, items: DataFrame, most: int = MOST, item_id: str = "item_id", text: str = "text", proven: list[int] | None = None) -> DataFrame:
    """``item_id, rank, doc_id, score, tier``: each item's ``most`` best documents with a score above 0, ties to the smaller id, null last.

    ``tier`` is the one that proved the item; its number goes to ``proven`` for
    every item, if given.  Null texts and texts without a term find nothing; rows
    of ``items`` that repeat are searched each; an empty table or index gives no rows.
    """
    spark = index.table.sparkSession
    results: list[DataFrame] = []
    for whole in _blocks(items, item_id, text) if index.n_docs else ():
        block, df = whole, _document_frequencies(index, whole)
        block.weight = {t: int(np.floor(1000 * np.log((2 * index.n_docs + 2) / (2 * n + 1)))) for t, n in df.items()}
        block.items = {t: q for t, q in block.items.items() if t in df}
        active = sorted({q for items in block.items.values() for q in items})
        for last in range(TIERS):
            best, bound, reaches = _best(index, block.of(active), last, most)
            if last == TIERS - 1:
                done, exact = active, active
            else:
                reach = {r["q"]: r["bound"] for r in bound.collect()}  # a figure for each item of the block
                least = {r["q"]: r["score"] for r in best.filter(F.col("rank") == most).select("q", "score").collect()}
                exact = [q for q in active if q not in reach]  # nothing of theirs is left below
                done = exact + [q for q in active if q in reach and reach[q] < least.get(q, 0)]
            if exact:
                results.append(best.filter(F.col("q").isin(exact)).withColumn("tier", F.lit(last)))
            if full := sorted({*done} - {*exact}):
                results.append(_in_full(index, block.of(full), last, {q: least[q] for q in full}, reaches, most).withColumn("tier", F.lit(last)))
            if proven is not None:
                proven += [last] * len(done)
            active = [q for q in active if q not in {*done}]
            if not active:
                break
    columns = ["item_id", "rank", "doc_id", "score", "tier"]
    if not results:
        return _none(spark)
    out = results[0].select(*columns)
    for r in results[1:]:
        out = out.union(r.select(*columns))
    return out


def _none(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long, tier int")
