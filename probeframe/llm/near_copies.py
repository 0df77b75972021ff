"""Near copies by exact Jaccard similarity of word shingles (near-dedup of the pipeline).

Texts whose simhash fingerprints differ in few bits are candidates, and so are
those that agree in a band of minhashes, as near copies of some length differ in
more bits; every link is confirmed by the exact similarity of the two sets of
shingles.  A first pass compares what fingerprints link, and each member of a
bucket with one of its members only, a second those that the first
left in different components: small buckets as pairs, large ones by cells, which
only links leave, so a large group of copies never unfolds to its pairs.  At a
similarity of 0.8 a pair agrees in no band with a probability of 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probeframe.llm._shared import broadcast_if_small, connected_components, materialize, small_batches
from probeframe.llm.simhash import RADIUS, SEED, SHINGLE, fingerprints, links_within, one_of_each

#: Words of a shingle; similarity of near copies; bands of minhashes and minhashes of a band.
WORDS, LEAST, BANDS, DEPTH = 5, 0.8, 25, 4
#: Pairs of a bucket that are listed; beyond, the bucket is compared by cells of so many members.
MOST_PAIRS, CELL = 1000, 2048
#: Places of 100 in which the signatures of a link agree at least.
LEAST_AGREEING = 60
_rng = np.random.default_rng(SEED)
FACTORS, SHIFTS = (_rng.integers(0, 1 << 64, BANDS * DEPTH, dtype=np.uint64) for _ in range(2))
FACTORS |= np.uint64(1)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a shorter text is one shingle, words as in ``simhash.fingerprint``."""
    tokens = (text or "").encode().lower().split()
    shingles = {b" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))}
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, len(shingles)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of the set's minhashes, as signed longs."""
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at : at + 2048, None] * FACTORS + SHIFTS).min(0))
    keys = [xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, DEPTH))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _sizes_allow(m: Column, n: Column, least: float) -> Column:
    return F.least(m, n) >= F.greatest(m, n) * F.lit(least) - F.lit(1e-6)


def confirmed(pairs: DataFrame, docs: DataFrame, least: float, words: int, text: str = "text") -> DataFrame:
    """The pairs ``a, b`` of ``pairs`` (marks of texts) whose sets of shingles have at least that similarity."""

    @F.pandas_udf("binary")
    def packed(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, words).tobytes() for t in texts])

    needed = materialize(pairs.select(F.col("a").alias("mark")).union(pairs.select("b")).distinct(), "needed")
    texts = docs.select(F.xxhash64(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(broadcast_if_small(needed), "mark", "left_semi")
    sets = materialize(texts.groupBy("mark").agg(F.min("t").alias("t")).select("mark", packed("t").alias("hashes")), "sets")
    side = lambda s: sets.select(F.col("mark").alias(s), F.col("hashes").alias(f"set_{s}"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["set_a"], batch["set_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                shared = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(shared >= least * (len(x) + len(y) - shared) - 1e-9)
            yield batch.loc[keep, ["a", "b"]]

    loaded = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return materialize(loaded.mapInPandas(compare, "a long, b long"), "confirmed")


def signature(hashes: np.ndarray) -> bytes:
    """The low byte of each minhash."""
    low = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 2048):
        low = np.minimum(low, (hashes[at : at + 2048, None] * FACTORS + SHIFTS).min(0))
    return low.astype(np.uint8).tobytes()


def links_in_cells(rest: DataFrame, mixed: DataFrame, docs: DataFrame, least: float, words: int, text: str) -> DataFrame:
    """Links between members of large buckets that are in different components, at least one of them outside of the largest.

    A bucket is cut into cells and its rest into blocks of bounded size, and
    pairs are compared where they are: only links leave a task.  Signatures that
    agree in fewer than :data:`LEAST_AGREEING` places are passed over; at a
    similarity of 0.8 that misses a pair with a probability of 1e-6.
    """

    @F.pandas_udf("hashes binary, sig binary")
    def packed(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"hashes": [x.tobytes() for x in sets], "sig": [signature(x) for x in sets]})

    needed = materialize(mixed.select("mark").distinct(), "needed")
    texts = docs.select(F.xxhash64(text).alias("mark"), F.coalesce(F.col(text), F.lit("")).alias("t")).join(broadcast_if_small(needed), "mark", "left_semi")
    sets = materialize(texts.groupBy("mark").agg(F.min("t").alias("t")).select("mark", packed("t").alias("s")).select("mark", "s.*"), "sets")
    size = lambda t, name: t.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias(name))
    spans = materialize(size(mixed, "cells").join(size(rest, "blocks"), "key"), "spans")
    salt = lambda c, m: F.pmod(F.xxhash64(c, F.lit(7)), F.col(m)).cast("int")
    each = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = rest.join(spans, "key").withColumn("block", salt("x", "blocks")).join(sets.select(F.col("mark").alias("x"), F.col("hashes").alias("x_hashes"), F.col("sig").alias("x_sig")), "x")
    left = left.select("key", "x", "x_root", "x_hashes", "x_sig", "block", each("cells").alias("cell"))
    right = mixed.join(spans, "key").withColumn("cell", salt("mark", "cells")).join(sets, "mark").select("key", "mark", "root", "hashes", "sig", "cell", each("blocks").alias("block"))

    def compare(some: pd.DataFrame, all_: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(some) and len(all_):
            sigs = np.frombuffer(b"".join(all_["sig"]), np.uint8).reshape(len(all_), -1)
            marks, roots, sets = all_["mark"].to_numpy(), all_["root"].to_numpy(), [np.frombuffer(h, np.uint64) for h in all_["hashes"]]
            for x, root, raw, sig in zip(some["x"], some["x_root"], some["x_hashes"], some["x_sig"], strict=True):
                mine, near = np.frombuffer(raw, np.uint64), (sigs == np.frombuffer(sig, np.uint8)).sum(1) >= LEAST_AGREEING
                joined = {root}  # one link to each other component is enough
                for i in np.flatnonzero(near & (roots != root)):
                    if roots[i] not in joined:
                        shared = len(mine) + len(sets[i]) - len(np.union1d(mine, sets[i]))
                        if shared >= least * (len(mine) + len(sets[i]) - shared) - 1e-9:
                            joined.add(roots[i])
                            found.append((x, marks[i]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    keys = ["key", "block", "cell"]
    return materialize(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "a long, b long").distinct(), "cell_links")


def components(docs: DataFrame, least: float = LEAST, words: int = WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, mark, root`` of every row: rows with one root are linked by texts of at least that similarity, directly or by others."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("n int, keys array<long>")
    def banded(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, words) for t in texts]
        return pd.DataFrame({"n": [len(s) for s in sets], "keys": [band_keys(s) for s in sets]})

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("mark"), banded(F.coalesce(F.col(text), F.lit(""))).alias("s"))
    rows = materialize(rows.select("doc_id", "mark", "s.n", "s.keys"), "banded")
    texts = rows.groupBy("mark").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    buckets = materialize(texts.select("mark", "n", F.explode("keys").alias("key")), "buckets")
    centre = F.min_by(F.struct("mark", "n"), F.xxhash64("mark", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size"), centre.alias("centre")).filter("size > 1").select("key", "centre")
    buckets = materialize(buckets.hint("merge").join(shared, "key"), "shared")

    star = buckets.filter((F.col("mark") != F.col("centre.mark")) & _sizes_allow(F.col("n"), F.col("centre.n"), least))
    star = materialize(star.select(F.least("mark", "centre.mark").alias("a"), F.greatest("mark", "centre.mark").alias("b")).distinct(), "star")
    near = materialize(fingerprint_pairs(docs, doc_id, text).join(star, ["a", "b"], "left_anti"), "near")
    links = materialize(confirmed(near.union(star), docs, least, words, text), "links")
    roots = connected_components(links).withColumnRenamed("id", "mark")
    def sides(roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Buckets of more than one component: all their members, and those outside of the largest component."""
        placed = buckets.select("key", "mark", "n").join(roots, "mark", "left").withColumn("root", F.coalesce("root", "mark"))
        placed = materialize(placed, "placed")
        counted = placed.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.count("*").alias("parts"), F.max_by("root", F.struct("m", "root")).alias("main"))
        mixed = materialize(placed.hint("merge").join(counted.filter("parts > 1").select("key", "main"), "key"), "mixed")
        return mixed, mixed.filter("root <> main").select("key", F.col("mark").alias("x"), F.col("n").alias("m"), F.col("root").alias("x_root"))

    # what the first pass left apart meets all of other components: in small buckets as pairs, in large ones by cells
    mixed, rest = sides(roots)
    counted = mixed.groupBy("key").agg((F.count("*") * F.sum((F.col("root") != F.col("main")).cast("long"))).alias("pairs"))
    large = materialize(counted.filter(F.col("pairs") > MOST_PAIRS).select("key"), "large")
    few_mixed, few_rest = (t.join(broadcast_if_small(large), "key", "left_anti") for t in (mixed, rest))
    apart = few_rest.hint("merge").join(few_mixed, "key").filter((F.col("x_root") != F.col("root")) & ((F.col("root") == F.col("main")) | (F.col("x") < F.col("mark"))))
    apart = apart.filter(_sizes_allow(F.col("m"), F.col("n"), least)).select(F.least("x", "mark").alias("a"), F.greatest("x", "mark").alias("b")).distinct()
    apart = materialize(apart.join(star, ["a", "b"], "left_anti"), "apart")
    by_cells = links_in_cells(*(materialize(t.join(broadcast_if_small(large), "key", "left_semi"), "part") for t in (rest, mixed)), docs, least, words, text)
    roots = connected_components(links.union(confirmed(apart, docs, least, words, text)).union(by_cells)).withColumnRenamed("id", "mark")
    return rows.select("doc_id", "mark").join(broadcast_if_small(materialize(roots, "roots")), "mark", "left").select("doc_id", "mark", F.coalesce("root", "mark").alias("root"))


def fingerprint_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE) -> DataFrame:
    """Candidates ``a, b`` (marks of texts, a < b) by simhash: texts of one fingerprint, and one text each of fingerprints within ``radius`` bits.

    Texts of one fingerprint meet the least of them, linked fingerprints meet by
    the forest that links them, so a large group never unfolds to its pairs.
    """
    rows = materialize(fingerprints(docs, words, doc_id, text).select("mark", "fp").distinct(), "prints")
    least = materialize(rows.groupBy("fp").agg(F.min("mark").alias("first")), "firsts")
    alike = rows.hint("merge").join(least, "fp").filter("mark <> first").select(F.col("first").alias("a"), F.col("mark").alias("b"))
    end = lambda s: least.select(F.col("fp").alias(s), F.col("first").alias(f"m{s}"))
    linked = links_within(least.select("fp"), radius).hint("merge").join(end("a"), "a").hint("merge").join(end("b"), "b").filter("ma <> mb")
    return alike.union(linked.select(F.least("ma", "mb"), F.greatest("ma", "mb"))).distinct()


def keep_one(docs: DataFrame, least: float = LEAST, words: int = WORDS) -> DataFrame:
    """One row of each component, with the columns of ``docs``, as in ``simhash.keep_one``."""
    return one_of_each(docs, components(docs, least, words))
