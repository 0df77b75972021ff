"""Mixing sources to target weights (operator 4); DataFrame functions only.

The words of a source, its documents in a pseudorandom order, are cut into
blocks of fixed length.  A source's target gives its number of slots, the last
of them cut to the word; a multinomial draw deals them to the output shards.
A shard takes as many of the source's next slots as it drew; a slot's place
gives its epoch and position, and an index permutation of that epoch maps the
position to a block.  Blocks join slots by (source, index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.llm._shared import WORD, broadcast_if_small, materialize, word_count

#: Words in a block; documents in a prefix-sum bucket; slots in a chunk and, on the average, in an output shard.
BLOCK_WORDS, BUCKET_DOCS, CHUNK_SLOTS, SHARD_SLOTS = 128, 4096, 8192, 65536
#: Times that a source may be used at most; rounds of the permutation.
MOST_EPOCHS, ROUNDS = 3, 20


def weights_for(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """``sources`` with ``weight``: the given ones, repeated over the sources by code point, null last.

    Strings compare by their UTF-8 bytes, which is the order of code points.
    The window orders one row per source.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.element_at(cycle, (at % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, most: float = MOST_EPOCHS) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``: shares of all words by weight, none above ``most`` times its source.

    Sources stop at their cap in the order of cap over weight; the level that
    the rest share follows from running sums over that order, so one sort over
    the sources does what repeated resharing would.  A source without words has
    target 0.
    """
    cap = F.lit(most) * F.col("source_size")
    by = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    ranked = (
        sources.withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("level", level)
        .withColumn("stops", F.col("ratio") <= F.col("level"))
        # the level of the first source that doesn't stop holds for all after it
        .withColumn("final", F.min(F.when(~F.col("stops"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    )
    target = F.when(F.col("stops"), F.col("cap")).otherwise(F.col("weight") * F.col("final"))
    return ranked.select("source", "source_size", "n_docs", "weight", target.cast("double").alias("target"))


def index_of(position: Column, n: Column, key: Column) -> Column:
    """A pseudorandom permutation of 0 to n-1 for each ``key``: the swap-or-not shuffle (Hoang, Morris and Rogaway 2012).

    A round pairs x with k - x, for a k drawn from the key, and swaps each pair
    or not as a bit drawn from key and pair says; it holds for every n.
    """

    def permuted(of: Column) -> Column:
        def swap(x: Column, r: Column) -> Column:
            other = F.pmod(F.pmod(F.xxhash64(of["key"], r), of["n"]) - x, of["n"])
            return F.when(F.xxhash64(of["key"], r, F.greatest(x, other)) % 2 == 0, other).otherwise(x)

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), of["at"], swap)

    # as a lambda's variable, key and n are evaluated once and not in every round
    once = F.array(F.struct(key.alias("key"), n.alias("n"), position.alias("at")))
    return F.element_at(F.transform(once, permuted), 1)


class Mix:
    """The mix of one table: ``sources``, ``slots``, ``segments`` and what each document gives.

    ``docs`` needs an id, a text and a source; other columns are not read.  A
    null source is a source, last in order; a null text is empty and gives
    nothing; rows that repeat count as often as they occur; an empty table
    makes empty results.  A source with a third of all rows is spread: its
    order and prefix sums are by bucket and its slots by chunk.
    """

    def __init__(self, docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = BLOCK_WORDS, seed: int = 7, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> None:
        self.block, self.seed = block, seed
        # sizes are counted once; the text stays out of this table
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"))
        self.docs = materialize(rows, "sizes")
        grouped = self.docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
        self.sources = materialize(targets(weights_for(materialize(grouped, "sources"), weights)), "targets")
        size, words = F.col("source_size"), F.floor(F.col("target") + 0.5).cast("long")
        blocks = F.ceil(size / block).cast("long")
        full = F.when(size > 0, F.floor(words / size)).otherwise(F.lit(0)).cast("long")
        rest = words - full * size
        # a source's last block may be short: it keeps its place at the end of every epoch, so that the rest is counted to the word
        plan = self.sources.withColumn("n_blocks", blocks).withColumn("last_words", size - (blocks - 1) * block)
        self.plan = plan.withColumn("n_slots", full * blocks + F.ceil(rest / block).cast("long")).withColumn("cut", rest % block)
        self.n_shards = -(-(self.plan.agg(F.sum("n_slots")).first()[0] or 0) // SHARD_SLOTS) or 1
        self.placed = self._place()

    def _place(self) -> DataFrame:
        """Documents with ``start``, the words before them in their source's order."""
        n = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_DOCS))
        order = F.xxhash64("doc_id", F.lit(self.seed))
        sources = self.sources.select(F.col("source").alias("of"), "source_size", "target", "n_docs")
        rows = self.docs.join(broadcast_if_small(sources), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        rows = rows.withColumn("spot", order).withColumn("bucket", F.pmod(F.col("spot"), n))
        sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("sum"))
        before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(F.col("source").alias("of"), F.col("bucket").alias("b"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
        within = Window.partitionBy("source", "bucket").orderBy("spot", "doc_id", "mark", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("upto", F.sum("size").over(within)).withColumn("rank", F.row_number().over(within))
        joined = rows.join(sums, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")))
        start = (F.col("base") + F.col("upto") - F.col("size")).alias("start")
        return materialize(joined.select("doc_id", "source", "size", "mark", "source_size", "target", "bucket", "rank", start), "placed")

    def shard_counts(self) -> DataFrame:
        """``source, shard, n_slots, before``: how many of a source's slots each output shard draws, and how many the shards before it drew.

        Every slot draws its shard, so the counts of a source are one
        multinomial draw; slots are counted where they are drawn.
        """
        plan = self.plan.filter("n_slots > 0")
        chunks = plan.select("source", "n_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_slots") - 1) / CHUNK_SLOTS))).alias("chunk"))
        last = F.least((F.col("chunk") + 1) * CHUNK_SLOTS, F.col("n_slots")) - 1
        # few rows that unfold to many: their number of tasks is given, as it wouldn't follow from their bytes
        draws = chunks.repartition(self.n_shards, "source", "chunk").select("source", F.explode(F.sequence(F.col("chunk") * CHUNK_SLOTS, last)).alias("slot"))
        shard = F.pmod(F.xxhash64("source", "slot", F.lit(self.seed + 1)), F.lit(self.n_shards)).alias("shard")
        counts = draws.groupBy("source", shard).agg(F.count("*").alias("n_slots"))
        before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("n_slots").over(before), F.lit(0)))

    def slots(self) -> DataFrame:
        """``source, shard, epoch, position, index, take``: one row for each block that the mix takes, and the words it takes of it."""
        counts = materialize(self.shard_counts(), "counts")
        plan = self.plan.select(F.col("source").alias("of"), "n_blocks", "last_words", F.col("n_slots").alias("total"), "cut")
        drawn = counts.join(broadcast_if_small(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        drawn = drawn.repartition(self.n_shards, "source", "shard")
        slots = drawn.select("source", "shard", "n_blocks", "last_words", "total", "cut", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n_slots") - 1)).alias("slot"))
        slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("n_blocks"))).withColumn("position", F.pmod("slot", "n_blocks"))
        whole = F.col("n_blocks") - (F.col("last_words") < self.block).cast("long")  # blocks that are not short
        moved = index_of(F.col("position"), F.greatest(whole, F.lit(1)), F.xxhash64("source", "epoch", F.lit(self.seed)))
        words = F.when(F.col("position") < whole, F.lit(self.block)).otherwise(F.col("last_words"))
        return slots.select(
            "source", "shard", "epoch", "position", F.when(F.col("position") < whole, moved).otherwise(F.col("position")).alias("index"),
            F.when((F.col("slot") == F.col("total") - 1) & (F.col("cut") > 0), F.col("cut")).otherwise(words).alias("take"),
        )

    def segments(self) -> DataFrame:
        """``source, index`` and the piece of a document there: words ``first`` to ``first + words - 1`` of the document, from word ``at`` of the block."""
        b, start, size = self.block, F.col("start"), F.col("size")
        spans = self.placed.filter("size > 0").select("*", F.explode(F.sequence(F.floor(start / b), F.floor((start + size - 1) / b))).alias("index"))
        first = F.greatest(F.lit(0), F.col("index") * b - start)
        stop = F.least(size, (F.col("index") + 1) * b - start)
        at = F.greatest(F.lit(0), start - F.col("index") * b)
        return spans.select("source", "index", "doc_id", "mark", "bucket", "rank", first.alias("first"), (stop - first).alias("words"), at.alias("at"))

    def blocks(self) -> DataFrame:
        """The mix: every slot with the document pieces of its block, ``shard, source, epoch, position, index, doc_id, first, words``.

        Null ids and sources are kept; texts without words have no piece.
        """
        pieces = self.segments().withColumn("s", F.coalesce(F.col("source"), F.lit(""))).withColumn("none", F.col("source").isNull())
        slots = self.slots().select(F.coalesce(F.col("source"), F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "index", "epoch", "position", "shard", "take")
        # both sides grow with the words, whatever size the planner guesses for an exploded sequence
        joined = slots.hint("merge").join(pieces, ["s", "none", "index"]).drop("s", "none").filter(F.col("take") > F.col("at"))
        return joined.withColumn("words", F.least("words", F.col("take") - F.col("at"))).drop("take", "at")

    def documents(self) -> DataFrame:
        """``doc_id, size, source_size, target, taken`` of every row."""
        taken = self.blocks().groupBy("source", "bucket", "rank").agg(F.sum("words").alias("taken"))
        taken = taken.select(F.col("source").alias("of"), F.col("bucket").alias("b"), F.col("rank").alias("r"), "taken")
        same = F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("b")) & (F.col("rank") == F.col("r"))
        return self.placed.join(taken, same, "left").select(
            "doc_id", "size", "source_size", "target", F.coalesce(F.col("taken"), F.lit(0)).cast("long").alias("taken"), "source"
        )


def mixed_texts(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them, with its columns: one row for each document and epoch.

    A document that an epoch takes whole keeps its text as it is; of another,
    the taken words are joined by single spaces in their order.  ``n_chars``,
    if present, is counted anew.
    """
    mix = Mix(docs, weights, block, seed)

    def key(doc_id: str, source: str, mark: Column) -> Column:
        return F.concat_ws("/", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), mark.cast("string"), F.xxhash64(source).cast("string"))

    parts = mix.blocks().groupBy("source", "doc_id", "mark", "bucket", "rank", "epoch").agg(
        F.sort_array(F.collect_list(F.struct("first", "words"))).alias("spans"), F.sum("words").alias("got")
    )
    takes = parts.groupBy("source", "doc_id", "mark", "bucket", "rank").agg(F.collect_list(F.struct("spans", "got")).alias("takes"))
    takes = takes.select(key("doc_id", "source", F.col("mark")).alias("key"), "bucket", "rank", "takes")
    # rows that repeat share a key: the nth of them gives what the nth place in the order takes.
    # The last condition is no key of the join, so that the rows are dealt once for window and join.
    takes = takes.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("bucket", "rank")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("key", key("row.doc_id", "row.source", F.xxhash64("row.text")))
    rows = rows.withColumn("mth", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    joined = rows.join(takes, (rows.key == takes.key) & (F.col("nth") - F.col("mth") == 0)).select("row", F.explode("takes").alias("take"))
    words = F.filter(F.split(F.col("row.text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = F.array_join(F.flatten(F.transform("take.spans", lambda s: F.slice(words, (s["first"] + 1).cast("int"), s["words"].cast("int")))), " ")
    whole = F.col("take.got") == word_count(F.col("row.text"))
    made = joined.select("row", F.when(whole, F.col("row.text")).otherwise(some).alias("mixed"))
    new = {"text": F.col("mixed"), "n_chars": F.length("mixed").cast("long")}
    return made.select(*[new.get(c, F.col("row")[c]).alias(c) for c in docs.columns])

