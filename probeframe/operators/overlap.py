"""Texts that hold, or share much with, protected benchmark items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.functions.text import let
from probeframe.operators.joins import join_counted
from probeframe.operators.scratch import written

#: Words of a shingle; words of the key that candidates share.
SHINGLE, KEY_WORDS = 5, 3
#: Items up to which their keys are broadcast; short items that go to the documents at once.
MOST_BROADCAST, BLOCK_ITEMS = 50_000, 1_000


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct runs of ``n`` words; the whole of a shorter text that has words; none for empty and null texts."""
    run = lambda w, i: F.concat_ws(" ", *[F.get(w, i + j) for j in range(n)])
    runs = lambda w: F.when(F.size(w) >= n, F.array_distinct(F.slice(F.transform(w, lambda x, i: run(w, i)), 1, F.size(w) - n + 1))).when(F.size(w) > 0, F.array(F.array_join(w, " ")))
    return let(words(text), runs)


def _keys(words: Column, size: int) -> Column:
    """Distinct hashes of all runs of ``size`` words."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(size)]))
    return let(words, lambda w: F.when(F.size(w) >= size, F.array_distinct(runs(w))))


def containments(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where the document's text holds the item's whole text.

    What stands between an item's first and last word are whole words of the
    document too, so up to three words from the second on are the key of the
    join; only documents that share it are searched.  Items of one or two words
    have nothing between: each block of :data:`BLOCK_ITEMS` of them goes to the
    documents as one row.  An empty item is in every text; nulls are in none.
    """
    listed = items.filter("text is not null").select("item_id", F.col("text").alias("item"), words(F.col("text")).alias("w"))
    size = F.least(F.size("w") - 2, F.lit(KEY_WORDS))
    listed = written(listed.select("item_id", "item", "w", size.alias("size")))
    parts = []
    for k in range(1, KEY_WORDS + 1):
        keyed = listed.filter(F.col("size") == k).select("item_id", "item", F.xxhash64(*[F.get("w", j + 1) for j in range(k)]).alias("key"))
        n = keyed.limit(MOST_BROADCAST + 1).count()
        if n:
            each = docs.select("doc_id", F.explode(_keys(words(F.col("text")), k)).alias("key"))
            keys = keyed.select("item_id", "key")
            near = each.join(F.broadcast(keys) if n <= MOST_BROADCAST else keys, "key").select("doc_id", "item_id").distinct()
            found = near.join(docs.select("doc_id", "text"), "doc_id").join(keyed.select("item_id", "item"), "item_id")
            parts.append(found.filter(F.contains("text", F.col("item"))).select("doc_id", "item_id"))
    short = listed.filter("size <= 0").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(-(-listed.filter("size <= 0").count() // BLOCK_ITEMS) or 1)))
    for row in short.select("block").distinct().toLocalIterator():
        block = short.filter(F.col("block") == row["block"]).agg(F.collect_list(F.struct("item_id", "item")).alias("some"))
        held = docs.crossJoin(F.broadcast(block)).select("doc_id", F.explode(F.filter("some", lambda x: F.contains("text", x["item"]))).alias("x"))
        parts.append(held.select("doc_id", "x.item_id"))
    if not parts:
        return docs.select("doc_id").crossJoin(items.select("item_id").limit(0)).limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out.distinct()


def similar(docs: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """``doc_id, item_id, shared, jaccard, held``: documents with the share ``least`` of an item's shingles or more.

    Of an item with n shingles such a document lacks n - ceil(least * n) at most,
    so it holds one of any n - ceil(least * n) + 1 of them: candidates are joined
    on those that the fewest documents have, the item's prefix, and what else
    they share is counted in the document's own row.  A shingle of a third of
    the documents costs a row for each of them, whatever the number of items
    that have it.  A repeated row of documents gives repeated rows, null texts
    and texts without words have no shingles.
    """
    hashed = lambda df, *keys: df.select(*keys, F.transform(shingles(F.col("text")), lambda s: F.xxhash64(s)).alias("hs")).filter("size(hs) > 0")
    wanted = hashed(items, "item_id").withColumn("n_item", F.size("hs"))
    asked = written(wanted.select("item_id", "n_item", F.explode("hs").alias("h"), "hs"))
    known = asked.select("h").distinct()
    if written(known).limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    rows = hashed(docs.withColumn("__row", F.monotonically_increasing_id()), "doc_id", "__row").select("doc_id", "__row", F.size("hs").alias("n_doc"), F.explode("hs").alias("h"))
    hits = written(rows.join(known, "h", "left_semi"))
    frequency = hits.groupBy("h").agg(F.count("*").alias("df"))
    n = F.col("n_item")
    nth = F.row_number().over(Window.partitionBy("item_id", "hs").orderBy("df", "h"))  # an item's own shingles
    placed = asked.join(frequency, "h", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("nth", nth)
    prefix = placed.filter((F.col("nth") <= n - F.ceil(n * F.lit(least) - 1e-9) + 1) & (F.col("df") > 0))
    near = hits.join(prefix.select("h", "item_id", "n_item", "hs"), "h").select("__row", "item_id", "n_item", "hs").distinct()
    held_by = hits.groupBy("__row", "doc_id", "n_doc").agg(F.collect_list("h").alias("own"))
    counts = near.join(held_by, "__row").select("doc_id", "item_id", "n_doc", "n_item", F.size(F.array_intersect("own", "hs")).cast("long").alias("shared"))
    held = F.col("shared") / F.col("n_item")
    jaccard = F.col("shared") / (F.col("n_doc") + F.col("n_item") - F.col("shared"))
    return counts.select("doc_id", "item_id", "shared", jaccard.alias("jaccard"), held.alias("held")).filter(F.col("held") >= least)


def exact_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, surface_hash, n_copies, first_id`` of every non-null text; copies are counted by hash, never gathered, and a popular text stays spread."""
    hashed = docs.filter(F.col("text").isNotNull()).select("doc_id", F.sha2("text", 256).alias("full"))
    counts = hashed.groupBy("full").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("first_id"))
    return join_counted(hashed, counts, ["full"], "n_copies").select("doc_id", F.substring("full", 1, 16).alias("surface_hash"), "n_copies", "first_id")
