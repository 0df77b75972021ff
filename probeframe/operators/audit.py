"""Audits of variants: consensus of models, value checks, names; and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from probeframe.functions import text as tx
from probeframe.functions.answers import magnitude, matches_audit
from probeframe.operators.joins import join_counted
from probeframe.operators.scratch import written
from probeframe.operators.significance import two_sample_t


def consensus(answers: DataFrame, key: str = "variant") -> DataFrame:
    """``key, n_answers, consensus, votes`` from ``key, model, extracted``.

    In the order of models each answer joins the first bucket it matches within
    1%, or opens one; the bucket with most votes wins, the first on a tie.  Under
    two answers there is no consensus.  A key has one answer per model, so its
    array is as long as there are models.
    """
    listed = answers.filter(F.col("extracted").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("model", "extracted"))).alias("list"))
    kind = "array<struct<v:double,n:int>>"

    def vote(buckets: Column, x: Column) -> Column:
        a = x["extracted"]
        hits = F.filter(F.transform(buckets, lambda b, i: F.when(matches_audit(a, b["v"]), i)), lambda i: i.isNotNull())
        at = F.try_element_at(hits, F.lit(1))
        more = F.transform(buckets, lambda b, i: F.struct(b["v"].alias("v"), F.when(i == at, b["n"] + 1).otherwise(b["n"]).cast("int").alias("n")))
        return F.when(F.size(hits) > 0, more.cast(kind)).otherwise(F.array_append(buckets, F.struct(a.cast("double").alias("v"), F.lit(1).alias("n"))).cast(kind))

    buckets = F.aggregate("list", F.array().cast(kind), lambda b, x: vote(b, x).cast(kind))
    most = F.array_max(F.transform("buckets", lambda b: b["n"]))
    winner = F.try_element_at(F.filter("buckets", lambda b: b["n"] == most), F.lit(1))
    enough = F.size("list") >= 2
    return listed.withColumn("buckets", buckets).select(
        key, F.size("list").alias("n_answers"), F.when(enough, winner["v"]).alias("consensus"), F.when(enough, winner["n"]).otherwise(F.lit(0)).alias("votes")
    )


def conflated(text: Column) -> Column:
    """Numbers that a text has more than once, 0 to 2 apart."""
    repeated = lambda found: F.filter(F.array_distinct(found), lambda v: (F.size(F.filter(found, lambda x: x == v)) > 1) & ~v.isin(0.0, 1.0, 2.0))
    return tx.let(tx.audit_numbers(text), repeated)


def variant_reasons(question: Column, answer: Column, variant_question: Column, variant_answer: Column, agreed: Column, votes: Column) -> Column:
    """``array<string>``: the names of the checks that a variant fails."""
    own, new = tx.audit_numbers(question), tx.audit_numbers(variant_question)
    rest = variant_answer - variant_answer.cast("bigint")
    ratio = F.try_divide(variant_answer, answer)
    grown = F.greatest(F.when((F.size(own) > 0) & (F.size(new) > 0) & (F.array_max(own) > 0), F.try_divide(F.array_max(new), F.array_max(own))).otherwise(F.lit(1.0)), F.lit(1.0))
    off = agreed.isNotNull() & (votes >= 2) & ~matches_audit(agreed, variant_answer)
    return F.array_compact(
        F.array(
            F.when(matches_audit(answer, variant_answer) & (own != new), "answer_invariant"),
            F.when((F.abs(rest) > 0.01) & (F.abs(rest - 0.5) > 0.01), "non_integer_answer"),
            F.when(F.size(conflated(variant_question)) > 0, "value_conflation"),
            F.when(off & matches_audit(agreed, variant_answer, 0.05), "consensus_near_miss"),
            F.when(off & ~matches_audit(agreed, variant_answer, 0.05), "consensus_disagrees"),
            F.when((answer != 0) & (variant_answer != 0) & ((ratio > 10) | (ratio < 0.1)) & ((ratio > grown * 3) | (ratio < 1 / (grown * 3))), "extreme_answer_ratio"),
        )
    )


def variant_status(reasons: Column) -> Column:
    has = lambda r: F.array_contains(reasons, r)
    return F.when(has("consensus_disagrees"), "broken").when(has("answer_invariant") | has("non_integer_answer") | (F.size(reasons) >= 2), "suspicious").otherwise("clean")


def item_status(verdicts: DataFrame, item: str = "item_id") -> DataFrame:
    """Counts of variant verdicts and the item's: broken from three broken, partial from one, suspicious from three suspicious."""
    count = lambda s: F.sum((F.col("status") == s).cast("long"))
    rows = verdicts.groupBy(item).agg(count("clean").alias("n_clean"), count("broken").alias("n_broken"), count("suspicious").alias("n_suspicious"), F.coalesce(F.every(F.array_contains("reasons", "answer_invariant")), F.lit(True)).alias("all_invariant"))
    status = F.when(F.col("n_broken") >= 3, "broken").when(F.col("n_broken") >= 1, "partial").when(F.col("n_suspicious") >= 3, "suspicious").otherwise("clean")
    return rows.withColumn("item_status", status)


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """Counts and shares by status."""
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def duplicates(rows: DataFrame, group: str, text: str, order: str) -> DataFrame:
    """Rows whose text an earlier row of their group has, with that first row's id; by a grouped minimum, so no group is gathered and a popular text stays spread."""
    keys = {"__g": F.col(group), "__h": F.xxhash64(text), "__h2": F.sha2(text, 256)}
    first = rows.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(F.min(order).alias("first"), F.count("*").alias("__n")).filter("__n > 1")
    return join_counted(rows.withColumns(keys), first, list(keys), "__n").filter(F.col(order) != F.col("first")).drop(*keys, "__n")


def entity_failures(pairs: DataFrame) -> DataFrame:
    """``item_id, variant_id, check, details`` from ``item_id, question, variant_id, variant_question, all_values_present``.

    Names of the original against the words of each variant; every part stays in
    the variant's row until its failures are unfolded.
    """
    return _unfolded(pairs, _names_checked(pairs))


def _names_checked(pairs: DataFrame) -> DataFrame:
    """Every pair's ids, what its names fail, whether a value is absent, and a hash of item and text: written, as several checks read it."""
    failed = tx.name_failures(F.col("question"), F.col("variant_question"))
    return written(pairs.select("item_id", "variant_id", failed.alias("failed"), (F.col("all_values_present") == False).alias("absent"), F.xxhash64("item_id", "variant_question").alias("rough")))  # noqa: E712


def _unfolded(pairs: DataFrame, checked: DataFrame) -> DataFrame:
    ids = ["item_id", "variant_id"]
    names = checked.select(*ids, F.explode("failed").alias("f")).select(*ids, "f.check", "f.details")
    flagged = checked.filter("absent").select(*ids, F.lit("NUMBER_GRAPH_MISMATCH").alias("check"), F.lit("a value is absent").alias("details"))
    found = names.unionByName(flagged)
    # equal texts of an item have equal hashes: where no hash repeats there is nothing to compare
    if checked.groupBy("rough").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return found
    twice = duplicates(pairs, "item_id", "variant_question", "variant_id").select(*ids, F.lit("DUPLICATE").alias("check"), F.concat(F.lit("same text as "), "first").alias("details"))
    return found.unionByName(twice)


def items_by_failure(pairs: DataFrame, failures: DataFrame) -> DataFrame:
    """``item_id, has_failures`` of every item."""
    rows = pairs.select("item_id", F.lit(False).alias("bad"), F.lit(True).alias("own")).unionByName(failures.select("item_id", F.lit(True).alias("bad"), F.lit(False).alias("own")))
    return rows.groupBy("item_id").agg(F.max("bad").alias("has_failures"), F.max("own").alias("own")).filter("own").drop("own")


def route(pairs: DataFrame) -> DataFrame:
    """``item_id, variant_id, variant_question, route``: intact, trimmed, regenerated; quarantined items have no rows kept.

    An item without failures stays; with two passing variants it keeps those;
    else all its variants are repaired and audited again, and two must pass.
    """
    return _routed(pairs).filter("kept").drop("kept")


def _routed(pairs: DataFrame) -> DataFrame:
    """All rows of ``pairs`` with their route and whether they are ``kept``.

    Names are read, mended and read again where a pair is; then pairs meet once,
    by item, and all else is decided there: nothing is written or joined.  Equal
    texts are known by two 64-bit hashes, so that texts which nobody asks for aren't shuffled.
    """
    absent = F.coalesce(F.col("all_values_present") == False, F.lit(False))  # noqa: E712
    seen = pairs.select("item_id", "variant_id", "variant_question", absent.alias("absent"), F.explode(F.array(tx.audited_names(F.col("question"), F.col("variant_question")))).alias("n"))
    bits = lambda text: F.when(text.isNotNull(), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b")))
    seen = seen.select(
        "item_id", "variant_id", "variant_question", "n.changed", "n.mended", (F.col("n.failed") | F.col("absent")).alias("fails"), (F.col("n.still") | F.col("absent")).alias("fails_still"),
        bits(F.col("variant_question")).alias("text"), F.when(F.col("n.changed"), bits(F.col("n.mended"))).alias("new_text"),
    ).repartition("item_id")
    item = lambda *more: Window.partitionBy("item_id", *more)

    def judged(rows: DataFrame, text: str, fails: str, bad: str, n_bad: str, n_good: str) -> DataFrame:
        """Adds whether a row is bad, as one with its ids fails or repeats an earlier one's text, and its item's counts of bad and good rows."""
        twice = F.coalesce(F.col(text).isNotNull() & (F.col("variant_id") != F.min("variant_id").over(item(text))), F.lit(False))
        marked = rows.withColumn(bad, F.col(fails) | twice).withColumn(bad, F.col("item_id").isNotNull() & F.col("variant_id").isNotNull() & F.max(bad).over(item("variant_id")))
        return marked.withColumn(n_bad, F.count_if(F.col(bad)).over(item())).withColumn(n_good, F.count_if(~F.col(bad)).over(item()))

    rows = judged(seen, "text", "fails", "bad", "n_bad", "n_good").withColumn("new_text", F.when(F.col("changed"), F.col("new_text")).otherwise(F.col("text")))
    rows = judged(rows, "new_text", "fails_still", "bad_still", "n_bad_still", "n_mended")
    route = F.when(F.col("n_bad") == 0, "intact").when(F.col("n_good") >= 2, "trimmed").otherwise("regenerated")
    kept = F.col("item_id").isNotNull() & F.when(F.col("n_bad") == 0, True).when(F.col("n_good") >= 2, ~F.col("bad")).otherwise(~F.col("bad_still") & (F.col("n_mended") >= 2))
    text = F.when((route == "regenerated") & F.col("changed"), F.col("mended")).otherwise(F.col("variant_question"))
    return rows.select("item_id", "variant_id", text.alias("variant_question"), route.alias("route"), kept.alias("kept"))


def routed_items(pairs: DataFrame) -> DataFrame:
    """What :func:`provenance` tells of the items of ``pairs`` and their :func:`route`, where the pairs met."""
    items = _routed(pairs).groupBy("item_id").agg(F.max(F.when(F.col("kept"), F.col("route"))).alias("route"), F.count_if("kept").alias("n_variants"))
    route = F.coalesce("route", F.lit("quarantined"))
    return items.select("item_id", route.alias("route"), "n_variants", (route == "trimmed").alias("entity_trimmed"), (route == "regenerated").alias("entity_regenerated"))


def provenance(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Every item of ``pairs`` with what became of it: ``item_id, route, n_variants, entity_trimmed, entity_regenerated``; ``kept`` is :func:`route`'s result.

    Items without a kept variant are ``quarantined``.
    """
    by_item = kept.groupBy("item_id").agg(F.max("route").alias("route"), F.count("*").alias("n_variants"))
    rows = pairs.select("item_id").distinct().join(by_item, "item_id", "left")
    route = F.coalesce("route", F.lit("quarantined"))
    return rows.select("item_id", route.alias("route"), F.coalesce("n_variants", F.lit(0)).alias("n_variants"), (route == "trimmed").alias("entity_trimmed"), (route == "regenerated").alias("entity_regenerated"))


def route_counts(items: DataFrame) -> DataFrame:
    """``route, n_items, n_variants``: the counters of the cleaned set's description."""
    return items.groupBy("route").agg(F.count("*").alias("n_items"), F.sum("n_variants").alias("n_variants"))


def set_audit(questions: DataFrame) -> DataFrame:
    """``measure, t, df, p_value, cohens_d, n_fractional, n_fractional_regenerated`` of a set's originals against its variants.

    ``questions`` is ``question, answer, is_original, regenerated``.  Measures are
    the magnitudes of answers and of the largest numbers of the texts, texts
    without a number left out; originals count as the first sample.  Fractional
    answers are counted among variants, and among those of regenerated items; null
    answers are in neither.  A side under two values gives nulls.
    """
    largest = F.array_max(tx.audit_numbers(F.col("question")))
    rows = written(questions.select("is_original", F.coalesce("regenerated", F.lit(False)).alias("regenerated"), "answer", magnitude(F.col("answer")).alias("size"), F.log10(largest + 1).alias("largest")))
    odd = (~F.col("is_original")) & (F.col("answer") != F.floor("answer"))
    counts = rows.agg(F.count_if(odd).alias("n_fractional"), F.count_if(odd & F.col("regenerated")).alias("n_fractional_regenerated"))
    tests = [two_sample_t(rows, "is_original", c).select(F.lit(name).alias("measure"), "t", "df", "p_value", "cohens_d") for name, c in (("answer_magnitude", "size"), ("max_number", "largest"))]
    return tests[0].union(tests[1]).join(F.broadcast(counts))  # counts are one row


def with_passthrough(items: DataFrame, status: DataFrame, made: DataFrame) -> DataFrame:
    """The regenerated set: ``item_id, variant_id, question, answer, origin``.

    Items of ``status(item_id, status)`` that are clean keep their own variants
    of ``items`` (``item_id, variant_id, question, answer``); others have those
    of ``made`` if there are any, and are absent else.  A null status isn't clean.
    """
    clean = status.filter("status = 'clean'").select("item_id")
    own = items.join(clean, "item_id", "left_semi").select("item_id", "variant_id", "question", "answer", F.lit("clean").alias("origin"))
    new = made.join(clean, "item_id", "left_anti").select("item_id", "variant_id", "question", "answer", F.lit("regenerated").alias("origin"))
    return own.unionByName(new)
