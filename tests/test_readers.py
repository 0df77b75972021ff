"""The small readers on Arrow batches, held against the Columns of the same rules."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from probeframe.functions import leaf_roles, names
from probeframe.functions import text as tx
from probeframe.functions.memo import Memo


def test_memo_reads_what_repeats_once_and_stays_bounded():
    met = []

    def read(rows):
        met.extend(rows)
        return pa.array([r and r.upper() for r in rows], pa.string())

    memo = Memo(read, most=3)
    assert memo(["a", None, "a", "b"]).to_pylist() == ["A", None, "A", "B"] and met == ["a", None, "b"]
    assert memo(["b", "a"]).to_pylist() == ["B", "A"] and len(met) == 3
    assert memo(["c", "a", "d", "e", "f"]).to_pylist() == ["C", "A", "D", "E", "F"]  # more than it may keep
    assert memo([]).to_pylist() == [] and len(memo.results) == len(memo.places) <= 5


def test_names_agree_with_the_columns(spark):
    rng = random.Random(3)
    words = ["Tommy", "Tommymy", "Zaramy", "Zara", "O'Neil", "O'Neilx", "Ann-Lee", "the", "boxes", "À-propos", "Élodie", "Élodieodie", "Bob's", "Bobs", "Zara’"]
    pairs = [(rng.choice(words), " ".join(rng.choices(words, k=6)), rng.choice(words)) for _ in range(300)]
    df = spark.createDataFrame(pairs, "name string, text string, word string").filter("length(name) >= 3")
    for r in df.select("*", tx.whole_word_count(F.col("text"), F.col("name")).alias("n"), tx.suffix_artifact(F.col("name"), F.col("word")).alias("s")).collect():
        assert (names.count(r["text"], r["name"]), names.left_suffix(r["name"], r["word"])) == (r["n"], r["s"])


def test_failures_of_null_texts_and_repair(spark):
    rows = [("Tommy ran. Did Tommy win?", "Zaramy ran. Did Tommy win? Said Zara."), (None, "Zara"), ("Tommy", None)]
    df = spark.createDataFrame(rows, "q string, v string")
    got = df.select(tx.name_failures(F.col("q"), F.col("v")).alias("f"), tx.mended_names(F.col("q"), F.col("v")).alias("m")).collect()
    assert [r["f"] for r in got[1:]] == [[], []] and [r["m"] for r in got[1:]] == [None, None]
    assert {(f["check"], f["details"]) for f in got[0]["f"]} == {("SUBSTRING_ARTIFACT", "Zaramy ends in my of Tommy"), ("LEFTOVER_NAME", "Tommy x 1")}
    assert got[0]["m"] == "Zara ran. Did Zara win? Said Zara."


def test_conversion_factors_agree_with_the_column(spark):
    texts = ["Every 12 days", "60 minutes in an hour", "EACH of 24", "12.5 percent", "3 of 7 out of 10", "100%", "x.12 per day", "every other odd long 52", "7 per week and 12 weeks", "1000", ""]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.conversion_values(F.col("t")).alias("v")).collect():
        assert leaf_roles.factors(r["t"]) == set(r["v"]), r["t"]


def test_new_numbers_agree_with_the_column(spark):
    from probeframe.operators import variants

    texts = ["5 and 5 and 12.5x, 3,000 then 5", "12 of 12.5 (12)", "no", "a5 5a 5.5 5."]
    changes = [("5", "7"), ("5", "12"), ("12", "99"), ("12.5", "8"), ("000", "1")]
    by_old = {}
    for old, new in changes:
        by_old.setdefault(old, []).append(new)
    listed = F.array(*[F.struct(F.lit(o).alias("old"), F.lit(n).alias("new")) for o, n in changes])
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.replace_numbers(F.col("t"), listed).alias("n")).collect():
        assert variants.variant_text(r["t"], by_old, 0) == r["n"]
    assert variants.variant_text("Janet and Tom; Tom's 3", {"3": ["4"]}, 0) == "Priya and Tom; Tom's 4"


def test_variants_are_made_without_expressions_on_their_texts(spark):
    """The filter on texts that stay as they were used to be pushed below what makes them, which then ran again for each use."""
    from probeframe.functions import graphs
    from probeframe.operators import variants

    rows = spark.createDataFrame([("p", "Tom packs 12 boxes of 30.", "<<12*30=360>>\n#### 360")], "pid string, question string, s string")
    made = variants.mutate(rows.select("pid", "question", F.explode(F.array(graphs.parse(F.col("s")))).alias("g")).select("pid", "question", "g.nodes", "g.answer"))
    assert "regexp" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    assert all(r["variant_question"] != "Tom packs 12 boxes of 30." for r in made.collect())


def test_reasons_are_evaluated_once_where_they_are_unfolded(spark):
    from probeframe.plans.item_plans import QUERIES

    plan = QUERIES["reason_breakdown"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("consensus_near_miss") == 1
