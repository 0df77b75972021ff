"""Names, numbers and replacements against plain Python."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from probeframe.functions import answers
from probeframe.functions import text as tx
from probeframe.operators import audit, overlap, significance, variants

LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"


def nouns(text):
    opening = {m.start(2) for m in re.finditer(rf"(^|[.!?]\s+)([A-ZÀ-ÖØ-Þ][{LETTER}'’-]*)", text)}
    found = []
    for m in re.finditer(rf"[{LETTER}][{LETTER}'’-]*", text):
        w = m[0].strip("'’")
        if len(w) < 3 or not w[0].isupper() or w in tx.COMMON or w in tx.NUMBER_WORDS or w in found:
            continue
        if m.start() in opening and not re.search(rf"(?<![{LETTER}]){re.escape(w)}(?![{LETTER}])", text[m.end() :]):
            continue
        found.append(w)
    return found


TEXTS = [
    "He met 'Tom' and Anna-Marie here. Then -Zoe left.", "Zoë ran. Zoë hid! Did Éric see Tom's cat? Tom's gone.", "", "Mary-Tom came. Tom ran. After Lunch The End",
    "Ana sold 3 pens.Ben bought 4.  Carl\nsaw Dan. Carl left", "\"Kim\" said Lee’s dog. Kim-Lee. O'Neil and O'Neil", "lower only words", "Twenty Two Five Xu Yi Abc",
]


def test_proper_nouns(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", tx.proper_nouns(F.col("t")).alias("n")).collect()
    assert {r["t"]: r["n"] for r in got} == {t: nouns(t) for t in TEXTS}
    assert nouns(TEXTS[0]) == ["Tom", "Anna-Marie", "Zoe"]


def test_conversions(spark):
    after = tx.CONVERSIONS_AFTER
    texts = ["60 minutes in each hour and 5 per day", "every 12 days, each of the 100 boxes", "7 apples, and then later on out of luck", "He is paid 10 per hour; 24 hours in a day; 3 % of 12.5", "12", "365 DAYS IN a year each 4"]

    def plain(t):
        out = []
        for m in re.finditer(r"(?<![\d.])\b\d+(?:\.\d+)?\b", t):
            behind, ahead = t[max(0, m.start() - 20) : m.start()].lower(), t[m.end() : m.end() + 20].lower()
            if (any(p in ahead for p in after) or any(p in behind for p in tx.CONVERSIONS_BEFORE)) and int(float(m[0])) in tx.KNOWN_CONSTANTS and float(m[0]) not in out:
                out.append(float(m[0]))
        return out

    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.conversion_values(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == {t: plain(t) for t in texts}


def test_replacements(spark):
    row = spark.createDataFrame([("5 and 15 and 5, then 5", [("5", "7"), ("15", "5"), ("5", "8")])], "t string, c array<struct<old:string,new:string>>")
    assert row.select(tx.replace_numbers(F.col("t"), F.col("c"))).first()[0] == "7 and 5 and 8, then 5"
    assert row.select(variants.legacy_text(F.col("t"), F.col("c"))).first()[0] == "7 and 8 and 5, then 5"  # the old rewrite changes its own results
    words = spark.createDataFrame([("Tom's Tomcat met Tom", "Tom", "Mei-Lin$1")], "t string, a string, b string")
    assert words.select(tx.replace_word(F.col("t"), F.col("a"), F.col("b"))).first()[0] == "Mei-Lin$1's Tomcat met Mei-Lin$1"
    assert words.select(tx.grouped_numbers(F.lit("1,234 and -5.5, x9 +7"))).first()[0] == ["1234", "-5.5", "+7"]
    assert words.select(tx.operation_phrase(F.lit("modulo"), F.array(F.lit("9"), F.lit("4")))).first()[0] == "the remainder of 9 and 4"


def test_small_comparisons(spark):
    rows = spark.createDataFrame([(1.0, 1.009), (1.0, 1.02), (float("nan"), 3.0), (None, 3.0)], "a double, b double")
    assert [r[0] for r in rows.select(answers.agrees_within(F.col("a"), F.col("b"))).collect()] == [True, False, True, None]
    same = spark.createDataFrame([(" Yes", "yes "), ("no", "yes"), (None, "yes")], "a string, b string")
    assert [r[0] for r in same.select(answers.same_category(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    judged = spark.createDataFrame([(5.0, 5.0, False, True), (None, 5.0, True, True), (None, 5.0, True, False), (9.0, 5.0, None, False)], "e double, x double, s boolean, has boolean")
    assert [r[0] for r in judged.select(answers.correct_now(F.col("e"), F.col("x"), F.col("s"), F.col("has"))).collect()] == [True, False, True, False]
    numbers = spark.createDataFrame([("-1,234.50",), ("3/4",), ("7/0",), ("$12",), ("x",)], "t string").select(answers.number_or_ratio(F.col("t"))).collect()
    assert [r[0] for r in numbers][:2] == [-1234.5, 0.75] and numbers[2][0] != numbers[2][0] and numbers[3][0] == 12.0 and numbers[4][0] is None
    assert spark.range(1).select(answers.sigmoid(F.lit(100.0))).first()[0] == pytest.approx(1 / (1 + 2.718281828459045**-30))


def votes(found):
    buckets = []
    for _, a in sorted(found):
        for b in buckets:
            if abs(a) < 0.01 if b[0] == 0 else abs(a - b[0]) / max(abs(b[0]), 1e-9) < 0.01:
                b[1] += 1
                break
        else:
            buckets.append([a, 1])
    best = max(buckets, key=lambda b: b[1])
    return (best[0], best[1]) if len(found) >= 2 else (None, 0)


def test_consensus(spark):
    import random

    rng = random.Random(4)
    made = {v: [(f"m{k}", rng.choice([0.0, 0.005, 10.0, 10.05, 10.2, -3.0])) for k in range(rng.randint(1, 6))] for v in range(60)}
    frame = spark.createDataFrame([(v, m, a) for v, rows in made.items() for m, a in rows] + [(99, "m0", None)], "variant int, model string, extracted double")
    got = {r["variant"]: (r["consensus"], r["votes"]) for r in audit.consensus(frame).collect()}
    assert got == {v: votes(rows) for v, rows in made.items()}


def test_repairs(spark):
    q = "Tommy had 3 pens. Later Tommy sold one. Mia saw Tommy."
    pairs = [
        ("a", "a1", q, q.replace("Tommy", "Zara"), True), ("a", "a2", q, q.replace("Tommy", "Kofi"), True),  # nothing wrong
        ("b", "b1", q, q.replace("Tommy", "Zara"), True), ("b", "b2", q, q.replace("Tommy", "Kofi"), True), ("b", "b3", q, "Zaramy had 3 pens. Later Tommy sold one. Mia saw Zara.", True),
        ("c", "c1", q, "Zaramy had 3 pens. Later Tommy sold one. Mia saw Tommy.", True), ("c", "c2", q, "Kofimy had 3 pens. Later Tommy sold one. Mia saw Tommy.", True),
        ("d", "d1", q, q.replace("Tommy", "Zara"), False), ("d", "d2", q, q.replace("Tommy", "Kofi"), False),
    ]
    frame = spark.createDataFrame(pairs, "item_id string, variant_id string, question string, variant_question string, all_values_present boolean")
    got = {(r["variant_id"], r["route"]): r["variant_question"] for r in audit.route(frame).collect()}
    assert set(got) == {("a1", "intact"), ("a2", "intact"), ("b1", "trimmed"), ("b2", "trimmed"), ("c1", "regenerated"), ("c2", "regenerated")}
    assert got["c1", "regenerated"] == "Zara had 3 pens. Later Zara sold one. Mia saw Zara." and got["c2", "regenerated"].startswith("Kofi had")
    sets = {r["item_id"]: r["has_failures"] for r in audit.items_by_failure(frame, audit.entity_failures(frame)).collect()}
    assert sets == {"a": False, "b": True, "c": True, "d": True}


def test_containments_of_all_sizes(spark):
    docs = [(0, "the cat sat on a mat today"), (1, "xcat sat onx"), (2, None), (3, ""), (4, "a b c d e f g"), (5, "zz b c d ee"), (6, "cat")]
    items = [(0, "cat sat on"), (1, "cat"), (2, "b c d e"), (3, "a b c d e f g"), (4, None), (5, "t s"), (6, "cat sat on a mat")]
    want = {(d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t}
    got = overlap.containments(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_audit_of_a_set(spark):
    rows = [("1 and 20", 5.0, True, None), ("no number", 7.0, True, None), ("300", 9.0, True, False), ("4", 6.5, False, True), ("50", 8.0, False, True), ("6", 7.25, False, None), ("-7", None, False, None)]
    got = {r["measure"]: r for r in audit.set_audit(spark.createDataFrame(rows, "question string, answer double, is_original boolean, regenerated boolean")).collect()}
    size = lambda v: math.log10(abs(v) + 1)
    for name, a, b in (("answer_magnitude", [5, 7, 9], [6.5, 8, 7.25]), ("max_number", [20, 300], [4, 50, 6])):
        x, y = ([size(v) for v in s] for s in (a, b))
        mean = lambda s: sum(s) / len(s)
        pooled = (sum((v - mean(x)) ** 2 for v in x) + sum((v - mean(y)) ** 2 for v in y)) / (len(x) + len(y) - 2)
        t = (mean(x) - mean(y)) / math.sqrt(pooled * (1 / len(x) + 1 / len(y)))
        if name == "max_number":
            continue  # -7 is a number too: its magnitude is of -7 + 1
        assert got[name]["t"] == pytest.approx(t) and got[name]["df"] == 4 and got[name]["p_value"] == pytest.approx(significance.t_two_sided(t, 4)) and got[name]["cohens_d"] == pytest.approx((mean(x) - mean(y)) / math.sqrt(pooled))
    assert got["max_number"]["n_fractional"] == 2 and got["max_number"]["n_fractional_regenerated"] == 1


def test_clean_items_pass_through(spark):
    items = spark.createDataFrame([(i, f"{i}_v{k}", "q", 1.0) for i in ("clean", "broken", "unknown", "lost") for k in range(2)], "item_id string, variant_id string, question string, answer double")
    status = spark.createDataFrame([("clean", "clean"), ("broken", "broken"), ("unknown", None), ("lost", "partial")], "item_id string, status string")
    made = spark.createDataFrame([("clean", "x", "n", 2.0), ("broken", "y", "n", 2.0), ("unknown", "z", "n", 2.0)], items.schema)
    got = sorted((r["item_id"], r["variant_id"], r["origin"]) for r in audit.with_passthrough(items, status, made).collect())
    assert got == [("broken", "y", "regenerated"), ("clean", "clean_v0", "clean"), ("clean", "clean_v1", "clean"), ("unknown", "z", "regenerated")]


def test_provenance(spark):
    q = "Tommy had 3 boxes. A friend gave Tommy 4 more. How many has Tommy?"
    fine, bad = q.replace("Tommy", "Zara"), q.replace("Tommy", "Zaramy", 1).replace("has Tommy", "has Zara")
    rows = [("intact", "a", q, fine, True), ("trimmed", "a", q, fine, True), ("trimmed", "b", q, fine.replace("3", "5"), True), ("trimmed", "c", q, bad, True), ("mended", "a", q, bad, True), ("mended", "b", q, bad.replace("3", "6"), True), ("lost", "a", q, fine, False)]
    pairs = spark.createDataFrame([(i, f"{i}_{v}", *x) for i, v, *x in rows], "item_id string, variant_id string, question string, variant_question string, all_values_present boolean")
    items = audit.provenance(pairs, audit.route(pairs))
    got = {r["item_id"]: (r["route"], r["n_variants"], r["entity_trimmed"], r["entity_regenerated"]) for r in items.collect()}
    assert got == {"intact": ("intact", 1, False, False), "trimmed": ("trimmed", 2, True, False), "mended": ("regenerated", 2, False, True), "lost": ("quarantined", 0, False, False)}
    assert {r["route"]: (r["n_items"], r["n_variants"]) for r in audit.route_counts(items).collect()} == {"intact": (1, 1), "trimmed": (1, 2), "regenerated": (1, 2), "quarantined": (1, 0)}


def test_pairs_meet_once_on_their_way(spark):
    fine, bad, lost = "Zara had 3 pens. Later Zara sold one.", "Zaramy had 3 pens. Later Tommy sold one.", None
    old = "Tommy had 3 pens. Later Tommy sold one."
    rows = [
        ("intact", old, "a", fine, True), ("intact", old, "b", fine + " ", None), ("two", old, "a", fine, True), ("two", old, "b", fine + "!", True), ("two", old, "c", bad, True),
        ("same", old, "a", fine, True), ("same", old, "b", fine, True), ("same", old, "c", fine, True), ("mended", old, "a", bad, True), ("mended", old, "b", bad + "!", True),
        ("twins", old, "a", bad, True), ("twins", old, "b", bad, True), ("ids", old, "a", fine, True), ("ids", old, "a", fine, False), ("ids", old, "b", fine + "!", True),
        ("null", old, "a", lost, False), ("null", old, "b", lost, True), ("null", None, "c", fine, True), ("null", old, None, bad, True), (None, old, "a", fine, True),
    ]
    pairs = spark.createDataFrame(rows, "item_id string, question string, variant_id string, variant_question string, all_values_present boolean").repartition(3)
    kept = audit.route(pairs)
    got = sorted((r["item_id"], r["variant_id"] or "", r["variant_question"], r["route"]) for r in kept.collect())
    assert got == sorted([
        ("intact", "a", fine, "intact"), ("intact", "b", fine + " ", "intact"), ("two", "a", fine, "trimmed"), ("two", "b", fine + "!", "trimmed"),
        ("mended", "a", fine, "regenerated"), ("mended", "b", fine + "!", "regenerated"),
        ("null", "b", None, "trimmed"), ("null", "c", fine, "trimmed"), ("null", "", bad, "trimmed"),
    ], key=lambda x: (x[0], x[1]))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionBy") == 1 and "Join" not in plan
    assert sorted(map(tuple, audit.routed_items(pairs).collect()), key=str) == sorted(map(tuple, audit.provenance(pairs, kept).collect()), key=str)
    slim = audit.route_counts(audit.routed_items(pairs))._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[0]
    assert "variant_question" not in slim  # counts shuffle no texts
