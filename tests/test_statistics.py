"""Published vectors and fixed cases."""

from __future__ import annotations

import itertools
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from probeframe.functions import answers, graphs
from probeframe.functions import text as tx
from probeframe.operators import gaps, selection, significance
from probeframe.plans import registry

def frame(spark, vectors):
    rows = [(m, i, max(d, 0.0), max(-d, 0.0), d) for m, v in vectors.items() for i, d in enumerate(v)]
    return spark.createDataFrame(rows, "model string, item_id int, p_orig double, p_iso double, delta double")


def test_delta_statistics(spark):
    row = gaps.model_gaps(frame(spark, {"m": [0.5, -0.25, 0.25, 0.0]})).first()
    assert row["delta"] == 0.125 and row["se_pop"] == pytest.approx((0.078125 / 4) ** 0.5) and row["delta_irt"] == pytest.approx(1 / 3)


@pytest.mark.parametrize(("vector", "p"), [([0.5] * 7, 0.0078125), ([0.2] * 10, 0.0009765625), ([0.0] * 11 + [0.3], 0.5)])
def test_exact_sign_flips(vector, p):
    assert significance.signed_rank_exact(vector) == p


def test_exact_ranks_count_all_patterns():
    rng = random.Random(9)
    for _ in range(60):
        vector = [rng.choice([0.0, 0.1, -0.1, 0.2, -0.3, 0.3, 0.5]) for _ in range(rng.randint(1, 12))]
        sizes = sorted(abs(d) for d in vector if d)
        rank = {s: sum(i + 1 for i, x in enumerate(sizes) if x == s) / sizes.count(s) for s in sizes}
        seen = sum(rank[abs(d)] for d in vector if d > 0)
        sums = [sum(rank[s] for s, up in zip(sizes, signs, strict=True) if up) for signs in itertools.product([0, 1], repeat=len(sizes))]
        assert significance.signed_rank_exact(vector) == (sum(s >= seen for s in sums) / len(sums) if sizes else 1.0)


def test_exact_ranks_of_long_vectors(spark):
    rng = random.Random(2)
    vector = [round(rng.gauss(0.05, 0.4), 2) for _ in range(400)]
    items = spark.createDataFrame([("m", d) for d in vector], "model string, delta double")
    normal, exact = significance.rank_test(items).first(), significance.rank_test(items, exact_below=500).first()
    assert exact["p_table"] == significance.signed_rank_exact(vector) != normal["p_table"] == pytest.approx(exact["p_table"], rel=0.02)


def test_two_sample_p(spark):
    rows = [(True, v) for v in (2.1, 2.5, 3.3, 2.8, 2.2)] + [(False, v) for v in (3.1, 3.9, 3.4, 4.2)]
    r = significance.two_sample_t(spark.createDataFrame(rows, "g boolean, v double"), "g", "v").first()
    assert r["df"] == 7 and r["t"] == pytest.approx(-3.25785, rel=1e-5) and r["p_value"] == pytest.approx(significance.t_two_sided(r["t"], 7)) and 0.01 < r["p_value"] < 0.02
    lone = significance.two_sample_t(spark.createDataFrame(rows[:1], "g boolean, v double"), "g", "v").first()
    assert lone["t"] is None and lone["p_value"] is None


def test_asymptotic_rank_test(spark):
    items = spark.createDataFrame([("m", d) for d in [0.0] * 16 + [0.2, 0.4]], "model string, delta double")
    assert significance.rank_test(items).first()["p_table"] == pytest.approx(0.0899, abs=1e-4)


def test_tails():
    assert significance.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-9)
    assert significance.chi2_upper(10.0, 5) == pytest.approx(0.07523524614651217, rel=1e-9)


@pytest.mark.parametrize(
    ("text", "value"),
    [
        (r"Hence $\boxed{58}$ crates", 58), ("Working\n#### 7,015", 7015), ("That leaves 61 pears.", 61), (r"\boxed{2.75}", 2.75), ("", None), (None, None),
        (r"\boxed{nan} #### 5", None), (r"\boxed{x} #### 5", 5), (r"\boxed{1} and \boxed{7}", 7), (r"\boxed{1d}", 1.0),
    ],
)
def test_extraction(spark, text, value):
    frame = spark.createDataFrame([(text,)], "t string")
    got = frame.select(answers.extract_last(F.col("t"))).first()[0]
    assert got == value


GRAPHS = {
    "<<3+4=7>> <<16-7=9>> <<9*2=18>>\n#### 18": (7, 3, 18, "0fe94f95735a", "8dd9e0677639d72f"),
    "<<40+25+15=80>>\n#### 80": (4, 1, 80, "6c194bfba2d6", "bdbc757ec4a1611d"),
    "<<120/8=15>> <<15-3=12>>\n#### 12": (5, 2, 12, "102d7e265a22", "32fe4de823acb7dc"),
}


@pytest.mark.parametrize(("solution", "want"), GRAPHS.items())
def test_graphs(spark, solution, want):
    g = spark.createDataFrame([(solution,)], "s string").select(graphs.parse(F.col("s")).alias("g"))
    n = F.col("g.nodes")
    row = g.select("g.accepted", F.size(n), graphs.depth(n), graphs.execute(n), graphs.fingerprint_script(n), graphs.fingerprint_core(n)).first()
    assert tuple(row) == (True, *want)


def test_suffix_artifact(spark):
    row = spark.createDataFrame([("Tommy", "Zaramy", "Tommy")], "a string, b string, c string").select(tx.suffix_artifact(F.col("a"), F.col("b")), tx.suffix_artifact(F.col("a"), F.col("c"))).first()
    assert tuple(row) == ("my", None)


def test_stride(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(9000)], "g long, i long")
    got = [tuple(r) for r in selection.stride_sample(rows, "g", "i", 50).select("g", "i").collect()]
    assert sorted(got) == sorted((i % 3, i) for i in range(9000))[:: 9000 // 50][:50]


def test_every_sql_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_report_with_p_values(spark):
    vectors = {"low": [0.0] * 16 + [0.2, 0.4], "high": [0.4, 0.5, 0.6, 0.3, 0.5, 0.7, 0.4, 0.2, 0.5, 0.6, 0.3, 0.4, 0.5], "none": [0.0] * 4}
    report = {r["model"]: r for r in significance.rescored_report(frame(spark, vectors)).collect()}
    for m, v in vectors.items():
        low, high = significance.bootstrap_exact(v)
        n, mean = len(v), sum(v) / len(v)
        se = (sum((x - mean) ** 2 for x in v) / n) ** 0.5 / n**0.5
        t = mean / se if se else 0.0
        row = report[m]
        assert (row["boot_low"], row["boot_high"]) == (low, high) and row["t"] == pytest.approx(t) and row["df"] == max(1, n - 1)
        assert row["t_p"] == pytest.approx(significance.t_two_sided(t, n - 1))
    assert report["high"]["tabled"] == "Mem" and report["high"]["documented"] == "Pure" and report["high"]["rescored"] in ("PARTIAL_MEMORIZER", "PURE_MEMORIZER")
    assert report["none"]["tabled"] == "Inv" and report["low"]["rescored"] == "INVARIANT"
    lines = {r["model"]: r for r in significance.report_rows(significance.rescored_report(frame(spark, vectors))).collect()}
    assert "p<0.001" in lines["high"]["line"] and lines["none"]["latex"].endswith(" \\\\") and "p=1.000" in lines["none"]["line"]


def test_poisson_bootstrap_is_near_the_exact_one(spark):
    import random

    rng = random.Random(2)
    v = [rng.choice([0.0, 0.25, 0.5, -0.25, 1.0]) for _ in range(800)]
    low, high = significance.bootstrap_exact(v)
    got = significance.bootstrap(frame(spark, {"m": v}), draws=4000, exact_items=10).first()
    assert abs(got["boot_low"] - low) < 0.01 and abs(got["boot_high"] - high) < 0.01


def test_item_response_fit_against_gradient_descent(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    theta, b, la = rng.normal(0, 1, 6), rng.normal(0, 1, 12), rng.normal(0, 0.3, 12)
    rate = rng.binomial(40, 1 / (1 + np.exp(-np.exp(la) * (theta[:, None] - b)))) / 40
    rows = spark.createDataFrame([(f"m{j}", i, float(rate[j, i])) for j in range(6) for i in range(12)], "model string, item_id int, rate double")
    abilities, items = significance.fit_2pl(rows, rounds=60, tolerance=1e-4)
    got_theta = np.array([r["theta"] for r in abilities.orderBy("model").collect()])
    got_b = np.array([r["b"] for r in items.orderBy("item_id").collect()])
    t, bb, aa = np.zeros(6), np.zeros(12), np.zeros(12)
    for _ in range(30000):  # plain ascent of the same penalised likelihood
        a = np.exp(aa)
        e = rate - 1 / (1 + np.exp(-a * (t[:, None] - bb)))
        t = t + 0.02 * ((a * e).sum(1) - 0.02 * t)
        bb = bb + 0.02 * ((-a * e).sum(0) - 0.02 * bb)
        aa = np.clip(aa + 0.02 * ((a * (t[:, None] - bb) * e).sum(0) - 0.02 * aa), -2, 2)
    assert np.abs(got_theta - (t - t.mean())).max() < 0.05 and np.corrcoef(got_b, bb)[0, 1] > 0.99


def test_item_response_fit_of_repeated_items_is_that_of_one_weighted_item(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    rate = rng.integers(4, 37, (5, 9)) / 40
    one = [(f"m{j}", i, float(rate[j, i])) for j in range(5) for i in range(9) if (i + j) % 4]
    many = [(m, i + 100 * c, x) for c in range(40) for m, i, x in one]
    rng.shuffle(many)
    frame = lambda rows: spark.createDataFrame([(str(m), int(i), float(x)) for m, i, x in rows], "model string, item_id int, rate double").repartition(3)
    kept = []
    monkeypatch.setattr(significance, "written", lambda df, write=significance.written: kept.append(write(df)) or kept[-1])
    monkeypatch.setattr(significance, "ITEMS_OF_TASK", 2)
    abilities, items = significance.fit_2pl(frame(many), rounds=4)
    assert kept[-1].count() == 9 and {r["n"] for r in kept[-1].select("n").collect()} == {40}  # a round fits nine sets of rates, not 360 items
    found = {r["item_id"]: (r["a"], r["b"]) for r in items.collect()}
    assert len(found) == 360 and all(found[i + 100 * c] == found[i] for i in range(9) for c in range(40))
    sizes, j, y = np.array([sum(k == i for _, k, _ in one) for i in range(9)]), np.array([int(m[1]) for i in range(9) for m, k, _ in one if k == i]), np.array([x for i in range(9) for _, k, x in one if k == i])
    means = np.bincount(j, y) / np.bincount(j)
    theta = np.log(means / (1 - means))
    for _ in range(4):  # the same rounds over all 360 items at once
        la, b, g, h = significance._item_batch(theta, np.tile(sizes, 40), np.tile(j, 40), np.tile(y, 40), 0.01)
        g, h = np.bincount(np.tile(j, 40), g), np.bincount(np.tile(j, 40), h)
        step = np.clip((g - 0.02 * theta) / (h + 0.02), -1, 1)
        shift, scale = significance._gauge(theta + step, 360, b.sum(), (b * b).sum(), la.sum())
        theta = (theta + step + shift) * scale
    la, b, *_ = significance._item_batch(theta, sizes, j, y, 0.01)
    assert [r["theta"] for r in abilities.orderBy("model").collect()] == pytest.approx(list(theta - theta.mean()), abs=1e-9)
    assert [found[i] for i in range(9)] == [pytest.approx((x, z), abs=1e-6) for x, z in zip(np.exp(la), b, strict=True)]


def test_running_accuracy_with_bursts(spark):
    rows = [(i, f"2024-01-01 00:00:{min(i // 40, 9):02d}", f"m{i % 2}", i % 3 == 0) for i in range(900)]
    attempts = spark.createDataFrame(rows, "event_id int, ts string, model string, correct boolean").withColumn("ts", F.col("ts").cast("timestamp"))
    got = {r["event_id"]: (r["n_done"], r["accuracy"]) for r in gaps.running_accuracy(attempts, 7).collect()}
    for m in (0, 1):
        done = [i for i, *_ in rows if i % 2 == m]
        assert all(got[i] == (k + 1, pytest.approx(sum(j % 3 == 0 for j in done[: k + 1]) / (k + 1))) for k, i in enumerate(done))


def test_full_test_and_its_parts(spark):
    rng = random.Random(4)
    rows = [(m, i, v, t, v == 0, rng.random() < (0.95 if v == 0 else 0.95 - drop)) for m, drop in (("steady", 0.0), ("fallen", 0.8)) for i in range(40) for v in range(6) for t in range(4)]
    responses = spark.createDataFrame(rows, "model string, item_id int, variant_no int, trial int, is_original boolean, correct boolean")
    z = significance.item_z(responses)
    got = {r["model"]: r for r in significance.global_test(z).collect()}
    bound = NormalDist().inv_cdf(1 - 0.05 / (2 * 40))
    for model in ("steady", "fallen"):
        zs = []
        for i in range(40):
            mine = [r for r in rows if r[0] == model and r[1] == i]
            p, t = sum(r[5] for r in mine if r[4]) / 4, 4
            means = [sum(r[5] for r in mine if r[2] == v) / 4 for v in range(1, 6)]
            mean = sum(means) / 5
            se = math.sqrt(p * (1 - p) / t + sum((x - mean) ** 2 for x in means) / 5 / 5)
            zs.append((p - mean) / se if se > 0 else 0.0)
        assert got[model]["n_flagged"] == sum(x > bound for x in zs) and got[model]["bound"] == pytest.approx(bound)
        chi2 = sum(max(x, 0) ** 2 for x in zs)
        assert got[model]["chi2"] == pytest.approx(chi2) and got[model]["p_value"] == pytest.approx(significance.chi2_upper(chi2, 40))
    assert got["fallen"]["n_flagged"] > 20 > got["steady"]["n_flagged"]


def test_ability_shift(spark):
    rows = [("a", 1.0, 0.5), ("b", 0.2, 0.1), ("c", -0.5, 0.5)]
    for r, (_, o, v) in zip(significance.decompose_ability(spark.createDataFrame(rows, "model string, theta_orig double, theta_iso double")).orderBy("model").collect(), rows, strict=True):
        se = math.sqrt(0.02)
        p = 2 * (1 - NormalDist().cdf(abs(o - v) / se))
        assert r["shift"] == pytest.approx(o - v) and r["ci_low"] == pytest.approx(o - v - 1.96 * se) and r["z_stat"] == pytest.approx((o - v) / se) and r["p_value"] == pytest.approx(p, abs=1e-12) and r["significant"] == (p < 0.01)
