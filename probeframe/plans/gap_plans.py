"""Accuracy gaps, their tests, and the choice of responses."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.functions import answers, verdicts
from probeframe.operators import gaps, selection, significance
from probeframe.plans._shape import r, rounded
from probeframe.sources import json_files
from probeframe.sources.domain import attempts, responses, table, with_views

ITEMS = """, items AS (
    SELECT model, item_id, avg(CASE WHEN is_original THEN CAST(correct AS DOUBLE) END) AS p_orig,
           avg(CASE WHEN NOT is_original THEN CAST(correct AS DOUBLE) END) AS p_iso,
           count(*) FILTER (WHERE is_original) AS n_orig, count(*) FILTER (WHERE NOT is_original) AS n_var
    FROM responses GROUP BY model, item_id),
gaps AS (SELECT *, p_orig - p_iso AS delta FROM items WHERE n_orig > 0 AND n_var > 0)"""
MODELS = ITEMS + """, models AS (
    SELECT model, count(*) AS n_items, avg(p_orig) AS acc_orig, avg(p_iso) AS acc_iso, avg(delta) AS delta,
           CASE WHEN count(*) > 1 THEN stddev_samp(delta) / sqrt(count(*)) ELSE 0 END AS se,
           CASE WHEN count(*) > 1 THEN stddev_pop(delta) / sqrt(count(*)) ELSE 0 END AS se_pop,
           CASE WHEN sum(delta * delta) > 0 THEN sum(delta * delta * delta) / sum(delta * delta) ELSE 0 END AS delta_irt,
           CAST(sum(CASE WHEN delta > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_flagged
    FROM gaps GROUP BY model)"""
BY_GAP = """CASE WHEN abs(delta) <= 0.02 THEN 'ROBUST_REASONER' WHEN delta >= 0.10 THEN 'PURE_MEMORIZER'
    WHEN delta > 0.02 AND delta < 0.10 THEN 'SYNTACTIC_MATCHER' ELSE 'ROBUST_REASONER' END"""
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.item_gaps(responses(spark, sf_dir))


@query("delta_report", with_views("responses", body=MODELS + f"""
    SELECT model, n_items, {r('acc_orig')}, {r('acc_iso')}, {r('delta')}, {r('se')}, {r('se_pop')}, {r('delta_irt')}, n_flagged,
           {r('delta - 1.96 * se', 'ci_low')}, {r('delta + 1.96 * se', 'ci_high')}, {r('n_flagged / n_items', 'flagged_share')}, {BY_GAP} AS archetype
    FROM models"""))  # fmt: skip
def delta_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gaps.model_gaps(_items(spark, sf_dir)))


@query("item_delta", with_views("responses", body=ITEMS + f" SELECT model, item_id, {r('p_orig')}, {r('p_iso')}, n_orig, n_var, {r('delta')} FROM gaps"))
def item_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_items(spark, sf_dir))


@query("item_delta_pooled", with_views("responses", body=f""", c AS (
    SELECT model, item_id, sum(CASE WHEN is_original AND correct THEN 1 ELSE 0 END) AS ro, sum(CASE WHEN is_original THEN 1 ELSE 0 END) AS no,
           sum(CASE WHEN NOT is_original AND correct THEN 1 ELSE 0 END) AS rv, sum(CASE WHEN NOT is_original THEN 1 ELSE 0 END) AS nv
    FROM responses GROUP BY model, item_id HAVING sum(CASE WHEN is_original THEN 1 ELSE 0 END) > 0 AND sum(CASE WHEN NOT is_original THEN 1 ELSE 0 END) > 0)
    SELECT model, count(*) AS n_items, {r('sum(ro) / sum(no)', 'acc_orig')}, {r('sum(rv) / sum(nv)', 'acc_iso')}, {r('sum(ro) / sum(no) - sum(rv) / sum(nv)', 'delta')}
    FROM c GROUP BY model"""))  # fmt: skip
def item_delta_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(gaps.pooled_gaps(gaps.item_counts(responses(spark, sf_dir))))


@query("delta_histogram", with_views("responses", body=ITEMS + """
    SELECT model, CAST(least(floor((delta + 0.5) / 0.075), 19) AS INTEGER) AS bin, count(*) AS n FROM gaps WHERE delta BETWEEN -0.5 AND 1.0 GROUP BY 1, 2"""))
def delta_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.histogram(_items(spark, sf_dir))


@query("gap_shape", with_views("responses", body=ITEMS + f"""
    SELECT model, CAST(sum(CASE WHEN abs(delta) < 0.01 THEN 1 ELSE 0 END) AS BIGINT) AS n_zero, {r('avg(CASE WHEN abs(delta) < 0.1 THEN 1.0 ELSE 0.0 END)', 'share_clean')},
           {r('avg(CASE WHEN delta > 0.8 THEN 1.0 ELSE 0.0 END)', 'share_high')}, {r('avg(CASE WHEN abs(delta) < 0.1 OR delta > 0.8 THEN 1.0 ELSE 0.0 END)', 'bimodal_ratio')}
    FROM gaps GROUP BY model"""))
def gap_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("delta")
    share = lambda c: F.avg(c.cast("double"))
    return rounded(_items(spark, sf_dir).groupBy("model").agg(F.sum((F.abs(d) < 0.01).cast("long")).alias("n_zero"), share(F.abs(d) < 0.1).alias("share_clean"), share(d > 0.8).alias("share_high"), share((F.abs(d) < 0.1) | (d > 0.8)).alias("bimodal_ratio")))


@query("running_accuracy", with_views("attempts", body="""
    SELECT model, event_id, count(*) OVER w AS n_done, CAST(sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER w AS DOUBLE) / count(*) OVER w AS accuracy
    FROM attempts WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""))
def running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gaps.running_accuracy(attempts(spark, sf_dir))


@query("signed_rank_w", with_views("responses", body=ITEMS + f""", d AS (SELECT model, round(delta, 9) AS d FROM gaps),
    t AS (SELECT model, abs(d) AS size, count(*) AS t, sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS pos FROM d GROUP BY 1, 2),
    k AS (SELECT *, sum(t) OVER (PARTITION BY model ORDER BY size) - (t - 1) / 2.0 AS rank FROM t WHERE size > 0),
    s AS (SELECT model, CAST(sum(t) AS DOUBLE) AS n, sum(pos * rank) AS w, sum(CAST(t AS DOUBLE) ^ 3 - t) AS ties FROM k GROUP BY 1),
    a AS (SELECT model, CAST(sum(t) AS BIGINT) AS n_all FROM t GROUP BY 1)
    SELECT model, n_all, CAST(coalesce(n, 0) AS BIGINT) AS n, {r('CAST(coalesce(w, 0) AS DOUBLE)', 'w_plus')},
           {r('(w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)', 'z')}
    FROM a LEFT JOIN s USING (model)"""))  # fmt: skip
def signed_rank_w(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.signed_ranks(_items(spark, sf_dir)))


@query("one_sample_t", with_views("responses", body=ITEMS + f""", s AS (SELECT model, count(*) AS n, avg(delta) AS mean, stddev_pop(delta) / sqrt(count(*)) AS se FROM gaps GROUP BY 1)
    SELECT model, n, {r('mean')}, {r('CASE WHEN se > 0 THEN mean / se ELSE 0 END', 't')}, greatest(1, n - 1) AS df FROM s"""))
def one_sample_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.one_sample_t(_items(spark, sf_dir)))


@query("two_sample_t", f"""WITH v AS (SELECT o_orderstatus = 'O' AS g, log10(abs(o_totalprice) + 1) AS v FROM orders),
    s AS (SELECT count(*) FILTER (WHERE g) AS n1, count(*) FILTER (WHERE NOT g) AS n2, avg(CASE WHEN g THEN v END) AS m1, avg(CASE WHEN NOT g THEN v END) AS m2,
                 var_samp(CASE WHEN g THEN v END) AS v1, var_samp(CASE WHEN NOT g THEN v END) AS v2 FROM v),
    p AS (SELECT *, sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS sd FROM s)
    SELECT n1, n2, {r('m1')}, {r('m2')}, {r('(m1 - m2) / (sd * sqrt(1.0 / n1 + 1.0 / n2))', 't')}, n1 + n2 - 2 AS df, {r('(m1 - m2) / sd', 'cohens_d')} FROM p""")
def two_sample_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "O").alias("g"), answers.magnitude(F.col("o_totalprice")).alias("v"))
    return rounded(significance.two_sample_t(values, "g", "v").drop("p_value"))


ITEM_Z = """, v AS (SELECT model, item_id, is_original, variant_no, sum(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS r, count(*) AS n FROM responses GROUP BY 1, 2, 3, 4),
    i AS (SELECT model, item_id, sum(CASE WHEN is_original THEN r END) AS ro, sum(CASE WHEN is_original THEN n END) AS t, sum(CASE WHEN NOT is_original THEN r END) AS rv,
                 sum(CASE WHEN NOT is_original THEN n END) AS nv, stddev_pop(CASE WHEN NOT is_original THEN r / n END) AS sd, count(*) FILTER (WHERE NOT is_original) AS k FROM v GROUP BY 1, 2),
    e AS (SELECT model, item_id, CAST(ro / t AS DOUBLE) - CAST(rv / nv AS DOUBLE) AS delta, sqrt((ro / t) * (1 - ro / t) / t + sd * sd / k) AS se FROM i WHERE t > 0 AND nv > 0),
    z AS (SELECT *, CASE WHEN se > 0 THEN delta / se ELSE 0 END AS z FROM e)"""


@query("dif_z", with_views("responses", body=ITEM_Z + f" SELECT model, item_id, {r('delta')}, {r('se')}, {r('CASE WHEN se > 1e-9 THEN z ELSE 0 END', 'z')} FROM z"))
def dif_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = significance.item_z(responses(spark, sf_dir))
    return rounded(z.withColumn("z", F.when(F.col("se") > 1e-9, F.col("z")).otherwise(F.lit(0.0))))


@query("global_chi2_stat", with_views("responses", body=ITEM_Z + f" SELECT model, count(*) AS n, {r('sum(CASE WHEN se > 1e-9 THEN greatest(z, 0) ^ 2 ELSE 0 END)', 'chi2')} FROM z GROUP BY model"))
def global_chi2_stat(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = significance.item_z(responses(spark, sf_dir))
    z = z.withColumn("z", F.when(F.col("se") > 1e-9, F.col("z")).otherwise(F.lit(0.0)))
    return rounded(significance.global_test(z).select("model", "n", "chi2"))


@query("spearman_pairs", with_views("responses", body=ITEMS + f""", d AS (SELECT model, item_id, round(delta, 9) AS d FROM gaps),
    p AS (SELECT a.model || '|' || b.model AS pair, a.d AS x, b.d AS y FROM d a JOIN d b ON a.item_id = b.item_id AND a.model < b.model),
    k AS (SELECT pair, rank() OVER (PARTITION BY pair ORDER BY x) + (count(*) OVER (PARTITION BY pair, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY pair ORDER BY y) + (count(*) OVER (PARTITION BY pair, y) - 1) / 2.0 AS ry FROM p)
    SELECT pair, count(*) AS n_items, {r('corr(rx, ry)', 'rho')} FROM k GROUP BY pair"""))
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.spearman_pairs(_items(spark, sf_dir)))


@query("flag_jaccard", with_views("responses", body=ITEMS + f""", f AS (SELECT model, item_id FROM gaps WHERE delta > 0.5), n AS (SELECT model, count(*) AS n FROM f GROUP BY 1),
    b AS (SELECT x.model AS model_a, y.model AS model_b, count(*) AS n_both FROM f x JOIN f y ON x.item_id = y.item_id AND x.model < y.model GROUP BY 1, 2)
    SELECT p.model AS model_a, q.model AS model_b, coalesce(n_both, 0) AS n_both, {r('coalesce(n_both, 0) / (p.n + q.n - coalesce(n_both, 0))', 'jaccard')}
    FROM n p JOIN n q ON p.model < q.model LEFT JOIN b ON b.model_a = p.model AND b.model_b = q.model"""))
def flag_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(significance.flag_overlap(_items(spark, sf_dir)))


@query("wilcoxon_p")
def wilcoxon_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.rank_test(_items(spark, sf_dir))


@query("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.bootstrap_poisson(_items(spark, sf_dir))


@query("rescored_report")
def rescored_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap, interval, p of both tests and three verdicts of each model; p-values have no SQL."""
    return significance.rescored_report(_items(spark, sf_dir))


@query("report_rows")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return significance.report_rows(significance.rescored_report(_items(spark, sf_dir)))


@query("weighted_gap")
def weighted_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps weighted by the discrimination of the items, as fitted on the variants."""
    items = _items(spark, sf_dir)
    return significance.weighted_gap(items, significance.fit_2pl(items.select("model", "item_id", F.col("p_iso").alias("rate")))[1])


@query("irt_2pl")
def irt_2pl(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = gaps.item_gaps(responses(spark, sf_dir)).select("model", "item_id", F.col("p_orig").alias("rate"))
    return significance.fit_2pl(rates)[1]


@query("ability_shift")
def ability_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abilities fitted on originals and on variants, their shift and its test."""
    items = gaps.item_gaps(responses(spark, sf_dir))
    orig = significance.fit_2pl(items.select("model", "item_id", F.col("p_orig").alias("rate")))[0]
    iso = significance.fit_2pl(items.select("model", "item_id", F.col("p_iso").alias("rate")))[0]
    both = orig.withColumnRenamed("theta", "theta_orig").join(iso.withColumnRenamed("theta", "theta_iso"), "model")
    return significance.decompose_ability(both)


@query("contamination_verdicts")
def contamination_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full test: gap, flags, global chi-square and verdict of each model."""
    rows = responses(spark, sf_dir)
    tests = significance.global_test(significance.item_z(rows)).select("model", "chi2", "p_value", F.col("n_flagged").alias("n_dif"), (F.col("n_flagged") / F.col("n")).alias("dif_share"))
    models = gaps.model_gaps(gaps.item_gaps(rows)).select("model", "delta", "delta_irt").join(tests, "model").join(ability_shift(spark, sf_dir).select("model", "shift"), "model")
    verdict = verdicts.full_test(F.col("delta"), F.col("delta_irt"), F.col("shift"), F.col("dif_share"), F.col("p_value"))
    return models.withColumn("verdict", verdict)


GRID = """(SELECT o_orderkey, CAST(o_custkey % 40 - 4 AS DOUBLE) / 100 AS gap, CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 11 AS DOUBLE) / 100 END AS p,
    CAST(o_orderkey % 7 AS DOUBLE) / 10 AS flagged, CAST(80 + o_custkey % 9 AS DOUBLE) / 100 AS acc FROM orders)"""


@query("verdict_grid", f"""SELECT o_orderkey, gap, p, flagged, acc,
    CASE WHEN gap <= 0.02 AND coalesce(p, 1) > 0.05 THEN 'ROBUST_REASONER' WHEN gap >= 0.10 AND flagged >= 0.30 THEN 'PURE_MEMORIZER' WHEN gap >= 0.03 AND gap < 0.10 AND flagged < 0.30 THEN 'SYNTACTIC_MATCHER'
         WHEN gap < 0.05 AND gap >= 0.08 THEN 'SELECTIVE_MEMORIZER' WHEN p < 0.05 THEN 'SYNTACTIC_MATCHER' ELSE 'ROBUST_REASONER' END AS full_test,
    CASE WHEN abs(gap) <= 0.02 AND flagged = 0 THEN 'ROBUST_REASONER' WHEN gap >= 0.10 THEN 'PURE_MEMORIZER' WHEN gap >= 0.03 THEN 'SYNTACTIC_MATCHER' ELSE 'ROBUST_REASONER' END AS with_flags,
    CASE WHEN abs(gap) <= 0.02 THEN 'ROBUST_REASONER' WHEN gap >= 0.10 THEN 'PURE_MEMORIZER' WHEN gap > 0.02 THEN 'SYNTACTIC_MATCHER' ELSE 'ROBUST_REASONER' END AS by_gap,
    CASE WHEN coalesce(p, 1) > 0.05 THEN 'INVARIANT' WHEN gap > 0.3 AND acc > 0.85 THEN 'PURE_MEMORIZER' WHEN gap > 0.15 THEN 'PARTIAL_MEMORIZER' WHEN gap > 0.05 THEN 'MILD_GAP' ELSE 'INVARIANT' END AS rescored,
    CASE WHEN coalesce(p, 1) > 0.05 THEN 'Inv' WHEN gap < 0.15 THEN 'Mild' ELSE 'Mem' END AS tabled,
    CASE WHEN coalesce(p, 1) > 0.05 THEN 'Invariant' WHEN gap < 0.15 THEN 'Mild' WHEN gap <= 0.30 THEN 'Partial' ELSE 'Pure' END AS documented
    FROM {GRID}""")  # fmt: skip
def verdict_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six rule sets over figures of every order, which meet the borders of their rules."""
    hundredth = lambda c: c.cast("double") / 100
    o = table(spark, sf_dir, "orders")
    grid = o.select(
        "o_orderkey", hundredth(F.col("o_custkey") % 40 - 4).alias("gap"), F.when(F.col("o_orderkey") % 11 > 0, hundredth(F.col("o_orderkey") % 11)).alias("p"),
        ((F.col("o_orderkey") % 7).cast("double") / 10).alias("flagged"), hundredth(F.col("o_custkey") % 9 + 80).alias("acc"),
    )
    gap, p, flagged, acc = (F.col(c) for c in ("gap", "p", "flagged", "acc"))
    return grid.select(
        "*", verdicts.full_test(gap, gap, F.lit(0.0), flagged, p).alias("full_test"), verdicts.with_flags(gap, flagged).alias("with_flags"), verdicts.by_gap(gap).alias("by_gap"),
        verdicts.rescored(gap, p, acc).alias("rescored"), verdicts.tabled(gap, p).alias("tabled"), verdicts.documented(gap, p).alias("documented"),
    )


@query("ability_decomposition", with_views("responses", body=ITEMS + f""", m AS (SELECT model, least(0.999, greatest(0.001, avg(p_orig))) AS o, least(0.999, greatest(0.001, avg(p_iso))) AS v FROM gaps GROUP BY 1),
    t AS (SELECT model, ln(o / (1 - o)) AS theta_orig, ln(v / (1 - v)) AS theta_iso FROM m), s AS (SELECT *, theta_orig - theta_iso AS shift, sqrt(0.02) AS se FROM t)
    SELECT model, {r('theta_orig')}, {r('theta_iso')}, {r('shift')}, {r('shift - 1.96 * se', 'ci_low')}, {r('shift + 1.96 * se', 'ci_high')}, {r('shift / se', 'z_stat')}, abs(shift / se) > 2.5758293035489004 AS significant FROM s"""))
def ability_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each model's ability on originals is above that on variants, both as log odds of their accuracies."""
    means = _items(spark, sf_dir).groupBy("model").agg(F.avg("p_orig").alias("o"), F.avg("p_iso").alias("v"))
    abilities = means.select("model", answers.logit(F.col("o"), 0.001).alias("theta_orig"), answers.logit(F.col("v"), 0.001).alias("theta_iso"))
    return rounded(significance.decompose_ability(abilities).drop("p_value"))


def _results(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 3 != odd)
    return o.select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") + odd).cast("double").alias("extracted"), F.col("o_custkey").cast("double").alias("expected"), (F.col("o_orderstatus") == "O").alias("correct"))


RESULTS = """WITH first AS (SELECT o_orderkey AS item_id, CAST(o_custkey AS DOUBLE) AS extracted, CAST(o_custkey AS DOUBLE) AS expected, o_orderstatus = 'O' AS correct FROM orders WHERE o_orderkey % 3 <> 0),
    second AS (SELECT o_orderkey AS item_id, CAST(o_custkey + 1 AS DOUBLE) AS extracted, CAST(o_custkey AS DOUBLE) AS expected, o_orderstatus = 'O' AS correct FROM orders WHERE o_orderkey % 3 <> 1)"""


@query("prefer_newer", RESULTS + " SELECT item_id, CASE WHEN s.item_id IS NULL THEN f.extracted ELSE s.extracted END AS extracted, coalesce(s.expected, f.expected) AS expected, coalesce(s.correct, f.correct) AS correct, s.item_id IS NOT NULL AS is_newer FROM first f FULL JOIN second s USING (item_id)")
def prefer_newer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.prefer_newer(_results(spark, sf_dir, 0), _results(spark, sf_dir, 1), ["item_id"])


@query("resume_anti", """WITH s AS (SELECT o_orderkey AS item_id, t AS trial, o_orderkey || '_t' || t AS key FROM orders, range(3) r(t)),
    d AS (SELECT l_orderkey || '_t' || (l_linenumber - 1) AS key FROM lineitem WHERE l_returnflag = 'R')
    SELECT item_id, CAST(trial AS INTEGER) AS trial, key FROM s WHERE key NOT IN (SELECT key FROM d)""")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = selection.schedule(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), 3)
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.concat(F.col("l_orderkey").cast("string"), F.lit("_t"), (F.col("l_linenumber") - 1).cast("string")).alias("key"))
    return selection.not_done(planned, done, ["key"]).select("item_id", "trial", "key")


@query("clean_semi", RESULTS + " SELECT * FROM first WHERE item_id IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'O')")
def clean_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("item_id"))
    return selection.within(_results(spark, sf_dir, 0), clean, ["item_id"])


@query("source_switch", RESULTS + """, c AS (SELECT o_orderkey AS item_id FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'), g AS (SELECT o_orderkey AS item_id FROM orders WHERE o_orderpriority LIKE '3%'),
    e AS (SELECT o_orderkey AS item_id, CAST(o_custkey + 1 AS DOUBLE) AS now FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT item_id, extracted, expected, correct, 'first' AS origin FROM first WHERE item_id IN (SELECT item_id FROM c)
    UNION ALL SELECT s.item_id, extracted, coalesce(now, expected), CASE WHEN coalesce(now, expected) = 0 THEN abs(extracted) < 0.01 ELSE abs(extracted - coalesce(now, expected)) / greatest(abs(coalesce(now, expected)), 1e-9) < 0.01 END, 'second'
    FROM second s LEFT JOIN e USING (item_id) WHERE s.item_id IN (SELECT item_id FROM g)""")
def source_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    ids = lambda *p: o.filter(F.substring("o_orderpriority", 1, 1).isin(*p)).select(F.col("o_orderkey").alias("item_id"))
    expected = o.filter("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("item_id"), (F.col("o_custkey") + 1).cast("double").alias("expected"))
    return selection.switch_source(_results(spark, sf_dir, 0), _results(spark, sf_dir, 1), ids("1", "2"), ids("3"), expected, answers.matches_audit)


@query("stride_sample", """WITH p AS (SELECT p_partkey AS idx, CAST(p_size AS BIGINT) AS n_nodes, row_number() OVER (ORDER BY p_size, p_partkey) - 1 AS position, greatest(1, count(*) OVER () // 100) AS step FROM part)
    SELECT idx, n_nodes, position FROM p WHERE position % step = 0 AND position < step * 100""")
def stride_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"), F.col("p_size").cast("bigint").alias("n_nodes"))
    return selection.stride_sample(parts, "n_nodes", "idx", 100).select("idx", "n_nodes", "position")


@query("report_lines", with_views("responses", body=MODELS + """
    SELECT model, model || ': n=' || n_items || ' gap=' || CAST(CAST(round(delta * 10000) AS BIGINT) AS VARCHAR) || 'e-4' AS line FROM models"""))
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of text for each model."""
    m = gaps.model_gaps(_items(spark, sf_dir))
    return m.select("model", F.concat("model", F.lit(": n="), F.col("n_items").cast("string"), F.lit(" gap="), F.round(F.col("delta") * 10000).cast("bigint").cast("string"), F.lit("e-4")).alias("line"))


_LINE = """WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_discount * 4 - 0.04, 4) AS gap, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_tax END AS p,
    l_quantity / 100 AS flagged, round(l_discount + 0.02, 4) AS weighted, round(1 - l_tax, 4) AS acc, l_linenumber % 3 AS n_flagged FROM lineitem)"""


@query("verdicts", _LINE + """ SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN gap <= 0.02 AND coalesce(p, 1) > 0.05 THEN 'ROBUST_REASONER' WHEN gap >= 0.10 AND flagged >= 0.30 THEN 'PURE_MEMORIZER' WHEN gap >= 0.03 AND gap < 0.10 AND flagged < 0.30 THEN 'SYNTACTIC_MATCHER'
         WHEN gap < 0.05 AND weighted >= 0.08 THEN 'SELECTIVE_MEMORIZER' WHEN p < 0.05 THEN 'SYNTACTIC_MATCHER' ELSE 'ROBUST_REASONER' END AS full_test,
    CASE WHEN abs(gap) <= 0.02 AND n_flagged = 0 THEN 'ROBUST_REASONER' WHEN gap >= 0.10 THEN 'PURE_MEMORIZER' WHEN gap >= 0.03 THEN 'SYNTACTIC_MATCHER' ELSE 'ROBUST_REASONER' END AS with_flags,
    CASE WHEN coalesce(p, 1) > 0.05 THEN 'INVARIANT' WHEN gap > 0.3 AND acc > 0.85 THEN 'PURE_MEMORIZER' WHEN gap > 0.15 THEN 'PARTIAL_MEMORIZER' WHEN gap > 0.05 THEN 'MILD_GAP' ELSE 'INVARIANT' END AS rescored,
    CASE WHEN coalesce(p, 1) > 0.05 THEN 'Inv' WHEN gap < 0.15 THEN 'Mild' ELSE 'Mem' END AS tabled,
    CASE WHEN coalesce(p, 1) > 0.05 THEN 'Invariant' WHEN gap < 0.15 THEN 'Mild' WHEN gap <= 0.30 THEN 'Partial' ELSE 'Pure' END AS documented
    FROM g""")
def verdicts_of_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule sets over a table, every branch of which occurs."""
    d, tax, n = F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber")
    gap, p, flagged, acc = F.round(d * 4 - 0.04, 4), F.when(n != 7, tax), F.col("l_quantity") / 100, F.round(1 - tax, 4)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdicts.full_test(gap, F.round(d + 0.02, 4), F.lit(0.0), flagged, p).alias("full_test"), verdicts.with_flags(gap, n % 3).alias("with_flags"),
        verdicts.rescored(gap, p, acc).alias("rescored"), verdicts.tabled(gap, p).alias("tabled"), verdicts.documented(gap, p).alias("documented"),
    )


@query("labelled_gaps", with_views("responses", body=MODELS + f"""
    SELECT m.model, coalesce(r_name, m.model) AS label, {r('delta')} FROM models m LEFT JOIN region ON m.model = 'm' || r_regionkey"""))
def labelled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each model under its display name; one without a name keeps its id."""
    names = table(spark, sf_dir, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("model"), "r_name")
    found = gaps.model_gaps(_items(spark, sf_dir)).join(names, "model", "left")
    return rounded(found.select("model", F.coalesce("r_name", "model").alias("label"), "delta"))


@query("seeded_shuffle", "SELECT doc_id, k AS shuffle_key, row_number() OVER (ORDER BY k, doc_id) - 1 AS position FROM (SELECT doc_id, sha256(doc_id || '|42') AS k FROM documents)")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 42).select("doc_id", "shuffle_key", "position")


@query("union_ids", "SELECT o_orderkey AS item_id FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean and regenerated ids, each once."""
    clean = table(spark, sf_dir, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("item_id"))
    return selection.any_of(clean, table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id")))


@query("dataset_totals", "SELECT count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_variants FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)")
def dataset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and variants of a nested dataset: orders with their lines."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.lit("q").alias("question"), F.col("o_totalprice").cast("double").alias("answer"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("parent_id"), F.col("l_linenumber").alias("variant_no"), F.concat_ws("_v", "l_orderkey", "l_linenumber").alias("item_id"),
        F.lit("q").alias("question"), F.col("l_extendedprice").cast("double").alias("answer"),
    )
    return json_files.totals(json_files.nested(lines, o))


@query("flatten_items", """SELECT CAST(o_orderkey AS VARCHAR) AS parent_id, CAST(o_orderkey AS VARCHAR) AS item_id, CAST(o_totalprice AS DOUBLE) AS answer, true AS is_original, CAST(0 AS INTEGER) AS variant_no FROM orders
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_orderkey || '_v' || n, CAST(l_extendedprice AS DOUBLE), false, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY n, l_extendedprice) AS INTEGER)
    FROM (SELECT l_orderkey, l_linenumber AS n, l_extendedprice FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))""")
def flatten_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested items, and back to flat rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("item_id"), F.lit("q").alias("question"), F.col("o_totalprice").cast("double").alias("answer"))
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("parent_id"), F.struct("l_linenumber", "l_extendedprice").alias("variant_no"), F.concat_ws("_v", "l_orderkey", "l_linenumber").alias("item_id"),
        F.lit("q").alias("question"), F.col("l_extendedprice").cast("double").alias("answer"),
    )
    return json_files.flatten(json_files.nested(lines, o)).drop("question")
