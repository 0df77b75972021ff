"""Statistics over item gaps.

Rank tests work on counts of equal gaps, not on rows: gaps are ratios of small
counts, so a model has few distinct ones however many items there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeframe.operators.scratch import written

#: Decimals to which gaps count as equal.
TIE_DECIMALS = 9
#: Vectors under this length (zeros counted) get exact sign-flip p-values.
EXACT_BELOW = 13
#: Items up to which a model's interval is resampled item by item, as published.
EXACT_ITEMS = 2000


def tied_ranks(values: DataFrame, by: str, value: str) -> DataFrame:
    """``by, value, n, rank``: distinct values with their count and average rank within ``by``."""
    counts = values.groupBy(by, F.col(value)).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("rank", upto - (F.col("n") - 1) / 2)


def signed_ranks(items: DataFrame) -> DataFrame:
    """Per model: ``n`` nonzero gaps, ``n_all``, ``w_plus``, and the tie-corrected normal ``z`` (no continuity correction)."""
    d = F.round("delta", TIE_DECIMALS)
    counts = items.select("model", d.alias("d")).groupBy("model", F.abs("d").alias("size")).agg(
        F.count("*").alias("t"), F.sum((F.col("d") > 0).cast("long")).alias("pos")
    )
    totals = counts.groupBy("model").agg(F.sum("t").alias("n_all"))
    upto = F.sum("t").over(Window.partitionBy("model").orderBy("size").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.filter("size > 0").withColumn("rank", upto - (F.col("t") - 1) / 2)
    t = F.col("t").cast("double")
    sums = ranked.groupBy("model").agg(F.sum("t").alias("n"), F.sum(F.col("pos") * F.col("rank")).alias("w_plus"), F.sum(t * t * t - t).alias("ties"))
    n = F.col("n").cast("double")
    mean = n * (n + 1) / 4
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    z = F.when(var > 0, (F.col("w_plus") - mean) / F.sqrt(var))
    return totals.join(sums, "model", "left").select(
        "model", "n_all", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), z.alias("z")
    )


def normal_tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to full precision."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))

    return tail(z)


def signed_rank_exact(deltas: list[float]) -> float:
    """One-sided exact p: the share of sign patterns of the nonzero ranks with as high a sum.

    Patterns are counted by sum, one rank after another, over doubled ranks,
    which are whole with ties too: n ranks take n passes over n(n+1) sums and not
    2^n patterns, so several hundred gaps are no trouble.
    """
    sizes = np.sort([abs(d) for d in deltas if d != 0])
    if not len(sizes):
        return 1.0
    values, counts = np.unique(sizes, return_counts=True)
    upto = np.cumsum(counts)
    doubled = dict(zip(values.tolist(), (2 * upto - counts + 1).tolist(), strict=True))
    seen = sum(doubled[abs(d)] for d in deltas if d > 0)
    share = np.zeros(sum(doubled[s] for s in sizes.tolist()) + 1)  # of patterns, by sum
    share[0], top = 1.0, 0
    for rank in (doubled[s] for s in sizes.tolist()):
        share[rank : top + rank + 1] += share[: top + 1].copy()
        top += rank
        share[: top + 1] /= 2
    return float(share[seen:].sum())


def rank_test(items: DataFrame, least: int = 5, exact_below: int = EXACT_BELOW) -> DataFrame:
    """:func:`signed_ranks` with ``p_report`` (null under ``least`` nonzero gaps), ``p_table`` (1 without any) and exact p for short vectors.

    Vectors of ``exact_below`` gaps or more get the normal p, as published; the
    exact p holds for any length up to several hundred.
    """
    ranks = signed_ranks(items).withColumn("p", normal_tail(F.col("z")))
    short = items.join(ranks.filter(F.col("n_all") < exact_below).select("model"), "model")

    def exact(group: pd.DataFrame) -> pd.DataFrame:  # under exact_below rows
        return pd.DataFrame({"model": [group["model"].iloc[0]], "p_exact": [signed_rank_exact(list(group["delta"].round(TIE_DECIMALS)))]})

    found = ranks.join(short.groupBy("model").applyInPandas(exact, "model string, p_exact double"), "model", "left")
    p = F.coalesce("p_exact", "p")
    return found.select("model", "n_all", "n", "w_plus", "z", F.when(F.col("n") >= least, p).alias("p_report"), F.coalesce(F.when(F.col("n") > 0, p), F.lit(1.0)).alias("p_table"))


def bootstrap_exact(deltas: list[float], draws: int = 5000, seed: int = 2026) -> tuple[float, float]:
    """Percentile interval of the mean, resampling the vector in its order; for short vectors (published results come out to the bit)."""
    if not len(deltas):
        return 0.0, 0.0
    rng, x = np.random.default_rng(seed), np.asarray(deltas, float)
    block = max(1, (1 << 22) // len(x))  # draws of one call; a call for several goes on in the same stream
    means = np.concatenate([rng.choice(x, size=(min(block, draws - at), len(x)), replace=True).mean(axis=1) for at in range(0, draws, block)])
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def bootstrap_items(items: DataFrame, draws: int = 5000, seed: int = 2026) -> DataFrame:
    """``model, boot_low, boot_high``: each model's items resampled in their order, as published; a model's items must fit a task."""

    def short(group: pd.DataFrame) -> pd.DataFrame:
        low, high = bootstrap_exact(list(group.sort_values("item_id", kind="stable")["delta"]), draws, seed)
        return pd.DataFrame({"model": [group["model"].iloc[0]], "boot_low": [low], "boot_high": [high]})

    return items.select("model", "item_id", "delta").groupBy("model").applyInPandas(short, "model string, boot_low double, boot_high double")


def bootstrap_poisson(items: DataFrame, draws: int = 5000, seed: int = 2026) -> DataFrame:
    """The same interval by Poisson weights, for any number of items.

    Each distinct gap, which n items share, counts Poisson(n) times in each
    draw, from a generator that model and gap seed; draws are summed by task, so
    none holds a model's items.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights: dict[str, np.ndarray] = {}
        for batch in batches:
            for model, key, d, n in zip(batch["model"], batch["key"], batch["d"], batch["n"], strict=True):
                w = np.random.default_rng([seed, key & (1 << 63) - 1]).poisson(n, draws).astype(float)
                held = weights.setdefault(model, np.zeros((2, draws)))
                held[0] += w
                held[1] += w * d
        for model, (w, s) in weights.items():
            yield pd.DataFrame({"model": model, "draw": np.arange(draws), "w": w, "s": s})

    counts = items.groupBy("model", F.col("delta").alias("d")).agg(F.count("*").alias("n")).withColumn("key", F.xxhash64("model", "d"))
    # few small rows that cost time each: their number of tasks is given, so that they aren't put together in one
    counts = counts.repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    means = counts.mapInPandas(draw, "model string, draw int, w double, s double").groupBy("model", "draw").agg((F.sum("s") / F.sum("w")).alias("mean"))
    return means.groupBy("model").agg(F.percentile("mean", F.lit(0.025)).alias("boot_low"), F.percentile("mean", F.lit(0.975)).alias("boot_high"))


def bootstrap(items: DataFrame, draws: int = 5000, seed: int = 2026, exact_items: int = EXACT_ITEMS) -> DataFrame:
    """:func:`bootstrap_items` for models of at most ``exact_items`` items, so that published intervals come out, :func:`bootstrap_poisson` for all others."""
    counted = written(items.groupBy("model").agg(F.count("*").alias("items")))
    rows = items.join(counted, "model")
    return bootstrap_items(rows.filter(F.col("items") <= exact_items), draws, seed).unionByName(bootstrap_poisson(rows.filter(F.col("items") > exact_items), draws, seed))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def chi2_upper(x: float, df: float) -> float:
    """Upper tail of the chi-square distribution: series or continued fraction of the incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - front * total)
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = 1 / ((num * d + b) or 1e-300)
        c = (b + num / c) or 1e-300
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * h


def _pairwise(function, first: Column, second: Column) -> Column:
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or pd.isna(y) else function(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return apply(first, second)


def t_p(t: Column, df: Column) -> Column:
    return _pairwise(t_two_sided, t, df)


def chi2_p(x: Column, df: Column) -> Column:
    return _pairwise(chi2_upper, x, df)


def one_sample_t(items: DataFrame) -> DataFrame:
    """``t`` of each model's mean gap against zero: the error has n degrees, the test n - 1 (at least one)."""
    d = F.col("delta")
    rows = items.groupBy("model").agg(F.count("*").alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("sd"))
    se = F.col("sd") / F.sqrt("n")
    return rows.select("model", "n", "mean", F.when(se > 0, F.col("mean") / se).otherwise(F.lit(0.0)).alias("t"), F.greatest(F.lit(1), F.col("n") - 1).alias("df"))


def two_sample_t(values: DataFrame, group: str, value: str) -> DataFrame:
    """Pooled two-sample t of ``value`` between the groups true and false, with its two-sided p, their means and Cohen's d; a group under two values gives nulls."""
    g, v = F.col(group), F.col(value)
    side = lambda f, c: f(F.when(c, v))
    r = values.agg(
        F.count(F.when(g, v)).alias("n1"), F.count(F.when(~g, v)).alias("n2"), side(F.avg, g).alias("m1"), side(F.avg, ~g).alias("m2"),
        side(F.var_samp, g).alias("v1"), side(F.var_samp, ~g).alias("v2"),
    )
    df = F.col("n1") + F.col("n2") - 2
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / df)
    diff = F.col("m1") - F.col("m2")
    return r.select("n1", "n2", "m1", "m2", (diff / (pooled * F.sqrt(1 / F.col("n1") + 1 / F.col("n2")))).alias("t"), df.alias("df"), (diff / pooled).alias("cohens_d")).withColumn("p_value", t_p(F.col("t"), F.col("df").cast("double")))


def item_z(responses: DataFrame) -> DataFrame:
    """Per item: gap over its error from trials of the original and spread of variant means; 0 where the error is 0."""
    right = F.coalesce(F.col("correct"), F.lit(False)).cast("double")
    by_variant = responses.groupBy("model", "item_id", "is_original", "variant_no").agg(F.sum(right).alias("r"), F.count("*").alias("n"))
    o = F.col("is_original")
    mean = F.col("r") / F.col("n")
    rows = by_variant.groupBy("model", "item_id").agg(
        F.sum(F.when(o, F.col("r"))).alias("ro"), F.sum(F.when(o, F.col("n"))).alias("t"), F.sum(F.when(~o, F.col("r"))).alias("rv"),
        F.sum(F.when(~o, F.col("n"))).alias("nv"), F.stddev_pop(F.when(~o, mean)).alias("sd"), F.count(F.when(~o, 1)).alias("k"),
    ).filter("t > 0 and nv > 0")
    p = F.col("ro") / F.col("t")
    delta = p - F.col("rv") / F.col("nv")
    se = F.sqrt(p * (1 - p) / F.col("t") + F.col("sd") * F.col("sd") / F.col("k"))
    return rows.select("model", "item_id", delta.alias("delta"), se.alias("se"), F.when(se > 0, delta / se).otherwise(F.lit(0.0)).alias("z"))


def global_test(z: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Per model: flags beyond the Bonferroni bound, and the chi-square of the positive z."""
    positive = F.greatest(F.col("z"), F.lit(0.0))
    n = z.groupBy("model").agg(F.count("*").alias("n"), F.sum(positive * positive).alias("chi2"))

    @F.pandas_udf("double")
    def bound(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: NormalDist().inv_cdf(1 - alpha / (2 * c)))

    bounds = n.select("model", "n", "chi2", bound("n").alias("bound"))
    flags = z.join(bounds.select("model", "bound"), "model").groupBy("model").agg(F.sum((F.col("z") > F.col("bound")).cast("long")).alias("n_flagged"))
    return bounds.join(flags, "model").withColumn("p_value", chi2_p(F.col("chi2"), F.col("n").cast("double")))


def decompose_ability(rows: DataFrame, se_orig: float = 0.1, se_iso: float = 0.1) -> DataFrame:
    """``theta_orig, theta_iso`` to the shift, its interval, z, two-sided p and significance at .01."""
    shift = F.col("theta_orig") - F.col("theta_iso")
    se = math.sqrt(se_orig**2 + se_iso**2)
    z = shift / se if se > 0 else F.lit(0.0)
    p = 2 * normal_tail(F.abs(z))
    return rows.select("*", shift.alias("shift"), (shift - 1.96 * se).alias("ci_low"), (shift + 1.96 * se).alias("ci_high"), z.alias("z_stat"), p.alias("p_value"), (p < 0.01).alias("significant"))


def spearman_pairs(items: DataFrame) -> DataFrame:
    """Rank correlation of gaps for each pair of models, over the items both have."""
    a = items.select("item_id", F.col("model").alias("model_a"), F.round("delta", TIE_DECIMALS).alias("x"))
    b = items.select("item_id", F.col("model").alias("model_b"), F.round("delta", TIE_DECIMALS).alias("y"))
    pairs = a.join(b, "item_id").filter("model_a < model_b").withColumn("pair", F.concat_ws("|", "model_a", "model_b"))
    rx = tied_ranks(pairs, "pair", "x").select("pair", "x", F.col("rank").alias("rx"))
    ry = tied_ranks(pairs, "pair", "y").select("pair", "y", F.col("rank").alias("ry"))
    both = pairs.groupBy("pair", "x", "y").agg(F.count("*").alias("n")).join(rx, ["pair", "x"]).join(ry, ["pair", "y"])
    n, x, y = F.col("n"), F.col("rx"), F.col("ry")
    s = both.groupBy("pair").agg(F.sum(n).alias("n"), F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"), F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")
    vx, vy = F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n"), F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    return s.select("pair", F.col("n").alias("n_items"), (cov / F.sqrt(vx * vy)).alias("rho"))


def flag_overlap(items: DataFrame, flag: float = 0.5) -> DataFrame:
    """Jaccard overlap of the flagged items of each pair of models; by counts, no sets are gathered."""
    flagged = items.filter(F.col("delta") > flag).select("model", "item_id")
    sizes = flagged.groupBy("model").agg(F.count("*").alias("n"))
    a = flagged.select("item_id", F.col("model").alias("model_a"))
    b = flagged.select("item_id", F.col("model").alias("model_b"))
    common = a.join(b, "item_id").filter("model_a < model_b").groupBy("model_a", "model_b").agg(F.count("*").alias("both"))
    pairs = sizes.select(F.col("model").alias("model_a"), F.col("n").alias("na")).join(sizes.select(F.col("model").alias("model_b"), F.col("n").alias("nb")), F.col("model_a") < F.col("model_b"))
    both = F.coalesce(F.col("both"), F.lit(0))
    return pairs.join(common, ["model_a", "model_b"], "left").select("model_a", "model_b", both.alias("n_both"), (both / (F.col("na") + F.col("nb") - both)).alias("jaccard"))


#: Newton steps of an item's two parameters in a round; models whose abilities may go to the tasks as one array; distinct items that are worth a task; items of an array.
ITEM_STEPS, MOST_MODELS, ITEMS_OF_TASK, ITEMS_AT_ONCE = 30, 1_000_000, 1000, 2048


def _item_batch(theta: np.ndarray, sizes: np.ndarray, j: np.ndarray, y: np.ndarray, ridge: float) -> tuple[np.ndarray, ...]:
    """Log discriminations and difficulties of a batch of items, given the abilities, and each rate's part of its ability's first and second derivative.

    ``sizes`` are the items' numbers of rates, ``j`` and ``y`` all rates' models and values, item by item.
    """
    n = sizes
    of = np.repeat(np.arange(len(n)), n)
    total = lambda x: np.bincount(of, x, minlength=len(n))
    mean = np.clip(total(y) / n, 0.05, 0.95)
    la, b = np.zeros(len(n)), -np.log(mean / (1 - mean))

    def at() -> tuple[np.ndarray, ...]:
        a, gap = np.exp(la)[of], theta[j] - b[of]
        p = 1 / (1 + np.exp(-np.clip(a * gap, -30, 30)))
        return a, gap, y - p, p * (1 - p)

    for _ in range(ITEM_STEPS):
        a, gap, e, w = at()
        g_b, g_l = total(-a * e) - 2 * ridge * b, total(a * gap * e) - 2 * ridge * la
        h_b, h_l, h = total(a * a * w) + 2 * ridge, total(a * a * gap * gap * w) + 2 * ridge, -total(a * a * gap * w)
        det = np.maximum(h_b * h_l - h * h, 1e-9)
        b = b + np.clip((h_l * g_b - h * g_l) / det, -1, 1)
        la = np.clip(la + np.clip((h_b * g_l - h * g_b) / det, -0.5, 0.5), -2, 2)
    a, _, e, w = at()
    return la, b, a * e, a * a * w


def _item_arrays(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """Of some items at a time the numbers of rates, all rates' models and values, and the columns ``more``."""
    for batch in batches:
        for start in range(0, batch.num_rows, ITEMS_AT_ONCE):
            part = batch.slice(start, ITEMS_AT_ONCE)
            j, y = part.column("j"), part.column("rate")
            yield j.value_lengths().to_numpy(), j.flatten().to_numpy().astype(int), y.flatten().to_numpy(zero_copy_only=False), *[part.column(c) for c in more]


def fit_2pl(rates: DataFrame, rounds: int = 60, ridge: float = 0.01, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """Two-parameter item response fit of ``model, item_id, rate``: abilities ``model, theta`` and items ``item_id, a, b``.

    A round is one job: tasks fit their items to the present abilities and sum
    the abilities' derivatives, which give the next ones.  Items with the same
    rates of the same models have the same fit, so a round fits each such set of
    rates once and counts it as often as it occurs; rates are shares of few
    answers, so there are far fewer of them than items.  An item's row holds
    its models' rates, so items, of which there are many, never meet; abilities
    are one array (:data:`MOST_MODELS` at most, or ValueError).  Rates, not only
    0 and 1, are allowed, equal rows count as often as they occur; log a is held
    within 2 and abilities are centred at the end.  Shift and scale of the
    whole, which only the penalty knows, are set in each round (:func:`_gauge`).
    It ends when no ability moves by ``tolerance`` in a round, or after ``rounds``.
    """
    spark = rates.sparkSession
    rates = written(rates.select("model", "item_id", F.col("rate").cast("double").alias("rate")))
    found = rates.groupBy("model").agg(F.avg("rate").alias("m")).orderBy("model").limit(MOST_MODELS + 1).collect()
    if len(found) > MOST_MODELS:
        raise ValueError("too many models")
    names = [r["model"] for r in found]
    place = spark.createDataFrame([(m, i) for i, m in enumerate(names)], f"model {rates.schema['model'].dataType.simpleString()}, j int")
    rows = rates.join(F.broadcast(place), "model").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("j", "rate"))).alias("r"))
    rows = written(rows.select("item_id", F.col("r.j").alias("j"), F.col("r.rate").alias("rate")))
    kinds = written(rows.groupBy("j", "rate").agg(F.count("*").alias("n")))
    # fits cost time by the item, not by the byte: small rows are dealt out again
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kinds.count() // ITEMS_OF_TASK))
    kinds = written(kinds.repartition(max(1, tasks)))
    means = [min(0.95, max(0.05, r["m"])) for r in found]
    theta = np.array([math.log(m / (1 - m)) for m in means])

    def derivatives(theta: np.ndarray) -> pd.DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, h, sums = np.zeros(len(theta)), np.zeros(len(theta)), np.zeros(4)
            for sizes, j, y, n in _item_arrays(batches, "n"):
                n = n.to_numpy()
                la, b, gb, hb = _item_batch(theta, sizes, j, y, ridge)
                of = np.repeat(n, sizes)
                g, h = g + np.bincount(j, of * gb, minlength=len(theta)), h + np.bincount(j, of * hb, minlength=len(theta))
                sums = sums + [n.sum(), (n * b).sum(), (n * b * b).sum(), (n * la).sum()]
            yield pa.RecordBatch.from_pydict({"j": np.arange(-4, len(theta), dtype=np.int32), "g": np.concatenate([sums, g]), "h": np.concatenate([np.zeros(4), h])})

        found = kinds.mapInArrow(run, "j int, g double, h double")
        return found.groupBy("j").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas().sort_values("j")  # a row for each model

    for _ in range(rounds if names else 0):
        d = derivatives(theta)
        sums, g, h = d["g"].to_numpy()[:4], d["g"].to_numpy()[4:], d["h"].to_numpy()[4:]
        step = np.clip((g - 2 * ridge * theta) / (h + 2 * ridge), -1, 1)
        shift, scale = _gauge(theta + step, *sums)
        theta = (theta + step + shift) * scale
        if np.abs(step).max() + abs(shift) + abs(math.log(scale)) < tolerance:
            break

    kind = T.StructType([rates.schema["item_id"], T.StructField("a", T.DoubleType()), T.StructField("b", T.DoubleType())])

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sizes, j, y, ids in _item_arrays(batches, "item_id"):
            la, b, _, _ = _item_batch(theta, sizes, j, y, ridge)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.exp(la)), pa.array(b)], ["item_id", "a", "b"])

    centred = spark.createDataFrame([(m, float(t - theta.mean())) for m, t in zip(names, theta, strict=True)], f"model {place.schema['model'].dataType.simpleString()}, theta double")
    return centred, rows.mapInArrow(items, kind)


def _gauge(theta: np.ndarray, n: float, sum_b: float, sum_bb: float, sum_la: float) -> tuple[float, float]:
    """The shift of all abilities and difficulties, and their scale against the discriminations, with the least penalty."""
    shift = -(theta.sum() + sum_b) / (len(theta) + n)
    squares = ((theta + shift) ** 2).sum() + sum_bb + 2 * shift * sum_b + n * shift * shift
    u = 0.0
    for _ in range(30):
        grown = squares * math.exp(2 * u)
        u -= max(-0.5, min(0.5, (grown - sum_la + n * u) / (2 * grown + n)))
    return shift, math.exp(u)


def weighted_gap(items: DataFrame, fitted: DataFrame) -> DataFrame:
    """``model, delta_raw, delta_weighted``: the mean gap, and that of gaps times the item's discrimination ``a``."""
    return items.join(fitted.select("item_id", "a"), "item_id").groupBy("model").agg(F.avg("delta").alias("delta_raw"), F.avg(F.col("a") * F.col("delta")).alias("delta_weighted"))


def gap_tests(items: DataFrame) -> DataFrame:
    """``model, n, mean, t, df, t_p``: :func:`one_sample_t` with its two-sided p."""
    t = one_sample_t(items)
    return t.withColumn("t_p", t_p(F.col("t"), F.col("df").cast("double")))


def rescored_report(items: DataFrame) -> DataFrame:
    """A row for each model: accuracies, gap, resampled interval, rank-test and t-test p, and the verdicts of the three rule sets that need a p."""
    from probeframe.functions import verdicts
    from probeframe.operators.gaps import model_gaps

    base = model_gaps(items).select("model", "n_items", "acc_orig", "acc_iso", "delta", "se_pop", "n_flagged")
    ranks = rank_test(items).select("model", F.col("p_table").alias("rank_p"), "p_report")
    rows = base.join(bootstrap(items), "model").join(ranks, "model").join(gap_tests(items).select("model", "t", "df", "t_p"), "model")
    delta, p = F.col("delta"), F.col("rank_p")
    return rows.withColumn("rescored", verdicts.rescored(delta, F.col("t_p"), F.col("acc_orig"))).withColumn("tabled", verdicts.tabled(delta, p)).withColumn("documented", verdicts.documented(delta, p))


def report_rows(report: DataFrame) -> DataFrame:
    """``model, line, latex``: each row of :func:`rescored_report` as text and as a table row; a p under .001 is shown as such."""
    percent = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    p = F.when(F.col("rank_p") < 0.001, "p<0.001").otherwise(F.format_string("p=%.3f", F.col("rank_p")))
    interval = F.format_string("[%+.3f, %+.3f]", "boot_low", "boot_high")
    gap = F.format_string("%+.3f", "delta")
    line = F.concat_ws("  ", "model", percent("acc_orig"), percent("acc_iso"), gap, interval, p, "tabled")
    escaped = lambda c: F.replace(F.replace(c, F.lit("_"), F.lit("\\_")), F.lit("%"), F.lit("\\%"))
    row = F.concat_ws(" & ", escaped(F.col("model")), escaped(percent("acc_orig")), escaped(percent("acc_iso")), gap, interval, F.replace(F.replace(p, F.lit("p<"), F.lit("$<$")), F.lit("p="), F.lit("")), "tabled")
    return report.select("model", line.alias("line"), F.concat(row, F.lit(" \\\\")).alias("latex"))
