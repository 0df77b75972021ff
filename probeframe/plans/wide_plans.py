"""Graphs, filters, roles and round trips over problems of many shapes; small functions over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probeframe.functions import answers, graphs
from probeframe.functions import text as tx
from probeframe.operators import audit, selection, variants
from probeframe.plans._shape import r, rounded
from probeframe.sources.domain import table
from probeframe.sources.wide import SQL, wide_problems

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _by_kind(cases: dict[int, str], other: str = "NULL") -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items()) + f" ELSE {other} END"


#: What the script rules say of each kind: the error of those that fail.
ERRORS = {5: "'forward reference'", 6: "'answer differs'", 8: "'no steps'", 9: "'no answer'", 10: "'too few nodes'", 13: "'answer differs'"}
#: Of those that pass: the answer, the leaves in order, the operations, and the edges on the longest path.
ANSWERS = {0: "x+y+z", 1: "x*y-z", 2: "x+z", 3: "x*1.5+z", 4: "26", 7: "z-x", 11: "x*y", 12: "y-x", 14: "y/2.0"}
LEAVES = {0: "x, y, z", 1: "x, y, z", 2: "x*y, y, z", 3: "x, 1.5, z", 4: "12, 2", 7: "z, x", 11: "x, y, 2*x*y, 2", 12: "x, y", 14: "x, y, 2"}
OPS = {0: "add,add", 1: "multiply,subtract", 2: "divide,add", 3: "multiply,add", 4: "multiply,add", 7: "subtract", 11: "multiply,divide", 12: "multiply,subtract", 14: "multiply,divide"}
DEEP = {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 7: 1, 11: 1, 12: 1, 14: 1}
#: Those whose computed values aren't always whole and not negative.
UNWHOLE = {3: "x % 2 = 0", 7: "false", 14: "y % 2 = 0"}
ACCEPTED = f"kind IN ({', '.join(map(str, ANSWERS))})"
LEAF_LIST = _by_kind({k: f"[{', '.join(f'CAST({v} AS DOUBLE)' for v in leaves.split(', '))}]" for k, leaves in LEAVES.items()})


def wide_graphs_of(spark: SparkSession, sf_dir: str, strict: bool = False) -> DataFrame:
    return wide_problems(spark, sf_dir).select("pid", "kind", "question", "solution", graphs.parse(F.col("solution"), strict).alias("g")).select("pid", "kind", "question", "solution", "g.*")


@query("wide_graphs", SQL + f""" SELECT pid, {ACCEPTED} AS accepted, {_by_kind(ERRORS)} AS error, CAST({_by_kind(ANSWERS)} AS DOUBLE) AS answer, CAST({_by_kind({k: len(LEAVES[k].split(',')) + len(OPS[k].split(',')) for k in LEAVES})} AS INTEGER) AS n_nodes,
    CAST({_by_kind(DEEP)} AS INTEGER) AS depth, {_by_kind({k: f"'{v}'" for k, v in OPS.items()})} AS ops, CASE WHEN {ACCEPTED} THEN {_by_kind(UNWHOLE, 'true')} END AS whole FROM w""")
def wide_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs of all shapes: accepted or why not, answer by execution, size, depth, operations, and whether intermediates are whole and not negative."""
    p = wide_graphs_of(spark, sf_dir)
    when = lambda c: F.when(F.col("accepted"), c)
    steps = F.filter("nodes", lambda n: n["op"] != "assign")
    return p.select(
        "pid", "accepted", "error", when(F.try_element_at("values", F.lit(-1))).alias("answer"), when(F.size("nodes")).alias("n_nodes"), when(F.col("depth")).alias("depth"),
        when(F.array_join(F.transform(steps, lambda n: n["op"]), ",")).alias("ops"), when(graphs.checked(F.col("nodes"), F.col("values"))["ok"]).alias("whole"),
    )


@query("wide_strict", SQL + """ SELECT pid, CASE kind WHEN 5 THEN 'forward reference' WHEN 8 THEN 'no steps' WHEN 9 THEN 'no answer' WHEN 10 THEN 'too few nodes' WHEN 13 THEN 'answer differs' END AS error,
    CASE kind WHEN 6 THEN 'modulo' WHEN 11 THEN 'divide' WHEN 12 THEN 'subtract' END AS last_op FROM w""")
def wide_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict reading: modulo is an operation, and steps whose result is no number are passed over."""
    last = F.try_element_at("nodes", F.lit(-1))["op"]
    return wide_graphs_of(spark, sf_dir, True).select("pid", "error", F.when(F.col("kind").isin(6, 11, 12), last).alias("last_op"))


@query("wide_filters", SQL + """ SELECT pid, CASE WHEN kind IN (5, 6, 8, 9, 10, 13) THEN 'no_graph' WHEN kind = 3 THEN 'fractional_leaf' WHEN kind = 11 OR (kind = 2 AND NOT contains((x*y) || ' ' || y, CAST(z AS VARCHAR))) THEN 'phantom_leaf'
    WHEN kind = 7 THEN 'not_positive' END AS rejected_by FROM w""")
def wide_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first filter that each problem of the wide view fails: no graph, few nodes, a fractional or an absent leaf, no positive answer."""
    p = wide_graphs_of(spark, sf_dir)
    own = variants.leaves(F.col("nodes"))
    rules = {
        "no_graph": ~F.col("accepted"), "few_nodes": F.size("nodes") < 3, "fractional_leaf": F.exists(own, lambda n: n["value"] != F.floor(n["value"])),
        "phantom_leaf": F.exists(own, lambda n: ~F.contains(F.col("question"), answers.number_text(n["value"]))), "not_positive": F.col("answer") <= 0,
    }
    return selection.tagged(p, rules).select("pid", "rejected_by")


@query("wide_roles", SQL + f""", l AS (SELECT pid, kind, x, y, z, unnest({LEAF_LIST}) AS value FROM w WHERE {ACCEPTED})
    SELECT pid, value, CASE WHEN kind = 4 OR (value = 24 AND kind IN (0, 1, 7)) OR (kind = 11 AND value = 2*x*y) OR (kind = 3 AND value = z AND NOT contains('1.5 ' || x, CAST(z AS VARCHAR)))
        OR (kind = 2 AND value = z AND NOT contains((x*y) || ' ' || y, CAST(z AS VARCHAR))) THEN 'CONSTANT' ELSE 'VARIABLE' END AS role FROM l""")
def wide_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each leaf of the wide view may change: constants that the text has, values it lacks, and conversion factors, which protect themselves last."""
    p = wide_graphs_of(spark, sf_dir).filter("accepted")
    return p.select("pid", F.explode(variants.roles(F.col("nodes"), F.col("question"))).alias("x")).select("pid", "x.value", "x.role")


@query("wide_movable", SQL + f" SELECT pid, kind <> 4 AS movable FROM w WHERE {ACCEPTED}")
def wide_movable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a problem has a leaf that may change at all."""
    p = wide_graphs_of(spark, sf_dir).filter("accepted")
    return p.select("pid", F.exists(variants.roles(F.col("nodes"), F.col("question")), lambda x: x["role"] == "VARIABLE").alias("movable"))


_HALF = "CASE WHEN {t} % 2 = 1 THEN ({t}) // 2 || '.5' ELSE CAST(({t}) // 2 AS VARCHAR) END"
STEPS = {
    0: "'<<' || x || '+' || y || '=' || (x+y) || '>> <<' || (x+y) || '+' || z || '=' || (x+y+z) || '>>' || chr(10) || '#### ' || (x+y+z)",
    1: "'<<' || x || '*' || y || '=' || (x*y) || '>> <<' || (x*y) || '-' || z || '=' || (x*y-z) || '>>' || chr(10) || '#### ' || (x*y-z)",
    2: "'<<' || (x*y) || '/' || y || '=' || x || '>> <<' || x || '+' || z || '=' || (x+z) || '>>' || chr(10) || '#### ' || (x+z)",
    3: "'<<' || x || '*1.5=' || " + _HALF.format(t="(3*x)") + " || '>> <<' || " + _HALF.format(t="(3*x)") + " || '+' || z || '=' || " + _HALF.format(t="(3*x+2*z)") + " || '>>' || chr(10) || '#### ' || " + _HALF.format(t="(3*x+2*z)"),
    4: "'<<12*2=24>> <<24+2=26>>' || chr(10) || '#### 26'",
    7: "'<<' || z || '-' || x || '=' || (z-x) || '>>' || chr(10) || '#### ' || (z-x)",
    11: "'<<' || x || '*' || y || '=' || (x*y) || '>> <<' || (2*x*y) || '/2=' || (x*y) || '>>' || chr(10) || '#### ' || (x*y)",
    12: "'<<' || y || '-' || x || '=' || (y-x) || '>>' || chr(10) || '#### ' || (y-x)",  # a step whose value is no number isn't written, so the graph read again lacks it
    14: "'<<' || x || '*' || y || '*2=' || (2*x+2*y) || '>> <<' || y || '/2=' || " + _HALF.format(t="y") + " || '>>' || chr(10) || '#### ' || " + _HALF.format(t="y"),
}


@query("wide_round_trip", SQL + f" SELECT pid, {_by_kind(STEPS)} AS solution, kind <> 12 AS same FROM w WHERE {ACCEPTED}")
def wide_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sound graphs of the wide view written as solutions again: the text, and whether reading it gives the same graph."""
    p = wide_graphs_of(spark, sf_dir).filter("accepted").select("pid", "nodes", F.explode(F.array(graphs.solution_of(F.col("nodes"), F.col("values")))).alias("solution"))
    again = p.select("pid", "nodes", "solution", F.explode(F.array(graphs.parse(F.col("solution")))).alias("again"))
    return again.select("pid", "solution", F.coalesce(F.col("nodes") == F.col("again.nodes"), F.lit(False)).alias("same"))


@query("schema_errors", """SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS gid, count(*) AS n,
    CASE (l_orderkey + l_partkey) % 10 WHEN 0 THEN '' WHEN 1 THEN 'answer node is absent' WHEN 2 THEN 'missing operand' WHEN 3 THEN 'forward reference' WHEN 4 THEN 'repeated id' WHEN 5 THEN 'assign with operands' WHEN 6 THEN 'bad id'
        WHEN 7 THEN 'too few nodes' WHEN 8 THEN 'unknown operation' ELSE 'bad answer id,answer node is absent' END AS errors
    FROM lineitem GROUP BY ALL""")
def schema_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphs in the schema's own form, each with one thing wrong or none, and what the schema says of them."""
    lines = table(spark, sf_dir, "lineitem")
    kind = F.pmod(F.col("l_orderkey") + F.col("l_partkey"), F.lit(10))
    pick = lambda cases, other: F.coalesce(*[F.when(kind == k, v) for k, v in cases.items()], other)
    text = F.lit
    node = lambda i, op, refs: F.struct(i.alias("id"), op.alias("op"), refs.cast("array<string>").alias("refs"), F.col("l_quantity").cast("double").alias("value"))
    none = F.array()
    first = node(pick({6: text("m0")}, text("n0")), text("assign"), none)
    second = node(pick({4: text("n0")}, text("n1")), text("assign"), pick({5: F.array(text("n0"))}, none.cast("array<string>")))
    refs = pick({2: F.array(text("n0"), text("n9")), 3: F.array(text("n0"), text("n2")), 4: F.array(text("n0"), text("n0")), 6: F.array(text("m0"), text("n1"))}, F.array(text("n0"), text("n1")))
    third = node(text("n2"), pick({8: text("guess")}, text("add")), refs)
    nodes = F.when(kind == 7, F.array(first)).otherwise(F.array(first, second, third))
    answer = pick({1: text("n7"), 7: text("n0"), 9: text("last")}, text("n2"))
    gid = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")], F.col("l_quantity").cast("string"))
    # the only element of an array, so that the nodes are made once however often the checks name them
    rows = lines.select(gid.alias("gid"), answer.alias("answer"), F.explode(F.array(nodes)).alias("nodes")).select("gid", F.array_join(graphs.schema_errors(F.col("nodes"), F.col("answer")), ",").alias("errors"))
    return rows.groupBy("gid", "errors").agg(F.count("*").alias("n"))


@query("small_functions", f"""SELECT o_orderkey, {r('1 / (1 + exp(-greatest(-30, least(30, o_totalprice / 50000 - 4))))', 'chance')}, {r('ln((o_custkey % 97 + 1) / (98 - (o_custkey % 97 + 1)))', 'log_odds')},
    CAST('0x' || right(sha256(CAST(o_orderkey AS VARCHAR)), 8) AS BIGINT) AS seed, o_orderstatus IN ('O', 'F') AS same,
    CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE o_custkey % 7 = 0 END AS correct,
    CASE WHEN starts_with(CAST(o_orderkey AS VARCHAR), '1') THEN '77' || substr(CAST(o_orderkey AS VARCHAR), 2) || ' of 15' WHEN contains(CAST(o_orderkey AS VARCHAR), '1')
         THEN substr(CAST(o_orderkey AS VARCHAR), 1, strpos(CAST(o_orderkey AS VARCHAR), '1') - 1) || '77' || substr(CAST(o_orderkey AS VARCHAR), strpos(CAST(o_orderkey AS VARCHAR), '1') + 1) || ' of 15' ELSE o_orderkey || ' of 775' END AS legacy FROM orders""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sigmoid and logit, seeds, categories compared, correctness judged anew, and the early rewrite that hits parts of numbers."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    change = F.array(F.struct(F.lit("1").alias("old"), F.lit("77").alias("new")))
    status = F.col("o_orderstatus")
    want = F.when(F.lower(status).isin("o", "f"), F.concat(F.lit("  "), F.lower(status), F.lit(" "))).otherwise(F.lit("none"))
    share = (F.col("o_custkey") % 97 + 1) / 98
    judged = answers.correct_now(F.when(F.col("o_orderkey") % 2 == 0, F.lit(10.0)).otherwise(F.lit(11.0)), F.lit(10.05), F.col("o_custkey") % 7 == 0, F.col("o_orderkey") % 3 == 0)
    return rounded(o.select(
        "o_orderkey", answers.sigmoid(F.col("o_totalprice").cast("double") / 50000 - 4).alias("chance"), answers.logit(share).alias("log_odds"), tx.seed_of(key).alias("seed"),
        answers.same_category(status, want).alias("same"), judged.alias("correct"), variants.legacy_text(F.concat(key, F.lit(" of 15")), change).alias("legacy"),
    ))


@query("v3_counters", """WITH p AS (SELECT DISTINCT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS pid, CAST(trunc(l_quantity) AS BIGINT) AS a, CAST(p_size AS BIGINT) AS b, CAST(l_linenumber AS BIGINT) AS k FROM lineitem JOIN part ON l_partkey = p_partkey),
    v AS (SELECT pid, v, (a + v) % 4 = 0 AS renamed, (a + b) % 17 = 0 AS absent FROM p, range(3) r(v)),
    m AS (SELECT pid, bool_or(renamed OR absent) OVER (PARTITION BY pid, v) AS bad, bool_or(absent) OVER (PARTITION BY pid, v) AS stays FROM v),
    i AS (SELECT pid, sum(bad::INT) AS n_bad, sum((NOT bad)::INT) AS n_good, sum((NOT stays)::INT) AS n_mended, count(*) AS n FROM m GROUP BY 1),
    s AS (SELECT *, CASE WHEN n_bad = 0 THEN 'intact' WHEN n_good >= 2 THEN 'trimmed' WHEN n_mended >= 2 THEN 'regenerated' ELSE 'quarantined' END AS route FROM i)
    SELECT route, count(*) AS n_items, CAST(sum(CASE route WHEN 'intact' THEN n WHEN 'trimmed' THEN n_good WHEN 'regenerated' THEN n_mended ELSE 0 END) AS BIGINT) AS n_variants FROM s GROUP BY 1""")
def v3_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and kept variants of the cleaned set by what became of them, the quarantined ones among them."""
    from probeframe.plans.item_plans import _named

    return audit.route_counts(audit.routed_items(_named(spark, sf_dir)))
