"""Graphs of annotated steps against a plain reading of the same rules, over all operators."""

from __future__ import annotations

import hashlib
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from probeframe.functions import extensions, graph_parser, graphs, leaf_roles
from probeframe.functions import text as tx
from probeframe.operators import draws, graph_tables, variants
from probeframe.plans import io_plans, wide_plans
from probeframe.sources import domain

SIGNS = {"+": "add", "-": "subtract", "*": "multiply", "/": "divide"}


def value(op, args):
    if op == "add":
        return sum(args)
    if op == "subtract":
        return args[0] - sum(args[1:])
    if op == "multiply":
        out = 1.0
        for a in args:
            out *= a
        return out
    if op == "divide":
        return float("inf") if args[1] == 0 else args[0] / args[1]
    return 0.0


def kind(expr):
    signs = re.findall(r"[-+*/%]", expr)
    if not signs:
        return None
    if set(signs) <= {"+", "-"}:
        return "subtract" if signs.count("-") >= signs.count("+") else "add"
    return "multiply" if "*" in signs else "divide" if "/" in signs else "add"


def read(solution):
    steps = [(e, float(r)) for e, r in re.findall(r"<<([^>]+?)=([^>]+?)>>", solution)]
    literals = list(dict.fromkeys(float(t) for e, _ in steps for t in re.findall(r"\d+(?:\.\d+)?", e)))
    nodes = [("assign", [], v) for v in literals]
    newest = {v: i for i, v in enumerate(literals)}
    for expr, result in steps:
        if kind(expr):
            nodes.append((kind(expr), [newest[float(t)] for t in re.findall(r"\d+(?:\.\d+)?", expr)], result))
            newest[result] = len(nodes) - 1
    first = {}
    for i, (op, _, v) in enumerate(nodes):
        if op != "assign":
            first.setdefault(v, i)
    target = [first[v] if op == "assign" and v in first else i for i, (op, _, v) in enumerate(nodes)]
    kept = [i for i in range(len(nodes)) if target[i] == i]
    return [(nodes[i][0], [kept.index(target[r]) for r in nodes[i][1]], nodes[i][2]) for i in kept]


def run(nodes):
    done = []
    for op, refs, v in nodes:
        done.append(v if op == "assign" else value(op, [done[r] for r in refs]))
    return done


def made(seed):
    rng = random.Random(seed)
    show = lambda x: str(int(x)) if x == int(x) else str(round(x, 4))
    known, steps, last = [round(rng.choice([rng.randint(2, 60), rng.randint(2, 60) / 4]), 2) for _ in range(3)], [], 0.0
    for _ in range(rng.randint(1, 5)):
        sign = rng.choice("+-*/")
        args = [rng.choice(known) for _ in range(rng.choice([2, 2, 3]) if sign in "+-*" else 2)]
        got = round(value(SIGNS[sign], args), 4)
        if not 0 < got < 1e7:
            continue
        last = got
        steps.append(f"so <<{sign.join(map(show, args))}={show(got)}>>")
        known.append(got)
    return " ".join(steps) + f"\n#### {show(last)}"


def test_parse_against_plain_reading(spark):
    solutions = [s for s in (made(i) for i in range(300)) if "<<" in s]
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(solutions)], "i int, s string").select("i", F.explode(F.array(graphs.parse(F.col("s")))).alias("g"))
    n = F.col("g.nodes")
    rows = frame.select("i", n.alias("nodes"), "g.accepted", "g.error", graphs.values(n).alias("done"), graphs.depth(n).alias("depth")).collect()
    accepted = 0
    for r in rows:
        want = read(solutions[r["i"]])
        assert [(x["op"], list(x["refs"]), x["value"]) for x in r["nodes"]] == want, solutions[r["i"]]
        ahead = any(ref >= i for i, (_, refs, _) in enumerate(want) for ref in refs)
        if ahead or len(want) < 2:
            assert not r["accepted"]
            continue
        done = run(want)
        assert r["done"] == pytest.approx(done, rel=1e-9)
        answer = float(solutions[r["i"]].split("#### ")[1])
        assert r["accepted"] == (abs(done[-1] - answer) <= 0.01)
        accepted += r["accepted"]
        deep = []
        for _, refs, _ in want:
            deep.append(1 + max(deep[x] for x in refs) if refs else 0)
        assert r["depth"] == max(deep)
    assert accepted > 100


def test_modulo_unknown_signs_and_nan(spark):
    texts = ["<<17%5=2>>\n#### 2", "no steps\n#### 3", "<<5=5>> <<5+1=6>>\n#### 6", "<<1+1=2>>", "<<4*5=a/b>>\n#### 20", None]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(graphs.parse(F.col("s"), True).alias("g")).select("g.accepted", "g.error").collect()
    assert [r["accepted"] for r in got][:2] == [True, False] and got[1]["error"] == "no steps" and got[3]["error"] == "no answer"
    lenient = spark.createDataFrame([(t,) for t in texts], "s string").select(graphs.parse(F.col("s")).alias("g")).select("g.accepted").collect()
    assert [r[0] for r in lenient] == [False, False, True, False, True, False]  # without modulo 17+5 differs from 2; a NaN result is not executed


def test_topological_order(spark):
    node = lambda op, refs: {"op": op, "refs": refs, "value": 1.0, "dc": 1}
    nodes = [node("add", [11, 2]), node("assign", []), node("assign", [])] + [node("assign", []) for _ in range(8)] + [node("add", [1])]
    order = spark.createDataFrame([(nodes,)], f"n {graphs.NODES}").select(graphs.topological_order(F.col("n"))).first()[0]
    needs = {f"n{i}": [f"n{r}" for r in n["refs"]] for i, n in enumerate(nodes)}
    want = []
    while len(want) < len(nodes):
        want.append(min(k for k, v in needs.items() if k not in want and all(x in want for x in v)))
    assert order == want and order.index("n10") < order.index("n2")


def test_leaf_filters_and_checks(spark):
    question = "A box has 12.5 kg and 40 pens; 7 go every day. How many?"
    solution = "<<12.5*40=500>> <<500-9=491>>\n#### 491"
    row = spark.createDataFrame([(question, solution)], "q string, s string").select("q", graphs.parse(F.col("s")).alias("g")).select("q", "g.nodes").first()
    values = [n["value"] for n in row["nodes"] if n["op"] == "assign"]
    assert values == [12.5, 40.0, 9.0] and [v for v in values if v != int(v)] == [12.5]  # fractional leaf
    own = variants.leaves(F.col("nodes"))
    frame = spark.createDataFrame([row])
    found = frame.select(F.transform(own, lambda n: F.contains(F.col("q"), F.regexp_replace(n["value"].cast("string"), r"\.0$", "")))).first()[0]
    assert found == [True, True, False]  # nine stands nowhere: a phantom leaf


def test_variants_are_sound(spark):
    rows = [(str(i), f"Tom has {a} boxes of {b} pens and gives away {c}. How many are left?", f"<<{a}*{b}={a * b}>> <<{a * b}-{c}={a * b - c}>>\n#### {a * b - c}", a * b - c) for i, (a, b, c) in enumerate([(15, 23, 17), (8, 31, 9), (125, 6, 88), (3, 14, 4444)])]
    frame = spark.createDataFrame(rows, "pid string, question string, solution string, answer long").withColumn("g", F.explode(F.array(graphs.parse(F.col("solution"))))).filter("g.accepted")
    made = variants.mutate(frame.select("pid", "question", "g.nodes", "g.answer"), variants=3, attempts=20).collect()
    by = {r[0]: r for r in rows}
    assert {r["pid"] for r in made} >= {"0", "1", "2"} and len({(r["pid"], r["variant_question"]) for r in made}) == len(made)
    for r in made:
        old = by[r["pid"]]
        leaves = [n["value"] for n in r["nodes"] if n["op"] == "assign"]
        shown = [float(x) for x in re.findall(r"\d+", r["variant_question"])]
        assert sorted(leaves) == sorted(shown) and "Tom" not in r["variant_question"].split() and r["variant_question"] != old[1]
        assert shown[0] * shown[1] - shown[2] == r["answer"] >= 0 and 1 / 3 <= abs(r["answer"] / old[3]) <= 3
        for new, was in zip(shown, (float(x) for x in re.findall(r"\d+", old[1])), strict=True):
            assert len(str(int(new))) == len(str(int(was)))
    again = variants.mutate(frame.select("pid", "question", "g.nodes", "g.answer"), variants=3, attempts=20).collect()
    assert sorted(json.dumps(r.asDict(True), sort_keys=True) for r in made) == sorted(json.dumps(r.asDict(True), sort_keys=True) for r in again)
    first = next(r for r in made if r["pid"] == "0")
    both = spark.createDataFrame([(frame.filter("pid = '0'").select("g.nodes").first()[0], first["nodes"], first["variant_question"])], f"a {graphs.NODES}, b {graphs.NODES}, t string").withColumn("x", F.lit(first["answer"]))
    checks = both.select(graphs.isomorphism_checks(F.col("a"), F.col("b"), F.col("t"), F.col("x")).alias("c")).first()["c"]
    assert checks["topology"] and checks["op_types"] and checks["numbers_present"] and checks["answer_consistent"] and checks["novel_surface"]
    broken = both.select(graphs.isomorphism_checks(F.col("a"), F.col("b"), F.lit("no numbers"), F.col("x") + 1).alias("c")).first()["c"]
    assert not broken["numbers_present"] and not broken["answer_consistent"]


def test_regeneration_and_first_generator(spark):
    texts = [
        ("free", "Tom has 15 boxes of 23 pens and gives away 17. How many?", "<<15*23=345>> <<345-17=328>>\n#### 328"),
        ("phantom", "Tom has 15 boxes and gives away 17. How many?", "<<15*23=345>> <<345-17=328>>\n#### 328"),
        ("stuck", "Tom has 12 eggs and 12 more, 12 each. How many?", "<<12+12=24>>\n#### 24"),
    ]
    p = spark.createDataFrame(texts, "pid string, question string, solution string").withColumn("g", F.explode(F.array(graphs.parse(F.col("solution"))))).filter("g.accepted")
    p = p.select("pid", "question", "g.nodes", "g.answer")
    status, made = variants.regenerate(p)
    got = {r["pid"]: (r["status"], r["n_variants"]) for r in status.collect()}
    assert got["free"][0] == "regenerated" and got["free"][1] >= 3 and got["phantom"][0] == "phantom_leaf" and got["stuck"] == ("no_variable_leaf", 0)
    assert {r["pid"] for r in made.collect()} == {"free"}
    first = {r["pid"]: r for r in variants.mutate(p, 1, 20, every_leaf=True).collect()}
    leaves = [n["value"] for n in first["free"]["nodes"] if n["op"] == "assign"]
    assert all(10 <= v <= 99 and v not in (15, 23, 17) for v in leaves) and leaves[0] * leaves[1] - leaves[2] == first["free"]["answer"]


def test_graphs_as_tables(spark):
    rng = random.Random(8)
    rows = []
    for g in range(25):
        n = rng.randint(1, 14)
        nodes = [{"op": "add", "refs": [], "value": 1.0, "dc": 1} for _ in range(n)]
        place = list(range(n))
        rng.shuffle(place)  # definition order isn't dependency order
        for i in range(1, n):
            nodes[place[i]]["refs"] = [place[rng.randrange(i)] for _ in range(rng.choice([0, 1, 2, 3]))]
        rows.append((g, nodes))
    rows += [(90, [{"op": "add", "refs": [1], "value": 1.0, "dc": 1}, {"op": "add", "refs": [0], "value": 1.0, "dc": 1}, {"op": "assign", "refs": [], "value": 1.0, "dc": 1}, {"op": "add", "refs": [0, 2, 9], "value": 1.0, "dc": 1}]), (91, [])]
    arrays = spark.createDataFrame(rows, f"graph int, nodes {graphs.NODES}")
    nodes, edges = graph_tables.tables_of(arrays)
    want = {r["graph"]: r for r in arrays.select("graph", graphs.topological_order(F.col("nodes")).alias("order"), graphs.edges(F.col("nodes")).alias("edges"), F.size("nodes").alias("n")).collect()}
    order = {}
    for r in graph_tables.orders(nodes, edges).collect():
        order.setdefault(r["graph"], []).append((r["position"], r["node"]))
    levels = {(r["graph"], r["node"]): r["level"] for r in graph_tables.levels(nodes, edges).collect()}
    deep = {r["graph"]: r["depth"] for r in graph_tables.depths(graph_tables.levels(nodes, edges)).collect()}
    signed = {r["graph"]: r for r in graph_tables.signatures(nodes, edges).collect()}
    for g, made in rows[:25]:
        assert [n for _, n in sorted(order[g])] == list(want[g]["order"])
        level = {}
        for name in want[g]["order"]:
            level[name] = max((level[f"n{r}"] + 1 for r in made[int(name[1:])]["refs"]), default=0)
        assert {n: levels[g, n] for n in level} == level and deep[g] == max(level.values())
        assert signed[g]["n_nodes"] == want[g]["n"] and signed[g]["n_edges"] == len(want[g]["edges"])
    same = {}
    for g, _ in rows[:25]:
        same.setdefault((want[g]["n"], str(want[g]["edges"])), set()).add(signed[g]["topology"])
    assert all(len(s) == 1 for s in same.values()) and len({next(iter(s)) for s in same.values()}) == len(same)
    assert {n for g, n in levels if g == 90} == {"n2"} and [n for _, n in order[90]] == ["n2"] and 91 not in order


def test_sql_functions(spark):
    texts = [(str(i), f"Tom has {a} boxes of {b} pens and gives away {c}. How many are left?", f"<<{a}*{b}={a * b}>> <<{a * b}-{c}={a * b - c}>>\n#### {a * b - c}") for i, (a, b, c) in enumerate([(15, 23, 17), (8, 31, 9), (125, 6, 88), (3, 14, 4444)])]
    spark.createDataFrame([*texts, ("n", None, None)], "pid string, question string, solution string").createOrReplaceTempView("texts")
    extensions.register(spark, {"none": lambda solutions: extensions.PARSERS["script"](solutions.filter(pa.array([False] * len(solutions))).cast(pa.string())) if not len(solutions) else extensions.PARSERS["script"](pa.nulls(len(solutions), pa.string()))})
    rows = spark.sql("SELECT pid, question, g.nodes, g.answer, g.accepted, parse_none(solution).error AS other FROM (SELECT *, parse_script(solution) AS g FROM texts)")
    assert {r["other"] for r in rows.collect()} == {"no answer"} and rows.filter("accepted").count() == 4
    found = rows.filter("accepted").select("pid", "question", "nodes", "answer")
    variants.drawable(found).createOrReplaceTempView("drawable")
    got = spark.sql("SELECT d.pid, v.k, v.attempt, v.answer FROM drawable d, LATERAL draw_variants(d.pid, d.nodes, d.free, d.answer, 3, 20) v").collect()
    want = variants.mutate(found, variants=3, attempts=20).select("pid", "k", "attempt", "answer").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 6
    assert spark.sql("SELECT * FROM draw_variants(CAST(NULL AS STRING), NULL, NULL, 1.0D, 3, 20)").count() == 0


def test_draws_are_from_all_that_is_allowed():
    for value, used in ((5.0, {7}), (1.0, set()), (9.0, {2, 3, 4, 5, 6}), (37.0, {11, 99}), (-480.0, {100, 999}), (12.0, set()), (8.0, {2, 3, 5, 6})):
        size, away = int(abs(value)), max(1, int(abs(value) * 0.2))
        d = len(str(size))
        low, high = (2, 9) if d == 1 else (10 ** (d - 1), 10**d - 1)
        allowed = {c for c in range(low, high + 1) if c not in used and abs(c - size) >= away and c not in tx.KNOWN_CONSTANTS}
        rng = random.Random(7)
        got = {variants.draw_like(value, used, rng) for _ in range(12000 if d == 3 else 2000)}
        assert got == ({(-c if value < 0 else c) for c in allowed} or {None})


def test_first_generator_may_repeat_a_leaf_only_in_a_retry():
    ops, refs = ["assign", "assign", "subtract"], [[], [], [0, 1]]
    first = [variants.redrawn(ops, refs, [5.0, 7.0, -2.0], f"s{i}", 30) for i in range(300)]
    assert all(v[1][0] != 5 and v[1][1] != 7 for v in first if v[0] == 0) and any(v[1][0] == 5 or v[1][1] == 7 for v in first if v[0] > 0)
    assert all(v[2] == v[1][0] - v[1][1] >= 0 and all(2 <= x <= 9 for x in v[1][:2]) for v in first)


def test_shapes_are_read_as_arrays_like_single_texts():
    rng = random.Random(3)
    forms = ["<<{}+{}={}>> <<{}*{}={}>>\n#### {}", "<<{}/{}=-{}>> <<{}%{}={}/{}>>\n#### -{}", "<<{}-{}=many>> <<{}-{}-{}={}>>\n#### {}", "<<{}={}>>\n#### {}.", "é {} <<{}+{}={}>>", "<<{}*{}={},{}>>\n####{}\n"]
    texts = [re.sub(r"\{\}", lambda _: rng.choice(["0", "1", "2", "2.5", "7", "12"]), form) for form in forms for _ in range(60)]
    rng.shuffle(texts)
    for strict in (False, True):
        single = [graph_parser.parse_batch(pa.array([t]), strict)[0].as_py() for t in texts]
        assert repr(graph_parser.parse_batch(pa.array(texts), strict).to_pylist()) == repr(single)


def test_texts_of_one_shape_are_walked_once(monkeypatch):
    walked = []
    own = graph_parser.linked
    monkeypatch.setattr(graph_parser, "linked", lambda steps: walked.append(1) or own(steps))
    graph_parser.shape_graph.cache_clear()
    texts = [f"<<{a}+{b}={a + b}>>\n#### {a + b}" for a in range(100, 120) for b in range(300, 350)]
    assert all(r["accepted"] for r in graph_parser.parse_batch(pa.array(texts), False).to_pylist()) and len(walked) < 5


def test_solutions_from_known_values(spark):
    texts = ["<<12.5*40=500>> <<500-9=491>>\n#### 491", "<<2-7=-5>> <<3-7=-4>>\n#### -4", "<<7/2=3.5>> <<3.5+2=5.5>> <<5.5+5.5=11>>\n#### 11"]
    g = spark.createDataFrame([(t,) for t in texts], "s string").select(F.explode(F.array(graphs.parse(F.col("s")))).alias("g"))
    got = g.select(graphs.solution_of(F.col("g.nodes"), F.col("g.values")), graphs.solution_of(F.col("g.nodes"))).collect()
    assert [r[0] for r in got] == texts and [r[1] for r in got] == texts


def test_nodes_of_the_schema_are_made_once(spark, tmp_path):
    lines = [(i, i % 3 + 1, i * 7, 5, 2.0) for i in range(40)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = wide_plans.schema_errors(spark, str(tmp_path))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("guess") == 1
    assert {r["errors"] for r in made.collect()} == {"", "unknown operation", "missing operand", "repeated id", "bad id"}


def test_ids_of_problems_are_written_after_repeats_are_gone(spark, tmp_path):
    lines = [(1, 2, 3, 4, 5.0), (1, 2, 3, 4, 5.4), (12, 3, 3, 4, 6.0), (1, 23, 3, 4, 6.0), (None, 2, 3, 4, 5.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.createDataFrame([(3, 8)], "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    made = domain.problems(spark, str(tmp_path))
    assert sorted((r["pid"], r["a"], r["k"]) for r in made.collect()) == [("1-2-3-4", 5, 2), ("1-23-3-4", 6, 23), ("12-3-3-4", 6, 3), ("2-3-4", 5, 2)]
    assert "concat_ws" not in made._jdf.queryExecution().optimizedPlan().toString().split("Repartition", 1)[1]


def test_factors_are_looked_for_only_where_they_matter(monkeypatch):
    looked = []
    own = leaf_roles.factors
    monkeypatch.setattr(leaf_roles, "factors", lambda q: looked.append(q) or own(q))
    assert leaf_roles.movable([213.0, 315.0], ["213", "315"], "213 rows of 315 seats every day?") == [True, True] and not looked
    assert leaf_roles.movable([24.5, 315.0], ["24.5", "315"], "24.5 per hour of 315?") == [False, True] and looked


def test_fingerprint_from_a_known_depth(spark):
    node = lambda op, refs, value, dc: {"op": op, "refs": refs, "value": value, "dc": dc}
    nodes = [node("assign", [], 2.5, 1), node("assign", [], 40.0, 2), node("multiply", [0, 1], 100.0, 3), node("add", [2, 2], 200.0, None)]
    row = spark.createDataFrame([(nodes, 2)], f"n {graphs.NODES}, d int").select(graphs.fingerprint_core(F.col("n"), F.col("d")), graphs.fingerprint_core(F.col("n")), graphs.fingerprint_script(F.col("n"))).first()
    shown = {"complexities": [[0, 1, 0, True, False], [0, 2, 0, False, False], [2, 3, 0, True, False], [2, 3, 0, False, False]], "depth": 2, "n_edges": 3, "n_nodes": 4, "op_types": ["assign", "assign", "multiply", "add"]}
    assert row[0] == row[1] == hashlib.sha256(json.dumps(shown).encode()).hexdigest()[:16]
    script = '{"dcs": [1, 2, 3], "depths": [0, 0, 2, 2], "n": 4, "ops": ["assign", "assign", "multiply", "add"]}'
    assert row[2] == hashlib.sha256(script.encode()).hexdigest()[:12]


def _lines(spark, folder, lines):
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(3, 8), (5, 31)], "p_partkey long, p_size int").write.parquet(f"{folder}/part.parquet")


def test_levels_of_equal_solutions_are_found_once(spark, tmp_path, monkeypatch):
    _lines(spark, str(tmp_path), [(i, 2, (3, 5)[i % 2], i % 4, 15.0) for i in range(40)])
    counted = []
    own = graph_tables.tables_of
    monkeypatch.setattr(graph_tables, "tables_of", lambda g: counted.append(g.count()) or own(g))
    got = io_plans.graph_levels(spark, str(tmp_path)).collect()
    assert counted == [2]  # not 40
    assert sorted(map(tuple, got)) == sorted((f"{i}-2-{(3, 5)[i % 2]}-{i % 4}/15/{(8, 31)[i % 2]}/2", 2, 5, 4) for i in range(40))


def test_round_trip_takes_every_sound_kind(spark, tmp_path):
    _lines(spark, str(tmp_path), [(kind, 2, 3, 0, 15.0) for kind in range(15)])  # x = 215, y = 308, z = 22
    got = {int(r["pid"].split("-")[0]): (r["solution"], r["same"]) for r in wide_plans.wide_round_trip(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 7, 11, 12, 14} and {k for k, (_, same) in got.items() if not same} == {12}
    assert got[2][0] == "<<66220/308=215>> <<215+22=237>>\n#### 237" and got[11][0] == "<<215*308=66220>> <<132440/2=66220>>\n#### 66220" and got[12][0] == "<<308-215=93>>\n#### 93"


def _batch(n=400):
    """Problems of several forms, odd ones among them, as :func:`draws.made_of` reads them."""
    rng, texts = random.Random(9), []
    for _ in range(n):
        a, b, k, s = rng.randint(1, 50), rng.randint(1, 50), rng.randint(1, 7), rng.randint(1, 60)
        c = 1000 + a * b
        texts.append(rng.choice([
            (f"Store {s} packs {a} boxes of {b} and removes {k}?", f"<<{a}*{b}={a * b}>> <<{a * b}-{k}={a * b - k}>>\n#### {a * b - k}"),
            (f"Tom and Ann get {a} pens every day for {b} days, {k}x?", f"<<{a}*{b}={a * b}>> <<{a * b}+{k}={a * b + k}>>\n#### {a * b + k}"),
            (f"Tom has {a} at 1.5, {c}?", f"<<{a}*1.5={a * 1.5}>> <<{a * 1.5}+{c}={a * 1.5 + c}>>\n#### {a * 1.5 + c}"),
            (f"Mary buys {c} out of {b}, 12 each", f"<<{c}/12={c / 12}>> <<{c / 12}-{b}={c / 12 - b}>>\n#### {c / 12 - b}"),
            (None, f"<<{a}+{c}={a + c}>>\n#### {a + c}"),
        ]))
    read = graph_parser.parse_batch(pa.array([t for _, t in texts]), False)
    shown = [[repr(x["value"]).removesuffix(".0") for x in g] if any(x["op"] == "assign" and x["value"] % 1 for x in g) else None for g in read.field("nodes").to_pylist()]
    columns = [pa.array([f"p{i}" for i in range(n)]), pa.array([q for q, _ in texts]), read.field("nodes"), read.field("answer"), pa.array(shown, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, names=["pid", "question", "nodes", "answer", "shown"])


def test_variants_are_drawn_as_arrays_like_single_ones(monkeypatch):
    batch, alone = _batch(), []
    own = draws._one_by_one
    monkeypatch.setattr(draws, "_one_by_one", lambda left, *rest: alone.append(len(left)) or own(left, *rest))
    rows = lambda made: sorted(zip(*(x.tolist() if hasattr(x, "tolist") else x.to_pylist() for x in made.lists()), strict=True), key=str)
    fast = draws.made_of(batch, 3, 10)
    monkeypatch.setattr(draws, "LEAST", len(batch) + 1)
    slow = draws.made_of(batch, 3, 10)
    assert alone[1] == len(batch) and alone[0] < 0.7 * len(batch)
    assert rows(fast) == rows(slow) and len(rows(fast)) > 300
    assert fast.movable.tolist() == slow.movable.tolist() and fast.phantom.tolist() == slow.phantom.tolist()


def test_draws_of_sql_are_those_of_mutate(spark):
    lines = [(i, f"Tom has {a} boxes of {b} pens and gives away {c}.", f"<<{a}*{b}={a * b}>> <<{a * b}-{c}={a * b - c}>>\n#### {a * b - c}") for i, (a, b, c) in enumerate([(15 + i, 23, 17 - i % 9) for i in range(30)])]
    p = spark.createDataFrame(lines, "pid int, question string, s string").select("pid", "question", F.explode(F.array(graphs.parse(F.col("s")))).alias("g")).select("pid", "question", "g.nodes", "g.answer")
    extensions.register(spark)
    variants.drawable(p).createOrReplaceTempView("drawable")
    by_row = spark.sql("SELECT d.pid, v.k, v.attempt, v.answer FROM drawable d, LATERAL draw_variants(d.pid, d.nodes, d.free, d.answer, 2, 10) v").collect()
    at_once = spark.sql("SELECT pid, k, attempt, v.answer FROM drawable LATERAL VIEW explode(array(drawn_variants(pid, nodes, free, answer, 2, 10))) d AS drawn LATERAL VIEW inline(drawn) v AS k, attempt, `values`, answer")
    want = variants.mutate(p, 2, 10, nodes=False).select("pid", "k", "attempt", "answer").collect()
    assert sorted(map(tuple, at_once.collect())) == sorted(map(tuple, by_row)) == sorted(map(tuple, want)) and len(want) > 40
    assert "PythonUDTF" not in at_once._jdf.queryExecution().executedPlan().toString()
    batch, many = _batch(20), lambda v: pa.array([v] * 20)
    free = pa.array([[True] * len(g) for g in batch.column("nodes").to_pylist()])
    assert draws.drawn_lists(pa.nulls(20, pa.string()), batch.column("nodes"), free, batch.column("answer"), many(2), many(10)).to_pylist() == [[]] * 20


def test_status_of_regeneration_writes_no_variants(spark, monkeypatch):
    rows = [("a", "Tom has 15 boxes of 23 pens and gives away 17.", "<<15*23=345>> <<345-17=328>>\n#### 328")] * 2 + [(None, "Tom has 15 boxes of 23 pens.", "<<15*23=345>>\n#### 345")]
    p = spark.createDataFrame(rows, "pid string, question string, s string").select("pid", "question", F.explode(F.array(graphs.parse(F.col("s")))).alias("g")).select("pid", "question", "g.nodes", "g.answer")
    status, made = variants.regenerate(p, 5, 50)
    assert "variant_question" not in status._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, status.collect()), key=str) == [("a", "regenerated", 10), ("a", "regenerated", 10), (None, "few_variants", 0)] and made.count() == 10


def test_equal_parts_spare_the_checks_of_a_variant(spark):
    node = lambda op, refs, value, dc: {"op": op, "refs": refs, "value": value, "dc": dc}
    first = [node("assign", [], 15.0, 2), node("assign", [], 2.5, 1), node("multiply", [0, 1], 37.5, 2)]
    others = [[node("assign", [], 16.0, 2), first[1], first[2]], [node("assign", [], 160.0, 3), *first[1:]], [node("assign", [], 16.5, 2), *first[1:]], [*first[:2], node("multiply", [1, 0], 37.5, 2)], [*first[:2], node("add", [0, 1], 37.5, 2)], first[:2], None]
    frame = spark.createDataFrame([(i, first, o) for i, o in enumerate(others)], f"i int, a {graphs.NODES}, b {graphs.NODES}")
    a, b = F.col("a"), F.col("b")
    plain = {"topology": (F.size(a) == F.size(b)) & (graphs.edges(a) == graphs.edges(b)), "op_types": graphs.ops(a) == graphs.ops(b), "complexity": graphs.complexities(a) == graphs.complexities(b), "fingerprint": graphs.fingerprint_core(a) == graphs.fingerprint_core(b)}
    checks = graphs.isomorphism_checks(a, b, F.lit("x"), F.lit(1.0))
    for r in frame.select(checks.alias("c"), *[c.alias(n) for n, c in plain.items()]).collect():
        assert all(r["c"][n] == r[n] for n in plain)
