"""Computation graphs as nested columns: parsing, checks, execution, fingerprints.

A graph is ``array<struct<op, refs, value, dc>>`` in definition order; ``refs``
are places in the array, from 0.  Texts are read on Arrow batches; all else is
higher-order functions over that array, so a graph never leaves its row and
nothing shuffles.
"""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from probeframe.functions.graph_parser import PARSED
from probeframe.functions.text import let, missing_numbers

STEP = r"<<([^>]+?)=([^>]+?)>>"
TOKEN = r"\d+(?:\.\d+)?|[+\-*/()%]"
NUMBER = r"\d+(?:\.\d+)?"
#: Operations that can be executed.
EXECUTABLE = ["assign", "add", "subtract", "multiply", "divide", "modulo"]
NODE = "struct<op:string,refs:array<int>,value:double,dc:int>"
NODES = f"array<{NODE}>"
GRAPH = f"struct<nodes:{NODES},answer:double,accepted:boolean,error:string,values:array<double>,depth:int>"


def steps(solution: Column) -> Column:
    """``array<struct<expr, result>>`` of the annotated steps, in order."""
    return F.arrays_zip(
        F.regexp_extract_all(solution, F.lit(STEP), F.lit(1)).alias("expr"), F.regexp_extract_all(solution, F.lit(STEP), F.lit(2)).alias("result")
    )


def tokens(expr: Column) -> Column:
    return F.regexp_extract_all(expr, F.lit(TOKEN), F.lit(0))


def numbers(expr: Column) -> Column:
    return F.transform(F.regexp_extract_all(expr, F.lit(NUMBER), F.lit(0)), lambda t: t.try_cast("double"))


def dominant_op(expr: Column, strict: bool = False) -> Column:
    """The operation that stands for a step: of mixed signs the commoner (subtract on a tie), else ``*`` before ``/``.

    ``strict`` knows ``%`` alone as modulo; otherwise it counts as add.  Null without an operator.
    """
    ops = F.filter(tokens(expr), lambda t: t.isin("+", "-", "*", "/", "%"))
    kinds = F.array_distinct(ops)
    count = lambda o: F.size(F.filter(ops, lambda t: t == o))
    only = lambda *o: F.size(F.array_except(kinds, F.array(*[F.lit(x) for x in o]))) == 0
    modulo = "modulo" if strict else "add"
    return (
        F.when(F.size(ops) == 0, F.lit(None).cast("string")).when(only("%"), modulo)
        .when(only("+", "-"), F.when(count("-") >= count("+"), F.when(count("-") > 0, "subtract").otherwise("add")).otherwise("add"))
        .when(F.array_contains(kinds, "*"), "multiply").when(F.array_contains(kinds, "/"), "divide").otherwise("add")
    )


def forward_refs(nodes: Column) -> Column:
    """Whether some node refers to itself, a later node or none."""
    return F.exists(F.transform(nodes, lambda n, i: F.exists(n["refs"], lambda r: (r >= i) | (r < 0))), lambda x: x)


def operate(op: Column, args: Column, lenient: bool = True) -> Column:
    """One node's value; divide and modulo take the first two operands.  A zero divisor gives infinity (``lenient``) or null."""
    first, second = F.try_element_at(args, F.lit(1)), F.try_element_at(args, F.lit(2))
    total = F.aggregate(args, F.lit(0.0), lambda a, x: a + x)
    product = F.aggregate(args, F.lit(1.0), lambda a, x: a * x)
    zero = F.lit(float("inf")) if lenient else F.lit(None).cast("double")
    return (
        F.when(op == "add", total).when(op == "subtract", first - (total - first)).when(op == "multiply", product)
        .when(op == "divide", F.when(second == 0, zero).otherwise(F.try_divide(first, second)))
        .when(op == "modulo", F.when(second == 0, zero).otherwise(first - second * F.floor(F.try_divide(first, second))))
        .otherwise(F.lit(0.0) if lenient else F.lit(None).cast("double"))
    )


def values(nodes: Column, lenient: bool = True) -> Column:
    """``array<double>``: every node's value by forward execution; a reference ahead makes a null."""

    def step(done: Column, n: Column) -> Column:
        made = let(F.transform(n["refs"], lambda r: F.try_element_at(done, r + 1)), lambda args: operate(n["op"], args, lenient))
        return F.concat(done, F.array(F.when(n["op"] == "assign", n["value"]).otherwise(made)))

    return F.aggregate(nodes, F.array().cast("array<double>"), lambda done, n: step(done, n).cast("array<double>"))


def execute(nodes: Column, lenient: bool = True) -> Column:
    """The last node's value."""
    return F.try_element_at(values(nodes, lenient), F.lit(-1))


def checked(nodes: Column, done: Column | None = None) -> Column:
    """``struct<answer, ok>``: ok if every computed value is whole, not negative and 1e8 at most; ``done`` are the values if they are known."""

    def judged(done: Column) -> Column:
        computed = F.filter(F.zip_with(nodes, done, lambda n, v: F.struct(n["op"].alias("op"), v.alias("v"))), lambda x: x["op"] != "assign")
        fine = F.forall(computed, lambda x: F.coalesce((x["v"] == F.floor(x["v"])) & (x["v"] >= 0) & (F.abs(x["v"]) <= 1e8), F.lit(False)))
        return F.struct(F.try_element_at(done, F.lit(-1)).alias("answer"), F.coalesce(fine, F.lit(False)).alias("ok"))

    return let(values(nodes, False) if done is None else done, judged)


@cache
def _reader(strict: bool):
    @F.arrow_udf(GRAPH)
    def read(solutions: pa.Array) -> pa.Array:
        return PARSED[strict](solutions.to_pylist())

    return read


def parse(solution: Column, strict: bool = False) -> Column:
    """``struct<nodes, answer, accepted, error, values, depth>``: the graph of an annotated solution, and whether it gives the stated answer.

    Leaves are the distinct literals of all steps; each step refers to the
    newest node with an operand's value.  A leaf whose value some step computes
    goes, and what referred to it refers to the first such step.  Steps without
    an operator are passed over; with ``strict``, so are steps whose result is
    no number.  ``nodes`` is null without steps and for a null solution.

    Strict graphs need two nodes, no reference ahead and a relative error under
    1%; script graphs an absolute error of .01 at most, and NaN is no error.
    ``values`` are all nodes' by forward execution, as :func:`values` gives them
    (lenient unless ``strict``), ``depth`` the edges on the longest path.

    The newest node of each value is state, so a small reader walks each text
    once, on Arrow batches (``graph_parser``).
    """
    return _reader(strict)(solution.cast("string"))


def build(solution: Column, strict: bool = False) -> Column:
    """The graph before acceptance; null without steps."""
    return parse(solution, strict)["nodes"]


def topological_order(nodes: Column) -> Column:
    """``array<string>``: node names ``n0, n1, ...`` in dependency order; of those ready, the first by text (n10 before n2). Nodes on a cycle are left out."""
    name = lambda i: F.concat(F.lit("n"), i.cast("string"))
    places = F.transform(nodes, lambda n, i: F.struct(name(i).alias("id"), F.transform(n["refs"], name).alias("needs")))

    def step(done: Column, places: Column) -> Column:
        ready = F.filter(places, lambda p: ~F.array_contains(done, p["id"]) & (F.size(F.array_except(p["needs"], done)) == 0))
        return let(F.array_min(F.transform(ready, lambda p: p["id"])), lambda found: F.when(found.isNull(), done).otherwise(F.array_append(done, found)))

    return let(places, lambda places: F.aggregate(places, F.array().cast("array<string>"), lambda done, _: step(done, places).cast("array<string>")))


def depth(nodes: Column) -> Column:
    """Edges on the longest path."""
    step = lambda done, n: F.concat(done, F.array(F.coalesce(F.array_max(F.transform(n["refs"], lambda r: F.try_element_at(done, r + 1))) + 1, F.lit(0))))
    return F.coalesce(F.array_max(F.aggregate(nodes, F.array().cast("array<int>"), lambda d, n: step(d, n).cast("array<int>"))), F.lit(0))


def edges(nodes: Column) -> Column:
    """The sorted distinct ``(source, target)`` places: with the node count, the topology."""
    pairs = F.flatten(F.transform(nodes, lambda n, i: F.transform(n["refs"], lambda r: F.struct(r.alias("s"), i.alias("t")))))
    return F.array_sort(F.array_distinct(pairs))


def ops(nodes: Column) -> Column:
    return F.transform(nodes, lambda n: n["op"])


def _json_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def _quoted_ops(nodes: Column) -> Column:
    named = F.array_compact(nodes["op"])
    return F.when(F.size(named) > 0, F.concat(F.lit('["'), F.array_join(named, '", "'), F.lit('"]'))).otherwise(F.lit("[]"))


def fingerprint_script(nodes: Column) -> Column:
    """12 hexadecimal digits of the sha256 of digit classes, operand counts, size and operations as spaced JSON with sorted keys."""
    text = F.concat(
        F.lit('{"dcs": '), _json_list(nodes["dc"].cast("array<string>")), F.lit(', "depths": '), _json_list(F.transform(nodes, lambda n: F.size(n["refs"]).cast("string"))),
        F.lit(', "n": '), F.size(nodes).cast("string"), F.lit(', "ops": '), _quoted_ops(nodes), F.lit("}"),
    )
    return F.substring(F.sha2(text, 256), 1, 12)


def complexities(nodes: Column) -> Column:
    """Per node ``struct<n_operands, digit_class, nesting, fraction, negative>``; the digit class is the largest of the node's and its operands'."""
    at = lambda r: F.element_at(nodes, r + 1)

    def of(n: Column) -> Column:
        own = F.array_max(F.concat(F.array(n["dc"]), F.transform(n["refs"], lambda r: at(r)["dc"])))
        fraction = (n["value"] != F.floor(n["value"])) | F.exists(n["refs"], lambda r: at(r)["value"] != F.floor(at(r)["value"]))
        return F.struct(F.size(n["refs"]).alias("n_operands"), own.alias("digit_class"), F.lit(0).alias("nesting"), fraction.alias("fraction"), F.lit(False).alias("negative"))

    return F.transform(nodes, of)


def fingerprint_core(nodes: Column, longest: Column | None = None) -> Column:
    """16 hexadecimal digits over complexities, depth, edge and node counts and operations; ``longest`` is the depth if it is known, as :func:`parse` gives it."""

    def shown(known: Column) -> Column:
        """The complexities as texts, as :func:`complexities` has them, from all nodes' digit classes and whether they are fractions."""

        def of(n: Column) -> Column:
            own = F.when(n["refs"].isNotNull(), F.greatest(n["dc"], F.array_max(F.transform(n["refs"], lambda r: F.element_at(known["dc"], r + 1)))))
            fraction = (n["value"] != F.floor(n["value"])) | F.exists(n["refs"], lambda r: F.element_at(known["fraction"], r + 1))
            return F.concat(F.lit("["), F.concat_ws(", ", F.size(n["refs"]).cast("string"), own.cast("string"), F.lit("0"), F.when(fraction, "true").otherwise("false"), F.lit("false")), F.lit("]"))

        return F.transform(nodes, of)

    cs = let(F.struct(nodes["dc"].alias("dc"), F.transform(nodes, lambda n: n["value"] != F.floor(n["value"])).alias("fraction")), shown)
    pairs = F.flatten(F.transform(nodes, lambda n, i: F.transform(n["refs"], lambda r: F.struct(r.alias("s"), i.alias("t")))))
    text = F.concat(
        F.lit('{"complexities": '), _json_list(cs), F.lit(', "depth": '), (depth(nodes) if longest is None else longest).cast("string"), F.lit(', "n_edges": '), F.size(F.array_distinct(pairs)).cast("string"),
        F.lit(', "n_nodes": '), F.size(nodes).cast("string"), F.lit(', "op_types": '), _quoted_ops(nodes), F.lit("}"),
    )
    return F.substring(F.sha2(text, 256), 1, 16)


#: The signs that steps write for operations.
SIGNS = {"add": "+", "subtract": "-", "multiply": "*", "divide": "/", "modulo": "%"}


def solution_of(nodes: Column, done: Column | None = None) -> Column:
    """The annotated solution that a graph stands for: its steps in order, and the answer by execution; for the round trip through :func:`parse`.

    ``done`` are the executed values if they are known, as :func:`parse` gives them.
    """
    from probeframe.functions.answers import number_text

    sign = F.create_map(*[F.lit(x) for pair in SIGNS.items() for x in pair])

    def written(texts: Column) -> Column:
        shown = lambda n: F.concat_ws("", F.transform(n["refs"], lambda r, i: F.concat(F.when(i > 0, F.element_at(sign, n["op"])).otherwise(F.lit("")), F.element_at(texts, r + 1))))
        step = lambda n, i: F.when(n["op"] != "assign", F.concat(F.lit("<<"), shown(n), F.lit("="), F.element_at(texts, i + 1), F.lit(">>")))
        return F.array_join(F.transform(nodes, step), " ")

    answer = execute(nodes) if done is None else F.try_element_at(done, F.lit(-1))
    return F.concat(let(F.transform(nodes, lambda n: number_text(n["value"])), written), F.lit("\n#### "), let(answer, number_text))


def violations(nodes: Column) -> Column:
    """What makes a graph unfit: ``array<string>``, empty for a sound one."""

    def broken(nodes: Column) -> Column:
        out_of = F.exists(nodes, lambda n: F.exists(n["refs"], lambda r: (r < 0) | (r >= F.size(nodes))))
        return F.array(
            F.when(F.size(nodes) < 2, "too few nodes"), F.when(F.exists(nodes, lambda n: (n["op"] == "assign") & (F.size(n["refs"]) > 0)), "assign with operands"),
            F.when(F.exists(nodes, lambda n: ~n["op"].isin(*EXECUTABLE)), "unknown operation"), F.when(out_of, "missing operand"), F.when(~out_of & forward_refs(nodes), "forward reference"),
        )

    return F.array_compact(let(nodes, broken))


#: What an id of a node looks like.
NODE_ID = r"^n[0-9]+$"
SCHEMA_NODES = "array<struct<id:string,op:string,refs:array<string>,value:double>>"


def schema_errors(nodes: Column, answer_id: Column) -> Column:
    """What is wrong with a graph in the schema's form (:data:`SCHEMA_NODES`, references by id): ``array<string>``, empty for a sound one.

    Ids are ``n`` and digits, no two alike; leaves have no operands; operations
    are known; every operand is a node, defined before it is used; there are two
    nodes at least, the answer's among them.  Null nodes are too few.
    """

    def found(ids: Column) -> Column:
        before = lambda n, i: F.exists(n["refs"], lambda r: F.array_contains(ids, r) & ~F.array_contains(F.slice(ids, 1, i), r))
        return F.array(
            F.when(F.exists(ids, lambda i: ~F.coalesce(i.rlike(NODE_ID), F.lit(False))), "bad id"), F.when(~F.coalesce(answer_id.rlike(NODE_ID), F.lit(False)), "bad answer id"),
            F.when(F.size(nodes) < 2, "too few nodes"), F.when(F.exists(nodes, lambda n: (n["op"] == "assign") & (F.size(n["refs"]) > 0)), "assign with operands"),
            F.when(F.exists(nodes, lambda n: ~n["op"].isin(*EXECUTABLE)), "unknown operation"), F.when(~F.coalesce(F.array_contains(ids, answer_id), F.lit(False)), "answer node is absent"),
            F.when(F.exists(nodes, lambda n: F.exists(n["refs"], lambda r: ~F.array_contains(ids, r))), "missing operand"),
            F.when(F.exists(F.transform(nodes, before), lambda x: x), "forward reference"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated id"),
        )

    return F.array_compact(F.coalesce(let(F.transform(nodes, lambda n: n["id"]), found), F.array(F.lit("too few nodes"))))


def isomorphism_checks(first: Column, second: Column, text: Column, answer: Column) -> Column:
    """Named booleans: whether ``second`` is a sound variant of ``first`` with its numbers in ``text`` and that answer; the novelty check always holds."""
    from probeframe.functions.answers import number_text

    leaves = F.transform(F.filter(second, lambda n: n["op"] == "assign"), lambda n: number_text(n["value"]))
    # all that topology, operations, complexities and fingerprints are made of: where it is equal and has no null, so are they
    parts = lambda nodes: F.transform(nodes, lambda n: F.struct(n["op"], n["refs"], n["dc"], n["value"] != F.floor(n["value"])))
    whole = F.forall(first, lambda n: n["op"].isNotNull() & n["refs"].isNotNull() & n["dc"].isNotNull() & n["value"].isNotNull())
    alike = F.coalesce(whole & (parts(first) == parts(second)), F.lit(False))
    or_else = lambda check: F.when(alike, True).otherwise(check)
    return F.struct(
        or_else((F.size(first) == F.size(second)) & (edges(first) == edges(second))).alias("topology"), or_else(ops(first) == ops(second)).alias("op_types"),
        or_else(complexities(first) == complexities(second)).alias("complexity"), or_else(fingerprint_core(first) == fingerprint_core(second)).alias("fingerprint"),
        (F.size(missing_numbers(leaves, text)) == 0).alias("numbers_present"),
        F.coalesce(F.abs(execute(second, False) - answer) < 1e-6, F.lit(False)).alias("answer_consistent"), F.lit(True).alias("novel_surface"),
    )
