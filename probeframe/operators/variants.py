"""Variants of problems: which leaves may change, new values, new texts.

Each problem draws the values of its variants from generators that its id, the
variant and the attempt seed; the first attempt that executes soundly wins.
Draws never depend on partitions, so a lost task redraws the same values.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from probeframe.functions import graphs
from probeframe.functions import text as tx
from probeframe.functions.answers import digit_class, number_text
from probeframe.functions.leaf_roles import roles_of
from probeframe.functions.names import alone
from probeframe.operators import draws

#: Attempts for each variant, and bounds of the new answer against the old.
ATTEMPTS, RATIO = 50, 3.0
#: Names that take the place of a problem's, and names that problems use.
AGENTS = (
    "Tomás Aisha Kenji Priya Oluwaseun Fatima Dmitri Yuki Ingrid Kofi Xiulan Rashid Svetlana Hiroshi Amara Bjorn Nalini Emeka Saoirse Tariq Mei-Lin Andrei Zara Kwame Linnea"
).split()
NAMES = (
    "Janet Mark James John Mary Tom Sarah Bob Alice Peter Jane Bill Mike Lisa Anna David Emily Alex Sam Chris Tim Dan Amy Beth Carl Weng Natalia Elaine Julie Martha Toby Henry "
    "Josh Jack Jill Gerald Cecelia Rex Gail Carla Joy Ruby Oliver Ryan Megan Phil Max Ken Ben Grace Steve Luke Tina Victor Hannah Kylar Marissa Tobias Leah Sofia Brennan"
).split()


def leaves(nodes: Column) -> Column:
    return F.filter(nodes, lambda n: n["op"] == "assign")


def roles(nodes: Column, question: Column) -> Column:
    """``array<struct<value, role>>`` of the leaves: VARIABLE may change, CONSTANT may not.

    Constant are values absent from the text, known constants that the text has,
    and values that it has twice; if all are, the largest value above one that
    it has exactly once is freed.  Conversion factors are then constant in any case.
    One pass over the question, on Arrow batches (``leaf_roles``).
    """
    own = F.transform(leaves(nodes), lambda n: F.struct(n["value"].alias("value"), number_text(n["value"]).alias("text")))
    return _role_reader()(own, question)


@cache
def _role_reader():
    def read(leaves: pa.Array, questions: pa.Array) -> pa.Array:
        return roles_of(leaves, questions)

    read.__annotations__ = {"leaves": pa.Array, "questions": pa.Array, "return": pa.Array}  # as types, by which Spark knows an Arrow function
    return F.arrow_udf(read, "array<struct<value:double,role:string>>")


def draw_like(value: float, used: set[int], rng: random.Random | draws.Words) -> float | None:
    """A whole number with as many digits as ``value`` and its sign, a fifth away from it or more, none of ``used`` and no known constant.

    One draw of an index into all that is allowed, counted as a range without an
    interval and some points; None only if nothing is allowed.
    """
    low, high, near, fixed, known = _allowed(value)
    own = [c for c in used if low <= c <= high and c not in known and not near[0] <= c <= near[1]]
    barred = sorted(fixed + [(c, c) for c in own]) if own else fixed
    allowed = high - low + 1 - len(own) - sum(b - a + 1 for a, b in fixed)
    if allowed <= 0:
        return None
    c = low + rng.randrange(allowed)
    for a, b in barred:
        if c >= a:
            c += b - a + 1
    return float(-c if value < 0 else c)


@lru_cache(10_000)
def _allowed(value: float) -> tuple[int, int, tuple[int, int], list[tuple[int, int]], frozenset[int]]:
    """For a value: the range of as many digits, what is too near, and all that is barred in order, with the known constants among it."""
    size = int(abs(value))
    digits = len(str(size))
    low, high = (2, 9) if digits == 1 else (10 ** (digits - 1), 10**digits - 1)
    away = max(1, int(abs(value) * 0.2))
    near = max(low, size - away + 1), min(high, size + away - 1)
    known = frozenset(c for c in tx.KNOWN_CONSTANTS if low <= c <= high and not near[0] <= c <= near[1])
    return low, high, near, sorted([(c, c) for c in known] + [near] * (near[0] <= near[1])), known


def run_checked(ops: list[str], refs: list[list[int]], values: list[float], whole: bool = True) -> float | None:
    """The last node's value by forward execution; None unless every computed value is not negative, 1e8 at most and, with ``whole``, whole."""
    done: list[float] = []
    for i, op in enumerate(ops):
        if op == "assign":
            done.append(values[i])
            continue
        args = []
        for r in refs[i]:
            if not 0 <= r < i:
                return None
            args.append(done[r])
        if op not in RUN or (op in ("divide", "modulo") and (len(args) < 2 or args[1] == 0)):
            return None
        got = RUN[op](args)
        if not 0 <= got <= 1e8 or (whole and got != math.floor(got)):
            return None
        done.append(float(got))
    return done[-1] if done else None


RUN = {"add": sum, "subtract": lambda x: x[0] - sum(x[1:]), "multiply": math.prod, "divide": lambda x: x[0] / x[1], "modulo": lambda x: x[0] % x[1]}


def sampled(ops: list[str], refs: list[list[int]], values: list[float], free: list[bool], answer: float, seed: str, attempts: int) -> tuple[int, list[float], float] | None:
    """The first sound attempt at new values for the leaves that are ``free``: its number, all values, and the answer."""
    fixed = {int(abs(v)) for op, v, f in zip(ops, values, free, strict=True) if op == "assign" and not f}
    key = draws.key_of(seed)
    for attempt in range(attempts):
        rng, used, new = draws.Words(key, attempt), set(fixed), list(values)
        for i, may in enumerate(free):
            if may:
                got = draw_like(values[i], used, rng)
                if got is None:
                    break
                new[i] = got
                used.add(int(abs(got)))
        else:
            made = run_checked(ops, refs, new)
            if made is not None and (answer == 0 or 1 / RATIO <= abs(made) / abs(answer) <= RATIO):
                return attempt, new, made
    return None


def redrawn(ops: list[str], refs: list[list[int]], values: list[float], seed: str, attempts: int) -> tuple[int, list[float], float] | None:
    """As :func:`sampled`, by the first generator's rules: every leaf is drawn from the numbers of as many digits, whatever the others are.

    In the first attempt each leaf must change, in later ones it may come out as it was.
    """
    for attempt in range(attempts):
        rng, new = random.Random(f"{seed}|{attempt}"), list(values)
        for i, op in enumerate(ops):
            if op == "assign":
                digits = len(str(int(abs(values[i]))))
                low, high = max(2, 10 ** (digits - 1)), 10**digits - 1
                inside = attempt == 0 and values[i] in range(low, high + 1)
                c = low + rng.randrange(high - low + 1 - inside)
                new[i] = float(c + (inside and c >= values[i]))
        made = run_checked(ops, refs, new, whole=False)
        if made is not None:
            return attempt, new, made
    return None


def drawable(parsed: DataFrame, every_leaf: bool = False) -> DataFrame:
    """``pid, question, nodes, answer, free`` of the problems that may have variants; ``free`` tells of every node whether its value may change."""
    # exploding an array of one keeps the planner from evaluating it once for each use
    rows = parsed.select(F.col("pid").cast("string").alias("pid"), "question", "nodes", "answer", F.explode(F.array(roles(F.col("nodes"), F.col("question")))).alias("roles"))
    rows = rows.filter((F.exists("roles", lambda r: r["role"] == "VARIABLE") | F.lit(every_leaf)) & ~F.exists("nodes", lambda n: n["value"].isNull() | F.isnan(n["value"])))
    free = F.transform("nodes", lambda n: (n["op"] == "assign") & F.exists("roles", lambda r: (r["value"] == n["value"]) & (r["role"] == "VARIABLE")))
    return rows.select("pid", "question", "nodes", "answer", free.alias("free"))


def mutate(parsed: DataFrame, variants: int = 5, attempts: int = ATTEMPTS, every_leaf: bool = False, nodes: bool = True) -> DataFrame:
    """``pid, k, attempt, nodes, answer, variant_question`` from ``pid, question, nodes, answer``; without ``nodes`` the graphs are left out and don't leave the workers.

    Sound attempts have whole, non-negative intermediates up to 1e8 and an
    answer within a factor of three of the original's.  A (problem, variant)
    without one has no row, nor has a problem none of whose leaves may change.
    Texts that come out as the original's go.  Draws are seeded by the problem's
    id, the variant and the attempt.  With ``every_leaf`` all leaves change, by
    the first generator's rules (:func:`redrawn`).
    """

    if every_leaf:
        made = _redrawn(parsed, variants, attempts)
        return made.drop("original") if nodes else made.drop("original", "nodes")
    return _mutated(parsed, variants, attempts).drop("original") if nodes else _drawn(parsed, variants, attempts, False)


def _rows(parsed: DataFrame, *more: Column) -> DataFrame:
    """The columns that ``draws.made_of`` reads; values as texts only where a leaf isn't whole."""
    odd = F.exists("nodes", lambda n: (n["op"] == "assign") & (n["value"] != F.floor(n["value"])))
    return parsed.select(F.col("pid").cast("string").alias("pid"), "question", "nodes", F.col("answer").cast("double").alias("answer"), F.when(odd, F.transform("nodes", lambda n: number_text(n["value"]))).alias("shown"), *more)


def _drawn(parsed: DataFrame, variants: int, attempts: int, nodes: bool) -> DataFrame:
    """``pid, k, attempt, answer, variant_question``, and with ``nodes`` the old graph and its new values."""
    rows = _rows(parsed)
    old = ["pid", "nodes"] if nodes else ["pid"]
    schema = T.StructType([rows.schema[c] for c in old] + T._parse_datatype_string("k int, attempt int, " + "new array<double>, " * nodes + "answer double, variant_question string").fields)

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ks, hits, new, answers, texts = draws.made_of(batch, variants, attempts).lists()
            taken = batch.select(old).take(pa.array(at.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*taken.columns, ks, hits, *[new] * nodes, answers, texts], names=schema.names)

    return rows.mapInArrow(tries, schema)


def _with_values(made: DataFrame) -> DataFrame:
    node = lambda n, v: F.struct(n["op"].alias("op"), n["refs"].alias("refs"), v.alias("value"), F.when(n["op"] == "assign", digit_class(v).cast("int")).otherwise(n["dc"]).alias("dc"))
    return made.select("pid", "k", "attempt", F.zip_with("nodes", "new", node).cast(graphs.NODES).alias("nodes"), "answer", "variant_question", F.col("nodes").alias("original"))


def _mutated(parsed: DataFrame, variants: int, attempts: int) -> DataFrame:
    """:func:`mutate` with the graph that a variant stems from, ``original``."""
    return _with_values(_drawn(parsed, variants, attempts, True))


def _redrawn(parsed: DataFrame, variants: int, attempts: int) -> DataFrame:
    """:func:`_mutated` with ``every_leaf``."""
    kept = drawable(parsed, True).withColumn("shown", F.transform("nodes", lambda n: number_text(n["value"])))
    schema = T.StructType([f for f in kept.schema.fields if f.name in ("pid", "nodes")] + T._parse_datatype_string("k int, attempt int, new array<double>, answer double, variant_question string").fields)

    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ks, attempt, new, answers, texts = [], [], [], [], [], []
            parts = [batch.column(c).to_pylist() for c in ("pid", "question", "shown")]
            for row, (pid, question, shown, plain) in enumerate(zip(*parts, plain_graphs(batch.column("nodes")), strict=True)):
                if question is None:
                    continue
                for k in range(variants):
                    seed = f"{pid}|{k}"
                    found = redrawn(*plain, seed, attempts)
                    text = found and variant_text(question, leaf_changes(plain[0], shown, found[1]), k)
                    if found and text.strip(" ") != question.strip(" "):
                        for out, x in zip((rows, ks, attempt, new, answers, texts), (row, k, *found, text), strict=True):
                            out.append(x)
            taken = batch.select(["pid", "nodes"]).take(pa.array(rows, pa.int64()))
            made = [pa.array(ks, pa.int32()), pa.array(attempt, pa.int32()), pa.array(new, pa.list_(pa.float64())), pa.array(answers, pa.float64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*taken.columns, *made], names=schema.names)

    return _with_values(kept.withColumn("answer", F.col("answer").cast("double")).mapInArrow(tries, schema))


def checks(parsed: DataFrame, variants: int, attempts: int) -> DataFrame:
    """``pid, k, c``: the static checks (``graphs.isomorphism_checks``) of every variant that :func:`mutate` makes, against the graph it stems from."""
    made = _mutated(parsed, variants, attempts)
    found = graphs.isomorphism_checks(F.col("original"), F.col("nodes"), F.col("variant_question"), F.col("answer"))
    return made.select("pid", "k", F.explode(F.array(found)).alias("c"))


def plain_graphs(nodes: pa.ListArray) -> Iterator[tuple[list[str], list[list[int]], list[float]]]:
    """Operations, references and values of each graph of a batch."""
    flat, at = nodes.flatten(), 0
    ops, values, refs = flat.field("op").to_pylist(), flat.field("value").to_pylist(), flat.field("refs").to_pylist()
    for n in nodes.value_lengths().to_pylist():
        n = n or 0
        yield ops[at : at + n], refs[at : at + n], values[at : at + n]
        at += n


def regenerate(parsed: DataFrame, variants: int = 5, attempts: int = ATTEMPTS, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Status of every item, ``pid, status, n_variants``, and the variants of those regenerated.

    An item fails, in this order, for a leaf that its question lacks, for having
    no leaf that may change, for fewer than ``least`` sound variants, and for
    variants that all have its own answer.  The status needs counts and answers
    of an item's variants only: they are counted where they are drawn, and the
    variants themselves are drawn again if they are asked for.
    """
    rows = _rows(parsed, F.col("pid").alias("id"), F.col("answer").alias("stated"))
    schema = T.StructType([rows.schema["id"], rows.schema["stated"], *T._parse_datatype_string("movable boolean, phantom boolean, n long, low double, high double").fields])

    def tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = draws.made_of(batch, variants, attempts)
            at, *_, answers, _ = made.joined()
            n = np.bincount(at, minlength=len(batch))
            low, high = np.full(len(batch), np.inf), np.full(len(batch), -np.inf)
            np.minimum.at(low, at, answers)
            np.maximum.at(high, at, answers)
            absent = batch.column("nodes").is_null().to_numpy(zero_copy_only=False)
            columns = [pa.array(made.movable, mask=absent), pa.array(made.phantom), pa.array(n), pa.array(low, mask=n == 0), pa.array(high, mask=n == 0)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("stated"), *columns], names=schema.names)

    own = Window.partitionBy("id")
    known = lambda c: F.when(F.col("id").isNotNull(), c.over(own))
    items = rows.mapInArrow(tallies, schema).withColumns({"n": F.coalesce(known(F.sum("n")), F.lit(0)), "low": known(F.min("low")), "high": known(F.max("high"))})
    status = (
        F.when(F.col("phantom"), "phantom_leaf").when(~F.col("movable"), "no_variable_leaf")
        .when(F.col("n") < least, "few_variants").when((F.col("low") == F.col("high")) & (F.col("low") == F.col("stated")), "answer_invariant").otherwise("regenerated")
    )
    status = items.select(F.col("id").alias("pid"), status.alias("status"), F.col("n").alias("n_variants"))
    return status, mutate(parsed, variants, attempts).join(status.filter("status = 'regenerated'").select("pid"), "pid", "left_semi")


def whole_text(v: float) -> str | None:
    """A whole number as texts show it, as in ``answers.number_text``; none beyond 64 bits."""
    return str(int(v)) if -(2.0**63) <= v < 2.0**63 else None


def leaf_changes(ops: list[str], shown: list[str | None], new: list[float]) -> dict[str, list[str | None]]:
    """The new numbers of each old one, in the order of the leaves; those that stay are left out."""
    changes: dict[str, list[str | None]] = {}
    for op, old, v in zip(ops, shown, new, strict=True):
        if op == "assign" and old is not None and (text := old if not v.is_integer() else whole_text(v)) is not None and text != old:
            changes.setdefault(old, []).append(text)
    return changes


NUMBER, RUNS = re.compile(r"(?<![0-9.])\b[0-9]+(?:\.[0-9]+)?\b"), re.compile(f"[{tx.LETTER}]+")
BY_LENGTH = sorted(NAMES, key=lambda n: -len(n))


def variant_text(question: str, changes: dict[str, list[str]], k: int) -> str:
    """The question with the leaves' new numbers, all replaced at once, and one name swapped for the k-th agent.

    The n-th occurrence of a number takes the n-th change for it, further ones stay.
    """
    left = {old: iter(new) for old, new in changes.items()}
    text = NUMBER.sub(lambda m: next(left[m[0]], m[0]) if m[0] in left else m[0], question) if left else question
    shown = {*RUNS.findall(text)}
    name = next((n for n in BY_LENGTH if n in shown), None) if not shown.isdisjoint(BY_LENGTH) else None
    return text if name is None else alone(name).sub(AGENTS[(k * 7 + 3) % len(AGENTS)], text)


def legacy_text(question: Column, changes: Column) -> Column:
    """The faulty early rewrite, kept to show its errors: longest old number first, each replacing the first place where it occurs, even inside another number."""
    ordered = F.array_sort(changes, lambda a, b: F.length(b["old"]) - F.length(a["old"]))

    def swap(text: Column, c: Column) -> Column:
        at = F.instr(text, c["old"])
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), c["new"], F.substring(text, at + F.length(c["old"]), F.length(text)))).otherwise(text)

    return F.aggregate(ordered, question, swap)
