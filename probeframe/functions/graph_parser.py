"""Reading annotated solutions into graphs in one pass, on Arrow batches.

The newest node of each value is state that every step reads and changes, so a
solution is walked once.  The walk sees only which values are equal: texts of a
batch that differ in their numbers alone, and have equal numbers at the same
places, have one walk in common and are executed as arrays.  Texts of rarer
shapes are read one by one.  ``graphs.parse`` is the Column that calls it.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from probeframe.functions.memo import Memo

STEP = re.compile(r"<<([^>]+?)=([^>]+?)>>")
TOKEN = re.compile(r"(\d+(?:\.\d+)?)|([+\-*/%])", re.ASCII)
ANSWER = re.compile(r"####\s*([^\r\n]+)", re.ASCII)
NUMERIC = re.compile(r"\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*", re.ASCII)
#: Characters that numbers lose.
MARKS = str.maketrans("", "", ",$€")

POWERS = 10.0 ** np.arange(1, 16)

NODE = pa.struct([("op", pa.string()), ("refs", pa.list_(pa.int32())), ("value", pa.float64()), ("dc", pa.int32())])
GRAPH = pa.struct([("nodes", pa.list_(NODE)), ("answer", pa.float64()), ("accepted", pa.bool_()), ("error", pa.string()), ("values", pa.list_(pa.float64())), ("depth", pa.int32())])


def number(text: str) -> float | None:
    """A double, or None for what isn't a plain decimal literal once its marks are gone."""
    if text.isdecimal() and text.isascii():
        return float(text)
    text = text.translate(MARKS)
    return float(text) if NUMERIC.fullmatch(text) else None


def number_or_ratio(text: str) -> float | None:
    """A number, or the quotient of the first two around slashes; NaN where that fails."""
    if "/" not in text:
        return number(text)
    first, second = (number(p) for p in text.split("/")[:2])
    return math.nan if first is None or not second else first / second


def step_op(signs: str, strict: bool) -> str | None:
    """The operation that stands for a step's signs, as in ``graphs.dominant_op``."""
    if not signs:
        return None
    kinds = set(signs)
    if kinds == {"%"}:
        return "modulo" if strict else "add"
    if kinds <= {"+", "-"}:
        return "subtract" if signs.count("-") >= signs.count("+") else "add"
    return "multiply" if "*" in kinds else "divide" if "/" in kinds else "add"


def operated(op: str, args: list[float | None], lenient: bool) -> float | None:
    """One node's value; None for missing operands, and for a zero divisor unless ``lenient``, which makes it infinity."""
    if op in ("divide", "modulo"):  # of more operands the first two count
        args = args[:2] if len(args) > 1 else [None]
    if None in args or (op == "subtract" and not args):
        return None
    if op == "add" or op == "subtract":
        total = 0.0
        for a in args:
            total += a
        return total if op == "add" else args[0] - (total - args[0])
    if op == "multiply":
        product = 1.0
        for a in args:
            product *= a
        return product
    if args[1] == 0:
        return math.inf if lenient else None
    ratio = args[0] / args[1]
    return ratio if op == "divide" else args[0] - args[1] * math.floor(ratio) if math.isfinite(ratio) else None


def read_graph(solution: str, strict: bool) -> list[tuple[str, list[int], float | None]] | None:
    """``op, refs, value`` of every node, or None without a step; the rules are those of ``graphs.parse``."""
    found = STEP.findall(solution)
    if not found:
        return None
    steps = []
    for expr, shown in found:
        result = number(shown) if strict else number_or_ratio(shown)
        if strict and result is None:
            continue
        args, signs = [], ""
        for literal, sign in TOKEN.findall(expr):
            if literal:
                args.append(float(literal))
            signs += sign
        steps.append((step_op(signs, strict), args, result))
    return linked(steps)


def linked(steps: list[tuple]) -> list[tuple]:
    """``op, refs, value`` of every node, from ``op, args, result`` of every step; of values only equality counts."""
    leaves: dict = {}
    for _, args, _ in steps:
        for a in args:
            leaves.setdefault(a, len(leaves))
    newest, made, first = dict(leaves), [], {}
    at = len(leaves)
    for op, args, result in steps:
        if op:
            made.append((op, [newest[a] for a in args], result))
            if result is not None:
                newest[result] = at
                first.setdefault(result, at)
            at += 1
    # a leaf that some step computes goes, and what referred to it refers to the first such step
    place, kept = {}, 0
    for v, i in leaves.items():
        if v not in first:
            place[i] = kept
            kept += 1
    gone = len(leaves) - kept
    moved = {i: first[v] - gone for v, i in leaves.items() if v in first} | place
    nodes = [("assign", [], v) for v, i in leaves.items() if i in place]
    return nodes + [(op, [moved.get(r, r - gone) for r in refs], v) for op, refs, v in made]


def judged(nodes: list | None, solution: str | None, strict: bool) -> tuple[float | None, str | None, list[float | None], int]:
    """The stated answer, what is wrong, all executed values and the edges on the longest path."""
    stated = ANSWER.search(solution or "")
    answer = number(stated[1]) if stated else None
    done: list[float | None] = []
    deep: list[int] = []
    ahead = False
    for i, (op, refs, v) in enumerate(nodes or ()):
        if op == "assign":
            done.append(v)
            deep.append(0)
            continue
        args, longest = [], 0
        for r in refs:
            if r < i:
                args.append(done[r])
                if deep[r] >= longest:
                    longest = deep[r] + 1
            else:
                args.append(None)
                ahead = True
        done.append(operated(op, args, not strict))
        deep.append(longest)
    depth = max(deep, default=0)
    if answer is None:
        return None, "no answer", done, depth
    if nodes is None:
        return answer, "no steps", done, depth
    if len(nodes) < 2:
        return answer, "too few nodes", done, depth
    if ahead:
        return answer, "forward reference", done, depth
    got = done[-1]
    if got is None:
        return answer, "answer differs", done, depth
    off = abs(got - answer)
    if strict:
        close = abs(got) < 0.01 if answer == 0 else off / max(abs(answer), 1e-300) < 0.01
    else:
        close = math.isnan(got) or off <= 0.01
    return answer, None if close else "answer differs", done, depth


def digits(values: np.ndarray) -> pa.Array:
    """Digits of the whole parts; null for what isn't finite or beyond 64 bits."""
    size = np.abs(values)
    found = np.searchsorted(POWERS, np.trunc(size), side="right") + 1
    for i in np.flatnonzero((size >= 1e15) & (size < 2.0**63)):  # a power of ten is exact up to there
        found[i] = len(str(int(size[i])))
    return pa.array(found.astype(np.int32), mask=~(size < 2.0**63))


#: Stands for a number in a text's shape; what stands for a number in a text; texts of a shape from which on they are read as arrays; characters of a number.
HOLE, DIGITS, LEAST, LONGEST = "\0", r"\d+(?:\.\d+)?", 16, 300


@lru_cache(4096)
def shape_plan(shape: str, strict: bool) -> tuple | None:
    """How texts of a shape are read, or None if one by one: the pattern of their numbers; steps ``op, args, result, signed``; the answer and whether it is signed.

    Args, results and answers are places among the numbers; a result that no
    number of the text makes is ``("fixed", value)``, a quotient ``("ratio", place, place)``.
    """
    before = [0]
    for c in shape:
        before.append(before[-1] + (c == HOLE))

    def number_at(start: int, end: int) -> tuple | None:
        text = shape[start:end]
        if HOLE not in text:
            return ("fixed", number(text) if strict or "/" not in text else number_or_ratio(text)), False
        if text == f"{HOLE}/{HOLE}":
            return (("fixed", None) if strict else ("ratio", before[start], before[start] + 1)), False
        return (before[start], text[0] == "-") if text in (HOLE, "-" + HOLE) else None

    steps = []
    for m in STEP.finditer(shape):
        found = number_at(*m.span(2))
        if found is None:
            return None
        if strict and found[0] == ("fixed", None):
            continue
        at, args, signs = before[m.start(1)], [], ""
        for c in m[1]:
            if c == HOLE:
                args.append(at)
                at += 1
            elif c in "+-*/%":
                signs += c
        steps.append((step_op(signs, strict), args, *found))
    stated = ANSWER.search(shape)
    answer = (("fixed", None), False)
    if stated:
        text = stated[1]
        answer = (("fixed", number(text)), False) if HOLE not in text else (before[stated.start(1)], text[0] == "-") if text in (HOLE, "-" + HOLE) else None
        if answer is None:
            return None
    pieces = shape.split(HOLE)
    pattern = "".join(re.escape(piece) + (f"(?P<n{i}>{DIGITS})" if i < len(pieces) - 1 else "") for i, piece in enumerate(pieces))
    return f"(?s)^{pattern}$", STEP.search(shape) is None, steps, answer


@lru_cache(65536)
def shape_graph(shape: str, strict: bool, same: tuple[int, ...]) -> tuple:
    """The nodes ``op, refs, place`` of texts of a shape whose numbers are equal as ``same`` says: the first of ``places`` that is equal to each."""
    _, absent, steps, _ = shape_plan(shape, strict)
    own = iter(same)
    args = [[next(own) for _ in step[1]] for step in steps]
    results = [next(own) for _ in steps]
    null = lambda r: isinstance(r, tuple) and r[1] is None
    nodes = linked([(op, a, None if null(result) else same_as) for (op, _, result, _), a, same_as in zip(steps, args, results, strict=True)])
    makers = [len(same) - len(steps) + i for i, (op, *_) in enumerate(steps) if op]
    n = len(nodes) - len(makers)
    return absent, tuple((op, tuple(refs), v if i < n else makers[i - n]) for i, (op, refs, v) in enumerate(nodes))


def operated_all(op: str, args: list[tuple[np.ndarray, np.ndarray | None]], lenient: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """:func:`operated` for many graphs: values, and which are None (no array: none is)."""
    if op in ("divide", "modulo"):
        args = args[:2]
    lost = None
    for _, none in args:
        if none is not None:
            lost = none if lost is None else lost | none
    if op in ("add", "subtract"):
        total = 0.0
        for a, _ in args:
            total = total + a
        return (total if op == "add" else args[0][0] - (total - args[0][0])), lost
    if op == "multiply":
        product = 1.0
        for a, _ in args:
            product = product * a
        return product, lost
    first, second = args[0][0], args[1][0]
    zero = second == 0
    ratio = np.divide(first, np.where(zero, 1.0, second))
    made = ratio if op == "divide" else first - second * np.floor(ratio)
    endless = None if op == "divide" else ~np.isfinite(ratio) & ~zero
    if lenient:
        made = np.where(zero, math.inf, made)
    elif zero.any():
        endless = zero if endless is None else endless | zero
    if endless is not None and endless.any():
        lost = endless if lost is None else lost | endless
    return made, lost


def judged_all(nodes: tuple, places: list[np.ndarray], answer: np.ndarray | None, absent: bool, strict: bool, n: int) -> tuple[np.ndarray, list, int]:
    """:func:`judged` for many texts of one graph: errors as places in :data:`ERRORS`, executed values and which are None, depth."""
    done, deep, ahead = [], [], False
    for i, (op, refs, at) in enumerate(nodes):
        if op == "assign":
            done.append((places[at], None))
            deep.append(0)
            continue
        later = [r >= i for r in refs]
        ahead |= any(later)
        # of divisions the first two operands count, the others may be missing
        missing = any(later[:2] if op in ("divide", "modulo") else later) or len(refs) < (2 if op in ("divide", "modulo") else 1 if op == "subtract" else 0)
        made = (np.zeros(n), np.ones(n, bool)) if missing else operated_all(op, [done[r] for r in (refs[:2] if op in ("divide", "modulo") else refs)], not strict)
        done.append((np.broadcast_to(made[0], n), made[1]))
        deep.append(max((deep[r] + 1 for r in refs if r < i), default=0))
    depth = max(deep, default=0)
    fixed = 1 if answer is None else 2 if absent else 3 if len(nodes) < 2 else 4 if ahead else 0
    if fixed:
        return np.full(n, fixed, np.int8), done, depth
    got, none = done[-1]
    off = np.abs(got - answer)
    if strict:
        close = np.where(answer == 0, np.abs(got) < 0.01, off / np.maximum(np.abs(answer), 1e-300) < 0.01)
    else:
        close = np.isnan(got) | (off <= 0.01)
    if none is not None:
        close &= ~none
    return np.where(close, 0, 5).astype(np.int8), done, depth


#: What operations and errors are called, by place.
OPS = ["assign", "add", "subtract", "multiply", "divide", "modulo"]
ERRORS = [None, "no answer", "no steps", "too few nodes", "forward reference", "answer differs"]


class _Block:
    """Graphs of texts that have one graph in common: rows of the batch, nodes, and arrays of values."""

    def __init__(self, rows, absent, nodes, values, answers, errors, done, depth):
        self.rows, self.absent, self.nodes, self.values, self.answers, self.errors, self.done, self.depth = rows, absent, nodes, values, answers, errors, done, depth


def _arrays_of(rows: list[list], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values as an array, and which are None."""
    values = np.array([[math.nan if v is None else v for v in row] for row in rows], float).reshape(len(rows), width)
    return values, np.array([[v is None for v in row] for row in rows], bool).reshape(len(rows), width)


@lru_cache(50_000)
def _read(text: str | None, strict: bool) -> tuple:
    nodes = read_graph(text, strict) if text is not None else None
    graph = nodes is None, tuple((op, tuple(refs), None) for op, refs, _ in nodes or ())
    return graph, [v for *_, v in nodes or ()], *judged(nodes, text, strict)


def _singles(rows: list[int], texts: list[str | None], strict: bool) -> list[_Block]:
    """The blocks of texts that are read one by one."""
    found: dict[tuple, list] = {}
    for row, text in zip(rows, texts, strict=True):
        graph, *rest = _read(text, strict)
        found.setdefault(graph, []).append((row, *rest))
    blocks = []
    for (absent, nodes), read in found.items():
        at, values, answers, errors, done, depth = zip(*read, strict=True)
        wide = len(nodes)
        blocks.append(_Block(np.array(at), absent, nodes, _arrays_of(values, wide), _arrays_of([[a] for a in answers], 1), np.array([ERRORS.index(e) for e in errors], np.int8), _arrays_of(done, wide), depth[0]))
    return blocks


def _many(rows: np.ndarray, texts: pa.Array, shape: str, strict: bool) -> list[_Block] | None:
    """The blocks of texts of one shape; None if they are to be read one by one."""
    plan = shape_plan(shape, strict)
    if plan is None:
        return None
    pattern, _, steps, (answer, negative) = plan
    columns = []
    if HOLE in shape:
        try:
            found = pc.extract_regex(texts, pattern)
        except pa.ArrowInvalid:  # a pattern too large
            return None
        if found.null_count or any((pc.max(pc.binary_length(c)).as_py() or 0) > LONGEST for c in found.flatten()):
            return None
        columns = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in found.flatten()]
    n = len(rows)

    def column(at, signed: bool) -> np.ndarray:
        if isinstance(at, tuple) and at[0] == "ratio":
            first, second = columns[at[1]], columns[at[2]]
            return np.where(second == 0, math.nan, first / np.where(second == 0, 1.0, second))
        if isinstance(at, tuple):
            return np.full(n, math.nan if at[1] is None else at[1])
        return -columns[at] if signed else columns[at]

    places = [column(a, False) for _, args, _, _ in steps for a in args] + [column(result, signed) for *_, result, signed in steps]
    same = np.tile(np.arange(len(places)), (n, 1))
    for j in range(1, len(places)):
        for i in range(j - 1, -1, -1):  # the first place that is equal stays; NaN equals nothing
            same[:, j] = np.where(places[i] == places[j], same[:, i], same[:, j])
    stated = None if isinstance(answer, tuple) and answer[1] is None else column(answer, negative)
    groups = [np.arange(n)]
    if places and (same != same[0]).any():
        m = len(places)
        keyed = {"return_inverse": True} if m**m < 1 << 62 else {"axis": 0, "return_inverse": True}
        of = np.unique(same if "axis" in keyed else same @ (m ** np.arange(m)), **keyed)[1].ravel()
        order = np.argsort(of, kind="stable")
        groups = np.split(order, np.flatnonzero(np.diff(of[order])) + 1)
    null_result = np.array([False] * (len(places) - len(steps)) + [isinstance(r, tuple) and r[1] is None for *_, r, _ in steps], bool)
    blocks = []
    for group in groups:
        m = len(group)
        absent, nodes = shape_graph(shape, strict, tuple(same[group[0]].tolist()))
        own = [p[group] for p in places] if len(groups) > 1 else places
        answers = None if stated is None else stated[group]
        with np.errstate(all="ignore"):
            errors, done, depth = judged_all(nodes, own, answers, absent, strict, m)
        at = [v for *_, v in nodes]
        stack = lambda arrays: np.stack(arrays, 1) if arrays else np.zeros((m, 0))  # noqa: B023, E731
        none = np.zeros(m, bool)
        blocks.append(_Block(
            rows[group], absent, nodes, (stack([own[v] for v in at]), np.tile(null_result[at], (m, 1)) if at else np.zeros((m, 0), bool)),
            (np.zeros((m, 1)), np.ones((m, 1), bool)) if answers is None else (answers[:, None], np.zeros((m, 1), bool)), errors,
            (stack([v for v, _ in done]), stack([none if lost is None else lost for _, lost in done]).astype(bool)), depth,
        ))
    return blocks


def _blocks(texts: pa.Array, strict: bool) -> list[_Block]:
    blocks, single = [], []
    shapes = pc.dictionary_encode(pc.replace_substring_regex(texts, DIGITS, HOLE))
    odd = pc.fill_null(pc.match_substring(texts, HOLE), True).to_numpy(zero_copy_only=False)
    codes = np.where(odd, -1, pc.fill_null(shapes.indices, -1).to_numpy(zero_copy_only=False))
    order = np.argsort(codes, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1) if len(order) else ():
        code = codes[rows[0]]
        found = _many(rows, texts.take(pa.array(rows)), shapes.dictionary[int(code)].as_py(), strict) if code >= 0 and len(rows) >= LEAST else None
        if found is None:
            single += rows.tolist()
        else:
            blocks += found
    return blocks + _singles(single, texts.take(pa.array(single, pa.int64())).to_pylist(), strict)


def parse_batch(solutions: pa.Array, strict: bool) -> pa.StructArray:
    """The graphs of a batch, written as flat buffers."""
    rows, blocks = len(solutions), _blocks(solutions, strict)
    counts, executed, depths, errors = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int32), np.zeros(rows, np.int8)
    absent, answers, no_answer = np.zeros(rows, bool), np.zeros(rows), np.zeros(rows, bool)
    for b in blocks:
        counts[b.rows], executed[b.rows], depths[b.rows], errors[b.rows], absent[b.rows] = len(b.nodes), b.done[0].shape[1], b.depth, b.errors, b.absent
        answers[b.rows], no_answer[b.rows] = b.answers[0][:, 0], b.answers[1][:, 0]
    ends, done_ends = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(executed)])
    ops, values, null = np.zeros(ends[-1], np.int8), np.zeros(ends[-1]), np.zeros(ends[-1], bool)
    done, none, n_refs = np.zeros(done_ends[-1]), np.zeros(done_ends[-1], bool), np.zeros(ends[-1], np.int64)
    for b in blocks:
        at = ends[b.rows][:, None] + np.arange(len(b.nodes))
        ops[at], values[at], null[at] = [OPS.index(op) for op, _, _ in b.nodes], *b.values
        n_refs[at] = [len(refs) for _, refs, _ in b.nodes]
        at = done_ends[b.rows][:, None] + np.arange(b.done[0].shape[1])
        done[at], none[at] = b.done
    ref_ends = np.concatenate([[0], np.cumsum(n_refs)])
    refs = np.zeros(ref_ends[-1], np.int32)
    for b in blocks:
        own = [r for _, to, _ in b.nodes for r in to]
        refs[ref_ends[ends[b.rows]][:, None] + np.arange(len(own))] = own
    offsets = lambda x: pa.array(x.astype(np.int32))
    named = pa.DictionaryArray.from_arrays(pa.array(ops), pa.array(OPS)).cast(pa.string())
    node = pa.StructArray.from_arrays([named, pa.ListArray.from_arrays(offsets(ref_ends), pa.array(refs)), pa.array(values, mask=null), digits(np.where(null, math.nan, values))], fields=list(NODE))
    graphs = pa.ListArray.from_arrays(offsets(ends), node, mask=pa.array(absent))
    called = pa.DictionaryArray.from_arrays(pa.array(np.maximum(errors - 1, 0), mask=errors == 0), pa.array(ERRORS[1:])).cast(pa.string())
    done_lists = pa.ListArray.from_arrays(offsets(done_ends), pa.array(done, mask=none))
    return pa.StructArray.from_arrays([graphs, pa.array(answers, mask=no_answer), pa.array(errors == 0), called, done_lists, pa.array(depths)], fields=list(GRAPH))


#: The same for texts as lists, script and strict: what repeats is read once in a worker.
PARSED = {strict: Memo(lambda texts, strict=strict: parse_batch(pa.array(texts, pa.string()), strict)) for strict in (False, True)}
