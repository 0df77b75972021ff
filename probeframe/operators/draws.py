"""Roles, draws and texts of variants for many problems at once, on Arrow batches.

Problems of a batch whose graphs have one shape and whose questions differ in
their numbers alone are handled as arrays, by the rules of the readers of one
problem (``leaf_roles.movable``, ``variants.sampled``, ``variants.variant_text``);
rarer or odd problems go through those readers themselves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from probeframe.functions.graph_parser import DIGITS, HOLE
from probeframe.functions.leaf_roles import AFTER, BEFORE, KNOWN_CONSTANTS, movable

GOLDEN, FIRST, SECOND, WORD = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, (1 << 64) - 1
#: Problems of one kind from which on they are arrays; whole numbers that doubles hold; a start that no number reaches.
LEAST, WHOLE, NEVER = 8, 1e15, 1 << 60
#: Numbers that readers of texts and the cut of a text into holes might see differently: beside letters, points or each other.
ODD = re.compile(r"[\w.]\0|\0\w|\0\.[0-9]|\0\0")
KNOWN = np.array(KNOWN_CONSTANTS, float)
#: The known constants of as many digits, by digits; one digit means 2 to 9.
OF_DIGITS = np.full((17, 6), NEVER, np.int64)
for _d in range(1, 5):
    _own = [c for c in KNOWN_CONSTANTS if (2 <= c <= 9 if _d == 1 else len(str(c)) == _d)]
    OF_DIGITS[_d, : len(_own)] = _own


def key_of(seed: str) -> int:
    return int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big")


def _mixed(x):
    """The finalizer of splitmix64, of a Python integer or of an array of 64-bit words."""
    if isinstance(x, int):
        x = (x ^ x >> 30) * FIRST & WORD
        x = (x ^ x >> 27) * SECOND & WORD
        return x ^ x >> 31
    x = (x ^ x >> np.uint64(30)) * np.uint64(FIRST)
    x = (x ^ x >> np.uint64(27)) * np.uint64(SECOND)
    return x ^ x >> np.uint64(31)


class Words:
    """The generator of one attempt (splitmix64): a word of 64 bits for each draw."""

    def __init__(self, key: int, attempt: int):
        self.state = _mixed(key + GOLDEN * (attempt + 1) & WORD)

    def randrange(self, n: int) -> int:
        self.state = self.state + GOLDEN & WORD
        return _mixed(self.state) % n


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[ends[1:]] - total[ends[:-1]]


def _ends(lengths: pa.Array) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths.fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)


class Graphs:
    """The graphs of a batch as flat arrays, and one by one."""

    def __init__(self, nodes: pa.ListArray):
        flat = nodes.flatten()
        ops, refs = flat.field("op").dictionary_encode(), flat.field("refs")
        self.ends, self.names = _ends(nodes.value_lengths()), ops.dictionary.to_pylist()
        self.ops = ops.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.values = flat.field("value").to_numpy(zero_copy_only=False).astype(float)
        self.null_value = flat.field("value").is_null().to_numpy(zero_copy_only=False)
        self.ref_ends, self.refs = _ends(refs.value_lengths()), refs.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        self.lost = (self.ops < 0) | refs.is_null().to_numpy(zero_copy_only=False)

    def one(self, row: int) -> tuple[list[str], list[list[int]], list[float | None]]:
        at = range(self.ends[row], self.ends[row + 1])
        return (
            [self.names[self.ops[i]] if self.ops[i] >= 0 else None for i in at], [self.refs[self.ref_ends[i] : self.ref_ends[i + 1]].tolist() for i in at],
            [None if self.null_value[i] else float(self.values[i]) for i in at],
        )

    def by_shape(self) -> Iterator[np.ndarray]:
        """Rows whose operations and references are equal; rows that can't be arrays are in none."""
        word = lambda x: x.astype(np.uint64)
        place = lambda ends: np.arange(ends[-1]) - np.repeat(ends[:-1], np.diff(ends))
        to = _sums(_mixed(word(self.refs * 1024 + place(self.ref_ends) + 1)), self.ref_ends)
        node = _mixed(word(self.ops * 1024 + np.diff(self.ref_ends) + 1) + to)
        row = _sums(_mixed(node + word(place(self.ends)) * np.uint64(GOLDEN)), self.ends)
        n = np.diff(self.ends)
        fit = (n > 0) & (_sums(word(self.lost), self.ends) == 0)
        rows = np.flatnonzero(fit)
        order = rows[np.argsort(row[rows], kind="stable")]
        for same in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else ():
            same = same[n[same] == n[same[0]]]
            at = self.ends[same][:, None] + np.arange(n[same[0]])
            equal = (self.ops[at] == self.ops[at[0]]).all(1) & (np.diff(self.ref_ends)[at] == np.diff(self.ref_ends)[at[0]]).all(1)
            same, at = same[equal], at[equal]
            k = self.ref_ends[at[0, -1] + 1] - self.ref_ends[at[0, 0]]
            refs = self.refs[self.ref_ends[at[:, 0]][:, None] + np.arange(k)]
            yield same[(refs == refs[0]).all(1)]


def _executable(ops: list[str], refs: list[list[int]]) -> bool:
    least = {"add": 1, "subtract": 1, "multiply": 1, "divide": 2, "modulo": 2}
    return all(op == "assign" or (op in least and len(to) >= least[op] and all(0 <= r < i for r in to)) for i, (op, to) in enumerate(zip(ops, refs, strict=True)))


def _run(ops: list[str], refs: list[list[int]], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last node's value, and whether every computed one is whole, not negative and 1e8 at most, as in ``variants.run_checked``."""
    done, good = [], np.ones(len(values), bool)
    for i, op in enumerate(ops):
        if op == "assign":
            done.append(values[:, i])
            continue
        args = [done[r] for r in refs[i]]
        if op in ("divide", "modulo"):
            good &= args[1] != 0
            got = args[0] / args[1] if op == "divide" else np.mod(args[0], args[1])
        elif op == "multiply":
            got = np.prod(args, axis=0)
        else:
            got = np.sum(args, axis=0) if op == "add" else args[0] - np.sum(args[1:], axis=0) if len(args) > 1 else args[0]
        good &= (got >= 0) & (got <= 1e8) & (got == np.floor(got))
        done.append(got)
    return done[-1], good


class _Allowed:
    """For the values of one leaf what ``variants.draw_like`` may draw: the range, what is too near, and known constants in it."""

    def __init__(self, values: np.ndarray):
        size = np.abs(values).astype(np.int64)
        digits = np.searchsorted(10 ** np.arange(1, 16), size, side="right") + 1
        self.low, self.high = np.where(digits == 1, 2, 10 ** (digits - 1)), np.where(digits == 1, 9, 10**digits - 1)
        away = np.maximum(1, (np.abs(values) * 0.2).astype(np.int64))
        self.near, self.until = np.maximum(self.low, size - away + 1), np.minimum(self.high, size + away - 1)
        known = OF_DIGITS[digits]
        self.known = np.where((known >= self.near[:, None]) & (known <= self.until[:, None]), NEVER, known)
        self.width = np.maximum(0, self.until - self.near + 1)
        self.count = self.high - self.low + 1 - self.width - (self.known < NEVER).sum(1)
        self.negative = values < 0

    def drawn(self, at: np.ndarray, used: list[tuple[np.ndarray, np.ndarray]], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers for the rows ``at``, and whether there are any to draw from; ``used`` are numbers that are taken, and where they are."""
        low, high, near, until, width = (x[at] for x in (self.low, self.high, self.near, self.until, self.width))
        points: list[np.ndarray] = []
        for c, there in used:
            own = there & (c >= low) & (c <= high) & ~((c >= near) & (c <= until)) & ~np.isin(c, KNOWN_CONSTANTS)
            for before in points:
                own &= before != c
            points.append(np.where(own, c, NEVER))
        count = self.count[at] - sum((p < NEVER).astype(np.int64) for p in points)
        c = low + (words % np.maximum(count, 1).astype(np.uint64)).astype(np.int64)
        starts = np.sort(np.column_stack([self.known[at], *points, np.where(width > 0, near, NEVER)]), axis=1)
        for j in range(starts.shape[1]):
            c += np.where(c >= starts[:, j], np.where((starts[:, j] == near) & (width > 0), width, 1), 0)
        return c, count > 0


def sampled_all(ops: list[str], refs: list[list[int]], values: np.ndarray, free: np.ndarray, answers: np.ndarray, keys: np.ndarray, attempts: int, ratio: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``variants.sampled`` for many variants of graphs of one shape with whole leaves: attempts (-1 for none), values, answers."""
    leaves = [i for i, op in enumerate(ops) if op == "assign"]
    rules = {i: _Allowed(values[:, i]) for i in leaves}
    found, new, made = np.full(len(values), -1), values.copy(), np.zeros(len(values))
    left = np.arange(len(values))
    for attempt in range(attempts):
        if not len(left):
            break
        v, may, good = values[left], free[left], np.ones(len(left), bool)
        state = _mixed(keys[left] + np.uint64(GOLDEN * (attempt + 1) & WORD))
        used = [(np.abs(v[:, i]).astype(np.int64), ~may[:, i]) for i in leaves if not may[:, i].all()]
        for i in leaves:
            own = may[:, i]
            if not own.any():
                continue
            state = np.where(own, state + np.uint64(GOLDEN), state)
            c, any_left = rules[i].drawn(left, used, _mixed(state))
            good &= any_left | ~own
            v[:, i] = np.where(own, np.where(rules[i].negative[left], -c, c), v[:, i])
            used.append((c, own))
        got, sound = _run(ops, refs, v)
        close = np.abs(got) / np.abs(answers[left])
        good &= sound & ((answers[left] == 0) | ((close >= 1 / ratio) & (close <= ratio)))
        at = left[good]
        found[at], new[at], made[at] = attempt, v[good], got[good]
        left = left[~good]
    return found, new, made


@lru_cache(4096)
def _swapped_pieces(shape: str, k: int) -> list[str]:
    from probeframe.operators.variants import variant_text

    return variant_text(shape, {}, k).split(HOLE)


class Questions:
    """The questions of a batch: the shape of each (-1 for odd ones), and the numbers of those of one shape."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        shapes = pc.dictionary_encode(pc.replace_substring_regex(texts, DIGITS, HOLE))
        self.shapes = shapes.dictionary.to_pylist()
        odd = pc.fill_null(pc.match_substring(texts, HOLE), True).to_numpy(zero_copy_only=False)
        codes = np.where(odd, -1, pc.fill_null(shapes.indices, -1).to_numpy(zero_copy_only=False))
        unfit = np.array([bool(ODD.search(s)) for s in self.shapes] + [True], bool)
        self.codes = np.where(unfit[codes], -1, codes)

    def numbers(self, rows: np.ndarray, shape: str) -> tuple[list[pa.Array], np.ndarray] | None:
        """The numbers of rows of one shape, as texts and as values."""
        pieces = shape.split(HOLE)
        pattern = "".join(re.escape(p) + (f"(?P<n{i}>{DIGITS})" if i < len(pieces) - 1 else "") for i, p in enumerate(pieces))
        if len(pieces) == 1:
            return [], np.zeros((len(rows), 0))
        try:
            found = pc.extract_regex(self.texts.take(pa.array(rows)), f"(?s)^{pattern}$")
        except pa.ArrowInvalid:  # a pattern too large
            return None
        if found.null_count:
            return None
        shown = found.flatten()
        return shown, np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in shown])


def _roles(leaves: np.ndarray, texts: list[pa.Array], numbers: np.ndarray, shape: str) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Which leaves may change, which rows must be read one by one, and for each leaf where its number stands."""
    whole = np.where(numbers < WHOLE, numbers, 0).astype(np.int64)
    plain = [pc.equal(t, pa.array(whole[:, j]).cast(pa.string())).to_numpy(zero_copy_only=False) & (numbers[:, j] < WHOLE) for j, t in enumerate(texts)]
    plain = np.column_stack(plain) if plain else np.zeros(numbers.shape, bool)
    equal = [numbers == leaves[:, i : i + 1] for i in range(leaves.shape[1])]
    places = [e & plain for e in equal]
    times = np.column_stack([p.sum(1) for p in places])
    same = np.column_stack([(leaves == leaves[:, i : i + 1]).sum(1) for i in range(leaves.shape[1])])
    known = np.isin(leaves, KNOWN)
    free = ~((known & ((same > 1) | (np.column_stack([e.sum(1) for e in equal]) * 2 > same))) | (times >= 2))
    # a number that only stands inside of another one, and leaves of equal values, are for the reader of one problem
    odd = (times == 0).any(1) | (same > 1).any(1)
    none = ~free.any(1)
    largest = np.where((np.abs(leaves) > 1) & (times == 1), leaves, -np.inf).max(1)
    free = np.where((none & (largest > -np.inf))[:, None], leaves == largest[:, None], free)
    if AFTER.search(shape) or BEFORE.search(shape):
        odd |= (free & known).any(1)
    return free, odd, places


class Made:
    """Of a batch: which problems have a leaf that may change and which one that their question lacks; and its variants, as parts ``rows, ks, attempts, values (flat), sizes, answers, texts``."""

    def __init__(self, n: int):
        self.movable, self.phantom, self.parts = np.zeros(n, bool), np.zeros(n, bool), []

    def add(self, rows, ks, attempts, values, sizes, answers, texts) -> None:
        self.parts.append((rows, ks, attempts, values, sizes, answers, texts))

    def joined(self) -> tuple:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0), np.zeros(0, np.int64), np.zeros(0), pa.array([], pa.string()))
        *numbers, texts = zip(*self.parts, strict=True)
        return *(np.concatenate(x) for x in numbers), pa.concat_arrays(list(texts))

    def lists(self) -> tuple:
        """The same with values as an array of lists."""
        rows, ks, attempts, values, sizes, answers, texts = self.joined()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return rows, pa.array(ks.astype(np.int32)), pa.array(attempts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(ends), pa.array(values)), pa.array(answers), texts


def made_of(batch: pa.RecordBatch, variants: int, attempts: int) -> Made:
    """The variants of a batch ``pid, question, nodes, answer, shown``; ``shown`` are the values as texts, null where all leaves are whole."""
    from probeframe.operators import variants as single

    graphs, questions, made = Graphs(batch.column("nodes")), Questions(batch.column("question")), Made(len(batch))
    pids, answers = batch.column("pid").to_pylist(), batch.column("answer").to_numpy(zero_copy_only=False)
    alone = np.ones(len(batch), bool)
    with np.errstate(all="ignore"):
        for same in graphs.by_shape():
            ops, refs, _ = graphs.one(int(same[0]))
            leaves = [i for i, op in enumerate(ops) if op == "assign"]
            if not leaves or not _executable(ops, refs) or len(same) < LEAST:
                continue
            values = graphs.values[graphs.ends[same][:, None] + np.arange(len(ops))]
            own = values[:, leaves]
            fit = ((own == np.floor(own)) & (np.abs(own) < WHOLE)).all(1) & ~np.isnan(values).any(1) & (questions.codes[same] >= 0)
            same, values = same[fit], values[fit]
            order = np.argsort(questions.codes[same], kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(questions.codes[same][order])) + 1) if len(order) else ():
                rows, shape = same[at], questions.shapes[questions.codes[same[at[0]]]]
                found = questions.numbers(rows, shape) if len(rows) >= LEAST else None
                if found is None:
                    continue
                texts, numbers = found
                free, odd, places = _roles(values[at][:, leaves], texts, numbers, shape)
                fine = np.flatnonzero(~odd)
                alone[rows[fine]] = False
                made.movable[rows] = free.any(1)
                fine = fine[free[fine].any(1)]
                if not len(fine):
                    continue
                every = np.zeros((len(fine), len(ops)), bool)
                every[:, leaves] = free[fine]
                of = np.tile(np.arange(len(fine)), variants)
                ks = np.repeat(np.arange(variants), len(fine))
                keys = np.array([key_of(f"{pids[r]}|{k}") for k in range(variants) for r in rows[fine].tolist()], np.uint64)
                hit, new, results = sampled_all(ops, refs, values[at][fine][of], every[of], answers[rows[fine]][of], keys, attempts, single.RATIO)
                for k in range(variants):
                    some = np.flatnonzero((ks == k) & (hit >= 0))
                    if not len(some):
                        continue
                    mine = fine[of[some]]
                    made_texts = _texts(_swapped_pieces(shape, k), [t.take(pa.array(mine)) for t in texts], [p[mine] for p in places], free[mine], new[some][:, leaves])
                    old = questions.texts.take(pa.array(rows[mine]))
                    differ = pc.not_equal(pc.utf8_trim(made_texts, " "), pc.utf8_trim(old, " ")).to_numpy(zero_copy_only=False)
                    keep = some[differ]
                    made.add(rows[mine][differ], np.full(len(keep), k), hit[keep], new[keep].ravel(), np.full(len(keep), len(ops)), results[keep], made_texts.filter(pa.array(differ)))
    left = np.flatnonzero(alone)
    if len(left):
        _one_by_one(left, graphs, batch, pids, made, variants, attempts)
    return made


def _texts(pieces: list[str], shown: list[pa.Array], places: list[np.ndarray], free: np.ndarray, new: np.ndarray) -> pa.Array:
    """Questions of one shape with the free leaves' new numbers, each where the old one stands first."""
    columns = list(shown)
    for i, place in enumerate(places):
        fresh = pa.array(new[:, i].astype(np.int64)).cast(pa.string())
        first = place & (np.cumsum(place, axis=1) == 1) & free[:, i : i + 1]
        for j in np.flatnonzero(first.any(0)).tolist():
            columns[j] = pc.if_else(pa.array(first[:, j]), fresh, columns[j])
    parts = [pa.scalar(pieces[0])]
    for column, piece in zip(columns, pieces[1:], strict=True):
        parts += [column, pa.scalar(piece)]
    return pc.binary_join_element_wise(*parts, "") if columns else pa.array(pieces * len(free), pa.string())


def _one_by_one(left: np.ndarray, graphs: Graphs, batch: pa.RecordBatch, pids: list, made: Made, variants: int, attempts: int) -> None:
    from probeframe.operators import variants as single

    parts = [batch.column(c).take(pa.array(left)).to_pylist() for c in ("question", "answer", "shown")]
    out: list[tuple] = []
    for row, question, answer, shown in zip(left.tolist(), *parts, strict=True):
        ops, refs, values = graphs.one(row)
        texts = shown if shown is not None else [None if v is None or v != v else single.whole_text(v) for v in values]
        own = [i for i, op in enumerate(ops) if op == "assign"]
        may = movable([values[i] for i in own], [texts[i] for i in own], question)
        made.movable[row] = any(may)
        made.phantom[row] = question is not None and any(texts[i] is not None and texts[i] not in question for i in own)
        if question is None or not any(may) or any(v is None or v != v for v in values):
            continue
        moves = {values[i] for i, m in zip(own, may, strict=True) if m}
        free = [op == "assign" and v in moves for op, v in zip(ops, values, strict=True)]
        for k in range(variants):
            found = single.sampled(ops, refs, values, free, answer, f"{pids[row]}|{k}", attempts)
            text = found and single.variant_text(question, single.leaf_changes(ops, texts, found[1]), k)
            if found and text.strip(" ") != question.strip(" "):
                out.append((row, k, *found, text))
    if out:
        rows, ks, hits, new, answers, texts = zip(*out, strict=True)
        sizes = np.array([len(v) for v in new])
        made.add(np.array(rows), np.array(ks), np.array(hits), np.concatenate(new), sizes, np.array(answers, float), pa.array(texts, pa.string()))


#: What :func:`drawn_lists` makes of a row.
DRAWN = pa.struct([("k", pa.int32()), ("attempt", pa.int32()), ("values", pa.list_(pa.float64())), ("answer", pa.float64())])


def drawn_lists(pids: pa.Array, nodes: pa.ListArray, free: pa.ListArray, answers: pa.Array, variants: pa.Array, attempts: pa.Array) -> pa.ListArray:
    """``array<struct<k, attempt, values, answer>>``: the variants that ``variants.sampled`` draws for each row; none for null arguments."""
    from probeframe.operators import variants as single

    graphs, ids, free_ends = Graphs(nodes), pids.to_pylist(), _ends(free.value_lengths())
    may = free.flatten().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
    wanted, tries = (x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (variants, attempts))
    stated = answers.to_numpy(zero_copy_only=False).astype(float)
    fit = (np.diff(graphs.ends) == np.diff(free_ends)) & (wanted > 0)
    for column in (pids, nodes, free, answers):
        fit &= ~column.is_null().to_numpy(zero_copy_only=False)
    alone, made = fit.copy(), Made(len(pids))
    none = lambda n: pa.nulls(n, pa.string())
    with np.errstate(all="ignore"):
        for same in graphs.by_shape():
            ops, refs, _ = graphs.one(int(same[0]))
            leaves = [i for i, op in enumerate(ops) if op == "assign"]
            if not leaves or not _executable(ops, refs):
                continue
            values = graphs.values[graphs.ends[same][:, None] + np.arange(len(ops))]
            own = values[:, leaves]
            good = fit[same] & ((own == np.floor(own)) & (np.abs(own) < WHOLE)).all(1)
            same, values = same[good], values[good]
            for n, m in {(int(wanted[r]), int(tries[r])) for r in same}:
                at = np.flatnonzero((wanted[same] == n) & (tries[same] == m))
                if len(at) < LEAST:
                    continue
                rows = same[at]
                alone[rows] = False
                every = may[free_ends[rows][:, None] + np.arange(len(ops))] & np.array([op == "assign" for op in ops])
                of, ks = np.tile(np.arange(len(rows)), n), np.repeat(np.arange(n), len(rows))
                keys = np.array([key_of(f"{ids[r]}|{k}") for k in range(n) for r in rows.tolist()], np.uint64)
                hit, new, results = sampled_all(ops, refs, values[at][of], every[of], stated[rows][of], keys, m, single.RATIO)
                some = np.flatnonzero(hit >= 0)
                made.add(rows[of[some]], ks[some], hit[some], new[some].ravel(), np.full(len(some), len(ops)), results[some], none(len(some)))
    for row in np.flatnonzero(alone).tolist():
        own = may[free_ends[row] : free_ends[row + 1]].tolist()
        for k in range(wanted[row]):
            found = single.sampled(*graphs.one(row), own, stated[row], f"{ids[row]}|{k}", int(tries[row]))
            if found:
                made.add(np.array([row]), np.array([k]), np.array([found[0]]), np.array(found[1], float), np.array([len(found[1])]), np.array([found[2]], float), none(1))
    rows, ks, hits, new, results, _ = made.lists()
    order = pa.array(np.lexsort((ks.to_numpy(), rows)))
    each = pa.StructArray.from_arrays([x.take(order) for x in (ks, hits, new, results)], fields=list(DRAWN))
    ends = np.concatenate([[0], np.cumsum(np.bincount(rows.astype(np.int64), minlength=len(pids)))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), each)
