"""Which leaves of a problem may change: a small reader of one question, on Arrow batches.

``variants.roles`` is the Column that calls it and states the rules.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa

#: Numbers that usually are conversion factors; phrases after, and words before, a number that is one; characters in which they must stand.
KNOWN_CONSTANTS = [0, 1, 2, 3, 4, 7, 10, 12, 16, 24, 52, 60, 100, 365, 1000]
CONVERSIONS_AFTER = [
    "per hour", "per minute", "per day", "per week", "per month", "per year", "percent", "%", "minutes in", "hours in", "days in", "out of", "in a dozen", "in a foot",
    "in a pound", "in a kilogram", "in a meter",
]
CONVERSIONS_BEFORE, NEAR = ["every ", "each "], 20

KNOWN = frozenset(KNOWN_CONSTANTS)
NUMBER = re.compile(r"\b[0-9]+(?:\.[0-9]+)?\b")
AFTER = re.compile("|".join(map(re.escape, CONVERSIONS_AFTER)), re.IGNORECASE | re.ASCII)
BEFORE = re.compile("|".join(CONVERSIONS_BEFORE), re.IGNORECASE | re.ASCII)
ROLES = pa.list_(pa.struct([("value", pa.float64()), ("role", pa.string())]))


def factors(question: str) -> set[float]:
    """The known constants that stand in a conversion's context, as ``text.conversion_values`` has them."""
    found = set()
    if not AFTER.search(question) and not BEFORE.search(question):
        return found
    for m in NUMBER.finditer(question):
        start, end = m.span()
        if start and (question[start - 1] == "." or question[start - 1] in "0123456789"):
            continue
        if int(value := float(m[0])) in KNOWN and (BEFORE.search(question, max(0, start - NEAR), start) or AFTER.search(question, end, end + NEAR)):
            found.add(value)
    return found


def movable(values: list[float | None], texts: list[str | None], question: str | None) -> list[bool]:
    """Of each leaf, whether its value may change; ``texts`` are the values as texts show them."""
    shown = NUMBER.findall(question) if question is not None else None
    numbers = [float(s) for s in shown or ()]
    free: list[bool] = []
    for v, text in zip(values, texts, strict=True):
        same = values.count(v)
        constant = (
            (question is not None and text is not None and text not in question)
            or (v in KNOWN and (same > 1 or (shown is not None and numbers.count(v) * 2 > same)))
            or (shown is not None and text is not None and shown.count(text) >= 2)
        )
        free.append(not constant)
    if question is None:
        return free
    if not any(free):
        once = [v for v, text in zip(values, texts, strict=True) if v is not None and abs(v) > 1 and shown.count(text) == 1]
        if once:
            largest = max(once)
            free = [v == largest for v in values]
    if not any(f and v is not None and math.isfinite(v) and int(v) in KNOWN for f, v in zip(free, values, strict=True)):
        return free  # no factor could be among them
    guarded = factors(question)
    return [f and v not in guarded for f, v in zip(free, values, strict=True)] if guarded else free


def roles_of(leaves: pa.ListArray, questions: pa.Array) -> pa.Array:
    """The roles of a batch: ``array<struct<value, role>>`` for leaves that are ``array<struct<value, text>>``; null for null leaves."""
    flat, ends, absent = leaves.flatten(), [0], leaves.is_null()
    values, texts, roles = flat.field("value").to_pylist(), flat.field("text").to_pylist(), []
    at = 0
    for n, question in zip(leaves.value_lengths().to_pylist(), questions.to_pylist(), strict=True):
        n = n or 0
        roles += ["VARIABLE" if f else "CONSTANT" for f in movable(values[at : at + n], texts[at : at + n], question)]
        at += n
        ends.append(at)
    each = pa.StructArray.from_arrays([flat.field("value"), pa.array(roles, pa.string())], fields=list(ROLES.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each, mask=absent)
