"""Column builders: reading answers from text, and comparing them.

Three extractors and three matchers exist side by side, because published
results depend on which was used.  None is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a decimal literal may look like: keeps type suffixes such as ``1d`` from being cast.
NUMERIC = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"
NOT_FINITE = r"^\s*[-+]?(nan|inf|infinity)\s*$"


def to_number(text: Column) -> Column:
    """A double, or null for what isn't a plain decimal literal."""
    return F.when(text.rlike(NUMERIC), F.trim(text).try_cast("double"))


def last_of(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def _clean(s: Column) -> Column:
    return F.regexp_replace(F.translate(s, ",$€\\{}", ""), r"\.+$", "")


def extract_last(text: Column) -> Column:
    r"""The answer in a model's text: the last ``\boxed{}``, else the last ``####`` number, else the last number of the final 200 characters.

    A box or mark that says NaN or infinity gives null at once; one that can't
    be read passes on to the next rule.  Null and empty texts give null.
    """
    boxed = _clean(last_of(text, r"\\boxed\{([^}]*)\}", 1))
    marked = _clean(last_of(text, r"####\s*([-+]?\d[\d,]*\.?\d*)", 1))
    tail = F.translate(last_of(F.right(text, F.lit(200)), r"[-+]?\d[\d,]*\.?\d*", 0), ",", "")
    odd = F.lower(F.coalesce(boxed, F.lit(""))).rlike(NOT_FINITE)
    return F.when(odd, F.lit(None).cast("double")).otherwise(F.coalesce(to_number(boxed), to_number(marked), to_number(tail)))


def extract_unsigned(text: Column) -> Column:
    r"""A laxer extractor: ``\boxed{}`` up to the first brace, any digits after ``####``, else the last unsigned number of the whole text."""
    boxed = F.translate(last_of(text, r"\\boxed\{([^}]+)\}", 1), ",$", "")
    marked = F.translate(last_of(text, r"####\s*([\d,.\-]+)", 1), ",", "")
    anywhere = F.translate(last_of(text, r"[\d,]+(?:\.\d+)?", 0), ",", "")
    return F.coalesce(to_number(boxed), to_number(marked), to_number(anywhere))


def extract_lenient(text: Column) -> Column:
    """:func:`extract_last` without the euro sign, and with NaN passing as a value."""
    boxed = F.regexp_replace(F.translate(last_of(text, r"\\boxed\{([^}]*)\}", 1), ",$\\{}", ""), r"\.+$", "")
    nan = F.when(F.lower(boxed).rlike(r"^\s*[-+]?nan\s*$"), F.lit(float("nan")))
    marked = F.regexp_replace(F.translate(last_of(text, r"####\s*([-+]?\d[\d,]*\.?\d*)", 1), ",$\\{}", ""), r"\.+$", "")
    tail = F.translate(last_of(F.right(text, F.lit(200)), r"[-+]?\d[\d,]*\.?\d*", 0), ",", "")
    return F.coalesce(to_number(boxed), nan, to_number(marked), to_number(tail))


def stated_answer(solution: Column) -> Column:
    """The number after the first ``####`` of an annotated solution."""
    return to_number(F.translate(F.regexp_extract(solution, r"####\s*([^\r\n]+)", 1), ",$€", ""))


def number_or_ratio(text: Column) -> Column:
    """A number, or the quotient of two around one slash; NaN where that fails."""
    plain = F.translate(text, ",$€", "")
    parts = F.split(plain, "/")
    ratio = F.try_divide(to_number(F.element_at(parts, 1)), to_number(F.try_element_at(parts, F.lit(2))))
    return F.when(F.contains(plain, F.lit("/")), F.coalesce(ratio, F.lit(float("nan")))).otherwise(to_number(plain))


def _relative(got: Column, want: Column, floor: float) -> Column:
    return F.abs(got - want) / F.greatest(F.abs(want), F.lit(floor))


def matches_report(got: Column, want: Column, tol: float = 0.01) -> Column:
    """Within a relative tolerance, or an absolute one where zero is expected; a missing answer is wrong."""
    return F.coalesce(F.when(want == 0, F.abs(got) < tol).otherwise(_relative(got, want, 1e-10) < tol), F.lit(False))


def matches_audit(got: Column, want: Column, tol: float = 0.01) -> Column:
    """As :func:`matches_report`, but a zero is matched within .01 whatever the tolerance."""
    return F.coalesce(F.when(want == 0, F.abs(got) < 0.01).otherwise(_relative(got, want, 1e-9) < tol), F.lit(False))


def matches_table(got: Column, want: Column, tol: float = 0.01) -> Column:
    """With the bound itself allowed, in both branches."""
    return F.coalesce(F.when(want == 0, F.abs(got) <= tol).otherwise(_relative(got, want, 1e-9) <= tol), F.lit(False))


def matches_parsed(got: Column, want: Column, tol: float = 0.01) -> Column:
    """Relative to the expected value itself."""
    return F.coalesce(F.when(want == 0, F.abs(got) < tol).otherwise(F.abs(got - want) / F.abs(want) < tol), F.lit(False))


def verifies(got: Column, want: Column, tolerance: float = 1e-6) -> Column:
    """An absolute tolerance, for a verification function's numeric answer."""
    return F.coalesce(F.abs(got - want) < tolerance, F.lit(False))


def agrees_within(got: Column, want: Column, bound: float = 0.01) -> Column:
    """Not off by more than ``bound``; NaN is not off, as no comparison with it holds."""
    return F.when(F.isnan(got) | F.isnan(want), F.lit(True)).otherwise(F.abs(got - want) <= bound)


def same_category(got: Column, want: Column) -> Column:
    return F.coalesce(F.lower(F.trim(got)) == F.lower(F.trim(want)), F.lit(False))


def correct_now(extracted: Column, expected: Column, stored: Column, has_extracted: Column) -> Column:
    """Judged anew where the response carries an extracted value (null included), else as stored."""
    return F.when(has_extracted, matches_table(extracted, expected)).otherwise(F.coalesce(stored, F.lit(False)))


def number_text(v: Column) -> Column:
    """Integral values without a decimal point, others as they print."""
    return F.when(v == F.floor(v), v.try_cast("bigint").cast("string")).otherwise(v.cast("string"))


def digit_class(v: Column) -> Column:
    """Digits of the whole part; null for what isn't finite or beyond 64 bits."""
    return F.length(F.abs(v.try_cast("bigint")).cast("string"))


def whole_digits(v: Column) -> Column:
    """Digits of the whole part of a double of any size; from 1e15 on by its decimal text, null for infinity."""
    size = F.abs(v)
    return F.when(size < 1e15, digit_class(F.when(size < 1e15, v))).when(size < float("inf"), F.length(F.format_string("%.0f", size)))


def magnitude(v: Column) -> Column:
    return F.log10(F.abs(v) + 1)


def sigmoid(x: Column, clip: float = 30.0) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-clip), F.least(F.lit(clip), x))))


def logit(p: Column, clip: float = 1e-10) -> Column:
    """Log odds of a probability, kept away from 0 and 1."""
    kept = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), p))
    return F.log(kept / (1 - kept))
