"""Column builders over question texts: words, names, numbers, replacements."""

from __future__ import annotations

from functools import cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from probeframe.functions import names
from probeframe.functions.leaf_roles import CONVERSIONS_AFTER, CONVERSIONS_BEFORE, KNOWN_CONSTANTS, NEAR
from probeframe.functions.names import COMMON, LETTER, NUMBER_WORDS, WORD  # noqa: F401


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def audit_numbers(text: Column) -> Column:
    """Numbers with an optional sign, as doubles."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"-?\d+\.?\d*"), F.lit(0)), lambda t: t.try_cast("double"))


def whole_numbers(text: Column) -> Column:
    """Unsigned number texts that stand between word borders."""
    return F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0))


def grouped_numbers(text: Column) -> Column:
    """Numbers with thousands separators that don't follow a letter; separators go."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])[-+]?\d+(?:,\d{3})*(?:\.\d+)?"), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def quoted(literal: Column) -> Column:
    """A pattern that matches exactly ``literal``."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _alone(word: Column) -> Column:
    return F.concat(F.lit(f"(?<![{LETTER}])"), quoted(word), F.lit(f"(?![{LETTER}])"))


def whole_word_count(text: Column, word: Column) -> Column:
    return F.regexp_count(text, _alone(word))


def replace_word(text: Column, old: Column, new: Column) -> Column:
    """Every occurrence of ``old`` as a whole word becomes ``new``."""
    plain = F.regexp_replace(new, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, _alone(old), plain)


@cache
def _by_name(of: str):
    """Arrow functions on texts, one for each of the readers of ``names``."""

    def nouns(texts: pa.Array) -> pa.Array:
        return names.NOUNS(texts.to_pylist())

    def failures(questions: pa.Array, variants: pa.Array) -> pa.Array:
        return names.FAILED(list(zip(questions.to_pylist(), variants.to_pylist(), strict=True)))

    def mended(questions: pa.Array, variants: pa.Array) -> pa.Array:
        return names.MENDED(list(zip(questions.to_pylist(), variants.to_pylist(), strict=True)))

    def audited(questions: pa.Array, variants: pa.Array) -> pa.Array:
        return names.AUDITS(list(zip(questions.to_pylist(), variants.to_pylist(), strict=True)))

    returns = {"nouns": "array<string>", "failures": "array<struct<check:string,details:string>>", "mended": "string", "audited": "struct<failed:boolean,changed:boolean,mended:string,still:boolean>"}
    made = {"nouns": nouns, "failures": failures, "mended": mended, "audited": audited}[of]
    # annotations are texts here, and Spark knows an Arrow function by its types
    made.__annotations__ = {k: pa.Array for k in made.__annotations__}
    return F.arrow_udf(made, returns[of])


def proper_nouns(text: Column) -> Column:
    """Distinct capitalised words of three letters or more, in order of first appearance.

    Quotes around a word don't count as its letters.  Stop words don't count; a
    word that opens a sentence does only if it was met before or stands alone
    again in a later word.  One pass over the text, on Arrow batches.
    """
    return _by_name("nouns")(text)


def name_failures(question: Column, variant: Column) -> Column:
    """``array<struct<check, details>>``: what went wrong with the names of ``question`` in ``variant``; empty where one is null."""
    return _by_name("failures")(question, variant)


def mended_names(question: Column, variant: Column) -> Column:
    """``variant`` with one replacement for each name of ``question``, where artifacts or leftovers show that one was tried."""
    return _by_name("mended")(question, variant)


def audited_names(question: Column, variant: Column) -> Column:
    """``struct<failed, changed, mended, still>``: whether names fail (:func:`name_failures`), whether :func:`mended_names` changes the text and to what (null if not), and whether names fail in that."""
    return _by_name("audited")(question, variant)


def suffix_artifact(original: Column, candidate: Column) -> Column:
    """The suffix of a name that a broken replacement left on another word; null if ``candidate`` shows none.

    The longest suffix counts, from half of the name (rounded up) down to two letters.
    """
    n = F.length(original)
    sizes = F.sequence(F.ceil(n / 2).cast("int"), F.lit(2), F.lit(-1))
    stem = lambda k: F.substring(candidate, F.lit(1), F.length(candidate) - k)
    fits = lambda k: F.endswith(candidate, F.right(original, k)) & ~F.startswith(candidate, original) & (F.length(candidate) - k >= 3) & stem(k).rlike("^[A-ZÀ-ÖØ-Þ]")
    found = F.try_element_at(F.filter(sizes, fits), F.lit(1))
    return F.when((candidate != original) & (n >= 4) & (F.length(candidate) > n), F.right(original, found))


def conversion_values(text: Column) -> Column:
    """Known constants that stand in a conversion's context: a phrase within 20 characters after, or one of two before; one pass over the text."""
    number = r"(?<![\d.])\b\d+(?:\.\d+)?\b"
    before = "|".join(f"(?<={w}[\\s\\S]{{0,{NEAR - len(w)}}})" for w in CONVERSIONS_BEFORE)
    after = "|".join(f"[\\s\\S]{{0,{NEAR - len(w)}}}{w}" for w in CONVERSIONS_AFTER)
    found = F.regexp_extract_all(text, F.lit(f"(?i)((?:{before}){number}|{number}(?={after}))"), F.lit(1))
    values = F.transform(found, lambda t: t.try_cast("double"))
    return F.array_distinct(F.filter(values, lambda v: v.cast("bigint").isin(*KNOWN_CONSTANTS)))


def replace_numbers(text: Column, changes: Column) -> Column:
    """Numbers replaced all at once: the n-th occurrence of a number takes the n-th change for it; further ones stay.

    ``changes`` is ``array<struct<old string, new string>>``.  The text is cut at
    its numbers, so a new number is never replaced again.
    """
    number = lambda p: F.regexp_extract(p, r"^([0-9]+(?:\.[0-9]+)?)\b", 1)

    def swap(shown: Column, p: Column, i: Column) -> Column:
        old = F.element_at(shown, i + 1)
        nth = F.size(F.filter(F.slice(shown, 1, i + 1), lambda s: s == old))
        new = F.try_element_at(F.transform(F.filter(changes, lambda c: c["old"] == old), lambda c: c["new"]), nth)
        return let(new, lambda new: F.when((old != "") & new.isNotNull(), F.concat(new, F.substring(p, F.length(old) + 1, F.length(p)))).otherwise(p))

    joined = lambda pieces: let(F.transform(pieces, number), lambda shown: F.array_join(F.transform(pieces, lambda p, i: swap(shown, p, i)), ""))
    return let(F.split(text, r"(?=\b\d+(?:\.\d+)?\b)(?<![\d.])"), joined)


def missing_numbers(required: Column, text: Column) -> Column:
    """The number texts of ``required`` that ``text`` doesn't have."""
    return F.array_except(required, whole_numbers(text))


def surface_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def seed_of(text: Column) -> Column:
    """An integer seed: the sha256 modulo 2^32."""
    return F.conv(F.right(F.sha2(text, 256), F.lit(8)), 16, 10).cast("bigint")


def operation_phrase(op: Column, args: Column) -> Column:
    """A step in words, for templates."""
    verb = F.when(op == "add", "sum").when(op == "subtract", "difference").when(op == "multiply", "product").when(op == "divide", "quotient").when(op == "modulo", "remainder")
    return F.concat(F.lit("the "), F.coalesce(verb, F.lit("value")), F.lit(" of "), F.array_join(args, " and "))
