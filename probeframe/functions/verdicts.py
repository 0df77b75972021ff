"""Ordered rules that name a model's behaviour; six rule sets, kept apart.

A null p-value (too few nonzero gaps) never counts as significant.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROBUST, PURE, SYNTACTIC, SELECTIVE = "ROBUST_REASONER", "PURE_MEMORIZER", "SYNTACTIC_MATCHER", "SELECTIVE_MEMORIZER"


def full_test(gap: Column, weighted: Column, ability: Column, flagged: Column, p: Column) -> Column:
    """From the item-response test: gap, weighted gap, ability shift, flagged share, p."""
    return (
        F.when((gap <= 0.02) & (F.abs(ability) <= 0.1) & (F.coalesce(p, F.lit(1.0)) > 0.05), ROBUST)
        .when((gap >= 0.10) & (flagged >= 0.30), PURE)
        .when((gap >= 0.03) & (gap < 0.10) & (flagged < 0.30), SYNTACTIC)
        .when((gap < 0.05) & (weighted >= 0.08), SELECTIVE)
        .when(p < 0.05, SYNTACTIC)
        .otherwise(ROBUST)
    )


def with_flags(gap: Column, n_flagged: Column) -> Column:
    """From the gap and whether any item is flagged."""
    return (
        F.when((F.abs(gap) <= 0.02) & (n_flagged == 0), ROBUST).when(gap >= 0.10, PURE).when((gap >= 0.03) & (gap < 0.10), SYNTACTIC).otherwise(ROBUST)
    )


def by_gap(gap: Column) -> Column:
    return F.when(F.abs(gap) <= 0.02, ROBUST).when(gap >= 0.10, PURE).when((gap > 0.02) & (gap < 0.10), SYNTACTIC).otherwise(ROBUST)


def rescored(gap: Column, p: Column, acc_original: Column) -> Column:
    return (
        F.when(F.coalesce(p, F.lit(1.0)) > 0.05, "INVARIANT")
        .when((gap > 0.3) & (acc_original > 0.85), "PURE_MEMORIZER")
        .when(gap > 0.15, "PARTIAL_MEMORIZER")
        .when(gap > 0.05, "MILD_GAP")
        .otherwise("INVARIANT")
    )


def tabled(gap: Column, p: Column) -> Column:
    return F.when(F.coalesce(p, F.lit(1.0)) > 0.05, "Inv").when(gap < 0.15, "Mild").otherwise("Mem")


def documented(gap: Column, p: Column) -> Column:
    return F.when(F.coalesce(p, F.lit(1.0)) > 0.05, "Invariant").when(gap < 0.15, "Mild").when(gap <= 0.30, "Partial").otherwise("Pure")
