"""Every registered query, and its SQL where SQL can express it."""

from __future__ import annotations

from probeframe.plans import gap_plans, io_plans, isomorph_plans, item_plans, wide_plans

QUERIES = gap_plans.QUERIES | item_plans.QUERIES | isomorph_plans.QUERIES | io_plans.QUERIES | wide_plans.QUERIES
ORACLES = gap_plans.ORACLES | item_plans.ORACLES | isomorph_plans.ORACLES | io_plans.ORACLES | wide_plans.ORACLES
