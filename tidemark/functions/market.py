"""Symbols, scales and rates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cents per million tokens would be shown as dollars: (prompt, answer) for each model of the test tables.
RATES = {"click": (0.10, 0.40), "view": (0.30, 2.50), "purchase": (1.25, 10.00)}
FALLBACK_RATE = (2.00, 12.00)


def classify_market(symbol: Column) -> Column:
    """KR for six digits or a Korean suffix, CRYPTO for a dollar pair, US for letters, else OTHER."""
    s = F.upper(F.trim(symbol))
    return F.when(s.rlike(r"^\d{6}(\.K[SQ])?$"), "KR").when(s.rlike(r"^[A-Z0-9]+-USD$"), "CRYPTO").when(s.rlike(r"^[A-Z]{1,5}([.-][A-Z])?$"), "US").otherwise("OTHER")


def krx_code(symbol: Column) -> Column:
    return F.lpad(F.regexp_replace(F.upper(F.trim(symbol)), r"\.K[SQ]$", ""), 6, "0")


def signed_log(value: Column) -> Column:
    """Sign and magnitude of money on a scale from -1 to 1; missing counts as 0."""
    v = F.coalesce(value, F.lit(0.0))
    return F.signum(v) * F.least(F.log10(F.abs(v) + 1) / 10, F.lit(1.0))


def urgency_rank(urgency: Column) -> Column:
    return F.when(urgency == "low", 1).when(urgency == "medium", 2).when(urgency == "high", 3).when(urgency == "critical", 4).otherwise(0)


def llm_cost(model: Column, prompt: Column, answer: Column) -> Column:
    """Dollars by exact model name; an unknown model costs the fallback rate."""
    cost = F.lit(None).cast("double")
    for name, (a, b) in RATES.items():
        cost = F.when(model == name, prompt * F.lit(a) + answer * F.lit(b)).otherwise(cost)
    return F.coalesce(cost, prompt * F.lit(FALLBACK_RATE[0]) + answer * F.lit(FALLBACK_RATE[1])) / 1e6
