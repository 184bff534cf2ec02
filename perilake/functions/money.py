"""Amounts, ratios and probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from perilake.functions.text import cleaned, col

MONEY = "decimal(18,2)"
PROBABILITY = "decimal(6,5)"


def money(value: str | Column) -> Column:
    """decimal(18,2), half-up; unreadable text is NULL."""
    return cleaned(value).try_cast(MONEY)


def total(value: str | Column, of: str = MONEY) -> Column:
    """Decimal sum kept at the column's own scale."""
    return F.sum(col(value)).cast(of)


def zero_if_missing(value: str | Column) -> Column:
    return F.coalesce(col(value), F.lit(0).cast(MONEY))


def ratio(numerator: str | Column, denominator: str | Column) -> Column:
    """NULL unless the denominator is positive."""
    return F.when(col(denominator) > 0, col(numerator) / col(denominator))


def score(good: Column, all_: Column) -> Column:
    """Share at six decimals; 1.0 when there was nothing to judge."""
    return F.when(all_ == 0, F.lit(1.0)).otherwise(F.round(good.cast("double") / F.nullif(all_, F.lit(0)), 6))


def clamped(value: str | Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col(value)))


def is_probability(value: str | Column) -> Column:
    """Finite and inside [0, 1]; NULL and NaN are not."""
    return F.coalesce(~F.isnan(col(value).cast("double")) & col(value).between(0, 1), F.lit(False))


def risk_level(probability: str | Column) -> Column:
    """Bands are cut on the published (rounded) probability."""
    return (
        F.when(col(probability) >= F.lit("0.70").cast(PROBABILITY), F.lit("HIGH"))
        .when(col(probability) >= F.lit("0.30").cast(PROBABILITY), F.lit("MEDIUM"))
        .otherwise(F.lit("LOW"))
    )
