"""Tier buckets, normalisation and rounding used by all scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = ("CRITICAL", "HIGH", "MEDIUM")

# fixed values: lower bounds of CRITICAL, HIGH, MEDIUM
CRITICALITY_BOUNDS = (0.70, 0.45, 0.25)
EDGE_BOUNDS = (0.70, 0.50, 0.30)
NODE_BOUNDS = (0.65, 0.45, 0.25)
SYSTEM_BOUNDS = (70.0, 50.0, 30.0)


def fair_round(value: Column, digits: int) -> Column:
    """Round half up; what lies within 1e-10 of a tie counts as the tie.

    Sums over rows come in any order, so their last bits must not decide a digit.
    """
    return F.round(F.round(value, 10), digits)


def tier(score: Column, bounds: tuple[float, float, float]) -> Column:
    """Name of the first bound the score reaches, else LOW."""
    out = F
    for level, bound in zip(LEVELS, bounds):
        out = out.when(score >= bound, level)
    return out.otherwise("LOW")


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 for an all-zero signal, 0.5 for a flat one, else the position in [low, high]."""
    return (F.when(high < 1e-9, 0.0).when(high - low < 1e-9, 0.5)
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low)))))


def texts(*pieces: Column, default: str) -> Column:
    """The non-null pieces as an array, or the default alone."""
    kept = F.array_compact(F.array(*pieces))
    return F.when(F.size(kept) == 0, F.array(F.lit(default))).otherwise(kept)
