"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_float(c: Column) -> Column:
    """NaN is a missing value."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL (for JSON output)."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sample_skewness(n: Column, g1: Column, variance: Column) -> Column:
    """Bias-corrected skewness from Spark's population value; 0 for constant columns, NULL below 3 rows."""
    corrected = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return F.when(n >= 3, F.when(variance == 0, F.lit(0.0)).otherwise(corrected))


def sample_kurtosis(n: Column, g2: Column, variance: Column) -> Column:
    """Bias-corrected excess kurtosis; 0 for constant columns, NULL below 4 rows."""
    corrected = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    return F.when(n >= 4, F.when(variance == 0, F.lit(0.0)).otherwise(corrected))


def grade(score: Column) -> Column:
    """Letter grade: A from 90, B from 80, C from 70, D from 60, else F."""
    return (F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C")
            .when(score >= 60, "D").otherwise("F"))


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))
