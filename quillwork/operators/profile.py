"""Dataset profile and chart aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite, sample_kurtosis, sample_skewness
from .columnstats import (cell, distinct_stats, field_kinds, is_number_or_bool, numeric_columns, present, value_counts,
                          value_stats, wide_stats)
from .ranking import quantiles

GROUP = 250  # columns of a group; a pass sums the products of two groups, 1500 by 1500 numbers


def _numbers(df: DataFrame) -> list[str]:
    return [n for n, t in field_kinds(df).items() if is_number_or_bool(t)]


def classify(df: DataFrame) -> DataFrame:
    """(position, column, total, filled, distinct, avg/min/max length, kind)."""
    facts = wide_stats(df, lambda n, t: {
        "filled": F.count(present(n, t)),
        "storage": F.max(F.lit("numeric" if is_number_or_bool(t) else
                               "text" if isinstance(t, T.StringType) else "other")),
        "avg_length": F.avg(F.length(present(n, t).cast("string"))),
        "min_length": F.min(F.length(present(n, t).cast("string"))).cast("long"),
        "max_length": F.max(F.length(present(n, t).cast("string"))).cast("long"),
    }, table={"total": F.count("*")})
    facts = facts.join(distinct_stats(df), "column", "left").fillna({"distinct": 0})
    free = (F.col("avg_length") > 50) | (F.col("distinct") / F.col("filled") > 0.5)
    kind = (F.when(F.col("storage") != "text", F.col("storage"))
            .when(F.col("filled") == 0, "categorical").when(free, "text").otherwise("categorical"))
    return facts.withColumn("kind", kind).drop("storage")


def numeric_profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Moments, quartiles, bias-corrected skewness and kurtosis per numeric column."""
    names = numeric_columns(df)
    facts = wide_stats(df, lambda n, t: {
        "n": F.count(present(n, t)), "mean": F.avg(present(n, t).cast("double")),
        "std": F.stddev_samp(present(n, t).cast("double")),
        "min": F.min(present(n, t)).cast("double"), "max": F.max(present(n, t)).cast("double"),
        "g1": F.skewness(present(n, t).cast("double")), "g2": F.kurtosis(present(n, t).cast("double")),
    }, names)
    quarts = quantiles(df, names, [0.25, 0.5, 0.75], exact).drop("n")
    variance = F.col("std") * F.col("std")
    return facts.join(quarts, "column", "left").select(
        "position", "column", "n", F.round("mean", 6).alias("mean"), F.round("q1", 6).alias("median"),
        F.round("std", 6).alias("std"), "min", "max", F.col("q0").alias("q25"), F.col("q1").alias("q50"),
        F.col("q2").alias("q75"), F.round(sample_skewness(F.col("n"), F.col("g1"), variance), 6).alias("skewness"),
        F.round(sample_kurtosis(F.col("n"), F.col("g2"), variance), 6).alias("kurtosis"))


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10) -> DataFrame:
    """(column, value, n, rank): most frequent values, ties by value.

    Each value's count is final before ranking, and ranking is preceded by a per-partition cut, so no
    task sees more than ``n`` rows per partition and column.
    """
    counted = value_counts(df, columns).withColumn("_p", F.spark_partition_id())
    order = [F.desc("n"), F.col("value")]
    local = Window.partitionBy("_p", "column").orderBy(*order)
    cut = counted.withColumn("_r", F.row_number().over(local)).filter(F.col("_r") <= n)
    final = Window.partitionBy("column").orderBy(*order)
    return cut.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= n).select(
        "column", "value", "n", "rank")


def text_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return wide_stats(df, lambda n, t: {
        "avg_length": F.round(F.coalesce(F.avg(F.length(cell(n))), F.lit(0.0)), 2),
        "min_length": F.coalesce(F.min(F.length(cell(n))), F.lit(0)).cast("long"),
        "max_length": F.coalesce(F.max(F.length(cell(n))), F.lit(0)).cast("long")}, columns)


def _pair_sums(df: DataFrame, names: Sequence[str]) -> np.ndarray:
    """Gram matrix over (x, present, x squared) of all columns, x centred and 0 where missing: one pass in the engine,
    summed in a tree; the driver gets (3 * columns) squared numbers."""
    kinds = field_kinds(df)
    cells = [present(n, kinds[n]).cast("double") for n in names]
    means = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)]).first()
    centred = [F.coalesce(c - F.lit(means[i] if means[i] is not None else 0.0), F.lit(0.0)) for i, c in enumerate(cells)]
    there = [c.isNotNull().cast("double") for c in cells]
    rows = df.select(array_to_vector(F.array(*centred, *there, *[c * c for c in centred])).alias("v"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v")).computeGramianMatrix().toArray()


NARROW = 8


def _few_correlations(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``correlations`` of few columns: one aggregate with one running covariance a pair, one pass over the table."""
    kinds = field_kinds(df)
    cells = {n: present(n, kinds[n]).cast("double") for n in names}
    pairs = list(combinations(names, 2))
    sums = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.when(cells[b].isNotNull(), cells[a]), F.when(cells[a].isNotNull(), cells[b])
        vary = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))  # what rounding leaves of a constant is no spread
        sums += [F.covar_pop(x, y).alias(f"c{i}"), F.stddev_pop(x).alias(f"x{i}"), F.stddev_pop(y).alias(f"y{i}"), vary.alias(f"v{i}")]
    found = df.agg(*sums)
    rows = []
    for i, (a, b) in enumerate(pairs):
        spread = F.col(f"x{i}") * F.col(f"y{i}")
        r = F.when(F.col(f"v{i}") & (spread > 0), F.greatest(F.least(F.try_divide(f"c{i}", spread), F.lit(1.0)), F.lit(-1.0)))
        rows.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(r, 6).alias("r")))
    rows = F.array(*rows)
    return found.select(F.explode(rows).alias("p")).select("p.*")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(a, b, r) for a before b: Pearson on the rows where both are present.

    Up to ``2 * GROUP`` columns take one pass over the table; wider tables one for each pair of column groups.
    """
    names = list(columns or _numbers(df))
    if 1 < len(names) <= NARROW:
        return _few_correlations(df, names)
    groups = [names[i:i + GROUP] for i in range(0, len(names), GROUP)]
    blocks = [names] if len(groups) <= 2 else [x + y for x, y in combinations(groups, 2)]
    found: dict[tuple[str, str], float | None] = {}
    for block in blocks if len(names) > 1 and not df.limit(1).isEmpty() else []:
        n = len(block)
        sums = _pair_sums(df, block)
        x, there, square = range(n), range(n, 2 * n), range(2 * n, 3 * n)
        count = sums[np.ix_(there, there)]
        sx, sxx = sums[np.ix_(x, there)], sums[np.ix_(square, there)]
        with np.errstate(divide="ignore", invalid="ignore"):
            covariance = sums[np.ix_(x, x)] - sx * sx.T / count
            spread = np.maximum(sxx - sx * sx / count, 0)
            # what rounding leaves of a constant column is no spread
            spread = np.where(spread <= 1e-13 * sxx, 0, spread)
            r = covariance / np.sqrt(spread * spread.T)
        for i, j in combinations(range(n), 2):
            found[block[i], block[j]] = float(np.clip(r[i, j], -1, 1)) if np.isfinite(r[i, j]) else None
    rows = [(a, b, found.get((a, b))) for a, b in combinations(names, 2)]  # a row for each pair of columns
    out = df.sparkSession.createDataFrame(rows, "a string, b string, r double")
    return out.select("a", "b", F.round("r", 6).alias("r"))


def correlation_map(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, other, r): both directions of ``correlations``."""
    half = correlations(df, columns)
    return half.select(F.explode(F.array(
        F.struct(F.col("a").alias("column"), F.col("b").alias("other"), "r"),
        F.struct(F.col("b").alias("column"), F.col("a").alias("other"), "r"))).alias("p")).select("p.*")


def top_correlations(df: DataFrame, columns: Sequence[str] | None = None, n: int = 10) -> DataFrame:
    return correlations(df, columns).filter("r is not null").orderBy(F.desc(F.abs("r")), "a", "b").limit(n)


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """One row per column with everything known about it."""
    base = classify(df)
    labels = [n for n, t in field_kinds(df).items() if isinstance(t, T.StringType)]
    modes = value_stats(df, labels).select("column", "mode") if labels else None
    base = base.join(modes, "column", "left") if labels else base.withColumn("mode", F.lit(None).cast("string"))
    numbers = numeric_profile(df, exact).drop("position", "n") if numeric_columns(df) else None
    out = base.select(
        "position", "column", "kind", F.col("total").alias("count"),
        (F.col("total") - F.col("filled")).alias("null_count"),
        F.round((F.col("total") - F.col("filled")) / F.greatest("total", F.lit(1)) * 100, 2).alias("null_pct"),
        F.col("distinct").alias("unique_count"),
        F.round(F.col("distinct") / F.greatest("filled", F.lit(1)) * 100, 2).alias("unique_pct"),
        F.when(F.col("kind").isin("categorical", "text"), F.col("mode")).alias("mode"), "mode_count",
        F.when(F.col("kind") == "text", F.round("avg_length", 2)).alias("avg_length"))
    return out.join(numbers, "column", "left") if numbers is not None else out


def profile_warnings(report: DataFrame) -> DataFrame:
    """(column, warning) over a profile."""
    filled = F.col("count") - F.col("null_count")
    checks = [
        (F.col("null_pct") > 50, "null_share_above_50"),
        ((filled > 0) & (F.col("unique_count") == 1), "constant"),
        ((filled > 0) & (F.col("unique_count") != 1) & (F.col("mode_count") / filled > 0.95), "near_constant"),
        ((F.col("kind") == "text") & (F.col("unique_count") / filled > 0.5), "mostly_unique_text"),
    ]
    if "skewness" in report.columns:
        checks.append((F.abs("skewness") > 2, "high_skewness"))
    found = F.array_compact(F.array(*[F.when(c, w) for c, w in checks]))
    return report.select("column", F.explode(found).alias("warning"))


# ---- chart data ---------------------------------------------------------------------------------

def columns_data(df: DataFrame, columns: Sequence[str], order_by: str, limit: int = 1000) -> DataFrame:
    """Raw values of the chosen columns, first ``limit`` rows by key; unknown names also try trimmed."""
    kinds = field_kinds(df)
    by_trim = {c.strip(): c for c in kinds}
    found = [c if c in kinds else by_trim[c.strip()] for c in columns if c in kinds or c.strip() in by_trim]
    head = df.orderBy(cell(order_by)).limit(limit)
    return head.select(*[(finite(cell(c)) if isinstance(kinds[c], (T.FloatType, T.DoubleType)) else cell(c)).alias(c)
                         for c in found])


def bar(df: DataFrame, column: str, n: int = 15) -> DataFrame:
    value = cell(column).cast("string")
    return (df.select(value.alias("value")).filter("value is not null").groupBy("value")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """(bin, lower, upper, n): equal widths, last bin closed, width 1/bins for a constant column.

    The range is one aggregate; counting is one more with map-side combining.
    """
    x = df.select(finite(cell(column).cast("double")).alias("x")).filter("x is not null")
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return df.sparkSession.createDataFrame([], "bin int, lower double, upper double, n long")
    width = (high - low) or 1.0
    place = F.least(F.floor((F.col("x") - low) / width * bins), F.lit(bins - 1)).cast("int")
    counted = x.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    empty = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return empty.join(counted, "bin", "left").select(
        "bin", (low + F.col("bin") * width / bins).alias("lower"),
        (low + (F.col("bin") + 1) * width / bins).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.select(finite(cell(x).cast("double")).alias("x"), finite(cell(y).cast("double")).alias("y"))
    return both.filter("x is not null and y is not null")


def scatter(df: DataFrame, x: str, y: str, order_by: str, limit: int = 1000) -> DataFrame:
    """Pairs of the first ``limit`` rows by key."""
    return _pairs(df.orderBy(cell(order_by)).limit(limit), x, y)


def line(df: DataFrame, x: str, y: str, order_by: str, limit: int = 1000) -> DataFrame:
    """As ``scatter``, sorted by x."""
    return scatter(df, x, y, order_by, limit).orderBy("x", "y")


def null_chart(df: DataFrame, n: int = 15) -> DataFrame:
    facts = wide_stats(df, lambda c, t: {"nulls": F.count_if(present(c, t).isNull())}, table={"total": F.count("*")})
    share = F.round(F.col("nulls") / F.greatest("total", F.lit(1)) * 100, 2)
    return facts.select("column", share.alias("null_pct")).filter("null_pct > 0").orderBy(
        F.desc("null_pct"), "column").limit(n)


def type_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count("*").alias("columns"))


def report_json(report: DataFrame) -> DataFrame:
    """(column, document): each profile row as one JSON document; missing values are left out."""
    return report.select("column", F.to_json(F.struct(*report.columns)).alias("document"))

