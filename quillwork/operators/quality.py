"""Table quality: completeness, uniqueness, consistency, validity and the weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import grade
from ..functions.text import is_blank
from .columnstats import FLOATING, field_kinds, is_number_or_bool, present, wide_stats

# Weights, column-name parts that promise non-negative numbers, text length limit.
WEIGHTS = {"completeness": 0.40, "uniqueness": 0.20, "consistency": 0.20, "validity": 0.20}
NON_NEGATIVE_PARTS = ("count", "size", "length", "age", "price")
MAX_TEXT = 10000


def float_decimals(c: Column) -> Column:
    """Digits after the point in the shortest plain text of a double.

    The engine switches to E notation at other magnitudes than plain text does (from 1e16 and below
    1e-4), so the count is derived from mantissa and exponent.
    """
    s = c.cast("string")
    scientific = r"^-?\d\.(\d+)E(-?\d+)$"
    mantissa = F.regexp_extract(s, scientific, 1)
    exponent = F.regexp_extract(s, scientific, 2).try_cast("int")
    digits = F.when(mantissa == "0", F.lit(0)).otherwise(F.length(mantissa))
    shown = F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))) + 2
    kept = F.when(digits == 0, F.lit(0)).otherwise(digits + shown)
    return (F.when(exponent.isNull(), F.length(F.regexp_extract(s, r"\.(\d+)$", 1)))
            .when(exponent >= 16, kept).when(exponent < -4, kept)
            .when(exponent < 0, digits - exponent)
            .otherwise(F.greatest(digits - exponent, F.lit(1))))


def column_facts(df: DataFrame) -> DataFrame:
    """Everything the per-column scores need, from one aggregate."""
    def measures(n: str, t: T.DataType) -> dict[str, Column]:
        c = present(n, t)
        text = isinstance(t, T.StringType)
        number = is_number_or_bool(t)
        zero = F.max(F.lit(0)).cast("long")
        upper = (c == F.upper(c)) & (c != F.lower(c)) if text else None
        lower = (c == F.lower(c)) & (c != F.upper(c)) if text else None
        # Decimal lengths are a handful of small numbers, so the set stays tiny.
        places = (F.size(F.collect_set(float_decimals(c.cast("double")))) if isinstance(t, FLOATING)
                  else F.max(F.lit(1)))
        guarded = number and not isinstance(t, T.BooleanType) and any(p in n.lower() for p in NON_NEGATIVE_PARTS)
        infinite = F.count_if(F.abs(c) == F.lit(float("inf"))) if isinstance(t, FLOATING) else zero
        return {
            "filled": F.count(c),
            "text": F.max(F.lit(text)), "number": F.max(F.lit(number)),
            "upper": F.count_if(upper) if text else zero,
            "lower": F.count_if(lower) if text else zero,
            "mixed": F.count_if(~upper & ~lower) if text else zero,
            "places": places.cast("long"),
            "checks": F.count(c) if text or number else zero,
            "issues": (F.count_if(F.length(c) > MAX_TEXT) + F.count_if(is_blank(c)) if text
                       else infinite + (F.count_if(c < 0) if guarded else F.lit(0)) if number else zero),
        }
    return wide_stats(df, measures, table={"total": F.count("*")})


def column_scores(df: DataFrame) -> DataFrame:
    """(column, completeness, consistency) on a 0-100 scale."""
    filled = F.col("filled")
    consistency = (F.when(filled == 0, 100.0)
                   .when(F.col("text"), F.greatest("upper", "lower", "mixed") / filled * 100)
                   .when(F.col("number"), F.when(F.col("places") <= 2, 95.0).otherwise(70.0))
                   .otherwise(90.0))
    return column_facts(df).select(
        "position", "column", "total", "filled", "checks", "issues",
        F.round(filled / F.greatest("total", F.lit(1)) * 100, 2).alias("completeness"),
        consistency.alias("consistency"))


def distinct_rows(df: DataFrame) -> DataFrame:
    """(rows, unique_rows); NULLs are equal.

    Rows are counted by a 128-bit fingerprint of values and NULL marks: 16 bytes travel instead of the row.
    """
    kinds = field_kinds(df)
    cells = [present(n, t) for n, t in kinds.items()]
    marks = [c.isNull() for c in cells]
    prints = df.select(*[F.xxhash64(F.lit(i), *cells, *marks).alias(f"h{i}") for i in (1, 2)])
    return prints.groupBy("h1", "h2").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("unique_rows"))


def dimensions(df: DataFrame) -> DataFrame:
    """(dimension, score, weight)."""
    totals = column_scores(df).agg(
        F.sum("filled").alias("filled"), F.sum("total").alias("cells"),
        F.avg("consistency").alias("consistency"), F.sum("checks").alias("checks"),
        F.sum("issues").alias("issues"))
    both = totals.unionByName(distinct_rows(df), allowMissingColumns=True)  # two single-row tables
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    scores = {
        "completeness": F.when(F.col("cells") > 0, F.col("filled") / F.col("cells") * 100).otherwise(0.0),
        "uniqueness": F.when(F.col("rows") > 0, F.col("unique_rows") / F.col("rows") * 100).otherwise(100.0),
        "consistency": F.col("consistency"),
        "validity": F.when(F.col("checks") > 0,
                           F.greatest(1 - F.col("issues") / F.col("checks"), F.lit(0.0)) * 100).otherwise(100.0),
    }
    rows = [F.struct(F.lit(k).alias("dimension"), F.round(v, 2).alias("score"), F.lit(WEIGHTS[k]).alias("weight"))
            for k, v in scores.items()]
    return both.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overall(dims: DataFrame) -> DataFrame:
    """(score, grade) from the dimension table."""
    total = dims.agg(F.round(F.sum(F.col("score") * F.col("weight")), 2).alias("score"))
    return total.select("score", grade(F.col("score")).alias("grade"))


def recommendations(dims: DataFrame) -> DataFrame:
    """(dimension, advice); one 'good' row when nothing is below its limit."""
    limits = {"completeness": (90, "fill missing values or check the source"),
              "uniqueness": (95, "deduplicate rows or confirm that repeats are intended"),
              "consistency": (80, "standardise casing and formats"),
              "validity": (90, "review values outside the expected ranges")}
    advice = F.lit(None).cast("string")
    for name, (limit, text) in limits.items():
        advice = F.when((F.col("dimension") == name) & (F.col("score") < limit), text).otherwise(advice)
    found = dims.select("dimension", advice.alias("advice")).filter("advice is not null")
    good = found.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("all").alias("dimension"), F.lit("no major issues").alias("advice"))
    return found.unionAll(good)


def score(df: DataFrame) -> DataFrame:
    """(overall, grade, completeness, uniqueness, consistency, validity) in one row."""
    wide = dimensions(df).agg(*[F.max(F.when(F.col("dimension") == k, F.col("score"))).alias(k) for k in WEIGHTS])
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return wide.select(F.round(total, 2).alias("overall"), *WEIGHTS).withColumn("grade", grade(F.col("overall")))
