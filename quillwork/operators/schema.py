"""Semantic column types and the schema report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..scratch import materialise
from .cleaning import looks_like_date
from .columnstats import (INTEGRAL, distinct_stats, field_kinds, is_number, is_number_or_bool, present, text_columns,
                          wide_stats)

# Patterns and words of the type tests.
PATTERNS = {
    "uuid": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "email": r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$",
    "url": r"^https?://\S+$",
    "phone": r"^[\+]?[\d\s\-\(\)]{7,15}$",
    "ip": r"^(\d{1,3}\.){3}\d{1,3}$",
    "currency": r"^[\$€£¥]?\s*[\d,]+\.?\d*$",
}
BOOLEAN_WORDS = ("true", "false", "yes", "no", "y", "n", "1", "0")


def _share(test: Column) -> Column:
    """Share of non-missing values that pass."""
    return F.coalesce(F.avg(test.cast("int")), F.lit(0.0))


def match_ratios(df: DataFrame) -> DataFrame:
    """(column, uuid, email, url, phone, ip, currency): pattern shares of the text columns."""
    return wide_stats(df, lambda n, t: {
        k: _share(strip(present(n, t)).rlike(p)) for k, p in PATTERNS.items()}, text_columns(df))


def date_ratios(df: DataFrame) -> DataFrame:
    """(column, date): share of non-missing text values under one of the date layouts."""
    return wide_stats(df, lambda n, t: {
        "date": _share(F.when(present(n, t).isNotNull(), looks_like_date(present(n, t))))}, text_columns(df))


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: semantic type, missing, distinct, lengths, moments.

    Shares are taken over all values, so the verdict does not depend on row order. Two passes whatever
    the number of columns: one wide aggregate and one count of (column, value) pairs.
    """
    def measures(n: str, t: T.DataType) -> dict[str, Column]:
        c = present(n, t)
        s = strip(c.cast("string"))
        number = c.cast("double") if is_number(t) else None
        amount = number if number is not None else F.when(
            s.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), s.try_cast("double"))
        text = isinstance(t, T.StringType)
        out = {
            "dtype": F.max(F.lit(t.simpleString())),
            "numeric": F.max(F.lit(is_number_or_bool(t))),
            "integral": F.max(F.lit(isinstance(t, INTEGRAL))),
            "filled": F.count(c),
            "zero_one": F.coalesce(F.min(number.isin(0.0, 1.0)), F.lit(False)) if number is not None
            else F.max(F.lit(isinstance(t, T.BooleanType))),
            "words": F.coalesce(F.min(F.lower(s).isin(*BOOLEAN_WORDS)), F.lit(False)),
        }
        for k, p in PATTERNS.items():
            out[k] = _share(s.rlike(p)) if text else F.max(F.lit(0.0))
        out["date"] = (_share(F.when(c.isNotNull(), looks_like_date(s))) if text
                       else F.max(F.lit(1.0 if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))
                                        else 0.0)))
        out["min_length"] = F.min(F.length(c.cast("string"))).cast("long")
        out["max_length"] = F.max(F.length(c.cast("string"))).cast("long")
        out["mean"] = F.avg(amount)
        out["std"] = F.stddev_samp(amount)
        out["min_value"] = F.min(amount)
        out["max_value"] = F.max(amount)
        return out

    facts = wide_stats(df, measures, table={"total": F.count("*")})
    facts = facts.join(distinct_stats(df).select("column", "distinct"), "column", "left").fillna({"distinct": 0})
    filled, distinct = F.col("filled"), F.col("distinct")
    diversity = distinct / F.greatest(filled, F.lit(1))
    kind = (F.when(filled == 0, "unknown")
            .when(F.col("numeric") & F.col("zero_one"), "boolean")
            .when(F.col("integral") & (distinct == filled) & F.lower("column").contains("id"), "id")
            .when(F.col("numeric"), "numeric")
            .when(F.col("words"), "boolean")
            .when(F.col("uuid") > 0.8, "id")
            .when(F.col("email") > 0.8, "email")
            .when(F.col("url") > 0.8, "url")
            .when(F.col("date") > 0.8, "date")
            .when(F.col("phone") > 0.7, "phone")
            .when(F.col("ip") > 0.8, "ip_address")
            .when(F.col("currency") > 0.7, "currency")
            .when((diversity < 0.05) & (distinct <= 50), "categorical")
            .when((diversity < 0.1) & (distinct <= 20), "categorical")
            .otherwise("text"))
    facts = facts.withColumn("kind", kind)
    texty = (F.col("dtype") == "string") | F.col("kind").isin("text", "email", "url", "categorical")
    measured = F.col("kind").isin("numeric", "currency")
    return facts.select(
        "position", "column", "dtype", F.col("kind").alias("inferred_type"),
        (F.col("total") - filled).alias("null_count"),
        F.round((F.col("total") - filled) / F.greatest("total", F.lit(1)) * 100, 2).alias("null_percentage"),
        distinct.alias("unique_count"), F.round(diversity * 100, 2).alias("unique_percentage"),
        F.when(texty, F.col("min_length")).alias("min_length"),
        F.when(texty, F.col("max_length")).alias("max_length"),
        F.when(measured, F.round("mean", 4)).alias("mean"), F.when(measured, F.round("std", 4)).alias("std"),
        F.when(measured, F.col("min_value")).alias("min_value"),
        F.when(measured, F.col("max_value")).alias("max_value"))


HEAD_ROWS = 1000


def sample_values(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    """(column, sample_values): the first ``n`` non-missing values of each column in key order.

    Most columns are served by the first rows of the table, found by one scan; the others, with few values in those,
    share one more scan of their non-missing cells, of which each task keeps ``n`` a column.
    """
    kinds = field_kinds(df)
    keyed = df.select(F.col(order_by).alias("k"), *[present(c, t).cast("string").alias(f"v{i}") for i, (c, t) in enumerate(kinds.items())])
    top = materialise(keyed.orderBy("k").limit(HEAD_ROWS), "first-rows")
    facts = top.agg(F.count("*").alias("rows"), F.max("k").alias("last")).first()
    if facts["rows"] == HEAD_ROWS:  # rows that share the last key may be missing
        top = top.filter(F.col("k") < F.lit(facts["last"]))
    filled = top.agg(*[F.count(f"v{i}").alias(f"v{i}") for i in range(len(kinds))]).first()
    sparse = [i for i in range(len(kinds)) if facts["rows"] == HEAD_ROWS and filled[f"v{i}"] < n]

    def cells(rows: DataFrame, places: list[int]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(i).alias("i"), F.col("k"), F.col(f"v{i}").alias("v")) for i in places])
        return rows.select(F.explode(F.filter(each, lambda c: c["v"].isNotNull())).alias("c")).select("c.*")

    picked = cells(top, [i for i in range(len(kinds)) if i not in sparse] or [0])
    if sparse:
        picked = picked.filter(~F.col("i").isin(sparse)).unionByName(cells(keyed, sparse))
    first = Window.partitionBy("i").orderBy("k", "v")
    taken = picked.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= n)
    lists = taken.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("s"))
    names = F.create_map(*[F.lit(x) for i, c in enumerate(kinds) for x in (i, c)])
    every = df.sparkSession.range(len(kinds)).select(F.col("id").cast("int").alias("j"))
    none = F.array().cast("array<string>")
    return every.join(lists, F.col("i") == F.col("j"), "left").select(
        F.element_at(names, F.col("j")).alias("column"), F.coalesce(F.transform("s", lambda x: x["v"]), none).alias("sample_values"))


def type_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("inferred_type").agg(F.count("*").alias("columns"))
