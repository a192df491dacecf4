"""Shared one-pass statistics over all columns of a table.

``wide_stats`` computes every per-column measure in one aggregate (no shuffle of rows) and turns the
single result row into one row per column. ``value_stats`` needs values, so it counts (column, value)
pairs with map-side combining; distinct count, mode and largest share all come from those counts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialise

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType)


def field_kinds(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def is_number(t: T.DataType) -> bool:
    return isinstance(t, NUMERIC)


def is_number_or_bool(t: T.DataType) -> bool:
    return isinstance(t, (*NUMERIC, T.BooleanType))


def is_text(t: T.DataType) -> bool:
    return isinstance(t, T.StringType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in field_kinds(df).items() if is_number(t)]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in field_kinds(df).items() if is_text(t)]


def cell(name: str) -> Column:
    return F.col(f"`{name}`")


def present(name: str, t: T.DataType) -> Column:
    """The cell with NaN read as missing."""
    c = cell(name)
    return F.when(~F.isnan(c), c) if isinstance(t, FLOATING) else c


def normalise_nan(df: DataFrame) -> DataFrame:
    return df.select(*[present(n, t).alias(n) for n, t in field_kinds(df).items()])


def wide_stats(df: DataFrame, measures: Callable[[str, T.DataType], dict[str, Column]],
               columns: Sequence[str] | None = None,
               table: dict[str, Column] | None = None) -> DataFrame:
    """One aggregate over the table, reported as one row per column.

    ``measures(name, type)`` gives the same keys and types for every column; ``table`` holds measures
    of the whole table repeated on each row.
    """
    kinds = field_kinds(df)
    columns = list(columns if columns is not None else kinds)
    table = table or {}
    aggs: list[Column] = [v.alias(f"t_{k}") for k, v in table.items()]
    rows = []
    for i, name in enumerate(columns):
        found = measures(name, kinds[name])
        aggs += [v.alias(f"c{i}_{k}") for k, v in found.items()]
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"),
                             *[F.col(f"c{i}_{k}").alias(k) for k in found],
                             *[F.col(f"t_{k}").alias(k) for k in table]))
    wide = df.agg(*aggs)
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value text, number, n) of the non-missing cells."""
    kinds = field_kinds(df)
    columns = list(columns if columns is not None else kinds)
    cells = []
    for name in columns:
        c = present(name, kinds[name])
        number = c.cast("double") if is_number_or_bool(kinds[name]) else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(name).alias("column"), c.cast("string").alias("value"),
                              number.alias("number")))
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("value is not null")
    return long.groupBy("column", "value", "number").agg(F.count("*").alias("n"))


SHORT_TEXT = 40


def distinct_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct, mode_count) without the values themselves.

    Long texts are counted by their digest, so whole documents never travel through the shuffle.
    """
    kinds = field_kinds(df)
    columns = list(columns if columns is not None else kinds)

    def short(name: str) -> Column:
        c = present(name, kinds[name]).cast("string")
        return F.when(F.length(c) > SHORT_TEXT, F.md5(c)).otherwise(c) if is_text(kinds[name]) else c

    cells = [F.struct(F.lit(name).alias("column"), short(name).alias("value")) for name in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").filter("value is not null")
    counted = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return counted.groupBy("column").agg(F.count("*").alias("distinct"), F.max("n").alias("mode_count"))


def value_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, distinct, mode, mode_count): the mode is the smallest of the most frequent values.

    Long texts are counted by digest with their first characters; the text itself is fetched only for the digests
    that may be the mode, and is reduced before it is shuffled.
    """
    kinds = field_kinds(df)
    columns = list(columns if columns is not None else kinds)

    def parts(name: str) -> Column:
        c = present(name, kinds[name])
        text = c.cast("string")
        long = F.length(text) > SHORT_TEXT if is_text(kinds[name]) else F.lit(False)
        number = c.cast("double") if is_number_or_bool(kinds[name]) else F.lit(None).cast("double")
        return F.struct(F.lit(name).alias("column"), number.alias("number"), F.substring(text, 1, SHORT_TEXT).alias("start"),
                        F.when(long, F.md5(text)).alias("digest"), F.when(~long, text).alias("value"))

    cells = df.select(F.explode(F.array(*[parts(c) for c in columns])).alias("c")).select("c.*").filter("start is not null")
    counted = cells.groupBy("column", "number", "start", "digest", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("column").agg(
        F.count("*").alias("distinct"), F.max("n").alias("mode_count"),
        F.min(F.struct((-F.col("n")).alias("n"), "number", "start")).alias("b"),
        F.min_by("value", F.struct(-F.col("n"), F.col("number"), F.col("start"), F.col("value").isNull())).alias("short"))
    texts = [c for c in columns if is_text(kinds[c])]
    if not texts:
        return best.select("column", "distinct", F.col("short").alias("mode"), "mode_count")
    best = materialise(best, "modes")
    tops = best.select(F.col("column").alias("bc"), F.col("b.n").alias("bn"), F.col("b.start").alias("bs"))
    ties = materialise(counted.filter("digest is not null").join(F.broadcast(tops), (F.col("column") == F.col("bc"))
                       & (-F.col("n") == F.col("bn")) & (F.col("start") == F.col("bs"))).select(
        F.col("column").alias("tc"), F.col("digest").alias("td")), "mode-ties")  # ``tops``: one row a column
    cells = F.filter(F.array(*[F.struct(F.lit(c).alias("column"), cell(c).alias("text")) for c in texts]),
                     lambda x: F.length(x["text"]) > SHORT_TEXT)
    rows = df.select(F.explode(cells).alias("c")).select("c.*")  # one more scan, for all text columns together
    longest = (rows.join(ties, (F.col("column") == F.col("tc")) & (F.md5("text") == F.col("td")), "left_semi")
               .groupBy("column").agg(F.min("text").alias("long")))
    # a short value that ties with long ones of the same beginning is that beginning, and so the smallest
    joined = best.join(longest.withColumnRenamed("column", "lc"), F.col("column") == F.col("lc"), "left")
    return joined.select("column", "distinct", F.coalesce(
        F.when(F.col("short").eqNullSafe(F.col("b.start")) | F.col("long").isNull(), F.col("short")), F.col("long")).alias("mode"), "mode_count")
