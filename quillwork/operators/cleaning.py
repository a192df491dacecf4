"""Cleaning operators. Every operator returns a table; reports are tables too."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, title
from ..scratch import materialise
from .columnstats import (cell, distinct_stats, field_kinds, is_number, normalise_nan, numeric_columns, present,
                          text_columns, value_stats, wide_stats)
from .ranking import quantiles, with_rank

MAX_ONEHOT = 50
MAX_OUTLIER_SHARE = 0.10
NULL_STRATEGIES = ("drop_rows", "fill_mean", "fill_median", "fill_mode", "fill_empty")


# ---- columns and duplicates ---------------------------------------------------------------------

def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[cell(c) for c in df.columns if c not in set(columns)])


def deduplicate(df: DataFrame) -> DataFrame:
    """Exact duplicates collapse to one row (partial aggregation, so hot copies never travel whole)."""
    return df.dropDuplicates()


def snake_name(name: str) -> str:
    return re.sub(r"[^a-zA-Z0-9_]+", "_", name.strip()).strip("_").lower() or name


def numbered_names(names: Sequence[str]) -> list[str]:
    """The first use of a name keeps it; later ones get the next number that no other column has."""
    taken, seen, out = {n.lower() for n in names}, set(), []
    for name in names:
        new, k = name, 1
        while new.lower() in (seen if k == 1 else taken):
            k += 1
            new = f"{name}_{k}"
        seen.add(new.lower())
        taken.add(new.lower())
        out.append(new)
    return out


def snake_names(df: DataFrame) -> DataFrame:
    """Headers as snake_case; a second use of a name gets the next free number."""
    return df.toDF(*numbered_names([snake_name(c) for c in df.columns]))


# ---- missing values -----------------------------------------------------------------------------

def null_counts(df: DataFrame) -> DataFrame:
    """(column, total, nulls) in one aggregate."""
    return wide_stats(df, lambda n, t: {"nulls": F.count_if(present(n, t).isNull())},
                      table={"total": F.count("*")})


def null_drop(df: DataFrame) -> DataFrame:
    """Rows without a missing value, columns that are missing throughout being ignored."""
    df = normalise_nan(df)
    counts = {r["column"]: (r["total"], r["nulls"]) for r in null_counts(df).collect()}
    keep = [c for c, (total, nulls) in counts.items() if nulls < total]
    if not keep:
        return df
    out = df.dropna(subset=keep)
    if out.limit(1).isEmpty() and any(total for total, _ in counts.values()):
        raise ValueError("drop_rows would delete every row; use a fill strategy")
    return out


def fill_values(df: DataFrame, strategy: str, exact: bool = True) -> dict[str, object]:
    """The replacement per column that has gaps: one report-sized row per column reaches the driver.

    Only columns with missing values are counted or ranked.
    """
    kinds = field_kinds(df)
    gaps = [r["column"] for r in null_counts(df).collect() if r["nulls"]]
    numeric = [c for c in gaps if is_number(kinds[c]) and strategy != "fill_mode"]
    by_mode = [c for c in gaps if c not in numeric]
    fills: dict[str, object] = {}
    if numeric and strategy == "fill_mean":
        stats = wide_stats(df, lambda n, t: {"v": F.avg(present(n, t))}, numeric)
        fills = {r["column"]: r["v"] for r in stats.collect()}
    elif numeric:
        fills = {r["column"]: r["q0"] for r in quantiles(df, numeric, [0.5], exact).collect()}
    if by_mode:
        fills.update({r["column"]: r["mode"] for r in value_stats(df, by_mode).collect()})
    if strategy != "fill_mode":
        fills.update({c: "" for c in by_mode if c not in fills and isinstance(kinds[c], T.StringType)})
    return fills


def fill_nulls(df: DataFrame, strategy: str = "fill_mode", exact: bool = True) -> DataFrame:
    """Missing values by the chosen strategy; an unknown strategy is an error."""
    if strategy not in NULL_STRATEGIES:
        raise ValueError(f"unknown null strategy {strategy!r}; use one of {NULL_STRATEGIES}")
    if strategy == "drop_rows":
        return null_drop(df)
    kinds = field_kinds(df)
    if strategy == "fill_empty":
        # '' in a number column turns it into text, as it would in the data being replaced.
        counts = {r["column"]: r["nulls"] for r in null_counts(df).collect()}
        return df.select(*[
            (F.coalesce(present(c, t).cast("string"), F.lit("")) if counts[c] else cell(c)).alias(c)
            for c, t in kinds.items()])
    fills = fill_values(df, strategy, exact)

    def filled(name: str, kind: T.DataType) -> Column:
        value = fills.get(name)
        if value is None:
            return cell(name)
        target = kind
        if strategy in ("fill_mean", "fill_median") and is_number(kind):
            target = T.DoubleType()
        return F.coalesce(present(name, kind).cast(target), F.lit(value).cast(target))

    return df.select(*[filled(c, t).alias(c) for c, t in kinds.items()])


# ---- text ---------------------------------------------------------------------------------------

def trim_text(df: DataFrame) -> DataFrame:
    texts = set(text_columns(df))
    return df.select(*[(strip(cell(c)) if c in texts else cell(c)).alias(c) for c in df.columns])


def trim_changes(df: DataFrame) -> DataFrame:
    """(column, changed): cells that trimming would change."""
    return wide_stats(df, lambda n, t: {"changed": F.count_if(cell(n) != strip(cell(n)))}, text_columns(df))


def change_case(df: DataFrame, mode: str) -> DataFrame:
    """Text values and all headers in lower, upper or title case."""
    cells = {"lower": F.lower, "upper": F.upper, "title": title}
    heads = {"lower": str.lower, "upper": str.upper, "title": str.title}
    if mode not in cells:
        raise ValueError("mode must be lower, upper or title")
    texts = set(text_columns(df))
    names = numbered_names([heads[mode](c) for c in df.columns])
    return df.select(*[(cells[mode](cell(c)) if c in texts else cell(c)).alias(n) for c, n in zip(df.columns, names)])


# ---- outliers -----------------------------------------------------------------------------------

def outlier_fences(df: DataFrame, multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """(column, lower, upper) for the columns where a fence makes sense.

    Left out: all-missing columns, 0/1 columns, zero quartile range, one value in over half the rows.
    """
    names = numeric_columns(df)
    spread = {r["column"]: r for r in quantiles(df, names, [0.25, 0.5, 0.75], exact).collect()}  # a row a column
    shapes = wide_stats(df, lambda n, t: {
        "filled": F.count(present(n, t)), "binary": F.min(present(n, t).isin(0, 1)),
        # a value that fills more than half of the rows is the median
        "median_count": F.count_if(present(n, t).cast("double") == F.lit(spread[n]["q1"]))}, [n for n in names if n in spread])
    rows = [(n, r["q0"], r["q2"]) for n, r in spread.items()]
    quarts = df.sparkSession.createDataFrame(rows, "column string, q0 double, q2 double")
    reach = multiplier * (F.col("q2") - F.col("q0"))
    return (quarts.join(shapes, "column")
            .filter((F.col("q2") != F.col("q0")) & ~F.col("binary") & (F.col("median_count") <= 0.5 * F.col("filled")))
            .select("column", (F.col("q0") - reach).alias("lower"), (F.col("q2") + reach).alias("upper")))


def _outside(name: str, kind: T.DataType, lower: float, upper: float) -> Column:
    c = present(name, kind)
    return F.coalesce((c < F.lit(lower)) | (c > F.lit(upper)), F.lit(False))


def outlier_report(df: DataFrame, fences: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, flagged, any_flagged, total); one aggregate for all columns."""
    kinds = field_kinds(df)
    flags = [_outside(c, kinds[c], *b) for c, b in fences.items()]
    hit = F.lit(False)
    for f in flags:
        hit = hit | f
    return wide_stats(df, lambda n, t: {"flagged": F.count_if(_outside(n, t, *fences[n]))}, list(fences),
                      table={"any_flagged": F.count_if(hit), "total": F.count("*")})


def remove_outliers(df: DataFrame, multiplier: float = 1.5, exact: bool = True) -> DataFrame:
    """Rows inside every fence; unchanged when more than a tenth of the rows would go."""
    fences = {r["column"]: (r["lower"], r["upper"])
              for r in outlier_fences(df, multiplier, exact).collect()} if numeric_columns(df) else {}
    if not fences:
        return df
    facts = outlier_report(df, fences).first()
    if facts["any_flagged"] > MAX_OUTLIER_SHARE * facts["total"]:
        return df
    kinds = field_kinds(df)
    for c, bounds in fences.items():
        df = df.filter(~_outside(c, kinds[c], *bounds))
    return df


# ---- encoding -----------------------------------------------------------------------------------

def onehot(df: DataFrame, column: str) -> tuple[DataFrame, str]:
    """One 0/1 column per value, replacing ``column``; left alone above the width limit."""
    kind = field_kinds(df)[column]
    values = df.select(present(column, kind).alias("v")).filter("v is not null").distinct()
    found = sorted(r["v"] for r in values.limit(MAX_ONEHOT + 1).collect())
    if len(found) > MAX_ONEHOT:
        return df, f"{column}: one-hot SKIPPED, more than {MAX_ONEHOT} distinct values"
    kept = [cell(c) for c in df.columns if c != column]
    flags = [F.coalesce((cell(column) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{column}_{v}")
             for v in found]
    return df.select(*kept, *flags), f"{column}: one-hot"


def label_codes(df: DataFrame, column: str, order_by: Sequence[str]) -> DataFrame:
    """(value, code): codes count up in order of first appearance under ``order_by``."""
    kind = field_kinds(df)[column]
    first = (df.select(present(column, kind).alias("value"), F.struct(*[cell(c) for c in order_by]).alias("k"))
             .filter("value is not null").groupBy("value").agg(F.min("k").alias("k")))
    ranked = with_rank(first, [F.col("k"), F.col("value")], name="r")
    return ranked.select("value", (F.col("r") - 1).alias("code"))


def label_encode(df: DataFrame, column: str, order_by: Sequence[str] | None = None) -> DataFrame:
    """Integer codes, -1 where missing. Without ``order_by`` all columns order the rows."""
    codes = label_codes(df, column, order_by or df.columns)
    value = present(column, field_kinds(df)[column])
    # rows without a value go around the join: their key would be one partition
    joined = df.filter(value.isNotNull()).join(codes, value == F.col("value"))
    missing = df.filter(value.isNull()).withColumn("code", F.lit(-1).cast("long"))
    return joined.drop("value").unionByName(missing).select(*[(F.col("code") if c == column else cell(c)).alias(c) for c in df.columns])


def encode(df: DataFrame, specs: Sequence[dict], order_by: Sequence[str] | None = None
           ) -> tuple[DataFrame, list[str]]:
    notes = []
    for spec in specs:
        column, mode = spec.get("column"), spec.get("mode")
        if column not in df.columns:
            continue
        if mode == "onehot":
            df, note = onehot(df, column)
            notes.append(note)
        elif mode == "label":
            keys = [c for c in (order_by or df.columns) if c in df.columns]
            df = label_encode(df, column, keys)
            notes.append(f"{column}: label codes")
    return df, notes


# ---- composite ----------------------------------------------------------------------------------

@dataclass(frozen=True)
class CleaningPlan:
    null_strategy: str = "fill_mode"
    remove_duplicates: bool = True
    trim: bool = True
    outliers: bool = False
    multiplier: float = 1.5
    drop: tuple[str, ...] = ()
    case: str = "none"
    snake: bool = False
    encode: tuple[dict, ...] = field(default=())
    order_by: tuple[str, ...] | None = None
    exact: bool = True


def clean(df: DataFrame, plan: CleaningPlan = CleaningPlan()) -> tuple[DataFrame, DataFrame]:
    """All steps in their fixed order, and (step, rows, columns, nulls, note) before and after each.

    Steps are lazy; the report counts each distinct stage once, and row-preserving steps reuse the
    count of the step before.
    """
    stages: list[tuple[str, DataFrame, str, bool]] = [("input", df, "", True)]

    def push(name: str, out: DataFrame, note: str = "", counts: bool = False) -> DataFrame:
        stages.append((name, out, note, counts))
        return out

    if plan.drop:
        df = push("drop_columns", drop_columns(df, plan.drop), counts=True)
    if plan.encode:
        out, notes = encode(df, plan.encode, plan.order_by)
        df = push("encode_categorical", out, "; ".join(notes), True)
    if plan.snake:
        df = push("standardize_column_names", snake_names(df))
    if plan.remove_duplicates:
        # Everything after this reads the table several times: shuffle for duplicates once, keep it.
        df = push("remove_duplicates", materialise(deduplicate(df), "dedup"), counts=True)
    df = push("handle_nulls", fill_nulls(df, plan.null_strategy, plan.exact), plan.null_strategy, True)
    if plan.trim:
        df = push("normalize_text", trim_text(df))
    if plan.case != "none":
        df = push("normalize_case", change_case(df, plan.case), plan.case)
    if plan.outliers:
        df = push("remove_outliers", remove_outliers(df, plan.multiplier, plan.exact), counts=True)

    report = None
    counted = None
    for i, (name, stage, note, counts) in enumerate(stages):
        if counts:
            kinds = field_kinds(stage)
            nulls = F.lit(0)
            for c, t in kinds.items():
                nulls = nulls + present(c, t).isNull().cast("long")
            counted = stage.agg(F.count("*").alias("rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("nulls"))
        row = counted.select(F.lit(i).alias("position"), F.lit(name).alias("step"), "rows", "nulls",
                             F.lit(len(stage.columns)).alias("columns"), F.lit(note).alias("note"))
        report = row if report is None else report.unionAll(row)
    return df, report


# ---- advice -------------------------------------------------------------------------------------

# Date layouts that the date tests accept, each with the shape of the texts it can read.
DATE_LAYOUTS = ((r"\d{4}-\d{2}-\d{2}", "yyyy-MM-dd"), (r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}", "yyyy-MM-dd HH:mm:ss"),
                (r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}", "yyyy-MM-dd'T'HH:mm:ss"), (r"\d{4}/\d{2}/\d{2}", "yyyy/MM/dd"),
                (r"\d{2}/\d{2}/\d{4}", "MM/dd/yyyy"), (r"\d{2}-\d{2}-\d{4}", "dd-MM-yyyy"),
                (r"\d{2}\.\d{2}\.\d{4}", "dd.MM.yyyy"), (r"\p{L}{3} \d{1,2} \d{4}", "MMM d yyyy"),
                (r"\d{1,2} \p{L}{3} \d{4}", "d MMM yyyy"), (r"\p{L}{3,12} \d{1,2}, \d{4}", "MMMM d, yyyy"))


def looks_like_date(c: Column) -> Column:
    """Whether text parses under one of the layouts. Its shape names the only one that can fit, so a cell is parsed
    once at most, and most texts never."""
    chosen = F.lit(None).cast("timestamp")
    for shape, layout in reversed(DATE_LAYOUTS):
        chosen = F.when(c.rlike(f"^{shape}$"), F.try_to_timestamp(c, F.lit(layout))).otherwise(chosen)
    return F.when(c.rlike(r"\d{2}$"), chosen).isNotNull()


def recommend(df: DataFrame, exact: bool = True) -> DataFrame:
    """(position, column, kind, priority, reason): advice per column, cheapest actions first.

    The pattern shares are measured on all values, not on a head sample.
    """
    def is_plain(t: T.DataType) -> bool:
        return not is_number(t) and not isinstance(t, T.BooleanType)

    def measures(n: str, t: T.DataType) -> dict[str, Column]:
        c = present(n, t)
        s = c.cast("string")
        hit = (lambda e: F.count_if(e)) if is_plain(t) else (lambda e: F.max(F.lit(0)).cast("long"))
        return {"filled": F.count(c), "kind": F.max(F.lit(
                    "numeric" if is_number(t) else "boolean" if isinstance(t, T.BooleanType) else "text")),
                "padded": hit(s != strip(s)), "dated": hit(looks_like_date(s)),
                "numbered": hit(strip(s).try_cast("double").isNotNull())}

    facts = wide_stats(df, measures, table={"total": F.count("*")})
    values = distinct_stats(df).select("column", "distinct")
    text_names = [n for n, t in field_kinds(df).items() if is_plain(t)]
    facts = facts.join(values, "column", "left").fillna({"distinct": 0})
    if text_names:
        lowered = distinct_stats(df.select(*[F.lower(cell(c).cast("string")).alias(c) for c in text_names]))
        facts = facts.join(lowered.select("column", F.col("distinct").alias("folded")), "column", "left")
    else:
        facts = facts.withColumn("folded", F.lit(None).cast("long"))
    numeric = numeric_columns(df)
    if numeric:
        fences = {r["column"]: (r["q0"] - 3 * (r["q1"] - r["q0"]), r["q1"] + 3 * (r["q1"] - r["q0"]))
                  for r in quantiles(df, numeric, [0.25, 0.75], exact).collect() if r["q1"] > r["q0"]}
    else:
        fences = {}
    if fences:
        outside = outlier_report(df, fences).select("column", F.col("flagged").alias("outside"))
        facts = facts.join(outside, "column", "left")
    else:
        facts = facts.withColumn("outside", F.lit(None).cast("long"))

    total, filled, distinct = F.col("total"), F.col("filled"), F.col("distinct")
    nulls = total - filled
    text = F.col("kind") == "text"
    not_numeric = F.col("kind") != "numeric"
    drop = (F.when(nulls / total >= 0.7, "missing")
            .when((distinct <= 1) & (total > 1), "single value")
            .when((distinct == total) & (total >= 10) & not_numeric, "identifier"))
    keep = drop.isNull()

    def action(when: Column, kind: str, priority: int, reason: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(priority).alias("priority"),
                                     reason.cast("string").alias("reason")))

    actions = F.array_compact(F.array(
        action(~keep, "drop", 1, drop),
        action(keep & not_numeric & distinct.between(2, 10), "encode_onehot", 2, distinct),
        action(keep & not_numeric & distinct.between(11, 50), "encode_label", 2, distinct),
        action(keep & text & (filled > 0) & (F.col("numbered") / filled >= 0.9) & (distinct >= 5),
               "coerce_numeric", 2, F.col("numbered")),
        action(keep & (nulls > 0) & ~not_numeric, "fill_median", 3, nulls),
        action(keep & (nulls > 0) & not_numeric, "fill_mode", 3, nulls),
        action(keep & ~not_numeric & (filled >= 20) & (F.col("outside") > 0)
               & (F.col("outside") / filled >= 0.005), "handle_outliers", 4, F.col("outside")),
        action(keep & text & (F.col("padded") > 0), "trim_whitespace", 5, F.col("padded")),
        action(keep & text & (filled > 0) & (F.col("dated") / filled >= 0.8), "parse_date", 6, F.col("dated")),
        action(text & (F.col("folded") < distinct), "lower_case", 7, distinct - F.col("folded"))))
    clean_note = F.array(F.struct(F.lit("noop").alias("kind"), F.lit(9).alias("priority"),
                                  F.lit("looks clean").alias("reason")))
    out = facts.withColumn("a", F.explode(F.when(F.size(actions) > 0, actions).otherwise(clean_note)))
    return out.select("position", "column", F.col("a.kind").alias("kind"),
                      F.col("a.priority").alias("priority"), F.col("a.reason").alias("reason"))


def null_strategy_hint(df: DataFrame) -> DataFrame:
    """The table-wide strategy by mean share of missing cells."""
    share = null_counts(df).agg(F.avg(F.col("nulls") / F.col("total")).alias("null_share"))
    return share.select("null_share", F.when(F.col("null_share") == 0, None)
                        .when(F.col("null_share") < 0.05, "fill_mode")
                        .when(F.col("null_share") < 0.20, "fill_median").otherwise("drop_rows").alias("strategy"))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First ``n`` rows in key order (a bounded heap per partition, no full sort)."""
    return df.orderBy(*[cell(c) for c in order_by]).limit(n)
