"""Label quality over entries (item_id, label, confidence)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import grade

# Weights and the limits below which advice is given.
WEIGHTS = {"coverage": 0.25, "balance": 0.20, "confidence": 0.20, "consistency": 0.20, "completeness": 0.15}
ADVICE = {"coverage": (80, "label more items"), "balance": (70, "collect more examples of rare labels"),
          "confidence": (70, "review labels of low confidence"), "consistency": (80, "resolve conflicting labels"),
          "completeness": (80, "label items of the missing classes")}


def coverage(entries: DataFrame, total_items: int | None = None) -> DataFrame:
    """(labeled, total, score). ``total_items`` is the table's row count; items outside it still count."""
    facts = entries.agg(F.count_distinct("item_id").alias("labeled"))
    total = F.greatest("labeled", F.lit(total_items or 0).cast("long"))
    score = F.when(total > 0, F.least(F.col("labeled") / total * 100, F.lit(100.0))).otherwise(0.0)
    return facts.select("labeled", total.alias("total"), F.round(score, 2).alias("score"))


def balance(entries: DataFrame) -> DataFrame:
    """(classes, entropy, score): entropy over the class counts, which are few rows."""
    counts = entries.groupBy("label").agg(F.count("*").alias("n"))
    # H = ln N - sum(n ln n) / N needs the counts only once.
    facts = counts.agg(F.count("*").alias("classes"), F.sum("n").alias("total"),
                       F.sum(F.col("n") * F.ln("n")).alias("s"))
    entropy = F.ln("total") - F.col("s") / F.col("total")
    score = F.when(F.col("classes") <= 1, 100.0).otherwise(entropy / F.ln("classes") * 100)
    return facts.select("classes", F.round(F.when(F.col("classes") <= 1, 0.0).otherwise(entropy), 4).alias("entropy"),
                        F.round(score, 2).alias("score"))


def confidence(entries: DataFrame) -> DataFrame:
    facts = entries.agg(F.avg("confidence").alias("mean"), F.min("confidence").alias("low"),
                        F.max("confidence").alias("high"), F.count("confidence").alias("n"))
    return facts.select(*[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(c) for c in ("mean", "low", "high")], "n",
                        F.round(F.least(F.coalesce("mean", F.lit(0.0)) * 100, F.lit(100.0)), 2).alias("score"))


def consistency(entries: DataFrame) -> DataFrame:
    """(multi_source, agreeing, score) over items with more than one entry."""
    items = entries.groupBy("item_id").agg(F.count("*").alias("n"), F.min("label").alias("low"),
                                           F.max("label").alias("high"))
    facts = items.filter("n > 1").agg(F.count("*").alias("multi_source"),
                                      F.count_if(F.col("low") == F.col("high")).alias("agreeing"))
    score = F.when(F.col("multi_source") > 0, F.col("agreeing") / F.col("multi_source") * 100).otherwise(100.0)
    return facts.select("multi_source", "agreeing", F.round(score, 2).alias("score"))


def completeness(entries: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """(found, expected, missing, score); one conditional count per expected label."""
    wanted = sorted(set(expected or []))
    if not wanted:
        return entries.agg(F.count_distinct("label").alias("found")).select(
            "found", F.lit(0).alias("expected"), F.array().cast("array<string>").alias("missing"),
            F.lit(100.0).alias("score"))
    facts = entries.agg(*[F.count_if(F.col("label") == w).alias(f"n{i}") for i, w in enumerate(wanted)])
    found: Column = sum((F.when(F.col(f"n{i}") > 0, 1).otherwise(0) for i in range(len(wanted))), F.lit(0))
    missing = F.array_compact(F.array(*[F.when(F.col(f"n{i}") == 0, w) for i, w in enumerate(wanted)]))
    return facts.select(found.cast("long").alias("found"), F.lit(len(wanted)).alias("expected"),
                        missing.alias("missing"), F.round(found / len(wanted) * 100, 2).alias("score"))


def evaluate(entries: DataFrame, total_items: int, expected: Sequence[str] | None = None) -> DataFrame:
    """(dimension, score, weight): the five scores; all zero when there is nothing to evaluate."""
    if total_items <= 0 and entries.isEmpty():
        rows = [(k, 0.0, w) for k, w in WEIGHTS.items()]
        return entries.sparkSession.createDataFrame(rows, "dimension string, score double, weight double")
    parts = {"coverage": coverage(entries, total_items), "balance": balance(entries),
             "confidence": confidence(entries), "consistency": consistency(entries),
             "completeness": completeness(entries, expected)}
    out = None
    for name, part in parts.items():
        row = part.select(F.lit(name).alias("dimension"), "score", F.lit(WEIGHTS[name]).alias("weight"))
        out = row if out is None else out.unionAll(row)
    return out


def summary(scores: DataFrame) -> DataFrame:
    """(overall, grade, advice)."""
    advice = F.lit(None).cast("string")
    for name, (limit, text) in ADVICE.items():
        advice = F.when((F.col("dimension") == name) & (F.col("score") < limit), text).otherwise(advice)
    facts = scores.agg((F.sum(F.col("score") * F.col("weight")) / F.sum("weight")).alias("raw"),
                       F.sort_array(F.collect_list(advice)).alias("advice"))
    return facts.select(F.round("raw", 2).alias("overall"), grade(F.round("raw", 9)).alias("grade"), "advice")
