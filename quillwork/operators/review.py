"""Review decisions over predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUS = {"approve": "approved", "reject": "rejected", "relabel": "relabeled"}


def _status(action: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[action]


def apply_actions(predictions: DataFrame, actions: DataFrame) -> DataFrame:
    """Predictions with label, review_status and original_label after all actions in ``seq`` order.

    The label is that of the last relabelling; the original is what it replaced.
    """
    last = actions.groupBy("item_id").agg(F.max_by("action", "seq").alias("last_action"))
    relabels = actions.filter("action = 'relabel'").select("item_id", "new_label", "seq")
    latest = relabels.groupBy("item_id").agg(F.max_by("new_label", "seq").alias("relabel"), F.max("seq").alias("at"))
    before = (relabels.join(latest.select("item_id", "at"), "item_id").filter("seq < at")
              .groupBy("item_id").agg(F.max_by("new_label", "seq").alias("replaced"), F.count("*").alias("earlier")))
    out = (predictions.join(last, "item_id", "left").join(latest, "item_id", "left").join(before, "item_id", "left"))
    return out.select(
        "item_id", F.when(F.col("at").isNotNull(), F.col("relabel")).otherwise(F.col("label")).alias("label"),
        "confidence", F.coalesce(_status(F.col("last_action")), F.lit("")).alias("review_status"),
        F.when(F.col("earlier") > 0, F.col("replaced")).when(F.col("at").isNotNull(), F.col("label"))
        .alias("original_label"))


def action_counts(predictions: DataFrame, actions: DataFrame) -> DataFrame:
    """(approved, rejected, relabeled, not_found): every action counts, repeated ones included."""
    known = predictions.select("item_id", F.lit(True).alias("known")).distinct()
    flat = actions.groupBy("item_id").agg(*[F.count_if(F.col("action") == a).alias(a) for a in STATUS])
    joined = flat.join(known, "item_id", "left")
    sums = [F.coalesce(F.sum(F.when(F.col("known"), F.col(a))), F.lit(0)).alias(s) for a, s in STATUS.items()]
    lost = F.coalesce(F.sum(F.when(F.col("known").isNull(), sum((F.col(a) for a in STATUS), F.lit(0)))), F.lit(0))
    return joined.agg(*sums, lost.alias("not_found"))


def status_counts(log: DataFrame) -> DataFrame:
    """(total_reviewed, approved, rejected, relabeled) by the latest action of each item."""
    latest = log.groupBy("item_id").agg(F.max_by("action", "seq").alias("action"))
    return latest.agg(F.count_if(F.col("action").isin(*STATUS)).alias("total_reviewed"),
                      *[F.count_if(F.col("action") == a).alias(s) for a, s in STATUS.items()])


def export_items(entries: DataFrame, order: tuple[str, ...] = ("completed_at", "position")) -> DataFrame:
    """(item_id, label, confidence, review_status): the newest entry of each item wins."""
    newest = F.struct(*order)
    return entries.groupBy("item_id").agg(
        F.max_by(F.struct("label", "confidence", "review_status"), newest).alias("e")).select("item_id", "e.*")
