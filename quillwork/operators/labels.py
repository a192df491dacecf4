"""Merging labels of several sources, choosing items for review.

Input is one long table ``label_events(item_id, source_type, label, confidence, seq)``. All work is by
aggregation with map-side combining, so an item with very many events is never gathered in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Source order (unknown sources come last) and source per run type.
PRIORITY = {"manual": 0, "rule": 1, "ai": 2, "propagation": 3}
UNKNOWN_PRIORITY = 99
SOURCE_OF_RUN = {"labeling": "rule", "ai_labeling": "ai", "aggregation": "aggregation",
                 "propagation": "propagation"}
STRATEGIES = ("confidence_weighted", "majority_vote", "priority")

_PREDICTION = ("array<struct<text:string,item_id:string,final_label:string,predicted_label:string,"
               "propagated_label:string,label:string,confidence:double,review_status:string>>")
# Where a run result may hold its predictions, in search order.
RESULT_PLACES = ("aggregation.results", "ai_labeling.predictions", "labeling.predictions",
                 "propagation.results", "predictions", "results")
RESULT_SCHEMA = (f"aggregation struct<results:{_PREDICTION}>, ai_labeling struct<predictions:{_PREDICTION}>, "
                 f"labeling struct<predictions:{_PREDICTION}>, propagation struct<results:{_PREDICTION}>, "
                 f"predictions {_PREDICTION}, results {_PREDICTION}")


def _first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def normalize_results(runs: DataFrame, result: str = "result", run_type: str = "run_type",
                      keep: Sequence[str] = ()) -> DataFrame:
    """Run results in any of the known layouts as (item_id, label, confidence, source, review_status, ...)."""
    parsed = runs.withColumn("_r", F.from_json(result, RESULT_SCHEMA))
    places = [F.col(f"_r.{p}") for p in RESULT_PLACES]
    filled = F.coalesce(*[F.when(F.size(p) > 0, p) for p in places])
    source = F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_OF_RUN.items() for x in kv])[F.col(run_type)],
                        F.lit("rule"))
    flat = parsed.select(*keep, source.alias("source"), F.posexplode(filled).alias("position", "p"))
    return flat.select(
        *keep, "source", "position",
        _first_filled(F.col("p.text"), F.col("p.item_id")).alias("item_id"),
        F.coalesce(_first_filled(F.col("p.final_label"), F.col("p.predicted_label"),
                                 F.col("p.propagated_label"), F.col("p.label")), F.lit("")).alias("label"),
        F.coalesce("p.confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("p.review_status", F.lit("")).alias("review_status")).filter("item_id is not null")


def valid_events(events: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    out = events.filter("label is not null and label <> ''")
    return out.filter(F.col("source_type").isin(list(sources))) if sources is not None else out


def _rank_of_source() -> Column:
    order = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(order[F.col("source_type")], F.lit(UNKNOWN_PRIORITY))


def per_label(events: DataFrame) -> DataFrame:
    """Votes of each (item, label): the only shuffle of events, after map-side combining."""
    turn = F.struct(_rank_of_source().alias("rank"), F.col("seq"))
    return valid_events(events).groupBy("item_id", "label").agg(
        F.count("*").alias("votes"), F.round(F.sum("confidence"), 9).alias("weight"),
        F.max("confidence").alias("best"), F.min("seq").alias("first_seq"),
        F.min(turn).alias("turn"), F.min_by("confidence", turn).alias("turn_confidence"))


def aggregate(events: DataFrame, strategy: str = "confidence_weighted") -> DataFrame:
    """(item_id, final_label, confidence, agreement, sources, labels) per item with a label."""
    earliest = -F.col("first_seq")
    if strategy == "confidence_weighted":
        order = F.struct(F.col("weight"), earliest)
    elif strategy == "majority_vote":
        order = F.struct(F.col("votes"), F.col("best"), earliest)
    elif strategy == "priority":
        order = F.struct(-F.col("turn.rank"), -F.col("turn.seq"))
    else:
        raise ValueError(f"unknown strategy {strategy!r}; use one of {STRATEGIES}")
    chosen = per_label(events).groupBy("item_id").agg(
        F.max_by(F.struct("label", "votes", "weight", "turn_confidence"), order).alias("w"),
        F.sum("votes").alias("sources"), F.sum("weight").alias("total"), F.count("*").alias("labels"))
    share = {"confidence_weighted": F.when(F.col("total") > 0, F.col("w.weight") / F.col("total")).otherwise(0.0),
             "majority_vote": F.col("w.votes") / F.col("sources"),
             "priority": F.col("w.turn_confidence")}[strategy]
    return chosen.select(
        "item_id", F.col("w.label").alias("final_label"), F.round(share, 4).alias("confidence"),
        F.round(F.col("w.votes") / F.col("sources"), 4).alias("agreement"), "sources", "labels")


def aggregate_report(events: DataFrame) -> DataFrame:
    """(total_items, labeled, multi_source, single_source, conflicts); blank-only items count in the total."""
    valid = F.col("label").isNotNull() & (F.col("label") != "")
    per_item = events.groupBy("item_id").agg(
        F.count_if(valid).alias("n"), F.min(F.when(valid, F.col("label"))).alias("low"),
        F.max(F.when(valid, F.col("label"))).alias("high"))
    return per_item.agg(
        F.count("*").alias("total_items"), F.count_if(F.col("n") > 0).alias("labeled"),
        F.count_if(F.col("n") > 1).alias("multi_source"), F.count_if(F.col("n") == 1).alias("single_source"),
        F.count_if(F.col("low") != F.col("high")).alias("conflicts"))


def label_distribution(aggregated: DataFrame) -> DataFrame:
    return aggregated.groupBy(F.col("final_label").alias("label")).agg(F.count("*").alias("count"))


def active_learning(events: DataFrame, n: int = 20) -> DataFrame:
    """(item_id, uncertainty, conflicting): most uncertain items first; without a label the score is 1."""
    totals = per_label(events).groupBy("item_id").agg(
        F.sum("votes").alias("sources"), F.max("votes").alias("most"), F.sum("weight").alias("weight"),
        F.sort_array(F.collect_set("label")).alias("labels"))  # bounded by the number of label values
    items = events.select("item_id").distinct().join(totals, "item_id", "left")
    score = 0.5 * (1 - F.col("most") / F.col("sources")) + 0.5 * (1 - F.col("weight") / F.col("sources"))
    return (items.select("item_id", F.round(F.coalesce(score, F.lit(1.0)), 4).alias("uncertainty"),
                         F.when(F.size("labels") > 1, F.col("labels")).otherwise(
                             F.array().cast("array<string>")).alias("conflicting"))
            .orderBy(F.desc("uncertainty"), "item_id").limit(n))


def unlabeled(vectors: DataFrame, labeled: DataFrame, vector_id: str, item_id: str = "item_id") -> DataFrame:
    """Ids of the vector table without a label."""
    keys = labeled.select(F.col(item_id).alias("_k")).distinct()
    return vectors.select(vector_id).distinct().join(keys, F.col(vector_id) == F.col("_k"), "left_anti")
