"""Queries over dataset, version, metadata and run tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import Pages, page

# Allowed status moves, and the mark of a deleted dataset.
TRANSITIONS = {"labeled": ("reviewed",), "reviewed": ("ready",)}
DELETED = "[DELETED] "


def latest_version(versions: DataFrame, version: int | None = None) -> DataFrame:
    """The newest version row per dataset, or the rows of one exact version.

    ``max_by`` combines on the map side, so a dataset with very many versions costs nothing extra.
    """
    if version is not None:
        return versions.filter(F.col("version_number") == version)
    rest = [c for c in versions.columns if c != "dataset_id"]
    newest = versions.groupBy("dataset_id").agg(F.max_by(F.struct(*rest), "version_number").alias("v"))
    return newest.select("dataset_id", "v.*")


NEWEST, BY_AGE, LATEST_RUNS = ["-created_at", "dataset_id"], ["created_at", "asset_id"], ["-completed_at", "run_id"]


def visible_datasets(datasets: DataFrame, status: str | None = None) -> DataFrame:
    visible = datasets.filter(~F.col("name").startswith(DELETED))
    return visible.filter(F.col("status") == status) if status else visible


def list_datasets(datasets: DataFrame, versions: DataFrame, status: str | None = None, skip: int = 0,
                  limit: int = 20, pages: Pages | None = None) -> DataFrame:
    """Newest first, with the newest version's row count and the number of versions.

    The page is cut before the join, so only versions of at most ``limit`` datasets are aggregated.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    head = page(visible_datasets(datasets, status), NEWEST, skip, limit, "dataset_id", pages)
    facts = versions.join(F.broadcast(head.select("dataset_id")), "dataset_id", "left_semi").groupBy("dataset_id").agg(
        F.max_by("row_count", "version_number").alias("row_count"), F.count("*").alias("version_count"))
    return head.join(facts, "dataset_id", "left").withColumn("version_count", F.coalesce("version_count", F.lit(0)))


def count_datasets(datasets: DataFrame, status: str | None = None) -> DataFrame:
    visible = datasets.filter(~F.col("name").startswith(DELETED))
    return (visible.filter(F.col("status") == status) if status else visible).agg(F.count("*").alias("total"))


def next_version(datasets: DataFrame, versions: DataFrame) -> DataFrame:
    """(dataset_id, next_version, parent_version)."""
    top = versions.groupBy("dataset_id").agg(F.max("version_number").alias("parent_version"))
    return datasets.select("dataset_id").join(top, "dataset_id", "left").select(
        "dataset_id", (F.coalesce("parent_version", F.lit(0)) + 1).alias("next_version"), "parent_version")


def versions_of(versions: DataFrame, dataset_id: int) -> DataFrame:
    return versions.filter(F.col("dataset_id") == dataset_id).orderBy("version_number")


def upsert(current: DataFrame, changes: DataFrame, key: Sequence[str], order_by: str) -> DataFrame:
    """Newest row per key of both tables."""
    rest = [c for c in current.columns if c not in key]
    both = current.unionByName(changes)
    newest = both.groupBy(*key).agg(F.max_by(F.struct(*rest), order_by).alias("_v"))
    return newest.select(*key, "_v.*")


def status_transitions(datasets: DataFrame, moves: DataFrame) -> DataFrame:
    """Requested moves (dataset_id, target) with the current status and whether each is allowed."""
    allowed = F.lit(False)
    for source, targets in TRANSITIONS.items():
        allowed = allowed | ((F.col("status") == source) & F.col("target").isin(*targets))
    return moves.join(datasets.select("dataset_id", "status"), "dataset_id", "left").withColumn(
        "accepted", F.coalesce(allowed, F.lit(False)))


def soft_delete(datasets: DataFrame, deleted: DataFrame) -> DataFrame:
    """Datasets with the deleted ones marked by name prefix (once)."""
    keys = deleted.select("dataset_id").distinct().withColumn("_d", F.lit(True))
    marked = F.when(F.col("_d") & ~F.col("name").startswith(DELETED), F.concat(F.lit(DELETED), "name"))
    return datasets.join(keys, "dataset_id", "left").withColumn(
        "name", F.coalesce(marked, F.col("name"))).drop("_d")


def visible(datasets: DataFrame) -> DataFrame:
    return datasets.filter(~F.col("name").startswith(DELETED))


def rule_sets(table: DataFrame) -> DataFrame:
    """Saved rule sets (id, name, rules JSON, created_at), newest first, with the number of rules."""
    return table.withColumn("rule_count", F.coalesce(F.json_array_length("rules"), F.lit(0))).orderBy(
        F.desc("created_at"), "rule_set_id")


def gallery(assets: DataFrame, cluster: int | None = None, skip: int = 0, limit: int = 50, pages: Pages | None = None) -> DataFrame:
    chosen = assets if cluster is None else assets.filter(F.col("cluster_id") == cluster)
    return page(chosen, BY_AGE, skip, limit, "asset_id", pages)


def gallery_counts(assets: DataFrame) -> DataFrame:
    return assets.agg(F.count("*").alias("total"), F.count("embedding_id").alias("embedded"))


def detail(datasets: DataFrame, versions: DataFrame, metadata: DataFrame, dataset_id: int) -> DataFrame:
    """(section, position, key, value) of one dataset: facts, versions and metadata as rows, not nested lists."""
    head = datasets.filter(F.col("dataset_id") == dataset_id).select(
        F.lit("dataset").alias("section"), F.lit(0).cast("long").alias("position"), F.col("name").alias("key"),
        F.col("status").alias("value"))
    parts = versions.filter(F.col("dataset_id") == dataset_id).select(
        F.lit("version"), F.col("version_number").cast("long"), F.col("version_number").cast("string"),
        F.col("row_count").cast("string"))
    meta = metadata.filter(F.col("dataset_id") == dataset_id).select(
        F.lit("metadata"), F.col("seq").cast("long"), "key", "value")
    return head.unionAll(parts).unionAll(meta)


def runs(table: DataFrame, dataset_id: int | None = None, run_type: str | None = None, status: str | None = None,
         skip: int = 0, limit: int = 20, pages: Pages | None = None) -> DataFrame:
    return page(chosen_runs(table, dataset_id, run_type, status), LATEST_RUNS, skip, limit, "run_id", pages)


def chosen_runs(table: DataFrame, dataset_id: int | None = None, run_type: str | None = None, status: str | None = None) -> DataFrame:
    for column, value in (("dataset_id", dataset_id), ("run_type", run_type), ("status", status)):
        if value is not None:
            table = table.filter(F.col(column) == value)
    return table


def latest_report(table: DataFrame) -> DataFrame:
    """(dataset_id, run_type, run_id, report) of the newest completed run."""
    done = table.filter("status = 'completed'").groupBy("dataset_id", "run_type").agg(
        F.max_by(F.struct("run_id", "report"), "completed_at").alias("r"))
    return done.select("dataset_id", "run_type", "r.*")


def delete_cascade(tables: dict[str, DataFrame], deleted: DataFrame, key: str) -> dict[str, DataFrame]:
    """Each dependent table without the rows of the deleted keys."""
    keys = deleted.select(key).distinct()
    return {name: t.join(keys, key, "left_anti") for name, t in tables.items()}
