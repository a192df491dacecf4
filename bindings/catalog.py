"""Catalog tables made from orders, customers and events."""

from pyspark.sql import functions as F

from quillwork.operators import catalog as C
from quillwork.operators.ranking import store_pages

from .base import INPUTS, load, register

INPUTS["moves"] = """
    SELECT c_custkey AS dataset_id, CASE c_custkey % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'reviewed' ELSE 'raw' END AS target
    FROM {customer} WHERE c_custkey % 2 = 0"""
INPUTS["saved_rules"] = """
    SELECT o_orderkey AS rule_set_id, o_orderdate AS created_at,
           CASE o_orderkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[{{"label":"a","column":"x","operator":"is_null"}}]'
                ELSE '[{{"label":"a"}},{{"label":"b"}}]' END AS rules
    FROM {orders}"""


def versions(spark, sf):
    return load(spark, sf, "versions")


def datasets(spark, sf):
    return load(spark, sf, "datasets")


LISTED = """
    WITH p AS (SELECT * FROM datasets WHERE status = 'ready' ORDER BY created_at DESC, dataset_id LIMIT 50 OFFSET 20)
    SELECT p.*, arg_max(v.row_count, v.version_number) AS row_count, count(v.dataset_id) AS version_count
    FROM p LEFT JOIN versions v USING (dataset_id) GROUP BY ALL"""


@register("cat_list_stored", LISTED)
def cat_list_stored(spark, sf):
    """A page by the directory of the stored order; the small parts make it span several."""
    pages = store_pages(C.visible_datasets(datasets(spark, sf), "ready"), C.NEWEST, rows_per_part=15)
    return C.list_datasets(datasets(spark, sf), versions(spark, sf), "ready", 20, 50, pages)


@register("cat_list", LISTED)
def cat_list(spark, sf):
    return C.list_datasets(datasets(spark, sf), versions(spark, sf), "ready", 20, 50)


@register("cat_list_total", "SELECT count(*) AS total FROM datasets WHERE status = 'ready'")
def cat_list_total(spark, sf):
    return C.count_datasets(datasets(spark, sf), "ready")


@register("cat_latest_version", """SELECT * FROM versions
    QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY version_number DESC) = 1""")
def cat_latest_version(spark, sf):
    return C.latest_version(versions(spark, sf))


@register("cat_exact_version", "SELECT * FROM versions WHERE version_number = 2")
def cat_exact_version(spark, sf):
    return C.latest_version(versions(spark, sf), 2)


@register("cat_next_version", """SELECT d.dataset_id, coalesce(max(version_number), 0) + 1 AS next_version,
    max(version_number) AS parent_version FROM datasets d LEFT JOIN versions v USING (dataset_id) GROUP BY d.dataset_id""")
def cat_next_version(spark, sf):
    return C.next_version(datasets(spark, sf), versions(spark, sf))


@register("cat_versions", "SELECT * FROM versions WHERE dataset_id = 7 ORDER BY version_number")
def cat_versions(spark, sf):
    return C.versions_of(versions(spark, sf), 7)


@register("cat_metadata_upsert", """SELECT dataset_id, key, arg_max(seq, seq) AS seq, arg_max(value, seq) AS value
    FROM dataset_meta GROUP BY dataset_id, key""")
def cat_metadata_upsert(spark, sf):
    meta = load(spark, sf, "dataset_meta")
    return C.upsert(meta.filter("seq % 3 <> 0"), meta.filter("seq % 3 = 0"), ["dataset_id", "key"], "seq").select(
        "dataset_id", "key", "seq", "value")


@register("cat_status_transition", """SELECT m.dataset_id, target, status,
    (status = 'labeled' AND target = 'reviewed') OR (status = 'reviewed' AND target = 'ready') AS accepted
    FROM moves m JOIN datasets USING (dataset_id)""")
def cat_status_transition(spark, sf):
    return C.status_transitions(datasets(spark, sf), load(spark, sf, "moves"))


@register("cat_soft_delete", """SELECT dataset_id, CASE WHEN dataset_id IN (SELECT dataset_id FROM moves)
    THEN '[DELETED] ' || name ELSE name END AS name, status, created_at FROM datasets""")
def cat_soft_delete(spark, sf):
    once = C.soft_delete(datasets(spark, sf), load(spark, sf, "moves"))
    return C.soft_delete(once, load(spark, sf, "moves"))


@register("cat_rule_sets", """SELECT *, CAST(json_array_length(rules) AS INT) AS rule_count FROM saved_rules""")
def cat_rule_sets(spark, sf):
    return C.rule_sets(load(spark, sf, "saved_rules"))


GALLERY = """SELECT asset_id, created_at, asset_id % 7 AS cluster_id,
    CASE WHEN asset_id % 4 <> 0 THEN asset_id END AS embedding_id FROM assets"""


def _gallery(spark, sf):
    return load(spark, sf, "assets").select(
        "asset_id", "created_at", (F.col("asset_id") % 7).alias("cluster_id"),
        F.when(F.col("asset_id") % 4 != 0, F.col("asset_id")).alias("embedding_id"))


@register("cat_gallery_stored", f"SELECT * FROM ({GALLERY}) g WHERE cluster_id = 3 ORDER BY created_at, asset_id LIMIT 50 OFFSET 100")
def cat_gallery_stored(spark, sf):
    assets = _gallery(spark, sf)
    return C.gallery(assets, 3, 100, 50, store_pages(assets.filter("cluster_id = 3"), C.BY_AGE, rows_per_part=40))


@register("cat_gallery", f"SELECT * FROM ({GALLERY}) g WHERE cluster_id = 3 ORDER BY created_at, asset_id LIMIT 50 OFFSET 100")
def cat_gallery(spark, sf):
    return C.gallery(_gallery(spark, sf), 3, 100, 50)


@register("cat_gallery_counts", f"SELECT count(*) AS total, count(embedding_id) AS embedded FROM ({GALLERY}) g")
def cat_gallery_counts(spark, sf):
    return C.gallery_counts(_gallery(spark, sf))


@register("cat_detail", """
    SELECT 'dataset' AS section, CAST(0 AS BIGINT) AS position, name AS key, status AS value FROM datasets WHERE dataset_id = 10
    UNION ALL SELECT 'version', version_number, CAST(version_number AS VARCHAR), CAST(row_count AS VARCHAR)
    FROM versions WHERE dataset_id = 10
    UNION ALL SELECT 'metadata', seq, key, value FROM dataset_meta WHERE dataset_id = 10""")
def cat_detail(spark, sf):
    return C.detail(datasets(spark, sf), versions(spark, sf), load(spark, sf, "dataset_meta"), 10)


@register("cat_runs", """SELECT * FROM runs WHERE run_type = 'profile' AND status = 'completed'
    ORDER BY completed_at DESC, run_id LIMIT 100 OFFSET 20""")
def cat_runs(spark, sf):
    return C.runs(load(spark, sf, "runs"), None, "profile", "completed", 20, 100)


@register("cat_runs_stored", """SELECT * FROM runs WHERE run_type = 'profile' AND status = 'completed'
    ORDER BY completed_at DESC, run_id LIMIT 100 OFFSET 20""")
def cat_runs_stored(spark, sf):
    runs = load(spark, sf, "runs")
    pages = store_pages(C.chosen_runs(runs, None, "profile", "completed"), C.LATEST_RUNS, rows_per_part=70)
    return C.runs(runs, None, "profile", "completed", 20, 100, pages)


@register("cat_latest_report", """SELECT dataset_id, run_type, arg_max(run_id, completed_at) AS run_id,
    arg_max(report, completed_at) AS report FROM runs WHERE status = 'completed' GROUP BY dataset_id, run_type""")
def cat_latest_report(spark, sf):
    return C.latest_report(load(spark, sf, "runs"))


@register("cat_delete_cascade", """
    SELECT 'versions' AS t, count(*) AS n FROM versions WHERE dataset_id NOT IN (SELECT dataset_id FROM moves)
    UNION ALL SELECT 'metadata', count(*) FROM dataset_meta WHERE dataset_id NOT IN (SELECT dataset_id FROM moves)
    UNION ALL SELECT 'runs', count(*) FROM runs WHERE dataset_id NOT IN (SELECT dataset_id FROM moves)""")
def cat_delete_cascade(spark, sf):
    tables = {"versions": versions(spark, sf), "metadata": load(spark, sf, "dataset_meta"), "runs": load(spark, sf, "runs")}
    left = C.delete_cascade(tables, load(spark, sf, "moves"), "dataset_id")
    parts = [t.agg(F.lit(n).alias("t"), F.count("*").alias("n")) for n, t in left.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])
