"""Registry, table access and the derived inputs shared by both engines."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# Derived inputs. The text runs unchanged on both engines; {name} marks a base table or another input.
INPUTS = {
    "dirty_customer": """
        SELECT c_custkey,
               CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN concat('  ', c_name, ' ')
                    ELSE c_name END AS c_name,
               c_nationkey,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
               CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment)
                    ELSE c_mktsegment END AS c_mktsegment,
               CAST(NULL AS STRING) AS all_null,
               c_custkey % 2 AS flag
        FROM (SELECT * FROM {customer} UNION ALL SELECT * FROM {customer} WHERE c_custkey % 20 = 0) c""",
    "dirty_orders": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CASE WHEN o_orderkey % 50 = 0 THEN o_totalprice * 100 WHEN o_orderkey % 17 = 0 THEN NULL
                    ELSE o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority,
               lpad(CAST(o_orderkey % 30 AS STRING), 3, '0') AS code,
               o_orderdate
        FROM {orders}""",
    "label_events": """
        SELECT CAST(event_id % 997 AS STRING) AS item_id,
               CASE event_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'rule' WHEN 2 THEN 'ai'
                    ELSE 'propagation' END AS source_type,
               CASE WHEN event_id % 17 = 0 THEN '' ELSE event_type END AS label,
               least(value / 500, CAST(1 AS DOUBLE)) AS confidence,
               event_id AS seq
        FROM {events} WHERE value > 90""",
    "review_log": """
        SELECT CAST(user_id AS STRING) AS item_id,
               CASE event_type WHEN 'click' THEN 'approve' WHEN 'view' THEN 'reject' ELSE 'relabel' END AS action,
               CASE WHEN event_type = 'purchase' THEN 'buyer' END AS new_label,
               event_id AS seq
        FROM {events} WHERE event_type IN ('click', 'view', 'purchase')""",
    "assets": """
        SELECT o_orderkey AS asset_id, o_custkey % 3 AS dataset_id,
               concat('img_', CAST(o_orderkey % 5000 AS STRING),
                      CASE WHEN o_orderkey % 2 = 0 THEN '.jpg' ELSE '.png' END) AS file_name,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 320 + (o_orderkey % 10) * 64 END AS width,
               CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 240 + (o_orderkey % 7) * 48 END AS height,
               o_orderdate AS created_at
        FROM {orders}""",
    "states": """
        SELECT o_orderkey AS asset_id, o_custkey % 3 AS dataset_id,
               CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'annotated' ELSE 'rejected' END AS status,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 10 < 7 THEN 'train'
                    WHEN o_orderkey % 10 < 9 THEN 'valid' ELSE 'test' END AS split
        FROM {orders} WHERE o_orderkey % 4 <> 0""",
    "classes": """
        SELECT CASE name WHEN 'A' THEN 0 WHEN 'N' THEN 1 WHEN 'R' THEN 2 ELSE 3 END AS class_index, name
        FROM (SELECT DISTINCT l_returnflag AS name FROM {lineitem} UNION ALL SELECT 'unused' AS name) c""",
    "annotations": """
        SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),
                         CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS ann_key,
               l_orderkey AS asset_id, l_returnflag AS class_name,
               CASE WHEN l_linenumber % 5 = 0 THEN 'classification' WHEN l_linenumber % 5 = 3 THEN 'polygon'
                    ELSE 'bbox' END AS kind,
               CASE WHEN l_linenumber % 5 IN (0, 3) THEN NULL ELSE CAST(l_partkey % 100 AS DOUBLE) / 100 END AS x,
               CASE WHEN l_linenumber % 5 IN (0, 3) THEN NULL ELSE CAST(l_suppkey % 100 AS DOUBLE) / 100 END AS y,
               CASE WHEN l_linenumber % 5 IN (0, 3) THEN NULL ELSE l_quantity / 100 END AS w,
               CASE WHEN l_linenumber % 5 IN (0, 3) THEN NULL ELSE l_discount * 4 END AS h,
               CAST(l_partkey % 100 AS DOUBLE) / 100 AS px, CAST(l_suppkey % 100 AS DOUBLE) / 100 AS py
        FROM {lineitem}""",
    "versions": """
        SELECT o_custkey AS dataset_id,
               CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version_number,
               CAST(floor(o_totalprice) AS BIGINT) AS row_count,
               CASE WHEN o_orderkey % 6 = 0 THEN 'id,amount' ELSE 'id,amount,note' END AS columns_csv
        FROM {orders}""",
    "datasets": """
        SELECT c_custkey AS dataset_id, c_name AS name,
               CASE c_custkey % 5 WHEN 0 THEN 'raw' WHEN 1 THEN 'processed' WHEN 2 THEN 'labeled'
                    WHEN 3 THEN 'reviewed' ELSE 'ready' END AS status,
               c_custkey * 7919 % 100003 AS created_at
        FROM {customer}""",
    "dataset_meta": """
        SELECT event_id AS seq, user_id AS dataset_id, event_type AS key, CAST(event_id % 10 AS STRING) AS value
        FROM {events}""",
    "runs": """
        SELECT event_id AS run_id, user_id AS dataset_id,
               CASE event_type WHEN 'click' THEN 'profile' WHEN 'view' THEN 'cleaning' ELSE 'labeling' END AS run_type,
               CASE WHEN event_id % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
               event_id AS completed_at, props AS report
        FROM {events}""",
    "text_docs": """
        SELECT doc_id, source AS dataset, concat(source, '/', CAST(doc_id AS STRING), '.txt') AS name,
               text AS content, doc_id AS doc_index FROM {documents}""",
    "text_spans": """
        SELECT doc_id, lang AS class_name, 'span' AS kind, CAST(doc_id % 20 AS BIGINT) AS start_offset,
               CAST(doc_id % 20 + 5 + doc_id % 15 AS BIGINT) AS end_offset, doc_id * 2 AS seq
        FROM {documents} WHERE n_chars >= 40
        UNION ALL
        SELECT doc_id, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS class_name, 'doc' AS kind,
               CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), doc_id * 2 + 1 AS seq
        FROM {labels}""",
    "vectors": """
        SELECT vec_id, embedding, CASE WHEN vec_id % 10 < 3 THEN label END AS known_label FROM {embeddings}""",
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _names(text: str) -> list[str]:
    return re.findall(r"(?<!{){(\w+)}", text)


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A base table or a derived input."""
    if name in TABLES:
        return spark.read.parquet(f"{sf}/{name}.parquet")
    text = INPUTS[name]
    needed = set(_names(text))
    return spark.sql(text, **{n: load(spark, sf, n) for n in needed})


def _plain(text: str) -> str:
    """Placeholders as names, doubled braces as single ones."""
    return re.sub(r"(?<!{){(\w+)}", r"\1", text).replace("{{", "{").replace("}}", "}")


def _needed(sql: str) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for inner in _names(INPUTS[name]):
            if inner in INPUTS:
                visit(inner)
        if name not in order:
            order.append(name)

    for name in INPUTS:
        if re.search(rf"\b{name}\b", sql):
            visit(name)
    return order


def with_inputs(sql: str) -> str:
    """The SQL text preceded by the derived inputs it uses."""
    parts = [f"{n} AS ({_plain(INPUTS[n])})" for n in _needed(sql)]
    if not parts:
        return sql
    head = ",\n".join(parts)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head},\n{body[14:]}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head},\n{body[4:]}"
    return f"WITH {head}\n{body}"


def register(name: str, sql: str | None = None):
    """Add a query under its inventory name, with its SQL statement where one exists."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_inputs(sql)
        return fn
    return add
