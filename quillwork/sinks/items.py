"""Exports of labelled items and the file writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import with_rank

MAX_COLUMNS = 10_000


def wide_items(items: DataFrame, data: str = "data") -> DataFrame:
    """(item_id, one column per key of the data map, label, confidence); keys in alphabetical order.

    The key list is as long as the result is wide, so it may reach the driver; above MAX_COLUMNS keys this is an error.
    """
    keys = sorted(r[0] for r in items.select(F.explode(F.map_keys(data))).distinct().limit(MAX_COLUMNS + 1).collect())
    if len(keys) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} different keys do not make a table; export them as JSON")
    return items.select("item_id", *[F.col(data)[k].alias(k) for k in keys], "label", "confidence")


def json_items(items: DataFrame) -> DataFrame:
    """(item_id, line): each item as one JSON document."""
    return items.select("item_id", F.to_json(F.struct(*items.columns)).alias("line"))


def category_ids(categories: Sequence[str], label: Column) -> Column:
    """Position of the label in the list, -1 when it is not there."""
    out = F.lit(-1)
    for i, name in enumerate(categories):
        out = F.when(label == name, i).otherwise(out)
    return out


def coco_items(items: DataFrame, categories: Sequence[str], order_by: str = "item_id") -> DataFrame:
    """(id, image_id, file_name, width, height, category_id): ids are exact positions."""
    ranked = with_rank(items, [F.col(order_by)], name="_r")
    return ranked.select((F.col("_r") - 1).alias("id"), (F.col("_r") - 1).alias("image_id"), "file_name", "width",
                         "height", category_ids(categories, F.col("label")).alias("category_id"))


def yolo_items(items: DataFrame, categories: Sequence[str]) -> DataFrame:
    """(path, content): one label file per item."""
    number = category_ids(categories, F.col("label")).cast("string")
    return items.select(F.concat(F.lit("labels/"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"),
                        F.concat(number, F.lit("\n")).alias("content"))


# ---- writers ------------------------------------------------------------------------------------

def write_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, path: str, order_by: Sequence[str], line: str = "line") -> None:
    """Text lines in global order: range partitions, each file sorted."""
    df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).select(line).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str) -> None:
    """(path, part, content) rows as Parquet, clustered by path; one row group holds many documents.

    Millions of tiny files are what a distributed file system handles worst, so documents stay rows.
    """
    df.repartitionByRange("path", "part").sortWithinPartitions("path", "part").write.mode("overwrite").parquet(path)


def cleaned_path(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/cleaned_{name}"


def write_cleaned(df: DataFrame, folder: str, name: str, fmt: str = "csv") -> str:
    path = cleaned_path(folder, name)
    if fmt == "csv":
        write_csv(df, path)
    elif fmt == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError("fmt must be csv or parquet")
    return path
