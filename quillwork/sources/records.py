"""JSON records: readers and checks over a table of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank
from .delimited import schema_hash


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records (or one record) per file."""
    return spark.read.option("multiLine", True).json(path)


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """One record per line; splittable. Lines that are not records are left out."""
    df = spark.read.option("columnNameOfCorruptRecord", "_broken_line").json(path)
    if "_broken_line" not in df.columns:
        return df
    return df.filter(F.col("_broken_line").isNull()).drop("_broken_line")


def parse_records(lines: DataFrame, schema: str) -> DataFrame:
    """Records of JSON lines under a known schema; lines that are not objects are left out."""
    parsed = lines.filter(F.trim("value").startswith("{")).select("line_no", F.from_json("value", schema).alias("r"))
    return parsed.select("line_no", "r.*")


def _maps(lines: DataFrame) -> DataFrame:
    record = F.when(F.ltrim("value").startswith("{"), F.from_json("value", "map<string,string>"))
    return lines.select("line_no", record.alias("m"))


def key_union(lines: DataFrame) -> DataFrame:
    """(key, present): every key of any record with the number of filled values.

    Counted per key with map-side combining; a record contributes each of its keys once.
    """
    flat = _maps(lines).filter("m is not null").select(F.explode("m").alias("key", "v"))
    return flat.groupBy("key").agg(F.count_if(F.col("v").isNotNull() & ~is_blank(F.col("v"))).alias("present"))


def validate_records(lines: DataFrame) -> DataFrame:
    """(row_count, skipped, columns, null_cells, duplicate_records, different_keys, schema_hash)."""
    maps = _maps(lines)
    first = maps.filter("m is not null").groupBy().agg(
        F.min_by(F.array_sort(F.map_keys("m")), F.col("line_no")).alias("keys"))
    entries = F.array_sort(F.map_entries("m"))
    shaped = maps.select(F.when(F.col("m").isNotNull(), F.md5(F.to_json(entries))).alias("h"),
                         F.array_sort(F.map_keys("m")).alias("keys"))
    # Copies collapse first; then key sets are compared once per distinct record.
    grouped = shaped.groupBy("h", "keys").agg(F.count("*").alias("n"))
    want = first.first()["keys"] if not lines.isEmpty() else None
    wanted = F.array(*[F.lit(k) for k in (want or [])]).cast("array<string>")
    real = F.col("h").isNotNull()
    zero = F.lit(0).cast("long")
    counts = grouped.agg(
        F.coalesce(F.sum(F.when(real, F.col("n"))), zero).alias("row_count"),
        F.coalesce(F.sum(F.when(~real, F.col("n"))), zero).alias("skipped"),
        F.coalesce(F.sum(F.when(real, F.col("n") - 1)), zero).alias("duplicate_records"),
        F.coalesce(F.sum(F.when(real & (F.col("keys") != wanted), F.col("n"))), zero).alias("different_keys"))
    # The key union is as long as the table is wide.
    keys = key_union(lines).agg(F.array_sort(F.collect_list("key")).alias("columns"),
                                F.coalesce(F.sum("present"), zero).alias("present"))
    both = counts.unionByName(keys, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in both.columns])
    return both.select("row_count", "skipped", "columns",
                       (F.col("row_count") * F.size("columns") - F.col("present")).alias("null_cells"),
                       "duplicate_records", "different_keys", schema_hash(F.col("columns")).alias("schema_hash"))
