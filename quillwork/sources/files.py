"""Readers by extension, file decoding, image facts, and small queries on a loaded table."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import finite
from ..operators.columnstats import FLOATING, cell, field_kinds, is_number
from .delimited import check_delimited, read_delimited, read_lines
from .encodings import decode_bytes
from .records import read_json, read_jsonl, validate_records

# Fixed values.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".bmp")


def extension_of(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A table by extension; everything unknown is sniffed as delimited text."""
    ext = extension_of(path)
    if ext == ".json":
        return read_json(spark, path)
    if ext == ".jsonl":
        return read_jsonl(spark, path)
    if ext == ".parquet":
        return spark.read.parquet(path)
    return read_delimited(spark, path)


def read_recorded(spark: SparkSession, folder: str, recorded: str | None = None) -> DataFrame:
    """The table of a data set's folder: the file recorded for it if it is there, else the first by name that is no
    output of a cleaning run (``cleaned_...``) and not hidden."""
    from pyarrow import fs

    from ..sinks.files import file_system

    if recorded is not None:
        system, path = file_system(recorded)
        if system.get_file_info(path).type != fs.FileType.NotFound:
            return read_any(spark, recorded)
    system, path = file_system(folder)
    names = sorted(f.base_name for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)))
    names = [n for n in names if not n.startswith(("cleaned_", ".", "_"))]
    if not names:
        raise FileNotFoundError(f"no table in {folder}")
    return read_any(spark, f"{folder.rstrip('/')}/{names[0]}")


def validate_file(spark: SparkSession, path: str) -> DataFrame:
    """One-row check by extension; raises on an unsupported one."""
    ext = extension_of(path)
    if ext in (".csv", ".tsv"):
        return check_delimited(spark, path, ext).select("row_count", "inconsistent_rows", "null_cells", "duplicate_rows")
    lines = read_lines(spark, path)
    if ext == ".jsonl":
        return validate_records(lines.filter(F.trim("value") != ""))
    if ext == ".json":
        records = read_json(spark, path)
        return validate_records(records.select(F.monotonically_increasing_id().alias("line_no"),
                                               F.to_json(F.struct("*")).alias("value")))
    if ext == ".txt":
        return lines.agg(F.count("*").alias("row_count"))
    raise ValueError(f"unsupported file extension {ext!r}")


# ---- a loaded table -----------------------------------------------------------------------------

def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)


def column_types(df: DataFrame) -> list[tuple[str, bool]]:
    """(name, is_numeric); booleans are not numeric."""
    return [(n, is_number(t)) for n, t in field_kinds(df).items()]


def column_values(df: DataFrame, column: str, order_by: str, limit: int = 100) -> DataFrame:
    """(value, truncated): distinct values in order of first appearance up to ``limit``, then sorted.

    Only ``limit + 1`` (at most 501) values leave the aggregation.
    """
    if not 1 <= limit <= 500:
        raise ValueError("limit must be 1..500")
    seen = df.select(cell(column).cast("string").alias("value"), cell(order_by).alias("k")).filter("value is not null")
    first = seen.groupBy("value").agg(F.min("k").alias("k")).orderBy("k", "value").limit(limit + 1)
    ranked = first.agg(F.array_sort(F.collect_list(F.struct("k", "value"))).alias("v"))
    kept = ranked.select(F.explode(F.slice("v", 1, limit)).alias("x"), (F.size("v") > limit).alias("truncated"))
    return kept.select(F.col("x.value").alias("value"), "truncated").orderBy(F.lower("value"), "value")


def column_range(df: DataFrame, column: str) -> DataFrame:
    """(min, max, mean) of a numeric column, rounded to 4 digits."""
    c = finite(cell(column).cast("double"))
    return df.agg(*[F.round(f(c), 4).alias(n) for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def preview(df: DataFrame, order_by: str, limit: int = 10, total: int | None = None) -> DataFrame:
    """First rows by key; ``truncated`` when the catalog knows of more rows than shown."""
    rows = df.orderBy(cell(order_by)).limit(limit)
    return rows if total is None else rows.withColumn("truncated", F.lit(total > limit))


# ---- text files ---------------------------------------------------------------------------------

def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_no, name, content, encoding) of whole text files in any encoding; one row per file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                        decode_bytes(F.col("content")).alias("d")).select(
        F.col("path").alias("file_no"), "name", F.col("d.text").alias("content"), F.col("d.encoding").alias("encoding"))


# ---- images -------------------------------------------------------------------------------------

_IMAGE = T.StructType([T.StructField("format", T.StringType()), T.StructField("width", T.IntegerType()),
                       T.StructField("height", T.IntegerType()), T.StructField("channels", T.IntegerType()),
                       T.StructField("mode", T.StringType())])


def _image_facts(raw: bytes) -> tuple:
    """Format, size, channels and mode from the file header alone."""
    nothing = (None, None, None, None, None)
    try:
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            width, height, _, kind = struct.unpack(">IIBB", raw[16:26])
            mode, channels = {0: ("L", 1), 2: ("RGB", 3), 3: ("P", 1), 4: ("LA", 2), 6: ("RGBA", 4)}[kind]
            return ("PNG", width, height, channels, mode)
        if raw[:6] in (b"GIF87a", b"GIF89a"):
            return ("GIF", *struct.unpack("<HH", raw[6:10]), 1, "P")
        if raw[:2] == b"BM":
            width, height, _, bits = struct.unpack("<iiHH", raw[18:30])
            mode, channels = {1: ("1", 1), 8: ("P", 1), 24: ("RGB", 3), 32: ("RGBA", 4)}[bits]
            return ("BMP", width, abs(height), channels, mode)
        if raw[:2] == b"\xff\xd8":
            at = 2
            while at + 9 < len(raw):
                marker, length = raw[at + 1], struct.unpack(">H", raw[at + 2:at + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    height, width, channels = struct.unpack(">HHB", raw[at + 5:at + 10])
                    return ("JPEG", width, height, channels, {1: "L", 3: "RGB", 4: "CMYK"}[channels])
                at += 2 + length
    except (struct.error, KeyError, IndexError):
        pass
    return nothing


@F.pandas_udf(_IMAGE)
def image_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_image_facts(bytes(b)) if b is not None else (None,) * 5 for b in content],
                        columns=[f.name for f in _IMAGE.fields]).astype(
        {"width": "Int32", "height": "Int32", "channels": "Int32"})


def image_metadata(df: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """``df`` without the bytes, plus size facts and ``problem`` (NULL when the image is usable)."""
    facts = df.withColumn("_i", image_header(F.col(content))).withColumn("file_size", F.length(content).cast("long"))
    known = F.lower(F.col(name)).rlike("(" + "|".join(e.replace(".", r"\.") for e in IMAGE_EXTENSIONS) + ")$")
    problem = F.when(~known, "unsupported extension").when(F.col("_i.format").isNull(), "unreadable image")
    return facts.select(*[c for c in df.columns if c != content], "file_size", "_i.*", problem.alias("problem"))


def read_image_metadata(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)
    return image_metadata(files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content"))


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities become NULL, in nested arrays and structs too."""
    def safe(c: Column, t: T.DataType) -> Column:
        if isinstance(t, FLOATING):
            return finite(c)
        if isinstance(t, T.ArrayType):
            return F.transform(c, lambda x: safe(x, t.elementType))
        if isinstance(t, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[safe(c[f.name], f.dataType).alias(f.name) for f in t.fields]))
        if isinstance(t, T.MapType):
            return F.transform_values(c, lambda _k, v: safe(v, t.valueType))
        return c

    return df.select(*[safe(cell(f.name), f.dataType).alias(f.name) for f in df.schema.fields])

