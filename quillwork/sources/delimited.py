"""Delimited text: sniffing, tolerant parsing, typing and checks.

The functions work on a table of lines ``(line_no, value)``, from files or from any other source, so a
file is read in splits and parsed in one distributed pass.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..operators.columnstats import cell, wide_stats
from ..scratch import materialise
from .encodings import SAMPLES, decode_bytes, decode_lines, likeliest, pair_scores
from .quoting import whole_records

# Delimiters tried, cell texts read as missing by the table reader, and those counted as
# empty by the file check.
DELIMITERS = (",", ";", "\t", "|")
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
           "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
EMPTY_TOKENS = ("", "null", "none", "na", "n/a")
HEAD_LINES = 200


# ---- lines --------------------------------------------------------------------------------------

def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, line_no, value): ``line_no`` increases along each block of a file."""
    raw = spark.read.text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("line_no"), "value")


def read_wide_lines(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_lines`` for 16-bit text, whose line ends cannot be found byte by byte: each file is read as a whole."""
    files = spark.read.format("binaryFile").load(path)
    text = decode_bytes(F.col("content"))["text"]
    lines = files.select(F.col("path").alias("file"), F.posexplode(F.split(text, "\r\n|\n|\r")).alias("line_no", "value"))
    return lines.select("file", F.lit(0).cast("long").alias("block"), F.col("line_no").cast("long").alias("line_no"), "value")


def table_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a tabular file as text, whatever its encoding.

    Files are read in splits. Those with a line that is no UTF-8 are decoded by the encoding that all their lines
    together are likeliest in; valid UTF-8 is not touched.
    """
    lines = read_lines(spark, path)
    raw = F.col("value").cast("binary")
    marked = F.substring(raw, 1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff")) | F.contains(raw, F.lit(bytearray(b"\x00")))
    if head(lines).filter(marked).head(1):
        return read_wide_lines(spark, path)
    foreign = lines.filter(~F.is_valid_utf8("value"))
    if not foreign.agg(F.count("*")).first()[0]:
        return lines
    files = foreign.select("file", pair_scores(raw).alias("s")).groupBy("file").agg(*[F.sum(f"s.{n}").alias(n) for n in SAMPLES])
    named = materialise(files.select("file", likeliest({n: F.col(n) for n in SAMPLES}).alias("encoding")), "encodings")
    known = lines.join(named, "file", "left")  # one row a file
    text = decode_lines(F.col("value"), F.coalesce("encoding", F.lit("utf-8")))
    return known.select("file", "block", "line_no", text.alias("value"))


def head(lines: DataFrame, n: int = HEAD_LINES) -> DataFrame:
    """First lines; for files only the first block is looked at."""
    if "block" in lines.columns:
        lines = lines.filter("block = 0")
    return lines.select("line_no", "value").orderBy("line_no").limit(n)


def _quoted(sep: str) -> str:
    """A pattern for a separator and the quoted text that begins a cell; it never goes back over what it has read."""
    return re.escape(sep) + r'"[^"]*+(?:""[^"]*+)*+"'


def field_count(line: Column, sep: str) -> Column:
    """Number of fields, separators inside quotes not counted."""
    led = F.concat(F.lit(sep), line)
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(led, _quoted(sep), sep.replace("$", r"\$"))).otherwise(led)
    return F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))


def split_fields(line: Column, sep: str) -> Column:
    """Cells of one line with quotes resolved; the pattern runs on quoted lines only. A quote that does not begin a cell
    or is never closed is an ordinary character."""
    plain = F.split(line, re.escape(sep), -1)
    cell_pattern = re.escape(sep) + r'((?:"[^"]*+(?:""[^"]*+)*+")?+[^' + re.escape(sep) + "]*+)"
    quoted = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(cell_pattern), F.lit(1))

    def unquote(c: Column) -> Column:
        inside = F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.startswith(c, F.lit('"')) & F.endswith(c, F.lit('"')) & (F.length(c) >= 2), inside).otherwise(c)

    return F.when(~F.contains(line, F.lit('"')), plain).otherwise(F.transform(quoted, unquote))


# ---- sniffing -----------------------------------------------------------------------------------

def sniff_delimiter(lines: DataFrame, extension: str = ".csv") -> DataFrame:
    """(delimiter, fields): the candidate that gives the first non-blank line most fields."""
    default = "\t" if extension == ".tsv" else ","
    order = [default] + [d for d in DELIMITERS if d != default]
    first = head(lines).filter(~is_blank(F.col("value"))).orderBy("line_no").limit(1)
    tries = F.array(*[F.struct(F.lit(-i).alias("turn"), F.lit(d).alias("delimiter"),
                               field_count(F.col("value"), d).alias("fields")) for i, d in enumerate(order)])
    flat = first.select(F.explode(tries).alias("t")).select("t.*")
    best = flat.agg(F.max_by(F.struct("delimiter", "fields"), F.struct("fields", "turn")).alias("b"))
    return best.select(F.coalesce("b.delimiter", F.lit(default)).alias("delimiter"),
                       F.coalesce("b.fields", F.lit(0)).alias("fields"))


def data_start(lines: DataFrame, sep: str) -> DataFrame:
    """(start): line number of the real header among the first 200 lines.

    The modal multi-field count decides, if at least three lines share it and the first line does not.
    """
    counted = head(lines).withColumn("fields", F.when(~is_blank(F.col("value")), field_count(F.col("value"), sep)))
    shapes = counted.groupBy("fields").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    many = F.when(F.col("fields") >= 2, F.struct(F.col("n"), (-F.col("first")).alias("f")))
    facts = shapes.agg(
        F.min("first").alias("top"), F.sum("n").alias("lines"),
        F.min_by("fields", F.when(F.col("fields").isNotNull(), F.col("first"))).alias("first_fields"),
        F.max_by(F.struct("fields", "first", "n"), many).alias("m"))
    found = (F.col("lines") >= 3) & (F.col("m.n") >= 3) & (F.col("m.fields") != F.col("first_fields"))
    return facts.select(F.when(found, F.col("m.first")).otherwise(F.col("top")).alias("start"))


# ---- parsing ------------------------------------------------------------------------------------

def parse_lines(lines: DataFrame, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """Text columns of all lines that fit: short lines are padded, lines with too many fields dropped."""
    cells = lines.filter(~is_blank(F.col("value"))).select("line_no", split_fields(F.col("value"), sep).alias("_c"))
    fit = cells.filter(F.size("_c") <= len(columns))

    def value(i: int) -> Column:
        c = F.get("_c", F.lit(i))
        return F.when(~c.isin(*MISSING), c)

    return fit.select("line_no", *[value(i).alias(c) for i, c in enumerate(columns)])


def parse_report(lines: DataFrame, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """(preparse_rows, skipped_rows): non-blank lines, and those with too many fields."""
    full = lines.filter(~is_blank(F.col("value")))
    return full.agg(F.count("*").alias("preparse_rows"),
                    F.count_if(field_count(F.col("value"), sep) > len(columns)).alias("skipped_rows"))


def column_kinds(texts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, kind): bigint, double, boolean or string; integers with leading zeros stay string.

    Every value is looked at, in one aggregate for all columns.
    """
    def measures(n, _t):
        c = strip(cell(n))
        return {"filled": F.count(c), "padded": F.count_if(c.rlike(r"^0\d")),
                "whole": F.count_if(c.rlike(r"^[+-]?\d{1,18}$")),
                "number": F.count_if(c.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")),
                "flag": F.count_if(F.lower(c).isin("true", "false"))}

    facts = wide_stats(texts, measures, columns)
    full = F.col("filled") > 0
    kind = (F.when(full & (F.col("whole") == F.col("filled")), F.when(F.col("padded") > 0, "string").otherwise("bigint"))
            .when(full & (F.col("number") == F.col("filled")), "double")
            .when(full & (F.col("flag") == F.col("filled")), "boolean").otherwise("string"))
    return facts.select("column", kind.alias("kind"))


def typed(texts: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns cast to their kinds."""
    kinds = {r["column"]: r["kind"] for r in column_kinds(texts, columns).collect()}
    return texts.select(*[(strip(cell(c)).try_cast(kinds[c]) if kinds[c] != "string" else cell(c)).alias(c)
                          if c in kinds else cell(c) for c in texts.columns])


def header_cells(line: str, sep: str) -> list[str]:
    """The trimmed cells of a header line."""
    import csv

    return [cell.strip() for cell in next(csv.reader([line], delimiter=sep), [])]


def header_names(line: str, sep: str) -> list[str]:
    """Column names from a header line; repeated names get ``.1``, ``.2``."""
    names: list[str] = []
    for name in header_cells(line, sep):
        k = 0
        while (name if not k else f"{name}.{k}") in names:
            k += 1
        names.append(name if not k else f"{name}.{k}")
    return names


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, extension: str | None = None,
                   infer: bool = True) -> DataFrame:
    """A delimited file (or files of one layout) as a table: sniffed, prelude skipped, bad lines dropped.

    The driver sees one sniffed line and the column kinds; rows are parsed by the executors.
    """
    body, header, sep = open_delimited(spark, path, sep, extension)
    if header is None:
        raise ValueError(f"no header found in {path}")
    columns = header_names(header, sep)
    table = parse_lines(body, columns, sep).drop("line_no")
    return typed(table, columns) if infer else table


def open_delimited(spark: SparkSession, path: str, sep: str | None = None,
                   extension: str | None = None) -> tuple[DataFrame, str | None, str]:
    """The data records behind prelude and header, the header line and the separator; a record is one line of text
    unless line breaks are quoted."""
    extension = extension or ("." + path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ".csv")
    lines = table_lines(spark, path)
    sep = sep or sniff_delimiter(lines, extension).first()["delimiter"]
    lines = whole_records(lines, sep)
    start = data_start(lines, sep).first()["start"]
    first = lines.filter((F.col("block") == 0) & (F.col("line_no") == start)).select("value").first()
    if first is None:
        return lines, None, sep
    return after_header(lines, start), first["value"].lstrip("\ufeff"), sep


def after_header(lines: DataFrame, start: int) -> DataFrame:
    """Lines behind the header at ``start`` of the first file, and behind the same place in every other file.

    Prelude and header are known by their position alone: a data row that repeats the header's text stays.
    """
    opening = lines.filter("block = 0")
    tops = opening.groupBy("file").agg(F.min("line_no").alias("_top"))
    place = tops.filter(F.col("_top") <= start).agg(F.max("_top")).first()[0]
    joined = lines.join(tops, "file", "left")  # one row a file: broadcast when small, else shuffled
    head_row = (F.col("block") == 0) & (F.col("line_no") - F.col("_top") <= start - place)
    return joined.filter(~F.coalesce(head_row, F.lit(False))).select(*lines.columns)


# ---- checks -------------------------------------------------------------------------------------

def validate_rows(lines: DataFrame, columns: Sequence[str], sep: str = ",") -> DataFrame:
    """(row_count, inconsistent_rows, null_cells, duplicate_rows) of the data lines.

    Rows are grouped by their hash with map-side combining, so masses of copies do not travel.
    """
    cells = split_fields(F.col("value"), sep)
    blank = F.size(F.filter(cells, lambda c: F.lower(strip(c)).isin(*EMPTY_TOKENS)))
    rows = lines.select(F.md5(F.array_join(cells, "|")).alias("h"), (F.size(cells) != len(columns)).alias("odd"),
                        blank.alias("blank"))
    grouped = rows.groupBy("h").agg(F.count("*").alias("n"), F.count_if("odd").alias("odd"), F.sum("blank").alias("blank"))
    zero = F.lit(0).cast("long")
    return grouped.agg(F.coalesce(F.sum("n"), zero).alias("row_count"), F.coalesce(F.sum("odd"), zero).alias("inconsistent_rows"),
                       F.coalesce(F.sum("blank"), zero).alias("null_cells"),
                       F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_rows"))


def header_problems(columns: Sequence[str]) -> list[str]:
    """Empty header or names that are equal but for case."""
    if not columns or all(not c.strip() for c in columns):
        return ["header row is empty or missing"]
    low = [c.strip().lower() for c in columns]
    return [f"duplicate column name {n}" for n in sorted({n for n in low if low.count(n) > 1})]


def check_delimited(spark: SparkSession, path: str, extension: str = ".csv", samples: int = 5) -> DataFrame:
    """One row: the counts of ``validate_rows``, ``columns``, ``problems`` of the header, and ``sample``, the cells of the
    first records."""
    body, header, sep = open_delimited(spark, path, extension=extension)
    columns = header_cells(header or "", sep)
    first = body.orderBy("file", "block", "line_no").limit(samples).select(
        F.struct("file", "block", "line_no").alias("at"), split_fields(F.col("value"), sep).alias("cells"))
    sample = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "cells"))), lambda r: r["cells"]).alias("sample"))
    facts = validate_rows(body, columns, sep)
    both = facts.unionByName(sample, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in facts.columns], F.max("sample").alias("sample")).withColumns(
        {"columns": texts(columns), "problems": texts(header_problems(columns))})


def texts(values: Sequence[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def schema_hash(names: Column) -> Column:
    """SHA-256 of the sorted, trimmed, lower-cased names joined by ``|``."""
    return F.sha2(F.array_join(F.array_sort(F.transform(names, lambda n: F.lower(strip(n)))), "|"), 256)
