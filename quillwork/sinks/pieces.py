"""Files as sorted pieces: rows (path, place, seq, line) of one shape at every size.

The first piece of a file is at place 0, the last at the highest place; lines of the same place follow ``seq``. A file
of any length is many rows, nothing is gathered, and the pieces in order are the file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise


def separated(lines: DataFrame, key: str, glue: str = ",") -> DataFrame:
    """(key, seq, line): every line but the first of its key has ``glue`` in front."""
    lines = materialise(lines.select(key, "seq", "line"), "lines")  # made once, not for the first of each key and again
    first = materialise(lines.groupBy(key).agg(F.min(F.struct("seq", "line")).alias("_first")).withColumnRenamed(key, "_key"), "firsts")
    later = F.struct("seq", "line") != F.col("_first")
    return lines.join(first, F.col(key) == F.col("_key")).select(
        key, "seq", F.when(later, F.concat(F.lit(glue), "line")).otherwise(F.col("line")).alias("line"))


def frame(owners: DataFrame, place: int, line: Column | None, *keep: str) -> DataFrame:
    """One piece per owner, such as the head or the end of its file; ``None`` only says that the file exists."""
    text = F.lit(None).cast("string") if line is None else line
    return owners.select(*keep, F.lit(place).alias("place"), F.lit(None).alias("seq"), text.alias("line"))


def body(owners: DataFrame, lines: DataFrame, key: str, place: int, *keep: str) -> DataFrame:
    """The lines (key, seq, line) of the owners as pieces."""
    return owners.select(key, *[k for k in keep if k != key]).join(lines, key).select(
        *keep, F.lit(place).alias("place"), "seq", "line")


def joined(*pieces: DataFrame) -> DataFrame:
    """All pieces as one table; the type of ``seq`` is that of the lines."""
    kind = next((p.schema["seq"].dataType for p in pieces if p.schema["seq"].dataType.typeName() != "void"), "string")
    out = None
    for p in pieces:
        p = p.withColumn("seq", F.col("seq").cast(kind))
        out = p if out is None else out.unionByName(p)
    return out


def in_order(pieces: DataFrame, path: str = "path") -> DataFrame:
    """Range-partitioned and sorted, ready to be written."""
    keys = [path, "place", "seq", "line"]
    return pieces.repartitionByRange(*keys).sortWithinPartitions(*keys)
