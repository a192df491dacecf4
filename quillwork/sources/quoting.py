"""Which line breaks of a delimited file lie inside quotes, found without reading the file in order.

A quote opens only where a cell begins; inside, doubled quotes are one quote and a single one closes. So a line maps the
two states it may begin in, outside or inside quotes, to the state it ends in. These maps are composed per file block
in one aggregate, over the blocks of a file in a window of one row a block, and then every block knows the state it
begins in. Its lines are joined into records in the task that reads them, and only the few record parts that cross a
block border are put together by a shuffle. A file without a quoted line break is read as lines, with no further pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

STAY, SWITCH, OUTSIDE, INSIDE = range(4)  # what a line does to the state


def quote_step(value: Column, sep: str) -> Column:
    """STAY, SWITCH, OUTSIDE or INSIDE for one line. Doubled quotes change nothing and are left out of account; of the
    others it matters only whether they stand where a cell begins (A) or not (B): outside, an A opens and the next
    quote of either kind closes."""
    bare = F.translate(F.replace(value, F.lit('""'), F.lit("")), "\x01", "")
    marked = F.regexp_replace(bare, f'(^|{re.escape(sep)})"', "$1\x01")
    quotes = F.translate(F.regexp_replace(marked, '[^\x01"]++', ""), '\x01"', "AB")

    def left_open(q: Column) -> Column:
        return F.endswith(F.regexp_replace(q, "B*+A[AB]", ""), F.lit("A"))

    outside, inside = left_open(quotes), F.when(quotes == "", True).otherwise(left_open(F.substring(quotes, F.lit(2), F.length(quotes))))
    step = (F.when(outside & inside, INSIDE).when(outside, SWITCH).when(inside, STAY).otherwise(OUTSIDE))
    return F.when(F.contains(value, F.lit('"')), step).otherwise(STAY)


def blocks_inside(lines: DataFrame, sep: str) -> DataFrame | None:
    """(file, block) of the blocks that begin inside quotes; None where no line break of any file is quoted."""
    steps = lines.select("file", "block", "line_no", quote_step(F.col("value"), sep).alias("step"))
    fixed = F.when(F.col("step") >= OUTSIDE, F.struct("line_no", "step"))
    blocks = materialise(steps.groupBy("file", "block").agg(
        F.max(fixed).alias("last"), F.count_if(F.col("step").isin(SWITCH, INSIDE)).alias("opened")), "quote-blocks")
    if not blocks.filter("opened > 0").head(1):
        return None
    after = (steps.filter(F.col("step") == SWITCH).join(F.broadcast(blocks.select("file", "block", "last")), ["file", "block"])
             .filter(F.col("last").isNull() | (F.col("line_no") > F.col("last.line_no")))  # one row a block
             .groupBy("file", "block").agg(F.count("*").alias("switches")))
    facts = blocks.join(after, ["file", "block"], "left").withColumn("switches", F.coalesce("switches", F.lit(0)))
    upto = Window.partitionBy("file").orderBy("block")
    # the state is the last fixed one, switched as often as the lines behind it say
    known = F.when(F.col("last").isNotNull(), F.when(F.col("last.step") == INSIDE, 1).otherwise(0) + F.col("switches") - F.col("all"))
    state = (facts.withColumn("all", F.sum("switches").over(upto)).withColumn("base", F.last(known, True).over(upto))
             .withColumn("ends", F.pmod(F.coalesce("base", F.lit(0)) + F.col("all"), F.lit(2)))
             .withColumn("begins", F.lag("ends", 1, 0).over(upto)))
    return state.filter("begins = 1").select("file", "block")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each block, which comes as a run of lines in order; what crosses its borders stays in lines.

    ``part`` is 0 for a whole record, else a line of one that crosses a border: 1 its first line, 2 another, 3 its last.
    """
    names = ["file", "block", "line_no", "value", "part"]
    key, inside, crossing, open_lines = None, False, False, []

    def rows_left():
        return [(*key, n, v, 1 if i == 0 else 2) for i, (n, v) in enumerate(open_lines)]

    def made(rows):
        types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    for batch in batches:
        out = []
        for file, block, n, value, step, begins_inside in zip(*[c.to_pylist() for c in batch.columns]):
            if (file, block) != key:
                out += rows_left() if open_lines else []
                key, inside, open_lines = (file, block), begins_inside, []
                crossing = begins_inside
            inside = inside if step == STAY else not inside if step == SWITCH else step == INSIDE
            if crossing:
                out.append((*key, n, value, 2 if inside else 3))
                crossing = inside
            elif inside:
                open_lines.append((n, value))
            elif open_lines:
                out.append((*key, open_lines[0][0], "\n".join([*(v for _, v in open_lines), value]), 0))
                open_lines = []
            else:
                out.append((*key, n, value, 0))
        if out:
            yield made(out)
    if open_lines:
        yield made(rows_left())


def whole_records(lines: DataFrame, sep: str) -> DataFrame:
    """The lines of ``delimited.read_lines`` with those of one record joined by a line feed.

    A quote that is never closed does not count: the lines behind it stay lines. ``line_no`` is that of the first line.
    """
    starts = blocks_inside(lines, sep)
    if starts is None:
        return lines
    marked = lines.join(F.broadcast(starts.withColumn("inside", F.lit(True))), ["file", "block"], "left")  # a row a block at most
    marked = marked.select("file", "block", "line_no", "value", quote_step(F.col("value"), sep).alias("step"),
                           F.coalesce("inside", F.lit(False)).alias("inside"))
    records = materialise(marked.mapInArrow(_joined, "file string, block long, line_no long, value string, part int"), "records")
    crossing = records.filter("part > 0")
    order = Window.partitionBy("file").orderBy("block", "line_no")  # only lines of records that cross a border
    chained = crossing.withColumn("chain", F.sum(F.when(F.col("part") == 1, 1).otherwise(0)).over(order))
    closed = chained.groupBy("file", "chain").agg(F.max("part").alias("upto"))
    chained = chained.join(closed, ["file", "chain"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line_no", "value"))), lambda r: r["value"]), "\n")
    first = F.min(F.struct("block", "line_no"))
    stitched = (chained.filter("upto = 3").groupBy("file", "chain").agg(first.alias("at"), text.alias("value"))
                .select("file", "at.block", "at.line_no", "value"))
    columns = ["file", "block", "line_no", "value"]
    return (records.filter("part = 0").select(columns).unionByName(stitched)
            .unionByName(chained.filter("upto < 3").select(columns)))
