"""Registry and helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import ship_by_value
from ..scratch import new_path

ship_by_value()  # tasks get the functions themselves; the package need not be installed on executors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SLICE = 1000  # rows that are strings in Python at once

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def register(name: str, sql: str | None = None):
    """Add a query, with the SQL that states its rows where SQL can."""
    def add(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return the written table; zstd pays for whole texts."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean_memory() -> None:
    """Let a Python worker give freed memory back: large blocks are mapped one by one, and what is free now is released.

    Without it the allocator keeps what earlier tasks of the worker used, next to what the executor's JVM holds.
    """
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 24)  # M_MMAP_THRESHOLD; otherwise it grows with the blocks freed
        c.malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send whole texts to Python in batches of ``rows`` where the session has Spark's default of ten times as many.

    A batch is held by the JVM outside its heap and by the Python worker; thousands of long texts would be too much.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Working column names that do not clash (in any case) with the columns of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        new = name
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def with_results(df: DataFrame, text: str, results: str,
                 compute: Callable[[Iterable[str | None]], Iterable[Sequence]], keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` plus the fields of ``results`` (a DDL schema), computed from each whole text.

    ``compute`` is called once per task with the texts in order and yields one tuple per text, so it can keep
    state such as a compiled automaton or a bounded cache for the length of the task.
    """
    import pandas  # noqa: F401  (Arrow transfer needs it installed)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(df.sparkSession)
    fields = StructType.fromDDL(results)
    keep = list(keep)
    n_keep = len(keep)
    at = keep.index(text) if text in keep else n_keep  # the text is sent once
    narrow = df.select(*[F.col(quoted(c)) for c in keep], *([] if at < n_keep else [F.col(quoted(text)).alias("__text")]))
    schema = StructType(narrow.schema.fields[:n_keep] + fields.fields)
    arrow = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import deque

        lean_memory()
        waiting: deque = deque()

        def texts():
            for batch in batches:
                for start in range(0, batch.num_rows, SLICE):
                    waiting.append(batch.slice(start, SLICE))
                    yield from waiting[-1].column(at).to_pylist()

        rows: list = []
        for row in compute(texts()):
            rows.append(row)
            if len(rows) == waiting[0].num_rows:
                batch = waiting.popleft()
                yield _batch(batch, rows, n_keep, arrow)
                rows = []

    return narrow.mapInArrow(run, schema)


def _batch(batch: pa.RecordBatch, rows: list, n_keep: int, arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    made = [pa.array(list(values), type=field.type) for values, field in zip(columns, arrow)]
    names = [batch.schema.field(i).name for i in range(n_keep)] + [f.name for f in arrow]
    return pa.RecordBatch.from_arrays([batch.column(i) for i in range(n_keep)] + made, names=names)
