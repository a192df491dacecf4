"""Run queries beside their SQL statement and compare; also a command line tool.

    python tests/oracle.py [sf dir] [name prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from bindings.base import TABLES  # noqa: E402


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(normal(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, normal(x)) for k, x in v.items()))
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, type(x).__name__ if not isinstance(x, (int, float)) else "n",
                                            x if x is not None else 0) for x in r))


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return (isinstance(a, (int, float)) and isinstance(b, (int, float))
                and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    return a == b


KINDS = {"BIGINT": "int", "INTEGER": "int", "HUGEINT": "int", "SMALLINT": "int", "UBIGINT": "int", "TINYINT": "int",
         "DOUBLE": "float", "FLOAT": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
SPARK_KINDS = {"bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float",
               "float": "float", "string": "str", "boolean": "bool"}


def compare(spark_df, con, sql: str) -> list[str]:
    """Differences in words; empty when equal."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in cur.description}
    expected = rows_of(names, cur.fetchall())
    got_rows = spark_df.collect()
    got = rows_of(spark_df.columns, [tuple(r) for r in got_rows])
    problems = []
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} vs {sorted(names)}"]
    for f in spark_df.schema.fields:
        k = SPARK_KINDS.get(f.dataType.simpleString())
        if k and k != kinds[f.name]:
            problems.append(f"type of {f.name}: {f.dataType.simpleString()} vs {kinds[f.name]}")
    if len(got) != len(expected):
        problems.append(f"rows {len(got)} vs {len(expected)}")
        extra = [g for g in got if g not in set(expected)][:2]
        missing = [e for e in expected if e not in set(got)][:2]
        problems.append(f"only spark {extra}; only sql {missing}"[:800])
        return problems
    bad = [(g, e) for g, e in zip(got, expected) if not same(g, e)]
    if bad:
        g, e = bad[0]
        problems.append(f"{len(bad)} rows differ, first: " + "; ".join(
            f"{n}: {x!r:.150} vs {y!r:.150}" for n, x, y in zip(sorted(names), g, e) if not same(x, y)))
    return problems


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            if name in oracles:
                problems = compare(fn(spark, sf), con, oracles[name])
                note = ""
            else:
                problems, note = [], f" rows only: {fn(spark, sf).count()}"
        except Exception as e:  # noqa: BLE001
            problems, note = [f"{type(e).__name__}: {str(e)[:1500]}"], ""
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - start:.1f}s{note} {' | '.join(problems)}", flush=True)
    print("failures:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main() and 1)
