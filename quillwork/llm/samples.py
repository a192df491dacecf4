"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(doc_id: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % divisor


def sample_by_label(rows: DataFrame, label: str, per_label: int, max_labels: int = 200) -> pd.DataFrame:
    """About ``per_label`` different rows of each label, chosen by a hash of the whole row, in a fixed order.

    The rows go to the driver, so their number is bounded: at most ``max_labels`` labels are taken (those with most
    different rows; the others are not learned), each label's share is set from the number of its different rows, equal
    rows count once, and never more than twice the wanted number leave the executors. Rows without a label are left out.
    """
    rows = rows.filter(F.col(label).isNotNull())
    whole = F.xxhash64(F.lit(17), *[F.col(f"`{c}`") for c in rows.columns])
    counts = rows.groupBy(label).agg(F.approx_count_distinct(whole, 0.02).alias("n")).orderBy(F.desc("n"), label).limit(max_labels).collect()
    if not counts:
        return rows.limit(0).toPandas()
    share = F.create_map(*[F.lit(x) for r in counts for x in (r[label], min(1.0, per_label / max(r["n"], 1)))])
    draw = F.pmod(whole, F.lit(1 << 30)) / F.lit(1 << 30)
    chosen = rows.filter(draw < F.element_at(share, F.col(label))).distinct()
    taken = chosen.orderBy(draw).limit(2 * per_label * len(counts)).toPandas()
    return taken.sort_values(list(rows.columns), kind="stable").reset_index(drop=True)
