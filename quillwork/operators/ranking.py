"""Exact ranks, neighbours, running totals and quantiles without a single-partition window.

Rows are range-partitioned by (group, order), written once with their partition number, ranked inside
each partition, and shifted by the sizes of earlier partitions. Only groups that cross a partition
border need a shift, so the shift table never holds more than two rows per partition, whatever the
data size; that bound is why it may be broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise, new_path


def _staged(df: DataFrame, group_by: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    keys = [F.col(g) for g in group_by] + list(order_by)
    ranged = df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    return materialise(ranged, "ranged")


def _border_shift(sizes: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Per (part, group) of border-crossing groups: how much lies in earlier parts."""
    whole = Window.partitionBy(*group_by)
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (sizes.withColumn("_parts", F.count("*").over(whole))
            .withColumn("_shift", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
            .filter("_parts > 1").drop("_size", "_parts"))


def _join_shift(df: DataFrame, shift: DataFrame, group_by: Sequence[str]) -> DataFrame:
    right = shift.select(F.col("_part").alias("_p2"), "_shift",
                         *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group_by)])
    on = F.col("_part") == F.col("_p2")
    for i, g in enumerate(group_by):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return (df.join(F.broadcast(right), on, "left")
            .drop("_p2", *[f"_g{i}" for i in range(len(group_by))]))


def with_running_total(df: DataFrame, amount: str, order_by: Sequence[Column],
                       group_by: Sequence[str] = (), name: str = "running_total") -> DataFrame:
    """Inclusive running total of ``amount`` in (group, order) order; the order must be total."""
    df = df.withColumn("_whole", F.lit(0)) if not group_by else df
    groups = list(group_by) or ["_whole"]
    staged = _staged(df, groups, order_by)
    sizes = staged.groupBy("_part", *groups).agg(F.sum(amount).alias("_size"))
    local = Window.partitionBy("_part", *groups).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = staged.withColumn("_local", F.sum(amount).over(local))
    out = _join_shift(inside, _border_shift(sizes, groups), groups)
    return (out.withColumn(name, F.col("_local") + F.coalesce("_shift", F.lit(0)))
            .drop("_local", "_shift", "_part", "_whole"))


def with_rank(df: DataFrame, order_by: Sequence[Column], group_by: Sequence[str] = (),
              name: str = "rank") -> DataFrame:
    """1-based exact position of each row in its group; the order must be total."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    return with_running_total(one, "_one", order_by, group_by, name).drop("_one")


def with_neighbors(df: DataFrame, id_col: str, order_by: Sequence[Column],
                   group_by: Sequence[str] = (), prev: str = "prev_id",
                   next_: str = "next_id") -> DataFrame:
    """Previous and next ``id_col`` in the group; borders between partitions are patched."""
    df = df.withColumn("_whole", F.lit(0)) if not group_by else df
    groups = list(group_by) or ["_whole"]
    staged = _staged(df, groups, order_by)
    key = F.struct(*order_by)
    edges = staged.groupBy("_part", *groups).agg(
        F.min_by(id_col, key).alias("_first"), F.max_by(id_col, key).alias("_last"))
    across = Window.partitionBy(*groups).orderBy("_part")
    edges = (edges.withColumn("_before", F.lag("_last").over(across))
             .withColumn("_after", F.lead("_first").over(across))
             .filter("_before is not null or _after is not null"))
    right = edges.select(F.col("_part").alias("_p2"), "_before", "_after",
                         *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)])
    on = F.col("_part") == F.col("_p2")
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    local = Window.partitionBy("_part", *groups).orderBy(*order_by)
    out = (staged.withColumn("_l", F.lag(id_col).over(local))
           .withColumn("_n", F.lead(id_col).over(local))
           .join(F.broadcast(right), on, "left"))
    return (out.withColumn(prev, F.coalesce("_l", "_before"))
            .withColumn(next_, F.coalesce("_n", "_after"))
            .drop("_l", "_n", "_before", "_after", "_part", "_p2", "_whole",
                  *[f"_g{i}" for i in range(len(groups))]))


@dataclass(frozen=True)
class Pages:
    """Rows stored in their order, and the directory of the stored parts: one (part, rows before it, rows) each."""
    path: str
    order_by: tuple[str, ...]
    rows: DataFrame
    parts: tuple[tuple[int, int, int], ...]

    def page(self, skip: int, limit: int) -> DataFrame:
        """Rows skip+1 .. skip+limit, read from the parts that hold them: one or two, or as many as a page spans."""
        held = {part: before for part, before, n in self.parts if before < skip + limit and before + n > skip}
        order = _order(self.order_by)
        if not held:
            return self.rows.drop("_part").limit(0)
        before = F.element_at(F.create_map(*[F.lit(x) for pair in held.items() for x in pair]), F.col("_part"))
        place = before + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
        found = self.rows.filter(F.col("_part").isin(list(held))).withColumn("_place", place)
        return found.filter((F.col("_place") > skip) & (F.col("_place") <= skip + limit)).drop("_place", "_part").orderBy(*order)


def _order(order_by: Sequence[str]) -> list[Column]:
    return [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order_by]


PARTS, PART_ROWS = 256, 100_000  # stored parts up to which few rows a part are kept to, and rows a part beyond


def part_count(rows: int, rows_per_part: int) -> int:
    """Parts of ``rows_per_part`` rows, but more than ``PARTS`` only as far as they have ``PART_ROWS`` rows."""
    wanted = -(-rows // rows_per_part)
    return max(1, min(wanted, max(PARTS, -(-rows // PART_ROWS))))


def store_pages(df: DataFrame, order_by: Sequence[str], path: str | None = None, rows_per_part: int = PART_ROWS) -> Pages:
    """Store ``df`` once in the (total) order for pages at any depth; ``-name`` stands for descending.

    The directory has one entry per part. Parts have ``rows_per_part`` rows, or more where that would make very many
    small files.
    """
    spark = df.sparkSession
    parts = part_count(df.count(), rows_per_part)
    order = _order(order_by)
    path = path or new_path(spark, "pages")
    ranged = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)
    ranged.write.partitionBy("_part").parquet(path)
    kept = spark.read.schema(ranged.schema).parquet(path)
    sizes, before = [], 0
    for r in kept.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row a part
        sizes.append((r["_part"], before, r["n"]))
        before += r["n"]
    return Pages(path, tuple(order_by), kept, tuple(sizes))


def page(df: DataFrame, order_by: Sequence[str], skip: int, limit: int, key: str, pages: Pages | None = None) -> DataFrame:
    """Rows skip+1 .. skip+limit in a total order; ``-name`` stands for descending.

    The first page is a bounded heap per partition. Behind it, ``key`` (unique) and the order columns alone are ranked
    over all partitions, so no task holds the rows skipped. With ``pages``, stored from the same rows in the same order,
    only the parts that hold the page are read.
    """
    if pages is not None:
        if pages.order_by != tuple(order_by):
            raise ValueError(f"stored in order {pages.order_by}, asked for {tuple(order_by)}")
        return pages.page(skip, limit)
    names = [n.lstrip("-") for n in order_by]
    order = [F.desc(n) if o.startswith("-") else F.asc(n) for n, o in zip(names, order_by)]
    if not skip:
        return df.orderBy(*order).limit(limit)
    narrow = df.select(*dict.fromkeys([*names, key]))
    chosen = with_rank(narrow, order, name="_place").filter(
        (F.col("_place") > skip) & (F.col("_place") <= skip + limit)).select(F.col(key).alias("_key"))
    return df.join(F.broadcast(chosen), F.col(key) == F.col("_key")).drop("_key").orderBy(*order)  # ``limit`` rows


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value) rows of the non-missing numbers."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("value"))
             for c in columns]
    long = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    return long.filter("value is not null and not isnan(value)")


def quantiles_of_counts(counted: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    """(column, n, q0, q1, ...) from (column, value, n), with linear interpolation.

    The counts are range-partitioned by value. Partition sizes alone tell which partitions hold the wanted
    order statistics; only those few are sorted, so the cost after the one shuffle does not grow with the data.
    """
    staged = _staged(counted, ["column"], [F.col("value")])
    sizes = staged.groupBy("_part", "column").agg(F.sum("n").alias("_size"))
    whole = Window.partitionBy("column")  # at most one row per partition
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    placed = (sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
              .withColumn("_total", F.sum("_size").over(whole)))
    wanted = []
    for p in probabilities:
        place = (F.col("_total") - 1) * F.lit(float(p))
        wanted += [F.floor(place), F.ceil(place)]
    here = F.lit(False)
    for k in wanted:
        here = here | ((k >= F.col("_before")) & (k < F.col("_before") + F.col("_size")))
    pairs = placed.filter(here).drop("_size")  # at most two per column and probability
    local = Window.partitionBy("_part", "column").orderBy("value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    near = staged.join(F.broadcast(pairs), ["_part", "column"]).withColumn(
        "_upto", F.col("_before") + F.sum("n").over(local))
    picks = []
    for i, k in enumerate(wanted):
        hit = (F.col("_upto") > k) & (F.col("_upto") - F.col("n") <= k)
        picks.append(F.max(F.when(hit, F.col("value"))).alias(f"v{i}"))
    found = near.groupBy("column").agg(F.max("_total").alias("n"), *picks)
    out = []
    for i, p in enumerate(probabilities):
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"v{2 * i}"), F.col(f"v{2 * i + 1}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(f"q{i}"))
    return found.select("column", "n", *out)


ACCURACY = 10_000
COLUMNS_PER_PASS = 100  # a quantile sketch per column is held in memory by every task


def _number(name: str) -> Column:
    c = F.col(f"`{name}`").cast("double")
    return F.when(~F.isnan(c), c)


def _per_column(df: DataFrame, columns: Sequence[str], measures) -> list[dict]:
    """One aggregate per hundred columns; the driver gets one small row for each column."""
    out = []
    for start in range(0, len(columns), COLUMNS_PER_PASS):
        part = columns[start:start + COLUMNS_PER_PASS]
        row = df.agg(*[F.struct(*[v.alias(k) for k, v in measures(c).items()]).alias(f"c{i}") for i, c in enumerate(part)]).first()
        out += [{"column": c, **row[f"c{i}"].asDict()} for i, c in enumerate(part)]
    return out


def _exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Order statistics without moving the cells.

    A sketch gives two values that enclose each wanted place but for its error; one pass counts what lies below and
    inside and finds the nearest values outside; only the values inside (about four in ten thousand) are counted and
    ranked. A column whose sketch missed is counted in full.
    """
    spark, ps = df.sparkSession, [float(p) for p in probabilities]
    wide = [min(1.0, max(0.0, p + side * 2 / ACCURACY)) for p in ps for side in (-1, 1)]
    bounds = {r["column"]: r for r in _per_column(df, columns, lambda c: {
        "n": F.count(_number(c)), "b": F.percentile_approx(_number(c), wide, ACCURACY)})}
    filled = [c for c in columns if bounds[c]["n"]]

    def inside(c: str, i: int) -> Column:
        return (_number(c) >= bounds[c]["b"][2 * i]) & (_number(c) <= bounds[c]["b"][2 * i + 1])

    facts = _per_column(df, filled, lambda c: {k: v for i in range(len(ps)) for k, v in {
        f"below{i}": F.count_if(_number(c) < bounds[c]["b"][2 * i]), f"inside{i}": F.count_if(inside(c, i)),
        f"prev{i}": F.max(F.when(_number(c) < bounds[c]["b"][2 * i], _number(c))),
        f"next{i}": F.min(F.when(_number(c) > bounds[c]["b"][2 * i + 1], _number(c)))}.items()})
    wanted, missed = [], []
    for r in facts:
        n, places = bounds[r["column"]]["n"], []
        for i, p in enumerate(ps):
            low = int((n - 1) * p)
            high = low if low == (n - 1) * p else low + 1
            places += [(r["column"], i, side, k - r[f"below{i}"], r[f"prev{i}"], r[f"next{i}"], r[f"inside{i}"])
                       for side, k in enumerate((low, high))]
        (wanted if all(-1 <= place <= size for *_, place, _, _, size in places) else missed).append((r["column"], places))
    found = {}
    rows = [x for _, places in wanted for x in places]
    if rows:
        cells = [F.when(inside(c, i), F.struct(F.lit(f"{j}:{i}").alias("key"), _number(c).alias("value")))
                 for j, (c, _) in enumerate(wanted) for i in range(len(ps))]
        number = {c: j for j, (c, _) in enumerate(wanted)}
        near = df.select(F.explode(F.array(*cells)).alias("c")).filter("c is not null").select("c.*")
        counted = near.groupBy("key", "value").agg(F.count("*").alias("size"))
        ranked = with_running_total(counted, "size", [F.col("value")], ["key"], "upto")
        targets = spark.createDataFrame([(f"{number[c]}:{i}", side, int(place)) for c, i, side, place, *_ in rows],
                                        "key string, side int, place long")  # two rows a column and probability
        hits = ranked.join(F.broadcast(targets), "key").filter(
            (F.col("upto") > F.col("place")) & (F.col("upto") - F.col("size") <= F.col("place")))
        found = {(r["key"], r["side"]): r["value"] for r in hits.select("key", "side", "value").collect()}
    out = []
    for c, places in wanted:
        values = {}
        for _, i, side, place, before, after, size in places:
            values[i, side] = before if place == -1 else after if place == size else found[f"{number[c]}:{i}", side]
        n = bounds[c]["n"]
        quants = []
        for i, p in enumerate(ps):
            at = (n - 1) * p
            quants.append(values[i, 0] + (values[i, 1] - values[i, 0]) * (at - int(at)))
        out.append((c, n, *quants))
    fields = ", ".join(["column string, n long", *[f"q{i} double" for i in range(len(ps))]])
    result = spark.createDataFrame(out, fields)
    if missed:
        counted = long_numbers(df, [c for c, _ in missed]).groupBy("column", "value").agg(F.count("*").alias("n"))
        result = result.unionByName(quantiles_of_counts(counted, ps))
    return result


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float],
              exact: bool = True) -> DataFrame:
    """(column, n, q0, q1, ...) with linear interpolation: exact, or from the one-pass sketch with ``exact=False``."""
    if not columns:
        return df.sparkSession.createDataFrame([], ", ".join(
            ["column string, n long", *[f"q{i} double" for i in range(len(probabilities))]]))
    if exact:
        return _exact_quantiles(df, columns, probabilities)
    return long_numbers(df, columns).groupBy("column").agg(
        F.count("*").alias("n"),
        *[F.percentile_approx("value", p, 100000).alias(f"q{i}") for i, p in enumerate(probabilities)])


GROUP_LIMIT = 50_000


def with_parts(df: DataFrame, key: Sequence[str], order_by: Sequence[Column],
               limit: int = GROUP_LIMIT, name: str = "part") -> DataFrame:
    """Add a part number that keeps every (key, part) group within ``limit`` rows, in order.

    Nearly always no key is larger than the limit and every part is 0. Rows of larger keys are ranked
    and cut into parts, so a key holding a large share of the table is still spread over many tasks.
    """
    sizes = df.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit)
    if sizes.isEmpty():
        return df.withColumn(name, F.lit(0).cast("long"))
    big = materialise(sizes.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]), "big-groups")
    on = F.lit(True)
    for i, k in enumerate(key):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    small = df.join(big, on, "left_anti").withColumn(name, F.lit(0).cast("long"))
    ranked = with_rank(df.join(big, on, "left_semi"), order_by, key, "_rank")
    parts = ranked.withColumn(name, F.floor((F.col("_rank") - 1) / limit).cast("long")).drop("_rank")
    return small.unionByName(parts)
