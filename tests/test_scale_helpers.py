"""Ranks, neighbours, quantiles, parts, neighbour joins and components over many partitions."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillwork.operators import neighbors as N
from quillwork.operators import ranking as R


def test_rank_with_a_group_over_many_partitions(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("g"), F.col("id") % 50)).alias("g")).repartition(16)
    out = R.with_rank(df, [F.col("id")], ["g"]).collect()
    expected, seen = {}, {}
    for r in sorted(out, key=lambda r: r["id"]):
        seen[r["g"]] = seen.get(r["g"], 0) + 1
        expected[r["id"]] = seen[r["g"]]
    assert {r["id"]: r["rank"] for r in out} == expected


def test_rank_without_group_and_null_group(spark):
    df = spark.range(1000).repartition(8)
    assert sorted((r["rank"], r["id"]) for r in R.with_rank(df, [F.col("id").desc()]).collect()) == [
        (i + 1, 999 - i) for i in range(1000)]
    nulls = spark.range(500).select("id", F.lit(None).cast("string").alias("g"))
    assert R.with_rank(nulls, [F.col("id")], ["g"]).agg(F.max("rank")).first()[0] == 500


def test_neighbors_across_borders(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 4 == 0, None).otherwise("a").alias("g"))
    out = R.with_neighbors(df, "id", [F.col("id")], ["g"]).collect()
    for name in (None, "a"):
        rows = sorted((r for r in out if r["g"] == name), key=lambda r: r["id"])
        ids = [r["id"] for r in rows]
        assert [r["prev_id"] for r in rows] == [None, *ids[:-1]]
        assert [r["next_id"] for r in rows] == [*ids[1:], None]


def test_no_global_window(spark):
    plan = R.with_rank(spark.range(100), [F.col("id")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, width=32)), min_size=1, max_size=60))
def test_quantiles_are_linear_interpolation(spark, values):
    df = spark.createDataFrame([(v, 1.0) for v in values], "x double, y double")
    got = {r["column"]: r for r in R.quantiles(df, ["x", "y"], [0.25, 0.5, 0.9]).collect()}
    present = [v for v in values if v is not None]
    if present:
        for i, p in enumerate((0.25, 0.5, 0.9)):
            assert got["x"][f"q{i}"] == pytest.approx(float(np.quantile(present, p)), rel=1e-9, abs=1e-6)
    assert got["y"]["q1"] == 1.0 and got["y"]["n"] == len(values)


def test_parts_keep_everything_in_order(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 100).alias("k"))
    out = R.with_parts(df, ["k"], [F.col("id")], limit=50)
    sizes = out.groupBy("k", "part").count()
    assert out.count() == 1000 and sizes.agg(F.max("count")).first()[0] <= 50
    hot = out.filter("k = 0").orderBy("id").collect()
    assert [r["part"] for r in hot] == sorted(r["part"] for r in hot) and hot[-1]["part"] > 0
    assert R.with_parts(df, ["k"], [F.col("id")]).agg(F.max("part")).first()[0] == 0


def cloud(n, dim, seed=1, copies=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim))
    v = centres[rng.integers(0, 12, n)] + 0.35 * rng.standard_normal((n, dim))
    if copies:
        v[:copies] = v[0]
    return v


def frame(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<double>")


@pytest.mark.parametrize("block,pivots", [(4000, None), (40, 9), (25, 1)])
def test_knn_is_exact(spark, block, pivots):
    v = cloud(300, 6)
    df = frame(spark, v)
    got = {}
    for r in N.knn_join(df.filter("id % 2 = 0"), df, 4, block, pivots).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["point_id"]))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    for i in range(0, 300, 2):
        assert [p for _, p in sorted(got[i])] == np.argsort(-s[i], kind="stable")[:4].tolist()


def brute_clusters(v, radius, least):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.sqrt(np.maximum(0, 2 - 2 * u @ u.T))
    near = d <= radius
    core = near.sum(axis=1) >= least
    label = np.full(len(v), -1)
    for start in np.flatnonzero(core):
        if label[start] < 0:
            todo = [start]
            while todo:
                i = todo.pop()
                if label[i] < 0:
                    label[i] = start
                    todo += np.flatnonzero(near[i] & core & (label < 0)).tolist()
    for i in np.flatnonzero(~core):
        options = np.flatnonzero(near[i] & core)
        if len(options):
            label[i] = label[options[np.argmin(d[i, options])]]
    out = {}
    for root in set(label.tolist()) - {-1}:
        members = np.flatnonzero(label == root)
        if len(members) >= least:
            out.update({int(m): int(members.min()) for m in members})
    return out


@pytest.mark.parametrize("block,pivots,copies", [(4000, None, 0), (30, 8, 0), (30, 8, 120)])
def test_density_clusters_equal_brute_force(spark, block, pivots, copies):
    v = cloud(360, 5, seed=3, copies=copies)
    got = {r["id"]: r["cluster"] for r in N.density_clusters(frame(spark, v), 0.2, 5, block, pivots).collect()}
    expected = brute_clusters(v, 0.2, 5)
    assert len(got) == 360 and {i: c for i, c in got.items() if c is not None} == expected
    assert 1 < len(set(expected.values())) and (copies or len(expected) < 360)


def test_few_points_are_noise(spark):
    assert {r["cluster"] for r in N.density_clusters(frame(spark, cloud(3, 4)), 0.5, 5).collect()} == {None}


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    loose = [(5000, 5000)]
    df = spark.createDataFrame(path + star + loose, "a long, b long").repartition(7)
    got = {r["node"]: r["component"] for r in N.connected_components(df).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(150)} == {1000} and got[5000] == 5000


def test_stored_pages_equal_slices_and_read_their_parts_only(spark):
    from quillwork.operators.ranking import store_pages

    df = spark.range(1000).selectExpr("id", "id % 17 as k", "if(id % 5 = 0, null, id * 3 % 101) as v")
    pages = store_pages(df, ["-k", "v", "id"], rows_per_part=90)
    rows = sorted(df.collect(), key=lambda r: (-r.k, r.v is not None, r.v or 0, r.id))
    assert sum(n for _, _, n in pages.parts) == 1000 and len(pages.parts) >= 8
    for skip, limit in ((0, 5), (85, 20), (440, 200), (995, 50), (1000, 5)):
        got = pages.page(skip, limit)
        assert [r.id for r in got.collect()] == [r.id for r in rows[skip:skip + limit]]
    assert re.search(r"PartitionFilters: \[[^\]]*_part", pages.page(440, 20)._jdf.queryExecution().executedPlan().toString())
    with pytest.raises(ValueError):
        from quillwork.operators.ranking import page
        page(df, ["id"], 0, 5, "id", pages)


def test_a_pair_of_parts_gives_k_rows_a_query_over_all_its_cells():
    """Not k rows for each cell, whose number grows with the table."""
    rng = np.random.default_rng(2)
    p = rng.normal(size=(600, 8))
    p[::7] = p[0]  # copies: equal similarities go by id
    p /= np.linalg.norm(p, axis=1)[:, None]
    ids = rng.permutation(600)
    points = pd.DataFrame({"id": ids, "v": list(p)})
    rows = np.arange(1500) % 600
    queries = pd.DataFrame({"id": ids[rows], "v": list(p[rows])})
    meetings = ((np.arange(a, min(a + N.SLICE, 1500)), p[rows[a:a + N.SLICE]], slice(b, b + 20))
                for a in range(0, 1500, N.SLICE) for b in range(0, 600, 20))
    got = N._nearest_of(3)(points, queries, meetings)
    assert len(got) == 3 * 1500
    for i in (0, 7, 601, 1499):
        mine = got.iloc[3 * i:3 * i + 3]
        order = sorted((-round(float(p[rows[i]] @ p[j]), 12), ids[j]) for j in range(600) if ids[j] != ids[rows[i]])[:3]
        assert mine["query_id"].tolist() == [ids[rows[i]]] * 3
        assert [(-round(x, 12), y) for x, y in zip(mine["similarity"], mine["point_id"])] == order


def test_small_parts_do_not_make_ever_more_files():
    from quillwork.operators.ranking import PART_ROWS, PARTS, part_count

    assert [part_count(n, 40) for n in (0, 1, 40, 41, 4000)] == [1, 1, 1, 2, 100]
    assert part_count(40 * PARTS * 50, 40) == PARTS and part_count(PART_ROWS * PARTS * 3, 40) == PARTS * 3
    assert part_count(PART_ROWS * 10, PART_ROWS) == 10
