"""k-means from several starts in one pass a round, and the silhouette with an error bound.

``features`` is a vector column. What a task gives back is one row for each start and cluster, or for each sampled point
and cluster, so nothing that leaves it grows with the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

SEEDS = 10_000  # rows that first centres are drawn from
ROWS = 1024  # points whose distances are held at once
SAMPLED = 2000  # points whose silhouette is computed


def _rows_of(df: DataFrame, limit: int, salt: int) -> np.ndarray:
    """At most ``limit`` rows, those with the least hash."""
    flat = df.select(vector_to_array("features").alias("x"))
    rows = flat.orderBy(F.xxhash64(F.lit(salt), F.col("x").cast("string")), "x").limit(limit).collect()
    return np.array([r["x"] for r in rows], dtype=np.float64)


def _square_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def _nearest(x: np.ndarray, centres: np.ndarray, norms: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each start, for the points that are the columns of ``x``: the nearest of its centres and its squared distance."""
    far = np.maximum((x * x).sum(axis=0) - 2 * (centres @ x) + norms, 0).reshape(starts, -1, x.shape[1])
    near, cost = np.zeros((starts, x.shape[1]), dtype=np.int32), far[:, 0].copy()
    for j in range(1, far.shape[1]):  # a later centre only where it is nearer
        np.copyto(near, j, where=far[:, j] < cost)
        np.minimum(cost, far[:, j], out=cost)
    return near, cost


def first_centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` rows, each drawn with a chance that grows with the squared distance to those drawn before."""
    chosen = [x[rng.integers(len(x))]]
    far = _square_distances(x, np.array(chosen))[:, 0]
    while len(chosen) < k and far.sum() > 0:
        chosen.append(x[rng.choice(len(x), p=far / far.sum())])
        far = np.minimum(far, _square_distances(x, np.array(chosen[-1:]))[:, 0])
    while len(chosen) < k:  # fewer different rows than clusters in the sample
        chosen.append(chosen[-1])
    return np.array(chosen)


def _round(flat: DataFrame, centres: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray, float]]:
    """Of each start: sums and counts of the points nearest to each centre, and the inertia. One pass for all starts.

    ``flat`` has one plain column for each feature, which reaches a task as one array.
    """
    shared = flat.sparkSession.sparkContext.broadcast(centres)
    k, d = next(iter(centres.values())).shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, all_ = list(shared.value), np.concatenate(list(shared.value.values()))
        norms, numbers = (all_ * all_).sum(axis=1)[:, None], np.arange(k, dtype=np.int32)[:, None]
        total = np.zeros((len(all_), d + 2))
        for batch in batches:
            whole = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            for begin in range(0, whole.shape[1], ROWS):
                x = np.ascontiguousarray(whole[:, begin:begin + ROWS])
                near, cost = _nearest(x, all_, norms, len(starts))
                mine = (near[:, None, :] == numbers).astype(np.float64)
                total[:, :d + 1] += mine.reshape(len(all_), -1) @ np.vstack([x, np.ones(x.shape[1])]).T
                total[:, d + 1] += (mine @ cost[:, :, None]).ravel()
        rows = [(starts[i // k], i % k, total[i].tolist()) for i in range(len(all_)) if total[i, d]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (
            pa.int32(), pa.int32(), pa.list_(pa.float64())))], names=["start", "cluster", "sums"])

    parts = flat.mapInArrow(work, "start int, cluster int, sums array<double>")
    added = parts.groupBy("start", "cluster").agg(*[F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(d + 2)]).collect()
    out = {s: (np.zeros((k, d)), np.zeros(k), 0.0) for s in centres}
    for r in added:  # a row for each start and cluster
        sums, counts, cost = out[r["start"]]
        sums[r["cluster"]] = [r[f"s{i}"] for i in range(d)]
        counts[r["cluster"]] = r[f"s{d}"]
        out[r["start"]] = (sums, counts, cost + r[f"s{d + 1}"])
    return out


def best_of_starts(df: DataFrame, k: int, starts: int = 10, seed: int = 42, rounds: int = 300,
                   shift: float = 1e-4) -> tuple[np.ndarray, float]:
    """Centres and inertia of the best of ``starts`` k-means fits.

    First centres are drawn from at most ``SEEDS`` rows. A start that has settled (its centres moved by ``shift`` at most,
    squared and added up) is left out of later rounds. A centre without points stays where it is.
    """
    x = _rows_of(df, SEEDS, seed)
    wide = df.select(vector_to_array("features").alias("x"))
    df = materialise(wide.select(*[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(x.shape[1])]), "features")
    open_ = {s: first_centres(x, k, np.random.default_rng(seed + s)) for s in range(starts)}
    done: dict[int, np.ndarray] = {}
    for _ in range(rounds):
        if not open_:
            break
        for s, (sums, counts, _) in _round(df, open_).items():
            new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], open_[s])
            if ((new - open_[s]) ** 2).sum() <= shift:
                done[s] = new
            open_[s] = new
        open_ = {s: c for s, c in open_.items() if s not in done}
    done |= open_
    cost = {s: c for s, (_, _, c) in _round(df, done).items()}
    best = min(cost, key=lambda s: (cost[s], s))
    return done[best], cost[best]


def nearest_centre(df: DataFrame, centres: np.ndarray) -> DataFrame:
    """``df`` with ``cluster``, the number of the nearest centre; the first one in a tie."""
    x = vector_to_array("features")
    far = F.array(*[F.struct(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)),
                                         F.lit(0.0), lambda t, v: t + v).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)])
    return df.withColumn("cluster", F.array_min(far)["i"])


def euclidean_silhouette(df: DataFrame, sampled: int = SAMPLED) -> DataFrame:
    """(clusters, points, silhouette, bound, exact) of rows with ``features`` and ``cluster``; nulls are left out.

    The silhouette of a point needs its distances to all others. It is computed for at most ``sampled`` points, drawn from
    every cluster in proportion to its size (two at least), against the whole table in one pass. If those are all points the
    value is exact; else ``bound`` is three standard errors of the stratified mean. Points alone in their cluster count
    as 0; with fewer than two clusters the value is -1.
    """
    spark = df.sparkSession
    rows = df.filter("cluster is not null").select(vector_to_array("features").alias("x"), F.col("cluster").cast("string").alias("c"))
    sizes = {r["c"]: r["n"] for r in rows.groupBy("c").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    total = sum(sizes.values())
    schema = "clusters int, points long, silhouette double, bound double, exact boolean"
    if len(names) < 2:
        return spark.createDataFrame([(len(names), total, -1.0, 0.0, True)], schema)
    wanted = {c: sizes[c] if total <= sampled else min(sizes[c], max(2, round(sampled * sizes[c] / total))) for c in names}
    draw = F.xxhash64(F.lit(5), F.col("x").cast("string"))
    picked = None
    for c in names:  # at most ``sampled`` rows and two a cluster
        some = rows.filter(F.col("c") == c)
        some = some if wanted[c] == sizes[c] else some.orderBy(draw, "x").limit(wanted[c])
        picked = some if picked is None else picked.unionByName(some)
    sample = picked.toPandas()
    points, own = np.stack(sample["x"].to_numpy()), sample["c"].map({c: i for i, c in enumerate(names)}).to_numpy()
    shared = spark.sparkContext.broadcast((points, {c: i for i, c in enumerate(names)}))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, number = shared.value
        sums = np.zeros((len(number), len(at)))
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.iloc[begin:begin + 256]
                x, mine = np.stack(part["x"].to_numpy()), part["c"].map(number).to_numpy()
                far = np.sqrt(((x[:, None, :] - at[None, :, :]) ** 2).sum(axis=2)) if at.size < 50_000 else np.sqrt(_square_distances(x, at))
                for i in np.unique(mine):
                    sums[i] += far[mine == i].sum(axis=0)
        yield pd.DataFrame({"cluster": np.arange(len(number)), "sums": list(sums)})

    parts = rows.mapInPandas(work, "cluster int, sums array<double>")
    added = np.zeros((len(names), len(points)))
    each = parts.select("cluster", F.posexplode("sums").alias("place", "v")).groupBy("cluster", "place").agg(F.sum("v").alias("v")).toPandas()
    added[each["cluster"].to_numpy(), each["place"].to_numpy()] = each["v"].to_numpy()
    n = np.array([sizes[c] for c in names])
    mean = added / n[:, None]
    inner = added[own, np.arange(len(own))] / np.maximum(n[own] - 1, 1)
    mean[own, np.arange(len(own))] = np.inf
    outer = mean.min(axis=0)
    value = np.where(n[own] > 1, (outer - inner) / np.maximum(np.maximum(outer, inner), 1e-300), 0.0)
    silhouette = variance = 0.0
    for i, c in enumerate(names):
        s, weight, m = value[own == i], n[i] / total, (own == i).sum()
        silhouette += weight * s.mean()
        variance += weight ** 2 * (1 - m / n[i]) * (s.var(ddof=1) if m > 1 else 0.0) / m
    exact = len(points) == total
    return spark.createDataFrame([(len(names), total, float(silhouette), 0.0 if exact else float(3 * variance ** 0.5), exact)], schema)
