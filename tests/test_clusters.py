"""k-means from ten starts beside single fits; the sampled silhouette beside the exact one."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillwork.operators import clusters as C


def features(spark, seed=1, n=600):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, 3)) * 2
    x = np.concatenate([c + rng.normal(size=(n // 7, 3)) for c in centres])
    return x, spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(array_to_vector("x").alias("features")).repartition(3)


def test_ten_starts_are_no_worse_than_ten_fits(spark):
    x, df = features(spark)
    centres, inertia = C.best_of_starts(df, 6)
    near = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert inertia == np.float64(near.min(axis=1).sum()).round(9) or abs(inertia - near.min(axis=1).sum()) < 1e-6
    fits = [KMeans(k=6, maxIter=300, tol=0.004, seed=s, featuresCol="features").fit(df).summary.trainingCost for s in range(10)]
    assert inertia <= min(fits) * 1.002
    placed = C.nearest_centre(df, centres).groupBy("cluster").agg(F.count("*").alias("n")).collect()
    assert {r.cluster: r.n for r in placed} == dict(enumerate(np.bincount(near.argmin(axis=1)).tolist()))


def test_sampled_silhouette_lies_within_its_bound(spark):
    x, df = features(spark, 2, 2100)
    placed = C.nearest_centre(df, C.best_of_starts(df, 5, starts=2)[0])
    exact = C.euclidean_silhouette(placed, 5000).first()
    part = C.euclidean_silhouette(placed, 300).first()
    assert exact.exact and exact.bound == 0 and not part.exact and 0 < part.bound < 0.1
    assert abs(exact.silhouette - part.silhouette) <= part.bound
    one = placed.withColumn("cluster", F.lit(1))
    assert C.euclidean_silhouette(one).first().silhouette == -1


def test_nearest_centres_of_all_starts_at_once():
    rng = np.random.default_rng(4)
    x, centres = rng.normal(size=(300, 3)), rng.normal(size=(4, 5, 3))
    centres[2, 3] = centres[2, 1]  # a tie goes to the first
    flat = centres.reshape(20, 3)
    near, cost = C._nearest(x.T.copy(), flat, (flat * flat).sum(axis=1)[:, None], 4)
    plain = ((x[None, :, None, :] - centres[:, None, :, :]) ** 2).sum(axis=3)
    assert (near == plain.argmin(axis=2)).all() and np.allclose(cost, plain.min(axis=2))


def test_a_round_adds_up_the_points_of_each_centre(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 2))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "x0 double, x1 double").repartition(3)
    centres = {1: x[:4].copy(), 7: np.vstack([x[4:7], [[99.0, 99.0]]])}
    for s, (sums, counts, cost) in C._round(df, centres).items():
        far = ((x[:, None, :] - centres[s]) ** 2).sum(axis=2)
        near = far.argmin(axis=1)
        assert counts.tolist() == np.bincount(near, minlength=4).tolist() and np.isclose(cost, far.min(axis=1).sum())
        assert np.allclose(sums, [x[near == j].sum(axis=0) for j in range(4)])
    assert {s: c.sum() for s, (_, c, _) in C._round(df.limit(0), centres).items()} == {1: 0, 7: 0}
