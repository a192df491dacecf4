"""Embeddings, similarity search, propagation and clustering."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import balance, materialise, spread
from .clusters import best_of_starts, nearest_centre
from .columnstats import cell, field_kinds, numeric_columns, present, text_columns, wide_stats
from .neighbors import knn_join
from .vector_index import Index, search

# Fixed values.
MIN_TEXT_LENGTH = 20
MAX_TERMS = 5000  # size of a vocabulary unless the caller asks for more
SVD_SIZE = 128
MAX_FEATURES = 50
ENCODED = 512  # items an encoder is given at once
PAYLOAD_CHARS = 500
MAX_WIDTH = 50_000  # bound of what is sent to every task
WORD = r"[\p{L}\p{N}_]{2,}"


# ---- text vectors -------------------------------------------------------------------------------

def text_vector_columns(df: DataFrame, min_length: int = MIN_TEXT_LENGTH) -> DataFrame:
    """(column, avg_length) of the text columns long enough to embed."""
    facts = wide_stats(df, lambda n, t: {"avg_length": F.avg(F.length(cell(n)))}, text_columns(df))
    return facts.filter(F.col("avg_length") > min_length).select("column", F.round("avg_length", 2).alias("avg_length"))


def stop_words() -> list[str]:
    return StopWordsRemover.loadDefaultStopWords("english")


def term_counts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, term, tf) without stop words."""
    words = F.regexp_extract_all(F.lower("_text"), F.lit(f"({WORD})"), F.lit(1))
    # texts travel once to the tasks of their documents, where all that follows for a document is done
    placed = spread(df.select(cell(doc_id).alias("doc_id"), F.col(text).alias("_text")).filter("_text is not null"), "doc_id")
    flat = placed.select("doc_id", F.explode_outer(words).alias("term")).filter("term is not null")
    stops = [w for w in stop_words() if len(w) > 1]
    return flat.filter(~F.col("term").isin(stops)).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def vocabulary(counts: DataFrame, docs: int, max_terms: int = MAX_TERMS) -> DataFrame:
    """(term, df, idf): the most frequent terms; at most ``max_terms`` rows."""
    terms = counts.groupBy("term").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
    top = terms.orderBy(F.desc("total"), "term").limit(max_terms)
    return top.select("term", "df", (F.ln((1 + F.lit(docs)) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(df: DataFrame, doc_id: str, text: str, max_terms: int = MAX_TERMS) -> DataFrame:
    """(doc_id, term, weight): L2-normalised sparse rows; a document without a vocabulary term has one row of NULLs.

    The vocabulary is the only broadcast side and holds at most ``max_terms`` rows, which may not exceed MAX_WIDTH.
    """
    if max_terms > MAX_WIDTH:
        raise ValueError(f"at most {MAX_WIDTH} terms can be sent to every task")
    counts = term_counts(df, doc_id, text)
    terms = vocabulary(counts, df.filter(F.col(text).isNotNull()).count(), max_terms)
    raw = counts.join(F.broadcast(terms), "term").select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))
    rows = raw.select("doc_id", "term", (F.col("w") / norm).alias("weight"))
    every = df.select(cell(doc_id).alias("doc_id")).distinct()
    return every.join(rows, "doc_id", "left")


def _gram_times(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """XᵀX·basis in one pass: each task folds its documents into one (terms x columns) matrix."""
    width, size = basis.shape

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((width, size))
        for batch in batches:
            for at, w in zip(batch["at"], batch["w"]):
                total[at] += np.outer(w, w @ basis[at])
        yield pd.DataFrame({"m": [total.tobytes()]})

    parts = rows.select("at", "w").mapInPandas(partial, "m binary").rdd.map(lambda r: np.frombuffer(r["m"]))
    # Partial sums meet on the executors in a tree; the driver gets a few matrices of bounded size.
    return parts.treeReduce(np.add, depth=3).reshape(width, size)


def svd(weights: DataFrame, size: int = SVD_SIZE, passes: int = 7, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """((doc_id, vector), singular values): projection on the leading right singular vectors.

    Every document has a vector; one without terms (term NULL) has the zero vector.

    Randomised subspace iteration: a fixed number of passes over the documents, each reduced to a matrix of
    (vocabulary x size), so neither documents nor their products are gathered.
    """
    weights = materialise(weights, "weights")
    found = weights.filter("term is not null").select("term").distinct().limit(MAX_WIDTH + 1).collect()
    if len(found) > MAX_WIDTH:
        raise ValueError(f"more than {MAX_WIDTH} terms; choose a vocabulary first")
    names = sorted(r["term"] for r in found) or [""]
    spark = weights.sparkSession
    numbers = spark.createDataFrame(list(enumerate(names)), "at int, term string")
    placed = weights.join(F.broadcast(numbers), "term", "left")  # at most MAX_WIDTH rows
    known = F.when(F.col("at").isNotNull(), F.struct("at", "weight"))
    rows = placed.groupBy("doc_id").agg(F.sort_array(F.collect_list(known)).alias("t"))
    rows = materialise(rows.select("doc_id", F.transform("t", lambda x: x["at"]).alias("at"),
                                   F.transform("t", lambda x: x["weight"]).alias("w")), "tfidf")
    width = len(names)
    k = max(1, min(size, rows.count() - 1, width - 1))
    basis = np.random.default_rng(seed).standard_normal((width, min(width, k + 10)))
    for _ in range(passes):
        basis, _ = np.linalg.qr(_gram_times(rows, basis))
    values, turn = np.linalg.eigh(basis.T @ _gram_times(rows, basis))
    order = np.argsort(values)[::-1][:k]
    right = basis @ turn[:, order]
    # The sign of a singular vector is free: its largest entry is made positive.
    signs = np.sign(right[np.abs(right).argmax(axis=0), np.arange(k)])
    right = right * np.where(signs == 0, 1, signs)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(w @ right[at]).tolist() for at, w in zip(batch["at"], batch["w"])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "vector": out})

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(project, f"doc_id {kind}, vector array<double>"), np.sqrt(np.maximum(values[order], 0))


# ---- encoders -----------------------------------------------------------------------------------

Encoder = Callable[[], Callable[[Sequence], Sequence]]


def embed(df: DataFrame, item_id: str, item: str, encoder: Encoder, tasks: int | None = None) -> DataFrame:
    """(item_id, vector): unit vectors from a user-supplied batch encoder.

    The encoder is made once per task. Items that cannot be encoded are dropped by id; a failing batch is
    retried item by item.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in (b.slice(begin, ENCODED) for b in batches for begin in range(0, b.num_rows, ENCODED)):
            given = batch.column(1).to_pandas()
            items = list(given[given.notna()])
            try:
                found = list(encode(items))
            except Exception:  # noqa: BLE001
                found = []
                for one in items:
                    try:
                        found.append(encode([one])[0])
                    except Exception:  # noqa: BLE001
                        found.append(None)
            rows = [(i, [float(x) for x in v]) for i, v in zip(np.flatnonzero(given.notna()), found) if v is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows], pa.int64())),
                                              pa.array([v for _, v in rows], pa.list_(pa.float64()))], names=["item_id", "vector"])

    kind = df.schema[item_id].dataType.simpleString()
    picked = df.select(item_id, item)
    raw = (picked.repartition(tasks) if tasks else balance(picked)).mapInArrow(run, f"item_id {kind}, vector array<double>")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("_n", norm).select("item_id", F.when(
        F.col("_n") > 0, F.transform("vector", lambda x: x / F.col("_n"))).otherwise(F.col("vector")).alias("vector"))


def embedding_report(vectors: DataFrame, method: str) -> DataFrame:
    return vectors.agg(F.lit(method).alias("method"), F.count("*").alias("count"),
                       F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"))


def store(current: DataFrame, new: DataFrame, vector_id: str, payload: str | None = None) -> DataFrame:
    """Upsert by id; payload texts are cut at 500 characters."""
    if payload:
        new = new.withColumn(payload, F.substring(payload, 1, PAYLOAD_CHARS))
    return current.join(new.select(vector_id), vector_id, "left_anti").unionByName(new)


# ---- search -------------------------------------------------------------------------------------

def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    def norm(v: Column) -> Column:
        return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))

    return F.when((norm(a) > 0) & (norm(b) > 0), dot / (norm(a) * norm(b)))


def top_k(vectors: DataFrame, query: Sequence[float], k: int = 10, vector_id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(vector_id, score): the ``k`` most similar rows to one query, by one scan with a bounded heap per task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(vector_id, cosine(F.col(vector), q).alias("score")).filter("score is not null")
    return scored.orderBy(F.desc("score"), vector_id).limit(k)


def in_catalog(hits: DataFrame, catalog: DataFrame, hit_id: str, asset_id: str) -> DataFrame:
    """Hits joined to their catalog rows; hits whose asset is gone are left out. ``hits`` is a bounded page."""
    return catalog.join(F.broadcast(hits), catalog[asset_id] == hits[hit_id])


def top_k_join(vectors: DataFrame, queries: DataFrame, k: int = 10, vector_id: str = "vec_id",
               vector: str = "embedding", **options) -> DataFrame:
    """(query_id, point_id, similarity, rank) for a table of queries (exact)."""
    points = vectors.select(F.col(vector_id).alias("id"), F.col(vector).alias("v"))
    return knn_join(queries.select(F.col(vector_id).alias("id"), F.col(vector).alias("v")), points, k, **options)


def propagate(vectors: DataFrame, k: int = 5, threshold: float = 0.7, candidates: str = "all",
              vector_id: str = "vec_id", vector: str = "embedding", label: str = "known_label",
              block: int | None = None, pivots: int | None = None, index: Index | None = None) -> DataFrame:
    """(item_id, label, confidence, source_id, similarity) for unlabelled items whose neighbours agree.

    With an ``index`` of the candidates their neighbours are searched there, else by the exact join.

    ``candidates='all'`` looks at the k nearest points and keeps the labelled ones among them;
    ``'labeled'`` looks at the k nearest labelled points.
    """
    if candidates not in ("all", "labeled"):
        raise ValueError("candidates must be 'all' or 'labeled'")
    flat = vectors.select(F.col(vector_id).alias("id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    known = flat.filter("label is not null")
    points = known if candidates == "labeled" else flat
    options = {k_: v for k_, v in (("block", block), ("pivots", pivots)) if v is not None}
    unknown = flat.filter("label is null")
    hits = search(index, unknown, k) if index else knn_join(unknown, points, k, **options)
    named = hits.join(known.select(F.col("id").alias("point_id"), "label"), "point_id")
    votes = named.groupBy("query_id", "label").agg(
        F.sum("similarity").alias("weight"), F.min("rank").alias("first"),
        F.min_by("point_id", "rank").alias("source_id"), F.max("similarity").alias("similarity"))
    won = votes.groupBy("query_id").agg(
        F.max_by(F.struct("label", "weight", "source_id", "similarity"),
                 F.struct(F.round("weight", 9), -F.col("first"))).alias("w"), F.sum("weight").alias("total"))
    share = F.when(F.col("total") > 0, F.col("w.weight") / F.col("total")).otherwise(0.0)
    return won.withColumn("share", share).filter(F.col("share") >= threshold).select(
        F.col("query_id").alias("item_id"), F.col("w.label").alias("label"), F.round("share", 4).alias("confidence"),
        F.col("w.source_id").alias("source_id"), F.round("w.similarity", 4).alias("similarity"))


def propagation_report(vectors: DataFrame, propagated: DataFrame, label: str = "known_label") -> DataFrame:
    """(total_unlabeled, propagated, skipped)."""
    total = vectors.agg(F.count_if(F.col(label).isNull()).alias("total_unlabeled"))
    done = propagated.agg(F.count("*").alias("propagated"))
    wide = total.unionByName(done, allowMissingColumns=True)
    wide = wide.agg(*[F.max(c).alias(c) for c in ("total_unlabeled", "propagated")])
    return wide.withColumn("skipped", F.col("total_unlabeled") - F.col("propagated"))


# ---- clustering ---------------------------------------------------------------------------------

def standardised(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` plus ``features``: missing as 0, centred, divided by the population deviation (1 if constant)."""
    kinds = field_kinds(df)

    def filled(c: str) -> Column:
        return F.coalesce(present(c, kinds[c]).cast("double"), F.lit(0.0))

    facts = df.agg(*[F.avg(filled(c)).alias(f"m{i}") for i, c in enumerate(columns)],
                   *[F.stddev_pop(filled(c)).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    scaled = [(filled(c) - F.lit(facts[f"m{i}"])) / F.lit(facts[f"s{i}"] or 1.0) for i, c in enumerate(columns)]
    return df.withColumn("features", array_to_vector(F.array(*scaled)))


def cluster_count(df: DataFrame, columns: Sequence[str], k: int) -> int:
    """``k`` limited by the number of distinct rows; 0 when there are fewer than two."""
    distinct = df.select(*[cell(c) for c in columns]).distinct().limit(k + 1).count()
    return 0 if distinct < 2 else max(2, min(k, distinct))


def reduce_features(features: DataFrame, components: int) -> tuple[DataFrame, list[float]]:
    """``features`` by principal components, and the explained variance shares."""
    model = PCA(k=components, inputCol="features", outputCol="_pca").fit(features)
    out = model.transform(features).drop("features").withColumnRenamed("_pca", "features")
    return out, [float(v) for v in model.explainedVariance]


def kmeans(df: DataFrame, k: int = 5, columns: Sequence[str] | None = None, max_features: int = MAX_FEATURES,
           seed: int = 42, restarts: int = 10) -> tuple[DataFrame, dict]:
    """(rows with ``cluster``, facts): standardise, reduce wide input, cluster.

    Facts hold n_clusters, inertia, centers and explained variance. The scaled rows are written for the rounds of
    the fit. Of ``restarts`` starts, fitted together, the best is kept.
    """
    columns = list(columns or numeric_columns(df))
    count = cluster_count(df, columns, k) if columns else 0
    if count == 0:
        return df.withColumn("cluster", F.lit(None).cast("int")), {
            "n_clusters": 0, "inertia": 0.0, "centers": [], "explained_variance": []}
    scaled = standardised(df, columns)
    variance: list[float] = []
    if len(columns) > max_features:
        scaled, variance = reduce_features(scaled, min(2 * count, len(columns), df.limit(2 * count).count()))
    scaled = materialise(balance(scaled), "scaled")
    centres, inertia = best_of_starts(scaled, count, restarts, seed)
    facts = {"n_clusters": count, "inertia": float(inertia), "centers": [[float(x) for x in c] for c in centres],
             "explained_variance": variance}
    return nearest_centre(scaled, centres), facts


def silhouette(clustered: DataFrame) -> float:
    """Silhouette with squared Euclidean distance; -1 when it is undefined."""
    groups = clustered.select("cluster").distinct().limit(2).count()
    if groups < 2:
        return -1.0
    return float(ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(clustered))


def cluster_sizes(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, size), noise left out."""
    return clustered.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count("*").alias("size"))


def cluster_summary(clustered: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(clusters, clustered, unclustered)."""
    per = clustered.groupBy(cluster).agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    return per.agg(F.count(cluster).alias("clusters"),
                   F.coalesce(F.sum(F.when(F.col(cluster).isNotNull(), F.col("n"))), zero).alias("clustered"),
                   F.coalesce(F.sum(F.when(F.col(cluster).isNull(), F.col("n"))), zero).alias("unclustered"))


def features_array(df: DataFrame) -> DataFrame:
    return df.withColumn("features", vector_to_array("features"))
