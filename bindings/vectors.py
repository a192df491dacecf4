"""Vectors, clustering and compositions."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quillwork.operators import clusters as C
from quillwork.operators import hierarchy as H
from quillwork.operators import neighbors as N
from quillwork.operators import rules as R
from quillwork.operators import scoring as S
from quillwork.operators import vector_index as I
from quillwork.operators import vectors as V
from quillwork.operators.cleaning import CleaningPlan, fill_nulls
from quillwork.plans import flows

from .base import load, register
from .images import png_images
from .tables import mode_sql

PARTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def vectors(spark, sf):
    return load(spark, sf, "vectors")


def as_columns(df):
    """The 64 vector entries as 64 numeric columns."""
    return df.select("vec_id", *[F.get("embedding", F.lit(i)).alias(f"e{i}") for i in range(64)])


UNIT = """u AS (SELECT vec_id, known_label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM vectors)"""
PAIRS = """p AS (SELECT a.vec_id AS q, b.vec_id AS p, b.known_label AS label, list_cosine_similarity(a.v, b.v) AS s
    FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE {where})"""


@register("vec_topk", f"""WITH {UNIT}, {PAIRS.format(where="a.vec_id = 0")}
    SELECT p AS vec_id, round(s, 6) AS score FROM p ORDER BY s DESC, p LIMIT 20""")
def vec_topk(spark, sf):
    table = vectors(spark, sf)
    query = table.filter("vec_id = 0").select("embedding").first()[0]
    out = V.top_k(table.filter("vec_id <> 0"), query, 20)
    return out.withColumn("score", F.round("score", 6))


@register("vec_topk_join", f"""WITH {UNIT}, {PAIRS.format(where="a.vec_id % 4 = 0")}
    SELECT q AS query_id, p AS point_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM p) x WHERE r <= 10""")
def vec_topk_join(spark, sf):
    table = vectors(spark, sf)
    return V.top_k_join(table, table.filter("vec_id % 4 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@register("vec_topk_join_cells", f"""WITH {UNIT}, {PAIRS.format(where="a.vec_id % 4 = 0")}
    SELECT q AS query_id, p AS point_id, round(s, 6) AS similarity, CAST(r AS INT) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM p) x WHERE r <= 10""")
def vec_topk_join_cells(spark, sf):
    """The same through many cells, several blocks each."""
    table = vectors(spark, sf)
    return V.top_k_join(table, table.filter("vec_id % 4 = 0"), 10, block=100, pivots=12).withColumn("similarity", F.round("similarity", 6))


@register("vec_topk_catalog", f"""WITH {UNIT}, {PAIRS.format(where="a.vec_id = 0")},
    h AS (SELECT p AS vec_id, round(s, 6) AS score FROM p ORDER BY s DESC, p LIMIT 20)
    SELECT vec_id, score, file_name, width, height FROM h JOIN assets ON asset_id = vec_id WHERE dataset_id = 1""")
def vec_topk_catalog(spark, sf):
    """The hits of a search that belong to one data set of the catalog."""
    assets = load(spark, sf, "assets").filter("dataset_id = 1")
    return V.in_catalog(vec_topk(spark, sf), assets, "vec_id", "asset_id").select("vec_id", "score", "file_name", "width", "height")


def near(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@register("vec_index_recall", """SELECT count(*) AS queries, 10 AS k, true AS reached, true AS exact_scores FROM embeddings
    WHERE vec_id % 50 = 0""")
def vec_index_recall(spark, sf):
    """Recall of the index against the exact join, after the number of cells to visit was found by it."""
    points = near(spark, sf)
    queries = points.filter("id % 50 = 0")
    index = I.tuned(I.build_index(points), queries, 10)
    found = I.recall(index, queries, 10)
    every = I.search(index, queries, 10).select("query_id", "point_id", "similarity")
    both = every.join(points.select(F.col("id").alias("query_id"), F.col("v").alias("a")), "query_id").join(
        points.select(F.col("id").alias("point_id"), F.col("v").alias("b")), "point_id")
    wrong = both.filter(F.abs(F.col("similarity") - V.cosine(F.col("a"), F.col("b"))) > 1e-6).count()
    return found.select("queries", "k", (F.col("recall") >= 0.95).alias("reached"), F.lit(wrong == 0).alias("exact_scores"))


@register("vec_propagate_index", "SELECT true AS agrees")
def vec_propagate_index(spark, sf):
    """Labels by way of the index agree with those of the exact join for nineteen items of twenty."""
    points = near(spark, sf)
    index = I.tuned(I.build_index(points), points.filter("id % 50 = 0"), 10)
    table = vectors(spark, sf)
    by_index = V.propagate(table, index=index).select("item_id", F.col("label").alias("other"))
    exact = V.propagate(table)
    both = exact.join(by_index, "item_id", "full")
    return both.agg((F.count_if(F.col("label").eqNullSafe(F.col("other"))) >= 0.95 * F.count("*")).alias("agrees"))


def propagated_sql(points: str) -> str:
    return f"""WITH {UNIT}, {PAIRS.format(where="a.known_label IS NULL" + points)},
    h AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, p) AS r FROM p),
    v AS (SELECT q, label, sum(s) AS w, min(r) AS first, arg_min(p, r) AS source, max(s) AS best
          FROM h WHERE r <= 5 AND label IS NOT NULL GROUP BY q, label),
    w AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(w, 9) DESC, first) AS r, sum(w) OVER (PARTITION BY q) AS total FROM v)
    SELECT q AS item_id, label, round(w / total, 4) AS confidence, source AS source_id, round(best, 4) AS similarity
    FROM w WHERE r = 1 AND w / total >= 0.7"""


@register("vec_propagate", propagated_sql(""))
def vec_propagate(spark, sf):
    return V.propagate(vectors(spark, sf))


@register("vec_propagate_labeled", propagated_sql(" AND b.known_label IS NOT NULL"))
def vec_propagate_labeled(spark, sf):
    return V.propagate(vectors(spark, sf), candidates="labeled")


@register("vec_propagation_report", f"""WITH x AS ({propagated_sql("")})
    SELECT (SELECT count(*) FROM vectors WHERE known_label IS NULL) AS total_unlabeled, count(*) AS propagated,
           (SELECT count(*) FROM vectors WHERE known_label IS NULL) - count(*) AS skipped FROM x""")
def vec_propagation_report(spark, sf):
    table = vectors(spark, sf)
    return V.propagation_report(table, V.propagate(table))


@register("vec_store", """
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN md5(substr(text, 1, 500)) ELSE md5(substr(text, 1, 10)) END AS payload
    FROM documents WHERE doc_id % 3 = 0 OR doc_id % 2 = 0""")
def vec_store(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", F.col("text").alias("payload"))
    current = docs.filter("doc_id % 2 = 0").withColumn("payload", F.substring("payload", 1, 10))
    out = V.store(current, docs.filter("doc_id % 3 = 0"), "doc_id", "payload")
    return out.withColumn("payload", F.md5("payload"))


@register("vec_text_columns", """SELECT * FROM (SELECT 'text' AS "column", round(avg(length(text)), 2) AS avg_length FROM documents
    UNION ALL SELECT 'lang', round(avg(length(lang)), 2) FROM documents) t WHERE avg_length > 20""")
def vec_text_columns(spark, sf):
    return V.text_vector_columns(load(spark, sf, "documents").select("doc_id", "text", "lang"))


STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its "
    "itself they them their theirs themselves what which who whom this that these those am is are was were be been being have "
    "has had having do does did doing a an the and but if or because as until while of at by for with about against between "
    "into through during before after above below to from up down in out on off over under again further then once here there "
    "when where why how all any both each few more most other some such no nor not only own same so than too very s t can will "
    "just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's "
    "we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't "
    "wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's "
    "where's who's why's would").split())
TERMS = f"""
    t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM documents),
    c AS (SELECT doc_id, term, count(*) AS tf FROM t WHERE term NOT IN ({STOPS}) GROUP BY doc_id, term),
    k AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
          FROM c GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 5000)"""


@register("vec_idf", f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM k")
def vec_idf(spark, sf):
    docs = load(spark, sf, "documents")
    terms = V.vocabulary(V.term_counts(docs, "doc_id", "text"), docs.count())
    return terms.withColumn("idf", F.round("idf", 6))


@register("vec_tfidf", f"""WITH {TERMS}, w AS (SELECT doc_id, term, tf * idf AS w FROM c JOIN k USING (term))
    SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM documents LEFT JOIN w USING (doc_id)""")
def vec_tfidf(spark, sf):
    out = V.tfidf(load(spark, sf, "documents"), "doc_id", "text")
    return out.withColumn("weight", F.round("weight", 6))


@register("vec_svd")
def vec_svd(spark, sf):
    docs = load(spark, sf, "documents")
    out, _ = V.svd(V.tfidf(docs, "doc_id", "text"))
    return out


def byte_share_encoder():
    """Stand-in encoder: share of each of 16 byte classes."""
    import numpy as np

    def encode(items):
        raw = [np.frombuffer(i.encode() if isinstance(i, str) else i, dtype=np.uint8) for i in items]
        return [np.bincount(r >> 4, minlength=16) / max(1, len(r)) for r in raw]
    return encode


def embedded(spark, sf):
    return V.embed(load(spark, sf, "documents"), "doc_id", "text", byte_share_encoder)


BYTES = """b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents),
    c AS (SELECT doc_id, left(b, 1) AS k, count(*) AS n FROM b GROUP BY ALL),
    u AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM c GROUP BY doc_id)"""


@register("vec_embed", f"""WITH {BYTES} SELECT doc_id, {", ".join(
    f"coalesce(round(max(n / norm) FILTER (k = '{k:X}'), 6), 0) AS e{k}" for k in range(16))} FROM c JOIN u USING (doc_id) GROUP BY doc_id""")
def vec_embed(spark, sf):
    return embedded(spark, sf).select(F.col("item_id").alias("doc_id"), *[F.round(F.get("vector", F.lit(k)), 6).alias(f"e{k}") for k in range(16)])


@register("vec_embed_report", "SELECT 'bytes' AS method, count(*) AS count, CAST(16 AS INT) AS dimension FROM documents")
def vec_embed_report(spark, sf):
    return V.embedding_report(embedded(spark, sf), "bytes")


@register("vec_embed_images")
def vec_embed_images(spark, sf):
    return V.embed(png_images(load(spark, sf, "embeddings")), "vec_id", "content", byte_share_encoder)


@register("ail_classify_images", """SELECT vec_id, '' AS predicted_label, CAST(0 AS DOUBLE) AS confidence, 'no label named' AS reasoning
    FROM embeddings WHERE vec_id % 2 = 1 UNION ALL
    SELECT vec_id, 'png', CAST(1 AS DOUBLE), 'named in the text' FROM embeddings WHERE vec_id % 2 = 0""")
def ail_classify_images(spark, sf):
    images = png_images(load(spark, sf, "embeddings"))
    # Half the images lose their first bytes, so that the stand-in scorer no longer finds the format name.
    images = images.withColumn("content", F.when(F.col("vec_id") % 2 == 0, F.col("content")).otherwise(
        F.substring("content", 9, 10)))
    return S.classify(images, "content", ["PNG"]).drop("content").withColumn("predicted_label", F.lower("predicted_label"))


# ---- clustering ---------------------------------------------------------------------------------

@register("vec_kmeans")
def vec_kmeans(spark, sf):
    clustered, _ = V.kmeans(load(spark, sf, "lineitem").select(*PARTS), 5)
    return V.cluster_sizes(clustered)


@register("vec_kmeans_centers")
def vec_kmeans_centers(spark, sf):
    _, facts = V.kmeans(load(spark, sf, "lineitem").select(*PARTS), 5)
    rows = [(i, [round(x, 6) for x in c], round(facts["inertia"], 4)) for i, c in enumerate(facts["centers"])]
    return spark.createDataFrame(rows, "cluster int, center array<double>, inertia double")


@register("vec_pca")
def vec_pca(spark, sf):
    wide = as_columns(load(spark, sf, "embeddings"))
    _, facts = V.kmeans(wide, 5, [c for c in wide.columns if c != "vec_id"])
    return spark.createDataFrame(list(enumerate(facts["explained_variance"])), "component int, share double")


@register("vec_silhouette")
def vec_silhouette(spark, sf):
    clustered, facts = V.kmeans(load(spark, sf, "lineitem").select(*PARTS), 5)
    return spark.createDataFrame([(facts["n_clusters"], V.silhouette(clustered))], "clusters int, silhouette_sq double")


@register("vec_kmeans_checks", """SELECT count(*) AS points, 5 AS clusters, 0 AS misplaced, true AS inertia_agrees, true AS centred
    FROM lineitem""")
def vec_kmeans_checks(spark, sf):
    """What holds for any k-means result: no point is nearer to another centre, centres are the means of their points,
    the inertia is the sum of the squared distances."""
    clustered, facts = V.kmeans(load(spark, sf, "lineitem").select(*PARTS), 5)
    rows = V.features_array(clustered).select("features", "cluster")
    centres = spark.createDataFrame([(i, c) for i, c in enumerate(facts["centers"])], "other int, centre array<double>")
    far = F.aggregate(F.zip_with("features", "centre", lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda t, x: t + x)
    every = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(len(facts["centers"]) - 1)))).join(F.broadcast(centres), "other")
    own = F.when(F.col("cluster") == F.col("other"), far)
    per_pair = every.withColumn("own", F.aggregate(F.zip_with("features", F.element_at(
        F.array(*[F.array(*map(F.lit, c)) for c in facts["centers"]]), F.col("cluster") + 1), lambda a, b: F.pow(a - b, 2)),
        F.lit(0.0), lambda t, x: t + x))
    found = per_pair.agg(F.count_if(F.col("other") == 0).alias("points"), F.count_if(far < F.col("own") - 1e-9).cast("int").alias("misplaced"),
                         F.sum(own).alias("inertia"))
    means = rows.groupBy("cluster").agg(*[F.avg(F.get("features", F.lit(i))).alias(f"m{i}") for i in range(len(PARTS))]).collect()
    moved = max(abs(r[f"m{i}"] - facts["centers"][r["cluster"]][i]) for r in means for i in range(len(PARTS)))
    return found.select("points", F.lit(facts["n_clusters"]).alias("clusters"), "misplaced",
                        (F.abs(F.col("inertia") - facts["inertia"]) <= 1e-6 * facts["inertia"]).alias("inertia_agrees"),
                        F.lit(moved < 0.02).alias("centred"))


@register("vec_silhouette_euclidean", """
    WITH u AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS c, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    d AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM u a, u b GROUP BY a.id, a.c, b.c),
    i AS (SELECT id, c, s / greatest(n - 1, 1) AS a, n FROM d WHERE c = o),
    o AS (SELECT id, min(s / n) AS b FROM d WHERE c <> o GROUP BY id)
    SELECT CAST(count(DISTINCT c) AS INT) AS clusters, count(*) AS points,
           round(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b) ELSE 0 END), 6) AS silhouette, true AS exact FROM i JOIN o USING (id)""")
def vec_silhouette_euclidean(spark, sf):
    """The silhouette of the known labels, exact as the table is small."""
    rows = load(spark, sf, "embeddings").select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
                                                F.col("label").alias("cluster"))
    return C.euclidean_silhouette(rows, 5000).select("clusters", "points", F.round("silhouette", 6).alias("silhouette"), "exact")


RADIUS = 0.7


@register("vec_density_clusters", f"""
    WITH RECURSIVE {UNIT},
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.v, b.v))) AS d FROM u a, u b),
    core AS (SELECT a AS id FROM d WHERE d <= {RADIUS} GROUP BY a HAVING count(*) >= 5),
    e AS (SELECT a, b FROM d WHERE d <= {RADIUS} AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    r AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a),
    bo AS (SELECT a AS id, arg_min(b, d) AS near FROM d WHERE d <= {RADIUS} AND a NOT IN (SELECT id FROM core)
           AND b IN (SELECT id FROM core) GROUP BY a),
    m AS (SELECT * FROM c UNION ALL SELECT bo.id, comp FROM bo JOIN c ON near = c.id),
    s AS (SELECT comp, min(id) AS cluster FROM m GROUP BY comp HAVING count(*) >= 5)
    SELECT vec_id AS id, cluster FROM vectors LEFT JOIN m ON vec_id = m.id LEFT JOIN s USING (comp)""")
def vec_density_clusters(spark, sf):
    return N.density_clusters(vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), RADIUS, 5)


@register("vec_density_cells", f"""
    WITH RECURSIVE {UNIT},
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.v, b.v))) AS d FROM u a, u b),
    core AS (SELECT a AS id FROM d WHERE d <= {RADIUS} GROUP BY a HAVING count(*) >= 5),
    e AS (SELECT a, b FROM d WHERE d <= {RADIUS} AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    r AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS id, min(b) AS comp FROM r GROUP BY a),
    bo AS (SELECT a AS id, arg_min(b, d) AS near FROM d WHERE d <= {RADIUS} AND a NOT IN (SELECT id FROM core)
           AND b IN (SELECT id FROM core) GROUP BY a),
    m AS (SELECT * FROM c UNION ALL SELECT bo.id, comp FROM bo JOIN c ON near = c.id),
    s AS (SELECT comp, min(id) AS cluster FROM m GROUP BY comp HAVING count(*) >= 5)
    SELECT vec_id AS id, cluster FROM vectors LEFT JOIN m ON vec_id = m.id LEFT JOIN s USING (comp)""")
def vec_density_cells(spark, sf):
    """The same through many cells, several blocks each."""
    return N.density_clusters(vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), RADIUS, 5,
                              block=100, pivots=12)


@register("vec_density_hierarchy")
def vec_density_hierarchy(spark, sf):
    """Clusters without a radius; a plain version in the tests gives the same."""
    return H.density_hierarchy(near(spark, sf), 5)


@register("vec_core_distances", f"""WITH {UNIT},
    d AS (SELECT a.vec_id AS id, sqrt(greatest(0, 2 - 2 * list_cosine_similarity(a.v, b.v))) AS d FROM u a, u b WHERE a.vec_id <> b.vec_id),
    r AS (SELECT id, d, row_number() OVER (PARTITION BY id ORDER BY d) AS r FROM d)
    SELECT id, round(d, 6) AS core FROM r WHERE r = 4""")
def vec_core_distances(spark, sf):
    """The distance to the fifth point around each, itself included, which the hierarchy is built on."""
    reps = near(spark, sf).withColumn("weight", F.lit(1).cast("long"))
    cores, _ = H.core_distances(N.unit(reps, "v"), 5, N.BLOCK, None)
    return cores.select("id", F.round("core", 6).alias("core"))


@register("vec_cluster_summary", """SELECT count(DISTINCT known_label) AS clusters, count(known_label) AS clustered,
    count(*) - count(known_label) AS unclustered FROM vectors""")
def vec_cluster_summary(spark, sf):
    return V.cluster_summary(vectors(spark, sf), "known_label")


@register("vec_cluster_sizes", "SELECT known_label, count(*) AS size FROM vectors WHERE known_label IS NOT NULL GROUP BY 1")
def vec_cluster_sizes(spark, sf):
    return V.cluster_sizes(vectors(spark, sf), "known_label")


# ---- compositions -------------------------------------------------------------------------------

SCORED = f"""
    WITH e AS (SELECT DISTINCT * FROM dirty_customer),
    f AS (SELECT c_custkey, trim(coalesce(c_name, {mode_sql('c_name', 'e')})) AS c_name, c_nationkey,
          coalesce(c_acctbal, {mode_sql('c_acctbal', 'e')}) AS c_acctbal,
          trim(coalesce(c_mktsegment, {mode_sql('c_mktsegment', 'e')})) AS c_mktsegment, all_null, flag FROM e)"""


@register("pip_structuring", SCORED + """
    SELECT 'cleaned_rows' AS fact, CAST(count(*) AS DOUBLE) AS value FROM f
    UNION ALL SELECT 'completeness', round((count(*) * 6) / (count(*) * 7) * 100, 2) FROM f
    UNION ALL SELECT 'uniqueness', round((SELECT count(*) FROM (SELECT DISTINCT * FROM f)) / count(*) * 100, 2) FROM f
    UNION ALL SELECT 'schema_columns', 7""")
def pip_structuring(spark, sf):
    out = flows.structuring(load(spark, sf, "dirty_customer"), CleaningPlan())
    score = out["quality"]
    parts = [out["cleaned"].agg(F.lit("cleaned_rows").alias("fact"), F.count("*").cast("double").alias("value")),
             score.select(F.lit("completeness"), "completeness"), score.select(F.lit("uniqueness"), "uniqueness"),
             out["schema"].agg(F.lit("schema_columns"), F.count("*").cast("double"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@register("pip_eda")
def pip_eda(spark, sf):
    out = flows.exploration(load(spark, sf, "part"), k=4)
    sizes = out["clusters"].select(F.concat(F.lit("cluster "), "cluster").alias("fact"), F.col("size").cast("double").alias("value"))
    return out["profile"].select(F.concat(F.lit("distinct "), "column").alias("fact"),
                                 F.col("unique_count").cast("double").alias("value")).unionAll(sizes)


@register("pip_steps", f"""
    WITH f AS (SELECT *, CASE WHEN o_totalprice > 200000 THEN 'high' END AS label FROM
      (SELECT o_orderkey, coalesce(o_totalprice, {mode_sql('o_totalprice', 'dirty_orders')}) AS o_totalprice FROM dirty_orders) o)
    SELECT 'labelled' AS fact, count(label) AS n FROM f UNION ALL SELECT 'completed steps', 2 UNION ALL SELECT 'skipped steps', 1""")
def pip_steps(spark, sf):
    rule = [{"label": "high", "column": "o_totalprice", "operator": "greater_than", "value": 200000}]
    steps = [{"step_type": "structuring", "name": "fill", "config": {"null_strategy": "fill_mode"}},
             {"step_type": "clustering", "name": "cluster", "config": {}},
             {"step_type": "labeling", "name": "label", "config": {"rules": rule}}]
    handlers = {"structuring": lambda df, c: fill_nulls(df, c["null_strategy"]),
                "labeling": lambda df, c: R.apply_rules(df, R.load_rules(c["rules"]))}
    out, report = flows.run_steps(load(spark, sf, "dirty_orders").select("o_orderkey", "o_totalprice"), steps, handlers)
    states = [r[2] for r in report]
    labelled = out.agg(F.lit("labelled").alias("fact"), F.count(R.LABEL).alias("n"))
    steps_done = [out.limit(1).select(F.lit(f"{s} steps").alias("fact"), F.lit(states.count(s)).cast("long").alias("n"))
                  for s in ("completed", "skipped")]
    return labelled.unionAll(steps_done[0]).unionAll(steps_done[1])


