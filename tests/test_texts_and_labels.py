import csv
import json

import pytest
from pyspark.sql import functions as F

from quillwork.sinks import pieces as P
from quillwork.operators import documents as D
from quillwork.operators import label_quality as LQ
from quillwork.operators import labels as L
from quillwork.operators import review as R
from quillwork.operators import scoring as S
from quillwork.operators import vectors as V

EVENTS = "item_id string, source_type string, label string, confidence double, seq long"


def events(spark, *rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], EVENTS)


def winner(spark, strategy, *rows):
    r = L.aggregate(events(spark, *rows), strategy).first()
    return r["final_label"], r["confidence"]


def test_strategies(spark):
    two = (("i", "ai", "cat", 0.6), ("i", "rule", "dog", 0.9))
    assert winner(spark, "confidence_weighted", *two) == ("dog", 0.6)
    assert winner(spark, "majority_vote", *two, ("i", "ai", "cat", 0.1)) == ("cat", round(2 / 3, 4))
    assert winner(spark, "majority_vote", *two) == ("dog", 0.5)
    assert winner(spark, "priority", *two, ("i", "manual", "emu", 0.2), ("i", "robot", "ant", 1.0)) == ("emu", 0.2)
    assert winner(spark, "confidence_weighted", ("i", "ai", "b", 0.5), ("i", "ai", "a", 0.5))[0] == "b"
    assert winner(spark, "confidence_weighted", ("i", "ai", "b", 0.0)) == ("b", 0.0)
    with pytest.raises(ValueError):
        L.aggregate(events(spark, *two), "dice")


def test_aggregate_report(spark):
    df = events(spark, ("a", "ai", "x", 1.0), ("a", "ai", "y", 1.0), ("b", "ai", "x", 1.0), ("c", "ai", "", 1.0))
    assert tuple(L.aggregate_report(df).first()) == (3, 2, 1, 1, 1)


def test_active_learning(spark):
    df = events(spark, ("sure", "ai", "a", .99), ("sure", "rule", "a", .98), ("unsure", "ai", "a", .5), ("unsure", "rule", "b", .5),
                ("blank", "ai", "", .5))
    rows = L.active_learning(df).collect()
    assert [r["item_id"] for r in rows] == ["blank", "unsure", "sure"]
    assert rows[0]["uncertainty"] == 1.0 and rows[1]["conflicting"] == ["a", "b"] and rows[2]["conflicting"] == []


def test_label_quality(spark):
    df = spark.createDataFrame([("1", "a", 1.0), ("2", "a", 0.5), ("3", "b", 0.9)], "item_id string, label string, confidence double")
    assert tuple(LQ.coverage(df, 4).first()) == (3, 4, 75.0)
    assert LQ.completeness(df, ["a", "c"]).first()["missing"] == ["c"]
    assert LQ.balance(df.filter("label = 'a'")).first()["score"] == 100.0
    nothing = LQ.summary(LQ.evaluate(df.limit(0), 0)).first()
    assert (nothing["overall"], nothing["grade"]) == (0.0, "F")
    full = LQ.evaluate(df, 4, ["a", "b"])
    assert full.count() == 5 and LQ.summary(full).first()["grade"] in "ABCDF"


def test_review_sequence(spark):
    predictions = spark.createDataFrame([("1", "a", .5), ("2", "b", .5), ("3", "c", .5)], "item_id string, label string, confidence double")
    actions = spark.createDataFrame([("1", "relabel", "x", 1), ("1", "relabel", "y", 2), ("1", "approve", None, 3), ("2", "reject", None, 4),
                                     ("9", "approve", None, 5)], "item_id string, action string, new_label string, seq int")
    got = {r["item_id"]: tuple(r)[1:] for r in R.apply_actions(predictions, actions).collect()}
    assert got == {"1": ("y", .5, "approved", "x"), "2": ("b", .5, "rejected", None), "3": ("c", .5, "", None)}
    assert tuple(R.action_counts(predictions, actions).first()) == (1, 1, 2, 1)


def test_responses(spark):
    texts = ['{"label": "Cat", "confidence": 0.5, "reasoning": "r"}', '```json\n{"label":"dog","confidence":"1.7"}\n```',
             '{"label": "emu", "confidence": 1}', '{"label": "cat", ', "cat", '{"label": "cat", "confidence": "high"}', None, '{"confidence": -1}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(S.parse_response(F.col("t"), ["cat", "dog"])).collect()]
    bad = (None, 0.0, "Parse error")
    assert got == [("Cat", .5, "r"), ("dog", 1.0, ""), (None, 1.0, ""), bad, bad, bad, bad, (None, 0.0, "")]


def test_failing_items_become_rows(spark):
    def factory():
        def score(items, labels):
            if any("boom" in i for i in items):
                raise RuntimeError("no")
            return [(labels[0], 0.5, "fine") for _ in items]
        return score
    df = spark.createDataFrame([("a",), ("boom",), ("c",)], "t string").coalesce(1)
    got = {r["t"]: r["predicted_label"] for r in S.classify(df, "t", ["x"], factory).collect()}
    assert got == {"a": "x", "boom": "", "c": "x"}
    assert tuple(S.scoring_report(S.classify(df, "t", ["x"], factory)).first()) == (3, 2, round(1 / 3, 4))


def test_splitting(spark):
    text = "\r\n\r\n one \r\ntwo\n \n\nthree\r\rfour\x00\n"
    df = spark.createDataFrame([(1, text), (2, "  \n "), (3, "a\n\nb")], "id int, t string")

    def split(strategy, i):
        return [r["piece"] for r in D.pieces(df, "t", strategy).filter(f"id = {i}").orderBy("position").collect()]

    assert split("blank_line", 1) == ["one \ntwo", "three", "four"] and split("auto", 1) == split("blank_line", 1)
    assert split("line", 1) == ["one", "two", "three", "four"] and split("file", 2) == [] and split("auto", 3) == ["a\n\nb"]
    built = D.build_documents(df.select(F.col("id").alias("file_no"), F.lit("f").alias("name"), F.col("t").alias("content")), "auto", 7)
    assert [(r["doc_index"], r["name"]) for r in built.orderBy("doc_index").collect()] == [
        (7, "f · 1"), (8, "f · 2"), (9, "f · 3"), (10, "f")]


def test_offsets_count_code_points(spark):
    docs = spark.createDataFrame([(1, "a😀bcd", 0, "n")], "doc_id int, content string, doc_index int, name string")
    spans = spark.createDataFrame([(1, "A", "span", 1, 3, 1), (1, "B", "span", 3, 9, 2), (1, "C", "doc", None, None, 3), (1, "Z", "doc", 0, 1, 4)],
                                  "doc_id int, class_name string, kind string, start_offset long, end_offset long, seq int")
    assert D.snippets(spans.filter("seq = 1"), docs).first()["snippet"] == "😀b"
    classes = spark.createDataFrame([("A",), ("B",), ("C",)], "name string")
    reasons = {r["class_name"]: r["reason"] for r in D.validate_annotations(spans, docs, classes).collect()}
    assert reasons == {"A": None, "B": "bad offsets", "C": None, "Z": "foreign class"}
    def record(pieces):
        return "".join(r["line"] for r in P.in_order(pieces, "doc_index").collect())

    assert json.loads(record(D.export_jsonl(docs, spans.filter("seq < 4")))) == {
        "name": "n", "text": "a😀bcd", "labels": ["C"], "spans": [{"start": 1, "end": 3, "label": "A"}, {"start": 3, "end": 9, "label": "B"}]}
    assert json.loads(record(D.export_spans(docs, spans.filter("seq < 3"))))["entities"] == [[1, 3, "A"], [3, 9, "B"]]
    fields = next(csv.reader([record(D.export_csv(docs, spans))]))
    assert fields[:3] == ["n", "a😀bcd", "C|Z"] and len(json.loads(fields[3])) == 2


def test_search_takes_wildcards_literally(spark):
    docs = spark.createDataFrame([("a%b", "x"), ("ab", "A%B")], "name string, content string")
    assert D.search(docs, "A%b").count() == 2 and D.search(docs, "a_b").count() == 0


def test_svd_matches_a_direct_one(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    words = [f"w{i:02d}" for i in range(30)]
    docs = [(i, " ".join(rng.choice(words[(i % 3) * 10:(i % 3) * 10 + 12 if i % 3 < 2 else 30], 25))) for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id int, text string")
    weights = V.tfidf(df, "doc_id", "text")
    rows = weights.collect()
    terms = sorted({r["term"] for r in rows})
    x = np.zeros((40, len(terms)))
    for r in rows:
        x[r["doc_id"], terms.index(r["term"])] = r["weight"]
    assert np.allclose(np.linalg.norm(x, axis=1), 1)
    vectors, values = V.svd(weights, 5, passes=12)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:5], rtol=1e-4)
    got = np.array([r["vector"] for r in vectors.orderBy("doc_id").collect()])
    assert np.allclose(np.abs(got[:, :3]), np.abs(x @ vt[:3].T), atol=1e-3)


def test_kmeans_edges(spark):
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "a double, b double")
    out, facts = V.kmeans(same, 3)
    assert facts["n_clusters"] == 0 and V.cluster_summary(out).first()["unclustered"] == 5
    two = spark.createDataFrame([(0.0, None)] * 5 + [(10.0, 1.0)] * 5, "a double, b double")
    out, facts = V.kmeans(two, 5)
    assert facts["n_clusters"] == 2 and facts["inertia"] == pytest.approx(0) and V.silhouette(out) == pytest.approx(1)
    assert sorted(r["size"] for r in V.cluster_sizes(out).collect()) == [5, 5]


def test_encoders_get_few_items_at_once(spark):
    from quillwork.operators import vectors as V

    def encoder():
        def encode(items):
            if any(i == "t13" for i in items):
                raise ValueError("cannot be read")
            return [[float(len(items)), 1.0] for _ in items]
        return encode

    df = spark.range(2000, numPartitions=1).selectExpr("id", "if(id % 50 = 0, null, concat('t', id)) as t")
    rows = V.embed(df, "id", "t", encoder, 1).collect()
    assert sorted(r["item_id"] for r in rows) == [i for i in range(2000) if i % 50 and i != 13]
    assert max(r["vector"][0] / r["vector"][1] for r in rows) <= V.ENCODED + 0.01


def test_texts_travel_and_their_terms_do_not(spark):
    from quillwork.operators import vectors as V

    df = spark.createDataFrame([(1, "red red fish"), (1, "fish pond"), (2, None), (None, "red")], "d long, t string")
    counts = V.term_counts(df, "d", "t")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "_text" in plan
    assert sorted(map(tuple, counts.collect()), key=str) == sorted([(1, "red", 2), (1, "fish", 2), (1, "pond", 1), (None, "red", 1)], key=str)
