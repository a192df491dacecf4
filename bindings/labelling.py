"""Label merging, label quality, review and model scoring."""

from pyspark.sql import functions as F

from quillwork.operators import label_quality as Q
from quillwork.operators import labels as L
from quillwork.operators import review as R
from quillwork.operators import scoring as S

from .base import INPUTS, load, register

# Run results in the layouts that occur, one or two predictions each.
INPUTS["run_results"] = """
    SELECT event_id AS run_id, event_id AS completed_at, user_id AS dataset_id,
           CASE event_id % 4 WHEN 0 THEN 'labeling' WHEN 1 THEN 'ai_labeling' WHEN 2 THEN 'aggregation'
                ELSE 'propagation' END AS run_type,
           CASE event_id % 4
             WHEN 0 THEN concat('{{"labeling":{{"predictions":[{{"item_id":"', CAST(event_id % 997 AS STRING), '","label":"',
                event_type, '","confidence":1.0}},{{"item_id":"","label":"x"}}]}}}}')
             WHEN 1 THEN concat('{{"ai_labeling":{{"predictions":[{{"text":"', CAST(event_id % 997 AS STRING),
                '","item_id":"other","predicted_label":"', event_type, '","confidence":0.', CAST(event_id % 9 AS STRING), '}}]}}}}')
             WHEN 2 THEN concat('{{"aggregation":{{"results":[]}},"results":[{{"item_id":"', CAST(event_id % 997 AS STRING),
                '","final_label":"', event_type, '","label":"old","confidence":0.5,"review_status":"approved"}}]}}')
             ELSE concat('{{"propagation":{{"results":[{{"item_id":"', CAST(event_id % 997 AS STRING),
                '","propagated_label":"', event_type, '"}}]}}}}') END AS result
    FROM {events}"""
INPUTS["entries"] = """
    SELECT run_id, completed_at, CAST(run_id % 997 AS STRING) AS item_id,
           CASE run_id % 4 WHEN 0 THEN 'rule' WHEN 1 THEN 'ai' WHEN 2 THEN 'aggregation' ELSE 'propagation' END AS source,
           CASE run_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN (run_id % 9) / CAST(10 AS DOUBLE) WHEN 2 THEN 0.5
                ELSE 0.0 END AS confidence,
           CASE WHEN run_id % 4 = 2 THEN 'approved' ELSE '' END AS review_status, label
    FROM (SELECT event_id AS run_id, event_id AS completed_at, event_type AS label FROM {events}) e"""
INPUTS["predictions"] = """
    SELECT CAST(user_id AS STRING) AS item_id, max(event_type) AS label, CAST(0.5 AS DOUBLE) AS confidence
    FROM {events} WHERE user_id % 3 <> 0 GROUP BY user_id"""


def events(spark, sf):
    return load(spark, sf, "label_events")


@register("lbl_normalize", """SELECT run_id, item_id, label, CAST(confidence AS DOUBLE) AS confidence, source, review_status
    FROM entries""")
def lbl_normalize(spark, sf):
    out = L.normalize_results(load(spark, sf, "run_results"), keep=["run_id"])
    return out.select("run_id", "item_id", "label", "confidence", "source", "review_status")


PER_LABEL = """
    l AS (SELECT item_id, label, count(*) AS votes, round(sum(confidence), 9) AS weight, max(confidence) AS best,
                 min(seq) AS first_seq FROM label_events WHERE label <> '' GROUP BY item_id, label)"""


@register("lbl_confidence", f"""WITH {PER_LABEL},
    w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY weight DESC, first_seq) AS r,
                 sum(weight) OVER (PARTITION BY item_id) AS total FROM l)
    SELECT item_id, label AS final_label, CASE WHEN total > 0 THEN round(weight / total, 4) ELSE 0 END AS confidence
    FROM w WHERE r = 1""")
def lbl_confidence(spark, sf):
    return L.aggregate(events(spark, sf)).select("item_id", "final_label", "confidence")


@register("lbl_majority", f"""WITH {PER_LABEL},
    w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, best DESC, first_seq) AS r,
                 sum(votes) OVER (PARTITION BY item_id) AS total FROM l)
    SELECT item_id, label AS final_label, round(votes / total, 4) AS confidence FROM w WHERE r = 1""")
def lbl_majority(spark, sf):
    return L.aggregate(events(spark, sf), "majority_vote").select("item_id", "final_label", "confidence")


@register("lbl_priority", """
    SELECT item_id, label AS final_label, round(confidence, 4) AS confidence FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE source_type WHEN 'manual' THEN 0 WHEN 'rule' THEN 1
             WHEN 'ai' THEN 2 WHEN 'propagation' THEN 3 ELSE 99 END, seq) AS r
      FROM label_events WHERE label <> '') x WHERE r = 1""")
def lbl_priority(spark, sf):
    return L.aggregate(events(spark, sf), "priority").select("item_id", "final_label", "confidence")


AGGREGATED = f"""WITH {PER_LABEL},
    w AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, best DESC, first_seq) AS r,
                 CAST(sum(votes) OVER (PARTITION BY item_id) AS BIGINT) AS sources,
                 count(*) OVER (PARTITION BY item_id) AS labels FROM l)"""


@register("lbl_aggregate", AGGREGATED + """SELECT item_id, label AS final_label, round(votes / sources, 4) AS confidence,
    round(votes / sources, 4) AS agreement, sources, labels FROM w WHERE r = 1""")
def lbl_aggregate(spark, sf):
    return L.aggregate(events(spark, sf), "majority_vote")


@register("lbl_aggregate_report", """
    WITH i AS (SELECT item_id, count(*) FILTER (label <> '') AS n, count(DISTINCT nullif(label, '')) AS d
               FROM label_events GROUP BY item_id)
    SELECT count(*) AS total_items, count(*) FILTER (n > 0) AS labeled, count(*) FILTER (n > 1) AS multi_source,
           count(*) FILTER (n = 1) AS single_source, count(*) FILTER (d > 1) AS conflicts FROM i""")
def lbl_aggregate_report(spark, sf):
    return L.aggregate_report(events(spark, sf))


@register("lbl_distribution", AGGREGATED + "SELECT label, count(*) AS count FROM w WHERE r = 1 GROUP BY label")
def lbl_distribution(spark, sf):
    return L.label_distribution(L.aggregate(events(spark, sf), "majority_vote"))


@register("lbl_active_learning", f"""WITH {PER_LABEL},
    t AS (SELECT item_id, sum(votes) AS n, max(votes) AS m, sum(weight) AS w, list_sort(list(label)) AS labels
          FROM l GROUP BY item_id),
    i AS (SELECT DISTINCT item_id FROM label_events)
    SELECT item_id, round(coalesce(0.5 * (1 - m / n) + 0.5 * (1 - w / n), 1), 4) AS uncertainty,
           CASE WHEN len(labels) > 1 THEN array_to_string(labels, ',') ELSE '' END AS conflicting
    FROM i LEFT JOIN t USING (item_id) ORDER BY uncertainty DESC, item_id LIMIT 50""")
def lbl_active_learning(spark, sf):
    return L.active_learning(events(spark, sf), 50).withColumn("conflicting", F.array_join("conflicting", ","))


@register("lbl_unlabeled", """SELECT vec_id FROM embeddings WHERE CAST(vec_id AS VARCHAR) NOT IN
    (SELECT item_id FROM label_events WHERE label <> '')""")
def lbl_unlabeled(spark, sf):
    labeled = L.valid_events(events(spark, sf)).select(F.col("item_id").cast("long").alias("item_id"))
    return L.unlabeled(load(spark, sf, "embeddings"), labeled, "vec_id")


# ---- label quality ------------------------------------------------------------------------------

def entries(spark, sf):
    return L.valid_events(events(spark, sf))


EXPECTED = ["click", "view", "purchase", "refund"]
VALID = "v AS (SELECT * FROM label_events WHERE label <> '')"
SCORES = {
    "coverage": """SELECT count(DISTINCT item_id) AS labeled, greatest(count(DISTINCT item_id), 997) AS total,
        round(count(DISTINCT item_id) / greatest(count(DISTINCT item_id), 997) * 100, 2) AS score FROM v""",
    "balance": """SELECT count(*) AS classes, round(-sum(n / t * ln(n / t)), 4) AS entropy,
        round(-sum(n / t * ln(n / t)) / ln(count(*)) * 100, 2) AS score
        FROM (SELECT label, count(*) AS n, sum(count(*)) OVER () AS t FROM v GROUP BY label) c""",
    "confidence": """SELECT round(avg(confidence), 4) AS mean, round(min(confidence), 4) AS low,
        round(max(confidence), 4) AS high, count(*) AS n, round(least(avg(confidence) * 100, 100), 2) AS score FROM v""",
    "consistency": """SELECT count(*) AS multi_source, count(*) FILTER (d = 1) AS agreeing,
        CASE WHEN count(*) = 0 THEN 100 ELSE round(count(*) FILTER (d = 1) / count(*) * 100, 2) END AS score
        FROM (SELECT count(*) AS n, count(DISTINCT label) AS d FROM v GROUP BY item_id HAVING count(*) > 1) m""",
    "completeness": """SELECT count(*) FILTER (k IN (SELECT label FROM v)) AS found, CAST(count(*) AS INT) AS expected,
        coalesce(string_agg(k, ',' ORDER BY k) FILTER (k NOT IN (SELECT label FROM v)), '') AS missing,
        round(count(*) FILTER (k IN (SELECT label FROM v)) / count(*) * 100, 2) AS score
        FROM (VALUES ('click'), ('view'), ('purchase'), ('refund')) e(k)""",
}


@register("lbq_coverage", f"WITH {VALID} {SCORES['coverage']}")
def lbq_coverage(spark, sf):
    return Q.coverage(entries(spark, sf), 997)


@register("lbq_balance", f"WITH {VALID} {SCORES['balance']}")
def lbq_balance(spark, sf):
    return Q.balance(entries(spark, sf))


@register("lbq_confidence", f"WITH {VALID} {SCORES['confidence']}")
def lbq_confidence(spark, sf):
    return Q.confidence(entries(spark, sf))


@register("lbq_consistency", f"WITH {VALID} {SCORES['consistency']}")
def lbq_consistency(spark, sf):
    return Q.consistency(entries(spark, sf))


@register("lbq_completeness", f"WITH {VALID} {SCORES['completeness']}")
def lbq_completeness(spark, sf):
    return Q.completeness(entries(spark, sf), EXPECTED).withColumn("missing", F.array_join("missing", ","))


DIMENSIONS = f"WITH {VALID}, d AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS dimension, score, CAST({Q.WEIGHTS[k]} AS DOUBLE) AS weight FROM ({s}) x" for k, s in SCORES.items()) + ")"


@register("lbq_evaluate", DIMENSIONS + "SELECT * FROM d")
def lbq_evaluate(spark, sf):
    return Q.evaluate(entries(spark, sf), 997, EXPECTED)


@register("lbq_summary", DIMENSIONS + """, o AS (SELECT sum(score * weight) / sum(weight) AS s FROM d)
    SELECT round(s, 2) AS overall, CASE WHEN s >= 90 THEN 'A' WHEN s >= 80 THEN 'B' WHEN s >= 70 THEN 'C'
           WHEN s >= 60 THEN 'D' ELSE 'F' END AS grade,
           (SELECT coalesce(string_agg(a, ';' ORDER BY a), '') FROM (SELECT CASE
              WHEN dimension = 'coverage' AND score < 80 THEN 'label more items'
              WHEN dimension = 'balance' AND score < 70 THEN 'collect more examples of rare labels'
              WHEN dimension = 'confidence' AND score < 70 THEN 'review labels of low confidence'
              WHEN dimension = 'consistency' AND score < 80 THEN 'resolve conflicting labels'
              WHEN dimension = 'completeness' AND score < 80 THEN 'label items of the missing classes' END AS a FROM d) z)
           AS advice FROM o""")
def lbq_summary(spark, sf):
    return Q.summary(Q.evaluate(entries(spark, sf), 997, EXPECTED)).withColumn("advice", F.array_join("advice", ";"))


# ---- review -------------------------------------------------------------------------------------

@register("rev_apply", """
    WITH a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS r FROM review_log),
    rl AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY seq DESC) AS r FROM review_log WHERE action = 'relabel')
    SELECT p.item_id, CASE WHEN r1.item_id IS NOT NULL THEN r1.new_label ELSE p.label END AS label, p.confidence,
           CASE a.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'relabel' THEN 'relabeled'
                ELSE '' END AS review_status,
           CASE WHEN r2.item_id IS NOT NULL THEN r2.new_label WHEN r1.item_id IS NOT NULL THEN p.label END AS original_label
    FROM predictions p LEFT JOIN a ON p.item_id = a.item_id AND a.r = 1
    LEFT JOIN rl r1 ON p.item_id = r1.item_id AND r1.r = 1 LEFT JOIN rl r2 ON p.item_id = r2.item_id AND r2.r = 2""")
def rev_apply(spark, sf):
    return R.apply_actions(load(spark, sf, "predictions"), load(spark, sf, "review_log"))


@register("rev_counts", """
    WITH j AS (SELECT l.action, p.item_id IS NOT NULL AS known FROM review_log l LEFT JOIN predictions p USING (item_id))
    SELECT count(*) FILTER (known AND action = 'approve') AS approved, count(*) FILTER (known AND action = 'reject') AS rejected,
           count(*) FILTER (known AND action = 'relabel') AS relabeled, count(*) FILTER (NOT known) AS not_found FROM j""")
def rev_counts(spark, sf):
    return R.action_counts(load(spark, sf, "predictions"), load(spark, sf, "review_log"))


@register("rev_status", """
    WITH a AS (SELECT item_id, arg_max(action, seq) AS action FROM review_log GROUP BY item_id)
    SELECT count(*) AS total_reviewed, count(*) FILTER (action = 'approve') AS approved,
           count(*) FILTER (action = 'reject') AS rejected, count(*) FILTER (action = 'relabel') AS relabeled FROM a""")
def rev_status(spark, sf):
    return R.status_counts(load(spark, sf, "review_log"))


@register("rev_export", """
    SELECT item_id, label, CAST(confidence AS DOUBLE) AS confidence, review_status FROM (
      SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY completed_at DESC) AS r FROM entries) x WHERE r = 1""")
def rev_export(spark, sf):
    return R.export_items(L.normalize_results(load(spark, sf, "run_results"), keep=["completed_at"]))


# ---- model scoring ------------------------------------------------------------------------------

LABELS = ["data", "water", "the", "und"]
HITS = "[x FOR x IN ['data', 'water', 'the', 'und'] IF contains(lower(text), x)]"
SCORED = f"""SELECT doc_id, coalesce({HITS}[1], '') AS predicted_label,
    CASE WHEN len({HITS}) > 0 THEN 1 / CAST(len({HITS}) AS DOUBLE) ELSE 0 END AS confidence,
    CASE WHEN len({HITS}) > 0 THEN 'named in the text' ELSE 'no label named' END AS reasoning FROM documents"""

INPUTS["responses"] = """
    SELECT doc_id, CASE doc_id % 7
        WHEN 0 THEN concat('{{"label": "', lang, '", "confidence": 0.9, "reasoning": "r', CAST(doc_id AS STRING), '"}}')
        WHEN 1 THEN concat('```json\n{{"label": "', upper(lang), '", "confidence": "0.25"}}\n```')
        WHEN 2 THEN '{{"label": "martian", "confidence": 0.8, "reasoning": "odd"}}'
        WHEN 3 THEN concat('{{"label": "', lang, '", "confidence": 1.7}}')
        WHEN 4 THEN concat('{{"label": "', lang, '", "confidence": ')
        WHEN 5 THEN '{{"confidence": -2}}'
        ELSE 'I think it is English' END AS content, lang
    FROM {documents}"""


@register("ail_prompt", """SELECT doc_id, md5('Choose exactly one label for the text. Labels: good, poor' || chr(10) || chr(10) ||
    'Instructions: judge style' || chr(10) || chr(10) || 'Examples:' || chr(10) || '- "abc" is "poor"' || chr(10) || chr(10) ||
    'Text:' || chr(10) || text || chr(10) || chr(10) || 'Answer in JSON with label, confidence and reasoning.') AS prompt
    FROM documents""")
def ail_prompt(spark, sf):
    text = S.prompt(F.col("text"), ["good", "poor"], " judge style ", [{"text": "abc", "label": "poor"}])
    return load(spark, sf, "documents").select("doc_id", F.md5(text).alias("prompt"))


@register("ail_classify", SCORED)
def ail_classify(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    return S.classify(docs, "text", LABELS).drop("text")


@register("ail_report", f"""SELECT count(*) AS total_items, count(*) FILTER (predicted_label <> '') AS labeled,
    round(avg(confidence), 4) AS avg_confidence FROM ({SCORED}) s""")
def ail_report(spark, sf):
    return S.scoring_report(ail_classify(spark, sf))


@register("ail_preview", SCORED + " WHERE text IS NOT NULL ORDER BY doc_id LIMIT 5")
def ail_preview(spark, sf):
    return S.preview(load(spark, sf, "documents").select("doc_id", "text"), "text", LABELS, "doc_id", 5).drop("text")


@register("ail_parse", """SELECT doc_id,
    CASE WHEN doc_id % 7 IN (0, 3) AND lang IN ('en', 'de', 'fr', 'es') THEN lang
         WHEN doc_id % 7 = 1 AND lang IN ('en', 'de', 'fr', 'es') THEN upper(lang) END AS label,
    CASE doc_id % 7 WHEN 0 THEN 0.9 WHEN 1 THEN 0.25 WHEN 2 THEN 0.8 WHEN 3 THEN 1 ELSE CAST(0 AS DOUBLE) END AS confidence,
    CASE doc_id % 7 WHEN 0 THEN 'r' || doc_id WHEN 2 THEN 'odd' WHEN 4 THEN 'Parse error' WHEN 6 THEN 'Parse error'
         ELSE '' END AS reasoning FROM responses""")
def ail_parse(spark, sf):
    out = load(spark, sf, "responses")
    return out.select("doc_id", S.parse_response(F.col("content"), ["en", "de", "fr", "es"]).alias("r")).select("doc_id", "r.*")
