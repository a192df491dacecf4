"""Rule labelling on orders with defects."""

from pyspark.sql import functions as F

from quillwork.operators import rules as R

from .base import load, register

THREE = [
    {"label": "high_value", "column": "o_totalprice", "operator": "greater_than", "value": 200000, "priority": 1},
    {"label": "urgent", "column": "o_orderpriority", "operator": "in_list", "value": "1-URGENT,2-HIGH", "priority": 5},
    {"label": "closed", "priority": 5, "logic": "and", "conditions": [
        {"column": "o_orderstatus", "operator": "equals", "value": "F"},
        {"column": "o_orderpriority", "operator": "not_contains", "value": "LOW"}]},
]
# The three tests in SQL, in rule order.
HIGH = "coalesce(o_totalprice > 200000, false)"
URGENT = "coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH'), false)"
CLOSED = "(o_orderstatus = 'F' AND coalesce(NOT contains(o_orderpriority, 'LOW'), false))"


def single(name: str, tests: list[tuple[str, str, str, object, str]]):
    """A query that labels each order with every test that holds: (label, column, operator, value, SQL)."""
    definitions = [{"label": t[0], "column": t[1], "operator": t[2], "value": t[3]} for t in tests]
    cases = ", ".join(f"CASE WHEN {t[4]} THEN '{t[0]}' END" for t in tests)

    @register(name, f"SELECT o_orderkey, nullif(concat_ws(',', {cases}), '') AS label FROM dirty_orders")
    def run(spark, sf):
        rules = R.load_rules(definitions, "all")
        out = R.apply_rules(load(spark, sf, "dirty_orders"), rules)
        return out.select("o_orderkey", F.col(R.LABEL).alias("label"))


single("rul_equals", [("text", "code", "equals", 7, "code = '7'"), ("padded", "code", "equals", "007", "code = '007'"),
                      ("number", "o_custkey", "equals", "7", "o_custkey = 7"),
                      ("status", "o_orderstatus", "equals", "F", "o_orderstatus = 'F'")])
single("rul_not_equals", [("priority", "o_orderpriority", "not_equals", "5-LOW", "o_orderpriority <> '5-LOW'"),
                          ("number", "o_custkey", "not_equals", 7.0, "o_custkey <> 7")])
single("rul_contains", [("urgent", "o_orderpriority", "contains", "URG", "contains(o_orderpriority, 'URG')"),
                        ("digit", "o_custkey", "contains", "9", "contains(CAST(o_custkey AS VARCHAR), '9')")])
single("rul_not_contains", [("calm", "o_orderpriority", "not_contains", "URG", "NOT contains(o_orderpriority, 'URG')")])
single("rul_starts_with", [("one", "o_orderpriority", "starts_with", "1-", "starts_with(o_orderpriority, '1-')")])
single("rul_ends_with", [("low", "o_orderpriority", "ends_with", "LOW", "ends_with(o_orderpriority, 'LOW')")])
single("rul_gt", [("price", "o_totalprice", "greater_than", "250000", "o_totalprice > 250000"),
                  ("code", "code", "greater_than", 20, "NOT starts_with(code, '0') AND TRY_CAST(code AS DOUBLE) > 20")])
single("rul_lt", [("price", "o_totalprice", "less_than", 50000, "o_totalprice < 50000")])
single("rul_ge", [("key", "o_custkey", "greater_equal", 100, "o_custkey >= 100")])
single("rul_le", [("key", "o_custkey", "less_equal", "10", "o_custkey <= 10")])
single("rul_between", [("list", "o_totalprice", "between", [200000, 100000], "o_totalprice BETWEEN 100000 AND 200000"),
                       ("comma", "o_custkey", "between", "5,10", "o_custkey BETWEEN 5 AND 10"),
                       ("dash", "o_custkey", "between", "20 - 30", "o_custkey BETWEEN 20 AND 30")])
single("rul_regex", [("level", "o_orderpriority", "regex_match", "^[12]-", "regexp_matches(o_orderpriority, '^[12]-')"),
                     ("broken", "o_orderpriority", "regex_match", "([", "false")])
single("rul_in_list", [("text", "o_orderpriority", "in_list", "1-URGENT, 2-HIGH",
                        "o_orderpriority IN ('1-URGENT', '2-HIGH')"),
                       ("number", "o_custkey", "in_list", ["5", "7.0", 9], "o_custkey IN (5, 7, 9)")])
single("rul_is_null", [("price", "o_totalprice", "is_null", None, "o_totalprice IS NULL"),
                       ("priority", "o_orderpriority", "is_null", None, "o_orderpriority IS NULL")])
single("rul_is_not_null", [("both", "o_totalprice", "is_not_null", None, "o_totalprice IS NOT NULL")])


@register("rul_logic", f"""
    SELECT o_orderkey, CASE WHEN {CLOSED} THEN 'both' WHEN {HIGH} OR {URGENT} THEN 'either' END AS label
    FROM dirty_orders""")
def rul_logic(spark, sf):
    rules = R.load_rules([
        {"label": "both", "conditions": THREE[2]["conditions"]},
        {"label": "never", "conditions": [{"column": "absent", "operator": "is_null"},
                                          {"column": "o_custkey", "operator": "is_not_null"}]},
        {"label": "either", "logic": "or", "conditions": [
            {k: THREE[i][k] for k in ("column", "operator", "value")} for i in (0, 1)]}])
    out = R.apply_rules(load(spark, sf, "dirty_orders"), rules)
    return out.select("o_orderkey", F.col(R.LABEL).alias("label"))


def _labelled(spark, sf, strategy):
    out = R.apply_rules(load(spark, sf, "dirty_orders"), R.load_rules(THREE, strategy))
    return out.select("o_orderkey", F.col(R.LABEL).alias("label"))


@register("rul_first_match", f"""
    SELECT o_orderkey, CASE WHEN {HIGH} THEN 'high_value' WHEN {URGENT} THEN 'urgent' WHEN {CLOSED} THEN 'closed' END
           AS label FROM dirty_orders""")
def rul_first_match(spark, sf):
    return _labelled(spark, sf, "first_match")


@register("rul_highest_priority", f"""
    SELECT o_orderkey, CASE WHEN {URGENT} THEN 'urgent' WHEN {CLOSED} THEN 'closed' WHEN {HIGH} THEN 'high_value' END
           AS label FROM dirty_orders""")
def rul_highest_priority(spark, sf):
    return _labelled(spark, sf, "highest_priority")


@register("rul_all", f"""
    SELECT o_orderkey, nullif(concat_ws(',', CASE WHEN {HIGH} THEN 'high_value' END,
           CASE WHEN {URGENT} THEN 'urgent' END, CASE WHEN {CLOSED} THEN 'closed' END), '') AS label
    FROM dirty_orders""")
def rul_all(spark, sf):
    return _labelled(spark, sf, "all")


@register("rul_report", f"""
    WITH m AS (SELECT {HIGH} AS a, {URGENT} AS b, {CLOSED} AS c FROM dirty_orders)
    SELECT 'summary' AS section, 'total_rows' AS name, count(*) AS count FROM m
    UNION ALL SELECT 'summary', 'labeled', count(*) FROM m WHERE a OR b OR c
    UNION ALL SELECT 'summary', 'unlabeled', count(*) FROM m WHERE NOT (a OR b OR c)
    UNION ALL SELECT 'summary', 'conflicts', count(*) FROM m WHERE a::INT + b::INT + c::INT > 1
    UNION ALL SELECT 'summary', 'rules_applied', 3
    UNION ALL SELECT 'rule', '0:high_value', count(*) FROM m WHERE a
    UNION ALL SELECT 'rule', '1:urgent', count(*) FROM m WHERE b
    UNION ALL SELECT 'rule', '2:closed', count(*) FROM m WHERE c
    UNION ALL SELECT 'label', 'high_value', count(*) FROM m WHERE a
    UNION ALL SELECT 'label', 'urgent', count(*) FROM m WHERE b
    UNION ALL SELECT 'label', 'closed', count(*) FROM m WHERE c""")
def rul_report(spark, sf):
    return R.rule_report(load(spark, sf, "dirty_orders"), R.load_rules(THREE, "all"))


@register("rul_apply", f"""
    SELECT *, CASE WHEN {HIGH} THEN 'high_value' WHEN {URGENT} THEN 'urgent' WHEN {CLOSED} THEN 'closed' END
           AS label FROM dirty_orders""")
def rul_apply(spark, sf):
    return R.apply_rules(load(spark, sf, "dirty_orders"), R.load_rules(THREE), "label")


@register("rul_distribution", f"""
    SELECT label, count(*) AS count FROM (
        SELECT CASE WHEN {HIGH} THEN 'high_value' WHEN {URGENT} THEN 'urgent' WHEN {CLOSED} THEN 'closed' END AS label
        FROM dirty_orders) l WHERE label IS NOT NULL GROUP BY label""")
def rul_distribution(spark, sf):
    return R.label_distribution(R.apply_rules(load(spark, sf, "dirty_orders"), R.load_rules(THREE)))


@register("rul_predictions", f"""
    SELECT CAST(o_orderkey AS VARCHAR) AS item_id,
           CASE WHEN {HIGH} THEN 'high_value' WHEN {URGENT} THEN 'urgent' ELSE 'closed' END AS label,
           CAST(1 AS DOUBLE) AS confidence
    FROM dirty_orders WHERE {HIGH} OR {URGENT} OR {CLOSED}""")
def rul_predictions(spark, sf):
    return R.predictions(R.apply_rules(load(spark, sf, "dirty_orders"), R.load_rules(THREE)), "o_orderkey")


@register("rul_preview", f"""
    WITH head AS (SELECT * FROM dirty_orders ORDER BY o_orderkey LIMIT 1000),
    f AS (SELECT o_orderkey AS k, 0 AS rule, 'high_value' AS label, {HIGH} AS hit FROM head
          UNION ALL SELECT o_orderkey, 1, 'urgent', {URGENT} FROM head
          UNION ALL SELECT o_orderkey, 2, 'closed', {CLOSED} FROM head)
    SELECT rule, label, count(*) FILTER (hit) AS matches, count(*) FILTER (hit) / CAST(count(*) AS DOUBLE) AS coverage,
           array_to_string(list_slice(list_sort(list(k) FILTER (hit)), 1, 5), ',') AS samples
    FROM f GROUP BY rule, label""")
def rul_preview(spark, sf):
    return R.preview(load(spark, sf, "dirty_orders"), R.load_rules(THREE), "o_orderkey", 1000, 5)
