import pytest
from pyspark.sql import functions as F

from quillwork.operators import rules as R


def labels(spark, rows, schema, definitions, strategy="first_match"):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    out = R.apply_rules(df, R.load_rules(definitions, strategy)).orderBy("i")
    return [r[R.LABEL] for r in out.collect()]


def one(column, operator, value=None):
    return [{"label": "L", "column": column, "operator": operator, "value": value}]


@pytest.mark.parametrize("definition,expected", [
    (one("x", "equals", 2), [None, "L", None]), (one("x", "not_equals", "2"), ["L", None, "L"]),
    (one("x", "greater_than", 1), [None, "L", "L"]), (one("x", "less_equal", "2"), ["L", "L", None]),
    (one("x", "between", "3 - 2"), [None, "L", "L"]), (one("x", "between", "-5 - 1"), ["L", None, None]),
    (one("x", "between", [2]), [None, None, None]), (one("x", "in_list", ["1", "3.0"]), ["L", None, "L"]),
    (one("x", "in_list", "1,2"), ["L", "L", None]), (one("x", "in_list", 5), [None, None, None]),
    (one("x", "greater_than", "abc"), [None, None, None]), (one("y", "equals", 1), [None, None, None])])
def test_numbers(spark, definition, expected):
    assert labels(spark, [(1,), (2,), (3,)], "x int", definition) == expected


@pytest.mark.parametrize("definition,expected", [
    (one("s", "contains", "an"), [None, "L", None]), (one("s", "not_contains", "an"), ["L", None, None]),
    (one("s", "starts_with", "app"), ["L", None, None]), (one("s", "ends_with", "na"), [None, "L", None]),
    (one("s", "regex_match", "^(app|ban)"), ["L", "L", None]), (one("s", "regex_match", "(?P<a>p)(?P=a)"), ["L", None, None]),
    (one("s", "regex_match", "(["), [None, None, None]), (one("s", "is_null"), [None, None, "L"]),
    (one("s", "is_not_null"), ["L", "L", None]), (one("s", "not_equals", "apple"), [None, "L", None])])
def test_texts(spark, definition, expected):
    assert labels(spark, [("apple",), ("banana",), (None,)], "s string", definition) == expected


def test_text_codes_are_not_numbers(spark):
    rows = [("007",), ("008",), ("9",), ("inf",), (" 12 ",), ("true",)]
    assert labels(spark, rows, "code string", one("code", "equals", 7)) == [None] * 6
    assert labels(spark, rows, "code string", one("code", "greater_than", 1)) == [None, None, "L", None, "L", None]


def test_nan_never_matches(spark):
    rows = [(float("nan"),), (2.0,), (None,)]
    assert labels(spark, rows, "x double", one("x", "greater_than", 1)) == [None, "L", None]
    assert labels(spark, rows, "x double", one("x", "is_null")) == ["L", None, "L"]
    assert labels(spark, rows, "x double", one("x", "not_equals", 5)) == [None, "L", None]


def test_booleans_are_text(spark):
    assert labels(spark, [(True,), (False,)], "b boolean", one("b", "greater_than", 0)) == [None, None]
    assert labels(spark, [(True,), (False,)], "b boolean", one("b", "equals", "true")) == ["L", None]


def test_logic(spark):
    rows = [(1, 10), (1, 20), (2, 20)]
    both = [{"column": "a", "operator": "equals", "value": 1}, {"column": "b", "operator": "equals", "value": 20}]
    assert labels(spark, rows, "a int, b int", [{"label": "L", "conditions": both}]) == [None, "L", None]
    assert labels(spark, rows, "a int, b int", [{"label": "L", "logic": "or", "conditions": both}]) == ["L", "L", "L"]


def test_conflicts(spark):
    two = [{"label": "A", "column": "x", "operator": "equals", "value": 1, "priority": 1},
           {"label": "B", "column": "x", "operator": "equals", "value": 1, "priority": 5}]
    assert labels(spark, [(1,)], "x int", two) == ["A"]
    assert labels(spark, [(1,)], "x int", two, "highest_priority") == ["B"]
    assert labels(spark, [(1,)], "x int", two, "all") == ["A,B"]
    assert labels(spark, [(1,)], "x int", []) == [None]
    tie = [dict(t, priority=3) for t in two]
    assert labels(spark, [(1,)], "x int", tie, "highest_priority") == ["A"]


def test_report_counts(spark):
    df = spark.range(10)
    rules = R.load_rules([{"label": "a", "column": "id", "operator": "less_than", "value": 4},
                          {"label": "b", "column": "id", "operator": "less_than", "value": 2}], "all")
    got = {(r["section"], r["name"]): r["count"] for r in R.rule_report(df, rules).collect()}
    assert got[("summary", "labeled")] == 4 and got[("summary", "conflicts")] == 2
    assert got[("rule", "1:b")] == 2 and got[("label", "a")] == 4 and got[("label", "b")] == 2
    assert R.rule_warnings(df, R.load_rules(one("zz", "is_null")))


@pytest.mark.parametrize("bad", [[{"label": "x", "column": "a", "operator": "almost"}], [{"label": "x", "conditions": []}],
                                 [{"label": "x", "logic": "xor", "column": "a", "operator": "is_null"}], [{"label": "x"}]])
def test_bad_rules(bad):
    with pytest.raises(ValueError):
        R.load_rules(bad)
    with pytest.raises(ValueError):
        R.load_rules([], "coin_toss")


def test_rules_stay_in_one_projection(spark):
    out = R.apply_rules(spark.range(5), R.load_rules(one("id", "greater_than", 1)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_predictions_find_the_id(spark):
    df = R.apply_rules(spark.range(3), R.load_rules(one("id", "greater_than", 0)))
    assert sorted(r["item_id"] for r in R.predictions(df).collect()) == ["1", "2"]
    keyless = R.predictions(df.select(F.col("id").alias("k"), R.LABEL))
    assert keyless.select("item_id").distinct().count() == 2
