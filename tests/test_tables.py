import pytest
from pyspark.sql import functions as F

from quillwork.operators import cleaning as C
from quillwork.operators import profile as P
from quillwork.operators import quality as Q
from quillwork.operators import schema as S

CUSTOMERS = [  # fifteen rows with one copy and three missing ages
    (1, "a@x.com", "2021-01-01", "US", 30.0, "pro", 10.0), (2, "b@x.com", "2021-01-02", "US", None, "free", 0.0),
    (3, "c@x.com", "2021-01-03", "DE", 41.0, "pro", 12.5), (1, "a@x.com", "2021-01-01", "US", 30.0, "pro", 10.0)]
SCHEMA = "id long, email string, since string, country string, age double, plan string, spend double"


def values(df, column):
    return [r[0] for r in df.select(f"`{column}`").collect()]


def test_dedup(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y"), (None, None), (None, None)], "a int, b string")
    assert C.deduplicate(df).count() == 3


def test_fill_mean_and_median(spark):
    df = spark.createDataFrame([(10.0,), (None,), (20.0,), (float("nan"),)], "n double")
    assert sorted(values(C.fill_nulls(df, "fill_mean"), "n")) == [10, 15, 15, 20]
    assert sorted(values(C.fill_nulls(df, "fill_median"), "n")) == [10, 15, 15, 20]


def test_fill_mode_smallest_of_ties(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, None)], "n int, s string")
    assert sorted(values(C.fill_nulls(df, "fill_mode"), "n")) == [9, 9, 10]
    assert sorted(values(C.fill_nulls(df, "fill_mode"), "s")) == ["a", "a", "b"]


def test_fill_empty_and_drop(spark):
    df = spark.createDataFrame([("a", 1.0), (None, None), ("c", 3.0)], "s string, x double")
    assert sorted(values(C.fill_nulls(df, "fill_empty"), "x")) == ["", "1.0", "3.0"]
    assert C.fill_nulls(df, "drop_rows").count() == 2
    with pytest.raises(ValueError):
        C.fill_nulls(df, "drop")


def test_drop_guard_and_all_missing_column(spark):
    with pytest.raises(ValueError):
        C.null_drop(spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double"))
    df = spark.createDataFrame([(1, None), (2, None), (3, None)], "a int, b string")
    assert C.null_drop(df).count() == 3


def test_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`Customer Name` int, `Total $ Amount` int, `total-amount` int")
    assert C.snake_names(df).columns == ["customer_name", "total_amount", "total_amount_2"]


def test_names_that_collide(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "a ", "a_2"])
    assert C.snake_names(df).columns == ["a", "a_3", "a_2"]
    both = spark.createDataFrame([("x", "y")], "A string, a_2 string").withColumn("b", F.lit(1))
    assert C.change_case(both, "lower").select("a", "a_2").count() == 1


def test_case_and_trim(spark):
    df = spark.createDataFrame([("\t o'neil mary-jane 3rd x_y ",), (None,)], "`full name` string")
    out = C.change_case(C.trim_text(df), "title")
    assert out.columns == ["Full Name"]
    assert set(values(out, "Full Name")) == {"O'Neil Mary-Jane 3Rd X_Y", None}
    assert C.trim_changes(df).first()["changed"] == 1


def test_encoding(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, "c"), (4, None)], "i int, c string")
    codes = C.label_encode(df, "c", ["i"]).orderBy("i")
    assert values(codes, "c") == [0, 1, 0, 2, -1]
    hot, _ = C.onehot(df, "c")
    assert hot.columns == ["i", "c_a", "c_b", "c_c"] and hot.filter("i = 4").first()[1:] == (0, 0, 0)
    wide = spark.range(55).select(F.col("id").cast("string").alias("c"))
    kept, note = C.onehot(wide, "c")
    assert kept.columns == ["c"] and "SKIPPED" in note


def test_outliers(spark):
    df = spark.createDataFrame([(float(i),) for i in [*range(1, 100), 100000]], "x double")
    assert C.remove_outliers(df).count() == 99
    many = spark.createDataFrame([(float(10 + i % 11),) for i in range(80)] + [(1000.0,)] * 20, "x double")
    assert C.remove_outliers(many).count() == 100
    flat = spark.createDataFrame([(0,)] * 8 + [(1,), (2,)], "x int")
    assert C.remove_outliers(flat).count() == 10


def test_composite(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, "y"), (3.0, None), (None, "z")], "a double, b string")
    out, report = C.clean(df)
    assert out.filter("a is null or b is null").count() == 0
    steps = {r["step"]: r for r in report.collect()}
    assert steps["input"]["nulls"] == 3 and steps["handle_nulls"]["nulls"] == 0


def test_schema_kinds(spark):
    rows = [(i, f"u{i}@x.org", f"https://x.org/{i}", i * 1.5, i % 2, i, "abc"[i % 3], f"a long sentence number {i} " * 4,
             f"2021-02-{i % 28 + 1:02d}", None, f"+1 555 010{i:02d}", f"10.0.0.{i}", f"${i},000.50") for i in range(80)]
    df = spark.createDataFrame(rows, "n long, email string, url string, x double, flag int, user_id int, kind string, "
                                     "body string, day string, none string, phone string, ip string, price string")
    got = {r["column"]: r["inferred_type"] for r in S.schema_report(df).collect()}
    assert got == {"n": "numeric", "email": "email", "url": "url", "x": "numeric", "flag": "boolean", "user_id": "id",
                   "kind": "categorical", "body": "text", "day": "date", "none": "unknown", "phone": "phone",
                   "ip": "ip_address", "price": "currency"}


def test_quality(spark):
    df = spark.createDataFrame([(1, "alice"), (2, "bob"), (3, "carol"), (4, "dave")], "id int, name string")
    row = Q.score(df).first()
    assert (row["grade"], row["completeness"], row["uniqueness"]) == ("A", 100.0, 100.0)
    half = spark.createDataFrame([(1, None), (None, "b"), (3, None), (None, "d")], "a int, b string")
    assert Q.score(half).first()["completeness"] == 50.0
    copies = spark.createDataFrame([(1,), (1,), (2,), (2,)], "a int")
    assert Q.score(copies).first()["uniqueness"] == 50.0
    Q.score(spark.createDataFrame([], "a int, b string")).collect()


def test_customers_score(spark):
    row = Q.score(spark.createDataFrame(CUSTOMERS, SCHEMA)).first()
    assert row["completeness"] == round((28 - 1) / 28 * 100, 2) and row["uniqueness"] == 75.0


@pytest.mark.parametrize("x", [1.0, 1.25, 1e7, 12345678.5, 1e15, 1.5e15, 1e16, 1.5e16, 1e-4, 5e-4, 1.5e-5, 1e-5, 0.1, 123456.789,
                               1e22, 2.5e-10, 100.0])
def test_decimal_places_follow_plain_text(spark, x):
    text = repr(x)
    expected = len(text.split(".")[-1]) if "." in text else 0
    got = spark.createDataFrame([(x,)], "x double").select(Q.float_decimals(F.col("x"))).first()[0]
    assert got == expected, text


def test_validity(spark):
    df = spark.createDataFrame([(-1.0, " "), (float("inf"), "x"), (2.0, "y")], "price double, s string")
    row = Q.dimensions(df).filter("dimension = 'validity'").first()
    assert row["score"] == round((1 - 3 / 6) * 100, 2)


def test_profile(spark):
    df = spark.createDataFrame([(i, 2 * i, "xy"[i % 2]) for i in range(1, 6)], "a int, b int, c string")
    assert P.profile(df).count() == 3
    assert P.correlations(df).first()["r"] == 1.0
    stats = P.numeric_profile(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 100)], "x double")).first()
    assert (stats["median"], stats["q25"], stats["q75"]) == (3.0, 2.0, 4.0)
    assert stats["skewness"] == pytest.approx(2.232396, abs=1e-5) and stats["kurtosis"] == pytest.approx(4.98679, abs=1e-3)
    flat = P.numeric_profile(spark.createDataFrame([(1.0,)] * 5, "x double")).first()
    assert (flat["skewness"], flat["kurtosis"]) == (0.0, 0.0)


def test_warnings(spark):
    df = spark.createDataFrame([(1, None, f"t{i}") for i in range(10)], "k int, n string, t string")
    got = {(r["column"], r["warning"]) for r in P.profile_warnings(P.profile(df)).collect()}
    assert got == {("k", "constant"), ("n", "null_share_above_50"), ("t", "mostly_unique_text")}


def test_histogram_of_constant(spark):
    rows = P.histogram(spark.createDataFrame([(5.0,)] * 3, "x double"), "x").orderBy("bin").collect()
    assert len(rows) == 20 and rows[0]["n"] == 3 and sum(r["n"] for r in rows) == 3


def test_advice(spark):
    rows = [(f"u{i}", " a" if i % 2 else "A", str(i), float(i % 7), f"2021-01-{i % 28 + 1:02d}") for i in range(30)]
    rows = rows[:-1] + [("u29", "a", "29", 1000.0, "2021-01-05")]
    df = spark.createDataFrame(rows, "uid string, mixed string, digits string, x double, day string")
    got = {(r["column"], r["kind"]) for r in C.recommend(df).collect()}
    assert {("uid", "drop"), ("mixed", "trim_whitespace"), ("mixed", "encode_onehot"), ("mixed", "lower_case"),
            ("x", "handle_outliers"), ("day", "parse_date")} <= got


def test_first_values_of_sparse_columns(spark):
    from quillwork.operators import schema

    df = spark.range(3000).selectExpr("3000 - id as k", "if(id % 700 = 3, concat('s', id), null) as rare", "cast(null as string) as none",
                                      "concat('v', id) as full")
    got = {r["column"]: r["sample_values"] for r in schema.sample_values(df, "k", 3).collect()}
    assert got == {"k": ["1", "2", "3"], "rare": ["s2803", "s2103", "s1403"], "none": [], "full": ["v2999", "v2998", "v2997"]}


def test_modes_of_several_long_texts_take_one_scan(spark):
    from quillwork.operators.columnstats import value_stats

    df = spark.range(40).selectExpr(*[f"concat(repeat('x', 60), id % {m}) as t{m}" for m in (3, 4, 7)], "if(id < 30, null, 'a') as s")
    stats = value_stats(df)
    got = {r["column"]: (r["distinct"], r["mode"], r["mode_count"]) for r in stats.collect()}
    assert got == {"t3": (3, "x" * 60 + "0", 14), "t4": (4, "x" * 60 + "0", 10), "t7": (7, "x" * 60 + "0", 6), "s": (1, "a", 10)}


def test_correlations_of_few_and_many_columns_agree(spark):
    from quillwork.operators import profile

    base = spark.range(400).selectExpr("id * 1.5 as a", "if(id % 7 = 0, null, sin(id)) as b", "pow(id, 2) as c", "7.0 as d",
                                       "if(id % 3 = 0, null, cos(id) + id) as e")
    wide = base.selectExpr("*", *[f"cos(a * {i}) as x{i}" for i in range(1, 6)])
    few = {(r.a, r.b): r.r for r in profile.correlations(base).collect()}
    many = {(r.a, r.b): r.r for r in profile.correlations(wide).collect()}
    assert len(few) == 10 and all(many[k] == v or abs(many[k] - v) < 2e-6 for k, v in few.items())
