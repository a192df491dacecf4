"""Cleaning, schema, quality and profile on customers with defects."""

from pyspark.sql import functions as F

from quillwork.operators import cleaning as C
from quillwork.operators import profile as P
from quillwork.operators import quality as Q
from quillwork.operators import schema as S

from .base import load, register

COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment", "all_null", "flag"]
NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal", "flag"]
TEXT = ["c_name", "c_mktsegment", "all_null"]


def dirty(spark, sf):
    return load(spark, sf, "dirty_customer")


def mode_sql(column: str, source: str = "dirty_customer") -> str:
    return (f"(SELECT {column} FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} "
            f"ORDER BY count(*) DESC, {column} LIMIT 1)")


def union(parts) -> str:
    return " UNION ALL ".join(parts)


# ---- cleaning -----------------------------------------------------------------------------------

@register("cln_drop_columns", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM dirty_customer")
def cln_drop_columns(spark, sf):
    return C.drop_columns(dirty(spark, sf), ["all_null", "flag", "c_nationkey", "absent"])


@register("cln_dedup", "SELECT DISTINCT * FROM dirty_customer")
def cln_dedup(spark, sf):
    return C.deduplicate(dirty(spark, sf))


@register("cln_null_drop", """SELECT * FROM dirty_customer
    WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL AND c_mktsegment IS NOT NULL""")
def cln_null_drop(spark, sf):
    return C.null_drop(dirty(spark, sf))


def _filled(spark, sf, strategy):
    out = C.fill_nulls(dirty(spark, sf), strategy)
    return out.withColumn("c_acctbal", F.round("c_acctbal", 4))


def _fill_sql(balance: str, empty: str = "''") -> str:
    return f"""SELECT c_custkey, coalesce(c_name, {mode_sql('c_name')}) AS c_name, c_nationkey,
        round(coalesce(c_acctbal, {balance}), 4) AS c_acctbal,
        coalesce(c_mktsegment, {mode_sql('c_mktsegment')}) AS c_mktsegment,
        CAST({empty} AS VARCHAR) AS all_null, flag FROM dirty_customer"""


@register("cln_null_mean", _fill_sql("(SELECT avg(c_acctbal) FROM dirty_customer)"))
def cln_null_mean(spark, sf):
    return _filled(spark, sf, "fill_mean")


@register("cln_null_median", _fill_sql("(SELECT median(c_acctbal) FROM dirty_customer)"))
def cln_null_median(spark, sf):
    return _filled(spark, sf, "fill_median")


@register("cln_null_mode", _fill_sql(mode_sql("c_acctbal"), "NULL"))
def cln_null_mode(spark, sf):
    return _filled(spark, sf, "fill_mode")


@register("cln_null_empty", """SELECT c_custkey, coalesce(c_name, '') AS c_name, c_nationkey,
    coalesce(CAST(c_acctbal AS VARCHAR), '') AS c_acctbal, coalesce(c_mktsegment, '') AS c_mktsegment,
    coalesce(all_null, '') AS all_null, flag FROM dirty_customer""")
def cln_null_empty(spark, sf):
    return C.fill_nulls(dirty(spark, sf), "fill_empty")


@register("cln_trim", """SELECT c_custkey, trim(c_name) AS c_name, c_nationkey, c_acctbal,
    trim(c_mktsegment) AS c_mktsegment, all_null, flag FROM dirty_customer""")
def cln_trim(spark, sf):
    return C.trim_text(dirty(spark, sf))


@register("cln_trim_changes", union(
    f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} <> trim({c})) AS changed FROM dirty_customer" for c in TEXT))
def cln_trim_changes(spark, sf):
    return C.trim_changes(dirty(spark, sf)).select("column", "changed")


@register("cln_case", """SELECT o_orderkey AS "O_Orderkey",
    regexp_replace(substr(p, 1, 2) || upper(substr(p, 3, 1)) || lower(substr(p, 4)), 't s', 't S') AS "O_Orderpriority",
    code AS "Code"
    FROM (SELECT o_orderkey, o_orderpriority AS p, code FROM dirty_orders) o""")
def cln_case(spark, sf):
    return C.change_case(load(spark, sf, "dirty_orders").select("o_orderkey", "o_orderpriority", "code"), "title")


@register("cln_outliers", """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b,
                      quantile_cont(o_custkey, 0.25) AS c, quantile_cont(o_custkey, 0.75) AS d FROM dirty_orders)
    SELECT o.* FROM dirty_orders o, q
    WHERE (o_totalprice IS NULL OR o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
      AND o_custkey BETWEEN c - 1.5 * (d - c) AND d + 1.5 * (d - c)""")
def cln_outliers(spark, sf):
    return C.remove_outliers(load(spark, sf, "dirty_orders"))


@register("cln_outlier_report", """
    WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM dirty_orders)
    SELECT 'o_totalprice' AS "column", count(*) FILTER (NOT o_totalprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
           AS flagged, count(*) AS total FROM dirty_orders, q""")
def cln_outlier_report(spark, sf):
    df = load(spark, sf, "dirty_orders").select("o_totalprice")
    fences = {r["column"]: (r["lower"], r["upper"]) for r in C.outlier_fences(df).collect()}
    return C.outlier_report(df, fences).select("column", "flagged", "total")


ONEHOT = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("cln_onehot", "SELECT c_custkey, " + ", ".join(
    f"CAST(c_mktsegment = '{v}' AS INT) AS \"c_mktsegment_{v}\"" for v in ONEHOT) + " FROM customer")
def cln_onehot(spark, sf):
    return C.onehot(load(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")[0]


@register("cln_label_encode", """
    WITH f AS (SELECT c_mktsegment AS v, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code
               FROM dirty_customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment)
    SELECT d.c_custkey, coalesce(f.code, -1) AS c_mktsegment FROM dirty_customer d LEFT JOIN f ON d.c_mktsegment = f.v""")
def cln_label_encode(spark, sf):
    return C.label_encode(dirty(spark, sf).select("c_custkey", "c_mktsegment"), "c_mktsegment", ["c_custkey"])


@register("cln_encode", """
    WITH f AS (SELECT c_name AS v, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code
               FROM dirty_customer WHERE c_name IS NOT NULL GROUP BY c_name)
    SELECT d.c_custkey, coalesce(f.code, -1) AS c_name, CAST(flag = 0 AS INT) AS flag_0, CAST(flag = 1 AS INT) AS flag_1
    FROM dirty_customer d LEFT JOIN f ON d.c_name = f.v""")
def cln_encode(spark, sf):
    specs = [{"column": "flag", "mode": "onehot"}, {"column": "c_name", "mode": "label"},
             {"column": "absent", "mode": "label"}]
    return C.encode(dirty(spark, sf).select("c_custkey", "c_name", "flag"), specs, ["c_custkey"])[0]


@register("cln_snake_names", """SELECT c_custkey AS customer_key, c_name AS name_full, c_acctbal AS name_full_2
    FROM dirty_customer""")
def cln_snake_names(spark, sf):
    return C.snake_names(dirty(spark, sf).select(
        F.col("c_custkey").alias(" Customer Key$"), F.col("c_name").alias("Name (Full)"),
        F.col("c_acctbal").alias("name_full_")))


PLAN = C.CleaningPlan(null_strategy="fill_mode", drop=("all_null",), case="lower", outliers=True,
                      encode=({"column": "c_nationkey", "mode": "label"},), order_by=("c_custkey",))
# Label codes of c_nationkey, distinct rows, gaps filled, trimmed and lower-cased; no column has outliers.
COMPOSITE = f"""
    WITH f AS (SELECT c_nationkey AS v, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS code
               FROM dirty_customer GROUP BY c_nationkey),
    e AS (SELECT DISTINCT c_custkey, c_name, f.code AS c_nationkey, c_acctbal, c_mktsegment, flag
          FROM dirty_customer JOIN f ON c_nationkey = f.v),
    m AS (SELECT {mode_sql('c_name', 'e')} AS name, {mode_sql('c_acctbal', 'e')} AS bal, {mode_sql('c_mktsegment', 'e')} AS seg)
    """


@register("cln_composite", COMPOSITE + """
    SELECT c_custkey, lower(trim(coalesce(c_name, name))) AS c_name, c_nationkey, coalesce(c_acctbal, bal) AS c_acctbal,
           lower(trim(coalesce(c_mktsegment, seg))) AS c_mktsegment, flag FROM e, m""")
def cln_composite(spark, sf):
    return C.clean(dirty(spark, sf), PLAN)[0]


@register("cln_composite_report", COMPOSITE + """
    , n AS (SELECT (SELECT count(*) FROM dirty_customer) AS before, (SELECT count(*) FROM e) AS after,
       (SELECT count(*) * 3 - count(c_name) - count(c_acctbal) - count(c_mktsegment) FROM dirty_customer) AS gaps,
       (SELECT count(*) * 3 - count(c_name) - count(c_acctbal) - count(c_mktsegment) FROM e) AS left_gaps)
    SELECT 0 AS position, 'input' AS step, before AS "rows", gaps + before AS nulls, 7 AS columns, '' AS note FROM n
    UNION ALL SELECT 1, 'drop_columns', before, gaps, 6, '' FROM n
    UNION ALL SELECT 2, 'encode_categorical', before, gaps, 6, 'c_nationkey: label codes' FROM n
    UNION ALL SELECT 3, 'remove_duplicates', after, left_gaps, 6, '' FROM n
    UNION ALL SELECT 4, 'handle_nulls', after, 0, 6, 'fill_mode' FROM n
    UNION ALL SELECT 5, 'normalize_text', after, 0, 6, '' FROM n
    UNION ALL SELECT 6, 'normalize_case', after, 0, 6, 'lower' FROM n
    UNION ALL SELECT 7, 'remove_outliers', after, 0, 6, '' FROM n""")
def cln_composite_report(spark, sf):
    return C.clean(dirty(spark, sf), PLAN)[1]


@register("cln_recommend", """
    WITH t AS (SELECT count(*) AS total, count(c_name) AS names, count(DISTINCT c_name) AS dnames,
                      count(*) FILTER (c_name <> trim(c_name)) AS padded, count(c_acctbal) AS bals,
                      count(c_mktsegment) AS segs, count(DISTINCT c_mktsegment) AS dsegs,
                      count(DISTINCT lower(c_mktsegment)) AS lsegs FROM dirty_customer)
    SELECT 0 AS position, 'c_custkey' AS "column", 'noop' AS kind, 9 AS priority, 'looks clean' AS reason
    UNION ALL SELECT 1, 'c_name', 'fill_mode', 3, CAST(total - names AS VARCHAR) FROM t
    UNION ALL SELECT 1, 'c_name', 'trim_whitespace', 5, CAST(padded AS VARCHAR) FROM t
    UNION ALL SELECT 2, 'c_nationkey', 'noop', 9, 'looks clean'
    UNION ALL SELECT 3, 'c_acctbal', 'fill_median', 3, CAST(total - bals AS VARCHAR) FROM t
    UNION ALL SELECT 4, 'c_mktsegment', 'encode_onehot', 2, CAST(dsegs AS VARCHAR) FROM t
    UNION ALL SELECT 4, 'c_mktsegment', 'fill_mode', 3, CAST(total - segs AS VARCHAR) FROM t
    UNION ALL SELECT 4, 'c_mktsegment', 'lower_case', 7, CAST(dsegs - lsegs AS VARCHAR) FROM t
    UNION ALL SELECT 5, 'all_null', 'drop', 1, 'missing'
    UNION ALL SELECT 6, 'flag', 'noop', 9, 'looks clean'""")
def cln_recommend(spark, sf):
    return C.recommend(dirty(spark, sf))


@register("cln_preview", """
    SELECT DISTINCT * FROM dirty_customer WHERE c_name IS NOT NULL AND c_acctbal IS NOT NULL
    AND c_mktsegment IS NOT NULL ORDER BY c_custkey LIMIT 10""")
def cln_preview(spark, sf):
    return C.preview(C.null_drop(C.deduplicate(dirty(spark, sf))), ["c_custkey"], 10)


# ---- schema -------------------------------------------------------------------------------------

KINDS = {"c_custkey": "numeric", "c_name": "text", "c_nationkey": "numeric", "c_acctbal": "numeric",
         "all_null": "unknown", "flag": "boolean"}


def _schema_row(position: int, c: str) -> str:
    number, text = c in NUMERIC, c in TEXT
    kind = f"'{KINDS[c]}'" if c in KINDS else (
        f"CASE WHEN count(DISTINCT {c}) / count({c}) < 0.05 AND count(DISTINCT {c}) <= 50 THEN 'categorical' "
        f"WHEN count(DISTINCT {c}) / count({c}) < 0.1 AND count(DISTINCT {c}) <= 20 THEN 'categorical' ELSE 'text' END")
    measured = number and c != "flag"
    lengths = [f"{f}(length({c}))" if text else "CAST(NULL AS BIGINT)" for f in ("min", "max")]
    stats = [e.format(c) if measured else "CAST(NULL AS DOUBLE)" for e in (
        "round(avg({}), 4)", "round(stddev_samp({}), 4)", "CAST(min({}) AS DOUBLE)", "CAST(max({}) AS DOUBLE)")]
    dtype = {"c_nationkey": "int", "c_acctbal": "double"}.get(c, "bigint" if number else "string")
    return f"""SELECT {position} AS position, '{c}' AS "column", '{dtype}' AS dtype, {kind} AS inferred_type,
        count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_percentage,
        count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / greatest(count({c}), 1) * 100, 2)
        AS unique_percentage, {lengths[0]} AS min_length, {lengths[1]} AS max_length, {stats[0]} AS mean,
        {stats[1]} AS std, {stats[2]} AS min_value, {stats[3]} AS max_value FROM dirty_customer"""


SCHEMA = union(_schema_row(i, c) for i, c in enumerate(COLUMNS))


@register("sch_infer", f"SELECT position, \"column\", inferred_type FROM ({SCHEMA}) s")
def sch_infer(spark, sf):
    return S.schema_report(dirty(spark, sf)).select("position", "column", "inferred_type")


@register("sch_stats", SCHEMA)
def sch_stats(spark, sf):
    return S.schema_report(dirty(spark, sf))


@register("sch_summary", f"SELECT inferred_type, count(*) AS columns FROM ({SCHEMA}) s GROUP BY inferred_type")
def sch_summary(spark, sf):
    return S.type_summary(S.schema_report(dirty(spark, sf)))


@register("sch_match_ratio", union(f"""SELECT '{c}' AS "column",
    coalesce(avg(regexp_matches(trim({c}), '^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+$')::INT), 0) AS email,
    coalesce(avg(regexp_matches(trim({c}), '^https?://\\S+$')::INT), 0) AS url,
    coalesce(avg(regexp_matches(trim({c}), '^[+]?[\\d\\s\\-()]{{7,15}}$')::INT), 0) AS phone,
    coalesce(avg(regexp_matches(trim({c}), '^[$]?\\s*[\\d,]+\\.?\\d*$')::INT), 0) AS currency
    FROM pages""" for c in ("url", "html")))
def sch_match_ratio(spark, sf):
    out = S.match_ratios(load(spark, sf, "pages").select("url", "html"))
    return out.select("column", "email", "url", "phone", "currency")


FORMATS = "['%Y-%m-%d', '%Y-%m-%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S', '%Y/%m/%d', '%m/%d/%Y', '%d-%m-%Y', '%d.%m.%Y', '%b %d %Y', '%d %b %Y', '%B %d, %Y']"


@register("sch_date_ratio", union(f"""SELECT '{name}' AS "column", avg(CASE WHEN try_strptime({text}, {FORMATS}) IS NOT NULL THEN 1.0 ELSE 0.0 END)
    AS date FROM orders""" for name, text in (("slashes", "strftime(o_orderdate, '%Y/%m/%d')"),
                                             ("iso", "CAST(o_orderdate AS VARCHAR)"), ("o_orderpriority", "o_orderpriority"))))
def sch_date_ratio(spark, sf):
    orders = load(spark, sf, "orders").select(
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("slashes"), F.col("o_orderdate").cast("string").alias("iso"),
        "o_orderpriority")
    return S.date_ratios(orders).select("column", "date")


@register("sch_samples", union(
    f"""SELECT '{c}' AS "column", array_to_string(list(CAST(v AS VARCHAR) ORDER BY k, v), ',') AS samples
        FROM (SELECT c_custkey AS k, {c} AS v FROM customer WHERE {c} IS NOT NULL ORDER BY k LIMIT 5) h"""
    for c in ("c_custkey", "c_name", "c_mktsegment")))
def sch_samples(spark, sf):
    out = S.sample_values(load(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return out.select("column", F.array_join("sample_values", ",").alias("samples"))


# ---- quality ------------------------------------------------------------------------------------

def _case_share(c: str) -> str:
    u = f"count(*) FILTER ({c} = upper({c}) AND {c} <> lower({c}))"
    l = f"count(*) FILTER ({c} = lower({c}) AND {c} <> upper({c}))"
    return f"(SELECT greatest({u}, {l}, count({c}) - {u} - {l}) / count({c}) * 100 FROM dirty_customer)"


QUALITY = f"""
    WITH n AS (SELECT count(*) AS r, 7 * count(*) AS cells, count(*) * 3 + count(c_name) + count(c_acctbal)
               + count(c_mktsegment) AS filled FROM dirty_customer),
    u AS (SELECT count(*) AS d FROM (SELECT DISTINCT * FROM dirty_customer) x),
    s AS (SELECT round(filled / cells * 100, 2) AS completeness, round(d / r * 100, 2) AS uniqueness,
          round((95 + {_case_share('c_name')} + 95 + 95 + {_case_share('c_mktsegment')} + 100 + 95) / 7, 2)
          AS consistency, CAST(100 AS DOUBLE) AS validity FROM n, u)
    """


def dimension(name: str):
    @register(f"qlt_{name}", QUALITY + f"SELECT {name} AS score FROM s")
    def run(spark, sf):
        return Q.dimensions(dirty(spark, sf)).filter(F.col("dimension") == name).select("score")


for _d in ("completeness", "uniqueness", "consistency"):
    dimension(_d)


@register("qlt_validity", """
    WITH f AS (SELECT sum(CASE WHEN n_chars > 10000 THEN 1 ELSE 0 END) + sum(CASE WHEN trim(lang) = '' THEN 1 ELSE 0 END)
                      AS bad, count(*) AS n FROM (SELECT length(text) AS n_chars, lang FROM documents) d)
    SELECT round(greatest(1 - bad / (n * 4), 0) * 100, 2) AS score FROM f""")
def qlt_validity(spark, sf):
    df = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    return Q.dimensions(df).filter("dimension = 'validity'").select("score")


@register("qlt_column_scores", union(
    f"SELECT '{c}' AS \"column\", round(count({c}) / count(*) * 100, 2) AS completeness FROM dirty_customer"
    for c in COLUMNS))
def qlt_column_scores(spark, sf):
    return Q.column_scores(dirty(spark, sf)).select("column", "completeness")


OVERALL = "round(completeness * 0.4 + uniqueness * 0.2 + consistency * 0.2 + validity * 0.2, 2)"
GRADE = "CASE WHEN {0} >= 90 THEN 'A' WHEN {0} >= 80 THEN 'B' WHEN {0} >= 70 THEN 'C' WHEN {0} >= 60 THEN 'D' ELSE 'F' END"


@register("qlt_grade", QUALITY + f"SELECT {OVERALL} AS score, {GRADE.format(OVERALL)} AS grade FROM s")
def qlt_grade(spark, sf):
    return Q.overall(Q.dimensions(dirty(spark, sf)))


@register("qlt_recommend", QUALITY + """
    , a AS (SELECT 'completeness' AS dimension, 'fill missing values or check the source' AS advice FROM s WHERE completeness < 90
      UNION ALL SELECT 'uniqueness', 'deduplicate rows or confirm that repeats are intended' FROM s WHERE uniqueness < 95
      UNION ALL SELECT 'consistency', 'standardise casing and formats' FROM s WHERE consistency < 80
      UNION ALL SELECT 'validity', 'review values outside the expected ranges' FROM s WHERE validity < 90)
    SELECT * FROM a UNION ALL SELECT 'all', 'no major issues' WHERE NOT EXISTS (SELECT 1 FROM a)""")
def qlt_recommend(spark, sf):
    return Q.recommendations(Q.dimensions(dirty(spark, sf)))


@register("qlt_score", QUALITY + f"""SELECT {OVERALL} AS overall, completeness, uniqueness, consistency, validity,
    {GRADE.format(OVERALL)} AS grade FROM s""")
def qlt_score(spark, sf):
    return Q.score(dirty(spark, sf))


# ---- profile ------------------------------------------------------------------------------------

def _profile_row(position: int, c: str) -> str:
    number = c in NUMERIC
    kind = "'numeric'" if number else (
        f"CASE WHEN count({c}) = 0 THEN 'categorical' WHEN avg(length({c})) > 50 OR count(DISTINCT {c}) / count({c}) > 0.5 "
        f"THEN 'text' ELSE 'categorical' END")
    num = [e.format(c) if number else "CAST(NULL AS DOUBLE)" for e in (
        "round(avg({}), 6)", "round(median({}), 6)", "round(stddev_samp({}), 6)", "CAST(min({}) AS DOUBLE)",
        "CAST(max({}) AS DOUBLE)", "quantile_cont(CAST({} AS DOUBLE), 0.25)", "quantile_cont(CAST({} AS DOUBLE), 0.5)",
        "quantile_cont(CAST({} AS DOUBLE), 0.75)", "round(skewness({}), 6)", "round(kurtosis({}), 6)")]
    names = ("mean", "median", "std", "min", "max", "q25", "q50", "q75", "skewness", "kurtosis")
    most = "NULL" if number or c == "all_null" else mode_sql(c)
    freq = f"(SELECT max(k) FROM (SELECT count(*) AS k FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c}) z)"
    return f"""SELECT {position} AS position, '{c}' AS "column", {kind} AS kind, count(*) AS count,
        count(*) - count({c}) AS null_count, round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct,
        count(DISTINCT {c}) AS unique_count, round(count(DISTINCT {c}) / greatest(count({c}), 1) * 100, 2) AS unique_pct,
        CAST({most} AS VARCHAR) AS mode, CAST({freq} AS BIGINT) AS mode_count,
        CASE WHEN ({kind}) = 'text' THEN round(avg(length({c if not number else "''"})), 2) END AS avg_length,
        {', '.join(f'{e} AS "{n}"' for e, n in zip(num, names))} FROM dirty_customer"""


PROFILE = union(_profile_row(i, c) for i, c in enumerate(COLUMNS))


@register("eda_profile", PROFILE)
def eda_profile(spark, sf):
    return P.profile(dirty(spark, sf))


@register("eda_classify", f"SELECT \"column\", kind FROM ({PROFILE}) p")
def eda_classify(spark, sf):
    return P.classify(dirty(spark, sf)).select("column", "kind")


@register("eda_numeric", union(f"""SELECT '{c}' AS "column", count({c}) AS n, round(avg({c}), 6) AS mean,
    round(median({c}), 6) AS median, round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
    CAST(max({c}) AS DOUBLE) AS max, quantile_cont({c}, 0.25) AS q25, quantile_cont({c}, 0.5) AS q50,
    quantile_cont({c}, 0.75) AS q75, round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis
    FROM (SELECT l_quantity, l_extendedprice, l_discount, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem) l"""
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")))
def eda_numeric(spark, sf):
    df = load(spark, sf, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_linenumber")
    return P.numeric_profile(df).drop("position")


@register("eda_categorical", union(f"""SELECT '{c}' AS "column", value, n, row_number() OVER (ORDER BY n DESC, value) AS rank
    FROM (SELECT {c} AS value, count(*) AS n FROM dirty_customer WHERE {c} IS NOT NULL GROUP BY {c}
          ORDER BY n DESC, value LIMIT 10) t""" for c in ("c_name", "c_mktsegment")))
def eda_categorical(spark, sf):
    out = P.top_values(dirty(spark, sf), ["c_name", "c_mktsegment", "all_null"])
    return out.withColumn("rank", F.col("rank").cast("long"))


@register("eda_text", union(f"""SELECT '{c}' AS "column", round(coalesce(avg(length({c})), 0), 2) AS avg_length,
    coalesce(min(length({c})), 0) AS min_length, coalesce(max(length({c})), 0) AS max_length FROM {t}"""
                            for c, t in (("text", "documents"), ("lang", "documents"))))
def eda_text(spark, sf):
    return P.text_profile(load(spark, sf, "documents"), ["text", "lang"]).drop("position")


CORR = [("c_custkey", "c_nationkey"), ("c_custkey", "c_acctbal"), ("c_custkey", "flag"),
        ("c_nationkey", "c_acctbal"), ("c_nationkey", "flag"), ("c_acctbal", "flag")]
CORRELATION = union(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM dirty_customer" for a, b in CORR)


@register("eda_correlation", f"""WITH h AS ({CORRELATION}) SELECT a AS "column", b AS other, r FROM h
    UNION ALL SELECT b, a, r FROM h""")
def eda_correlation(spark, sf):
    return P.correlation_map(dirty(spark, sf))


@register("eda_top_correlations", f"SELECT a, b, r FROM ({CORRELATION}) c ORDER BY abs(r) DESC, a, b LIMIT 4")
def eda_top_correlations(spark, sf):
    return P.top_correlations(dirty(spark, sf), n=4)


@register("eda_warnings", f"""WITH p AS ({PROFILE})
    SELECT "column", 'null_share_above_50' AS warning FROM p WHERE null_pct > 50
    UNION ALL SELECT "column", 'constant' FROM p WHERE count > null_count AND unique_count = 1
    UNION ALL SELECT "column", 'near_constant' FROM p WHERE count > null_count AND unique_count <> 1
        AND mode_count / (count - null_count) > 0.95
    UNION ALL SELECT "column", 'mostly_unique_text' FROM p WHERE kind = 'text' AND unique_count / (count - null_count) > 0.5
    UNION ALL SELECT "column", 'high_skewness' FROM p WHERE abs(skewness) > 2""")
def eda_warnings(spark, sf):
    return P.profile_warnings(P.profile(dirty(spark, sf)))


@register("eda_columns_data", """SELECT o_orderkey, o_totalprice FROM dirty_orders ORDER BY o_orderkey LIMIT 1000""")
def eda_columns_data(spark, sf):
    return P.columns_data(load(spark, sf, "dirty_orders"), ["o_orderkey", " o_totalprice ", "absent"], "o_orderkey", 1000)


@register("eda_bar", """SELECT p_brand AS value, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, value LIMIT 15""")
def eda_bar(spark, sf):
    return P.bar(load(spark, sf, "part"), "p_brand")


@register("eda_histogram", """
    WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) - min(l_extendedprice) AS w FROM lineitem),
    c AS (SELECT CAST(least(floor((l_extendedprice - lo) / w * 20), 19) AS INT) AS bin, count(*) AS n
          FROM lineitem, r GROUP BY 1)
    SELECT CAST(b.bin AS INT) AS bin, round(lo + b.bin * w / 20, 4) AS lower, round(lo + (b.bin + 1) * w / 20, 4) AS upper,
           coalesce(n, 0) AS n FROM range(20) b(bin) LEFT JOIN c ON b.bin = c.bin, r""")
def eda_histogram(spark, sf):
    out = P.histogram(load(spark, sf, "lineitem"), "l_extendedprice")
    return out.withColumn("lower", F.round("lower", 4)).withColumn("upper", F.round("upper", 4))


PAIRS = """SELECT CAST(o_custkey AS DOUBLE) AS x, o_totalprice AS y FROM
    (SELECT * FROM dirty_orders ORDER BY o_orderkey LIMIT 1000) h WHERE o_totalprice IS NOT NULL"""


@register("eda_scatter", PAIRS)
def eda_scatter(spark, sf):
    return P.scatter(load(spark, sf, "dirty_orders"), "o_custkey", "o_totalprice", "o_orderkey")


@register("eda_line", PAIRS + " ORDER BY x, y")
def eda_line(spark, sf):
    return P.line(load(spark, sf, "dirty_orders"), "o_custkey", "o_totalprice", "o_orderkey")


@register("eda_null_chart", "SELECT * FROM (" + union(
    f"SELECT '{c}' AS \"column\", round((count(*) - count({c})) / count(*) * 100, 2) AS null_pct FROM dirty_customer"
    for c in COLUMNS) + ") x WHERE null_pct > 0 ORDER BY null_pct DESC LIMIT 15")
def eda_null_chart(spark, sf):
    return P.null_chart(dirty(spark, sf))


@register("eda_type_counts", f"SELECT kind, count(*) AS columns FROM ({PROFILE}) p GROUP BY kind")
def eda_type_counts(spark, sf):
    return P.type_counts(P.classify(dirty(spark, sf)))


@register("eda_report_json", f"""SELECT "column", '{{"column":"' || "column" || '","kind":"' || kind || '","count":' || count ||
    ',"null_count":' || null_count || ',"unique_count":' || unique_count || '}}' AS document FROM ({PROFILE}) p""")
def eda_report_json(spark, sf):
    return P.report_json(P.profile(dirty(spark, sf)).select("column", "kind", "count", "null_count", "unique_count"))
