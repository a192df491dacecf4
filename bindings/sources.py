"""Sources and ingestion checks on lines, records and bytes made from the tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillwork.operators.ranking import with_neighbors
from quillwork.scratch import new_path
from quillwork.sources import delimited as D
from quillwork.sources import files as Fl
from quillwork.sources import records as R
from quillwork.streaming.incremental import not_yet_embedded

from .base import INPUTS, load, register
from .images import png_images

# A delimited file: header, plain rows, quoted rows, short rows, long rows, empty cells and copies.
INPUTS["csv_lines"] = """
    SELECT CAST(n * 1000000000 + o_orderkey AS BIGINT) AS line_no,
           concat(CAST(o_orderkey AS STRING), ',', lpad(CAST(o_custkey % 50 AS STRING), 3, '0'), ',',
                  CASE o_orderkey % 11 WHEN 1 THEN concat('"a, ""b""', '"') WHEN 2 THEN 'NA' WHEN 3 THEN '' WHEN 4 THEN ' None '
                       ELSE o_orderpriority END,
                  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN ',1,2' ELSE
                       concat(',', CAST(o_custkey AS STRING), '.5') END) AS value
    FROM (SELECT 0 AS n, o_orderkey, o_custkey, o_orderpriority FROM {orders}
          UNION ALL SELECT 1, o_orderkey, o_custkey, o_orderpriority FROM {orders} WHERE o_orderkey % 20 = 0) o"""
INPUTS["json_lines"] = """
    SELECT n * 1000000000 + event_id AS line_no,
           CASE event_id % 9 WHEN 0 THEN '[1, 2]' WHEN 1 THEN concat('{{"id":', CAST(event_id AS STRING), ',"type":null}}')
                WHEN 2 THEN concat('{{"type":" ","id":', CAST(event_id AS STRING), '}}')
                WHEN 3 THEN concat('{{"id":', CAST(event_id AS STRING), ',"extra":', props, '}}')
                ELSE concat('{{"id":', CAST(event_id AS STRING), ',"type":"', event_type, '"}}') END AS value
    FROM (SELECT 0 AS n, event_id, event_type, props FROM {events}
          UNION ALL SELECT 1, event_id, event_type, props FROM {events} WHERE event_id % 10 = 0) e"""
# A prelude of one-field lines before rows of four fields.
INPUTS["prelude_lines"] = """
    SELECT CAST(o_orderkey AS BIGINT) AS line_no,
           CASE WHEN o_orderkey <= 7 THEN 'about this file' ELSE concat_ws(';', CAST(o_orderkey AS STRING),
                CAST(o_custkey AS STRING), o_orderstatus, '"a;b"') END AS value FROM {orders}"""
COLUMNS = ["key", "code", "note", "price"]


def csv_lines(spark, sf):
    return load(spark, sf, "csv_lines")


FIELDS = """
    f AS (SELECT n, o_orderkey AS k, o_custkey AS c, CASE o_orderkey % 11 WHEN 1 THEN 'a, "b"' WHEN 2 THEN NULL WHEN 3 THEN NULL
                 WHEN 4 THEN ' None ' ELSE o_orderpriority END AS note,
                 CASE WHEN o_orderkey % 13 = 0 THEN 3 WHEN o_orderkey % 17 = 0 THEN 5 ELSE 4 END AS fields
          FROM (SELECT 0 AS n, * FROM orders UNION ALL SELECT 1, * FROM orders WHERE o_orderkey % 20 = 0) o)"""


@register("src_csv_tolerant", f"""WITH {FIELDS}
    SELECT n * 1000000000 + k AS line_no, CAST(k AS VARCHAR) AS key, lpad(CAST(c % 50 AS VARCHAR), 3, '0') AS code, note,
           CASE WHEN fields = 4 THEN c || '.5' END AS price FROM f WHERE fields <= 4""")
def src_csv_tolerant(spark, sf):
    return D.parse_lines(csv_lines(spark, sf), COLUMNS)


def headed(lines, head):
    """The lines (value) with the head before the first one of every partition, so in every file written from them; there
    is a file with the head alone, too."""
    first = F.monotonically_increasing_id() % (1 << 33) == 0  # the lower 33 bits count the rows of a partition
    text = F.coalesce("value", F.lit(""))
    led = lines.select(F.when(first, F.concat(F.lit(head + "\n"), text)).otherwise(text).alias("value"))
    return lines.sparkSession.range(1, numPartitions=1).select(F.lit(head).alias("value")).unionByName(led)


def quoted_file(spark, sf, charset):
    """The path of files of whole texts in quoted cells with their line breaks; the header leads each."""
    path = new_path(spark, "source") + ".csv"
    quoted = F.concat(F.lit('"'), F.replace(F.coalesce("text", F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", "doc_id", quoted, F.coalesce("lang", F.lit("")))
    lines = load(spark, sf, "documents").select(F.encode(line, charset).cast("string").alias("value"))
    headed(lines, "doc_id,text,lang").write.text(path)
    return path


QUOTED = "SELECT doc_id, CASE WHEN text <> '' THEN md5(text) END AS text, lang FROM documents"


@register("src_csv_quoted", QUOTED)
def src_csv_quoted(spark, sf):
    return Fl.read_any(spark, quoted_file(spark, sf, "UTF-8")).select("doc_id", F.md5("text").alias("text"), "lang")


@register("src_csv_encoding", QUOTED)
def src_csv_encoding(spark, sf):
    """One byte a character; the texts have none beyond Latin-1."""
    return Fl.read_any(spark, quoted_file(spark, sf, "ISO-8859-1")).select("doc_id", F.md5("text").alias("text"), "lang")


@register("src_csv_report", f"""WITH {FIELDS} SELECT count(*) AS preparse_rows, count(*) FILTER (fields > 4) AS skipped_rows FROM f""")
def src_csv_report(spark, sf):
    return D.parse_report(csv_lines(spark, sf), COLUMNS)


@register("src_leading_zero", """SELECT * FROM (VALUES ('key', 'bigint'), ('code', 'string'), ('note', 'string'),
    ('price', 'double')) t("column", kind)""")
def src_leading_zero(spark, sf):
    return D.column_kinds(D.parse_lines(csv_lines(spark, sf), COLUMNS), COLUMNS)


@register("src_csv_typed", f"""WITH {FIELDS}
    SELECT k AS key, lpad(CAST(c % 50 AS VARCHAR), 3, '0') AS code, note,
           CASE WHEN fields = 4 THEN c + CAST(0.5 AS DOUBLE) END AS price FROM f WHERE fields <= 4""")
def src_csv_typed(spark, sf):
    return D.typed(D.parse_lines(csv_lines(spark, sf), COLUMNS).drop("line_no"), COLUMNS)


def written(spark, lines, ext):
    """The path of a folder of text files holding the lines (column value), named with the extension."""
    path = new_path(spark, "source") + ext
    lines.write.text(path)
    return path


@register("src_json", "SELECT event_id, CAST(regexp_extract(props, '\\d+') AS BIGINT) AS k FROM events")
def src_json(spark, sf):
    """Files with one array of at most 100,000 records each, written and read back by their extension."""
    record = F.to_json(F.struct("event_id", F.from_json("props", "k bigint").alias("p")))
    arrays = load(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 100_000).alias("file")).agg(
        F.concat(F.lit("["), F.array_join(F.collect_list(record), ","), F.lit("]")).alias("value"))
    path = new_path(spark, "source") + ".json"
    arrays.write.partitionBy("file").text(path)  # one row, so one array, a file
    return Fl.read_any(spark, path).select("event_id", "p.k")


@register("src_jsonl", """SELECT line_no % 1000000000 AS id, CASE line_no % 1000000000 % 9 WHEN 1 THEN NULL WHEN 2 THEN ' '
    WHEN 3 THEN NULL ELSE event_type END AS type FROM json_lines JOIN events ON event_id = line_no % 1000000000
    WHERE line_no % 1000000000 % 9 <> 0""")
def src_jsonl(spark, sf):
    path = written(spark, load(spark, sf, "json_lines").select("value"), ".jsonl")
    return Fl.read_any(spark, path).select("id", "type")


@register("src_jsonl_schema", """SELECT line_no, line_no % 1000000000 AS id, CASE line_no % 1000000000 % 9 WHEN 1 THEN NULL WHEN 2 THEN ' '
    WHEN 3 THEN NULL ELSE event_type END AS type FROM json_lines JOIN events ON event_id = line_no % 1000000000
    WHERE line_no % 1000000000 % 9 <> 0""")
def src_jsonl_schema(spark, sf):
    return R.parse_records(load(spark, sf, "json_lines"), "id bigint, type string")


@register("src_delimiter", "SELECT ';' AS delimiter, CAST(4 AS INT) AS fields")
def src_delimiter(spark, sf):
    return D.sniff_delimiter(load(spark, sf, "prelude_lines").filter("line_no > 7"))


@register("src_prelude", """SELECT min(o_orderkey) AS start FROM orders WHERE o_orderkey > 7""")
def src_prelude(spark, sf):
    return D.data_start(load(spark, sf, "prelude_lines"), ";")


@register("src_encoding", """SELECT doc_id, md5(text) AS text, CASE doc_id % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-8-sig'
    WHEN 2 THEN 'utf-16' ELSE 'utf-16-le (no BOM)' END AS encoding FROM documents""")
def src_encoding(spark, sf):
    kind = F.col("doc_id") % 4
    raw = (F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
           .when(kind == 2, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-16LE")))
    out = load(spark, sf, "documents").select("doc_id", Fl.decode_bytes(raw).alias("d"))
    return out.select("doc_id", F.md5("d.text").alias("text"), "d.encoding")


@register("src_validate_report", f"""WITH {FIELDS}, c AS (SELECT count(*) AS r FROM f)
    SELECT r AS row_count, count(*) FILTER (fields <> 4) AS inconsistent_rows,
           count(*) FILTER (note IS NULL OR note = ' None ') AS null_cells, count(*) FILTER (n = 1) AS duplicate_rows,
           'key|code|note|KEY' AS columns, 'duplicate column name key' AS problems, 5 AS samples
    FROM f, c GROUP BY r""")
def src_validate_report(spark, sf):
    """The check of files with two lines before their header."""
    path = new_path(spark, "source") + ".csv"
    lines = csv_lines(spark, sf).repartitionByRange("line_no").sortWithinPartitions("line_no")
    headed(lines, "made for\na check\nkey,code,note,KEY").write.text(path)
    found = D.check_delimited(spark, path)
    return found.select("row_count", "inconsistent_rows", "null_cells", "duplicate_rows", F.array_join("columns", "|").alias("columns"),
                        F.array_join("problems", "|").alias("problems"), F.size("sample").alias("samples"))


@register("src_validate_csv", f"""WITH {FIELDS},
    c AS (SELECT count(*) AS r FROM f)
    SELECT r AS row_count, count(*) FILTER (fields <> 4) AS inconsistent_rows,
           count(*) FILTER (note IS NULL OR note = ' None ') AS null_cells, count(*) FILTER (n = 1) AS duplicate_rows
    FROM f, c GROUP BY r""")
def src_validate_csv(spark, sf):
    return D.validate_rows(csv_lines(spark, sf), COLUMNS)


@register("src_validate_json", """
    WITH e AS (SELECT line_no % 1000000000 % 9 AS m, line_no FROM json_lines),
    f AS (SELECT CASE WHEN m IN (0) THEN NULL WHEN m = 3 THEN 'extra,id' ELSE 'id,type' END AS keys, * FROM e),
    first AS (SELECT keys FROM f WHERE keys IS NOT NULL ORDER BY line_no LIMIT 1)
    SELECT count(f.keys) AS row_count, count(*) FILTER (f.keys IS NULL) AS skipped, 'extra,id,type' AS columns,
           3 * count(f.keys) - CAST(sum(CASE WHEN m IN (1, 2) THEN 1 WHEN m = 0 THEN 0 ELSE 2 END) AS BIGINT) AS null_cells,
           count(*) FILTER (line_no >= 1000000000 AND m <> 0) AS duplicate_records,
           count(*) FILTER (f.keys <> first.keys) AS different_keys, sha256('extra|id|type') AS schema_hash FROM f, first""")
def src_validate_json(spark, sf):
    return R.validate_records(load(spark, sf, "json_lines")).withColumn("columns", F.array_join("columns", ","))


@register("src_validate_file", """SELECT (SELECT count(*) FROM documents) AS row_count, 0 AS skipped, 'lang,text' AS columns,
    0 AS null_cells, (SELECT count(*) - count(DISTINCT lang || '|' || text) FROM documents) AS duplicate_records,
    0 AS different_keys""")
def src_validate_file(spark, sf):
    path = written(spark, load(spark, sf, "documents").select(F.to_json(F.struct("lang", "text")).alias("value")), ".jsonl")
    return Fl.validate_file(spark, path).withColumn("columns", F.array_join("columns", ",")).drop("schema_hash")


HASH = "sha256(array_to_string(list_sort(string_split(columns_csv, ',')), '|'))"


@register("src_schema_hash", f"""SELECT dataset_id, version_number, {HASH} AS schema_hash,
    coalesce({HASH} <> lag({HASH}) OVER (PARTITION BY dataset_id ORDER BY version_number), false) AS drift FROM versions""")
def src_schema_hash(spark, sf):
    hashed = load(spark, sf, "versions").select("dataset_id", "version_number", D.schema_hash(
        F.split(F.upper("columns_csv"), ",")).alias("schema_hash"))
    out = with_neighbors(hashed, "schema_hash", [F.col("version_number")], ["dataset_id"])
    return out.select("dataset_id", "version_number", "schema_hash",
                      F.coalesce(F.col("schema_hash") != F.col("prev_id"), F.lit(False)).alias("drift"))


@register("src_column_values", """SELECT value, true AS truncated FROM (SELECT p_type AS value, min(p_partkey) AS k FROM part
    GROUP BY p_type ORDER BY k, value LIMIT 5) v""")
def src_column_values(spark, sf):
    return Fl.column_values(load(spark, sf, "part"), "p_type", "p_partkey", 5)


@register("src_column_range", """SELECT round(min(p_retailprice), 4) AS min, round(max(p_retailprice), 4) AS max,
    round(avg(p_retailprice), 4) AS mean FROM part""")
def src_column_range(spark, sf):
    return Fl.column_range(load(spark, sf, "part"), "p_retailprice")


@register("src_preview", "SELECT *, true AS truncated FROM customer ORDER BY c_custkey LIMIT 10")
def src_preview(spark, sf):
    df = load(spark, sf, "customer")
    return Fl.preview(df, "c_custkey", 10, df.count())


@register("src_image_meta", """SELECT vec_id, name, format, CAST(width AS INT) AS width, CAST(height AS INT) AS height,
    CAST(channels AS INT) AS channels, mode, CASE WHEN vec_id % 6 = 0 THEN 'unsupported extension'
         WHEN vec_id % 5 = 0 THEN 'unreadable image' END AS problem
    FROM (SELECT vec_id, 'v' || vec_id || CASE WHEN vec_id % 6 = 0 THEN '.txt' ELSE '.PNG' END AS name,
                 CASE WHEN vec_id % 5 <> 0 THEN 'PNG' END AS format, CASE WHEN vec_id % 5 <> 0 THEN 8 END AS width,
                 CASE WHEN vec_id % 5 <> 0 THEN len(embedding) // 8 END AS height, CASE WHEN vec_id % 5 <> 0 THEN 1 END AS channels,
                 CASE WHEN vec_id % 5 <> 0 THEN 'L' END AS mode FROM embeddings) e""")
def src_image_meta(spark, sf):
    images = png_images(load(spark, sf, "embeddings"))
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"), F.when(F.col("vec_id") % 6 == 0, ".txt").otherwise(".PNG"))
    broken = F.when(F.col("vec_id") % 5 == 0, F.substring("content", 1, 6)).otherwise(F.col("content"))
    return Fl.image_metadata(images.select("vec_id", name.alias("name"), broken.alias("content"))).drop("file_size")


@register("src_incremental", """SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)""")
def src_incremental(spark, sf):
    done = load(spark, sf, "labels").select("doc_id")
    return not_yet_embedded(load(spark, sf, "embeddings").select("vec_id"), done, "vec_id", "doc_id")


@register("exp_json_safe", """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '{"event_id":' || event_id || '}'
    ELSE '{"event_id":' || event_id || ',"v":' || event_id || '.0}' END AS document FROM events""")
def exp_json_safe(spark, sf):
    v = F.when(F.col("event_id") % 14 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 0, F.lit(float("inf")))
    df = load(spark, sf, "events").select(
        "event_id", v.otherwise(F.col("event_id").cast("double")).alias("v"))
    safe = Fl.json_safe(df)
    plain = F.when(F.col("v").isNotNull(), F.col("v").cast(T.DecimalType(21, 1)))
    return safe.select("event_id", F.to_json(F.struct("event_id", plain.alias("v"))).alias("document"))
