"""Text documents and their annotations."""

from pyspark.sql import functions as F

from quillwork.functions.text import newlines
from quillwork.operators import documents as D
from quillwork.operators.ranking import store_pages

from .base import INPUTS, load, register

# Documents with windows line ends, blank-line blocks and stray NULs, made from the words of each text.
INPUTS["raw_texts"] = """
    SELECT doc_id, source AS dataset, concat('f', CAST(doc_id AS STRING), '.txt') AS name,
           CASE doc_id % 4 WHEN 0 THEN replace(text, '. ', concat('.', chr(13), chr(10), ' ', chr(13), chr(10)))
                WHEN 1 THEN concat(chr(10), chr(10), replace(text, ', ', concat(chr(13), ' ')), chr(10), chr(10), chr(10))
                WHEN 2 THEN '   ' ELSE text END AS content
    FROM {documents}"""

NORMAL = "regexp_replace(replace(content, chr(0), ''), '\\r\\n?', chr(10), 'g')"
STRIP = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"
BLOCKS = (f"list_filter(list_transform(string_split_regex({NORMAL}, '\\n\\s*\\n+'), lambda p: {STRIP.format('p')}), "
          "lambda p: p <> '')")
LINES = f"list_filter(list_transform(string_split({NORMAL}, chr(10)), lambda p: {STRIP.format('p')}), lambda p: p <> '')"
WHOLE = f"CASE WHEN {STRIP.format(NORMAL)} <> '' THEN [{NORMAL}] ELSE CAST([] AS VARCHAR[]) END"
AUTO = f"CASE WHEN len({BLOCKS}) >= 3 THEN {BLOCKS} ELSE {WHOLE} END"


def raw(spark, sf):
    return load(spark, sf, "raw_texts")


def docs(spark, sf):
    return load(spark, sf, "text_docs")


def spans(spark, sf):
    return load(spark, sf, "text_spans")


@register("txt_newlines", f"SELECT doc_id, md5({NORMAL}) AS content FROM raw_texts")
def txt_newlines(spark, sf):
    return raw(spark, sf).select("doc_id", F.md5(newlines(F.col("content"))).alias("content"))


def splitter(strategy: str, sql: str):
    @register(f"txt_split_{strategy.split('_')[0]}", f"""
        SELECT doc_id, CAST(i - 1 AS INT) AS position, md5(p[i]) AS piece
        FROM (SELECT doc_id, {sql} AS p FROM raw_texts) x, unnest(range(1, len(p) + 1)) u(i)""")
    def run(spark, sf):
        out = D.pieces(raw(spark, sf).select("doc_id", "content"), "content", strategy)
        return out.select("doc_id", "position", F.md5("piece").alias("piece"))


for _s, _q in (("blank_line", BLOCKS), ("line", LINES), ("file", WHOLE), ("auto", AUTO)):
    splitter(_s, _q)


@register("txt_build_documents", f"""
    WITH p AS (SELECT doc_id, name, {AUTO} AS p FROM raw_texts),
    o AS (SELECT *, CAST(sum(len(p)) OVER (ORDER BY doc_id) - len(p) AS BIGINT) + 100 AS first FROM p)
    SELECT first + i - 1 AS doc_index, doc_id AS file_no, CASE WHEN len(p) = 1 THEN name ELSE name || ' · ' || i END AS name,
           md5(p[i]) AS content, length(p[i]) AS char_count, 'unlabeled' AS status
    FROM o, unnest(range(1, len(p) + 1)) u(i)""")
def txt_build_documents(spark, sf):
    files = raw(spark, sf).select(F.col("doc_id").alias("file_no"), "name", "content")
    return D.build_documents(files, "auto", 100).withColumn("content", F.md5("content"))


@register("txt_preview", f"""SELECT doc_id, substr(regexp_replace({STRIP.format('text')}, '\\s+', ' ', 'g'), 1, 180) AS preview
    FROM documents""")
def txt_preview(spark, sf):
    return load(spark, sf, "documents").select("doc_id", D.preview_text(F.col("text")).alias("preview"))


LABELED = "(SELECT doc_id FROM text_spans)"


@register("txt_search", f"""SELECT doc_id, name FROM text_docs WHERE doc_id IN {LABELED}
    AND (contains(lower(name), 'the%') OR contains(lower(content), 'water'))""")
def txt_search(spark, sf):
    found = D.search(D.with_status(docs(spark, sf), spans(spark, sf)), "WATER", "labeled")
    return found.select("doc_id", "name")


TEXT_PAGE = f"""
    WITH page AS (SELECT * FROM text_docs WHERE contains(lower(name || content), 'e') ORDER BY doc_index LIMIT 100 OFFSET 50)
    SELECT doc_id, doc_index, name, length(content) AS char_count,
           substr(regexp_replace({STRIP.format('content')}, '\\s+', ' ', 'g'), 1, 180) AS preview,
           coalesce((SELECT string_agg(class_name || ':' || n, ',' ORDER BY class_name) FROM (SELECT class_name, count(*) AS n
                     FROM text_spans s WHERE s.doc_id = page.doc_id AND kind = 'doc' GROUP BY class_name) l), '') AS labels,
           (SELECT count(*) FROM text_spans s WHERE s.doc_id = page.doc_id AND kind = 'span') AS span_count
    FROM page"""


@register("txt_list_stored", TEXT_PAGE)
def txt_list_stored(spark, sf):
    found = D.search(docs(spark, sf), "e")
    out = D.listing(found, spans(spark, sf), 50, 100, store_pages(found, D.IN_ORDER, rows_per_part=60))
    return out.withColumn("labels", F.array_join("labels", ","))


@register("txt_list", TEXT_PAGE)
def txt_list(spark, sf):
    out = D.listing(D.search(docs(spark, sf), "e"), spans(spark, sf), 50, 100)
    return out.withColumn("labels", F.array_join("labels", ","))


@register("txt_neighbors", """SELECT dataset, doc_index, doc_id, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id
    FROM text_docs WINDOW w AS (PARTITION BY dataset ORDER BY doc_index)""")
def txt_neighbors(spark, sf):
    return D.neighbors(docs(spark, sf))


@register("txt_neighbors_turns", """SELECT conv_id, turn, md5(text) AS doc, lag(md5(text)) OVER w AS prev_id,
    lead(md5(text)) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def txt_neighbors_turns(spark, sf):
    turns = load(spark, sf, "conversations").withColumn("doc", F.md5("text"))
    return D.neighbors(turns, "doc", "conv_id", "turn")


@register("txt_summary", f"""SELECT count(*) AS total, count(*) FILTER (doc_id IN {LABELED}) AS labeled,
    count(*) FILTER (doc_id NOT IN {LABELED}) AS unlabeled,
    (SELECT count(*) FROM text_spans WHERE kind = 'span') AS spans FROM text_docs""")
def txt_summary(spark, sf):
    return D.summary(docs(spark, sf), spans(spark, sf))


@register("txt_class_counts", "SELECT class_name, count(*) AS count FROM text_spans GROUP BY class_name")
def txt_class_counts(spark, sf):
    return D.class_counts(spans(spark, sf))


INPUTS["bad_spans"] = """
    SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'foreign' ELSE class_name END AS class_name, kind,
           CASE WHEN kind = 'doc' AND doc_id % 6 = 0 THEN CAST(1 AS BIGINT) WHEN doc_id % 10 = 0 THEN CAST(-1 AS BIGINT) + start_offset
                ELSE start_offset END AS start_offset,
           CASE WHEN doc_id % 7 = 0 THEN end_offset * 1000 ELSE end_offset END AS end_offset, seq
    FROM {text_spans}"""
INPUTS["text_classes"] = "SELECT DISTINCT class_name AS name FROM {text_spans}"


@register("txt_validate_spans", """
    SELECT a.*, CASE WHEN class_name = 'foreign' THEN 'foreign class'
           WHEN kind = 'span' AND NOT coalesce(start_offset >= 0 AND start_offset < end_offset AND end_offset <= length(content), false)
           THEN 'bad offsets' WHEN kind = 'doc' AND (start_offset IS NOT NULL OR end_offset IS NOT NULL)
           THEN 'offsets on a doc label' END AS reason
    FROM bad_spans a JOIN text_docs d USING (doc_id)""")
def txt_validate_spans(spark, sf):
    return D.validate_annotations(load(spark, sf, "bad_spans"), docs(spark, sf), load(spark, sf, "text_classes"))


@register("txt_snippets", """SELECT s.doc_id, class_name, kind, start_offset, end_offset, seq,
    substr(content, start_offset + 1, least(end_offset - start_offset, 200)) AS snippet
    FROM text_spans s JOIN text_docs d USING (doc_id) WHERE kind = 'span'""")
def txt_snippets(spark, sf):
    return D.snippets(spans(spark, sf), docs(spark, sf))


@register("txt_replace_annotations", """
    WITH n AS (SELECT * FROM text_spans WHERE doc_id % 5 <> 0 UNION ALL
               SELECT doc_id, 'fresh', 'doc', NULL, NULL, doc_id FROM documents WHERE doc_id % 10 = 0)
    SELECT d.doc_id, count(n.doc_id) AS annotations, CASE WHEN count(n.doc_id) > 0 THEN 'labeled' ELSE 'unlabeled' END AS status
    FROM documents d LEFT JOIN n USING (doc_id) GROUP BY d.doc_id""")
def txt_replace_annotations(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    none = F.lit(None).cast("long")
    fresh = d.filter("doc_id % 10 = 0").select(
        "doc_id", F.lit("fresh").alias("class_name"), F.lit("doc").alias("kind"), none.alias("start_offset"),
        none.alias("end_offset"), F.col("doc_id").alias("seq"))
    after = D.replace_annotations(spans(spark, sf), fresh, d.filter("doc_id % 5 = 0"))
    counts = after.groupBy("doc_id").agg(F.count("*").alias("annotations"))
    return D.with_status(d, after).join(counts, "doc_id", "left").select(
        "doc_id", F.coalesce("annotations", F.lit(0)).alias("annotations"), "status")


PIECES = """
    l AS (SELECT doc_id, 1 AS place, seq, class_name AS label, row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 AS first
          FROM text_spans WHERE kind = 'doc'),
    s AS (SELECT doc_id, 3 AS place, seq, start_offset, end_offset, class_name AS label,
                 CAST(json_object('start', start_offset, 'end', end_offset, 'label', class_name) AS VARCHAR) AS span,
                 row_number() OVER (PARTITION BY doc_id ORDER BY seq) = 1 AS first FROM text_spans WHERE kind = 'span'),
    t AS (SELECT *, CAST(to_json(name) AS VARCHAR) AS jname, CAST(to_json(content) AS VARCHAR) AS jtext FROM text_docs)"""


def pieces_sql(head: str, label: str, glue: str, middle: str, span: str, end: str) -> str:
    """The pieces of a record in SQL; empty ``label`` or ``middle`` leave that part out."""
    none = "CAST(NULL AS BIGINT)"
    rows = [f"SELECT doc_index, 0 AS place, {none} AS seq, {head} AS line FROM t"]
    if label:
        rows.append(f"SELECT doc_index, place, seq, CASE WHEN first THEN '' ELSE '{glue}' END || {label} FROM t JOIN l USING (doc_id)")
    if middle:
        rows.append(f"SELECT doc_index, 2, {none}, '{middle}' FROM t")
    rows.append(f"SELECT doc_index, place, seq, CASE WHEN first THEN '' ELSE ',' END || {span} FROM t JOIN s USING (doc_id)")
    rows.append(f"SELECT doc_index, 4, {none}, '{end}' FROM t")
    return f"WITH {PIECES} " + " UNION ALL ".join(rows)


@register("txt_export_jsonl", pieces_sql("""'{"name":' || jname || ',"text":' || jtext || ',"labels":['""", "CAST(to_json(label) AS VARCHAR)",
                                         ",", '],"spans":[', "span", "]}"))
def txt_export_jsonl(spark, sf):
    return D.export_jsonl(docs(spark, sf), spans(spark, sf))


@register("txt_export_csv", pieces_sql("""'"' || replace(name, '"', '""') || '","' || replace(content, '"', '""') || '","'""",
                                       """replace(label, '"', '""')""", "|", '","[', """replace(span, '"', '""')""", ']"'))
def txt_export_csv(spark, sf):
    return D.export_csv(docs(spark, sf), spans(spark, sf))


@register("txt_export_spans", pieces_sql("""'{"text":' || jtext || ',"entities":['""", "", ",", "",
                                         """'[' || start_offset || ',' || end_offset || ',"' || label || '"]'""", "]}"))
def txt_export_spans(spark, sf):
    return D.export_spans(docs(spark, sf), spans(spark, sf))
