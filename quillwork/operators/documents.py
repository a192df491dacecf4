"""Text documents: splitting, listing, annotation checks, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, is_blank, json_text, newlines, strip
from ..scratch import balance, materialise
from ..sinks import pieces as P
from .ranking import Pages, page, with_neighbors, with_running_total

SNIPPET_CHARS = 200
PREVIEW_CHARS = 180


# ---- splitting ----------------------------------------------------------------------------------

def _stripped(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_blank(text: Column) -> Column:
    return _stripped(F.split(text, r"\n\s*\n+"))


def split_line(text: Column) -> Column:
    return _stripped(F.split(text, r"\n"))


def split_file(text: Column) -> Column:
    return F.when(~is_blank(text), F.array(text)).otherwise(F.array().cast("array<string>"))


def split_auto(text: Column) -> Column:
    blocks = split_blank(text)
    return F.when(F.size(blocks) >= 3, blocks).otherwise(split_file(text))


SPLITTERS = {"blank_line": split_blank, "line": split_line, "file": split_file, "auto": split_auto}


def pieces(df: DataFrame, text: str, strategy: str) -> DataFrame:
    """``df`` without ``text`` plus (position, piece, of): one row per piece."""
    cut = balance(df).withColumn("_pieces", SPLITTERS[strategy](newlines(F.col(text)))).drop(text)
    # The outer form keeps the optimizer from testing the size below, which would split every text twice.
    flat = cut.select(*[c for c in cut.columns if c != "_pieces"], F.size("_pieces").alias("of"),
                      F.posexplode_outer("_pieces").alias("position", "piece"))
    return flat.filter("position is not null")


def build_documents(files: DataFrame, strategy: str = "auto", start_index: int = 0,
                    order_by: str = "file_no") -> DataFrame:
    """(doc_index, file_no, name, content, char_count, status) from files (file_no, name, content).

    Only (file_no, number of pieces) is ranked globally; the text itself moves once, in the join.
    """
    split = SPLITTERS[strategy]
    counts = balance(files).select(order_by, F.size(split(newlines(F.col("content")))).cast("long").alias("n"))
    # Written first: the range partitioning below samples its input, which would split every text again.
    counts = materialise(counts, "counts")
    upto = with_running_total(counts, "n", [F.col(order_by)], name="upto")
    offsets = upto.select(order_by, (F.col("upto") - F.col("n") + start_index).alias("offset"))
    flat = pieces(files, "content", strategy).join(offsets, order_by)
    number = F.when(F.col("of") == 1, F.col("name")).otherwise(
        F.concat("name", F.lit(" · "), (F.col("position") + 1).cast("string")))
    return flat.select((F.col("offset") + F.col("position")).alias("doc_index"), order_by,
                       F.substring(number, 1, 512).alias("name"), F.col("piece").alias("content"),
                       F.length("piece").alias("char_count"), F.lit("unlabeled").alias("status"))


def preview_text(text: Column) -> Column:
    return F.substring(collapse(text), 1, PREVIEW_CHARS)


# ---- listing ------------------------------------------------------------------------------------

def with_status(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Documents with status ``labeled`` where any annotation exists."""
    marked = annotations.select("doc_id").distinct().withColumn("_m", F.lit(True))
    return docs.join(marked, "doc_id", "left").withColumn(
        "status", F.when(F.col("_m"), "labeled").otherwise("unlabeled")).drop("_m")


def search(docs: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Case-insensitive literal search in name or content, optionally by status."""
    if q:
        needle = F.lower(F.lit(q))
        docs = docs.filter(F.contains(F.lower("name"), needle) | F.contains(F.lower("content"), needle))
    if status:
        docs = docs.filter(F.col("status") == status)
    return docs


IN_ORDER = ["doc_index", "doc_id"]


def listing(docs: DataFrame, annotations: DataFrame, skip: int = 0, limit: int = 50, pages: Pages | None = None) -> DataFrame:
    """One page with preview, doc labels (each with its count) and span count.

    The page is cut first and is at most ``limit`` (200) rows, so it is the broadcast side.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must be 1..200")
    shown = page(docs, IN_ORDER, skip, limit, "doc_id", pages)
    keys = F.broadcast(shown.select("doc_id"))
    found = annotations.join(keys, "doc_id", "left_semi")
    by_class = found.groupBy("doc_id", "class_name").agg(
        F.count_if(F.col("kind") == "doc").alias("docs"), F.count_if(F.col("kind") == "span").alias("spans"))
    facts = by_class.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("docs") > 0, F.concat_ws(":", "class_name", "docs")))).alias("labels"),
        F.sum("spans").alias("span_count"))  # at most one entry per class
    return shown.join(facts, "doc_id", "left").select(
        "doc_id", "doc_index", "name", F.length("content").alias("char_count"),
        preview_text(F.col("content")).alias("preview"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce("span_count", F.lit(0)).alias("span_count"))


def neighbors(docs: DataFrame, doc_id: str = "doc_id", dataset: str = "dataset",
              doc_index: str = "doc_index") -> DataFrame:
    """(dataset, doc_index, doc_id, prev_id, next_id) within each dataset, however large it is."""
    return with_neighbors(docs.select(dataset, doc_index, doc_id), doc_id, [F.col(doc_index)], [dataset])


def summary(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(total, labeled, unlabeled, spans)."""
    states = with_status(docs.select("doc_id"), annotations).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "labeled").alias("labeled"))
    spans = annotations.agg(F.count_if(F.col("kind") == "span").alias("spans"))
    both = states.unionByName(spans, allowMissingColumns=True)
    both = both.agg(*[F.max(c).alias(c) for c in ("total", "labeled", "spans")])
    return both.select("total", "labeled", (F.col("total") - F.col("labeled")).alias("unlabeled"), "spans")


def class_counts(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("class_name").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "class_name")


# ---- annotations --------------------------------------------------------------------------------

def validate_annotations(annotations: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Annotations plus ``reason`` (NULL when valid). Only the length of each document travels."""
    lengths = docs.select(F.col("doc_id").alias("_d"), F.length("content").alias("_length"))
    names = classes.select(F.col("name").alias("_c")).distinct()
    start, end = F.col("start_offset"), F.col("end_offset")
    ok = (start >= 0) & (start < end) & (end <= F.col("_length"))
    reason = (F.when(F.col("_d").isNull(), "unknown document").when(F.col("_c").isNull(), "foreign class")
              .when((F.col("kind") == "span") & ~F.coalesce(ok, F.lit(False)), "bad offsets")
              .when((F.col("kind") == "doc") & (start.isNotNull() | end.isNotNull()), "offsets on a doc label"))
    return (annotations.join(lengths, F.col("doc_id") == F.col("_d"), "left")
            .join(names, F.col("class_name") == F.col("_c"), "left")
            .withColumn("reason", reason).drop("_d", "_length", "_c"))


def snippets(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans with the text they cover, at most 200 characters; offsets count code points."""
    spans = annotations.filter("kind = 'span'")
    cut = F.substring(F.col("content"), F.col("start_offset").cast("int") + 1,
                      F.least(F.col("end_offset") - F.col("start_offset"), F.lit(SNIPPET_CHARS)).cast("int"))
    return spans.join(docs.select("doc_id", "content"), "doc_id").withColumn("snippet", cut).drop("content")


def replace_annotations(current: DataFrame, replacement: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """All annotations of the named documents give way to the replacement rows."""
    return current.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(replacement)


# ---- exports ------------------------------------------------------------------------------------

def _lists(docs: DataFrame, annotations: DataFrame, label: Column, span: Column, glue: str
           ) -> tuple[DataFrame, DataFrame]:
    """Pieces of the labels (place 1) and of the spans (place 3) of each document."""
    owners = docs.select("doc_id", "doc_index")
    marks = annotations.withColumns({"start": F.col("start_offset"), "end": F.col("end_offset"), "label": F.col("class_name")})
    labels = marks.filter("kind = 'doc'").select("doc_id", "seq", label.alias("line"))
    spans = marks.filter("kind = 'span'").select("doc_id", "seq", span.alias("line"))
    return (P.body(owners, P.separated(labels, "doc_id", glue), "doc_id", 1, "doc_index"),
            P.body(owners, P.separated(spans, "doc_id"), "doc_id", 3, "doc_index"))


def _span_json() -> Column:
    return F.to_json(F.struct("start", "end", "label"))


def export_jsonl(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_index, place, seq, line): pieces of ``{name,text,labels,spans}``, one record a document."""
    labels, spans = _lists(docs, annotations, json_text(F.col("label")), _span_json(), ",")
    head = F.concat(F.lit('{"name":'), json_text(F.col("name")), F.lit(',"text":'), json_text(F.col("content")), F.lit(',"labels":['))
    return P.joined(P.frame(docs, 0, head, "doc_index"), labels, P.frame(docs, 2, F.lit('],"spans":['), "doc_index"), spans,
                    P.frame(docs, 4, F.lit("]}"), "doc_index"))


def export_csv(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_index, place, seq, line): pieces of the quoted fields name, text, labels (joined by ``|``), spans (JSON)."""
    def inside(c: Column) -> Column:
        return F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""'))

    labels, spans = _lists(docs, annotations, inside(F.col("label")), inside(_span_json()), "|")
    head = F.concat(F.lit('"'), inside(F.col("name")), F.lit('","'), inside(F.col("content")), F.lit('","'))
    return P.joined(P.frame(docs, 0, head, "doc_index"), labels, P.frame(docs, 2, F.lit('","['), "doc_index"), spans,
                    P.frame(docs, 4, F.lit(']"'), "doc_index"))


def export_spans(docs: DataFrame, annotations: DataFrame) -> DataFrame:
    """(doc_index, place, seq, line): pieces of ``{text, entities: [[start, end, label]]}``, one record a document."""
    entity = F.concat(F.lit("["), F.col("start").cast("string"), F.lit(","), F.col("end").cast("string"), F.lit(","),
                      json_text(F.col("label")), F.lit("]"))
    _, spans = _lists(docs, annotations, F.col("label"), entity, ",")
    head = F.concat(F.lit('{"text":'), json_text(F.col("content")), F.lit(',"entities":['))
    return P.joined(P.frame(docs, 0, head, "doc_index"), spans, P.frame(docs, 4, F.lit("]}"), "doc_index"))
