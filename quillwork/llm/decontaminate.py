"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

A benchmark item is cut into windows of consecutive words, the size of a match. A window's shingles (short word
sequences) are ordered by how rare they are in the corpus. As a match must contain the whole window, one shingle is
the necessary prefix: the rarest. Documents are joined on that shingle alone; the shingle's place in the window gives
the place where the window would have to begin, positional and length bounds drop what would not fit, and the words
are compared exactly. Windows with a shingle that the corpus does not have are dropped before the join.

Everything is DataFrame functions. The side of windows is broadcast only below a checked number of rows; beyond it
the optimizer shuffles (document, position, hash) rows and the words are fetched for candidates only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column, free_names, lower_ascii, register, stored, table

BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what separates words


def words_of(text: Column) -> Column:
    """Lower-cased words; splitting and dropping the empty ends is several times faster than extracting matches."""
    return F.coalesce(F.array_remove(F.split(lower_ascii(text), BETWEEN), ""), F.array().cast("array<string>"))


def _shingle(words: str, at: str, size: int) -> str:
    return "xxhash64(" + ", ".join(f"get({words}, {at} + {i})" for i in range(size)) + ")"


def item_windows(items: DataFrame, text: str, window: int) -> DataFrame:
    """(win, n): the distinct windows of all items; an item of fewer words, but not none, is one window."""
    words = items.select(words_of(column(text)).alias("words")).filter("size(words) > 0")
    starts = words.select("words", F.explode(F.expr(f"sequence(1, greatest(size(words) - {window} + 1, 1))")).alias("at"))
    return starts.select(F.expr(f"slice(words, at, {window})").alias("win")).distinct().withColumn("n", F.size("win"))


def _shingled_docs(docs: DataFrame, sizes: list[int], carry: list[str]) -> DataFrame:
    """(carried columns, pos, k, h) for every shingle of every document, one scan for each shingle size."""
    out = None
    for k in sizes:
        rows = docs.select(*carry, "words", F.posexplode("words").alias("pos", "word")).filter(
            F.expr(f"pos + {k} <= size(words)"))
        rows = rows.select(*carry, "words", "pos", F.lit(k).alias("k"), F.expr(_shingle("words", "pos", k)).alias("h"))
        out = rows if out is None else out.unionByName(rows)
    return out


def find_windows(docs: DataFrame, items: DataFrame, doc_key: list[str], text: str = "text", window: int = 10,
                 shingle: int = 3, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc_key, start, n, win): every place of a document where a window of an item occurs; start counts from 0.

    Beyond ``broadcast_rows`` windows the same rows come by a shuffle. Keys may be null and have any names; rows with the
    same key and words may give a place several times.
    """
    windows = stored(item_windows(items, text, window), "windows")
    sizes = sorted({min(shingle, r.n) for r in windows.select("n").distinct().collect()})  # at most `shingle` values
    inner = [f"__key{i}" for i in range(len(doc_key))]  # whatever the key is called
    words = docs.select(*[column(c).alias(i) for i, c in zip(inner, doc_key)], words_of(column(text)).alias("words"))
    if not sizes:
        return words.limit(0).select(*[F.col(i).alias(c) for i, c in zip(inner, doc_key)], F.lit(0).alias("start"), F.lit(0).alias("n"), F.col("words").alias("win"))

    def sized(side: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(side) if rows <= broadcast_rows else side

    parts = None
    for k in sizes:
        at_k = windows.filter(F.least(F.col("n"), F.lit(shingle)) == k).select(
            "win", "n", F.explode(F.expr(f"sequence(0, n - {k})")).alias("p"))
        at_k = at_k.select("win", "n", "p", F.lit(k).alias("k"), F.expr(_shingle("win", "p", k)).alias("h"))
        parts = at_k if parts is None else parts.unionByName(at_k)
    parts = stored(parts, "window-shingles")
    wanted = parts.select("k", "h").distinct()
    seen = _shingled_docs(words, sizes, []).select("k", "h").join(sized(wanted, parts.count()), ["k", "h"])
    rarity = seen.groupBy("k", "h").agg(F.count("*").alias("freq"))
    ranked = parts.join(rarity, ["k", "h"], "left").groupBy("win", "n").agg(
        F.min(F.coalesce("freq", F.lit(0))).alias("least"),
        F.min_by(F.struct("k", "h", "p"), F.struct(F.coalesce("freq", F.lit(0)), "p")).alias("rarest"))
    prefix = stored(ranked.filter("least > 0").select("win", "n", "rarest.*"), "prefixes")

    n_prefix = prefix.count()
    if n_prefix <= broadcast_rows:
        near = _shingled_docs(words, sizes, inner).join(F.broadcast(prefix), ["k", "h"])
    else:  # narrow rows travel; the words come back for candidates, a null key for a null key
        near = _shingled_docs(words, sizes, inner).select(*inner, "pos", "k", "h").join(prefix, ["k", "h"])
        near = near.filter("pos >= p").select(*[F.col(c).alias(f"{c}_") for c in inner], "pos", "p", "n", "win").distinct()
        same_key = F.lit(True)
        for c in inner:
            same_key = same_key & F.col(c).eqNullSafe(F.col(f"{c}_"))
        near = near.join(words, same_key)
    fits = near.filter("pos >= p and pos - p + n <= size(words)")
    same = fits.filter(F.expr("slice(words, pos - p + 1, n) = win"))
    return same.select(*[F.col(i).alias(c) for i, c in zip(inner, doc_key)], F.expr("pos - p").alias("start"), "n", "win")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", window: int = 10, shingle: int = 3) -> DataFrame:
    """Per row of ``docs``: its columns plus ``n_words``, ``n_hit``, ``spans`` (start, n) and ``item_ids``.

    ``spans`` are the places where a window of an item occurs, ``n_hit`` the words inside any of them, ``item_ids``
    the items with an occurring window, sorted as strings. Null texts and texts without words have no hits; items
    without words and null item texts never match; a null item_id is left out of the list. Rows repeated with the
    same id and text get the same result each; rows that share an id but not the text are told apart by a digest.
    """
    new = ("n_words", "n_hit", "spans", "item_ids")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    kid, digest, hit_id, hit_digest, n_words, spans_of, ids_of = free_names(
        docs, "__id", "__digest", "__hit_id", "__hit_digest", "__n_words", "__spans", "__item_ids")
    keyed = docs.withColumn(kid, column(doc_id)).withColumn(digest, F.xxhash64(column(text)))
    key = [kid, digest]
    hits = stored(find_windows(keyed, items, key, text, window, shingle), "hits")
    owners = items.select(column(item_id).cast("string").alias("item"), words_of(column(text)).alias("words")).filter(
        "size(words) > 0 and item is not null")
    owners = owners.select("item", F.explode(F.expr(
        f"transform(sequence(1, greatest(size(words) - {window} + 1, 1)), i -> slice(words, i, {window}))")).alias("win"))
    found = hits.select(*key, "win").distinct().join(owners, "win").select(*key, "item").distinct()
    items_of = found.groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    spans = hits.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("start", "n"))).alias("spans"))
    per_doc = spans.join(items_of, spans[kid].eqNullSafe(items_of[kid]) & (spans[digest] == items_of[digest]), "left").select(
        spans[kid].alias(hit_id), spans[digest].alias(hit_digest), F.col("spans").alias(spans_of),
        F.col("item_ids").alias(ids_of))
    covered = F.expr(f"aggregate({spans_of}, named_struct('hit', 0, 'upto', 0), (a, s) -> named_struct("
                     "'hit', a.hit + greatest(0, s.start + s.n - greatest(a.upto, s.start)), "
                     "'upto', greatest(a.upto, s.start + s.n)), a -> a.hit)")
    base = keyed.withColumn(n_words, F.size(words_of(column(text))).cast("long"))
    joined = base.join(per_doc, base[kid].eqNullSafe(per_doc[hit_id]) & (base[digest] == per_doc[hit_digest]), "left")
    return joined.select(
        *[column(c) for c in docs.columns], F.col(n_words).alias("n_words"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(spans_of, F.array().cast("array<struct<start:int,n:int>>")).alias("spans"),
        F.coalesce(ids_of, F.array().cast("array<string>")).alias("item_ids"))


_SQL = r"""
WITH dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM wins),
cand AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(i)),
hits AS (SELECT doc_id, i, n, win FROM cand WHERE win IN (SELECT win FROM wins)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN wins USING (win, n)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


@register("op6_decontaminate", _SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
                      (F.col("n_hit") > 0).alias("contaminated"))
