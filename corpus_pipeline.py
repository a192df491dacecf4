"""A corpus from raw documents to token ids, one operator after the other.

Every stage takes what its predecessor kept and returns the columns of ``documents``; the last one returns tokens.
``run`` writes each stage's rows to the shared checkpoint folder and reads them again, so a stage can be lost and
repeated on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.llm import byte_bpe, decontaminate, linededup, simhash, toxicity
from quillwork.llm.base import column, free_names, stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the lexicon is learned from a sample of the labelled ones.

    A null or empty text has no toxic word and stays, as do all documents where nothing is labelled; repeated rows share
    their fate, an empty table gives none, and columns of any name are kept.
    """
    lexicon = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxicity(docs, lexicon, keep=docs.columns)
    return scored.filter("predicted = 0").select(*[column(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line equals or resembles; n_chars follows the text.

    A null text stays null. Of equal rows all are kept with the same lines. An empty table gives none.
    """
    out = linededup.dedup_lines(docs)
    length = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*[length.alias(c) if c == "n_chars" else column(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of linked fingerprints.

    Rows that share an id are one document: one of them stays, the one with the smallest digest. Rows with a null id
    stay where no document with an id has a linked fingerprint.
    """
    key = free_names(docs, "__one", "__two", "__which")
    cells = [column(c) for c in docs.columns]
    # 128 bits and the id, so that different rows do not meet by chance
    rows = docs.withColumns(dict(zip(key, (F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells),
                                           F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    found = simhash.near_duplicates(rows, keep=key)
    first = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.min(F.struct(*key)).alias("key")).select("key.*")
    stays = first.unionByName(found.filter("doc_id is null and component_id is null").select(*key)).distinct()
    whole = F.struct(*cells).alias("row")
    once = rows.groupBy(*key).agg(F.first(whole).alias("row"))  # the same row several times, combined before the shuffle
    return once.join(stays, key, "left_semi").select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten consecutive words of a benchmark item.

    Texts without words (null, empty) stay, as do all where the benchmark is empty; repeated rows share their fate.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.filter("n_hit = 0").select(*[column(c) for c in docs.columns])


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and a digest of the text decoded from them.

    A null text is empty and has no ids; every row gives one, repeated rows equal ones, and an empty table none.
    """
    coded = byte_bpe.encode_decode(docs, keep=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("simhash", drop_near_duplicates),
          ("decontamination", drop_contaminated), ("byte_bpe", tokenize)]

#: Learned weights, MinHash and XXH64 have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}", "zstd")
    return docs
