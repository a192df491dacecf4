"""The pipeline's stages, one after the other, beside a plain version of each."""

import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from helpers import DOCS, raw
from pyspark.sql import functions as F
from test_corpus_operators import Union, plain_lines

import corpus_pipeline as P
from quillwork.llm import byte_bpe, simhash, toxicity
from quillwork.llm.base import table

SF = "/root/testdata/sf0.001"


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return "".join(c if c >= "\x80" or c.isdigit() or "a" <= c <= "z" else " " for c in lowered).split(" ")


def windows(text):
    words = [w for w in plain_words(text) if w]
    return {tuple(words[i:i + 10]) for i in range(max(1, len(words) - 9))} if words else set()


def test_stages_match_plain_versions(spark):
    docs = table(spark, SF, "documents").filter("doc_id < 110").unionByName(
        raw(spark, [(5000, "A text of its own that stays as it is, line by line."), (5001, None), (5002, "")]))
    rows = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(P.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "simhash", "decontamination", "byte_bpe"]

    lexicon = toxicity.train(docs, table(spark, SF, "labels"))
    scores = dict(zip(rows, (s[1] for s in toxicity.score_texts(rows.values(), lexicon))))
    rows = {i: t for i, t in rows.items() if scores[i] == 0}
    docs = spark.createDataFrame(stages["toxicity"](spark, docs, SF).collect(), DOCS)
    assert {r.doc_id: r.text for r in docs.collect()} == rows and docs.columns == [f.name for f in DOCS.fields]

    rows = plain_lines(list(rows.items()))
    docs = spark.createDataFrame(stages["line_dedup"](spark, docs, SF).collect(), DOCS)
    found = docs.collect()
    assert {r.doc_id: r.text for r in found} == rows
    assert all(r.n_chars == len(r.text) for r in found if r.text and r.doc_id < 5000)

    ids = sorted(rows)
    prints, groups = [simhash.fingerprint(rows[i]) for i in ids], Union(len(ids))
    for a in range(len(ids)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                groups.join(a, b)
    rows = {i: rows[i] for n, i in enumerate(ids) if groups.find(n) == n}
    docs = spark.createDataFrame(stages["simhash"](spark, docs, SF).collect(), DOCS)
    assert {r.doc_id: r.text for r in docs.collect()} == rows

    leaked = set().union(*(windows(r.text) for r in table(spark, SF, "benchmark").collect()))
    shortest = {len(w) for w in leaked}
    assert shortest == {10}  # so windows of ten words decide
    rows = {i: t for i, t in rows.items() if not windows(t) & leaked}
    docs = spark.createDataFrame(stages["decontamination"](spark, docs, SF).collect(), DOCS)
    assert {r.doc_id: r.text for r in docs.collect()} == rows and 5000 in rows

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                            mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    out = stages["byte_bpe"](spark, docs, SF).collect()
    assert {r.doc_id for r in out} == set(rows)
    for r in out:
        text = rows[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text)
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_one_of_repeated_rows_stays(spark):
    text = "Three rows that are all the same document in every column."
    docs = raw(spark, [(7, text), (7, text), (9, text), (None, text), (None, "alone and without an id"), (8, "something else entirely here")])
    kept = P.drop_near_duplicates(spark, docs.withColumn("extra", F.lit("x")), SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(7, text), (8, "something else entirely here")]
    assert [r.text for r in kept if r.doc_id is None] == ["alone and without an id"]


def test_empty_documents(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0


def test_run_returns_tokens(spark):
    out = P.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert 0 < out.count() <= table(spark, SF, "documents").count()
