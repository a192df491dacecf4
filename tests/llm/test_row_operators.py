"""Operators that look at one document at a time."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
import zstandard
from helpers import DOCS, ODD, documents, raw

from quillwork.llm import byte_bpe, language, quality_rules, toxicity
from quillwork.llm.base import table

SF = "/root/testdata/sf0.001"
BIG = "/root/testdata/sf0.01"


def plain_rules(text):
    """The counts, stated word by word."""
    text = text or ""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(line in lines[:i] and bool(line.strip(" \t\x0b\x0c\r")) for i, line in enumerate(lines))
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside),
            len(words) < 10 or 100 * len(inside) > 20 * len(words))


def test_quality_counts_match_a_plain_version(spark):
    texts = [*ODD, "a b c d e f " * 6, "## x | y <b>\n## x | y <b>\n\n\n", *[r.text for r in table(spark, SF, "documents").limit(120).collect()]]
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules.quality_rules(documents(spark, texts, extra="kept")).collect()}
    assert got == {i + 1: plain_rules(t) for i, t in enumerate(texts)}


def test_quality_bands(spark):
    rng = np.random.default_rng(1)
    noise = " ".join("".join(chr(33 + c) for c in rng.integers(0, 90, 12)) for _ in range(2000))
    loop = " ".join(f"tok{i % 7} and{i % 5} then{i % 3}" for i in range(3000))
    prose = [r.text for r in table(spark, SF, "documents").filter("n_chars > 400").limit(40).collect()]
    rows = quality_rules.quality_rules(documents(spark, [noise, loop, *prose])).orderBy("doc_id").collect()
    assert not rows[0].kept and not rows[1].kept
    assert all(r.kept for r in rows[2:] if not r.base_failed and r.ratio < 3)
    ratio = len(loop.encode()) / len(zstandard.ZstdCompressor(level=3).compress(loop.encode()))
    assert rows[1].ratio == pytest.approx(ratio)


def test_bpe_equals_tiktoken(spark):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*ODD, "  a  b ", "'s don't I'LL   x　y", "=" * 300 + " <|endoftext|>", "ab" * 200,
             *[r.text for r in table(spark, SF, "documents").limit(60).collect()]]
    for r in byte_bpe.encode_decode(documents(spark, texts), group_chars=5000).collect():
        text = texts[r.doc_id - 1] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == own.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode() and r.n_tokens == len(r.ids) // 4


def test_bpe_steps_are_cut_and_resumed():
    coder = byte_bpe.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, steps=3)
    ranks = coder.ranks
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "unquestionableness antidisestablishmentarianismly zzzzzzzzzzzzzzz"
    assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == own.encode_ordinary(text)


def test_language_held_out_accuracy(spark):
    docs = table(spark, BIG, "documents")
    seen = docs.filter("crc32(cast(doc_id as string)) % 3 <> 1")
    model = language.train(seen, per_language=400)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = language.identify(docs, model).collect()
    held = [(r.lang_pred, truth[r.doc_id]) for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and np.mean([a == b for a, b in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_texts(spark):
    model = language.train(table(spark, BIG, "documents"), per_language=60)
    got = {r.doc_id: r for r in language.identify(documents(spark, [*ODD, "123 !!"], extra="rejected"), model).collect()}
    letters = [t is not None and any(map(str.isalpha, t)) for t in [*ODD, "123 !!"]]
    assert [got[i + 1].lang_pred != "und" for i in range(len(letters))] == letters
    assert all(got[i + 1].score == 0 and got[i + 1].rejected for i, x in enumerate(letters) if not x)
    nothing = language.train(table(spark, BIG, "documents").limit(0))
    assert {r.lang_pred for r in language.identify(documents(spark, ODD), nothing).collect()} == {"und"}


def test_toxicity_held_out(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    lexicon = toxicity.train(docs, labels, per_label=1000)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, lexicon).collect()}
    held = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    clean = [got[r.doc_id].predicted for r in held if r.toxic == 0]
    assert np.mean(clean) < 0.05 and all(0 <= r.score <= 1 for r in got.values())
    bad = [got[r.doc_id].predicted for r in held if r.toxic == 1]
    assert np.mean(bad) > 0.6


def sample():
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + a)}{chr(97 + b)}x" for a in range(20) for b in range(20)]
    text = [" ".join(rng.choice(words, 60)) for _ in range(200)]
    toxic = [int(i % 2) for i in range(200)]
    text = [t + (" you idiot and loser" if y else " go to the clown fish") for t, y in zip(text, toxic)]
    return pd.DataFrame({"text": text, "toxic": toxic})


def test_toxicity_folding_and_exceptions():
    lexicon = toxicity.fit(sample(), terms={"clown": 6.0})
    texts = ["You 1d10t!", "уоu idiоt", "ＩＤＩＯＴ l0$er", "a clown fish swims here", "a clown swims here", "idiotic 100 l", None, ""]
    score = [r[0] for r in toxicity.score_texts(texts, lexicon)]
    assert min(score[0], score[1], score[2]) > 0.5
    assert score[3] == score[6] == score[7] < 0.5 and score[4] > score[3]


def test_toxicity_without_labels(spark):
    empty = table(spark, SF, "labels").limit(0)
    lexicon = toxicity.train(documents(spark, ODD), empty)
    assert {r.predicted for r in toxicity.toxicity(documents(spark, ODD, extra="weight"), lexicon).collect()} == {0}


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], DOCS)
    twice = raw(spark, [(1, "One two."), (1, "One two."), (None, None)])
    lexicon, model = toxicity.Lexicon({" two ": 3.0}), language.train(table(spark, SF, "documents"), per_language=20)
    for run in (quality_rules.quality_rules, byte_bpe.encode_decode, lambda d: language.identify(d, model),
                lambda d: toxicity.toxicity(d, lexicon)):
        assert run(none).count() == 0
        rows = [tuple(r) for r in run(twice).collect()]
        assert len(rows) == 3 and Counter(rows).most_common(1)[0][1] == 2


def test_digests(spark):
    row = byte_bpe.encode_decode(documents(spark, ["Hello world"])).collect()[0]
    assert hashlib.sha256(bytes(row.decoded)).hexdigest() == hashlib.sha256(b"Hello world").hexdigest()
