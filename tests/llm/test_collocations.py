"""Phrase collocations: the trie beside a plain counter, and the query on odd texts beside plain Python."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD
from pyspark.sql import types as T

from quillwork.llm import collocations as col

ROWS = T.StructType([T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])


@pytest.mark.parametrize("length", [1, 2, 3])
def test_trie_counts_bursts_and_spills(length):
    rng = np.random.default_rng(length)
    trie, expected, got = col.HatTrie(length, full=64), Counter(), Counter()
    for step in range(6):
        words = (rng.zipf(1.3, (4000, length)) % 300).astype(np.int64)
        keys = words[:, 0]
        for k in range(1, length):
            keys = keys << col.BITS | words[:, k]
        expected.update(keys.tolist())
        trie.add(keys)
        assert trie.lows == sorted(set(trie.lows)) and all(c.used <= 64 for c in trie.containers)
        spilled = trie.spill(500 if step < 5 else 0)
        for key, n in zip(*spilled):
            got[int(key)] += int(n)
        assert len(trie) <= 500
    assert got == expected


def plain(rows, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or ("und" if lang is None else lang)
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f[lang].update(zip(*[words[i:] for i in range(k)]))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items()):
                continue
            cuts = [(1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):  # noqa: E741
            out.add((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return out


def rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)] + ["É", "the", "The", "x\x00", "日本", "\xa0"]
    ends = [" ", "\t", "  ", ". ", ",", "\n", "\x0b", "\r", " "]
    texts = ["".join(words[i] + ends[j] for i, j in zip(rng.zipf(1.5, 400) % 18, rng.integers(0, 9, 400))) for _ in range(12)]
    return [(t, lang) for i, t in enumerate([*texts, *ODD, texts[0]]) for lang in ("en", None if i % 2 else "fr")]


def test_odd_texts_match_a_plain_version(spark, monkeypatch):
    data = rows()
    table = spark.createDataFrame([(*r, 1) for r in data], T.StructType([*ROWS.fields, T.StructField("n", T.IntegerType())]))
    assert {tuple(r) for r in col.collocations(table).collect()} == plain(data)
    # many partitions, so that frequent words and pairs are split
    assert {tuple(r) for r in col.collocations(table.repartition(5), words_per_partition=40).collect()} == plain(data)
    assert {tuple(r) for r in col.collocations(table, top=5).collect()} == plain(data, top=5)
    assert col.collocations(spark.createDataFrame([], ROWS)).count() == 0


@pytest.mark.parametrize("small", [dict(WORDS=3), dict(PART=7), dict(PENDING=5, ENTRIES=8), dict(FULL=2)])
def test_runs_add_up_however_they_are_cut(monkeypatch, small):
    for name, value in small.items():
        monkeypatch.setattr(col, name, value)
    texts = [(t or "").encode() for t, _ in rows()[:30:2]]
    for length in (1, 2, 3):
        yes = b"\xff" * 64
        counter = col.Counter(length, 4, yes, yes, set())
        runs = [r for a in range(0, len(texts), 4) for r in counter.feed(b"en", texts[a:a + 4])] + list(counter.finish())
        got = Counter()
        for part in range(4):
            for lang, words, n in col.merged([r[1:] for r in runs if r[0] == part], length, 1) if any(r[0] == part for r in runs) else ():
                if words:
                    assert tuple(words) not in got
                    got[tuple(words)] = n
        expected = Counter()
        for text in texts:
            for piece in re.split(b"[.,;:!?\n-\r]", text.lower()):
                words = [w.decode() for w in re.findall(b"[^ \t]+", piece)]
                expected.update(zip(*[words[i:] for i in range(length)]))
        assert got == expected


def test_long_text_and_long_word():
    counter = col.Counter(2, 1, None, None, set())
    text = b"one two three " * 600_000 + b"x" * 5_000_000 + b" end"
    runs = [*counter.feed(b"en", [text]), *counter.finish()]
    found = {tuple(w): n for _, w, n in col.merged([r[1:] for r in runs], 2, 1)}
    assert found["one", "two"] == 600_000 and found["three", "one"] == 599_999 and len(found) == 5
