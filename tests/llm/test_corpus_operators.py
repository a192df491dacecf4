"""Operators that compare documents with each other, with rules, or with a benchmark."""

import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import DOCS, ODD, documents, raw
from oracle import compare, connect
from pyspark.sql import functions as F

from quillwork.llm import decontaminate, linededup, queries, sharding, simhash, suffix_dedup, urlfilter
from quillwork.llm.base import table
from quillwork.llm.samples import sample_by_label
from quillwork.llm.components import components, local_roots

SF = "/root/testdata/sf0.001"


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


# --- sharding -------------------------------------------------------------------------------------------------

def test_shards_are_exact_and_gapless(spark):
    docs = documents(spark, [*ODD, *(f"text {i}" for i in range(300))], extra="slot").repartition(5)
    twice = docs.unionByName(docs.filter("doc_id <= 7"))
    out = sharding.shard_uniformly(twice, 16, block_rows=4).collect()
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == twice.count()
    for shard in sizes:
        assert sorted(r.slot for r in out if r.shard == shard) == list(range(sizes[shard]))
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in twice.collect())
    assert sharding.shard_uniformly(spark.createDataFrame([], DOCS), 4).count() == 0


def test_matrix_follows_the_hypergeometric_law(spark):
    parts = spark.createDataFrame([(0, 30), (1, 0), (2, 50), (3, 21)], "part int, n long")
    drawn = [[r.counts for r in sorted(sharding.communication_matrix(parts, 4, seed).collect(), key=lambda r: r.part)]
             for seed in range(40)]
    cells = np.array(drawn)
    assert (cells.sum(axis=2) == [30, 0, 50, 21]).all() and (cells.sum(axis=1) == [26, 25, 25, 25]).all()
    # mean of a cell is row sum * column sum / total, variance that of the hypergeometric law
    mean = np.outer([30, 0, 50, 21], [26, 25, 25, 25]) / 101
    var = mean * (1 - np.array([26, 25, 25, 25]) / 101) * ((101 - np.array([30, 0, 50, 21])) / 100)[:, None]
    assert (np.abs(cells.mean(axis=0) - mean) <= 4 * np.sqrt(var / 40) + 1e-9).all()
    assert 0.5 < cells.var(axis=0).sum() / var.sum() < 1.6


# --- URL filters ----------------------------------------------------------------------------------------------

def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [r for r in urlfilter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best.verdict if best else "allow"


def test_urls_match_a_plain_version(spark):
    urls = [None, "", "no scheme", "http://", "http://ORG/x", "https://a.Example.ORG/en/12?x", "http://example.org/en/2#/en/1",
            "http://example.org", "ftp://x.com/fr/://y", "http://xcom/fr/", "http://a.com/de/?q", "://com/de/", "http://É.com/de/é",
            "http://b.com/fr\n/", "http://.org/", "http://org./", "http://com/fr/", "http://com/fr/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge_urls(pages, urlfilter.RULES).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate(urls)}
    assert urlfilter.judge_urls(pages.limit(0), urlfilter.RULES).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 3000, 37).selectExpr("concat('k', id) as key")
    levels = urlfilter.build_cascade(universe, listed, rate=0.5)
    keys = universe.selectExpr("array(key) as keys")
    hits = keys.select(F.explode(urlfilter.in_cascade(spark, levels, F.col("keys"))).alias("k")).collect()
    assert {r.k for r in hits} == {f"k{i}" for i in range(0, 3000, 37)} and len(levels) > 1


# --- line dedup -----------------------------------------------------------------------------------------------

def plain_lines(rows, threshold=0.8):
    def norm(line):
        return line.strip(" \t\r\x0b\x0c").lower()

    first = {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for j, line in enumerate((text or "").split("\n")):
            if norm(line):
                first.setdefault(norm(line), (i, j))
    lines = list(first)
    sets, groups = [linededup.shingles(x) for x in lines], Union(len(lines))
    order = sorted(range(len(lines)), key=lambda i: first[lines[i]])
    for a in range(len(lines)):
        for b in range(a):
            if min(len(sets[a]), len(sets[b])) >= threshold * max(len(sets[a]), len(sets[b])) \
                    and linededup.jaccard(sets[a], sets[b]) >= threshold:
                groups.join(a, b)
    best = {}
    for i in order:
        best.setdefault(groups.find(i), first[lines[i]])
    at = {x: i for i, x in enumerate(lines)}
    return {i: None if text is None else "\n".join(
        x for j, x in enumerate(text.split("\n")) if not norm(x) or best[groups.find(at[norm(x)])] == (i, j)) for i, text in rows}


def test_lines_match_a_plain_version(spark):
    texts = [r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(60).collect()]
    near = "The quick brown fox jumps over the lazy dog near the river bank today"
    texts = [*[t for t in ODD if t is None or len(t) < 6000], near, near + "!", " " + near.upper() + "\nA new line", near + ".\n\nde\nde", *texts]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, texts, extra="n_lines")).collect()}
    assert got == plain_lines(rows)


def test_lines_of_repeated_rows_and_empty_tables(spark):
    docs = raw(spark, [(1, "one line\ntwo lines"), (1, "one line\ntwo lines"), (None, "two lines"), (2, None)])
    got = Counter((r.doc_id, r.text, r.n_removed) for r in linededup.dedup_lines(docs).collect())
    assert got == Counter({(1, "one line", 1): 2, (None, "two lines", 0): 1, (2, None, 0): 1})
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_pairs_of_a_bucket_that_stays_apart_are_checked(spark):
    base = "the quick brown fox jumps over the lazy dog"
    lines = {1: "one " * 9, 2: base, 3: "two " * 9, 4: base + "s", 5: "six " * 9}  # 2 and 4 are neither least nor neighbours
    rows = pd.DataFrame({"buckets": [np.full(5, 7, "<u4").tobytes()], "ids": [np.array([4, 2, 1, 3, 5], "<i8").tobytes()]})
    pairs = spark.createDataFrame(linededup.bucket_pairs(rows))
    texts = spark.createDataFrame([(i, i, t) for i, t in lines.items()], "h1 long, node long, line string")
    apart = linededup._unsettled(pairs, texts, spark.createDataFrame([], "node long, root long"))
    for crowd in (2, 32):
        assert (2, 4) in {(r.a, r.b) for r in linededup._open_pairs(apart, texts, 0.8, crowd).collect()}


def test_links_in_crowded_buckets_are_found(spark):
    rng, texts = np.random.default_rng(3), []
    for _ in range(3):  # lines too far from their base to be linked to it, each with a near copy
        base = rng.choice(list("abcdefgh "), 90)
        for _ in range(12):
            far = base.copy()
            far[rng.integers(0, 90, 5)] = rng.choice(list("uvwxyz"), 5)
            near = far.copy()
            near[int(rng.integers(6, 84))] = "0"
            texts += ["".join(far) + ".", "".join(near) + "."]
    order = rng.permutation(len(texts)).tolist()
    texts = [texts[i] for i in order]
    rows = [(i + 1, t) for i, t in enumerate(texts)]
    for crowd in (2, 32):
        got = {r.doc_id: r.text for r in linededup.dedup_lines(documents(spark, texts), crowd=crowd).collect()}
        assert got == plain_lines(rows)
    lines = spark.createDataFrame([(i, i, t) for i, t in rows], "node long, root long, line string")
    sets = [linededup.shingles(t) for t in texts]
    linked = {(a + 1, b + 1) for b in range(len(sets)) for a in range(b) if linededup.jaccard(sets[a], sets[b]) >= 0.8}
    assert linked <= {(r.a, r.b) for r in linededup.prefix_pairs(lines, 0.8).collect()} and len(linked) >= 20


def test_blocks_of_a_crowded_bucket_give_spanning_links(spark):
    """Links of any two blocks are found, and no more pairs come out than are needed to join what they link."""
    rng, lines = np.random.default_rng(5), {}
    for _ in range(4):
        base = rng.choice(list("abcdefgh "), 120)
        for _ in range(25):
            line = base.copy()
            line[rng.integers(0, 120, 3)] = rng.choice(list("uvwxyz"), 3)
            lines[len(lines) + 1] = "".join(line)
    lines |= {901: "ab", 902: "ab\0\0\0", 903: "abc", 904: "ab\U0001F600" * 9, 905: "ab\U0001F600" * 9 + "b"}
    texts = spark.createDataFrame(list(lines.items()), "node long, line string")
    crowded = texts.selectExpr("1L as least", f"{len(lines)}L as n", "node", "if(node between 1 and 20, 1L, node) as root")
    sets = {i: linededup.shingles(t) for i, t in lines.items()}
    want = Union(1000)
    for i in range(2, 21):
        want.join(1, i)
    for a in lines:
        for b in lines:
            if a < b and linededup.jaccard(sets[a], sets[b]) >= 0.8:
                want.join(a, b)
    for block in (7, 40, 1024):
        found = [(r.a, r.b) for r in linededup.crowded_pairs(crowded, texts, 0.8, block).collect()]
        assert all(linededup.jaccard(sets[a], sets[b]) >= 0.8 for a, b in found)
        got = Union(1000)
        for i in range(2, 21):
            got.join(1, i)
        for a, b in found:
            got.join(a, b)
        assert {(a, b) for a in lines for b in lines if got.find(a) == got.find(b)} == {
            (a, b) for a in lines for b in lines if want.find(a) == want.find(b)}
        assert block < 1024 or len(found) < len(lines)  # one task: a forest


def test_signature_recall():
    rng = np.random.default_rng(4)
    found = total = 0
    for _ in range(150):
        line = "".join(rng.choice(list("abcdefgh "), rng.integers(30, 200)))
        other = list(line)
        other[int(rng.integers(0, len(line)))] = "z"
        other = "".join(other)
        if linededup.jaccard(linededup.shingles(line), linededup.shingles(other)) >= 0.8:
            bands = linededup.band_hashes(linededup.signatures([line, other], linededup._probes()))
            total, found = total + 1, found + bool((bands[0] == bands[1]).any())
    assert total > 80 and found / total > 0.97


# --- decontamination ------------------------------------------------------------------------------------------

def test_contamination_of_odd_rows(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = spark.createDataFrame([(1, item), (2, None), (3, " ?! "), (4, "Short ITEM"), (None, "solo"), (5, item)],
                                  "item_id long, text string")
    texts = [None, "", "x " + item.upper() + " y", "alpha beta gamma delta epsilon zeta eta theta iota x", "a short item here", "solo",
             item + " " + item, "short, item"]
    docs = documents(spark, texts, extra="spans").unionByName(documents(spark, ["short item"], 8, extra="spans"))
    got = {(r.doc_id, r.text): (r.n_words, r.n_hit, r.item_ids) for r in decontaminate.contamination(docs, items).collect()}
    want = {0: (0, 0, []), 1: (0, 0, []), 2: (14, 12, ["1", "5"]), 3: (10, 0, []), 4: (4, 2, ["4"]), 5: (1, 1, []),
            6: (24, 24, ["1", "5"]), 7: (2, 2, ["4"])}
    assert got == {**{(i + 1, texts[i]): v for i, v in want.items()}, (8, "short item"): (2, 2, ["4"])}
    assert all(r.n_hit == 0 for r in decontaminate.contamination(docs, items.limit(0)).collect())
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_contamination_without_broadcast(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    keyed = docs.selectExpr("doc_id as doc", "text")
    rows = [sorted(map(tuple, decontaminate.find_windows(keyed, items, ["doc"], broadcast_rows=n).select("doc", "start", "n").collect()))
            for n in (200_000, 0)]
    assert rows[0] == rows[1] and rows[0]


# --- SimHash --------------------------------------------------------------------------------------------------

def test_components_and_local_roots(spark):
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 300, 260), rng.integers(0, 300, 260)
    a, b = np.append(a, np.arange(400, 449)), np.append(b, np.arange(401, 450))  # a long chain
    groups = Union(450)
    for x, y in zip(a, b):
        groups.join(int(x), int(y))
    want = {i: groups.find(i) for i in range(450) if groups.find(i) != i}
    links = spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long")
    assert {r.node: r.root for r in components(links).collect()} == want
    roots = local_roots(450, a, b)
    assert {i: int(r) for i, r in enumerate(roots) if r != i} == want


def test_near_links_with_small_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 30, dtype=np.uint64)
    prints = set()
    for i in range(500):
        x = int(base[rng.integers(0, 30)] if i % 3 else base[0])
        for bit in rng.integers(0, 64, rng.integers(0, 4)):
            x ^= 1 << int(bit)
        prints.add(x)
    prints = np.array(sorted(prints), dtype=np.uint64)
    ids, groups = rng.permutation(len(prints)), Union(len(prints))
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1:] ^ prints[i]) <= 2) + i + 1:
            groups.join(int(ids[i]), int(ids[j]))
    rows = spark.createDataFrame([(simhash._signed(int(f)), int(i)) for f, i in zip(prints, ids)], "fp long, id long")
    got = {r.node: r.root for r in components(simhash.near_links(rows, group_rows=24, max_visitors=30)).collect()}
    assert got == {int(i): groups.find(int(i)) for i in ids if groups.find(int(i)) != i}


def test_simhash_of_odd_rows(spark):
    rows = [(i + 1, t) for i, t in enumerate(ODD)] + [(None, "only here without an id at all"), (None, "One two three."), (5, "One two three.")]
    got = [(r.doc_id, r.fp & (2 ** 64 - 1), r.component_id) for r in simhash.near_duplicates(raw(spark, rows)).collect()]
    assert Counter((i, f) for i, f, _ in got) == Counter((i, simhash.fingerprint(t)) for i, t in rows)
    assert {c for i, _, c in got if i in (1, 2, 3, 12)} == {1} and simhash.fingerprint(" \n") == 0
    assert {c for i, f, c in got if f == simhash.fingerprint("One two three.")} == {5}
    assert [c for i, f, c in got if f == simhash.fingerprint("only here without an id at all")] == [None]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_fingerprint_uses_the_engine_hash(spark):
    text = "Alpha beta GAMMA"
    row = spark.sql("select xxhash64('alpha beta gamma') as h").collect()[0]
    assert simhash._signed(simhash.fingerprint(text)) == row.h


# --- suffix arrays --------------------------------------------------------------------------------------------

def plain_repeats(rows, length=50):
    seen = {}
    for i, text in rows:
        data = (text or "").encode()
        for s in range(len(data) - length + 1):
            w = data[s:s + length]
            seen[w] = min(seen.get(w, i), i) if i is not None else seen.get(w, 10 ** 9)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data), dtype=bool)
        for s in range(len(data) - length + 1):
            if i is not None and seen[data[s:s + length]] < i:
                covered[s:s + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~covered])
        out.append((i, len(data), int(covered.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def suffix_rows(docs, **kw):
    rows = suffix_dedup.remove_repeats(docs, **kw).collect()
    return Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()) for r in rows)


@pytest.mark.parametrize("sizes", [{}, dict(part_bytes=60_000, block=20_000, shard_bytes=3_000)])
def test_repeats_match_a_plain_version(spark, sizes):
    passage = "a passage of some sixty bytes, é and \x00 bytes included, that repeats"
    texts = [*ODD, passage, "x" + passage + "y", passage[3:60] + passage[:55], "y" * 49, "y" * 49, "z" * 300, "q" + "z" * 120 + "q",
             *[r.text for r in table(spark, SF, "documents").orderBy("doc_id").limit(50).collect()]]
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(20, texts[19]), (None, passage), (3, passage)]
    assert suffix_rows(raw(spark, rows), **sizes) == plain_repeats(rows)


def test_repeats_of_empty_tables(spark):
    assert suffix_rows(spark.createDataFrame([], DOCS)) == Counter()


def test_places_travel_packed_for_groups_of_documents():
    """A part gives a row a group of documents, not one a document, and documents come back whole."""
    rng = np.random.default_rng(6)
    ids = np.stack([rng.integers(-500, 500, 5000), rng.integers(0, 2, 5000)], axis=1)
    places = rng.integers(0, 1 << 32, 5000).astype("<u4")
    packed = [suffix_dedup._by_document(ids[at::3], places[at::3], 8) for at in range(3)]
    assert [len(p) for p in packed] == [8, 8, 8] and not len(suffix_dedup._by_document(ids[:0], places[:0], 8))
    found = [suffix_dedup.gathered(rows, 4) for _, rows in pd.concat(packed).groupby("bucket")]
    got = {(r.id, r.digest): sorted(np.frombuffer(r.data, "<u4").tolist()) for f in found for r in f.itertuples()}
    want = {}
    for (i, d), at in zip(ids.tolist(), places.tolist()):
        want.setdefault((i, d), []).append(at)
    assert sum(map(len, found)) == len(want) and got == {k: sorted(v) for k, v in want.items()}


def test_anchors_fill_all_parts_alike():
    data = np.random.default_rng(2).integers(97, 123, 400_000, dtype=np.uint8).tobytes()
    hashed, anchor, exists = suffix_dedup.window_anchors(data, np.array([len(data)]), 50)
    sizes = np.bincount(suffix_dedup._part(hashed[np.unique(anchor[exists])], 64), minlength=64)
    assert sizes.min() > 0.7 * sizes.mean() and sizes.max() < 1.3 * sizes.mean()


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(8)
    texts = [bytes(rng.integers(97, 99, rng.integers(50, 90), dtype=np.uint8)) for _ in range(30)] * 2
    joined, sizes = b"".join(texts), np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    ends = np.repeat(begins + sizes, sizes)
    order, place = suffix_dedup.suffix_array(joined, ends, 50)
    whole = [joined[i:ends[i]] for i in range(len(joined))]
    assert all(whole[a][:50] <= whole[b][:50] for a, b in zip(order, order[1:]))
    prefix = suffix_dedup.common_prefixes(np.frombuffer(joined, np.uint8), begins, ends, order, place, 50)
    for i in range(len(joined)):
        if i + 50 <= ends[i] and place[i]:
            a, b = whole[i], whole[order[place[i] - 1]]
            n = next((k for k in range(min(len(a), len(b), 50)) if a[k] != b[k]), min(len(a), len(b), 50))
            assert prefix[i] == n


# --- null keys, long hosts, bounded samples -------------------------------------------------------------------

@pytest.mark.parametrize("broadcast_rows", [0, 200_000])
def test_windows_of_null_keys_on_both_paths(spark, broadcast_rows):
    words = "one two three four five six seven eight nine ten eleven"
    docs = raw(spark, [(1, words), (None, words), (None, "other words"), (2, None), (1, words)]).withColumnRenamed("doc_id", "k")
    items = spark.createDataFrame([(7, words)], "item_id long, text string")
    found = decontaminate.find_windows(docs, items, ["k"], broadcast_rows=broadcast_rows).select("k", "start", "n").distinct()
    assert sorted((r.k or 0, r.start, r.n) for r in found.collect()) == [(0, 0, 10), (0, 1, 10), (1, 0, 10), (1, 1, 10)]


def test_host_of_many_labels(spark):
    urls = ["http://" + "a." * 100_000 + "com/de/x", "http://" + "." * 100_000, "http://example.org./es/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge_urls(pages, urlfilter.RULES).collect()}
    assert got == {0: ("com/de/", "block"), 1: (None, "allow"), 2: (None, "allow")}


def test_sample_is_bounded_whatever_repeats(spark):
    for text in ("a", "b", "c", "d", "e"):  # one of them has a hash that is drawn
        rows = spark.range(20_000).selectExpr("if(id % 2 = 0, 'x', 'y') as lang", f"if(id % 4 < 2, '{text}', cast(id as string)) as text")
        taken = sample_by_label(rows, "lang", 500)
        assert 700 < len(taken) < 1300 and not taken.duplicated().any()
    assert len(sample_by_label(rows.limit(0), "lang", 5)) == 0


def test_runs_of_many_masks_at_once():
    rng = random.Random(5)
    masks = [np.array([rng.random() < 0.6 for _ in range(rng.randint(1, 12))]) for _ in range(300)]
    plain = []
    for i, mask in enumerate(masks):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
        plain += [(i, a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
    assert list(zip(*(x.tolist() for x in suffix_dedup.mask_runs(masks)))) == plain
    assert [len(x) for x in suffix_dedup.mask_runs([])] == [0, 0, 0]


def test_sketches_lose_no_similar_line():
    rng = random.Random(3)
    lines = ["".join(rng.choice("abcdefgh \u03c3\u4e2d") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    lines += ["aaaa" * 50, "ab\0\0\0", "ab", "a" * 4, "x" * 2000]
    pairs = [(x, x[:i] + rng.choice("ab") + x[i + rng.randint(0, 3):]) for x in lines for i in range(0, len(x), 1 + len(x) // 5)]
    pairs += list(zip(lines, lines[1:]))
    near = [linededup.jaccard(linededup.shingles(a), linededup.shingles(b)) >= 0.8 for a, b in pairs]
    may = linededup.may_reach(linededup.sketches([a for a, _ in pairs]), linededup.sketches([b for _, b in pairs]), 0.8)
    assert all(m for n, m in zip(near, may) if n) and sum(near) > 100 and (~may).sum() > 200
    assert len(linededup.may_reach([], [], 0.8)) == 0


def test_a_line_is_sent_once_by_a_task():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2], pa.int64()), pa.array(["a line of text", "quite another line"])], names=["h1", "line"])
    sent = [np.frombuffer(i.as_py(), "<i8") for b in linededup._entries(iter([batch, batch, batch]), 4) for i in b.column("ids")]
    assert sorted(np.concatenate(sent).tolist()) == [1] * linededup.BANDS + [2] * linededup.BANDS


def test_lines_are_lower_cased_like_single_lines(spark):
    text = "\u039f\u0394\u039f\u03a3\n \u03a3 \r\n\t\x0b\x0c\n\u03a3\u0391\n\n A\u0130 \u00c4"
    docs = raw(spark, [(1, text)])
    got = {r.line_no: r.line for r in linededup._lines(docs, "text", ["doc_id"]).collect()}
    strip = " \t\r\x0b\x0c"
    assert got == {i: x.strip(strip).lower() for i, x in enumerate(text.split("\n")) if x.strip(strip)}


def test_roots_with_further_links(spark):
    links = spark.createDataFrame([(1, 5), (5, 9), (2, 6), (3, 7)], "a long, b long")
    more = spark.createDataFrame([(9, 6), (8, 7), (0, 8), (11, 12)], "a long, b long")
    whole = {r.node: r.root for r in components(links.unionByName(more)).collect()}
    assert {r.node: r.root for r in linededup.joined_roots(components(links), more).collect()} == whole
    assert {r.node: r.root for r in linededup.joined_roots(components(links), more.limit(0)).collect()} == {5: 1, 9: 1, 6: 2, 7: 3}
