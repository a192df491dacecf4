"""Phrase collocations, counted in tries of hash containers that spill sorted runs.

A task counts the phrases of its texts in a HAT-trie: the words of a phrase lead through a shallow trie, kept as the
sorted prefixes at which its containers begin; a container is an open-addressed hash table of the phrases that share a
prefix and bursts at a word boundary when it is full. When a task holds too many phrases, its largest subtrees leave
it as sorted runs, cut by prefix partition. One task merges the runs of a partition. Prefixes with more occurrences than a
partition should hold are split by their next word, so that no partition grows with a frequent word.

Words are counted first, then pairs of frequent words, then triples of frequent pairs: a phrase cannot be more frequent
than its parts, so nothing is lost. Tasks know the frequent parts by a bit map of bounded size: a chance hit only costs
work, and a map too small for the corpus passes more phrases, never fewer.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import column, lean_memory, register, small_batches, stored, table

BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
CUT, LANG = b"\xff", b"\xfe"  # bytes that UTF-8 never has: a cut between pieces, the end of a language name

BITS = 21  # of a word number; three make a key
WORDS = 400_000  # distinct words a task knows at once
ENTRIES = 1_500_000  # distinct phrases a task holds at once
FULL = 1 << 15  # phrases in a container before it bursts
PENDING = 1 << 20  # phrases that are sorted together before they go into the trie
PART = 1 << 22  # bytes of a text that are words at once
MAX_MAP = 28  # the largest bit map has two to this bits: 32 MB

_END = re.compile(b"[" + SPACES + BREAKS + b"]")
_FOLD = bytes(0xFF if i in BREAKS else 0x20 if i in SPACES else i for i in range(256))


def words_of(data: bytes) -> tuple[np.ndarray, list[bytes], np.ndarray, int]:
    """The words of lower-cased ``data`` as places in a list of distinct words, the number of cuts before each word, and
    the number of all cuts."""
    raw = np.frombuffer(data.lower().translate(_FOLD), np.uint8)
    cut = raw == 0xFF
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~(cut | (raw == 0x20))
    edges = np.flatnonzero(inside[1:] != inside[:-1])  # a word begins at every other one
    starts, ends, inside = edges[::2], edges[1::2], inside[1:-1]
    cuts = np.cumsum(cut, dtype=np.int32)
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw[inside])])
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary.to_pylist(), cuts[starts], int(cuts[-1]) if len(cuts) else 0


def parts(data: bytes, size: int | None = None) -> Iterator[bytes]:
    """``data`` in parts that end where a word ends."""
    at, size = 0, size or PART
    while len(data) - at > size:
        end = _END.search(data, at + size)
        if end is None:
            break
        yield data[at:end.start()]
        at = end.start()
    yield data[at:]


class Container:
    """Phrases that share a prefix, with their counts, in an open-addressed table."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.used = 0
        self._empty(max(256, 1 << (2 * len(keys) - 1).bit_length()))
        self.add(keys, counts)

    def _empty(self, size: int) -> None:
        self.keys, self.counts = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.shift = np.uint64(64 - (size.bit_length() - 1))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.keys >= 0)
        at = at[np.argsort(self.keys[at])]
        return self.keys[at], self.counts[at]

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct ``keys``."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old = self.entries()
            self.used = 0
            self._empty(1 << (2 * (len(old[0]) + len(keys))).bit_length())
            self.add(*old)
        slots = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several keys for one slot the last one stays
            mine = self.keys[slots] == keys
            self.used += int((free & mine).sum())
            self.counts[slots[mine]] += counts[mine]
            keys, counts, slots = keys[~mine], counts[~mine], (slots[~mine] + 1) & (len(self.keys) - 1)


class HatTrie:
    """Counts of phrases of ``length`` word numbers, packed into one key."""

    def __init__(self, length: int, full: int = FULL):
        self.length, self.full = length, full
        self.lows, self.containers = [0], [Container(np.zeros(0, np.int64), np.zeros(0, np.int64))]

    def __len__(self) -> int:
        return sum(c.used for c in self.containers)

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        at = np.searchsorted(keys, self.lows[1:])
        for i, (a, b) in reversed(list(enumerate(zip([0, *at], [*at, len(keys)])))):
            if a < b:
                self.containers[i].add(keys[a:b], counts[a:b])
                if self.containers[i].used > self.full:
                    self._burst(i)

    def _burst(self, i: int) -> None:
        """Split a container at the word boundary nearest to the root that lies inside it."""
        keys, counts = self.containers[i].entries()
        for depth in range(self.length):
            shift = BITS * (self.length - 1 - depth)
            cut = int(keys[len(keys) // 2]) >> shift << shift
            if cut <= keys[0]:  # all before the middle belongs to one word; end it there
                cut += 1 << shift
            if keys[0] < cut <= keys[-1]:
                break
        else:
            return
        at = int(np.searchsorted(keys, cut))
        new = [(self.lows[i], Container(keys[:at], counts[:at])), (cut, Container(keys[at:], counts[at:]))]
        self.lows[i:i + 1], self.containers[i:i + 1] = [x for x, _ in new], [c for _, c in new]
        for j in (i + 1, i):
            if self.containers[j].used > self.full:
                self._burst(j)

    def spill(self, entries: int) -> tuple[np.ndarray, np.ndarray]:
        """Take out the largest subtrees until at most ``entries`` phrases are left."""
        left, taken = len(self), []
        for i in sorted(range(len(self.containers)), key=lambda i: -self.containers[i].used):
            if left <= entries:
                break
            left -= self.containers[i].used
            taken.append(self.containers[i].entries())
            self.containers[i] = Container(*[x[:0] for x in taken[-1]])
        none = np.zeros(0, np.int64)
        return (np.concatenate([k for k, _ in taken] or [none]), np.concatenate([c for _, c in taken] or [none]))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each pair of hashes."""
    h = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + (a << np.uint64(7)))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


class BitMap:
    """Membership of 64-bit hashes; may say yes to others, never no to a member."""

    def __init__(self, data: bytes):
        self.data, self.bits = data, np.frombuffer(data, np.uint8)
        self.mask = np.uint64(8 * len(data) - 1)

    def has_one(self, value: int) -> bool:
        at = value & (8 * len(self.data) - 1)
        return self.data[at >> 3] >> (at & 7) & 1 > 0

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


class Vocabulary(dict):
    """Numbers of the words of one language; -1 for a word that is not frequent."""

    def __init__(self, lang: bytes, names: list[bytes], hashes: list[int], frequent: BitMap | None):
        super().__init__()
        self.lang, self.names, self.hashes, self.frequent = lang + LANG, names, hashes, frequent

    def __missing__(self, word: bytes) -> int:
        name = self.lang + word
        value = xxhash.xxh64_intdigest(name)
        if self.frequent is not None and not self.frequent.has_one(value):
            self[word] = -1
            return -1
        self[word] = number = len(self.names)
        self.names.append(name)
        self.hashes.append(value)
        return number


class Counter:
    """Counts the phrases of one length in a task's texts and gives them back as runs."""

    def __init__(self, length: int, partitions: int, word_map: bytes | None, pair_map: bytes | None, hot: set):
        self.length, self.partitions = length, partitions
        self.words = BitMap(word_map) if word_map else None
        self.pairs = BitMap(pair_map) if pair_map else None
        self.hot_hashes = np.fromiter(hot, np.uint64, len(hot))
        self.squeeze = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.names: list[bytes] = []
        self.hashes: list[int] = []
        self.known: dict[bytes, Vocabulary] = {}
        self.trie = HatTrie(self.length)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def feed(self, lang: bytes, texts: Sequence[bytes]) -> Iterator[tuple]:
        """Count whole ``texts``; yields the runs that had to leave."""
        waiting, size = [], 0
        for text in texts:
            if len(text) > PART:
                yield from self._count(lang, parts(text))
                continue
            waiting.append(text)
            size += len(text)
            if size > PART:
                yield from self._count(lang, [CUT.join(waiting)])
                waiting, size = [], 0
        yield from self._count(lang, [CUT.join(waiting)])

    def _count(self, lang: bytes, data: Iterable[bytes]) -> Iterator[tuple]:
        """Count the phrases of one text that comes in parts."""
        old_ids, old_cuts = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of the last words of the part before
        for part in data:
            if len(self.names) + sum(map(len, self.known.values())) // 4 > WORDS:
                before = [None if i < 0 else self.names[i] for i in old_ids]
                yield from self.finish()
                old_ids = np.array([-1 if name is None else self._number(name) for name in before], np.int64)
            places, words, cuts, all_cuts = words_of(part)
            known = self._vocabulary(lang)
            numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            ids, cuts = np.concatenate([old_ids, numbers[places]]), np.concatenate([old_cuts, cuts])
            yield from self._add(ids, cuts)
            tail = max(0, len(ids) - self.length + 1)
            old_ids, old_cuts = ids[tail:], cuts[tail:] - all_cuts

    def _vocabulary(self, lang: bytes) -> Vocabulary:
        if lang not in self.known:
            self.known[lang] = Vocabulary(lang, self.names, self.hashes, self.words)
        return self.known[lang]

    def _number(self, name: bytes) -> int:
        lang, word = name.split(LANG, 1)
        return self._vocabulary(lang)[word]

    def _add(self, ids: np.ndarray, cuts: np.ndarray) -> Iterator[tuple]:
        n = len(ids) - self.length + 1
        if n <= 0:
            return
        good = ids >= 0
        keys, whole = ids[:n], good[:n] & (cuts[:n] == cuts[self.length - 1:])
        for k in range(1, self.length):
            keys = keys << BITS | ids[k:n + k]
            whole &= good[k:n + k]
        if self.length > 2:  # both pairs of a triple must be frequent
            h = np.array(self.hashes, np.uint64)
            at = np.flatnonzero(whole)
            a, b, c = (h[ids[at + k]] for k in range(3))
            whole[at] = self.pairs.has(mixed(a, b)) & self.pairs.has(mixed(b, c))
        keys = keys[whole]
        self.waiting.append(keys)
        self.n_waiting += len(keys)
        if self.n_waiting > PENDING:
            yield from self._settle(ENTRIES)

    def _settle(self, entries: int) -> Iterator[tuple]:
        if self.waiting:
            self.trie.add(np.concatenate(self.waiting))
            self.waiting, self.n_waiting = [], 0
        if len(self.trie) > entries:
            yield from self._runs(*self.trie.spill(entries // 2))

    def finish(self) -> Iterator[tuple]:
        yield from self._settle(0)
        self._fresh()

    def partition_of(self, ids: list[np.ndarray]) -> np.ndarray:
        """The partition of each phrase: by its first word, and by each next one while the words before are hot."""
        h = np.array(self.hashes, np.uint64)
        prefix = h[ids[0]]
        split = np.isin(prefix, self.hot_hashes)
        for k in range(1, self.length):
            longer = mixed(prefix, h[ids[k]])
            prefix = np.where(split, longer, prefix)
            if k + 1 < self.length:
                split &= np.isin(prefix, self.hot_hashes)
        return (prefix >> np.uint64(11)) % np.uint64(self.partitions)

    def _runs(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[tuple]:
        """One row for each prefix partition: its words in order, its phrases in order of their words, their counts."""
        mask = (1 << BITS) - 1
        ids = [(keys >> (BITS * (self.length - 1 - k))) & mask for k in range(self.length)]
        part = self.partition_of(ids)
        used = np.unique(np.concatenate(ids)) if len(keys) else np.zeros(0, np.int64)
        used = np.array(sorted(used.tolist(), key=self.names.__getitem__), np.int64)
        rank = np.zeros(len(self.names), np.int64)
        rank[used] = np.arange(len(used))
        ids = [rank[x] for x in ids]
        order = np.lexsort((*reversed(ids), part))
        part, counts, ids = part[order], counts[order], [x[order] for x in ids]
        ends = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *ends], [*ends, len(part)]):
            if a == b:
                continue
            mine, dense = np.unique(np.concatenate([x[a:b] for x in ids]), return_inverse=True)
            words = CUT.join(self.names[i] for i in used[mine])
            yield (int(part[a]), b - a, self.squeeze.compress(words), self.squeeze.compress(dense.astype("<i4").tobytes()),
                   self.squeeze.compress(counts[a:b].astype("<i8").tobytes()))


RUN = "part int, n long, words binary, grams binary, counts binary"


def merged(runs: Sequence[tuple], length: int, least: int) -> Iterator[tuple]:
    """(language, words, count) of the phrases of one partition with ``least`` occurrences, and for phrases of one word
    (language, None, all occurrences)."""
    expand = zstandard.ZstdDecompressor().decompress
    dictionaries = [expand(words).split(CUT) for _, words, _, _ in runs]
    names = sorted(set().union(*dictionaries))
    number = {name: i for i, name in enumerate(names)}
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(1, (len(names) - 1).bit_length())
    waiting, n_waiting = [(keys, counts)], 0

    def settle():
        keys = np.concatenate([k for k, _ in waiting])
        counts = np.concatenate([c for _, c in waiting])
        order = np.argsort(keys, kind="stable")  # a merge: every run is in order
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.diff(keys, prepend=-1))
        return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    if bits * length > 62:
        raise ValueError("a prefix partition has too many words; use more partitions")
    for (n, _, grams, count), words in zip(runs, dictionaries):
        place = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        ids = place[np.frombuffer(expand(grams), "<i4")].reshape(length, n)
        key = ids[0]
        for k in range(1, length):
            key = key << bits | ids[k]
        waiting.append((key, np.frombuffer(expand(count), "<i8")))
        n_waiting += n
        if n_waiting > 4 * PENDING:
            waiting, n_waiting = [settle()], 0
    keys, counts = settle()
    if length == 1:
        langs: dict[bytes, int] = {}
        for key, count in zip(keys.tolist(), counts.tolist()):
            lang = names[key].split(LANG, 1)[0]
            langs[lang] = langs.get(lang, 0) + count
        for lang, count in langs.items():
            yield lang.decode(), None, count
    often = counts >= least
    for key, count in zip(keys[often].tolist(), counts[often].tolist()):
        words = [names[key >> (bits * (length - 1 - k)) & ((1 << bits) - 1)] for k in range(length)]
        yield words[0].split(LANG, 1)[0].decode(), [w.split(LANG, 1)[1].decode() for w in words], count


def count_phrases(docs: DataFrame, length: int, least: int, partitions: int, word_map: bytes | None = None,
                  pair_map: bytes | None = None, hot: set | None = None) -> DataFrame:
    """(lang, words, n) for the phrases of ``length`` words with at least ``least`` occurrences; ``docs`` has lang, text.

    For single words there is also one row per language and partition with null words and all occurrences there.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((word_map, pair_map, hot or set()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        counter = Counter(length, partitions, *shared.value)

        def made(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                names=["part", "n", "words", "grams", "counts"])

        for batch in batches:
            groups: dict[bytes, list[bytes]] = {}
            langs, texts = (batch.column(i).cast(pa.binary()).to_pylist() for i in range(2))
            for lang, text in zip(langs, texts):
                groups.setdefault(lang, []).append(text)
            for lang, group in groups.items():
                for run in counter.feed(lang, group):
                    yield made([run])
        for run in counter.finish():
            yield made([run])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean_memory()
        part, runs = None, []

        def result():
            rows = list(merged(runs, length, least))
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*rows[at:at + 50_000]), (pa.string(), pa.list_(pa.string()), pa.int64()))],
                    names=["lang", "words", "n"])

        for batch in batches:
            for p, *run in zip(*[c.to_pylist() for c in batch.columns]):
                if p != part:
                    if runs:
                        yield from result()
                    part, runs = p, []
                runs.append(run)
        if runs:
            yield from result()

    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    runs = texts.mapInArrow(count, RUN)
    return (runs.repartition(partitions, "part").sortWithinPartitions("part")
            .mapInArrow(merge, "lang string, words array<string>, n long"))


def bit_map(found: DataFrame, length: int) -> bytes:
    """The bit map of the phrases in ``found``; built in blocks by tasks, 16 bits a phrase, at most 32 MB."""
    n = found.count()
    bits = min(MAX_MAP, max(16, (16 * n).bit_length()))
    block = 15

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(phrase_hashes(batch) & np.uint64((1 << bits) - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> block), pa.array(at)], names=["block", "at"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(1).to_numpy()
            for b in np.unique(at >> block).tolist():
                own = at[at >> block == b] & ((1 << block) - 1)
                np.bitwise_or.at(held.setdefault(b, np.zeros(1 << (block - 3), np.uint8)), own >> 3,
                                 (1 << (own & 7)).astype(np.uint8))
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.tobytes() for x in held.values()])],
                                             names=["block", "bits"])

    rows = (found.select("lang", "words").mapInArrow(positions, "block long, at long").repartition("block")
            .mapInArrow(blocks, "block long, bits binary").collect())  # at most 32 MB
    out = bytearray(1 << (bits - 3))
    for r in rows:
        size = 1 << (block - 3)
        out[r.block * size:r.block * size + size] = r.bits
    return bytes(out)


def phrase_hashes(batch: pa.RecordBatch) -> np.ndarray:
    """The hash that tasks give to each phrase (lang, words)."""
    columns = None
    for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if columns is None:
            columns = [[] for _ in words]
        for values, word in zip(columns, words):
            values.append(xxhash.xxh64_intdigest(lang.encode() + LANG + word.encode()))
    if columns is None:
        return np.zeros(0, np.uint64)
    hashed = [np.array(values, np.uint64) for values in columns]
    out = hashed[0]
    for other in hashed[1:]:
        out = mixed(out, other)
    return out


def hot_hashes(found: DataFrame, more_than: int) -> set:
    """Hashes of the phrases with more than ``more_than`` occurrences; no more of them than partitions, by its choice."""
    rows = found.filter(F.col("n") > more_than).select("lang", "words").collect()
    if not rows:
        return set()
    batch = pa.RecordBatch.from_arrays([pa.array([r.lang for r in rows]), pa.array([r.words for r in rows])], names=["l", "w"])
    return set(phrase_hashes(batch).tolist())


def top_per_group(df: DataFrame, group: str, order: Sequence[Column], spread_by: str, limit: int, name: str) -> DataFrame:
    """The first ``limit`` rows of each group with their place, found by rounds over ever fewer buckets of a group."""
    buckets = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while buckets > 1:
        df = df.withColumn("__bucket", F.pmod(F.xxhash64(spread_by), F.lit(buckets)))
        place = F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order))
        df = df.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place", "__bucket")
        buckets //= 64
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long")).filter(F.col(name) <= limit)


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000,
                 swallowed: int = 50, words_per_partition: int = 8_000_000) -> DataFrame:
    """The ``top`` phrases of two or three words per language: lang, rank, phrase, a, l, r, n, score.

    ``a`` counts the phrase, ``l`` and ``r`` the parts of its cut, ``n`` all words of the language; the score is
    floor(1000000 a a / (l r)) of the cut with the lowest, the first such cut. Phrases within a longer one that has at
    least ``swallowed`` percent of their occurrences are left out. A null text is empty, a null language ``und``. Equal
    scores go by ``a``, then by the phrase's bytes. Repeated rows count each time; an empty table gives no phrases;
    columns with other names are ignored. ``a`` may reach 10^16.
    """
    spark = docs.sparkSession
    rows = docs.select(column(lang).cast("string").alias("lang"), column(text).cast("string").alias("text"))
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = stored(count_phrases(rows, 1, least, slots), "words")
    totals = counted.filter("words is null").groupBy("lang").agg(F.sum("n").alias("n"))
    all_words = sum(r.n for r in totals.collect())  # one row per language
    partitions = max(slots, -(-all_words // words_per_partition))
    hot_above = all_words // partitions
    single = counted.filter("words is not null")
    word_map, hot = bit_map(single, 1), hot_hashes(single, hot_above)
    double = stored(count_phrases(rows, 2, least, partitions, word_map, hot=hot), "pairs")
    triple = stored(count_phrases(rows, 3, least, partitions, word_map, bit_map(double, 2),
                                  hot | hot_hashes(double, hot_above)), "triples")
    return scored(single, double, triple, totals, top, swallowed)


def scored(single: DataFrame, double: DataFrame, triple: DataFrame, totals: DataFrame, top: int, swallowed: int) -> DataFrame:
    """The report from the counts of words, pairs and triples; every part of a phrase is among them."""
    def counts(found: DataFrame, name: str, *words: str) -> DataFrame:
        return found.select("lang", *[F.get("words", F.lit(i)).alias(w) for i, w in enumerate(words)], F.col("n").alias(name))

    def score(l: str, r: str) -> Column:  # noqa: E741
        wide = {x: f"cast({x} as decimal(16,0))" for x in ("a", l, r)}
        return F.expr(f"({wide['a']} * {wide['a']} * cast(1000000 as decimal(7,0))) div ({wide[l]} * {wide[r]})")

    longer = triple.filter(F.col("words").isNotNull())
    within = longer.select("lang", "n", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("words"))
    within = within.groupBy("lang", "words").agg(F.max("n").alias("longer"))
    pairs = (double.join(within, ["lang", "words"], "left")
             .filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("n") * swallowed)))
    pairs = (counts(pairs, "a", "w1", "w2").join(counts(single, "l", "w1"), ["lang", "w1"])
             .join(counts(single, "r", "w2"), ["lang", "w2"])
             .select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r").withColumn("score", score("l", "r")))
    triples = (counts(longer, "a", "w1", "w2", "w3")
               .join(counts(single, "l1", "w1"), ["lang", "w1"]).join(counts(double, "r1", "w2", "w3"), ["lang", "w2", "w3"])
               .join(counts(double, "l2", "w1", "w2"), ["lang", "w1", "w2"]).join(counts(single, "r2", "w3"), ["lang", "w3"])
               .withColumn("s1", score("l1", "r1")).withColumn("s2", score("l2", "r2")))
    first = F.col("s1") <= F.col("s2")
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a",
                             F.when(first, F.col("l1")).otherwise(F.col("l2")).alias("l"),
                             F.when(first, F.col("r1")).otherwise(F.col("r2")).alias("r"), F.least("s1", "s2").alias("score"))
    best = top_per_group(pairs.unionByName(triples), "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], "phrase", top, "rank")
    return best.join(F.broadcast(totals), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # one row per language


#: The contract in SQL.
SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM worded),
f1 AS (SELECT lang, ws[i] AS w1, count(*) AS f FROM placed GROUP BY ALL),
f2 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM placed WHERE i < len(ws) GROUP BY ALL),
f3 AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM placed WHERE i + 1 < len(ws) GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY lang),
cuts AS (
  SELECT t.lang, w1 || ' ' || w2 AS phrase, 1 AS k, t.f AS a, x.f AS l, y.f AS r
  FROM f2 t JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2)
  WHERE t.f >= 10 AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.f >= 10 AND 100 * f3.f >= 50 * t.f AND f3.lang = t.lang
                                  AND f3.w1 = t.w1 AND f3.w2 = t.w2)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.f >= 10 AND 100 * f3.f >= 50 * t.f AND f3.lang = t.lang
                    AND f3.w2 = t.w1 AND f3.w3 = t.w2)
  UNION ALL
  SELECT t.lang, w1 || ' ' || w2 || ' ' || w3, 1, t.f, x.f, y.f
  FROM f3 t JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) y USING (lang, w2, w3) WHERE t.f >= 10
  UNION ALL
  SELECT t.lang, w1 || ' ' || w2 || ' ' || w3, 2, t.f, x.f, y.f
  FROM f3 t JOIN f2 x USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM f1) y USING (lang, w3) WHERE t.f >= 10),
scores AS (
  SELECT *, CAST(1000000 * CAST(a AS HUGEINT) * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts),
lowest AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000"""


@register("op12_collocations", SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
