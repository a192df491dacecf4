"""Fuzzy line deduplication over the whole corpus: MinHash, exact verification, union-find.

1. Every non-blank line (trimmed, lower-cased) gets a 128-bit key; equal lines are one key from here on, with the
   place of its first occurrence.
2. Character shingles of each line fill a one-permutation MinHash signature; empty cells copy a cell chosen by a
   fixed probing order. Bands of the signature become bucket entries. They travel packed, 12 bytes each, and never
   with the text.
3. In each bucket every line is first paired with the smallest and with the next one, which spans the bucket.
4. The lines that are in some pair (few) are fetched with a sketch, which of ``BINS`` bins their shingles fall in. Two
   sketches bound what two lines can have in common, so of pairs that cannot reach the threshold no text travels. For the
   others the exact Jaccard similarity of the shingle sets is computed; pairs at or above the threshold are links.
5. Buckets that these links do not join into one component are settled: all pairs of different components are checked.
   Buckets of more than ``CROWD`` lines are cut into blocks: every block of lines outside the bucket's largest component
   meets every block of the bucket in a task, which counts the shingles in common and keeps the links that span.
6. Connected components of the links. The first occurrence of a component stays, all other occurrences of its lines go.

With 16 bands of 6 cells a pair of similarity 0.8 is found with probability 0.992, of 0.85 with 0.9995.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import column, free_names, register, stored, table
from .components import components

SHINGLE, BANDS, ROWS = 5, 16, 6
CELLS = BANDS * ROWS
CROWD = 32  # lines of a bucket that are all paired where its first links leave it apart
BLOCK = 1024  # lines of a larger bucket that meet as many others in one task
BINS = 512  # bits of a sketch
SEEN = 500_000  # lines that a task remembers to have sent
EMPTY = np.uint32(0xFFFFFFFF)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(line: str, size: int = SHINGLE) -> frozenset[str]:
    """Character shingles; a shorter line is its own only shingle."""
    return frozenset(line[i:i + size] for i in range(max(1, len(line) - size + 1)))


def jaccard(a: frozenset, b: frozenset) -> float:
    common = len(a & b)
    return common / (len(a) + len(b) - common)


def packed_shingles(line: str) -> np.ndarray | None:
    """The distinct shingles as sorted numbers, 12 bits a character; None where a character needs more."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not SHINGLE <= len(codes) or codes.max() >> np.uint64(12):
        return None
    out = codes[:len(codes) - SHINGLE + 1].copy()
    for i in range(1, SHINGLE):
        out = (out << np.uint64(12)) | codes[i:len(codes) - SHINGLE + 1 + i]
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def similarity(a: str, b: str, packed: np.ndarray | None, other: np.ndarray | None) -> float:
    """Exact Jaccard similarity of the shingle sets; ``packed`` and ``other`` are the packed shingles of both."""
    if packed is None or other is None:
        return jaccard(shingles(a), shingles(b))
    both = np.concatenate([packed, other])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common / (len(both) - common)


def _probes(tries: int = 96) -> np.ndarray:
    return np.random.default_rng(11).integers(0, CELLS, (tries, CELLS), dtype=np.int16)


def hashed_shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit numbers of all shingles, repeats included, and the line of each; short lines are filled up with zeros."""
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    joined = "".join(x + "\0" * max(0, SHINGLE - len(x)) for x in lines)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    padded = np.maximum(sizes, SHINGLE)
    n = len(codes) - SHINGLE + 1
    hashed = codes[:n].copy()
    for i in range(1, SHINGLE):
        hashed *= _M1
        hashed += codes[i:i + n]
    line = np.repeat(np.arange(len(lines)), padded)[:n]
    inside = np.ones(len(codes), dtype=bool)
    ends = np.cumsum(padded)
    for i in range(1, SHINGLE):
        inside[ends - i] = False  # would reach into the next line
    inside = inside[:n]
    hashed, line = hashed[inside], line[inside]
    hashed ^= hashed >> np.uint64(31)
    hashed *= _M2
    hashed ^= hashed >> np.uint64(29)
    return hashed, line


def sketches(lines: list[str]) -> list[bytes]:
    """Of each line the number of its shingles, repeats included (4 bytes), and a bit for each bin that has some."""
    out, start = [], 0
    while start < len(lines):
        end, chars = start, 0
        while end < len(lines) and chars < 100_000:
            chars += len(lines[end])
            end += 1
        number, line = hashed_shingles(lines[start:end])
        bins = np.zeros((end - start) * BINS, dtype=bool)
        bins[line * BINS + (number >> np.uint64(64 - 9)).astype(np.int64)] = True
        counts = np.bincount(line, minlength=end - start).astype("<u4").view(np.uint8).reshape(-1, 4)
        made = np.concatenate([counts, np.packbits(bins.reshape(-1, BINS), axis=1)], axis=1).tobytes()
        width = 4 + BINS // 8
        out += [made[i:i + width] for i in range(0, len(made), width)]
        start = end
    return out


def may_reach(left: list[bytes], right: list[bytes], threshold: float) -> np.ndarray:
    """Whether two lines of these sketches can have the similarity.

    A bin that only one of them uses holds a shingle the other does not have, so it counts in the union and not in common.
    """
    if not len(left):
        return np.ones(0, dtype=bool)
    one, two = (np.frombuffer(b"".join(x), np.uint8).reshape(len(x), -1) for x in (left, right))
    n, m = (np.ascontiguousarray(x[:, :4]).view("<u4")[:, 0].astype(np.int64) for x in (one, two))
    only, other = (np.bitwise_count(a[:, 4:] & ~b[:, 4:]).sum(axis=1, dtype=np.int64) for a, b in ((one, two), (two, one)))
    common = np.minimum(n - only, m - other)
    return common >= threshold * (common + only + other) - 1e-6


def signatures(lines: list[str], probes: np.ndarray) -> np.ndarray:
    """(lines, CELLS) of 32-bit minima."""
    hashed, line = hashed_shingles(lines)
    cell = hashed >> np.uint64(32)
    cell *= np.uint64(CELLS)
    cell >>= np.uint64(32)
    line *= CELLS
    line += cell.view(np.int64)
    out = np.full(len(lines) * CELLS, EMPTY, dtype=np.uint32)
    np.minimum.at(out, line, hashed.astype(np.uint32) & np.uint32(0x7FFFFFFF))
    out = out.reshape(len(lines), CELLS)
    full = out != EMPTY
    row, col = np.nonzero(~full)
    for probe in probes:
        if not len(row):
            break
        source = probe[col]
        hit = full[row, source]
        out[row[hit], col[hit]] = out[row[hit], source[hit]]
        row, col = row[~hit], col[~hit]
    for r, c in zip(row, col):  # cells that no probe could fill: the next filled one
        at = np.flatnonzero(full[r])
        out[r, c] = out[r, at[np.searchsorted(at, c) % len(at)]]
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """(lines, BANDS) of 64-bit bucket hashes, different for each band."""
    cells = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    hashed = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _M2, cells.shape[:2]).copy()
    for i in range(ROWS):
        hashed = (hashed ^ cells[:, :, i]) * _M1
        hashed ^= hashed >> np.uint64(32)
    return hashed


def _entries(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Packed bucket entries (4 bytes of bucket and 8 of id) by part, from (id, line) rows."""
    probes = _probes()
    seen: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    small = np.uint16 if parts < 1 << 16 else np.int64  # 16 bits are sorted by radix

    def flush() -> pa.RecordBatch:
        part, bucket, ids = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(part, kind="stable")
        part, bucket, ids = part[order].astype(np.int32), bucket[order], ids[order]
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        bounds = [*starts.tolist(), len(part)]
        held.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(part[starts]), pa.array([bucket[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
             pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())],
            names=["part", "buckets", "ids"])

    def add(ids: list[int], lines: list[str]) -> None:
        hashed = band_hashes(signatures(lines, probes)).reshape(-1)
        held.append(((((hashed >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(small),
                     (hashed & np.uint64(0xFFFFFFFF)).astype("<u4"), np.repeat(np.array(ids, dtype="<i8"), BANDS)))

    for batch in batches:
        distinct = dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        ids, lines, chars = [], [], 0
        if len(seen) > SEEN:
            seen.clear()
        for i, text in distinct.items():
            if i in seen:
                continue
            ids.append(i)
            lines.append(text)
            chars += len(text)
            if chars > 100_000 or len(ids) >= 4096:
                add(ids, lines)
                ids, lines, chars = [], [], 0
        seen.update(distinct)
        if ids:
            add(ids, lines)
        if sum(len(i) for _, _, i in held) > 3_000_000:
            yield flush()
    if held:
        yield flush()


def bucket_pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """(a, b, more): pairs that span every bucket, each line with the bucket's smallest id and with the next one.

    ``more`` tells that the bucket has other pairs too; its lines are those paired with the smallest id.
    """
    bucket = np.frombuffer(b"".join(rows["buckets"]), dtype="<u4")
    ids = np.frombuffer(b"".join(rows["ids"]), dtype="<i8")
    order = np.argsort(bucket, kind="stable")
    same = bucket[order][1:] == bucket[order][:-1]
    order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]  # buckets of one line are done
    order = order[np.lexsort((ids[order], bucket[order]))]
    bucket, ids = bucket[order], ids[order]
    first = np.ones(len(ids), dtype=bool)
    first[1:] = bucket[1:] != bucket[:-1]
    new = first.copy()
    new[1:] |= ids[1:] != ids[:-1]
    ids, first = ids[new], first[new]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(ids)))
    least, many = np.repeat(ids[starts], sizes), np.repeat(sizes > 3, sizes)
    at = np.flatnonzero(~first)
    pairs = pd.DataFrame({"a": np.concatenate([least[at], ids[at - 1]]), "b": np.concatenate([ids[at], ids[at]]),
                          "more": np.concatenate([many[at], np.zeros(len(at), dtype=bool)])})
    return pairs.drop_duplicates()


def _unsettled(pairs: DataFrame, texts: DataFrame, roots: DataFrame) -> DataFrame:
    """(least, n, node, root) of the lines of buckets that the links do not join into one component.

    Buckets with the same smallest line are taken as one.
    """
    more = pairs.filter("more").select(F.col("a").alias("least"), F.col("b").alias("h1"))
    members = more.unionByName(more.select("least", F.col("least").alias("h1")).distinct())
    rooted = texts.select("h1", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = stored(members.join(rooted, "h1").drop("h1"), "line-buckets")
    apart = placed.groupBy("least").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low < high")
    return stored(placed.join(apart.select("least", "n"), "least"), "line-crowds")


def common_shingles(rows: list[str], columns: list[str], at_once: int = 2048) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles that every row has in common with every column, and how many each row and column has.

    ``at_once`` shingles are counted together, so the indicator matrices take little room.
    """
    lines, n = [*rows, *columns], len(rows)
    number, line = hashed_shingles(lines)
    # a short line is its own shingle, whatever a longer one with zeros has
    number = number ^ np.array([len(x) < SHINGLE for x in lines])[line] * _M2
    order = np.lexsort((line, number))
    number, line = number[order], line[order]
    new = np.concatenate([[True], (number[1:] != number[:-1]) | (line[1:] != line[:-1])])
    number, line = number[new], line[new]
    sizes = np.bincount(line, minlength=len(lines))
    starts = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    left = line < n
    rank = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(number))))
    both = np.minimum(np.bincount(rank[left], minlength=len(starts)), np.bincount(rank[~left], minlength=len(starts))) > 0
    place = np.cumsum(both) - 1
    keep = both[rank]
    rank, line = place[rank[keep]], line[keep]
    common = np.zeros((n, len(columns)), dtype=np.float32)
    for a in range(0, int(both.sum()), at_once):
        some = slice(*np.searchsorted(rank, (a, a + at_once)))
        has = np.zeros((len(lines), at_once), dtype=np.float32)
        has[line[some], rank[some] - a] = 1
        common += has[:n] @ has[n:].T
    return common, sizes[:n], sizes[n:]


def block_links(key: tuple, rows: pa.Table, threshold: float) -> pa.Table:
    """(a, b): of the lines (side, node, root, line) of two blocks, links that join as many roots as all their links do."""
    side = np.array(rows["side"])
    node, root = (np.array(rows[c]) for c in ("node", "root"))
    lines = rows["line"].to_pylist()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(one) and len(two):
        common, n, m = common_shingles([lines[i] for i in one], [lines[i] for i in two])
        near = common >= threshold * (n[:, None] + m[None, :] - common) - 1e-6
        i, j = np.nonzero(near & (root[one][:, None] != root[two][None, :]))
        a, b = one[i], two[j]
    if len(a):
        _, number = np.unique(root, return_inverse=True)
        low, high = np.minimum(number[a], number[b]), np.maximum(number[a], number[b])
        _, first = np.unique(low * len(number) + high, return_index=True)  # one link for two roots
        a, b, low, high = a[first], b[first], low[first], high[first]
        label = np.arange(len(number))
        spans = []
        for at, (x, y) in enumerate(zip(low.tolist(), high.tolist())):
            while label[x] != x:
                label[x] = x = label[label[x]]
            while label[y] != y:
                label[y] = y = label[label[y]]
            if x != y:
                label[max(x, y)] = min(x, y)
                spans.append(at)
        a, b = node[a[spans]], node[b[spans]]
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def crowded_pairs(crowded: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join what all links between different roots of a bucket (least, n, node, root) join.

    Every line is compared with every line of its bucket but those of its root; lines of the bucket's largest root need
    not be compared with each other. No task has more than about ``block`` lines of either side.
    """
    main = crowded.groupBy("least", "root").agg(F.count("*").alias("size")).groupBy("least").agg(
        F.max_by("root", F.struct("size", "root")).alias("main"), (F.sum("size") - F.max("size")).alias("others"))
    # written, so that nothing is done to the lines of other buckets
    whole = stored(crowded.join(texts.select("node", "line"), "node").join(main, "least"), "line-blocks", "zstd")

    def cut(count: str):
        return F.ceil(F.col(count) / block).cast("int")

    def own(count: str):
        return F.pmod(F.xxhash64("node"), cut(count)).cast("int")

    def all_of(count: str):
        return F.explode(F.sequence(F.lit(0), cut(count) - 1))

    one = whole.filter("root <> main").select("least", own("others").alias("i"), all_of("n").alias("j"), F.lit(0).alias("side"), "node", "root", "line")
    two = whole.select("least", all_of("others").alias("i"), own("n").alias("j"), F.lit(1).alias("side"), "node", "root", "line")
    found = one.unionByName(two).groupBy("least", "i", "j").applyInArrow(
        lambda key, rows: block_links(key, rows, threshold), "a long, b long")
    return found.distinct()


def _open_pairs(apart: DataFrame, texts: DataFrame, threshold: float, crowd: int) -> DataFrame:
    """(a, b): the pairs of different components that may be linked, of the buckets of ``_unsettled``.

    Of buckets with more than ``crowd`` lines those that span what is linked are enough.
    """
    few = apart.filter(F.col("n") <= crowd)
    one, two = (few.select("least", F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab")
    pairs = one.join(two, "least").filter("a < b and root_a <> root_b").select("a", "b")
    return pairs.unionByName(crowded_pairs(apart.filter(F.col("n") > crowd), texts, threshold)).distinct()


def prefix_pairs(lines: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of ``lines`` (node, root, line) of different roots, among them all that reach the threshold.

    Shingle sets of that similarity share one of their first shingles in any common order, of ``size`` shingles the
    first ``size - ceil(threshold * size) + 1``. The rarest come first, so that few lines meet.
    """
    size = F.greatest(F.length("line") - SHINGLE + 1, F.lit(1))
    sets = lines.select("node", "root", F.array_distinct(F.transform(
        F.sequence(F.lit(1), size), lambda i: F.col("line").substr(i, F.lit(SHINGLE)))).alias("set"))
    each = stored(sets.select("node", "root", F.size("set").alias("size"), F.explode("set").alias("shingle")), "line-shingles", "zstd")
    counts = each.groupBy("shingle").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "shingle").groupBy("node", "root", "size").agg(
        F.array_sort(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    rest = F.ceil(F.col("size") * threshold - 1e-9).cast("int") - 1
    heads = stored(ranked.select("node", "root", "size", F.explode(F.slice("all", F.lit(1), F.col("size") - F.greatest(rest, F.lit(0))))
                                 .alias("s")).select("node", "root", "size", "s.shingle"), "line-prefixes", "zstd")
    one = heads.select(F.col("node").alias("a"), F.col("root").alias("root_a"), F.col("size").alias("size_a"), "shingle")
    two = heads.select(F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("size").alias("size_b"), "shingle")
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * threshold - 1e-9
    met = one.join(two, "shingle").filter((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & near)
    common = met.groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.count("*").alias("common"))
    # a shingle that both have but not both have in front lies behind the front part of one of them
    behind = F.ceil(F.greatest("size_a", "size_b") * threshold - 1e-9) - 1
    wanted = (F.col("size_a") + F.col("size_b")) * (threshold / (1 + threshold)) - 1e-6
    return common.filter(F.col("common") + behind >= wanted).select("a", "b")


def _lines(keyed: DataFrame, text: str, key: list[str]) -> DataFrame:
    """(key, line_no, line, h1, h2) of the non-blank lines."""
    blanks = F.lit(" \t\r\x0b\x0c")
    # lower-cased as a whole, since a line break ends every context; blank lines are told by their beginning
    lines = keyed.select(*key, F.posexplode(F.split(F.lower(column(text)), "\n")).alias("line_no", "raw"))
    lines = lines.filter(F.ltrim("raw", blanks) != "").withColumn("line", F.btrim("raw", blanks))
    return lines.select(*key, "line_no", "line", F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit(1), "line").alias("h2"))


def _alike(pairs: DataFrame, texts: DataFrame, key: str, threshold: float) -> DataFrame:
    """(a, b): the nodes of the ``pairs`` (a, b: values of ``key``) of lines that reach the threshold, written."""

    @F.pandas_udf("boolean")
    def maybe(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(may_reach(left.tolist(), right.tolist(), threshold))

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        packed: dict[str, np.ndarray | None] = {}  # a line is in several pairs that lie together

        def of(line: str) -> np.ndarray | None:
            if line not in packed:
                if len(packed) > 1000:
                    packed.clear()
                packed[line] = packed_shingles(line)
            return packed[line]

        return pd.Series([similarity(a, b, of(a), of(b)) >= threshold for a, b in zip(left, right)], dtype=bool)

    def side(n: str, *what: str) -> DataFrame:
        return texts.select(F.col(key).alias(n), *[F.col(c).alias(f"{c}_{n}") for c in what])

    near = pairs.join(side("a", "sketch"), "a").join(side("b", "sketch"), "b").filter(maybe("sketch_a", "sketch_b"))
    near = stored(near.select("a", "b"), "line-near")
    nodes = [] if key == "node" else ["node"]
    checked = near.join(side("a", "line", *nodes), "a").join(side("b", "line", *nodes), "b").filter(alike("line_a", "line_b"))
    ends = [F.col(f"node_{n}" if nodes else n).alias(n) for n in "ab"]
    return stored(checked.select(*ends), "line-links")


def joined_roots(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` (node, root) of the links so far with further links (a, b): only the roots of these are joined anew."""
    ends = [roots.select(F.col("node").alias(n), F.col("root").alias(f"root_{n}")) for n in "ab"]
    between = stored(more.join(ends[0], "a", "left").join(ends[1], "b", "left").select(
        F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")), "line-links")
    if not between.limit(1).count():
        return roots
    tops = stored(components(between), "line-tops")
    over = tops.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root")).unionByName(tops)


def similar_lines(lines: DataFrame, n_distinct: int, threshold: float, broadcast_rows: int,
                  crowd: int = CROWD) -> DataFrame:
    """(h1, h2, node, root): the lines that are linked to others, with the smallest node of their component."""
    parts = max(8, -(-n_distinct * BANDS // 400_000))
    entries = lines.select("h1", "line").mapInArrow(lambda b: _entries(b, parts), "part int, buckets binary, ids binary")
    paired = entries.groupBy("part").applyInPandas(bucket_pairs, "a long, b long, more boolean")
    pairs = stored(paired.groupBy("a", "b").agg(F.max("more").alias("more")), "line-pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "line-ids")
    few = wanted.count() <= broadcast_rows  # long ids only: 8 bytes a row
    some = lines.select("h1", "h2", "line").join(F.broadcast(wanted) if few else wanted, F.col("h1") == F.col("id"), "left_semi")

    @F.pandas_udf("binary")
    def sketch(lines: pd.Series) -> pd.Series:
        return pd.Series(sketches(lines.tolist()), dtype=object)

    texts = stored(some.groupBy("h1", "h2").agg(F.first("line").alias("line"))
                   .withColumn("node", F.monotonically_increasing_id()).withColumn("sketch", sketch("line")), "line-texts", "zstd")
    links = _alike(pairs.select("a", "b"), texts, "h1", threshold)
    roots = components(links)
    if pairs.filter("more").limit(1).count():
        apart = _unsettled(pairs, texts, roots)
        if apart.limit(1).count():
            roots = joined_roots(roots, _alike(_open_pairs(apart, texts, threshold, crowd), texts, "node", threshold))
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    return texts.select("h1", "h2", "node").join(linked, "node")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8,
                broadcast_rows: int = 4_000_000, crowd: int = CROWD) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, plus ``n_lines`` and ``n_removed``.

    Of all lines that are equal or linked (trimmed, lower-cased, similarity of the shingle sets at least
    ``threshold``), the one that comes first by doc_id and line stays, everywhere else they are removed. Blank lines
    stay. ``crowd`` bounds the buckets whose lines are all paired. A null text stays null; a text whose lines all go becomes empty. Null ids come first in the order. Rows that
    repeat id and text count as one document and get the same result; rows that share only the id are ordered by a
    digest. Columns of ``docs`` named like the new ones are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("n_lines", "n_removed")])
    kid, digest, out_id, out_digest, gone = free_names(docs, "__id", "__digest", "__out_id", "__out_digest", "__gone")
    keyed = docs.withColumn(kid, column(doc_id)).withColumn(digest, F.xxhash64(column(text)))
    key = [kid, digest]
    lines = _lines(keyed, text, key)
    place = F.struct(*key, "line_no")
    places = stored(lines.select(*key, "line_no", "h1", "h2"), "line-places")
    firsts = stored(places.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")), "lines")
    linked = stored(similar_lines(lines, firsts.count(), threshold, broadcast_rows, crowd), "linked-lines")
    roots = stored(linked.join(firsts, ["h1", "h2"]).groupBy("root").agg(F.min("first").alias("stays")), "line-roots")
    stays = stored(linked.join(roots, "root").select("h1", "h2", "stays"), "staying-lines")
    # a line that occurs once and is linked to nothing needs no decision
    decided = stored(firsts.join(stays, ["h1", "h2"], "left").filter("n > 1 or stays is not null").select(
        "h1", "h2", F.coalesce("stays", "first").alias("stays")), "line-decisions")
    removed = places.join(decided, ["h1", "h2"]).filter(
        ~place.eqNullSafe(F.col("stays")))
    per_doc = removed.groupBy(*key).agg(F.sort_array(F.collect_set("line_no")).alias(gone)).select(
        F.col(kid).alias(out_id), F.col(digest).alias(out_digest), gone)
    joined = keyed.join(per_doc, F.col(kid).eqNullSafe(F.col(out_id)) & (F.col(digest) == F.col(out_digest)), "left")
    split = F.split(column(text), "\n")
    cut = F.array_join(F.filter(split, lambda line, i: ~F.array_contains(F.col(gone), i)), "\n")
    columns = [F.when(F.col(gone).isNull(), column(c)).otherwise(cut).alias(c) if c == text else column(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"))


@register("op5_lines")
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
