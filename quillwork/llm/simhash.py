"""SimHash near-duplicates with a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours in the order differ in few bits, and cut into
groups of equal size. A node of the index holds the bits that all its fingerprints share and its parent's do not: a
mask and a pattern. A search goes down from the top and adds up the differences between the fingerprint and the
patterns; a node whose sum exceeds the allowed distance is left with its whole group. At the bottom the sum is the
Hamming distance itself.

The same index works on two levels. The patterns of the groups (at most ``max_groups``) are the upper part, which
every task has: it tells to which groups a fingerprint must travel. Each group then builds the lower part over its
members. Visitors travel packed, several thousand in a row; a group with many of them is split. Only one link per
fingerprint and group leaves a task (to the root of what it is linked with there), never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranking import with_rank
from .base import column, register, stored, table, with_results
from .components import components, local_roots

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of word shingles, repeats included; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # blanks are \x20 and \x09-\x0D
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for start in range(0, len(grams), 1 << 16):
        part = grams[start:start + (1 << 16)]
        hashes = np.fromiter((digest(g, seed) for g in part), dtype="<u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(grams)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), shingle: int = 3) -> DataFrame:
    """Columns ``keep`` plus ``fp`` (the 64 bits as a signed long) of each whole text; null counts as no words."""
    def compute(texts: Iterable[str | None]) -> Iterator[tuple]:
        return ((_signed(fingerprint(t, shingle)),) for t in texts)

    return with_results(docs, text, "fp long", compute, keep)


def gray_rank(fp: Column) -> Column:
    """Position of the fingerprint in Gray order, as a long that sorts by sign."""
    for step in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, step))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


#: A level of an index: for each node its first child in the level below, its mask and its pattern.
Level = tuple[np.ndarray, np.ndarray, np.ndarray]


def build_index(masks: np.ndarray, patterns: np.ndarray, fan: int = 8) -> list[Level]:
    """Levels from the top down over leaves in Gray order; ``masks`` are the bits of a leaf that are fixed."""
    levels = []
    first = np.arange(len(masks) + 1)
    while True:
        levels.append((first, masks, patterns))
        if len(masks) <= fan:
            break
        starts = np.arange(0, len(masks), fan)
        both = np.bitwise_and.reduceat(patterns, starts)
        either = np.bitwise_or.reduceat(patterns, starts)
        fixed = np.bitwise_and.reduceat(masks, starts) & ~(both ^ either)
        inner = np.repeat(fixed, np.diff(np.append(starts, len(masks))))
        levels[-1] = (first, masks & ~inner, patterns)  # what the parent holds is not kept twice
        first, masks, patterns = np.append(starts, len(masks)), fixed, both & fixed
    return levels[::-1]


def search(index: Sequence[Level], queries: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """All (query, leaf) whose fixed bits differ in at most ``distance`` places."""
    found_q, found_leaf = [], []
    for start in range(0, len(queries), 1024):
        part = queries[start:start + 1024]
        width = len(index[0][1])
        q = np.repeat(np.arange(len(part)), width)
        node = np.tile(np.arange(width), len(part))
        gone = np.zeros(len(q), dtype=np.uint8)
        for depth, (first, masks, patterns) in enumerate(index):
            if depth:
                begin, end = index[depth - 1][0][node], index[depth - 1][0][node + 1]
                n = end - begin
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                q, gone, node = np.repeat(q, n), np.repeat(gone, n), np.repeat(begin, n) + offset
            gone = gone + np.bitwise_count((part[q] ^ patterns[node]) & masks[node])
            near = gone <= distance
            q, node, gone = q[near], node[near], gone[near]
        found_q.append(q + start)
        found_leaf.append(node)
    if not found_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_q), np.concatenate(found_leaf)


def _unpack(rows: Iterable[bytes]) -> np.ndarray:
    """(n, 2) of fingerprint and id."""
    return np.frombuffer(b"".join(rows), dtype="<u8").reshape(-1, 2)


def gray_groups(prints: DataFrame, group_rows: int) -> DataFrame:
    """(grp, n, mask, pattern, members): ``prints`` (fp, id) in Gray order, cut into groups and packed."""
    ranked = with_rank(prints.withColumn("gray", gray_rank(F.col("fp"))), [F.col("gray")], name="place")
    ranked = ranked.select("fp", "id", "gray", F.floor((F.col("place") - 1) / group_rows).cast("int").alias("grp"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("gray")
        fp = rows["fp"].to_numpy(np.int64).view(np.uint64)
        both, either = np.bitwise_and.reduce(fp), np.bitwise_or.reduce(fp)
        packed = np.stack([fp, rows["id"].to_numpy(np.int64).view(np.uint64)], axis=1).astype("<u8").tobytes()
        mask = ~(both ^ either)
        return pd.DataFrame({"grp": [int(rows["grp"].iloc[0])], "n": [len(rows)], "mask": [int(mask.view(np.int64))],
                             "pattern": [int((both & mask).view(np.int64))], "members": [packed]})

    return stored(ranked.groupBy("grp").applyInPandas(pack, "grp int, n int, mask long, pattern long, members binary"),
                  "gray-groups")


def near_links(prints: DataFrame, distance: int = 2, group_rows: int = 2048, max_groups: int = 16_384,
               max_visitors: int = 100_000) -> DataFrame:
    """(a, b): links between ids that connect exactly the fingerprints within ``distance`` of each other.

    ``prints`` has distinct ``fp`` and an ``id`` each, neither null. The links are a spanning part of all pairs.
    """
    spark = prints.sparkSession
    n = prints.count()
    if n < 2:
        return spark.createDataFrame([], "a long, b long")
    groups = gray_groups(prints, max(group_rows, -(-n // max_groups)))
    upper = groups.select("grp", "mask", "pattern").orderBy("grp").toPandas()  # max_groups rows at most
    shared = spark.sparkContext.broadcast(build_index(
        upper["mask"].to_numpy(np.int64).view(np.uint64), upper["pattern"].to_numpy(np.int64).view(np.uint64)))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in batches:
            for grp, members in zip(batch["grp"], batch["members"]):
                own = _unpack([members])
                q, target = search(index, np.ascontiguousarray(own[:, 0]), distance)
                q, target = q[target > grp], target[target > grp]  # each pair of groups meets once
                order = np.argsort(target, kind="stable")
                q, target = q[order], target[order]
                starts = np.flatnonzero(np.diff(target, prepend=-1))
                packed = [own[part].tobytes() for part in np.split(q, starts[1:])] if len(q) else []
                yield pd.DataFrame({"grp": target[starts].astype(np.int32), "n": [len(p) // 16 for p in packed],
                                    "part": np.full(len(packed), grp, np.int32), "visitors": packed})

    visits = stored(groups.select("grp", "members").mapInPandas(route, "grp int, n int, part int, visitors binary"),
                    "visits")
    load = visits.groupBy("grp").agg(F.ceil(F.sum("n") / max_visitors).cast("int").alias("parts"))
    load = stored(load, "visit-load")
    split = visits.join(load, "grp").select("grp", F.pmod(F.hash("part"), F.col("parts")).alias("part"), "visitors",
                                            F.lit(None).cast("binary").alias("members"))
    hosts = groups.join(load, "grp", "left").select(
        "grp", F.explode(F.sequence(F.lit(0), F.greatest(F.coalesce("parts", F.lit(1)), F.lit(1)) - 1)).alias("part"),
        F.lit(None).cast("binary").alias("visitors"), "members")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        members = _unpack(rows["members"].dropna())
        visitors = _unpack(rows["visitors"].dropna())
        everyone = np.concatenate([members, visitors]) if rows["part"].iloc[0] == 0 else visitors
        codes = np.ascontiguousarray(members[:, 0])
        index = build_index(np.full(len(codes), FULL), codes)
        ids = np.concatenate([members[:, 1], visitors[:, 1]]).view(np.int64)
        shift = 0 if rows["part"].iloc[0] == 0 else len(members)
        nodes = np.argsort(ids, kind="stable")  # the smallest id of a component becomes its root
        place = np.empty(len(ids), np.int64)
        place[nodes] = np.arange(len(ids))
        roots = np.arange(len(ids))
        for start in range(0, len(everyone), 8192):
            q, leaf = search(index, np.ascontiguousarray(everyone[start:start + 8192, 0]), distance)
            a, b = place[q + start + shift], place[leaf]
            roots = local_roots(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, roots]))
        linked = roots != np.arange(len(ids))
        return pd.DataFrame({"a": ids[nodes[linked]], "b": ids[nodes[roots[linked]]]})

    met = split.unionByName(hosts).groupBy("grp", "part").applyInPandas(link, "a long, b long")
    return met


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: Sequence[str] = (),
                    distance: int = 2, shingle: int = 3) -> DataFrame:
    """``doc_id``, columns ``keep``, ``fp`` and ``component_id`` of every row of ``docs``.

    Two fingerprints are linked if they differ in at most ``distance`` bits; ``component_id`` is the smallest doc_id
    that can be reached, the row's own included. Null texts and texts without words have fingerprint 0 and are linked
    like any other. Rows that repeat an id stay. Rows with a null id get the component of their fingerprint; a
    fingerprint that only such rows have forms no links and has no component_id. An empty table gives no rows.
    """
    rows = docs.select(column(doc_id).cast("long").alias("__id"), *[column(c) for c in dict.fromkeys([doc_id, *keep])],
                       column(text).alias("__text"))
    prints = stored(fingerprints(rows, "__text", [c for c in rows.columns if c != "__text"], shingle), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("__id").alias("id")), "distinct-fingerprints")
    # one id may stand for several fingerprints where ids repeat; it links them, as they are one id
    roots = components(near_links(distinct.filter("id is not null"), distance))
    named = stored(distinct.join(roots, F.col("id") == F.col("node"), "left").select(
        F.col("fp").alias("__fp"), F.coalesce("root", "id").alias("component_id")), "fingerprint-components")
    return prints.join(named, F.col("fp") == F.col("__fp")).drop("__fp", "__id")


@register("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
