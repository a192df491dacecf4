"""URL rules by a cascade of Bloom filters: exact membership over the corpus's own keys, without a join.

A rule is a host and a path prefix; it fits the host and all its subdomains. Every URL has a few candidate keys:
each suffix of its host with each prefix of its path whose length some rule has. The cascade answers which of
these keys are listed. Level 0 encodes the listed keys; level 1 the keys of the whole corpus that level 0 takes
for listed but are not; level 2 the listed keys that level 1 takes for false positives; and so on until a level
makes no mistake. Over the corpus's complete key universe the answer is then exact.

Level 0 is sized so that about as many false positives are left as there are listed keys, so every level is in
proportion to the list, not to the corpus. The bits are built by distributed aggregation and sent to tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import LOWER, UPPER, free_names, register, stored, table

MAX_LISTED = 20_000_000  # listed keys a cascade takes: the bits of all levels then stay below about 200 MB


#: One filter: its 64-bit words, number of bits, number of hashes (a plain tuple, so that it can be broadcast).
Level = tuple[np.ndarray, int, int]


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"))


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, depths: Sequence[int], path_lengths: Sequence[int]) -> Column:
    """Host suffixes of the given numbers of labels joined with the path prefixes of the given lengths, longest key first.

    The keys of a host are as many as the rules have depths and lengths, however many labels it has.
    """
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    known = F.array(*[F.struct(F.lit(int(d)).alias("d"), F.substring_index(host, ".", -int(d)).alias("s")) for d in depths])
    suffixes = F.transform(F.filter(known, lambda x: x["d"] <= labels), lambda x: x["s"])
    lengths = F.array(*[F.lit(int(n)) for n in path_lengths])
    fitting = F.filter(lengths, lambda n: n <= F.length(path))
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(
        fitting, lambda n: F.concat(s, F.substring(path, F.lit(1), n)))))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.reverse(F.array_sort(F.transform(pairs, lambda k: F.struct(
            F.length(k).alias("n"), k.alias("key"))))))["key"])


def _two_hashes(key: Column, level: int) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(2 * level)), F.xxhash64(key, F.lit(2 * level + 1)).bitwiseOR(F.lit(1))


def _places(first: np.ndarray, second: np.ndarray, level: Level) -> Iterator[np.ndarray]:
    _, n_bits, n_hashes = level
    for i in range(n_hashes):
        yield (first.view(np.uint64) + np.uint64(i) * second.view(np.uint64)) % np.uint64(n_bits)


def _holds(level: Level, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    found = np.ones(len(first), dtype=bool)
    for at in _places(first, second, level):
        found &= (level[0][at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _hash_columns(key: Column, number: int) -> list[Column]:
    first, second = _two_hashes(key, number)
    return [first, second]


def _passes(spark: SparkSession, level: Level, number: int, key: Column) -> Column:
    shared = spark.sparkContext.broadcast(level)

    @F.pandas_udf("boolean")
    def test(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series(_holds(shared.value, np.ascontiguousarray(first.to_numpy(np.int64)),
                                np.ascontiguousarray(second.to_numpy(np.int64))))

    return test(*_hash_columns(key, number))


def _build(keys: DataFrame, count: int, number: int, rate: float) -> Level:
    """The Bloom filter of ``keys``: bits are set per task, combined by word, and only words reach the driver."""
    n_bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    n_hashes = max(1, round(n_bits / max(count, 1) * math.log(2)))
    words = np.zeros(n_bits // 64 + 1, dtype=np.uint64)
    level = (words, n_bits, min(n_hashes, 40))

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            first = np.ascontiguousarray(batch["a"].to_numpy(np.int64))
            second = np.ascontiguousarray(batch["b"].to_numpy(np.int64))
            at = np.unique(np.concatenate(list(_places(first, second, level)) or [np.zeros(0, np.uint64)]))
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64),
                                "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    first, second = _two_hashes(F.col("key"), number)
    rows = (keys.select(first.alias("a"), second.alias("b")).mapInPandas(set_bits, "word long, bits long")
            .groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas())
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return level


def build_cascade(universe: DataFrame, listed: DataFrame, rate: float = 0.5) -> list[Level]:
    """Levels that tell the ``listed`` keys from all other keys of ``universe`` (both: distinct column ``key``).

    Listed keys that the corpus never shows may be left in; they only take room. Raises above MAX_LISTED keys,
    since the bits are sent to every task.
    """
    spark = universe.sparkSession
    n_listed, n_all = listed.count(), universe.count()
    if n_listed > MAX_LISTED:
        raise ValueError(f"{n_listed} listed keys, more than the {MAX_LISTED} whose bits may be sent to every task")
    if n_listed == 0:
        return []
    inside, outside = listed, universe.join(listed, "key", "left_anti") if n_all else universe
    levels: list[Level] = []
    n_inside = n_listed
    while n_inside:
        first_rate = min(rate, max(n_inside, 1) / max(n_all, 1) / math.sqrt(2))
        level = _build(inside, n_inside, len(levels), rate if levels else first_rate)
        levels.append(level)
        wrong = stored(outside.filter(_passes(spark, level, len(levels) - 1, F.col("key"))), "cascade")
        inside, outside, n_inside = wrong, inside, wrong.count()
    return levels


def in_cascade(spark: SparkSession, levels: Sequence[Level], keys: Column) -> Column:
    """The members of the array ``keys`` that are listed, in order."""
    if not levels:
        return F.slice(keys, 1, 0)
    shared = spark.sparkContext.broadcast(list(levels))
    hashes = F.transform(keys, lambda k: F.array(*[h for n in range(len(levels)) for h in _hash_columns(k, n)]))

    @F.pandas_udf("array<int>")
    def listed(hashed: pd.Series) -> pd.Series:
        sizes = np.array([len(h) for h in hashed], dtype=np.int64)
        flat = [np.asarray(list(h), dtype=np.int64) for h in hashed if len(h)]
        values = np.concatenate(flat) if flat else np.zeros((0, 2 * len(shared.value)), np.int64)
        depth = np.full(len(values), len(shared.value))  # the first level that does not hold the key
        open_ = np.ones(len(values), dtype=bool)
        for number, level in enumerate(shared.value):
            now = np.flatnonzero(open_)
            missed = now[~_holds(level, np.ascontiguousarray(values[now, 2 * number]),
                                 np.ascontiguousarray(values[now, 2 * number + 1]))]
            depth[missed] = number
            open_[missed] = False
        member = depth % 2 == 1
        ends = np.cumsum(sizes)
        return pd.Series([np.flatnonzero(member[e - n:e]).astype(np.int32) + 1 for e, n in zip(ends, sizes)])

    return F.transform(listed(hashes), lambda i: F.element_at(keys, i))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", otherwise: str = "allow") -> DataFrame:
    """``pages`` plus ``host``, ``path``, ``rule`` (the longest fitting rule or null) and ``verdict``.

    A URL that is null or has no ``://`` has an empty host and path and fits no rule; a URL without a listed key
    gets ``otherwise``, the answer of the cascade for keys that are not listed. The candidate keys of one URL are
    few (labels of the host times distinct path lengths of the rules). Columns of ``pages`` with the new names are
    replaced; repeated rows stay.
    """
    spark = pages.sparkSession
    host, path = url_host(F.col(f"`{url}`")), url_path(F.col(f"`{url}`"))
    pages = pages.drop(*[c for c in pages.columns if c.lower() in ("host", "path", "rule", "verdict") and c != url])
    keys, hits = free_names(pages, "__keys", "__hits")
    lengths, depths = sorted({len(r.path) for r in rules}), sorted({r.host.count(".") + 1 for r in rules})
    keyed = pages.withColumn("host", host).withColumn("path", path).withColumn(
        keys, candidate_keys(F.col("host"), F.col("path"), depths, lengths))
    universe = stored(keyed.select(F.explode(keys).alias("key")).distinct(), "url-keys")
    verdicts = {r.name: r.verdict for r in sorted(rules, key=lambda r: r.name)}
    listed = spark.createDataFrame([(k,) for k in verdicts], "key string").coalesce(1)
    levels = build_cascade(universe, listed)
    found = keyed.withColumn(hits, in_cascade(spark, levels, F.col(keys)))
    rule = F.when(F.size(hits) > 0, F.element_at(hits, 1))
    blocked = [k for k, v in verdicts.items() if v == "block"]
    judged = found.withColumn("rule", rule)
    verdict = F.when(F.col("rule").isNull(), F.lit(otherwise)).when(
        F.col("rule").isin(blocked), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("verdict", verdict).drop(keys, hits)


_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
keys AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
         arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
  FROM keys JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best b ON p.host = b.host AND p.path = b.path"""


@register("op2_urlfilter", _SQL)
def op2_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")
