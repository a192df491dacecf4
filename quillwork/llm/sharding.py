"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

1. Every input partition is put into random order and written once; a row then has a fixed partition number and
   a fixed place in it, so later stages and retried tasks agree.
2. The matrix of partition-to-shard counts is drawn exactly: the set of partitions is halved again and again, and
   each half's share of every shard is a hypergeometric draw given what is left. Row sums are the partition sizes,
   column sums the shard sizes.
3. Places 0..a-1 of a partition go to shard 0, the next ones to shard 1, and so on. Since the order was random,
   the choice is uniform.
4. Rows are exchanged to (shard, block) by a second random number and permuted again there; a running total of the
   block sizes makes the slots gapless.

Only the matrix (partitions x shards) and the block sizes are gathered; a shard of any size is many blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import column, free_names, register, stored, table


def _let(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _draw(good: str, total: str, n: str, u: str) -> str:
    """SQL for one hypergeometric draw by inversion: ``n`` of ``total`` items, of which ``good`` count.

    Weights follow the ratio of neighbouring probabilities from ten standard deviations below the mode (or the
    lowest possible value) upwards, and are normalised by their sum, so that no factorial is needed.
    """
    ratio = "((g - k) * (m - k)) / ((k + 1D) * (t - g - m + k + 1D))"
    span = "sequence(lo, hi)"
    mass = (f"aggregate({span}, named_struct('w', 1D, 's', 0D), "
            f"(a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w), a -> a.s)")
    pick = (f"aggregate({span}, named_struct('w', 1D, 's', 0D, 'c', 0L), "
            f"(a, k) -> named_struct('w', a.w * {ratio}, 's', a.s + a.w, "
            f"'c', a.c + IF(a.s + a.w < aim, 1L, 0L)), a -> least(lo + a.c, hi))")
    body = _let("aim", f"({u}) * {mass}", pick)
    body = _let("hi", "cast(least(m, g, mode + wide) as bigint)", body)
    body = _let("lo", "cast(greatest(0D, m + g - t, mode - wide) as bigint)", body)
    body = _let("wide", "ceil(10 * sqrt(greatest(0D, m * g / greatest(t, 1D) * (1 - g / greatest(t, 1D)) "
                        "* (t - m) / greatest(t - 1, 1D)))) + 12", body)
    body = _let("mode", "floor((m + 1) * (g + 1) / (t + 2))", body)
    for name, value in (("m", n), ("t", total), ("g", good)):
        body = _let(name, f"cast({value} as double)", body)
    return body


def _split(seed: int) -> str:
    """SQL for the left half's share of every shard: draws one after the other from what is left."""
    u = f"pmod(xxhash64({seed}L, node.id, j), 9007199254740992L) / 9007199254740992D"
    step = _let("x", _draw("node.caps[j]", "s.total", "s.n", u),
                "named_struct('n', s.n - x, 'total', s.total - node.caps[j], 'out', concat(s.out, array(x)))")
    return ("aggregate(sequence(0, size(node.caps) - 1), "
            "named_struct('n', aggregate(slice(node.parts, 1, half), 0L, (s, p) -> s + p.n), "
            "'total', aggregate(node.parts, 0L, (s, p) -> s + p.n), 'out', cast(array() as array<bigint>)), "
            f"(s, j) -> {step}, s -> s.out)")


def communication_matrix(parts: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """(part, counts): how many rows each partition sends to each shard.

    ``parts`` has (part, n), one row per partition. Shard sizes are equal but for one row. The work is one
    expression per level of halving; levels beyond the sixth run on many tasks.
    """
    n_parts = parts.count()
    gathered = parts.agg(F.sort_array(F.collect_list(F.struct("part", F.col("n").cast("long").alias("n")))).alias("parts"))
    total = "aggregate(parts, 0L, (s, p) -> s + p.n)"
    nodes = gathered.select(F.expr(
        f"named_struct('id', 1L, 'parts', parts, 'caps', transform(sequence(0, {shards - 1}), "
        f"j -> {total} div {shards} + IF(j < {total} % {shards}, 1L, 0L)))").alias("node"))
    for level in range(max(0, (n_parts - 1).bit_length())):
        halved = nodes.withColumn("half", F.expr("cast(ceil(size(node.parts) / 2) as int)")).withColumn(
            "left", F.expr(f"IF(size(node.parts) > 1, {_split(seed)}, node.caps)"))
        nodes = halved.select(F.explode(F.expr(
            "IF(size(node.parts) > 1, array("
            "named_struct('id', node.id * 2, 'parts', slice(node.parts, 1, half), 'caps', left), "
            "named_struct('id', node.id * 2 + 1, 'parts', slice(node.parts, half + 1, size(node.parts)), "
            "'caps', zip_with(node.caps, left, (a, b) -> a - b))), array(node))")).alias("node"))
        if level == 6:
            nodes = nodes.repartition(F.col("node.id"))
    return nodes.filter("size(node.parts) > 0").select(
        F.expr("node.parts[0].part").alias("part"), F.col("node.caps").alias("counts"))


def shard_uniformly(df: DataFrame, shards: int, seed: int = 0, block_rows: int = 8192,
                    shard: str = "shard", slot: str = "slot") -> DataFrame:
    """All columns of ``df`` plus ``shard`` (0..shards-1) and ``slot`` (0.. without gaps inside the shard).

    Every arrangement is equally likely, shard sizes differ by one row at most, and every row of ``df`` comes out
    exactly once, repeated rows and rows of nulls included. An empty table gives no rows. Existing columns named
    like the two new ones are replaced. The written copy in the checkpoint folder makes the result stable under
    retries.
    """
    spark = df.sparkSession
    df = df.drop(*[c for c in df.columns if c.lower() in (shard.lower(), slot.lower())])
    part, place, u, upto, mix, block, n, before, rank = free_names(
        df, "__part", "__place", "__u", "__upto", "__mix", "__block", "__n", "__before", "__rank")
    ordered = df.withColumn(u, F.rand(seed)).sortWithinPartitions(u).drop(u)
    fixed = stored(ordered.withColumn(part, F.spark_partition_id()).withColumn(
        place, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "shuffle", "zstd")

    sizes = stored(fixed.groupBy(F.col(part).alias("part")).agg(F.count("*").alias("n")), "shuffle-parts")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    matrix = stored(communication_matrix(sizes, shards, seed).select(
        F.col("part").alias(part),
        F.expr("transform(sequence(1, size(counts)), i -> aggregate(slice(counts, 1, i), 0L, (s, c) -> s + c))")
        .alias(upto)), "shuffle-matrix")
    blocks = max(1, -(-total // (shards * block_rows)))

    def placed(rows: DataFrame) -> DataFrame:
        mixed = F.xxhash64(F.lit(seed + 1), F.col(part), F.col(place))
        return (rows.join(matrix, part)
                .withColumn(shard, F.expr(f"size(filter({upto}, c -> c <= {place}))"))
                .withColumn(mix, mixed).withColumn(block, F.pmod(F.col(mix), F.lit(blocks)))
                .drop(upto))

    counted = placed(fixed.select(part, place)).groupBy(shard, block).agg(F.count("*").alias(n))
    earlier = Window.partitionBy(shard).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(counted.select(shard, block, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before)),
                     "shuffle-blocks")
    again = Window.partitionBy(shard, block).orderBy(mix, part, place)
    out = placed(fixed).withColumn(rank, F.row_number().over(again)).join(offsets, [shard, block])
    return out.select(*[column(c) for c in df.columns], F.col(shard).cast("int").alias(shard),
                      (F.col(before) + F.col(rank) - 1).cast("long").alias(slot))


def text_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


@register("op1_shards")
def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; sizes and checksums are taken from the rows as they arrive in their shard."""
    out = shard_uniformly(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", (text_bytes(F.col("text")) + 1).alias("size"),
                      F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("rows").alias("law"),
                      "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
