"""Work only on rows that are new.

The stateless operators (rules, response parsing, splitting, geometry checks) are plain projections and
run on a stream unchanged; what needs a table is the vector store, which grows batch by batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def not_yet_embedded(assets: DataFrame, vectors: DataFrame, asset_id: str, vector_id: str) -> DataFrame:
    """Assets without a vector; the vector table itself is the only record of what is done."""
    done = vectors.select(F.col(vector_id).alias("_v")).distinct()
    return assets.join(done, F.col(asset_id) == F.col("_v"), "left_anti")


def embed_stream(assets: DataFrame, vectors_path: str, checkpoint: str, asset_id: str, vector_id: str,
                 embed: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Embed a stream of assets into a Parquet vector table, each asset once.

    A batch that is replayed after a failure finds its vectors in the table and adds nothing.
    """
    def one_batch(batch: DataFrame, _number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([asset_id])
        try:
            new = not_yet_embedded(new, spark.read.parquet(vectors_path), asset_id, vector_id)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        embed(new).write.mode("append").parquet(vectors_path)

    return (assets.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def embed_stream_by_state(assets: DataFrame, vectors_path: str, checkpoint: str, asset_id: str,
                          embed: Callable[[DataFrame], DataFrame], event_time: str | None = None,
                          keep: str = "7 days") -> StreamingQuery:
    """As ``embed_stream``, but the ids that are done are keyed state beside the checkpoint, on disk and not in the heap,
    so a batch reads its own rows only, however large the vector table is.

    With ``event_time`` (a timestamp column) an id is forgotten ``keep`` after it was last met; without it none is. Every
    batch has a folder of its own below ``vectors_path``, which a replay after a failure writes anew.
    """
    spark = assets.sparkSession
    if event_time:
        fresh = assets.withWatermark(event_time, keep).dropDuplicatesWithinWatermark([asset_id])
    else:
        fresh = assets.dropDuplicates([asset_id])

    def one_batch(batch: DataFrame, number: int) -> None:
        embed(batch).write.mode("overwrite").parquet(f"{vectors_path.rstrip('/')}/batch={number}")

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # read when the query starts
    try:
        return (fresh.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).start())
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def state_size(query: StreamingQuery) -> dict[str, int]:
    """Ids held and bytes used by the state of a query, as of its last batch."""
    operators = [o for o in (query.lastProgress or {}).get("stateOperators", [])]
    return {"rows": sum(o["numRowsTotal"] for o in operators), "bytes": sum(o["memoryUsedBytes"] for o in operators)}
