"""What streams write: a folder per micro-batch, or a merge table with one row per key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lograph.sources.merge_table import VERSION, MergeTable, is_stored, schema_of


def start_batches(
    stream: DataFrame, target: str, checkpoint: str, mode: str = "update",
    prepare: Callable[[DataFrame, int], DataFrame] | None = None, once: bool = True, key: str | None = None,
) -> StreamingQuery:
    """Write each micro-batch to ``target``; with ``once`` stop when the input is used up.

    With a ``key`` the target is a merge table: the rows of a batch are the newest ones of their keys, older ones are merged away, and a
    batch that the table has is not added again. Otherwise each batch has a folder, ``batch=<id>``, which it replaces when it runs again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch, batch_id) if prepare else batch
        if key:
            MergeTable(batch.sparkSession, target, schema_of(rows), key).append(rows, checkpoint, batch_id)
        else:
            rows.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def finish(query: StreamingQuery) -> None:
    query.awaitTermination()


def batches(spark: SparkSession, target: str) -> DataFrame:
    """All rows that were written and not merged away, with the ``batch`` (or version of the table) that brought them."""
    if is_stored(spark, target):
        table = MergeTable(spark, target)
        return table.stored(table.manifest()["runs"]).select(*table.columns, F.col(VERSION).alias("batch"))
    return spark.read.option("basePath", target).parquet(target)


def latest_rows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Newest row per key."""
    if is_stored(spark, target) and (table := MergeTable(spark, target)).key == keys[0] and len(keys) == 1:
        return table.newest()
    rows = batches(spark, target)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("row"))
    return newest.select(*keys, *[F.col("row")[c].alias(c) for c in rest])
