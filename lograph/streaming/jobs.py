"""The streams: health per resource, error windows, deduplicated ingest, trigger routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lograph.operators import incremental, ledger
from lograph.operators.findings import incident_aggregates, incident_rows, line_severity
from lograph.operators.health import fold_aggregates, health_signals
from lograph.operators.triggers import route_triggers
from lograph.session import written
from lograph.sources.merge_table import MergeTable, schema_of
from lograph.streaming.sinks import start_batches


def health_stream(findings: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Folded signals per resource. The state holds one row per resource, not the findings."""
    folded = health_signals(findings).groupBy("arn").agg(*fold_aggregates())
    return start_batches(folded, target, checkpoint, "update", once=once, key="arn")


def error_window_stream(
    lines: DataFrame, target: str, checkpoint: str, window: str = "1 hour", lateness: str = "1 hour", once: bool = True
) -> StreamingQuery:
    """Error lines per time window. Lines later than ``lateness`` are dropped. ``ts`` is a TIMESTAMP."""
    counted = (
        lines.withColumn("severity", line_severity(F.col("line")))
        .where(F.col("severity").isin("error", "critical"))
        .withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(F.count(F.lit(1)).alias("errors"))
        .select(F.col("w.start").alias("window_start"), "errors")
    )
    return start_batches(counted, target, checkpoint, "update", once=once, key="window_start")


def incident_stream(
    findings: DataFrame, target: str, checkpoint: str, gap: str = "30 minutes", lateness: str = "1 hour", closing: DataFrame | None = None, once: bool = True,
) -> StreamingQuery:
    """Incidents as :func:`lograph.operators.findings.incidents` finds them, each written once, when no signal can join it any more.

    ``ts`` is a TIMESTAMP. Findings later than ``lateness`` are dropped. ``closing``, a stream of rows with ``ts``, ends the incidents before it.
    """
    signals = health_signals(findings).where("ts is not null").select("arn", "ts", "seq", F.col("pos").cast("int").alias("pos"), "message", "rank")
    if closing is not None:
        none = [F.lit(None).cast(kind).alias(name) for name, kind in (("seq", "bigint"), ("pos", "int"), ("message", "string"), ("rank", "int"))]
        signals = signals.unionByName(closing.select(F.lit(None).cast("string").alias("arn"), "ts", *none))
    found = signals.withWatermark("ts", lateness).groupBy("arn", F.session_window("ts", gap).alias("w")).agg(*incident_aggregates())
    # Closing rows have no rank. A condition on their key would be pushed below the watermark, which they are there to move.
    return start_batches(incident_rows(found.where("signals > 0")), target, checkpoint, "append", once=once)


def ingest_stream(references: DataFrame, target: str, checkpoint: str, order: list[str], once: bool = True) -> StreamingQuery:
    """Each reference enters the ledger once, at its first appearance."""
    rest = [c for c in references.columns if c != "unique_id"]

    def unseen(batch: DataFrame, _: int) -> DataFrame:
        firsts = batch.groupBy("unique_id").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row"))
        firsts = written(firsts.select("unique_id", *[F.col("row")[c].alias(c) for c in rest]), "arrivals")
        # Only the buckets whose filters may hold one of these ids are read.
        return ledger.new_references(firsts, MergeTable(batch.sparkSession, target, schema_of(firsts), "unique_id").lookup(firsts))

    return start_batches(references, target, checkpoint, "append", unseen, once, key="unique_id")


def cache_stream(files: DataFrame, results: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Files that still need work: not empty, not over the size limit, not in the result cache."""
    def misses(batch: DataFrame, _: int) -> DataFrame:
        return incremental.cache_misses(incremental.with_fingerprint(incremental.size_gate(batch)), results)

    return start_batches(files, target, checkpoint, "append", misses, once)


def trigger_stream(
    events: DataFrame, target: str, checkpoint: str,
    handlers: dict[str, Callable[[DataFrame, int], None]] | None = None, once: bool = True,
) -> StreamingQuery:
    """Routed triggers, kept as rows; a handler per tool gets the triggers of each batch that name it."""
    def route(batch: DataFrame, batch_id: int) -> DataFrame:
        routed = route_triggers(batch)
        for tool, run in (handlers or {}).items():
            run(routed.where(F.col("tool") == tool), batch_id)
        return routed

    return start_batches(events, target, checkpoint, "append", route, once)
