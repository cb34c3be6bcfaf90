"""Queries that run as streams: the tables come in as file streams, the result is what the stream wrote."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from lograph.operators import health as H
from lograph.plans import edit_queries
from lograph.plans.graph_queries import ORACLES as GRAPH_ORACLES
from lograph.plans.graph_queries import AUDIT_COLUMNS, SIGNALS_CTE, as_text, fresh_nodes
from lograph.plans.event_queries import ORACLES as EVENT_ORACLES
from lograph.plans.event_queries import GAP, SEVERE
from lograph.plans.views import oracle, table_stream, view, view_stream, with_arrays
from lograph.session import scratch_path
from lograph.streaming import edits as E
from lograph.streaming import jobs as J
from lograph.streaming.audit import health_audit_stream
from lograph.streaming.sinks import batches, finish, latest_rows


@contextmanager
def state_partitions(spark):
    """A stream keeps one state store per shuffle partition, for its whole life: one per core here."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(spark.sparkContext.defaultParallelism, 1)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _folders(spark, name):
    root = scratch_path(spark, name)
    return f"{root}/out", f"{root}/checkpoint"


def stream_health(spark, sf_dir):
    target, checkpoint = _folders(spark, "stream_health")
    with state_partitions(spark):
        finish(J.health_stream(with_arrays(view_stream(spark, sf_dir, "findings_v")), target, checkpoint))
    folded = latest_rows(spark, target, ["arn"])
    return H.apply_fold(fresh_nodes(spark, sf_dir), folded).select("arn", "status", "last_error", "error_count", "last_seen")


def stream_error_windows(spark, sf_dir):
    target, checkpoint = _folders(spark, "stream_windows")
    lines = view_stream(spark, sf_dir, "loglines_v").withColumn("ts", F.col("ts").cast("timestamp"))
    with state_partitions(spark):
        finish(J.error_window_stream(lines, target, checkpoint))
    return latest_rows(spark, target, ["window_start"]).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_ingest(spark, sf_dir):
    target, checkpoint = _folders(spark, "stream_ingest")
    lines = table_stream(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s3_bucket:orders:"), F.col("l_orderkey").cast("string"), F.lit(".log")).alias("unique_id"),
        F.col("l_shipdate").alias("ts"), F.col("l_linenumber").cast("bigint").alias("line"))
    finish(J.ingest_stream(lines, target, checkpoint, ["ts", "line"]))
    return batches(spark, target).select("unique_id", "ts", "line")


def stream_triggers(spark, sf_dir):
    target, checkpoint = _folders(spark, "stream_triggers")
    finish(J.trigger_stream(view_stream(spark, sf_dir, "triggers_v"), target, checkpoint))
    return batches(spark, target).drop("batch")


def _after_all(spark, sf_dir):
    """A time that is later than all findings by more than any lateness here."""
    last = F.coalesce(F.max("ts"), F.lit("2000-01-01").cast("timestamp_ntz"))
    return view(spark, sf_dir, "findings_v").agg((last + F.expr("interval 3 days")).cast("timestamp").alias("ts"))


def stream_health_audit(spark, sf_dir):
    """The audit of all findings as they come, in the order of their time; a closing row releases the last ones."""
    target, checkpoint = _folders(spark, "stream_audit")
    ends = scratch_path(spark, "closing")
    spark.createDataFrame([], "ts timestamp").write.parquet(ends)
    closing = spark.readStream.schema("ts timestamp").parquet(ends)
    found = with_arrays(view_stream(spark, sf_dir, "findings_v")).withColumn("ts", F.col("ts").cast("timestamp"))
    nodes = fresh_nodes(spark, sf_dir)
    with state_partitions(spark):
        finish(health_audit_stream(found, nodes, target, checkpoint, "batch-1", closing=closing))
        _after_all(spark, sf_dir).write.mode("append").parquet(ends)
        finish(health_audit_stream(found, nodes, target, checkpoint, "batch-1", closing=closing))
    return batches(spark, target).select(*AUDIT_COLUMNS).withColumn("pos", F.col("pos").cast("bigint"))


def stream_incidents(spark, sf_dir):
    target, checkpoint = _folders(spark, "stream_incidents")
    ends = scratch_path(spark, "closing")
    spark.createDataFrame([], "ts timestamp").write.parquet(ends)
    closing = spark.readStream.schema("ts timestamp").parquet(ends)
    found = with_arrays(view_stream(spark, sf_dir, "findings_v")).withColumn("ts", F.col("ts").cast("timestamp"))
    with state_partitions(spark):
        finish(J.incident_stream(found, target, checkpoint, GAP, closing=closing))
        _after_all(spark, sf_dir).write.mode("append").parquet(ends)
        finish(J.incident_stream(found, target, checkpoint, GAP, closing=closing))
    return batches(spark, target).drop("batch")


def _edited(spark, sf_dir, name):
    """All edits, brought by three micro-batches in list order."""
    target, checkpoint = _folders(spark, name)
    source = scratch_path(spark, "edits")
    edits = edit_queries.edits(spark, sf_dir)
    last = edits.agg(F.max("seq")).scalar()
    for third in range(3):
        edits.where(F.floor(F.col("seq") * 3 / (last + 1)) == third).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(edits.schema).option("maxFilesPerTrigger", 1).parquet(source)
    with state_partitions(spark):
        finish(E.edit_stream(stream, edit_queries.nodes(spark, sf_dir), edit_queries.edges(spark, sf_dir), target, checkpoint))
    return target


def stream_edit_nodes(spark, sf_dir):
    return E.streamed_nodes(spark, _edited(spark, sf_dir, "edit_nodes")).withColumn("metadata", as_text(F.col("metadata")))


def stream_edit_edges(spark, sf_dir):
    return E.streamed_edges(spark, _edited(spark, sf_dir, "edit_edges")).drop("added_seq")


QUERIES = {f.__name__: f for f in [
    stream_health, stream_error_windows, stream_ingest, stream_triggers, stream_health_audit, stream_incidents, stream_edit_nodes, stream_edit_edges,
]}

ORACLES = {
    "stream_health": oracle(f"WITH {SIGNALS_CTE} SELECT * FROM state", "findings_v"),
    "stream_error_windows": oracle(f"""WITH {SEVERE} SELECT date_trunc('hour', ts) AS window_start, count(*) AS errors FROM l
        WHERE severity IN ('error', 'critical') GROUP BY 1""", "loglines_v"),
    "stream_ingest": """SELECT 's3_bucket:orders:' || l_orderkey || '.log' AS unique_id, ts, line FROM (SELECT l_orderkey, l_shipdate AS ts,
        CAST(l_linenumber AS BIGINT) AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
    "stream_triggers": EVENT_ORACLES["trigger_route"],
    "stream_health_audit": GRAPH_ORACLES["health_audit"],
    "stream_incidents": EVENT_ORACLES["incidents"],
    "stream_edit_nodes": edit_queries.ORACLES["edit_nodes"],
    "stream_edit_edges": edit_queries.ORACLES["edit_edges"],
}
