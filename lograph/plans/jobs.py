"""The jobs from end to end: take in logs, bring the topology up to date, apply edits, look into an error, retire old logs, restore some."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.fixed_values import RETENTION_DAYS
from lograph.operators import edits as E
from lograph.operators import findings as N
from lograph.operators import graph as G
from lograph.operators import health as H
from lograph.operators import ledger as L
from lograph.operators import reports as S
from lograph.operators import trace as R
from lograph.operators.running import numbered, positioned, with_running
from lograph.plans.ledger_jobs import enforce, enter, ledger_of, restore
from lograph.schemas import MANIFEST, REJECTS
from lograph.session import configure, written
from lograph.sinks.tables import append_audit
from lograph.sources import readers, snapshots
from lograph.sources.files import log_references, scan_files, suffix

AUDIT_COLUMNS = [
    "change_id", "timestamp", "resource_arn", "change_type", "source", "triggered_by", "description", "previous_value", "new_value", "seq", "pos",
]


def references(spark: SparkSession, log_root: str, as_of: Column, source_type: str = "local_file") -> DataFrame:
    """All logs under a folder as rows of the ledger, with their length."""
    return log_references(scan_files(spark, log_root), source_type, log_root).select(
        "unique_id", "source_type", F.col("identifier").alias("source_identifier"), "key",
        F.col("path").alias("local_path"), as_of.alias("downloaded_at"), F.col("size_bytes").alias("length"))


def take_in(spark: SparkSession, log_root: str, state_root: str, as_of: Column, source_type: str = "local_file") -> DataFrame:
    """Enter the logs that the ledger does not know yet; returns them (unique_id, path). They stay where they are.

    For logs that are processed elsewhere. :func:`ingest` enters logs together with what they tell.
    """
    configure(spark)
    new = enter(ledger_of(spark, state_root), references(spark, log_root, as_of, source_type).drop("length"), ["unique_id"])
    return new.select("unique_id", F.col("local_path").alias("path"))


def ingest(
    spark: SparkSession, log_root: str, state_root: str, batch: str, as_of: Column, source_type: str = "local_file"
) -> DataFrame:
    """Bring new logs into topology and ledger, each exactly once; returns the outcome per log (unique_id, path, outcome).

    The batch's logs are fixed in a manifest first. The topology takes a batch once, and the ledger takes the logs of a batch after
    the topology has them. A batch that failed anywhere is run again under its name and goes on where it
    stopped. Logs that no reader takes, or that turn out damaged, go to the rejects and not to the ledger.
    """
    configure(spark)
    manifest_path, rejects_path = f"{state_root}/batches/{batch}/manifest", f"{state_root}/batches/{batch}/rejects"
    ledger = ledger_of(spark, state_root)
    schema = f"{MANIFEST}, length bigint"
    if not snapshots.is_written(spark, manifest_path):
        there = written(references(spark, log_root, as_of, source_type), "references")
        L.new_references(there, ledger.lookup(there)).write.mode("overwrite").parquet(manifest_path)
    logs = spark.read.schema(schema).parquet(manifest_path)
    files = logs.select("unique_id", F.col("local_path").alias("path"), "length")
    refused = readers.unread_reason(files)
    taken = files.join(refused, "path", "left_anti")
    # Formats that are read whole are parsed once: their lines tell what is damaged, and go on to the topology.
    whole = taken.where(suffix(F.col("path")).isin(readers.WHOLE_SUFFIXES) & (F.col("length") > 0))
    whole_lines = written(readers.lines_of(spark, whole), "whole_lines")
    if not snapshots.is_written(spark, rejects_path):
        # Whole-file formats that give no line although they have bytes are damaged.
        damaged = readers.unreadable(whole, whole_lines).select("path", F.lit("damaged").alias("reason"))
        files.join(refused.unionByName(damaged), "path").select("unique_id", "path", "reason").write.mode("overwrite").parquet(rejects_path)
    rejects = spark.read.schema(REJECTS).parquet(rejects_path)
    good = taken.join(rejects, "path", "left_anti")
    plain = readers.lines_of(spark, good.join(whole.select("path"), "path", "left_anti"))
    update_topology(spark, log_root, state_root, batch, as_of, lines=plain.unionByName(whole_lines))
    # Logs that the ledger has by now are left alone, so a batch that runs again adds nothing.
    enter(ledger, logs.drop("length").join(good, "unique_id", "left_semi"), ["unique_id"])
    return good.select("unique_id", "path", F.lit("ingested").alias("outcome")).unionByName(
        rejects.select("unique_id", "path", F.col("reason").alias("outcome")))


def retire(
    spark: SparkSession, state_root: str, as_of: Column, failed_deletes: DataFrame | None = None, days: int = RETENTION_DAYS
) -> DataFrame:
    """Mark logs past their retention as purged; returns the ids. Deleting the files is the storage's lifecycle rule."""
    configure(spark)
    return enforce(ledger_of(spark, state_root), as_of, failed_deletes, days).select("unique_id")


def restore_logs(spark: SparkSession, state_root: str, requests: DataFrame, as_of: Column) -> DataFrame:
    """Enter purged logs that were brought back (``requests``: unique_id, new_path); returns each request with its ``outcome``.

    ``restored``, ``not_found`` or ``not_purged``. The retention of a restored log starts again.
    """
    configure(spark)
    return restore(ledger_of(spark, state_root), requests, as_of)


def log_findings(lines: DataFrame, as_of: Column) -> DataFrame:
    """Findings of log lines (path, block, line_no, line), in the order of path and place. Lines without resource or problem stay out."""
    found = N.line_findings(lines).where("severity <> 'info' or size(resource_arns) > 0").select(
        F.col("path").alias("source_file"), "block", "line_no", "severity", F.col("line").alias("message"), "resource_arns",
        F.coalesce(F.try_to_timestamp("written_time").cast("timestamp_ntz"), as_of).alias("ts"),
    )
    # Written before the range sort, which reads its input twice: the logs are parsed once.
    return positioned(written(found, "findings"), ["source_file", "block", "line_no"])


def update_topology(
    spark: SparkSession, log_root: str, state_root: str, batch: str, as_of: Column, after: str | None = None,
    only: DataFrame | None = None, lines: DataFrame | None = None,
) -> int:
    """Merge what the logs tell into the stored topology; returns the new version.

    A batch that the topology holds already changes nothing. Health counters add up, so each log must
    come in one batch: ``only`` (path) names them, ``after`` spares the listing files that are older anyway; or ``lines`` has
    their lines already (path, block, line_no, line).
    """
    configure(spark)
    root = f"{state_root}/topology"
    if snapshots.has_batch(spark, root, batch):
        return snapshots.latest_version(spark, root)
    lines = readers.file_lines(spark, log_root, after, only) if lines is None else lines
    found = log_findings(lines, as_of)
    old_nodes, old_edges = snapshots.read_snapshot(spark, root)
    resources = G.resource_nodes(found).withColumn("properties", F.create_map(F.lit("region"), F.col("region")))
    merged = written(G.merge_nodes(old_nodes, resources), "merged_nodes")
    known = old_nodes.select("arn", "health.*")
    before = merged.join(known, "arn", "left").withColumns({
        "status": F.coalesce("status", F.lit("unknown")), "error_count": F.coalesce("error_count", F.lit(0))})
    edges = written(G.merge_edges(old_edges, G.resource_edges(found)), "merged_edges")
    after = H.health_state(found, before).select(
        "arn", "resource_type", "name", F.struct("status", "last_error", "error_count", "last_seen").alias("health"), "metadata")
    # What adds to the graph comes before what happens to it, in the order of the log lines.
    graph_audit = G.node_audit(merged, batch).unionByName(G.edge_audit(edges, batch)).withColumns({
        "timestamp": as_of, "seq": F.lit(None).cast("bigint"), "pos": F.lit(None).cast("int")})
    health_audit = H.health_audit(found, before, batch).withColumns({"timestamp": as_of, "pos": F.col("pos").cast("int")})
    append_audit(
        graph_audit.select(*AUDIT_COLUMNS).unionByName(health_audit.select(*AUDIT_COLUMNS)), f"{state_root}/audit", batch)
    return _next_version(after, edges.drop("added"), root, as_of, batch)


def _next_version(nodes: DataFrame, edges: DataFrame, root: str, as_of: Column, batch: str) -> int:
    """Write a version of the topology and drop those that are old; readers that need an old one lease it."""
    version = snapshots.write_snapshot(nodes, edges, root, as_of, batch)
    snapshots.drop_versions(nodes.sparkSession, root)
    return version


def apply_edits(spark: SparkSession, state_root: str, edits: DataFrame, operator_id: str, batch: str, as_of: Column) -> int:
    """Apply a batch of operator edits (``schemas.EDITS``) to the stored topology; returns the new version.

    Counters of what stays are kept; new edges follow the stored ones in the list. A known batch changes nothing.
    """
    configure(spark)
    root = f"{state_root}/topology"
    if snapshots.has_batch(spark, root, batch):
        return snapshots.latest_version(spark, root)
    nodes, edges = snapshots.read_snapshot(spark, root)
    flat = nodes.select("arn", "resource_type", "name", "health.*", "metadata")
    steps = written(E.node_steps(flat, edits), "node_steps")
    removals = E.node_removals(steps)
    audit = E.edit_audit(steps, E.edge_steps(edges, edits, removals), operator_id, batch)
    append_audit(
        audit.withColumns({"timestamp": as_of, "pos": F.lit(0)}).select(*AUDIT_COLUMNS), f"{state_root}/audit", batch)
    free = edges.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("free"))
    left = written(E.edited_edges(edges, edits, removals), "edited_edges")
    placed = left.where("added_seq is null").drop("added_seq").unionByName(
        numbered(left.where("added_seq is not null"), ["added_seq", *G.EDGE_KEY], "place")
        .withColumn("position", F.col("place") + free.scalar()).drop("place", "added_seq"))
    after = E.edited_nodes(flat, edits).select(
        "arn", "resource_type", "name", F.struct("status", "last_error", "error_count", "last_seen").alias("health"), "metadata")
    return _next_version(after, placed, root, as_of, batch)


def investigate(
    spark: SparkSession, log_root: str, state_root: str, pattern: str, surface: str
) -> dict[str, DataFrame]:
    """What is known about an error: the files that show it, the chain to its root, what the root affects, and evidence.

    All files and lines are there, ranked; a display takes as many as it shows.
    """
    configure(spark)
    nodes, edges = snapshots.read_snapshot(spark, f"{state_root}/topology")
    lines = readers.file_lines(spark, log_root).withColumnRenamed("path", "file_name")
    chain = written(R.root_cause_trace(edges, nodes.select("arn", "health.status"), surface), "chain")
    root = chain.where("position = 0").first()
    mentions = N.line_findings(lines).where("severity <> 'info'").select(
        "file_name", "line", F.explode(F.array_distinct("resource_arns")).alias("arn"))
    # Numbered in blocks: one resource may have a third of all lines.
    evidence = positioned(mentions.join(chain.select("arn", "position"), "arn"), ["file_name", "line"])
    evidence = with_running(evidence, ["arn"], ["seq"], {"before": ("sum", F.lit(1))})
    return {
        "files": N.rank_files(lines, pattern),
        "chain": S.with_labels(chain, nodes).orderBy("position"),
        "affected": S.with_labels(R.affected_resources(edges, root["arn"] if root else surface), nodes),
        "evidence": evidence.withColumn("n", F.col("before") + 1).drop("seq", "before"),
    }
