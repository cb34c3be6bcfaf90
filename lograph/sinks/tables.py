"""Writers of the append-only audit, of reports and of a set of artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.fixed_values import CHANGE_SOURCES, CHANGE_TYPES
from lograph.functions import checks
from lograph.schemas import AUDIT
from lograph.sinks.graph_text import dot_lines, graphml_lines, write_lines


def append_audit(audit: DataFrame, root: str, batch: str) -> None:
    """Add audit rows, partitioned by day. A repeated batch replaces its own rows only."""
    rows = audit.withColumn("day", F.to_date("timestamp"))
    rows.write.mode("overwrite").partitionBy("day").parquet(f"{root}/batch={batch}")


def read_audit(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.option("basePath", root).schema(AUDIT + ", batch string, day date").parquet(root)


def audit_json(audit: DataFrame, path: str) -> None:
    """Audit as JSON lines, for other tools."""
    audit.write.mode("append").json(path)


def audit_rules() -> dict:
    """Validity rules of an audit row, for :func:`lograph.functions.checks.split_valid`."""
    return {
        "bad_change_id": checks.valid_uuid(F.col("change_id")),
        "blank_resource": checks.not_blank(F.col("resource_arn")),
        "blank_trigger": checks.not_blank(F.col("triggered_by")),
        "bad_change_type": checks.one_of(F.col("change_type"), CHANGE_TYPES),
        "bad_source": checks.one_of(F.col("source"), CHANGE_SOURCES),
    }


def write_reports(reports: DataFrame, path: str) -> None:
    """Reports as JSON lines; evidence stays nested."""
    evidence = F.transform("source_evidence", lambda v: F.to_json(v))
    reports.withColumn("source_evidence", evidence).write.mode("overwrite").json(path)


def write_artifacts(nodes: DataFrame, edges: DataFrame, audit: DataFrame, root: str) -> None:
    """Graph tables, Graphviz and GraphML text and audit side by side in one folder."""
    nodes.write.mode("overwrite").json(f"{root}/nodes")
    edges.write.mode("overwrite").json(f"{root}/edges")
    write_lines(dot_lines(nodes, edges), f"{root}/dot")
    write_lines(graphml_lines(nodes, edges), f"{root}/graphml")
    audit.write.mode("overwrite").json(f"{root}/audit")
