"""Findings from log lines: severity, resources, digests per file, ranking, timeline.

``lines``: file_name, line_no, ts, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lograph.fixed_values import SEVERITIES
from lograph.functions import checks
from lograph.functions.arn import find_arns

# Words that mark a line's severity; the worst that fits counts.
CRITICAL = r"(?i)\b(fatal|critical|panic|outofmemory|emergency)\b"
ERROR = r"(?i)\b(error|exception|failed|failure|denied|refused)\b"
WARNING = r"(?i)\b(warn|warning|timeout|timed out|retry|throttl\w*|slow)\b"
IP_PATTERN = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
ARN_MASK = r"arn:aws[\w-]*:\S+"
UUID_MASK = r"\b[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\b"
HEX_MASK = r"\b(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{8,}\b"
TIME_PATTERN = r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\b"


def line_severity(line: Column) -> Column:
    return (
        F.when(line.rlike(CRITICAL), "critical").when(line.rlike(ERROR), "error")
        .when(line.rlike(WARNING), "warning").otherwise("info")
    )


def line_findings(lines: DataFrame) -> DataFrame:
    """Severity, resources, addresses and the written time of each line."""
    line = F.col("line")
    return lines.select(
        *[c for c in lines.columns if c != "line"], line_severity(line).alias("severity"),
        find_arns(line).alias("resource_arns"),
        F.regexp_extract_all(line, F.lit(IP_PATTERN), F.lit(0)).alias("addresses"),
        F.nullif(F.regexp_extract(line, TIME_PATTERN, 0), F.lit("")).alias("written_time"), "line",
    )


def template(line: Column) -> Column:
    """Line with resource ids, UUIDs, long hexadecimal runs and numbers masked, so that like lines fall together."""
    for pattern, mark in ((ARN_MASK, "<arn>"), (UUID_MASK, "<uuid>"), (HEX_MASK, "<hex>"), (r"\d+", "#")):
        line = F.regexp_replace(line, pattern, mark)
    return line


def file_digest(lines: DataFrame, top: int | None = None) -> DataFrame:
    """Templates per file by falling number of lines, with their rank; with ``top`` only the best.

    Lines fold to templates before any of them meet, and only the best ``top`` of each task go on.
    """
    line = F.col("line")
    counted = (
        lines.select("file_name", line_severity(line).alias("severity"), template(line).alias("template"))
        .groupBy("file_name", "severity", "template").agg(F.count(F.lit(1)).alias("lines"))
    )
    rank = F.row_number().over(Window.partitionBy("file_name").orderBy(F.desc("lines"), "severity", "template"))
    ranked = counted.withColumn("rank", rank)
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def file_overview(lines: DataFrame) -> DataFrame:
    """Lines per severity and the number of different resources per file.

    Lines fold per file and resource first: what meets per file is one row per resource.
    """
    rows = lines.select(
        "file_name", line_severity(F.col("line")).alias("severity"), F.posexplode_outer(find_arns(F.col("line"))).alias("pos", "arn"))
    first = F.coalesce("pos", F.lit(0)) == 0  # a line counts once, however many resources it names
    per_resource = rows.groupBy("file_name", "arn").agg(
        F.count_if(first).alias("lines"),
        F.count_if(first & (F.col("severity") == "critical")).alias("critical_lines"),
        F.count_if(first & (F.col("severity") == "error")).alias("error_lines"),
    )
    return per_resource.groupBy("file_name").agg(
        F.sum("lines").alias("lines"), F.sum("critical_lines").alias("critical_lines"), F.sum("error_lines").alias("error_lines"),
        F.count("arn").alias("resources"),
    )


def rank_files(lines: DataFrame, pattern: str, top: int | None = None, literal: bool = True) -> DataFrame:
    """Files by falling number of lines that hold the pattern; with ``top`` only the first."""
    fits = F.contains(F.lower("line"), F.lit(pattern.lower())) if literal else F.col("line").rlike(pattern)
    ranked = lines.where(fits).groupBy("file_name").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "file_name")
    return ranked if top is None else ranked.limit(top)


def recent_errors(lines: DataFrame, hours: int = 1) -> DataFrame:
    """Error lines of the last hours before the newest line."""
    newest = lines.agg((F.max("ts") - F.expr(f"interval {hours} hours")).alias("since"))
    severity = line_severity(F.col("line"))
    return lines.where(F.col("ts") >= newest.scalar()).withColumn("severity", severity).where(
        F.col("severity").isin("error", "critical")
    )


def timeline(lines: DataFrame, window: str = "1 hour") -> DataFrame:
    """Lines per time window and severity, with the first and last of them."""
    return (
        lines.select("ts", line_severity(F.col("line")).alias("severity"))
        .groupBy(F.window("ts", window).alias("w"), "severity")
        .agg(F.count(F.lit(1)).alias("lines"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        .select(F.col("w.start").alias("window_start"), "severity", "lines", "first_ts", "last_ts")
    )


def incident_aggregates() -> list[Column]:
    """What is known of an incident: its last signal, how many there were, the worst, and the first message of an error."""
    rank = F.col("rank")
    return [
        F.max("ts").alias("last_ts"), F.count("rank").alias("signals"), F.count_if(rank == 2).alias("errors"), F.max("rank").alias("worst"),
        F.min_by("message", F.when(rank == 2, F.struct("ts", "seq", "pos"))).alias("first_error"),
    ]


def incident_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "arn", F.col("w.start").cast("timestamp_ntz").alias("first_ts"), F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "signals", "errors",
        F.when(F.col("worst") == 2, "error").otherwise("warning").alias("status"), "first_error",
    )


def incidents(signals: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Signals of a resource that follow each other by no more than ``gap``, as one incident.

    ``signals``: arn, ts, seq, pos, message, rank (see :func:`lograph.operators.health.health_signals`); those without a time belong to none.
    Sessions are merged in each task before they are shuffled (``session.SETTINGS``), so a resource with many signals sends few rows.
    """
    timed = signals.where("ts is not null").withColumn("ts", F.col("ts").cast("timestamp"))
    return incident_rows(timed.groupBy("arn", F.session_window("ts", gap).alias("w")).agg(*incident_aggregates()))


def finding_rules() -> dict[str, Column]:
    """Validity rules of a finding, for :func:`lograph.functions.checks.split_valid`."""
    return {
        "bad_severity": checks.one_of(F.col("severity"), SEVERITIES),
        "blank_file": checks.not_blank(F.col("source_file")),
        "no_message": F.col("message").isNotNull(),
    }
