"""Health of resources from findings: the state, and the audit of each step.

An error never goes back to a warning. The state needs no order beyond three mergeable aggregates,
so it works batch by batch and as a stream; only the audit needs running values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import UNKNOWN
from lograph.functions.arn import normalize_arn
from lograph.functions.text import change_id
from lograph.operators.running import BLOCK_ROWS, with_running


def severity_rank(severity: Column) -> Column:
    return F.when(severity.isin("error", "critical"), 2).when(severity == "warning", 1).otherwise(0)


def status_rank(status: Column) -> Column:
    return F.when(status == "error", 2).when(status == "warning", 1).otherwise(0)


def health_signals(findings: DataFrame) -> DataFrame:
    """One row per finding and resource that can change health. A resource named twice counts twice."""
    return (
        findings.withColumn("rank", severity_rank(F.col("severity")))
        .where("rank > 0")
        .select("seq", "ts", "message", "rank", F.posexplode(F.array_compact("resource_arns")).alias("pos", "raw_arn"))
        .select("seq", "pos", "ts", "message", "rank", normalize_arn(F.col("raw_arn")).alias("arn"))
    )


def fold_aggregates(order: Column | None = None) -> list[Column]:
    """Aggregates of a resource's signals, ordered by (seq, pos), never by arrival."""
    order = F.struct("seq", "pos") if order is None else order
    is_error = F.col("rank") == 2
    return [
        F.max("rank").alias("worst"),
        F.count_if(is_error).alias("errors"),
        F.max_by("message", F.when(is_error, order)).alias("error_message"),
        F.max_by("ts", F.when(is_error, order)).alias("error_ts"),
        F.max_by("ts", F.when(F.col("rank") == 1, order)).alias("warning_ts"),
    ]


def apply_fold(nodes: DataFrame, folded: DataFrame) -> DataFrame:
    """Nodes with their next health. ``nodes``: arn, status, last_error, error_count, last_seen."""
    was_error = F.col("status") == "error"
    worst = F.greatest(status_rank(F.col("status")), F.coalesce("worst", F.lit(0)))
    others = [c for c in nodes.columns if c not in ("arn", "status", "last_error", "error_count", "last_seen")]
    return nodes.join(folded, "arn", "left").select(
        "arn", *others,
        F.when(worst == 2, "error").when(worst == 1, "warning").otherwise(F.col("status")).alias("status"),
        F.when(F.col("errors") > 0, F.col("error_message")).otherwise(F.col("last_error")).alias("last_error"),
        (F.col("error_count") + F.coalesce("errors", F.lit(0))).alias("error_count"),
        F.coalesce("error_ts", F.when(~was_error, F.col("warning_ts")), "last_seen").alias("last_seen"),
    )


def health_state(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """Health after all findings. Signals fold per resource before they meet the nodes."""
    return apply_fold(nodes, health_signals(findings).groupBy("arn").agg(*fold_aggregates()))


def with_unknown_health(nodes: DataFrame) -> DataFrame:
    """Fresh nodes: unknown, no error seen."""
    return nodes.withColumns({
        "status": F.lit(UNKNOWN),
        "last_error": F.lit(None).cast("string"),
        "error_count": F.lit(0).cast("bigint"),
        "last_seen": F.lit(None).cast("timestamp_ntz"),
    })


def health_audit(
    findings: DataFrame, nodes: DataFrame, batch: str, triggered_by: str = "graph_merge", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One audit row per status change, and one per further error with its count before and after."""
    known = nodes.select("arn", F.col("status").alias("status0"), F.col("error_count").alias("count0"))
    signals = with_running(
        health_signals(findings),
        keys=["arn"],
        order=["seq", "pos"],
        values={"worst": ("max", F.col("rank")), "errors": ("sum", F.when(F.col("rank") == 2, 1).otherwise(0))},
        block_rows=block_rows,
        base=known,
    )
    steps = signals.withColumns({
        "before": F.greatest(status_rank(F.col("status0")), F.coalesce("worst", F.lit(0))),
        "count_before": F.col("count0") + F.col("errors"),
    }).where("before < rank or (rank = 2 and before = 2)")
    return audit_rows(steps, batch, triggered_by)


def audit_rows(steps: DataFrame, batch: str, triggered_by: str, *more: str) -> DataFrame:
    """Audit rows of steps: signals with the status rank and the error count before each, and the status at the start."""
    status_before = F.when(F.col("before") == 2, "error").when(F.col("before") == 1, "warning").otherwise(F.col("status0"))
    again, fails = F.col("before") == 2, F.col("rank") == 2

    def counted(n: Column) -> Column:
        return F.concat(F.lit('{"error_count":'), n.cast("string"), F.lit("}"))

    moved = F.concat(F.lit("Health changed from '"), status_before)
    return steps.select(
        *more, "seq", "pos", "ts",
        change_id(F.lit(batch), F.col("seq"), F.col("pos")).alias("change_id"),
        F.col("arn").alias("resource_arn"),
        F.when(again, "health_error_recorded").otherwise("health_status_changed").alias("change_type"),
        F.lit("log_analysis").alias("source"),
        F.lit(triggered_by).alias("triggered_by"),
        F.when(again, F.concat(F.lit("Additional error recorded: "), "message"))
        .when(fails, F.concat(moved, F.lit("' to 'error': "), "message"))
        .otherwise(F.concat(moved, F.lit("' to 'warning'"))).alias("description"),
        F.when(again, counted(F.col("count_before")))
        .otherwise(F.to_json(F.struct(status_before.alias("status")))).alias("previous_value"),
        F.when(again, counted(F.col("count_before") + 1))
        .when(fails, F.to_json(F.struct(F.lit("error").alias("status"), F.col("message").alias("last_error"))))
        .otherwise(F.to_json(F.struct(F.lit("warning").alias("status")))).alias("new_value"),
    )


def health_summary(nodes: DataFrame) -> DataFrame:
    """Resources and errors by type and status, with subtotals per type and in all."""
    return nodes.rollup("resource_type", "status").agg(
        F.count(F.lit(1)).alias("resources"), F.sum("error_count").alias("errors"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def change_history(
    audit: DataFrame,
    resource_arn: str | None = None,
    since: Column | None = None,
    change_type: str | None = None,
    source: str | None = None,
    order: tuple[str, ...] = ("seq", "pos"),
) -> DataFrame:
    """Audit rows that meet every given filter, oldest first, ties in list order. Reads fresh and stored audit rows."""
    time = "timestamp" if "timestamp" in audit.columns else "ts"
    if resource_arn:
        audit = audit.where(F.col("resource_arn") == resource_arn)
    if since is not None:
        audit = audit.where(F.col(time) >= since)
        if "day" in audit.columns:  # the stored audit has a folder per day
            audit = audit.where(F.col("day") >= F.to_date(since))
    if change_type:
        audit = audit.where(F.col("change_type") == change_type)
    if source:
        audit = audit.where(F.col("source") == source)
    return audit.orderBy(time, *order)
