"""Stored JSON records as typed rows: gaps get defaults, rows with bad values are set apart, none fails the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.functions import checks
from lograph.operators.findings import finding_rules
from lograph.sinks.tables import audit_rules

_FINDING = (
    "source_file string, timestamp string, severity string, message string, resource_arns array<string>, "
    "raw_lines array<string>, line_numbers array<int>, context map<string,string>"
)
_AUDIT = (
    "change_id string, timestamp string, resource_arn string, change_type string, source string, triggered_by string, "
    "description string, previous_value string, new_value string"
)
_STATE = (
    "iteration int, max_iterations int, investigated_arns array<string>, investigated_logs array<string>, hypothesis string, "
    "root_cause_chain array<string>, is_resolved boolean, started_at string, last_checkpoint_at string, error_pattern string, log_dir string"
)


def _time(text: str, default: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(text).cast("timestamp_ntz"), default)


def _texts(name: str) -> Column:
    return F.coalesce(name, F.expr("cast(array() as array<string>)"))


def findings(lines: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Findings out of JSON lines, and the lines that give none. ``lines``: seq, json."""
    r = F.col("r")
    rows = lines.select("seq", "json", F.from_json("json", _FINDING).alias("r")).select(
        "seq", "json", r["source_file"].alias("source_file"), _time("r.timestamp", as_of).alias("ts"), r["severity"].alias("severity"),
        r["message"].alias("message"), _texts("r.resource_arns").alias("resource_arns"), _texts("r.raw_lines").alias("raw_lines"),
        F.coalesce("r.line_numbers", F.expr("cast(array() as array<int>)")).alias("line_numbers"),
        F.coalesce("r.context", F.expr("cast(map() as map<string,string>)")).alias("context"),
    )
    good, bad = checks.split_valid(rows, finding_rules())
    return good.drop("json"), bad.select("seq", "json", "errors")


def audit(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Audit rows out of JSON lines, and the lines that break a rule. ``lines``: seq, json. Blank lines are skipped."""
    rows = lines.where(checks.not_blank(F.col("json"))).select("seq", "json", F.from_json("json", _AUDIT).alias("r")).select(
        "seq", "json", "r.*").withColumn("timestamp", _time("timestamp", F.lit(None).cast("timestamp_ntz")))
    rules = {**audit_rules(), "bad_time": F.col("timestamp").isNotNull()}
    good, bad = checks.split_valid(rows, rules)
    return good.drop("json"), bad.select("seq", "json", "errors")


def states(documents: DataFrame) -> DataFrame:
    """Investigation states out of JSON documents; one that does not parse counts as none. ``documents``: json."""
    rows = documents.select(F.from_json("json", _STATE, {"mode": "PERMISSIVE"}).alias("r"), F.try_parse_json("json").alias("data"))
    return rows.where("data is not null").select(
        F.coalesce("r.log_dir", F.lit("")).alias("log_dir"), F.coalesce("r.error_pattern", F.lit("")).alias("error_pattern"),
        F.coalesce("r.iteration", F.lit(0)).alias("iteration"), F.coalesce("r.max_iterations", F.lit(10)).alias("max_iterations"),
        F.array_sort(F.array_distinct(_texts("r.investigated_arns"))).alias("investigated_arns"),
        F.array_sort(F.array_distinct(_texts("r.investigated_logs"))).alias("investigated_logs"),
        "r.hypothesis", _texts("r.root_cause_chain").alias("root_cause_chain"), F.coalesce("r.is_resolved", F.lit(False)).alias("is_resolved"),
        _time("r.started_at", F.lit(None).cast("timestamp_ntz")).alias("started_at"),
        _time("r.last_checkpoint_at", F.lit(None).cast("timestamp_ntz")).alias("last_checkpoint_at"),
    )
