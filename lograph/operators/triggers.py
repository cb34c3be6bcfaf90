"""Trigger events: kind, fields and the job they start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import INVESTIGATE_TOOL, UPDATE_TOOL
from lograph.functions import replies as R


def route_triggers(events: DataFrame, default_tool: str = UPDATE_TOOL) -> DataFrame:
    """Classify raw events and name the job to start. Works on a batch and on a stream.

    Storage events need ``s3`` in the first record; monitoring events a source and a detail. Only a
    monitoring event with an error pattern starts an investigation. ``events``: ``event`` as JSON text.
    """
    data = F.col("data")
    is_storage = R.has(data, "$.Records[0].s3")
    is_alarm = ~is_storage & R.has(data, "$.source") & R.has(data, "$.detail")
    pattern = R.text_at(data, "$.detail.errorPattern")
    return events.withColumn("data", F.try_parse_json("event")).select(
        *[c for c in events.columns if c != "event"],
        F.when(is_storage, "s3_event").when(is_alarm, "cloudwatch_event").otherwise("unknown").alias("trigger_type"),
        F.when(is_storage, F.coalesce(R.text_at(data, "$.Records[0].s3.bucket.name"), F.lit(""))).alias("bucket"),
        F.when(is_storage, F.coalesce(R.text_at(data, "$.Records[0].s3.object.key"), F.lit(""))).alias("key"),
        F.when(is_alarm, R.text_at(data, "$.source")).alias("event_source"),
        F.when(is_alarm, R.text_at(data, "$.detail.resourceArn")).alias("target_arn"),
        F.when(is_alarm, pattern).alias("error_pattern"),
        F.when(is_alarm & (F.coalesce(pattern, F.lit("")) != ""), INVESTIGATE_TOOL).otherwise(default_tool).alias("tool"),
    )
