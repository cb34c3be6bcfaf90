import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folds import fold_health
from lograph.operators import health as H

NODES = "arn string, status string, last_error string, error_count bigint, last_seen timestamp_ntz"
FINDINGS = "seq bigint, ts timestamp_ntz, severity string, message string, resource_arns array<string>"
ARNS = ["arn:aws:lambda:us-east-1:1:function:f", "arn:aws:s3:::b/x/", "arn:aws:s3:::b", "arn:aws:rds:::db:d", "arn:aws:ec2:::gone"]
START = dt.datetime(2024, 1, 1)


def batch(seed):
    rng = random.Random(seed)
    kinds = ["info", "warning", "error", "critical"]
    findings = []
    for seq in range(60):
        arns = [ARNS[0] if rng.random() < 0.5 else rng.choice(ARNS) for _ in range(rng.randrange(0, 4))]
        # Times run against the order on purpose: order decides, not time.
        findings.append((seq, START + dt.timedelta(minutes=rng.randrange(500)), rng.choice(kinds), f"m{seq}", arns))
    nodes = {
        ARNS[0]: ("unknown", None, 0, None), "arn:aws:s3:::b": (rng.choice(["healthy", "warning", "error"]), "old", 3, START),
        ARNS[3]: ("healthy", None, 0, START),
    }
    return nodes, findings


@pytest.mark.parametrize("seed", range(4))
def test_state_and_audit_match_the_loop(spark, seed):
    nodes, findings = batch(seed)
    frame = spark.createDataFrame([(a, *v) for a, v in nodes.items()], NODES)
    rows = spark.createDataFrame(findings, FINDINGS)
    want, want_audit = fold_health(nodes, findings)
    state = H.health_state(rows, frame).select("arn", "status", "last_error", "error_count", "last_seen").collect()
    assert {r["arn"]: tuple(r)[1:] for r in state} == want
    audit = H.health_audit(rows, frame, "b", block_rows=7)
    before = F.coalesce(
        F.get_json_object("previous_value", "$.status"), F.get_json_object("new_value", "$.error_count"))
    got = audit.select("seq", "pos", "resource_arn", "change_type", before.alias("b")).collect()
    assert sorted(map(tuple, got)) == sorted((s, p, a, k, str(b)) for s, p, a, k, b in want_audit)


def test_two_batches_add_up(spark):
    nodes, findings = batch(9)
    frame = spark.createDataFrame([(a, *v) for a, v in nodes.items()], NODES)
    first = H.health_state(spark.createDataFrame(findings[:30], FINDINGS), frame)
    both = H.health_state(spark.createDataFrame(findings[30:], FINDINGS), first)
    want, _ = fold_health(nodes, findings)
    assert {r["arn"]: tuple(r)[1:] for r in both.select("arn", "status", "last_error", "error_count", "last_seen").collect()} == want


def test_audit_ids_repeat_and_are_valid(spark):
    from lograph.functions.checks import valid_uuid

    nodes, findings = batch(2)
    frame = spark.createDataFrame([(a, *v) for a, v in nodes.items()], NODES)
    audit = H.health_audit(spark.createDataFrame(findings, FINDINGS), frame, "b")
    assert audit.where(~valid_uuid(F.col("change_id"))).count() == 0
    again = H.health_audit(spark.createDataFrame(findings, FINDINGS), frame, "b")
    assert audit.select("change_id").exceptAll(again.select("change_id")).count() == 0
    assert audit.select("change_id").distinct().count() == audit.count()


def test_history_filters_are_anded_and_since_is_inclusive(spark):
    rows = [(1, 0, START, "a", "node_added", "human_input"), (2, 0, START + dt.timedelta(1), "a", "edge_added", "human_input"),
            (3, 0, START, "b", "node_added", "log_analysis")]
    audit = spark.createDataFrame(rows, "seq bigint, pos int, ts timestamp_ntz, resource_arn string, change_type string, source string")
    assert [r["seq"] for r in H.change_history(audit).collect()] == [1, 3, 2]
    assert [r["seq"] for r in H.change_history(audit, resource_arn="a", since=F.lit(START)).collect()] == [1, 2]
    assert [r["seq"] for r in H.change_history(audit, change_type="node_added", source="log_analysis").collect()] == [3]
    assert [r["seq"] for r in H.change_history(audit, since=F.lit(START + dt.timedelta(1))).collect()] == [2]
