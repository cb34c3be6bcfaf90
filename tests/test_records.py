import datetime as dt
import json

from pyspark.sql import functions as F

from lograph.operators import replies as P
from lograph.operators import reports as S
from lograph.sinks import tables as B
from lograph.sources import records

AT = dt.datetime(2024, 1, 1)
GOOD = {"change_id": "12345678-1234-5678-1234-567812345678", "timestamp": "2024-01-01T00:00:00", "resource_arn": "a", "change_type": "node_added",
        "source": "human_input", "triggered_by": "operator:x", "description": "d", "previous_value": None, "new_value": {"k": 1}}


def test_findings_get_defaults_and_bad_ones_are_set_apart(spark):
    lines = spark.createDataFrame([
        (1, '{"source_file":"f","severity":"error","message":"m"}'), (2, '{"source_file":"f","severity":"odd","message":"m"}'), (3, "{broken"),
    ], "seq bigint, json string")
    good, bad = records.findings(lines, F.lit(AT).cast("timestamp_ntz"))
    row = good.first()
    assert (row["seq"], row["ts"], row["resource_arns"], row["line_numbers"], row["context"]) == (1, AT, [], [], {})
    assert {r["seq"]: r["errors"] for r in bad.collect()} == {2: ["bad_severity"], 3: ["bad_severity", "blank_file", "no_message"]}


def test_audit_lines(spark):
    rows = [(1, json.dumps(GOOD)), (2, "  "), (3, json.dumps({**GOOD, "change_type": "odd"})), (4, json.dumps({**GOOD, "change_id": "x", "timestamp": "?"}))]
    good, bad = records.audit(spark.createDataFrame(rows, "seq bigint, json string"))
    assert [(r["seq"], r["timestamp"], json.loads(r["new_value"])) for r in good.collect()] == [(1, AT, {"k": 1})]
    assert {r["seq"]: r["errors"] for r in bad.collect()} == {3: ["bad_change_type"], 4: ["bad_change_id", "bad_time"]}


def test_states_sort_their_sets_and_unreadable_ones_count_as_none(spark):
    docs = spark.createDataFrame([('{"iteration":2,"investigated_logs":["b","a","b"],"is_resolved":false,"log_dir":"/l"}',), ("{broken",), ("{}",)], "json string")
    got = sorted((r["log_dir"], r["iteration"], r["max_iterations"], r["investigated_logs"], r["is_resolved"]) for r in records.states(docs).collect())
    assert got == [("", 0, 10, [], False), ("/l", 2, 10, ["a", "b"], False)]


def test_reports_are_written_as_json_lines(spark, tmp_path):
    replies = spark.createDataFrame([(1, '{"root_cause_chain":["a"],"source_evidence":[{"excerpt":"e"},"plain"]}')], "response_id bigint, response string")
    B.write_reports(S.report_fields(replies), str(tmp_path / "r"))
    row = spark.read.json(str(tmp_path / "r")).first()
    assert row["root_cause_chain"] == ["a"] and row["source_evidence"] == ['{"excerpt":"e"}', '"plain"']


def test_audit_goes_out_as_json_lines(spark, tmp_path):
    audit = spark.createDataFrame([(GOOD["change_id"], AT, "a", "node_added", "human_input", "operator:x", "d", None, "{}", 7, 2)], B.AUDIT)
    B.audit_json(audit, str(tmp_path / "a"))
    B.audit_json(audit, str(tmp_path / "a"))
    back = spark.read.text(str(tmp_path / "a")).select(F.monotonically_increasing_id().alias("seq"), F.col("value").alias("json"))
    good, bad = records.audit(back)
    assert good.count() == 2 and bad.count() == 0
    assert [(r["seq"], r["pos"]) for r in spark.read.json(str(tmp_path / "a")).collect()] == [(7, 2)] * 2


def test_existing_counts_as_older_than_any_reply(spark):
    replies = spark.createDataFrame([(0, '{"nodes":[{"arn":"a","name":"new"}]}')], "response_id bigint, response string")
    old = spark.createDataFrame([("a", "t", "old")], "arn string, resource_type string, name string")
    assert tuple(P.merged_nodes(replies, old).first()) == ("a", "t", "new")
