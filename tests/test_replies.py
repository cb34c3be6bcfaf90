import pytest
from pyspark.sql import functions as F

from lograph.functions import replies as R
from lograph.operators import replies as P
from lograph.operators import reports as S
from lograph.operators import triggers as T

X = "x"


@pytest.fixture
def replies(spark):
    return lambda *texts: spark.createDataFrame(list(enumerate(texts)), "response_id bigint, response string")


@pytest.mark.parametrize("text,want", [
    ('a {"b":{}} c', '{"b":{}}'), ("} {", None), ("none", None), ("{", None), ("}", None), ("{}", "{}"), ("x{\n1}y}", "{\n1}y}"),
])
def test_span(one, text, want):
    assert one(R.json_span(F.col(X)), x=text) == want


@pytest.mark.parametrize("json,want", [
    ('{}', 0.5), ('{"confidence":0.7}', 0.7), ('{"confidence":1}', 1.0), ('{"confidence":"HIGH"}', 0.85), ('{"confidence":"low risk"}', 0.3),
    ('{"confidence":"VERY LOW"}', 0.9), ('{"confidence":"85%"}', 0.5), ('{"confidence":" 0.75 "}', 0.75), ('{"confidence":"  "}', 0.5),
    ('{"confidence":null}', 0.5), ('{"confidence":"0.9d"}', 0.5), ('{"confidence":true}', 1.0), ('{"confidence":[1]}', 0.5),
    ('{"confidence":"1e-1"}', 0.1), ('{"confidence":"medium"}', 0.6), ('{"confidence":1,"confidence":0.2}', 0.2),
])
def test_confidence(one, json, want):
    assert one(R.confidence(R.parse_object(F.col(X))), x=json) == pytest.approx(want)


def test_texts_keep_a_single_string_whole(one):
    data = R.parse_object(F.col(X))
    assert one(R.texts_at(data, "$.c"), x='{"c":"abc"}') == ["abc"]
    assert one(R.texts_at(data, "$.c"), x='{"c":["a",1,{"k":2}]}') == ["a", "1", '{"k":2}']
    assert one(R.texts_at(data, "$.c"), x='{"c":{"k":1}}') == ['{"k":1}']
    assert one(R.texts_at(data, "$.c"), x='{"c":null}') == []
    assert one(R.texts_at(data, "$.c"), x="{}") == []


def test_log_requests(one):
    data = R.parse_object(F.col(X))
    text = '{"request_logs":["a",{"name":"n","file":"f"},{"path":"p"},{"other":1},7,{"filename":3}]}'
    assert one(R.log_requests(data), x=text) == ["a", "f", "p", "3"]
    assert one(R.log_requests(data), x="nothing") == []


def test_nodes_take_the_last_repeat_and_defaults(replies):
    rows = P.reply_nodes(replies('{"nodes":[{"resource_id":"a:b","name":"one"},{"arn":"c"},{"resource_id":"","arn":"a:b","resource_type":"t"},{"name":"x"}]}'))
    assert sorted(tuple(r)[1:] for r in rows.collect()) == [("a:b", "t", "b"), ("c", "unknown", "c")]


def test_bad_reply_keeps_the_graph(replies, spark):
    found = replies('{"nodes":[{"resource_id":"a","name":"A"}],"edges":[{"source_id":"a","target_id":"b"},{"source_id":"a","target_id":"b"}]}',
                    "broken {", '{"nodes":[{"resource_id":"a","resource_type":"t"}]}')
    old = spark.createDataFrame([("z", "zt", "Z"), ("a", "old", "old")], "arn string, resource_type string, name string")
    assert sorted(map(tuple, P.merged_nodes(found, old).collect())) == [("a", "t", "A"), ("z", "zt", "Z")]
    assert [tuple(r) for r in P.merged_edges(found).collect()] == [("a", "b", "connected_to")]
    assert P.reply_edges(found).count() == 2
    assert [r["response_id"] for r in P.rejects(found).collect()] == [1]


def test_report_of_a_broken_reply(replies):
    row = S.report_fields(replies("x" * 600)).first()
    assert (row["confidence"], row["hypothesis"], row["root_cause_chain"], row["parsed"]) == (0.3, "x" * 600, [], False)


def test_chain_roles(replies):
    reports = S.report_fields(replies('{"root_cause_chain":["a","b","c"]}', '{"root_cause_chain":["a"]}', '{"root_cause_chain":"one thing"}'))
    got = sorted((r["response_id"], r["pos"], r["arn"], r["role"]) for r in S.chain_roles(reports).collect())
    assert got == [(0, 0, "a", "ROOT CAUSE"), (0, 1, "b", "PROPAGATION"), (0, 2, "c", "SURFACE"), (1, 0, "a", "ROOT CAUSE"),
                   (2, 0, "one thing", "ROOT CAUSE")]


def test_report_text(replies, spark):
    found = replies(
        '{"root_cause_chain":["svc:a","b"],"confidence":"HIGH","narrative":["n1","n2"],"affected_resources":["b"],'
        '"suggested_remediation":["r1","r2"],"source_evidence":["plain",{"excerpt":"' + "e" * 600 + '","relevance":"why"}]}')
    nodes = spark.createDataFrame([("b", "t", "Bee")], "arn string, resource_type string, name string")
    lines = S.report_lines(S.report_fields(found), nodes).orderBy("section_no", "item_no", "line_no")
    assert [r["line"] for r in lines.collect()] == [
        "# Incident Report", "", "Confidence: 0.85", "", "## Incident Timeline", "", "n1", "n2", "", "## Root Cause Chain", "",
        "### 1. a — ROOT CAUSE", "- ID: `svc:a`", "", "### 2. Bee — SURFACE", "- ID: `b`", "", "## Affected Resources", "", "- Bee — `b`", "",
        "## Recommended Action", "", "r1\nr2", "", "## Source Evidence", "", "### Evidence 0", "", "plain", "",
        "### Evidence 1: `unknown`", "", "**Relevance:** why", "", "```", "e" * 600, "```", ""]


def test_actions(replies):
    rows = {r["response_id"]: r for r in P.reply_actions(replies(
        'go {"action":"tool","tool":"t","params":{"log_dir":"/x","n":1}}', '{"action":"tool","params":{}}', '{"message":"hi"}',
        " plain ", '{"action":"other"}'), "/logs").collect()}
    assert (rows[0]["tool"], rows[0]["log_dir"], rows[0]["message"]) == ("t", "/x", None)
    assert (rows[1]["tool"], rows[1]["log_dir"]) == ("", "/logs")
    assert (rows[2]["action"], rows[2]["message"]) == ("respond", "hi")
    assert (rows[3]["action"], rows[3]["message"]) == ("respond", "plain")
    assert (rows[4]["action"], rows[4]["message"], rows[4]["tool"]) == ("other", '{"action":"other"}', None)


@pytest.mark.parametrize("event,kind,tool", [
    ('{"Records":[{"s3":{"bucket":{"name":"b"},"object":{"key":"k"}}},{"sns":{}}]}', "s3_event", "topology_update"),
    ('{"Records":[{"sns":{}},{"s3":{}}]}', "unknown", "topology_update"),
    ('{"Records":[],"source":"x","detail":{}}', "cloudwatch_event", "topology_update"),
    ('{"source":"x","detail":{"errorPattern":"OOM"}}', "cloudwatch_event", "error_root_cause"),
    ('{"source":"x","detail":{"errorPattern":""}}', "cloudwatch_event", "topology_update"),
    ('{"source":"x"}', "unknown", "topology_update"), ("broken", "unknown", "topology_update"),
    ('{"Records":[{"s3":{}}],"source":"x","detail":{"errorPattern":"OOM"}}', "s3_event", "topology_update"),
])
def test_triggers(spark, event, kind, tool):
    row = T.route_triggers(spark.createDataFrame([(1, event)], "id int, event string")).first()
    assert (row["trigger_type"], row["tool"]) == (kind, tool)


def test_file_overview_counts_lines_once_and_resources_closely(spark):
    from lograph.operators import findings as N
    arn = "arn:aws:ec2:us-east-1:1:instance/i-"
    rows = [("f", f"ERROR {arn}{i} and {arn}{i + 1000}") for i in range(300)] + [("f", "FATAL none"), ("g", "fine")]
    got = {r["file_name"]: r for r in N.file_overview(spark.createDataFrame(rows, "file_name string, line string")).collect()}
    assert (got["f"]["lines"], got["f"]["error_lines"], got["f"]["critical_lines"]) == (301, 300, 1)
    assert abs(got["f"]["resources"] - 600) < 60
    assert (got["g"]["lines"], got["g"]["resources"]) == (1, 0)


def test_reports_tell_when_how_deep_and_at_what_cost(spark):
    replies = spark.createDataFrame([(1, '{"root_cause_chain":["arn:aws:s3:::b/x/"],"confidence":"HIGH"}', 4), (2, "no json", None)], "response_id bigint, response string, rounds int")
    reports = S.report_fields(replies, F.col("rounds"))
    assert {r["response_id"]: r["iterations_used"] for r in reports.collect()} == {1: 4, 2: 0}
    nodes = spark.createDataFrame([], "arn string, name string, resource_type string")
    usage = spark.createDataFrame([(3, 1.5, 60)], "sessions bigint, credits double, seconds bigint")
    lines = S.report_lines(reports, nodes, generated_at=F.expr("timestamp_ntz '2024-01-02 03:04:05'"), usage=usage)
    text = [r["line"] for r in lines.where("response_id = 1").orderBy("section_no", "item_no", "line_no").collect()]
    assert text[:5] == ["# Incident Report", "", "Generated: 2024-01-02 03:04:05 UTC", "Confidence: 0.85", "Investigation depth: 4 iterations"]
    assert text[-6:] == ["| Metric | Value |", "|--------|-------|", "| Sessions | 3 |", "| Credits | 1.5 |", "| Time | 60s |", ""]
    assert S.report_lines(reports, nodes).where("line like 'Generated%' or section_no = 7").count() == 0
    none = S.report_lines(reports, nodes, usage=usage.limit(0)).where("line = '| Sessions | 0 |'")
    assert none.count() == 2
    findings = spark.createDataFrame([(1, "m1", ["arn:aws:s3:::b/y/", "arn:aws:s3:::b"]), (2, "m2", ["other"]), (3, "m3", None)], "seq bigint, message string, resource_arns array<string>")
    chains = spark.createDataFrame([(1, ["arn:aws:s3:::b", "arn:aws:s3:::b"]), (2, [])], "response_id bigint, root_cause_chain array<string>")
    assert [tuple(r) for r in S.supporting_findings(chains, findings).collect()] == [(1, 1, "m1")]
