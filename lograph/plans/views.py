"""Adapter views: log data shaped from the given tables, in SQL that both Spark and DuckDB run."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.session import configure

# View name: the tables or views it reads.
READS = {
    "findings_v": ["events"],
    "edits_v": ["orders"],
    "edit_nodes_v": ["nation"],
    "edit_edges_v": ["supplier"],
    "ledger_v": ["orders"],
    "known_v": ["ledger_v", "orders"],
    "incoming_v": ["lineitem", "orders"],
    "responses_v": ["conversations"],
    "usage_v": ["conversations"],
    "graph_v": ["orders", "customer", "supplier", "nation", "region"],
    "graph_health_v": ["graph_v"],
    "triggers_v": ["events"],
    "loglines_v": ["events"],
}

SQL = {
    "findings_v": """
SELECT event_id AS seq, ts,
  'svc_' || CAST(user_id % 7 AS STRING) || '.log' AS source_file,
  CASE WHEN event_type = 'error' AND value >= 100 THEN 'critical' WHEN event_type = 'error' THEN 'error'
       WHEN event_type = 'signup' THEN 'warning' ELSE 'info' END AS severity,
  CASE event_id % 13 WHEN 0 THEN 'Invoked handler' WHEN 1 THEN 'slow query on table'
    WHEN 2 THEN 'insert failed' WHEN 3 THEN 'connection timeout' WHEN 4 THEN 'access denied'
    WHEN 5 THEN 'route to backend' WHEN 6 THEN 'publish failed' WHEN 7 THEN 'row contention'
    WHEN 8 THEN 'replica lag' WHEN 9 THEN 'target unhealthy' WHEN 10 THEN 'input rejected'
    WHEN 11 THEN 'clock skew' ELSE 'health check ok' END AS message,
  CASE event_id % 3 WHEN 0 THEN 'arn:aws:lambda:us-east-1:123456789012:function:fn-' || CAST(user_id AS STRING)
    WHEN 1 THEN 'arn:aws:rds:eu-west-1:123456789012:db:db-' || CAST(user_id % 4 AS STRING)
    ELSE 'arn:aws:s3:::bucket-' || CAST(user_id % 5 AS STRING) || '/logs/' || event_type || '/' END AS arn1,
  CASE event_id % 4 WHEN 0 THEN NULL
    WHEN 1 THEN 'arn:aws:dynamodb:us-west-2:123456789012:table/t-' || CAST(user_id % 6 AS STRING)
    WHEN 2 THEN 'arn:aws:s3:::bucket-' || CAST(user_id % 5 AS STRING) || '/other/'
    ELSE 'arn:aws:ec2::123456789012:instance/i-' || CAST(user_id % 9 AS STRING) || '/' END AS arn2
FROM events
""",
    "edits_v": """
SELECT o_orderkey AS seq,
  CASE (o_orderkey + o_custkey) % 6 WHEN 0 THEN 'add_node' WHEN 1 THEN 'remove_node' WHEN 2 THEN 'add_edge'
    WHEN 3 THEN 'remove_edge' WHEN 4 THEN 'update_health' ELSE 'annotate' END AS action,
  'node-' || CAST(o_custkey % 40 AS STRING) AS arn,
  'node-' || CAST((o_custkey * 7 + o_orderkey) % 40 AS STRING) AS target_arn,
  CASE WHEN o_orderkey % 2 = 0 THEN 'depends_on' ELSE 'invokes' END AS relationship,
  CASE o_orderstatus WHEN 'F' THEN 'error' WHEN 'P' THEN 'warning' ELSE 'healthy' END AS status,
  'note ' || o_orderpriority AS note,
  CASE o_orderkey % 4 WHEN 0 THEN 'lambda:function' WHEN 1 THEN 'rds:db' WHEN 2 THEN 's3:b' ELSE 'ecs:svc' END AS resource_type
FROM orders
""",
    "edit_nodes_v": """
SELECT 'node-' || CAST(n_nationkey AS STRING) AS arn, 'ec2:instance' AS resource_type, n_name AS name FROM nation
""",
    "edit_edges_v": """
SELECT DISTINCT 'node-' || CAST(s_suppkey % 40 AS STRING) AS source_arn,
  'node-' || CAST(s_nationkey % 40 AS STRING) AS target_arn, 'depends_on' AS relationship FROM supplier
""",
    "ledger_v": """
SELECT 's3_bucket:bucket-' || CAST(o_custkey % 5 AS STRING) || ':' || CAST(o_orderkey AS STRING) || '.log' AS unique_id,
  's3_bucket' AS source_type, 'bucket-' || CAST(o_custkey % 5 AS STRING) AS source_identifier,
  CAST(o_orderkey AS STRING) || '.log' AS key,
  CASE WHEN o_orderstatus = 'F' THEN NULL ELSE '/logs/' || CAST(o_orderkey AS STRING) END AS local_path,
  o_orderdate AS downloaded_at, o_orderstatus = 'F' AS is_purged,
  CASE WHEN o_orderstatus = 'F' AND o_orderkey % 10 <> 0 THEN o_orderdate END AS purged_at
FROM orders
""",
    # A ledger that does not know some of the logs yet.
    "known_v": """
SELECT l.* FROM ledger_v l JOIN orders ON key = CAST(o_orderkey AS STRING) || '.log' WHERE o_orderpriority <> '1-URGENT'
""",
    "incoming_v": """
SELECT 's3_bucket:bucket-' || CAST(o_custkey % 5 AS STRING) || ':' || CAST(o_orderkey AS STRING) || '.log' AS unique_id,
  l_shipdate AS ts, CAST(l_quantity AS BIGINT) AS size_bytes
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
    "responses_v": """
SELECT conv_id * 1000 + turn AS response_id,
  CASE (conv_id + turn) % 5
    WHEN 0 THEN 'Here you go: {"nodes":[{"resource_id":"svc-' || CAST(conv_id AS STRING) || '","name":"Svc","resource_type":"app"},{"arn":"arn:aws:sqs:us-east-1:1:q-' || CAST(turn AS STRING) || '"},{"name":"no id"}],"edges":[{"source_id":"svc-' || CAST(conv_id AS STRING) || '","target_arn":"arn:aws:sqs:us-east-1:1:q-' || CAST(turn AS STRING) || '"},{"source_id":"","target_id":"x"}]} Done {'
    WHEN 1 THEN '{"request_logs":["a.log",{"file":"b.log","name":"z"},{"path":"c.log"},{"other":1}],"reasoning":"r"}'
    WHEN 2 THEN '{"root_cause_chain":["svc-1","svc-2","svc-3"],"confidence":"' || CASE turn % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'very low' WHEN 2 THEN '0.75' ELSE '85%' END || '","narrative":"n","suggested_remediation":["x","y"],"source_evidence":["plain",{"source_file":"a.log","excerpt":"e"}]}'
    WHEN 3 THEN 'no json here'
    ELSE '{"broken": [1, ' END AS response
FROM conversations
""",
    "usage_v": """
SELECT conv_id, turn, 'session-' || CAST(conv_id AS STRING) AS label,
  CASE conv_id % 4 WHEN 0 THEN 'haiku' WHEN 1 THEN 'sonnet' WHEN 2 THEN 'claude-opus-4.6' ELSE 'other-model' END AS model,
  CASE WHEN conv_id % 5 = 0 THEN 0 ELSE length(text) END AS input_tokens,
  CASE WHEN conv_id % 5 = 0 THEN 0 ELSE length(text) * 2 END AS output_tokens,
  length(text) AS input_chars, length(text) * 3 AS output_chars,
  turn * 700 + conv_id % 900 AS duration_ms,
  CASE WHEN turn % 3 = 0 THEN 0.5 ELSE 0.0 END AS total_cost_usd
FROM conversations
""",
    "graph_v": """
SELECT DISTINCT 'order-' || CAST(o_orderkey % 500 AS STRING) AS source_arn, 'cust-' || CAST(o_custkey AS STRING) AS target_arn, 'depends_on' AS relationship FROM orders
UNION SELECT DISTINCT 'cust-' || CAST(c_custkey AS STRING), 'nation-' || CAST(c_nationkey AS STRING), 'depends_on' FROM customer
UNION SELECT DISTINCT 'supp-' || CAST(s_suppkey AS STRING), 'nation-' || CAST(s_nationkey AS STRING), 'depends_on' FROM supplier
UNION SELECT DISTINCT 'nation-' || CAST(n_nationkey AS STRING), 'region-' || CAST(n_regionkey AS STRING), 'routes_to' FROM nation
UNION SELECT DISTINCT 'region-' || CAST(r_regionkey AS STRING), 'nation-' || CAST(r_regionkey AS STRING), 'reads_from' FROM region
""",
    "graph_health_v": """
SELECT arn, CASE WHEN arn NOT LIKE 'region-%' AND (arn LIKE '%3' OR arn LIKE '%0') THEN 'error' ELSE 'healthy' END AS status
FROM (SELECT source_arn AS arn FROM graph_v UNION SELECT target_arn FROM graph_v) n
""",
    "triggers_v": """
SELECT event_id,
  CASE event_id % 6
    WHEN 0 THEN '{"Records":[{"s3":{"bucket":{"name":"b' || CAST(user_id AS STRING) || '"},"object":{"key":"k/' || CAST(event_id AS STRING) || '.log"}}},{"s3":{}}]}'
    WHEN 1 THEN '{"source":"aws.cloudwatch","detail":{"resourceArn":"arn:' || CAST(user_id AS STRING) || '","errorPattern":"OOM"}}'
    WHEN 2 THEN '{"source":"aws.cloudwatch","detail":{"resourceArn":"arn:' || CAST(user_id AS STRING) || '","errorPattern":""}}'
    WHEN 3 THEN '{"Records":[],"source":"x","detail":{}}'
    WHEN 4 THEN '{"Records":[{"sns":{}}]}'
    ELSE '{"foo":1}' END AS event
FROM events
""",
    "loglines_v": """
SELECT event_id AS line_no, ts, 'svc_' || CAST(user_id % 7 AS STRING) || '.log' AS file_name,
  CASE event_type WHEN 'error' THEN '[ERROR]' WHEN 'signup' THEN 'WARN:' WHEN 'purchase' THEN 'FATAL' ELSE 'info' END
  || ' req=' || CAST(event_id AS STRING) || ' arn:aws:lambda:us-east-1:123456789012:function:fn-' || CAST(user_id AS STRING)
  || ' ' || CASE event_id % 4 WHEN 0 THEN 'connection timeout' WHEN 1 THEN 'OutOfMemory killed' WHEN 2 THEN 'access denied' ELSE 'done' END
  || ' from 10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(event_id % 250 AS STRING) AS line
FROM events
""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(spark: SparkSession, sf_dir: str, name: str, frames: dict[str, DataFrame]) -> DataFrame:
    """A view's SQL over frames. They are registered under names of their folder, so queries over two folders do not mix."""
    sql, folder = SQL[name], hashlib.md5(sf_dir.encode()).hexdigest()[:12]
    for source, frame in frames.items():
        own = f"{source}_{'stream' if frame.isStreaming else 'table'}_{folder}"
        frame.createOrReplaceTempView(own)
        sql = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {own}", sql)
    return spark.sql(sql)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view over the tables in ``sf_dir``."""
    return _over(spark, sf_dir, name, {
        source: view(spark, sf_dir, source) if source in SQL else table(spark, sf_dir, source) for source in READS[name]})


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a file stream. The pattern matches a single file as well as a folder of files."""
    path = f"{sf_dir}/{name}.parque[t]"
    return spark.readStream.schema(table(spark, sf_dir, name).schema).option("maxFilesPerTrigger", 16).parquet(path)


def view_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view over one table, as a stream."""
    (source,) = READS[name]
    return _over(spark, sf_dir, name, {source: table_stream(spark, sf_dir, source)})


def with_arrays(findings: DataFrame) -> DataFrame:
    """Findings with their resources as an array."""
    return findings.withColumn("resource_arns", F.array_compact(F.array("arn1", "arn2"))).drop("arn1", "arn2")


def oracle(body: str, *views: str) -> str:
    """Oracle SQL: the body behind the views it reads."""
    needed: list[str] = []
    for name in views:
        needed += [d for d in READS[name] if d in SQL and d not in needed]
        needed += [name] if name not in needed else []
    parts = [f"{name} AS ({SQL[name]})" for name in needed]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE"):]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(parts) + ", " + body[len("WITH"):]
    return "WITH " + ", ".join(parts) + " " + body if parts else body
