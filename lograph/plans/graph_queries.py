"""Queries on findings and the graph they build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.functions import arn as A
from lograph.operators import graph as G
from lograph.operators import health as H
from lograph.plans.views import oracle, table, view, with_arrays

BATCH = "batch-1"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_arrays(view(spark, sf_dir, "findings_v"))


def fresh_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_unknown_health(G.resource_nodes(findings(spark, sf_dir)))


def as_text(entries: Column) -> Column:
    """A map as sorted ``key=value`` text."""
    return F.array_join(
        F.transform(F.array_sort(F.map_entries(entries)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","
    )


def arn_fields(spark, sf_dir):
    arns = findings(spark, sf_dir).select(F.explode("resource_arns").alias("arn")).distinct()
    arn = F.col("arn")
    return arns.select(
        "arn", A.normalize_arn(arn).alias("normalized"), A.resource_type(arn).alias("resource_type"),
        A.resource_name(arn).alias("name"), A.region(arn).alias("region"), A.safe_name(arn).alias("safe_id"),
    )


def line_arns(spark, sf_dir):
    lines = view(spark, sf_dir, "loglines_v")
    return lines.select(F.explode(A.find_arns(F.col("line"))).alias("arn")).groupBy("arn").agg(
        F.count(F.lit(1)).alias("lines"))


def graph_nodes(spark, sf_dir):
    return G.resource_nodes(findings(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return G.resource_edges(findings(spark, sf_dir))


def relationship_counts(spark, sf_dir):
    weights = G.edge_weights(findings(spark, sf_dir))
    return weights.groupBy("relationship").agg(
        F.count(F.lit(1)).alias("edges"), F.sum("request_count").alias("mentions"))


def edge_weights(spark, sf_dir):
    return G.edge_weights(findings(spark, sf_dir))


def health_state(spark, sf_dir):
    state = H.health_state(findings(spark, sf_dir), fresh_nodes(spark, sf_dir))
    return state.select("arn", "status", "last_error", "error_count", "last_seen")


def labelled_edges(spark, sf_dir):
    found = findings(spark, sf_dir)
    return G.labelled_edges(G.resource_edges(found), G.resource_nodes(found)).select(
        "source_label", "relationship", "target_label", "source_arn", "target_arn")


def graph_size(spark, sf_dir):
    found = findings(spark, sf_dir)
    return G.graph_size(G.resource_nodes(found), G.resource_edges(found))


def stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topology known beforehand: functions seen in sign-ups, and the nations."""
    signups = table(spark, sf_dir, "events").where("event_type = 'signup'").select("user_id").distinct()
    functions = signups.select(
        F.concat(F.lit("arn:aws:lambda:us-east-1:123456789012:function:fn-"), F.col("user_id").cast("string")).alias("arn"),
        F.lit("lambda:old").alias("resource_type"), F.concat(F.lit("old-"), F.col("user_id").cast("string")).alias("name"),
        F.create_map(F.lit("owner"), F.lit("team"), F.lit("region"), F.lit("stale")).alias("metadata"),
    )
    nations = view(spark, sf_dir, "edit_nodes_v").select(
        "arn", "resource_type", "name", F.create_map(F.lit("owner"), F.lit("ops")).alias("metadata"))
    return functions.unionByName(nations)


def _merged_nodes(spark, sf_dir):
    resources = G.resource_nodes(findings(spark, sf_dir)).withColumn(
        "properties", F.create_map(F.lit("region"), F.col("region")))
    return G.merge_nodes(stored_nodes(spark, sf_dir), resources)


def node_merge(spark, sf_dir):
    return _merged_nodes(spark, sf_dir).select("arn", "resource_type", "name", as_text(F.col("metadata")).alias("metadata"), "added")


def node_merge_audit(spark, sf_dir):
    return G.node_audit(_merged_nodes(spark, sf_dir), BATCH)


def metadata_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("k"), F.lit("old")).alias("older"),
        F.from_json("props", "map<string,string>").alias("newer"))
    return rows.select("event_id", as_text(G.merge_maps(F.col("older"), F.col("newer"))).alias("metadata"))


def _merged_edges(spark, sf_dir):
    found = findings(spark, sf_dir)
    stored = G.edge_weights(found.where("severity = 'info'"))
    return G.merge_edges(stored, G.resource_edges(found))


def edge_merge(spark, sf_dir):
    return _merged_edges(spark, sf_dir)


def edge_merge_audit(spark, sf_dir):
    return G.edge_audit(_merged_edges(spark, sf_dir), BATCH)


def _audit(spark, sf_dir):
    return H.health_audit(findings(spark, sf_dir), fresh_nodes(spark, sf_dir), BATCH)


AUDIT_COLUMNS = ["seq", "pos", "ts", "change_id", "resource_arn", "change_type", "description", "previous_value", "new_value"]


def health_audit(spark, sf_dir):
    return _audit(spark, sf_dir).select(*AUDIT_COLUMNS).withColumn("pos", F.col("pos").cast("bigint"))


def health_summary(spark, sf_dir):
    return H.health_summary(H.health_state(findings(spark, sf_dir), fresh_nodes(spark, sf_dir)))


def change_history(spark, sf_dir):
    history = H.change_history(
        _audit(spark, sf_dir), since=F.expr("timestamp_ntz '2024-01-15 00:00:00'"),
        change_type="health_error_recorded", source="log_analysis")
    return history.select("seq", "ts", "resource_arn", "description", "new_value")


QUERIES = {f.__name__: f for f in [
    arn_fields, line_arns, graph_nodes, graph_edges, relationship_counts, edge_weights, health_state, labelled_edges,
    graph_size, node_merge, node_merge_audit, metadata_merge, edge_merge, edge_merge_audit, health_audit, health_summary,
    change_history,
]}


# Oracle side ---------------------------------------------------------------------------------

def norm(a: str) -> str:
    return f"regexp_replace({a}, '^(arn:aws:s3:::[^/]*)/.*$', '\\1')"


def rtype(a: str) -> str:
    s = f"string_split({a}, ':')"
    return f"CASE WHEN len({s}) >= 6 THEN {s}[3] || ':' || string_split({s}[6], '/')[1] ELSE 'unknown' END"


def rname(a: str) -> str:
    tail = f"string_split({norm(a)}, ':')[-1]"
    return (f"CASE WHEN len(string_split({norm(a)}, ':')) >= 6 THEN "
            f"coalesce(list_filter(string_split({tail}, '/'), lambda s: s <> '')[-1], {tail}) ELSE {norm(a)} END")


def rregion(a: str) -> str:
    return f"coalesce(nullif(string_split({a}, ':')[4], ''), 'us-east-1')"


def rel(m: str) -> str:
    def has(*words):
        return " OR ".join(f"contains(lower({m}), '{w}')" for w in words)
    return (f"CASE WHEN {has('invok')} THEN 'invokes' WHEN {has('read', 'get', 'query', 'select')} THEN 'reads_from' "
            f"WHEN {has('write', 'put', 'insert', 'update')} THEN 'writes_to' "
            f"WHEN {has('timeout', 'latency', 'slow')} THEN 'depends_on' "
            f"WHEN {has('denied', 'unauthorized', 'forbidden')} THEN 'access_denied_to' "
            f"WHEN {has('route', 'backend', 'forward')} THEN 'routes_to' WHEN {has('publish', 'notify')} THEN 'publishes_to' "
            f"WHEN {has('block', 'lock', 'contention')} THEN 'blocks' "
            f"WHEN {has('replica', 'replication')} THEN 'replicates_to' ELSE 'connected_to' END")


def uuid_of(*parts: str) -> str:
    h = "md5(concat_ws('|', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"
    return f"substr({h},1,8)||'-'||substr({h},9,4)||'-'||substr({h},13,4)||'-'||substr({h},17,4)||'-'||substr({h},21,12)"


NODES_CTE = f"""
raw AS (SELECT arn1 AS a FROM findings_v UNION SELECT arn2 FROM findings_v WHERE arn2 IS NOT NULL),
nodes AS (SELECT arn, {rtype('arn')} AS resource_type, {rname('arn')} AS name, {rregion('arn')} AS region
          FROM (SELECT DISTINCT {norm('a')} AS arn FROM raw))"""
MENTIONS_CTE = f"""
pairs AS (SELECT seq, severity, {rel('message')} AS relationship, {norm('arn1')} AS a1, {norm('arn2')} AS a2 FROM findings_v
          WHERE arn2 IS NOT NULL),
mentions AS (SELECT seq, severity, relationship,
    CASE WHEN string_split(a1, ':')[3] IN ('rds','s3','dynamodb','sqs','sns','kinesis') THEN a2 ELSE a1 END AS source_arn,
    CASE WHEN string_split(a1, ':')[3] IN ('rds','s3','dynamodb','sqs','sns','kinesis') THEN a1 ELSE a2 END AS target_arn
  FROM pairs WHERE a1 <> a2),
edges AS (SELECT source_arn, target_arn, relationship, min(seq) AS first_seq, count(*) AS request_count,
    count(*) FILTER (severity IN ('error','critical')) AS error_count FROM mentions GROUP BY ALL)"""
SIGNALS_CTE = f"""
signals AS (
  SELECT seq, pos, ts, message, r, {norm('a')} AS arn FROM (
    SELECT seq, 0 AS pos, ts, message, severity, arn1 AS a FROM findings_v
    UNION ALL SELECT seq, 1, ts, message, severity, arn2 FROM findings_v WHERE arn2 IS NOT NULL) x,
    LATERAL (SELECT CASE WHEN severity IN ('error','critical') THEN 2 WHEN severity = 'warning' THEN 1 ELSE 0 END AS r)),
state AS (
  SELECT arn, CASE max(r) WHEN 2 THEN 'error' WHEN 1 THEN 'warning' ELSE 'unknown' END AS status,
    arg_max(message, seq * 2 + pos) FILTER (r = 2) AS last_error, count(*) FILTER (r = 2) AS error_count,
    coalesce(arg_max(ts, seq * 2 + pos) FILTER (r = 2), arg_max(ts, seq * 2 + pos) FILTER (r = 1)) AS last_seen
  FROM signals GROUP BY arn)"""
AUDIT_CTE = SIGNALS_CTE + f""",
steps AS (SELECT *, coalesce(max(r) OVER w, 0) AS rb, count(*) FILTER (r = 2) OVER w AS nb FROM signals
  WINDOW w AS (PARTITION BY arn ORDER BY seq, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
audit AS (SELECT seq, CAST(pos AS BIGINT) AS pos, ts, {uuid_of("'batch-1'", 'seq', 'pos')} AS change_id, arn AS resource_arn,
  CASE WHEN rb = 2 THEN 'health_error_recorded' ELSE 'health_status_changed' END AS change_type,
  CASE WHEN rb = 2 THEN 'Additional error recorded: ' || message
       WHEN r = 2 THEN 'Health changed from ''' || was || ''' to ''error'': ' || message
       ELSE 'Health changed from ''unknown'' to ''warning''' END AS description,
  CASE WHEN rb = 2 THEN '{{"error_count":' || nb || '}}' ELSE '{{"status":"' || was || '"}}' END AS previous_value,
  CASE WHEN rb = 2 THEN '{{"error_count":' || (nb + 1) || '}}'
       WHEN r = 2 THEN '{{"status":"error","last_error":"' || message || '"}}' ELSE '{{"status":"warning"}}' END AS new_value
  FROM (SELECT *, CASE rb WHEN 1 THEN 'warning' ELSE 'unknown' END AS was FROM steps) WHERE r = 2 OR (r = 1 AND rb = 0))"""
STORED_CTE = """
stored AS (
  SELECT 'arn:aws:lambda:us-east-1:123456789012:function:fn-' || user_id AS arn, 'lambda:old' AS resource_type,
    'old-' || user_id AS name, 'team' AS owner FROM (SELECT DISTINCT user_id FROM events WHERE event_type = 'signup')
  UNION ALL SELECT arn, resource_type, name, 'ops' FROM edit_nodes_v),
merged AS (SELECT coalesce(s.arn, n.arn) AS arn, coalesce(s.resource_type, n.resource_type) AS resource_type,
  coalesce(s.name, n.name) AS name,
  CASE WHEN s.arn IS NULL THEN '' WHEN n.arn IS NOT NULL THEN 'owner=' || owner || ',region=' || n.region
       WHEN owner = 'team' THEN 'owner=team,region=stale' ELSE 'owner=ops' END AS metadata,
  s.arn IS NULL AS added
  FROM stored s FULL JOIN nodes n ON s.arn = n.arn)"""
EDGE_MERGE_CTE = """
stored_edges AS (SELECT source_arn, target_arn, relationship, count(*) AS request_count, 0 AS error_count
  FROM mentions WHERE severity = 'info' GROUP BY ALL),
merged_edges AS (SELECT *, false AS added FROM stored_edges UNION ALL
  SELECT source_arn, target_arn, relationship, 0, 0, true FROM edges e WHERE NOT EXISTS (
    SELECT 1 FROM stored_edges s WHERE s.source_arn = e.source_arn AND s.target_arn = e.target_arn
      AND s.relationship = e.relationship))"""


def on_findings(ctes: str, body: str, *more: str) -> str:
    return oracle(f"WITH {ctes} {body}", "findings_v", *more)


ORACLES = {
    "arn_fields": on_findings(NODES_CTE, f"""SELECT a AS arn, {norm('a')} AS normalized, {rtype('a')} AS resource_type,
        {rname('a')} AS name, {rregion('a')} AS region, replace(replace(a, ':', '_'), '/', '_') AS safe_id FROM raw"""),
    "line_arns": oracle("""SELECT regexp_extract(line, 'arn:aws:[^ ]*') AS arn, count(*) AS lines FROM loglines_v
        GROUP BY 1""", "loglines_v"),
    "graph_nodes": on_findings(NODES_CTE, "SELECT * FROM nodes"),
    "graph_edges": on_findings(MENTIONS_CTE, "SELECT source_arn, target_arn, relationship, first_seq FROM edges"),
    "relationship_counts": on_findings(MENTIONS_CTE, """SELECT relationship,
        count(DISTINCT source_arn || '|' || target_arn) AS edges, count(*) AS mentions FROM mentions GROUP BY 1"""),
    "edge_weights": on_findings(MENTIONS_CTE, "SELECT source_arn, target_arn, relationship, first_seq, request_count, error_count FROM edges"),
    "health_state": on_findings(SIGNALS_CTE, "SELECT * FROM state"),
    "labelled_edges": on_findings(NODES_CTE + "," + MENTIONS_CTE, """SELECT s.name AS source_label, relationship,
        t.name AS target_label, source_arn, target_arn FROM edges JOIN nodes s ON s.arn = source_arn
        JOIN nodes t ON t.arn = target_arn"""),
    "graph_size": on_findings(NODES_CTE + "," + MENTIONS_CTE, """SELECT (SELECT count(*) FROM nodes) AS node_count,
        (SELECT count(*) FROM edges) AS edge_count"""),
    "node_merge": on_findings(NODES_CTE + "," + STORED_CTE, "SELECT * FROM merged", "edit_nodes_v"),
    "node_merge_audit": on_findings(NODES_CTE + "," + STORED_CTE, f"""SELECT {uuid_of("'batch-1'", "'node'", 'arn')} AS change_id,
        arn AS resource_arn, 'node_added' AS change_type, 'resource_discovery' AS source, 'graph_merge' AS triggered_by,
        'Added node ' || name || ' (' || resource_type || ')' AS description, CAST(NULL AS VARCHAR) AS previous_value,
        '{{"arn":"' || arn || '","resource_type":"' || resource_type || '","name":"' || name || '"}}' AS new_value
        FROM merged WHERE added""", "edit_nodes_v"),
    "metadata_merge": """SELECT event_id, 'k=' || json_extract_string(props, '$.k') || ',type=' || event_type AS metadata
        FROM events""",
    "edge_merge": on_findings(MENTIONS_CTE + "," + EDGE_MERGE_CTE, "SELECT * FROM merged_edges"),
    "edge_merge_audit": on_findings(MENTIONS_CTE + "," + EDGE_MERGE_CTE, f"""SELECT
        {uuid_of("'batch-1'", "'edge'", 'source_arn', 'target_arn', 'relationship')} AS change_id, source_arn AS resource_arn,
        'edge_added' AS change_type, 'resource_discovery' AS source, 'graph_merge' AS triggered_by,
        'Added edge ' || source_arn || ' --' || relationship || '--> ' || target_arn AS description,
        CAST(NULL AS VARCHAR) AS previous_value,
        '{{"source_arn":"' || source_arn || '","target_arn":"' || target_arn || '","relationship":"' || relationship || '"}}'
        AS new_value FROM merged_edges WHERE added"""),
    "health_audit": on_findings(AUDIT_CTE, "SELECT * FROM audit"),
    "health_summary": on_findings(SIGNALS_CTE, f"""SELECT resource_type, status, count(*) AS resources,
        CAST(sum(error_count) AS BIGINT) AS errors, CAST(grouping(resource_type, status) AS BIGINT) AS level
        FROM (SELECT {rtype('arn')} AS resource_type, status, error_count FROM state) GROUP BY ROLLUP (resource_type, status)"""),
    "change_history": on_findings(AUDIT_CTE, """SELECT seq, ts, resource_arn, description, new_value FROM audit
        WHERE ts >= TIMESTAMP '2024-01-15' AND change_type = 'health_error_recorded'"""),
}
