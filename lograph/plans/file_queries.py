"""Queries on file formats and exports. Where a reader needs files, the tables are first written as such."""

from __future__ import annotations

from pyspark.sql import functions as F

from lograph.functions.tabular import cells, key_values
from lograph.operators import graph as G
from lograph.operators import health as H
from lograph.plans import jobs
from lograph.plans.ledger_jobs import ledger_of
from lograph.plans.event_queries import SEVERE
from lograph.plans.graph_queries import MENTIONS_CTE, NODES_CTE, SIGNALS_CTE, findings, fresh_nodes
from lograph.plans.views import oracle, table, view
from lograph.session import scratch_path
from lograph.sinks import graph_text as X
from lograph.sinks.tables import read_audit
from lograph.sources import files as S
from lograph.sources import readers as R
from lograph.sources import snapshots as V


def printable_strings(spark, sf_dir):
    blobs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    runs = R.printable_lines(blobs)
    return runs.select(F.col("path").cast("bigint").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"),
                       F.length("line").cast("bigint").alias("chars"), F.md5("line").alias("digest"))


CSV_SQL = '''
SELECT o_orderkey, CAST(o_orderkey AS STRING) || ',' || o_orderstatus || CASE o_orderstatus WHEN 'P' THEN '' ELSE ',"' || o_orderpriority || ' ""q"""' END
  || CASE o_orderstatus WHEN 'F' THEN ',extra,' ELSE '' END AS record FROM orders'''


def csv_kv(spark, sf_dir):
    """Rows shorter and longer than the header, with quotes."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    header = cells(F.lit("key,status,priority"))
    rows = spark.sql(CSV_SQL).select("o_orderkey", cells(F.col("record")).alias("row"))
    return rows.select("o_orderkey", key_values(header, F.col("row")).alias("line"))


def csv_files(spark, sf_dir):
    """Customers written as CSV files and read back as text."""
    path = scratch_path(spark, "csv_files")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment").write.option("header", True).csv(path)
    lines = R.csv_lines(S.scan_content(spark, path))
    return lines.where("line_no > 2").select("line")


XML_SQL = """
SELECT CAST(event_id AS STRING) AS path, 'noise' || chr(1) || '<event name="' || event_type || '" id="' || CAST(event_id AS STRING) || '">'
  || '<data unit="ms">' || CAST(user_id AS STRING) || '</data><action><text>a &lt; b</text></action></event>' || chr(2)
  || CASE event_type WHEN 'error' THEN '<event><broken></event>' ELSE '<event id="2"><data/></event>' END AS text FROM events"""


def xml_events(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("events")
    return R.xml_event_lines(spark.sql(XML_SQL)).select("path", "event_no", "line")


def xml_files(spark, sf_dir):
    """Suppliers written as XML files and read back with known fields."""
    path = scratch_path(spark, "xml_files")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    rows.write.format("xml").option("rootTag", "events").option("rowTag", "event").save(path)
    return R.typed_events(spark, path, "s_suppkey bigint, s_name string, s_nationkey bigint")


def log_files(spark, sf_dir):
    """Log lines written as one folder of files per log, scanned by suffix and read back."""
    path = scratch_path(spark, "log_files")
    view(spark, sf_dir, "loglines_v").select("file_name", F.col("line").alias("value")).write.partitionBy("file_name").text(path)
    lines = R.scan_lines(spark, path)
    return lines.groupBy(F.regexp_extract("path", "file_name=([^/]+)/", 1).alias("file_name")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum(F.length("line").cast("bigint")).alias("chars"))


def file_scan(spark, sf_dir):
    """Discovery over two sources, one of them missing: files, sizes and source status."""
    path = scratch_path(spark, "file_scan")
    view(spark, sf_dir, "loglines_v").select("line").write.text(path)
    refs, status = S.discover(spark, [
        {"source_type": "local_file", "identifier": path}, {"source_type": "local_file", "identifier": path + "-missing"}])
    size = refs.agg(F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"))
    return status.select(F.when(F.col("reachable"), "found").otherwise("missing").alias("source"), "reachable",
                         F.when(F.col("reachable"), size.scalar()).otherwise(0).alias("bytes"))


def snapshot_round_trip(spark, sf_dir):
    """Nodes with health written as two versions and read back."""
    path = scratch_path(spark, "snapshot")
    found, fresh = findings(spark, sf_dir), fresh_nodes(spark, sf_dir)
    nodes = H.health_state(found, fresh).select(
        "arn", "resource_type", "name", F.struct("status", "last_error", "error_count", "last_seen").alias("health"),
        F.create_map(F.lit("region"), F.col("region")).alias("metadata"))
    edges = G.edge_weights(found).drop("first_seq")
    at = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    V.write_snapshot(nodes.where("health.status = 'unknown'"), edges.limit(0), path, at)
    V.write_snapshot(nodes, edges, path, at)
    stored, linked = V.read_snapshot(spark, path)
    out = linked.groupBy(F.col("source_arn").alias("arn")).agg(F.sum("request_count").alias("calls"))
    version = V.read_header(spark, path).agg(F.max("version").alias("v"))
    return stored.join(out, "arn", "left").select(
        "arn", "name", F.col("health.status").alias("status"), F.col("health.error_count").alias("error_count"),
        F.col("metadata")["region"].alias("region"), F.coalesce("calls", F.lit(0)).alias("calls"), version.scalar().alias("version"))


def topology_job(spark, sf_dir):
    """The whole update: log files are written, read, turned into findings and merged into a stored topology."""
    root = scratch_path(spark, "topology_job")
    view(spark, sf_dir, "loglines_v").select("file_name", F.col("line").alias("value")).write.partitionBy("file_name").text(f"{root}/logs")
    jobs.update_topology(spark, f"{root}/logs", f"{root}/state", "b1", F.expr("timestamp_ntz '2024-02-01 00:00:00'"))
    nodes, _ = V.read_snapshot(spark, f"{root}/state/topology")
    steps = read_audit(spark, f"{root}/state/audit").groupBy(F.col("resource_arn").alias("arn")).agg(F.count(F.lit(1)).alias("audit_rows"))
    return nodes.join(steps, "arn", "left").select(
        "arn", "name", F.col("health.status").alias("status"), F.col("health.error_count").alias("error_count"), "audit_rows")


def _state(spark, sf_dir, name, times=1):
    """A state folder into which the log lines were brought by one batch, run so many times; logs, state, outcome."""
    root = scratch_path(spark, name)
    view(spark, sf_dir, "loglines_v").select("file_name", F.col("line").alias("value")).write.partitionBy("file_name").text(f"{root}/logs")
    table(spark, sf_dir, "nation").select("n_name").coalesce(1).write.option("extension", "pdf").csv(f"{root}/logs/scans")
    for _ in range(times):
        outcome = jobs.ingest(spark, f"{root}/logs", f"{root}/state", "b1", F.expr("timestamp_ntz '2024-02-01 00:00:00'"))
    return root, outcome


def topology_replay(spark, sf_dir):
    """A batch that runs twice counts once."""
    root, _ = _state(spark, sf_dir, "replay", 2)
    nodes, _ = V.read_snapshot(spark, f"{root}/state/topology")
    steps = read_audit(spark, f"{root}/state/audit").groupBy(F.col("resource_arn").alias("arn")).agg(F.count(F.lit(1)).alias("audit_rows"))
    return nodes.join(steps, "arn", "left").select(
        "arn", "name", F.col("health.status").alias("status"), F.col("health.error_count").alias("error_count"), "audit_rows")


def ingest_outcome(spark, sf_dir):
    """What became of each kind of file, and what the ledger holds."""
    root, outcome = _state(spark, sf_dir, "outcome")
    known = ledger_of(spark, f"{root}/state").newest().select("unique_id", F.lit(True).alias("known"))
    kind = F.when(F.col("path").endswith(".pdf"), "pdf").otherwise(F.regexp_extract("path", "file_name=([^/]+)/", 1))
    return outcome.join(known, "unique_id", "left").groupBy(kind.alias("file_name"), "outcome").agg(
        F.bool_and(F.coalesce("known", F.lit(False))).alias("in_ledger"))


def stored_history(spark, sf_dir):
    """Health changes of the stored audit, in the order of the log lines."""
    root, _ = _state(spark, sf_dir, "history")
    audit = H.change_history(read_audit(spark, f"{root}/state/audit"), change_type="health_error_recorded",
                             since=F.expr("timestamp_ntz '2024-01-31 00:00:00'"))
    return audit.groupBy("resource_arn").agg(F.count(F.lit(1)).alias("steps"), F.max_by("new_value", F.struct("timestamp", "seq", "pos")).alias("last_value"))


def stored_dot(spark, sf_dir):
    root, _ = _state(spark, sf_dir, "dot")
    lines = X.dot_lines(*V.read_snapshot(spark, f"{root}/state/topology"))
    return lines.where("part in (1, 3)").groupBy("part").agg(F.count(F.lit(1)).alias("lines")).withColumn("part", F.col("part").cast("bigint"))


def stored_graphml(spark, sf_dir):
    root, _ = _state(spark, sf_dir, "graphml")
    lines = X.graphml_lines(*V.read_snapshot(spark, f"{root}/state/topology"))
    return lines.where("part in (1, 3)").groupBy("part").agg(F.count(F.lit(1)).alias("lines")).withColumn("part", F.col("part").cast("bigint"))


def _graph(spark, sf_dir):
    found = findings(spark, sf_dir)
    return G.resource_nodes(found), G.edge_weights(found)


def _wide(lines):
    return lines.withColumns({"part": F.col("part").cast("bigint"), "line_no": F.col("line_no").cast("bigint")}).orderBy(*X.ORDER)


def dot_lines(spark, sf_dir):
    return _wide(X.dot_lines(*_graph(spark, sf_dir)))


def graphml_lines(spark, sf_dir):
    return _wide(X.graphml_lines(*_graph(spark, sf_dir)))


QUERIES = {f.__name__: f for f in [
    printable_strings, csv_kv, csv_files, xml_events, xml_files, log_files, file_scan, snapshot_round_trip, topology_job, topology_replay,
    ingest_outcome, stored_history, stored_dot, stored_graphml, dot_lines, graphml_lines,
]}

SAFE = "replace(replace({}, ':', '_'), '/', '_')"
SVC = "string_split(resource_type, ':')[1]"
EDGES = "e AS (SELECT *, row_number() OVER (ORDER BY first_seq, source_arn, target_arn, relationship) - 1 AS edge_no FROM edges)"


def fixed(part: int, lines: list[str]) -> str:
    quoted = ", ".join("'" + line.replace("'", "''") + "'" for line in lines)
    return (f"SELECT CAST({part} AS BIGINT) AS part, '' AS node_id, CAST(0 AS BIGINT) AS edge_no, CAST(i - 1 AS BIGINT) AS line_no, l[i] AS line "
            f"FROM (SELECT l, unnest(generate_series(1, len(l))) AS i FROM (SELECT [{quoted}] AS l))")


def exploded(part: int, source: str, node_id: str, edge_no: str, lines: str) -> str:
    return (f"SELECT {part}, node_id, edge_no, i - 1, l[i] FROM (SELECT *, unnest(generate_series(1, len(l))) AS i FROM "
            f"(SELECT {node_id} AS node_id, {edge_no} AS edge_no, {lines} AS l FROM {source}))")


ORACLES = {
    "printable_strings": r"""SELECT doc_id, CAST(i - 1 AS BIGINT) + 1 AS line_no, length(r[i]) AS chars, md5(r[i]) AS digest FROM (
        SELECT doc_id, r, unnest(generate_series(1, len(r))) AS i FROM (
          SELECT doc_id, regexp_extract_all(text, '[\x20-\x7E\t\n\r]{8,}') AS r FROM documents) WHERE len(r) > 0)""",
    "csv_kv": """SELECT o_orderkey, 'key=' || o_orderkey || ' | status=' || o_orderstatus
        || CASE o_orderstatus WHEN 'P' THEN '' ELSE ' | priority=' || o_orderpriority || ' "q"' END
        || CASE o_orderstatus WHEN 'F' THEN ' | extra | ' ELSE '' END AS line FROM orders""",
    "csv_files": "SELECT 'c_custkey=' || c_custkey || ' | c_name=' || c_name || ' | c_mktsegment=' || c_mktsegment AS line FROM customer",
    "xml_events": """SELECT CAST(event_id AS VARCHAR) AS path, CAST(n AS INTEGER) AS event_no, ls[k] AS line FROM (
        SELECT event_id, n, ls, unnest(generate_series(1, len(ls))) AS k FROM (
        SELECT event_id, 1 AS n, ['[Event 1] event {''name'': ''' || event_type || ''', ''id'': ''' || event_id || '''}', '  data: ' || user_id,
          '  data attrs: {''unit'': ''ms''}', '    text: a < b'] AS ls FROM events
        UNION ALL SELECT event_id, 2, CASE event_type WHEN 'error' THEN ['[Event 2] <event><broken></event>']
          ELSE ['[Event 2] event {''id'': ''2''}'] END FROM events))""",
    "xml_files": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "log_files": oracle("SELECT file_name, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM loglines_v GROUP BY 1", "loglines_v"),
    "file_scan": oracle("""SELECT 'found' AS source, true AS reachable, CAST(sum(length(line) + 1) AS BIGINT) AS bytes FROM loglines_v
        UNION ALL SELECT 'missing', false, 0""", "loglines_v"),
    "snapshot_round_trip": oracle("WITH " + NODES_CTE + "," + MENTIONS_CTE + "," + SIGNALS_CTE + """
        SELECT arn, name, status, error_count, region, coalesce((SELECT CAST(sum(request_count) AS BIGINT) FROM edges WHERE source_arn = arn), 0) AS calls,
          2 AS version FROM nodes JOIN state USING (arn)""", "findings_v"),
    "topology_job": oracle(f"""WITH {SEVERE}, a AS (SELECT *, regexp_extract(line, 'arn:aws:[^ ]*') AS arn FROM l),
        n AS (SELECT arn, count(*) FILTER (severity IN ('error', 'critical')) AS errors, count(*) FILTER (severity = 'warning') AS warnings,
          arg_min(severity, file_name || lpad(CAST(line_no AS VARCHAR), 12, '0')) FILTER (severity <> 'info') AS first_bad FROM a GROUP BY arn)
        SELECT arn, string_split(arn, ':')[-1] AS name, CASE WHEN errors > 0 THEN 'error' WHEN warnings > 0 THEN 'warning' ELSE 'unknown' END AS status,
          errors AS error_count, 1 + errors + CASE WHEN first_bad = 'warning' THEN 1 ELSE 0 END AS audit_rows FROM n""", "loglines_v"),
    "dot_lines": oracle("WITH " + NODES_CTE + "," + MENTIONS_CTE + "," + EDGES + " "
        + fixed(0, X.DOT_HEAD) + " UNION ALL " + fixed(2, [""]) + " UNION ALL " + fixed(4, ["}"]) + " UNION ALL "
        + exploded(1, "nodes", "arn", "0", f"""['    "' || {SAFE.format('arn')} || '" [label="' || name || '\\n' || resource_type || '", fillcolor='
            || CASE {SVC} WHEN 'lambda' THEN 'lightyellow' WHEN 'rds' THEN 'lightblue' WHEN 'dynamodb' THEN 'lightsalmon' WHEN 's3' THEN 'lightgreen'
              WHEN 'ec2' THEN 'wheat' ELSE 'white' END || '];']""") + " UNION ALL "
        + exploded(3, "e", "''", "edge_no", f"""['    "' || {SAFE.format('source_arn')} || '" -> "' || {SAFE.format('target_arn')}
            || '" [label="' || relationship || '"];']"""), "findings_v"),
    "graphml_lines": oracle("WITH " + NODES_CTE + "," + MENTIONS_CTE + "," + EDGES + " "
        + fixed(0, X.GRAPHML_HEAD) + " UNION ALL " + fixed(4, ["  </graph>", "</graphml>"]) + " UNION ALL "
        + exploded(1, "nodes", "arn", "0", f"""['    <node id="' || {SAFE.format('arn')} || '">', '      <data key="arn">' || arn || '</data>',
            '      <data key="resource_type">' || resource_type || '</data>', '      <data key="name">' || name || '</data>', '    </node>']""")
        + " UNION ALL "
        + exploded(3, "e", "''", "edge_no", f"""['    <edge id="e' || edge_no || '" source="' || {SAFE.format('source_arn')} || '" target="'
            || {SAFE.format('target_arn')} || '">', '      <data key="relationship">' || relationship || '</data>',
            '      <data key="request_count">' || request_count || '</data>', '      <data key="error_count">' || error_count || '</data>', '    </edge>']"""),
        "findings_v"),
}
ORACLES["topology_replay"] = ORACLES["topology_job"]
ORACLES["ingest_outcome"] = oracle("""SELECT DISTINCT file_name, 'ingested' AS outcome, true AS in_ledger FROM loglines_v
    UNION ALL SELECT 'pdf', 'format not read', false""", "loglines_v")
ORACLES["stored_history"] = oracle(f"""WITH {SEVERE}, a AS (SELECT regexp_extract(line, 'arn:aws:[^ ]*') AS resource_arn, count(*) AS n FROM l
    WHERE severity IN ('error', 'critical') GROUP BY 1)
    SELECT resource_arn, n - 1 AS steps, '{{"error_count":' || n || '}}' AS last_value FROM a WHERE n > 1""", "loglines_v")
ORACLES["stored_dot"] = oracle("SELECT CAST(1 AS BIGINT) AS part, count(DISTINCT regexp_extract(line, 'arn:aws:[^ ]*')) AS lines FROM loglines_v", "loglines_v")
ORACLES["stored_graphml"] = oracle(
    "SELECT CAST(1 AS BIGINT) AS part, 5 * count(DISTINCT regexp_extract(line, 'arn:aws:[^ ]*')) AS lines FROM loglines_v", "loglines_v")
