"""Queries on batches of operator edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.operators import edits as E
from lograph.plans import jobs
from lograph.plans.graph_queries import as_text, uuid_of
from lograph.plans.views import oracle, view
from lograph.session import scratch_path, written
from lograph.sources import snapshots


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edits_v").withColumnRenamed("note", "text").withColumns({
        "name": F.concat(F.lit("name "), "arn"),
        "last_error": F.when(F.col("status") == "error", F.col("text")),
        "metadata": F.create_map(F.lit("origin"), F.col("resource_type")),
    })


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edit_nodes_v").withColumns({
        "status": F.lit("unknown"), "last_error": F.lit(None).cast("string"),
        "metadata": F.create_map(F.lit("origin"), F.lit("stored")), "error_count": F.length("arn").cast("bigint"),
        "last_seen": F.expr("timestamp_ntz '2024-01-15 12:30:00'"),
    })


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "edit_edges_v").withColumns({
        "request_count": (10 * F.length("source_arn")).cast("bigint"), "error_count": F.length("target_arn").cast("bigint")})


def edit_nodes(spark, sf_dir):
    return E.edited_nodes(nodes(spark, sf_dir), edits(spark, sf_dir)).withColumn("metadata", as_text(F.col("metadata")))


def edit_edges(spark, sf_dir):
    batch = edits(spark, sf_dir)
    removals = E.node_removals(E.node_steps(nodes(spark, sf_dir), batch))
    return E.edited_edges(edges(spark, sf_dir), batch, removals).drop("added_seq")


def edit_audit(spark, sf_dir):
    batch = edits(spark, sf_dir)
    steps = written(E.node_steps(nodes(spark, sf_dir), batch), "node_steps")
    edge_rows = E.edge_steps(edges(spark, sf_dir), batch, E.node_removals(steps))
    return E.edit_audit(steps, edge_rows, "op-7", "edits-1")


def edit_job(spark, sf_dir):
    """The same batch applied to a stored topology, twice: the second time changes nothing."""
    root = scratch_path(spark, "edit_job")
    at = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    stored = nodes(spark, sf_dir).select(
        "arn", "resource_type", "name", F.struct("status", "last_error", "error_count", "last_seen").alias("health"), "metadata")
    placed = edges(spark, sf_dir).withColumn("position", F.monotonically_increasing_id())
    snapshots.write_snapshot(stored, placed, f"{root}/topology", at)
    for _ in range(2):
        jobs.apply_edits(spark, root, edits(spark, sf_dir), "op-7", "edits-1", at)
    after, _ = snapshots.read_snapshot(spark, f"{root}/topology")
    return after.select("arn", "resource_type", "name", "health.*", as_text(F.col("metadata")).alias("metadata"))


QUERIES = {f.__name__: f for f in [edit_nodes, edit_edges, edit_audit, edit_job]}

NODE_CTE = """
ev AS (SELECT -1 AS seq, 'add_node' AS action, arn, 'unknown' AS status, NULL AS last_error, NULL AS note, resource_type, name,
    'stored' AS origin, length(arn) AS errors, TIMESTAMP '2024-01-15 12:30:00' AS seen FROM edit_nodes_v
  UNION ALL SELECT seq, action, arn, status, CASE WHEN status = 'error' THEN note END, note, resource_type, 'name ' || arn,
    resource_type, 0, NULL FROM edits_v WHERE action IN ('add_node', 'remove_node', 'update_health', 'annotate')),
ex AS (SELECT *, coalesce(last_value(CASE action WHEN 'add_node' THEN true WHEN 'remove_node' THEN false END IGNORE NULLS) OVER
    (PARTITION BY arn ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS ex FROM ev),
eff AS (SELECT *, count(*) FILTER (action = 'add_node') OVER (PARTITION BY arn ORDER BY seq) AS inc FROM ex
    WHERE ex <> (action = 'add_node')),
sets AS (SELECT *, CASE WHEN action = 'update_health' OR seq = -1 THEN status WHEN action = 'add_node' THEN 'unknown' END AS set_status,
    CASE WHEN action = 'update_health' THEN last_error END AS set_error, CASE WHEN action = 'annotate' THEN note END AS set_note,
    first_value(resource_type) OVER i AS btype, first_value(name) OVER i AS bname, first_value(origin) OVER i AS borigin, first_value(errors) OVER i AS berrors, first_value(seen) OVER i AS bseen
    FROM eff WINDOW i AS (PARTITION BY arn, inc ORDER BY seq)),
old AS (SELECT *, last_value(set_status IGNORE NULLS) OVER w AS old_status, last_value(set_error IGNORE NULLS) OVER w AS old_error,
    last_value(set_note IGNORE NULLS) OVER w AS old_note FROM sets
    WINDOW w AS (PARTITION BY arn, inc ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
EDGE_CTE = NODE_CTE + """,
universe AS (SELECT source_arn, target_arn, relationship FROM edit_edges_v UNION
  SELECT arn, target_arn, relationship FROM edits_v WHERE action IN ('add_edge', 'remove_edge')),
tl AS (SELECT -1 AS seq, source_arn, target_arn, relationship, true AS up, 'stored' AS kind FROM edit_edges_v
  UNION ALL SELECT seq, arn, target_arn, relationship, action = 'add_edge', action FROM edits_v WHERE action IN ('add_edge', 'remove_edge')
  UNION ALL SELECT DISTINCT e.seq, u.source_arn, u.target_arn, u.relationship, false, 'cascade' FROM eff e JOIN universe u
    ON e.action = 'remove_node' AND (e.arn = u.source_arn OR e.arn = u.target_arn)),
tx AS (SELECT *, coalesce(lag(up) OVER (PARTITION BY source_arn, target_arn, relationship ORDER BY seq), false) AS was FROM tl)"""
FINAL = ("coalesce({m} || ',', '') || 'origin=' || borigin").format(m="'human_annotation=' || fnote")
ORACLES = {
    "edit_nodes": oracle(f"""WITH {NODE_CTE},
        fin AS (SELECT arn, inc, any_value(btype) AS resource_type, any_value(bname) AS name, any_value(borigin) AS borigin,
            any_value(berrors) AS error_count, any_value(bseen) AS last_seen,
            arg_max(set_status, seq) AS status, arg_max(set_error, seq) AS last_error, arg_max(set_note, seq) AS fnote,
            bool_or(action = 'remove_node') AS gone FROM sets GROUP BY arn, inc)
        SELECT arn, resource_type, name, status, last_error, error_count, last_seen, {FINAL} AS metadata FROM fin f
        WHERE NOT gone AND inc = (SELECT max(inc) FROM fin g WHERE g.arn = f.arn)""", "edits_v", "edit_nodes_v"),
    "edit_edges": oracle(f"""WITH {EDGE_CTE} SELECT source_arn, target_arn, relationship,
          CAST(CASE WHEN bool_and(up) AND bool_or(kind = 'stored') THEN 10 * length(source_arn) ELSE 0 END AS BIGINT) AS request_count,
          CAST(CASE WHEN bool_and(up) AND bool_or(kind = 'stored') THEN length(target_arn) ELSE 0 END AS BIGINT) AS error_count FROM tl
        GROUP BY source_arn, target_arn, relationship HAVING arg_max(up, seq)""", "edits_v", "edit_nodes_v", "edit_edges_v"),
    "edit_audit": oracle(f"""WITH {EDGE_CTE},
        rows AS (SELECT seq, arn AS resource_arn,
          CASE action WHEN 'add_node' THEN 'node_added' WHEN 'remove_node' THEN 'node_removed'
            WHEN 'update_health' THEN 'health_status_changed' ELSE 'human_annotation' END AS change_type,
          CASE action WHEN 'add_node' THEN 'Human added node ' || name || ' (' || resource_type || ')'
            WHEN 'remove_node' THEN 'Human removed node ' || arn
            WHEN 'update_health' THEN 'Human changed health from ''' || old_status || ''' to ''' || status || ''''
            ELSE 'Human annotation: ' || note END AS description,
          CASE action WHEN 'remove_node' THEN '{{"arn":"' || arn || '","resource_type":"' || btype || '","name":"' || bname
              || '","status":"' || old_status || '"' || coalesce(',"last_error":"' || old_error || '"', '')
              || ',"error_count":' || berrors || coalesce(',"last_seen":"' || strftime(bseen, '%Y-%m-%dT%H:%M:%S.%g') || '"', '')
              || ',"metadata":{{"origin":"' || borigin || '"' || coalesce(',"human_annotation":"' || old_note || '"', '') || '}}}}'
            WHEN 'update_health' THEN '{{"status":"' || old_status || '"}}' END AS previous_value,
          CASE action WHEN 'add_node' THEN '{{"resource_type":"' || resource_type || '","name":"' || name
              || '","metadata":{{"origin":"' || origin || '"}}}}'
            WHEN 'update_health' THEN '{{"status":"' || status || '"}}'
            WHEN 'annotate' THEN '{{"annotation":"' || note || '"}}' END AS new_value
          FROM old WHERE seq >= 0
          UNION ALL SELECT seq, source_arn, CASE WHEN up THEN 'edge_added' ELSE 'edge_removed' END,
            CASE WHEN up THEN 'Human added edge ' ELSE 'Human removed edge ' END || source_arn || ' --' || relationship || '--> ' || target_arn,
            CASE WHEN NOT up THEN j END, CASE WHEN up THEN j END
          FROM (SELECT *, '{{"source_arn":"' || source_arn || '","target_arn":"' || target_arn || '","relationship":"' || relationship || '"}}' AS j
            FROM tx WHERE kind IN ('add_edge', 'remove_edge') AND up <> was))
        SELECT *, {uuid_of("'edits-1'", 'seq')} AS change_id, 'human_input' AS source, 'operator:op-7' AS triggered_by FROM rows""",
        "edits_v", "edit_nodes_v", "edit_edges_v"),
}
ORACLES["edit_job"] = ORACLES["edit_nodes"]
