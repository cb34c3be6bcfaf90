"""The question the graph is built for: which resources are unhealthy, and how are they connected?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.operators import graph, health
from lograph.plans.graph_queries import MENTIONS_CTE, NODES_CTE, SIGNALS_CTE, findings
from lograph.plans.views import oracle


def unhealthy_resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unhealthy resources with their errors and the names of what they depend on."""
    found = findings(spark, sf_dir)
    nodes = graph.resource_nodes(found)
    edges = graph.labelled_edges(graph.resource_edges(found), nodes)
    dependencies = edges.groupBy(F.col("source_arn").alias("arn")).agg(
        F.count_distinct("target_arn").alias("dependencies"), F.max("target_label").alias("last_dependency"))
    state = health.health_state(found, health.with_unknown_health(nodes)).where("status in ('error', 'warning')")
    return state.join(dependencies, "arn", "left").select(
        "arn", "name", "resource_type", "status", "error_count", "last_error", "last_seen",
        F.coalesce("dependencies", F.lit(0)).alias("dependencies"), "last_dependency")


QUERIES = {"unhealthy_resources": unhealthy_resources}
ORACLES = {
    "unhealthy_resources": oracle(f"""WITH {NODES_CTE}, {MENTIONS_CTE}, {SIGNALS_CTE},
        d AS (SELECT source_arn AS arn, count(DISTINCT target_arn) AS dependencies, max(name) AS last_dependency
          FROM edges JOIN nodes ON nodes.arn = target_arn GROUP BY 1)
        SELECT arn, name, resource_type, status, error_count, last_error, last_seen, coalesce(dependencies, 0) AS dependencies, last_dependency
        FROM nodes JOIN state USING (arn) LEFT JOIN d USING (arn) WHERE status IN ('error', 'warning')""", "findings_v"),
}
