"""Dependency graph from findings: nodes, edges, merges into a topology, listings.

Edges carry ``first_seq``, the list position at which they first appear. Duplicates fold in
aggregates, so a hot resource never gathers its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import CALLED_SERVICES
from lograph.functions import arn as A
from lograph.functions.text import change_id
from lograph.operators.running import numbered

EDGE_KEY = ["source_arn", "target_arn", "relationship"]


def resource_nodes(findings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """One node per resource named in ``resource_arns``; nodes already known stay out."""
    arns = findings.select(F.explode(A.normalize_arns(F.col("resource_arns"))).alias("arn")).distinct()
    if existing is not None:
        arns = arns.join(existing.select("arn"), "arn", "left_anti")
    arn = F.col("arn")
    return arns.select(
        "arn", A.resource_type(arn).alias("resource_type"), A.resource_name(arn).alias("name"), A.region(arn).alias("region")
    )


def edge_mentions(findings: DataFrame) -> DataFrame:
    """One row per finding and second or later resource: the edge it speaks for, with its severity.

    The first resource is the log source. It is the caller, unless its service logs the requests
    that come in.
    """
    arns = A.normalize_arns(F.col("resource_arns"))
    pairs = (
        findings.select("seq", "severity", A.relationship(F.col("message")).alias("relationship"), arns.alias("arns"))
        .where(F.size("arns") >= 2)
        .select(
            "seq", "severity", "relationship", F.get("arns", F.lit(0)).alias("log_source"),
            F.posexplode(F.expr("slice(arns, 2, size(arns) - 1)")).alias("pos", "other"),
        )
    )
    called = A.service(F.col("log_source")).isin(CALLED_SERVICES)
    return pairs.select(
        "seq", "pos", "severity",
        F.when(called, F.col("other")).otherwise(F.col("log_source")).alias("source_arn"),
        F.when(called, F.col("log_source")).otherwise(F.col("other")).alias("target_arn"),
        "relationship",
    )


def resource_edges(findings: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Distinct edges with the position of their first mention; known edges stay out."""
    edges = edge_mentions(findings).groupBy(*EDGE_KEY).agg(F.min("seq").alias("first_seq"))
    return edges if existing is None else edges.join(existing.select(*EDGE_KEY), EDGE_KEY, "left_anti")


def edge_weights(findings: DataFrame) -> DataFrame:
    """Where an edge is first mentioned, how often it is, and how often by an error."""
    return edge_mentions(findings).groupBy(*EDGE_KEY).agg(
        F.min("seq").alias("first_seq"),
        F.count(F.lit(1)).alias("request_count"),
        F.count_if(F.col("severity").isin("error", "critical")).alias("error_count"),
    )


def merge_maps(older: Column, newer: Column) -> Column:
    """Later value wins per key."""
    older = F.coalesce(older, F.expr("cast(map() as map<string,string>)"))
    newer = F.coalesce(newer, F.expr("cast(map() as map<string,string>)"))
    return F.map_concat(F.map_filter(older, lambda k, v: ~F.map_contains_key(newer, k)), newer)


def merge_nodes(topology: DataFrame, resources: DataFrame) -> DataFrame:
    """Topology nodes after a merge. New nodes take type and name only, known ones their properties.

    ``topology``: arn, resource_type, name, metadata. ``resources``: arn, resource_type, name,
    properties. The column ``added`` marks new nodes.
    """
    old, new = topology.alias("o"), resources.alias("n")
    known = F.col("o.arn").isNotNull()
    return old.join(new, F.col("o.arn") == F.col("n.arn"), "full_outer").select(
        F.coalesce("o.arn", "n.arn").alias("arn"),
        F.when(known, F.col("o.resource_type")).otherwise(F.col("n.resource_type")).alias("resource_type"),
        F.when(known, F.col("o.name")).otherwise(F.col("n.name")).alias("name"),
        F.when(known, merge_maps(F.col("o.metadata"), F.col("n.properties")))
        .otherwise(F.expr("cast(map() as map<string,string>)")).alias("metadata"),
        (~known).alias("added"),
    )


def merge_edges(topology: DataFrame, resources: DataFrame) -> DataFrame:
    """Topology edges after a merge: known ones keep their counters, new ones start at 0.

    Where the topology has list positions, new edges follow in the order of their first mention.
    """
    fresh = (
        resources.groupBy(*EDGE_KEY).agg(F.min("first_seq").alias("first_seq"))
        .join(topology.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    )
    placed = ["position"] if "position" in topology.columns else []
    if placed:
        free = topology.agg((F.coalesce(F.max("position"), F.lit(-1)) + 1).alias("free"))
        fresh = numbered(fresh, ["first_seq", *EDGE_KEY], "place").withColumn("position", F.col("place") + free.scalar())
    fresh = fresh.select(
        *EDGE_KEY, F.lit(0).cast("bigint").alias("request_count"), F.lit(0).cast("bigint").alias("error_count"), *placed,
        F.lit(True).alias("added"))
    kept = topology.select(*EDGE_KEY, "request_count", "error_count", *placed, F.lit(False).alias("added"))
    return kept.unionByName(fresh)


def node_audit(merged: DataFrame, batch: str, triggered_by: str = "graph_merge") -> DataFrame:
    """Audit rows for the nodes that :func:`merge_nodes` added."""
    return merged.where("added").select(
        change_id(F.lit(batch), F.lit("node"), F.col("arn")).alias("change_id"),
        F.col("arn").alias("resource_arn"),
        F.lit("node_added").alias("change_type"),
        F.lit("resource_discovery").alias("source"),
        F.lit(triggered_by).alias("triggered_by"),
        F.concat(F.lit("Added node "), "name", F.lit(" ("), "resource_type", F.lit(")")).alias("description"),
        F.lit(None).cast("string").alias("previous_value"),
        F.to_json(F.struct("arn", "resource_type", "name")).alias("new_value"),
    )


def edge_audit(merged: DataFrame, batch: str, triggered_by: str = "graph_merge") -> DataFrame:
    """Audit rows for the edges that :func:`merge_edges` added, keyed by the source."""
    return merged.where("added").select(
        change_id(F.lit(batch), F.lit("edge"), *[F.col(c) for c in EDGE_KEY]).alias("change_id"),
        F.col("source_arn").alias("resource_arn"),
        F.lit("edge_added").alias("change_type"),
        F.lit("resource_discovery").alias("source"),
        F.lit(triggered_by).alias("triggered_by"),
        F.concat(F.lit("Added edge "), "source_arn", F.lit(" --"), "relationship", F.lit("--> "), "target_arn")
        .alias("description"),
        F.lit(None).cast("string").alias("previous_value"),
        F.to_json(F.struct(*EDGE_KEY)).alias("new_value"),
    )


def labelled_edges(edges: DataFrame, nodes: DataFrame, short_fallback: bool = False) -> DataFrame:
    """Edges with the names of both ends; an unknown end shows its id, or the id's last part."""
    names = nodes.select("arn", "name")

    def label(name: str, arn: str) -> Column:
        return F.coalesce(F.col(name), A.last_part(F.col(arn)) if short_fallback else F.col(arn))

    return (
        edges.join(names.select(F.col("arn").alias("source_arn"), F.col("name").alias("__source")), "source_arn", "left")
        .join(names.select(F.col("arn").alias("target_arn"), F.col("name").alias("__target")), "target_arn", "left")
        .withColumn("source_label", label("__source", "source_arn"))
        .withColumn("target_label", label("__target", "target_arn"))
        .drop("__source", "__target")
    )


def graph_size(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: number of nodes and of edges, each counted in its own pass."""
    counted = nodes.select(F.lit(1).alias("node"), F.lit(0).alias("edge")).unionAll(
        edges.select(F.lit(0).alias("node"), F.lit(1).alias("edge"))
    )
    return counted.agg(
        F.coalesce(F.sum("node"), F.lit(0)).alias("node_count"), F.coalesce(F.sum("edge"), F.lit(0)).alias("edge_count")
    )


def bump_version(header: DataFrame, at: Column) -> DataFrame:
    """Next snapshot header: version and time move on every update, also without a change."""
    return header.select((F.col("version") + 1).alias("version"), "generated_at", at.alias("last_updated"))
