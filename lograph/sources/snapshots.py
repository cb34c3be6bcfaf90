"""Versioned tables (topology, ledger): a folder per version, a header row that makes a version valid.

A version is written to a folder that no other writer uses; its header row comes last and names the folder and
the batch. A reader takes the highest version that has a header, so a lost job leaves nothing half-read behind. Of
two writers of the same version the one with the smaller folder name counts, and the other is told so. Old versions are dropped by
:func:`drop_versions`, but for those that a reader leases; their header rows stay, as they name the batches.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.fixed_values import UNKNOWN
from lograph.functions import replies as R
from lograph.schemas import RESOURCE_EDGES, RESOURCE_NODES, SNAPSHOT_HEADER, TOPOLOGY_EDGES, TOPOLOGY_NODES
from lograph.sources import store_files

#: Versions that stay after a job wrote a new one.
KEEP = 16


def absent(problem: AnalysisException) -> bool:
    """Whether a read failed because nothing is there, and for no other reason."""
    return problem.getCondition() == "PATH_NOT_FOUND"


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    """A stored table; empty when it was never written."""
    try:
        return spark.read.schema(schema).format(kind).load(path)
    except AnalysisException as problem:
        if not absent(problem):
            raise
        return spark.createDataFrame([], schema)


def read_header(spark: SparkSession, root: str) -> DataFrame:
    """All versions; empty when nothing was written yet."""
    return read_or_empty(spark, f"{root}/header", SNAPSHOT_HEADER)


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    try:
        return bool(spark.read.text(f"{path}/_SUCCESS") is not None)
    except AnalysisException as problem:
        if not absent(problem):
            raise
        return False


def has_batch(spark: SparkSession, root: str, batch: str) -> bool:
    """Whether a version already holds this batch."""
    return not read_header(spark, root).where(F.col("batch") == batch).isEmpty()


def latest_version(spark: SparkSession, root: str) -> int:
    return read_header(spark, root).agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def read_table(spark: SparkSession, root: str, name: str, schema: str, version: int | None = None) -> DataFrame:
    """One table of a version, the latest by default; empty when there is none."""
    version = latest_version(spark, root) if version is None else version
    if version == 0:
        return spark.createDataFrame([], schema)
    folder = read_header(spark, root).where(F.col("version") == version).agg(F.min("folder")).first()[0]
    return spark.read.schema(schema).parquet(f"{root}/{folder}/{name}")


def write_tables(spark: SparkSession, tables: dict[str, DataFrame], root: str, as_of: Column, batch: str | None = None) -> int:
    """Write the tables as the next version and return its number. Every call makes a new version.

    The tables may come from an earlier version: it is read while the new one is written elsewhere.
    """
    known = read_header(spark, root).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"), F.min("generated_at").alias("g")).first()
    version = known["v"] + 1
    folder = f"version={version}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{root}/{folder}/{name}")
    born = as_of if known["g"] is None else F.lit(known["g"])
    spark.range(1).select(
        F.lit(version).cast("bigint").alias("version"), born.cast("timestamp_ntz").alias("generated_at"),
        as_of.cast("timestamp_ntz").alias("last_updated"), F.lit(batch).cast("string").alias("batch"), F.lit(folder).alias("folder"),
    ).coalesce(1).write.mode("append").parquet(f"{root}/header")
    if read_header(spark, root).where(F.col("version") == version).agg(F.min("folder")).first()[0] != folder:
        raise RuntimeError(f"another writer made version {version} of {root}; run the batch again")
    return version


@contextmanager
def lease(spark: SparkSession, root: str) -> Iterator[int]:
    """The newest version, to be read with ``version=``; it is not dropped as long as the lease is held."""
    def there(version: int) -> bool:
        folders = {r["folder"] for r in read_header(spark, root).where(F.col("version") == version).collect()}
        return bool(folders & set(store_files.names(spark, root)))

    with store_files.lease(spark, root, lambda: latest_version(spark, root), there) as version:
        yield version


def drop_versions(spark: SparkSession, root: str, keep: int = KEEP) -> list[int]:
    """Delete the tables of versions that are neither among the last ``keep`` nor leased; returns those versions.

    Folders that no header names belong to a writer that is at work or lost; they are deleted once their version is an old one.
    """
    last = latest_version(spark, root)
    leased = store_files.leased(spark, root)
    gone = set()
    for name in store_files.names(spark, root):
        version = int(name.split("-")[0].removeprefix("version=")) if name.startswith("version=") else last
        if version <= last - keep and version not in leased:
            store_files.delete(spark, f"{root}/{name}")
            gone.add(version)
    return sorted(gone)


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a topology version."""
    version = latest_version(spark, root) if version is None else version
    return (
        read_table(spark, root, "nodes", TOPOLOGY_NODES, version), read_table(spark, root, "edges", TOPOLOGY_EDGES, version),
    )


def write_snapshot(nodes: DataFrame, edges: DataFrame, root: str, as_of: Column, batch: str | None = None) -> int:
    return write_tables(nodes.sparkSession, {"nodes": nodes, "edges": edges}, root, as_of, batch)


def _document(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("wholetext", True).text(path).select(F.try_parse_json("value").alias("data"))


def read_topology_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Topology out of one JSON document with ``nodes`` by id and a list of ``edges``; gaps get defaults."""
    data = _document(spark, path)
    nodes = data.select(F.explode(F.try_variant_get("data", "$.nodes", "map<string,variant>")).alias("id", "v"))
    v = F.col("v")
    nodes = nodes.select(
        F.coalesce(R.text_at(v, "$.arn"), "id").alias("arn"),
        F.coalesce(R.text_at(v, "$.resource_type"), F.lit(UNKNOWN)).alias("resource_type"),
        F.coalesce(R.text_at(v, "$.name"), "id").alias("name"),
        F.struct(
            F.coalesce(R.text_at(v, "$.health.status"), F.lit(UNKNOWN)).alias("status"),
            R.text_at(v, "$.health.last_error").alias("last_error"),
            F.coalesce(F.try_variant_get(v, "$.health.error_count", "bigint"), F.lit(0)).alias("error_count"),
            F.try_to_timestamp(R.text_at(v, "$.health.last_seen")).cast("timestamp_ntz").alias("last_seen"),
        ).alias("health"),
        F.try_variant_get(v, "$.metadata", "map<string,string>").alias("metadata"),
    )
    edges = data.select(F.posexplode(R.items_at(F.col("data"), "$.edges")).alias("n", "e"))
    e = F.col("e")
    edges = edges.select(
        R.text_at(e, "$.source_arn").alias("source_arn"), R.text_at(e, "$.target_arn").alias("target_arn"),
        R.text_at(e, "$.relationship").alias("relationship"),
        F.coalesce(F.try_variant_get(e, "$.request_count", "bigint"), F.lit(0)).alias("request_count"),
        F.coalesce(F.try_variant_get(e, "$.error_count", "bigint"), F.lit(0)).alias("error_count"), F.col("n").cast("bigint").alias("position"),
    )
    return nodes, edges


def read_resource_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Resource map as written by :func:`write_resource_tables`; empty tables when there is none."""
    return read_or_empty(spark, f"{root}/nodes", RESOURCE_NODES, "json"), read_or_empty(spark, f"{root}/edges", RESOURCE_EDGES, "json")


def write_resource_tables(nodes: DataFrame, edges: DataFrame, root: str) -> None:
    nodes.write.mode("overwrite").json(f"{root}/nodes")
    edges.write.mode("overwrite").json(f"{root}/edges")
