"""The stored ledger: a merge table that batches add to. No batch rewrites it, and none reads more than the buckets of its ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.fixed_values import RETENTION_DAYS
from lograph.operators import ledger as L
from lograph.schemas import LEDGER
from lograph.session import written
from lograph.sources.merge_table import MergeTable


def ledger_of(spark: SparkSession, state_root: str, buckets: int = 16) -> MergeTable:
    """The ledger of a state folder. ``buckets`` holds for a new one: one for every few gigabytes that it will have."""
    return MergeTable(spark, f"{state_root}/ledger", LEDGER, "unique_id", buckets)


def enter(table: MergeTable, downloads: DataFrame, order: list[str]) -> DataFrame:
    """Enter the downloads that the ledger does not know, the first of each id; returns the rows that were entered."""
    known = table.manifest()
    downloads = written(downloads, "downloads")
    new = L.new_references(downloads, table.lookup(downloads, known))
    rows = written(L.mark_downloaded(table.spark.createDataFrame([], LEDGER), new, order), "entered")
    table.append(rows, known=known)
    return rows


def purge(table: MergeTable, ids: DataFrame, at: Column) -> DataFrame:
    """Mark ids as purged; returns their rows as they are now. Ids that the ledger does not know are left out."""
    known = table.manifest()
    held = table.lookup(ids, known)
    rows = written(L.mark_purged(held, ids, at), "purged")
    table.append(rows, known=known)
    return rows


def enforce(table: MergeTable, as_of: Column, failed_deletes: DataFrame | None = None, days: int = RETENTION_DAYS) -> DataFrame:
    """Mark what is past its retention as purged; returns the rows. Rows whose file could not be deleted stay as they are."""
    known = table.manifest()
    old = table.where((F.col("downloaded_at") < as_of - F.expr(f"interval {days} days")) & ~F.col("is_purged"), known)
    due = written(L.due_for_purge(old, as_of, failed_deletes, days), "due")
    rows = written(L.mark_purged(due, due, as_of), "purged")
    table.append(rows, known=known)
    return rows


def restore(table: MergeTable, requests: DataFrame, as_of: Column) -> DataFrame:
    """Restore purged logs (``requests``: unique_id, new_path); returns each request with its ``outcome``."""
    known = table.manifest()
    requests = written(requests, "requests")
    held = written(table.lookup(requests, known), "held")
    outcome = written(L.classify_restores(requests, held), "outcome")
    table.append(L.restore(held.where("is_purged"), requests, as_of), known=known)
    return outcome
