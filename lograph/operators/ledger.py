"""Download ledger: deduplicated ingest, retention, restore. One row per ``unique_id``.

Every function gives the next state of the rows it is given. The stored ledger (:mod:`lograph.plans.ledger_jobs`) hands over the rows
that a batch touches, and adds what changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.fixed_values import RETENTION_DAYS
from lograph.functions import checks
from lograph.functions.arn import safe_name

COLUMNS = [
    "unique_id", "source_type", "source_identifier", "key", "local_path", "downloaded_at", "is_purged", "purged_at",
]


def load_rows(stored: DataFrame) -> DataFrame:
    """Typed ledger rows from stored text: 0/1 to boolean, ISO text to timestamp."""
    return stored.select(
        "unique_id", "source_type", "source_identifier", "key", "local_path",
        F.try_to_timestamp("downloaded_at").cast("timestamp_ntz").alias("downloaded_at"),
        (F.coalesce(F.col("is_purged").try_cast("int"), F.lit(0)) != 0).alias("is_purged"),
        F.try_to_timestamp(F.nullif("purged_at", F.lit(""))).cast("timestamp_ntz").alias("purged_at"),
    )


def new_references(incoming: DataFrame, ledger: DataFrame) -> DataFrame:
    """References not yet in the ledger. Purged ids count as seen; repeats inside the batch stay."""
    return incoming.join(ledger.select("unique_id"), "unique_id", "left_anti")


def mark_downloaded(ledger: DataFrame, downloads: DataFrame, order: list[str]) -> DataFrame:
    """Ledger with the new downloads. The first row of an id wins, known ids are left alone."""
    details = [c for c in COLUMNS if c not in ("unique_id", "is_purged", "purged_at")]
    firsts = (
        downloads.groupBy("unique_id")
        .agg(F.min_by(F.struct(*details), F.struct(*order)).alias("row"))
        .join(ledger.select("unique_id"), "unique_id", "left_anti")
        .select(
            "unique_id", *[F.col("row")[c].alias(c) for c in details],
            F.lit(False).alias("is_purged"), F.lit(None).cast("timestamp_ntz").alias("purged_at"),
        )
    )
    return ledger.select(*COLUMNS).unionByName(firsts.select(*COLUMNS))


def lookup(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Whether each id is known and whether it is purged; an unknown id is not purged."""
    state = ledger.select("unique_id", "is_purged", F.lit(True).alias("known"))
    return ids.join(state, "unique_id", "left").select(
        *ids.columns,
        F.coalesce("known", F.lit(False)).alias("is_downloaded"),
        F.coalesce("is_purged", F.lit(False)).alias("is_purged"),
    )


def records(ids: DataFrame, ledger: DataFrame) -> DataFrame:
    """Full rows of the given ids."""
    return ledger.join(ids.select("unique_id"), "unique_id", "left_semi")


def all_ids(ledger: DataFrame) -> DataFrame:
    return ledger.select("unique_id").distinct()


def downloaded_since(ledger: DataFrame, since: Column) -> DataFrame:
    """Rows at or after ``since``, purged ones included."""
    return ledger.where(F.col("downloaded_at") >= since)


def expired(ledger: DataFrame, before: Column) -> DataFrame:
    """Rows strictly before the cutoff that still hold a file."""
    return ledger.where((F.col("downloaded_at") < before) & ~F.col("is_purged"))


def mark_purged(ledger: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """Ledger with the given ids purged: no path, a purge time, the row stays."""
    hits = ids.select("unique_id").distinct().withColumn("__hit", F.lit(True))
    return _rewrite_purged(ledger.join(hits, "unique_id", "left"), F.col("__hit").isNotNull(), at)


def due_for_purge(
    ledger: DataFrame, as_of: Column, failed_deletes: DataFrame | None = None, days: int = RETENTION_DAYS
) -> DataFrame:
    """Expired rows at ``as_of``, without those whose file could not be deleted."""
    due = expired(ledger, as_of - F.expr(f"interval {days} days"))
    return due if failed_deletes is None else due.join(failed_deletes.select("unique_id"), "unique_id", "left_anti")


def enforce_retention(
    ledger: DataFrame, as_of: Column, failed_deletes: DataFrame | None = None, days: int = RETENTION_DAYS
) -> DataFrame:
    """Ledger after retention at ``as_of``. A row whose file could not be deleted stays as it is."""
    due = (F.col("downloaded_at") < as_of - F.expr(f"interval {days} days")) & ~F.col("is_purged")
    if failed_deletes is None:
        return _rewrite_purged(ledger, due, as_of)
    kept = failed_deletes.select("unique_id").distinct().withColumn("__failed", F.lit(True))
    return _rewrite_purged(ledger.join(kept, "unique_id", "left"), due & F.col("__failed").isNull(), as_of)


def _rewrite_purged(rows: DataFrame, condition: Column, at: Column) -> DataFrame:
    return rows.select(
        "unique_id", "source_type", "source_identifier", "key",
        F.when(~condition, F.col("local_path")).alias("local_path"),
        "downloaded_at",
        (condition | F.col("is_purged")).alias("is_purged"),
        F.when(condition, at).otherwise(F.col("purged_at")).alias("purged_at"),
    )


def classify_restores(requests: DataFrame, ledger: DataFrame) -> DataFrame:
    """Per request: ``restored``, ``not_found`` or ``not_purged``."""
    state = ledger.select("unique_id", F.col("is_purged").alias("__purged"))
    return requests.join(state, "unique_id", "left").select(
        *requests.columns,
        F.when(F.col("__purged").isNull(), "not_found").when(F.col("__purged"), "restored")
        .otherwise("not_purged").alias("outcome"),
    )


def restore(ledger: DataFrame, requests: DataFrame, as_of: Column) -> DataFrame:
    """Ledger with purged rows restored; ``downloaded_at`` becomes ``as_of``, so retention restarts.

    ``requests``: unique_id, new_path; one row per id.
    """
    wanted = requests.groupBy("unique_id").agg(F.min("new_path").alias("__path"))
    hit = F.col("__path").isNotNull() & F.col("is_purged")
    return ledger.join(wanted, "unique_id", "left").select(
        "unique_id", "source_type", "source_identifier", "key",
        F.when(hit, F.col("__path")).otherwise(F.col("local_path")).alias("local_path"),
        F.when(hit, as_of).otherwise(F.col("downloaded_at")).alias("downloaded_at"),
        (F.col("is_purged") & ~hit).alias("is_purged"),
        F.when(~hit, F.col("purged_at")).alias("purged_at"),
    )


def rules() -> dict[str, Column]:
    """Validity rules of a ledger row, for :func:`lograph.functions.checks.split_valid`."""
    return {
        "blank_id": checks.not_blank(F.col("unique_id")),
        "purged_with_path": ~F.col("is_purged") | F.col("local_path").isNull(),
        "purged_without_time": ~F.col("is_purged") | F.col("purged_at").isNotNull(),
    }


def name_collisions(ledger: DataFrame) -> DataFrame:
    """File names that two or more ids would share."""
    return (
        ledger.select("unique_id", safe_name(F.col("unique_id")).alias("file_name")).distinct()
        .groupBy("file_name").agg(F.count(F.lit(1)).alias("ids")).where("ids > 1")
    )
