"""Queries on the download ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lograph.functions import checks
from lograph.operators import ledger as L
from lograph.plans import ledger_jobs as J
from lograph.plans.views import oracle, view
from lograph.session import scratch_path

def as_of():
    return F.expr("timestamp_ntz '1998-06-01 00:00:00'")


def later():
    return F.expr("timestamp_ntz '1998-07-01 00:00:00'")


def since():
    return F.expr("timestamp_ntz '1997-06-01 00:00:00'")


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "ledger_v").select(*L.COLUMNS)


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger without the urgent orders, so that some of the incoming logs are new to it."""
    return view(spark, sf_dir, "known_v").select(*L.COLUMNS)


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "incoming_v")


def ledger_new(spark, sf_dir):
    return L.new_references(incoming(spark, sf_dir), known(spark, sf_dir))


def downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incoming(spark, sf_dir).select(
        "unique_id", F.lit("s3_bucket").alias("source_type"),
        F.split("unique_id", ":").getItem(1).alias("source_identifier"), F.split("unique_id", ":").getItem(2).alias("key"),
        F.concat(F.lit("/new/"), F.col("size_bytes").cast("string")).alias("local_path"), F.col("ts").alias("downloaded_at"),
        "size_bytes",
    )


def ledger_insert_ignore(spark, sf_dir):
    return L.mark_downloaded(known(spark, sf_dir), downloads(spark, sf_dir), ["downloaded_at", "size_bytes"])


def ledger_lookup(spark, sf_dir):
    return L.lookup(incoming(spark, sf_dir).select("unique_id").distinct(), known(spark, sf_dir))


def ledger_records(spark, sf_dir):
    return L.records(L.all_ids(incoming(spark, sf_dir)), stored(spark, sf_dir))


def ledger_since(spark, sf_dir):
    return L.downloaded_since(stored(spark, sf_dir), since())


def ledger_expired(spark, sf_dir):
    return L.expired(stored(spark, sf_dir), as_of())


def ledger_mark_purged(spark, sf_dir):
    late = incoming(spark, sf_dir).where(F.col("ts") >= since())
    return L.mark_purged(stored(spark, sf_dir), late, as_of())


def ledger_retention(spark, sf_dir):
    ledger = stored(spark, sf_dir)
    stuck = ledger.where("source_identifier = 'bucket-3'").select("unique_id")
    return L.enforce_retention(ledger, as_of(), stuck)


def _requests(spark, sf_dir):
    return incoming(spark, sf_dir).select("unique_id").distinct().withColumn("new_path", F.concat(F.lit("/again/"), "unique_id"))


def ledger_restore(spark, sf_dir):
    return L.restore(stored(spark, sf_dir), _requests(spark, sf_dir), as_of())


def ledger_restore_outcome(spark, sf_dir):
    return L.classify_restores(_requests(spark, sf_dir), known(spark, sf_dir)).select("unique_id", "outcome")


def ledger_invalid(spark, sf_dir):
    _, bad = checks.split_valid(stored(spark, sf_dir), L.rules())
    return bad.select("unique_id", F.array_join("errors", ",").alias("errors"))


def ledger_load(spark, sf_dir):
    text = stored(spark, sf_dir).withColumns({
        "downloaded_at": F.date_format("downloaded_at", "yyyy-MM-dd'T'HH:mm:ss"), "is_purged": F.col("is_purged").cast("int"),
        "purged_at": F.date_format("purged_at", "yyyy-MM-dd'T'HH:mm:ss")})
    return L.load_rows(text)


def _table(spark, sf_dir, name):
    """The ledger as a stored table: the known rows, then all incoming logs in two batches, most of them known."""
    table = J.ledger_of(spark, scratch_path(spark, name), buckets=8)
    table.append(known(spark, sf_dir))
    arrivals = downloads(spark, sf_dir)
    for part in (F.col("downloaded_at") < since(), F.col("downloaded_at") >= since()):
        J.enter(table, arrivals.where(part), ["downloaded_at", "size_bytes"])
    return table


def ledger_table(spark, sf_dir):
    """The stored ledger after inserts, a retention run, and a restore of what the first batch brought."""
    table = _table(spark, sf_dir, "ledger_table")
    stuck = stored(spark, sf_dir).where("source_identifier = 'bucket-3'").select("unique_id")
    J.enforce(table, as_of(), stuck)
    J.restore(table, _requests(spark, sf_dir).where("unique_id like '%7.log'"), later())
    return table.newest().select(*L.COLUMNS)


def ledger_restore_job(spark, sf_dir):
    """Outcomes of a restore job over the stored ledger, also of ids that it does not know."""
    table = _table(spark, sf_dir, "ledger_restores")
    requests = stored(spark, sf_dir).select("unique_id", F.concat(F.lit("/again/"), "unique_id").alias("new_path"))
    return J.restore(table, requests, later()).select("unique_id", "outcome")


def name_collisions(spark, sf_dir):
    """Ids whose separator differs share a file name."""
    ids = stored(spark, sf_dir).select("unique_id")
    slashed = incoming(spark, sf_dir).select(F.translate("unique_id", ":", "/").alias("unique_id"))
    return L.name_collisions(ids.unionByName(slashed))


QUERIES = {f.__name__: f for f in [
    ledger_new, ledger_insert_ignore, ledger_lookup, ledger_records, ledger_since, ledger_expired, ledger_mark_purged,
    ledger_retention, ledger_restore, ledger_restore_outcome, ledger_invalid, ledger_load, name_collisions, ledger_table, ledger_restore_job,
]}

ALL = ", ".join(L.COLUMNS)
ENTERED = f"""
first AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ts >= TIMESTAMP '1997-06-01', ts, size_bytes) AS rn FROM incoming_v),
entered AS (SELECT {ALL} FROM known_v UNION ALL SELECT unique_id, 's3_bucket', string_split(unique_id, ':')[2], string_split(unique_id, ':')[3],
  '/new/' || size_bytes, ts, false, NULL FROM first WHERE rn = 1 AND unique_id NOT IN (SELECT unique_id FROM known_v))"""
ORACLES = {
    "ledger_new": oracle("""SELECT * FROM incoming_v i WHERE NOT EXISTS (SELECT 1 FROM known_v l
        WHERE l.unique_id = i.unique_id)""", "known_v", "incoming_v"),
    "ledger_insert_ignore": oracle(f"""SELECT {ALL} FROM known_v UNION ALL
        SELECT unique_id, 's3_bucket', string_split(unique_id, ':')[2], string_split(unique_id, ':')[3],
          '/new/' || size_bytes, ts, false, NULL FROM (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ts, size_bytes)
          AS rn FROM incoming_v) WHERE rn = 1 AND unique_id NOT IN (SELECT unique_id FROM known_v)""", "known_v", "incoming_v"),
    "ledger_lookup": oracle("""SELECT i.unique_id, l.unique_id IS NOT NULL AS is_downloaded, coalesce(is_purged, false) AS is_purged
        FROM (SELECT DISTINCT unique_id FROM incoming_v) i LEFT JOIN known_v l USING (unique_id)""", "known_v", "incoming_v"),
    "ledger_records": oracle(f"SELECT {ALL} FROM ledger_v WHERE unique_id IN (SELECT unique_id FROM incoming_v)",
                             "ledger_v", "incoming_v"),
    "ledger_since": oracle(f"SELECT {ALL} FROM ledger_v WHERE downloaded_at >= TIMESTAMP '1997-06-01'", "ledger_v"),
    "ledger_expired": oracle(f"SELECT {ALL} FROM ledger_v WHERE downloaded_at < TIMESTAMP '1998-06-01' AND NOT is_purged", "ledger_v"),
    "ledger_mark_purged": oracle("""WITH hit AS (SELECT DISTINCT unique_id FROM incoming_v WHERE ts >= TIMESTAMP '1997-06-01')
        SELECT unique_id, source_type, source_identifier, key, CASE WHEN h THEN NULL ELSE local_path END AS local_path, downloaded_at,
          h OR is_purged AS is_purged, CASE WHEN h THEN TIMESTAMP '1998-06-01' ELSE purged_at END AS purged_at
        FROM (SELECT *, unique_id IN (SELECT unique_id FROM hit) AS h FROM ledger_v)""", "ledger_v", "incoming_v"),
    "ledger_retention": oracle("""SELECT unique_id, source_type, source_identifier, key,
          CASE WHEN due THEN NULL ELSE local_path END AS local_path, downloaded_at, due OR is_purged AS is_purged,
          CASE WHEN due THEN TIMESTAMP '1998-06-01' ELSE purged_at END AS purged_at
        FROM (SELECT *, downloaded_at < TIMESTAMP '1998-05-25' AND NOT is_purged AND source_identifier <> 'bucket-3' AS due
          FROM ledger_v)""", "ledger_v"),
    "ledger_restore": oracle("""SELECT unique_id, source_type, source_identifier, key,
          CASE WHEN h THEN '/again/' || unique_id ELSE local_path END AS local_path,
          CASE WHEN h THEN TIMESTAMP '1998-06-01' ELSE downloaded_at END AS downloaded_at, is_purged AND NOT h AS is_purged,
          CASE WHEN h THEN NULL ELSE purged_at END AS purged_at
        FROM (SELECT *, is_purged AND unique_id IN (SELECT unique_id FROM incoming_v) AS h FROM ledger_v)""",
        "ledger_v", "incoming_v"),
    "ledger_restore_outcome": oracle("""SELECT i.unique_id, CASE WHEN l.unique_id IS NULL THEN 'not_found' WHEN is_purged
        THEN 'restored' ELSE 'not_purged' END AS outcome
        FROM (SELECT DISTINCT unique_id FROM incoming_v) i LEFT JOIN known_v l USING (unique_id)""", "known_v", "incoming_v"),
    "ledger_invalid": oracle("""SELECT unique_id, 'purged_without_time' AS errors FROM ledger_v
        WHERE is_purged AND purged_at IS NULL""", "ledger_v"),
    "ledger_load": oracle(f"SELECT {ALL} FROM ledger_v", "ledger_v"),
    "ledger_table": oracle(f"""WITH {ENTERED},
        kept AS (SELECT unique_id, source_type, source_identifier, key, CASE WHEN due THEN NULL ELSE local_path END AS local_path, downloaded_at,
          due OR is_purged AS is_purged, CASE WHEN due THEN TIMESTAMP '1998-06-01' ELSE purged_at END AS purged_at
          FROM (SELECT *, downloaded_at < TIMESTAMP '1998-05-25' AND NOT is_purged AND source_identifier <> 'bucket-3' AS due FROM entered))
        SELECT unique_id, source_type, source_identifier, key, CASE WHEN h THEN '/again/' || unique_id ELSE local_path END AS local_path,
          CASE WHEN h THEN TIMESTAMP '1998-07-01' ELSE downloaded_at END AS downloaded_at, is_purged AND NOT h AS is_purged,
          CASE WHEN h THEN NULL ELSE purged_at END AS purged_at
        FROM (SELECT *, is_purged AND unique_id LIKE '%7.log' AND unique_id IN (SELECT unique_id FROM incoming_v) AS h FROM kept)""",
        "known_v", "incoming_v"),
    "ledger_restore_job": oracle(f"""WITH {ENTERED} SELECT l.unique_id, CASE WHEN e.unique_id IS NULL THEN 'not_found'
        WHEN e.is_purged THEN 'restored' ELSE 'not_purged' END AS outcome FROM ledger_v l LEFT JOIN entered e USING (unique_id)""", "known_v", "incoming_v"),
    "name_collisions": oracle("""SELECT replace(unique_id, ':', '_') AS file_name, 2 AS ids FROM ledger_v
        WHERE unique_id IN (SELECT unique_id FROM incoming_v)""", "ledger_v", "incoming_v"),
}
