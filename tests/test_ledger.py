import datetime as dt

import pytest
from pyspark.sql import functions as F

from lograph.functions import checks
from lograph.operators import incremental as I
from lograph.operators import ledger as L
from lograph.schemas import LEDGER

DAY = dt.datetime(2024, 1, 10)


def row(uid, at=DAY, purged=False, path="/p", purged_at=None):
    return (uid, "s3_bucket", "b", uid, None if purged else path, at, purged, purged_at or (DAY if purged else None))


@pytest.fixture
def table(spark):
    return lambda *rows: spark.createDataFrame(list(rows), LEDGER)


@pytest.fixture
def ids(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "unique_id string")


def test_purged_ids_stay_seen_and_repeats_stay(table, ids):
    got = L.new_references(ids("a", "b", "c", "c"), table(row("a"), row("b", purged=True)))
    assert sorted(r[0] for r in got.collect()) == ["c", "c"]


def test_insert_or_ignore_keeps_the_first(table, spark):
    downloads = spark.createDataFrame([
        ("a", "s3_bucket", "b", "a", "/new", DAY, 1), ("n", "s3_bucket", "b", "n", "/late", DAY, 3), ("n", "s3_bucket", "b", "n", "/first", DAY, 2),
    ], "unique_id string, source_type string, source_identifier string, key string, local_path string, downloaded_at timestamp_ntz, seq int")
    once = L.mark_downloaded(table(row("a")), downloads, ["seq"])
    assert sorted((r["unique_id"], r["local_path"], r["is_purged"]) for r in once.collect()) == [("a", "/p", False), ("n", "/first", False)]
    assert L.mark_downloaded(once, downloads, ["seq"]).exceptAll(once).count() == 0


def test_lookup_of_unknown_is_not_purged(table, ids):
    got = L.lookup(ids("a", "b", "z"), table(row("a"), row("b", purged=True)))
    assert sorted(map(tuple, got.collect())) == [("a", True, False), ("b", True, True), ("z", False, False)]


def test_since_is_inclusive_and_expiry_strict(table):
    ledger = table(row("old", DAY - dt.timedelta(1)), row("at", DAY), row("gone", DAY - dt.timedelta(1), purged=True))
    assert sorted(r[0] for r in L.downloaded_since(ledger, F.lit(DAY)).collect()) == ["at"]
    assert sorted(r[0] for r in L.downloaded_since(ledger, F.lit(DAY - dt.timedelta(1))).collect()) == ["at", "gone", "old"]
    assert [r[0] for r in L.expired(ledger, F.lit(DAY)).collect()] == ["old"]


def test_retention_skips_failed_deletes_and_repeats(table, ids):
    as_of = F.lit(DAY + dt.timedelta(8)).cast("timestamp_ntz")
    ledger = table(row("old"), row("stuck"), row("new", DAY + dt.timedelta(1)), row("gone", purged=True))
    once = L.enforce_retention(ledger, as_of, ids("stuck", "stuck"))
    got = {r["unique_id"]: r for r in once.collect()}
    assert (got["old"]["is_purged"], got["old"]["local_path"], got["old"]["purged_at"]) == (True, None, DAY + dt.timedelta(8))
    assert not got["stuck"]["is_purged"] and not got["new"]["is_purged"] and got["gone"]["purged_at"] == DAY
    assert L.enforce_retention(once, as_of, ids("stuck")).exceptAll(once).count() == 0 and len(got) == 4


def test_restore_restarts_the_clock_for_purged_rows_only(table, spark):
    at = DAY + dt.timedelta(30)
    requests = spark.createDataFrame([("gone", "/again"), ("kept", "/x"), ("none", "/y")], "unique_id string, new_path string")
    ledger = table(row("gone", purged=True), row("kept"))
    assert sorted((r["unique_id"], r["outcome"]) for r in L.classify_restores(requests, ledger).collect()) == [
        ("gone", "restored"), ("kept", "not_purged"), ("none", "not_found")]
    got = {r["unique_id"]: r for r in L.restore(ledger, requests, F.lit(at).cast("timestamp_ntz")).collect()}
    assert set(got) == {"gone", "kept"}
    assert (got["gone"]["local_path"], got["gone"]["downloaded_at"], got["gone"]["is_purged"], got["gone"]["purged_at"]) == ("/again", at, False, None)
    assert (got["kept"]["local_path"], got["kept"]["downloaded_at"]) == ("/p", DAY)


def test_mark_purged_keeps_the_row(table, ids):
    got = {r["unique_id"]: r for r in L.mark_purged(table(row("a"), row("b")), ids("a", "zz"), F.lit(DAY).cast("timestamp_ntz")).collect()}
    assert got["a"]["is_purged"] and got["a"]["local_path"] is None and not got["b"]["is_purged"]


def test_rules(table):
    bad = [("", *row("x")[1:]), (*row("path", purged=True)[:4], "/p", DAY, True, DAY), (*row("time", purged=True)[:7], None)]
    _, rejected = checks.split_valid(table(row("ok"), row("fine", purged=True), *bad), L.rules())
    assert sorted((r["unique_id"], tuple(r["errors"])) for r in rejected.collect()) == [
        ("", ("blank_id",)), ("path", ("purged_with_path",)), ("time", ("purged_without_time",))]


def test_stored_text_becomes_typed(spark):
    stored = spark.createDataFrame([("a", "t", "s", "k", None, "2024-01-10T00:00:00", 1, "2024-01-10T00:00:00"), ("b", "t", "s", "k", "/p", "junk", None, "")],
                                   "unique_id string, source_type string, source_identifier string, key string, local_path string, downloaded_at string, is_purged int, purged_at string")
    got = [tuple(r)[5:] for r in L.load_rows(stored).orderBy("unique_id").collect()]
    assert got == [(DAY, True, DAY), (None, False, None)]


def test_name_collisions(ids):
    assert [tuple(r) for r in L.name_collisions(ids("a:b", "a/b", "a/b", "c")).collect()] == [("a_b", 2)]


def test_cache_needs_the_same_fingerprint_and_path(spark):
    files = I.with_fingerprint(spark.createDataFrame(
        [("/l/a", 5, 1), ("/l/b", 5, 1), ("/l/e", 0, 1), ("/l/x", 50_000_000, 1), ("/l/y", 50_000_001, 1)],
        "path string, length bigint, modified_ms bigint"))
    assert sorted(r["path"] for r in I.size_gate(files).collect()) == ["/l/a", "/l/b", "/l/x"]
    done = files.where("path in ('/l/a', '/l/b')").withColumn(
        "result", F.when(F.col("path") == "/l/a", F.lit("  found\n")).otherwise(F.lit(" \n\t ")))
    cache = I.cache_rows(done)
    assert [(r["abs_path"], r["file_name"], r["result"]) for r in cache.collect()] == [("/l/a", "a", "found")]
    moved = cache.withColumn("abs_path", F.lit("/other"))
    assert I.cache_split(files, cache).where("hit").count() == 1 and I.cache_split(files, moved).where("hit").count() == 0
    assert sorted(r["path"] for r in I.cache_misses(I.size_gate(files), cache).collect()) == ["/l/b", "/l/x"]


def test_resume_only_unresolved_and_latest(spark):
    states = spark.createDataFrame([("d1", 1, False), ("d1", 2, True), ("d2", 1, True), ("d2", 3, False)], "log_dir string, iteration int, is_resolved boolean")
    assert [tuple(r) for r in I.resume_state(states, ["log_dir"]).collect()] == [("d2", 3, False)]
    failed = I.next_state(states.where("log_dir = 'd2'"), F.lit(False))
    assert I.resume_state(failed, ["log_dir"]).count() == 1
