import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lograph.operators import ledger as L
from lograph.plans import ledger_jobs as J
from lograph.schemas import LEDGER
from lograph.sources import merge_table as M
from lograph.sources import store_files

SCHEMA = "id string, n bigint"
DAY = dt.datetime(2024, 1, 10)


@pytest.fixture
def table(spark, tmp_path):
    return lambda **given: M.MergeTable(spark, str(tmp_path / "t"), SCHEMA, "id", **{"buckets": 4, **given})


def rows(spark, pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(frame):
    return {r["id"]: r["n"] for r in frame.collect()}


def test_newest_rows_win_over_batches_merges_and_lookups(spark, table):
    rng, want, made = random.Random(1), {}, table()
    assert made.newest().count() == 0 and made.lookup(rows(spark, [("a", 1)])).count() == 0
    for batch in range(12):
        new = {f"k{rng.randrange(60)}": batch * 100 + i for i in range(15)}
        want |= new
        made.append(rows(spark, new.items()))
    assert content(table().newest()) == want
    asked = [(f"k{i}", 0) for i in range(0, 90, 2)] * 2
    assert content(made.lookup(rows(spark, [*asked, (None, 0)]))) == {k: n for k, n in want.items() if int(k[1:]) % 2 == 0}
    assert content(made.where(F.col("n") < 700)) == {k: n for k, n in want.items() if n < 700}
    assert made.schema == SCHEMA and M.MergeTable(spark, made.root).buckets == 4


def test_fifty_batches_keep_files_and_reads_bounded(spark, table):
    made, seen = table(buckets=2), []
    for batch in range(50):
        made.append(rows(spark, [(f"k{batch}-{i}", batch) for i in range(3)]))
        if batch % 10 == 9:
            one = made.lookup(rows(spark, [(f"k{batch // 2}-1", 0)]))
            live = made.manifest()["runs"]
            _, pairs = made.places(rows(spark, [(f"k{batch // 2}-1", 0)]), live)
            seen.append((len(made.stored(live).inputFiles()), len(pairs), len(live)))
            assert content(one) == {f"k{batch // 2}-1": batch // 2}
    assert max(s[0] for s in seen) <= 2 * 9 and max(s[1] for s in seen) == 1 and max(s[2] for s in seen) <= 9
    assert made.newest().count() == 150
    assert len(store_files.names(spark, f"{made.root}/log")) == made.keep
    # Runs that only dropped versions listed are gone, so the folder does not grow with the batches.
    assert len(store_files.names(spark, f"{made.root}/runs")) < 50


def test_filters_lose_no_key_and_admit_few_others(spark, table):
    made = table(buckets=1)
    made.append(spark.range(30000).select(F.concat(F.lit("in"), "id").alias("id"), F.lit(1).cast("bigint").alias("n")))
    assert made.manifest()["runs"][0]["blocks"] > 1
    assert made.lookup(spark.range(30000).select(F.concat(F.lit("in"), "id").alias("id"))).count() == 30000
    bits = spark.read.parquet(f"{made.root}/filters").select("block", "bits")
    other = spark.range(20000).select(F.concat(F.lit("out"), "id").alias("id")).withColumn("block", M.block_of("id", F.lit(made.manifest()["runs"][0]["blocks"])))
    assert other.join(bits, "block").where(F.forall(M.bits_of("id"), lambda b: M.has_bit(F.col("bits"), b))).count() < 200
    assert made.lookup(rows(spark, [("never", 0)])).count() == 0 and made.places(rows(spark, [("never", 0)]), made.manifest()["runs"])[1] == []


def test_a_lost_merge_changes_nothing_and_is_made_later(spark, table, monkeypatch):
    made = table(fan=3)
    for batch in range(2):
        made.append(rows(spark, [("a", batch), (f"b{batch}", batch)]))
    write = M.MergeTable.write_run

    def lost(self, frame, version, level):
        entry = write(self, frame, version, level)
        if level:
            raise RuntimeError("lost")
        return entry

    with monkeypatch.context() as broken:
        broken.setattr(M.MergeTable, "write_run", lost)
        with pytest.raises(RuntimeError):
            made.append(rows(spark, [("a", 2)]), "s", 0)
    assert content(made.newest()) == {"a": 2, "b0": 0, "b1": 1} and len(made.manifest()["runs"]) == 3
    made.append(rows(spark, [("a", 9)]), "s", 0)  # the batch runs again and is there already
    assert content(made.newest())["a"] == 2
    made.append(rows(spark, [("a", 3)]), "s", 1)
    assert content(made.newest()) == {"a": 3, "b0": 0, "b1": 1} and [r["level"] for r in made.manifest()["runs"]] == [1]


def test_a_slow_writer_is_told_and_a_half_written_manifest_does_not_count(spark, table):
    made = table()
    known = made.manifest()
    made.append(rows(spark, [("a", 1)]))
    with pytest.raises(RuntimeError, match="another writer"):
        made.append(rows(spark, [("a", 2)]), known=known)
    assert content(made.newest()) == {"a": 1}
    assert store_files.create(spark, f"{made.root}/log/{2:020d}.json", '{"version": 2, "ru')
    assert made.manifest()["version"] == 1 and content(table().newest()) == {"a": 1}


def test_a_slow_reader_keeps_its_version_while_three_writers_go_on(spark, tmp_path, table):
    made = table(fan=2, keep=2)
    made.append(rows(spark, [("a", 0)]))
    with made.lease() as held:
        slow = made.newest(held)
        writers = [table(fan=2, keep=2) for _ in range(3)]
        for turn in range(9):
            writers[turn % 3].append(rows(spark, [("a", turn + 1), (f"w{turn}", turn)]))
        assert content(slow) == {"a": 0}
        versions = store_files.names(spark, f"{made.root}/log")
        assert f"{held['version']:020d}.json" in versions and len(versions) == 3
    made.append(rows(spark, [("z", 1)]))
    assert f"{held['version']:020d}.json" not in store_files.names(spark, f"{made.root}/log")
    assert content(made.newest())["a"] == 9 and made.newest().count() == 11


def ledger_rows(spark, *given):
    return spark.createDataFrame([(u, "local_file", "r", u, f"/p/{u}", at, False, None) for u, at in given], LEDGER)


def test_ledger_batches_equal_the_whole_table_functions(spark, tmp_path):
    """Random batches of all kinds against the functions that take and give whole tables."""
    rng = random.Random(7)
    table, whole = J.ledger_of(spark, str(tmp_path), 3), {}
    table.fan = 3
    for turn in range(10):
        at = DAY + dt.timedelta(days=turn)
        now = F.lit(at).cast("timestamp_ntz")
        before = spark.createDataFrame(list(whole.values()), LEDGER)
        kind = ["enter", "enter", "purge", "enforce", "restore"][turn % 5]
        ids = [f"u{rng.randrange(12)}" for _ in range(5)]
        if kind == "enter":
            new = ledger_rows(spark, *[(u, at - dt.timedelta(hours=i)) for i, u in enumerate(ids)])
            J.enter(table, new, ["downloaded_at"])
            after = L.mark_downloaded(before, new, ["downloaded_at"])
        elif kind == "purge":
            given = spark.createDataFrame([(u,) for u in ids], "unique_id string")
            J.purge(table, given, now)
            after = L.mark_purged(before, given, now)
        elif kind == "enforce":
            stuck = spark.createDataFrame([(ids[0],)], "unique_id string")
            J.enforce(table, now, stuck, days=2)
            after = L.enforce_retention(before, now, stuck, days=2)
        else:
            asked = spark.createDataFrame([(u, f"/again/{u}") for u in sorted(set(ids))], "unique_id string, new_path string")
            got = {r["unique_id"]: r["outcome"] for r in J.restore(table, asked, now).collect()}
            assert got == {r["unique_id"]: r["outcome"] for r in L.classify_restores(asked, before).collect()}
            after = L.restore(before, asked, now)
        whole = {r["unique_id"]: tuple(r[c] for c in L.COLUMNS) for r in after.collect()}
        assert {r["unique_id"]: tuple(r) for r in table.newest().select(*L.COLUMNS).collect()} == whole, kind
