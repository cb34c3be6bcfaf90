from pyspark.sql import functions as F

from lograph.operators.running import positioned, with_running
from lograph.plans import jobs
from lograph.sinks.tables import read_audit
from lograph.sources import snapshots

WEB, DB, DISK = "arn:aws:lambda:us-east-1:1:function:web", "arn:aws:rds:us-east-1:1:db:main", "arn:aws:s3:::disk"


def test_logs_become_topology_and_an_error_is_traced(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    (logs / "day").mkdir(parents=True)
    (logs / "web.log").write_text(f"2024-01-01 10:00:00 ERROR {WEB} timeout on {DB}\nall fine\nWARN {WEB} retry\n")
    (logs / "day" / "db.csv").write_text(f'source,text\n{WEB},"FATAL write failed {DISK}/x"\n')
    at = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    assert jobs.update_topology(spark, str(logs), state, "b1", at) == 1
    nodes, edges = snapshots.read_snapshot(spark, f"{state}/topology")
    health = {r["name"]: (r["health"]["status"], r["health"]["error_count"]) for r in nodes.collect()}
    assert health == {"web": ("error", 2), "main": ("error", 1), "disk": ("error", 1)}
    assert sorted((r["target_arn"], r["relationship"]) for r in edges.collect()) == [(DB, "depends_on"), (DISK, "writes_to")]
    kinds = [r["change_type"] for r in read_audit(spark, f"{state}/audit").collect()]
    assert sorted(kinds) == ["edge_added"] * 2 + ["health_error_recorded"] + ["health_status_changed"] * 3 + ["node_added"] * 3

    (logs / "web.log").write_text(f"ERROR {WEB} again\n")
    (logs / "day" / "db.csv").unlink()
    assert jobs.update_topology(spark, str(logs), state, "b2", at) == 2
    nodes, _ = snapshots.read_snapshot(spark, f"{state}/topology")
    web = nodes.where(F.col("arn") == WEB).first()
    assert web["health"]["error_count"] == 3 and web["metadata"] == {"region": "us-east-1"}

    result = jobs.investigate(spark, str(logs), state, "again", WEB)
    assert [(r["label"], r["role"]) for r in result["chain"].collect()] == [("main", "ROOT CAUSE"), ("web", "SURFACE")]
    assert [r["arn"] for r in result["affected"].collect()] == [WEB]
    assert [r["hits"] for r in result["files"].collect()] == [1] and result["evidence"].count() == 1


def test_positions_follow_the_order_over_several_tasks(spark):
    frame = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("hot").alias("g"))
    rows = positioned(frame, ["k"])
    assert [r["k"] for r in rows.orderBy("seq").collect()] == list(range(5000))
    got = with_running(rows, ["g"], ["seq"], {"n": ("sum", F.lit(1))}, 64)
    assert got.where("n <> k").count() == 0


def test_logs_come_in_once_and_retire(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    (logs / "a.log").write_text(f"ERROR {WEB} one\n")
    day = "timestamp_ntz '2024-02-{} 00:00:00'"
    first = jobs.take_in(spark, str(logs), state, F.expr(day.format("01")))
    assert [r["path"] for r in first.collect()] == [f"file:{logs}/a.log"]
    jobs.update_topology(spark, str(logs), state, "b1", F.expr(day.format("01")), only=first)
    (logs / "b.log").write_text(f"ERROR {WEB} two\n")
    second = jobs.take_in(spark, str(logs), state, F.expr(day.format("05")))
    assert [r["path"] for r in second.collect()] == [f"file:{logs}/b.log"]
    jobs.update_topology(spark, str(logs), state, "b2", F.expr(day.format("05")), after="2020-01-01T00:00:00", only=second)
    nodes, _ = snapshots.read_snapshot(spark, f"{state}/topology")
    assert [r["health"]["error_count"] for r in nodes.collect()] == [2]  # each log counted once
    assert jobs.take_in(spark, str(logs), state, F.expr(day.format("06"))).count() == 0
    assert [r["unique_id"] for r in jobs.retire(spark, state, F.expr(day.format("09"))).collect()] == [f"local_file:{logs}:a.log"]
    assert jobs.retire(spark, state, F.expr(day.format("09"))).count() == 0
    assert jobs.take_in(spark, str(logs), state, F.expr(day.format("10"))).count() == 0  # purged logs stay known


def test_ingest_brings_every_log_once_and_names_what_it_cannot_read(spark, tmp_path, monkeypatch):
    logs, state = tmp_path / "lo gs", str(tmp_path / "state")
    logs.mkdir()
    (logs / "a b+c.log").write_text(f"ERROR {WEB} one\nERROR {WEB} two\n")
    (logs / "x.pdf").write_bytes(b"%PDF")
    (logs / "bad.docx").write_bytes(b"no archive")
    at = F.expr("timestamp_ntz '2024-02-01 00:00:00'")

    def fail(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(jobs.L, "mark_downloaded", fail)  # between topology and ledger
        try:
            jobs.ingest(spark, str(logs), state, "b1", at)
            raise AssertionError("did not fail")
        except RuntimeError:
            pass
    (logs / "late.log").write_text(f"ERROR {DB} three\n")
    outcome = {r["path"].rsplit("/", 1)[1]: r["outcome"] for r in jobs.ingest(spark, str(logs), state, "b1", at).collect()}
    assert outcome == {"a b+c.log": "ingested", "x.pdf": "format not read", "bad.docx": "damaged"}
    assert jobs.ingest(spark, str(logs), state, "b1", at).count() == 3  # again: nothing changes
    jobs.ingest(spark, str(logs), state, "b2", at)
    nodes, _ = snapshots.read_snapshot(spark, f"{state}/topology")
    assert {r["arn"]: r["health"]["error_count"] for r in nodes.collect()} == {WEB: 2, DB: 1}
    known = jobs.ledger_of(spark, state).newest()
    assert sorted(r["key"] for r in known.collect()) == ["a b+c.log", "late.log"]


def test_edits_of_a_stored_topology(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    (logs / "web.log").write_text(f"ERROR {WEB} timeout on {DB}\nERROR {WEB} writes {DISK}\n")
    at = F.expr("timestamp_ntz '2024-02-01 00:00:00'")
    jobs.ingest(spark, str(logs), state, "b1", at)
    base = "cast(null as string) target_arn, cast(null as string) relationship, 'healthy' status, cast(null as string) last_error, 'checked' text, "
    rest = "'t' resource_type, 'n' name, map('k', 'v') metadata"
    edits = spark.sql(f"select 0L seq, 'update_health' action, '{WEB}' arn, {base} {rest} union all select 1L, 'remove_node', '{DISK}', {base} {rest}")
    assert jobs.apply_edits(spark, state, edits, "o", "e1", at) == 2 and jobs.apply_edits(spark, state, edits, "o", "e1", at) == 2
    nodes, edges = snapshots.read_snapshot(spark, f"{state}/topology")
    assert {r["arn"]: (r["health"]["status"], r["health"]["error_count"]) for r in nodes.collect()} == {WEB: ("healthy", 2), DB: ("error", 1)}
    assert [(r["target_arn"], r["position"]) for r in edges.collect()] == [(DB, 0)]
    from lograph.operators.health import change_history
    kinds = [r["change_type"] for r in change_history(read_audit(spark, f"{state}/audit"), source="human_input").collect()]
    assert kinds == ["health_status_changed", "node_removed"]
    from lograph.sinks.tables import write_artifacts
    write_artifacts(nodes, edges, read_audit(spark, f"{state}/audit"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "graphml")).where("value like '%<edge %'").count() == 1


def test_purged_logs_are_restored_once(spark, tmp_path):
    logs, state = tmp_path / "logs", str(tmp_path / "state")
    logs.mkdir()
    (logs / "a.log").write_text("one\n")
    (logs / "b.log").write_text("two\n")
    day = lambda n: F.expr(f"timestamp_ntz '2024-02-{n:02} 00:00:00'")
    jobs.take_in(spark, str(logs), state, day(1))
    stuck = spark.createDataFrame([(f"local_file:{logs}:b.log",)], "unique_id string")
    assert jobs.retire(spark, state, day(20), stuck).count() == 1
    requests = spark.createDataFrame([(f"local_file:{logs}:{n}.log", f"/again/{n}") for n in "abc"], "unique_id string, new_path string")
    outcomes = [{r["unique_id"][-5]: r["outcome"] for r in jobs.restore_logs(spark, state, requests, day(21)).collect()} for _ in range(2)]
    assert outcomes == [{"a": "restored", "b": "not_purged", "c": "not_found"}, {"a": "not_purged", "b": "not_purged", "c": "not_found"}]
    rows = {r["key"]: (r["local_path"], r["downloaded_at"].day, r["is_purged"], r["purged_at"]) for r in jobs.ledger_of(spark, state).newest().collect()}
    assert rows["a.log"] == ("/again/a", 21, False, None) and rows["b.log"][1:] == (1, False, None)
    assert jobs.retire(spark, state, day(26)).count() == 1  # the retention of the restored one starts again
