import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lograph.operators import edits as batch_edits
from lograph.operators import findings as N
from lograph.operators import health as H
from lograph.streaming import edits as E
from lograph.streaming import jobs as J
from lograph.streaming.audit import health_audit_stream
from lograph.streaming.sinks import batches, finish, latest_rows

FINDINGS = "seq bigint, ts timestamp_ntz, severity string, message string, resource_arns array<string>"
NODES = "arn string, status string, last_error string, error_count bigint, last_seen timestamp_ntz"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def feed(spark, tmp_path):
    """A folder that takes one file per call, and the stream over it."""
    folder = str(tmp_path / "in")

    class Feed:
        out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

        def put(self, rows, schema):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return Feed()


def test_health_over_files_and_a_restart_equals_the_batch(spark, feed):
    rows = [(i, START + dt.timedelta(minutes=60 - i), ["info", "warning", "error"][i % 3], f"m{i}", ["hot"] * (1 + i % 2) + [f"r{i % 4}"]) for i in range(24)]
    nodes = spark.createDataFrame([(a, "unknown", None, 0, None) for a in ("hot", "r0", "r1", "r2", "r3")], NODES)
    for part in (rows[16:], rows[:8]):  # later rows arrive first
        feed.put(part, FINDINGS)
    finish(J.health_stream(feed.stream(FINDINGS), feed.out, feed.checkpoint))
    feed.put(rows[8:16], FINDINGS)
    finish(J.health_stream(feed.stream(FINDINGS), feed.out, feed.checkpoint))
    got = H.apply_fold(nodes, latest_rows(spark, feed.out, ["arn"]))
    want = H.health_state(spark.createDataFrame(rows, FINDINGS), nodes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert batches(spark, feed.out).select("batch").distinct().count() == 3


def test_error_windows_drop_late_lines(spark, feed):
    schema = "ts timestamp, line string"
    day = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
    feed.put([(day, "error a"), (day + dt.timedelta(minutes=30), "fine"), (day + dt.timedelta(hours=5), "FATAL b")], schema)
    finish(J.error_window_stream(feed.stream(schema), feed.out, feed.checkpoint))
    feed.put([(day, "error late"), (day + dt.timedelta(hours=5), "error c")], schema)
    finish(J.error_window_stream(feed.stream(schema), feed.out, feed.checkpoint))
    got = sorted((r["window_start"].hour, r["errors"]) for r in latest_rows(spark, feed.out, ["window_start"]).collect())
    assert got == [(0, 1), (5, 2)]


def test_ingest_takes_each_id_once_also_when_a_batch_runs_again(spark, feed):
    schema = "unique_id string, seq bigint"
    feed.put([("a", 2), ("a", 1), ("b", 1)], schema)
    finish(J.ingest_stream(feed.stream(schema), feed.out, feed.checkpoint, ["seq"]))
    feed.put([("a", 0), ("c", 1)], schema)
    finish(J.ingest_stream(feed.stream(schema), feed.out, feed.checkpoint, ["seq"]))
    want = [("a", 1), ("b", 1), ("c", 1)]
    assert sorted((r["unique_id"], r["seq"]) for r in batches(spark, feed.out).collect()) == want
    # The same input from a fresh checkpoint runs both batches again over the same folders.
    finish(J.ingest_stream(feed.stream(schema), feed.out, feed.checkpoint + "2", ["seq"]))
    assert sorted(r["unique_id"] for r in batches(spark, feed.out).collect()) == ["a", "b", "c"]


def test_triggers_reach_their_handlers(spark, feed):
    schema = "id bigint, event string"
    feed.put([(1, '{"source":"s","detail":{"errorPattern":"OOM"}}'), (2, '{"Records":[{"s3":{}}]}')], schema)
    seen = {}
    handlers = {tool: (lambda batch, _, tool=tool: seen.setdefault(tool, []).extend(r["id"] for r in batch.collect()))
                for tool in ("error_root_cause", "topology_update")}
    finish(J.trigger_stream(feed.stream(schema), feed.out, feed.checkpoint, handlers))
    assert seen == {"error_root_cause": [1], "topology_update": [2]}
    assert batches(spark, feed.out).count() == 2


def test_cached_files_need_no_work(spark, feed):
    from lograph.operators import incremental as I
    schema = "path string, length bigint, modified_ms bigint"
    feed.put([("/a", 5, 1), ("/b", 5, 1), ("/empty", 0, 1)], schema)
    known = I.with_fingerprint(spark.createDataFrame([("/a", 5, 1)], schema)).select("fingerprint", F.col("path").alias("abs_path"), F.lit("r").alias("result"))
    finish(J.cache_stream(feed.stream(schema), known, feed.out, feed.checkpoint))
    assert [r["path"] for r in batches(spark, feed.out).collect()] == ["/b"]


SIGNALS = "seq bigint, ts timestamp, severity string, message string, resource_arns array<string>"
DAY = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def plain_audit(released, status):
    """Steps (place, seq, pos, kind, count before) of one resource whose signals are released in this order."""
    worst, errors, out = {"error": 2, "warning": 1}.get(status[0], 0), status[1], []
    for seq, pos, rank in released:
        if worst < rank or worst == rank == 2:
            out.append((len(out), seq, pos, worst == 2, errors))
        worst, errors = max(worst, rank), errors + (rank == 2)
    return out


def test_audit_stream_orders_late_signals_and_survives_a_restart(spark, feed, tmp_path):
    closing = str(tmp_path / "closing")
    spark.createDataFrame([], "ts timestamp").write.parquet(closing)
    ends = spark.readStream.schema("ts timestamp").parquet(closing)
    nodes = spark.createDataFrame([("hot", "warning", 3)], "arn string, status string, error_count bigint")

    def run(checkpoint=feed.checkpoint, out=feed.out):
        findings = feed.stream(SIGNALS)
        finish(health_audit_stream(findings, nodes, out, checkpoint, "b1", "10 minutes", closing=ends))

    def finding(seq, minute, severity="error"):
        return (seq, DAY + dt.timedelta(minutes=minute), severity, f"m{seq}", ["hot", f"r{seq % 2}", "hot"])

    feed.put([finding(2, 20), finding(1, 15, "warning"), finding(0, 18)], SIGNALS)
    run()
    assert batches(spark, feed.out).count() == 0  # all may still be overtaken
    feed.put([finding(3, 12, "warning"), finding(4, 40)], SIGNALS)
    run()
    feed.put([finding(5, 5), finding(6, 41, "info")], SIGNALS)  # 5 comes after its time was released
    run()
    spark.createDataFrame([(DAY + dt.timedelta(days=1),)], "ts timestamp").write.mode("append").parquet(closing)
    run()
    rows = batches(spark, feed.out).collect()
    got = {arn: sorted((r["place"], r["seq"], r["pos"], r["change_type"] == "health_error_recorded") for r in rows if r["resource_arn"] == arn) for arn in ("hot", "r0", "r1")}
    order = [(3, 1), (1, 1), (0, 2), (2, 2), (5, 2), (4, 2)]
    want = {arn: plain_audit([(s, p, rank) for s, rank in order for p, a in enumerate(["hot", f"r{s % 2}", "hot"]) if a == arn], start)
            for arn, start in (("hot", ("warning", 3)), ("r0", ("unknown", 0)), ("r1", ("unknown", 0)))}
    assert got == {arn: [step[:4] for step in steps] for arn, steps in want.items()}
    counts = {(r["seq"], r["pos"]): r["previous_value"] for r in rows if r["resource_arn"] == "hot" and r["change_type"] == "health_error_recorded"}
    assert counts == {(s, p): f'{{"error_count":{n}}}' for _, s, p, again, n in want["hot"] if again}
    assert len({r["change_id"] for r in rows}) == len(rows)


def test_audit_stream_equals_the_batch_audit(spark, feed, tmp_path):
    rows = [(i, DAY + dt.timedelta(minutes=i), ["info", "warning", "error"][i % 3], f"m{i}", ["hot", f"r{i % 4}"]) for i in range(40)]
    nodes = spark.createDataFrame([(a, "unknown", 0) for a in ("hot", "r0", "r1", "r2", "r3")], "arn string, status string, error_count bigint")
    for part in (rows[20:25], rows[:20], rows[25:]):
        feed.put(part, SIGNALS)
    empty = str(tmp_path / "ends")
    spark.createDataFrame([], "ts timestamp").write.parquet(empty)
    ends = spark.readStream.schema("ts timestamp").parquet(empty)
    for _ in range(2):
        finish(health_audit_stream(feed.stream(SIGNALS), nodes, feed.out, feed.checkpoint, "b1", "1 day", closing=ends))
        spark.createDataFrame([(DAY + dt.timedelta(days=9),)], "ts timestamp").write.mode("append").parquet(empty)
    got = batches(spark, feed.out).drop("batch", "place")
    want = H.health_audit(spark.createDataFrame(rows, SIGNALS).withColumn("ts", F.col("ts").cast("timestamp_ntz")), nodes, "b1")
    columns = want.columns
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.collect())) and got.count() == 30


def test_incidents_of_a_stream_equal_the_batch(spark, feed, tmp_path):
    closing = str(tmp_path / "closing")
    spark.createDataFrame([], "ts timestamp").write.parquet(closing)
    ends = spark.readStream.schema("ts timestamp").parquet(closing)
    # Gaps of exactly 30 minutes keep an incident together, longer ones do not.
    minutes = [0, 30, 31, 62, 200, 201, 230, 261, 600]
    rows = [(i, DAY + dt.timedelta(minutes=m), ["error", "warning", "info"][i % 3], f"m{i}", ["hot", "hot"] if i % 2 else ["r", "hot"]) for i, m in enumerate(minutes)]
    for part in (rows[:3], rows[5:7], rows[3:5], rows[7:]):
        feed.put(part, SIGNALS)
    for _ in range(2):
        finish(J.incident_stream(feed.stream(SIGNALS), feed.out, feed.checkpoint, "30 minutes", "1 day", closing=ends))
        spark.createDataFrame([(DAY + dt.timedelta(days=9),)], "ts timestamp").write.mode("append").parquet(closing)
    got = sorted(map(tuple, batches(spark, feed.out).drop("batch").collect()))
    signals = H.health_signals(spark.createDataFrame([*rows, (99, None, "error", "no time", ["hot"])], SIGNALS))
    assert got == sorted(map(tuple, N.incidents(signals, "30 minutes").collect()))
    minute = lambda t: int((t - dt.datetime(2024, 1, 1)).total_seconds() // 60)
    assert [(minute(r[1]), minute(r[2]), r[3]) for r in got if r[0] == "hot"] == [(0, 30, 3), (62, 62, 2), (200, 230, 2), (261, 261, 2)]


EDIT = "seq bigint, action string, arn string, target_arn string, relationship string, status string, last_error string, text string, resource_type string, name string, metadata map<string,string>"


def test_edits_of_a_stream_equal_the_batch_also_after_a_restart(spark, feed):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(6)]
    nodes = spark.createDataFrame(
        [(n, "t", n.upper(), "error", "old", 4, dt.datetime(2024, 1, 1), {"k": n}) for n in names[:3]],
        "arn string, resource_type string, name string, status string, last_error string, error_count bigint, last_seen timestamp_ntz, metadata map<string,string>")
    edges = spark.createDataFrame([("n0", "n1", "a", 7, 1), ("n1", "n2", "a", 8, 2), ("n2", "n2", "a", 9, 3), ("n0", "zz", "a", 5, 5)],
                                  "source_arn string, target_arn string, relationship string, request_count bigint, error_count bigint")
    actions = ["add_node", "remove_node", "add_edge", "add_edge", "remove_edge", "update_health", "annotate"]
    rows = [(i, rng.choice(actions), rng.choice(names), rng.choice(names), rng.choice("ab"), rng.choice(["error", "healthy"]), rng.choice([None, "e"]), rng.choice([None, f"note{i}"]),
             f"t{i}", f"name{i}", rng.choice([None, {"v": str(i)}])) for i in range(90)]
    for part in (rows[:30], rows[30:31]):
        feed.put(part, EDIT)
    finish(E.edit_stream(feed.stream(EDIT), nodes, edges, feed.out, feed.checkpoint))
    feed.put(rows[31:], EDIT)
    for _ in range(2):  # the second run finds nothing new
        finish(E.edit_stream(feed.stream(EDIT), nodes, edges, feed.out, feed.checkpoint))
    edits = spark.createDataFrame(rows, EDIT)
    text = lambda frame: frame.withColumn("metadata", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metadata")))))
    want = batch_edits.edited_nodes(nodes, edits)
    got = E.streamed_nodes(spark, feed.out).select(want.columns)
    assert sorted(map(repr, text(got).collect())) == sorted(map(repr, text(want).collect())) and got.count() > 1
    removals = batch_edits.node_removals(batch_edits.node_steps(nodes, edits))
    want = batch_edits.edited_edges(edges, edits, removals)
    got = E.streamed_edges(spark, feed.out).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 3


class _CountedMap:
    """A map state in memory that counts the calls made on it."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "iterator":
                return iter(list(self.held.items()))
            if name == "keys":
                return iter(list(self.held))
            if name == "containsKey":
                return args[0] in self.held
            if name == "updateValue":
                self.held[args[0]] = args[1]
            elif name == "removeKey":
                self.held.pop(args[0], None)
            elif name == "clear":
                self.held.clear()
            return None
        return call


class _Node:
    def exists(self):
        return False

    def update(self, value):
        pass


def test_node_edits_call_the_edge_state_a_bounded_number_of_times():
    import pandas as pd

    processor, edges = E.NodeEdits(), _CountedMap()
    processor.edges, processor.node = edges, _Node()
    rows = [{c: None for c in E.EVENT_COLUMNS} | {"arn": "node-1", "seq": i, "action": "add_edge" if i % 3 else "remove_edge",
            "source_arn": "node-1", "target_arn": f"node-{i % 5}", "relationship": "depends_on"} for i in range(3000)]
    list(processor.handleInputRows(("node-1",), iter([pd.DataFrame(rows)]), None))
    want = {("node-1", f"node-{t}", "depends_on") for t in range(5)} - {("node-1", f"node-{(2997 + k) % 5}", "depends_on") for k in range(3) if (2997 + k) % 3 == 0}
    assert set(edges.held) == want
    assert edges.calls <= 20
