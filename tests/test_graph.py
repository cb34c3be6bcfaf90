import random

import pytest
from pyspark.sql import functions as F

from lograph.operators import graph as G
from lograph.operators import trace as R
from lograph.sinks import graph_text as X
from lograph.sinks import tables as B
from lograph.sources import snapshots as V

FINDINGS = "seq bigint, severity string, message string, resource_arns array<string>"
L, D, S = "arn:aws:lambda:us-east-1:1:function:f", "arn:aws:rds:::db:d", "arn:aws:s3:::b"


@pytest.fixture
def findings(spark):
    return spark.createDataFrame([
        (1, "info", "Invoked", [L, D, S + "/x", S + "/y"]), (2, "error", "slow", [D, L]), (3, "error", "Invoked", [L, D]),
        (4, "info", "alone", [S + "/a", S + "/b"]), (5, "info", "none", []),
    ], FINDINGS)


def test_nodes_and_direction_of_edges(findings):
    assert {r["arn"]: r["name"] for r in G.resource_nodes(findings).collect()} == {L: "f", D: "d", S: "b"}
    got = sorted(map(tuple, G.resource_edges(findings).collect()))
    assert got == sorted([(L, D, "invokes", 1), (L, S, "invokes", 1), (L, D, "depends_on", 2)])


def test_known_nodes_and_edges_stay_out(findings, spark):
    known = spark.createDataFrame([(L,)], "arn string")
    assert {r["arn"] for r in G.resource_nodes(findings, known).collect()} == {D, S}
    edge = spark.createDataFrame([(L, D, "invokes")], "source_arn string, target_arn string, relationship string")
    assert {(r["target_arn"], r["relationship"]) for r in G.resource_edges(findings, edge).collect()} == {(S, "invokes"), (D, "depends_on")}


def test_weights(findings):
    got = {(r["target_arn"], r["relationship"]): (r["request_count"], r["error_count"]) for r in G.edge_weights(findings).collect()}
    assert got == {(D, "invokes"): (2, 1), (S, "invokes"): (1, 0), (D, "depends_on"): (1, 1)}


def test_merge_keeps_old_nodes_and_copies_properties_only_there(spark):
    old = spark.createDataFrame([("a", "t", "n", {"k": "1", "x": "1"}), ("b", "t", "n", None)], "arn string, resource_type string, name string, metadata map<string,string>")
    new = spark.createDataFrame([("a", "T", "N", {"k": "2"}), ("c", "T", "N", {"k": "3"})], "arn string, resource_type string, name string, properties map<string,string>")
    got = {r["arn"]: tuple(r)[1:] for r in G.merge_nodes(old, new).collect()}
    assert got == {"a": ("t", "n", {"x": "1", "k": "2"}, False), "b": ("t", "n", {}, False), "c": ("T", "N", {}, True)}


def test_labels_fall_back(spark):
    edges = spark.createDataFrame([("a", "x:y:z", "r")], "source_arn string, target_arn string, relationship string")
    nodes = spark.createDataFrame([("a", "Name")], "arn string, name string")
    assert tuple(G.labelled_edges(edges, nodes).select("source_label", "target_label").first()) == ("Name", "x:y:z")
    assert G.labelled_edges(edges, nodes, short_fallback=True).first()["target_label"] == "z"


def test_version_moves_on_every_update(spark):
    import datetime as dt
    header = spark.createDataFrame([(4, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1))], "version bigint, generated_at timestamp_ntz, last_updated timestamp_ntz")
    row = G.bump_version(header, F.lit(dt.datetime(2024, 2, 1))).first()
    assert row["version"] == 5 and row["generated_at"] == dt.datetime(2024, 1, 1) and row["last_updated"] == dt.datetime(2024, 2, 1)


@pytest.fixture
def drawn(spark):
    nodes = spark.createDataFrame([("b:1/x", "s3:b", "B & <co>"), ("a", "odd", "A")], "arn string, resource_type string, name string")
    edges = spark.createDataFrame([("b:1/x", "a", "r", 9, 3, 1), ("a", "b:1/x", "q", 2, 0, 0)],
                                  "source_arn string, target_arn string, relationship string, first_seq bigint, request_count bigint, error_count bigint")
    return nodes, edges


def test_dot(drawn, tmp_path, spark):
    lines = X.dot_lines(*drawn)
    text = [r["line"] for r in lines.orderBy(*X.ORDER).collect()]
    assert text[4:] == ['    "a" [label="A\\nodd", fillcolor=white];', '    "b_1_x" [label="B & <co>\\ns3:b", fillcolor=lightgreen];', "",
                        '    "a" -> "b_1_x" [label="q"];', '    "b_1_x" -> "a" [label="r"];', "}"]
    X.write_lines(lines, str(tmp_path / "dot"), single_file=True)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "dot")).collect()] == text


def test_graphml_is_sound_xml(drawn):
    import xml.etree.ElementTree as ElementTree
    text = "\n".join(r["line"] for r in X.graphml_lines(*drawn).orderBy(*X.ORDER).collect())
    root = ElementTree.fromstring(text.encode())
    edges = [e for e in root.iter() if e.tag.endswith("}edge")]
    assert [(e.get("id"), e.get("source")) for e in edges] == [("e0", "a"), ("e1", "b_1_x")]
    assert "B & <co>" in [d.text for d in root.iter() if d.tag.endswith("}data")]


def breadth_first(edges, start):
    depth, frontier = {start: 0}, [start]
    while frontier:
        frontier = sorted({t for s, t in edges if s in frontier} - set(depth))
        depth.update({n: max(depth.values()) + 1 for n in frontier})
    return depth


@pytest.mark.parametrize("seed", range(2))
def test_reachable_matches_breadth_first(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(16)}
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_arn string, target_arn string, relationship string")
    start = spark.createDataFrame([("n0",)], "arn string")
    want = breadth_first(pairs, "n0")
    assert {r["arn"]: r["depth"] for r in R.reachable(edges, start, 20).collect()} == want
    back = breadth_first({(b, a) for a, b in pairs}, "n0")
    assert {r["arn"]: r["hops"] for r in R.affected_resources(edges, "n0", 20).collect()} == {k: v for k, v in back.items() if v}


def trace(spark, pairs, failing, surface, hops=10):
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_arn string, target_arn string, relationship string")
    health = spark.createDataFrame([(n, "error") for n in failing] or [("none", "healthy")], "arn string, status string")
    rows = R.root_cause_trace(edges, health, surface, hops).orderBy("position").collect()
    return [(r["arn"], r["role"]) for r in rows]


def test_trace_runs_from_the_root_to_the_surface(spark):
    pairs = [("web", "api"), ("api", "db"), ("api", "cache"), ("db", "disk"), ("web", "web")]
    assert trace(spark, pairs, ["web", "api", "db"], "web") == [("db", "ROOT CAUSE"), ("api", "PROPAGATION"), ("web", "SURFACE")]
    assert trace(spark, pairs, ["web"], "web") == [("web", "ROOT CAUSE")]
    assert trace(spark, pairs, [], "web") == []


def test_trace_in_a_cycle_of_errors_takes_the_deepest(spark):
    assert trace(spark, [("a", "b"), ("b", "c"), ("c", "a")], ["a", "b", "c"], "a") == [
        ("c", "ROOT CAUSE"), ("b", "PROPAGATION"), ("a", "SURFACE")]


def test_long_chains_take_few_rounds(spark):
    """A thousand hops with side branches, a cycle of errors in front of the root, and a shorter way that joins late."""
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(1000)]
    sides = [(f"c{i:04}", "log") for i in range(0, 1000, 3)] + [(f"job{i}", f"c{i:04}") for i in range(0, 1000, 7)]
    ring = [("c1000", "r1"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "root")]
    pairs = chain + sides + ring + [("c0000", "s1"), ("s1", "c0400")]
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_arn string, target_arn string, relationship string")
    walk = R._walk(edges, spark.createDataFrame([("c0000",)], "arn string"), None, False)
    want = breadth_first(pairs, "c0000")
    assert {r["arn"]: r["depth"] for r in walk.seen.collect()} == want and walk.rounds <= 15
    failing = [n for n in want if n != "log"]
    got = trace(spark, pairs, failing, "c0000", None)
    assert [n for n, _ in got] == ["root", "r3", "r2", "r1", *[f"c{i:04}" for i in range(1000, 399, -1)], "s1", "c0000"]
    assert got[0][1] == "ROOT CAUSE" and got[-1][1] == "SURFACE"


@pytest.mark.parametrize("seed", range(3))
def test_predecessors_are_the_smallest_on_a_shortest_way(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(18)} | {("n0", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "n5")}
    edges = spark.createDataFrame([(a, b, "r") for a, b in pairs], "source_arn string, target_arn string, relationship string")
    want = breadth_first(pairs, "n0")
    got = {r["arn"]: (r["depth"], r["via"]) for r in R.reachable(edges, spark.createDataFrame([("n0",)], "arn string")).collect()}
    assert got == {n: (d, min((a for a, b in pairs if b == n and want.get(a, -2) == d - 1), default=None)) for n, d in want.items()}


def test_snapshots_have_versions_and_no_half_written_ones(spark, tmp_path):
    root = str(tmp_path / "topology")
    nodes, edges = V.read_snapshot(spark, root)
    assert nodes.count() == 0 and edges.count() == 0
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    one = nodes.unionByName(spark.sql("select 'a' arn, 't' resource_type, 'n' name, named_struct('status','unknown','last_error',cast(null as string),'error_count',0L,'last_seen',cast(null as timestamp_ntz)) health, map('k','v') metadata"))
    assert V.write_snapshot(one, edges, root, at) == 1
    old, _ = V.read_snapshot(spark, root)
    assert V.write_snapshot(old.unionByName(one.withColumn("arn", F.lit("b"))), edges, root, at) == 2
    one.write.parquet(f"{root}/version=3/nodes")  # a lost job: no header row
    assert {r["arn"] for r in V.read_snapshot(spark, root)[0].collect()} == {"a", "b"}
    assert {r["arn"] for r in V.read_snapshot(spark, root, 1)[0].collect()} == {"a"}


def test_topology_document_gets_defaults(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"nodes":{"a":{"arn":"a","resource_type":"t","name":"n","health":{"status":"error","error_count":2}},"b":{}},'
                                     '"edges":[{"source_arn":"a","target_arn":"b","relationship":"r"}],"version":3}')
    nodes, edges = V.read_topology_json(spark, str(tmp_path / "t.json"))
    got = {r["arn"]: (r["resource_type"], r["name"], r["health"]["status"], r["health"]["error_count"]) for r in nodes.collect()}
    assert got == {"a": ("t", "n", "error", 2), "b": ("unknown", "b", "unknown", 0)}
    assert [tuple(r) for r in edges.collect()] == [("a", "b", "r", 0, 0, 0)]


def test_resource_tables_round_trip(spark, tmp_path):
    root = str(tmp_path / "map")
    assert V.read_resource_tables(spark, root)[0].count() == 0
    nodes = spark.createDataFrame([("a", "t", "n", "r", {"k": "v"})], "arn string, resource_type string, name string, region string, properties map<string,string>")
    edges = spark.createDataFrame([("a", "b", "r")], "source_arn string, target_arn string, relationship string")
    V.write_resource_tables(nodes, edges, root)
    back, linked = V.read_resource_tables(spark, root)
    assert back.collect() == nodes.collect() and linked.collect() == edges.collect()


def test_audit_batches_replace_themselves(spark, tmp_path):
    import datetime as dt
    rows = [("12345678-1234-5678-1234-567812345678", dt.datetime(2024, 1, 1, 5), "a", "node_added", "human_input", "operator:x", "d", None, None, 1, 0)]
    audit = spark.createDataFrame(rows, B.AUDIT)
    for _ in range(2):
        B.append_audit(audit, str(tmp_path / "audit"), "b1")
    B.append_audit(audit, str(tmp_path / "audit"), "b2")
    back = B.read_audit(spark, str(tmp_path / "audit"))
    assert back.count() == 2 and {str(r["day"]) for r in back.collect()} == {"2024-01-01"}
    from lograph.functions.checks import split_valid
    good, bad = split_valid(back, B.audit_rules())
    assert good.count() == 2 and bad.count() == 0


def test_artifacts(spark, drawn, tmp_path):
    nodes, edges = drawn
    B.write_artifacts(nodes, edges, spark.createDataFrame([], B.AUDIT), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out/dot")).count() == 10


def test_versions_are_dropped_but_for_leased_ones(spark, tmp_path):
    """A slow reader and three writers: what the reader leased stays until it is done."""
    root, at = str(tmp_path / "topology"), F.expr("timestamp_ntz '2024-01-01 00:00:00'")
    node = "arn string, resource_type string, name string"

    def write(n):
        nodes = spark.createDataFrame([(f"a{n}", "t", "n")], node).withColumns({
            "health": F.struct(F.lit("unknown").alias("status"), F.lit(None).cast("string").alias("last_error"), F.lit(0).cast("bigint").alias("error_count"),
                               F.lit(None).cast("timestamp_ntz").alias("last_seen")), "metadata": F.expr("cast(map() as map<string,string>)")})
        edges = V.read_snapshot(spark, root)[1]
        V.write_snapshot(nodes, edges, root, at, f"b{n}")
        return V.drop_versions(spark, root, keep=2)

    write(0)
    with V.lease(spark, root) as version:
        slow, _ = V.read_snapshot(spark, root, version)
        dropped = [write(n) for n in range(1, 7)]  # three writers, two turns each
        assert version == 1 and dropped == [[], [], [2], [3], [4], [5]]
        assert [r["arn"] for r in slow.collect()] == ["a0"]
    assert write(7) == [1, 6] and [r["arn"] for r in V.read_snapshot(spark, root)[0].collect()] == ["a7"]
    assert V.has_batch(spark, root, "b0")  # what a version took in stays known
    with V.lease(spark, str(tmp_path / "none")) as version:
        assert version == 0
