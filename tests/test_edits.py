import datetime as dt
import json
import random

import pytest

from folds import fold_edits
from lograph.operators import edits as E
from lograph.schemas import EDITS

NODES = "arn string, resource_type string, name string, status string, last_error string, metadata map<string,string>, error_count bigint, last_seen timestamp_ntz"
EDGES = "source_arn string, target_arn string, relationship string, request_count bigint, error_count bigint, position bigint"
SEEN = dt.datetime(2024, 1, 1)


def batch(seed, size=90):
    rng = random.Random(seed)
    names = ["hot", "hot", "hot", "n1", "n2", "n3"]
    actions = E.NODE_ACTIONS + E.EDGE_ACTIONS
    edits = []
    for seq in range(size):
        status = rng.choice(["healthy", "warning", "error"])
        edits.append({
            "seq": seq, "action": rng.choice(actions), "arn": rng.choice(names), "target_arn": rng.choice(names),
            "relationship": rng.choice(["r", "s"]), "status": status, "last_error": f"e{seq}" if status == "error" else None,
            "text": f"t{seq}", "resource_type": f"type{seq}", "name": f"name{seq}",
            "metadata": rng.choice([None, {"k": f"v{seq}"}]),
        })
    edits.append({**edits[0], "seq": size, "action": "explode"})
    nodes = {a: {"resource_type": "t", "name": a, "status": "healthy", "last_error": None, "metadata": {"human_annotation": "first", "z": "1"}}
             for a in ("hot", "n1")}
    edges = {("hot", "n1", "r"), ("n1", "ghost", "r"), ("hot", "hot", "s")}
    return nodes, edges, edits


def frames(spark, nodes, edges, edits):
    return (
        spark.createDataFrame([(a, v["resource_type"], v["name"], v["status"], v["last_error"], v["metadata"], 7, SEEN) for a, v in nodes.items()], NODES),
        spark.createDataFrame([(*e, 5, 2, i) for i, e in enumerate(sorted(edges))], EDGES),
        spark.createDataFrame([tuple(e[c.split()[0]] for c in EDITS.split(", ")) for e in edits], EDITS),
    )


@pytest.mark.parametrize("seed,block_rows", [(0, 1), (1, 4), (2, 11), (3, 1000), (4, 5), (5, 2)])
def test_edits_match_the_loop(spark, seed, block_rows):
    nodes, edges, edits = batch(seed)
    want_nodes, want_edges, want_audit = fold_edits(nodes, edges, edits)
    node_frame, edge_frame, edit_frame = frames(spark, nodes, edges, edits)

    got = {r["arn"]: {k: r[k] for k in ("resource_type", "name", "status", "last_error", "metadata")}
           for r in E.edited_nodes(node_frame, edit_frame, block_rows).collect()}
    assert got == want_nodes

    steps = E.node_steps(node_frame, edit_frame, block_rows)
    removals = E.node_removals(steps)
    assert {tuple(r)[:3] for r in E.edited_edges(edge_frame, edit_frame, removals).collect()} == want_edges

    audit = E.edit_audit(steps, E.edge_steps(edge_frame, edit_frame, removals, block_rows), "op", "b").orderBy("seq").collect()
    assert [(r["seq"], r["change_type"], r["resource_arn"]) for r in audit] == [w[:3] for w in want_audit]
    for row, (_, kind, _, before) in zip(audit, want_audit, strict=True):
        if kind == "health_status_changed":
            assert json.loads(row["previous_value"]) == {"status": before}
        if kind == "node_removed":
            old = json.loads(row["previous_value"])
            assert {k: old.get(k) for k in before} == before
        assert row["triggered_by"] == "operator:op" and row["source"] == "human_input"


def test_removed_and_added_again_starts_fresh(spark):
    nodes, edges, edits = batch(0, 1)
    base = edits[0]
    edits = [{**base, "seq": i, "arn": "hot", "action": a, "status": "error", "last_error": "x"} for i, a in
             enumerate(["update_health", "remove_node", "annotate", "add_node", "add_node"])]
    node_frame, edge_frame, edit_frame = frames(spark, nodes, edges, edits)
    row = [r for r in E.edited_nodes(node_frame, edit_frame).collect() if r["arn"] == "hot"][0]
    assert (row["status"], row["last_error"], row["error_count"], row["last_seen"]) == ("unknown", None, 0, None)
    kept = [r for r in E.edited_nodes(node_frame, edit_frame).collect() if r["arn"] == "n1"][0]
    assert (kept["error_count"], kept["last_seen"]) == (7, SEEN)
    steps = E.node_steps(node_frame, edit_frame)
    assert {r["action"] for r in steps.collect()} == {"update_health", "remove_node", "add_node"}
    removed = [r for r in E.edit_audit(steps, E.edge_steps(edge_frame, edit_frame, E.node_removals(steps)), "o", "b").collect() if r["change_type"] == "node_removed"]
    assert json.loads(removed[0]["previous_value"])["error_count"] == 7
    left = E.edited_edges(edge_frame, edit_frame, E.node_removals(steps)).collect()
    assert [tuple(r) for r in left] == [("n1", "ghost", "r", 5, 2, 2, None)]


def test_edge_removed_and_added_again_starts_its_counters_anew(spark):
    nodes, edges, edits = batch(0, 1)
    base = {**edits[0], "arn": "n1", "target_arn": "ghost", "relationship": "r"}
    edits = [{**base, "seq": 0, "action": "remove_edge"}, {**base, "seq": 1, "action": "add_edge"},
             {**base, "seq": 2, "arn": "hot", "target_arn": "n1", "action": "add_edge"}]
    node_frame, edge_frame, edit_frame = frames(spark, nodes, edges, edits)
    removals = E.node_removals(E.node_steps(node_frame, edit_frame))
    got = {tuple(r)[:3]: tuple(r)[3:] for r in E.edited_edges(edge_frame, edit_frame, removals).collect()}
    assert got[("n1", "ghost", "r")] == (0, 0, None, 1) and got[("hot", "n1", "r")] == (5, 2, 1, None)
