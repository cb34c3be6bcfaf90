"""Small sequential referees, written from the rules, to check the set-based operators against."""


def bucket(arn):
    head = "arn:aws:s3:::"
    return head + arn[len(head):].split("/")[0] if arn.startswith(head) else arn


def fold_health(nodes, findings):
    """nodes: arn -> [status, last_error, count, last_seen]; findings in order: (seq, ts, severity, message, arns)."""
    nodes = {a: list(v) for a, v in nodes.items()}
    audit = []
    for seq, ts, severity, message, arns in findings:
        for pos, arn in enumerate(bucket(a) for a in arns):
            if arn not in nodes:
                continue
            state = nodes[arn]
            was = state[0]
            if severity in ("error", "critical"):
                state[0], state[1], state[3] = "error", message, ts
                state[2] += 1
                kind = "health_error_recorded" if was == "error" else "health_status_changed"
                audit.append((seq, pos, arn, kind, state[2] if was == "error" else was))
            elif severity == "warning" and was != "error":
                state[3] = ts
                if was != "warning":
                    state[0] = "warning"
                    audit.append((seq, pos, arn, "health_status_changed", was))
    return {a: tuple(v) for a, v in nodes.items()}, audit


def fold_edits(nodes, edges, edits):
    """nodes: arn -> dict; edges: set of triples; edits in order as dicts. Returns nodes, edges, audit rows."""
    nodes = {a: dict(v, metadata=dict(v["metadata"])) for a, v in nodes.items()}
    edges = set(edges)
    audit = []
    for e in edits:
        arn, action = e["arn"], e["action"]
        triple = (arn, e["target_arn"], e["relationship"])
        node = nodes.get(arn)
        if action == "add_node" and node is None:
            nodes[arn] = {"resource_type": e["resource_type"], "name": e["name"], "status": "unknown", "last_error": None,
                          "metadata": dict(e["metadata"] or {})}
            audit.append((e["seq"], "node_added", arn, None))
        elif action == "remove_node" and node is not None:
            audit.append((e["seq"], "node_removed", arn, dict(node, metadata=dict(node["metadata"]))))
            del nodes[arn]
            edges = {t for t in edges if arn not in t[:2]}
        elif action == "add_edge" and triple not in edges:
            edges.add(triple)
            audit.append((e["seq"], "edge_added", arn, None))
        elif action == "remove_edge" and triple in edges:
            edges.discard(triple)
            audit.append((e["seq"], "edge_removed", arn, triple))
        elif action == "update_health" and node is not None:
            audit.append((e["seq"], "health_status_changed", arn, node["status"]))
            node["status"] = e["status"]
            if e["last_error"] is not None:
                node["last_error"] = e["last_error"]
        elif action == "annotate" and node is not None:
            audit.append((e["seq"], "human_annotation", arn, None))
            node["metadata"]["human_annotation"] = e["text"]
    return nodes, edges, audit
