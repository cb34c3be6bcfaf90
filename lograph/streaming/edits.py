"""Operator edits as a stream: a state per node with its incident edges, and a merge table of edges behind it.

1. Edits are keyed by node; an edit of an edge goes to both its ends. The state of a node holds its incarnation and what was set in it, and a
   map of the edges that were added at it. A removal that takes effect sends a cut to every edge of the map.
2. What the nodes send is keyed by edge. Of a batch the last event of an edge counts, and whether it was ever cut; that meets the row
   that the edge has in its table. An edge keeps its counters as long as nothing cut it.

Edits come in list order from batch to batch (inside a batch by ``seq``). The edits of one node in one micro-batch are worked on by one task, since
each depends on the one before. Both tables take a batch once, so a batch that runs again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lograph.fixed_values import UNKNOWN
from lograph.operators.edits import EDGE_ACTIONS, INITIAL, NODE_ACTIONS, with_note
from lograph.operators.graph import EDGE_KEY
from lograph.session import written
from lograph.sources.merge_table import MergeTable

#: What is set in a node; the map of metadata as JSON text.
NODE = "resource_type string, name string, metadata string, status string, last_error string, note string, error_count bigint, last_seen timestamp_ntz"
EVENT = "arn string, seq bigint, action string, source_arn string, target_arn string, relationship string, status string, last_error string, " \
    "text string, resource_type string, name string, metadata string, error_count bigint, last_seen timestamp_ntz"
EVENT_COLUMNS = [part.split()[0] for part in EVENT.split(", ")]
OUT = f"arn string, present boolean, incarnation bigint, {NODE}, seq bigint, source_arn string, target_arn string, relationship string, is_add boolean"
OUT_COLUMNS = [part.split()[0] for part in OUT.split(", ")]
NODES = f"arn string, present boolean, incarnation bigint, {NODE}"
EDGES = "edge string, source_arn string, target_arn string, relationship string, present boolean, cut boolean, stored boolean, " \
    "request_count bigint, error_count bigint, seq bigint"
STORED_NODE, STORED_EDGE = "stored_node", "stored_edge"
#: Cuts in one frame of output.
CUTS = 10_000


def _plain(value):
    """Pandas' missing values as none."""
    return None if value is None or value is pd.NaT or value != value else value


class NodeEdits(StatefulProcessor):
    """Edits of one node in list order in; the node as it is then, and events of its edges out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.node = handle.getValueState("node", f"present boolean, incarnation bigint, {NODE}")
        self.edges = handle.getMapState("edges", "source_arn string, target_arn string, relationship string", "seq bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for row in initialState[EVENT_COLUMNS].itertuples(index=False):
            if row.action == STORED_NODE:
                fields = (row.resource_type, row.name, row.metadata, row.status, row.last_error, None, row.error_count, row.last_seen)
                self.node.update((True, 0, *map(_plain, fields)))
            else:
                self.edges.updateValue((row.source_arn, row.target_arn, row.relationship), (INITIAL,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows))[EVENT_COLUMNS].sort_values("seq")
        present, incarnation, *node = self.node.get() if self.node.exists() else (False, -1, *[None] * 8)
        # The map of edges is read once and written back once: a call on the state for each edit costs a round trip to the JVM.
        held = {tuple(edge): tuple(seq) for edge, seq in self.edges.iterator()}
        before = dict(held)
        changed, out = False, []
        for row in events.itertuples(index=False):
            action = row.action
            if action in EDGE_ACTIONS:
                edge = (row.source_arn, row.target_arn, row.relationship)
                if action == "add_edge":
                    held[edge] = (int(row.seq),)
                else:
                    held.pop(edge, None)
                if row.source_arn == key[0]:
                    out.append(self.event(edge, row.seq, action == "add_edge"))
                continue
            if present == (action == "add_node"):
                continue
            changed = True
            if action == "add_node":
                present, incarnation = True, incarnation + 1
                node = [_plain(row.resource_type), _plain(row.name), _plain(row.metadata), UNKNOWN, None, None, 0, None]
            elif action == "remove_node":
                present = False
                for edge in held:
                    out.append(self.event(edge, row.seq, False))
                    if len(out) >= CUTS:
                        yield self.frame(out)
                        out = []
                held.clear()
            elif action == "update_health":
                node[3] = _plain(row.status)
                node[4] = node[4] if _plain(row.last_error) is None else row.last_error
            else:
                node[5] = _plain(row.text)
        for edge in before.keys() - held.keys():
            self.edges.removeKey(edge)
        for edge, seq in held.items():
            if before.get(edge) != seq:
                self.edges.updateValue(edge, seq)
        if changed:
            self.node.update((present, incarnation, *node))
            out.append((key[0], present, incarnation, *node, None, None, None, None, None))
        if out:
            yield self.frame(out)

    @staticmethod
    def event(edge: tuple, seq: int, is_add: bool) -> tuple:
        return (None, None, None, *[None] * 8, int(seq), *edge, is_add)

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=OUT_COLUMNS, dtype=object)
        out["last_seen"] = pd.to_datetime(out["last_seen"])
        return out.astype({"incarnation": "Int64", "error_count": "Int64", "seq": "Int64", "present": "boolean", "is_add": "boolean"})

    def close(self) -> None:
        pass


def node_table(spark: SparkSession, target: str) -> MergeTable:
    return MergeTable(spark, f"{target}/nodes", NODES, "arn")


def edge_table(spark: SparkSession, target: str) -> MergeTable:
    return MergeTable(spark, f"{target}/edges", EDGES, "edge")


def edge_id():
    return F.to_json(F.array(*EDGE_KEY))


def _stored(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Stored nodes and edges as events, an edge once for each end."""
    none = {name: F.lit(None).cast(kind) for name, kind in (part.split() for part in EVENT.split(", "))}
    seq = F.lit(INITIAL).cast("bigint")
    known = {"seq": seq, "action": F.lit(STORED_NODE), "metadata": F.to_json("metadata")}
    held = [known.get(c, F.col(c) if c in nodes.columns else none[c]).alias(c) for c in EVENT_COLUMNS]
    ends = edges.select(*EDGE_KEY, F.explode(F.array_distinct(F.array("source_arn", "target_arn"))).alias("arn"))
    linked = [{"seq": seq, "action": F.lit(STORED_EDGE)}.get(c, F.col(c) if c in ends.columns else none[c]).alias(c) for c in EVENT_COLUMNS]
    return nodes.select(*held).unionByName(ends.select(*linked))


def _events(edits: DataFrame) -> DataFrame:
    """Edits keyed by node; those of an edge once for each end."""
    on_edge = F.col("action").isin(EDGE_ACTIONS)
    ends = F.when(on_edge, F.array_distinct(F.array("arn", "target_arn"))).otherwise(F.array("arn"))
    rows = edits.where(F.col("action").isin(NODE_ACTIONS + EDGE_ACTIONS)).withColumn("__end", F.explode(ends))
    own = {
        "arn": F.col("__end"), "source_arn": F.when(on_edge, F.col("arn")), "metadata": F.to_json("metadata"),
        "error_count": F.lit(0).cast("bigint"), "last_seen": F.lit(None).cast("timestamp_ntz"),
    }
    return rows.select(*[own.get(c, F.col(c)).alias(c) for c in EVENT_COLUMNS])


def _edge_rows(events: DataFrame, table: MergeTable) -> DataFrame:
    """The edges of a batch's events as they are then."""
    last = written(events.groupBy(edge_id().alias("edge"), *EDGE_KEY).agg(
        F.max_by("is_add", "seq").alias("is_add"), F.max("seq").alias("last_seq"), F.bool_or(~F.col("is_add")).alias("cut_now"),
    ), "edge_events")
    old = table.lookup(last).select("edge", F.col("cut").alias("cut0"), F.col("stored").alias("stored0"), "request_count", "error_count")
    cut, stored = F.coalesce("cut0", F.lit(False)) | F.col("cut_now"), F.coalesce("stored0", F.lit(False))
    counted = [F.when(stored & ~cut, F.col(c)).otherwise(0).cast("bigint").alias(c) for c in ("request_count", "error_count")]
    return last.join(old, "edge", "left").select(
        "edge", *EDGE_KEY, F.col("is_add").alias("present"), cut.alias("cut"), stored.alias("stored"), *counted, F.col("last_seq").alias("seq"),
    )


def edit_stream(edits: DataFrame, nodes: DataFrame, edges: DataFrame, target: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply a stream of edits (``schemas.EDITS``) to the nodes and edges that are there when it starts.

    ``nodes`` and ``edges`` as :func:`lograph.operators.edits.edited_nodes` and :func:`~lograph.operators.edits.edited_edges` take them.
    Results are read by :func:`streamed_nodes` and :func:`streamed_edges`.
    """
    spark = edits.sparkSession
    start = nodes.select(
        "arn", F.lit(True).alias("present"), F.lit(0).cast("bigint").alias("incarnation"), "resource_type", "name", F.to_json("metadata").alias("metadata"),
        "status", "last_error", F.lit(None).cast("string").alias("note"), "error_count", "last_seen",
    )
    linked = edges.select(
        edge_id().alias("edge"), *EDGE_KEY, F.lit(True).alias("present"), F.lit(False).alias("cut"), F.lit(True).alias("stored"),
        "request_count", "error_count", F.lit(INITIAL).cast("bigint").alias("seq"),
    )
    node_table(spark, target).append(start, checkpoint, INITIAL)
    edge_table(spark, target).append(linked, checkpoint, INITIAL)
    out = _events(edits).groupBy("arn").transformWithStateInPandas(
        NodeEdits(), OUT, "Append", "None", initialState=_stored(nodes, edges).groupBy("arn"))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch, "edited")
        node_table(batch.sparkSession, target).append(rows.where("arn is not null"), checkpoint, batch_id)
        table = edge_table(batch.sparkSession, target)
        table.append(_edge_rows(rows.where("arn is null"), table), checkpoint, batch_id)

    writer = out.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if once else writer).start()


def streamed_nodes(spark: SparkSession, target: str) -> DataFrame:
    """The nodes after all edits so far, as :func:`lograph.operators.edits.edited_nodes` gives them."""
    metadata = with_note(F.from_json("metadata", "map<string,string>"), F.col("note"))
    return node_table(spark, target).newest().where("present").select(
        "arn", "resource_type", "name", "status", "last_error", "error_count", "last_seen", metadata.alias("metadata"))


def streamed_edges(spark: SparkSession, target: str) -> DataFrame:
    """The edges after all edits so far; ``added_seq`` tells which edit added an edge that was not there at the start or was cut since."""
    same = F.col("stored") & ~F.col("cut")
    return edge_table(spark, target).newest().where("present").select(
        *EDGE_KEY, "request_count", "error_count", F.when(~same, F.col("seq")).alias("added_seq"))
