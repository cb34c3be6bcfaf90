"""Batches of operator edits on a topology, applied in list order without a loop.

Whether an edit takes effect depends on what came before it: on the node for node edits, on the
edge and both its ends for edge edits. A node's life is cut at each add that takes effect (an
incarnation). The order column ``seq`` is cut into blocks, so one much edited resource spreads over
many tasks: each block is summed up for both cases, node present or absent at its start, and a
window over the block summaries tells which case holds.

Removing a node removes its edges. That is not a join of removals with edges: an edge holds after
its own last edit exactly if neither end was removed since.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lograph.fixed_values import UNKNOWN
from lograph.functions.text import change_id
from lograph.operators.graph import EDGE_KEY, merge_maps
from lograph.operators.running import BLOCK, BLOCK_ROWS, earlier, latest, with_block, with_running

INITIAL = -1
NODE_ACTIONS = ["add_node", "remove_node", "update_health", "annotate"]
EDGE_ACTIONS = ["add_edge", "remove_edge"]
STATE = ["birth", "status", "last_error", "note"]


def _node_events(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """Stored nodes as adds before the batch, and the node edits, with what each would set."""
    stored = nodes.select(
        F.lit(INITIAL).cast("bigint").alias("seq"), F.lit("add_node").alias("action"), "arn", "status", "last_error",
        F.lit(None).cast("string").alias("text"), "resource_type", "name", "metadata", "error_count", "last_seen",
    )
    asked = edits.where(F.col("action").isin(NODE_ACTIONS)).select(
        "seq", "action", "arn", "status", "last_error", "text", "resource_type", "name", "metadata",
        F.lit(0).cast("bigint").alias("error_count"), F.lit(None).cast("timestamp_ntz").alias("last_seen"),
    )
    is_add, is_stored = F.col("action") == "add_node", F.col("seq") == INITIAL
    sets_health, sets_note = F.col("action") == "update_health", F.col("action") == "annotate"
    return stored.unionByName(asked).withColumns({
        "is_add": F.when(is_add, True).when(F.col("action") == "remove_node", False),
        # One-field structs, so that a value reset to null still counts as set.
        "set_birth": F.when(is_add, F.struct("resource_type", "name", "metadata", "error_count", "last_seen")),
        "set_status": F.when(is_stored, F.struct(F.col("status").alias("v")))
        .when(is_add, F.struct(F.lit(UNKNOWN).alias("v"))).when(sets_health, F.struct(F.col("status").alias("v"))),
        "set_last_error": F.when(is_stored, F.struct(F.col("last_error").alias("v")))
        .when(is_add, F.struct(F.lit(None).cast("string").alias("v")))
        .when(sets_health & F.col("last_error").isNotNull(), F.struct(F.col("last_error").alias("v"))),
        "set_note": F.when(is_add, F.struct(F.lit(None).cast("string").alias("v")))
        .when(sets_note, F.struct(F.col("text").alias("v"))),
    })


def _blocks(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events with what their own block tells, and one row per (arn, block) with its start and end state."""
    here = events.withColumn(
        "present_here", F.last("is_add", ignorenulls=True).over(earlier("arn", BLOCK, order=["seq"]))
    )
    sure = F.col("present_here").isNotNull()
    works = F.when(F.col("action") == "add_node", ~F.col("present_here")).otherwise(F.col("present_here"))
    seq = F.col("seq")
    adds_or_removes = F.when(F.col("is_add").isNotNull(), seq)
    summary = [
        F.min_by("is_add", adds_or_removes).alias("first_is_add"),
        F.max_by("is_add", adds_or_removes).alias("last_is_add"),
        F.count_if(sure & works & (F.col("action") == "add_node")).alias("sure_births"),
    ]
    for name in STATE:
        value = F.col(f"set_{name}")
        summary += [
            latest(F.when(sure & works, value), seq).alias(f"sure_{name}"),
            latest(F.when(~sure & (F.col("action") != "add_node"), value), seq).alias(f"if_present_{name}"),
            F.min_by(value, F.when(~sure & (F.col("action") == "add_node"), seq)).alias(f"if_absent_{name}"),
        ]
    per_block = here.groupBy("arn", BLOCK).agg(*summary)
    before = earlier("arn", order=[BLOCK])
    started = per_block.withColumn(
        "present_start", F.coalesce(F.last("last_is_add", ignorenulls=True).over(before), F.lit(False))
    )
    born_first = F.coalesce(F.col("first_is_add"), F.lit(False)) & ~F.col("present_start")
    ended = started.withColumns({
        "births": F.col("sure_births") + born_first.cast("bigint"),
        **{
            f"end_{name}": F.coalesce(
                f"sure_{name}",
                F.when(born_first, F.col(f"if_absent_{name}")),
                F.when(F.col("present_start"), F.col(f"if_present_{name}")),
            )
            for name in STATE
        },
    })
    return here, ended.select(
        "arn", BLOCK, "present_start", "last_is_add",
        F.coalesce(F.sum("births").over(before), F.lit(0)).alias("births_start"),
        *[F.last(f"end_{n}", ignorenulls=True).over(before).alias(f"start_{n}") for n in STATE],
        *[F.col(f"end_{n}") for n in STATE],
    )


def node_steps(nodes: DataFrame, edits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Node edits that take effect, each with the node as it was before the step.

    ``nodes``: arn, resource_type, name, status, last_error, error_count, last_seen, metadata. ``edits``: see ``schemas.EDITS``.
    """
    here, ended = _blocks(with_block(_node_events(nodes, edits), "seq", block_rows))
    present = F.coalesce("present_here", "present_start")
    works = F.when(F.col("action") == "add_node", ~present).otherwise(present)
    in_block = earlier("arn", BLOCK, order=["seq"])
    rows = here.join(ended.drop("last_is_add", *[f"end_{n}" for n in STATE]), ["arn", BLOCK]).withColumn("works", works)
    rows = rows.withColumns({
        **{
            f"old_{n}": F.coalesce(
                F.last(F.when(F.col("works"), F.col(f"set_{n}")), ignorenulls=True).over(in_block), F.col(f"start_{n}")
            )
            for n in STATE
        },
        "incarnation": F.col("births_start") + F.sum(
            F.when(F.col("works") & (F.col("action") == "add_node"), 1).otherwise(0)
        ).over(Window.partitionBy("arn", BLOCK).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)),
    })
    return rows.where(F.col("works") & (F.col("seq") != INITIAL)).select(
        "seq", "action", "arn", "incarnation", "status", "last_error", "text", "resource_type", "name", "metadata",
        F.col("old_birth.resource_type").alias("old_resource_type"), F.col("old_birth.name").alias("old_name"),
        F.col("old_birth.metadata").alias("old_metadata"), F.col("old_birth.error_count").alias("old_error_count"),
        F.col("old_birth.last_seen").alias("old_last_seen"), F.col("old_status.v").alias("old_status"),
        F.col("old_last_error.v").alias("old_last_error"), F.col("old_note.v").alias("old_note"),
    )


def edited_nodes(nodes: DataFrame, edits: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Nodes after the batch, from the block summaries alone. No edit touches the error counter and the last error's time."""
    _, ended = _blocks(with_block(_node_events(nodes, edits), "seq", block_rows))
    block = F.col(BLOCK)
    final = ended.groupBy("arn").agg(
        latest(F.col("last_is_add"), block).alias("present"), *[latest(F.col(f"end_{n}"), block).alias(n) for n in STATE]
    )
    return final.where("present").select(
        "arn", F.col("birth.resource_type").alias("resource_type"), F.col("birth.name").alias("name"),
        F.col("status.v").alias("status"), F.col("last_error.v").alias("last_error"),
        F.col("birth.error_count").alias("error_count"), F.col("birth.last_seen").alias("last_seen"),
        with_note(F.col("birth.metadata"), F.col("note.v")).alias("metadata"),
    )


def with_note(metadata: Column, note: Column) -> Column:
    """Metadata with the operator's note under its own key."""
    return F.when(note.isNull(), F.coalesce(metadata, F.expr("cast(map() as map<string,string>)"))).otherwise(
        merge_maps(metadata, F.create_map(F.lit("human_annotation"), note))
    )


def _edge_events(edges: DataFrame, edits: DataFrame) -> DataFrame:
    asked = edits.where(F.col("action").isin(EDGE_ACTIONS)).select(
        "seq", F.col("arn").alias("source_arn"), "target_arn", "relationship", (F.col("action") == "add_edge").alias("is_add")
    )
    stored = edges.select(F.lit(INITIAL).cast("bigint").alias("seq"), *EDGE_KEY, F.lit(True).alias("is_add"))
    return stored.unionByName(asked)


def edge_steps(edges: DataFrame, edits: DataFrame, removals: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edge edits that take effect. ``removals``: arn, seq of the node removals that took effect."""
    events = _edge_events(edges, edits)
    own = with_running(
        events, EDGE_KEY, ["seq"], {"own": ("last", F.struct("seq", "is_add"))}, block_rows
    ).where(F.col("seq") != INITIAL)
    both = F.array_distinct(F.array("source_arn", "target_arn"))
    ends = events.where(F.col("seq") != INITIAL).select(F.explode(both).alias("arn"), "seq").withColumn(
        "removed_at", F.lit(None).cast("bigint")
    )
    probes = with_running(
        ends.unionByName(removals.select("arn", "seq", F.col("seq").alias("removed_at"))),
        ["arn"], ["seq"], {"last_removal": ("max", F.col("removed_at"))}, block_rows,
    )
    cut = probes.where("removed_at is null").groupBy("seq").agg(F.max("last_removal").alias("last_removal"))
    present = F.coalesce(
        F.col("own.is_add") & (F.coalesce("last_removal", F.lit(INITIAL - 1)) < F.col("own.seq")), F.lit(False)
    )
    works = F.when(F.col("is_add"), ~present).otherwise(present)
    return own.join(cut, "seq").where(works).select("seq", *EDGE_KEY, "is_add")


def edited_edges(edges: DataFrame, edits: DataFrame, removals: DataFrame) -> DataFrame:
    """Edges after the batch: last own edit an add, and no end removed since.

    A stored edge that no edit and no removed end cut keeps its counters and position. An edge that was added
    starts its counters at 0; ``added_seq`` tells where in the batch.
    """
    kept = [c for c in ("request_count", "error_count", "position") if c in edges.columns]
    events = _edge_events(edges, edits).join(
        edges.select(*EDGE_KEY, F.lit(INITIAL).cast("bigint").alias("seq"), F.struct(F.lit(True).alias("there"), *kept).alias("stored")), [*EDGE_KEY, "seq"], "left")
    last = events.groupBy(*EDGE_KEY).agg(
        F.max_by("is_add", "seq").alias("is_add"), F.max("seq").alias("seq"), F.max("stored").alias("stored"),
        F.bool_or(~F.col("is_add")).alias("cut"),
    ).where("is_add")
    gone = removals.groupBy("arn").agg(F.max("seq").alias("gone_at"))
    for end in ("source_arn", "target_arn"):
        here = gone.select(F.col("arn").alias(end), F.col("gone_at").alias("__gone"))
        last = last.join(here, end, "left").where("__gone is null or __gone < seq").withColumn(
            "cut", F.col("cut") | F.col("__gone").isNotNull()).drop("__gone")
    same = F.col("stored").isNotNull() & ~F.col("cut")
    counters = [F.when(same, F.col(f"stored.{c}")).otherwise(F.lit(None if c == "position" else 0).cast("bigint")).alias(c) for c in kept]
    return last.select(*EDGE_KEY, *counters, F.when(~same, F.col("seq")).alias("added_seq"))


def node_removals(steps: DataFrame) -> DataFrame:
    return steps.where(F.col("action") == "remove_node").select("arn", "seq")


def edit_audit(node_rows: DataFrame, edge_rows: DataFrame, operator_id: str, batch: str) -> DataFrame:
    """One audit row per edit that took effect. Edges lost with a node have none of their own."""
    action = F.col("action")
    old_node = F.to_json(F.struct(
        "arn", F.col("old_resource_type").alias("resource_type"), F.col("old_name").alias("name"),
        F.col("old_status").alias("status"), F.col("old_last_error").alias("last_error"),
        F.col("old_error_count").alias("error_count"), F.col("old_last_seen").alias("last_seen"),
        with_note(F.col("old_metadata"), F.col("old_note")).alias("metadata"),
    ))
    nodes = node_rows.select(
        "seq", F.col("arn").alias("resource_arn"),
        F.when(action == "add_node", "node_added").when(action == "remove_node", "node_removed")
        .when(action == "update_health", "health_status_changed").otherwise("human_annotation").alias("change_type"),
        F.when(action == "add_node", F.concat(F.lit("Human added node "), "name", F.lit(" ("), "resource_type", F.lit(")")))
        .when(action == "remove_node", F.concat(F.lit("Human removed node "), "arn"))
        .when(action == "update_health", F.concat(
            F.lit("Human changed health from '"), "old_status", F.lit("' to '"), "status", F.lit("'")))
        .otherwise(F.concat(F.lit("Human annotation: "), "text")).alias("description"),
        F.when(action == "remove_node", old_node)
        .when(action == "update_health", F.to_json(F.struct(F.col("old_status").alias("status")))).alias("previous_value"),
        F.when(action == "add_node", F.to_json(F.struct("resource_type", "name", "metadata")))
        .when(action == "update_health", F.to_json(F.struct("status")))
        .when(action == "annotate", F.to_json(F.struct(F.col("text").alias("annotation")))).alias("new_value"),
    )
    edge = F.to_json(F.struct(*EDGE_KEY))
    is_add = F.col("is_add")
    edges = edge_rows.select(
        "seq", F.col("source_arn").alias("resource_arn"),
        F.when(is_add, "edge_added").otherwise("edge_removed").alias("change_type"),
        F.concat(
            F.when(is_add, "Human added edge ").otherwise("Human removed edge "),
            "source_arn", F.lit(" --"), "relationship", F.lit("--> "), "target_arn",
        ).alias("description"),
        F.when(~is_add, edge).alias("previous_value"), F.when(is_add, edge).alias("new_value"),
    )
    return nodes.unionByName(edges).withColumns({
        "change_id": change_id(F.lit(batch), F.col("seq")),
        "source": F.lit("human_input"),
        "triggered_by": F.lit(f"operator:{operator_id}"),
    })
