"""Prefix trie of conversations, as a burst trie over sorted containers.

A conversation is a path of turns, below a root turn without text. A turn is known by the MD5 of role and text, so texts are hashed where they
are read and never shuffled. Equal paths are folded first, with their number and smallest id.

1. A container holds the paths below one trie head. One container of all paths is the start.
2. A container of more than ``CAPACITY`` turns in more than one path bursts: the turns that all its paths share become the chain of a trie
   head, and each next turn id after them gets a container of its own. Containers of equal size or of one path stay, so every round bursts
   all large ones at once. A burst changes rows in place; only sums per container are shuffled, folded before.
3. Spark deals the remaining containers to tasks and sorts their paths. A sweep keeps the nodes of the current path open, closes what the next path
   does not share, and hands sums to the parent. It holds one path and the closed children of open nodes: at most a container.
4. Heads take the sums of the containers below them, from the last round of bursts up.

Turns of one conversation are collected into one row (about 40 bytes each): conversations of up to some ten million turns. Rounds grow
with the branching depth of large containers, not with the length of a shared beginning.

Cases: null role and text count as empty. Turns are ordered by turn (null first), then role, then MD5; repeated rows are repeated turns. Rows without
``conv_id`` belong to no conversation. No rows give no nodes, not even a root. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lograph.session import written

#: Turns of a container that does not burst; ids whose text is packed into one row before they are hashed.
CAPACITY, PACKED = 1 << 12, 1 << 14
TURN = "struct<id:binary,size:bigint>"
CONTAINER = ["box", "above", "above_conv", "depth", "rep", "n", "path"]
NODES = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "end_rep bigint, end_n bigint, box binary, above binary"
)
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_rep", "end_n", "box", "above"]
SCHEMA = pa.schema([(name, pa.binary() if name in ("box", "above") else pa.int64()) for name in NAMES])


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id`` and ``path``, its turns in order. ``turns`` has ``conv_id``, ``turn``, ``role`` and ``text``."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    known = F.unhex(F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text)))
    rows = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").isNotNull().alias("given"), "turn", role.alias("role"), known.alias("id"),
        F.octet_length(text).cast("bigint").alias("size"),
    )
    listed = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("given", "turn", "role", "id", "size"))).alias("turns"))
    return listed.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["size"].alias("size"))).alias("path"))


def folded(lists: DataFrame) -> DataFrame:
    """Each distinct path once: ``rep`` (smallest conversation), ``n`` (conversations) and ``path``."""
    return lists.groupBy("path").agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"))


def shared(low: Column, high: Column) -> Column:
    """How many turns two different paths have in common at their beginning."""
    return F.array_position(F.zip_with(low, high, lambda a, b: F.coalesce(a["id"] == b["id"], F.lit(False))), F.lit(False)) - 1


def burst(boxes: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, list[DataFrame]]:
    """Containers that need no burst any more, and the trie heads of each round."""
    heads: list[DataFrame] = []
    while True:
        weights = boxes.groupBy("box").agg(F.sum(F.size("path")).alias("weight"), F.count(F.lit(1)).alias("rows"))
        large = written(weights.filter((F.col("weight") > capacity) & (F.col("rows") > 1)).select("box"), "large")
        if large.isEmpty():
            return boxes, heads
        ends = boxes.join(large, "box").groupBy("box", "above", "above_conv", "depth").agg(
            F.min("path").alias("low"), F.max("path").alias("high"), F.min("rep").alias("conv"), F.sum("n").alias("convs"),
        )
        head = ends.select(
            "box", "above", "above_conv", "depth", "conv", "convs", F.slice("low", F.lit(1), shared(F.col("low"), F.col("high")).cast("int")).alias("chain"),
        )
        heads.append(written(head, "heads"))
        marks = heads[-1].select(F.col("box").alias("of"), F.col("conv").alias("own_conv"), F.size("chain").alias("common"))
        joined = boxes.join(marks, F.col("box") == F.col("of"), "left")
        more = F.size("path") > F.col("common")
        next_id = F.element_at("path", F.col("common") + 1)["id"]
        box = F.when(F.col("of").isNull(), F.col("box")).when(more, F.unhex(F.md5(F.concat("box", next_id))))
        boxes = written(joined.select(
            box.alias("box"), F.when(F.col("of").isNull(), F.col("above")).otherwise(F.col("box")).alias("above"),
            F.when(F.col("of").isNull(), F.col("above_conv")).otherwise(F.col("own_conv")).alias("above_conv"),
            (F.col("depth") + F.coalesce("common", F.lit(0))).alias("depth"), "rep", "n",
            F.when(F.col("of").isNull(), F.col("path")).otherwise(F.slice("path", F.col("common") + 1, F.size("path"))).alias("path"),
        ), "boxes")
        # Paths that end at a head are no container: the head keeps them.
        heads[-1] = heads[-1].join(
            boxes.filter("box is null").select(F.col("above").alias("of"), F.col("rep").alias("end_rep"), F.col("n").alias("end_n")),
            F.col("box") == F.col("of"), "left",
        ).drop("of")
        boxes = boxes.filter("box is not null")


class Node:
    __slots__ = ("children", "conv", "depth", "end_n", "end_rep", "id", "leaves", "n", "pending", "saved", "size")

    def __init__(self, depth: int, id_: bytes, size: int) -> None:
        self.depth, self.id, self.size = depth, id_, size
        self.conv, self.n, self.children, self.leaves, self.saved = None, 0, 0, 0, 0
        self.end_rep, self.end_n, self.pending = None, 0, []


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of containers, of rows sorted by container and path. The top node of each has ``box`` and ``above``."""
    out: list[tuple] = []
    open_: list[Node] = []
    box = above = above_conv = None

    def close(keep: int) -> None:
        while len(open_) > keep:
            node = open_.pop()
            if not node.children:
                node.leaves = 1
            node.saved += (node.n - 1) * node.size
            out.extend((*row, node.conv) for row in node.pending)
            row = (node.conv, node.depth, node.n, node.children, node.leaves, node.saved, node.end_rep, node.end_n, None, None)
            if not open_:
                out.append((*row[:-2], box, above, above_conv))
                continue
            parent = open_[-1]
            parent.pending.append(row)
            parent.children += 1
            parent.n += node.n
            parent.leaves += node.leaves
            parent.saved += node.saved
            parent.conv = node.conv if parent.conv is None else min(parent.conv, node.conv)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        conv, depth, n, children, leaves, saved, end_rep, end_n, box, above, parent = (list(c) for c in zip(*rows))
        columns = [conv, depth, parent, n, children, leaves, saved, end_rep, end_n, box, above]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, SCHEMA.types)], names=NAMES)

    for batch in batches:
        for row in range(batch.num_rows):
            own, over, over_conv, depth, rep, n = (batch.column(i)[row].as_py() for i in range(6))
            turns = batch.column(6)[row].values
            ids, sizes = turns.field("id").to_pylist(), turns.field("size").to_pylist()
            if own != box:
                close(0)
                box, above, above_conv = own, over, over_conv
            common = 0
            while common < len(open_) and common < len(ids) and open_[common].id == ids[common]:
                common += 1
            close(common)
            for i in range(common, len(ids)):
                open_.append(Node(depth + i, ids[i], sizes[i]))
            # Paths are distinct, and a path that ends inside another comes before it.
            last = open_[-1]
            last.end_rep, last.end_n = rep, n
            last.n += n
            last.conv = rep if last.conv is None else min(last.conv, rep)
        if len(out) > PACKED:
            yield batch_of(out)
            out = []
    close(0)
    if out:
        yield batch_of(out)


def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of trie heads, with the sums of what is below them."""
    for batch in batches:
        out: dict[str, list] = {name: [] for name in NAMES}
        for row in batch.to_pylist():
            saved, chain = row["saved"], row["chain"]
            for i in range(len(chain) - 1, -1, -1):
                saved += (row["convs"] - 1) * chain[i]["size"]
                top, last = i == 0, i == len(chain) - 1
                values = (
                    row["conv"], row["depth"] + i, row["above_conv"] if top else row["conv"], row["convs"], row["children"] if last else 1, row["leaves"],
                    saved, row["end_rep"] if last else None, (row["end_n"] or 0) if last else 0, row["box"] if top else None, row["above"] if top else None,
                )
                for name, value in zip(NAMES, values):
                    out[name].append(value)
        yield pa.RecordBatch.from_arrays([pa.array(out[name], kind) for name, kind in zip(NAMES, SCHEMA.types)], names=NAMES)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by ``rep`` and ``conv_id``: the ids of each ``rep`` as text, some thousands to a row, with the first of them."""
    rep, ids = None, []
    out: list[tuple[int, int, str]] = []
    for batch in batches:
        for r, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (r != rep or len(ids) == PACKED):
                out.append((rep, ids[0], ",".join(map(str, ids))))
                ids = []
            rep = r
            ids.append(c)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*out)], names=["rep", "first", "ids"])
            out = []
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array([rep]), pa.array([ids[0]]), pa.array([",".join(map(str, ids))])], names=["rep", "first", "ids"])


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the packed ids of each ``rep``, of rows sorted by ``rep`` and ``first``: one state of the hash is held."""
    rep, state = None, None
    names = ["end_of", "ends_sha256"]
    for batch in batches:
        done: list[tuple[int, str]] = []
        for r, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if r != rep:
                if state is not None:
                    done.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=names)


def end_hashes(lists: DataFrame, folds: DataFrame) -> DataFrame:
    """``end_of`` and ``ends_sha256`` of every path that several conversations have."""
    several = folds.filter("n > 1").select(F.slice("path", F.lit(2), F.size("path")).alias("path"), "rep")
    members = lists.join(several, "path").select("rep", "conv_id")
    packed = written(members, "members").repartitionByRange("rep", "conv_id").sortWithinPartitions("rep", "conv_id").mapInArrow(
        pack, "rep bigint, first bigint, ids string",
    )
    packed = written(packed, "packed")
    return packed.repartition("rep").sortWithinPartitions("rep", "first").mapInArrow(digest, "end_of bigint, ends_sha256 string")


def prefix_trie(lists: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per node of the trie of ``lists`` (``conv_id``, unique, and ``path``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.
    """
    lists = written(lists.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("path").cast(f"array<{TURN}>").alias("path")), "paths")
    root = F.struct(F.lit(b"").alias("id"), F.lit(0).cast("bigint").alias("size"))
    folds = written(folded(lists).select(
        F.lit(b"").alias("box"), F.lit(None).cast("binary").alias("above"), F.lit(None).cast("bigint").alias("above_conv"),
        F.lit(0).cast("bigint").alias("depth"), "rep", "n", F.concat(F.array(root), "path").alias("path"),
    ), "folds")
    boxes, heads = burst(folds, capacity)
    dealt = boxes.select(*CONTAINER).repartition("box").sortWithinPartitions("box", "path")
    nodes = written(dealt.mapInArrow(sweep, NODES), "nodes")
    for head in reversed(heads):
        below = nodes.filter("box is not null").groupBy(F.col("above").alias("of")).agg(
            F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("children"),
        )
        filled = head.join(below, F.col("box") == F.col("of"))
        nodes = nodes.union(written(filled.mapInArrow(chains, NODES), "chains"))
    none = F.sha2(F.lit("").cast("binary"), 256)
    single = F.when(F.col("end_n") == 1, F.sha2(F.col("end_rep").cast("string").cast("binary"), 256)).otherwise(none)
    several = nodes.filter("end_n > 1").join(end_hashes(lists, folds), F.col("end_rep") == F.col("end_of"))
    columns = NAMES[:7]
    return nodes.filter("end_n <= 1").select(*columns, single.alias("ends_sha256")).union(several.select(*columns, "ends_sha256"))
