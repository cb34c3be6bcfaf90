"""Near-duplicate vectors through hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class, represented by its smallest id; a digest names what is equal. Classes are dealt to shards by a hash; a task builds
the graph of a shard and writes it as files to the shared folder. Then blocks of queries meet every shard: each class queries every graph. Tasks
read the graph and the block from those files, so no vector is shuffled to the shards and the JVM holds no graph.
A query whose whole beam lies above the threshold is repeated with a wider one (and answered by comparing
all vectors of the shard once the beam would hold a good part of it). Each task audits itself: for the queries whose id is
divisible by ``AUDIT`` it compares all vectors of the shard, and while the graph found less than ``RECALL`` of their links, the beam
of the whole block doubles. Cosines of what was found are verified in double precision; a pair found from either side is a link.

The graph: nodes get levels by a hash, each level is a graph of the nodes that reach it, levels are built from the top, in batches that
search the level so far and link each other. Links are picked so that none is nearer to another
picked one than to the node itself, which keeps dense groups connected to the rest.

Cases: a vector that is null, empty, zero or holds null or non-finite components links with nothing. Vectors of
different lengths do not link. A null id has no links and a null component. Repeated rows are members of one class. An empty table gives an
empty result. Extra columns do not matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lograph.llm.components import components
from lograph.llm.warc import as_uri
from lograph.session import free_shuffles, scratch_path, written

THRESHOLD = 0.9
LEAST_SHARDS, SHARD_NUMBERS = 8, 4 << 20
#: Queries per block. A task holds one block and one shard.
BLOCK = 16_384
#: The most tasks that the queries are dealt to.
TASKS = 1 << 14
#: Links per node and level; twice as many on the lowest level.
LINKS = 12
BUILD_BEAM, BEAM = 48, 48
AUDIT, RECALL = 100, 0.98
#: Nodes expanded per step of a search, queries searched together.
WIDE, TOGETHER = 3, 512
FIRST = 256


def select(sims: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Of candidates (ordered by falling similarity, -1 for none) at most ``most`` links per row, -1 for none.

    A candidate is picked if no picked one is nearer to it than the node itself; gaps are filled with the nearest others.
    """
    rows, wide = ids.shape
    there = ids >= 0
    own = vectors[np.maximum(ids, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    picked = np.zeros((rows, wide), dtype=bool)
    blocked = ~there
    for j in range(wide):
        take = ~blocked[:, j] & (picked.sum(axis=1) < most)
        picked[:, j] = take
        blocked |= take[:, None] & (between[:, j, :] > sims)
    # Picked ones first, then the nearest of the rest.
    order = np.argsort(np.where(picked, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, dtype=np.int32)
    out[:, :order.shape[1]] = np.take_along_axis(np.where(there, ids, -1), order, axis=1)
    return out


def search(vectors: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the beams of all queries, ordered by falling similarity; -1 for none."""
    n = len(queries)
    ids = np.full((n, beam), -1, dtype=np.int32)
    sims = np.full((n, beam), -np.inf, dtype=np.float32)
    ids[:, 0] = entries
    sims[:, 0] = np.einsum("qd,qd->q", queries, vectors[entries])
    done = np.zeros((n, beam), dtype=bool)
    seen = np.zeros((n, len(vectors)), dtype=bool)
    seen[np.arange(n), entries] = True
    active = np.arange(n)
    while len(active):
        open_ = np.where(done[active] | (ids[active] < 0), -np.inf, sims[active])
        width = min(WIDE, beam)
        best = np.argpartition(-open_, width - 1, axis=1)[:, :width]
        good = np.take_along_axis(open_, best, axis=1) > -np.inf
        some = good.any(axis=1)
        active, best, good = active[some], best[some], good[some]
        if not len(active):
            break
        place = active[:, None]
        from_ = np.where(good, ids[place, best], -1)
        mark = done[place, best]
        done[place, best] = mark | good
        next_ = np.where(from_[:, :, None] >= 0, graph[np.maximum(from_, 0)], -1).reshape(len(active), -1)
        next_ = np.sort(next_, axis=1)
        fresh = next_ >= 0
        fresh[:, 1:] &= next_[:, 1:] != next_[:, :-1]
        fresh &= ~seen[place, np.maximum(next_, 0)]
        row, col = np.nonzero(fresh)
        found = next_[row, col]
        seen[active[row], found] = True
        new_sims = np.full(next_.shape, -np.inf, dtype=np.float32)
        new_sims[row, col] = np.einsum("nd,nd->n", queries[active[row]], vectors[found])
        all_sims = np.concatenate([sims[active], new_sims], axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_sims, top, axis=1)
        ids[active] = np.where(sims[active] > -np.inf, np.take_along_axis(np.concatenate([ids[active], next_], axis=1), top, axis=1), -1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(next_.shape, dtype=bool)], axis=1), top, axis=1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)


class Graph:
    """The levels over the vectors of a shard. Nodes are numbered so that those of higher levels come first."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray]) -> None:
        self.vectors, self.levels = vectors, levels

    @staticmethod
    def build(vectors: np.ndarray, marks: np.ndarray) -> tuple["Graph", np.ndarray]:
        """The graph, and the order in which it holds the vectors. ``marks`` are hashes of the nodes."""
        chance = (marks.astype(np.float64) + 1) / 2.0**64
        height = np.floor(-np.log(chance) / np.log(LINKS)).astype(int)
        order = np.lexsort((marks, -height))
        vectors, height = vectors[order].astype(np.float32), height[order]
        graph = Graph(vectors, [])
        for level in range(height.max() if len(height) else 0, -1, -1):
            graph.add_level(int((height >= level).sum()), 2 * LINKS if level == 0 else LINKS)
        return graph, order

    def descend(self, queries: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """The nearest node found on the lowest of these levels."""
        at = np.zeros(len(queries), dtype=np.int64)
        for links in levels:
            at = search(self.vectors[:len(links)], links, queries, at, 2)[0][:, 0].astype(np.int64)
        return at

    def add_level(self, size: int, most: int) -> None:
        links = np.full((size, most), -1, dtype=np.int32)
        at = 0
        while at < size:
            stop = min(size, at + (FIRST if at == 0 else min(TOGETHER, at)))
            batch = self.vectors[at:stop]
            among = batch @ batch.T
            np.fill_diagonal(among, -np.inf)
            width = min(BUILD_BEAM, stop - at)
            near = np.argpartition(-among, width - 1, axis=1)[:, :width]
            ids, sims = near + at, np.take_along_axis(among, near, axis=1)
            ids = np.where(sims > -np.inf, ids, -1)
            if at:
                below, found = search(self.vectors[:at], links[:at], batch, np.minimum(self.descend(batch, self.levels), at - 1), BUILD_BEAM)
                ids, sims = np.concatenate([ids, below], axis=1), np.concatenate([sims, found], axis=1)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
            links[at:stop] = select(sims, ids, self.vectors, most)
            self.link_back(links, at, stop)
            at = stop
        self.levels.append(links)

    def link_back(self, links: np.ndarray, at: int, stop: int) -> None:
        """Give the nodes that a batch linked to their links back; a full list is picked anew."""
        most = links.shape[1]
        row, col = np.nonzero(links[at:stop] >= 0)
        to, new = links[at + row, col], (at + row).astype(np.int32)
        order = np.argsort(to, kind="stable")
        to, new = to[order], new[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        for k in range(0, len(nodes), TOGETHER):
            part, begin, n = nodes[k:k + TOGETHER], first[k:k + TOGETHER], count[k:k + TOGETHER]
            width = int(n.max())
            own = np.full((len(part), width), -1, dtype=np.int32)
            inside = np.arange(width)[None, :] < n[:, None]
            own[inside] = new[(begin[:, None] + np.arange(width)[None, :])[inside]]
            ids = np.sort(np.concatenate([links[part], own], axis=1), axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.where(ids >= 0, np.einsum("qd,qkd->qk", self.vectors[part], self.vectors[np.maximum(ids, 0)]), -np.inf)
            order = np.argsort(-sims, axis=1, kind="stable")[:, :2 * most]
            links[part] = select(np.take_along_axis(sims, order, axis=1), np.take_along_axis(ids, order, axis=1), self.vectors, most)

    def near(self, queries: np.ndarray, entries: np.ndarray, beam: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """All (query, node) found with a similarity of about ``threshold`` or more, widening full beams."""
        rows, cols = [], []
        left = np.arange(len(queries))
        while len(left):
            if 4 * beam >= len(self.vectors):
                for k in range(0, len(left), TOGETHER):
                    r, c = np.nonzero(queries[left[k:k + TOGETHER]] @ self.vectors.T >= threshold)
                    rows.append(left[k:k + TOGETHER][r])
                    cols.append(c)
                break
            full = []
            for k in range(0, len(left), TOGETHER):
                part = left[k:k + TOGETHER]
                ids, sims = search(self.vectors, self.levels[-1], queries[part], entries[part], beam)
                wide = sims[:, -1] >= threshold
                full.append(part[wide])
                r, c = np.nonzero((sims >= threshold) & ~wide[:, None])
                rows.append(part[r])
                cols.append(ids[r, c])
            left = np.concatenate(full)
            beam *= 2
        return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.empty(0, int), np.empty(0, int))


def unit_of(given: np.ndarray) -> np.ndarray | None:
    """The vector of length 1, in doubles; none if it cannot link."""
    vector = given.astype(np.float64)
    if not len(vector) or not np.isfinite(vector).all() or not (size := np.abs(vector).max()) > 0:
        return None
    vector /= size  # neither very large nor very small numbers spoil the norm
    return vector / np.sqrt((vector * vector).sum())


def unit_rows(batches: Iterator[pa.RecordBatch], kind: type, raw: bool) -> Iterator[pa.RecordBatch]:
    """Per row its id, its length and the digest of its vector of length 1 (null if it cannot link); with ``raw`` also the numbers as given."""
    for batch in batches:
        lists = batch.column(1)
        flat, ends = lists.values.cast(pa.float64()).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()  # a null is no number
        dims, digests, given = [], [], []
        for begin, end, there in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist()):
            vector = flat[begin:end] if there else flat[:0]
            unit = unit_of(vector)
            dims.append(len(vector))
            digests.append(None if unit is None else hashlib.sha256(unit.tobytes()).digest())
            given.append(None if unit is None else vector.astype(kind).tobytes())
        columns = [batch.column(0), pa.array(dims, pa.int32()), pa.array(digests, pa.binary())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(given, pa.binary())] if raw else columns, names=["vec_id", "dim", "digest", "raw"][:4 if raw else 3])


INDEX_SQL = "dim int, name string, n int"
INDEX = pa.schema([("dim", pa.int32()), ("name", pa.string()), ("n", pa.int32())])
LEVELS = pa.schema([("level", pa.large_binary()), ("width", pa.int32())])
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("beam", pa.int32())])


def write_table(system: fs.FileSystem, path: str, batches: list[pa.RecordBatch]) -> None:
    with system.open_output_stream(path, compression=None) as out, pa.ipc.new_file(out, batches[0].schema) as file:
        for batch in batches:
            file.write_batch(batch)


def build_shard(key: tuple, rows: pa.Table, folder: str, kind: type) -> pa.Table:
    """Writes the graph of a shard, its vectors in batches of ``BLOCK``; one row: the name of its files."""
    rows = rows.sort_by([("rep", "ascending"), ("digest", "ascending")])
    units = np.stack([unit_of(np.frombuffer(raw, dtype=kind)) for raw in rows.column("raw").to_pylist()])
    reps, marks = rows.column("rep").to_numpy(), rows.column("mark").to_numpy().view(np.uint64)
    graph, order = Graph.build(units, marks)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    name = uuid.uuid4().hex  # only the files of tasks that end well are named in the index
    nodes = pa.schema([("rep", pa.int64()), ("unit", pa.binary(8 * units.shape[1]))])
    parts = [order[k:k + BLOCK] for k in range(0, len(order), BLOCK)]
    write_table(system, f"{path}/{name}.nodes", [
        pa.RecordBatch.from_arrays([pa.array(reps[part]), pa.FixedSizeBinaryArray.from_buffers(nodes.field(1).type, len(part), [None, pa.py_buffer(units[part].tobytes())])], schema=nodes)
        for part in parts
    ])
    write_table(system, f"{path}/{name}.levels", [
        pa.RecordBatch.from_arrays([pa.array([links.tobytes()], pa.large_binary()), pa.array([links.shape[1]], pa.int32())], schema=LEVELS) for links in graph.levels
    ])
    return pa.table([pa.array([units.shape[1]], pa.int32()), pa.array([name]), pa.array([len(order)], pa.int32())], schema=INDEX)


def read_nodes(system: fs.FileSystem, path: str, blocks: range | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of some blocks of a shard, or of all."""
    reps, units = [], []
    with system.open_input_file(f"{path}.nodes") as file, pa.ipc.open_file(file) as nodes:
        for k in blocks or range(nodes.num_record_batches):
            batch = nodes.get_batch(k)
            reps.append(batch.column(0).to_numpy())
            units.append(np.frombuffer(batch.column(1).buffers()[1], dtype=np.float64, count=batch.num_rows * batch.schema.field(1).type.byte_width // 8).reshape(batch.num_rows, -1))
    return (np.concatenate(reps), np.concatenate(units)) if len(reps) > 1 else (reps[0], units[0])


def read_graph(system: fs.FileSystem, path: str) -> tuple[np.ndarray, np.ndarray, Graph]:
    """Ids and vectors of a shard, and its graph."""
    reps, exact = read_nodes(system, path)
    levels = []
    with system.open_input_file(f"{path}.levels") as file, pa.ipc.open_file(file) as table:
        for k in range(table.num_record_batches):
            batch = table.get_batch(k)
            levels.append(np.frombuffer(batch.column(0)[0].as_buffer(), dtype=np.int32).reshape(-1, batch.column(1)[0].as_py()))
    return reps, exact, Graph(exact.astype(np.float32), levels)


def query_shards(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Links between blocks of queries and shards (``name``, ``other``, ``block``: a shard and a block of another or the same)."""
    system, path = fs.FileSystem.from_uri(folder)
    held, shard = None, None
    for batch in batches:
        for name, other, block in zip(*(column.to_pylist() for column in batch.columns)):
            if name != held:
                shard = None  # two shards are never held at once
                held, shard = name, read_graph(system, f"{path}/{name}")
            yield from query_shard(*read_nodes(system, f"{path}/{other}", range(block, block + 1)), *shard)


def query_shard(ids: np.ndarray, wanted: np.ndarray, reps: np.ndarray, exact: np.ndarray, graph: Graph) -> Iterator[pa.RecordBatch]:
    """Links between a block of queries and a shard, each as (smaller id, larger id)."""
    single = wanted.astype(np.float32)
    low = THRESHOLD - 1e-4  # single precision finds, double precision decides
    entries = np.concatenate([graph.descend(single[k:k + TOGETHER], graph.levels[:-1]) for k in range(0, len(single), TOGETHER)])
    audit = np.flatnonzero(ids % AUDIT == 0)
    truth = [np.empty(0, dtype=np.int64)]
    for k in range(0, len(audit), TOGETHER):
        r, c = np.nonzero(single[audit[k:k + TOGETHER]] @ graph.vectors.T >= low)
        truth.append(audit[k:k + TOGETHER][r] * len(reps) + c)
    truth = np.concatenate(truth)
    beam = BEAM
    while True:
        at, node = graph.near(single, entries, beam, low)
        checked = np.isin(at, audit)
        met = np.isin(truth, at[checked] * len(reps) + node[checked]).sum()
        if met >= RECALL * len(truth) or 4 * beam >= len(reps):
            break
        beam *= 2
    for k in range(0, len(at), 1 << 16):
        i, j = at[k:k + (1 << 16)], node[k:k + (1 << 16)]
        good = (np.einsum("nd,nd->n", wanted[i], exact[j]) >= THRESHOLD) & (ids[i] != reps[j])
        a, b = ids[i[good]], reps[j[good]]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.full(len(a), beam, dtype=np.int32))], schema=PAIRS)


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per row ``vec_id``, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    given = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = np.float32 if isinstance(given.schema["embedding"].dataType.elementType, FloatType) else np.float64
    folder = as_uri(scratch_path(spark, "shards"))
    rows = written(given.mapInArrow(lambda batches: unit_rows(batches, kind, False), "vec_id bigint, dim int, digest binary"), "units")
    # Ids that repeat with different vectors stay classes of their own.
    classes = written(rows.filter("vec_id is not null and digest is not null").groupBy("digest").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"),
    ), "classes")
    per_dim = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("dim").alias("d"), F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.col("n") * F.col("dim") / SHARD_NUMBERS)).cast("int").alias("shards"),
    )
    placed = classes.join(per_dim, F.col("dim") == F.col("d")).withColumn("mark", F.xxhash64("rep")).select(
        "rep", F.col("digest").alias("of"), "mark", F.pmod("mark", "shards").cast("int").alias("shard"),
    )
    numbers = given.mapInArrow(lambda batches: unit_rows(batches, kind, True), "vec_id bigint, dim int, digest binary, raw binary")
    numbers = numbers.filter("vec_id is not null and digest is not null").groupBy("vec_id", "digest").agg(F.first("dim").alias("dim"), F.first("raw").alias("raw"))
    held = numbers.join(placed, (F.col("vec_id") == F.col("rep")) & (F.col("digest") == F.col("of"))).select("dim", "shard", "rep", "digest", "mark", "raw")
    shards = written(held.groupBy("dim", "shard").applyInArrow(lambda key, table: build_shard(key, table, folder, kind), INDEX_SQL), "graphs")
    free_shuffles(spark)
    blocks = shards.select(F.col("dim").alias("d"), F.col("name").alias("other"), F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))).alias("block"))
    asked = written(shards.join(blocks, F.col("dim") == F.col("d")).select("name", "other", "block"), "asked")
    # Dealt out by number: the rows are few and small, and each is much work.
    dealt = asked.repartition(max(1, min(TASKS, asked.count())))
    found = dealt.mapInArrow(lambda batches: query_shards(batches, folder), "a bigint, b bigint, beam int")
    links = written(found.groupBy("a", "b").agg(F.max("beam").alias("beam")), "links")
    copies = classes.groupBy("rep").agg(F.sum("copies").alias("copies"))
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    joined = components(links.select("a", "b"))
    summary = copies.join(linked, F.col("rep") == F.col("a"), "left").join(joined, F.col("rep") == F.col("node"), "left").select(
        "rep", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
    )
    of = rows.join(classes.select("digest", "rep"), "digest", "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("of"))
    return of.join(summary, F.col("of") == F.col("rep"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
