"""Similarity self-join of documents on sets of word shingles, by count vectors in R-trees.

A shingle hashes into one of some groups, so a document is a point of group counts, and the overlap of two documents is
at most the sum over groups of the smaller count. Groups grow with the document (at most four shingles each, see :func:`dims`), as counts
of many shingles differ too little to bound anything; a point of more groups folds into one of fewer by adding up.

1. Tiles. Documents of similar size divide the hash space into bands, one more than two linked
   documents can differ in elements (and some to spare for empty bands). So some band holds the same shingles in both,
   and Spark groups documents by the contents of each band: every link lies inside a tile.
2. Stars. In each tile the smallest document is compared with the others: by the bound from the counts, then
   exactly. That settles most tiles in work linear in their size, also groups of thousands of near copies.
3. Trees. A tile whose documents are not all connected by then gets an R-tree over its points, joined with itself: a
   pair of nodes is dropped if the summed minima of their upper corners cannot reach the overlap that a link needs
   at their sizes. Surviving pairs that are not connected yet are verified exactly. Tiles above ``BLOCK`` documents (or ``CELLS`` counts)
   are cut into blocks, with one tree join per pair of blocks, so that no task holds more than two blocks.

Equal sets are one document throughout; a task emits the bands of a set once, straight into the shuffle, and equal tiles once. The bands name
sets by a 64-bit hash, which only brings candidates together: sets whose hashes collide are both candidates. Links are exact up to collisions
of 64-bit hashes inside a pair of documents. Which links were found is enough for the components, all links
between members of a component that is already joined need no check.

Cases: no words (also null) give an empty set, linked with nothing. Fewer words than a shingle make one shingle of
all. A null id is linked with nothing and has a null component. Rows that repeat an id join what they link. Extra columns do not matter.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograph.llm.components import components
from lograph.llm.shingles import ODD, mix, shingle_sets
from lograph.session import free_shuffles, scratch_scope, written


class Rule(NamedTuple):
    """Shingles of ``width`` words; a link: ``part * intersection >= share * union``."""

    width: int
    share: int
    part: int


#: The contract of the operator, and what other uses take.
OPERATOR, STAGE = Rule(4, 85, 100), Rule(5, 80, 100)
#: Fewest and most groups of a document; points per leaf.
DIMS, MOST_DIMS, LEAF = 256, 1 << 14, 16
#: The most that a group counts; a document with more in one has more groups.
BYTE = 127
#: Groups of a coarse point, by which pairs are bounded first: most pairs of a tile that do not link share less than that allows.
COARSE = 64
#: Documents and counts per block of a large tile.
BLOCK, CELLS = 4096, 1 << 22
#: Sizes of a class span this factor.
SPREAD = 1.6
#: Bands sent on at once by a task; members of a tile in one row (a larger tile has several); tiles whose marks a task holds.
SENT, CHUNK, MARKS = 1 << 18, 1 << 12, 1 << 18
SETS = "doc_id bigint, n int, hi bigint, lo bigint, sid bigint, counts array<tinyint>, coarse array<int>"
BANDS = "key bigint, sid bigint"
TILES = "key bigint, members array<bigint>, size bigint, low bigint, high bigint, s1 bigint, s2 bigint"


def edges() -> list[int]:
    """Smallest size of each class."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * SPREAD)))
    return out


EDGES = edges()


def differing(total: int, rule: Rule = OPERATOR) -> int:
    """The most elements in which two linked sets differ whose sizes add up to ``total``."""
    return (rule.part - rule.share) * total // (rule.part + rule.share)


@lru_cache(maxsize=256)
def class_bands(kind: int, rule: Rule = OPERATOR) -> np.ndarray:
    """The upper ends (inclusive) of the bands of a class: one more than two linked documents of it can differ in, and some to spare for empty ones."""
    most = differing(2 * (EDGES[kind + 1] - 1), rule)
    spare = max(2, most // 16)
    n = most + 1 + spare
    return np.array([((k + 1) << 64) // n - 1 for k in range(n)], dtype=np.uint64)


def band_keys(shingles: np.ndarray, rule: Rule = OPERATOR) -> np.ndarray:
    """A key per band (class, band and contents) of a sorted set, for its own class and the next if partners may lie there."""
    n = len(shingles)
    kind = bisect.bisect_right(EDGES, n) - 1
    kinds = [kind]
    largest = n * rule.part // rule.share
    if bisect.bisect_right(EDGES, largest) - 1 > kind:
        kinds.append(kind + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(shingles * ODD[3] + ODD[4]), out=sums[1:])
    found = []
    for kind in kinds:
        ends = class_bands(kind, rule)
        cut = np.searchsorted(shingles, ends, side="right")
        before = np.concatenate([[0], cut[:-1]])
        own = sums[cut] - sums[before]
        place = np.arange(len(ends), dtype=np.uint64) * ODD[1] + np.full(1, kind, dtype=np.uint64) * ODD[2]
        keys = mix(mix(own + (cut - before).astype(np.uint64)) + place)
        full = cut > before
        # Of more bands that are not empty than a partner of this class can differ in, one is equal in both. Empty bands are equal in
        # unrelated documents: only sets with too few others need them, and of two such sets both send them.
        apart = differing(n + min(largest, EDGES[kind + 1] - 1), rule)
        found.append(keys[full] if full.sum() > apart else keys)
    return np.concatenate(found)


def name_of(s: np.ndarray) -> tuple[int, int, int, int]:
    """Size, two fingerprints and the name of a set."""
    hi, lo = s.sum(dtype=np.uint64), mix(s * ODD[4]).sum(dtype=np.uint64)
    sid = mix(mix(np.full(1, hi) + ODD[0]) + lo + np.uint64(len(s)))[0]
    return len(s), *(int(x) - (int(x) >> 63 << 64) for x in (hi, lo, sid))


def dims(n: int) -> int:
    """Groups of a set of ``n`` shingles: a power of two, a quarter of ``n`` or more."""
    return min(MOST_DIMS, max(DIMS, 1 << max(0, (n + 3) // 4 - 1).bit_length()))


def fold(counts: np.ndarray, size: int) -> np.ndarray:
    """Counts by fewer groups."""
    return counts.reshape(-1, size).sum(axis=0, dtype=np.int64) if len(counts) > size else counts


def point_of(s: np.ndarray) -> np.ndarray:
    """The group counts of a set, in bytes, as they are sent to every tile of the set."""
    size = dims(len(s))
    while True:
        found = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size)
        if found.max(initial=0) <= BYTE:
            return found.astype(np.int8)
        size *= 2


def int_lists(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))


def list_sets(batches: Iterator[pa.RecordBatch], rule: Rule = OPERATOR) -> Iterator[pa.RecordBatch]:
    """Size, fingerprints, name and group counts of the set of each document."""
    for batch in batches:
        names, counts, coarse = [], [], []
        for s in shingle_sets(batch.column(1), rule.width):
            names.append(name_of(s))
            counts.append(point_of(s))
            coarse.append(fold(counts[-1].astype(np.int32), COARSE).astype(np.int32))
        if not names:
            continue
        n, hi, lo, sid = (list(c) for c in zip(*names))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sid, pa.int64()),
            int_lists(counts), int_lists(coarse),
        ], names=["doc_id", "n", "hi", "lo", "sid", "counts", "coarse"])


def list_bands(batches: Iterator[pa.RecordBatch], rule: Rule = OPERATOR) -> Iterator[pa.RecordBatch]:
    """The bands of each set with its name, where the set is met for the first time in the task."""
    met: set[tuple[int, int, int, int]] = set()
    keys: list[np.ndarray] = []
    sids: list[np.ndarray] = []
    size = 0

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sids))], names=["key", "sid"])

    for batch in batches:
        for doc_id, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), rule.width)):
            if not len(s) or doc_id is None or (name := name_of(s)) in met:
                continue
            met.add(name)
            keys.append(band_keys(s, rule).view(np.int64))
            sids.append(np.full(len(keys[-1]), name[3]))
            size += len(keys[-1])
            if size >= SENT:
                yield sent()
                keys, sids, size = [], [], 0
    if keys:
        yield sent()


def bound_pairs(batches: Iterator[pa.RecordBatch], rule: Rule = OPERATOR) -> Iterator[pa.RecordBatch]:
    """Of pairs with the counts of both (``a``, ``b``, ``na``, ``nb``, ``ca``, ``cb``) those that the summed minima allow to link."""
    for batch in batches:
        sizes = batch.column(2).to_numpy().astype(np.int64) + batch.column(3).to_numpy()
        bounds = np.empty(batch.num_rows, dtype=np.int64)
        flat = [np.asarray(batch.column(i).values) for i in (4, 5)]
        ends = [batch.column(i).offsets.to_numpy() for i in (4, 5)]
        for row in range(batch.num_rows):
            one, two = (values[offsets[row]:offsets[row + 1]] for values, offsets in zip(flat, ends))
            size = min(len(one), len(two))
            bounds[row] = np.minimum(fold(one, size), fold(two, size)).sum(dtype=np.int64)
        yield batch.select([0, 1]).filter(pa.array(may_link(bounds, sizes, rule)))


def check_pairs(batches: Iterator[pa.RecordBatch], rule: Rule = OPERATOR) -> Iterator[pa.RecordBatch]:
    """Of pairs with both texts those whose sets link."""
    for batch in batches:
        good = [
            may_link(len(np.intersect1d(x, y, assume_unique=True)), len(x) + len(y), rule)
            for x, y in zip(shingle_sets(batch.column(2), rule.width), shingle_sets(batch.column(3), rule.width))
        ]
        yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))


def member_sums(members: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the members of each stretch, which tell sets of members apart."""
    own = mix(members.view(np.uint64))
    return np.add.reduceat(own, starts).view(np.int64), np.add.reduceat(mix(own + ODD[1]), starts).view(np.int64)


def wrapped(a: int, b: int) -> int:
    """Sum of two bigints, as Spark's."""
    total = (a + b) & (1 << 64) - 1
    return total - (total >> 63 << 64)


def tile_batch(keys: list[int], members: np.ndarray, sizes: list[int], marks: list[tuple]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(members))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), lists, *(pa.array(c, pa.int64()) for c in zip(*marks))], names=["key", "members", "size", "low", "high", "s1", "s2"])


def whole_tiles(keys: np.ndarray, sids: np.ndarray, met: set[int]) -> pa.RecordBatch | None:
    """The tiles of whole keys that have several sets and that were not met before."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    if not len(starts):
        return None
    firsts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    members = sids[np.repeat(starts - firsts, sizes) + np.arange(sizes.sum())]
    columns = (sizes, members[firsts], members[firsts + sizes - 1], *member_sums(members, firsts))
    new, marks = [], []
    for i, mark in enumerate(zip(*(c.tolist() for c in columns))):
        both = (mark[3] << 64) + mark[4]  # the two sums, in one number
        if both not in met:
            if len(met) >= MARKS:
                met.clear()
            met.add(both)
            new.append(i)
            marks.append(mark)
    if not new:
        return None
    return tile_batch(keys[starts[new]].tolist(), np.concatenate([members[firsts[i]:firsts[i] + sizes[i]] for i in new]), sizes[new].tolist(), marks)


def list_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and set: keys of several sets as tiles, of tiles of the same sets in the task only the first.

    A tile is known by its size, its ends and two sums over its members. Of a tile of more than ``CHUNK`` sets the last row has them.
    """
    met: set[int] = set()
    keys, sids = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    sent: tuple[int, int, int, int] | None = None  # size, low end and sums of what is out of the tile at the front

    def part(members: np.ndarray, ends: bool) -> pa.RecordBatch:
        nonlocal sent
        size, low, *sums = sent or (0, int(members[0]), 0, 0)
        more = member_sums(members, np.zeros(1, dtype=np.int64))
        sent = (size + len(members), low, *(wrapped(a, int(b[0])) for a, b in zip(sums, more)))
        mark = (sent[0], low, int(members[-1]), *sent[2:]) if ends else (None,) * 5
        sent = None if ends else sent
        return tile_batch([int(keys[0])], members, [len(members)], [mark])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sids = np.concatenate([keys, batch.column(0).to_numpy()]), np.concatenate([sids, batch.column(1).to_numpy()])
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]))
        keys, sids = keys[fresh], sids[fresh]
        if sent and keys[-1] != keys[0]:
            end = int(np.searchsorted(keys, keys[0], side="right"))
            yield part(sids[:end], True)
            keys, sids = keys[end:], sids[end:]
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last and (found := whole_tiles(keys[:last], sids[:last], met)) is not None:
            yield found
        keys, sids = keys[last:], sids[last:]
        if len(keys) > CHUNK:
            # The newest member stays: it may come again, and the end of a tile needs one.
            yield part(sids[:-1], False)
            keys, sids = keys[-1:], sids[-1:]
    if sent:
        yield part(sids, True)
    elif len(keys) and (found := whole_tiles(keys, sids, met)) is not None:
        yield found


class Tree:
    """An R-tree over points, packed by halving at the median of the widest coordinate."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> None:
        self.high, self.low_size, self.high_size = counts[rows].max(axis=0), sizes[rows].min(), sizes[rows].max()
        self.rows, self.parts = rows, ()
        if len(rows) > LEAF:
            spread = self.high - counts[rows].min(axis=0)
            wide = int(spread.argmax())
            by = sizes[rows] if self.high_size - self.low_size > spread[wide] else counts[rows, wide]
            order = rows[np.argsort(by, kind="stable")]
            half = len(order) // 2
            self.parts = (Tree(counts, sizes, order[:half]), Tree(counts, sizes, order[half:]))


def may_link(bound: np.ndarray | int, sizes: np.ndarray | int, rule: Rule = OPERATOR) -> np.ndarray | bool:
    """Whether an overlap of ``bound`` can make a link at this sum of sizes."""
    return bound * (rule.part + rule.share) >= rule.share * sizes


def tree_join(counts: np.ndarray, sizes: np.ndarray, left: Tree, right: Tree, rule: Rule = OPERATOR) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows whose summed minima allow a link; with ``left is right`` each pair once."""
    open_ = [(left, right)]
    while open_:
        a, b = open_.pop()
        if rule.share * a.low_size > rule.part * b.high_size or rule.share * b.low_size > rule.part * a.high_size:
            continue
        if not may_link(np.minimum(a.high, b.high).sum(), a.low_size + b.low_size, rule):
            continue
        if a.parts and (a is b or len(a.rows) >= len(b.rows) or not b.parts):
            if a is b:
                open_ += [(a.parts[0], a.parts[0]), (a.parts[0], a.parts[1]), (a.parts[1], a.parts[1])]
            else:
                open_ += [(p, b) for p in a.parts]
        elif b.parts:
            open_ += [(a, p) for p in b.parts]
        else:
            bound = np.minimum(counts[a.rows][:, None, :], counts[b.rows][None, :, :]).sum(axis=2)
            good = may_link(bound, sizes[a.rows][:, None] + sizes[b.rows][None, :], rule)
            if a is b:
                good = np.triu(good, 1)
            i, j = np.nonzero(good)
            yield a.rows[i], b.rows[j]


def join_tile(left: pa.Table, rule: Rule = OPERATOR) -> pa.Table:
    """One pair of blocks of a tile: pairs that may link and are not in one component yet."""
    kind = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    reps, sides, stars = (left.column(c).to_numpy() for c in ("rep", "side", "star"))
    sizes = left.column("n").to_numpy().astype(np.int64)
    lists = left.column("counts").combine_chunks()
    values, ends = np.asarray(lists.values), lists.offsets.to_numpy()
    size = int(np.diff(ends).min()) if len(reps) else DIMS
    counts = np.stack([fold(values[i:j].astype(np.int32), size) for i, j in zip(ends[:-1], ends[1:])]) if len(reps) else np.empty((0, size), dtype=np.int64)
    first, second = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    out_a, out_b = [], []
    if len(first):
        tree = Tree(counts, sizes, first)
        other = Tree(counts, sizes, second) if len(second) else tree
        for i, j in tree_join(counts, sizes, tree, other, rule):
            apart = stars[i] != stars[j]
            out_a.append(reps[i[apart]])
            out_b.append(reps[j[apart]])
    return pa.table([np.concatenate(out_a) if out_a else np.empty(0, np.int64), np.concatenate(out_b) if out_b else np.empty(0, np.int64)], schema=kind)


def verified(pairs: DataFrame, points: DataFrame, texts: DataFrame, rule: Rule = OPERATOR) -> DataFrame:
    """Of pairs ``a``, ``b`` those that link: bounded by their coarse counts, by all counts, then by the sets of their texts.

    Each bound leaves fewer pairs to meet the larger rows of the next. Texts meet the pairs that the bound leaves, and not the sets, which are larger and do not compress.
    """
    spark = pairs.sparkSession
    left = pairs
    with scratch_scope(spark):
        for name in ("coarse", "counts"):
            one = points.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col(name).alias("ca"))
            two = points.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col(name).alias("cb"))
            counted = left.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "ca", "cb")
            left = written(counted.mapInArrow(lambda batches: bound_pairs(batches, rule), "a bigint, b bigint").distinct(), "bounded")
        free_shuffles(spark)
        both = left.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        links = both.mapInArrow(lambda batches: check_pairs(batches, rule), "a bigint, b bigint").distinct()
        return written(links, "links", keep=True)


def tiles_of(texts: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """``key``, ``rep``, ``size`` and ``low`` (the smallest document of the tile): documents by the contents of each band."""
    spark = texts.sparkSession
    free_shuffles(spark)
    with scratch_scope(spark):
        bands = texts.mapInArrow(lambda batches: list_bands(batches, rule), BANDS)
        found = written(bands.repartition("key").sortWithinPartitions("key", "sid").mapInArrow(list_tiles, TILES), "tiles")
        # Tiles of the same documents are one.
        marks = found.filter("size is not null").groupBy("size", "low", "high", "s1", "s2").agg(F.min("key").alias("key"))
        kept = written(marks.select("key", "size"), "kept")
        members = found.join(kept.withColumnRenamed("size", "all"), "key").select("key", F.col("all").alias("size"), F.explode("members").alias("sid"))
        placed = written(members.join(classes.select("sid", "rep"), "sid").select("key", "rep", "size"), "placed")
        lows = placed.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low <> high").drop("high")
        return written(placed.join(lows, "key").select("key", "rep", "size", "low"), "tiles", keep=True)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = OPERATOR) -> DataFrame:
    """Per document ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id that its links reach."""
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sets = written(texts.mapInArrow(lambda batches: list_sets(batches, rule), SETS), "sets")
    narrow = sets.drop("counts", "coarse")
    filled = narrow.filter("n > 0 and doc_id is not null")
    classes = written(filled.groupBy("hi", "lo", "n", "sid").agg(F.min("doc_id").alias("rep")), "classes")
    member = written(filled.join(classes.drop("sid"), ["hi", "lo", "n"]).select("doc_id", "rep").distinct(), "member")
    tiles = tiles_of(texts, classes, rule)

    reps = tiles.select("rep").distinct()
    points = sets.join(reps, F.col("doc_id") == F.col("rep"), "left_semi").dropDuplicates(["doc_id", "n", "hi", "lo"])
    points = written(points.select(F.col("doc_id").alias("rep"), "n", "counts", "coarse"), "points")
    stars = tiles.filter("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct()
    links = verified(stars, points, texts, rule)
    connected = written(components(links), "connected")
    free_shuffles(texts.sparkSession)

    # Tiles that are not connected through stars: tree joins.
    starred = tiles.join(connected, F.col("rep") == F.col("node"), "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("star"))
    # A tile has documents of similar size, so the largest tells how many counts all have.
    largest = points.groupBy("rep").agg(F.max(F.size("counts")).alias("dims"))
    starred = starred.join(largest, "rep")
    apart = starred.groupBy("key").agg(F.min("star").alias("x"), F.max("star").alias("y"), F.max("dims").alias("most")).filter("x <> y and x is not null").select("key", "most")
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("size") * F.col("most") / CELLS)).cast("int")
    placed = starred.join(apart, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    placed = placed.select("key", "rep", "star", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "key", "rep", "star", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    held = placed.join(points.drop("coarse"), "rep")
    found = held.groupBy("key", "i", "j").applyInArrow(lambda tile: join_tile(tile, rule), "a bigint, b bigint")
    more = written(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = links.union(verified(more, points, texts, rule))
    joined = components(links)
    ids = member.join(joined, F.col("rep") == F.col("node"), "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    # An id with several texts joins their components.
    several = ids.groupBy("doc_id").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y")
    if not several.isEmpty():
        bridges = ids.join(several.select("doc_id"), "doc_id").select(F.col("doc_id").alias("a"), F.col("component").alias("b"))
        joined = components(links.union(bridges).union(member.select("doc_id", "rep").filter("doc_id <> rep").toDF("a", "b")))
        ids = member.select("doc_id").join(joined, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    ids = ids.groupBy("doc_id").agg(F.min("component").alias("component"))
    return narrow.join(ids.withColumnRenamed("doc_id", "of"), F.col("doc_id") == F.col("of"), "left").select(
        "doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
    )
