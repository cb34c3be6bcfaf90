"""Removal of repeated byte strings across documents, with suffix arrays by linear grouping.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier (in a document of smaller id, or earlier in the
same one). All strings with the same anchor content (:mod:`lograph.llm.anchors`) meet in one place:

1. A task finds the anchors of its documents. Of equal contexts (the bytes of all strings of an anchor) in the task only the
   first goes on; the others are repeats already.
2. Spark brings equal anchors together. Of equal contexts all but the first are repeats. Anchors whose contexts all
   agree are settled.
3. Where contexts of an anchor differ, their strings are compared through a suffix array over these contexts. Of each context only
   as many bytes on either side take part as some other context of the anchor shares; if those and the anchor are shorter than a string, nothing in it
   repeats and it stays out. The anchor and what all contexts share around it are one symbol. Suffixes are grouped by Lyndon prefixes from the largest group down along
   pointers to the previous smaller suffix, and then put in order group by group, without renaming. Equal strings are
   neighbours in the array.
4. An anchor with more than ``HOT`` different contexts is not held in one task: its strings are grouped by
   hash over all tasks.

Equality is that of 64-bit hashes of anchors and contexts, and of the bytes themselves in step 3.

Cases: null and empty texts have no bytes. Rows that repeat an id and text are one document. A null id is not compared and
loses nothing. Texts are read whole. No other column matters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograph.llm.anchors import GRAM, LENGTH, anchors, run_hash, sums
from lograph.llm.shingles import as_bytes, mix
from lograph.session import written

HOT = 2_000
#: Anchors combined at once in a task; symbols of one suffix array (a group more than fills it, if it does).
TOGETHER, SYMBOLS = 1 << 20, 1 << 17
ROWS = "h bigint, ctx bigint, doc bigint, at int, low int, high int"
NAMES = ["h", "ctx", "doc", "at", "low", "high"]


def suffix_array(text: list[int]) -> list[int]:
    """The order of all suffixes of a text whose last symbol is its only smallest one.

    A group is a stretch of the array, named by where it starts; ``prev`` is the last place before a suffix
    whose group is lower. Groups are taken from the highest down: places that are ``prev`` of members rise
    above the rest of their own group, those with more members (repeats of the same prefix) higher.
    """
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, size, where, prev = [0] * n, [0] * n, [0] * n, [-1] * n
    start = 0
    for place, i in enumerate(order):
        if text[i] != text[order[start]]:
            start = place
        group[i] = start
        size[start] += 1
        where[i] = place
    end = n
    while end:
        own = group[order[end - 1]]
        members = sorted(order[own:end])
        end = own
        counts: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] > own:
                p = prev[p]
            if p >= 0 and group[p] == own:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                counts[p] = counts.get(p, 0) + 1
        if not counts:
            continue
        by_count: dict[int, list[int]] = {}
        for p, k in counts.items():
            by_count.setdefault(k, []).append(p)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for p in by_count[k]:
                from_ = group[p]
                last = size[from_] - 1
                size[from_] = last
                other, place = order[from_ + last], where[p]
                order[from_ + last], order[place] = p, other
                where[p], where[other] = from_ + last, place
                moved.setdefault(from_, []).append(p)
            for from_, those in moved.items():
                new = from_ + size[from_]
                size[new] = len(those)
                if new != from_:
                    for p in those:
                        group[p] = new
    # Each suffix met in order places those whose next smaller suffix it is.
    fill = list(range(n))
    out, placed = [-1] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for rank in range(n):
        i = out[rank] - 1
        while i >= 0 and not placed[i]:
            out[fill[group[i]]] = i
            fill[group[i]] += 1
            placed[i] = True
            i = prev[i]
    return out


def list_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of documents, one per context in the task; spans of the other occurrences have no ``h``."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        for doc, a, b in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            if doc is None or b - a < LENGTH:
                continue
            prefix = sums(data[a:b])
            at, h, low, high = anchors(prefix)
            context = run_hash(prefix, low, high + LENGTH) ^ mix((at - low).astype(np.uint64))
            held.append((h.view(np.int64), context.view(np.int64), np.full(len(at), doc), at, low, high))
            size += len(at)
            if size >= TOGETHER:
                yield combined(held)
                held, size = [], 0
    if held:
        yield combined(held)


def combined(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    h, ctx, doc, at, low, high = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((at, doc, ctx, h))
    h, ctx, doc, at, low, high = (x[order] for x in (h, ctx, doc, at, low, high))
    first = np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    again = (doc == doc[head]) & (at == at[head])  # the same place of a repeated row
    later = ~again
    spans = merged(doc[later], low[later], high[later] + LENGTH)
    return rows_of((h[first], ctx[first], doc[first], at[first], low[first], high[first]), spans)


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each document joined where they touch."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    change = np.append(True, doc[1:] != doc[:-1])
    # Documents are laid one after another, so that one running maximum serves all.
    shift = np.cumsum(change) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + shift)
    first = np.append(True, (start + shift)[1:] > reach[:-1])
    at = np.flatnonzero(first)
    return doc[at], start[at], (reach - shift)[np.append(at[1:], len(doc)) - 1]


def rows_of(kept: tuple[np.ndarray, ...], spans: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    n, m = len(kept[0]), len(spans[0])
    none = np.concatenate([np.zeros(n, dtype=bool), np.ones(m, dtype=bool)])
    # Spans go to any task: their context column is a hash of where they are.
    keys = mix(spans[0].astype(np.uint64) + np.asarray(spans[1]).astype(np.uint64)).view(np.int64)
    zero = np.zeros(m, dtype=np.int64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([kept[0], zero]), pa.int64(), mask=none), pa.array(np.concatenate([kept[1], keys]), pa.int64()),
        pa.array(np.concatenate([kept[2], spans[0]]), pa.int64()), pa.array(np.concatenate([kept[3], zero]), pa.int32(), mask=none),
        pa.array(np.concatenate([kept[4], spans[1]]), pa.int32()), pa.array(np.concatenate([kept[5], spans[2]]), pa.int32()),
    ], names=NAMES)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, context and place: spans of repeated contexts, and the firsts of anchors with several contexts."""
    rep = waiting = None  # the first of the current context; a first that has met no other context of its anchor yet
    for batch in batches:
        if not batch.num_rows:
            continue
        span = batch.column(0).is_null().to_numpy(zero_copy_only=False)
        given = tuple(batch.column(i).drop_null().to_numpy() if i in (0, 3) else batch.column(i).to_numpy()[~span] for i in range(6))
        passed = [batch.column(i).to_numpy()[span] for i in (2, 4, 5)]
        h, ctx, doc, at, low, high = (x.astype(np.int64) for x in given)
        n = len(h)
        if not n:
            yield rows_of(tuple(x[:0] for x in (h, ctx, doc, at, low, high)), merged(*passed))
            continue
        first = np.append(rep is None or (h[0], ctx[0]) != rep[:2], (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))
        head = np.maximum.accumulate(np.where(first, np.arange(n), -1))
        old = rep or (0, 0, 0, 0)
        rep_doc = np.where(head >= 0, doc[head], old[2])
        rep_at = np.where(head >= 0, at[head], old[3])
        later = (doc != rep_doc) | (at != rep_at)
        spans = merged(*(np.concatenate([x, y]) for x, y in zip(passed, (doc[later], low[later], high[later] + LENGTH))))
        rep = (h[-1], ctx[-1], rep_doc[-1], rep_at[-1])
        firsts = [x[first] for x in (h, ctx, doc, at, low, high)]
        if waiting is not None:
            firsts = [np.append(w, x) for w, x in zip(waiting[0], firsts)]
        own = firsts[0]
        if len(own):
            several = np.zeros(len(own), dtype=bool)
            equal = own[1:] == own[:-1]
            several[1:] |= equal
            several[:-1] |= equal
            several[0] |= waiting is not None and waiting[1]
            waiting = ([x[-1] for x in firsts], bool(several[-1]))
            kept = tuple(x[:-1][several[:-1]] for x in firsts)
        else:
            kept = tuple(firsts)
        yield rows_of(kept, spans)
    if waiting is not None and waiting[1]:
        yield rows_of(tuple(np.array([x]) for x in waiting[0]), tuple(np.empty(0, dtype=np.int64) for _ in range(3)))


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the contexts that a document holds."""
    for batch in batches:
        data, offsets = as_bytes(batch.column(1))
        out: list[tuple] = []
        for doc, begin, wanted in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), batch.column(2).to_pylist()):
            for w in wanted:
                out.append((w["h"], doc, w["at"], w["low"], w["high"], data[begin + w["low"]:begin + w["high"] + LENGTH].tobytes()))
        columns = list(zip(*out)) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["h", "doc", "at", "low", "high", "bytes"])


def common(a: bytes, b: bytes) -> int:
    """How many bytes two strings share at their beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high:
        middle = (low + high + 1) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def reaches(sides: list[bytes]) -> list[int]:
    """For each string the most bytes that it shares at its beginning with another one: the one before or after it in order."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    out = [0] * len(sides)
    for i, j in zip(order, order[1:]):
        n = common(sides[i], sides[j])
        out[i] = max(out[i], n)
        out[j] = n
    return out


def compare(rows: list[tuple]) -> pa.RecordBatch:
    """Spans of strings in these contexts that another context, of an earlier place, holds too. ``rows`` has whole anchors.

    A string with more bytes on one side of the anchor than any other context shares there is not repeated, and needs no symbol. What all
    contexts of an anchor have in common on both sides of it is one symbol of the suffix array's text. A string that starts inside it is
    compared from that symbol on.
    """
    text: list[int] = []
    columns: list[np.ndarray] = []
    for number, (_, group) in enumerate(groupby(rows, key=itemgetter(0))):
        contexts = list(group)
        lefts = [c[5][:c[2] - c[3]][::-1] for c in contexts]
        rights = [c[5][c[2] - c[3] + GRAM:] for c in contexts]
        sides = list(zip(reaches(lefts), reaches(rights)))
        kept = [i for i, (x, y) in enumerate(sides) if x + GRAM + y >= LENGTH]
        if len(kept) < 2:
            continue
        lefts, rights = ([side[i][:sides[i][k]] for i in kept] for k, side in enumerate((lefts, rights)))
        left, right = (common(min(x), max(x)) for x in (lefts, rights))
        for i, before_it, after_it in zip(kept, lefts, rights):
            _, doc, at, low, high, _ = contexts[i]
            place = np.arange(max(low, at - len(before_it)), min(high, at - (LENGTH - GRAM - len(after_it))) + 1)
            begin = len(text)
            text += [b + 2 for b in before_it[:left - len(before_it) - 1:-1]] if left < len(before_it) else []
            core = len(text)
            text.append(number + 258)
            text += [b + 2 for b in after_it[right:]]
            text.append(1)
            before = at - place  # bytes of the string before the anchor
            after = np.maximum(0, LENGTH - GRAM - before - right)
            outside = before > left
            columns.append(np.stack([
                np.full(len(place), number), before, np.where(outside, begin + len(before_it) - before, core),
                np.where(outside, before - left, 0) + 1 + after, np.full(len(place), doc), place,
            ]))
    if not columns:
        none = np.empty(0, dtype=np.int64)
        return rows_of((none,) * 6, (none,) * 3)
    text.append(0)
    rank = np.empty(len(text), dtype=np.int64)
    rank[suffix_array(text)] = np.arange(len(text))
    strings = np.concatenate(columns, axis=1)
    strings = strings[:, np.lexsort((rank[strings[2]], strings[1], strings[0]))]
    anchor, before, symbol, need, doc, place = strings
    width = LENGTH - GRAM + 1
    table = np.lib.stride_tricks.sliding_window_view(np.array(text + [0] * width, dtype=np.int32), width)
    equal = np.zeros(strings.shape[1], dtype=bool)
    for k in range(1, len(equal), 1 << 16):
        some, last = slice(k, min(len(equal), k + (1 << 16))), slice(k - 1, min(len(equal), k + (1 << 16)) - 1)
        same = (table[symbol[some]] == table[symbol[last]]) | (np.arange(width) >= need[some, None])
        equal[some] = same.all(axis=1) & (anchor[some] == anchor[last]) & (before[some] == before[last])
    run = np.cumsum(~equal)
    by_place = np.lexsort((place, doc, run))
    doc, place, run = doc[by_place], place[by_place], run[by_place]
    head = np.maximum.accumulate(np.where(np.append(True, run[1:] != run[:-1]), np.arange(len(run)), 0))
    gone = (doc != doc[head]) | (place != place[head])  # the same place twice is a repeated row
    return rows_of(tuple(np.empty(0, dtype=np.int64) for _ in range(6)), merged(doc[gone], place[gone], place[gone] + LENGTH))


def compare_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over whole anchors, of rows sorted by anchor."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if size >= SYMBOLS and row[0] != held[-1][0]:
                yield compare(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5]) - GRAM + 2
    if held:
        yield compare(held)


def list_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of the contexts, as a hash, with its place."""
    for batch in batches:
        hashes, docs, places = [], [], []
        for doc, low, high, content in zip(*(batch.column(n).to_pylist() for n in ("doc", "low", "high", "bytes"))):
            prefix = sums(np.frombuffer(content, dtype=np.uint8))
            begin = np.arange(high - low + 1)
            hashes.append(run_hash(prefix, begin, begin + LENGTH).view(np.int64))
            docs.append(np.full(len(begin), doc))
            places.append(begin + low)
        join = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(join(hashes)), pa.array(join(docs)), pa.array(join(places).astype(np.int32))], names=["string", "doc", "at"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc``, ``start``, ``end`` of repeated strings, in byte positions; spans may overlap. ``docs`` has ``doc_id`` and ``text``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = texts.mapInArrow(list_anchors, ROWS).repartition(F.coalesce("h", "ctx")).sortWithinPartitions("h", "ctx", "doc", "at")
    settled = written(found.mapInArrow(settle, ROWS), "settled")
    spans = settled.filter("h is null").select("doc", F.col("low").alias("start"), F.col("high").alias("end"))
    open_ = settled.filter("h is not null")
    wanted = open_.groupBy("doc").agg(F.collect_list(F.struct("h", "at", "low", "high")).alias("wanted"))
    contexts = texts.join(wanted, F.col("doc_id") == F.col("doc")).select("doc_id", "text", "wanted").mapInArrow(
        cut_contexts, "h bigint, doc bigint, at int, low int, high int, bytes binary",
    )
    contexts = written(contexts, "contexts")
    sizes = contexts.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).select(F.col("h").alias("hot"))
    sizes = written(sizes, "hot")
    few = contexts.join(sizes, F.col("h") == F.col("hot"), "left_anti").repartition("h").sortWithinPartitions("h", "doc", "at")
    compared = few.mapInArrow(compare_runs, ROWS).select("doc", F.col("low").alias("start"), F.col("high").alias("end"))
    strings = contexts.join(sizes, F.col("h") == F.col("hot"), "left_semi").mapInArrow(list_strings, "string bigint, doc bigint, at int")
    strings = written(strings, "strings")
    firsts = strings.groupBy("string").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "at")).alias("first")).filter("n > 1")
    many = strings.join(firsts.select("string", "first"), "string").filter("struct(doc, at) <> first").select(
        "doc", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"),
    )
    return written(spans.unionByName(compared).unionByName(many), "spans")


def without_repeats(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``kept``, the bytes that stay."""
    spans = repeated_spans(docs).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.select("doc_id", "text").join(spans, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = as_bytes(batch.column(1))
            spans = batch.column(2)
            sizes, removed, runs, hashes, kept = [], [], [], [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                text = data[a:b]
                gone = np.zeros(b - a + 1, dtype=np.int32)
                if spans[row].is_valid:
                    own = spans[row].values
                    np.add.at(gone, np.minimum(own.field("start").to_numpy(), b - a), 1)
                    np.add.at(gone, np.minimum(own.field("end").to_numpy(), b - a), -1)
                stay = np.cumsum(gone[:-1]) == 0
                left = text[stay].tobytes()
                sizes.append(b - a)
                removed.append(b - a - len(left))
                runs.append(int(((~stay) & np.append(True, stay[:-1])).sum()) if b > a else 0)
                hashes.append(hashlib.sha256(left).hexdigest())
                kept.append(left)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(hashes, pa.string()), pa.array(kept, pa.binary()),
            ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")
