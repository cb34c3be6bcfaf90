"""Periodic runs of words inside each document, by suffix trees.

A run is a maximal stretch of words with smallest period ``q`` that is at least ``2 q`` and ``LEAST`` words long.

1. Cut. The first and last ``length - q`` words of a run are equal, so every word of it lies in a stretch of ``GRAM``
   words that the same part of the document holds twice. Words that lie in none are cut away, and what is left is cut
   again in its own parts, until little changes. That is exact: it only takes away words that no run contains.
2. Trees. The parts are laid one after another with separators that occur once, and Ukkonen's algorithm builds the suffix tree
   of that text and of its reversal. Over the string depths along an Euler tour of a tree, the least value between two
   leaves (that of their lowest common ancestor) is how far the two suffixes agree; it takes constant time.
3. Roots. Every run holds a Lyndon word of its period that is the longest one from its place, in the order of symbols or in
   the reversed order. Those words follow from the order of the leaves (next smaller suffix, next greater suffix). Each
   is extended to both sides by the trees; it is a run if what was added is a period or more.

A document is worked on in one task, documents need no shuffle. A tree takes about half a kilobyte per word that is left after
the cut; documents are put together up to ``TOGETHER`` words, a longer one is alone.

Cases: null and empty texts have no words and no runs. Rows that repeat are worked on one by one. Only ``text`` is read here,
further columns come along.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lograph.llm.shingles import mix

LEAST, GRAM = 12, 6
#: Words of the trees that are built at once; bytes of text whose words are held at once (a longer text is alone).
TOGETHER, HELD_BYTES = 1 << 16, 1 << 22
RUN = "struct<start:bigint,length:bigint,period:bigint>"
FACTORS = mix(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)


class Tree(NamedTuple):
    """String depths along the Euler tour, where each suffix's leaf stands in it, and the rank of each suffix."""

    tour: np.ndarray
    leaf: np.ndarray
    rank: np.ndarray


def suffix_tree(text: Sequence[int]) -> Tree:
    """The suffix tree of a text of small non-negative symbols whose last one occurs once."""
    n, width = len(text), max(text) + 1
    start, end, link, suffix = array("i", [0]), array("i", [0]), array("i", [0]), array("i", [-1])
    edges: dict[int, int] = {}
    node = edge = length = waiting = 0
    for i, symbol in enumerate(text):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                edge = i
            key = node * width + text[edge]
            below = edges.get(key)
            if below is None:
                edges[key] = len(start)
                start.append(i)
                end.append(n)
                link.append(0)
                suffix.append(i - waiting + 1)
                if last:
                    link[last] = node
                    last = 0
            else:
                begin = start[below]
                reach = min(end[below], i + 1) - begin
                if length >= reach:
                    node, length, edge = below, length - reach, edge + reach
                    continue
                if text[begin + length] == symbol:
                    length += 1
                    if last:
                        link[last] = node
                    break
                middle = len(start)
                edges[key] = middle
                edges[middle * width + text[begin + length]] = below
                edges[middle * width + symbol] = middle + 1
                start.extend((begin, i))
                end.extend((begin + length, n))
                link.extend((0, 0))
                suffix.extend((-1, i - waiting + 1))
                start[below] = begin + length
                if last:
                    link[last] = middle
                last = middle
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                edge = i - waiting + 1
    return walked(n, width, edges, start, end, suffix)


def walked(n: int, width: int, edges: dict[int, int], start: array, end: array, suffix: array) -> Tree:
    keys = np.fromiter(edges.keys(), dtype=np.int64, count=len(edges))
    order = np.argsort(keys)
    children = np.fromiter(edges.values(), dtype=np.int64, count=len(edges))[order].tolist()
    bounds = np.searchsorted(keys[order] // width, np.arange(len(start) + 1)).tolist()
    at, depth = bounds[:-1], array("i", bytes(4 * len(start)))
    tour, leaf, rank = array("i"), array("i", bytes(4 * n)), array("i", bytes(4 * n))
    stack, seen = [0], 0
    while stack:
        node = stack[-1]
        tour.append(depth[node])
        place = at[node]
        if place < bounds[node + 1]:
            at[node] = place + 1
            child = children[place]
            depth[child] = depth[node] + end[child] - start[child]
            stack.append(child)
            continue
        if suffix[node] >= 0:
            leaf[suffix[node]], rank[suffix[node]] = len(tour) - 1, seen
            seen += 1
        stack.pop()
    return Tree(np.asarray(tour), np.asarray(leaf), np.asarray(rank))


class Minima:
    """Least value of any stretch of an array in constant time: blocks by a sparse table, inside them by the lowest levels of one."""

    BITS = 5

    def __init__(self, values: np.ndarray) -> None:
        size = 1 << self.BITS
        whole = np.append(values, np.full(-len(values) % size, np.iinfo(values.dtype).max, dtype=values.dtype))
        self.short = [whole]
        for k in range(self.BITS):
            low = self.short[-1]
            self.short.append(np.minimum(low, np.append(low[1 << k:], low[:1 << k])))
        blocks = whole.reshape(-1, size)
        self.before = np.minimum.accumulate(blocks, axis=1).ravel()
        self.after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.long = [blocks.min(axis=1)]
        while 2 << (len(self.long) - 1) <= len(blocks):
            low, k = self.long[-1], 1 << (len(self.long) - 1)
            self.long.append(np.minimum(low[:-k], low[k:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least value from ``a`` to ``b``, both inclusive, in either order."""
        low, high = np.minimum(a, b), np.maximum(a, b)
        out = np.empty(len(low), dtype=self.before.dtype)
        near = high - low < 1 << self.BITS
        span = np.log2(high - low + 1).astype(np.int64)
        for k in range(self.BITS + 1):
            some = near & (span == k)
            out[some] = np.minimum(self.short[k][low[some]], self.short[k][high[some] - (1 << k) + 1])
        far = ~near
        low, high = low[far], high[far]
        least = np.minimum(self.after[low], self.before[high])
        first, count = (low >> self.BITS) + 1, (high >> self.BITS) - (low >> self.BITS) - 1
        span = np.log2(np.maximum(count, 1)).astype(np.int64)
        for k in range(len(self.long)):
            some = (count > 0) & (span == k)
            inner = np.minimum(self.long[k][first[some]], self.long[k][first[some] + count[some] - (1 << k)])
            least[some] = np.minimum(least[some], inner)
        out[far] = least
        return out


def next_below(rank: Sequence[int]) -> np.ndarray:
    """For each place the next one with a smaller rank; the length where there is none."""
    n = len(rank)
    after = array("i", [n]) * n
    open_: list[int] = []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            after[open_.pop()] = i
        open_.append(i)
    return np.asarray(after)


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of at least ``LEAST`` symbols, sorted by start and period. Symbols are positive."""
    n = len(symbols)
    text = symbols.tolist()
    forward, backward = suffix_tree([*text, 0]), suffix_tree([*text[::-1], 0])
    right, left = Minima(forward.tour), Minima(backward.tour)
    found = []
    for rank in (forward.rank[:n], n - forward.rank[:n]):
        at = np.arange(n)
        period = next_below(rank.tolist()) - at
        inside = at + period < n
        at, period = at[inside], period[inside]
        more = right.between(forward.leaf[at], forward.leaf[at + period])
        # Place i of the text is place n - 1 - i of the reversal; nothing stands before the first place.
        less = np.zeros(len(at), dtype=more.dtype)
        some = at > 0
        less[some] = left.between(backward.leaf[n - at[some]], backward.leaf[n - at[some] - period[some]])
        length = less + period + more
        good = (less + more >= period) & (length >= LEAST)
        found.append(np.stack([(at - less)[good], period[good], length[good]]))
    start, period, length = np.unique(np.concatenate(found, axis=1), axis=1)
    return start, length, period


def cut(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of words that may lie in a run, and the part of the document that each is in."""
    place, part = np.arange(len(ids)), doc
    while len(place) >= LEAST:
        own = ids[place].astype(np.uint64)
        count = len(place) - GRAM + 1
        gram = mix(part[:count].astype(np.uint64) + np.uint64(1))
        for j in range(GRAM):
            gram += own[j:count + j] * FACTORS[j]
        whole = np.flatnonzero(part[:count] == part[GRAM - 1:])
        gram = mix(gram[whole])
        order = np.argsort(gram)
        equal = gram[order[1:]] == gram[order[:-1]]
        twice = np.zeros(len(whole), dtype=bool)
        twice[order[1:][equal]] = True
        twice[order[:-1][equal]] = True
        change = np.zeros(len(place) + 1, dtype=np.int32)
        np.add.at(change, whole[twice], 1)
        np.add.at(change, whole[twice] + GRAM, -1)
        held = np.cumsum(change[:-1]) > 0
        begins = held & np.append(True, ~held[:-1] | (part[1:] != part[:-1]))
        part = np.cumsum(begins)[held]
        before, place = len(place), place[held]
        large = np.bincount(part, minlength=1)[part] >= LEAST if len(part) else np.empty(0, dtype=bool)
        place, part = place[large], part[large]
        if len(place) > 0.95 * before:
            break
    return (place, part) if len(place) >= LEAST else (place[:0], part[:0])


def chunks(place: np.ndarray, part: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole parts, up to ``TOGETHER`` words each."""
    ends = np.append(np.flatnonzero(part[1:] != part[:-1]) + 1, len(part))
    begin = 0
    while begin < len(part):
        fits = ends[np.searchsorted(ends, begin + TOGETHER, side="right") - 1]
        stop = fits if fits > begin else ends[np.searchsorted(ends, begin, side="right")]
        yield place[begin:stop], part[begin:stop]
        begin = stop


def list_runs(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs of consecutive documents. ``ids`` names each word, ``doc`` (ascending) its document."""
    found: list[tuple[np.ndarray, ...]] = []
    place, part = cut(ids, doc)
    for own, parts in chunks(place, part):
        number = np.cumsum(np.append(True, parts[1:] != parts[:-1])) - 1
        _, symbols = np.unique(ids[own], return_inverse=True)
        m = int(symbols.max()) + 2
        text = np.empty(len(own) + int(number[-1]), dtype=np.int64)
        spot = np.arange(len(own)) + number
        text[spot] = symbols + 1
        ends = np.flatnonzero(np.append(number[1:] != number[:-1], False))
        text[spot[ends] + 1] = m + np.arange(len(ends))
        start, length, period = runs_of(text)
        back = np.zeros(len(text), dtype=np.int64)
        back[spot] = own
        found.append((back[start], length, period))
    if not found:
        none = np.empty(0, dtype=np.int64)
        return none, none, none
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found))


def word_lists(texts: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of consecutive texts with the number of the first text, about ``HELD_BYTES`` at once."""
    first, size, held = 0, 0, []
    for i in range(len(texts)):
        value = texts[i].as_buffer() if texts[i].is_valid else b""
        content = bytes(value) if value is not None else b""
        if held and size + len(content) > HELD_BYTES:
            yield first, held
            first, size, held = i, 0, []
        # Splitting bytes parts at space and U+0009 to U+000D, and nowhere else.
        held.append(content.split())
        size += len(content)
    if held:
        yield first, held


def runs_in(lists: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Per list of words its runs as (start, length, period), by start, then period."""
    known: dict[bytes, int] = {}
    sizes = [len(words) for words in lists]
    ids = np.fromiter((known.setdefault(w, len(known)) for words in lists for w in words), dtype=np.int64, count=sum(sizes))
    doc = np.repeat(np.arange(len(lists)), sizes)
    before = np.concatenate([[0], np.cumsum(sizes)])
    start, length, period = list_runs(ids, doc)
    out: list[list[tuple[int, int, int]]] = [[] for _ in lists]
    order = np.lexsort((period, start))
    for s, size, p in zip(start[order].tolist(), length[order].tolist(), period[order].tolist()):
        own = doc[s]
        out[own].append((s - int(before[own]), size, p))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that are in no run, or among the first ``period`` words of every run they are in."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def with_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with ``n_words``, ``runs`` (an array of start, length and period) and ``collapsed``, the text without repeated periods.

    Columns of these names are replaced.
    """
    names = [c for c in docs.columns if c not in ("n_words", "runs", "collapsed")]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for first, lists in word_lists(texts):
                runs = runs_in(lists)
                kept = [b" ".join(collapsed(words, own)) for words, own in zip(lists, runs)]
                some = batch.slice(first, len(lists))
                yield pa.RecordBatch.from_arrays([
                    *some.columns[:-1], pa.array([len(words) for words in lists], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in own] for own in runs], kind),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ], names=[*names, "n_words", "runs", "collapsed"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, F.col(text).alias("__text")).mapInArrow(find, f"{kinds}, n_words bigint, runs array<{RUN}>, collapsed string")
