"""Byte-pair encoding and decoding with a pair occurrence index.

A task splits its texts into pieces, collects the distinct pieces that it has not seen, and encodes all of
these together: an index maps every pair of neighbouring tokens to all its positions; the ranks of the
pairs present are applied in ascending order, each at all its positions from left to right, and only the
lists of the pairs next to a merge change. A merge never makes a pair of lower rank than its own, so one
ascending pass equals encoding each piece by itself.

The tokenizer comes from a JSON file of the byte-level kind; its path is a parameter and every executor
needs the file. Texts are encoded whole, the file's added tokens inside a text count as those tokens.
Decoding maps ids to bytes, joins them and reads them as UTF-8 (bytes that are none become U+FFFD).

Cases: a null or empty text has no tokens and decodes to the empty text. Equal rows give equal rows.
Further columns come along, but for those named like a result.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Fixed value: the splitting pattern of the byte-level tokenizer family.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks kept from batch to batch in a task; when there are more, the task starts anew.
CACHE = 400_000
#: Texts encoded together hold about this many characters (one text may hold more).
TOGETHER = 8_000_000
#: In the token array: the end of a piece, and a token taken up by the one on its left.
END, GONE = -1, -2
SPAN = 1 << 20


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, others = [], 0
    for byte in range(256):
        letters.append(chr(byte) if byte in plain else chr(256 + others))
        others += byte not in plain
    return letters


class PairIndex:
    """Tokens of many pieces in one array with links to their neighbours, and the positions of every mergeable pair by rank."""

    def __init__(self, tokens: np.ndarray, keys: np.ndarray, ranks: np.ndarray) -> None:
        self.tokens, self.keys, self.ranks = tokens, keys, ranks
        self.after = np.arange(1, len(tokens) + 1, dtype=np.int32)
        self.before = np.arange(-1, len(tokens) - 1, dtype=np.int32)
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(np.arange(len(tokens) - 1, dtype=np.int32))

    def add(self, at: np.ndarray) -> None:
        """Enter the pairs that start at these positions under their ranks."""
        left, right = self.tokens[at], self.tokens[self.after[at]]
        key = left.astype(np.int64) * SPAN + right
        found = np.searchsorted(self.keys, key)
        found[found == len(self.keys)] = 0
        there = (self.keys[found] == key) & (left >= 0) & (right >= 0)
        if not there.any():
            return
        at, rank = at[there], self.ranks[found[there]]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
        for part, first in zip(np.split(at, cuts), [0, *cuts.tolist()]):
            own = int(rank[first])
            if own not in self.places:
                self.places[own] = []
                heapq.heappush(self.active, own)
            self.places[own].append(part)

    def merge_all(self, merges: list[tuple[int, int, int]]) -> None:
        """Apply the active ranks in ascending order; ``merges`` has left, right and merged token by rank."""
        tokens, after, before = self.tokens, self.after, self.before
        while self.active:
            rank = heapq.heappop(self.active)
            left, right, merged = merges[rank]
            lists = self.places.pop(rank)
            at = np.unique(np.concatenate(lists))
            at = at[(tokens[at] == left) & (tokens[after[at]] == right)]
            if left == right and len(at):
                at = self.every_other(at)
            if not len(at):
                continue
            then = after[at]
            nxt = after[then]
            tokens[at] = merged
            tokens[then] = GONE
            after[at] = nxt
            before[nxt] = at
            prev = before[at]
            self.add(np.concatenate([at, prev[prev >= 0]]))

    def every_other(self, at: np.ndarray) -> np.ndarray:
        """Of pairs of equal tokens that overlap, the first, third and so on of each run."""
        at = np.sort(at)
        follows = np.zeros(len(at), dtype=bool)
        follows[1:] = self.after[at[:-1]] == at[1:]
        place = np.arange(len(at))
        head = np.maximum.accumulate(np.where(follows, 0, place))
        return at[(place - head) % 2 == 0]


class Codec:
    """Vocabulary, merge ranks and the chunks encoded so far, in one worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        vocab = data["model"]["vocab"]
        letters = byte_letters()
        byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.start = np.array([vocab[letter] for letter in letters], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = np.array([a * SPAN + b for a, b, _ in self.merges], dtype=np.int64)
        self.ranks = np.argsort(keys)
        self.keys = keys[self.ranks]
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: content.encode() for content, i in self.added.items()}
        self.decimal = {i: str(i) for i in self.bytes_of}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        #: Encoded chunks: those at the start of a text, and those after a space.
        self.first: dict[str, tuple | None] = {}
        self.rest: dict[str, tuple | None] = {}

    def forget(self) -> None:
        self.first, self.rest = {}, {}

    def encode_pieces(self, pieces: list[str]) -> dict[str, list[int]]:
        """The ids of distinct pieces, all encoded together through one pair index."""
        if not pieces:
            return {}
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(r) for r in raw])
        ends = np.cumsum(sizes + 1)
        tokens = np.full(ends[-1], END, dtype=np.int32)
        inside = np.ones(len(tokens), dtype=bool)
        inside[ends - 1] = False
        tokens[inside] = self.start[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        index = PairIndex(tokens, self.keys, self.ranks)
        index.merge_all(self.merges)
        left = tokens[tokens != GONE]
        stops = np.flatnonzero(left == END).tolist()
        ids = left.tolist()
        return {p: ids[a:b] for p, a, b in zip(pieces, [0, *[s + 1 for s in stops]], stops)}

    def entry(self, ids: list[int]) -> tuple[str, int, bytes]:
        """What is kept of encoded ids: in decimal, their number, and the bytes they decode to."""
        return ",".join([self.decimal[i] for i in ids]), len(ids), b"".join([self.bytes_of[i] for i in ids])

    def learn(self, texts: list[str]) -> None:
        """Encode all chunks not seen before. A chunk is what lies between two spaces, with the space before it.

        A chunk after a space that is empty or starts with white space depends on its neighbours, as does one
        with an added token; these are kept as None.
        """
        if len(self.rest) + len(self.first) > CACHE:
            self.first, self.rest = {}, {}
        first, rest = set(), set()
        for text in texts:
            chunks = text.split(" ")
            first.add(chunks[0])
            rest.update(chunks[1:])
        fresh: list[tuple[dict, str, list[str]]] = []
        for seen, chunks, space in ((self.first, first, ""), (self.rest, rest, " ")):
            for chunk in chunks.difference(seen):
                if (space and (not chunk or chunk[0].isspace())) or (self.split_added and self.split_added.search(chunk)):
                    seen[chunk] = None
                else:
                    fresh.append((seen, chunk, PIECES.findall(space + chunk)))
        ids_of = self.encode_pieces(list({piece for _, _, pieces in fresh for piece in pieces}))
        for seen, chunk, pieces in fresh:
            seen[chunk] = self.entry(ids_of[pieces[0]] if len(pieces) == 1 else [i for p in pieces for i in ids_of[p]])

    def parts(self, text: str) -> list[tuple[str, int, bytes]]:
        """The encoded chunks of a text that :meth:`learn` has met; piece by piece where chunks are not independent."""
        chunks = text.split(" ")
        found = [self.first[chunks[0]], *map(self.rest.__getitem__, chunks[1:])]
        if None not in found:
            return found
        pieces: list[str | int] = []
        at = 0
        for stop in self.split_added.finditer(text) if self.split_added else []:
            pieces += [*PIECES.findall(text[at:stop.start()]), self.added[stop.group()]]
            at = stop.end()
        pieces += PIECES.findall(text[at:])
        ids_of = self.encode_pieces(list({p for p in pieces if isinstance(p, str)}))
        return [self.entry([i for p in pieces for i in ([p] if isinstance(p, int) else ids_of[p])])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def blocks(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts (null as empty) of about ``TOGETHER`` characters, each with the place of its first."""
    some: list[str] = []
    held = first = 0
    for at, text in enumerate(texts.to_pylist()):
        some.append(text or "")
        held += len(some[-1])
        if held >= TOGETHER:
            yield first, some
            some, held, first = [], 0, at + 1
    if some:
        yield first, some


def encoded(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All other columns but the text, plus ``n_tokens``, ``ids`` (decimal, joined by commas) and ``decoded`` (the text decoded from the ids)."""
    kept = [f for f in docs.schema.fields if f.name not in (text, "n_tokens", "ids", "decoded")]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.StringType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        own.forget()  # a worker lives on between tasks; what it learned must not pile up beside other work
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            for at, some in blocks(texts):
                own.learn(some)
                counts, ids, decoded = [], [], []
                for t in some:
                    parts = own.parts(t)
                    counts.append(sum([p[1] for p in parts]))
                    ids.append(",".join([p[0] for p in parts if p[1]]))
                    decoded.append(b"".join([p[2] for p in parts]).decode("utf-8", "replace"))
                part = batch.slice(at, len(some))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(part.schema.get_field_index(n)) for n in names], pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                    names=[*names, "n_tokens", "ids", "decoded"],
                )
        own.forget()

    return docs.mapInArrow(run, schema)
