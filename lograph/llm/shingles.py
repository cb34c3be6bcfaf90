"""Word shingles of many texts at once, on the bytes of Arrow columns.

Only A-Z are lower-cased and only space and U+0009 to U+000D separate words; all are single bytes in UTF-8, so
texts need no decoding. A word is hashed to 64 bits by its bytes, a shingle by its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
ODD = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
#: Texts are worked on in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * ODD[0]
    h = (h ^ (h >> np.uint64(27))) * ODD[1]
    return h ^ (h >> np.uint64(31))


class Powers:
    """Powers of a number modulo 2^64, as many as were asked for so far."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.known = base, np.ones(1, dtype=np.uint64)

    def first(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(n, self.base, dtype=np.uint64)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known[:n]


POWERS, INVERSES = Powers(BASE), Powers(INVERSE)


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins (one more for the end); null counts as empty."""
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data else np.empty(0, dtype=np.uint8), offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of consecutive texts, and how many words lie before each text's start (one more for the end)."""
    text = data[offsets[0]:offsets[-1]].copy()
    at = offsets - offsets[0]
    upper = (text >= 65) & (text <= 90)
    text[upper] |= 32
    inside = ~((text == 32) | ((text >= 9) & (text <= 13)))
    first = np.zeros(len(text) + 1, dtype=bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:-1]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:-1]
    stops = np.flatnonzero(ends) + 1
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * POWERS.first(len(text) + 1)[:-1], out=sums[1:])
    hashes = (sums[stops] - sums[starts]) * INVERSES.first(len(text) + 1)[starts]
    return mix(hashes + (stops - starts).astype(np.uint64) * ODD[2]), np.searchsorted(starts, at)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text its distinct shingles, sorted; fewer words than ``width`` make one shingle, none make none."""
    data, offsets = as_bytes(texts)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    begin = 0
    while begin < len(offsets) - 1:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + RUN_BYTES, side="right")) - 1)
        words, before = word_hashes(data, offsets[begin:end + 1])
        grams = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
        for j in range(width):
            grams += words[j:len(words) - width + 1 + j] * factors[j]
        grams = mix(grams + np.uint64(width))
        for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
            if b - a >= width:
                yield np.unique(grams[a:b - width + 1])
            elif b > a:
                own = (words[a:b] * factors[:b - a]).sum(keepdims=True)
                yield mix(own + np.uint64(b - a))
            else:
                yield np.empty(0, dtype=np.uint64)
        begin = end
