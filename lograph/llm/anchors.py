"""Content-defined anchors: places in texts that depend only on the bytes around them.

Every string of ``LENGTH`` bytes has one anchor, the leftmost of its runs of ``GRAM`` bytes with the smallest hash.
Equal strings have their anchors in the same place, so strings can be compared anchor by anchor. An anchor serves a range of
strings: those that start from ``low`` to ``high``.
"""

from __future__ import annotations

import numpy as np

from lograph.llm.shingles import INVERSES, POWERS, mix

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1


def sums(text: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any run of bytes follows."""
    out = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * POWERS.first(len(text) + 1)[:-1], out=out[1:])
    return out


def run_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * INVERSES.first(len(prefix))[start] + (stop - start).astype(np.uint64))


def anchors(prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor of one text: its place, the hash of its run, and the first and last start of the strings that it serves."""
    n = len(prefix) - 1 - LENGTH + 1
    none = np.empty(0, dtype=np.int64)
    if n <= 0:
        return none, np.empty(0, dtype=np.uint64), none, none
    grams = len(prefix) - GRAM
    h = mix((prefix[GRAM:] - prefix[:grams]) * INVERSES.first(grams))
    best, width = np.arange(grams, dtype=np.int32), 1
    while 2 * width <= SPAN:
        a, b = best[:len(best) - width], best[width:]
        best = np.where(h[a] <= h[b], a, b)
        width *= 2
    a, b = best[:n], best[SPAN - width:SPAN - width + n]
    best = np.where(h[a] <= h[b], a, b)
    low = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    return best[low].astype(np.int64), h[best[low]], low, np.append(low[1:], n) - 1
