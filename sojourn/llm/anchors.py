"""Content-chosen anchors: positions of a text that any long repeated string shares with its copies, wherever it lies.

A text is an array of units, bytes or 64-bit hashes of words. Every window of `length` units has one anchor: the start of its leftmost k-gram of least hash. The choice depends on nothing but
the window's units, so equal windows have anchors with equal k-grams at equal offsets. Successive windows mostly share their
anchor; such a run of window starts is one entry.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sojourn.llm.common import slices

_RNG = np.random.default_rng(23)
BYTE = _RNG.integers(0, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x5851F42D4C957F2D)
BACK = np.uint64(pow(int(STEP), -1, 2**64))
MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a position in the packed (hash, position) that is minimized; longer texts are taken in overlapping pieces.
PLACE = 22
#: Units of texts that are taken side by side, so that what is computed stays in a core's cache.
TOGETHER = 1 << 16


@lru_cache(maxsize=2)
def _many_powers(base: int, n: int) -> np.ndarray:
    return _new_powers(np.uint64(base), n)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return _many_powers(int(base), TOGETHER)[:n] if n <= TOGETHER else _new_powers(base, n)


def _new_powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of the k units from each position on."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((BYTE[data] if data.dtype == np.uint8 else data) * _powers(STEP, n), out=sums[1:])
    x = (sums[k:] - sums[: n - k + 1]) * _powers(BACK, n - k + 1)
    x ^= x >> np.uint64(32)
    x *= MIX
    return x ^ (x >> np.uint64(32))


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w values in a row, by minima from both ends of blocks."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    up = np.minimum.accumulate(blocks, axis=1).ravel()
    down = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1 : n])


def runs(data: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the anchor's k-gram, anchor, first and last window start) of each run; empty for texts shorter than `length`."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    size = (1 << PLACE) - length
    hashes, anchors = [], []
    for at in range(0, n, size):
        piece = data[at : at + size + length - 1]
        h = gram_hashes(piece, k)
        packed = (h >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_minimum(packed, length - k + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        hashes.append(h[place])
        anchors.append(place + at)
    h, a = np.concatenate(hashes), np.concatenate(anchors)
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    return h[first], a[first], first, np.r_[first[1:], n] - 1



def runs_of_many(data: np.ndarray, starts: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`runs` of texts that lie end to end, with how many runs each has; starts has one place more than there are texts. No window
    crosses texts, and places are those in the own text."""
    out = []
    for i, j in slices(starts, TOGETHER):
        own, begin = data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]
        if j == i + 1 or len(own) < length:
            found = runs(own, length, k)
            out.append((*found, np.r_[len(found[0]), np.zeros(j - i - 1, np.int64)]))
            continue
        h = gram_hashes(own, k)
        packed = (h >> np.uint64(PLACE)) << np.uint64(PLACE) | np.arange(len(h), dtype=np.uint64)
        a = (sliding_minimum(packed, length - k + 1) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        new = np.ones(len(a) + 1, bool)
        np.not_equal(a[1:], a[:-1], out=new[1:-1])
        edge = np.concatenate([begin, begin[1:] - length + 1])  # windows over an edge lie in runs of their own
        new[edge[(edge >= 0) & (edge < len(a))]] = True
        first = np.flatnonzero(new)
        first, last = first[:-1], first[1:] - 1
        text = np.searchsorted(begin, first, side="right") - 1
        whole = first + length <= begin[text + 1]
        first, last, text = first[whole], last[whole], text[whole]
        a = a[first]
        out.append((h[a], a - begin[text], first - begin[text], last - begin[text], np.bincount(text, minlength=j - i)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(4)))
