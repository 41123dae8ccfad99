"""64-bit hashes of the words of many texts at once; words are runs of anything but ASCII white space."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

SLICE = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE, _INVERSE = 0x9E3779B97F4A7C55, pow(0x9E3779B97F4A7C55, -1, 1 << 64)


def ranges(texts: list[str | None], most: int = 4 * SLICE) -> list[tuple[int, int]]:
    """Index ranges of about so many characters, so that what is held for a batch does not grow with its texts' number."""
    out, begin, held = [], 0, 0
    for i, t in enumerate(texts):
        held += len(t or "") + 1
        if held >= most:
            out.append((begin, i + 1))
            begin, held = i + 1, 0
    return [*out, (begin, len(texts))] if begin < len(texts) else out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(times)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def run(base: int) -> np.ndarray:
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)])

    return run(_BASE), run(_INVERSE)


def words(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(hash, begin, end, document) of every word, positions in bytes of the joined text, and that text.

    A document's bytes begin where those before it end, plus one each. Null texts have no words.
    """
    blobs = [(t or "").encode() for t in texts]
    joined = b"\n".join(blobs)
    raw = np.frombuffer(joined, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(raw):
        to = min(len(raw), at + SLICE)
        while to < len(raw):  # on to the next white space, so that no word is cut
            space = np.flatnonzero(_SPACE[raw[to : to + SLICE]])
            if len(space):
                to += int(space[0])
                break
            to = min(len(raw), to + SLICE)
        b = raw[at:to]
        step = np.diff(np.r_[False, ~_SPACE[b], False].astype(np.int8))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if len(begin):
            size = 1 << max(20, int(len(b) + 1).bit_length())
            power, inverse = _powers(size)
            v = (_LOWER[b] if lower else b).astype(np.uint64) + np.uint64(1)
            sums = np.r_[np.uint64(0), np.cumsum(mix(v) * power[: len(b)], dtype=np.uint64)]
            h = (sums[end] - sums[begin]) * inverse[begin]
            found.append((mix(h + (end - begin).astype(np.uint64)), begin + at, end + at))
        at = to
    if not found:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), empty, empty, empty, joined
    h, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
    starts = np.cumsum([0] + [len(x) + 1 for x in blobs])[:-1]
    return h, begin, end, np.searchsorted(starts, begin, "right") - 1, joined


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
