"""Cut a sequence into segments of window starts, from content alone.

All windows of a fixed length that hold the same least gram hash (the leftmost of equals) share its place as anchor, and
equal windows have equal anchors, wherever they stand. So windows are compared only within their anchor's content, and a
table needs one row per segment instead of one per window.
"""

from __future__ import annotations

import numpy as np

LOW = np.uint64((1 << 24) - 1)
CHUNK = 1 << 22  # windows at a time; a cut here makes two segments of one, which costs a comparison only
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[1]
    return h ^ (h >> np.uint64(29))


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours: running minima from both ends of blocks of that width."""
    n = len(v)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = v
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(gram: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` gram hashes, the place of its least."""
    out = []
    for at in range(0, len(gram) - width + 1, CHUNK):
        g = gram[at:at + CHUNK + width - 1]
        v = (g & ~LOW) | np.arange(len(g), dtype=np.uint64)
        out.append((sliding_min(v, width) & LOW).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def segments(anchor: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts with one anchor and one ``step`` of distance to it: (first, last, shift).

    A window starting at p has its anchor at p + l; the shift is the least multiple of ``step`` at or below l, plus p - l.
    """
    if not len(anchor):
        none = np.zeros(0, np.int64)
        return none, none, none
    level = (anchor - np.arange(len(anchor))) // step
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1])]))
    last = np.concatenate([first[1:], [len(anchor)]]) - 1
    return first, last, anchor[first] - level[first] * step
