"""Hashed word and character n-grams of whole texts, for a block of documents at a time, in numpy.

Bytes of a block are one array with a separator after each document, so the work per document is a few array slices.
Features: character n-grams of CHARS lengths, words, word pairs. A word equal to the one before it is replaced by a marker before hashing, so that repetition itself is a feature and
not the word that happens to repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHARS = (3, 4)
BLOCK_BYTES = 1 << 18
K = np.uint64(0x9E3779B97F4A7C15)
MIX = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
REPEAT = np.uint64(0xA0761D6478BD642F)
SPACES = np.zeros(256, bool)
SPACES[[32, 9, 10, 11, 12, 13]] = True
POWERS = np.cumprod(np.full(64, K | np.uint64(1)))
FAR_POWERS = np.cumprod(np.full(64, MIX[1] | np.uint64(1)))


def blocks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, ends): consecutive documents, with one separator byte after each; ends exclude it."""
    values = texts.to_pylist()
    at = 0
    while at < len(values):
        to, size = at, 0
        while to < len(values) and (to == at or size + len(values[to]) < BLOCK_BYTES):
            size += len(values[to]) + 1
            to += 1
        joined = np.frombuffer(b"\n".join(values[at:to]) + b"\n", np.uint8)
        yield at, to, joined, np.cumsum([len(v) + 1 for v in values[at:to]]) - 1
        at = to


def bucket(h: np.ndarray, bits: int) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * K
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def word_hashes(joined: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word, in order, and the number of its document."""
    space = SPACES[joined]
    edge = np.diff(np.concatenate([[1], space.astype(np.int8)]))
    first, past = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    size = past - first
    inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    wide = joined[~space].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(wide * POWERS[inside & 63] * FAR_POWERS[inside >> 6 & 63], np.cumsum(size) - size)
    return h ^ size.astype(np.uint64) * MIX[0], np.searchsorted(ends, first).astype(np.int32)


def features(joined: np.ndarray, ends: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (buckets, document number ascending) that together hold every feature of every document once."""
    starts = np.concatenate([[0], ends[:-1] + 1])
    wide = joined.astype(np.uint64) + np.uint64(1)
    for n in CHARS:
        if len(wide) < n:
            continue
        count = len(wide) - n + 1
        h = np.full(count, np.uint64(n))
        for j in range(n):
            h += wide[j:j + count] * MIX[j]
        sizes = np.maximum(ends - starts - n + 1, 0)
        total = int(sizes.sum())
        doc = np.repeat(np.arange(len(ends), dtype=np.int32), sizes)
        at = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        yield bucket(h[at], bits), doc
    h, doc = word_hashes(joined, ends)
    if not len(h):
        return
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    h = np.where(again, REPEAT, h)
    yield bucket(h, bits), doc
    pair = doc[1:] == doc[:-1]
    yield bucket((h[:-1] * MIX[2] + h[1:])[pair], bits), doc[1:][pair]


def counted(joined: np.ndarray, ends: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per document: its distinct buckets and their counts."""
    found = list(features(joined, ends, bits))
    if not found:
        return [(np.zeros(0, np.int32), np.zeros(0, np.int32))] * len(ends)
    key = np.concatenate([d.astype(np.int64) << bits | b for b, d in found])
    key, n = np.unique(key, return_counts=True)
    cuts = np.searchsorted(key >> bits, np.arange(1, len(ends)))
    mask = (1 << bits) - 1
    return [((k & mask).astype(np.int32), c.astype(np.int32)) for k, c in zip(np.split(key, cuts), np.split(n, cuts), strict=True)]


def sums(joined: np.ndarray, ends: np.ndarray, bits: int, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document: the sum of ``value`` over its features, and their number."""
    total, count = np.zeros(len(ends)), np.zeros(len(ends), np.int64)
    for b, d in features(joined, ends, bits):
        total += np.bincount(d, weights=value[b], minlength=len(ends))
        count += np.bincount(d, minlength=len(ends))
    return total, count
