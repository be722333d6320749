"""Bloom filters over 64-bit hashes, built in shards by Spark tasks and broadcast under a fixed size bound.

Hashes go to SHARDS shards; a shard's task keeps a filter of the hashes seen once and one of those seen twice, and sends
back the one asked for. A filter never misses a hash, so a caller that confirms the hits exactly loses nothing: beyond
the size bound there are only more hits to confirm.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.shared import arrow_map

SHARDS = 256
PROBES = 4
HASHES = "h long"


def bit_places(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES places of each hash in a filter of ``bits`` (a power of two), one row each."""
    step = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20) | np.uint64(1)
    return np.stack([((h >> np.uint64(8)) + np.uint64(j) * step) & np.uint64(bits - 1) for j in range(PROBES)])


def shard_of(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(SHARDS - 1)).astype(np.int32)


def at_most_twice(parts: Iterable[np.ndarray], rows: int = 1 << 20) -> Iterator[dict]:
    """Rows (h) of the hashes in ``parts``: every ``rows`` of them, each distinct one once or, if it repeats, twice."""

    def out(held):
        u, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
        return {"h": np.concatenate([u, u[n > 1]]).view(np.int64)}

    held, size = [], 0
    for h in parts:
        held.append(h)
        size += len(h)
        if size >= rows:
            yield out(held)
            held, size = [], 0
    yield out(held)


def empty(bits: int) -> np.ndarray:
    """The packed filters of all shards, ``bits`` each, as a plain array, which can be broadcast to workers without this module."""
    return np.zeros((SHARDS, bits // 8), np.uint8)


def hits(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash is in the filter of its shard."""
    shard, hit = shard_of(h), np.ones(len(h), bool)
    for place in bit_places(h, 8 * table.shape[1]):
        hit &= (table[shard, place >> np.uint64(3)] >> (np.uint64(7) - (place & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
    return hit


def _shards(bits: int, twice: bool):
    """Rows sorted by shard in; each shard's packed filter out."""

    def run(batches):
        at, seen, again = None, None, None

        def out():
            return {"shard": [at], "bits": [zlib.compress(np.packbits(again if twice else seen).tobytes(), 1)]}

        for b in batches:
            h = b["h"].to_numpy().view(np.uint64)
            shard = shard_of(h)
            edges = np.flatnonzero(np.diff(shard)) + 1
            for part in np.split(np.arange(len(h)), edges) if len(h) else []:
                if shard[part[0]] != at:
                    if at is not None:
                        yield out()
                    at, seen, again = int(shard[part[0]]), np.zeros(bits, bool), np.zeros(bits, bool)
                u, n = np.unique(h[part], return_counts=True)
                places = bit_places(u, bits)
                again[places[:, (n > 1) | seen[places].all(axis=0)]] = True
                seen[places] = True
        if at is not None:
            yield out()

    return run


def build(hashes: DataFrame, twice: bool, max_mb: int = 256) -> np.ndarray:
    """The filter of the hashes (h), a stored table, that appear at all, or that appear twice or more."""
    wanted = max(10, int(10 * hashes.count() / SHARDS).bit_length())
    bits = 1 << min(wanted, (max_mb * 2**23 // SHARDS).bit_length() - 1)
    made = empty(bits)
    shard = F.col("h").bitwiseAND(SHARDS - 1)
    for shard, packed in arrow_map(hashes.repartition(shard).sortWithinPartitions(shard), _shards(bits, twice), "shard int, bits binary").collect():
        made[shard] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return made
