"""Byte-level BPE encoding and decoding from a rank file, in numpy.

Pieces (matches of the split pattern) that are tokens as they stand are looked up; the others go, grouped by length, into
padded matrices, one row a piece, one column a byte. In each round every row merges its leftmost pair of least rank: the
ranks of pairs come from a hash table, the merged columns are compacted, and only the pairs beside a merge are looked up
again. Rows without a pair to merge leave. Equal pieces are encoded once per worker, in a bounded cache. Pieces of more
than LONG bytes, rare in text, merge one at a time through a heap, as padded rounds would take quadratic time there.

Defined cases: a null or empty text has no tokens. Texts with any characters decode to their own bytes. Repeated rows
get the same result. Input columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.pieces import cut
from meshtide.llm.shared import arrow_map, per_worker

NONE = np.int32(2**31 - 1)
LONG = 2048
CACHED = 300_000
K = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing over (left id, right id); finds the rank of the joined token, NONE where there is none."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, joined = [], [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(rank)
        key = self.keys(np.array(left, np.int64), np.array(right, np.int64))
        self.bits = max(10, (2 * len(key)).bit_length() + 1)
        self.key, self.rank = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        slot, todo, value = self.slots(key), np.arange(len(key)), np.array(joined, np.int32)
        self.probes = 1
        while len(todo):
            free = self.key[slot[todo]] == 0
            at, first = np.unique(slot[todo][free], return_index=True)
            put = todo[free][first]
            self.key[at], self.rank[at] = key[put], value[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    @staticmethod
    def keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) + np.uint64(1)

    def slots(self, key: np.ndarray) -> np.ndarray:
        return ((key * K) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Elementwise over 1-d arrays."""
        key = self.keys(a, b)
        slot, out = self.slots(key), np.full(len(key), NONE, np.int32)
        todo = np.arange(len(key))
        while len(todo):
            held = self.key[slot[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (held != 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.pairs = PairTable(self.ranks)
        self.bytes_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.cache: dict[str, bytes] = {}

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of each piece, by merges."""
        out: list[np.ndarray] = [None] * len(pieces)
        size = np.array([len(p) for p in pieces])
        for lo, hi in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 32), (32, 64), (64, 256), (256, LONG)):
            rows = np.flatnonzero((size > lo) & (size <= hi))
            step = max(1, (1 << 20) // hi)
            for at in range(0, len(rows), step):
                part = rows[at:at + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], hi), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(size > LONG):
            out[i] = self.merge_long(pieces[i])
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """One padded matrix; -1 is padding."""
        out: list[np.ndarray] = [None] * len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(-1, width)
        size = np.array([len(p) for p in pieces])
        column = np.arange(width)
        ids = np.where(column < size[:, None], self.bytes_ids[flat], np.int32(-1))
        rank = np.full((len(pieces), width), NONE, np.int32)
        has = np.argwhere(column[:-1] < size[:, None] - 1)
        rank[has[:, 0], has[:, 1]] = self.pairs.find(ids[has[:, 0], has[:, 1]], ids[has[:, 0], has[:, 1] + 1])
        own = np.arange(len(pieces))
        while len(own):
            at = rank.argmin(axis=1)  # the first of equal ranks: the leftmost
            row = np.arange(len(own))
            least = rank[row, at]
            over = least == NONE
            if over.any():
                for r in np.flatnonzero(over):
                    out[own[r]] = ids[r, :size[r]].copy()
                stay = ~over
                ids, rank, size, own, at, least = ids[stay], rank[stay], size[stay], own[stay], at[stay], least[stay]
                row = np.arange(len(own))
                if not len(own):
                    break
            ids[row, at] = least
            shift = np.minimum(column + (column > at[:, None]), width - 1)
            ids, rank = np.take_along_axis(ids, shift, 1), np.take_along_axis(rank, shift, 1)
            size -= 1
            for left in (at - 1, at):
                ok = np.flatnonzero(left >= 0)
                edge = left[ok] + 1 >= size[ok]
                rank[ok[edge], left[ok[edge]]] = NONE
                ok = ok[~edge]
                rank[ok, left[ok]] = self.pairs.find(ids[ok, left[ok]], ids[ok, left[ok] + 1])
            width = int(size.max())
            ids, rank, column = ids[:, :width], rank[:, :width], column[:width]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        ids = self.bytes_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), [int(NONE)] * n
        rank[:-1] = self.pairs.find(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        one = np.zeros(1, np.int64)
        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            gone = after[i]
            ids[i], rank[gone], after[i] = r, -1, after[gone]
            if after[i] < n:
                before[after[i]] = i
            ids[gone] = -1
            for j in (before[i], i):
                if j >= 0:
                    rank[j] = int(self.pairs.find(one + ids[j], one + ids[after[j]])[0]) if after[j] < n else int(NONE)
                    if rank[j] != NONE:
                        heapq.heappush(heap, (rank[j], j))
        return np.array([x for x in ids if x >= 0], np.int32)

    def learn(self, parts: set[str]) -> None:
        """Put the ids of every part into the cache."""
        found = {p: [m.encode() for m in self.pattern.findall(p)] for p in parts}
        new = list({m for ms in found.values() for m in ms if m not in self.ranks})
        merged = dict(zip(new, (ids.astype("<u4").tobytes() for ids in self.merge(new)), strict=True))
        for p, ms in found.items():
            self.cache[p] = b"".join(merged[m] if m in merged else self.ranks[m].to_bytes(4, "little") for m in ms)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [cut(t) for t in texts]
        missing = {p for ps in parts for p in ps if p not in self.cache}
        if len(self.cache) + len(missing) > CACHED:
            self.cache.clear()
            missing = {p for ps in parts for p in ps}
        self.learn(missing)
        cache = self.cache
        return [b"".join([cache[p] for p in ps]) for ps in parts]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def codec(name: str, pattern: str) -> Codec:
    """One per worker process; ``name`` is that of a file shipped with the job."""
    return per_worker(("bpe", name, pattern), lambda: Codec(SparkFiles.get(name), pattern))


def slices(texts: list[str], chars: int = 1 << 20):
    """Consecutive runs of texts of about ``chars`` characters, at least one text each."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= chars):
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def ship(docs: DataFrame, path: str) -> str:
    """Send the vocabulary file to the executors, once; its name there."""
    context = docs.sparkSession.sparkContext
    name = path.rsplit("/", 1)[-1]
    if not any(str(f).endswith("/" + name) for f in context.listFiles):
        context.addFile(path)
    return name


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids binary: little-endian unsigned 32-bit integers)."""
    name = ship(docs, path)

    def run(batches):
        own = codec(name, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": [x for part in slices(b["text"].to_pylist()) for x in own.encode(part)]}

    return arrow_map(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run, "doc_id long, ids binary", holds=True)


def decode(ids: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded binary) of rows as ``encode`` returns them; null ids decode to no bytes, an unknown id raises."""
    name = ship(ids, path)

    def run(batches):
        own = codec(name, pattern)
        for b in batches:
            yield {"doc_id": b["doc_id"], "ids": b["ids"], "decoded": [own.decode(x or b"") for x in b["ids"].to_pylist()]}

    return arrow_map(ids.select("doc_id", "ids"), run, "doc_id long, ids binary, decoded binary", holds=True)


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes, and decodes what it encoded, in one pass."""
    name = ship(docs, path)

    def run(batches):
        own = codec(name, pattern)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            for part in slices(b["text"].to_pylist()):
                for ids in own.encode(part):
                    n.append(len(ids) // 4)
                    ids_hash.append(hashlib.sha256(ids).hexdigest())
                    text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield {"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_hash, "decoded_sha256": text_hash}

    return arrow_map(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), run,
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", holds=True)
