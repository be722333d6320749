"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Every triplet of bytes in a window of five that holds the window's first byte (six of them) is hashed to one of BUCKETS
buckets. The digest gives each bucket's quartile among the counts in two bits, after a byte for the length on a log
scale. The difference of two digests is bounded: per bucket 0, 1, 2 or, for opposite ends, FAR; for lengths the
distance of their codes, at most LENGTHS_APART. Likeness is one less the difference over its bound.

``with_neighbour`` puts rows in one order by range partitioning and lets each task stream over its rows with the one
before at hand; only the first and last row of each partition meet in a second, small step. No text moves twice.

Defined cases: a null text is empty; an empty or very short text has all buckets in the lowest quartile, so such texts
are alike but for length. Rows of equal doc_id are ordered by text; null doc_ids come last. A single row is its own
neighbour. Input columns other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.llm.shared import Scratch, arrow_map

BUCKETS = 256
FAR = 6
LENGTHS_APART = 64
WINDOW = 5
PAIRS = [(a, b) for a in range(1, WINDOW) for b in range(a + 1, WINDOW)]
BLOCK = 1 << 20


def bucket_counts(text: bytes) -> np.ndarray:
    """Counts of the hashed triplets; long texts go by in overlapping blocks."""
    count = np.zeros(BUCKETS, np.int64)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(len(data) - WINDOW + 1, 0), BLOCK):
        x = data[at:at + BLOCK + WINDOW - 1].astype(np.uint32) + np.uint32(1)
        n = len(x) - WINDOW + 1
        for salt, (i, j) in enumerate(PAIRS):
            h = x[:n] * np.uint32(0x9E3779B1) ^ x[i:i + n] * np.uint32(0x85EBCA77) ^ (x[j:j + n] + np.uint32(salt << 8)) * np.uint32(0xC2B2AE3D)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            count += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    return count


def fingerprint(text: bytes) -> str:
    """Lowercase hex: the length's code, then BUCKETS two-bit quartiles."""
    count = bucket_counts(text)
    ranked = np.sort(count)
    cuts = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (count[:, None] > cuts).sum(axis=1).astype(np.uint8).reshape(-1, 4)
    packed = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    length = min(255, round(8 * float(np.log2(len(text) + 1))))
    return bytes([length]).hex() + packed.astype(np.uint8).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """0 to 1; 1 for equal fingerprints."""
    if a == b:
        return 1.0
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    apart = np.abs(quartiles(x[1:]).astype(int) - quartiles(y[1:]))
    score = int(np.where(apart == 3, FAR, apart).sum()) + min(LENGTHS_APART, abs(int(x[0]) - int(y[0])))
    return 1.0 - score / (FAR * BUCKETS + LENGTHS_APART)


def quartiles(packed: np.ndarray) -> np.ndarray:
    return (packed[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).ravel()


def edited(text: str, after: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


FIELDS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(doc_id: int | None, text: str, own: str, after: str, after_print: str) -> tuple:
    changed = edited(text, after).encode()
    changed_print = fingerprint(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, changed_print, likeness(own, changed_print), likeness(own, after_print)


def _stream(batches):
    """Finished rows, plus the partition's first and last text (one row, if it holds any) for ``_ends``."""
    part, first, last = TaskContext.get().partitionId(), None, None
    empty = {k: [] for k in ("part", "ends", *FIELDS)}
    for b in batches:
        out = {k: [] for k in empty}
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist(), strict=True):
            now = (doc_id, text, fingerprint(text.encode()))
            first = first or now
            if last:
                for k, v in zip(("part", "ends", *FIELDS), (part, None, *compare(last[0], last[1], last[2], now[1], now[2])), strict=True):
                    out[k].append(v)
            last = now
        yield out
    if last:
        ends = {"first_text": first[1], "first_print": first[2], "last_id": last[0], "last_text": last[1], "last_print": last[2]}
        yield {k: [None] for k in FIELDS} | {"part": [part], "ends": [ends]}


def _ends(batches):
    for b in batches:
        rows = [compare(*r) for r in zip(*[b[k].to_pylist() for k in ("last_id", "last_text", "last_print", "next_text", "next_print")], strict=True)]
        yield {k: [r[i] for r in rows] for i, k in enumerate(FIELDS)}


def compare_to_next(docs: DataFrame) -> DataFrame:
    """Per document, its fingerprint, that of its edited text, and the likenesses, by descending doc_id."""
    ends = "struct<first_text:string, first_print:string, last_id:bigint, last_text:string, last_print:string>"
    order = [F.col("doc_id").desc_nulls_last(), F.col("text").desc()]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(order[0]).sortWithinPartitions(*order)
    with Scratch(docs.sparkSession) as scratch:
        done = scratch.cut(arrow_map(ordered, _stream, f"part int, ends {ends}, {RESULT}"))
        scratch.keep(done)
    # one row per partition; the last partition's next is the first
    at = done.where("ends is not null").select("part", "ends.*")
    by_part = Window.orderBy("part")
    wrap = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = at.select("part", F.coalesce(F.lead("part").over(by_part), F.first("part").over(wrap)).alias("next"))
    after = at.select(F.col("part").alias("next"), F.col("first_text").alias("next_text"), F.col("first_print").alias("next_print"))
    joined = at.join(place, "part").join(after, "next").select("last_id", "last_text", "last_print", "next_text", "next_print")
    return done.where("ends is null").select(*FIELDS).unionByName(arrow_map(joined, _ends, RESULT))


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """In one list, for tests."""
    rows = sorted(((d, t or "") for d, t in rows), reverse=True)
    prints = [fingerprint(t.encode()) for _, t in rows]
    return [compare(d, t, prints[i], rows[(i + 1) % len(rows)][1], prints[(i + 1) % len(rows)]) for i, (d, t) in enumerate(rows)]
