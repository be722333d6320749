"""Line dedup with a once-seen and a twice-seen Bloom filter.

The hashes of all line keys (8 bytes each, at most two of a kind per task) go to filter shards. A shard adds a
hash to its once-seen filter, or to its twice-seen filter if the first one has it already. The twice-seen filters,
whose size has a fixed bound, are broadcast; only lines that hit them are shuffled, as 128-bit digests, for the
exact count of documents and the choice of the occurrence that stays. False hits cost traffic, never a result.

Defined cases: a null text is one empty line. A row is a document, so repeated rows count as often as they
appear, and rows that share the largest doc_id all keep their lines; a null doc_id ranks below any other. Empty
and short lines are never dropped. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.bloom import HASHES, at_most_twice, build, hits
from meshtide.llm.shared import Scratch, arrow_map, as_bytes, bounded_batches, fewer_files, skewed_join

def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """The key of every line, None where it is too short to count. ``bytes`` methods touch ASCII only."""
    out = []
    for line in text.split(b"\n"):
        key = line.strip()
        long = len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(key.lower() if long else None)
    return out


def _hashes(min_chars: int):
    """Hashes of line keys, those of one document once."""

    def own(batches):
        for b in batches:
            for text in b["text"].to_pylist():
                keys = set(line_keys(text, min_chars))
                keys.discard(None)
                yield np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    return lambda batches: at_most_twice(own(batches))


def _suspects(shipped, min_chars: int):
    """One row per document and suspected key, as a 128-bit digest."""

    def run(batches):
        for b in batches:
            keys, rows = [], []
            for i, text in enumerate(b["text"].to_pylist()):
                own = set(line_keys(text, min_chars))
                own.discard(None)
                keys += own
                rows += [i] * len(own)
            h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
            hit = np.flatnonzero(hits(shipped.value, h))
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(keys[i]) for i in hit), "<i8").reshape(-1, 2)
            take = pa.array(np.array(rows, np.int64)[hit])
            yield {"doc_id": b["doc_id"].take(take), "same": b["same"].take(take), "k1": digest[:, 0].copy(), "k2": digest[:, 1].copy()}

    return run


def _rewrite(min_chars: int):
    """A text and the digests of the keys it loses (null: it loses none) to its kept lines and the number of those dropped."""

    @F.arrow_udf("struct<kept: binary, dropped: bigint>")
    def run(text: pa.Array, gone: pa.Array) -> pa.Array:
        texts, dropped = [], []
        for t, keys in zip(text, gone, strict=True):
            if not keys.is_valid:
                texts.append(None)
                dropped.append(0)
                continue
            lost = {(g["k1"], g["k2"]) for g in keys.as_py()}
            lines = t.as_py().split(b"\n")
            kept = [x for x, k in zip(lines, line_keys(t.as_py(), min_chars), strict=True)
                    if k is None or tuple(np.frombuffer(xxhash.xxh3_128_digest(k), "<i8").tolist()) not in lost]
            texts.append(b"\n".join(kept))
            dropped.append(len(lines) - len(kept))
        return pa.StructArray.from_arrays([pa.array(texts, pa.binary()), pa.array(dropped, pa.int64())], ["kept", "dropped"])

    return run


def dropped_keys(docs: DataFrame, scratch: Scratch, min_docs: int = 3, min_chars: int = 20, max_filter_mb: int = 256) -> DataFrame:
    """Keys that each document loses: doc_id, same (a hash of its text), gone (list of digests).

    ``max_filter_mb`` bounds the broadcast; with more keys than it holds well the filters let more lines through
    to the exact step.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("same"), as_bytes().alias("text"))
    hashes = scratch.cut(arrow_map(texts.select("text"), _hashes(min_chars), HASHES))
    repeated = spark.sparkContext.broadcast(build(hashes, twice=True, max_mb=max_filter_mb))
    scratch.drop(hashes)
    found = scratch.cut(arrow_map(texts, _suspects(repeated, min_chars), "doc_id long, same long, k1 long, k2 long"))
    counted = scratch.cut(found.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("doc_id").alias("stays")).where(F.col("n") >= min_docs), few=True)
    loses = skewed_join(found, counted, ["k1", "k2"])
    loses = loses.where(~F.col("doc_id").eqNullSafe(F.col("stays")))
    gone = scratch.cut(loses.groupBy("doc_id", "same").agg(F.collect_set(F.struct("k1", "k2")).alias("gone")), few=True)
    for table in (found, counted):
        scratch.drop(table)
    return gone


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20) -> DataFrame:
    """``docs`` with ``text`` replaced by its kept lines, n_chars (if there) renewed, plus n_lines and n_dropped.

    Input columns named n_lines or n_dropped are replaced; all others pass through.
    """
    with Scratch(docs.sparkSession) as scratch:
        gone = dropped_keys(docs, scratch, min_docs, min_chars)
        scratch.keep(gone)
    left = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64("text").alias("own"), as_bytes().alias("bytes"))
    met = F.col("doc.doc_id").eqNullSafe(gone["doc_id"]) & (F.col("own") == gone["same"])
    both = left.join(gone.hint("shuffle_hash"), met, "left")
    bounded_batches(docs.sparkSession)
    # rows stay in the JVM; Python sees the texts that lose lines, and nothing of the others
    done = both.select("doc", "bytes", _rewrite(min_chars)(F.when(F.col("gone").isNotNull(), F.col("bytes")), F.col("gone")).alias("done"))
    kept = F.coalesce("done.kept", "bytes").cast("string")
    columns = {"text": kept, "n_lines": F.size(F.split(F.col("bytes").cast("string"), "\n", -1)).cast("long"), "n_dropped": F.col("done.dropped")}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.char_length(kept).cast(docs.schema["n_chars"].dataType)
    order = docs.columns + [c for c in ("n_lines", "n_dropped") if c not in docs.columns]
    return done.select(*[columns.get(c, F.col("doc").getField(c)).alias(c) for c in order])


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    kept = dedup_lines(docs.select("doc_id", "text"))
    return fewer_files(kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")))


def brute_force(rows: list[tuple[int, str | None]], min_docs: int = 3, min_chars: int = 20) -> list[tuple]:
    """The same result by plain counting, for tests."""
    held: dict[bytes, list[int]] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for k in set(line_keys(t, min_chars)) - {None}:
            held.setdefault(k, []).append(d)
    out = []
    for d, t in texts:
        kept = [x for x, k in zip(t.split(b"\n"), line_keys(t, min_chars), strict=True)
                if k is None or len(held[k]) < min_docs or max(held[k]) == d]
        n = t.count(b"\n") + 1
        out.append((d, n, n - len(kept), hashlib.sha256(b"\n".join(kept)).hexdigest()))
    return out
