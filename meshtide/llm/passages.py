"""Substring dedup over words: remove what any passage of WINDOW words that also starts earlier covers.

1. Windows are cut into segments by content (``windows``): all windows of a segment share an anchor of GRAM words. Anchor
   hashes go to a Bloom filter of twice-seen ones; the segments that pass are counted by their whole words.
2. Confirmed recurring passages are, first, the segments whose words occur more than once, with their first place, and
   second, for anchors with differing segments, the windows that occur in more than one of them, found by one row per
   window of one segment of each kind.
3. Documents are dealt to buckets of bounded size. A bucket gets the places of its own recurring passages that have an
   earlier first place, compiles the words there into an Aho-Corasick automaton (over word numbers of the bucket), and
   streams all its documents through it once. Every occurrence after a passage's first place goes.

So the automata are sharded by what their documents can hold, each document meets one shard, and no passage text travels.
The first place of a passage is a map-side combined minimum, so a passage in very many documents costs a row per task.

Defined cases: a null or empty text has no words; texts under WINDOW words lose nothing. Rows that share a doc_id count as
one document: a repeated row is no earlier occurrence, and null doc_ids come before all others. Words are compared as they
are in automata, and by 64-bit hashes where first places are chosen. Input columns other than doc_id and text are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshtide.llm.bloom import HASHES, at_most_twice, build, hits
from meshtide.llm.ngrams import blocks, word_hashes
from meshtide.llm.shared import Scratch, arrow_map, as_bytes, fewer_files, skewed_join
from meshtide.llm.windows import MIX, anchors, mixed

WINDOW = 20
GRAM = 8
BUCKET_WORDS = 250_000
NO_ID = -(2**63)
BASE = 0x9E3779B97F4A7C15 | 1


def cut(joined: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of all documents of a block.

    core: hash of the anchor's words; doc; first: word number in the document; n: windows; full: hash of all words;
    at: first word's number in the block; and, for ``window_hashes``, the running sums and inverse powers.
    """
    h, doc = word_hashes(joined, ends)
    n = len(h) - WINDOW + 1
    if n < 1:
        return {k: np.zeros(0, np.uint64 if k in ("core", "full") else np.int64) for k in ("core", "doc", "first", "n", "full", "at")}
    h = mixed(h)
    gram = np.zeros(len(h) - GRAM + 1, np.uint64)
    for j in range(GRAM):
        gram = (gram ^ h[j:j + len(gram)]) * MIX[j % 4]
        gram ^= gram >> np.uint64(29)
    anchor = anchors(gram, WINDOW - GRAM + 1)
    inside = doc[:n] == doc[WINDOW - 1:]
    begin = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (doc[1:n] != doc[:n - 1])]))
    last = np.concatenate([begin[1:], [n]]) - 1
    begin, last = begin[inside[begin]], last[inside[begin]]
    power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), np.uint64(BASE)))])
    inverse = np.concatenate([[np.uint64(1)], np.cumprod(np.full(len(h), np.uint64(pow(BASE, -1, 2**64))))])
    running = np.concatenate([[np.uint64(0)], np.cumsum(h * power[:-1])])
    doc_start = np.searchsorted(doc, np.arange(len(ends)))
    count = last - begin + 1
    full = mixed((running[last + WINDOW] - running[begin]) * inverse[begin] ^ count.astype(np.uint64) * MIX[2])
    return {"core": gram[anchor[begin]], "doc": doc[begin].astype(np.int64), "first": begin - doc_start[doc[begin]], "n": count, "full": full, "at": begin,
            "running": running, "inverse": inverse}


def place_ids(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    return mixed(mixed(key.view(np.uint64) * MIX[2]) ^ first.astype(np.uint64) * MIX[3])


def _cores(batches):
    return at_most_twice(cut(joined, ends)["core"] for b in batches for _, _, joined, ends in blocks(b["text"]))


def _segments(shipped):
    """Segments whose anchor may repeat."""

    def run(batches):
        for b in batches:
            keys = b["key"].to_numpy()
            for lo, hi, joined, ends in blocks(b["text"]):
                s = cut(joined, ends)
                hit = np.flatnonzero(hits(shipped.value, s["core"]))
                yield {"core": s["core"][hit].view(np.int64), "full": s["full"][hit].view(np.int64), "key": keys[lo:hi][s["doc"][hit]],
                       "first": s["first"][hit], "n": s["n"][hit]}

    return run


def _windows(shipped):
    """The windows of the chosen segments, one row each."""

    def run(batches):
        for b in batches:
            keys = b["key"].to_numpy()
            for lo, hi, joined, ends in blocks(b["text"]):
                s = cut(joined, ends)
                hit = np.flatnonzero(hits(shipped.value, place_ids(keys[lo:hi][s["doc"]], s["first"])))
                n = s["n"][hit]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(s["at"][hit], n) + step
                w = (s["running"][at + WINDOW] - s["running"][at]) * s["inverse"][at] if len(at) else np.zeros(0, np.uint64)
                yield {"core": np.repeat(s["core"][hit], n).view(np.int64), "window": w.view(np.int64), "key": keys[lo:hi][np.repeat(s["doc"][hit], n)],
                       "start": np.repeat(s["first"][hit], n) + step}

    return run


def later_passages(texts: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(key, start, words, first_key, first_start): places of recurring passages with their first place, which is earlier;
    and the number of segments in all, for sizing."""
    context = texts.sparkSession.sparkContext
    hashes = scratch.cut(arrow_map(texts.select("text"), _cores, HASHES))
    total = hashes.count()
    seen_twice = context.broadcast(build(hashes, twice=True))
    scratch.drop(hashes)
    found = scratch.cut(arrow_map(texts, _segments(seen_twice), "core long, full long, key long, first int, n int"))
    contents = scratch.cut(found.groupBy("core", "full").agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("least")), few=True)
    again = skewed_join(found.withColumnRenamed("n", "windows"), contents.where("n > 1"), ["core", "full"])
    again = again.select("key", F.col("first").alias("start"), (F.col("windows") + WINDOW - 1).alias("words"),
                         F.col("least.key").alias("first_key"), F.col("least.first").alias("first_start"))

    mixed_cores = scratch.cut(contents.groupBy("core").agg(F.count("*").alias("n")).where("n > 1"), few=True)
    chosen = skewed_join(contents.select("core", "least"), mixed_cores, ["core"]).select("least.key", "least.first")

    def hashed(batches):
        for b in batches:
            h = place_ids(b["key"].to_numpy(), b["first"].to_numpy())
            yield {"h": h.view(np.int64)}

    places = context.broadcast(build(scratch.cut(arrow_map(chosen, hashed, HASHES), few=True), twice=False))
    windows = scratch.cut(arrow_map(texts, _windows(places), "core long, window long, key long, start int"))
    firsts = scratch.cut(windows.groupBy("core", "window").agg(F.count("*").alias("n"), F.min(F.struct("key", "start")).alias("least")).where("n > 1"), few=True)
    single = skewed_join(windows, firsts, ["core", "window"]).select(
        "key", "start", F.lit(WINDOW).alias("words"), F.col("least.key").alias("first_key"), F.col("least.start").alias("first_start"))
    return again.unionByName(single).where("key > first_key or key = first_key and start > first_start"), total


def joined_places(passages: pa.Table) -> list[tuple[int, int, int, tuple[int, int]]]:
    """(key, start, words, (first_key, first_start)), each first place and length once.

    Passages of a document that overlap by all but a word, or more, and whose first places lie as they do, are one.
    """
    key, start, words, first_key, first_start = (passages[c].to_numpy() for c in ("key", "start", "words", "first_key", "first_start"))
    apart = start.astype(np.int64) - first_start
    order = np.lexsort((start, apart, first_key, key))
    key, start, words, first_key, first_start, apart = (x[order] for x in (key, start.astype(np.int64), words, first_key, first_start, apart))
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (first_key[1:] != first_key[:-1]) | (apart[1:] != apart[:-1])])[:len(key)]
    lane = np.cumsum(new) << 40
    end = np.maximum.accumulate(start + words + lane) - lane
    new[1:] |= start[1:] > end[:-1] - WINDOW + 1
    at = np.flatnonzero(new)
    size = end[np.concatenate([at[1:], [len(key)]])[:len(at)] - 1] - start[at]
    firsts = np.stack([first_key[at], first_start[at].astype(np.int64), size], axis=1)
    once = np.unique(firsts, axis=0, return_index=True)[1]
    return [(int(key[i]), int(start[i]), int(n), (int(first_key[i]), int(first_start[i]))) for i, n in zip(at[once], size[once], strict=True)]


def _stream(documents: pa.Table, passages: pa.Table) -> pa.Table:
    """One bucket: compile its passages, stream its documents."""
    import ahocorasick

    numbers: dict[bytes, int] = {}
    keys = documents["key"].to_pylist()
    words = [t.split() for t in documents["text"].to_pylist()]
    coded = [tuple([numbers.setdefault(w, len(numbers)) for w in ws]) for ws in words]
    rows_of: dict[int, list[int]] = {}
    for i, k in enumerate(keys):
        rows_of.setdefault(k, []).append(i)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, start, n, first in joined_places(passages):
        for i in rows_of[key]:  # rows of one doc_id may differ in text; a place beyond the text is another row's
            passage = coded[i][start:start + n]
            if len(passage) == n:
                automaton.add_word(passage, min((*first, n), automaton.get(passage, (*first, n))))
    compiled = len(automaton) > 0
    if compiled:
        automaton.make_automaton()
    removed, kept = [], []
    for key, ws, code in zip(keys, words, coded, strict=True):
        mark = np.zeros(len(ws) + 1, np.int64)
        if compiled and len(ws) >= WINDOW:
            for end, (first_key, first_start, n) in automaton.iter(code):
                start = end - n + 1
                if key > first_key or key == first_key and start > first_start:
                    mark[start] += 1
                    mark[end + 1] -= 1
        gone = np.cumsum(mark)[:-1] > 0
        removed.append(int(gone.sum()))
        kept.append(b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g]) if removed[-1] else b" ".join(ws))
    ids = [None if k == NO_ID else k for k in keys]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array([len(w) for w in words], pa.int64()),
                     "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.binary())})


def remove_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept binary: the kept words, joined by blanks)."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), as_bytes().alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        later, total = later_passages(texts, scratch)
        later = scratch.cut(later)
        scratch.keep(later)
    buckets = max(128, total * (WINDOW - GRAM) // 2 // BUCKET_WORDS)
    bucket = F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int").alias("bucket")
    left, right = texts.select(bucket, "key", "text"), later.select(bucket, *later.columns)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept", T.BinaryType())])
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_stream, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return fewer_files(remove_passages(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def brute_force(rows: list[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """Every window in a dictionary, for tests; a null doc_id comes first."""
    texts = [(NO_ID if d is None else d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, tuple] = {}
    for d, ws in texts:
        for p in range(len(ws) - window + 1):
            w = tuple(ws[p:p + window])
            first[w] = min(first.get(w, (d, p)), (d, p))
    out = []
    for d, ws in texts:
        gone = [False] * len(ws)
        for p in range(len(ws) - window + 1):
            if first[tuple(ws[p:p + window])] < (d, p):
                gone[p:p + window] = [True] * window
        kept = b" ".join(w for w, g in zip(ws, gone, strict=True) if not g)
        out.append((None if d == NO_ID else d, len(ws), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out
