"""Substring dedup over bytes: remove what any string of LENGTH bytes that also starts elsewhere covers.

Suffixes are compared at all places, but sorted only where that decides something:

1. Window starts are cut into segments by content (``windows``). All windows of a segment share a core of
   LENGTH - STEP + 1 bytes. Core hashes go to a Bloom filter of twice-seen ones; other segments are unique.
2. Of the segments that pass, those whose whole bytes (core and both sides) repeat are removed on their own.
3. What is left are cores with differing sides. One segment for each distinct content gives its windows, as suffixes in
   which the core is replaced by its name, so only the name and the STEP - 1 bytes beside the core remain. Every task
   sorts its suffixes, front-codes the runs and sends them by range of name; a range is merged by a loser tree that
   compares two heads only beyond the prefix each is known to share with the last output. Equal neighbours are repeats.
   Equal suffixes of one task are settled there and leave once, so a passage in very many documents costs a suffix per
   task, not per document.

The size-bounded filters only let more segments through when full; names and segment contents are hashes of 64 bits each,
the bytes beside the core are compared as they are. Defined cases: a null text is empty; texts under LENGTH bytes lose
nothing; repeated rows are different documents, so a repeated text of LENGTH bytes or more goes as a whole. Input columns
other than doc_id and text are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.bloom import HASHES, at_most_twice, build, hits
from meshtide.llm.shared import Scratch, arrow_map, as_bytes, fewer_files, skewed_join
from meshtide.llm.windows import MIX, anchors, mixed, segments

LENGTH = 400
GRAM = 32
STEP = 32
CORE = LENGTH - STEP + 1
ITEM = 8 + STEP - 1
RUN = 1 << 18
NO_ID = -(2**63)
COVER = "key long, same long, a int, b int"


def cut(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments (first, last, core start) of the window starts of one text."""
    n = len(text) - GRAM + 1
    if len(text) < LENGTH:
        return segments(np.zeros(0, np.int64), STEP)
    word = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
    h = np.zeros(n, np.uint64)
    for i in range(0, GRAM, 8):
        h = (h ^ word[i:i + n]) * MIX[i // 8]
        h ^= h >> np.uint64(29)
    return segments(anchors(h * MIX[0], LENGTH - GRAM + 1), STEP)


def cores(text: bytes, start: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(text[a:a + CORE]) for a in start.tolist()), np.uint64, len(start))


def place_ids(key: int, same: int, first: np.ndarray) -> np.ndarray:
    """A hash of the place of a segment: document and first window."""
    own = np.array([key, same], np.int64).view(np.uint64)
    return mixed(mixed(own[0:1] * MIX[2] ^ own[1:2]) ^ first.astype(np.uint64) * MIX[3])


def _repeated(shipped):
    """Segments whose core may repeat."""

    def run(batches):
        for b in batches:
            out = {k: [] for k in ("core", "full", "place", "key", "same", "first", "n")}
            for key, same, text in zip(b["key"].to_pylist(), b["same"].to_pylist(), b["text"].to_pylist(), strict=True):
                first, last, start = cut(text)
                core = cores(text, start)
                hit = hits(shipped.value, core)
                if not hit.any():
                    continue
                first, last, start = first[hit], last[hit], start[hit]
                full = [xxhash.xxh3_64_intdigest(text[a:z + LENGTH], c - a) for a, z, c in zip(first.tolist(), last.tolist(), start.tolist(), strict=True)]
                for k, v in (("core", core[hit].view(np.int64)), ("full", np.array(full, np.uint64).view(np.int64)),
                             ("place", place_ids(key, same, first).view(np.int64)), ("key", np.full(len(first), key)),
                             ("same", np.full(len(first), same)), ("first", first), ("n", last - first + 1)):
                    out[k].append(v)
            yield {k: np.concatenate([np.zeros(0, np.int64), *v]) for k, v in out.items()}

    return run


def suffixes(text: bytes, core: int, first: int, last: int, start: int) -> Iterator[bytes]:
    """The windows of a segment: the name of core and distance, then the bytes before and after the core."""
    for p in range(first, last + 1):
        name = (core ^ (start - p + 1) * 0x9E3779B97F4A7C15) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        yield (name ^ name >> 32).to_bytes(8, "big") + text[p:start] + text[start + CORE:p + LENGTH]


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Sorted rows of equal length: the length each shares with the one before, and the rest of each."""
    lcp = np.zeros(len(rows), np.uint8)
    lcp[1:] = np.argmin(np.concatenate([rows[1:] == rows[:-1], np.zeros((len(rows) - 1, 1), bool)], axis=1), axis=1)
    return lcp, rows[np.arange(rows.shape[1]) >= lcp[:, None]].tobytes()


def decode(lcp: bytes, rest: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(shared with the one before, item, its number) of a front-coded run."""
    item, at = b"", 0
    for i, shared in enumerate(lcp):
        item = item[:shared] + rest[at:at + ITEM - shared]
        at += ITEM - shared
        yield shared, item, i


def merge(runs: list[Iterator[tuple[int, bytes, int]]]) -> Iterator[tuple[int, bytes, int, int]]:
    """Loser tree over sorted runs: (shared with the last output, item, run, number).

    ``known[r]`` is what the head of run r shares with the last output; of two heads the one sharing more is less, and
    only equal lengths are compared, from there on.
    """
    size = 1 << max(0, (len(runs) - 1).bit_length())
    head: list[bytes | None] = [None] * size
    number, known, loser = [0] * size, [0] * size, [0] * size

    def pull(r):
        known[r], head[r], number[r] = next(runs[r], (0, None, 0)) if r < len(runs) else (0, None, 0)

    def less(x, y):
        a, b = head[x], head[y]
        if a is None or b is None:
            return b is None and a is not None
        if known[x] != known[y]:
            return known[x] > known[y]
        c = known[x]
        while c < ITEM and a[c] == b[c]:
            c += 1
        wins = c == ITEM or a[c] < b[c]
        known[y if wins else x] = c
        return wins

    def first(node):
        if node >= size:
            return node - size
        x, y = first(2 * node), first(2 * node + 1)
        won = less(x, y)
        loser[node] = y if won else x
        return x if won else y

    for r in range(size):
        pull(r)
    top = first(1)
    while head[top] is not None:
        yield known[top], head[top], top, number[top]
        pull(top)
        node = (top + size) >> 1
        while node:
            if not less(top, loser[node]):
                top, loser[node] = loser[node], top
            node >>= 1


def _runs(shipped, parts: int):
    """Sorted, front-coded runs by range of name, and the windows that repeat within the task."""

    def run(batches):
        items, owner, place, owners = [], [], [], []

        def flush():
            order = sorted(range(len(items)), key=items.__getitem__)
            rows = np.frombuffer(b"".join([items[i] for i in order]), np.uint8).reshape(-1, ITEM)
            who, at, table = np.array(owner, np.int64)[order], np.array(place, np.int64)[order], np.array(owners, np.int64).reshape(-1, 2)
            equal = (rows[1:] == rows[:-1]).all(axis=1)
            repeats = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
            yield covers(table[who[repeats]], at[repeats])
            keep = np.concatenate([[True], ~equal])
            rows, who, at = rows[keep], who[keep], at[keep]
            part = ((rows[:, :4].copy().view(">u4").ravel().astype(np.uint64) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
            for piece in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
                lcp, rest = front_code(rows[piece])
                held, index = np.unique(who[piece], return_inverse=True)
                out = covers(np.zeros((1, 2), np.int64), np.zeros(1, np.int64))
                yield out | {"part": [int(part[piece[0]])], "lcp": [lcp.tobytes()], "rest": [rest], "owner": [index.astype("<u4").tobytes()],
                             "place": [at[piece].astype("<u4").tobytes()], "owners": [table[held].astype("<i8").tobytes()]}
            for x in (items, owner, place, owners):
                x.clear()

        for b in batches:
            for key, same, text in zip(b["key"].to_pylist(), b["same"].to_pylist(), b["text"].to_pylist(), strict=True):
                first, last, start = cut(text)
                hit = np.flatnonzero(hits(shipped.value, place_ids(key, same, first)))
                if not len(hit):
                    continue
                for s, core in zip(hit.tolist(), cores(text, start[hit]).tolist(), strict=True):
                    items.extend(suffixes(text, core, int(first[s]), int(last[s]), int(start[s])))
                    place.extend(range(int(first[s]), int(last[s]) + 1))
                owner.extend([len(owners)] * (len(items) - len(owner)))
                owners.append((key, same))
                if len(items) >= RUN:
                    yield from flush()
        if items:
            yield from flush()

    return run


def covers(owner: np.ndarray, place: np.ndarray) -> dict:
    none = [None] * len(place)
    return {"key": owner[:, 0].copy(), "same": owner[:, 1].copy(), "a": place, "b": place + LENGTH} | dict.fromkeys(("part", "lcp", "rest", "owner", "place", "owners"), none)


def _merged(batches):
    """Rows sorted by part in; the windows that repeat between runs out."""
    at, held = None, []
    for b in batches:
        names = ("part", "lcp", "rest", "owner", "place", "owners")
        for row in zip(*[b[n].to_pylist() for n in names], strict=True):
            if row[0] != at and held:
                yield _repeats(held)
                held = []
            at = row[0]
            held.append(row)
    if held:
        yield _repeats(held)


def _repeats(rows: list[tuple]) -> dict:
    owner = [np.frombuffer(r[5], "<i8").reshape(-1, 2)[np.frombuffer(r[3], "<u4")] for r in rows]
    place = [np.frombuffer(r[4], "<u4") for r in rows]
    marked: list[list[int]] = [[] for _ in rows]
    last = None
    for shared, _, r, i in merge([decode(r[1], r[2]) for r in rows]):
        if shared == ITEM:
            if last:
                marked[last[0]].append(last[1])
            marked[r].append(i)
            last = None
        else:
            last = (r, i)
    who = np.concatenate([o[m] for o, m in zip(owner, marked, strict=True)])
    where = np.concatenate([p[m] for p, m in zip(place, marked, strict=True)]).astype(np.int64)
    return {"key": who[:, 0].copy(), "same": who[:, 1].copy(), "a": where, "b": where + LENGTH}


def repeated_spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, same, spans): per text of ``texts`` (key, same, text) its repeated stretches, apart and in order."""
    spark = texts.sparkSession

    def all_cores(batches):
        return at_most_twice(cores(t, cut(t)[2]) for b in batches for t in b["text"].to_pylist())

    hashes = scratch.cut(arrow_map(texts.select("text"), all_cores, HASHES))
    seen_twice = spark.sparkContext.broadcast(build(hashes, twice=True))
    scratch.drop(hashes)
    found = scratch.cut(arrow_map(texts, _repeated(seen_twice), "core long, full long, place long, key long, same long, first int, n int"))
    contents = scratch.cut(found.groupBy("core", "full").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.first("n").alias("windows")), few=True)
    whole = skewed_join(found.select("core", "full", "key", "same", "first", F.col("n").alias("windows")), contents.where("n > 1").select("core", "full", "n"), ["core", "full"])
    whole = whole.select("key", "same", F.col("first").alias("a"), (F.col("first") + F.col("windows") - 1 + LENGTH).alias("b"))

    mixed_cores = contents.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    chosen = scratch.cut(skewed_join(contents.select("core", "place", "windows"), scratch.cut(mixed_cores, few=True), ["core"]).select(
        F.col("place").alias("h"), "windows"), few=True)
    parts = max(64, (chosen.agg(F.sum("windows")).first()[0] or 0) // 100_000)
    sides = spark.sparkContext.broadcast(build(chosen.select("h"), twice=False))
    runs = scratch.cut(arrow_map(texts, _runs(sides, parts), f"{COVER}, part int, lcp binary, rest binary, owner binary, place binary, owners binary"))
    dealt = runs.where("part is not null").drop("key", "same", "a", "b").repartition("part").sortWithinPartitions("part")
    single = arrow_map(dealt, _merged, COVER).unionByName(runs.where("part is null").select("key", "same", "a", "b"))
    spans = whole.unionByName(single).groupBy("key", "same").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return scratch.cut(arrow_map(spans, _merged_spans, "key long, same long, spans array<struct<a:int, b:int>>"), few=True)


def merge_spans(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and adjoining spans put together, in order."""
    order = np.argsort(a, kind="stable")
    a, far = a[order], np.maximum.accumulate(b[order])
    first = np.concatenate([[True], a[1:] > far[:-1]])
    return a[first], far[np.concatenate([first[1:], [True]])]


def _merged_spans(batches):
    for batch in batches:
        lists = batch["spans"]
        a, b = (lists.flatten().field(k).to_numpy() for k in range(2))
        ends = np.cumsum(lists.value_lengths().to_numpy())
        spans = [merge_spans(a[i:j], b[i:j]) for i, j in zip([0, *ends[:-1]], ends, strict=True)] if len(ends) else []
        yield {"key": batch["key"], "same": batch["same"], "spans": [[{"a": int(x), "b": int(y)} for x, y in zip(*s, strict=True)] for s in spans]}


def _removed(batches):
    for b in batches:
        out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
        for text, spans in zip(b["text"].to_pylist(), b["spans"].to_pylist(), strict=True):
            gone = [(s["a"], s["b"]) for s in spans or ()]
            kept = b"".join(text[a:z] for a, z in zip([0, *(z for _, z in gone)], [*(a for a, _ in gone), len(text)], strict=True))
            for k, v in zip(out, (len(text), len(text) - len(kept), len(gone), kept), strict=True):
                out[k].append(v)
        yield {"doc_id": b["doc_id"]} | out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary); cut anywhere, the kept bytes need not be valid UTF-8."""
    texts = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("key"), F.xxhash64("text").alias("same"), as_bytes().alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        spans = repeated_spans(texts, scratch)
        scratch.keep(spans)
    left = texts.join(spans.hint("shuffle_hash"), ["key", "same"], "left")
    return arrow_map(left.select(F.nullif("key", F.lit(NO_ID)).alias("doc_id"), "text", "spans"), _removed,
                     "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    out = remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    return fewer_files(out)


def brute_force(rows: list[tuple[int, str | None]], length: int = LENGTH) -> list[tuple]:
    """Every window in a dictionary, for tests."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    count: dict[bytes, int] = {}
    for _, t in texts:
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            count[w] = count.get(w, 0) + 1
    out = []
    for d, t in texts:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out
