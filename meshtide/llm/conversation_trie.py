"""Prefix trie of conversations, by double-array tries per prefix shard.

A turn is named by 128 bits of its (role, text); only names and text lengths are shuffled. Equal rebuilt conversations are one
row with a count. Rows that share their first turns are dealt to one shard, and prefixes with more than ``limit`` distinct
conversations are split after their longest common prefix, so a shard's size has a bound however common a first turn
is. A shard numbers its turns densely, packs BASE and CHECK arrays, and walks its conversations through them to count
its nodes. Nodes at and below the depth where a prefix was split off belong to one shard and are finished there; the shared
ones above have partial counts, which are merged globally, and sums over their subtrees follow by pointer jumping.

Defined cases: rows with a null conv_id belong to no conversation. A null role or text is empty, a null turn comes first; equal
turns go by role, then by the digest of role and text, and repeated rows are turns of their own. The base of conversation c
is c - c % 100 with the remainder's sign that of c. An empty table has no node, not even a root. Other columns are ignored.
A task holds 20 bytes per turn of the longest conversation. The list of members that end at a node is hashed as a stream of
chunks, which SHA-256 makes sequential per node, in bounded memory.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.shared import Scratch, arrow_map, fewer_files, skewed_join

LIMIT = 8192  # distinct conversations below one prefix, at most, in a shard
SHARD_TURNS = 200_000  # turns of a task's shards together, about
CHUNK_BYTES = 1 << 16
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
FAMILY = 100  # conversations c - c % 100 to c share their head
HEADS = 6


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, names, sizes): every conversation after its head was replaced by its family's.

    ``names`` joins 32 hex digits per turn, ``sizes`` are the code points of the texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32)
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", role.alias("role"), name.alias("name"), F.char_length(text).alias("size")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))
    whole = whole.select("conv_id", F.transform("own", lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size"))).alias("own"))
    heads = whole.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, HEADS - 1).alias("head"))
    both = whole.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, "base", "left")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = both.withColumn("h", h).select("conv_id", F.expr(
        "concat(slice(coalesce(head, slice(own, 1, 0)), 1, h), slice(own, h + 1, size(own)))").alias("turns"))
    return both.select("conv_id", F.array_join(F.transform("turns", lambda t: t["name"]), "").alias("names"),
                       F.transform("turns", lambda t: t["size"]).alias("sizes"))


def _chunks(batches):
    """Rows sorted by (key, conv_id) in; per key, parts of its comma-joined ids, named by their first id."""
    key, ids, size = None, [], 0
    for b in batches:
        out = {"key": [], "at": [], "part": []}

        def close():
            if ids:
                out["key"].append(key)
                out["at"].append(ids[0])
                out["part"].append(",".join(map(str, ids)))

        for k, i in zip(b["key"].to_pylist(), b["conv_id"].to_pylist(), strict=True):
            if k != key or size >= CHUNK_BYTES:
                close()
                key, ids, size = k, [], 0
            ids.append(i)
            size += 20
        yield out
    yield {"key": [key], "at": [ids[0]], "part": [",".join(map(str, ids))]} if ids else {"key": [], "at": [], "part": []}


def _hashed(batches):
    """Parts sorted by (key, at) in; one digest per key out, from a stream."""
    key, sha = None, None
    for b in batches:
        keys, ends = [], []
        for k, part in zip(b["key"].to_pylist(), b["part"].to_pylist(), strict=True):
            if k != key:
                if sha is not None:
                    keys.append(key)
                    ends.append(sha.digest())
                key, sha = k, hashlib.sha256(part.encode())
            else:
                sha.update(b"," + part.encode())
        yield {"key": keys, "ends": ends}
    yield {"key": [key], "ends": [sha.digest()]} if sha is not None else {"key": [], "ends": []}


def ends(members: DataFrame) -> DataFrame:
    """(key, ends): SHA-256 of each key's conv_ids in ascending order."""
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = members.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = arrow_map(placed, _chunks, "key binary, at long, part string")
    return arrow_map(parts.repartition("key").sortWithinPartitions("key", "at"), _hashed, "key binary, ends binary")


def dealt(rows: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """Add ``cut``, the depth from which nodes belong to one shard, and ``shard``, what rows of one shard share.

    ``cut`` starts at the first turn. A prefix of more than ``limit`` rows is cut anew one turn after the longest prefix common to its
    least and greatest row, which is common to all. A row that ends before its cut has shared nodes only and a shard of its own.
    """
    prefix = F.substring(F.sha2(F.expr("substring(names, 1, 32 * cut)"), 256), 1, 32)
    left = scratch.cut(rows.withColumn("cut", F.lit(1)).withColumn("shard", prefix))
    done = None
    while True:
        short = F.char_length("names") < 32 * F.col("cut")
        groups = left.where(~short).groupBy("shard").agg(F.count("*").alias("n"), F.min("names").alias("lo"), F.max("names").alias("hi"))
        turns = "sequence(0, cast(least(length(lo), length(hi)) / 32 as int))"
        common = F.expr(f"cast(array_position(transform({turns}, i -> i < least(length(lo), length(hi)) / 32 and "
                        "substring(lo, 32 * i + 1, 32) = substring(hi, 32 * i + 1, 32)), false) as int)")
        large = scratch.cut(groups.where(F.col("n") > limit).select("shard", "n", common.alias("next")), few=True)
        closed = left.where(short).withColumn("shard", F.hex("key"))
        if large.isEmpty():
            closed = closed.unionByName(left.where(~short))
            return closed if done is None else done.unionByName(closed)
        names = large.select("shard")
        closed = closed.unionByName(left.where(~short).join(F.broadcast(names) if large.count() <= 2000 else names, "shard", "left_anti"))
        done = closed if done is None else done.unionByName(closed)
        again = skewed_join(left.where(~short), large, ["shard"]).withColumn("cut", F.col("next")).drop("n", "next")
        left = scratch.cut(again.withColumn("shard", prefix))


class DoubleArray:
    """BASE and CHECK over dense labels: the child of slot s by label c is BASE[s] + c if CHECK there is s. The root is slot 0."""

    def __init__(self):
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0], self.top, self.low = 0, 1, 1

    def _room(self, upto: int) -> None:
        if upto >= len(self.check):
            more = max(upto + 1, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first n free slots; those past the top are all free."""
        holes = np.flatnonzero(self.check[self.low:self.top] < 0)[:n] + self.low
        return np.concatenate([holes, np.arange(self.top, self.top + n - len(holes))])

    def _take(self, slots: np.ndarray, parents) -> None:
        self._room(int(slots.max()))
        self.check[slots] = parents
        self.top = max(self.top, int(slots.max()) + 1)

    def add(self, parents: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The slots of new children, rows sorted by (parent, label) that name all children of their parents."""
        first = np.flatnonzero(np.concatenate([[True], parents[1:] != parents[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(parents)]]))
        slots = np.empty(len(parents), np.int64)
        for at, size in zip(first[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            own = labels[at:at + size]
            apart = own - own[0]
            fits = self.top
            for f in self._free(16).tolist():
                inside = f + apart
                if (self.check[inside[inside < self.top]] < 0).all():
                    fits = f
                    break
            self.base[parents[at]] = fits - own[0]
            slots[at:at + size] = fits + apart
            self._take(slots[at:at + size], parents[at])
        one = first[sizes == 1]
        if len(one):
            slots[one] = self._free(len(one))
            self._take(slots[one], parents[one])
            self.base[parents[one]] = slots[one] - labels[one]
            holes = np.flatnonzero(self.check[self.low:self.top] < 0)
            self.low = int(holes[0]) + self.low if len(holes) else self.top
        return slots

    def step(self, slots: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The children by these labels, -1 where there is none."""
        to = self.base[slots] + labels
        inside = (to > 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slots), to, -1)


def dense(flat: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Numbers for the names, in order of first appearance level by level, so that siblings have numbers close together."""
    order = np.argsort(depth, kind="stable")
    _, at, inverse = np.unique(flat[order], return_index=True, return_inverse=True)
    rank = np.empty(len(at), np.int64)
    rank[np.argsort(at)] = np.arange(len(at))
    out = np.empty(len(flat), np.int64)
    out[order] = rank[inverse]
    return out


def packed(labels: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> DoubleArray:
    """The trie of the sequences ``labels[start:start + size]``."""
    trie, at = DoubleArray(), np.zeros(len(starts), np.int64)
    span = int(labels.max()) + 1 if len(labels) else 1
    for d in range(int(sizes.max()) if len(sizes) else 0):
        on = np.flatnonzero(sizes > d)
        pairs, inverse = np.unique(at[on] * span + labels[starts[on] + d], return_inverse=True)
        at[on] = trie.add(pairs // span, pairs % span)[inverse]
    return trie


NODE = ("key binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved long, size long, ends binary")


def nodes(table: pa.Table) -> pa.Table:
    """All nodes of a task's shards. Shared ones have a key, and counts of this task alone."""
    blobs = table.column("names").to_pylist()
    order = sorted(range(len(blobs)), key=blobs.__getitem__)
    table, blobs = table.take(pa.array(order)), [blobs[i] for i in order]
    sizes = np.array([len(b) // 16 for b in blobs])
    starts = np.cumsum(sizes) - sizes
    flat = np.frombuffer(b"".join(blobs), "S16")
    chars = pa.concat_arrays(table.column("sizes").chunks).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    depth_of = np.arange(len(flat)) - np.repeat(starts, sizes)
    labels = dense(flat, depth_of)
    trie = packed(labels, starts, sizes)
    weight, first, cut = (table.column(c).to_numpy().astype(np.int64) for c in ("copies", "conv_id", "cut"))

    n = trie.top
    count, least, size, shared = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64), np.zeros(n, bool)
    count[0], least[0], shared[0] = weight.sum(), first.min(), True
    levels, at, one = [np.zeros(1, np.int64)], np.zeros(len(starts), np.int64), np.zeros(n, np.int64)
    for d in range(int(sizes.max())):
        on = np.flatnonzero(sizes > d)
        to = trie.step(at[on], labels[starts[on] + d])
        at[on] = to
        np.add.at(count, to, weight[on])
        np.minimum.at(least, to, first[on])
        size[to] = chars[starts[on] + d]
        shared[to] = d + 1 < cut[on]
        one[to] = on
        levels.append(np.unique(to))
    members = np.full(n, None, object)
    members[at] = table.column("ends").to_pylist()

    kids, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for level in reversed(levels[1:]):
        own = level[~shared[level]]
        leaves[own] += kids[own] == 0
        saved[own] += (count[own] - 1) * size[own]
        up = trie.check[own]
        np.add.at(kids, up, 1)
        np.add.at(leaves, up, leaves[own])
        np.add.at(saved, up, saved[own])

    depth, keys = np.zeros(n, np.int64), {0: bytes(16)}
    for d, level in enumerate(levels):
        depth[level] = d
        for s in level[shared[level]].tolist() if d else ():
            keys[s] = xxhash.xxh3_128_digest(keys[int(trie.check[s])] + blobs[one[s]][16 * d - 16:16 * d])
    slots = np.concatenate(levels)
    up = trie.check[slots]
    inner = ~shared[up]
    return pa.table({
        "key": pa.array([keys.get(s) for s in slots.tolist()], pa.binary()),
        "parent": pa.array([None if i or s == 0 else keys[u] for s, u, i in zip(slots.tolist(), up.tolist(), inner.tolist(), strict=True)], pa.binary()),
        "conv_id": least[slots], "depth": depth[slots], "parent_conv_id": pa.array(least[up], mask=~inner), "n_convs": count[slots],
        "n_children": kids[slots], "n_leaves": leaves[slots], "saved": saved[slots], "size": size[slots],
        "ends": pa.array(members[slots].tolist(), pa.binary())})


def shared_nodes(parts: DataFrame, scratch: Scratch) -> DataFrame:
    """The shared nodes from their parts, whole: counts are added up, and sums over subtrees passed up by pointer jumping.

    After k rounds a node's sums cover its descendants at distances below 2^k, and ``to`` is its ancestor at distance 2^k.
    """
    whole = parts.groupBy("key").agg(
        F.first("parent", ignorenulls=True).alias("parent"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved").alias("saved"),
        F.max("size").alias("size"), F.max("ends").alias("ends"))
    whole = scratch.cut(whole, few=True)
    below = whole.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("more"))
    whole = whole.join(below, "key", "left").withColumn("n_children", F.col("tops") + F.coalesce("more", F.lit(0)))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    whole = scratch.cut(whole.withColumn("leaves", F.col("leaves") + leaf).withColumn("saved", F.col("saved") + (F.col("n_convs") - 1) * F.col("size")), few=True)
    sums = whole.select("key", F.col("parent").alias("to"), "leaves", "saved")
    deepest = whole.agg(F.max("depth")).first()[0] or 0
    reach = 1
    while reach <= deepest:
        up = sums.where("to is not null").groupBy(F.col("to").alias("key")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        # hop is asked by every descendant of a node: rows with their count let the crowded ones be broadcast
        asked = scratch.cut(sums.where("to is not null").select("key", "to"), few=True)
        hops = asked.groupBy("to").agg(F.count("*").alias("n")).join(sums.select(F.col("key").alias("to"), F.col("to").alias("hop")), "to")
        far = skewed_join(asked, hops, ["to"]).select("key", "hop")
        sums = sums.drop("to").join(up, "key", "left").join(far, "key", "left").select(
            "key", F.col("hop").alias("to"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"))
        sums = scratch.cut(sums, few=True)
        reach *= 2
    return scratch.cut(whole.drop("leaves", "saved").join(sums.drop("to").withColumnRenamed("leaves", "n_leaves"), "key"), few=True)


def trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    with Scratch(spark) as scratch:
        key = F.unhex(F.substring(F.sha2("names", 256), 1, 32)).alias("key")
        rows = scratch.cut(rebuilt(conversations).select(key, "conv_id", "names", "sizes"))
        distinct = rows.groupBy("key").agg(F.count("*").alias("copies"), F.min("conv_id").alias("conv_id"), F.first("names").alias("names"), F.first("sizes").alias("sizes"))
        distinct = scratch.cut(distinct.join(ends(rows.select("key", "conv_id")), "key"))
        turns = distinct.agg(F.sum(F.size("sizes"))).first()[0] or 0
        shards = F.pmod(F.xxhash64("shard"), F.lit(1 + turns // SHARD_TURNS)).alias("task")
        spread = dealt(distinct, limit, scratch).select(shards, F.unhex("names").alias("names"), "sizes", "copies", "conv_id", "cut", "ends")
        found = scratch.cut(spread.groupBy("task").applyInArrow(nodes, NODE))
        upper = shared_nodes(found.where("key is not null"), scratch)
        tops = scratch.cut(found.where("key is null and parent is not null"))
        above = upper.select(F.col("key").alias("parent"), F.col("tops").alias("n"), F.col("conv_id").alias("above"))
        tops = skewed_join(tops, above, ["parent"]).withColumn("parent_conv_id", F.col("above"))
        parents = upper.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
        upper = upper.join(parents, "parent", "left")
        columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
        inner = found.where("key is null and parent is null")
        out = scratch.cut(inner.select(columns).unionByName(tops.select(columns)).unionByName(upper.select(columns)))
        scratch.keep(out)
    return fewer_files(out).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("ends")), F.lit(NO_MEMBERS)).alias("ends_sha256"))


SQL = r"""
WITH poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t),
own AS (SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS own
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
keyed AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
                  lambda a, z: xor(a >> 8, t[(xor(a, z) & 255) + 1])), 4294967295) % 6 AS h FROM own o, poly),
seqs AS (SELECT k.conv_id, list_concat(coalesce(b.own, [])[1:h], k.own[h + 1:]) AS turns
         FROM keyed k LEFT JOIN own b ON b.conv_id = k.conv_id - k.conv_id % 100),
steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM seqs),
named AS (SELECT conv_id, depth, sha256(turns[1:depth]::VARCHAR) AS node, sha256(turns[1:depth - 1]::VARCHAR) AS up, len(turns) = depth AS ends,
          CASE WHEN depth = 0 THEN 0 ELSE length(turns[depth][2]) END AS size FROM steps),
nodes AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size,
          sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM named GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(kids, 0) AS kids FROM nodes n LEFT JOIN kids USING (node, depth)),
above AS (SELECT DISTINCT a.node AS top, a.depth AS top_depth, d.node, d.depth FROM named d JOIN named a ON a.conv_id = d.conv_id AND a.depth <= d.depth),
sums AS (SELECT top AS node, top_depth AS depth, count(*) FILTER (WHERE kids = 0) AS leaves, sum((n - 1) * size)::BIGINT AS saved
         FROM above JOIN full_nodes USING (node, depth) GROUP BY ALL)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN sums USING (node, depth) LEFT JOIN nodes p ON p.node = f.up AND p.depth = f.depth - 1"""


def brute_force(rows: list[tuple]) -> list[tuple]:
    """The same nodes from plain dictionaries of (conv_id, turn, role, text), for tests."""
    import zlib

    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append((turn is not None, turn or 0, role, name, text))
    own = {c: [(t[2], t[4]) for t in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % HEADS
        base = c - int(np.fmod(c, FAMILY))
        seqs[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members: dict[tuple, list[int]] = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    kids: dict[tuple, int] = {}
    for s in members:
        if s:
            kids[s[:-1]] = kids.get(s[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for s, own_members in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += s not in kids
            saved[s[:d]] += (len(own_members) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, m in members.items():
        last = ",".join(str(c) for c in sorted(m) if seqs[c] == s)
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), kids.get(s, 0), leaves[s], saved[s], hashlib.sha256(last.encode()).hexdigest()))
    return out
