"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is the majority of the 64 hash bits of a document's word shingles. Two fingerprints that differ in at
most d bits agree in at least m - d of m blocks, so joining on every choice of m - d blocks meets every close pair;
m grows with the number of distinct fingerprints, so that a chance key holds about one. Work is on distinct
fingerprints: copies never meet each other. Within a key, fingerprints are compared as integers, and a chain through
each connected set goes out instead of all its pairs. A key with more than TILE fingerprints is split into pairs of
chunks, which different tasks compare. All links count; there is no cap.

``drop_near_duplicates`` is for texts whose sets of shingles have a similarity of 0.8 or more. Their fingerprints of 64 bits differ in 5 to 14
bits, for which there are no blocks of usable width, so ``groups`` takes longer ones: 256 bits, of which near copies differ in
at most 72, and blocks of many more, of which only the strongest bits make up the keys (``votes``). Sets that share a key and have
close fingerprints are candidates, and linked if the sets themselves confirm it.

Defined cases: a null or empty text has fingerprint zero and is linked like any other. Repeated rows share a
fingerprint and so a component; rows without doc_id get the component of their group, and count for no minimum. An
empty table gives an empty result. Input columns other than doc_id and text are ignored by ``near_duplicates`` and
pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.llm import minhash, votes
from meshtide.llm.bloom import build, hits
from meshtide.llm.graph import components
from meshtide.llm.shared import Scratch, arrow_map, as_bytes, fewer_files, skewed_join

BITS = 64
TILE = 4096
PRINTS = [f"p{i}" for i in range(votes.PRINT // 64)]


def fingerprint(text: bytes, words: int = 4, seed: int = 42) -> int:
    """Lower-cased (A-Z) ASCII-space separated words; the whole sequence where there are fewer than ``words``."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = [0, *ends[:-words].tolist()]
    digest = xxhash.xxh64_intdigest
    n, ones = len(starts), np.zeros(BITS, np.int64)
    stops = (ends[words - 1:] - 1).tolist()
    for at in range(0, n, 1 << 16):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at:at + (1 << 16)], stops[at:at + (1 << 16)], strict=True)), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    def run(batches):
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64)
            yield {"doc_id": b["doc_id"], "fp": found.view(np.int64)}

    return arrow_map(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, fp long")


def block_masks(rows: int, distance: int) -> list[int]:
    """Masks, as signed longs, of every choice of m - distance of m blocks, with m the least for ``rows`` keys."""
    m = distance + 1
    while m < BITS and (m - distance) * BITS // m < rows.bit_length():
        m += 1
    edges = [BITS * i // m for i in range(m + 1)]
    blocks = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    masks = [sum(pick) for pick in combinations(blocks, m - distance)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in masks]


def chains(group: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect, within each run of equal ``group``, what links of at most ``distance`` bits connect."""
    a, b = [], []
    n = len(fp)
    edges = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [n]]) if n else np.zeros(1, int)
    sizes = np.diff(edges)
    small = np.repeat(sizes <= 16, sizes)
    for step in range(1, min(16, n)):
        near = small[:-step] & (group[step:] == group[:-step]) & (np.bitwise_count(fp[step:] ^ fp[:-step]) <= distance)
        at = np.flatnonzero(near)
        a.append(fp[at])
        b.append(fp[at + step])
    for g in np.flatnonzero(sizes > 16):
        rest = fp[edges[g]:edges[g + 1]]
        while len(rest) > 1:
            front, rest = rest[:1], rest[1:]
            chain = [front]
            at = 0
            while at < len(chain) and len(rest):
                for x in chain[at]:
                    near = np.bitwise_count(rest ^ x) <= distance
                    if near.any():
                        chain.append(rest[near])
                        rest = rest[~near]
                at += 1
            line = np.concatenate(chain)
            a.append(line[:-1])
            b.append(line[1:])
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linked(distance: int):
    """Rows sorted by group in; a group that crosses batches is put together first."""

    def run(batches):
        group, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for b in batches:
            group = np.concatenate([group, b["g"].to_numpy()])
            fp = np.concatenate([fp, b["fp"].to_numpy().view(np.uint64)])
            if len(group):
                cut = int(np.searchsorted(group, group[-1]))
                x, y = chains(group[:cut], fp[:cut], distance)
                yield {"a": x.view(np.int64), "b": y.view(np.int64)}
                group, fp = group[cut:], fp[cut:]
        x, y = chains(group, fp, distance)
        yield {"a": x.view(np.int64), "b": y.view(np.int64)}

    return run


def links(prints: DataFrame, scratch: Scratch, distance: int = 4) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints whose connected sets are those of all pairs within ``distance``."""
    masks = block_masks(prints.count(), distance)
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("block"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = prints.select("fp", keys.alias("k")).select("k.block", "k.key", "fp")
    shared = scratch.cut(keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1"), few=True)
    chunks = F.ceil(F.col("n") / TILE).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j), F.greatest(own, j))))
    met = keyed.join(shared, ["block", "key"]).select("fp", "block", "key", tile.alias("tile"))
    # equal hashes of two groups would only add comparisons, never lose one
    group = met.select("fp", F.xxhash64("block", "key", "tile").alias("g"))
    dealt = group.repartition("g").sortWithinPartitions("g", "fp")
    return scratch.cut(arrow_map(dealt, _linked(distance), "a long, b long").distinct(), few=True)


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """(doc_id, fp long, component_id): the smallest doc_id reachable over links."""
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.cut(fingerprints(docs, words))
        classes = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), few=True)
        roots = components(links(classes.select("fp"), scratch, distance), scratch)
        rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
        least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
        named = scratch.cut(rooted.join(least, "root").select("fp", "component_id"), few=True)
        scratch.keep(prints)
        scratch.keep(named)
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def _classes(words: int, width: int, depth: int, keys: int):
    def run(batches):
        for part, sets in minhash.sets_of(batches, words):
            sizes = np.array(list(map(len, sets)), np.int64)
            prints, codes = votes.prints_and_codes(np.concatenate([np.zeros(0, np.uint64), *sets]), sizes, width, depth, keys)
            edges = np.concatenate([[0], np.cumsum(np.where(sizes > 0, keys, 0))]).astype(np.int32)
            yield {"row": part["row"], "doc_id": part["doc_id"], "th": part["th"], "node": [minhash.name_of(x) for x in sets], "size": sizes,
                   "codes": pa.ListArray.from_arrays(edges, codes[sizes > 0].ravel()), **{f"p{i}": prints[:, i] for i in range(len(PRINTS))}}

    return run


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, doc): each row of ``docs`` as a struct, with a number; a stored table, so that the numbers stay."""
    return scratch.cut(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("doc")))


def candidates(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): members that meet the first one of a key, where sizes allow a similarity of 4/5 and fingerprints are close."""
    sides = classes.select("id", F.struct("size", *PRINTS).alias("own"))
    met = members.where("id <> hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    met = met.join(sides.select(F.col("id").alias("b"), F.col("own").alias("y")), "b").join(sides.select(F.col("id").alias("a"), F.col("own").alias("x")), "a")
    differ = sum((F.bit_count(F.col(f"x.{p}").bitwiseXOR(F.col(f"y.{p}"))) for p in PRINTS), F.lit(0))
    return met.where((differ <= votes.DISTANCE) & F.expr("5 * least(x.size, y.size) >= 4 * greatest(x.size, y.size)")).select("a", "b")


def groups(rows: DataFrame, scratch: Scratch, words: int = 5) -> DataFrame:
    """(row, stays): for every row of a ``numbered`` table the row that stands for its group.

    That is the one with the smallest doc_id, a null one last; of equal doc_ids the least hash of the text, then the first row.
    A class, a distinct set, goes by the number of that row. Members of a key first meet one hub each, which is linear in a key's size:
    a task holds one hub's set and streams the sets of its members, and a hub with more than PER_TASK of them is dealt to several tasks. Keys of
    three or more whose members are then still of several groups are compared in full inside tasks, over the sets; one with more than TILE
    shingles is split into pairs of chunks, which different tasks compare. There is no cap, and no set is broadcast.
    """
    texts = rows.select("row", "doc.doc_id", F.xxhash64("doc.text").alias("th"), as_bytes("doc.text").alias("text"))
    columns = "row long, doc_id long, th long, node binary, size long, codes array<int>, " + ", ".join(f"{p} long" for p in PRINTS)
    prints = scratch.cut(arrow_map(texts, _classes(words, *votes.setting(rows.count())), columns))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th", "row")).alias("least")
    classes = prints.groupBy("node").agg(first, *[F.first(c).alias(c) for c in ("size", *PRINTS)])
    classes = scratch.cut(classes.select("node", "least", F.col("least.row").alias("id"), "size", *PRINTS), few=True)
    coded = prints.select(F.col("row").alias("id"), "codes").join(classes.select("id").hint("shuffle_hash"), "id", "left_semi")
    key = F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("col").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    keyed = coded.select("id", F.posexplode("codes")).select(key.alias("key"), "id")
    at = Window.partitionBy("key").orderBy("id")
    met = keyed.select("key", "id", F.first("id").over(at).alias("hub"), F.lead("id").over(at).alias("after"))
    members = scratch.cut(met.where("id <> hub or after is not null").drop("after"), few=True)

    pairs = scratch.cut(candidates(members, classes), few=True)
    crowded = scratch.cut(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 2"), few=True)
    asked_for = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    sets = scratch.cut(held(texts, asked_for, scratch, words))
    hubs = scratch.cut(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / minhash.PER_TASK).cast("int")), few=True)
    asked = skewed_join(pairs, hubs, ["a"]).select("a", F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"), "b")
    asked = asked.join(sets.withColumnRenamed("id", "b"), "b").select("a", "part", "b", "held")
    own = hubs.join(sets.withColumnRenamed("id", "a"), "a").select(
        "a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "held")
    dealt = own.unionByName(asked).repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
    links = scratch.cut(arrow_map(dealt, minhash.verified, "a long, b long"), few=True)

    roots = components(links, scratch)
    # one row per class with its keys, which are bounded, meets its root; a crowded group's keys do not go through a join one by one
    listed = skewed_join(members.select("key", "id"), crowded, ["key"]).groupBy("id").agg(F.collect_list("key").alias("keys"))
    placed = classes.select("id", "size").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rooted = listed.join(placed, "id").select("size", "root", F.explode("keys").alias("key"))
    open_keys = rooted.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.min("root").alias("x"), F.max("root").alias("y"))
    left = scratch.cut(open_keys.where("x <> y").select("key", "n", F.ceil(F.col("total") / minhash.TILE).cast("int").alias("chunks")), few=True)
    open_members = scratch.cut(skewed_join(members.select("key", "id"), left, ["key"]).select("key", "id", "chunks"), few=True)
    sets = scratch.cut(held(texts, open_members.select("id").distinct(), scratch, words))
    listed = open_members.groupBy("id").agg(F.collect_list(F.struct("key", "chunks")).alias("of"))
    each = listed.join(sets, "id").select("id", "held", F.explode("of").alias("of")).select("id", "held", "of.key", "of.chunks")
    mine = F.pmod(F.xxhash64("id"), "chunks").cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.struct(F.least(mine, j), F.greatest(mine, j))))
    tiled = each.select("id", "held", "key", tile.alias("tile")).select("id", "held", F.xxhash64("key", "tile").alias("g"))
    dealt = tiled.repartition("g").sortWithinPartitions("g", "id")
    more = scratch.cut(arrow_map(dealt, minhash.compared, "a long, b long").distinct(), few=True)

    roots = components(links.unionByName(more), scratch).withColumnRenamed("node", "id")
    whole = classes.select("node", "id", "least").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    named = whole.join(whole.groupBy("root").agg(F.min("least").alias("stays")), "root").select("node", F.col("stays.row").alias("stays"))
    return scratch.cut(prints.select("row", "node").join(named, "node").select("row", "stays"))


def held(texts: DataFrame, ids: DataFrame, scratch: Scratch, words: int) -> DataFrame:
    """(id, held): the sets of the classes ``ids`` names, and of few others, whom a Bloom filter does not tell from them; no text is shuffled."""
    table = build(scratch.cut(ids.select(F.xxhash64("id").alias("h")), few=True), twice=False)
    shipped = texts.sparkSession.sparkContext.broadcast(table)
    make = minhash.held_sets(words)

    def run(batches):
        def named():
            for b in batches:
                hit = pa.array(hits(shipped.value, b["h"].to_numpy().view(np.uint64)))
                yield {n: b[n].filter(hit) for n in ("id", "text")}

        return make(named())

    return arrow_map(texts.select(F.col("row").alias("id"), F.xxhash64("row").alias("h"), "text"), run, "id long, held array<long>")


def drop_near_duplicates(docs: DataFrame, words: int = 5) -> DataFrame:
    """One whole row of each group of ``groups``: the one with the smallest doc_id, a null one last, then with the least text hash."""
    with Scratch(docs.sparkSession) as scratch:
        rows = numbered(docs, scratch)
        found = groups(rows, scratch, words)
        for table in (rows, found):
            scratch.keep(table)
    return rows.join(found.where("row = stays").hint("shuffle_hash"), "row", "left_semi").select("doc.*")


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    found = near_duplicates(docs)
    return fewer_files(found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


def brute_force(rows: list[tuple[int, str | None]], words: int = 4, distance: int = 4) -> list[tuple[int, str, int]]:
    """All pairs, bit by bit, for tests."""
    prints = []
    for _, text in rows:
        tokens = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()]
        shingles = [b" ".join(tokens[i:i + words]) for i in range(max(1, len(tokens) - words + 1))] if tokens else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << j for j in range(BITS) if 2 * sum(x >> j & 1 for x in h) > len(h)))
    to = list(range(len(rows)))

    def top(i):
        while to[i] != i:
            i = to[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                to[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(d, least.get(top(i), d))
    return [(d, f"{prints[i]:016x}", least[top(i)]) for i, (d, _) in enumerate(rows)]
