"""Byte, line, passage and near-duplicate removal against plain versions."""

import random

import numpy as np
import pytest

from meshtide.llm import byte_repeats, graph, line_dedup, minhash, passages, simhash
from meshtide.llm.bloom import bit_places, empty, hits, shard_of
from meshtide.llm.shared import Scratch, documents

from .conftest import rows_of, same_rows

SF = "/root/testdata/sf0.001"


def hold_rows(spark, sf):
    return [tuple(r) for r in documents(spark, sf).select("doc_id", "text").collect()]


@pytest.mark.parametrize("operator", [byte_repeats, line_dedup, passages])
def test_awkward_rows(operator, docs, awkward):
    same_rows(operator.digests(docs), null_lines(awkward) if operator is line_dedup else operator.brute_force(awkward))


def null_lines(rows):
    """The line rule with a null doc_id below all others."""
    low = [(-1 if d is None else d, t) for d, t in rows]
    return [(None if r[0] == -1 else r[0], *r[1:]) for r in line_dedup.brute_force(low)]


def test_near_duplicates_of_awkward_rows(docs, awkward):
    same_rows(simhash.digests(docs.where("doc_id is not null")), simhash.brute_force([r for r in awkward if r[0] is not None]))
    assert len(simhash.digests(docs).collect()) == len(awkward)


@pytest.mark.parametrize("operator", [byte_repeats, line_dedup, passages, simhash])
def test_empty_table(operator, no_docs):
    assert operator.digests(no_docs).collect() == []


@pytest.mark.parametrize("operator", [line_dedup, passages, simhash])
def test_whole_small_table(operator, spark):
    same_rows(operator.digests(documents(spark, SF)), operator.brute_force(hold_rows(spark, SF)))


def overlapping(seed):
    """Texts from a small alphabet that share stretches about as long as the window."""
    r = random.Random(seed)
    base = ["".join(r.choice("ab é") for _ in range(1500)) for _ in range(3)]
    rows = []
    for i in range(60):
        at = r.randrange(900)
        text = "".join(r.choice("abc") for _ in range(r.randrange(150))) + r.choice(base)[at:at + r.choice([395, 400, 401, 433, 600])]
        rows.append((i, text + r.choice(base)[:r.randrange(380, 700)] if r.random() < 0.3 else text))
    return [*rows, (60, "ab" * 400), (61, "x" * 399), (62, "x" * 399 + "y"), (63, "z" * 401)]


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_repeats_of_overlapping_texts(spark, seed):
    rows = overlapping(seed)
    same_rows(byte_repeats.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), byte_repeats.brute_force(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_overlapping_texts(spark, seed):
    r = random.Random(seed)
    base = [[r.choice(["a", "b", "é", "dd"]) for _ in range(120)] for _ in range(3)]
    rows = []
    for i in range(120):
        at = r.randrange(90)
        words = [r.choice("abc") for _ in range(r.randrange(20))] + r.choice(base)[at:at + r.choice([19, 20, 21, 30])]
        rows.append((i, r.choice([" ", "\n", "\t "]).join(words + r.choice(base)[:r.randrange(50)])))
    same_rows(passages.digests(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), passages.brute_force(rows))


def test_loser_tree_merges_with_shared_lengths():
    r = np.random.default_rng(5)
    runs = []
    for n in (1, 7, 300, 50):
        rows = np.unique(r.integers(97, 99, (n, byte_repeats.ITEM), dtype=np.uint8), axis=0)
        if n > 40:
            rows[:20, 9:] = 97
            rows = np.unique(rows, axis=0)
        runs.append(rows)
    coded = [byte_repeats.front_code(x) for x in runs]
    out = list(byte_repeats.merge([byte_repeats.decode(lcp.tobytes(), rest) for lcp, rest in coded] + [iter(())]))
    items = [x[1] for x in out]
    assert items == sorted(row.tobytes() for x in runs for row in x)
    for before, now, (shared, *_) in zip(items, items[1:], out[1:], strict=False):
        common = next((i for i in range(len(now)) if before[i] != now[i]), len(now))
        assert shared == common


def test_line_dedup_keeps_other_columns(docs):
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == [*docs.columns, "n_dropped"]
    assert sorted(map(str, (r[:1] + r[2:4] for r in kept.drop("n_lines", "n_dropped").collect()))) == sorted(
        map(str, (r[:1] + r[2:4] for r in docs.collect())))
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_drop_near_duplicates_returns_whole_rows(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 5 in ids and 6 not in ids and ids.count(10) == 1  # one row of a group stays, also of equal rows
    assert ids.count(7) == 1 and sum(not (r.text or "").strip() for r in kept.collect()) == 1


def edited(seed):
    """Texts of one cloud of edits, of pairs just above and below 0.8, and with one shingle in most places."""
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(r.randrange(1, 5)):
            words[r.randrange(len(words))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    for i in range(60, 120, 2):
        words = [f"v{r.randrange(10**6)}" for _ in range(200)]
        rows += [(i, " ".join(words)), (i + 1, " ".join(words[:r.randrange(155, 170)]))]
    return rows + [(200 + i, "la " * 300 + " ".join(f"u{r.randrange(10**6)}" for _ in range(100))) for i in range(5)] + [(300, None), (301, " ")]


@pytest.mark.parametrize("tile", [minhash.TILE, 500])
def test_near_copies_of_similarity_four_fifths_go(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = edited(4)
    group, pairs = minhash.brute_force(rows)
    least = {g: min(d for (d, _), o in zip(rows, group, strict=True) if o == g) for g in group}
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert pairs > 60 and len(least) > 30 and sorted(r.doc_id for r in kept.collect()) == sorted(least.values())


def test_near_copies_of_a_whole_small_table(spark):
    rows = hold_rows(spark, SF)
    group, _ = minhash.brute_force(rows)
    least = {min(d for (d, _), o in zip(rows, group, strict=True) if o == g) for g in group}
    assert {r.doc_id for r in simhash.drop_near_duplicates(documents(spark, SF)).collect()} == least


def test_crowded_keys_are_split(spark, monkeypatch):
    """Many fingerprints within a few bits: the tiled comparison finds the same sets."""
    r = np.random.default_rng(3)
    seeds = r.integers(0, 2**63, 4)
    prints = {int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in r.integers(0, 60, (60, 2))}
    monkeypatch.setattr(simhash, "TILE", 16)
    rows = spark.createDataFrame([(p,) for p in prints], "fp long")
    with Scratch(spark) as scratch:
        found = graph.components(simhash.links(rows, scratch), scratch)
        root = {r.node: r.root for r in found.collect()}
    near = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 4]
    assert near and all(root[a] == root[b] for a, b in near)
    assert len(set(root.values())) == len({min(x for x in prints if (x ^ int(s)).bit_count() <= 2) for s in seeds})


def test_block_masks_meet_every_close_pair():
    r = random.Random(1)
    for rows in (10, 10**6, 10**9):
        masks = simhash.block_masks(rows, 4)
        for _ in range(200):
            flips = sum(1 << i for i in r.sample(range(64), 4))
            assert any(flips & (m & (2**64 - 1)) == 0 for m in masks)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001), (5, 5)], "a long, b long")
    with Scratch(spark) as scratch:
        root = {r.node: r.root for r in graph.components(edges, scratch).collect()}
    assert len({root[i] for i in range(201)}) == 1 and root[1000] == root[1001] != root[0]


def test_filters_miss_nothing():
    h = np.random.default_rng(2).integers(0, 2**64, 5000, dtype=np.uint64)
    f = empty(1 << 12)
    for shard in range(256):
        own, bits = h[shard_of(h) == shard], np.zeros(1 << 12, bool)
        bits[bit_places(own, 1 << 12)] = True
        f[shard] = np.packbits(bits)
    assert hits(f, h).all() and hits(f, h + np.uint64(12345)).mean() < 0.2
