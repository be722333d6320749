"""Classifier, rules, mixing and the pipeline."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest

import corpus_pipeline
from meshtide.llm import bpe, line_dedup, minhash, mixing, ngrams, quality_classifier, quality_rules
from meshtide.llm.queries import SQL
from meshtide.llm.shared import documents, labels
from meshtide.llm.training import Sample

from .conftest import rows_of

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_classifier_on_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in labels(spark, SF).collect()}
    rows = [r for r in quality_classifier.digests(documents(spark, SF), labels(spark, SF)).collect() if r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_classifier_reads_no_held_out_label(spark):
    docs, known = documents(spark, SF), labels(spark, SF)
    flipped = known.withColumn("quality", quality_classifier.F.when(quality_classifier.held_out(), 1 - quality_classifier.F.col("quality")).otherwise(
        quality_classifier.F.col("quality")).cast("int"))
    assert (quality_classifier.fit(docs, known).value == quality_classifier.fit(docs, flipped).value).all()


def test_driver_gathers_the_model_and_no_sample(spark, monkeypatch):
    """The sample's features are learned from in a task: keys and sizes of its rows and the model reach the driver, nothing else."""
    frame, got = type(spark.range(0)), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: got.append(real(self)) or got[-1])
    for fit, bits in ((quality_classifier.fit, 10), (quality_rules.fit, 10)):
        got.clear()
        model = fit(documents(spark, SF), labels(spark, SF), bits)
        assert any(len(v) == 1 << bits for v in vars(model).values() if isinstance(v, np.ndarray))
        rows = [r for rows in got for r in rows]
        size = sum(len(v) for r in rows for v in r if isinstance(v, str | bytes | bytearray))
        assert len(rows) > 200 and size < 32 * len(rows) + (16 << bits)


def test_awkward_rows_and_empty_tables(spark, docs, no_docs, awkward):
    known = spark.createDataFrame([(5, 1), (5, None), (None, 1), (17, 0), (99, 1)], "doc_id long, quality int")
    for table, n in ((docs, len(awkward)), (no_docs, 0)):
        assert len(quality_classifier.digests(table, known).collect()) == n
        assert len(quality_rules.digests(table, known).collect()) == n
        assert len(mixing.digests(table).collect()) == n
        assert quality_classifier.keep_good(table, quality_classifier.fit(table, known)).columns == docs.columns
    nothing = known.where("false")
    assert {r.score for r in quality_classifier.digests(docs, nothing).collect()} == {0.5}
    assert all(r.kept != r.base_failed for r in quality_rules.digests(docs, nothing).collect())


def plain_counts(text):
    words, seen, repeated = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count, cover = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            cover.update(range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), repeated, len(cover)


def test_rule_counts(spark, docs, awkward):
    rows = quality_rules.judge(docs, quality_rules.Rules()).collect()
    found = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert found == Counter((d, *plain_counts(t)) for d, t in awkward)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) for r in rows)


def test_rules_keep_the_good(spark):
    truth = {r.doc_id: r.quality for r in labels(spark, SF).collect()}
    rows = [r for r in quality_rules.digests(documents(spark, SF), labels(spark, SF)).collect() if r.doc_id in truth and not r.base_failed]
    good, bad = [r.kept for r in rows if truth[r.doc_id]], [r.kept for r in rows if not truth[r.doc_id]]
    assert np.mean(good) > 0.98 and np.mean(bad or [False]) < 0.1


def test_calibration_recovers_probabilities():
    r = np.random.default_rng(1)
    z = r.normal(size=20_000)
    slope, shift = quality_rules.calibrate(z, (r.random(20_000) < 1 / (1 + np.exp(-(2 * z - 1)))).astype(float))
    assert abs(slope - 2) < 0.15 and abs(shift + 1) < 0.15


def test_training_needs_both_classes():
    one = Sample([np.array([1, 2])] * 3, [np.array([0.5, 0.5], np.float32)] * 3, np.array([1, 1, 1]))
    assert quality_classifier.train(one).bias > 0 and quality_rules.train(one).weight is None


def test_features_do_not_depend_on_blocks(awkward, monkeypatch):
    texts = pa.array([(t or "").encode() for _, t in awkward], pa.binary())
    value = np.random.default_rng(0).normal(size=1 << 17)

    def all_sums():
        return [np.concatenate(x) for x in zip(*[ngrams.sums(j, e, 17, value) for _, _, j, e in ngrams.blocks(texts)], strict=True)]

    (one, n), _ = all_sums(), monkeypatch.setattr(ngrams, "BLOCK_BYTES", 1)
    (other, m) = all_sums()
    assert (n == m).all() and np.allclose(one, other, atol=1e-9)


def fill(sizes):
    """Targets by raising the level until every capped share is settled."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        share = sum(w for s, w in weight.items() if s not in full)
        over = {s for s in names if s not in full and left * weight[s] / share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in full else left * weight[s] / share for s in names}
        full |= over


def test_targets_and_taken_words(spark):
    docs = documents(spark, SF)
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    rows = mixing.digests(docs).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
    target = fill(sizes)
    for r in rows:
        assert abs(r.target - target[sources[r.doc_id]]) <= 1e-6 * r.target and r.source_size == sizes[sources[r.doc_id]]
    assert all(abs(taken[s] - target[s]) <= 3 * largest[s] for s in sizes)
    assert rows_of(mixing.digests(docs.repartition(7))) == rows_of(mixing.digests(docs))


def test_mix_repeats_whole_rows(docs):
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns
    copies = Counter({(r.doc_id, r.size): r.copies for r in mixing.plan(docs).collect() if r.doc_id not in (7, 10)})
    found = Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in taken.collect() if r.doc_id not in (7, 10))
    assert +copies == found


@pytest.mark.parametrize("name", sorted(SQL))
def test_reference_sql(spark, name):
    from meshtide.llm.queries import QUERIES

    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = QUERIES[name](spark, SF)
    wanted = con.sql(SQL[name])
    order = sorted(frame.columns)
    assert order == sorted(wanted.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in frame.collect()))) == sorted(
        map(str, con.sql(f"SELECT {', '.join(order)} FROM ({SQL[name]})").fetchall()))


def test_pipeline_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = documents(spark, sf)
    states = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        states.append([r.asDict() for r in docs.collect()])
    start = [r.asDict() for r in documents(spark, sf).collect()]
    good, lines, near, mixed, ids = states

    score = {r.doc_id: r.score for r in quality_classifier.scores(documents(spark, sf), quality_classifier.fit(documents(spark, sf), labels(spark, sf))).collect()}
    assert [r["doc_id"] for r in good] == [r["doc_id"] for r in start if score[r["doc_id"]] >= 0.5]
    whole = {r[0]: r[3] for r in line_dedup.brute_force([(r["doc_id"], r["text"]) for r in good])}
    sha = quality_classifier_sha
    assert {r["doc_id"]: sha(r["text"]) for r in lines} == whole and all(r["n_chars"] == len(r["text"]) for r in lines)
    group, _ = minhash.brute_force([(r["doc_id"], r["text"]) for r in lines])
    least: dict = {}
    for g, r in zip(group, lines, strict=True):
        least[g] = min(r["doc_id"], least.get(g, r["doc_id"]))
    assert sorted(r["doc_id"] for r in near) == sorted(least.values())
    plan = {r.doc_id: r.copies for r in mixing.plan(spark.createDataFrame(near, documents(spark, sf).schema)).collect()}
    assert Counter(r["doc_id"] for r in mixed) == +Counter(plan)
    codec = bpe.Codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    assert len(ids) == len(mixed) and {r["doc_id"]: codec.decode(bytes(r["ids"])).decode() for r in ids} == {r["doc_id"]: r["text"] for r in mixed}
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(ids)


def quality_classifier_sha(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()
