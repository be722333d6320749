"""Training on a bounded, reproducible sample of labelled documents as hashed features, for the learned operators.

The sample never leaves the executors: one task, whose share is bounded whatever the input's size, learns from it, and the
driver gets the model alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.ngrams import blocks, counted
from meshtide.llm.shared import Scratch, arrow_map, as_bytes


@dataclass
class Sample:
    """Per document: its distinct buckets, their share of its features, and its label."""

    ids: list[np.ndarray]
    shares: list[np.ndarray]
    label: np.ndarray


def fitted(docs: DataFrame, labels: DataFrame, column: str, bits: int, max_rows: int, max_features: int, train: Callable[[Sample], object]) -> dict:
    """The fields of the model that ``train`` makes of at most ``max_rows`` labelled documents and ``max_features`` distinct
    features in all, least md5(doc_id) first.

    Both bounds hold what the training task keeps to 8 * max_features bytes; every document is used whole. A doc_id that
    has several labels or texts counts once, with the least of them; rows with a null label or doc_id are not used.
    """
    chosen = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).alias("label"))
    chosen = chosen.withColumn("h", F.md5(F.col("doc_id").cast("string"))).orderBy("h").limit(max_rows)
    own = docs.select("doc_id", as_bytes().alias("text")).join(F.broadcast(chosen), "doc_id")
    own = own.groupBy("doc_id", "h", "label").agg(F.min("text").alias("text"))

    def run(batches):
        for b in batches:
            found = [x for _, _, joined, ends in blocks(b["text"]) for x in counted(joined, ends, bits)]
            yield {"h": b["h"], "label": b["label"], "n": [len(i) for i, _ in found], "ids": [i.tobytes() for i, _ in found],
                   "counts": [c.tobytes() for _, c in found]}

    def learn(batches):
        rows = []
        for b in batches:
            for h, label, ids, counts in zip(*[b[n].to_pylist() for n in ("h", "label", "ids", "counts")], strict=True):
                c = np.frombuffer(counts, np.int32)
                rows.append((h, label, np.frombuffer(ids, np.int32), (c / max(1, c.sum())).astype(np.float32)))
        rows.sort(key=lambda r: r[0])
        model = train(Sample([r[2] for r in rows], [r[3] for r in rows], np.array([r[1] for r in rows], np.int64)))
        yield {"model": [pickle.dumps(vars(model))]}  # plain values: the driver needs no class of the task's

    with Scratch(docs.sparkSession) as scratch:
        table = scratch.cut(arrow_map(own.select("h", F.col("label").cast("int").alias("label"), "text"), run,
                                      "h string, label int, n int, ids binary, counts binary"), few=True)
        sizes = sorted((r.h, r.n) for r in table.select("h", "n").collect())
        fits = np.cumsum([n for _, n in sizes]) <= max_features
        if not fits.any():
            return vars(train(Sample([], [], np.zeros(0, np.int64))))
        used = table.where(F.col("h") <= sizes[int(fits.sum()) - 1][0]).select("h", "label", "ids", "counts")
        return pickle.loads(arrow_map(used.coalesce(1), learn, "model binary").first().model)
