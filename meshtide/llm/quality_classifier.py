"""Quality classifier: supervised subword embeddings.

Hashed n-grams have learned vectors; a document's vector is their mean, and a softmax over it gives the classes. Both
are trained by stochastic gradient descent in numpy, in one task, on a bounded sample (``MAX_ROWS`` documents,
``MAX_FEATURES`` features). As mean and output are linear, a trained model is one number per bucket, so scoring is a lookup and a mean
over every n-gram of the whole text, in one pass without a shuffle.

Defined cases: a null or empty text, or one without n-grams, scores by the class prior alone. Repeated rows score alike.
A sample with one class, or none, gives that class's smoothed share as everyone's score. Only the text is an input.
Input columns named as the results are ignored by ``scores`` and pass through ``keep_good``. An empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.llm.ngrams import blocks, sums
from meshtide.llm.shared import arrow_map, as_bytes, bounded_batches, release_worker
from meshtide.llm.training import Sample, fitted

BITS = 17
MAX_ROWS = 3000
MAX_FEATURES = 24_000_000


@dataclass
class Model:
    value: np.ndarray  # of each bucket
    bias: float


def train(rows: Sample, bits: int = BITS, dim: int = 16, updates: int = 12_000, rate: float = 1.0, seed: int = 1) -> Model:
    """At least ``updates`` steps, and whole passes over the sample."""
    ones, n = int(rows.label.sum()), len(rows.label)
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if ones in (0, n):
        return Model(np.zeros(1 << bits), prior)
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype(np.float32)
    out, bias = np.zeros((dim, 2), np.float32), np.array([0, prior], np.float32)
    epochs = -(-updates // n)
    done, steps = 0, epochs * n
    for _ in range(epochs):
        for i in random.permutation(n):
            ids, share, step = rows.ids[i], rows.shares[i], np.float32(rate * (1 - done / steps))
            done += 1
            mean = share @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[rows.label[i]] -= 1
            back = out @ p
            out -= step * np.outer(mean, p)
            bias -= np.float32(0.1) * step * p
            vectors[ids] -= step * np.outer(share, back)
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> Model:
    """Learn from the labels outside the held-out third, crc32(doc_id) mod 3 = 1."""
    known = labels.where(~held_out())
    return Model(**fitted(docs, known, "quality", bits, MAX_ROWS, MAX_FEATURES, lambda rows: train(rows, bits)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_texts(texts: pa.Array, model: Model, bits: int = BITS) -> np.ndarray:
    found = [np.zeros(0)]
    for _, _, joined, ends in blocks(texts):
        total, count = sums(joined, ends, bits, model.value)
        found.append(1 / (1 + np.exp(-(total / np.maximum(count, 1) + model.bias))))
    return np.concatenate(found)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score)."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))

    def run(batches):
        for b in batches:
            yield {"doc_id": b["doc_id"], "score": score_texts(b["text"], Model(*shipped.value))}

    return arrow_map(docs.select("doc_id", as_bytes().alias("text")), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The whole rows that score ``least`` or more. Rows stay in the JVM; a task's Python sees their texts alone."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.value, model.bias))

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        release_worker()
        return pa.array(score_texts(text, Model(*shipped.value)))

    bounded_batches(docs.sparkSession)
    return docs.where(score(as_bytes()) >= least)


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    found = scores(docs, fit(docs, labels))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
