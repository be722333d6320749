"""Quality rules: counted rules, and a calibrated logistic regression over hashed n-grams against a fixed threshold.

The regression is trained on labelled quality rows (a bounded sample, see ``training.fitted``); a quarter of the sample
is kept from training and sets the calibration (a sigmoid fitted with smoothed targets). Everything is scored in Arrow
batches, in one pass without a shuffle; every count covers the whole text.

Defined cases: a null or empty text has no words, fails the base rules, and counts 0 throughout. Repeated rows get the
same result. Without labels of both classes only the base rules decide. Input columns other than doc_id and text are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from meshtide.llm.ngrams import blocks, sums
from meshtide.llm.shared import arrow_map, as_bytes
from meshtide.llm.training import Sample, fitted

BITS = 17
MAX_ROWS = 3000
MAX_FEATURES = 24_000_000
THRESHOLD = 0.5
SYMBOLS = b"#*$%&|<>"
WINDOW = 5


@dataclass
class Rules:
    """Calibrated probability: sigmoid(slope * (mean weight + bias) + shift); None where nothing could be learned."""

    weight: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


def train(rows: Sample, bits: int = BITS, updates: int = 10_000, rate: float = 1.0, seed: int = 1) -> Rules:
    """At least ``updates`` steps, and whole passes over the sample's training part."""
    label = rows.label.astype(np.float64)
    random = np.random.default_rng(seed)
    order = random.permutation(len(label))
    aside, own = order[: len(order) // 4], order[len(order) // 4:]
    if len({*label[own]}) < 2 or len({*label[aside]}) < 2:
        return Rules()
    weight, seen, bias = np.zeros(1 << bits), np.full(1 << bits, 1e-10), float(np.log(label[own].mean() / (1 - label[own].mean())))
    for _ in range(-(-updates // len(own))):
        for i in random.permutation(own):
            ids, share = rows.ids[i], rows.shares[i]
            slope = (1 / (1 + np.exp(-(share @ weight[ids] + bias))) - label[i]) * share
            seen[ids] += slope * slope
            weight[ids] -= rate * slope / np.sqrt(seen[ids])
    z = np.array([rows.shares[i] @ weight[rows.ids[i]] for i in aside]) + bias
    return Rules(weight, bias, *calibrate(z, label[aside]))


def calibrate(z: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits smoothed targets best, by damped Newton steps on scaled scores."""
    ones, scale = label.sum(), max(float(np.std(z)), 1e-12)
    target = np.where(label == 1, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.stack([z / scale, np.ones(len(z))])
    a = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-6 * np.eye(2), x @ (p - target))
        a -= step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0] / scale), float(a[1])


def fit(docs: DataFrame, labels: DataFrame, bits: int = BITS) -> Rules:
    return Rules(**fitted(docs, labels, "quality", bits, MAX_ROWS, MAX_FEATURES, lambda rows: train(rows, bits)))


def repeated_words(words: list[bytes], joined: bytes, window: int = WINDOW) -> int:
    """How many words lie in windows whose words occur in more than one place."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-window].tolist()]
    seen = [joined[a:b] for a, b in zip(starts, ends[window - 1:].tolist(), strict=True)]
    if len(set(seen)) == n:
        return 0
    count = Counter(seen)
    first = np.flatnonzero(np.fromiter((count[s] > 1 for s in seen), bool, n))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, first, 1)
    np.add.at(cover, first + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. ``bytes`` methods split at ASCII space only."""
    words = text.split()
    joined = b" ".join(words) + b" "
    spaces = len(text) - len(joined) + len(words) + (not words)
    chars = len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), chars - spaces, len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words, joined))


def judge(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, the five counts, base_failed, probability or null, kept)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(rules))  # plain values: workers need no copy of this module

    def run(batches):
        r = Rules(**shipped.value)
        for b in batches:
            counts = np.array([base_counts(t) for t in b["text"].to_pylist()], np.int64).reshape(-1, 5)
            failed = (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])
            good, odds = np.ones(len(counts), bool), [None] * len(counts)
            if r.weight is not None:
                z = np.concatenate([np.zeros(0), *[t / np.maximum(n, 1) for t, n in (sums(j, e, BITS, r.weight) for _, _, j, e in blocks(b["text"]))]])
                odds = 1 / (1 + np.exp(-np.clip(r.slope * (z + r.bias) + r.shift, -500, 500)))
                good = odds >= THRESHOLD
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            yield {"doc_id": b["doc_id"], "base_failed": failed, "probability": odds, "kept": good & ~failed} | dict(zip(names, counts.T.copy(), strict=True))

    return arrow_map(docs.select("doc_id", as_bytes().alias("text")), run,
                     "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                     "base_failed boolean, probability double, kept boolean")


def digests(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns."""
    return judge(docs, fit(docs, labels))
