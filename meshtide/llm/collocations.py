"""Phrase collocations, counted over a prefix-free parse.

Texts are parsed into chunks: a chunk begins at the start of a document and wherever the hash of the next OVERLAP words is a trigger, and
runs OVERLAP words into the next chunk. So equal passages are cut alike wherever they stand, and the distinct chunks with their
frequencies are a dictionary of the corpus. Every phrase of up to OVERLAP + 1 words that starts before a chunk's overlap lies inside the
chunk; it is counted there, times the chunk's frequency, and nowhere else.

Only phrases whose parts are frequent can be frequent. So words are counted first, then pairs of frequent words, then longer phrases
of frequent pairs, by 64-bit hashes and Bloom filters of what was frequent. The hashes only choose: texts of chosen phrases are counted
once more, exactly. A filter is at most ``max_filter_mb``; beyond that more phrases are counted than need be, and results are the same.

Defined cases: a null lang is ``und``, a null text is empty. Repeated rows count as often as they appear. A text without words has no
phrase. A phrase has single blanks between its words, whatever stood there. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.llm.bloom import HASHES, build, hits
from meshtide.llm.ngrams import FAR_POWERS, MIX, POWERS, blocks
from meshtide.llm.shared import Scratch, arrow_map, as_bytes, skewed_join

WORDS = 5  # longest phrase
OVERLAP = WORDS - 1
TRIGGER = 32  # words of a chunk, on average
LEAST = 100
TOP = 2000
HELD_BYTES = 48 << 20
HELD_ROWS = 4 << 20
# letters A-Z to lower case, piece ends to line feeds, tabs to blanks
PLAIN = np.arange(256, dtype=np.uint8)
PLAIN[65:91] += 32
PLAIN[np.frombuffer(b".,;:!?\n\v\f\r", np.uint8)] = 10
PLAIN[9] = 32


def spans(joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end byte of every word of plain bytes."""
    gap = (joined == 32) | (joined == 10)
    edge = np.diff(np.concatenate([[1], gap.astype(np.int8), [1]]))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX[0]
    return h ^ (h >> np.uint64(29))


def hashed(joined: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """A hash of every word."""
    if not len(first):
        return np.zeros(0, np.uint64)
    size = past - first
    starts = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(starts, size)
    wide = joined[np.repeat(first, size) + inside].astype(np.uint64) + np.uint64(1)
    h = np.add.reduceat(wide * POWERS[inside & 63] * FAR_POWERS[inside >> 6 & 63], starts)
    return mixed(h ^ size.astype(np.uint64) * MIX[1])


def joined_hash(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of every ``words`` neighbours; the last ``words`` - 1 places have none."""
    n = max(0, len(h) - words + 1)
    out = np.full(n, np.uint64(words))
    for j in range(words):
        out = mixed(out * MIX[2] + h[j:j + n])
    return out


def seeds(langs: list[str]) -> np.ndarray:
    known = {x: xxhash.xxh3_64_intdigest(x) for x in set(langs)}
    return np.fromiter((known[x] for x in langs), np.uint64, len(langs))


def _chunks(batches):
    """(lang, last, chunk, n): distinct chunks of what a task holds, and how often they occur. The last of a document has no overlap."""
    held: Counter = Counter()
    size = 0

    def out():
        keys = list(held)
        return {"lang": [k[0] for k in keys], "last": [k[1] for k in keys], "chunk": pa.array([k[2] for k in keys], pa.binary()), "n": list(held.values())}

    for b in batches:
        langs = b["lang"].to_pylist()
        for lo, hi, joined, ends in blocks(b["text"]):
            joined = PLAIN[joined]
            first, past = spans(joined)
            if not len(first):
                continue
            doc = np.searchsorted(ends, first)
            begin = np.concatenate([[True], doc[1:] != doc[:-1]])
            if len(first) >= OVERLAP:
                sign = joined_hash(hashed(joined, first, past), OVERLAP) % np.uint64(TRIGGER) == 0
                begin[:len(sign)] |= sign & (doc[:len(sign)] == doc[OVERLAP - 1:])
            at = np.flatnonzero(begin)
            following = np.concatenate([at[1:], [len(first)]])
            last = np.concatenate([doc[at[1:]] != doc[at[:-1]], [True]])
            stop = past[np.where(last, following - 1, np.minimum(following + OVERLAP, len(first)) - 1)]
            data = joined.tobytes()
            for s, e, final, d in zip(first[at].tolist(), stop.tolist(), last.tolist(), doc[at].tolist(), strict=True):
                key = (langs[lo + d], final, data[s:e])
                if key not in held:
                    size += e - s + 100
                held[key] += 1
            if size >= HELD_BYTES:
                yield out()
                held.clear()
                size = 0
    yield out()


def _word_counts(batches):
    """(lang, phrase, n) of the words that chunks own."""
    held: Counter = Counter()

    def out():
        return {"lang": [k[0] for k in held], "phrase": pa.array([k[1] for k in held], pa.binary()), "n": list(held.values())}

    for b in batches:
        by_lang: dict[str, Counter] = {}
        for lang, last, chunk, n in zip(b["lang"].to_pylist(), b["last"].to_pylist(), b["chunk"].to_pylist(), b["n"].to_pylist(), strict=True):
            words = chunk.split()
            own = words if last else words[:-OVERLAP]
            counts = by_lang.setdefault(lang, Counter())
            if n == 1:
                counts.update(own)
            else:
                for w in own:
                    counts[w] += n
        for lang, counts in by_lang.items():
            for w, n in counts.items():
                held[lang, w] += n
        if len(held) > 500_000:
            yield out()
            held.clear()
    yield out()


class Block:
    """The words of a run of chunks: hashes with their language in, which neighbours share a piece, and what each place counts for."""

    def __init__(self, langs: list[str], last: np.ndarray, n: np.ndarray, joined: np.ndarray, ends: np.ndarray):
        self.first, self.past = spans(joined)
        self.chunk = np.searchsorted(ends, self.first)
        piece = np.cumsum(joined == 10)[self.first] if len(self.first) else np.zeros(0, np.int64)  # a line feed stands between chunks, too
        self.tied = piece[1:] == piece[:-1]
        self.h = hashed(joined, self.first, self.past) ^ seeds(langs)[self.chunk]
        to_end = np.searchsorted(self.chunk, self.chunk, side="right") - np.arange(len(self.chunk))
        self.n = np.where(last[self.chunk] | (to_end > OVERLAP), n[self.chunk], 0)

    def places(self, words: int, fits: np.ndarray) -> np.ndarray:
        """Starts of phrases in one piece that count here, ``fits`` holding for each of their neighbouring pairs."""
        count = max(0, len(self.h) - words + 1)
        ok = self.n[:count] > 0
        for j in range(words - 1):
            ok &= fits[j:j + count]
        return np.flatnonzero(ok)


def chunk_blocks(b: dict):
    langs, last, n = b["lang"].to_pylist(), b["last"].to_numpy(zero_copy_only=False), b["n"].to_numpy()
    for lo, hi, joined, ends in blocks(b["chunk"]):
        yield lo, joined, Block(langs[lo:hi], last[lo:hi], n[lo:hi], joined, ends)


def _summed(parts):
    """Rows (h, n) of pairs of arrays, equal hashes added up for every HELD_ROWS of them."""

    def out(held):
        h = np.concatenate([np.zeros(0, np.uint64), *[x for x, _ in held]])
        n = np.concatenate([np.zeros(0, np.int64), *[x for _, x in held]])
        order = np.argsort(h)
        h, n = h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return {"h": h[first].view(np.int64), "n": np.add.reduceat(n, first) if len(h) else n}

    held, rows = [], 0
    for h, n in parts:
        held.append((h, n))
        rows += len(h)
        if rows >= HELD_ROWS:
            yield out(held)
            held, rows = [], 0
    yield out(held)


def _pairs(words):
    """Hash counts of pairs of frequent words."""

    def parts(batches):
        for b in batches:
            for _, _, x in chunk_blocks(b):
                often = hits(words.value, mixed(x.h))
                at = x.places(2, x.tied & often[1:] & often[:-1])
                yield joined_hash(x.h, 2)[at], x.n[at]

    return lambda batches: _summed(parts(batches))


def frequent_pairs(x: Block, pairs: np.ndarray) -> np.ndarray:
    ok = np.flatnonzero(x.tied)
    out = np.zeros(len(x.tied), bool)
    out[ok[hits(pairs, joined_hash(x.h, 2)[ok])]] = True
    return out


def _longer(pairs):
    """Hash counts of longer phrases of frequent pairs."""

    def parts(batches):
        for b in batches:
            for _, _, x in chunk_blocks(b):
                often = frequent_pairs(x, pairs.value)
                for k in range(3, WORDS + 1):
                    at = x.places(k, often)
                    yield joined_hash(x.h, k)[at], x.n[at]

    return lambda batches: _summed(parts(batches))


def _phrases(pairs, longer):
    """(lang, phrase, n): exact counts of the phrases whose hashes were frequent."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return {"lang": [k[0] for k in held], "phrase": pa.array([k[1] for k in held], pa.binary()), "n": list(held.values())}

        for b in batches:
            langs = b["lang"].to_pylist()
            for lo, joined, x in chunk_blocks(b):
                data, often = joined.tobytes(), frequent_pairs(x, pairs.value)
                for k in range(2, WORDS + 1):
                    at = x.places(k, often)
                    if k > 2:
                        at = at[hits(longer.value, joined_hash(x.h, k)[at])]
                    for s, e, c, n in zip(x.first[at].tolist(), x.past[at + k - 1].tolist(), x.chunk[at].tolist(), x.n[at].tolist(), strict=True):
                        held[langs[lo + c], data[s:e]] += n
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    return run


def parsed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The dictionary of the corpus: (lang, last, chunk, n)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), as_bytes().alias("text"))
    chunks = arrow_map(texts, _chunks, "lang string, last boolean, chunk binary, n long")
    return scratch.cut(chunks.groupBy("lang", "last", "chunk").agg(F.sum("n").alias("n")))


def counts(docs: DataFrame, scratch: Scratch, least: int = LEAST, max_filter_mb: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases of 1 to WORDS words with f >= ``least``; (lang, total) words of each lang. Stored tables."""
    context = docs.sparkSession.sparkContext
    dictionary = parsed(docs, scratch)
    words = scratch.cut(arrow_map(dictionary, _word_counts, "lang string, phrase binary, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("f")), few=True)
    totals = scratch.cut(words.groupBy("lang").agg(F.sum("f").alias("total")), few=True)
    words = words.where(F.col("f") >= least)

    def word_hashes(batches):
        for b in batches:
            for lo, hi, joined, ends in blocks(b["phrase"]):
                yield {"h": mixed(hashed(joined, *spans(joined)) ^ seeds(b["lang"].to_pylist()[lo:hi])).view(np.int64)}

    def filtered(h: DataFrame):
        return context.broadcast(build(h, twice=False, max_mb=max_filter_mb))

    common = filtered(scratch.cut(arrow_map(words, word_hashes, HASHES), few=True))
    often = lambda rows: scratch.cut(rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h"), few=True)
    pairs = filtered(often(arrow_map(dictionary, _pairs(common), "h long, n long")))
    longer = filtered(often(arrow_map(dictionary, _longer(pairs), "h long, n long")))
    found = arrow_map(dictionary, _phrases(pairs, longer), "lang string, phrase binary, n long")
    # between words stand blanks only: several are one
    found = found.select("lang", F.regexp_replace(F.col("phrase").cast("string"), " +", " ").alias("phrase"), "n")
    found = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    every = scratch.cut(words.select("lang", F.col("phrase").cast("string").alias("phrase"), "f").unionByName(found), few=True)
    scratch.drop(dictionary)
    return every, totals


def with_count(rows: DataFrame, every: DataFrame, part: str, name: str, scratch: Scratch) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``; a part that many phrases have is met by a broadcast row."""
    rows = scratch.cut(rows, few=True)
    keys = rows.groupBy("lang", part).agg(F.count("*").alias("n"))
    keys = scratch.cut(keys.join(every.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part]), few=True)
    return skewed_join(rows, keys, ["lang", part]).drop("n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, max_filter_mb: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best ``top`` phrases."""
    with Scratch(docs.sparkSession) as scratch:
        every, totals = counts(docs, scratch, least, max_filter_mb)
        size = F.size(F.split("phrase", " "))
        cand = every.where(size > 1).select("lang", "phrase", F.col("f").alias("a"))
        # a longer phrase that holds this one as often has one with one word more between them that does, too
        tail, head = F.expr("substring(phrase, locate(' ', phrase) + 1)"), F.expr(f"substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)")
        inside = every.where(size > 2).select("lang", F.explode(F.array(tail, head)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
        cand = scratch.cut(cand.join(inside, ["lang", "phrase"], "left").where("longer is null or 100 * longer < 100 * a").drop("longer"), few=True)

        cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
        cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("tail", F.expr("substring(phrase, length(head) + 2)"))
        cuts = with_count(with_count(cuts, every, "head", "l", scratch), every, "tail", "r", scratch)
        cuts = scratch.cut(cuts.drop("head", "tail"), few=True)
        totals = scratch.cut(cuts.groupBy("lang").agg(F.count("*").alias("n")).join(totals, "lang"), few=True)
        wide = lambda c: F.col(c).cast("decimal(19,0)")
        cuts = skewed_join(cuts, totals, ["lang"]).withColumn("top", wide("a") * wide("total") * 1000).withColumn("bottom", wide("l") * wide("r"))
        best = F.min(F.struct(F.expr("top div bottom").alias("score"), "k", "l", "r")).alias("cut")
        scored = scratch.cut(cuts.groupBy("lang", "phrase", "a", "total").agg(best).select("lang", "phrase", "a", F.col("total").alias("n"), "cut.*"), few=True)

        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        # the first ones of each part of a lang, then of the lang: no task sorts a whole lang
        parts = F.lit(1 + int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        scored = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), parts))
        scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        out = scratch.cut(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), few=True)
        scratch.keep(out)
    return out


SQL = r"""
WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, row_number() OVER () AS piece, ws
  FROM (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS ws FROM texts)),
words AS (SELECT lang, piece, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM pieces),
places AS (SELECT lang, w AS w1, lead(w, 1) OVER s AS w2, lead(w, 2) OVER s AS w3, lead(w, 3) OVER s AS w4, lead(w, 4) OVER s AS w5
           FROM words WINDOW s AS (PARTITION BY piece ORDER BY p)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, 1 AS k, w1 AS phrase FROM places
        UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM places WHERE w2 IS NOT NULL
        UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM places WHERE w3 IS NOT NULL
        UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM places WHERE w4 IS NOT NULL
        UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM places WHERE w5 IS NOT NULL) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
inside AS (SELECT lang, array_to_string(ws[i:j], ' ') AS phrase, max(a) AS longer FROM cand, range(1, 6) x(i), range(1, 6) y(j)
           WHERE j > i AND j <= k AND j - i + 1 < k GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a),
parts AS (SELECT kept.*, cut, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail FROM kept, range(1, 5) s(cut) WHERE cut < k),
cuts AS (SELECT p.lang, p.phrase, a, t.n, cut, x.f AS l, y.f AS r, (1000::HUGEINT * a * t.n) // (x.f::HUGEINT * y.f) AS score
         FROM parts p JOIN totals t ON t.lang = p.lang JOIN f x ON x.lang = p.lang AND x.phrase = head JOIN f y ON y.lang = p.lang AND y.phrase = tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000"""


def brute_force(rows: list[tuple[str | None, str | None]], least: int = LEAST, top: int = TOP) -> list[tuple]:
    """The same rows from one dictionary of all phrases, for tests."""
    import re

    f: Counter = Counter()
    for lang, text in rows:
        lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            for k in range(1, WORDS + 1):
                f.update(("und" if lang is None else lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    total: Counter = Counter()
    for (lang, words), n in f.items():
        total[lang] += n if len(words) == 1 else 0
    cand = {k: n for k, n in f.items() if len(k[1]) > 1 and n >= least}
    contained = {(lang, words[i:j]) for (lang, words), n in cand.items() for i in range(len(words)) for j in range(i + 2, len(words) + 1)
                 if j - i < len(words) and 100 * n >= 100 * f[lang, words[i:j]]}
    found: dict[str, list] = {}
    for (lang, words), a in cand.items():
        if (lang, words) not in contained:
            score, _, left, right = min((1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
                                        for k in range(1, len(words)))
            found.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return [(lang, i + 1, p.decode(), -a, left, right, total[lang], -score) for lang, v in found.items() for i, (score, a, p, left, right) in enumerate(sorted(v)[:top])]
