"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Every document of a source is expected target / source_size times. Documents of a source stand in a fixed order; the
expected copies before a document are its ordinal times that rate; with one offset per source, a document goes out
once for each whole number that the running sum crosses. The order is by size class first (eight classes to a factor
of two), so the words taken follow the target, and by a hash within a class. The ordinal is a sum over three levels,
class in source, hash block in class, row in block, so that no window holds a whole source.

Defined cases: a null text has size 0, and a null source is a source of its own, ranked last. A source without words
has target 0 and nothing is taken from it. Documents of equal doc_id and size are alike: which of them gets a copy
cannot be seen in the result. Reruns and other partitionings give the same result. An empty table gives an empty one.
``mix`` keeps all input columns; ``plan`` uses only doc_id, text and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshtide.llm.shared import Scratch, fewer_files

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def offset(key: Column, seed: int) -> Column:
    """One number in [0, 1) per source, in steps of 2^-24."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 6), 16, 10).cast("double") / F.lit(float(1 << 24))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(key, source, source_size) to (key, source_size, target): the fill level where capped shares sum to all sizes.

    Sources are few next to documents; this is one window over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    rows = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("w", weight)
    # in order of the level at which a source is full
    full = Window.orderBy(F.col("source_size") * F.lit(most) / F.col("w"), "rank")
    before, after = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    left = total - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * most
    rows = rows.withColumn("level", left.cast("double") / F.sum("w").over(after))
    fits = F.when(F.col("level") * F.col("w") <= F.col("source_size") * most, F.col("level"))
    level = F.first(fits, ignorenulls=True).over(full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least((F.col("source_size") * most).cast("double"), level * F.col("w"))
    return rows.select("key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def plan(docs: DataFrame, seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target and copies per row, and the struct ``_row`` of the columns ``keep``."""
    sized = docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"), size_of().alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), *([F.struct(*keep).alias("_row")] if keep else []))
    top_bits = F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0))").cast("int")
    sized = sized.withColumn("class", F.length(F.bin("size")) * 16 + top_bits).withColumn("block", F.substring("h", 1, 2))
    cell = ["key", "class", "block"]
    with Scratch(docs.sparkSession) as scratch:
        cells = scratch.cut(sized.groupBy(*cell).agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.first("source").alias("source")), few=True)
        scratch.keep(cells)
    classes = cells.groupBy("key", "class").agg(F.sum("n").alias("n"))
    sources = targets(cells.groupBy("key").agg(F.sum("s").alias("source_size"), F.first("source").alias("source")))
    in_source, in_class = Window.partitionBy("key").orderBy("class"), Window.partitionBy("key", "class").orderBy("block")
    classes = classes.select("key", "class", (F.sum("n").over(in_source) - F.col("n")).alias("c"))
    starts = cells.select(*cell, (F.sum("n").over(in_class) - F.col("n")).alias("b")).join(classes, ["key", "class"]).join(sources, "key")
    starts = starts.select(*cell, "source_size", "target", (F.col("b") + F.col("c")).alias("start"))
    rows = sized.withColumn("i", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "doc_id", "size")) - 1)
    placed = rows.join(starts, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    at = F.col("start") + F.col("i")
    crossed = F.floor(rate * (at + 1) + offset(F.col("key"), seed)) - F.floor(rate * at + offset(F.col("key"), seed))
    copies = F.least(crossed, F.lit(MOST)).cast("long")  # rounding of a rate just under MOST may cross once more
    return placed.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *(["_row"] if keep else []))


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix: whole rows of ``docs``, each as many times as it is taken."""
    taken = plan(docs, seed, keep=docs.columns).where("copies > 0")
    each = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])


def digests(docs: DataFrame) -> DataFrame:
    """The query's columns."""
    return fewer_files(plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")))


SQL = r"""
WITH sized AS (
  SELECT doc_id, coalesce('s' || source, 'n') AS key, source, md5(coalesce(doc_id::VARCHAR, '')) AS h,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
classed AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS class FROM sized),
sources AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sources),
rows AS (SELECT *, (rank - 1) % 3 + 1 AS w FROM weighed),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(w) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM rows WINDOW f AS (ORDER BY source_size * 3 / w, rank)),
level AS (SELECT arg_min(level, (source_size * 3 / w, rank)) AS level FROM levels WHERE level * w <= source_size * 3),
targets AS (SELECT key, source_size, coalesce(least((source_size * 3)::DOUBLE, l.level * w), 0.0) AS target FROM rows, level l),
placed AS (SELECT c.*, t.source_size, t.target, row_number() OVER (PARTITION BY key ORDER BY class, h, doc_id, size) - 1 AS i,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
           ('0x' || substr(md5('7:' || key), 1, 6))::BIGINT / 16777216.0::DOUBLE AS u
           FROM classed c JOIN targets t USING (key))
SELECT doc_id, size, source_size, target, least(floor(rate * (i + 1) + u) - floor(rate * i + u), 3)::BIGINT * size AS taken FROM placed"""
