"""Skew-safe ranking and sorting.

A window over a group that holds a third of all rows would run in one task.  Here rows are range
partitioned on (group, order), each partition is numbered locally, and per-partition offsets turn
local numbers into a global order; ranks inside a group follow by subtracting the group's start.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.session import durable, release


def global_order(df: DataFrame, order: list[str], parts: int | None = None) -> DataFrame:
    """Add ``ordinal``: 0-based position in the order of the given columns (ties in any order)."""
    spark = df.sparkSession
    # a stored tie-break lets range partitioning split equal rows, and a retry cannot change it
    tied = durable(df.withColumn("_tie", F.monotonically_increasing_id()))
    if parts is None:
        # a partition numbers its rows in 33 bits; this keeps it far below
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tied.count() >> 24)
    placed = tied.repartitionByRange(parts, *order, "_tie").sortWithinPartitions(*order, "_tie")
    local = durable(placed.drop("_tie").withColumn("_id", F.monotonically_increasing_id()))
    release(tied)
    local = local.withColumn("_pid", F.shiftright("_id", 33))
    sizes = local.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # one row per partition: at most ``parts`` rows
    out = local.join(F.broadcast(starts), "_pid")
    ordinal = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("ordinal", ordinal).select(*df.columns, "ordinal")


def prefix_sums(sizes: DataFrame, key: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """Exclusive prefix sum of ``value`` over an integer ``key``, in two levels.

    Keys are summed in blocks; only the block totals meet in one window.
    """
    tagged = sizes.withColumn("_b", F.floor(F.col(key) / block).cast("long"))
    totals = tagged.groupBy("_b").agg(F.sum(value).alias("_t"))
    earlier = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_b", F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_in", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = local.join(bases, "_b")
    return joined.withColumn(out, F.col("_base") + F.col("_in")).select(*sizes.columns, out)


def ranked(df: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """Add the 0-based rank of each row inside its integer ``group``."""
    ordered = global_order(df, [group, *order])
    sizes = ordered.groupBy(group).agg(F.count(F.lit(1)).alias("_size"))
    starts = prefix_sums(sizes, group, "_size", "_first").select(group, "_first")
    joined = ordered.join(starts, group)
    return joined.withColumn(out, F.col("ordinal") - F.col("_first")).select(*df.columns, out)


def _narrowed(rows: DataFrame, group: list[str], probs: dict[str, float], accuracy: int, width: float | None) -> DataFrame:
    """(*group, name, place, _v, _c): the distinct values around each wanted place with their counts.

    A sketch of every group brackets the place; what lies below the bracket is one row with a null value, what lies above
    goes.  Rows are counted before they are shuffled.  Without a width everything is kept.
    """
    spread = 1.0 if width is None else width / accuracy
    ends = [e for p in probs.values() for e in (max(p - spread, 0.0), min(p + spread, 1.0))]
    sketch = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_q"))
    none = F.lit(None).cast("double")
    brackets = F.array(*(F.struct(
        F.lit(k).alias("name"), ((F.col("_n") - 1) * F.lit(float(p))).alias("place"),
        (none if p - spread <= 0.0 else F.col("_q")[2 * i]).alias("lo"), (none if p + spread >= 1.0 else F.col("_q")[2 * i + 1]).alias("hi"))
        for i, (k, p) in enumerate(probs.items())))
    own = sketch.select(*(F.col(c).alias(f"_g_{c}") for c in group), brackets.alias("_b"))
    if group:
        met = rows.join(own, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group)))
    else:
        met = rows.join(F.broadcast(own))  # one row
    met = met.select(*group, "_v", F.explode(F.filter("_b", lambda b: b["hi"].isNull() | (F.col("_v") <= b["hi"]))).alias("_b"))
    inside = F.when(F.col("_b.lo").isNull() | (F.col("_v") >= F.col("_b.lo")), F.col("_v"))
    return met.groupBy(*group, F.col("_b.name").alias("name"), F.col("_b.place").alias("place"), inside.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def percentiles(df: DataFrame, value: str, probs: dict[str, float], group: list[str] | None = None, accuracy: int = 10000) -> DataFrame:
    """Exact interpolated percentiles of the values that are not null: one row per group, or one in all.

    Selection without sorting: a first pass sketches each group, a second one counts what lies below and inside the sketch's
    bracket of each place.  Only distinct values inside brackets, about 8 of ``accuracy`` of the rows, are stored and ordered, over
    range partitions.  Counts prove that a bracket holds its place; where one does not, all are widened, at last to the whole.
    Null groups count as a group; NaN lies above all numbers; without any value a single row of nulls is returned where there are no groups.
    """
    group = group or []
    rows = df.select(*group, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    low, high = F.floor("place"), F.ceil("place")
    for width in (4.0, 64.0, None):
        narrow = durable(_narrowed(rows, group, probs, accuracy, width))
        held = narrow.groupBy(*group, "name", "place").agg(
            F.sum(F.when(F.col("_v").isNull(), F.col("_c")).otherwise(0)).alias("below"), F.sum("_c").alias("upto"))
        if width is None or held.filter((F.col("below") > low) | (F.col("upto") <= high)).isEmpty():
            break
        release(narrow)
    ordered = prefix_sums(global_order(narrow, [*group, "name", "_v"]), "ordinal", "_c", "_before")
    first = ordered.groupBy(*group, "name").agg(F.min("_before").alias("_first"))
    first = first.select("_first", *(F.col(c).alias(f"_g_{c}") for c in (*group, "name")))
    placed = ordered.join(first, reduce(and_, (F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in (*group, "name"))))
    placed = placed.withColumn("_from", F.col("_before") - F.col("_first")).withColumn("_k", F.explode(F.array_distinct(F.array(low, high))))
    found = placed.filter((F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_from") + F.col("_c")))
    share = 1.0 - F.abs(F.col("_k") - F.col("place"))  # of the two neighbours; 1 on a place
    out = found.groupBy(*group).agg(*(F.sum(F.when(F.col("name") == k, share * F.col("_v"))).alias(k) for k in probs))
    return out.select(*group, *probs)
