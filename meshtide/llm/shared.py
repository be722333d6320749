"""Helpers of the operators: input, shared intermediate tables, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; the warehouse, which is shared as well, where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def delete_folder(spark: SparkSession, where: str) -> None:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fewer_files(df: DataFrame) -> DataFrame:
    """For rows much smaller than the shuffle before them: an eighth of its partitions, but a task for every core.

    A task then goes through several partitions, one after the other, and writes one file.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


class Scratch:
    """Tables of one call in the shared folder; they outlive lost executors.

    Leaving the ``with`` block drops every table but those passed to ``keep``, which a returned frame still
    reads; after an error all of them go. ``release`` drops kept ones when their reader is done.
    """

    kept: list[tuple[SparkSession, str]] = []

    def __init__(self, spark: SparkSession):
        self.spark, self.made = spark, []

    def new_folder(self) -> str:
        where = f"{shared_folder(self.spark)}/llm-{uuid.uuid4().hex}"
        self.made.append(where)
        return where

    def cut(self, df: DataFrame, few: bool = False) -> DataFrame:
        """Write ``df`` and read it back: no lineage before this point is run again.

        ``few``: for a table much smaller than the shuffle before it, fewer and larger files.
        """
        where = self.new_folder()
        df = fewer_files(df) if few else df
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out._scratch = where
        return out

    def drop(self, df: DataFrame) -> None:
        self.made.remove(df._scratch)
        delete_folder(self.spark, df._scratch)

    def keep(self, where: str | DataFrame) -> None:
        where = where if isinstance(where, str) else where._scratch
        self.made.remove(where)
        Scratch.kept.append((self.spark, where))

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for where in self.made:
            delete_folder(self.spark, where)


def release() -> None:
    """Drop the tables that returned frames were still reading."""
    while Scratch.kept:
        delete_folder(*Scratch.kept.pop())


def as_bytes(col: str = "text") -> Column:
    """The UTF-8 bytes of a text, null as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session end at BATCH_BYTES, too, and not only at a number of rows: rows here are whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[dict[str, pa.Array]]], Iterable[dict]], schema: str, holds: bool = False) -> DataFrame:
    """``mapInArrow`` with columns by name on both sides; ``schema`` is DDL. ``holds``: ``fn`` uses values of ``per_worker``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    bounded_batches(df.sparkSession)
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    fields = to_arrow_schema(spark_schema)

    def run(batches):
        release_worker(keep=holds)
        try:
            for out in fn({n: b.column(i) for i, n in enumerate(b.schema.names)} for b in batches):
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c := out[f.name], pa.Array) else pa.array(c, f.type) for f in fields], schema=fields)
        finally:
            release_worker(keep=holds)

    return df.mapInArrow(run, spark_schema)


def skewed_join(rows: DataFrame, counted: DataFrame, on: list[str]) -> DataFrame:
    """Inner join of the stored table ``rows`` with ``counted``, one row per key with its number ``n`` of rows there.

    Keys above a 1/2000 share of all rows are at most 2000 and are broadcast; no other key is large in a task.
    """
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") >= max(1000, total // 2000)
    hot = F.broadcast(counted.where(often))
    return rows.join(hot, on).unionByName(rows.join(hot, on, "left_anti").join(counted.where(~often), on))


def _worker_state() -> dict:
    # task functions are shipped by value, so a task's module globals are its own; a module of the process holds the values
    return sys.modules.setdefault("meshtide_worker_state", types.ModuleType("meshtide_worker_state")).__dict__.setdefault("held", {})


def per_worker(key: tuple, make: Callable[[], object]) -> object:
    """One value per key and Python process, for all its tasks until one comes that holds none."""
    held = _worker_state()
    if key not in held:
        held[key] = make()
    return held[key]


def release_worker(keep: bool = False) -> None:
    """Give unused memory of this Python process back to the system, with ``per_worker``'s values unless ``keep``.

    Workers outlive their tasks: what a stage leaves in them would count in all later ones.
    """
    if not keep and _worker_state():
        _worker_state().clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)
