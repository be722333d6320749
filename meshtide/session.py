"""Session helpers: a local session for tests, and lineage cuts through tables in a shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_TABLES: dict[int, tuple[DataFrame, str]] = {}


def local_session(cores: int = 8, name: str = "meshtide") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"{tempfile.gettempdir()}/meshtide-{os.getpid()}")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which is shared as well."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_meshtide"


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through a table in the checkpoint folder.

    The table outlives executors, so a lost one costs a re-read and never a recomputation; later
    stages read only the columns they need.  ``release`` drops it once it is superseded, ``tables_freed``
    when the frames that read it have been used.
    """
    spark = df.sparkSession
    where = f"{checkpoint_dir(spark)}/meshtide-{uuid.uuid4().hex}"
    try:
        df.write.parquet(where)
    except Exception:
        _delete(spark, where)
        raise
    out = spark.read.schema(df.schema).parquet(where)
    _TABLES[id(out)] = (out, where)
    return out


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*frames: DataFrame) -> None:
    """Delete the tables behind frames that ``durable`` made; other frames are left alone."""
    for df in frames:
        held = _TABLES.pop(id(df), None)
        if held is not None:
            _delete(df.sparkSession, held[1])


@contextmanager
def tables_freed() -> Iterator[None]:
    """Drop, at the end of the block or on an error in it, every table made inside: use a query's result within."""
    before = set(_TABLES)
    try:
        yield
    finally:
        release(*[df for key, (df, _) in list(_TABLES.items()) if key not in before])
