"""Particle views of tables, and generated lattices and noise."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.functions.lattice import div

SIDE = 4096
STEP = 2.0**-7  # 32 / 4096

# Integer lattice coordinates and dyadic velocities from table columns.
VIEWS = {
    "lineitem": {
        "jx": "(l_orderkey * 2654435 + l_linenumber * 40503) % 4096",
        "jy": "(l_partkey * 97 + l_suppkey * 13) % 4096",
        "jz": "cast(round(l_extendedprice * 100) as bigint) % 4096",
        "vx": "(l_quantity - 25) / 64",
        "vy": "(round(l_discount * 100) - 5) / 16",
        "vz": "(round(l_tax * 100) - 4) / 16",
    },
    "orders": {
        "jx": "(o_orderkey * 1299709 + o_custkey * 31) % 4096",
        "jy": "(o_custkey * 7907 + o_orderkey * 17) % 4096",
        "jz": "cast(round(o_totalprice * 100) as bigint) % 4096",
        "vx": "(o_orderkey % 101 - 50) / 32",
        "vy": "(o_custkey % 67 - 33) / 32",
        "vz": "(o_orderkey % 29 - 14) / 16",
    },
    "events": {
        "jx": "(event_id * 104729) % 4096",
        "jy": "(user_id * 7919 + event_id * 13) % 4096",
        "jz": "(cast(round(abs(value) * 1000) as bigint) + event_id * 7) % 4096",
        "vx": "(event_id % 61 - 30) / 16",
        "vy": "(user_id % 41 - 20) / 16",
        "vz": "(event_id % 17 - 8) / 8",
    },
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def particles(spark: SparkSession, sf_dir: str, table: str = "lineitem",
              keep: list[str] | None = None) -> DataFrame:
    """x, y, z in [0, 32) and vx, vy, vz, from a table's columns; pure projection."""
    view = VIEWS[table]
    cols = [F.expr(f"cast({view['j' + a]} as double) * {STEP!r}D").alias(a) for a in "xyz"]
    cols += [F.expr(f"cast({view['v' + a]} as double)").alias(f"v{a}") for a in "xyz"]
    return read_table(spark, sf_dir, table).select(*(keep or []), *cols)


def particles_sql(table: str = "lineitem", keep: str = "") -> str:
    """The same view as a SQL query."""
    v = VIEWS[table]
    pos = ", ".join(f"cast({v['j' + a]} as double) * {STEP!r} as {a}" for a in "xyz")
    vel = ", ".join(f"cast({v['v' + a]} as double) as v{a}" for a in "xyz")
    return f"select {keep + ', ' if keep else ''}{pos}, {vel} from {table}"


def lagrangian_grid(spark: SparkSession, n: int, box: float) -> DataFrame:
    """Unperturbed positions, one particle per cell of an n^3 lattice."""
    i, cell = F.col("id"), F.lit(box / n)
    ix, iy, iz = div(i, n * n), div(i, n) % n, i % n
    return spark.range(n**3).select(
        "id", ix.alias("ix"), iy.alias("iy"), iz.alias("iz"),
        (ix * cell).alias("x"), (iy * cell).alias("y"), (iz * cell).alias("z"),
    )


def white_noise(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """Unit normal mesh in pencil rows; a plane depends only on (seed, plane index)."""

    def draw(batches):
        for b in batches:
            for ix in b.column("id").to_pylist():
                plane = np.random.Generator(np.random.Philox(key=[seed, ix])).standard_normal((n, n))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, ix), pa.int64()), pa.array(np.arange(n), pa.int64()),
                     pa.array(list(plane), pa.list_(pa.float64()))],
                    names=["ix", "iy", "white"],
                )

    parts = min(n, spark.sparkContext.defaultParallelism * 4)
    return spark.range(0, n, 1, parts).mapInArrow(draw, "ix long, iy long, white array<double>")
