"""Order-free stochastic rounding offsets: a splitmix64 finaliser of the lattice position.

Spark's bigint multiply raises on overflow, and limb arithmetic inside a fused stage outgrows
what the JVM compiles, so the 64-bit wrap-around products run on NumPy columns in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Axis multipliers, key multiplier and the two splitmix64 mixing multipliers.
AXIS_MUL = {"x": 0x9E3779B97F4A7C15, "y": 0xC2B2AE3D27D4EB4F, "z": 0x165667B19E3779F9}
KEY_MUL = 0xD6E8FEB86659FD93
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
MASK64 = 2**64 - 1


def drift_key(step: int | None, after_snapshot: bool = False) -> int:
    """Key of a run's drift: 0 for the lead drift, step + 1, and + 2^32 after a snapshot."""
    if step is None:
        return 0
    return step + 1 + (2**32 if after_snapshot else 0)


def with_dither(df: DataFrame, key: int, out: str = "u") -> DataFrame:
    """Add u_x, u_y, u_z in [0, 1) from jx, jy, jz and the drift's key (names: ``{out}_{axis}``)."""
    salts = [(key * 3 + axis) * KEY_MUL & MASK64 for axis in (1, 2, 3)]
    spread, mix = list(AXIS_MUL.values()), MIX

    def offsets(jx: pd.Series, jy: pd.Series, jz: pd.Series) -> pd.DataFrame:
        u64 = np.uint64
        with np.errstate(over="ignore"):
            parts = [j.to_numpy().astype(u64) * u64(m) for j, m in zip((jx, jy, jz), spread)]
            h = parts[0] ^ parts[1] ^ parts[2]
            cols = {}
            for axis, salt in zip("xyz", salts):
                z = h ^ u64(salt)
                for shift, m in zip((30, 27), mix):
                    z = (z ^ (z >> u64(shift))) * u64(m)
                z ^= z >> u64(31)
                cols[axis] = (z >> u64(11)).astype(np.float64) * 2.0**-53
        return pd.DataFrame(cols)

    udf = F.pandas_udf(offsets, "x double, y double, z double")
    rows = df.withColumn("_u", udf("jx", "jy", "jz"))
    return rows.select(*df.columns, *(F.col(f"_u.{a}").alias(f"{out}_{a}") for a in "xyz"))
