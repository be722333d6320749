"""Lattice codec as Column expressions (half-even rounding, modular wrap, no clamping)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshtide.config import CODE_MAX, LEVELS_PER_BUCKET, Geometry, Lattice

AXES = ("x", "y", "z")


def rint_long(c: Column) -> Column:
    return F.rint(c).cast("long")


def lattice_index(pos: Column, lat: Lattice) -> Column:
    """Nearest lattice level of a position, wrapped into [0, levels)."""
    return F.pmod(rint_long(pos / F.lit(lat.quantum)), F.lit(lat.levels))


def bucket_of(index: Column) -> Column:
    return F.shiftright(index, 8)


def offset_of(index: Column) -> Column:
    return index.bitwiseAND(LEVELS_PER_BUCKET - 1)


def level_of(bucket: Column, offset: Column) -> Column:
    return bucket * LEVELS_PER_BUCKET + offset


def position_of(index: Column, lat: Lattice) -> Column:
    return index.cast("double") * F.lit(lat.quantum)


def div(a: Column, b: int) -> Column:
    """Integer division of non-negative values."""
    return F.floor(a / F.lit(b)).cast("long") if b & (b - 1) else F.shiftright(a, b.bit_length() - 1)


def with_lattice(df: DataFrame, lat: Lattice) -> DataFrame:
    """Add jx, jy, jz: the lattice indices of x, y, z."""
    return df.withColumns({f"j{a}": lattice_index(F.col(a), lat) for a in AXES})


def flat(x: Column, y: Column, z: Column, n: int) -> Column:
    return (x * n + y) * n + z


def no_position() -> Column:
    """Raises, in place of the key of a row without a position."""
    return F.raise_error(F.lit("a particle has a null position")).cast("long")


def with_keys(df: DataFrame, g: Geometry) -> DataFrame:
    """Add ``brick`` and ``bucket`` (brick-major ordinal) from jx, jy, jz."""
    per, nb = g.buckets_per_brick_side, g.bricks
    b = {a: bucket_of(F.col(f"j{a}")) for a in AXES}
    brick = flat(*(div(b[a], per) for a in AXES), nb)
    within = flat(*(b[a] - div(b[a], per) * per for a in AXES), per)
    # a non-null key spares joins on it a null filter, which would copy the whole expression down
    brick = F.coalesce(brick, no_position())
    return df.withColumn("brick", brick).withColumn("bucket", F.coalesce(F.col("brick") * per**3 + within, no_position()))


def bucket_axes(bucket: Column, g: Geometry) -> dict[str, Column]:
    """Per-axis bucket indices from the brick-major ordinal."""
    per, nb = g.buckets_per_brick_side, g.bricks
    brick, within = div(bucket, per**3), bucket % per**3
    bx, by, bz = div(brick, nb * nb), div(brick, nb) % nb, brick % nb
    wx, wy, wz = div(within, per * per), div(within, per) % per, within % per
    return {"x": bx * per + wx, "y": by * per + wy, "z": bz * per + wz}


def brick_axes(brick: Column, nb: int) -> dict[str, Column]:
    return {"x": div(brick, nb * nb), "y": div(brick, nb) % nb, "z": brick % nb}


def encode_positions(df: DataFrame, g: Geometry) -> DataFrame:
    """x, y, z -> brick, bucket, off_x, off_y, off_z."""
    keyed = with_keys(with_lattice(df, g.lattice), g)
    return keyed.withColumns({f"off_{a}": offset_of(F.col(f"j{a}")) for a in AXES})


def decode_positions(df: DataFrame, g: Geometry) -> DataFrame:
    """brick-major bucket and offsets -> x, y, z (one multiply of the global level)."""
    b = bucket_axes(F.col("bucket"), g)
    return df.withColumns(
        {a: position_of(level_of(b[a], F.col(f"off_{a}")), g.lattice) for a in AXES}
    )


def speed_max(prefix: str = "v") -> Column:
    return F.greatest(*(F.abs(F.col(f"{prefix}{a}")) for a in AXES))


def scale_from_max(vmax: Column) -> Column:
    """max|v| / 32767, and 1 where everything is at rest."""
    s = vmax / F.lit(float(CODE_MAX))
    return F.when(s > 0.0, s).otherwise(F.lit(1.0))


def checked_code(code: Column) -> Column:
    """Raise on a velocity code outside int16; never wrap or clamp it."""
    ok = (code >= -CODE_MAX - 1) & (code <= CODE_MAX)
    msg = F.concat(F.lit("velocity code outside int16: "), code.cast("string"))
    return F.when(ok, code).otherwise(F.raise_error(msg).cast("long"))


def encode_velocity(v: Column, scale: Column) -> Column:
    return checked_code(rint_long(v / scale))


def rescale_code(w: Column, old: Column, new: Column) -> Column:
    """Re-express a code at a new scale with one rounding (0 where the new scale is not positive)."""
    ratio = F.when(new > 0.0, old / new).otherwise(F.lit(0.0))
    return checked_code(rint_long(w.cast("double") * ratio))


def minimum_image(d: Column, box: float) -> Column:
    return d - F.lit(box) * F.rint(d / F.lit(box))
