"""Mass deposit: particles -> mesh cells.

Particles are first summed per *base cell* (one wide aggregate with map-side combine, so a cell
holding a third of all particles costs one partial row per task).  Only these per-cell rows are
then spread over the stencil.  The fixed-point deposit is integer, hence independent of row
order, partitioning and retries, and every particle contributes exactly ``2**frac_bits`` units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.functions.lattice import div
from meshtide.functions.stencil import REACH, code_sql, slots, weight_sql, with_stencil


def _spread(base: DataFrame, scheme: str, n: int, values: list[str], keys: list[str]) -> DataFrame:
    """Move per-base-cell corner sums ``{value}_{slot}`` to their target cells and add them up."""
    reach = REACH[scheme]
    w, first = len(reach), reach[0]
    arrays = [F.array(*(F.col(f"{v}_{t}") for t in range(w**3))).alias(v) for v in values]
    packed = base.select(*keys, "cx", "cy", "cz", *arrays)
    if len(values) == 1:
        rows = packed.select(*keys, "cx", "cy", "cz", F.posexplode(values[0]).alias("t", values[0]))
    else:
        rows = packed.select(*keys, "cx", "cy", "cz", F.posexplode(F.arrays_zip(*values)).alias("t", "v"))
        rows = rows.select(*keys, "cx", "cy", "cz", "t", *(F.col(f"v.{v}").alias(v) for v in values))
    at = [f"pmod(cx + (t div {w * w}) + ({first}), {n}L)",
          f"pmod(cy + (t div {w}) % {w} + ({first}), {n}L)", f"pmod(cz + t % {w} + ({first}), {n}L)"]
    cell = F.expr(f"({at[0]} * {n} + {at[1]}) * {n} + {at[2]}").alias("cell")
    summed = rows.groupBy(*keys, cell).agg(*(F.sum(v).alias(v) for v in values))
    c = F.col("cell")
    return summed.select(*keys, div(c, n * n).alias("ix"), (div(c, n) % n).alias("iy"),
                         (c % n).alias("iz"), *values)


def corner_sums(particles: DataFrame, scheme: str, n: int, box: float, frac_bits: int = 12,
                keys: list[str] | None = None) -> DataFrame:
    """Per base cell: the summed fixed-point code of every corner, exact in total mass.

    The corner nearest each particle takes 2^frac_bits minus the other corners' codes; summed
    over the particles of a cell that is ``2^frac_bits * count`` minus the other sums.
    """
    keys = list(keys or [])
    ss = slots(scheme)
    st = with_stencil(particles, scheme, n, box)
    group = [*keys, "cx", "cy", "cz"]
    if scheme == "cic":
        near = "cast(if(dx >= 0.5D, 4, 0) + if(dy >= 0.5D, 2, 0) + if(dz >= 0.5D, 1, 0) as int)"
        st = st.withColumn("near", F.expr(near))
        group.append("near")
    sums = [F.expr(f"sum({code_sql(s, frac_bits)})").alias(f"r_{t}") for t, s in enumerate(ss)]
    agg = st.groupBy(*group).agg(F.count(F.lit(1)).alias("m"), *sums)
    total = " + ".join(f"r_{t}" for t in range(len(ss)))
    unit = 2**frac_bits
    agg = agg.withColumn("excess", F.expr(f"m * {unit}L - ({total})"))
    if scheme == "tsc":
        centre = len(ss) // 2
        fixed = [F.expr(f"r_{t}" + (" + excess" if t == centre else "")).alias(f"q_{t}")
                 for t in range(len(ss))]
        return agg.select(*keys, "cx", "cy", "cz", "m", *fixed)
    fixed = [F.expr(f"r_{t} + if(near = {t}, excess, 0L)").alias(f"q_{t}") for t in range(len(ss))]
    per_near = agg.select(*keys, "cx", "cy", "cz", "m", *fixed)
    return per_near.groupBy(*keys, "cx", "cy", "cz").agg(
        F.sum("m").alias("m"), *(F.sum(f"q_{t}").alias(f"q_{t}") for t in range(len(ss)))
    )


def deposit_int(particles: DataFrame, scheme: str, n: int, box: float, frac_bits: int = 12
                ) -> DataFrame:
    """Fixed-point deposit: (ix, iy, iz, q) for every cell a stencil touches."""
    return _spread(corner_sums(particles, scheme, n, box, frac_bits), scheme, n, ["q"], [])


def deposit_float(particles: DataFrame, scheme: str, n: int, box: float,
                  fields: dict[str, str] | None = None, shift: float = 0.0) -> DataFrame:
    """Floating deposit of one or more per-particle quantities (name -> SQL expression).

    Sums of doubles depend on row order in their last bits; compare after rounding.
    """
    fields = fields or {"w": "1.0D"}
    ss = slots(scheme)
    st = with_stencil(particles, scheme, n, box, shift)
    aggs = [F.expr(f"sum(({weight_sql(s)}) * ({e}))").alias(f"{name}_{t}")
            for name, e in fields.items() for t, s in enumerate(ss)]
    base = st.groupBy("cx", "cy", "cz").agg(*aggs)
    return _spread(base, scheme, n, list(fields), [])


def sub_block(mesh: DataFrame, origin: tuple[int, int, int], extent: tuple[int, int, int], n: int
              ) -> DataFrame:
    """Cells of a periodic sub-block, re-based to its origin (lx, ly, lz)."""
    local = {f"l{a}": F.expr(f"pmod(i{a} - ({o}), {n}L)") for a, o in zip("xyz", origin)}
    out = mesh.withColumns(local)
    for a, e in zip("xyz", extent):
        out = out.filter(F.col(f"l{a}") < e)
    return out


def counts(mesh: DataFrame, frac_bits: int = 12) -> DataFrame:
    """Fixed point -> particle counts per cell."""
    return mesh.withColumn("count", F.col("q") * F.lit(2.0**-frac_bits))


def grid(spark, n: int) -> DataFrame:
    """Every cell of an n^3 mesh."""
    i = F.col("id")
    return spark.range(n**3).select(
        div(i, n * n).alias("ix"), (div(i, n) % n).alias("iy"), (i % n).alias("iz")
    )


def density_contrast(mesh: DataFrame, n: int, n_particles, frac_bits: int = 12) -> DataFrame:
    """delta = counts / mean - 1 on every cell of the mesh, empty cells included.

    ``n_particles`` is a number, or a Column such as a scalar subquery.
    """
    total = n_particles if hasattr(n_particles, "cast") else F.lit(n_particles)
    mean = total.cast("double") / F.lit(float(n) ** 3)
    full = grid(mesh.sparkSession, n).join(mesh, ["ix", "iy", "iz"], "left")
    q = F.coalesce(F.col("q"), F.lit(0)).cast("double") * F.lit(2.0**-frac_bits)
    return full.select("ix", "iy", "iz", (q / mean - F.lit(1.0)).alias("delta"))
