"""Initial conditions: white noise -> linear density -> displacements -> particles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshtide.config import Cosmology
from meshtide.functions import cosmology as C
from meshtide.functions import kspace as K
from meshtide.operators import spectral as S
from meshtide.session import durable
from meshtide.sources.particles import lagrangian_grid, white_noise


def colour(mesh: DataFrame, field: str, n: int, box: float, table: C.SpectrumTable,
           amplitude: float = 1.0, out: str = "delta") -> DataFrame:
    """White noise -> density pencils with power P(k); DC removed."""
    power = table.power_fn()
    f = lambda k: amplitude * np.sqrt(power(k) * n**3 / box**3)
    return S.solve(mesh, field, n, K.radial_kernel(n, box, f, 0.0, out), [out])


def potential(mesh: DataFrame, field: str, n: int, box: float, cosmo: Cosmology, table: C.SpectrumTable,
              out: str = "phi") -> DataFrame:
    """White noise -> Gaussian primordial potential with delta = M phi."""
    power, poisson = table.power_fn(), table.poisson_fn(cosmo)
    f = lambda k: np.sqrt(power(k) * n**3 / box**3) / poisson(k)
    return S.solve(mesh, field, n, K.radial_kernel(n, box, f, 0.0, out), [out])


def mean_square(pencils: DataFrame, field: str, n: int) -> DataFrame:
    """One row: <field^2>, summed per plane first."""
    square = F.expr(f"aggregate({field}, 0.0D, (s, v) -> s + v * v)")
    planes = pencils.groupBy("ix").agg(F.sum(square).alias("s"))
    return planes.agg((F.sum("s") / float(n) ** 3).alias("mean_sq"))


def linear_density(noise: DataFrame, field: str, n: int, box: float, cosmo: Cosmology,
                   f_nl: float = 0.0, table: C.SpectrumTable | None = None) -> DataFrame:
    """delta with local non-Gaussianity: delta = M [phi + f_nl (phi^2 - <phi^2>)]."""
    table = table or C.SpectrumTable(cosmo, n, box)
    if f_nl == 0.0:
        return colour(noise, field, n, box, table)
    phi = durable(potential(noise, field, n, box, cosmo, table))
    mean = mean_square(phi, "phi", n).scalar()
    bent = phi.withColumn("_m", mean).withColumn(
        "phi", F.expr(f"transform(phi, p -> p + {float(f_nl)!r}D * (p * p - _m))")).drop("_m")
    f = table.poisson_fn(cosmo)
    return S.solve(bent, "phi", n, K.radial_kernel(n, box, f, 1.0, "delta"), ["delta"])


def zeldovich(delta: DataFrame, field: str, n: int, box: float, scale: float = 1.0) -> DataFrame:
    """First-order displacement pencils psi with div psi = -delta."""
    kernel = K.force_kernel(n, box, "mono", scale=scale)
    return S.solve(delta, field, n, kernel, ["gx", "gy", "gz"])


def second_order_source(delta: DataFrame, field: str, n: int, box: float) -> DataFrame:
    """Second-order source pencils: sum over i<j of phi_ii phi_jj - phi_ij^2."""
    pairs = ["xx", "yy", "zz", "xy", "xz", "yz"]
    d = S.solve(delta, field, n, K.second_derivatives(n, box), pairs)
    body = ("xx[i] * yy[i] + xx[i] * zz[i] + yy[i] * zz[i]"
            " - xy[i] * xy[i] - xz[i] * xz[i] - yz[i] * yz[i]")
    return d.select("ix", "iy", F.expr(f"transform(sequence(0, {n - 1}), i -> {body})").alias("delta2"))


def divergence(psi: DataFrame, fields: list[str], n: int, box: float) -> DataFrame:
    return S.solve(psi, fields, n, K.divergence_kernel(n, box), ["div"])


def lpt_particles(delta: DataFrame, field: str, n: int, box: float, a: float, cosmo: Cosmology,
                  order: int = 2, growth2: str = "lcdm") -> DataFrame:
    """(id, x, y, z, vx, vy, vz): x = wrap(q + (D psi1 - D2 psi2)), v = dx/dD."""
    if order not in (1, 2):
        raise ValueError("order is 1 or 2")
    d1, f1 = C.growth(a, cosmo), C.growth_rate(a, cosmo)
    delta = durable(delta)
    psi = S.cells(zeldovich(delta, field, n, box), ["gx", "gy", "gz"])
    rows = lagrangian_grid(delta.sparkSession, n, box).join(psi, ["ix", "iy", "iz"])
    wrap = lambda q, u: F.pmod(q + u, F.lit(box))
    if order == 1:
        return rows.select("id", *(wrap(F.col(c), F.lit(d1) * F.col(f"g{c}")).alias(c) for c in "xyz"),
                           *(F.col(f"g{c}").alias(f"v{c}") for c in "xyz"))
    d2, f2 = C.growth2(a, cosmo, growth2), C.growth2_rate(a, cosmo, growth2)
    src = second_order_source(delta, field, n, box)
    psi2 = S.cells(zeldovich(src, "delta2", n, box), ["gx", "gy", "gz"])
    psi2 = psi2.withColumnsRenamed({f"g{c}": f"h{c}" for c in "xyz"})
    rows = rows.join(psi2, ["ix", "iy", "iz"])
    second = -(d2 * f2) / (d1 * f1)
    move = lambda c: F.lit(d1) * F.col(f"g{c}") - F.lit(d2) * F.col(f"h{c}")
    return rows.select("id", *(wrap(F.col(c), move(c)).alias(c) for c in "xyz"),
                       *((F.col(f"g{c}") + F.lit(second) * F.col(f"h{c}")).alias(f"v{c}") for c in "xyz"))


def generate(spark: SparkSession, seed: int, n: int, box: float, cosmo: Cosmology, a: float,
             f_nl: float = 0.0, order: int = 2, growth2: str = "lcdm") -> DataFrame:
    """Seeded particles at scale factor a."""
    delta = linear_density(white_noise(spark, n, seed), "white", n, box, cosmo, f_nl)
    return lpt_particles(delta, "delta", n, box, a, cosmo, order, growth2)
