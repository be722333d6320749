"""Incremental mass deposit.  Integer sums make the running mesh equal to the batch mesh exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.functions.stencil import REACH, code_sql, slots, with_stencil


def running_deposit(particles: DataFrame, scheme: str, n: int, box: float, frac_bits: int = 12) -> DataFrame:
    """(cell, q) kept up to date as particles arrive; use output mode update or complete."""
    reach, ss = REACH[scheme], slots(scheme)
    w, unit = len(reach), 2**frac_bits
    st = with_stencil(particles, scheme, n, box)
    near = f"{w**3 // 2}" if scheme == "tsc" else "if(dx >= 0.5D, 4, 0) + if(dy >= 0.5D, 2, 0) + if(dz >= 0.5D, 1, 0)"
    codes = st.select("cx", "cy", "cz", F.expr(near).alias("near"), *(F.expr(code_sql(s, frac_bits)).alias(f"r_{t}") for t, s in enumerate(ss)))
    codes = codes.withColumn("excess", F.expr(f"{unit}L - ({' + '.join(f'r_{t}' for t in range(len(ss)))})"))
    rows = codes.select("cx", "cy", "cz", "near", "excess", F.posexplode(F.array(*(F.col(f"r_{t}") for t in range(len(ss))))).alias("t", "r"))
    at = [f"pmod(cx + (t div {w * w}) + ({reach[0]}), {n}L)",
          f"pmod(cy + (t div {w}) % {w} + ({reach[0]}), {n}L)", f"pmod(cz + t % {w} + ({reach[0]}), {n}L)"]
    q = F.expr("r + if(t = near, excess, 0L)")
    return rows.groupBy(F.expr(f"({at[0]} * {n} + {at[1]}) * {n} + {at[2]}").alias("cell")).agg(F.sum(q).alias("q"))
