"""Stencil geometry of the CIC and TSC assignments as Column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REACH = {"cic": (0, 1), "tsc": (-1, 0, 1)}


def corners(scheme: str) -> list[tuple[int, int, int]]:
    return list(product(REACH[scheme], repeat=3))


def with_stencil(df: DataFrame, scheme: str, n: int, box: float, shift: float = 0.0) -> DataFrame:
    """Add the base cell (cx, cy, cz in [0, n)) and per-axis weights w{axis}{slot}.

    CIC is node centred: the base is the floor.  TSC is centred on the nearest node (half-even).
    ``shift`` moves the grid by a fraction of a cell.
    """
    if scheme not in REACH:
        raise ValueError(f"scheme is 'cic' or 'tsc', not {scheme!r}")
    cell = box / n
    moved = "" if shift == 0.0 else f" + {shift!r}D"
    out = df.withColumns({f"s{a}": F.expr(f"{a} / {cell!r}D{moved}") for a in "xyz"})
    snap = "floor" if scheme == "cic" else "rint"
    out = out.withColumns({f"b{a}": F.expr(f"cast({snap}(s{a}) as double)") for a in "xyz"})
    out = out.withColumns({f"d{a}": F.expr(f"s{a} - b{a}") for a in "xyz"})
    cols = {f"c{a}": F.expr(f"pmod(cast(b{a} as bigint), {n}L)") for a in "xyz"}
    for a in "xyz":
        if scheme == "cic":
            cols[f"w{a}0"] = F.expr(f"1.0D - d{a}")
            cols[f"w{a}1"] = F.expr(f"d{a}")
        else:
            cols[f"w{a}0"] = F.expr(f"0.5D * (0.5D - d{a}) * (0.5D - d{a})")
            cols[f"w{a}1"] = F.expr(f"0.75D - d{a} * d{a}")
            cols[f"w{a}2"] = F.expr(f"0.5D * (0.5D + d{a}) * (0.5D + d{a})")
    return out.withColumns(cols)


def weight_sql(slot: tuple[int, int, int]) -> str:
    """Product of per-axis weights, formed left to right."""
    i, j, k = slot
    return f"wx{i} * wy{j} * wz{k}"


def slots(scheme: str) -> list[tuple[int, int, int]]:
    return list(product(range(len(REACH[scheme])), repeat=3))


def code_sql(slot, frac_bits: int) -> str:
    """A corner weight in fixed point, rounded through 32-bit floats."""
    unit = float(2**frac_bits)
    return f"cast(rint(cast(cast({weight_sql(slot)} as float) as double) * {unit!r}D) as bigint)"
