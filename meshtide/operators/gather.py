"""Stencil gather: mesh fields -> particles.

Mesh and particles meet per *block* of cells.  A block's field, with a one-cell halo, travels as
slices of z-pencils; particles travel once, with no stencil multiplication and no identifier.
A block holding more than ``max_rows`` particles is split into chunks, each paired with its own
copy of the block, so a task sees at most about ``max_rows`` particles and ``(side + 2)^3`` cells
however the particles cluster.  The weighted sum itself is a short NumPy expression per chunk.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshtide.functions.lattice import div, no_position
from meshtide.functions.stencil import REACH

MAX_ROWS = 131_072


def with_salt(df: DataFrame) -> DataFrame:
    """Add ``salt``, spreading the rows of a crowded group over chunks.

    Use it on a frame whose row order is fixed (a scan or a checkpoint), so that a retried task
    assigns the same values.
    """
    return df.withColumn("salt", F.monotonically_increasing_id())


def pencils(mesh: DataFrame, fields: list[str], n: int) -> DataFrame:
    """Cell rows (ix, iy, iz, *fields) -> pencil rows of n values; absent cells are zero."""
    if "iz" not in mesh.columns:
        return mesh.select("ix", "iy", *fields)
    entry = F.struct(F.col("iz").cast("int").alias("iz"), F.struct(*(F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in fields)).alias("v"))
    # a pencil's absent cells are appended as zeros, so that sorting by iz fills it in one pass
    listed = mesh.groupBy("ix", "iy").agg(F.collect_list(entry).alias("m"))
    none = ", ".join(f"'{f}', 0.0D" for f in fields)
    absent = (f"transform(array_except(sequence(0, {n - 1}), transform(m, e -> e.iz)), "
              f"z -> named_struct('iz', z, 'v', named_struct({none})))")
    filled = listed.select("ix", "iy", F.expr(f"array_sort(concat(m, {absent}), (l, r) -> l.iz - r.iz)").alias("m"))
    return filled.select("ix", "iy", *(F.expr(f"transform(m, e -> e.v.{f})").alias(f) for f in fields))


def block_side(n: int, limit: int = 32) -> int:
    """Largest divisor of n not above ``limit``."""
    return max(b for b in range(1, min(n, limit) + 1) if n % b == 0)


def _block_rows(mesh: DataFrame, fields: list[str], n: int, side: int) -> DataFrame:
    """Pencil slices with halo: (block, lx, ly, {field}[side + 2])."""
    nb = n // side

    def owners(axis: str) -> str:
        # the block a plane lies in, and the neighbours whose halo it is
        own = f"struct({axis} div {side} as b, {axis} % {side} + 1 as l)"
        low = f"if({axis} % {side} = 0, struct(pmod({axis} div {side} - 1, {nb}) as b, {side + 1}L as l), null)"
        high = (f"if({axis} % {side} = {side - 1}, struct(pmod({axis} div {side} + 1, {nb}) as b, 0L as l),"
                " null)")
        return f"filter(array({own}, {low}, {high}), e -> e is not null)"

    rows = pencils(mesh, fields, n)
    rows = rows.withColumn("ox", F.explode(F.expr(owners("ix"))))
    rows = rows.withColumn("oy", F.explode(F.expr(owners("iy"))))
    rows = rows.withColumn("bz", F.explode(F.expr(f"sequence(0L, {nb - 1}L)")))
    cut = [F.expr(f"slice(concat(slice({f}, {n}, 1), {f}, slice({f}, 1, 1)), "
                  f"cast(bz * {side} + 1 as int), {side + 2})").alias(f) for f in fields]
    return rows.select(F.expr(f"(ox.b * {nb} + oy.b) * {nb} + bz").alias("block"),
                       F.col("ox.l").alias("lx"), F.col("oy.l").alias("ly"), *cut)


def stencil_weights(pos: np.ndarray, scheme: str, cell: float):
    """Base cells (unwrapped) and per-axis weights (reach, rows, 3)."""
    s = pos / cell
    if scheme == "cic":
        base = np.floor(s)
        d = s - base
        return base.astype(np.int64), (1.0 - d, d)
    base = np.rint(s)
    d = s - base
    return base.astype(np.int64), (0.5 * (0.5 - d) ** 2, 0.75 - d**2, 0.5 * (0.5 + d) ** 2)


def read_blocks(particles: DataFrame, blocks: DataFrame, fields: list[str], scheme: str, n: int,
                box: float, side: int, out: list[str], max_rows: int = MAX_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Weighted stencil read from block rows (block, lx, ly, {field}[side + 2]).

    Local index 1 is a block's first cell.  ``particles`` needs a ``salt`` column (see
    ``with_salt``), which is kept.  ``counted`` holds the same positions by a shorter plan, to size the chunks by.
    """
    cell, nb = box / n, n // side
    snap = "floor" if scheme == "cic" else "rint"
    own = [F.expr(f"pmod(cast({snap}({a} / {cell!r}D) as bigint), {n}L) div {side}") for a in "xyz"]
    names, schema = particles.columns, particles.schema
    block = F.coalesce((own[0] * nb + own[1]) * nb + own[2], no_position())
    placed = particles.withColumn("block", block)
    sized = placed if counted is None else counted.withColumn("block", block)
    per_block = sized.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    chunks = per_block.select("block", F.ceil(F.col("m") / max_rows).cast("long").alias("chunks"))
    # crowded blocks are at most one per max_rows particles: their list is broadcast, so that no block's particles meet in one task
    crowded = F.broadcast(chunks.filter("chunks > 1"))
    left = placed.join(crowded, "block", "left").withColumn("chunk", F.coalesce(F.col("salt") % F.col("chunks"), F.lit(0).cast("long")))
    left = left.select(*names, "block", "chunk")
    right = blocks.join(crowded, "block", "left")
    right = right.withColumn("chunk", F.explode(F.expr("sequence(0L, coalesce(chunks, 1L) - 1)")))
    right = right.select("block", "chunk", "lx", "ly", *fields)
    corners = list(product(range(len(REACH[scheme])), repeat=3))
    first, w3 = REACH[scheme][0], side + 2

    def fn(rows: pa.Table, cells: pa.Table) -> pa.Table:
        body = rows.select(names)
        if rows.num_rows == 0:
            return pa.table({**{c: body.column(c) for c in names}, **{o: pa.array([], pa.float64()) for o in out}})
        grids = [np.zeros((w3, w3, w3)) for _ in fields]
        if cells.num_rows:
            lx, ly = cells.column("lx").to_numpy(), cells.column("ly").to_numpy()
            for f, g in zip(fields, grids):
                c = cells.column(f).combine_chunks()
                g[lx, ly] = np.asarray(c.flatten()).reshape(len(c), w3)
        grids = [g.ravel() for g in grids]
        pos = np.stack([rows.column(a).to_numpy() for a in "xyz"], axis=1)
        base, w = stencil_weights(pos, scheme, cell)
        b = base % n % side + 1 + first
        acc = [np.zeros(len(pos)) for _ in fields]
        for i, j, k in corners:
            at = ((b[:, 0] + i) * w3 + b[:, 1] + j) * w3 + b[:, 2] + k
            ww = w[i][:, 0] * w[j][:, 1] * w[k][:, 2]
            for a, g in zip(acc, grids):
                a += ww * g[at]
        cols = {c: body.column(c) for c in names}
        cols.update({o: pa.array(a) for o, a in zip(out, acc)})
        return pa.table(cols)

    result = T.StructType(list(schema.fields) + [T.StructField(o, T.DoubleType()) for o in out])
    pair = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk"))
    return pair.applyInArrow(fn, result)


def gather(particles: DataFrame, mesh: DataFrame, fields: list[str], scheme: str, n: int,
           box: float, out: list[str] | None = None, max_rows: int = MAX_ROWS, counted: DataFrame | None = None) -> DataFrame:
    """Read mesh ``fields`` (cell or pencil rows) at each particle; absent cells count as zero."""
    side = block_side(n)
    out = out or [f"{f}_at" for f in fields]
    blocks = _block_rows(mesh, fields, n, side)
    return read_blocks(particles, blocks, fields, scheme, n, box, side, out, max_rows, counted)
