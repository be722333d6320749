"""Distributed 3-D transforms of periodic meshes.

A forward transform is two grouped stages: a real 2-D transform of each x-plane, a shuffle on
ky, and a complex transform along x of each ky-plane.  The inverse mirrors it.  A k-space solve
multiplies its kernels inside the ky stage and goes straight back, so it costs two shuffles of
the mesh.  Every group is one plane (n^2 values), whatever the number of particles; empty planes
and cells are zeros.

Many meshes of one side (tiles, sub-volumes) transform together: ``by`` names the integer columns
that tell them apart, which join every grouping key, so a task still holds one plane of one mesh.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _arr(names: list[str]) -> str:
    return ", ".join(f"{f}_re array<double>, {f}_im array<double>" for f in names)


def lists(block: np.ndarray) -> pa.Array:
    """(rows, width) block -> a list array sharing its buffer."""
    block = np.ascontiguousarray(block, dtype=np.float64)
    off = np.arange(block.shape[0] + 1, dtype=np.int32) * block.shape[1]
    return pa.ListArray.from_arrays(pa.array(off), pa.array(block.ravel()))


def block_of(column, width: int) -> np.ndarray:
    c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(c.flatten()).reshape(len(c), width)


def _tags(table: pa.Table, by, rows: int) -> dict:
    """The mesh's own key, repeated on every row."""
    return {c: pa.array(np.full(rows, table.column(c)[0].as_py()), pa.int64()) for c in by}


def _longs(*names: str) -> str:
    return ", ".join(f"{c} long" for c in names)


def _table(tags, key, index, key_values, index_values, arrays) -> pa.Table:
    cols = {**tags, key: pa.array(key_values, pa.int64()), index: pa.array(index_values, pa.int64())}
    for name, a in arrays.items():
        cols[f"{name}_re"], cols[f"{name}_im"] = lists(a.real), lists(a.imag)
    return pa.table(cols)


def _read(table: pa.Table, index: str, name: str, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, width), dtype=np.complex128)
    at = table.column(index).to_numpy()
    out[at] = block_of(table.column(f"{name}_re"), width) + 1j * block_of(table.column(f"{name}_im"), width)
    return out


def _planes_from_cells(mesh: DataFrame, fields: list[str], n: int, by=()) -> DataFrame:
    """x-planes of cell rows (ix, iy, iz, *fields) -> (ky, ix, half-grid rows)."""

    def fn(table: pa.Table) -> pa.Table:
        ix = table.column("ix")[0].as_py()
        iy, iz = table.column("iy").to_numpy(), table.column("iz").to_numpy()
        out = {}
        for f in fields:
            plane = np.zeros((n, n))
            plane[iy, iz] = table.column(f).to_numpy()
            out[f] = np.fft.rfft2(plane)
        return _table(_tags(table, by, n), "ky", "ix", np.arange(n), np.full(n, ix), out)

    cols = [F.col(c).cast("long") for c in ("ix", "iy", "iz")]
    rows = mesh.select(*by, *cols, *(F.col(f).cast("double") for f in fields))
    return rows.groupBy(*by, "ix").applyInArrow(fn, f"{_longs(*by, 'ky', 'ix')}, {_arr(fields)}")


def _planes_from_pencils(mesh: DataFrame, fields: list[str], n: int, by=()) -> DataFrame:
    """x-planes of pencil rows (ix, iy, array fields) -> (ky, ix, half-grid rows)."""

    def fn(table: pa.Table) -> pa.Table:
        ix = table.column("ix")[0].as_py()
        out = {}
        for f in fields:
            plane = np.zeros((n, n))
            plane[table.column("iy").to_numpy()] = block_of(table.column(f), n)
            out[f] = np.fft.rfft2(plane)
        return _table(_tags(table, by, n), "ky", "ix", np.arange(n), np.full(n, ix), out)

    rows = mesh.select(*by, F.col("ix").cast("long"), F.col("iy").cast("long"), *fields)
    return rows.groupBy(*by, "ix").applyInArrow(fn, f"{_longs(*by, 'ky', 'ix')}, {_arr(fields)}")


def planes(mesh: DataFrame, fields: list[str], n: int, by=()) -> DataFrame:
    """First half of the forward transform, from cell rows or pencil rows."""
    make = _planes_from_cells if "iz" in mesh.columns else _planes_from_pencils
    return make(mesh, fields, n, by)


def spectrum(mesh: DataFrame, fields: list[str] | str, n: int) -> DataFrame:
    """Forward transform: rows (ky, kx, {field}_re[], {field}_im[]) over half-grid kz."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    nh = n // 2 + 1

    def fn(table: pa.Table) -> pa.Table:
        ky = table.column("ky")[0].as_py()
        out = {f: np.fft.fft(_read(table, "ix", f, n, nh), axis=0) for f in fields}
        return _table({}, "ky", "kx", np.full(n, ky), np.arange(n), out)

    half = planes(mesh, fields, n)
    return half.groupBy("ky").applyInArrow(fn, f"ky long, kx long, {_arr(fields)}")


def ky_map(mesh: DataFrame, fields: list[str], n: int, fn, schema: str, by=()) -> DataFrame:
    """Reduce each ky-plane of modes inside its task: fn(ky, [modes (n, n//2+1)]) -> pa.Table.

    The ``by`` columns go before those of ``schema``.
    """
    nh = n // 2 + 1

    def task(table: pa.Table) -> pa.Table:
        ky = table.column("ky")[0].as_py()
        got = fn(ky, [np.fft.fft(_read(table, "ix", f, n, nh), axis=0) for f in fields])
        return pa.table({**_tags(table, by, got.num_rows), **{c: got.column(c) for c in got.column_names}})

    schema = ", ".join([_longs(*by), schema]) if by else schema
    return planes(mesh, fields, n, by).groupBy(*by, "ky").applyInArrow(task, schema)


def modes(spec: DataFrame, fields: list[str] | str) -> DataFrame:
    """One row per half-grid mode: (kx, ky, kz, {field}_re, {field}_im)."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    arrays = [f"{f}_{p}" for f in fields for p in ("re", "im")]
    zipped = spec.select("kx", "ky", F.posexplode(F.arrays_zip(*arrays)).alias("kz", "m"))
    return zipped.select("kx", "ky", F.col("kz").cast("long").alias("kz"),
                         *(F.col(f"m.{a}").alias(a) for a in arrays))


def _inverse(back: DataFrame, names: list[str], n: int, by=()) -> DataFrame:
    nh = n // 2 + 1

    def fn(table: pa.Table) -> pa.Table:
        ix = table.column("ix")[0].as_py()
        cols = {**_tags(table, by, n), "ix": pa.array(np.full(n, ix), pa.int64()), "iy": pa.array(np.arange(n), pa.int64())}
        for f in names:
            cols[f] = lists(np.fft.irfft2(_read(table, "ky", f, n, nh), s=(n, n)))
        return pa.table(cols)

    schema = ", ".join([_longs(*by, "ix", "iy"), *(f"{f} array<double>" for f in names)])
    return back.groupBy(*by, "ix").applyInArrow(fn, schema)


def solve(mesh: DataFrame, fields: list[str] | str, n: int, kernel, names: list[str], by=()) -> DataFrame:
    """Forward, multiply, inverse: pencil rows (*by, ix, iy, {name}[]) for every output name.

    ``kernel(ky, [field modes])`` returns {name: modes} for the ky-plane of shape (n, n//2+1).
    """
    fields = [fields] if isinstance(fields, str) else list(fields)
    nh = n // 2 + 1

    def fn(table: pa.Table) -> pa.Table:
        ky = table.column("ky")[0].as_py()
        got = kernel(ky, [np.fft.fft(_read(table, "ix", f, n, nh), axis=0) for f in fields])
        out = {name: np.fft.ifft(got[name], axis=0) for name in names}
        return _table(_tags(table, by, n), "ix", "ky", np.arange(n), np.full(n, ky), out)

    half = planes(mesh, fields, n, by)
    back = half.groupBy(*by, "ky").applyInArrow(fn, f"{_longs(*by, 'ix', 'ky')}, {_arr(names)}")
    return _inverse(back, names, n, by)


def inverse(spec: DataFrame, fields: list[str] | str, n: int) -> DataFrame:
    """Inverse transform of ``spectrum`` rows: pencil rows (ix, iy, {field}[])."""
    fields = [fields] if isinstance(fields, str) else list(fields)
    nh = n // 2 + 1

    def fn(table: pa.Table) -> pa.Table:
        ky = table.column("ky")[0].as_py()
        out = {f: np.fft.ifft(_read(table, "kx", f, n, nh), axis=0) for f in fields}
        return _table({}, "ix", "ky", np.arange(n), np.full(n, ky), out)

    back = spec.groupBy("ky").applyInArrow(fn, f"ix long, ky long, {_arr(fields)}")
    return _inverse(back, fields, n)


def cells(pencils: DataFrame, names: list[str] | str) -> DataFrame:
    """Pencil rows -> one row per cell (ix, iy, iz, *names)."""
    names = [names] if isinstance(names, str) else list(names)
    z = pencils.select("ix", "iy", F.posexplode(F.arrays_zip(*names)).alias("iz", "m"))
    return z.select("ix", "iy", F.col("iz").cast("long").alias("iz"),
                    *(F.col(f"m.{f}").alias(f) for f in names))
