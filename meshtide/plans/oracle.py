"""Reference SQL for the registered queries, in DuckDB's dialect, written independently of Spark plans."""

from __future__ import annotations

import math

import numpy as np

from meshtide.functions import cosmology as C
from meshtide.functions.dither import AXIS_MUL, KEY_MUL, MIX
from meshtide.functions.schedule import momentum_factor
from meshtide.plans.queries import (
    A_OUT, BOX, COSMO, DITHER_KEY, DRIFT, EDGES, FLOOR, GEO, HALO_EDGES, KF, LINK, N, TRIANGLES,
)
from meshtide.sources.particles import particles_sql

Q = GEO.lattice.quantum
LEVELS = GEO.lattice.levels
SQL: dict[str, str] = {}


def sql(ctes: list[str], body: str) -> str:
    return f"with {', '.join(ctes)} {body}"


def rd(e: str, d: int) -> str:
    return f"round({e}, {d}) + 0.0"


def mod(e: str, n) -> str:
    return f"((({e}) % {n}) + {n}) % {n}"


def fmod(e: str, n: float) -> str:
    return f"(({e}) - {n!r} * floor(({e}) / {n!r}))"


def rint(e: str) -> str:
    return f"cast(round_even({e}, 0) as bigint)"


P = f"p as ({particles_sql()})"
PL = f"p as ({particles_sql('lineitem', 'l_linenumber')})"
RAW = ("raw as (select l_linenumber, x + l_linenumber * 0.0009765625 as x, y + l_linenumber * 0.0009765625 * 2 as y,"
       " z - l_linenumber * 0.0009765625 as z, vx, vy, vz from p)")


def lattice(src: str, name: str = "lat", keep: str = "*") -> str:
    cols = ", ".join(f"{mod(rint(f'{a} / {Q!r}'), LEVELS)} as j{a}" for a in "xyz")
    return f"{name} as (select {keep}, {cols} from {src})"


def keyed(src: str, name: str = "k", drop: str = "") -> str:
    """Brick and bucket of jx, jy, jz: 2 buckets per brick side, 8 bricks per side."""
    brick = "((jx // 512) * 8 + jy // 512) * 8 + jz // 512"
    within = "((jx // 256 % 2) * 2 + jy // 256 % 2) * 2 + jz // 256 % 2"
    off = ", ".join(f"j{a} % 256 as off_{a}" for a in "xyz")
    star = f"* exclude ({drop})" if drop else "*"
    return f"{name} as (select {star}, {brick} as brick, ({brick}) * 8 + {within} as bucket, {off} from {src})"


SCALES = ("sc as (select brick, case when max(greatest(abs(vx), abs(vy), abs(vz))) / 32767.0 > 0 then"
          " max(greatest(abs(vx), abs(vy), abs(vz))) / 32767.0 else 1.0 end as vel_scale, count(*) as n from k group by brick)")
CODED = ("c as (select k.brick, k.bucket, k.off_x, k.off_y, k.off_z, "
         + ", ".join(f"{rint(f'k.v{a} / sc.vel_scale')} as w_{a}" for a in "xyz")
         + ", sc.vel_scale, k.jx, k.jy, k.jz from k join sc using (brick))")
ENC = [P, lattice("p"), keyed("lat"), SCALES, CODED]
CODES = "brick, bucket, off_x, off_y, off_z, w_x, w_y, w_z"

SQL["particle_scan"] = f"select * from ({particles_sql()})"
SQL["event_particles"] = f"select * from ({particles_sql('events', 'event_id')})"
SQL["lattice_index"] = sql([PL, RAW, lattice("raw")], "select jx, jy, jz from lat")
SQL["encode_positions"] = sql([PL, RAW, lattice("raw"), keyed("lat")],
                              "select off_x, off_y, off_z, jx // 256 as b_x, jy // 256 as b_y, jz // 256 as b_z from k")
SQL["decode_positions"] = sql([PL, RAW, lattice("raw")],
                              "select " + ", ".join(f"cast(j{a} as double) * {Q!r} as {a}" for a in "xyz") + " from lat")
_near = lambda e: f"abs({e} - {BOX!r} * round_even(({e}) / {BOX!r}, 0))"
SQL["position_roundtrip"] = sql([PL, RAW, lattice("raw")], "select max(greatest("
                                + ", ".join(_near(f"(j{a} * {Q!r} - {a})") for a in "xyz") + ")) as max_error, count(*) as n from lat")
SQL["bucket_order_key"] = sql([PL, RAW, lattice("raw"), keyed("lat")],
                              "select brick, bucket, count(*) as n from k group by all")
SQL["bucket_from_key"] = sql([P, lattice("p")],
                             "select jx // 256 as b_x, jy // 256 as b_y, jz // 256 as b_z, count(*) as n from lat group by all")
SQL["velocity_codes_global"] = sql(
    [P, "s as (select max(greatest(abs(vx), abs(vy), abs(vz))) / 32767.0 as s from p)"],
    "select " + ", ".join(f"{rint(f'v{a} / s')} as w_{a}" for a in "xyz") + " from p, s")
SQL["velocity_codes"] = sql(ENC, f"select {CODES} from c")
SQL["velocity_decode"] = sql(ENC, "select brick, " + ", ".join(f"{rd(f'w_{a} * vel_scale', 9)} as v{a}" for a in "xyz") + " from c")
SQL["decode_bricks"] = sql(ENC, "select brick, " + ", ".join(f"j{a} * {Q!r} as {a}" for a in "xyz")
                           + f", {rd('w_x * vel_scale', 9)} as vx from c")
SQL["rescale_codes"] = sql(ENC + ["t as (select max(vel_scale) as top from sc)"], "select brick, "
                           + ", ".join(f"{rint(f'w_{a} * (vel_scale / top)')} as w_{a}" for a in "xyz") + " from c, t")
SQL["reconcile_velocity_scale"] = sql(ENC, "select max(vel_scale) as vel_scale from sc")
_tile = lambda a: f"(cast(floor({a} / 0.5) as bigint) % 64) // 16"
SQL["owning_tile"] = sql([P], f"select {_tile('x')} as tx, {_tile('y')} as ty, {_tile('z')} as tz, count(*) as n from p group by all")
_U = "u as (select " + ", ".join(f"{fmod(f'{a} - ({o!r})', BOX)} as u{a}" for a, o in zip("xyz", (-4.0, 4.0, 20.0))) + " from p)"
SQL["tile_local_coords"] = sql([P, _U], "select * from u")
SQL["in_padded_box"] = sql([P, _U], "select count(*) filter (ux < 16 and uy < 16 and uz < 16) as inside,"
                           " count(*) filter (not (ux < 16 and uy < 16 and uz < 16)) as outside from u")
_vf = C.peculiar_velocity_factor(A_OUT, COSMO)
SQL["peculiar_velocity"] = sql([P], "select " + ", ".join(f"{rd(f'v{a} * {_vf!r}', 6)} as v{a}" for a in "xyz") + " from p")
_mf = momentum_factor(A_OUT, COSMO)
SQL["momentum_conversion"] = sql([P], "select " + ", ".join(
    f"{rd(f'v{a} * {_mf!r}', 9)} as p{a}, {rd(f'v{a}', 9)} as v{a}" for a in "xyz") + " from p")
_d1, _d2 = C.growth(A_OUT, COSMO), C.growth2(A_OUT, COSMO)
SQL["displaced_positions"] = sql([P], "select " + ", ".join(
    f"{rd(fmod(f'{a} + ({_d1!r} * v{a} - {_d2!r} * vx)', BOX), 9)} as {a}" for a in "xyz") + " from p")
SQL["slab_scan"] = sql(ENC, "select brick // 64 as bx, count(*) as n, sum(w_x)::bigint as sum_wx, count(distinct brick) as bricks"
                       " from c where brick // 64 between 2 and 4 group by all")
SQL["export_particles"] = sql(ENC, "select " + ", ".join(f"j{a} * {Q!r} as {a}" for a in "xyz") + ", "
                              + ", ".join(f"{rd(f'w_{a} * vel_scale * {_vf!r}', 5)} as v{a}" for a in "xyz") + " from c")
SQL["export_row_offsets"] = sql(ENC + ["t as (select brick // 64 as part, count(*) as n from c group by all)"],
                                "select part, n, coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)::bigint as row0 from t")

# ---- layout ----
SQL["brick_occupancy"] = sql(ENC, "select brick, count(*) as n from c group by all")
SQL["bucket_occupancy"] = sql(ENC, "select bucket, count(*) as n from c group by all")
SQL["brick_velocity_scale"] = sql(ENC, "select brick, vel_scale, n from sc")
_RANK = f"r as (select {CODES}, row_number() over (partition by brick order by bucket, off_x, off_y, off_z, w_x, w_y, w_z) - 1 as rank from c)"
SQL["run_rank"] = sql(ENC + [_RANK], "select * from r")
SQL["bucket_starts"] = sql(ENC + ["b as (select brick, bucket, count(*) as n from c group by all)"],
                           "select *, coalesce(sum(n) over (partition by brick order by bucket rows between unbounded preceding and 1 preceding), 0)::bigint as start from b")
_TB = ("bc as (select brick, n, brick // 64 as ux, brick // 8 % 8 as uy, brick % 8 as uz from sc), "
       "tl as (select t, t // 16 as tx, t // 4 % 4 as ty, t % 4 as tz from range(64) r(t)), "
       "tb as (select t as tile, brick, n, (ux // 2) = tx and (uy // 2) = ty and (uz // 2) = tz as owned from bc, tl where "
       + " and ".join(f"{mod(f'u{a} - (t{a} * 2 - 1)', 8)} < 4" for a in "xyz") + ")")
SQL["tile_membership"] = sql(ENC + [_TB], "select * from tb")
SQL["tile_members"] = sql(ENC + [_TB], "select tile, sum(n)::bigint as members, sum(case when owned then n else 0 end)::bigint as owned, count(*) as bricks from tb group by all")
SQL["ownership_partition"] = sql(ENC, "select brick // 64 // 2 as tx, brick // 8 % 8 // 2 as ty, brick % 8 // 2 as tz, count(*) as owned from c group by all")
SQL["partition_diagnosis"] = sql(ENC + [_TB], "select brick, count(tile)::bigint as claims from sc left join (select tile, brick from tb) q using (brick) group by all having count(tile) <> 1")
_EV = f"p as ({particles_sql('events', 'event_id as id')})"
SQL["placement_check"] = sql(
    [_EV, lattice("p"), keyed("lat"), "m as (select * replace (case when id % 10 = 0 then (jx + 1) % 4096 else jx end as jx) from lat)",
     keyed("m", "k2")], "select k.id, k.bucket, k2.bucket as want from k join k2 using (id)"
    " where k.bucket <> k2.bucket or k.off_x <> k2.off_x or k.off_y <> k2.off_y or k.off_z <> k2.off_z")
SQL["state_check"] = sql(ENC, "select count(*) as n, count(*) filter (vel_scale is null) as no_scale,"
                         " max(greatest(abs(w_x), abs(w_y), abs(w_z))) as max_code, count(*) filter (bucket // 8 <> brick) as misfiled from c")


# ---- deposits ----
def stencil(src: str, scheme: str, n: int, name: str = "st", shift: str = "") -> str:
    d = BOX / n
    snap = (lambda e: f"floor({e})") if scheme == "cic" else (lambda e: f"round_even({e}, 0)")
    s = {a: f"({a} / {d!r}{shift})" for a in "xyz"}
    cols = []
    for a in "xyz":
        cols.append(f"{mod(f'cast({snap(s[a])} as bigint)', n)} as c{a}")
        cols.append(f"{s[a]} - {snap(s[a])} as d{a}")
    return f"{name} as (select *, {', '.join(cols)} from {src})"


def weight(a: str, scheme: str, o: str) -> str:
    if scheme == "cic":
        return f"case when {o} = 1 then d{a} else 1.0 - d{a} end"
    return (f"case {o} when -1 then 0.5 * (0.5 - d{a}) * (0.5 - d{a}) when 0 then 0.75 - d{a} * d{a}"
            f" else 0.5 * (0.5 + d{a}) * (0.5 + d{a}) end")


def offsets(scheme: str) -> str:
    r = (0, 1) if scheme == "cic" else (-1, 0, 1)
    rows = ", ".join(f"({i}, {j}, {k})" for i in r for j in r for k in r)
    return f"off_{scheme} as (select * from (values {rows}) o(i, j, k))"


def mesh(src: str, scheme: str, n: int, name: str = "mesh", tag: str = "") -> list[str]:
    """Exact-mass deposit: other corners' codes, and the remainder on the nearest corner."""
    w = " * ".join(f"({weight(a, scheme, o)})" for a, o in zip("xyz", "ijk"))
    near = ("i = 0 and j = 0 and k = 0" if scheme == "tsc" else
            "i = (dx >= 0.5)::int and j = (dy >= 0.5)::int and k = (dz >= 0.5)::int")
    up = {a: (f"c{a}" if scheme == "tsc" else f"(c{a} + (d{a} >= 0.5)::int) % {n}") for a in "xyz"}
    at = {a: mod(f"c{a} + {o}", n) for a, o in zip("xyz", "ijk")}
    t = tag or name
    return [
        offsets(scheme) if not tag else f"off_{t} as (select 1)",
        stencil(src, scheme, n, f"st_{t}"),
        f"co_{t} as (select {', '.join(f'{at[a]} as t{a}' for a in 'xyz')}, {', '.join(f'{up[a]} as n{a}' for a in 'xyz')},"
        f" round_even(cast(cast({w} as float) as double) * 4096.0, 0)::bigint as q from st_{t}, off_{scheme} where not ({near}))",
        f"dl_{t} as (select tx as ix, ty as iy, tz as iz, q from co_{t} union all select nx, ny, nz, -q from co_{t}"
        f" union all select {up['x']}, {up['y']}, {up['z']}, 4096 from st_{t})",
        f"{name} as (select ix, iy, iz, sum(q)::bigint as q from dl_{t} group by all)",
    ]


CELLS = "select ix, iy, iz, q from mesh"
SQL["cic_paint_int"] = sql([P] + mesh("p", "cic", 32), CELLS)
SQL["tsc_paint_int"] = sql([P] + mesh("p", "tsc", N), CELLS)
SQL["tsc_paint_orders"] = sql([f"p as ({particles_sql('orders')})"] + mesh("p", "tsc", N), CELLS)
SQL["tsc_paint_subblock"] = sql([P] + mesh("p", "tsc", N), f"select * from (select {mod('ix + 2', N)} as lx, {mod('iy - 3', N)} as ly,"
                                f" {mod('iz - 14', N)} as lz, q from mesh) where lx < 8 and ly < 8 and lz < 8")
SQL["tsc_paint_incremental"] = sql([P] + mesh("p", "tsc", N), f"select (ix * {N} + iy) * {N} + iz as cell, q from mesh")
SQL["cic_paint_incremental"] = sql([PL, RAW] + mesh("raw", "cic", N), f"select (ix * {N} + iy) * {N} + iz as cell, q from mesh")


def float_mesh(src, scheme, n, fields: dict, shift="", name="fm") -> list[str]:
    w = " * ".join(f"({weight(a, scheme, o)})" for a, o in zip("xyz", "ijk"))
    at = ", ".join(f"{mod(f'c{a} + {o}', n)} as i{a}" for a, o in zip("xyz", "ijk"))
    vals = ", ".join(f"sum({w} * ({e})) as {f}" for f, e in fields.items())
    return [offsets(scheme), stencil(src, scheme, n, "st_f", shift),
            f"{name} as (select {at}, {vals} from st_f, off_{scheme} group by all)"]


SQL["cic_paint_float"] = sql([P] + float_mesh("p", "cic", N, {"w": "1.0"}), f"select ix, iy, iz, {rd('w', 7)} as w from fm")
SQL["tsc_paint_float"] = sql([P] + float_mesh("p", "tsc", N, {"w": "1.0"}), f"select ix, iy, iz, {rd('w', 7)} as w from fm")
SQL["momentum_fields"] = sql([P] + float_mesh("p", "cic", N, {"rho": "1.0", "px": "vx", "py": "vy", "pz": "vz"}, " - 0.5"),
                             "select ix, iy, iz, " + ", ".join(f"{rd(f, 7)} as {f}" for f in ("rho", "px", "py", "pz")) + " from fm")
SQL["paint_mass_check"] = sql([P] + mesh("p", "tsc", N), "select sum(q)::bigint as mass, max(q) as peak, count(*) as cells from mesh")
SQL["paint_counts"] = sql([P] + mesh("p", "tsc", N), f"select ix, iy, iz, {rd('q / 4096.0', 9)} as count from mesh")


def contrast(scheme, n):
    return sql([P] + mesh("p", scheme, n) + [
        f"g as (select i // {n * n} as ix, i // {n} % {n} as iy, i % {n} as iz from range({n**3}) r(i))", "t as (select count(*) as m from p)"],
        f"select ix, iy, iz, {rd(f'coalesce(q, 0) / 4096.0 / (m / {float(n**3)!r}) - 1.0', 9)} as delta from g left join mesh using (ix, iy, iz), t")


SQL["density_contrast_cic"] = contrast("cic", 32)
SQL["density_contrast_tsc"] = contrast("tsc", N)
SQL["displaced_paint"] = sql(
    [P, "mv as (select " + ", ".join(f"{fmod(f'{a} + round({_d1!r} * v{a} / {Q!r}, 0) * {Q!r}', BOX)} as {a}" for a in "xyz") + " from p)"]
    + mesh("mv", "cic", N), CELLS)
_tl = lambda a: mod(f"c{a} - (t{a} * 16 - 8)", 64)
_w8 = " * ".join(f"({weight(a, 'cic', o)})" for a, o in zip("xyz", "ijk"))
TILES = [
    offsets("cic"), stencil("p", "cic", 64),
    "tl as (select t as tile, t // 16 as tx, t // 4 % 4 as ty, t % 4 as tz from range(64) r(t))",
    f"lo as (select tile, dx, dy, dz, {_tl('x')} as lx, {_tl('y')} as ly, {_tl('z')} as lz from st, tl where {_tl('x')} < 32 and {_tl('y')} < 32 and {_tl('z')} < 32)",
    f"co as (select tile, (lx + i) % 32 as ix, (ly + j) % 32 as iy, (lz + k) % 32 as iz, (lx + (dx >= 0.5)::int) % 32 as nx,"
    f" (ly + (dy >= 0.5)::int) % 32 as ny, (lz + (dz >= 0.5)::int) % 32 as nz, round_even(cast(cast({_w8} as float) as double) * 4096.0, 0)::bigint as q"
    " from lo, off_cic where not (i = (dx >= 0.5)::int and j = (dy >= 0.5)::int and k = (dz >= 0.5)::int))",
    "dl as (select tile, ix, iy, iz, q from co union all select tile, nx, ny, nz, -q from co union all"
    " select tile, (lx + (dx >= 0.5)::int) % 32, (ly + (dy >= 0.5)::int) % 32, (lz + (dz >= 0.5)::int) % 32, 4096 from lo)"]
SQL["tile_paint_int"] = sql([P] + TILES, "select tile, ix, iy, iz, sum(q)::bigint as q from dl group by all")


# ---- gathers ----
def gather_sql(scheme, n, digits):
    w = " * ".join(f"({weight(a, scheme, o)})" for a, o in zip("xyz", "ijk"))
    at = " and ".join(f"m.i{a} = {mod(f's.c{a} + {o}', n)}" for a, o in zip("xyz", "ijk"))
    return sql([P] + mesh("p", scheme, n) + [
        "sr as (select *, row_number() over () as rid from st_mesh)",
        f"g as (select rid, any_value(s.x) as x, any_value(s.y) as y, any_value(s.z) as z, sum({w} * q) as ax, sum({w} * q * iy) as ay,"
        f" sum({w} * (q - iz * 1000)) as az from sr s, off_{scheme} join mesh m on {at} group by rid)"],
        f"select x, y, z, {rd('ax', digits)} as ax, {rd('ay', digits)} as ay, {rd('az', digits)} as az from g")


SQL["cic_gather"] = gather_sql("cic", 32, 5)
SQL["tsc_gather"] = gather_sql("tsc", N, 4)


# ---- separable DFT ----
def _c(e, n=N):
    return f"cos(2 * pi() * (({e}) % {n}) / {n}.0)"


def _s(e, n=N):
    return f"sin(2 * pi() * (({e}) % {n}) / {n}.0)"


def fft(src: str, vals: list[str], out: str, n: int = N) -> list[str]:
    """Half-grid spectrum of cell rows: (kx, ky, kz, {v}_re, {v}_im)."""
    z = ", ".join(f"sum({v} * {_c('kz * iz', n)}) as {v}_re, -sum({v} * {_s('kz * iz', n)}) as {v}_im" for v in vals)

    def rot(k, i):
        return ", ".join(f"sum({v}_re * {_c(f'{k} * {i}', n)} + {v}_im * {_s(f'{k} * {i}', n)}) as {v}_re,"
                         f" sum({v}_im * {_c(f'{k} * {i}', n)} - {v}_re * {_s(f'{k} * {i}', n)}) as {v}_im" for v in vals)
    return [f"{out}_z as (select ix, iy, kz, {z} from {src}, range({n // 2 + 1}) r(kz) group by all)",
            f"{out}_y as (select ix, ky, kz, {rot('ky', 'iy')} from {out}_z, range({n}) r(ky) group by all)",
            f"{out} as (select kx, ky, kz, {rot('kx', 'ix')} from {out}_y, range({n}) r(kx) group by all)"]


def ifft(src: str, vals: list[str], out: str, n: int = N) -> list[str]:
    def rot(k, i):
        return ", ".join(f"sum({v}_re * {_c(f'{k} * {i}', n)} - {v}_im * {_s(f'{k} * {i}', n)}) as {v}_re,"
                         f" sum({v}_im * {_c(f'{k} * {i}', n)} + {v}_re * {_s(f'{k} * {i}', n)}) as {v}_im" for v in vals)
    w = f"case when kz in (0, {n // 2}) then 1.0 else 2.0 end"
    z = ", ".join(f"sum({w} * ({v}_re * {_c('kz * iz', n)} - {v}_im * {_s('kz * iz', n)})) / {float(n**3)!r} as {v}" for v in vals)
    return [f"{out}_x as (select ix, ky, kz, {rot('kx', 'ix')} from {src}, range({n}) r(ix) group by all)",
            f"{out}_y as (select ix, iy, kz, {rot('ky', 'iy')} from {out}_x, range({n}) r(iy) group by all)",
            f"{out} as (select ix, iy, iz, {z} from {out}_y, range({n}) r(iz) group by all)"]


def turns(n: int) -> str:
    """Rows of cosines and sines of an n-point transform, as lists."""
    return (f"tw{n} as (select k, list(cos(2 * pi() * (k * i % {n}) / {n}.0) order by i) as c, list(sin(2 * pi() * (k * i % {n}) / {n}.0) order by i) as s"
            f" from range({n}) a(k), range({n}) b(i) group by k)")


def _turned(src: str, axis: str, at: str, rest: str, vals: list[str], out: str, sign: str, n: int) -> list[str]:
    """One axis of complex values, a list dot product per output: ``axis`` goes, ``at`` comes."""
    other = "-" if sign == "+" else "+"
    packed = ", ".join(f"list({v}_{p} order by {axis}) as {v}_{p}" for v in vals for p in ("re", "im"))
    dot = lambda v, t: f"list_dot_product({v}, {t})"
    turned = ", ".join(f"{dot(f'{v}_re', 'c')} {sign} {dot(f'{v}_im', 's')} as {v}_re, {dot(f'{v}_im', 'c')} {other} {dot(f'{v}_re', 's')} as {v}_im" for v in vals)
    return [f"{out}_p as (select {rest}, {packed} from {src} group by {rest})", f"{out} as (select {rest}, k as {at}, {turned} from {out}_p, tw{n})"]


def tile_fft(src: str, v: str, out: str, n: int) -> list[str]:
    """Half-grid spectrum of the dense cells of every tile: (tile, kx, ky, kz, {v}_re, {v}_im)."""
    return [f"{out}_l as (select tile, ix, iy, list({v} order by iz) as l from {src} group by tile, ix, iy)",
            f"{out}_z as (select tile, ix, iy, k as kz, list_dot_product(l, c) as {v}_re, -list_dot_product(l, s) as {v}_im from {out}_l, tw{n} where k <= {n // 2})",
            *_turned(f"{out}_z", "iy", "ky", "tile, ix, kz", [v], f"{out}_y", "+", n), *_turned(f"{out}_y", "ix", "kx", "tile, ky, kz", [v], out, "+", n)]


def tile_ifft(src: str, vals: list[str], out: str, n: int) -> list[str]:
    w = f"(case when kz in (0, {n // 2}) then 1.0 else 2.0 end) / {float(n**3)!r}"
    packed = ", ".join(f"list({v}_{p} * {w} order by kz) as {v}_{p}" for v in vals for p in ("re", "im"))
    half = lambda t: f"list_slice({t}, 1, {n // 2 + 1})"
    real = ", ".join(f"list_dot_product({v}_re, {half('c')}) - list_dot_product({v}_im, {half('s')}) as {v}" for v in vals)
    return [*_turned(src, "kx", "ix", "tile, ky, kz", vals, f"{out}_x", "-", n), *_turned(f"{out}_x", "ky", "iy", "tile, ix, kz", vals, f"{out}_y", "-", n),
            f"{out}_w as (select tile, ix, iy, {packed} from {out}_y group by tile, ix, iy)",
            f"{out} as (select tile, ix, iy, k as iz, {real} from {out}_w, tw{n})"]


def waves(src: str, out: str, n: int = N, kf: float = KF) -> str:
    """Add wavenumbers and k2; the Nyquist index is negative along x and y, positive along z."""
    sg = lambda c: f"(case when {c} >= {n // 2} then {c} - {n} else {c} end)"
    return (f"{out} as (select *, {sg('kx')} * {kf!r} as wx, {sg('ky')} * {kf!r} as wy, kz * {kf!r} as wz,"
            f" {sg('kx')} * {sg('kx')} + {sg('ky')} * {sg('ky')} + kz * kz as n2 from {src})")


def sinc(e: str) -> str:
    return f"(case when {e} = 0 then 1.0 else sin({e}) / ({e}) end)"


def win(order: int, ratio: float = 1.0) -> str:
    """Assignment window for cells ``ratio`` times the mesh cell."""
    half = ratio * BOX / N / 2
    return " * ".join(f"pow({sinc(f'(w{a} * {half!r})')}, {order})" for a in "xyz")


K2 = f"(n2 * {KF * KF!r})"
SAFE = f"(case when n2 = 0 then 1.0 else {K2} end)"
CNT = "t as (select count(*) as m from p)"
DENS = f"d as (select ix, iy, iz, q / 4096.0 / (m / {float(N**3)!r}) as d from mesh, t)"
TSC = [P, CNT] + mesh("p", "tsc", N) + [DENS]


def force(src: str, factor: str, v: str = "d", kf: float = KF, by: str = "", out: str = "kf") -> str:
    """ik / k2 times a factor, on spectrum rows with waves."""
    safe = f"(case when n2 = 0 then 1.0 else (n2 * {kf * kf!r}) end)"
    comp = ", ".join(f"-w{a} * {v}_im * ({factor}) / {safe} as g{a}_re, w{a} * {v}_re * ({factor}) / {safe} as g{a}_im" for a in "xyz")
    return f"{out} as (select {by}kx, ky, kz, {comp} from {src})"


G3 = ["gx", "gy", "gz"]


def force_sql(factor: str, digits: int = 8) -> str:
    return sql(TSC + fft("d", ["d"], "f") + [waves("f", "fw"), force("fw", factor)] + ifft("kf", G3, "g"),
               "select ix, iy, iz, " + ", ".join(f"{rd(c, digits)} as {c}" for c in G3) + " from g")


SQL["dft_spectrum"] = sql([P] + mesh("p", "tsc", N) + fft("mesh", ["q"], "f"),
                          f"select kx, ky, kz, {rd('q_re', 1)} as re, {rd('q_im', 1)} as im from f")
SQL["inverse_roundtrip"] = SQL["tsc_paint_int"]
_S = f"exp(-{K2} * {GEO.r_s ** 2!r})"
SQL["poisson_force"] = force_sql("1.0")
SQL["long_force"] = force_sql(_S)
SQL["short_force"] = force_sql(f"1.0 - {_S}")
_ratio = GEO.fine_cell / GEO.coarse_cell
SQL["coarse_force_matched"] = force_sql(f"{_S} * ({win(4, _ratio)}) / ({win(6)})")
SQL["zeldovich_displacement"] = force_sql("1.0")


def read_back(scheme: str, field: str, src: str) -> list[str]:
    w = " * ".join(f"({weight(a, scheme, o)})" for a, o in zip("xyz", "ijk"))
    at = " and ".join(f"m.i{a} = {mod(f's.c{a} + {o}', N)}" for a, o in zip("xyz", "ijk"))
    return [f"sr as (select *, row_number() over () as rid from {src})",
            "rb as (select rid, any_value(s.x) as x, any_value(s.y) as y, any_value(s.z) as z, any_value(s.vx) as vx,"
            " any_value(s.vy) as vy, any_value(s.vz) as vz, " + ", ".join(f"sum({w} * {c}) as {c}" for c in G3)
            + f" from sr s, off_{scheme} join {field} m on {at} group by rid)"]


# each of the 64 tiles is a periodic box of 32 fine cells: 16 of its own between buffers of 8
_TK = 2 * math.pi / 16.0
_TS = f"1.0 - exp(-(n2 * {_TK * _TK!r}) * {GEO.r_s ** 2!r})"
TILE_FORCE = [CNT, turns(32)] + TILES + [
    "tq as (select tile, ix, iy, iz, sum(q) as q from dl group by all)",
    "tg0 as (select i // 32768 as tile, i // 1024 % 32 as ix, i // 32 % 32 as iy, i % 32 as iz from range(2097152) r(i))",
    f"td as (select tile, ix, iy, iz, coalesce(q, 0) / 4096.0 * {64.0**3!r} / m as d from tg0 left join tq using (tile, ix, iy, iz), t)"] + tile_fft(
    "td", "d", "tf", 32) + [waves("tf", "tw_k", 32, _TK), force("tw_k", _TS, kf=_TK, by="tile, ", out="tk")] + tile_ifft("tk", G3, "tg", 32) + [
    "ro as (select rid, dx, dy, dz, i, j, k, (cx // 16) * 16 + (cy // 16) * 4 + cz // 16 as tile,"
    " cx % 16 + 8 + i as ix, cy % 16 + 8 + j as iy, cz % 16 + 8 + k as iz from st, off_cic)",
    "tr as (select rid, " + ", ".join(f"sum({_w8} * {c}) as {c}" for c in G3) + " from ro join tg using (tile, ix, iy, iz) group by rid)"]
NUMBERED = f"p as materialized (select *, row_number() over () as rid from ({particles_sql()}))"
_three = lambda src: ", ".join(f"{rd(src.format(c), 7)} as {c}" for c in G3)
SQL["tiled_short_force"] = sql([NUMBERED] + TILE_FORCE, f"select x, y, z, {_three('{}')} from tr join p using (rid)")
# the long arm: coarse mesh, split kernel times the window match, read with the same stencil
_wt = " * ".join(f"({weight(a, 'tsc', o)})" for a, o in zip("xyz", "ijk"))
TWO_LEVEL = [NUMBERED] + TILE_FORCE + mesh("p", "tsc", N) + [DENS] + fft("d", ["d"], "f") + [
    waves("f", "fw"), force("fw", f"{_S} * ({win(4, _ratio)}) / ({win(6)})")] + ifft("kf", G3, "lg") + [
    "lo_r as (select rid, dx, dy, dz, i, j, k, " + ", ".join(f"{mod(f'c{a} + {o}', N)} as i{a}" for a, o in zip("xyz", "ijk")) + " from st_mesh, off_tsc)",
    "lr as (select rid, " + ", ".join(f"sum({_wt} * {c}) as {c}" for c in G3) + " from lo_r join lg using (ix, iy, iz) group by rid)",
    "tw_l as (select rid, " + ", ".join(f"lr.{c} + tr.{c} as {c}" for c in G3) + " from lr join tr using (rid))"]
SQL["two_level_force"] = sql(TWO_LEVEL, f"select x, y, z, {_three('{}')} from tw_l join p using (rid)")
# one mesh of 64 cells a side: the same steps with a single tile
SQL["force_error_percentiles"] = sql(TWO_LEVEL + [turns(64)] + mesh("p", "cic", 64, "fine", "fine") + [
    "fg as (select 0 as tile, i // 4096 as ix, i // 64 % 64 as iy, i % 64 as iz from range(262144) r(i))",
    f"fd as (select tile, ix, iy, iz, coalesce(q, 0) / 4096.0 * {64.0**3!r} / m as d from fg left join fine using (ix, iy, iz), t)"]
    + tile_fft("fd", "d", "ff", 64) + [waves("ff", "fk", 64), force("fk", "1.0", by="tile, ", out="fo")] + tile_ifft("fo", G3, "fs", 64) + [
    "fo_r as (select rid, dx, dy, dz, i, j, k, " + ", ".join(f"{mod(f'c{a} + {o}', 64)} as i{a}" for a, o in zip("xyz", "ijk")) + " from st_fine, off_cic)",
    "sr1 as (select rid, " + ", ".join(f"sum({_w8} * {c}) as {c}" for c in G3) + " from fo_r join fs using (ix, iy, iz) group by rid)",
    "er as (select sqrt(" + " + ".join(f"pow(tw_l.{c} - sr1.{c}, 2)" for c in G3) + ") as e, "
    + " + ".join(f"pow(sr1.{c}, 2)" for c in G3) + " as w from tw_l join sr1 using (rid))"],
    f"select {rd('sqrt(avg(w))', 7)} as rms, {rd('quantile_cont(e, 0.5) / sqrt(avg(w))', 7)} as p50, {rd('quantile_cont(e, 0.95) / sqrt(avg(w))', 7)} as p95 from er")


def mono_at(src: str = "p") -> list[str]:
    """Single-mesh CIC force at every row of ``src``."""
    return (mesh(src, "cic", N) + [DENS] + fft("d", ["d"], "f") + [waves("f", "fw"), force("fw", "1.0")]
            + ifft("kf", G3, "g") + read_back("cic", "g", "st_mesh"))


SQL["global_force"] = sql([P, CNT] + mono_at(), "select x, y, z, " + ", ".join(f"{rd(c, 7)} as {c}" for c in G3) + " from rb")

_pairs = [a + b for a, b in (("x", "x"), ("y", "y"), ("z", "z"), ("x", "y"), ("x", "z"), ("y", "z"))]
_SRC2 = TSC + fft("d", ["d"], "f") + [waves("f", "fw"), "k6 as (select kx, ky, kz, " + ", ".join(
    f"-w{p[0]} * w{p[1]} * d_re / {SAFE} as {p}_re, -w{p[0]} * w{p[1]} * d_im / {SAFE} as {p}_im" for p in _pairs) + " from fw)"] \
    + ifft("k6", _pairs, "h6") + ["s2 as (select ix, iy, iz, xx*yy + xx*zz + yy*zz - xy*xy - xz*xz - yz*yz as d2 from h6)"]
SQL["lpt2_source"] = sql(_SRC2, f"select ix, iy, iz, {rd('d2', 8)} as delta2 from s2")
_PSI2 = _SRC2 + fft("s2", ["d2"], "f2") + [waves("f2", "fw2"), force("fw2", "1.0", "d2")] + ifft("kf", G3, "h")
SQL["second_order_displacement"] = sql(_PSI2, "select ix, iy, iz, " + ", ".join(f"{rd(c, 8)} as {c}" for c in G3) + " from h")
_PSI1 = TSC + fft("d", ["d"], "f") + [waves("f", "fw"), force("fw", "1.0")] + ifft("kf", G3, "g")
_DIV = _PSI1 + fft("g", G3, "gf") + [waves("gf", "gw"),
    "dk as (select kx, ky, kz, -(" + " + ".join(f"w{a} * g{a}_im" for a in "xyz") + ") as v_re, "
    + " + ".join(f"w{a} * g{a}_re" for a in "xyz") + " as v_im from gw)"] + ifft("dk", ["v"], "dv")
SQL["displacement_divergence"] = sql(_DIV, f"select ix, iy, iz, {rd('v', 8)} as div from dv")
_RES = _DIV + ["rs as (select ix, iy, iz, coalesce(d, 0) - 1.0 as a, v + coalesce(d, 0) - 1.0 as r from dv left join d using (ix, iy, iz))"] \
    + fft("rs", ["a", "r"], "rf") + ["pw as (select kx = 8 or ky = 8 or kz = 8 as nyq, a_re*a_re + a_im*a_im as pa, r_re*r_re + r_im*r_im as pr from rf)"]
SQL["residual_power"] = sql(_RES, f"select {rd('sum(pr) / sum(pa)', 9)} as resid_all, {rd('sum(pr) filter (not nyq) / sum(pa) filter (not nyq)', 9)} as resid_off,"
                            f" {rd('sum(pr) filter (nyq) / sum(pa) filter (nyq)', 9)} as resid_on, {rd('sum(pa) filter (nyq) / sum(pa)', 9)} as field_on from pw")
_da, _f1 = C.growth(0.1, COSMO), C.growth_rate(0.1, COSMO)
_db, _f2 = C.growth2(0.1, COSMO), C.growth2_rate(0.1, COSMO)
_co = -(_db * _f2) / (_da * _f1)
_P12 = _PSI2[:-len(ifft("kf", G3, "h")) - 1] + [force("fw2", "1.0", "d2").replace("kf as", "kf2 as")] + ifft("kf2", G3, "h") \
    + [force("fw", "1.0")] + ifft("kf", G3, "g")
SQL["lpt_particles"] = sql(_P12, f"select (ix * {N} + iy) * {N} + iz as id, " + ", ".join(
    f"{rd(fmod(f'i{a} * 2.0 + ({_da!r} * g.g{a} - ({_db!r}) * h.g{a})', BOX), 7)} as {a}, {rd(f'g.g{a} + ({_co!r}) * h.g{a}', 7)} as v{a}" for a in "xyz")
    + " from g join h using (ix, iy, iz)")
SQL["plane_square_sums"] = sql(TSC, f"select ix, {rd('sum(d * d)', 7)} as sq from d group by ix")


def _top(R):
    x = f"(sqrt(n2) * {KF * R!r})"
    return f"(3.0 * (sin({x}) - {x} * cos({x})) / pow({x}, 3))"


def smooth(radii, cic=False):
    w = f" / ({win(2)})" if cic else ""
    cols = ", ".join(f"case when n2 = 0 then 0.0 else d_re * {_top(R)}{w} end as r{i}_re, case when n2 = 0 then 0.0 else d_im * {_top(R)}{w} end as r{i}_im"
                     for i, R in enumerate(radii))
    return TSC + fft("d", ["d"], "f") + [waves("f", "fw"), f"sk as (select kx, ky, kz, {cols} from fw)"] \
        + ifft("sk", [f"r{i}" for i in range(len(radii))], "sm")


SQL["tophat_smoothed"] = sql(smooth([4.0, 6.0], True), f"select ix, iy, iz, {rd('r0', 8)} as r0, {rd('r1', 8)} as r1 from sm")

# ---- statistics ----
_MODES = TSC + fft("d", ["d"], "f") + [waves("f", "fw")]
_BIN = "cast(floor(sqrt(n2) - 0.5) as bigint)"
SQL["shell_mask"] = sql([P] + mesh("p", "tsc", N) + fft("mesh", ["q"], "f") + [waves("f", "fw")],
                        f"select kx, ky, kz, {rd('q_re', 1)} as re from fw where sqrt(n2) >= 2.5 and sqrt(n2) < 3.5")
_NORM = BOX**3 / float(N) ** 6


def pk(power: str, ctes) -> str:
    return sql(ctes + [f"b as (select {_BIN} as bin, {power} as p from fw)"],
               f"select bin, {rd('avg(p)', 7)} as p, count(*) as n_modes, {rd(f'(bin + 1.0) * {KF!r}', 7)} as k from b where bin between 0 and {N // 2 - 1} group by bin")


SQL["pk_estimator"] = pk(f"(d_re*d_re + d_im*d_im) * {_NORM!r}", _MODES)
SQL["pk_deconvolved"] = pk(f"(d_re*d_re + d_im*d_im) * {_NORM!r} / pow({win(2)}, 2)",
                           [P, CNT] + mesh("p", "cic", N) + [DENS] + fft("d", ["d"], "f") + [waves("f", "fw")])
_ORD = [P, f"po as ({particles_sql('orders')})", "t as (select (select count(*) from p) as m, (select count(*) from po) as mo)"] \
    + mesh("p", "tsc", N) + mesh("po", "tsc", N, "mesho", "mesho") \
    + [f"d as (select ix, iy, iz, coalesce(a.q, 0) / 4096.0 / (m / {float(N**3)!r}) as d, coalesce(b.q, 0) / 4096.0 / (mo / {float(N**3)!r}) as o"
       " from mesh a full join mesho b using (ix, iy, iz), t)"]
_TWO = _ORD + fft("d", ["d", "o"], "f") + [waves("f", "fw")]
SQL["cross_r"] = sql(_TWO + [f"b as (select {_BIN} as bin, d_re*d_re+d_im*d_im as aa, o_re*o_re+o_im*o_im as bb, d_re*o_re+d_im*o_im as ab from fw)"],
                     f"select bin, {rd(f'(bin + 1.0) * {KF!r}', 9)} as k, {rd('sum(ab) / sqrt(sum(aa) * sum(bb))', 9)} as r, count(*) as n_modes from b where bin between 0 and {N // 2 - 1} group by bin")
SQL["spectrum_ratio"] = sql(_TWO + [f"b as (select {_BIN} as bin, d_re*d_re+d_im*d_im as aa, o_re*o_re+o_im*o_im as bb from fw)"],
                            f"select bin, {rd(f'(bin + 1.0) * {KF!r}', 7)} as k, {rd('avg(aa) / avg(bb) - 1.0', 7)} as ratio from b where bin between 0 and {N // 2 - 1} group by bin")
_sh = [(c - 0.5, c + 0.5) for c in (2, 4, 6)] + [(20, 21)]
SQL["band_power"] = sql(_MODES + ["sh as (select * from (values " + ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(_sh)) + ") s(shell, lo, hi))"],
                        f"select shell::bigint as shell, {rd(f'coalesce(sum(d_re*d_re + d_im*d_im) * {_NORM!r} / count(n2), cast(chr(110) || chr(97) || chr(110) as double))', 7)} as p, count(n2) as n_modes"
                        " from sh left join fw on sqrt(n2) >= lo and sqrt(n2) < hi group by shell")
_HW = f"case when kz in (0, {N // 2}) then 1.0 else 2.0 end"
_CARD = _MODES + [f"cb as (select cast(floor(sqrt(n2) - 0.25) as bigint) as bin, {_HW} as w, (d_re*d_re + d_im*d_im) * {_NORM!r} as raw,"
                  f" pow({win(3)}, 2) as w2, sqrt(n2) * {KF!r} as k, m from fw, t where n2 > 0)"]
_shot = f"({BOX**3!r} / any_value(m))"
SQL["pk_card"] = sql(_CARD, f"select bin, {rd('sum(k * w) / sum(w)', 8)} as k_mean, {rd(f'sum((raw / w2 - {BOX**3!r} / m) * w) / sum(w)', 6)} as p, sum(w) as n_modes,"
                     f" {rd('sum(w2 * w) / sum(w)', 8)} as window_correction, {rd(f'{_shot} / (sum(raw * w) / sum(w))', 6)} as shot_fraction"
                     f" from cb where bin between 0 and {len(EDGES) - 2} group by bin having sum(w) > 20")
SQL["card_shells_verified"] = sql(_CARD, f"select bin, n2, sum(w)::bigint as modes from (select *, cast(round(pow(k / {KF!r}, 2), 0) as bigint) as n2 from cb)"
                                  f" where bin between 0 and {len(EDGES) - 3} group by bin, n2 qualify sum(sum(w)) over (partition by bin) > 20")  # bins of the card
SQL["card_bin_shells"] = sql(_CARD, f"select bin, n2::bigint as n2, sum(w) as modes, {rd(f'sum(w * raw) / {_NORM!r}', 4)} as power from (select *, cast(round(pow(k / {KF!r}, 2), 0) as bigint) as n2 from cb)"
                             " where bin between 0 and 5 group by bin, n2")
_ph = f"({BOX / N / 2!r} * (wx + wy + wz))"
_F2 = float_mesh("p", "tsc", N, {"g0": "1.0"})
_F3 = [s.replace("st_f as", "st_h as").replace("from st_f,", "from st_h,") for s in float_mesh("p", "tsc", N, {"g1": "1.0"}, " + 0.5", "fh")[1:]]
SQL["interlaced_pk"] = sql(
    [P, CNT] + _F2 + _F3 + ["d as (select ix, iy, iz, coalesce(g0, 0) as g0, coalesce(g1, 0) as g1 from fm full join fh using (ix, iy, iz))"]
    + fft("d", ["g0", "g1"], "f") + [waves("f", "fw"),
    f"il as (select n2, {_HW} as w, wx, wy, wz, 0.5 * (g0_re + g1_re * cos({_ph}) - g1_im * sin({_ph})) as re, 0.5 * (g0_im + g1_im * cos({_ph}) + g1_re * sin({_ph})) as im from fw)",
    f"b as (select cast(floor((sqrt(n2) - 0.5) / 2) as bigint) as bin, w, sqrt(n2) * {KF!r} as k, (re*re + im*im) / pow({win(3)}, 2) * {_NORM!r} * pow({float(N**3)!r} / m, 2) as p, m from il, t)"],
    f"select bin, {rd('sum(k * w) / sum(w)', 6)} as k, {rd(f'sum(p * w) / sum(w) - {_shot}', 6)} as p, {rd('sum(p * w) / sum(w)', 6)} as p_raw, sum(w) as n_modes"
    f" from b where bin between 0 and {len([e for e in range(100) if 0.5 + 2 * e < N / 2 + 2]) - 2} group by bin")
_nv = len([e for e in range(100) if 0.5 + 2 * e < N / 2]) - 1
_MOM = {"rho": "1.0", "px": "vx", "py": "vy", "pz": "vz"}
SQL["velocity_spectra"] = sql(
    [P, CNT] + float_mesh("p", "cic", N, _MOM, " - 0.5") + fft("fm", list(_MOM), "f") + [waves("f", "fw"),
    f"b as (select cast(floor((sqrt(n2) - 0.5) / 2) as bigint) as bin, {_HW} as w, sqrt(n2) * {KF!r} as k, pow({float(N**3)!r} / m, 2) as s, rho_re*rho_re + rho_im*rho_im as d,"
    " px_re*px_re+px_im*px_im+py_re*py_re+py_im*py_im+pz_re*pz_re+pz_im*pz_im as mo, pow(wx*px_re+wy*py_re+wz*pz_re, 2) + pow(wx*px_im+wy*py_im+wz*pz_im, 2) as th from fw, t)"],
    f"select bin, {rd('sum(k*w)/sum(w)', 4)} as k, sum(w) as n_modes, {rd('sum(d*w*s)/sum(w)', 4)} as p_density, {rd('sum(mo*w*s)/sum(w)', 4)} as p_momentum,"
    f" {rd('sum(th*w*s)/sum(w)', 4)} as p_divergence from b where bin between 0 and {_nv - 1} group by bin")


def bisp(ctes, fields, tris, ratio="1.0"):
    legs = sorted({leg / KF for t in tris for leg in t})
    names = {round(v, 9): i for i, v in enumerate(legs)}
    sel, outs = [], []
    for f in dict.fromkeys(fields):
        for i, c in enumerate(legs):
            on = f"(sqrt(n2) >= {c - 0.5!r} and sqrt(n2) < {c + 0.5!r})"
            sel += [f"case when {on} then {f}_re else 0.0 end as {f}{i}_re, case when {on} then {f}_im else 0.0 end as {f}{i}_im"]
            outs.append(f"{f}{i}")
    for i, c in enumerate(legs):
        sel.append(f"case when sqrt(n2) >= {c - 0.5!r} and sqrt(n2) < {c + 0.5!r} then 1.0 else 0.0 end as j{i}_re, 0.0 as j{i}_im")
        outs.append(f"j{i}")
    rows = []
    for t, tri in enumerate(tris):
        a, b, c = (names[round(v / KF, 9)] for v in tri)
        s = f"sum({fields[0]}{a} * {fields[1]}{b} * {fields[2]}{c})"
        j = f"sum(j{a} * j{b} * j{c})"
        n6 = float(N) ** 6
        rows.append(f"select {t}::bigint as triangle, case when {j} * {n6!r} >= 0.5 then {rd(f'{BOX**6 / float(N)**9!r} * {s} / {j}', 4)} else cast('nan' as double) end as b,"
                    f" case when {j} * {n6!r} >= 0.5 then {rd(f'{j} * {n6!r}', 4)} else 0.0 end as n_triplets from bf")
    return sql(ctes + [f"bk as (select kx, ky, kz, {', '.join(sel)} from fw)"] + ifft("bk", outs, "bf"), " union all ".join(rows))


SQL["bispectrum"] = bisp(_MODES, ("d", "d", "d"), TRIANGLES)
SQL["cross_bispectrum"] = bisp(_TWO, ("d", "o", "o"), TRIANGLES[:2])

# sub-cubes of 4 cells, origin shifted by 2; one band around the sub-box fundamental
_SUB = TSC + [
    f"g as (select i // 256 as ix, i // 16 % 16 as iy, i % 16 as iz from range(4096) r(i))",
    f"sb as (select ((({mod('ix - 2', 16)}) // 4) * 4 + ({mod('iy - 2', 16)}) // 4) * 4 + ({mod('iz - 2', 16)}) // 4 as sub, ({mod('ix - 2', 16)}) % 4 as ix,"
    f" ({mod('iy - 2', 16)}) % 4 as iy, ({mod('iz - 2', 16)}) % 4 as iz, coalesce(d, 0) - 1.0 as v from g left join d using (ix, iy, iz))",
    "sm as (select sub, avg(v) as delta_bar from sb group by sub)",
    f"sf as (select sub, kx, ky, kz, sum(v * {_c('kx*ix + ky*iy + kz*iz', 4)}) as re, sum(v * {_s('kx*ix + ky*iy + kz*iz', 4)}) as im"
    " from sb, range(4) a(kx), range(4) b(ky), range(3) c(kz) group by all)",
    "sp as (select *, (case when kx >= 2 then kx - 4 else kx end) as ax, (case when ky >= 2 then ky - 4 else ky end) as ay from sf)",
    f"pw as (select sub, avg((re*re + im*im) * {8.0**3 / 4.0**6!r}) as p from sp where sqrt(ax*ax + ay*ay + kz*kz) >= 0.5 and sqrt(ax*ax + ay*ay + kz*kz) < 1.5 group by sub)",
    "sv as (select sub, delta_bar, p from sm join pw using (sub))"]
SQL["subvolume_power"] = sql(_SUB, f"select sub, {rd('delta_bar', 12)} as delta_bar, 0::bigint as band, {rd('p', 7)} as p from sv")
SQL["subvolume_response"] = sql(
    _SUB + ["mn as (select avg(p) as p_mean from sv)", "y as (select delta_bar as x, p / p_mean - 1.0 as y, p_mean from sv, mn)",
            "ft as (select any_value(p_mean) as p_mean, regr_slope(y, x) as slope, regr_sxx(y, x) as sxx, regr_syy(y, x) as syy, count(*) as n from y)"],
    f"select 0::bigint as band, {rd('p_mean', 6)} as p_mean, {rd('slope', 6)} as slope, {rd('sqrt((syy - slope*slope*sxx) / (n - 2) / sxx)', 6)} as slope_err, n as n_blocks from ft")


def moments(col: str, scale: str, name: str) -> str:
    return (f"{name} as (select ((ix // 4) * 4 + iy // 4) * 4 + iz // 4 as sub, avg(pow({col} * {scale}, 2)) as m2, avg(pow({col} * {scale}, 3)) as m3 from sm group by all)")


SQL["sub_moments"] = sql(smooth([4.0]) + [moments("r0", "10.0", "mo")], f"select sub, {rd('m2', 7)} as m2, {rd('m3', 7)} as m3 from mo")
_JK = "tt as (select count(*) as n, sum(m2) as s2, sum(m3) as s3 from mo), lo as (select ((s3 - m3) / (n - 1)) / pow((s2 - m2) / (n - 1), 2) as v from mo, tt)"


def _linear_variance(R: float) -> float:
    """Trapezoids in ln k, finer than the library's own rule."""
    u = np.linspace(math.log(C.K_MIN), math.log(C.K_MAX), 40001)
    k = np.exp(u)
    y = k**3 * C.linear_power(k, COSMO) * (3.0 * (np.sin(k * R) - k * R * np.cos(k * R)) / (k * R) ** 3) ** 2 / (2.0 * math.pi**2)
    return float(((y[1:] + y[:-1]) / 2.0 * np.diff(u)).sum())


def _theory(i: int, R: float) -> str:
    """One radius: sums over modes with the top hat W and x W', and constants of linear theory by a difference quotient."""
    x = f"(sqrt(n2) * {KF * R!r})"
    e = 1e-3
    slope = math.log(_linear_variance(R * (1 + e)) / _linear_variance(R * (1 - e))) / math.log((1 + e) / (1 - e))
    return (f"select {i} as r, {R!r} as radius, sum(w * {_top(R)} * {_top(R)}) as sigma2, sum(w * {_top(R)} * 6.0 * (sin({x}) / {x} - {_top(R)})) as g,"
            f" {_linear_variance(R)!r} as sigma2_linear, {slope!r} as gamma_linear from md")


SQL["skewness_theory"] = sql(
    smooth([4.0, 6.0]) + [
        f"md as (select n2, (case when kz in (0, {N // 2}) then 1.0 else 2.0 end) * (d_re * d_re + d_im * d_im) / {float(N)**6!r} as w from fw where n2 > 0)",
        f"th as ({_theory(0, 4.0)} union all {_theory(1, 6.0)})",
        "mo as (select r, ((ix // 4) * 4 + iy // 4) * 4 + iz // 4 as sub, avg(pow(v, 2)) as m2, avg(pow(v, 3)) as m3 from"
        " (select 0 as r, ix, iy, iz, r0 as v from sm union all select 1, ix, iy, iz, r1 from sm) group by all)",
        "tt as (select r, count(*) as n, sum(m2) as s2, sum(m3) as s3 from mo group by r)",
        "lo as (select r, sqrt((any_value(n) - 1) * var_pop(((s3 - m3) / (n - 1)) / pow((s2 - m2) / (n - 1), 2))) as err from mo join tt using (r) group by r)"],
    f"select radius, {rd('sigma2', 7)} as sigma2, {rd('g / sigma2', 7)} as gamma, {rd('sigma2_linear', 3)} as sigma2_linear, {rd('gamma_linear', 3)} as gamma_linear,"
    f" {rd('(s3 / n) / pow(s2 / n, 2)', 4)} as s3, {rd('err', 4)} as s3_err, {rd('34.0 / 7.0 + g / sigma2', 7)} as s3_tree, {rd('4.0 + g / sigma2', 7)} as s3_zeldovich"
    " from th join tt using (r) join lo using (r)")
SQL["skewness_jackknife"] = sql(smooth([4.0]) + [moments("r0", "1.0", "mo"), _JK],
                                f"select n as n_sub, {rd('(s3 / n) / pow(s2 / n, 2)', 5)} as s3, (select {rd('sqrt((count(*) - 1) * var_pop(v))', 5)} from lo) as s3_err from tt")
_R3 = 4.0
_sub = "((ix // 4) * 4 + iy // 4) * 4 + iz // 4 as sub"


def _smooth_of(src: str, val: str, out: str, cic: bool = False) -> list[str]:
    """Top-hat smoothing of a cell field."""
    w = f" / ({win(2)})" if cic else ""
    part = lambda p: f"case when n2 = 0 then 0.0 else {val}_{p} * {_top(_R3)}{w} end as {out}_{p}"
    return fft(src, [val], f"{out}_f") + [waves(f"{out}_f", f"{out}_w"), f"{out}_k as (select kx, ky, kz, {part('re')}, {part('im')} from {out}_w)"] \
        + ifft(f"{out}_k", [out], f"{out}_c")


_DIV2 = fft("h", G3, "hf") + [waves("hf", "hw"), "dk as (select kx, ky, kz, -(" + " + ".join(f"w{a} * g{a}_im" for a in "xyz") + ") as v_re, "
                              + " + ".join(f"w{a} * g{a}_re" for a in "xyz") + " as v_im from hw)"] + ifft("dk", ["v"], "dv")
_TREE = _DIV2 + _smooth_of("d", "d", "u") + _smooth_of("dv", "v", "s") \
    + [f"mt as (select {_sub}, avg(pow({_da!r} * u, 2)) as m2, 3.0 * avg(pow({_da!r} * u, 2) * {_db!r} * s) as m3 from u_c join s_c using (ix, iy, iz) group by all)"]
SQL["tree_skewness"] = sql(
    _PSI2 + _TREE + [_JK.replace("from mo,", "from mt,").replace("from mo)", "from mt)")],
    f"select n as n_sub, {rd('(s3 / n) / pow(s2 / n, 2)', 4)} as ds3_tree, (select {rd('sqrt((count(*) - 1) * var_pop(v))', 4)} from lo) as ds3_tree_err from tt")
_moved = lambda second: ", ".join(fmod(f"i{a} * 2.0 + ({_da!r} * g.g{a} - ({second!r}) * h.g{a})", BOX) + f" as {a}" for a in "xyz")


def _painted(tag: str, second: float) -> list[str]:
    st = [c.replace("st_f", f"st_{tag}") for c in float_mesh(f"p_{tag}", "cic", N, {"w": "1.0"}, "", f"c_{tag}")[1:]]
    return [f"p_{tag} as (select {_moved(second)} from g join h using (ix, iy, iz))"] + st + _smooth_of(f"c_{tag}", "w", f"z{tag}", True) \
        + [f"m_{tag} as (select {_sub}, avg(pow(z{tag}, 2)) as m2, avg(pow(z{tag}, 3)) as m3 from z{tag}_c group by all)"]


SQL["paired_skewness"] = sql(
    _P12 + [offsets("cic")] + _painted("b", _db) + _painted("a", 0.0) + _TREE
    + ["j as (select " + ", ".join(f"{t}.m{i} as {o}{i}" for t, o in (("m_b", "p"), ("m_a", "q"), ("mt", "t")) for i in (2, 3))
       + " from m_b join m_a using (sub) join mt using (sub))",
       "al as (select count(*) as n, " + ", ".join(f"sum({o}{i}) as s{o}{i}" for o in "pqt" for i in (2, 3)) + " from j)",
       "lo as (select " + ", ".join(f"((s{o}3 - {o}3) / (n - 1)) / pow((s{o}2 - {o}2) / (n - 1), 2) as {o}" for o in "pqt") + " from j, al)",
       "er as (select " + ", ".join(f"sqrt((count(*) - 1) * var_pop({e})) as {k}" for k, e in (("e1", "p - q"), ("e2", "t"), ("e3", "p - q - t"))) + " from lo)",
       "wh as (select " + ", ".join(f"(s{o}3 / n) / pow(s{o}2 / n, 2) as {o}" for o in "pqt") + " from al)"],
    f"select {rd('p - q', 4)} as ds3, {rd('e1', 4)} as ds3_err, {rd('t', 4)} as tree, {rd('e2', 4)} as tree_err, {rd('p - q - t', 4)} as remainder,"
    f" {rd('e3', 4)} as remainder_err from wh, er")

# ---- evolution ----
M64 = 2**64


def mul(e: str, c: int) -> str:
    return f"cast((cast({e} as uhugeint) * {c}::uhugeint) % {M64}::uhugeint as ubigint)"


def dither(src: str, key: int, name: str = "di") -> list[str]:
    h = f"xor(xor({mul('jx', AXIS_MUL['x'])}, {mul('jy', AXIS_MUL['y'])}), {mul('jz', AXIS_MUL['z'])})"
    salt = {a: (key * 3 + i) * KEY_MUL % M64 for i, a in enumerate("xyz", 1)}
    return [f"di_h as (select *, {h} as hh from {src})",
            "di_0 as (select *, " + ", ".join(f"xor(hh, {salt[a]}::ubigint) as z{a}" for a in "xyz") + " from di_h)",
            "di_1 as (select * replace (" + ", ".join(f"{mul(f'xor(z{a}, z{a} >> 30)', MIX[0])} as z{a}" for a in "xyz") + ") from di_0)",
            "di_2 as (select * replace (" + ", ".join(f"{mul(f'xor(z{a}, z{a} >> 27)', MIX[1])} as z{a}" for a in "xyz") + ") from di_1)",
            f"{name} as (select *, " + ", ".join(f"cast(xor(z{a}, z{a} >> 31) >> 11 as bigint) as u_{a}" for a in "xyz") + " from di_2)"]


SQL["dither_bits"] = sql([P, lattice("p")] + dither("lat", DITHER_KEY), "select jx, jy, jz, u_x, u_y, u_z from di")


def moved(src: str, dithered: bool) -> list[str]:
    x = lambda a: f"(j{a} * {Q!r}) / {Q!r} + ({DRIFT!r} * (w_{a} * vel_scale)) / {Q!r}"
    if dithered:
        new = {a: f"cast(floor({x(a)} + cast(u_{a} as double) * pow(2.0, -53)) as bigint)" for a in "xyz"}
    else:
        new = {a: rint(x(a)) for a in "xyz"}
    return ["mv as (select brick as src, vel_scale, w_x, w_y, w_z, jx as ox, jy as oy, jz as oz, " + ", ".join(f"{mod(new[a], LEVELS)} as j{a}" for a in "xyz") + f" from {src})",
            keyed("mv", "dr")]


_NEAR = ENC + moved("c", False)
_DITH = ENC + dither("c", DITHER_KEY) + moved("di", True)
SQL["drift_nearest"] = sql(_NEAR, "select jx, jy, jz, src, brick from dr")
SQL["drift_dithered"] = sql(_DITH, "select jx, jy, jz, src, brick from dr")
SQL["dest_census"] = sql(_DITH, "select brick, count(*) as n, count(*) filter (src <> brick) as immigrants from dr group by brick")
SQL["migration_stats"] = sql(_NEAR, f"select count(*) as n, count(*) filter (src <> brick) as migrants, max(abs({mod('brick // 64 - src // 64 + 4', 8)} - 4)) as realized_reach,"
                             f" {rd('count(*) filter (src <> brick) / count(*)', 9)} as migrant_frac from dr")
_MS = "ms as (select brick, case when max(greatest(abs(w_x), abs(w_y), abs(w_z)) * vel_scale) > 0 then max(greatest(abs(w_x), abs(w_y), abs(w_z)) * vel_scale) / 32767.0 else 1.0 end as s, count(*) as n from dr group by brick)"
SQL["migrate_scales"] = sql(_DITH + [_MS], "select brick, s as vel_scale, n from ms")
SQL["migrate_rescale"] = sql(_DITH + [_MS], "select brick, bucket, off_x, off_y, off_z, " + ", ".join(f"{rint(f'w_{a} * (vel_scale / s)')} as w_{a}" for a in "xyz") + " from dr join ms using (brick)")
SQL["brick_reach"] = sql(ENC, f"select cast(ceil({DRIFT!r} * max(vel_scale) * 32767 / 4.0) as bigint) as reach from sc")
SQL["min_image_rms"] = sql(_NEAR, "select " + rd("sqrt(avg(" + " + ".join(f"pow(({e}) - 32.0 * round_even(({e}) / 32.0, 0), 2)" for e in
                           (f"(j{a} - o{a}) * {Q!r}" for a in "xyz")) + ") / 3.0)", 9) + " as rms from dr")
_EM = ["em as (select " + ", ".join(f"{fmod(a, BOX)} as {a}" for a in "xyz") + ", vx, vy, vz from raw)", lattice("em", keep="vx, vy, vz"),
       keyed("lat"), SCALES]
SQL["codec_emulation"] = sql([PL, RAW] + _EM, "select " + ", ".join(f"j{a} * {Q!r} as {a}" for a in "xyz") + ", "
                             + ", ".join(f"{rd(f'round_even(v{a} / vel_scale, 0) * vel_scale', 9)} as v{a}" for a in "xyz") + " from k join sc using (brick)")
SQL["quantisation_statistics"] = sql([P, "v as (select vx as v from p union all select vy from p union all select vz from p)"],
                                     f"select {rd(f'quantile_cont(abs(v * 0.004) / {Q!r}, 0.5)', 9)} as med, {rd(f'avg((abs(v * 0.004) / {Q!r} < 0.5)::int)', 9)} as below_half from v")


# ---- halos ----
def fof(src: str, t: str) -> list[str]:
    """Distance links through 32-level cells, labels by recursion, minimum-image centres."""
    link2 = (LINK * LEVELS / GEO.n_part) ** 2
    cells = LEVELS // 64
    d = " + ".join(f"pow(least(abs(a.j{c} - b.j{c}), {LEVELS} - abs(a.j{c} - b.j{c})), 2)" for c in "xyz")
    return [
        lattice(src, f"l_{t}", "0 as z0"),
        f"ps_{t} as (select (jx * {LEVELS} + jy) * {LEVELS} + jz as pos, jx, jy, jz, count(*) as n from l_{t} group by all)",
        f"nb_{t} as (select p.*, {', '.join(f'{mod(f'j{c} // 64 + {o}', cells)} as g{c}' for c, o in zip('xyz', 'ijk'))} from ps_{t} p,"
        " (select a.i, b.i as j, c.i as k from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i), (values (-1), (0), (1)) c(i)) o)",
        f"ed_{t} as (select a.pos as a, b.pos as b from nb_{t} a join ps_{t} b on {' and '.join(f'a.g{c} = b.j{c} // 64' for c in 'xyz')}"
        f" where a.pos <> b.pos and {d} <= {link2!r})",
        f"rc_{t}(a, r) as (select distinct a, a from ed_{t} union select e.b, r.r from rc_{t} r join ed_{t} e on e.a = r.a where r.r < e.b)",
        f"lb_{t} as (select p.*, coalesce(l.root, p.pos) as root from ps_{t} p left join (select a, min(r) as root from rc_{t} group by a) l on l.a = p.pos)",
        f"gr_{t} as (select root, sum(n) as size from lb_{t} group by root having sum(n) >= {FLOOR})",
        f"ct_{t} as (select root, n, root // {LEVELS**2} as rx, root // {LEVELS} % {LEVELS} as ry, root % {LEVELS} as rz, jx, jy, jz from lb_{t} join gr_{t} using (root))",
        f"h_{t} as (select root as halo_id, sum(n)::bigint as n, " + ", ".join(
            fmod(f"(any_value(r{c}) * {Q!r} + sum(n * ((j{c} - r{c}) - {LEVELS}.0 * round_even((j{c} - r{c}) / {LEVELS}.0, 0))) / sum(n) * {Q!r})", BOX) + f" as c{c}"
            for c in "xyz") + f" from ct_{t} group by root)"]


def recursive(ctes, body):
    return f"with recursive {', '.join(ctes)} {body}"


_H = "select halo_id, n, " + ", ".join(f"{rd(f'c{c}', 7)} as c{c}" for c in "xyz")
SQL["halo_fof"] = recursive([f"p as ({particles_sql('orders')})"] + fof("p", "a"), f"{_H} from h_a")
SQL["halo_fof_lineitem"] = recursive([P] + fof("p", "a"), f"{_H} from h_a")
_near = " + ".join(f"pow(least(abs(a.{c} - b.{c}), {BOX} - abs(a.{c} - b.{c})), 2)" for c in "xyz")
SQL["halo_fof_raw"] = recursive([
    f"p as ({particles_sql('lineitem', 'l_linenumber')})",
    "q as (select " + ", ".join(f"{c} + l_linenumber * {w * 2.0**-12!r} as {c}" for c, w in zip("xyz", (1, 3, 5))) + " from p)",
    "w as (select " + ", ".join(f"case when {c} >= {BOX} then {c} - {BOX} else {c} end as {c}" for c in "xyz") + " from q)",
    "ps as (select row_number() over (order by x, y, z) as pos, x, y, z, count(*) as n from w group by x, y, z)",
    "sh as (select a.i, b.i as j, c.i as k from (values (-1), (0), (1)) a(i), (values (-1), (0), (1)) b(i), (values (-1), (0), (1)) c(i))",
    "nb as (select p.*, " + ", ".join(f"{mod(f'floor({c} * 2)::bigint + {o}', 64)} as g{c}" for c, o in zip("xyz", "ijk")) + " from ps p, sh)",
    f"ed as (select a.pos as a, b.pos as b from nb a join ps b on {' and '.join(f'a.g{c} = floor(b.{c} * 2)::bigint' for c in 'xyz')}"
    f" where a.pos <> b.pos and {_near} <= {(LINK * BOX / GEO.n_part) ** 2!r})",
    "rc(a, r) as (select distinct a, a from ed union select e.b, r.r from rc r join ed e on e.a = r.a where r.r < e.b)",
    "lb as (select p.*, coalesce(l.root, p.pos) as root from ps p left join (select a, min(r) as root from rc group by a) l on l.a = p.pos)",
    "ct as (select l.root, l.n, l.x, l.y, l.z, r.x as x0, r.y as y0, r.z as z0 from lb l join ps r on r.pos = l.root)",
    "h as (select root, sum(n)::bigint as n, " + ", ".join(f"any_value({c}0) as {c}0" for c in "xyz") + ", " + ", ".join(
        fmod(f"(any_value({c}0) + sum(n * (({c} - {c}0) - {BOX} * round_even(({c} - {c}0) / {BOX}, 0))) / sum(n))", BOX) + f" as c{c}" for c in "xyz")
    + f" from ct group by root having sum(n) >= {FLOOR})"],
    "select row_number() over (order by n desc, root) - 1 as halo, n, x0, y0, z0, " + ", ".join(f"{rd(f'c{c}', 7)} as c{c}" for c in "xyz") + " from h")
_dx = moved("c", False)[0].replace(repr(DRIFT), "0.02").replace("mv as", "m2 as")
_CATS = ENC + [_dx, "pb as (select " + ", ".join(f"j{a} * {Q!r} as {a}" for a in "xyz") + " from m2)"] + fof("p", "a") + fof("pb", "b")
_D2 = " + ".join(f"pow((a.c{c} - b.c{c}) - 32.0 * round_even((a.c{c} - b.c{c}) / 32.0, 0), 2)" for c in "xyz")
_R200 = lambda n: f"pow({3.0 / (800.0 * math.pi)!r} * {n}, {1.0 / 3.0!r})"
_MATCH = _CATS + [
    f"pr as (select a.halo_id as a_id, b.halo_id as b_id, a.n as n_a, b.n as n_b, sqrt({_D2}) as d from h_a a, h_b b)",
    "mt as (select * from (select *, row_number() over (partition by a_id order by d, b_id) as ra, row_number() over (partition by b_id order by d, a_id) as rb from pr)"
    f" where ra = 1 and rb = 1 and d < 4.0 * {_R200('greatest(n_a, n_b)')})"]
SQL["halo_match"] = recursive(_MATCH, f"select a_id, b_id, n_a, n_b, {rd('d', 7)} as d from mt")
_bins = "bn as (select * from (values " + ", ".join(f"({i}, {lo}, {hi})" for i, (lo, hi) in enumerate(zip(HALO_EDGES, (*HALO_EDGES[1:], 2**62)))) + ") b(bin, lo, hi))"
_AB = [_bins, "ab as (select bin, lo, hi, (select count(*) from h_a where n >= lo and n < hi) as n_a, (select count(*) from h_b where n >= lo and n < hi) as n_b from bn)"]
SQL["halo_abundance"] = recursive(_CATS + _AB, "select bin::int as bin, lo::bigint as lo, n_a, n_b, case when n_b > 0 then " + rd("n_a / n_b", 9)
                                  + " else cast('nan' as double) end as ratio, case when n_b > 0 then "
                                  + rd("n_a / n_b * sqrt(1.0 / greatest(n_a, 1) + 1.0 / greatest(n_b, 1))", 9) + " else cast('nan' as double) end as sigma from ab")
_pct = lambda x, q: f"coalesce({rd(f'quantile_cont({x}, {q})', 6)}, cast('nan' as double))"
SQL["halo_match_table"] = recursive(
    _MATCH + _AB, "select bin::int as bin, count(mt.a_id) as matched, " + rd("count(mt.a_id) / greatest(any_value(ab.n_a), 1)", 6) + " as f_match_a, "
    + rd("(select count(*) from mt m2 where m2.n_b >= any_value(lo) and m2.n_b < any_value(hi)) / greatest(any_value(ab.n_b), 1)", 6) + " as f_match_b, "
    + ", ".join(f"{_pct('ln(mt.n_b / mt.n_a)', q)} as p{int(q * 100)}" for q in (0.16, 0.5, 0.84)) + ", "
    + _pct(f"d / {_R200('mt.n_a')}", 0.5) + " as med_offset from ab left join mt on mt.n_a >= lo and mt.n_a < hi group by bin")


def _field(src: str, tag: str, fields: dict) -> list[str]:
    """One more float mesh beside others: own stencil rows, shared offsets."""
    return [c.replace("st_f", f"st_{tag}") for c in float_mesh(src, "cic", N, fields, "", tag)[1:]]


_UP = [*zip(HALO_EDGES, (*HALO_EDGES[1:], 2**62))]
_HF = {side: {f"h{i}_{side}": f"(case when n >= {lo} and n < {hi} then 1.0 else 0.0 end)" for i, (lo, hi) in enumerate(_UP)} for side in "ab"}
_BF = ["m_a", "m_b", *_HF["a"], *_HF["b"]]
_cross = lambda x, y: f"sum(w * ({x}_re * {y}_re + {x}_im * {y}_im))"
_of_bin = lambda i: (f"select {i} as bin, shell, n_modes, k_mean, mm_a, mm_b, mm_ab, hm_a{i} as hm_a, hm_b{i} as hm_b, hh_a{i} as hh_a, hh_b{i} as hh_b,"
                     f" hh_ab{i} as hh_ab from sh")
SQL["halo_bias"] = recursive(
    _CATS + _AB + [offsets("cic")] + _field("p", "ma", {"m_a": "1.0"}) + _field("pb", "mb", {"m_b": "1.0"})
    + [f"hp_{t} as (select cx as x, cy as y, cz as z, n from h_{t})" for t in "ab"] + _field("hp_a", "ha", _HF["a"]) + _field("hp_b", "hb", _HF["b"])
    + [f"d as (select ix, iy, iz, {', '.join(f'coalesce({f}, 0) as {f}' for f in _BF)} from ma full join mb using (ix, iy, iz)"
       " full join ha using (ix, iy, iz) full join hb using (ix, iy, iz))"]
    + fft("d", _BF, "f") + [waves("f", "fw"),
    f"b as (select *, {_HW} as w, sqrt(n2) as kk, case when sqrt(n2) >= 1 and sqrt(n2) < 3 then 0 when sqrt(n2) >= 3 and sqrt(n2) < 5 then 1"
    " when sqrt(n2) >= 5 and sqrt(n2) < 7 then 2 end as shell from fw)",
    f"sh as (select shell, sum(w) as n_modes, sum(kk * w) / sum(w) * {KF!r} as k_mean, {_cross('m_a', 'm_a')} as mm_a, {_cross('m_b', 'm_b')} as mm_b,"
    f" {_cross('m_a', 'm_b')} as mm_ab, " + ", ".join(
        f"{_cross(f'h{i}_a', 'm_a')} as hm_a{i}, {_cross(f'h{i}_b', 'm_b')} as hm_b{i}, {_cross(f'h{i}_a', f'h{i}_a')} as hh_a{i},"
        f" {_cross(f'h{i}_b', f'h{i}_b')} as hh_b{i}, {_cross(f'h{i}_a', f'h{i}_b')} as hh_ab{i}" for i in range(len(_UP)))
    + " from b where shell is not null group by shell)",
    "un as (" + " union all ".join(_of_bin(i) for i in range(len(_UP))) + ")",
    "tt as (select (select count(*) from p)::double as t_a, (select count(*) from pb)::double as t_b)",
    "bb as (select un.*, n_a, n_b, hm_a / mm_a * t_a / n_a as ba, hm_b / mm_b * t_b / n_b as bb, t_a, t_b from un join ab using (bin), tt where least(n_a, n_b) >= 5)"],
    f"select bin::int as bin, n_a, n_b, shell::int as shell, {rd('k_mean', 6)} as k_mean, n_modes, {rd('ba', 6)} as b_a, {rd('bb', 6)} as b_b,"
    f" {rd('ba / bb', 6)} as b_ratio, {rd('hh_ab / sqrt(hh_a * hh_b)', 6)} as r_hh, {rd('mm_a / mm_b * pow(t_b / t_a, 2.0)', 6)} as pmm_ratio,"
    f" {rd('mm_ab / sqrt(mm_a * mm_b)', 6)} as r_mm from bb")


def _momenta(src: str, t: str) -> list[str]:
    fields = {f"{t}_rho": "1.0", f"{t}_px": "vx", f"{t}_py": "vy", f"{t}_pz": "vz"}
    return [c.replace("st_f", f"st_{t}") for c in float_mesh(src, "cic", N, fields, " - 0.5", f"fm_{t}")[1:]]


_P4 = ["rho", "px", "py", "pz"]
_BOTH = [f"{t}_{c}" for t in "ab" for c in _P4]
_dot = lambda x, y: f"({x}_re * {y}_re + {x}_im * {y}_im)"
_KINDS = {"density": ["rho"], "momentum": ["px", "py", "pz"], "divergence": ["div"]}
_product = {f"{x}{y}_{k}": " + ".join(_dot(f"{x}_{c}", f"{y}_{c}") for c in cs) for k, cs in _KINDS.items() for x, y in ("aa", "bb", "ab")}
SQL["velocity_compare"] = sql(
    ENC + moved("c", False)[:1] + ["pv as (select " + ", ".join(f"j{a} * {Q!r} as {a}, w_{a} * vel_scale as v{a}" for a in "xyz") + " from mv)", offsets("cic")]
    + _momenta("p", "a") + _momenta("pv", "b")
    + [f"d as (select ix, iy, iz, {', '.join(f'coalesce({c}, 0) as {c}' for c in _BOTH)} from fm_a full join fm_b using (ix, iy, iz))"]
    + fft("d", _BOTH, "f") + [waves("f", "fw"),
    "dv as (select *, " + ", ".join(f"-({' + '.join(f'w{a} * {t}_p{a}_im' for a in 'xyz')}) as {t}_div_re, {' + '.join(f'w{a} * {t}_p{a}_re' for a in 'xyz')} as {t}_div_im"
                                    for t in "ab") + f", {_HW} as w, cast(floor((sqrt(n2) - 0.5) / 2) as bigint) as bin from fw)",
    "sm as (select bin, sum(w) as n_modes, sum(w * sqrt(n2)) as kw, " + ", ".join(f"sum(w * ({e})) as {n}" for n, e in _product.items()) + " from dv where bin between 0 and 2 group by bin)"],
    f"select bin, {rd(f'kw / n_modes * {KF!r}', 6)} as k, n_modes, " + ", ".join(
        f"{rd(f'aa_{k} / bb_{k}', 6)} as {k}_ratio, {rd(f'ab_{k} / sqrt(aa_{k} * bb_{k})', 6)} as {k}_r" for k in _KINDS) + " from sm")

# Ewald sum with its constants written out: screening 2.5 / box, 2 images and 6 waves a side; erf by its ascending series.
_AE = f"(2.5 / {BOX!r})"
_series = "0.0"
for _k in range(90, -1, -1):  # 2^k / (2k + 1)!! by Horner's scheme
    _series = f"({2.0**_k / math.prod(range(1, 2 * _k + 2, 2))!r} + u * u * {_series})"
_erfc = f"(case when u < 5.0 then 1.0 - 2.0 / sqrt(pi()) * exp(-u * u) * u * {_series} else 0.0 end)"
_side = lambda n: f"(select unnest(range({-n}, {n + 1})) as i)"
SQL["newton_pair_field"] = sql(
    [f"po as (select row_number() over () as id, x + 0.0009765625 as x, y + 0.0009765625 as y, z + 0.0009765625 as z from ({particles_sql('orders')}))",
     f"ri as (select id, po.x + a.i * {BOX!r} as rx, po.y + b.i * {BOX!r} as ry, po.z + c.i * {BOX!r} as rz from po, {_side(2)} a, {_side(2)} b, {_side(2)} c)",
     f"rr as (select *, sqrt(rx * rx + ry * ry + rz * rz) as r, {_AE} * sqrt(rx * rx + ry * ry + rz * rz) as u from ri)",
     f"rs as (select *, ({_erfc} + 2.0 * u / sqrt(pi()) * exp(-u * u)) / pow(r, 3) as s from rr)",
     "near as (select id, sum(rx * s) as ex, sum(ry * s) as ey, sum(rz * s) as ez from rs group by id)",
     f"kv as (select a.i * {KF!r} as wx, b.i * {KF!r} as wy, c.i * {KF!r} as wz from {_side(6)} a, {_side(6)} b, {_side(6)} c where a.i <> 0 or b.i <> 0 or c.i <> 0)",
     f"kc as (select *, 4.0 * pi() / {BOX**3!r} * exp(-(wx * wx + wy * wy + wz * wz) / (4.0 * {_AE} * {_AE})) / (wx * wx + wy * wy + wz * wz) as f from kv)",
     "far as (select id, " + ", ".join(f"sum(sin(x * wx + y * wy + z * wz) * f * w{a}) as e{a}" for a in "xyz") + " from po, kc group by id)"],
    "select x, y, z, " + ", ".join(f"{rd(f'n.e{a} + f.e{a}', 9)} as e{a}" for a in "xyz") + " from po join near n using (id) join far f using (id)")

# The linear spectrum at the lattice's own wavenumbers, one constant per squared mode number.
_lin_fn = C.SpectrumTable(COSMO, N, BOX).power_fn()
_N2 = [v for v in range(1, 3 * (N // 2) ** 2 + 1)]
_LIN = ("ln as (select * from (values " + ", ".join(f"({v}, {float(p)!r}::double)" for v, p in zip(_N2, _lin_fn(KF * np.sqrt(np.array(_N2, float))))) + ") l(n2, lin))")
_LOG = np.geomspace(0.999 * KF, math.pi * N / BOX, 49)
_RECOVER = _MODES + [
    _LIN, "eg as (select * from (values " + ", ".join(f"({i}, {float(lo)!r}, {float(hi)!r})" for i, (lo, hi) in enumerate(zip(_LOG[:-1], _LOG[1:]))) + ") e(bin, lo, hi))",
    f"md as (select cast(fw.n2 as bigint) as n2, sqrt(n2) * {KF!r} as k, {_HW} as w, (d_re*d_re + d_im*d_im) * {_NORM!r} as p from fw where n2 > 0)",
    "rc as (select bin, sum(w) as w, sum(w * k) / sum(w) as k, sum(w * p) / sum(w * lin) as ratio, sum(w * p / lin) / sum(w) as mode_mean"
    " from md join ln using (n2) join eg on k >= lo and k < hi group by bin)"]
SQL["pk_linear_recovery"] = sql(_RECOVER, f"select bin::bigint as bin, {rd('k', 6)} as k, w as n_modes, {rd('ratio', 6)} as ratio, {rd('mode_mean', 6)} as mode_mean,"
                                f" {rd('sqrt(2.0 / w)', 6)} as sigma from rc")
SQL["pk_recovery_summary"] = sql(
    _RECOVER, f"select {rd('sum(pow(ratio - 1.0, 2) * w / 2.0)', 4)} as chi2, count(*) as dof, {rd('sum(mode_mean * w) / sum(w)', 4)} as mean_all,"
    f" {rd('sqrt(2.0 / sum(w))', 4)} as err_all, {rd('sum(mode_mean * w) filter (k < 0.5) / sum(w) filter (k < 0.5)', 4)} as mean_low,"
    f" {rd('sqrt(2.0 / sum(w) filter (k < 0.5))', 4)} as err_low from rc")
_d2a = C.growth(A_OUT, COSMO) ** 2
_CARDS = _CARD + [_LIN, f"cd as (select bin, sum(k * w) / sum(w) as k_mean, sum((raw / w2 - {BOX**3!r} / m) * w) / sum(w) as p, sum(w) as n_modes,"
                  f" sum({_d2a!r} * lin * w) / sum(w) as p_oracle, sum(w2 * w) / sum(w) as window_correction, {_shot} / (sum(raw * w) / sum(w)) as shot_fraction"
                  f" from (select *, cast(round(pow(k / {KF!r}, 2), 0) as bigint) as n2 from cb) join ln using (n2) where bin between 0 and {len(EDGES) - 2} group by bin having sum(w) > 20)",
                  "cz as (select *, (p / p_oracle - 1.0) / sqrt(2.0 / n_modes) as z_profile from cd)"]
SQL["pk_card_oracle"] = sql(_CARDS, "select bin, n_modes, " + ", ".join(
    f"{rd(c, 6)} as {c}" for c in ("k_mean", "p", "p_oracle", "z_profile", "window_correction", "shot_fraction")) + " from cz")
SQL["band_verdict"] = sql(_CARDS, f"select {rd(repr(KF), 6)} as k_min, {rd(repr(6 * KF), 6)} as k_max, count(*) as n_bins, {rd('max(abs(z_profile))', 6)} as max_abs_z,"
                          f" max(abs(z_profile)) < 5.0 as ok from cz where k_mean between {KF!r} and {6 * KF!r}")
