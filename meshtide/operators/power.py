"""Binned spectra: unweighted estimator, accuracy card, cross-correlation, interlaced P(k)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.config import Cosmology
from meshtide.functions import cosmology as C
from meshtide.functions import kspace as K
from meshtide.operators import deposit as D
from meshtide.operators import spectral as S

CARD_SCHEMA = "bin long, sum_p double, sum_raw double, sum_oracle double, sum_k double, sum_w double, sum_wcorr double"


def pk_estimator(mesh: DataFrame, field: str, n: int, box: float, scale: float = 1.0,
                 window_order: int = 0, dk: float | None = None) -> DataFrame:
    """(bin, k, p, n_modes): unweighted half-grid shells from half a fundamental, k = 0 excluded.

    ``window_order`` divides out an assignment window (2 CIC, 3 TSC).
    """
    modes = S.modes(S.spectrum(mesh, field, n), field)
    return bin_power(modes, field, field, n, box, scale * scale, window_order, dk)


def shell_bin(n: int, dk_kf: float = 1.0):
    """Half-open shell index of a mode, in units of the fundamental, from 1/2."""
    return F.floor((F.sqrt(K.n2_column(n).cast("double")) - F.lit(0.5)) / F.lit(dk_kf)).cast("long")


def shell_count(n: int, dk_kf: float = 1.0) -> int:
    return len(np.arange(0.5, n / 2 + dk_kf, dk_kf)) - 1


def product_sql(a: str, b: str) -> str:
    return f"({a}_re * {b}_re + {a}_im * {b}_im)"


def bin_power(modes: DataFrame, a: str, b: str, n: int, box: float, scale: float = 1.0,
              window_order: int = 0, dk: float | None = None) -> DataFrame:
    kf = 2.0 * math.pi / box
    dk_kf = 1.0 if dk is None else dk / kf
    p = F.expr(product_sql(a, b)) * F.lit(box**3 / float(n) ** 6 * scale)
    if window_order:
        p = p / F.pow(K.window_column(n, window_order), F.lit(2.0))
    rows = modes.select(shell_bin(n, dk_kf).alias("bin"), p.alias("p"))
    rows = rows.filter((F.col("bin") >= 0) & (F.col("bin") < shell_count(n, dk_kf)))
    out = rows.groupBy("bin").agg(F.avg("p").alias("p"), F.count(F.lit(1)).alias("n_modes"))
    return out.withColumn("k", (F.lit(0.5) + (F.col("bin") + 0.5) * dk_kf) * F.lit(kf))


def cross_r(mesh: DataFrame, a: str, b: str, n: int, box: float) -> DataFrame:
    """(bin, k, r, n_modes): P_ab / sqrt(P_aa P_bb) of two fields on the same mesh rows."""
    m = S.modes(S.spectrum(mesh, [a, b], n), [a, b])
    rows = m.select(shell_bin(n).alias("bin"), F.expr(product_sql(a, a)).alias("aa"),
                    F.expr(product_sql(b, b)).alias("bb"), F.expr(product_sql(a, b)).alias("ab"))
    rows = rows.filter((F.col("bin") >= 0) & (F.col("bin") < shell_count(n)))
    s = rows.groupBy("bin").agg(F.sum("aa").alias("aa"), F.sum("bb").alias("bb"),
                                F.sum("ab").alias("ab"), F.count(F.lit(1)).alias("n_modes"))
    den = F.sqrt(F.col("aa") * F.col("bb"))
    kf = 2.0 * math.pi / box
    return s.select("bin", ((F.col("bin") + 1.0) * F.lit(kf)).alias("k"),
                    (F.col("ab") / F.when(den > 0, den).otherwise(1.0)).alias("r"), "n_modes")


def join_meshes(a: DataFrame, b: DataFrame, va: str, vb: str) -> DataFrame:
    """Two sparse meshes on one row set: (ix, iy, iz, va, vb), absent values zero."""
    keys = ["ix", "iy", "iz"]
    j = a.select(*keys, F.col("q").alias(va)).join(b.select(*keys, F.col("q").alias(vb)), keys, "full")
    return j.fillna(0, [va, vb])


def band_power(mesh: DataFrame, field: str, n: int, box: float, shells: list[tuple[float, float]],
               scale: float = 1.0) -> DataFrame:
    """(shell, p, n_modes) on given [k_lo, k_hi) shells; an empty shell gives NaN and 0."""
    m = S.modes(S.spectrum(mesh, field, n), field)
    kf = 2.0 * math.pi / box
    k = F.sqrt(K.n2_column(n).cast("double")) * F.lit(kf)
    # a mode may lie in several shells: one flag per shell, summed in one pass
    aggs = []
    for i, (lo, hi) in enumerate(shells):
        inside = (F.col("k") >= lo) & (F.col("k") < hi)
        aggs += [F.sum(F.when(inside, F.col("p")).otherwise(0.0)).alias(f"s{i}"),
                 F.sum(F.when(inside, 1).otherwise(0)).alias(f"n{i}")]
    p = F.expr(product_sql(field, field)) * F.lit(box**3 / float(n) ** 6 * scale * scale)
    tot = m.select(k.alias("k"), p.alias("p")).agg(*aggs)
    rows = ", ".join(f"named_struct('shell', {i}L, 'p', if(n{i} > 0, s{i} / n{i}, double('NaN')),"
                     f" 'n_modes', n{i})" for i in range(len(shells)))
    return tot.select(F.expr(f"inline(array({rows}))"))


# ---- accuracy card ----

def card_partials(mesh: DataFrame, field: str, n: int, box: float, edges, scale: float = 1.0,
                  p_of_k=None, window_order: int = 3, shot: float = 0.0) -> DataFrame:
    """Per ky-plane, per bin sums of the hermitian-weighted power, reduced inside each task.

    Order of corrections: divide by the window squared, subtract shot noise, then bin.
    """
    edges = np.asarray(edges, float)
    cell, nb = box / n, len(edges) - 1
    norm = box**3 / float(n) ** 6 * scale * scale

    def fn(ky, fields):
        kx, kv, kz, k2 = K.pencil_k(n, cell, ky)
        k = np.sqrt(k2).ravel()
        w = np.full(n // 2 + 1, 2.0)
        w[0] = 1.0
        if n % 2 == 0:
            w[-1] = 1.0
        w = np.broadcast_to(w, k2.shape).ravel()
        at = np.digitize(k, edges) - 1
        sel = (at >= 0) & (at < nb) & (k > 0.0)
        raw = (np.abs(fields[0]) ** 2 * norm).ravel()[sel]
        w2 = np.ones_like(k)
        if window_order:
            w2 = (K.window(kx, kv, kz, cell, window_order) ** 2).ravel()
        at, k, w, w2 = at[sel], k[sel], w[sel], w2[sel]
        total = lambda v: np.bincount(at, weights=v * w, minlength=nb).astype(float)
        oracle = p_of_k(k) if p_of_k is not None and len(k) else np.zeros(len(k))
        sums = [total(raw / w2 - shot), total(raw), total(oracle), total(k), total(np.ones_like(k)), total(w2)]
        names = ["sum_p", "sum_raw", "sum_oracle", "sum_k", "sum_w", "sum_wcorr"]
        cols = {"ky": pa.array(np.full(nb, ky), pa.int64()), "bin": pa.array(np.arange(nb), pa.int64())}
        cols.update({name: pa.array(s) for name, s in zip(names, sums)})
        return pa.table(cols)

    return S.ky_map(mesh, [field], n, fn, "ky long, " + CARD_SCHEMA)


def combine_card(partials: DataFrame, shot: float, min_weight: float = 100.0) -> DataFrame:
    """Correctly rounded sums over ky-planes (at most n rows per bin), then the card's columns."""
    names = ["sum_p", "sum_raw", "sum_oracle", "sum_k", "sum_w", "sum_wcorr"]

    def fold(table: pa.Table) -> pa.Table:
        out = {"bin": pa.array([table.column("bin")[0].as_py()], pa.int64())}
        out.update({c: pa.array([math.fsum(table.column(c).to_pylist())]) for c in names})
        return pa.table(out)

    s = partials.groupBy("bin").applyInArrow(fold, CARD_SCHEMA).filter(F.col("sum_w") > min_weight)
    w = F.col("sum_w")
    p, oracle = F.col("sum_p") / w, F.col("sum_oracle") / w
    return s.select(
        "bin", (F.col("sum_k") / w).alias("k_mean"), p.alias("p"), oracle.alias("p_oracle"),
        w.alias("n_modes"),
        F.when(oracle > 0, (p / oracle - 1.0) / F.sqrt(F.lit(2.0) / w)).alias("z_profile"),
        (F.col("sum_wcorr") / w).alias("window_correction"),
        (F.lit(shot) / (F.col("sum_raw") / w)).alias("shot_fraction"))


def check_coverage(partials: DataFrame, n: int) -> None:
    """Refuse partials that do not hold each ky-plane exactly once."""
    per = partials.filter(F.col("bin") == 0).groupBy("ky").agg(F.count(F.lit(1)).alias("c"))
    row = per.agg(F.count(F.lit(1)).alias("planes"), F.max("c").alias("most")).first()
    if row.planes != n or row.most != 1:
        raise ValueError(f"{row.planes} of {n} ky-planes present, at most {row.most} times")


def pk_card(mesh: DataFrame, n: int, box: float, n_particles: int, a_out: float, cosmo: Cosmology,
            edges=None, frac_bits: int = 12, deconvolve: bool = True, subtract_shot: bool = True,
            min_weight: float = 100.0, table=None) -> DataFrame:
    """Measured P(k) of a fixed-point TSC mesh beside the bin-averaged linear spectrum."""
    if edges is None:
        edges = np.linspace(0.0, 0.5 * math.pi * n / box, 65)
    tab = C.SpectrumTable(cosmo, n, box, table=table)
    d2 = C.growth(a_out, cosmo) ** 2
    shot = box**3 / n_particles if subtract_shot else 0.0
    scale = 2.0**-frac_bits * float(n) ** 3 / n_particles
    linear = tab.power_fn()
    parts = card_partials(mesh, "q", n, box, edges, scale, lambda k: d2 * linear(k),
                          3 if deconvolve else 0, shot)
    return combine_card(parts, shot, min_weight)


def card_record(card: DataFrame, n: int, box: float, n_particles: int, a_out: float,
                cosmo: Cosmology, edges, shot: float, table=None) -> dict:
    """The card as a document; refuses one with no bin (bins are few, so the driver holds them)."""
    rows = card.orderBy("bin").collect()
    if not rows:
        raise ValueError("no bin reached the minimum weight: widen the bins or lower it")
    tab = C.SpectrumTable(cosmo, n, box, table=table)
    d2 = C.growth(a_out, cosmo) ** 2
    return dict(
        card="meshtide-pk-card-1", n_coarse=n, box_size=box, n_particles=n_particles, a_out=a_out,
        growth_factor=math.sqrt(d2), k_nyquist=math.pi * n / box,
        k_nonlinear=C.nonlinear_scale(lambda k: d2 * tab.power(k)), k_nonlinear_scan=[1e-3, 10.0],
        shot_noise=shot, n_bins=len(rows), k_edges=[float(e) for e in edges],
        **{c: [float(r[c]) for r in rows] for c in
           ("k_mean", "p", "p_oracle", "n_modes", "z_profile", "window_correction", "shot_fraction")})


def band_verdict(card: DataFrame, k_max: float, k_min: float = 0.0, bar: float = 5.0) -> DataFrame:
    """One row: the worst |z| over a named band, and whether it stays below the bar."""
    band = card.filter(F.col("k_mean").between(k_min, k_max))
    return band.agg(
        F.count(F.lit(1)).alias("n_bins"), F.max(F.abs(F.col("z_profile"))).alias("max_abs_z"),
    ).select(F.lit(k_min).alias("k_min"), F.lit(k_max).alias("k_max"), "n_bins", "max_abs_z",
             (F.col("max_abs_z") < bar).alias("ok"))


def ratio(a: DataFrame, b: DataFrame, value: str = "p") -> DataFrame:
    """a / b - 1 on identical bins; a bin present on one side only raises."""
    j = a.select("bin", "k", F.col(value).alias("_a")).join(
        b.select("bin", F.col("k").alias("_k"), F.col(value).alias("_b")), "bin", "full")
    same = F.abs(F.col("k") - F.col("_k")) <= 1e-8 + 1e-5 * F.abs(F.col("_k"))
    bad = F.raise_error(F.lit("the two spectra are on different bins")).cast("double")
    return j.select("bin", "k", F.when(F.coalesce(same, F.lit(False)), F.col("_a") / F.col("_b") - 1.0)
                    .otherwise(bad).alias("ratio"))


# ---- linear recovery ----

def linear_recovery(mesh: DataFrame, field: str, n: int, box: float, linear, scale: float = 1.0, bins: int = 48) -> DataFrame:
    """(bin, k, n_modes, ratio, mode_mean, sigma): measured over linear power in log bins up to the mesh Nyquist.

    ``ratio`` divides bin averages, ``mode_mean`` averages each mode's own quotient; ``sigma`` is the scatter of a
    Gaussian field.  Each ky-plane is reduced to a row per bin inside its task.
    """
    cell = box / n
    edges = np.geomspace(0.999 * 2.0 * math.pi / box, math.pi / cell, bins + 1)
    names = ["w", "k", "p", "lin", "r"]

    def fn(ky, fields):
        k = np.sqrt(K.pencil_k(n, cell, ky)[3])
        weight = np.broadcast_to(np.where(np.arange(n // 2 + 1) % (n // 2) == 0, 1.0, 2.0), k.shape)
        at = np.digitize(k, edges) - 1
        inside = (at >= 0) & (at < bins)
        at, k, weight, found = at[inside], k[inside], weight[inside], np.abs(fields[0])[inside] ** 2
        found, expected = found * scale**2 * box**3 / float(n) ** 6, linear(k) if len(k) else k
        add = lambda v: np.bincount(at, weights=v * weight, minlength=bins).astype(float)
        cols = [add(np.ones_like(k)), add(k), add(found), add(expected), add(found / expected)]
        return pa.table({"bin": pa.array(np.arange(bins), pa.int64())} | dict(zip(names, cols)))

    parts = S.ky_map(mesh, [field], n, fn, "bin long, " + ", ".join(f"{c} double" for c in names))
    t = parts.groupBy("bin").agg(*(F.sum(c).alias(c) for c in names)).filter("w > 0")
    w = F.col("w")
    return t.select("bin", (F.col("k") / w).alias("k"), w.alias("n_modes"), (F.col("p") / F.col("lin")).alias("ratio"),
                    (F.col("r") / w).alias("mode_mean"), F.sqrt(2.0 / w).alias("sigma"))


def recovery_summary(rows: DataFrame, k_low: float) -> DataFrame:
    """One row: chi2 of the ratio against 1, bins, and the mean quotient over all modes and below ``k_low``, with errors."""
    low = F.when(F.col("k") < k_low, F.col("n_modes"))
    mean = lambda w: F.sum(F.col("mode_mean") * w) / F.sum(w)
    return rows.agg(F.sum(((F.col("ratio") - 1.0) / F.col("sigma")) ** 2).alias("chi2"), F.count(F.lit(1)).alias("dof"),
                    mean(F.col("n_modes")).alias("mean_all"), F.sqrt(2.0 / F.sum("n_modes")).alias("err_all"),
                    mean(low).alias("mean_low"), F.sqrt(2.0 / F.sum(low)).alias("err_low"))


# ---- interlaced and velocity spectra ----

def interlaced_pk(particles: DataFrame, n: int, box: float, n_particles: int,
                  interlace: bool = True) -> DataFrame:
    """(bin, k, p, p_raw, n_modes): TSC power to the Nyquist, two half-cell-shifted grids averaged.

    Hermitian weights, weighted mean k, bins two fundamentals wide from half a fundamental.
    """
    cell, kf = box / n, 2.0 * math.pi / box
    g = D.deposit_float(particles, "tsc", n, box, {"g0": "1.0D"})
    fields = ["g0"]
    if interlace:
        g2 = D.deposit_float(particles, "tsc", n, box, {"g1": "1.0D"}, shift=0.5)
        g = g.join(g2, ["ix", "iy", "iz"], "full").fillna(0.0, ["g0", "g1"])
        fields.append("g1")
    edges = np.arange(0.5 * kf, math.pi * n / box + 2 * kf, 2 * kf)
    nb = len(edges) - 1
    norm = box**3 / float(n) ** 6 * (float(n) ** 3 / n_particles) ** 2

    def fn(ky, f):
        kx, kv, kz, k2 = K.pencil_k(n, cell, ky)
        d = f[0]
        if len(f) == 2:
            # the second grid samples the field half a cell lower along each axis
            d = 0.5 * (d + f[1] * np.exp(0.5j * cell * (kx + kv + kz)))
        k = np.sqrt(k2).ravel()
        p = (np.abs(d) ** 2 / K.window(kx, kv, kz, cell, 3) ** 2 * norm).ravel()
        w = np.full(n // 2 + 1, 2.0)
        w[0] = 1.0
        if n % 2 == 0:
            w[-1] = 1.0
        w = np.broadcast_to(w, k2.shape).ravel()
        at = np.digitize(k, edges) - 1
        sel = (at >= 0) & (at < nb)
        at = at[sel]
        sums = [np.bincount(at, weights=v[sel], minlength=nb).astype(float) for v in (w, k * w, p * w)]
        return pa.table({"bin": pa.array(np.arange(nb), pa.int64()), "w": sums[0], "kw": sums[1], "pw": sums[2]})

    parts = S.ky_map(g, fields, n, fn, "bin long, w double, kw double, pw double")
    t = parts.groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("w", "kw", "pw"))).filter("w > 0")
    raw = F.col("pw") / F.col("w")
    return t.select("bin", (F.col("kw") / F.col("w")).alias("k"), (raw - box**3 / n_particles).alias("p"),
                    raw.alias("p_raw"), F.col("w").alias("n_modes"))


def momentum_fields(particles: DataFrame, n: int, box: float) -> DataFrame:
    """Cell-centred CIC count and momentum meshes: (ix, iy, iz, rho, px, py, pz)."""
    fields = {"rho": "1.0D", "px": "vx", "py": "vy", "pz": "vz"}
    return D.deposit_float(particles, "cic", n, box, fields, shift=-0.5)


def velocity_spectra(particles: DataFrame, n: int, box: float, n_particles: int) -> DataFrame:
    """(bin, k, n_modes, p_density, p_momentum, p_divergence) of one particle set."""
    mesh = momentum_fields(particles, n, box)
    cell, kf = box / n, 2.0 * math.pi / box
    edges = np.arange(0.5 * kf, math.pi / cell, 2 * kf)
    nb = len(edges) - 1
    scale = float(n) ** 3 / n_particles

    def fn(ky, f):
        kx, kv, kz, k2 = K.pencil_k(n, cell, ky)
        rho, px, py, pz = (scale * v for v in f)
        theta = 1j * (kx * px + kv * py + kz * pz)
        w = np.full(n // 2 + 1, 2.0)
        w[0] = w[-1] = 1.0
        w = np.broadcast_to(w, k2.shape).ravel()
        k = np.sqrt(k2).ravel()
        at = np.digitize(k, edges) - 1
        sel = (at >= 0) & (at < nb)
        add = lambda v: np.bincount(at[sel], weights=(v.ravel() * w)[sel], minlength=nb).astype(float)
        mom = np.abs(px) ** 2 + np.abs(py) ** 2 + np.abs(pz) ** 2
        return pa.table({"bin": pa.array(np.arange(nb), pa.int64()), "w": add(np.ones_like(k)), "kw": add(k),
                         "d": add(np.abs(rho) ** 2), "m": add(mom), "t": add(np.abs(theta) ** 2)})

    parts = S.ky_map(mesh, ["rho", "px", "py", "pz"], n, fn,
                     "bin long, w double, kw double, d double, m double, t double")
    t = parts.groupBy("bin").agg(*(F.sum(c).alias(c) for c in ("w", "kw", "d", "m", "t"))).filter("w > 0")
    w = F.col("w")
    return t.select("bin", (F.col("kw") / w).alias("k"), w.alias("n_modes"), (F.col("d") / w).alias("p_density"),
                    (F.col("m") / w).alias("p_momentum"), (F.col("t") / w).alias("p_divergence"))


def velocity_compare(a: DataFrame, b: DataFrame, n: int, box: float, n_particles: int) -> DataFrame:
    """(bin, k, n_modes, {density, momentum, divergence} ratio and r) of two particle sets."""
    names = ["rho", "px", "py", "pz"]
    ma = momentum_fields(a, n, box).withColumnsRenamed({c: f"a_{c}" for c in names})
    mb = momentum_fields(b, n, box).withColumnsRenamed({c: f"b_{c}" for c in names})
    both = [f"a_{c}" for c in names] + [f"b_{c}" for c in names]
    mesh = ma.join(mb, ["ix", "iy", "iz"], "full").fillna(0.0, both)
    cell, kf = box / n, 2.0 * math.pi / box
    edges = np.arange(0.5 * kf, math.pi / cell, 2 * kf)
    nb = len(edges) - 1
    kinds = ["density", "momentum", "divergence"]

    def fn(ky, f):
        kx, kv, kz, k2 = K.pencil_k(n, cell, ky)
        div = lambda p: 1j * (kx * p[0] + kv * p[1] + kz * p[2])
        sides = [[[f[0]], f[1:4], [div(f[1:4])]], [[f[4]], f[5:8], [div(f[5:8])]]]
        w = np.full(n // 2 + 1, 2.0)
        w[0] = w[-1] = 1.0
        w = np.broadcast_to(w, k2.shape).ravel()
        k = np.sqrt(k2).ravel()
        at = np.digitize(k, edges) - 1
        sel = (at >= 0) & (at < nb)
        add = lambda v: np.bincount(
            at[sel], weights=(np.asarray(v).ravel() * w)[sel], minlength=nb).astype(float)
        cols = {"bin": pa.array(np.arange(nb), pa.int64()), "w": add(np.ones_like(k)), "kw": add(k)}
        for name, x, y in zip(kinds, sides[0], sides[1]):
            cols[f"aa_{name}"] = sum(add(np.abs(v) ** 2) for v in x)
            cols[f"bb_{name}"] = sum(add(np.abs(v) ** 2) for v in y)
            cols[f"ab_{name}"] = sum(add((u * np.conj(v)).real) for u, v in zip(x, y))
        return pa.table(cols)

    sums = ["w", "kw"] + [f"{p}_{name}" for name in kinds for p in ("aa", "bb", "ab")]
    parts = S.ky_map(mesh, both, n, fn, "bin long, " + ", ".join(f"{c} double" for c in sums))
    t = parts.groupBy("bin").agg(*(F.sum(c).alias(c) for c in sums)).filter("w > 0")
    out = []
    for name in kinds:
        aa, bb, ab = (F.col(f"{p}_{name}") for p in ("aa", "bb", "ab"))
        out += [(aa / bb).alias(f"{name}_ratio"), (ab / F.sqrt(aa * bb)).alias(f"{name}_r")]
    return t.select("bin", (F.col("kw") / F.col("w")).alias("k"), F.col("w").alias("n_modes"), *out)


def residual_power(modes: DataFrame, a: str, r: str, n: int) -> DataFrame:
    """One row: power of field r over power of field a, on, off and across the Nyquist planes."""
    h = n // 2
    nyq = (F.col("kx") == h) | (F.col("ky") == h) | (F.col("kz") == h)
    rows = modes.select(nyq.alias("nyq"), F.expr(product_sql(a, a)).alias("pa"), F.expr(product_sql(r, r)).alias("pr"))
    on = lambda c: F.sum(F.when(F.col("nyq"), F.col(c)).otherwise(0.0))
    off = lambda c: F.sum(F.when(F.col("nyq"), 0.0).otherwise(F.col(c)))
    return rows.agg((F.sum("pr") / F.sum("pa")).alias("resid_all"), (off("pr") / off("pa")).alias("resid_off"),
                    (on("pr") / on("pa")).alias("resid_on"), (on("pa") / F.sum("pa")).alias("field_on"))


def lattice_shells(edges_kf, n: int, spark) -> DataFrame:
    """(bin, n2, modes): the full-grid lattice shells inside each bin of a card.

    Edges are in units of the fundamental.  Refuses bins that reach the Nyquist planes.
    """
    edges = np.asarray(edges_kf, float)
    if int(edges[-1]) + 1 >= n // 2:
        raise ValueError("bins reach the mesh's Nyquist planes")
    grid = D.grid(spark, n).select(F.col("ix").alias("kx"), F.col("iy").alias("ky"), F.col("iz").alias("kz"))
    z = K.signed(F.col("kz"), n)
    xy = K.signed(F.col("kx"), n) ** 2 + K.signed(F.col("ky"), n) ** 2
    n2 = (xy + z * z).cast("long")
    k = F.sqrt(n2.cast("double"))
    index = sum((F.when(k >= float(e), 1).otherwise(0) for e in edges), F.lit(0)) - 1
    rows = grid.select(index.cast("long").alias("bin"), n2.alias("n2"))
    rows = rows.filter((F.col("bin") >= 0) & (F.col("bin") < len(edges) - 1) & (F.col("n2") > 0))
    return rows.groupBy("bin", "n2").agg(F.count(F.lit(1)).alias("modes"))


def verified_shells(shells: DataFrame, card: DataFrame) -> DataFrame:
    """The shells (bin, n2, modes) of the card's bins; a bin whose shells do not hold the card's n_modes raises."""
    held = shells.groupBy("bin").agg(F.sum("modes").cast("double").alias("held"))
    both = card.select("bin", "n_modes").join(held, "bin", "left")
    refusal = F.raise_error(F.concat(F.lit("the card and its shells differ in bin "), F.col("bin").cast("string"))).cast("boolean")
    agree = F.coalesce("held", F.lit(0.0)) == F.col("n_modes")
    sound = both.select("bin", F.when(agree, True).otherwise(refusal).alias("sound")).where("sound")
    return shells.join(sound, "bin").drop("sound")
