"""Registered queries: every operator over the whole tables of a scale-factor directory.

Particles come from table columns (see ``sources.particles``) in the 'smoke' geometry: box 32,
32 particles per side, 16^3 coarse and 64^3 fine mesh.  Floating results are rounded, since sums
of doubles depend on their order in the last bits.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from meshtide.config import Cosmology, geometry
from meshtide.functions import cosmology as C
from meshtide.functions import kspace as K
from meshtide.functions import lattice as L
from meshtide.functions.dither import with_dither
from meshtide.operators import deposit as D
from meshtide.operators import forces as FO
from meshtide.operators import gather as GA
from meshtide.operators import halos as H
from meshtide.operators import higher as HI
from meshtide.operators import power as P
from meshtide.operators import rank as R
from meshtide.operators import spectral as S
from meshtide.operators import state as ST
from meshtide.plans import initial as IC
from meshtide.session import durable
from meshtide.sources.particles import particles, read_table

GEO = geometry("smoke")
BOX, N = GEO.box, GEO.n_coarse
KF = 2.0 * math.pi / BOX
COSMO = Cosmology()
A_OUT = 0.5
DRIFT = 0.75
DITHER_KEY = 2**32 + 7
AXES = ("x", "y", "z")
QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def rd(c, digits):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, digits) + F.lit(0.0)


def rounded(df, digits, *names):
    return df.withColumns({n: rd(n, digits) for n in names})


def lines(spark, sf, keep=None):
    return particles(spark, sf, "lineitem", keep)


def raw_lines(spark, sf):
    """Off-lattice positions: sub-quantum shifts with exact ties, and some below zero."""
    p = lines(spark, sf, ["l_linenumber"])
    s = F.col("l_linenumber") * F.lit(2.0**-10)
    return p.withColumns({"x": F.col("x") + s, "y": F.col("y") + s * 2, "z": F.col("z") - s})


def total(spark, sf, table="lineitem"):
    """Row count, from parquet footers."""
    return read_table(spark, sf, table).count()


def coded_lines(spark, sf):
    return ST.encode(lines(spark, sf), GEO)


def mesh(spark, sf, scheme="tsc", n=N, table="lineitem"):
    return D.deposit_int(particles(spark, sf, table), scheme, n, BOX)


def scale(spark, sf, n=N, table="lineitem"):
    """Code units -> counts over the mean."""
    return 2.0**-12 * n**3 / total(spark, sf, table)


# ---- sources and codec ----

@query
def particle_scan(spark, sf):
    return lines(spark, sf)


@query
def event_particles(spark, sf):
    return particles(spark, sf, "events", ["event_id"])


@query
def lattice_index(spark, sf):
    return L.with_lattice(raw_lines(spark, sf), GEO.lattice).select("jx", "jy", "jz")


@query
def encode_positions(spark, sf):
    e = L.encode_positions(raw_lines(spark, sf), GEO)
    b = L.bucket_axes(F.col("bucket"), GEO)
    return e.select("off_x", "off_y", "off_z", *(b[a].alias(f"b_{a}") for a in AXES))


@query
def decode_positions(spark, sf):
    return L.decode_positions(L.encode_positions(raw_lines(spark, sf), GEO).drop(*AXES), GEO).select(*AXES)


@query
def position_roundtrip(spark, sf):
    raw = raw_lines(spark, sf).select(*(F.col(a).alias(f"r{a}") for a in AXES), *AXES)
    dec = L.decode_positions(L.encode_positions(raw, GEO), GEO)
    err = F.greatest(*(F.abs(L.minimum_image(F.col(a) - F.col(f"r{a}"), BOX)) for a in AXES))
    return dec.agg(F.max(err).alias("max_error"), F.count(F.lit(1)).alias("n"))


@query
def bucket_order_key(spark, sf):
    return L.encode_positions(raw_lines(spark, sf), GEO).groupBy("brick", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query
def bucket_from_key(spark, sf):
    e = L.encode_positions(lines(spark, sf), GEO)
    b = L.bucket_axes(F.col("bucket"), GEO)
    return e.groupBy(*(b[a].alias(f"b_{a}") for a in AXES)).agg(F.count(F.lit(1)).alias("n"))


@query
def velocity_codes_global(spark, sf):
    p = lines(spark, sf)
    s = ST.global_scale(p).scalar()
    rows = p.withColumn("vel_scale", s)
    return rows.select(*(L.encode_velocity(F.col(f"v{a}"), F.col("vel_scale")).alias(f"w_{a}") for a in AXES))


@query
def velocity_codes(spark, sf):
    return coded_lines(spark, sf)[0]


@query
def velocity_decode(spark, sf):
    d = ST.decode(*coded_lines(spark, sf), GEO)
    return rounded(d.select("brick", "vx", "vy", "vz"), 9, "vx", "vy", "vz")


@query
def decode_bricks(spark, sf):
    d = ST.decode_bricks(*coded_lines(spark, sf), GEO, list(range(GEO.bricks**3)))
    return rounded(d.select("brick", "x", "y", "z", "vx"), 9, "vx")


@query
def rescale_codes(spark, sf):
    rows, scales = coded_lines(spark, sf)
    top = ST.reconcile_scale(scales).scalar()
    j = rows.join(scales.select("brick", "vel_scale"), "brick").withColumn("top", top)
    return j.select("brick", *(L.rescale_code(F.col(f"w_{a}"), F.col("vel_scale"), F.col("top")).alias(f"w_{a}")
                               for a in AXES))


@query
def reconcile_velocity_scale(spark, sf):
    return ST.reconcile_scale(coded_lines(spark, sf)[1])


@query
def owning_tile(spark, sf):
    return lines(spark, sf).withColumns(ST.owning_tile(GEO)).groupBy("tx", "ty", "tz").agg(
        F.count(F.lit(1)).alias("n"))


@query
def tile_local_coords(spark, sf):
    origin = [(t * GEO.n_tile - GEO.real_buffer) * GEO.fine_cell for t in (0, 1, 3)]
    u = {f"u{a}": F.pmod(F.col(a) - F.lit(o), F.lit(BOX)) for a, o in zip(AXES, origin)}
    return lines(spark, sf).withColumns(u).select("ux", "uy", "uz")


@query
def in_padded_box(spark, sf):
    """Rows inside one tile's padded box, and rows outside it."""
    extent = GEO.pad_side * GEO.fine_cell
    u = tile_local_coords(spark, sf)
    inside = (F.col("ux") < extent) & (F.col("uy") < extent) & (F.col("uz") < extent)
    return u.agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


@query
def peculiar_velocity(spark, sf):
    f = C.peculiar_velocity_factor(A_OUT, COSMO)
    return lines(spark, sf).select(*(rd(F.col(f"v{a}") * F.lit(f), 6).alias(f"v{a}") for a in AXES))


@query
def momentum_conversion(spark, sf):
    from meshtide.functions.schedule import momentum_factor
    f = momentum_factor(A_OUT, COSMO)
    p = lines(spark, sf).select(*((F.col(f"v{a}") * F.lit(f)).alias(f"p{a}") for a in AXES))
    return p.select(*(rd(f"p{a}", 9).alias(f"p{a}") for a in AXES),
                    *(rd(F.col(f"p{a}") / F.lit(f), 9).alias(f"v{a}") for a in AXES))


@query
def displaced_positions(spark, sf):
    d1, d2 = C.growth(A_OUT, COSMO), C.growth2(A_OUT, COSMO)
    move = {a: F.pmod(F.col(a) + (F.lit(d1) * F.col(f"v{a}") - F.lit(d2) * F.col("vx")), F.lit(BOX)) for a in AXES}
    return rounded(lines(spark, sf).withColumns(move).select(*AXES), 9, *AXES)


@query
def min_image_rms(spark, sf):
    """RMS displacement per component of one drift."""
    d = ST.drift(ST.decode(*coded_lines(spark, sf), GEO), GEO, DRIFT)
    parts = [L.minimum_image(L.position_of(F.col(f"j{a}"), GEO.lattice) - F.col(a), BOX) ** 2 for a in AXES]
    return d.agg(rd(F.sqrt(F.avg(sum(parts)) / 3.0), 9).alias("rms"))


@query
def slab_scan(spark, sf):
    """A range of brick x-planes."""
    rows, _ = coded_lines(spark, sf)
    bx = L.div(F.col("brick"), GEO.bricks**2)
    return rows.filter((bx >= 2) & (bx < 5)).groupBy(bx.alias("bx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("w_x").alias("sum_wx"), F.countDistinct("brick").alias("bricks"))


@query
def export_particles(spark, sf):
    from meshtide.sources.exports import decoded
    f = C.peculiar_velocity_factor(A_OUT, COSMO)
    e = decoded(*coded_lines(spark, sf), GEO, "double", f).drop("brick")
    return rounded(e, 5, "vx", "vy", "vz")


@query
def export_row_offsets(spark, sf):
    """First row number of every brick plane in brick order."""
    rows, _ = coded_lines(spark, sf)
    n = rows.groupBy(L.div(F.col("brick"), GEO.bricks**2).alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return R.prefix_sums(n, "part", "n", "row0")


# ---- layout ----

@query
def brick_occupancy(spark, sf):
    return ST.occupancy(coded_lines(spark, sf)[0], "brick")


@query
def bucket_occupancy(spark, sf):
    return ST.occupancy(coded_lines(spark, sf)[0], "bucket")


@query
def brick_velocity_scale(spark, sf):
    return coded_lines(spark, sf)[1].select("brick", "vel_scale", "n")


@query
def run_rank(spark, sf):
    return ST.run_rank(coded_lines(spark, sf)[0])


@query
def bucket_starts(spark, sf):
    return ST.bucket_starts(coded_lines(spark, sf)[0], GEO)


@query
def tile_membership(spark, sf):
    return ST.tile_bricks(ST.occupancy(coded_lines(spark, sf)[0], "brick"), GEO)


@query
def tile_members(spark, sf):
    return ST.tile_members(ST.occupancy(coded_lines(spark, sf)[0], "brick"), GEO)


@query
def ownership_partition(spark, sf):
    """Owned rows per tile, by brick; they add up to every row once."""
    rows, _ = coded_lines(spark, sf)
    return rows.withColumns(ST.tile_of_brick(F.col("brick"), GEO)).groupBy("tx", "ty", "tz").agg(
        F.count(F.lit(1)).alias("owned"))


@query
def partition_diagnosis(spark, sf):
    """Bricks that no padded tile claims (0), or several do: with buffers, all tiles beside a brick."""
    n = ST.occupancy(coded_lines(spark, sf)[0], "brick")
    return ST.diagnose_partition(ST.tile_bricks(n, GEO), n, "brick")


@query
def placement_check(spark, sf):
    """Events whose coded cell differs from that of a slightly moved reference position."""
    p = particles(spark, sf, "events", ["event_id"]).withColumnRenamed("event_id", "id")
    rows, _ = ST.encode(p, GEO, ["id"])
    moved = p.withColumn("x", F.col("x") + F.when(F.col("id") % 10 == 0, F.lit(2.0**-7)).otherwise(0.0))
    return ST.check_placement(rows, moved, GEO).select("id", "bucket", "want")


@query
def state_check(spark, sf):
    rows, scales = coded_lines(spark, sf)
    j = rows.join(scales, "brick", "left")
    far = F.greatest(*(F.abs(F.col(f"w_{a}")) for a in AXES))
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vel_scale").isNull()).alias("no_scale"),
                 F.max(far).alias("max_code"), F.count_if(L.div(F.col("bucket"), 8) != F.col("brick")).alias("misfiled"))


# ---- deposits ----

@query
def cic_paint_int(spark, sf):
    return mesh(spark, sf, "cic", 32)


@query
def tsc_paint_int(spark, sf):
    return mesh(spark, sf, "tsc", N)


@query
def tsc_paint_orders(spark, sf):
    return mesh(spark, sf, "tsc", N, "orders")


@query
def tsc_paint_subblock(spark, sf):
    m = D.sub_block(mesh(spark, sf), (-2, 3, 14), (8, 8, 8), N)
    return m.select("lx", "ly", "lz", "q")


@query
def tsc_paint_incremental(spark, sf):
    """The row-wise form used by the streaming deposit."""
    from meshtide.streaming.deposit import running_deposit
    return running_deposit(lines(spark, sf), "tsc", N, BOX)


@query
def cic_paint_incremental(spark, sf):
    from meshtide.streaming.deposit import running_deposit
    return running_deposit(raw_lines(spark, sf), "cic", N, BOX)


@query
def cic_paint_float(spark, sf):
    return rounded(D.deposit_float(lines(spark, sf), "cic", N, BOX), 7, "w")


@query
def tsc_paint_float(spark, sf):
    return rounded(D.deposit_float(lines(spark, sf), "tsc", N, BOX), 7, "w")


@query
def paint_mass_check(spark, sf):
    m = mesh(spark, sf)
    return m.agg(F.sum("q").alias("mass"), F.max("q").alias("peak"), F.count(F.lit(1)).alias("cells"))


@query
def paint_counts(spark, sf):
    return rounded(D.counts(mesh(spark, sf)).select("ix", "iy", "iz", "count"), 9, "count")


@query
def density_contrast_cic(spark, sf):
    n = read_table(spark, sf, "lineitem").agg(F.count(F.lit(1)).alias("n")).scalar()
    return rounded(D.density_contrast(mesh(spark, sf, "cic", 32), 32, n), 9, "delta")


@query
def density_contrast_tsc(spark, sf):
    return rounded(D.density_contrast(mesh(spark, sf), N, total(spark, sf)), 9, "delta")


@query
def momentum_fields(spark, sf):
    return rounded(P.momentum_fields(lines(spark, sf), N, BOX), 7, "rho", "px", "py", "pz")


@query
def tile_paint_int(spark, sf):
    """Fixed-point mesh of every padded tile, corners wrapped in the tile's own period."""
    return FO.tile_density(lines(spark, sf), GEO)


@query
def displaced_paint(spark, sf):
    """Deposit of particles moved by a displacement."""
    d1 = C.growth(A_OUT, COSMO)
    q = GEO.lattice.quantum
    p = lines(spark, sf).withColumns(
        {a: F.pmod(F.col(a) + F.round(F.lit(d1) * F.col(f"v{a}") / q) * q, F.lit(BOX)) for a in AXES})
    return D.deposit_int(p, "cic", N, BOX)


# ---- gathers ----

def integer_force_field(spark, sf, scheme, n):
    """A simple exact mesh to read: the deposit itself and two multiples by cell index."""
    m = mesh(spark, sf, scheme, n)
    return m.select("ix", "iy", "iz", F.col("q").cast("double").alias("gx"),
                    (F.col("q") * F.col("iy")).cast("double").alias("gy"),
                    (F.col("q") - F.col("iz") * 1000).cast("double").alias("gz"))


def salted_lines(spark, sf):
    return GA.with_salt(lines(spark, sf))


@query
def cic_gather(spark, sf):
    f = integer_force_field(spark, sf, "cic", 32)
    g = GA.gather(salted_lines(spark, sf), f, ["gx", "gy", "gz"], "cic", 32, BOX, ["ax", "ay", "az"])
    return rounded(g.select(*AXES, "ax", "ay", "az"), 5, "ax", "ay", "az")


@query
def tsc_gather(spark, sf):
    f = integer_force_field(spark, sf, "tsc", N)
    g = GA.gather(salted_lines(spark, sf), f, ["gx", "gy", "gz"], "tsc", N, BOX, ["ax", "ay", "az"])
    return rounded(g.select(*AXES, "ax", "ay", "az"), 4, "ax", "ay", "az")


# ---- spectra ----

@query
def dft_spectrum(spark, sf):
    m = S.modes(S.spectrum(mesh(spark, sf), "q", N), "q")
    return m.select("kx", "ky", "kz", rd("q_re", 1).alias("re"), rd("q_im", 1).alias("im"))


@query
def inverse_roundtrip(spark, sf):
    back = S.cells(S.inverse(S.spectrum(mesh(spark, sf), "q", N), "q", N), "q")
    return back.select("ix", "iy", "iz", L.rint_long(F.col("q")).alias("q"))


def force_cells(spark, sf, which, r_s=0.0, match=None, digits=8):
    f = FO.force_mesh(mesh(spark, sf), N, BOX, total(spark, sf), which, r_s, match)
    return rounded(S.cells(f, FO.FORCE), digits, *FO.FORCE)


@query
def poisson_force(spark, sf):
    return force_cells(spark, sf, "mono")


@query
def long_force(spark, sf):
    return force_cells(spark, sf, "long", GEO.r_s)


@query
def short_force(spark, sf):
    return force_cells(spark, sf, "short", GEO.r_s)


@query
def coarse_force_matched(spark, sf):
    """The production long arm: split kernel times the TSC-to-CIC window match."""
    return force_cells(spark, sf, "long", GEO.r_s, FO.long_match(GEO))


@query
def global_force(spark, sf):
    """Deposit, solve and read back at every particle."""
    g = FO.force_global(salted_lines(spark, sf), N, BOX, total(spark, sf), "mono", scheme="cic")
    out = g.select(*AXES, *(F.col(f"g{a}_at").alias(f"g{a}") for a in AXES))
    return rounded(out, 7, "gx", "gy", "gz")


@query
def tiled_short_force(spark, sf):
    g = FO.force_short(salted_lines(spark, sf), GEO, total(spark, sf))
    out = g.select(*AXES, *(F.col(f"g{a}_at").alias(f"g{a}") for a in AXES))
    return rounded(out, 7, "gx", "gy", "gz")


@query
def two_level_force(spark, sf):
    g = FO.two_level_force(salted_lines(spark, sf), GEO, total(spark, sf))
    out = g.select(*AXES, *(F.col(f"g{a}_at").alias(f"g{a}") for a in AXES))
    return rounded(out, 7, "gx", "gy", "gz")


@query
def force_error_percentiles(spark, sf):
    """Two-level against single-mesh force at the same particles."""
    g = FO.two_level_force(salted_lines(spark, sf), GEO, total(spark, sf))
    got = [f"g{a}_at" for a in AXES]
    g = g.withColumnsRenamed({c: f"t{c}" for c in got})
    m = FO.force_global(salted_lines(spark, sf), GEO.n_fine, BOX, total(spark, sf), "mono", scheme="cic", readers=g, same=True)
    return rounded(FO.force_error_stats(m, [f"t{c}" for c in got], got), 7, "rms", "p50", "p95")


@query
def newton_pair_field(spark, sf):
    """Periodic Newtonian field of a charge at the origin, at every position of orders.

    Positions are moved by 2^-10, since one at the origin would have no finite field.
    """
    p = particles(spark, sf, "orders").select(*((F.col(a) + F.lit(0.0009765625)).alias(a) for a in AXES))
    return rounded(FO.newton_field(p, BOX), 9, "ex", "ey", "ez")


@query
def zeldovich_displacement(spark, sf):
    f = IC.zeldovich(mesh(spark, sf), "q", N, BOX, scale(spark, sf))
    return rounded(S.cells(f, FO.FORCE), 8, *FO.FORCE)


def counts_mesh(spark, sf, n=N):
    """Counts over the mean, as pencils."""
    m = mesh(spark, sf, "tsc", n)
    s = scale(spark, sf, n)
    return m.select("ix", "iy", "iz", (F.col("q") * F.lit(s)).alias("d"))


@query
def lpt2_source(spark, sf):
    d = IC.second_order_source(counts_mesh(spark, sf), "d", N, BOX)
    return rounded(S.cells(d, "delta2"), 8, "delta2")


@query
def second_order_displacement(spark, sf):
    d = IC.second_order_source(counts_mesh(spark, sf), "d", N, BOX)
    return rounded(S.cells(IC.zeldovich(d, "delta2", N, BOX), FO.FORCE), 8, *FO.FORCE)


@query
def displacement_divergence(spark, sf):
    """div psi, which is minus the density away from the Nyquist planes."""
    psi = IC.zeldovich(mesh(spark, sf), "q", N, BOX, scale(spark, sf))
    return rounded(S.cells(IC.divergence(psi, FO.FORCE, N, BOX), "div"), 8, "div")


@query
def lpt_particles(spark, sf):
    """Second-order displaced lattice from the table's own density field."""
    p = IC.lpt_particles(counts_mesh(spark, sf), "d", N, BOX, 0.1, COSMO)
    return rounded(p, 7, *AXES, "vx", "vy", "vz")


@query
def plane_square_sums(spark, sf):
    m = counts_mesh(spark, sf)
    return m.groupBy("ix").agg(rd(F.sum(F.col("d") ** 2), 7).alias("sq"))


@query
def tophat_smoothed(spark, sf):
    d = HI.smoothed(counts_mesh(spark, sf), "d", N, BOX, [4.0, 6.0], cic=True)
    return rounded(d, 8, "r0", "r1")


# ---- statistics ----

@query
def shell_mask(spark, sf):
    """Modes of one half-open shell."""
    m = S.modes(S.spectrum(mesh(spark, sf), "q", N), "q")
    k = F.sqrt(K.n2_column(N).cast("double"))
    return m.filter((k >= 2.5) & (k < 3.5)).select("kx", "ky", "kz", rd("q_re", 1).alias("re"))


@query
def pk_estimator(spark, sf):
    p = P.pk_estimator(mesh(spark, sf), "q", N, BOX, scale(spark, sf))
    return rounded(p, 7, "p", "k")


@query
def pk_deconvolved(spark, sf):
    p = P.pk_estimator(mesh(spark, sf, "cic"), "q", N, BOX, scale(spark, sf), window_order=2)
    return rounded(p, 7, "p", "k")


@query
def cross_r(spark, sf):
    m = P.join_meshes(mesh(spark, sf), mesh(spark, sf, table="orders"), "a", "b")
    return rounded(P.cross_r(m, "a", "b", N, BOX), 9, "r", "k")


@query
def band_power(spark, sf):
    shells = [(c * KF - 0.5 * KF, c * KF + 0.5 * KF) for c in (2, 4, 6)] + [(20 * KF, 21 * KF)]
    return rounded(P.band_power(mesh(spark, sf), "q", N, BOX, shells, scale(spark, sf)), 7, "p")


@query
def spectrum_ratio(spark, sf):
    a = P.pk_estimator(mesh(spark, sf), "q", N, BOX, scale(spark, sf))
    b = P.pk_estimator(mesh(spark, sf, table="orders"), "q", N, BOX, scale(spark, sf, table="orders"))
    return rounded(P.ratio(a, b), 7, "ratio", "k")


EDGES = [(i + 0.25) * KF for i in range(8)]


def card(spark, sf):
    return P.pk_card(mesh(spark, sf), N, BOX, total(spark, sf), A_OUT, COSMO, EDGES, min_weight=20.0)


@query
def pk_card(spark, sf):
    c = card(spark, sf)
    return c.select("bin", rd("k_mean", 8).alias("k_mean"), rd("p", 6).alias("p"), "n_modes",
                    rd("window_correction", 8).alias("window_correction"), rd("shot_fraction", 6).alias("shot_fraction"))


@query
def pk_card_oracle(spark, sf):
    """The bin-averaged linear spectrum beside the measured one, and its z profile."""
    return rounded(card(spark, sf), 6, "k_mean", "p", "p_oracle", "z_profile", "window_correction", "shot_fraction")


@query
def band_verdict(spark, sf):
    return rounded(P.band_verdict(card(spark, sf), 6 * KF, KF, 5.0), 6, "k_min", "k_max", "max_abs_z")


def recovery(spark, sf):
    linear = C.SpectrumTable(COSMO, N, BOX).power_fn()
    return P.linear_recovery(counts_mesh(spark, sf), "d", N, BOX, linear)


@query
def pk_linear_recovery(spark, sf):
    """Measured over linear power of the table's mesh, in 48 log bins."""
    return rounded(recovery(spark, sf), 6, "k", "ratio", "mode_mean", "sigma")


@query
def pk_recovery_summary(spark, sf):
    return rounded(P.recovery_summary(recovery(spark, sf), 0.5), 4, "chi2", "mean_all", "err_all", "mean_low", "err_low")


@query
def card_bin_shells(spark, sf):
    """The lattice shells and mode weights the card's bins average over."""
    m = S.modes(S.spectrum(mesh(spark, sf), "q", N), "q").withColumn("n2", K.n2_column(N))
    k = F.sqrt(F.col("n2").cast("double"))
    b = F.floor(k - F.lit(0.25)).cast("long")
    rows = m.select(b.alias("bin"), F.col("n2").cast("long").alias("n2"), K.hermitian_weight(N).alias("w"),
                    F.expr(P.product_sql("q", "q")).alias("p"))
    rows = rows.filter((F.col("bin") >= 0) & (F.col("bin") < 6) & (F.col("n2") > 0))
    s = scale(spark, sf)
    return rows.groupBy("bin", "n2").agg(F.sum("w").alias("modes"),
                                         rd(F.sum(F.col("w") * F.col("p")) * F.lit(s * s), 4).alias("power"))


@query
def card_shells_verified(spark, sf):
    """The lattice shells of the measured card's bins, refused where the card averages over other modes."""
    edges = [e / KF for e in EDGES[:-1]]  # the last bin reaches the Nyquist planes
    return P.verified_shells(P.lattice_shells(edges, N, spark), card(spark, sf).where(F.col("bin") < len(edges) - 1))


@query
def interlaced_pk(spark, sf):
    return rounded(P.interlaced_pk(lines(spark, sf), N, BOX, total(spark, sf)), 6, "k", "p", "p_raw")


@query
def velocity_spectra(spark, sf):
    v = P.velocity_spectra(lines(spark, sf), N, BOX, total(spark, sf))
    return rounded(v, 4, "k", "p_density", "p_momentum", "p_divergence")


@query
def velocity_compare(spark, sf):
    """Density, momentum and divergence of the particles against their drifted state."""
    a = lines(spark, sf)
    d = ST.drift(ST.decode(*coded_lines(spark, sf), GEO), GEO, DRIFT)
    b = d.select(*(L.position_of(F.col(f"j{c}"), GEO.lattice).alias(c) for c in AXES), "vx", "vy", "vz")
    v = P.velocity_compare(a, b, N, BOX, total(spark, sf))
    return rounded(v, 6, *(c for c in v.columns if c not in ("bin", "n_modes")))


@query
def residual_power(spark, sf):
    """Residual of div psi = -delta on and off the Nyquist planes."""
    psi = IC.zeldovich(mesh(spark, sf), "q", N, BOX, scale(spark, sf))
    div = S.cells(IC.divergence(psi, FO.FORCE, N, BOX), "div")
    j = div.join(counts_mesh(spark, sf), ["ix", "iy", "iz"], "left").fillna(0.0, ["d"])
    j = j.select("ix", "iy", "iz", (F.col("d") - 1.0).alias("delta"), (F.col("div") + F.col("d") - 1.0).alias("res"))
    m = S.modes(S.spectrum(j, ["delta", "res"], N), ["delta", "res"])
    return rounded(P.residual_power(m, "delta", "res", N), 9, "resid_all", "resid_off", "resid_on", "field_on")


TRIANGLES = [(2 * KF, 2 * KF, 2 * KF), (2 * KF, 4 * KF, 4 * KF), (3 * KF, 4 * KF, 5 * KF), (KF, KF, 7 * KF)]


@query
def bispectrum(spark, sf):
    b = HI.bispectrum(counts_mesh(spark, sf), "d", N, BOX, TRIANGLES)
    return rounded(b, 4, "b", "n_triplets")


@query
def cross_bispectrum(spark, sf):
    m = P.join_meshes(mesh(spark, sf), mesh(spark, sf, table="orders"), "a", "b")
    sa, sb = scale(spark, sf), scale(spark, sf, table="orders")
    m = m.withColumns({"a": F.col("a") * F.lit(sa), "b": F.col("b") * F.lit(sb)})
    return rounded(HI.cross_bispectrum(m, ("a", "b", "b"), N, BOX, TRIANGLES[:2]), 4, "b", "n_triplets")


@query
def subvolume_power(spark, sf):
    p = HI.subvolume_power(mesh(spark, sf), "q", N, BOX, 4, [2 * math.pi * 4 / BOX], scale=scale(spark, sf))
    return rounded(rounded(p, 12, "delta_bar"), 7, "p")


@query
def subvolume_response(spark, sf):
    p = HI.subvolume_power(mesh(spark, sf), "q", N, BOX, 4, [2 * math.pi * 4 / BOX], scale=scale(spark, sf))
    return rounded(HI.subvolume_response(p), 6, "p_mean", "slope", "slope_err")


@query
def sub_moments(spark, sf):
    d = HI.smoothed(counts_mesh(spark, sf), "d", N, BOX, [4.0])
    return rounded(HI.sub_moments(d, "r0", N, 4, scale=10.0), 7, "m2", "m3")


@query
def skewness_theory(spark, sf):
    """Variance, its slope and S3 of the smoothed counts beside linear theory, at two radii."""
    t = HI.skewness_against_theory(counts_mesh(spark, sf), "d", N, BOX, [4.0, 6.0], 4, COSMO)
    t = rounded(t, 7, "sigma2", "gamma", "s3_tree", "s3_zeldovich")
    return rounded(rounded(t, 4, "s3", "s3_err"), 3, "sigma2_linear", "gamma_linear")


@query
def skewness_jackknife(spark, sf):
    d = HI.smoothed(counts_mesh(spark, sf), "d", N, BOX, [4.0])
    return rounded(HI.skewness(HI.sub_moments(d, "r0", N, 4)), 5, "s3", "s3_err")


S3_RADIUS, S3_A = 4.0, 0.1


def tree_cells(spark, sf):
    """D1 delta and D2 div psi2, smoothed at one radius."""
    d = counts_mesh(spark, sf)
    psi2 = IC.zeldovich(IC.second_order_source(d, "d", N, BOX), "delta2", N, BOX)
    first = HI.smoothed(d, "d", N, BOX, [S3_RADIUS])
    second = HI.smoothed(IC.divergence(psi2, FO.FORCE, N, BOX), "div", N, BOX, [S3_RADIUS])
    both = first.join(second.withColumnRenamed("r0", "s"), ["ix", "iy", "iz"])
    return both.select("ix", "iy", "iz", (F.lit(C.growth(S3_A, COSMO)) * F.col("r0")).alias("d"), (F.lit(C.growth2(S3_A, COSMO)) * F.col("s")).alias("s"))


@query
def tree_skewness(spark, sf):
    """Tree-level skewness of the second-order displacement term."""
    return rounded(HI.tree_skewness(tree_cells(spark, sf), "d", "s", N, 4), 4, "ds3_tree", "ds3_tree_err")


@query
def paired_skewness(spark, sf):
    """Skewness of second- less first-order displaced particles against its tree term, paired by sub-cube."""
    def painted(order):
        p = IC.lpt_particles(counts_mesh(spark, sf), "d", N, BOX, S3_A, COSMO, order)
        cells = HI.smoothed(D.deposit_float(p, "cic", N, BOX, {"w": "1.0D"}), "w", N, BOX, [S3_RADIUS], cic=True)
        return HI.sub_moments(cells, "r0", N, 4)

    tree = HI.tree_moments(tree_cells(spark, sf), "d", "s", N, 4)
    t = HI.paired_skewness(painted(2), painted(1), tree)
    return rounded(t, 4, "ds3", "ds3_err", "tree", "tree_err", "remainder", "remainder_err")


# ---- evolution ----

def decoded_lines(spark, sf):
    return ST.decode(*coded_lines(spark, sf), GEO)


@query
def dither_bits(spark, sf):
    """The 53-bit offsets, as integers."""
    j = L.with_lattice(lines(spark, sf), GEO.lattice).select("jx", "jy", "jz")
    u = with_dither(j, DITHER_KEY)
    return u.select("jx", "jy", "jz", *((F.col(f"u_{a}") * F.lit(2.0**53)).cast("long").alias(f"u_{a}") for a in AXES))


@query
def drift_nearest(spark, sf):
    d = ST.drift(decoded_lines(spark, sf), GEO, DRIFT)
    return d.select("jx", "jy", "jz", "src", "brick")


@query
def drift_dithered(spark, sf):
    d = ST.drift(decoded_lines(spark, sf), GEO, DRIFT, DITHER_KEY)
    return d.select("jx", "jy", "jz", "src", "brick")


@query
def dest_census(spark, sf):
    return ST.census(ST.drift(decoded_lines(spark, sf), GEO, DRIFT, DITHER_KEY))


@query
def migration_stats(spark, sf):
    return rounded(ST.migration_stats(ST.drift(decoded_lines(spark, sf), GEO, DRIFT), GEO), 9, "migrant_frac")


@query
def migrate_rescale(spark, sf):
    return ST.drift_and_migrate(*coded_lines(spark, sf), GEO, DRIFT, DITHER_KEY)[0]


@query
def migrate_scales(spark, sf):
    return ST.drift_and_migrate(*coded_lines(spark, sf), GEO, DRIFT, DITHER_KEY)[1]


@query
def brick_reach(spark, sf):
    return ST.brick_reach(coded_lines(spark, sf)[1], GEO, DRIFT)


@query
def codec_emulation(spark, sf):
    """Float state rounded through the position and per-brick velocity codecs."""
    p = raw_lines(spark, sf).withColumns({a: F.pmod(F.col(a), F.lit(BOX)) for a in AXES}).drop("l_linenumber")
    return rounded(ST.emulate_codes(p, GEO, "xv"), 9, "vx", "vy", "vz")


@query
def quantisation_statistics(spark, sf):
    """Median drift in quanta, and the share below half a quantum."""
    q = GEO.lattice.quantum
    v = lines(spark, sf).select(F.explode(F.array("vx", "vy", "vz")).alias("v"))
    a = F.abs(F.col("v") * F.lit(0.004)) / F.lit(q)
    below = v.agg(rd(F.avg((a < 0.5).cast("int")), 9).alias("below_half"))
    return rounded(R.percentiles(v.select(a.alias("a")), "a", {"med": 0.5}), 9, "med").join(below)


# ---- halos ----

LINK, FLOOR = 0.4, 3


def catalog(spark, sf, table="lineitem"):
    return H.fof_catalog(particles(spark, sf, table), GEO.lattice, LINK, FLOOR)


def drifted_positions(spark, sf):
    d = ST.drift(decoded_lines(spark, sf), GEO, 0.02)
    return d.select(*(L.position_of(F.col(f"j{a}"), GEO.lattice).alias(a) for a in AXES))


def drifted_catalog(spark, sf):
    return H.fof_catalog(durable(drifted_positions(spark, sf)), GEO.lattice, LINK, FLOOR)


@query
def halo_fof(spark, sf):
    return rounded(catalog(spark, sf, "orders"), 7, "cx", "cy", "cz")


@query
def halo_fof_lineitem(spark, sf):
    return rounded(catalog(spark, sf), 7, "cx", "cy", "cz")


@query
def halo_fof_raw(spark, sf):
    """Groups of positions off the lattice, numbered by decreasing count."""
    at = particles(spark, sf, "lineitem", keep=["l_linenumber"])
    shifted = at.select(*((F.col(a) + F.col("l_linenumber") * F.lit(w * 2.0**-12)).alias(a) for a, w in zip(AXES, (1, 3, 5))))
    return rounded(H.raw_catalog(shifted, BOX, LINK * GEO.lattice.spacing, FLOOR), 7, "cx", "cy", "cz")


@query
def halo_match(spark, sf):
    m = H.match(catalog(spark, sf), drifted_catalog(spark, sf), GEO.lattice, 4.0)
    return rounded(m, 7, "d")


HALO_EDGES = (3, 4, 6, 10)


@query
def halo_abundance(spark, sf):
    a = H.abundance(catalog(spark, sf), drifted_catalog(spark, sf), HALO_EDGES)
    return rounded(a, 9, "ratio", "sigma")


@query
def halo_match_table(spark, sf):
    a, b = catalog(spark, sf), drifted_catalog(spark, sf)
    t = H.match_table(H.match(a, b, GEO.lattice, 4.0), a, b, GEO.lattice, HALO_EDGES)
    return rounded(t, 6, "f_match_a", "f_match_b", "p16", "p50", "p84", "med_offset")


BIAS_SHELLS = [i * 2.0 * math.pi / BOX for i in (1, 3, 5, 7)]


@query
def halo_bias(spark, sf):
    """Halo bias, its ratio, and cross-correlations of the two catalogues, per count bin and shell."""
    t = H.bias_table((lines(spark, sf), drifted_positions(spark, sf)), (catalog(spark, sf), drifted_catalog(spark, sf)),
                     N, BOX, BIAS_SHELLS, HALO_EDGES, 5)
    return rounded(t, 6, "k_mean", "b_a", "b_b", "b_ratio", "r_hh", "pmm_ratio", "r_mm")
