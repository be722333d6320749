import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtide.config import Cosmology, Geometry, geometry
from meshtide.functions import kspace as K
from meshtide.operators import forces as FO
from meshtide.operators import gather as GA
from meshtide.operators import higher as HI
from meshtide.operators import power as P
from meshtide.operators import spectral as S
from meshtide.plans import initial as IC
from meshtide.sources.particles import white_noise
from tests.test_particles import BOX, dense, frame, reference_mesh

GEO = geometry("smoke")
KF = 2 * np.pi / BOX


def mesh_frame(spark, field, name="q"):
    i = np.indices(field.shape).reshape(3, -1)
    return spark.createDataFrame(pd.DataFrame({"ix": i[0], "iy": i[1], "iz": i[2], name: field.ravel()}))


def pencil_cube(df, name, n):
    out = np.zeros((n, n, n))
    for r in df.select("ix", "iy", name).collect():
        out[r.ix, r.iy] = r[name]
    return out


def test_forward_and_inverse(spark):
    f = np.random.default_rng(0).normal(size=(12, 12, 12))
    df = mesh_frame(spark, f)
    ref = np.fft.rfftn(f)
    got = S.modes(S.spectrum(df, "q", 12), "q").toPandas()
    z = (got.q_re + 1j * got.q_im).to_numpy()
    assert np.abs(z - ref[got.kx, got.ky, got.kz]).max() < 1e-12
    back = pencil_cube(S.inverse(S.spectrum(df.repartition(5), "q", 12), "q", 12), "q", 12)
    assert np.abs(back - f).max() < 1e-13


def test_split_identity_and_force(spark):
    n = 16
    pos = np.random.default_rng(1).uniform(0, BOX, (800, 3))
    q = mesh_frame(spark, reference_mesh(pos, n, "cic"))
    cubes = {w: pencil_cube(FO.force_mesh(q, n, BOX, 800, w, 3.0), "gx", n) for w in ("mono", "long", "short")}
    assert np.abs(cubes["long"] + cubes["short"] - cubes["mono"]).max() < 1e-12
    d = np.fft.rfftn(reference_mesh(pos, n, "cic") / 4096 / (800 / n**3) - 1)
    k, kz = K.freqs(n, BOX / n), K.freqs(n, BOX / n, True)
    k2 = k[:, None, None] ** 2 + k[None, :, None] ** 2 + kz[None, None, :] ** 2
    k2[0, 0, 0] = 1
    assert np.abs(cubes["mono"] - np.fft.irfftn(1j * k[:, None, None] * d / k2, s=(n,) * 3)).max() < 1e-12


def test_tiled_force_is_the_tile_algorithm(spark):
    """One tile solved by hand, with its own wrap, against the distributed form."""
    rng = np.random.default_rng(2)
    pos = np.rint(rng.uniform(0, BOX, (600, 3)) / GEO.lattice.quantum) * GEO.lattice.quantum % BOX
    got = FO.force_short(GA.with_salt(frame(spark, pos, ids=True)), GEO, 600).toPandas().sort_values("id")
    P_, b, T, cell = GEO.pad_side, GEO.real_buffer, GEO.n_tile, GEO.fine_cell
    tile = (3, 0, 2)
    own = np.all(np.floor(pos / cell).astype(int) // T == tile, axis=1)
    u = np.mod(pos - (np.array(tile) * T - b) * cell, BOX)
    inside = np.all(u < P_ * cell, axis=1)
    import tests.test_particles as TP
    old, TP.BOX = TP.BOX, P_ * cell  # the padded box is periodic in its own side
    mesh = reference_mesh(u[inside], P_, "cic") / 4096 / (600 / GEO.n_fine**3)
    TP.BOX = old
    k, kz = K.freqs(P_, cell), K.freqs(P_, cell, True)
    k2 = k[:, None, None] ** 2 + k[None, :, None] ** 2 + kz[None, None, :] ** 2
    pref = (1 - np.exp(-k2 * GEO.r_s**2)) / np.where(k2 > 0, k2, 1)
    g = np.fft.irfftn(np.fft.rfftn(mesh) * pref * 1j * k[:, None, None], s=(P_,) * 3)
    base, w = GA.stencil_weights(u[own], "cic", cell)
    want = sum(w[c[0]][:, 0] * w[c[1]][:, 1] * w[c[2]][:, 2] * g[tuple((base[:, a] + c[a]) % P_ for a in range(3))]
               for c in itertools.product((0, 1), repeat=3))
    assert own.sum() > 3 and np.abs(got["gx_at"].to_numpy()[own] - want).max() < 1e-11


def test_one_tile_without_a_buffer_is_the_whole_box(spark):
    rng = np.random.default_rng(11)
    pos = np.rint(rng.uniform(0, BOX, (500, 3)) / GEO.lattice.quantum) * GEO.lattice.quantum % BOX
    rows = GA.with_salt(frame(spark, pos, ids=True))
    one = Geometry(GEO.n_part, BOX, GEO.n_fine, GEO.n_coarse, GEO.n_fine, 0)
    tiled = FO.force_short(rows, one, 500).toPandas().sort_values("id")
    whole = FO.force_global(rows, GEO.n_fine, BOX, 500, "short", GEO.r_s).toPandas().sort_values("id")
    cols = [f"{c}_at" for c in FO.FORCE]
    scale = np.abs(whole[cols].to_numpy()).max()
    assert scale > 1e-6 and np.abs(tiled[cols].to_numpy() - whole[cols].to_numpy()).max() / scale < 1e-12


def test_batched_transforms_keep_meshes_apart(spark):
    """Three sparse meshes in one solve, against each alone; a mesh without a row yields none."""
    rng, n = np.random.default_rng(12), 8
    cubes = {m: rng.normal(size=(n, n, n)) * (rng.random((n, n, n)) < 0.3) for m in (-4, 0, 2**40)}
    rows = [(m, *map(int, i), float(c[tuple(i)])) for m, c in cubes.items() for i in np.argwhere(c)]
    df = spark.createDataFrame(rows, "mesh long, ix long, iy long, iz long, q double")
    got = S.solve(df, "q", n, K.force_kernel(n, BOX), FO.FORCE, by=["mesh"]).toPandas()
    assert len(got) == 3 * n * n
    for m in cubes:
        alone = S.solve(df.filter(F.col("mesh") == m).drop("mesh"), "q", n, K.force_kernel(n, BOX), FO.FORCE).toPandas()
        mine = got[got.mesh == m].sort_values(["ix", "iy"])
        for c in FO.FORCE:
            assert np.array_equal(np.stack(mine[c]), np.stack(alone.sort_values(["ix", "iy"])[c]))


def test_subvolume_power_against_cubes(spark):
    """Two bands of 8 sub-cubes of 8 cells (one of them empty), each transformed whole."""
    rng, n = np.random.default_rng(13), 16
    cube = rng.poisson(1.0, (n, n, n)).astype(float)
    cube[:8, :8, :8] = 0.0
    df = spark.createDataFrame([(*map(int, i), float(cube[tuple(i)])) for i in np.argwhere(cube)], "ix long, iy long, iz long, q double")
    kf, centers = 2 * np.pi / (BOX / 2), [2 * np.pi / (BOX / 2), 3 * 2 * np.pi / (BOX / 2)]
    got = HI.subvolume_power(df, "q", n, BOX, 2, centers, offset_frac=0.0, scale=0.5).toPandas().set_index(["sub", "band"])
    f, h = K.freqs(8, BOX / 16), K.freqs(8, BOX / 16, True)
    k = np.sqrt(f[:, None, None] ** 2 + f[None, :, None] ** 2 + h[None, None, :] ** 2)
    assert len(got) == 16
    for sub in range(8):
        x, y, z = sub // 4 * 8, sub // 2 % 2 * 8, sub % 2 * 8
        d = cube[x:x + 8, y:y + 8, z:z + 8] * 0.5 - 1.0
        p = np.abs(np.fft.rfftn(d)) ** 2 * (BOX / 2) ** 3 / 8.0**6
        for band, c in enumerate(centers):
            want = p[(k >= c - kf / 2) & (k < c + kf / 2)].mean()
            assert np.isclose(got.loc[(sub, band)].p, want, rtol=1e-12, atol=1e-15) and np.isclose(got.loc[(sub, band)].delta_bar, d.mean(), atol=1e-14)


def test_variance_and_its_slope_against_the_whole_grid(spark):
    from meshtide.functions import cosmology as C
    rng, n, radius, e = np.random.default_rng(14), 16, 5.0, 1e-4
    cube = rng.normal(size=(n, n, n))
    k = K.freqs(n, BOX / n)
    size = np.sqrt(k[:, None, None] ** 2 + k[None, :, None] ** 2 + k[None, None, :] ** 2)
    power = np.abs(np.fft.fftn(cube)) ** 2
    power[0, 0, 0] = 0.0
    var = lambda r: (power * K.tophat(size * r) ** 2).sum() / n**6
    got = HI.variance_slopes(mesh_frame(spark, cube), "q", n, BOX, [radius, 8.0]).orderBy("r").collect()
    assert [g.sigma2 for g in got] == pytest.approx([var(radius), var(8.0)], rel=1e-12)
    slope = lambda f: np.log(f(radius * (1 + e)) / f(radius * (1 - e))) / np.log((1 + e) / (1 - e))
    assert got[0].gamma == pytest.approx(slope(var), rel=1e-6)
    cosmo = Cosmology()
    assert C.sigma_slope(radius, cosmo) == pytest.approx(slope(lambda r: C.sigma_R(r, cosmo) ** 2), rel=1e-6)
    table = HI.skewness_against_theory(mesh_frame(spark, cube), "q", n, BOX, [radius], 4, cosmo, z=1.0).first()
    assert table.sigma2_linear == pytest.approx(C.sigma_R(radius, cosmo, 1.0) ** 2) and table.s3_tree - table.s3_zeldovich == pytest.approx(6 / 7)


def test_erfc():
    x = np.concatenate([np.linspace(0.0, 6.0, 601), [2.5, 10.0, 26.0]])
    assert np.allclose(FO.erfc(x), [math.erfc(v) for v in x], rtol=3e-12, atol=1e-15)


def test_newton_field_is_antisymmetric_and_inverse_square(spark):
    pts = np.array([[0.5, 0.0, 0.0], [-0.5, 0.0, 0.0]])
    e = FO.newton_field(frame(spark, pts).select("x", "y", "z"), BOX).toPandas()
    assert np.allclose(e.ex.sum(), 0.0, atol=1e-12) and abs(e.ex.max() - 4.0) < 0.01


def test_newton_field_does_not_depend_on_its_screening_or_on_the_period(spark):
    pts = frame(spark, np.random.default_rng(5).uniform(-BOX, BOX, (50, 3))).select("x", "y", "z")
    once = np.array(FO.newton_field(pts, BOX).select("ex", "ey", "ez").collect())
    for screening in (1.5, 4.0):
        assert np.allclose(np.array(FO.newton_field(pts, BOX, screening).select("ex", "ey", "ez").collect()), once, rtol=1e-11, atol=1e-13)
    moved = pts.selectExpr(f"x + {BOX} as x", f"y - {2 * BOX} as y", "z")
    assert np.allclose(np.array(FO.newton_field(moved, BOX).select("ex", "ey", "ez").collect()), once, rtol=1e-10, atol=1e-12)


def test_shells_hold_every_vector_once():
    whole, half = np.concatenate(FO.shells(3.5)), np.concatenate(FO.shells(3.5, half=True))
    both = sorted(map(tuple, np.concatenate([half, -half, [[0, 0, 0]]])))
    assert both == sorted(map(tuple, whole)) and len(set(both)) == len(both)
    assert len(whole) == sum(i * i + j * j + k * k <= 12 for i in range(-3, 4) for j in range(-3, 4) for k in range(-3, 4))


def test_white_noise_and_colour(spark):
    n, cosmo = 16, Cosmology()
    a = pencil_cube(white_noise(spark, n, 3), "white", n)
    assert np.array_equal(a, pencil_cube(white_noise(spark, n, 3).repartition(3), "white", n))
    assert not np.array_equal(a, pencil_cube(white_noise(spark, n, 4), "white", n))
    assert abs(a.mean()) < 0.1 and abs(a.std() - 1) < 0.05
    noise = white_noise(spark, n, 3)
    zero = pencil_cube(IC.linear_density(noise, "white", n, 256.0, cosmo), "delta", n)
    tiny = pencil_cube(IC.linear_density(noise, "white", n, 256.0, cosmo, f_nl=1e-9), "delta", n)
    assert np.abs(zero - tiny).max() < 1e-9 and zero.std() > 0.1


def test_displacement_divergence(spark):
    n = 16
    k = np.zeros((n, n, n))
    x = np.arange(n) * BOX / n
    k += np.cos(2 * KF * x)[:, None, None] + np.sin(3 * KF * x)[None, :, None]
    psi = IC.zeldovich(mesh_frame(spark, k, "d"), "d", n, BOX)
    div = pencil_cube(IC.divergence(psi, FO.FORCE, n, BOX), "div", n)
    assert np.abs(div + k).max() < 1e-12


def test_lpt_orders(spark):
    n, cosmo = 8, Cosmology()
    d = mesh_frame(spark, 0.1 * np.random.default_rng(6).normal(size=(n, n, n)), "d")
    one = IC.lpt_particles(d, "d", n, BOX, 0.1, cosmo, order=1).toPandas()
    two = IC.lpt_particles(d, "d", n, BOX, 0.1, cosmo).toPandas()
    assert len(one) == len(two) == n**3 and one.x.between(0, BOX).all()
    with pytest.raises(ValueError):
        IC.lpt_particles(d, "d", n, BOX, 0.1, cosmo, order=3)


def test_single_mode_power(spark):
    n = 16
    f = np.broadcast_to(np.cos(3 * KF * np.arange(n) * BOX / n)[:, None, None], (n, n, n)).copy()
    p = P.pk_estimator(mesh_frame(spark, f), "q", n, BOX).toPandas().set_index("bin")
    # two of the half-grid modes of the third shell carry |d_k|^2 = n^6 / 4
    assert p.p[2] == pytest.approx(2 * BOX**3 / 4 / p.n_modes[2], rel=1e-12)
    assert p.p.drop(2).abs().max() < 1e-20


def test_card_statistics_and_coverage(spark):
    n, box = 32, 64.0
    f = np.random.default_rng(8).normal(size=(n, n, n))
    edges = np.linspace(0, np.pi * n / box / 2, 9)
    flat = lambda k: np.full(len(k), (box / n) ** 3)
    parts = P.card_partials(mesh_frame(spark, f), "q", n, box, edges, 1.0, flat, window_order=0)
    P.check_coverage(parts, n)
    card = P.combine_card(parts, 0.0, 20.0).toPandas()
    assert card.z_profile.abs().max() < 4.0
    wrong = P.card_partials(mesh_frame(spark, 1.3 * f), "q", n, box, edges, 1.0, flat, window_order=0)
    assert P.combine_card(wrong, 0.0, 20.0).toPandas().z_profile.abs().max() > 5.0
    with pytest.raises(ValueError):
        P.check_coverage(parts.filter("ky <> 3"), n)
    with pytest.raises(ValueError):
        P.check_coverage(parts.unionByName(parts.filter("ky = 3")), n)


def test_ratio_refuses_other_bins(spark):
    a = spark.createDataFrame([(0, 1.0, 2.0), (1, 2.0, 3.0)], "bin long, k double, p double")
    assert P.ratio(a, a).toPandas().ratio.abs().max() == 0
    with pytest.raises(Exception, match="different bins"):
        P.ratio(a, a.filter("bin = 0")).collect()


def test_bispectrum_brute_force(spark):
    n = 8
    f = np.random.default_rng(12).normal(size=(n, n, n))
    tri = (2 * KF, 2 * KF, 2 * KF)
    got = HI.bispectrum(mesh_frame(spark, f), "q", n, BOX, [tri, (KF, KF, 7 * KF)]).toPandas()
    d = np.fft.fftn(f)
    m = np.fft.fftfreq(n, 1 / n).astype(int)
    idx = [(a, b, c) for a in m for b in m for c in m if 1.5 <= np.sqrt(a * a + b * b + c * c) < 2.5]
    keep = set(idx)
    total, count = 0.0, 0
    wrap = lambda v: (v + n // 2) % n - n // 2
    for p in idx:
        for q in idx:
            r = tuple(wrap(-p[a] - q[a]) for a in range(3))
            if r in keep:
                total += (d[p] * d[q] * d[r]).real
                count += 1
    assert got.n_triplets[0] == pytest.approx(count, abs=1e-6)
    assert got.b[0] == pytest.approx(BOX**6 / n**9 * total / count, rel=1e-10)
    assert np.isnan(got.b[1]) and got.n_triplets[1] == 0


def test_fnl_template_bins_near_the_continuum(spark):
    n, box, cosmo = 32, 256.0, Cosmology()
    kf = 2 * np.pi / box
    tris = [(3 * kf, 8 * kf, 8 * kf)]
    got = HI.binned_fnl_template(spark, n, box, cosmo, tris, 100.0).toPandas().b[0]
    from meshtide.functions.cosmology import fnl_template
    assert got == pytest.approx(fnl_template(tris, cosmo, 100.0)[0], rel=0.25)


def test_subvolume_refusals_and_slope(spark):
    n = 16
    f = np.random.default_rng(3).normal(size=(n, n, n))
    df = mesh_frame(spark, f)
    for kw in (dict(n_sub=3, centers=[1.0]), dict(n_sub=4, centers=[0.1]),
               dict(n_sub=4, centers=[4 * KF], offset_frac=0.0, tiles=4)):
        with pytest.raises(ValueError):
            HI.subvolume_power(df, "q", n, BOX, **kw)
    # each sub-cube holds the same pattern scaled with its own mean: slope 2a / (1 + a^2 var)
    s = np.random.default_rng(5)
    base = s.normal(size=(4, 4, 4))
    base -= base.mean()
    amp, c = 0.5, s.normal(size=64)
    c -= c.mean()
    rows = []
    for sub in range(64):
        block = base * (1 + amp * c[sub]) + c[sub]
        for (i, j, k), v in np.ndenumerate(block):
            at = [(sub // 16) * 4 + i, (sub // 4 % 4) * 4 + j, (sub % 4) * 4 + k]
            rows.append((*at, float(v)))
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["ix", "iy", "iz", "q"])).withColumn("q", F.col("q") + 1.0)
    r = HI.subvolume_response(HI.subvolume_power(df, "q", n, BOX, 4, [4 * KF * 1.0], offset_frac=0.0)).toPandas()
    x, y = c, (1 + amp * c) ** 2
    y = y / y.mean() - 1
    assert r.slope[0] == pytest.approx((x * y).sum() / (x * x).sum(), rel=1e-9)


def test_amplitude_projection(spark):
    pdf = pd.DataFrame([(s, t, (2.0 + s) * (t + 1), t + 1.0) for s in range(4) for t in range(3)],
                       columns=["seed", "triangle", "signal", "template"])
    r = HI.projected_amplitude(spark.createDataFrame(pdf)).first()
    assert r.amplitude == pytest.approx(3.5) and r.seeds == 4


def test_lattice_shells(spark):
    got = P.lattice_shells([0.5, 1.5, 2.5], 16, spark).toPandas()
    assert got.set_index(["bin", "n2"]).modes.loc[(0, 1)] == 6 and got[got.bin == 0].modes.sum() == 18
    with pytest.raises(ValueError):
        P.lattice_shells([0.5, 9.5], 16, spark)


def test_shells_are_refused_where_the_card_has_other_modes(spark):
    shells = P.lattice_shells([0.5, 1.5, 2.5], 16, spark)
    card = lambda *rows: spark.createDataFrame(rows, "bin long, n_modes double")
    own = {r.bin: float(r.n) for r in shells.groupBy("bin").agg(F.sum("modes").alias("n")).collect()}
    assert sorted(P.verified_shells(shells, card((0, own[0]), (1, own[1]))).collect()) == sorted(shells.select("bin", "n2", "modes").collect())
    assert {r.bin for r in P.verified_shells(shells, card((1, own[1]))).collect()} == {1}
    for wrong in ([(0, own[0] + 2.0)], [(0, own[0]), (7, 30.0)]):
        with pytest.raises(Exception, match="the card and its shells differ in bin"):
            P.verified_shells(shells, card(*wrong)).collect()


def test_dense_helper(spark):
    assert dense(mesh_frame(spark, np.ones((2, 2, 2))), 2).sum() == 8


def test_linear_recovery_of_white_noise(spark):
    """Unit white noise has power box^3 / n^3 at every mode: quotients average to one, chi2 to its bins."""
    n = 16
    noise = np.random.default_rng(6).normal(size=(n, n, n))
    cells = pd.DataFrame([(*c, noise[c]) for c in np.ndindex(noise.shape)], columns=["ix", "iy", "iz", "d"])
    rows = P.linear_recovery(spark.createDataFrame(cells), "d", n, BOX, lambda k: np.full(len(k), BOX**3 / n**3))
    got = P.recovery_summary(rows, 1.0).first()
    assert abs(got.mean_all - 1) < 5 * got.err_all and abs(got.mean_low - 1) < 5 * got.err_low
    assert got.chi2 < 3 * got.dof and rows.agg({"n_modes": "sum"}).first()[0] <= n**3 - 1
