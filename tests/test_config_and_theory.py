import json
import math

import numpy as np
import pytest

from meshtide.config import Cosmology, Geometry, Lattice, geometry, padded_side
from meshtide.functions import cosmology as C
from meshtide.functions import schedule as SCH
from meshtide.operators.higher import straddle_fraction
from meshtide.sources import linear_pk

COSMO = Cosmology()
EDS = Cosmology(Omega_m=1.0 - 1e-12)


def test_lattice_refuses_bad_geometry():
    with pytest.raises(ValueError):
        Lattice(32.0, 48)
    with pytest.raises(ValueError):
        Lattice(32.0, 31)
    with pytest.raises(ValueError):
        Lattice(-1.0, 32)
    Lattice(32.0, 1024).check_ids()
    with pytest.raises(ValueError):
        Lattice(32.0, 2048).check_ids()


def test_presets_are_consistent():
    from meshtide.config import PRESETS
    for name in PRESETS:
        g = geometry(name)
        assert g.n_tile % g.brick == 0 and g.real_buffer % g.brick == 0
        assert g.span_bricks <= g.bricks
    assert geometry("smoke").brick == 8 and geometry("smoke").bricks == 8
    assert geometry("cdev", n_fine=1024).buffer == 64


def test_wrapping_tile_is_refused():
    with pytest.raises(ValueError):
        Geometry(32, 32.0, 64, 16, 32, 32)
    with pytest.raises(ValueError):
        padded_side(64, 8, 64)


def test_growth_limits():
    assert C.growth(1.0, COSMO) == pytest.approx(1.0, abs=1e-14)
    assert C.growth(0.3, EDS) == pytest.approx(0.3, rel=1e-9)
    assert C.growth_rate(0.3, EDS) == pytest.approx(1.0, rel=1e-9)
    h = 1e-5
    slope = (math.log(C.growth(0.6 * (1 + h), COSMO)) - math.log(C.growth(0.6 * (1 - h), COSMO))) / (2 * h)
    assert C.growth_rate(0.6, COSMO) == pytest.approx(slope, rel=1e-8)


def test_second_order_growth():
    assert C.growth2(0.1, COSMO) == pytest.approx(C.growth2(0.1, COSMO, "eds"), rel=1e-4)
    assert C.growth2(1.0, COSMO) != pytest.approx(C.growth2(1.0, COSMO, "eds"), rel=1e-3)
    assert C.growth2(0.5, EDS) == pytest.approx(-3.0 / 7.0 * 0.25, rel=1e-7)
    assert C.growth2_rate(0.01, COSMO) == pytest.approx(2.0, rel=1e-4)
    with pytest.raises(ValueError):
        C.growth2(3.0, COSMO)


def test_power_is_normalised_and_bounded():
    assert C.sigma_R(8.0, COSMO) == pytest.approx(COSMO.sigma8, rel=1e-12)
    assert C.transfer(1e-6, COSMO) == pytest.approx(1.0, abs=1e-3)
    tab = C.SpectrumTable(COSMO, 32, 256.0)
    k = np.array([0.03, 0.2, 0.7])
    assert np.allclose(tab.power(k), C.linear_power(k, COSMO), rtol=1e-5)
    with pytest.raises(ValueError):
        tab.power(np.array([1e3]))
    with pytest.raises(ValueError):
        C.SpectrumTable(COSMO, 4096, 16.0)
    # squeezed limit of the local template: B ~ 4 f P(long) P(short) M(short) / (M(long) M(short))
    b = C.fnl_template([(0.01, 0.5, 0.5)], COSMO, 1.0)[0]
    p, m = C.linear_power(np.array([0.01, 0.5]), COSMO), C.poisson_M(np.array([0.01, 0.5]), COSMO)
    assert b == pytest.approx(4 * p[0] * p[1] / m[0] + 2 * m[0] / m[1] ** 2 * p[1] ** 2, rel=1e-9)


def test_nonlinear_scale():
    k = C.nonlinear_scale(lambda q: C.linear_power(q, COSMO))
    assert k**3 * C.linear_power(k, COSMO) / (2 * np.pi**2) == pytest.approx(1.0, rel=1e-3)
    assert C.nonlinear_scale(lambda q: 0.0 * q + 1e-30) is None


def test_schedule():
    a = SCH.a_grid(0.1, 1.0, 8)
    s = SCH.bullfrog(a, COSMO)
    # a growing mode keeps growing: v = D-time velocity of the Zel'dovich solution stays 1
    assert np.all((s.alpha > 0) & (s.alpha < 1)) and np.allclose(s.alpha + s.beta, 1.0)
    e = SCH.bullfrog(a, EDS, growth2="eds")
    D0, D1 = e.D[0], e.D[1]
    mid = 0.5 * (D0 + D1)
    F = (-3 / 7 * D0**2 - 6 / 7 * D0 * 0.5 * (D1 - D0)) / mid - mid
    assert e.alpha[0] == pytest.approx((-6 / 7 * D1 - F) / (-6 / 7 * D0 - F), rel=1e-12)
    with pytest.raises(ValueError):
        SCH.bullfrog(a, COSMO, D_of_a=lambda x: x)
    exact, fast = SCH.kdk(a, COSMO), SCH.kdk(a, COSMO, "fastpm")
    assert exact.shape == fast.shape == (8, 3) and np.allclose(exact, fast, rtol=0.1)


def test_straddle_fraction():
    assert straddle_fraction(16, 4, 0, 4) == 0.0
    assert straddle_fraction(16, 4, 2, 4) == 1.0
    # cells 0..3 4..7 8..11 12..15 shifted by 1 against walls at 8: one axis crossed in two of four places
    assert straddle_fraction(16, 4, 1, 2) == pytest.approx(1 - 0.5**3)


def spectrum_document():
    k = np.geomspace(C.K_MIN, C.K_MAX, 600)
    return linear_pk.make(k, C.linear_power(k, COSMO), COSMO, "analytic").document()


def test_spectrum_round_trip(spark, tmp_path):
    path, doc = tmp_path / "pk.json", spectrum_document()
    path.write_text(json.dumps(doc))
    assert linear_pk.load(spark, str(path), COSMO).digest() == doc["digest"]


@pytest.mark.parametrize("message, change", [
    ("format", lambda d: d.update(format="other")),
    ("redshift", lambda d: d.update(redshift=1.0)),
    ("written with", lambda d: d.update(digest="0" * 64)),
    ("h is 0.7", lambda d: d["cosmology"].update(h=0.7)),
    ("extra is 1", lambda d: d["cosmology"].update(extra=1.0)),
    ("sigma8", lambda d: (d.pop("digest"), d["columns"].update(power=[2 * p for p in d["columns"]["power"]]))),
    ("ascend", lambda d: d["columns"].update(k=d["columns"]["k"][::-1])),
    ("span", lambda d: (d.pop("digest"), d.update(columns={n: v[5:] for n, v in d["columns"].items()}))),
    ("one length", lambda d: d["columns"]["k"].pop()),
    ("positive", lambda d: d["columns"]["power"].__setitem__(3, -1.0)),
    ("one length", lambda d: d.pop("columns")),
])
def test_spectrum_faults_are_named(message, change):
    doc = spectrum_document()
    change(doc)
    with pytest.raises(ValueError, match=message):
        linear_pk.parse(doc, COSMO)
