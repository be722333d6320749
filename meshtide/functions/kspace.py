"""Wavenumbers, kernels and windows: NumPy for the transform tasks, Columns for mode rows.

Conventions: forward transform unnormalised, inverse 1/n^3, half grid along z, and
``g = ik / k^2 * delta`` solves ``div g = -delta``.  ``k2`` keeps a true zero at DC for the split
factor; only the division uses a safe copy.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def freqs(n: int, cell: float, half: bool = False) -> np.ndarray:
    """Angular wavenumbers of an n-point axis."""
    f = np.fft.rfftfreq(n, d=cell) if half else np.fft.fftfreq(n, d=cell)
    return 2.0 * np.pi * f


def pencil_k(n: int, cell: float, ky: int):
    """(kx[:, None], ky, kz[None, :], k2) of the plane of modes at one ky index."""
    kx, kz = freqs(n, cell)[:, None], freqs(n, cell, half=True)[None, :]
    kv = freqs(n, cell)[ky]
    return kx, kv, kz, kx**2 + kv**2 + kz**2


def split(k2, r_s: float, which: str):
    """Gaussian split: 'long' is S = exp(-k2 rs^2), 'short' is literally 1 - S, 'mono' is 1."""
    if which == "mono":
        return np.ones_like(k2)
    s = np.exp(-k2 * float(r_s) ** 2)
    if which == "long":
        return s
    if which == "short":
        return 1.0 - s
    raise ValueError(f"which is 'mono', 'long' or 'short', not {which!r}")


def window_1d(k, cell: float, order: int):
    """sinc^order of an assignment on cells of side ``cell`` (order 2 CIC, 3 TSC)."""
    return np.sinc(k * cell / (2.0 * np.pi)) ** order


def window(kx, ky, kz, cell: float, order: int):
    return window_1d(kx, cell, order) * window_1d(ky, cell, order) * window_1d(kz, cell, order)


def match_factor(kx, ky, kz, solve, target, order_solve=2, order_target=2, clip=None):
    """(W_target / W_solve)^2: re-windows a field painted and gathered on the solve cell."""
    ratio = (window(kx, ky, kz, target, 2 * order_target)
             / window(kx, ky, kz, solve, 2 * order_solve))
    return ratio if clip is None else np.minimum(ratio, float(clip))


def force_kernel(n, box, which="mono", r_s=0.0, match=None, clip=None, scale=1.0):
    """Task kernel {gx, gy, gz}: scale * S ik / k^2, optionally window matched.

    ``match`` is (solve cell, target cell, solve order, target order).
    """
    cell = box / n

    def kernel(ky, fields):
        kx, kv, kz, k2 = pencil_k(n, cell, ky)
        pref = scale * split(k2, r_s, which) / np.where(k2 > 0.0, k2, 1.0)
        if match is not None:
            pref = pref * match_factor(kx, kv, kz, *match, clip=clip)
        (d,) = fields
        return {"gx": 1j * kx * pref * d, "gy": 1j * kv * pref * d, "gz": 1j * kz * pref * d}

    return kernel


def second_derivatives(n, box):
    """Task kernel: the six fields -k_i k_j / k^2 delta."""
    cell = box / n

    def kernel(ky, fields):
        kx, kv, kz, k2 = pencil_k(n, cell, ky)
        (d,) = fields
        d = d / np.where(k2 > 0.0, k2, 1.0)
        axis = {"x": kx, "y": kv, "z": kz}
        return {p: -axis[p[0]] * axis[p[1]] * d for p in ("xx", "yy", "zz", "xy", "xz", "yz")}

    return kernel


def divergence_kernel(n, box):
    cell = box / n

    def kernel(ky, fields):
        kx, kv, kz, _ = pencil_k(n, cell, ky)
        px, py, pz = fields
        return {"div": 1j * (kx * px + kv * py + kz * pz)}

    return kernel


def radial_kernel(n, box, f, dc, name="field"):
    """Task kernel: multiply by f(|k|), the DC mode by ``dc``."""
    cell = box / n

    def kernel(ky, fields):
        _, _, _, k2 = pencil_k(n, cell, ky)
        k = np.sqrt(k2)
        lowest = 2.0 * np.pi / box
        m = np.asarray(f(np.where(k > 0.0, k, lowest)))
        m = np.where(k > 0.0, m, dc)
        (d,) = fields
        return {name: m * d}

    return kernel


def tophat(x):
    """Fourier top hat 3 (sin x - x cos x) / x^3, 1 at x = 0."""
    safe = np.where(x > 0.0, x, 1.0)
    return np.where(x > 0.0, 3.0 * (np.sin(safe) - safe * np.cos(safe)) / safe**3, 1.0)


def smooth_kernel(n, box, radii, cic=False):
    """Task kernel: top-hat smoothing at each radius, optionally dividing out the CIC window."""
    cell = box / n

    def kernel(ky, fields):
        kx, kv, kz, k2 = pencil_k(n, cell, ky)
        (d,) = fields
        d = np.where(k2 > 0.0, d, 0.0)
        if cic:
            d = d / window(kx, kv, kz, cell, 2)
        k = np.sqrt(k2)
        return {f"r{i}": d * tophat(k * r) for i, r in enumerate(radii)}

    return kernel


def shell_kernel(n, box, shells, weight=None):
    """Task kernel: band fields of (lo, hi) shells of the field, and ones-filled mode counts."""
    cell = box / n

    def kernel(ky, fields):
        _, _, _, k2 = pencil_k(n, cell, ky)
        k = np.sqrt(k2)
        (d,) = fields
        out = {}
        for i, (lo, hi) in enumerate(shells):
            m = ((k >= lo) & (k < hi)).astype(float)
            out[f"i{i}"], out[f"j{i}"] = d * m, m.astype(complex)
            if weight is not None:
                f, g = weight(k)
                out[f"f{i}"], out[f"g{i}"] = (m * f).astype(complex), (m * g).astype(complex)
        return out

    return kernel


# ---- Column forms, for mode rows (kx, ky, kz integer indices on the half grid) ----

def signed(i: Column, n: int) -> Column:
    """Signed frequency index; the Nyquist index is negative, as in the FFT ordering."""
    return F.when(i >= (n + 1) // 2, i - n).otherwise(i)


def k_columns(n: int, box: float) -> dict[str, Column]:
    kf = 2.0 * np.pi / box
    kx, ky = signed(F.col("kx"), n) * F.lit(kf), signed(F.col("ky"), n) * F.lit(kf)
    kz = F.col("kz") * F.lit(kf)
    return {"k_x": kx, "k_y": ky, "k_z": kz}


def n2_column(n: int) -> Column:
    """|n|^2 of a mode in units of the fundamental, an exact integer."""
    kx, ky = signed(F.col("kx"), n), signed(F.col("ky"), n)
    return kx * kx + ky * ky + F.col("kz") * F.col("kz")


def hermitian_weight(n: int) -> Column:
    """Full-grid multiplicity of a half-grid mode."""
    edge = F.col("kz") == 0
    if n % 2 == 0:
        edge = edge | (F.col("kz") == n // 2)
    return F.when(edge, 1.0).otherwise(2.0)


def sinc_column(k_index: Column, n: int, order: int) -> Column:
    """sinc^order(k / (2 k_nyquist)) from a signed mode index."""
    x = k_index.cast("double") * F.lit(np.pi / n)
    return F.pow(F.when(x == 0.0, 1.0).otherwise(F.sin(x) / x), F.lit(float(order)))


def window_column(n: int, order: int) -> Column:
    return (sinc_column(signed(F.col("kx"), n), n, order)
            * sinc_column(signed(F.col("ky"), n), n, order)
            * sinc_column(F.col("kz"), n, order))
