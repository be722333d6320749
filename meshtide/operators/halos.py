"""Friends-of-friends groups, halo catalogues, mutual matching and abundances.

Linking is that of ``linking``: cells as graph nodes, decided by bounding boxes. Catalogues of coded particles link distinct lattice
positions, whose distances are exact; ``raw_catalog`` links coordinates as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshtide.config import Lattice
from meshtide.functions import kspace as K
from meshtide.functions import lattice as L
from meshtide.operators import deposit as D
from meshtide.operators import spectral as S
from meshtide.operators import linking
from meshtide.operators.rank import global_order, percentiles
from meshtide.session import durable

# Lower member-count edges of the abundance and matching tables; the last bin is open.
COUNT_EDGES = (20, 50, 150, 500, 1500)
RHO_CRIT = 2.77536627e11  # h^2 Msun / Mpc^3


def particle_mass(omega_m: float, lat: Lattice) -> float:
    return RHO_CRIT * omega_m * lat.spacing**3


def fof_cells(particles: DataFrame, lat: Lattice, b: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """(points, cells): x, y, z in levels with their cell, and the cells of ``linking`` with their root."""
    n = lat.levels
    # levels are whole numbers, so distances in levels are exact
    levels = L.with_lattice(particles, lat).select(*(F.col(f"j{a}").cast("double").alias(a) for a in "xyz"))
    return linking.linked_cells(levels, float(n), b * n / lat.n_part)


def fof_catalog(particles: DataFrame, lat: Lattice, b: float = 0.2, floor: int = 10) -> DataFrame:
    """(halo_id, n, cx, cy, cz) of groups with at least ``floor`` members.

    Ids are the group's lowest lattice position; centres are minimum-image means about it. A cell whose points share
    an image counts with its sums; only cells that half the box from the lowest position cuts look at points again.
    ``particles`` may be read three times: give a stored table, or a cheap projection of one.
    """
    points, cells = fof_cells(particles, lat, b)
    n, q, box = lat.levels, lat.quantum, lat.box
    groups = cells.groupBy("root").agg(F.min(F.struct("lx", "ly", "lz")).alias("least"), F.sum("n").alias("size"))
    groups = durable(groups.filter(F.col("size") >= floor).select("root", *(F.col(f"least.l{a}").alias(f"{a}0") for a in "xyz")))
    rows = cells.join(groups, "root")
    turns = lambda c, a: F.rint((F.col(c) - F.col(f"{a}0")) / F.lit(float(n)))
    one_image = F.lit(True)
    for a in "xyz":
        one_image = one_image & (turns(f"lo{a}", a) == turns(f"hi{a}", a))
    refs = [f"{a}0" for a in "xyz"]
    even = rows.filter(one_image).select("root", *refs, "n", *(
        (F.col(f"s{a}") - F.col("n") * (F.col(f"{a}0") + F.lit(float(n)) * turns(f"lo{a}", a))).alias(f"s{a}") for a in "xyz"))
    cut = durable(rows.filter(~one_image).select("cell", "root", *refs))
    odd = points.join(cut, "cell").select("root", *refs, F.lit(1).cast("long").alias("n"), *(
        (F.col(a) - F.col(f"{a}0") - F.lit(float(n)) * turns(a, a)).alias(f"s{a}") for a in "xyz"))
    sums = [F.sum(c).alias(c) for c in ("n", "sx", "sy", "sz")]
    # points are summed by themselves, so that a group's sums are one row per task before they meet
    out = even.groupBy("root", *refs).agg(*sums).unionByName(odd.groupBy("root", *refs).agg(*sums)).groupBy("root", *refs).agg(*sums)
    com = [F.expr(f"pmod(cast({a}0 as bigint) * {q!r}D + s{a} / n * {q!r}D, {box!r}D)").alias(f"c{a}") for a in "xyz"]
    return out.select(L.flat(*(F.col(r).cast("long") for r in refs), n).alias("halo_id"), "n", *com)


def raw_catalog(points: DataFrame, box: float, link: float, floor: int = 10) -> DataFrame:
    """(halo, n, x0, y0, z0, cx, cy, cz) of groups of raw positions, numbered by decreasing count, ties by least point.

    Numbers come from range partitions and their offsets; no task orders the whole catalogue.
    """
    found = durable(linking.groups(points, box, link, floor).drop("root").withColumn("_less", -F.col("n")))
    ordered = global_order(found, ["_less", "x0", "y0", "z0"])
    return ordered.select(F.col("ordinal").alias("halo"), *[c for c in found.columns if c != "_less"])


HEADER = ("box", "n_part", "link", "mesh")


def with_header(catalog: DataFrame, box: float, n_part: int, link: float, mesh: int, a: float) -> DataFrame:
    """The catalogue with what it was made from, as metadata of its count column: it stays through writes and reads."""
    made = {"box": float(box), "n_part": int(n_part), "link": float(link), "mesh": int(mesh), "a": float(a)}
    return catalog.withMetadata("n", {"catalogue": made})


def header(catalog: DataFrame) -> dict:
    found = catalog.schema["n"].metadata.get("catalogue")
    if found is None:
        raise ValueError("the catalogue has no header")
    return found


def refuse_unlike(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> None:
    """Raise unless both catalogues come from the same box, particles, linking length, mesh and epoch."""
    one, other = header(a), header(b)
    unlike = [f"{k} {one[k]} and {other[k]}" for k in HEADER if one[k] != other[k]]
    if abs(one["a"] - other["a"]) > tolerance * abs(other["a"]):
        unlike.append(f"epochs {one['a']} and {other['a']}")
    if unlike:
        raise ValueError("the catalogues cannot be compared: " + ", ".join(unlike))


def compare(a: DataFrame, b: DataFrame, lat: Lattice, r_fac: float = 2.0, edges=None) -> DataFrame:
    """``match_table`` of two catalogues with headers, refused where these differ from each other or from the lattice."""
    refuse_unlike(a, b)
    if header(a)["box"] != lat.box or header(a)["n_part"] != lat.n_part:
        raise ValueError("the catalogues come from another lattice")
    a, b = durable(a), durable(b)
    return match_table(match(a, b, lat, r_fac), a, b, lat, COUNT_EDGES if edges is None else edges)


def r200m(n, lat: Lattice):
    """Radius enclosing 200 times the mean density for a halo of n particles."""
    return F.lit(lat.spacing) * F.pow(F.lit(3.0 / (800.0 * math.pi)) * n, F.lit(1.0 / 3.0))


LEAF_POINTS = 256
LEAF_BITS = (12, 16, 20)  # three of the finest indices fit a long


def leaf_bits(b: DataFrame, box: float) -> int:
    """The coarsest leaf cells that hold at most LEAF_POINTS distinct points each, or the finest there are."""
    for bits in LEAF_BITS[:-1]:
        own = [F.floor(F.col(c) * (2**bits / box)).alias(f"k{c}") for c in "xyz"]
        most = b.select(*own).groupBy("kx", "ky", "kz").count().agg(F.max("count")).first()[0] or 0
        if most <= LEAF_POINTS:
            return bits
    return LEAF_BITS[-1]


def nearest(a: DataFrame, b: DataFrame, box: float) -> DataFrame:
    """(a_id, b_id, d): each point of a (id, x, y, z) with its periodic nearest point of b.

    A descent through nested cells: for every point keep only the cells that can still hold its
    nearest neighbour, i.e. whose smallest distance does not exceed the least largest distance.
    That leaves a bounded number of cells per point and level, however the points cluster.
    Equal distances resolve to the smaller id; coincident points of b keep the smallest id.
    """
    step = 2
    # points on one spot are interchangeable, so one of them stands for all
    b = durable(b.groupBy("x", "y", "z").agg(F.min("id").alias("b_id")))
    bits = leaf_bits(b, box)
    side = box / 2**bits
    leaf = [F.least(F.floor(F.col(c) / side).cast("long"), F.lit(2**bits - 1)).alias(f"k{c}") for c in "xyz"]
    tree = b.select("b_id", *leaf, *(F.col(c).alias(f"b{c}") for c in "xyz"))
    cand = a.select(F.col("id").alias("a_id"), *(F.col(c).alias(f"a{c}") for c in "xyz"))

    def code(shift: int, prefix: str = "k") -> str:
        return (f"((shiftright({prefix}x, {shift}) * {2**bits}L + shiftright({prefix}y, {shift})) * {2**bits}L"
                f" + shiftright({prefix}z, {shift}))")

    for shift in range(bits - step, -1, -step):
        kids = tree.select(F.expr(code(shift + step)).alias("parent"),
                           *(F.expr(f"shiftright(k{c}, {shift})").alias(f"n{c}") for c in "xyz")).distinct()
        if shift == bits - step:
            cand = cand.withColumn("parent", F.lit(0).cast("long"))
            kids = F.broadcast(kids)  # at most 4^3 cells
        cand = cand.join(kids, "parent")
        w, half = side * 2**shift, 0.5 * box
        near, far = [], []
        for c in "xyz":
            # distance from the cell's centre, on the circle, in [0, box / 2]
            mid = f"abs(a{c} - (n{c} + 0.5D) * {w!r}D)"
            d = f"least({mid}, {box!r}D - {mid})"
            near.append(f"pow(greatest({d} - {0.5 * w!r}D, 0.0D), 2)")
            far.append(f"pow(least({d} + {0.5 * w!r}D, {half!r}D), 2)")
        cand = cand.withColumns({"lo": F.expr(" + ".join(near)), "hi": F.expr(" + ".join(far))})
        # a point keeps a bounded number of cells, so its window is small
        cand = cand.withColumn("ub", F.min("hi").over(Window.partitionBy("a_id")))
        cand = cand.filter(F.col("lo") <= F.col("ub") * (1.0 + 1e-12))
        here = f"((nx * {2**bits}L + ny) * {2**bits}L + nz)"
        cand = cand.select("a_id", "ax", "ay", "az", F.expr(here).alias("parent"))
    points = tree.select(F.expr(code(0)).alias("parent"), "b_id", "bx", "by", "bz")
    hits = cand.join(points, "parent")
    d2 = sum((L.minimum_image(F.col(f"a{c}") - F.col(f"b{c}"), box) ** 2 for c in "xyz"), F.lit(0.0))
    best = hits.withColumn("d2", d2).groupBy("a_id").agg(F.min(F.struct("d2", "b_id")).alias("m"))
    return best.select("a_id", F.col("m.b_id").alias("b_id"), F.sqrt("m.d2").alias("d"))


def match(a: DataFrame, b: DataFrame, lat: Lattice, r_fac: float = 2.0) -> DataFrame:
    """(a_id, b_id, n_a, n_b, d): mutually nearest halos within r_fac R200m of the larger one."""
    a, b = durable(a), durable(b)
    pts = lambda h: h.select(F.col("halo_id").alias("id"), F.col("cx").alias("x"),
                             F.col("cy").alias("y"), F.col("cz").alias("z"))
    ab = nearest(pts(a), pts(b), lat.box)
    ba = nearest(pts(b), pts(a), lat.box).select(F.col("a_id").alias("b_id"), F.col("b_id").alias("a_id"))
    pairs = ab.join(ba, ["a_id", "b_id"])
    pairs = pairs.join(a.select(F.col("halo_id").alias("a_id"), F.col("n").alias("n_a")), "a_id")
    pairs = pairs.join(b.select(F.col("halo_id").alias("b_id"), F.col("n").alias("n_b")), "b_id")
    reach = F.lit(r_fac) * r200m(F.greatest("n_a", "n_b"), lat)
    return pairs.filter(F.col("d") < reach).select("a_id", "b_id", "n_a", "n_b", "d")


def count_bin(n, edges=COUNT_EDGES):
    """Number of the bin whose lower edge is the last at or below n; null below the first edge."""
    out = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        out = F.when(n >= e, i).otherwise(out)
    return out


def abundance(a: DataFrame, b: DataFrame, edges=COUNT_EDGES) -> DataFrame:
    """(bin, lo, n_a, n_b, ratio, sigma) per member-count bin; bins empty on both sides are kept."""
    spark = a.sparkSession
    side = lambda h, c: (h.select(count_bin(F.col("n"), edges).alias("bin")).filter("bin is not null")
                         .groupBy("bin").agg(F.count(F.lit(1)).alias(c)))
    bins = spark.range(len(edges)).select(F.col("id").cast("int").alias("bin"))
    lows = F.element_at(F.array(*(F.lit(e).cast("long") for e in edges)), F.col("bin") + 1)
    out = bins.join(side(a, "n_a"), "bin", "left").join(side(b, "n_b"), "bin", "left").fillna(0)
    ratio = F.when(F.col("n_b") > 0, F.col("n_a") / F.col("n_b")).otherwise(F.lit(float("nan")))
    inv = lambda c: 1.0 / F.greatest(F.col(c), F.lit(1))
    return out.select("bin", lows.alias("lo"), "n_a", "n_b", ratio.alias("ratio"),
                      (ratio * F.sqrt(inv("n_a") + inv("n_b"))).alias("sigma"))


def match_table(pairs: DataFrame, a: DataFrame, b: DataFrame, lat: Lattice, edges=COUNT_EDGES) -> DataFrame:
    """(bin, matched, f_match_a, f_match_b, p16, p50, p84 of ln(n_b/n_a), median offset / R200m)."""
    p = pairs.withColumn("bin", count_bin(F.col("n_a"), edges)).filter("bin is not null")
    p = p.withColumn("lr", F.log(F.col("n_b") / F.col("n_a"))).withColumn("off", F.col("d") / r200m(F.col("n_a"), lat))
    p = durable(p.select("bin", "lr", "off"))
    t = p.groupBy("bin").agg(F.count(F.lit(1)).alias("matched"))
    t = t.join(percentiles(p, "lr", {"p16": 0.16, "p50": 0.5, "p84": 0.84}, ["bin"]), "bin")
    t = t.join(percentiles(p, "off", {"med_offset": 0.5}, ["bin"]), "bin")
    hb = pairs.withColumn("bin", count_bin(F.col("n_b"), edges)).groupBy("bin").agg(F.count(F.lit(1)).alias("mb"))
    ab = abundance(a, b, edges)
    out = ab.select("bin", "n_a", "n_b").join(t, "bin", "left").join(hb, "bin", "left")
    frac = lambda num, den: F.coalesce(F.col(num), F.lit(0)) / F.greatest(F.col(den), F.lit(1))
    out = out.withColumn("matched", F.coalesce("matched", F.lit(0)))
    # a bin without a pair keeps its fractions of 0 and has no percentiles
    out = out.fillna(float("nan"), ["p16", "p50", "p84", "med_offset"])
    return out.select("bin", "matched", frac("matched", "n_a").alias("f_match_a"),
                      frac("mb", "n_b").alias("f_match_b"), "p16", "p50", "p84", "med_offset")


def bias_table(matter: tuple[DataFrame, DataFrame], halos: tuple[DataFrame, DataFrame], n: int, box: float,
               shells: list[float], edges=COUNT_EDGES, min_halos: int = 50) -> DataFrame:
    """Spectra of two runs' halos against their matter, per count bin and shell [k_i, k_i+1).

    (bin, n_a, n_b, shell, k_mean, n_modes, b_a, b_b, b_ratio, r_hh, pmm_ratio, r_mm); a bin with fewer than
    ``min_halos`` halos in either run is left out.  All are ratios of spectra of contrasts rho / mean - 1: off the
    mean mode a contrast is its field over the field's mean, so raw sums are transformed and means divide at the end.
    """
    upper = [*edges[1:], None]
    weight = [f"case when n >= {lo} {f'and n < {hi}' if hi else ''} then 1.0D else 0.0D end" for lo, hi in zip(edges, upper)]
    mesh, names = None, []
    for side, particles, cat in zip("ab", matter, halos):
        at = cat.select(F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"), "n")
        parts = {f"m_{side}": D.deposit_float(particles, "cic", n, box, {f"m_{side}": "1.0D"}),
                 f"h_{side}": D.deposit_float(at, "cic", n, box, {f"h{i}_{side}": w for i, w in enumerate(weight)})}
        for part in parts.values():
            names += [c for c in part.columns if c not in ("ix", "iy", "iz")]
            mesh = part if mesh is None else mesh.join(part, ["ix", "iy", "iz"], "full")
    modes = S.modes(S.spectrum(mesh.fillna(0.0, names), names, n), names)
    k = F.sqrt(K.n2_column(n).cast("double")) * F.lit(2.0 * math.pi / box)
    shell = F.lit(None).cast("int")
    for i, (lo, hi) in enumerate(zip(shells, shells[1:])):
        shell = F.when((k >= lo) & (k < hi), i).otherwise(shell)
    w = K.hermitian_weight(n)
    pairs = {"mm_a": ("m_a", "m_a"), "mm_b": ("m_b", "m_b"), "mm_ab": ("m_a", "m_b")}
    for i in range(len(edges)):
        h = [f"h{i}_a", f"h{i}_b"]
        pairs |= {f"hm_a{i}": (h[0], "m_a"), f"hm_b{i}": (h[1], "m_b"), f"hh_a{i}": (h[0], h[0]), f"hh_b{i}": (h[1], h[1]), f"hh_ab{i}": tuple(h)}
    product = lambda x, y: F.expr(f"{x}_re * {y}_re + {x}_im * {y}_im")
    rows = modes.withColumn("shell", shell).filter("shell is not null")
    sums = rows.groupBy("shell").agg(F.sum(w).alias("n_modes"), F.sum(k * w).alias("kw"), *(F.sum(w * product(*xy)).alias(c) for c, xy in pairs.items()))
    spread = F.explode(F.array(*(F.struct(F.lit(i).alias("bin"), *(F.col(f"{c}{i}").alias(c) for c in ("hm_a", "hm_b", "hh_a", "hh_b", "hh_ab")))
                                 for i in range(len(edges))))).alias("s")
    per = sums.select("shell", "n_modes", "kw", "mm_a", "mm_b", "mm_ab", spread).select("*", "s.*").drop("s")
    counts = abundance(*halos, edges).filter(F.least("n_a", "n_b") >= min_halos).select("bin", "n_a", "n_b")
    total = [m.agg(F.count(F.lit(1)).cast("double").alias(f"t_{side}")) for side, m in zip("ab", matter)]
    per = per.join(counts, "bin").join(F.broadcast(total[0])).join(F.broadcast(total[1]))  # totals are one row each
    b_a, b_b = (F.col(f"hm_{x}") / F.col(f"mm_{x}") * F.col(f"t_{x}") / F.col(f"n_{x}") for x in "ab")
    return per.select(
        "bin", "n_a", "n_b", "shell", (F.col("kw") / F.col("n_modes")).alias("k_mean"), "n_modes", b_a.alias("b_a"), b_b.alias("b_b"),
        (b_a / b_b).alias("b_ratio"), (F.col("hh_ab") / F.sqrt(F.col("hh_a") * F.col("hh_b"))).alias("r_hh"),
        (F.col("mm_a") / F.col("mm_b") * F.pow(F.col("t_b") / F.col("t_a"), F.lit(2.0))).alias("pmm_ratio"),
        (F.col("mm_ab") / F.sqrt(F.col("mm_a") * F.col("mm_b"))).alias("r_mm"))
