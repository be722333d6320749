"""Coded particle state: per-brick velocity scales, drift, migration, and layout queries.

A state is two frames: ``coded`` rows (brick, bucket, off_*, w_*) and a ``scales`` dimension
(brick, vel_scale, n).  Slots, spare rows and arenas are storage detail of other engines; here a
brick is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.config import CODE_MAX, Geometry
from meshtide.functions import dither as D
from meshtide.functions import lattice as L
from meshtide.operators.rank import ranked
from meshtide.session import durable

CODED = ["brick", "bucket", "off_x", "off_y", "off_z", "w_x", "w_y", "w_z"]


def brick_scales(df: DataFrame) -> DataFrame:
    """(brick, vel_scale, n) from float velocities."""
    agg = df.groupBy("brick").agg(F.max(L.speed_max()).alias("vmax"), F.count(F.lit(1)).alias("n"))
    return agg.select("brick", L.scale_from_max(F.col("vmax")).alias("vel_scale"), "n")


def global_scale(df: DataFrame) -> DataFrame:
    """One row: the shared velocity scale of all particles."""
    return df.agg(L.scale_from_max(F.max(L.speed_max())).alias("vel_scale"))


def reconcile_scale(scales: DataFrame) -> DataFrame:
    """One row: the largest positive brick scale, 1 if none."""
    top = F.max(F.when(F.col("vel_scale") > 0.0, F.col("vel_scale")))
    return scales.agg(F.coalesce(top, F.lit(1.0)).alias("vel_scale"))


def encode(df: DataFrame, g: Geometry, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """x, y, z, v* -> (coded rows, scales)."""
    keep = list(keep or [])
    placed = L.encode_positions(df, g)
    scales = brick_scales(placed)
    rows = placed.join(scales.select("brick", "vel_scale"), "brick")
    rows = rows.withColumns(
        {f"w_{a}": L.encode_velocity(F.col(f"v{a}"), F.col("vel_scale")) for a in L.AXES})
    return rows.select(*keep, *CODED), scales


def decode(coded: DataFrame, scales: DataFrame, g: Geometry) -> DataFrame:
    """Coded rows -> the same rows with x, y, z, vx, vy, vz, vel_scale."""
    rows = coded.join(scales.select("brick", "vel_scale"), "brick")
    rows = L.decode_positions(rows, g)
    return rows.withColumns(
        {f"v{a}": F.col(f"w_{a}").cast("double") * F.col("vel_scale") for a in L.AXES})


def decode_bricks(coded: DataFrame, scales: DataFrame, g: Geometry, bricks: list[int]) -> DataFrame:
    return decode(coded.filter(F.col("brick").isin(bricks)), scales, g)


def drift(decoded: DataFrame, g: Geometry, c: float, key: int | None = None) -> DataFrame:
    """Advance positions by c * v on the integer lattice; add the new jx, jy, jz, brick, bucket.

    Without a key the drift rounds to the nearest level; with one it rounds stochastically by
    the dither of the pre-drift index.  The old brick stays as ``src``.
    """
    q, lat = g.lattice.quantum, g.lattice
    rows = L.with_lattice(decoded, lat)
    moved = {a: f"{a} / {q!r}D + ({float(c)!r}D * v{a}) / {q!r}D" for a in L.AXES}
    if key is None:
        new = {f"j{a}": F.expr(f"pmod(cast(rint({moved[a]}) as bigint), {lat.levels}L)") for a in L.AXES}
    else:
        rows = D.with_dither(rows, key)
        new = {f"j{a}": F.expr(f"pmod(cast(floor({moved[a]} + u_{a}) as bigint), {lat.levels}L)")
               for a in L.AXES}
    rows = rows.withColumns(new).withColumn("src", F.col("brick")).drop("brick", "bucket")
    rows = L.with_keys(rows, g)
    return rows.withColumns({f"off_{a}": L.offset_of(F.col(f"j{a}")) for a in L.AXES})


def migrate(drifted: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Re-home drifted rows: fix every brick's scale over its new members, re-round codes once."""
    keep = list(keep or [])
    speed = F.greatest(*(F.abs(F.col(f"w_{a}")) for a in L.AXES)).cast("double") * F.col("vel_scale")
    scales = drifted.groupBy("brick").agg(F.max(speed).alias("vmax"), F.count(F.lit(1)).alias("n"))
    scales = scales.select("brick", L.scale_from_max(F.col("vmax")).alias("vel_scale"), "n")
    new = scales.select("brick", F.col("vel_scale").alias("new_scale"))
    rows = drifted.join(new, "brick")
    rows = rows.withColumns(
        {f"w_{a}": L.rescale_code(F.col(f"w_{a}"), F.col("vel_scale"), F.col("new_scale"))
         for a in L.AXES})
    return rows.select(*keep, *CODED), scales


def drift_and_migrate(coded: DataFrame, scales: DataFrame, g: Geometry, c: float,
                      key: int | None = None, keep: list[str] | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    # the drifted rows feed both the new scales and the new codes: store them once
    return migrate(durable(drift(decode(coded, scales, g), g, c, key)), keep)


def census(drifted: DataFrame) -> DataFrame:
    """Members every brick will have after the move, with how many arrive from elsewhere."""
    arrived = F.sum(F.when(F.col("src") != F.col("brick"), 1).otherwise(0))
    return drifted.groupBy("brick").agg(F.count(F.lit(1)).alias("n"), arrived.alias("immigrants"))


def brick_reach(scales: DataFrame, g: Geometry, c: float) -> DataFrame:
    """One row: an upper bound on the bricks a particle crosses per axis in this drift."""
    extent = g.box / g.bricks
    bound = F.ceil(F.lit(abs(float(c))) * F.max("vel_scale") * CODE_MAX / extent)
    return scales.agg(bound.cast("long").alias("reach"))


def migration_stats(drifted: DataFrame, g: Geometry) -> DataFrame:
    """One row: migrants, migrant fraction, and the largest realized x-reach in bricks."""
    nb = g.bricks
    gap = L.div(F.col("brick"), nb * nb) - L.div(F.col("src"), nb * nb)
    disp = F.pmod(gap + nb // 2, F.lit(nb)) - nb // 2
    moved = F.col("src") != F.col("brick")
    return drifted.agg(
        F.count(F.lit(1)).alias("n"), F.sum(moved.cast("long")).alias("migrants"),
        F.max(F.abs(disp)).alias("realized_reach"),
    ).withColumn("migrant_frac", F.col("migrants") / F.col("n"))


def emulate_codes(rows: DataFrame, g: Geometry, what: str) -> DataFrame:
    """Round float state through the codecs named in ``what``: x (positions), v (velocities)."""
    names = rows.columns
    if "x" in what:
        rows = rows.withColumns({a: L.position_of(L.lattice_index(F.col(a), g.lattice), g.lattice) for a in L.AXES})
    if "v" in what:
        width = g.box / g.bricks
        b = [F.expr(f"pmod(cast(floor({a} / {width!r}D) as bigint), {g.bricks}L)") for a in L.AXES]
        rows = rows.withColumn("brick", L.flat(*b, g.bricks))
        s = brick_scales(rows).select("brick", "vel_scale")
        rows = rows.join(s, "brick").withColumns(
            {f"v{a}": F.rint(F.col(f"v{a}") / F.col("vel_scale")) * F.col("vel_scale") for a in L.AXES})
    return rows.select(*names)


# ---- layout queries ----

def occupancy(coded: DataFrame, by: str = "bucket") -> DataFrame:
    return coded.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


def bucket_starts(coded: DataFrame, g: Geometry) -> DataFrame:
    """(brick, bucket, n, start): where each bucket's run begins in its brick."""
    n = coded.groupBy("brick", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a brick has a fixed number of buckets, so this window is bounded
    from pyspark.sql import Window
    w = Window.partitionBy("brick").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return n.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0)))


def run_rank(coded: DataFrame) -> DataFrame:
    """Each row's position inside its brick's run, in bucket order."""
    return ranked(coded, "brick", ["bucket", "off_x", "off_y", "off_z", "w_x", "w_y", "w_z"])


def check_state(coded: DataFrame, scales: DataFrame, g: Geometry, n_particles: int) -> None:
    """Structural checks; raise on the first violation."""
    got = coded.count()
    if got != n_particles:
        raise ValueError(f"the state holds {got} rows, expected {n_particles}")
    per3 = g.buckets_per_brick_side**3
    bad = coded.filter(
        (L.div(F.col("bucket"), per3) != F.col("brick")) | (F.col("bucket") < 0)
        | (F.col("bucket") >= g.lattice.buckets**3)
        | F.greatest("off_x", "off_y", "off_z").__gt__(255) | F.least("off_x", "off_y", "off_z").__lt__(0)
        | F.greatest(*(F.abs(F.col(f"w_{a}")) for a in L.AXES)).__gt__(CODE_MAX))
    if not bad.isEmpty():
        raise ValueError("a row lies outside its brick, its bucket's offsets or the code range")
    if not coded.join(scales, "brick", "left_anti").isEmpty():
        raise ValueError("a row's brick has no velocity scale")
    if not scales.filter("not vel_scale > 0").isEmpty():
        raise ValueError("a velocity scale is not positive")
    if not scales.groupBy("brick").count().filter("count > 1").isEmpty():
        raise ValueError("a brick has two velocity scales")


# ---- tiles ----

def owning_tile(g: Geometry) -> dict:
    """Per-axis tile of a position: floor(x / cell) mod n_fine, div n_tile."""
    return {f"t{a}": F.expr(f"pmod(cast(floor({a} / {g.fine_cell!r}D) as bigint), {g.n_fine}L)"
                            f" div {g.n_tile}") for a in L.AXES}


def tile_of_brick(brick, g: Geometry) -> dict:
    per = g.n_tile // g.brick
    return {f"t{a}": L.div(c, per) for a, c in L.brick_axes(brick, g.bricks).items()}


def tile_bricks(counts: DataFrame, g: Geometry) -> DataFrame:
    """Range membership as an equi-join: (tile, brick, owned) for every brick a tile needs.

    Each brick lists the tiles whose core-plus-buffer span covers it, per axis.
    """
    per, pad, nt = g.n_tile // g.brick, g.pad_bricks, g.tiles
    reach = -(-pad // per)
    axes = L.brick_axes(F.col("brick"), g.bricks)
    rows = counts.withColumns({f"_b{a}": c for a, c in axes.items()})
    for a in L.AXES:
        # candidate tiles around the owner, kept where the brick lies inside the span
        cand = f"array_distinct(transform(sequence(-{reach}, {reach}), o -> pmod(_b{a} div {per} + o, {nt}L)))"
        span = g.span_bricks
        keep = f"filter({cand}, t -> pmod(_b{a} - (t * {per} - {pad}), {g.bricks}L) < {span})"
        rows = rows.withColumn(f"_t{a}", F.explode(F.expr(keep)))
    tile = L.flat(F.col("_tx"), F.col("_ty"), F.col("_tz"), nt)
    owned = F.lit(True)
    for a in L.AXES:
        owned = owned & (L.div(F.col(f"_b{a}"), per) == F.col(f"_t{a}"))
    return rows.select(tile.alias("tile"), "brick", "n", owned.alias("owned"))


def tile_members(counts: DataFrame, g: Geometry) -> DataFrame:
    """Members of every tile plus buffer, and how many it owns."""
    m = tile_bricks(counts, g)
    return m.groupBy("tile").agg(
        F.sum("n").alias("members"), F.sum(F.when(F.col("owned"), F.col("n")).otherwise(0)).alias("owned"),
        F.count(F.lit(1)).alias("bricks"))


def diagnose_partition(claims: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, claims): rows claimed by no tile (0) or by more than one."""
    n = claims.groupBy(key).agg(F.count(F.lit(1)).alias("claims"))
    missing = rows.select(key).join(n, key, "left_anti").select(key, F.lit(0).cast("long").alias("claims"))
    return n.filter("claims > 1").unionByName(missing)


def check_placement(coded: DataFrame, reference: DataFrame, g: Geometry) -> DataFrame:
    """Rows (by id) whose coded bucket or offsets differ from their reference position's."""
    want = L.encode_positions(reference, g).select(
        "id", F.col("bucket").alias("want"), *(F.col(f"off_{a}").alias(f"o_{a}") for a in L.AXES))
    joined = coded.join(want, "id", "full_outer")
    same = F.col("bucket").eqNullSafe(F.col("want"))
    for a in L.AXES:
        same = same & F.col(f"off_{a}").eqNullSafe(F.col(f"o_{a}"))
    return joined.filter(~same)


