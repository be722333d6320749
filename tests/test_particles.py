import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtide.config import geometry
from meshtide.functions import lattice as L
from meshtide.functions.dither import drift_key, with_dither
from meshtide.operators import deposit as D
from meshtide.operators import gather as GA
from meshtide.operators import rank as R
from meshtide.operators import state as ST

GEO = geometry("smoke")
BOX = GEO.box


def frame(spark, pos, vel=None, ids=False):
    pos = np.asarray(pos, float)
    vel = np.zeros_like(pos) if vel is None else vel
    pdf = pd.DataFrame({**{c: pos[:, i] for i, c in enumerate("xyz")}, **{f"v{c}": vel[:, i] for i, c in enumerate("xyz")}})
    if ids:
        pdf["id"] = np.arange(len(pdf))
    return spark.createDataFrame(pdf)


def tie_positions(n):
    """Around every place, within a cell, where a stencil's rounding or a weight's leading corner changes.

    Floor changes at cell edges, rint and the nearest corner at cell middles; just below and above each as well.
    """
    turns = np.array([0.0, 0.5])
    near = np.concatenate([turns + e for e in (-(2.0**-16), 0.0, 2.0**-16)])
    rng = np.random.default_rng(11)
    inside = np.stack(np.meshgrid(near, near, near), axis=-1).reshape(-1, 3)
    ties = (rng.integers(n, size=inside.shape) + inside) * (BOX / n)
    return np.concatenate([np.mod(ties, BOX), BOX * rng.random((500, 3))])


def reference_mesh(pos, n, scheme, unit=4096):
    """Brute-force fixed-point deposit, one particle at a time."""
    mesh = np.zeros((n, n, n), np.int64)
    reach = (0, 1) if scheme == "cic" else (-1, 0, 1)
    for p in pos:
        s = p / (BOX / n)
        base = np.floor(s) if scheme == "cic" else np.rint(s)
        d = s - base
        w = (1 - d, d) if scheme == "cic" else (0.5 * (0.5 - d) ** 2, 0.75 - d**2, 0.5 * (0.5 + d) ** 2)
        near = tuple(int(v >= 0.5) for v in d) if scheme == "cic" else (1, 1, 1)
        rest = 0
        for c in itertools.product(range(len(reach)), repeat=3):
            if c != near:
                q = int(np.rint(np.float32(w[c[0]][0] * w[c[1]][1] * w[c[2]][2]) * np.float32(unit)))
                rest += q
                mesh[tuple((int(base[a]) + reach[c[a]]) % n for a in range(3))] += q
        mesh[tuple((int(base[a]) + reach[near[a]]) % n for a in range(3))] += unit - rest
    return mesh


def dense(rows, n, value="q"):
    out = np.zeros((n, n, n))
    pdf = rows.toPandas()
    out[pdf.ix, pdf.iy, pdf.iz] = pdf[value]
    return out


@pytest.mark.parametrize("scheme", ["cic", "tsc"])
def test_exact_mass_deposit(spark, scheme):
    pos = tie_positions(16)
    df = frame(spark, pos)
    got = dense(D.deposit_int(df, scheme, 16, BOX), 16)
    assert np.array_equal(got, reference_mesh(pos, 16, scheme))
    assert got.sum() == 4096 * len(pos)
    again = dense(D.deposit_int(df.repartition(7), scheme, 16, BOX), 16)
    assert np.array_equal(got, again)
    soft = dense(D.deposit_float(df, scheme, 16, BOX), 16, "w")
    assert np.abs(soft - got / 4096).max() < len(pos) * 14 / 4096


def test_float_deposit_shift(spark):
    pos = np.random.default_rng(1).uniform(0, BOX, (50, 3))
    moved = (pos + 0.5 * BOX / 16) % BOX
    a = dense(D.deposit_float(frame(spark, pos), "tsc", 16, BOX, shift=0.5), 16, "w")
    b = dense(D.deposit_float(frame(spark, moved), "tsc", 16, BOX), 16, "w")
    assert np.allclose(a, b, atol=1e-12)


def test_cells_beyond_32_bits(spark):
    """A crowded cell: its code units pass 2^31 and stay exact."""
    one = frame(spark, [[0.25, 0.25, 0.25]] * 8)
    single = dense(D.deposit_int(one, "cic", 16, BOX), 16)
    crowd = one.crossJoin(spark.range(80_000)).drop("id")
    many = dense(D.deposit_int(crowd, "cic", 16, BOX), 16)
    assert many.sum() == 8 * 80_000 * 4096 > 2**31 and np.array_equal(many, single * 80_000)


@pytest.mark.parametrize("read", [lambda df: ST.encode(df, GEO)[0], lambda df: L.with_keys(L.with_lattice(df, GEO.lattice), GEO)])
def test_null_positions_raise(spark, read):
    df = frame(spark, [[1.0, 2.0, 3.0]]).withColumn("y", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="null position"):
        read(df).collect()


def test_codec_round_trip(spark):
    rng = np.random.default_rng(3)
    pos = rng.uniform(-1.0, BOX + 1.0, (500, 3))
    df = frame(spark, pos, rng.normal(size=(500, 3)), ids=True)
    rows, scales = ST.encode(df, GEO, ["id"])
    back = ST.decode(rows, scales, GEO).toPandas().sort_values("id")
    err = back[list("xyz")].to_numpy() - pos
    assert np.abs(err - BOX * np.rint(err / BOX)).max() <= GEO.lattice.quantum / 2
    ST.check_state(rows, scales, GEO, 500)
    b = L.bucket_axes(F.col("bucket"), GEO)
    at = rows.select("id", *(b[a].alias(a) for a in "xyz")).toPandas().sort_values("id")
    want = np.mod(np.rint(pos / GEO.lattice.quantum).astype(int), 4096) // 256
    assert np.array_equal(at[list("xyz")].to_numpy(), want)


def test_state_check_can_fail(spark):
    rows, scales = ST.encode(frame(spark, np.random.default_rng(0).uniform(0, BOX, (40, 3))), GEO)
    for bad in (rows.withColumn("off_x", F.lit(256)), rows.withColumn("bucket", F.col("bucket") + 8),
                rows.withColumn("w_x", F.lit(40000))):
        with pytest.raises(ValueError):
            ST.check_state(bad, scales, GEO, 40)
    with pytest.raises(ValueError):
        ST.check_state(rows, scales.limit(1), GEO, 40)
    with pytest.raises(ValueError):
        ST.check_state(rows, scales, GEO, 41)


def test_code_escape_raises(spark):
    df = spark.createDataFrame([(30000,)], "w long")
    with pytest.raises(Exception, match="int16"):
        df.select(L.rescale_code(F.col("w"), F.lit(2.0), F.lit(1.0))).collect()


def numpy_dither(j, key):
    u64, mask = np.uint64, 2**64 - 1
    mul = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]
    out = []
    for row in j:
        h = 0
        for v, m in zip(row, mul):
            h ^= int(v) * m & mask
        bits = []
        for axis in (1, 2, 3):
            z = h ^ ((key * 3 + axis) * 0xD6E8FEB86659FD93 & mask)
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 & mask
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB & mask
            bits.append((z ^ (z >> 31)) >> 11)
        out.append(bits)
    return np.array(out, dtype=u64)


@pytest.mark.parametrize("key", [0, 1, 2**32 + 7])
def test_dither_matches_integer_arithmetic(spark, key):
    j = np.random.default_rng(5).integers(0, 2**21, (300, 3))
    df = spark.createDataFrame(pd.DataFrame(j, columns=["jx", "jy", "jz"]))
    got = with_dither(df, key).toPandas()
    want = pd.DataFrame(j, columns=["jx", "jy", "jz"])
    bits = numpy_dither(j, key)
    for i, a in enumerate("xyz"):
        want[f"u_{a}"] = bits[:, i].astype(float) * 2.0**-53
    cols = list(want.columns)
    assert got[cols].sort_values(cols).reset_index(drop=True).equals(want.sort_values(cols).reset_index(drop=True))


def test_drift_keys_are_unique():
    keys = [drift_key(None)] + [drift_key(k) for k in range(5)] + [drift_key(k, True) for k in range(5)]
    assert len(set(keys)) == len(keys)


def test_drift_is_unbiased_and_conserves(spark):
    rng = np.random.default_rng(11)
    df = frame(spark, rng.uniform(0, BOX, (4000, 3)), np.full((4000, 3), 0.3 * GEO.lattice.quantum))
    rows, scales = ST.encode(df, GEO)
    dec = ST.decode(rows, scales, GEO)
    move = ST.drift(dec, GEO, 1.0, 5)
    d = move.select(F.avg(L.minimum_image(L.position_of(F.col("jx"), GEO.lattice) - F.col("x"), BOX))).first()[0]
    assert abs(d / GEO.lattice.quantum - 0.3) < 0.04
    new, new_scales = ST.drift_and_migrate(rows, scales, GEO, 1.0, 5)
    ST.check_state(new, new_scales, GEO, 4000)
    nearest = ST.drift(dec, GEO, 1.0)
    assert nearest.filter("brick <> src").count() == 0


def test_ranking_of_equal_rows(spark):
    """A third of the rows are copies of one row in one group."""
    pdf = pd.DataFrame({"g": [1] * 300 + list(range(600)), "v": [5] * 300 + list(range(600))})
    got = R.ranked(spark.createDataFrame(pdf).repartition(5), "g", ["v"]).toPandas()
    for _, rows in got.groupby("g"):
        assert sorted(rows["rank"]) == list(range(len(rows)))
        ordered = rows.sort_values("rank")["v"].tolist()
        assert ordered == sorted(ordered)


def test_prefix_sums_across_blocks(spark):
    pdf = pd.DataFrame({"k": range(1000), "n": np.random.default_rng(2).integers(0, 9, 1000)})
    got = R.prefix_sums(spark.createDataFrame(pdf), "k", "n", "s", block=64).toPandas().sort_values("k")
    assert np.array_equal(got["s"], pdf["n"].cumsum() - pdf["n"])


@pytest.mark.parametrize("scheme,n", [("cic", 64), ("tsc", 16)])
def test_gather_against_numpy(spark, scheme, n):
    rng = np.random.default_rng(4)
    # a third of the particles crowd one cell, so that its block splits into chunks
    pos = np.concatenate([rng.uniform(0, BOX, (200, 3)), np.full((100, 3), 3.3)])
    field = rng.normal(size=(n, n, n))
    i = np.indices(field.shape).reshape(3, -1)
    mesh = spark.createDataFrame(pd.DataFrame({"ix": i[0], "iy": i[1], "iz": i[2], "f": field.ravel()}))
    df = GA.with_salt(frame(spark, pos, ids=True))
    got = GA.gather(df, mesh, ["f"], scheme, n, BOX, max_rows=16).toPandas().sort_values("id")
    base, w = GA.stencil_weights(pos, scheme, BOX / n)
    first = 0 if scheme == "cic" else -1
    want = np.zeros(len(pos))
    for c in itertools.product(range(len(w)), repeat=3):
        at = tuple((base[:, a] + c[a] + first) % n for a in range(3))
        want += w[c[0]][:, 0] * w[c[1]][:, 1] * w[c[2]][:, 2] * field[at]
    assert len(got) == 300 and np.allclose(got["f_at"], want, atol=1e-12)


def test_gather_joins_no_particles_by_block(spark):
    """One block holds all particles: a join on it would bring them into one task. Blocks without particles give no rows."""
    i = np.indices((16, 16, 16)).reshape(3, -1)
    mesh = spark.createDataFrame(pd.DataFrame({"ix": i[0], "iy": i[1], "iz": i[2], "f": np.ones(16**3)}))
    got = GA.gather(GA.with_salt(frame(spark, np.full((50, 3), 3.3))), mesh, ["f"], "cic", 16, BOX, max_rows=8)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = got.select("f_at")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    fine = GA.gather(GA.with_salt(frame(spark, np.full((50, 3), 3.3))), mesh.filter("ix < 0"), ["f"], "cic", 64, BOX, max_rows=8)
    assert got.count() == fine.count() == 50


def test_tile_ownership_is_a_partition(spark):
    rows, scales = ST.encode(frame(spark, np.random.default_rng(9).uniform(0, BOX, (9000, 3))), GEO)
    m = ST.tile_members(scales, GEO).toPandas()
    assert m["owned"].sum() == 9000 and (m["bricks"] == GEO.span_bricks**3).all()
    claims = ST.tile_bricks(scales, GEO).filter("owned")
    assert ST.diagnose_partition(claims, scales, "brick").isEmpty()
    assert not ST.diagnose_partition(claims.unionByName(claims), scales, "brick").isEmpty()


def test_percentiles_through_the_order(spark):
    r = np.random.default_rng(4)
    rows = [(int(g), None if v < -1.5 else float(v)) for g, v in zip(r.integers(0, 3, 500), np.round(r.normal(size=500), 1))] + [(9, 5.0), (8, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    probs = {"low": 0.16, "mid": 0.5, "top": 1.0}
    got = {x.g: x for x in R.percentiles(df, "v", probs, ["g"]).collect()}
    assert sorted(got) == [0, 1, 2, 9]
    for g, x in got.items():
        own = [v for h, v in rows if h == g and v is not None]
        assert [x.low, x.mid, x.top] == pytest.approx(np.quantile(own, [0.16, 0.5, 1.0]))
    every = R.percentiles(df, "v", probs).first()
    assert every.mid == pytest.approx(np.median([v for _, v in rows if v is not None]))


def test_percentiles_where_brackets_miss(spark):
    """A sketch too coarse for its brackets, ties over half of a group, infinities, a null group: exact all the same."""
    r = np.random.default_rng(6)
    rows = [(1, float(v)) for v in np.exp(r.normal(size=3000) * 8)] + [(2, 7.0)] * 900 + [(2, float(v)) for v in r.normal(size=700)]
    rows += [(None, v) for v in (float("-inf"), -1.0, 3.0, float("inf"))] + [(None, None)]
    df = spark.createDataFrame(rows, "g long, v double").repartition(7)
    probs = {"a": 0.0, "b": 0.07, "c": 0.5, "d": 0.93, "e": 1.0}
    for accuracy in (3, 200, 10000):
        got = {x.g: x for x in R.percentiles(df, "v", probs, ["g"], accuracy).collect()}
        assert len(got) == 3
        for g in (1, 2):
            own = [v for h, v in rows if h == g]
            assert [got[g][k] for k in probs] == pytest.approx(np.quantile(own, list(probs.values())), rel=1e-12)
        assert (got[None].a, got[None].c, got[None].e) == (float("-inf"), 1.0, float("inf"))


def test_percentiles_of_nothing(spark):
    none = spark.createDataFrame([(1, None)], "g long, v double")
    assert R.percentiles(none, "v", {"m": 0.5}).collect() == [(None,)]
    assert R.percentiles(none, "v", {"m": 0.5}, ["g"]).collect() == []


def test_percentiles_store_a_narrow_part(spark):
    df = spark.range(400000).selectExpr("cast(id as double) as v")
    kept = R._narrowed(df.withColumnRenamed("v", "_v"), [], {"m": 0.5}, 10000, 4.0)
    assert kept.count() < 2000 and R.percentiles(df, "v", {"m": 0.5}).first().m == 199999.5
