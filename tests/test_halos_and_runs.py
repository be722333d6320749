import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshtide.config import Cosmology, geometry
from meshtide.functions.cosmology import peculiar_velocity_factor
from meshtide.operators import halos as H
from meshtide.operators import state as ST
from meshtide.operators.components import components
from meshtide.plans import initial as IC
from meshtide import session
from meshtide.sources import checkpoints as CP
from meshtide.sources import exports, store
from meshtide.streaming.deposit import running_deposit
from tests.test_particles import BOX, frame, reference_mesh

GEO = geometry("smoke")


def brute_groups(pos, link):
    n = len(pos)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n):
        d = pos[i + 1:] - pos[i]
        d -= BOX * np.rint(d / BOX)
        for j in np.flatnonzero((d**2).sum(axis=1) <= link * link):
            a, b = find(i), find(i + 1 + int(j))
            root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("b", [0.2, 0.4])
def test_fof_against_brute_force(spark, b):
    rng = np.random.default_rng(1)
    # clumps, one across the seam, one spot with a third of all particles, and a field
    spots = np.concatenate([rng.normal(c, 0.12, (60, 3)) for c in ([5, 5, 5], [0.05, 31.9, 16], [20, 8, 30])])
    pos = np.concatenate([spots, np.full((150, 3), 11.0), rng.uniform(0, BOX, (120, 3))]) % BOX
    pos = np.rint(pos / GEO.lattice.quantum) * GEO.lattice.quantum % BOX
    got = H.fof_catalog(frame(spark, pos), GEO.lattice, b, 4).toPandas()
    sizes = pd.Series(brute_groups(pos, b * GEO.lattice.spacing)).value_counts()
    assert sorted(got.n) == sorted(int(s) for s in sizes if s >= 4)
    spot = got[got.n >= 150].iloc[0]
    assert abs(spot.cx - 11.0) < 0.5


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in list(range(201)) + list(range(1000, 1150)) + [5000]], "id long")
    got = components(nodes, edges).toPandas()
    assert got.root.nunique() == 3 and got.groupby("root").size().tolist().count(1) == 1


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(3)
    a = rng.uniform(0, BOX, (60, 3))
    b = np.concatenate([rng.normal(16, 0.3, (80, 3)), rng.uniform(0, BOX, (5, 3)), np.full((20, 3), 2.0)]) % BOX
    fr = lambda p: frame(spark, p, ids=True).select("id", "x", "y", "z")
    got = H.nearest(fr(a), fr(b), BOX).toPandas().sort_values("a_id")
    d = a[:, None] - b[None]
    d = np.sqrt(((d - BOX * np.rint(d / BOX)) ** 2).sum(axis=2))
    assert len(got) == 60 and np.allclose(got.d, d.min(axis=1), atol=1e-12)
    assert np.array_equal(got.b_id, d.argmin(axis=1))


def test_self_match_is_identity(spark):
    cat = spark.createDataFrame([(i, 50, float(3 * i), 5.0, 7.0) for i in range(8)],
                                "halo_id long, n long, cx double, cy double, cz double")
    m = H.match(cat, cat, GEO.lattice).toPandas()
    assert (m.a_id == m.b_id).all() and len(m) == 8
    ab = H.abundance(cat, cat).toPandas().set_index("bin")
    assert ab.ratio[1] == 1.0 and np.isnan(ab.ratio[0])


def coded(spark, n=400, seed=2):
    rng = np.random.default_rng(seed)
    return ST.encode(frame(spark, rng.uniform(0, BOX, (n, 3)), rng.normal(0, 0.3, (n, 3))), GEO)


def multiset(df):
    cols = ST.CODED
    return df.select(*cols).toPandas().sort_values(cols).reset_index(drop=True)


def test_store_round_trip_and_refusals(spark, tmp_path):
    rows, scales = coded(spark)
    where = str(tmp_path / "state")
    with pytest.raises(FileNotFoundError):
        store.read_manifest(spark, where)
    man = store.write_state(rows, scales, GEO, where, {"note": "x"})
    assert man["n_particles"] == 400
    back, back_scales, _ = store.load_state(spark, where, GEO)
    assert multiset(back).equals(multiset(rows))
    part, _, _ = store.load_state(spark, where, GEO, slabs=(2, 4))
    assert part.count() == rows.filter((F.col("brick") >= 128) & (F.col("brick") < 256)).count()
    with pytest.raises(ValueError):
        store.load_state(spark, where, geometry("cdev8"))
    man["slabs"]["3"]["crc"] += 1
    store.write_text(spark, f"{where}/{store.MANIFEST}", __import__("json").dumps(man))
    with pytest.raises(ValueError, match="3"):
        store.load_state(spark, where, GEO)
    store.write_text(spark, f"{where}/{store.MANIFEST}", '{"schema": "other"}')
    with pytest.raises(ValueError):
        store.read_manifest(spark, where)


def test_export(spark, tmp_path):
    rows, scales = coded(spark)
    where, cosmo = str(tmp_path / "export"), Cosmology()
    head = exports.write_particles(rows, scales, GEO, where, a=0.5, cosmo=cosmo)
    df, again = exports.load_particles(spark, where)
    assert again["n_particles"] == df.count() == 400 and head["units"]["velocity"] == "km/s"
    native = ST.decode(rows, scales, GEO).agg(F.sum("vx")).first()[0]
    assert df.agg(F.sum("vx")).first()[0] == pytest.approx(native * peculiar_velocity_factor(0.5, cosmo), rel=1e-4)
    off = exports.part_offsets(df).toPandas().sort_values("number")
    assert off.row0.iloc[0] == 0 and off.n.sum() == 400
    with pytest.raises(ValueError, match="half a step"):
        exports.write_particles(rows, scales, GEO, where, provenance=dict(kind="checkpoint", aligned=False))


def test_export_epoch():
    epoch = exports.resolve_epoch
    assert epoch({"a": 0.3, "cosmology": {}}) == exports.Epoch(0.3, Cosmology(), "recorded")
    assert epoch({"a": 0.3}, a=0.4, h=0.7) == exports.Epoch(0.4, Cosmology(h=0.7), "asked")
    assert epoch({}) == epoch({"a": 0.3}, native=True) == exports.Epoch()
    for wrong in (dict(h=0.7), dict(native=True, a=0.2), dict(native=True, h=0.7)):
        with pytest.raises(ValueError):
            epoch({}, **wrong)


def test_checkpoint_generations(spark, tmp_path):
    rows, scales = coded(spark)
    plan = CP.Schedule(((0.05, 0.9, 0.1), (0.06, 0.92, 0.12), (0.07, 0.93, 0.1)), frozenset({2}))
    path = str(tmp_path / "ck")
    assert CP.newest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        CP.load(spark, path, GEO, plan)
    made = [CP.write(rows, scales, GEO, path, step, plan, {"a": 0.1 * step}) for step in (1, 2, 3)]
    assert [c.generation for c in made] == [0, 1, 0] and [c.aligned for c in made] == [False, True, True]
    c, _, last = CP.load(spark, path, GEO, plan)
    assert last == made[2] and multiset(c).equals(multiset(rows))
    store.delete(spark, f"{made[2].path}/{store.MANIFEST}")  # a write that did not end
    assert CP.newest(spark, path) == made[1]
    for other in (CP.Schedule(plan.coefficients), CP.Schedule(plan.coefficients[:2], plan.snapshots)):
        with pytest.raises(ValueError, match="another configuration"):
            CP.load(spark, path, GEO, other)


def test_tables_are_freed_after_an_error(spark):
    with pytest.raises(RuntimeError), session.tables_freed():
        made = session.durable(spark.range(5))
        path = session._TABLES[id(made)][1]
        raise RuntimeError
    assert not os.path.exists(path)


def test_match_table_keeps_bins_without_a_pair(spark):
    lat, cols = GEO.lattice, "halo_id long, n long, cx double, cy double, cz double"
    a = spark.createDataFrame([(1, 30, 1.0, 1.0, 1.0), (2, 60, 8.0, 8.0, 8.0), (3, 3 * 10**9, 4.0, 1.0, 6.0)], cols)
    b = spark.createDataFrame([(1, 25, 1.1, 1.0, 1.0), (2, 70, 3.0, 9.0, 3.0), (3, 3 * 10**9, 4.0, 1.0, 6.0)], cols)
    rows = {r.bin: r for r in H.match_table(H.match(a, b, lat), a, b, lat).collect()}
    assert sorted(rows) == [0, 1, 2, 3, 4]
    assert rows[0].matched == 1 and rows[0].f_match_a == 1 and rows[0].p50 == pytest.approx(np.log(25 / 30))
    assert rows[1].matched == 0 and rows[1].f_match_a == 0 and np.isnan(rows[1].p50)
    assert rows[4].matched == 1 and {r.bin: r.n_a for r in H.abundance(a, b).collect()}[4] == 1


def test_nearest_in_a_crowded_spot(spark):
    """Many points within one coarse leaf: finer leaves, the same answer."""
    r = np.random.default_rng(8)
    spot = np.concatenate([1.0 + 1e-4 * r.random((600, 3)), r.random((20, 3)) * BOX])
    probe = np.concatenate([1.0 + 1e-4 * r.random((40, 3)), r.random((10, 3)) * BOX])
    table = lambda x: spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")
    assert H.leaf_bits(table(spot), BOX) > H.LEAF_BITS[0]
    d = probe[:, None] - spot
    d2 = ((d - BOX * np.rint(d / BOX)) ** 2).sum(axis=2)
    found = {q.a_id: q for q in H.nearest(table(probe), table(spot), BOX).collect()}
    assert [found[i].b_id for i in range(50)] == d2.argmin(axis=1).tolist()


def test_generated_particles(spark):
    p = IC.generate(spark, 5, 8, 64.0, Cosmology(), 0.1).toPandas()
    assert len(p) == 512 and p[list("xyz")].stack().between(0, 64.0).all()


@pytest.mark.parametrize("scheme", ["cic", "tsc"])
def test_row_wise_deposit_equals_batch_without_lambdas(spark, scheme):
    """Corners are plain expressions: a function applied per array element is not compiled, and took most of the time."""
    pos = np.random.default_rng(5).uniform(0, BOX, (400, 3))
    rows = running_deposit(frame(spark, pos), scheme, 16, BOX)
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = np.zeros(16**3, np.int64)
    for r in rows.collect():
        got[r.cell] = r.q
    assert np.array_equal(got.reshape(16, 16, 16), reference_mesh(pos, 16, scheme))


def test_streaming_deposit_equals_batch(spark, tmp_path):
    pos = np.random.default_rng(4).uniform(0, BOX, (300, 3))
    src = str(tmp_path / "in")
    df = frame(spark, pos)
    df.repartition(3).write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (running_deposit(stream, "tsc", 16, BOX).writeStream.outputMode("complete").format("memory")
         .queryName("running_mesh").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = np.zeros(16**3, np.int64)
    for r in spark.table("running_mesh").collect():
        got[r.cell] = r.q
    assert np.array_equal(got.reshape(16, 16, 16), reference_mesh(pos, 16, "tsc"))


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["encode_positions", "tsc_paint_int", "cic_paint_int", "tile_paint_int", "run_rank",
                                  "drift_dithered", "migrate_rescale", "tsc_gather", "dft_spectrum", "coarse_force_matched",
                                  "pk_card", "bispectrum", "subvolume_response", "halo_fof_lineitem", "halo_match"])
def test_query_against_reference_sql(spark, name):
    import __spark_entry__ as entry
    from tests.compare import connect, difference
    sf = "/root/testdata/sf0.001"
    held = set(session._TABLES)
    with session.tables_freed():
        got = entry.queries()[name](spark, sf).toPandas()
    assert set(session._TABLES) == held
    assert difference(got, connect(sf).execute(entry.oracle_sql()[name]).df()) is None


def test_catalogue_headers_travel_and_unlike_ones_are_refused(spark, tmp_path):
    cat = spark.createDataFrame([(1, 40, 1.0, 1.0, 1.0), (2, 12, 9.0, 9.0, 9.0)], "halo_id long, n long, cx double, cy double, cz double")
    made = dict(box=GEO.box, n_part=GEO.n_part, link=0.2, mesh=GEO.n_fine, a=0.5)
    a = H.with_header(cat, **made)
    a.write.parquet(str(tmp_path / "cat"))
    stored = spark.read.parquet(str(tmp_path / "cat"))
    assert H.header(stored) == H.header(a) == made
    H.refuse_unlike(a, H.with_header(cat, **{**made, "a": 0.5 * (1 + 1e-7)}))
    for key, other in (("box", 2 * GEO.box), ("n_part", 7), ("link", 0.28), ("mesh", 7), ("a", 0.5001)):
        with pytest.raises(ValueError, match="epochs" if key == "a" else key):
            H.compare(a, H.with_header(cat, **{**made, key: other}), GEO.lattice)
    with pytest.raises(ValueError, match="no header"):
        H.compare(a, cat, GEO.lattice)
    far = H.with_header(cat, **{**made, "box": 2 * GEO.box})
    with pytest.raises(ValueError, match="lattice"):
        H.compare(far, far, GEO.lattice)
    rows = H.compare(a, stored, GEO.lattice, edges=(10, 30)).orderBy("bin").collect()
    assert [r.matched for r in rows] == [1, 1] and [r.f_match_a for r in rows] == [1.0, 1.0]
