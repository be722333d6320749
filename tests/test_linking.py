import numpy as np
import pandas as pd
import pytest

from meshtide.operators import linking as K

BOX = 10.0


def frame(spark, pos):
    return spark.createDataFrame(pd.DataFrame(pos, columns=["x", "y", "z"])).repartition(4)


def brute(pos, link):
    """Root of each point: all pairs, minimum image, no tolerance."""
    root = np.arange(len(pos))
    d = np.abs(pos[:, None] - pos[None])
    d = np.minimum(d, BOX - d)
    near = (d**2).sum(axis=2) <= link * link
    while True:
        new = np.array([root[n].min() for n in near])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def same_groups(spark, pos, link, floor=1):
    pos = pos % BOX
    got = K.groups(frame(spark, pos), BOX, link, floor).toPandas()
    root = brute(pos, link)
    want = []
    for r in np.unique(root):
        own = pos[root == r]
        if len(own) >= floor:
            first = min(map(tuple, own))
            d = own - np.array(first)
            want.append((len(own), *first, *((np.array(first) + (d - BOX * np.rint(d / BOX)).mean(axis=0)) % BOX)))
    got = sorted(map(tuple, got[["n", "x0", "y0", "z0", "cx", "cy", "cz"]].to_numpy().tolist()))
    assert len(got) == len(want)
    for g, w in zip(got, sorted(want)):
        assert g[:4] == w[:4]
        d = np.abs(np.array(g[4:]) - np.array(w[4:]))
        assert np.minimum(d, BOX - d).max() < 1e-9


@pytest.mark.parametrize("link", [0.3, 0.9])
def test_groups_against_all_pairs(spark, link):
    rng = np.random.default_rng(int(link * 100))
    clumps = np.concatenate([rng.normal(c, 0.25, (80, 3)) for c in ([2, 2, 2], [0.02, 9.95, 5], [7, 3, 9])])
    same_groups(spark, np.concatenate([clumps, np.repeat([[4.1, 4.2, 4.3]], 100, axis=0), rng.uniform(0, BOX, (250, 3))]), link)


def test_points_at_the_threshold(spark):
    """Pairs a unit in the last place inside, at and outside the link, along axes, diagonals and across the seam."""
    link, rng, pos = 0.5, np.random.default_rng(4), []
    for i in range(60):
        centre = np.array([(i % 5) * 2.0, (i // 5 % 4) * 2.4, (i // 20) * 3.2]) + rng.uniform(0, 0.3, 3)
        way = rng.normal(size=3) if i % 3 else np.eye(3)[i % 9 // 3]
        other = centre + way / np.linalg.norm(way) * link
        other[0] = np.nextafter(other[0], [-np.inf, other[0], np.inf][i % 3])
        pos += [centre, other]
    same_groups(spark, np.array(pos), link)


def test_crowded_cells_at_the_threshold(spark):
    """Thousands of points in two cells whose nearest ones decide: boxes are cut several times, points never paired."""
    link, rng = 1.0, np.random.default_rng(5)
    wall = rng.uniform(0, 0.4, (3000, 3))
    wall[:, 0] = 0
    gap = np.nextafter(1.0, 2.0)
    left, right = wall + [3.0, 3, 3], rng.permutation(wall) + [3.0 + gap, 3, 3]
    right[:, 1:] += 1e-13
    same_groups(spark, np.concatenate([left[:400], right[:400]]), link)
    same_groups(spark, np.concatenate([left[:400], right[:400], left[:1] + [1.0, 0, 0]]), link)


def test_links_need_points_and_refusals(spark):
    same_groups(spark, np.array([[1.0, 1, 1]]), 0.5)
    empty = frame(spark, np.array([[1.0, 1, 1]])).where("false")
    assert K.groups(empty, BOX, 0.5, 1).count() == 0
    with pytest.raises(ValueError):
        K.cells_per_side(1.0, 0.7)
    with pytest.raises(Exception, match="null position"):
        K.groups(frame(spark, np.array([[1.0, 1, 1]])).selectExpr("cast(null as double) x", "y", "z"), BOX, 0.5).count()


def test_filled_box_leaves_few_pairs(spark):
    """Full cells are never within the link as boxes: their points decide, and few pairs leave the blocks."""
    link, rng = 1.0, np.random.default_rng(6)
    pos = rng.uniform(0, BOX, (60_000, 3))
    m, _ = K.cells_per_side(BOX, link)
    cells = K.cell_table(K.with_cell(frame(spark, pos), BOX, m)).cache()
    assert cells.agg({"n": "max"}).first()[0] > K.KEEP
    assert K.neighbour_pairs(cells, BOX, link).count() < 2 * cells.count()
    got = K.groups(frame(spark, pos), BOX, link).toPandas()
    assert got["n"].tolist() == [len(pos)]
    assert tuple(got.loc[0, ["x0", "y0", "z0"]]) == min(map(tuple, pos))
    assert "pts" in cells.columns and not cells.filter("whole and length(pts) <> 24 * n or not whole and length(pts) > 24 * 16").count()
