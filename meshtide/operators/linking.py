"""Distance links between points at raw double coordinates, exact at the threshold.

The box is cut into cells so small that any two points of one cell are linked. A cell is then one node of a graph, and one row:
its count, its bounding box, its coordinate sums, and its points where it has at most KEEP, else its extreme ones. Rows are
made inside the map tasks already, so that a crowded cell sends a row per task. Cells meet their neighbours in blocks:
a cell goes to the block it is in and to those whose margin it is in, about two copies, and a block is matched in arrays, nearest
cells first; pairs that links before connect already are passed over. Bounding boxes decide: farther apart than the link, or wholly
within it; and so do the points that the rows hold. Of the rest, crowded cells whose extreme points are too far apart, only pairs
in different components look at points again, and not at single ones: the points are boxed in eighths of the cell's side,
the boxes are compared, and only boxes still undecided are cut further. Boxes of one point each decide exactly.

Groups in tasks are bounded by geometry (cells of a block, eighths of a cell), however many points share a cell.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshtide.functions import lattice as L
from meshtide.operators.components import components
from meshtide.session import durable, release

KEEP = 16  # points in a cell's row, at most
CHUNK = 1 << 19  # points that a map task puts together at a time
AHEAD = np.array([o for o in product((-1.0, 0.0, 1.0), repeat=3) if np.abs(o).sum() in (1, 3)])  # where a crowded cell's extreme points are sought
BLOCK = 16  # cells per side of a block, at least
CUT = 8  # parts per side of an undecided box
LAST = 12  # after so many cuts a box is a few units of the last place wide: its points are compared as they are
SLACK = 1e-12  # of a squared distance, between boxes; points are compared without


def cells_per_side(box: float, link: float) -> tuple[int, int]:
    """(cells per side, reach): cells whose diagonal is below the link; links reach that many cells."""
    m = int(box * math.sqrt(3.0) / link * (1.0 + 1e-9)) + 1
    reach = int(link / (box / m)) + 1
    if m < 2 * reach + 1:
        raise ValueError("the linking length is too large for this box")
    return m, reach


def half_space(m: int, reach: int, box: float, link: float) -> list[tuple[int, int, int]]:
    side = box / m
    return [o for o in product(range(-reach, reach + 1), repeat=3)
            if o > (0, 0, 0) and sum(max(abs(v) - 1, 0) ** 2 for v in o) * side * side <= link * link * (1.0 + SLACK)]


def with_cell(points: DataFrame, box: float, m: int) -> DataFrame:
    """x, y, z wrapped into the box, and ``cell``; other columns stay."""
    rows = points.withColumns({a: F.coalesce(F.expr(f"pmod(cast({a} as double), {box!r}D)"), L.no_position().cast("double")) for a in "xyz"})
    own = [F.least(F.floor(F.col(a) * F.lit(m / box)).cast("long"), F.lit(m - 1)) for a in "xyz"]
    return rows.withColumn("cell", L.flat(*own, m))


def _edges(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]]))


def extreme(cell: np.ndarray, xyz: np.ndarray) -> np.ndarray:
    """Places, ascending, of each cell's farthest point in every direction of AHEAD and of its least point; rows are sorted by cell."""
    first = _edges(cell)
    run = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [len(cell)]])))
    found = [np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0], run))[first]]
    for way in AHEAD:
        v = xyz @ way
        at = np.flatnonzero(v == np.maximum.reduceat(v, first)[run])
        found.append(at[_edges(run[at])])
    return np.unique(np.concatenate(found))


def _summed(cell: np.ndarray, n: np.ndarray, sums: np.ndarray, held: np.ndarray, xyz: np.ndarray) -> tuple[np.ndarray, ...]:
    """The rows of each cell as one: ``held`` points of each row are in ``xyz``. At most KEEP of a cell's points stay."""
    order = np.argsort(cell, kind="stable")
    at = np.repeat(cell, held)
    by_cell = np.argsort(at, kind="stable")
    at, xyz = at[by_cell], xyz[by_cell]
    cell, first = cell[order], _edges(cell[order])
    n, sums = np.add.reduceat(n[order], first), np.add.reduceat(sums[order], first, axis=0)
    held = np.diff(np.concatenate([_edges(at), [len(at)]]))
    many = np.repeat(held > KEEP, held)
    if many.any():
        some = np.flatnonzero(many)
        keep = ~many
        keep[some[extreme(at[some], xyz[some])]] = True
        at, xyz = at[keep], xyz[keep]
        held = np.diff(np.concatenate([_edges(at), [len(at)]]))
    return cell[first], n, sums, held, xyz


def _packed(held: np.ndarray, xyz: np.ndarray) -> pa.Array:
    ends = (np.concatenate([[0], np.cumsum(held)]) * 24).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(xyz).tobytes())])


def _unpacked(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(held, xyz) of the column ``pts``."""
    c = pa.concat_arrays([x.cast(pa.binary()) for x in table.column("pts").chunks])
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset:c.offset + len(c) + 1]
    return np.diff(ends) // 24, np.frombuffer(c.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(np.float64).reshape(-1, 3)


def _partial(batches):
    """Points to rows of cells, some CHUNK points at a time; count and sums are null where the row holds all its points."""

    def done():
        table = pa.Table.from_batches(kept)
        cell, xyz = table.column("cell").to_numpy(), np.stack([table.column(a).to_numpy() for a in "xyz"], axis=1)
        one = np.ones(len(cell), np.int64)
        cell, n, sums, held, xyz = _summed(cell, one, xyz, one, xyz)
        whole = n == held
        return pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n, mask=whole), *(pa.array(sums[:, k], mask=whole) for k in range(3)), _packed(held, xyz)],
                                          ["cell", "n", "sx", "sy", "sz", "pts"])

    kept, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            kept.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            yield done()
            kept, rows = [], 0
    if rows:
        yield done()


def _merged(batches):
    """Rows sorted by cell: one row per cell."""
    for table in _whole_groups(batches, "cell"):
        held, xyz = _unpacked(table)
        first = np.cumsum(held) - held
        n, sums = held.astype(np.int64), np.add.reduceat(xyz, first, axis=0)
        given = np.flatnonzero(table.column("n").is_valid().to_numpy())
        if len(given):
            some = table.take(pa.array(given))
            n[given] = some.column("n").to_numpy()
            sums[given] = np.stack([some.column(f"s{a}").to_numpy() for a in "xyz"], axis=1)
        cell, n, sums, held, xyz = _summed(table.column("cell").to_numpy(), n, sums, held, xyz)
        first = np.cumsum(held) - held
        run = np.repeat(np.arange(len(first)), held)
        least = xyz[np.lexsort((xyz[:, 2], xyz[:, 1], xyz[:, 0], run))[first]]
        boxes = [f.reduceat(xyz, first, axis=0) for f in (np.minimum, np.maximum)]
        columns = [v[:, k] for v in (*boxes, sums, least) for k in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n), *map(pa.array, columns), pa.array(n == held), _packed(held, xyz)],
                                         ["cell", "n", *(f"{t}{a}" for t in ("lo", "hi", "s", "l") for a in "xyz"), "whole", "pts"])


def cell_table(points: DataFrame) -> DataFrame:
    """(cell, n, lo, hi, sum and least point per axis, whole, pts): one row per cell that holds a point.

    ``pts`` is all points where ``whole``, else extreme ones; boxes and least points are of all points either way.
    """
    rows = points.select("cell", "x", "y", "z").mapInArrow(_partial, "cell long, n long, sx double, sy double, sz double, pts binary")
    of_all = ", ".join(f"{t}{a} double" for t in ("lo", "hi", "s", "l") for a in "xyz")
    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_merged, f"cell long, n long, {of_all}, whole boolean, pts binary")


def apart(a: dict, b: dict, box: float, link: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked, undecided) of pairs of boxes; ``lo`` and ``hi`` are (rows, 3), and boxes are small beside the box."""
    near = far = flat = 0.0
    for k in range(3):
        shift = box * np.rint((a["lo"][:, k] - b["lo"][:, k]) / box)
        lo, hi = b["lo"][:, k] + shift, b["hi"][:, k] + shift
        near = near + np.maximum(np.maximum(lo - a["hi"][:, k], a["lo"][:, k] - hi), 0.0) ** 2
        far = far + np.maximum(hi - a["lo"][:, k], a["hi"][:, k] - lo) ** 2
        d = np.abs(a["lo"][:, k] - b["lo"][:, k])
        flat = flat + np.minimum(d, box - d) ** 2
    points = (a["lo"] == a["hi"]).all(axis=1) & (b["lo"] == b["hi"]).all(axis=1)
    linked = np.where(points, flat <= link * link, far <= link * link * (1.0 - SLACK))
    return linked, ~linked & ~points & (near <= link * link * (1.0 + SLACK))


def _whole_groups(batches, key: str):
    """Arrow tables that end where a value of ``key`` ends, rows being sorted by it."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        values = held.column(key).to_numpy()
        if len(values) == 0:
            continue
        cut = int(np.searchsorted(values, values[-1]))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def connected(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes is connected to by the edges (i, j)."""
    top = np.arange(n)
    while len(i):
        least = np.minimum(top[i], top[j])
        np.minimum.at(top, top[i], least)
        np.minimum.at(top, top[j], least)
        while (top[top] != top).any():
            top = top[top]
        left = top[i] != top[j]
        i, j = i[left], j[left]
    return top


def _boxes(table: pa.Table, names: str = "") -> dict:
    return {t: np.stack([table.column(f"{names}{t}{a}").to_numpy() for a in "xyz"], axis=1) for t in ("lo", "hi")}


def points_meet(held: np.ndarray, xyz: np.ndarray, i: np.ndarray, j: np.ndarray, box: float, link: float) -> np.ndarray:
    """Whether a held point of row i is within the link of one of row j."""
    first, most = np.cumsum(held) - held, np.maximum(held[i], held[j])
    out, done = np.zeros(len(i), bool), 0
    for width in (1, 2, 4, 8, KEEP):
        some = np.flatnonzero((most > done) & (most <= width))
        done = width
        # a short row repeats its last point
        u, v = (first[r[some], None] + np.minimum(np.arange(width), held[r[some], None] - 1) for r in (i, j))
        flat = 0.0
        for k in range(3):
            d = np.abs(xyz[u, k][:, :, None] - xyz[v, k][:, None, :])
            flat = flat + np.minimum(d, box - d) ** 2
        out[some] = (flat <= link * link).any(axis=(1, 2))
    return out


def neighbour_pairs(cells: DataFrame, box: float, link: float) -> DataFrame:
    """(a, b, linked): cells that are linked, directly or through others of their block, and cells that boxes leave undecided."""
    m, reach = cells_per_side(box, link)
    blocks = max(1, m // BLOCK)
    offsets = sorted(half_space(m, reach, box, link), key=lambda o: sum(v * v for v in o))
    c = F.col("cell")
    rows = cells.select("cell", "whole", "pts",
                        *(v.alias(f"i{a}") for a, v in zip("xyz", (L.div(c, m * m), L.div(c, m) % m, c % m))))
    for a in "xyz":
        home = f"(((i{a} + 1) * {blocks}L - 1) div {m}L)"
        places = [f"array(struct({home} as b, i{a} as u))",
                  f"if(i{a} - {home} * {m}L div {blocks}L < {reach}, array(struct(pmod({home} - 1, {blocks}L) as b, i{a} + if({home} = 0, {m}L, 0L) as u)), array())"]
        if a != "x":  # a pair is found by the cell with the smaller x; the other's block needs no margin below
            places.append(f"if(({home} + 1) * {m}L div {blocks}L - i{a} <= {reach}, "
                          f"array(struct(({home} + 1) % {blocks}L as b, i{a} - if({home} = {blocks - 1}L, {m}L, 0L) as u)), array())")
        rows = rows.withColumn(f"_{a}", F.explode(F.expr(f"concat({', '.join(places)})")))
    rows = rows.select(F.expr(f"(_x.b * {blocks}L + _y.b) * {blocks}L + _z.b").alias("block"), *(F.col(f"_{a}.u").alias(f"u{a}") for a in "xyz"),
                       F.expr("_x.u = ix and _y.u = iy and _z.u = iz").alias("home"), "cell", "whole", "pts")

    def run(batches):
        for table in _whole_groups(batches, "block"):
            block = table.column("block").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            size = np.diff(np.concatenate([first, [len(block)]]))
            key = np.repeat(np.arange(len(first)), size)
            span = 2 * BLOCK + 4 * reach + 2
            for a in "xyz":
                u = table.column(f"u{a}").to_numpy()
                key = key * span + u - np.repeat(np.minimum.reduceat(u, first), size) + reach
            order = np.argsort(key)
            key, cell, whole = key[order], table.column("cell").to_numpy()[order], table.column("whole").to_numpy()[order]
            held, xyz = _unpacked(table)
            first = np.cumsum(held) - held
            held, at = held[order], np.repeat(first[order], held[order])
            first = np.cumsum(held) - held
            xyz = xyz[at + np.arange(len(at)) - np.repeat(first, held)]
            b = {t: f.reduceat(xyz, first, axis=0) for t, f in (("lo", np.minimum), ("hi", np.maximum))}
            home = np.flatnonzero(table.column("home").to_numpy()[order])
            top, open_pairs = np.arange(len(cell)), []
            for o in offsets:
                want = key[home] + (o[0] * span + o[1]) * span + o[2]
                at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                met = (key[at] == want) & (top[home] != top[at])
                i, j = home[met], at[met]
                linked, open_ = apart({t: v[i] for t, v in b.items()}, {t: v[j] for t, v in b.items()}, box, link)
                unsure = np.flatnonzero(open_)
                linked[unsure] = points_meet(held, xyz, i[unsure], j[unsure], box, link)
                open_ &= ~linked & ~(whole[i] & whole[j])
                open_pairs.append((i[open_], j[open_]))
                if linked.any():
                    top = connected(len(cell), top[i[linked]], top[j[linked]])[top]
            # within the task links are one to the least of what they connect, and what they connect is no longer undecided
            x, y = (np.concatenate([p[k] for p in open_pairs]) for k in (0, 1))
            apart_yet = top[x] != top[y]
            x, y = x[apart_yet], y[apart_yet]
            own = np.flatnonzero(top != np.arange(len(cell)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([cell[top[own]], cell[x]])), pa.array(np.concatenate([cell[own], cell[y]])),
                                              pa.array(np.arange(len(own) + len(x)) < len(own))], ["a", "b", "linked"])

    dealt = rows.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(run, "a long, b long, linked boolean")


def _compared(box: float, link: float):
    """Boxes of both sides of a pair, sorted by pair: pairs of boxes that are linked (one per pair) or undecided."""

    def run(batches):
        for table in _whole_groups(batches, "pair"):
            pair, side, b = table.column("pair").to_numpy(), table.column("side").to_numpy(), _boxes(table)
            names = {c: table.column(c).to_numpy() for c in ("a", "b", "kx", "ky", "kz")}
            edges = np.concatenate([[0], np.flatnonzero(pair[1:] != pair[:-1]) + 1, [len(pair)]])
            out_a, out_b, out_linked = [], [], []
            for lo, hi in zip(edges, edges[1:]):
                own = lo + np.flatnonzero(side[lo:hi] == 0)
                other = lo + np.flatnonzero(side[lo:hi] == 1)
                i, j = np.repeat(own, len(other)), np.tile(other, len(own))
                # two pairs of one hash share the rows of both: only boxes of one pair are compared
                same = (names["a"][i] == names["a"][j]) & (names["b"][i] == names["b"][j])
                i, j = i[same], j[same]
                linked, open_ = apart({t: v[i] for t, v in b.items()}, {t: v[j] for t, v in b.items()}, box, link)
                keep = np.flatnonzero(linked | open_)
                out_a.append(i[keep])
                out_b.append(j[keep])
                out_linked.append(linked[keep])
            i, j = np.concatenate(out_a), np.concatenate(out_b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names["a"][i]), pa.array(names["b"][i]), *(pa.array(names[k][x]) for x in (i, j) for k in ("kx", "ky", "kz")), pa.array(np.concatenate(out_linked))],
                ["a", "b", "ax", "ay", "az", "bx", "by", "bz", "linked"])

    return run


def refined(points: DataFrame, pairs: DataFrame, box: float, link: float, m: int) -> DataFrame:
    """(a, b) of the undecided ``pairs`` of cells that hold points within the link."""
    zero = F.lit(0).cast("long")
    state = durable(pairs.select("a", "b", *(zero.alias(f"{s}{a}") for s in "ab" for a in "xyz")))
    near = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    near = durable(points.select("cell", "x", "y", "z").join(near, "cell", "left_semi"))
    found, level, made = None, 0, []
    c = F.col("cell")
    index = dict(zip("xyz", (L.div(c, m * m), L.div(c, m) % m, c % m)))
    inside = {a: F.col(a) * F.lit(m / box) - index[a] for a in "xyz"}
    while not state.isEmpty():
        level += 1
        parent = {a: F.greatest(F.floor(inside[a] * float(CUT ** (level - 1))).cast("long"), zero) if level > 1 else zero for a in "xyz"}
        own = {a: F.greatest(F.floor(inside[a] * float(CUT**level)).cast("long"), zero) for a in "xyz"}
        keys = [parent[a].alias(f"p{a}") for a in "xyz"] + [own[a].alias(f"k{a}") for a in "xyz"]
        # at the last level every position is a box of its own
        exact = ["x", "y", "z"] if level > LAST else []
        boxes = near.select("cell", "x", "y", "z", *keys).groupBy("cell", "px", "py", "pz", "kx", "ky", "kz", *exact).agg(
            *(f(a).alias(f"{t}{a}") for t, f in (("lo", F.min), ("hi", F.max)) for a in "xyz")).drop(*exact)
        boxes = durable(boxes)
        pair = F.xxhash64("a", "b", *(f"{s}{a}" for s in "ab" for a in "xyz"))
        sides = []
        for number, s in enumerate("ab"):
            at = boxes.withColumnsRenamed({"cell": s} | {f"p{a}": f"{s}{a}" for a in "xyz"})
            sides.append(state.withColumn("pair", pair).join(at, [s, *(f"{s}{a}" for a in "xyz")]).select(
                "pair", F.lit(number).alias("side"), "a", "b", "kx", "ky", "kz", *(f"{t}{a}" for t in ("lo", "hi") for a in "xyz")))
        met = sides[0].unionByName(sides[1]).repartition("pair").sortWithinPartitions("pair")
        decided = durable(met.mapInArrow(_compared(box, link), "a long, b long, ax long, ay long, az long, bx long, by long, bz long, linked boolean"))
        made.append(decided)
        now = decided.filter("linked").select("a", "b").distinct()
        found = now if found is None else found.unionByName(now)
        before, state = state, durable(decided.filter("not linked").drop("linked").join(now, ["a", "b"], "left_anti"))
        release(before, boxes)
    out = durable(pairs.select("a", "b").filter("false") if found is None else found)
    release(near, state, *made)
    return out


def linked_cells(points: DataFrame, box: float, link: float) -> tuple[DataFrame, DataFrame]:
    """(points with ``cell``, cells with ``root``): cells of one root are what links of at most ``link`` connect.

    ``points`` may be read twice: give a stored table, or a cheap projection of one.
    """
    m, _ = cells_per_side(box, link)
    placed = with_cell(points, box, m)
    table = durable(cell_table(placed))
    cells = table.drop("pts", "whole")
    pairs = durable(neighbour_pairs(table, box, link))
    ids = cells.select(F.col("cell").alias("id"))
    sure = pairs.filter("linked").select("a", "b")
    labels = durable(components(ids, sure))
    at = {s: labels.select(F.col("id").alias(s), F.col("root").alias(f"root_{s}")) for s in "ab"}
    unsure = durable(pairs.filter("not linked").select("a", "b").join(at["a"], "a").join(at["b"], "b").filter("root_a <> root_b"))
    release(pairs)
    used = [table, unsure, labels]
    if not unsure.isEmpty():
        more = refined(placed, unsure.select("a", "b"), box, link, m)
        # what the later links connect is connected between the components that the sure ones made
        met = more.join(at["a"], "a").join(at["b"], "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        over = components(labels.select(F.col("root").alias("id")).distinct(), met).select(F.col("id").alias("root"), F.col("root").alias("top"))
        labels = labels.join(over, "root").select("id", F.col("top").alias("root"))
        used.append(more)
    out = durable(cells.join(labels.withColumnRenamed("id", "cell"), "cell"))
    release(*used)
    return placed, out


def groups(points: DataFrame, box: float, link: float, floor: int = 10) -> DataFrame:
    """(root, n, x0, y0, z0, cx, cy, cz) of groups with at least ``floor`` points.

    The least point of a group by (x, y, z), and its mean position, minimum image about the root's cell (of a group wider than half the box
    a mean depends on that choice, as any does). A cell's points share an image, so
    sums per cell are enough and a crowded cell costs one row.
    """
    m, _ = cells_per_side(box, link)
    _, cells = linked_cells(points, box, link)
    middle = lambda c: [(v.cast("double") + 0.5) * F.lit(box / m) for v in (L.div(F.col(c), m * m), L.div(F.col(c), m) % m, F.col(c) % m)]
    sums = []
    for a, here, anchor in zip("xyz", middle("cell"), middle("root")):
        turns = F.rint((here - anchor) / F.lit(box))
        sums.append(F.sum(F.col(f"s{a}") - F.col("n") * (anchor + turns * F.lit(box))).alias(f"s{a}"))
    out = cells.groupBy("root").agg(F.sum("n").alias("n"), F.min(F.struct("lx", "ly", "lz")).alias("least"), *sums).filter(F.col("n") >= floor)
    mean = [F.pmod(anchor + F.col(f"s{a}") / F.col("n"), F.lit(box)).alias(f"c{a}") for a, anchor in zip("xyz", middle("root"))]
    return out.select("root", "n", *(F.col(f"least.l{a}").alias(f"{a}0") for a in "xyz"), *mean)
