"""Clusters of similar poses: parallel pivot correlation clustering, then the exact joining of clusters that touch.

Rounds: of the poses not yet in a cluster, those whose hash lies under a rising bound are candidates; a candidate with the
least hash among its similar candidates is a pivot, and every pose similar to a pivot is absorbed. A cluster of m poses
meets its first candidate when the bound passes about 1 / m, so however large it is, a round has few candidates of it; the
first round has at most ``FIRST`` candidates in all. When no pose is left, each goes to its closest pivot.

Clusters as the problem has them join all poses linked by similarity, also through others. A member similar to another
cluster's pivot links the two at once: in a dense region that joins all there is. Only members that lie within
another cluster's radius and the limit, of clusters not yet joined, are then compared with each other. No pair is missed:
every step leaves out only what the triangle inequality rules out.

Neighbours are found by a tree of cells that refines with the data: a cell of more than ``LEAF`` poses is cut at its mean
along the leading directions in which it is wide, until it is small or narrower than what is similar. Poses are written
in order of their cells. A projection never lengthens a distance, so a pose and all that is within a radius of it meet in
the pose's cell, to which the other side is copied if the box around the cell's poses is within that radius. Cells that
cannot be cut and hold more than ``BLOCK`` poses are cut by hash. A side of at most ``SMALL`` poses is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handloom.llm.poses import VALUES, lists, packed, scaled_poses
from handloom.operators.components import components
from handloom.runtime import materialise, scratch, sendable, spread_join

LIMIT = 0.12
DIRECTIONS = 16
#: Poses of a cell that is not cut any more; more where there would be over MOST_LEAVES cells, which bounds what is sent.
LEAF, MOST_LEAVES = 1024, 250_000
#: Cuts of a cell in one pass over the poses, and the deviation along a direction under which cutting does not pay.
CUTS, NARROW = 5, 1.3 * LIMIT
#: Sums that a task holds before it passes them on.
SUMS = 50_000
#: Passes at most; cells grow smaller by a constant factor in each, so this only ends what rounding would carry on.
PASSES = 40
FIRST, FASTER = 4096, 8
SMALL = 8192
BLOCK = 20_000
BLOCK_BITS = 24
STEP = 2048
#: Of a sum of 63 products in single precision, with room to spare.
ROUNDING = 1e-5
EPS = 1e-6


def usable(records: DataFrame) -> DataFrame:
    """``(id, pose)`` of usable records, poses packed, each feature_id once; of differing copies the one with the least hash."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, _ = scaled_poses(b.column("pose"))
            good = b.filter(pa.array(ok))
            yield pa.RecordBatch.from_arrays([good.column("id"), packed(good.column("pose"))], ["id", "pose"])

    slim = records.select(F.col("feature_id").cast("bigint").alias("id"), F.col("aligned").alias("pose")).filter("id is not null and pose is not null")
    return slim.mapInArrow(check, "id bigint, pose binary").groupBy("id").agg(F.min_by("pose", F.xxhash64("pose")).alias("pose"))


class Tree:
    """Cells by cuts along principal directions. A cell's number is its node; ``blocks`` says how often hash cuts it.

    Per node: the direction and place of its cut and the two nodes below, or -1 for a cell; the box around its poses.
    """

    def __init__(self, directions: np.ndarray):
        self.directions = directions
        self.axis, self.at, self.low, self.high = (np.full(1, -1, np.int32), np.zeros(1), *(np.full(1, -1, np.int32) for _ in "lh"))
        self.blocks = np.ones(1, np.int64)
        self.least = self.most = np.empty((0, directions.shape[1]))

    def cut(self, cells: dict[int, list[tuple[int, float]]]) -> None:
        """Cut each cell along several directions, each given with its place."""
        axis, at, low, high = (x.tolist() for x in (self.axis, self.at, self.low, self.high))
        for cell, cuts in cells.items():
            below = [cell]
            for d, place in cuts:
                for k in below:
                    axis[k], at[k], low[k], high[k] = d, place, len(axis), len(axis) + 1
                    for x, new in ((axis, -1), (at, 0.0), (low, -1), (high, -1)):
                        x += [new, new]
                below = [c for k in below for c in (low[k], high[k])]
        self.axis, self.low, self.high = (np.array(x, np.int32) for x in (axis, low, high))
        self.at, self.blocks = np.array(at), np.ones(len(axis), np.int64)

    def cell(self, m: np.ndarray) -> np.ndarray:
        p, node, rows = m @ self.directions, np.zeros(len(m), np.int64), np.arange(len(m))
        while len(rows := rows[self.low[node[rows]] >= 0]):
            k = node[rows]
            node[rows] = np.where(p[rows, self.axis[k]] < self.at[k], self.low[k], self.high[k])
        return node

    def home(self, m: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """Cell and block in one number; ``spread`` is a hash that chooses the block."""
        cell = self.cell(m)
        return (cell << BLOCK_BITS) | (spread % self.blocks[cell])

    def reached(self, m: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, home) for all cells and blocks that hold a pose within the row's radius, as far as projections can tell."""
        p, radius = m @ self.directions, radius + EPS
        rows, node, done = np.arange(len(m)), np.zeros(len(m), np.int64), []
        while len(rows):
            inner = self.low[node] >= 0
            done.append((rows[~inner], node[~inner]))
            rows, k = rows[inner], node[inner]
            off = p[rows, self.axis[k]] - self.at[k]
            down, up = off - radius[rows] < 0, off + radius[rows] >= 0
            rows, node = np.append(rows[down], rows[up]), np.append(self.low[k[down]], self.high[k[up]])
        rows, node = (np.concatenate(x) for x in zip(*done, strict=True))
        near = np.empty(len(rows), bool)
        for s in range(0, len(rows), 1 << 16):
            q, k = p[rows[s : s + (1 << 16)]], node[s : s + (1 << 16)]
            off = np.maximum(np.maximum(self.least[k] - q, q - self.most[k]), 0)
            near[s : s + (1 << 16)] = np.sqrt((off**2).sum(axis=1)) <= radius[rows[s : s + (1 << 16)]]
        rows, node = rows[near], node[near]
        n = self.blocks[node]
        block = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(rows, n), (np.repeat(node, n) << BLOCK_BITS) | block


def _sums(points: DataFrame, of: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], width: int) -> DataFrame:
    """``(key, s0, s1, ...)``: sums of numbers per key, made within each partition and then over all."""

    def summed(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(key, return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(keys)))
        return keys, np.add.reduceat(values[order], starts, axis=0) if len(keys) else values

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(summed(*of(b)))
            n += len(held[-1][0])
            if n > SUMS:
                held = [summed(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if n > SUMS // 2:  # too many keys to hold: the shuffle adds up the rest
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), *(pa.array(c) for c in held[0][1].T)], names)
                    held, n = [], 0
        if held:
            key, sums = summed(*map(np.concatenate, zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c) for c in sums.T)], names)

    names = ["key", *(f"s{k}" for k in range(width))]
    schema = "key bigint, " + ", ".join(f"{n} double" for n in names[1:])
    return points.mapInArrow(partial, schema).groupBy("key").agg(*(F.sum(n).alias(n) for n in names[1:]))


def principal_directions(points: DataFrame, k: int = DIRECTIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k leading directions of all poses, the mean and deviation along them, and the number of poses."""

    def products(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, m = scaled_poses(b.column("pose"))
        m = np.hstack([m, np.ones((len(m), 1))])
        return np.arange(VALUES + 1), m.T @ m

    total = np.zeros((VALUES + 1, VALUES + 1))
    for r in _sums(points.select("pose"), products, VALUES + 1).collect():
        total[r.key] = r[1:]
    n = max(total[-1, -1], 1.0)
    mean = total[-1, :-1] / n
    spread, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    vectors = vectors[:, ::-1][:, :k].copy()
    return vectors, mean @ vectors, np.sqrt(np.maximum(spread[::-1][:k], 0)), int(total[-1, -1])


def grown(points: DataFrame) -> Tree:
    """The tree of cells for all ``points``. What comes to the driver are sums of cells with more than LEAF poses."""
    directions, mean, deviation, n = principal_directions(points)
    tree, most = Tree(directions), max(LEAF, n // MOST_LEAVES)
    wide = {0: (n, mean, deviation)}
    width = directions.shape[1]

    def stats(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        _, m = scaled_poses(b.column("pose"))
        p = m @ tree.directions
        return tree.cell(m), np.hstack([np.ones((len(p), 1)), p, p**2])

    for _ in range(PASSES):
        cells = {}
        for cell, (count, mean, deviation) in wide.items():
            order = [int(d) for d in np.argsort(-deviation) if deviation[d] > NARROW]
            cuts = order[: min(CUTS, max(0, int(np.ceil(np.log2(count / most)))))] if count else []
            if cuts:
                cells[cell] = [(d, mean[d]) for d in cuts]
        if not cells:
            break
        tree.cut(cells)
        found = _sums(points.select("pose"), stats, 1 + 2 * width).filter(F.col("s0") > most).collect()  # at most n / most cells
        wide = {}
        for r in found:
            s = np.array(r[1:])
            mean = s[1 : 1 + width] / s[0]
            wide[r.key] = (s[0], mean, np.sqrt(np.maximum(s[1 + width :] / s[0] - mean**2, 0)))
    for cell, (count, *_) in wide.items():
        tree.blocks[cell] = max(1, -(-int(count) // BLOCK))
    return tree


def placed(points: DataFrame, tree: Tree) -> DataFrame:
    """``(id, pose, home)``, written in order of home; the boxes of the tree's cells are taken from it."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(tree)  # at most 2 * MOST_LEAVES nodes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = scaled_poses(b.column("pose"))
            home = shared.value.home(m, b.column("spread").to_numpy())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("pose"), pa.array(home)], ["id", "pose", "home"])

    spread = points.select("id", "pose", F.shiftrightunsigned(F.xxhash64("id"), 1).alias("spread"))
    found = spread.mapInArrow(place, "id bigint, pose binary, home bigint")
    found = materialise(found.repartitionByRange("home", "id").sortWithinPartitions("home", "id"), "points")
    width = tree.directions.shape[1]
    names = ["cell", *(f"{e}{d}" for e in ("least", "most") for d in range(width))]

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = scaled_poses(b.column("pose"))
            p, out = m @ shared.value.directions, []
            for g in _groups(b.column("home").to_numpy() >> BLOCK_BITS):
                out.append([b.column("home")[int(g[0])].as_py() >> BLOCK_BITS, *p[g].min(axis=0), *p[g].max(axis=0)])
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            types = [pa.int64()] + [pa.float64()] * (2 * width)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    ends = found.select("home", "pose").mapInArrow(boxes, "cell bigint, " + ", ".join(f"{n} double" for n in names[1:]))
    best = [(F.min if n.startswith("least") else F.max)(n).alias(n) for n in names[1:]]
    tree.least, tree.most = (np.full((len(tree.axis), width), x) for x in (np.inf, -np.inf))
    for r in ends.groupBy("cell").agg(*best).toLocalIterator():  # as many rows as cells
        tree.least[r.cell], tree.most[r.cell] = r[1 : 1 + width], r[1 + width :]
    return found


def near_pairs(a: np.ndarray, b: np.ndarray, radius: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, distances) of all pairs within ``radius`` of b, in parts.

    A product in single precision, with room for its error, picks the pairs; their distances are taken in double.
    """
    if not len(a) or not len(b):
        return
    middle = b.mean(axis=0)
    a1, b1 = (a - middle).astype(np.float32), (b - middle).astype(np.float32)
    aa, bb = (a1**2).sum(axis=1), (b1**2).sum(axis=1)
    for s in range(0, len(b), STEP):
        e = s + STEP
        gap = a1 @ b1[s:e].T
        gap *= -2
        gap += (bb[s:e] * (1 - ROUNDING) - radius[s:e] ** 2 - 1e-6)[None].astype(np.float32)
        i, j = np.nonzero(gap <= (-aa * (1 - ROUNDING))[:, None])
        for t in range(0, len(i), 1 << 16):
            ii, jj = i[t : t + (1 << 16)], j[t : t + (1 << 16)] + s
            d = np.sqrt(((a[ii] - b[jj]) ** 2).sum(axis=1))
            ok = d <= radius[jj]
            yield ii[ok], jj[ok], d[ok]


Kernel = Callable[[pa.Table, np.ndarray, pa.Table, np.ndarray], pa.Table]


def _copied(points: DataFrame, tree: Tree) -> DataFrame:
    """Rows with a ``radius`` once for every cell they reach."""
    shared = points.sparkSession.sparkContext.broadcast(tree)  # at most 2 * MOST_LEAVES nodes

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = scaled_poses(b.column("pose"))
            rows, cells = shared.value.reached(m, b.column("radius").to_numpy())
            t = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cells)], [*t.schema.names, "cell"])

    return points.mapInArrow(place, points.schema.simpleString()[7:-1] + ",cell:bigint")


def _groups(values: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(values, kind="stable")
    cuts = np.nonzero(np.diff(values[order]))[0] + 1
    yield from np.split(order, cuts) if len(order) else ()


def meet(left: DataFrame, right: DataFrame, tree: Tree, kernel: Kernel, schema: str, gather=lambda df: df) -> DataFrame:
    """``kernel`` over all that may be near: rows of ``left`` (id, pose, cell, ...) and of ``right`` (id, pose, radius, ...).

    Each left row sees every right row whose radius reaches it at least once; in blocks if many reach a cell, so results
    of a left row may come in parts; ``gather`` then puts them together. The kernel gets (left rows, their matrix, right
    rows, their matrix).
    """
    lcols, rcols = [c for c in left.columns if c != "cell"], right.columns
    n = right.limit(SMALL + 1).count()
    if n <= SMALL:
        there = right.toArrow()
        _, rm = scaled_poses(there.column("pose").combine_chunks())
        rows, cells = tree.reached(rm, there.column("radius").to_numpy())
        of_cell = {int(cells[g[0]]): rows[g] for g in _groups(cells)}
        shared = left.sparkSession.sparkContext.broadcast((there, rm, of_cell))  # at most SMALL rows, checked

        def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there, rm, of_cell = shared.value
            none = np.empty(0, np.int64)
            for b in batches:
                t = pa.Table.from_batches([b]).select(lcols)
                _, m = scaled_poses(b.column("pose"))
                for g in _groups(b.column("cell").to_numpy()):
                    near = of_cell.get(b.column("cell")[int(g[0])].as_py(), none)
                    for s in range(0, len(g), STEP):
                        part = g[s : s + STEP]
                        yield from kernel(t.take(pa.array(part)), m[part], there.take(pa.array(near)), rm[near]).to_batches()

        return left.select(*lcols, "cell").mapInArrow(beside, schema)

    copies = materialise(_copied(right, tree), "copies")
    cuts = copies.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    cuts = materialise(cuts, "cuts")  # at most copies / BLOCK rows
    a = left.select("cell", F.struct(*lcols).alias("l"))
    b = copies.select("cell", F.struct(*rcols).alias("r"))
    if whole := cuts.isEmpty():
        a, b = a.withColumn("block", F.lit(0)), b.withColumn("block", F.lit(0))
    else:
        cuts, parts = sendable(cuts), F.coalesce("parts", F.lit(1))
        a = a.join(cuts, "cell", "left").withColumn("block", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        b = b.join(cuts, "cell", "left").withColumn("block", F.pmod(F.xxhash64("r.id"), parts).cast("int")).drop("parts")
    both = a.unionByName(b, allowMissingColumns=True).repartition("cell", "block").sortWithinPartitions("cell", "block")

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            l, r = t.column("l").combine_chunks(), t.column("r").combine_chunks()
            is_left = l.is_valid()
            lt = pa.Table.from_struct_array(l.filter(is_left))
            rt = pa.Table.from_struct_array(r.filter(pc.invert(is_left)))
            _, lm = scaled_poses(lt.column("pose").combine_chunks())
            _, rm = scaled_poses(rt.column("pose").combine_chunks())
            mask = is_left.to_numpy(zero_copy_only=False)
            keys = np.stack([t.column(c).to_numpy() for c in ("cell", "block")])
            new = np.append(True, (np.diff(keys) != 0).any(axis=0))
            number = np.cumsum(new)
            ln, rn = number[mask], number[~mask]
            for k in np.unique(ln):
                lo, hi = np.searchsorted(ln, [k, k + 1])
                ro, rh = np.searchsorted(rn, [k, k + 1])
                for s in range(lo, hi, STEP):
                    e = min(s + STEP, hi)
                    yield from kernel(lt.slice(s, e - s), lm[s:e], rt.slice(ro, rh - ro), rm[ro:rh]).to_batches()

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            last = t.num_rows - 1
            same = pc.and_(pc.equal(t.column("cell"), t.column("cell")[last]), pc.equal(t.column("block"), t.column("block")[last]))
            cut = pc.index(same, True).as_py()
            if cut:
                yield from work(pa.concat_tables([*held, t.slice(0, cut)]))
                held = [t.slice(cut)]
            elif held and any(held[-1].column(c)[held[-1].num_rows - 1] != t.column(c)[0] for c in ("cell", "block")):
                yield from work(pa.concat_tables(held))
                held = [t]
            else:
                held.append(t)
        if held:
            yield from work(pa.concat_tables(held))

    found = both.mapInArrow(together, schema)
    return found if whole else gather(found)


def _limits(m: np.ndarray) -> np.ndarray:
    return np.full(len(m), LIMIT)


def _closest(lt: pa.Table, lm: np.ndarray, rt: pa.Table, rm: np.ndarray) -> pa.Table:
    """Every left row with the closest right row within LIMIT, if any; of equally close ones that of the lower id."""
    pivot, best = np.full(len(lm), -1), np.full(len(lm), np.inf)
    ids = rt.column("id").to_numpy()
    for i, j, d in near_pairs(lm, rm, _limits(rm)):
        order = np.lexsort((ids[j], d, i))
        i, first = np.unique(i[order], return_index=True)
        d, j = d[order][first], ids[j[order][first]]
        better = (d < best[i]) | ((d == best[i]) & (j < pivot[i]))
        best[i[better]], pivot[i[better]] = d[better], j[better]
    none = pa.array(best > LIMIT)
    out = [pc.if_else(none, pa.scalar(None, t), pa.array(v, t)) for v, t in ((pivot, pa.int64()), (best, pa.float64()))]
    return lt.select(["id", "pose", "home"]).append_column("pivot", out[0]).append_column("far", out[1])


CLOSEST = "id bigint, pose binary, home bigint, pivot bigint, far double"


def _beaten(lt: pa.Table, lm: np.ndarray, rt: pa.Table, rm: np.ndarray) -> pa.Table:
    """Left rows that have a similar right row of lesser hash."""
    lh, rh = lt.column("hash").to_numpy(), rt.column("hash").to_numpy()
    lost = np.zeros(len(lm), bool)
    for i, j, _ in near_pairs(lm, rm, _limits(rm)):
        lost[i[rh[j] < lh[i]]] = True
    return lt.select(["id"]).filter(pa.array(lost))


def _facing(lt: pa.Table, lm: np.ndarray, rt: pa.Table, rm: np.ndarray) -> pa.Table:
    """Left rows with the pivots of other clusters that they are similar to, and those whose members may be."""
    own, other, reach = lt.column("pivot").to_numpy(), rt.column("id").to_numpy(), rt.column("radius").to_numpy()
    near, maybe = [], []
    for i, j, d in near_pairs(lm, rm, reach + EPS):
        strange = own[i] != other[j]
        for found, ok in ((near, strange & (d <= LIMIT)), (maybe, strange & (d > LIMIT))):
            found.append(np.stack([i[ok], other[j[ok]]]))
    columns, any_of = [], np.zeros(len(lm), bool)
    for found in (near, maybe):
        i, b = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        order = np.argsort(i, kind="stable")
        counts = np.bincount(i, minlength=len(lm))
        any_of |= counts > 0
        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(b[order], pa.int64())))
    out = lt.select(["id", "pose", "home", "pivot"])
    for name, c in zip(("near", "maybe"), columns, strict=True):
        out = out.append_column(name, c)
    return out.filter(pa.array(any_of))


FACING = "id bigint, pose binary, home bigint, pivot bigint, near array<bigint>, maybe array<bigint>"


def _links(lt: pa.Table, lm: np.ndarray, rt: pa.Table, rm: np.ndarray) -> pa.Table:
    """Pairs of clusters, as joined so far, that have similar members; each once per call."""
    lp, rp = lt.column("whole").to_numpy(), rt.column("whole").to_numpy()
    found = [np.empty((0, 2), np.int64)]
    for i, j, _ in near_pairs(lm, rm, _limits(rm)):
        ok = lp[i] < rp[j]
        found.append(np.unique(np.stack([lp[i[ok]], rp[j[ok]]], axis=1), axis=0))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _one_each(matched: DataFrame) -> DataFrame:
    """The best of the parts in which a row's matches may have come."""
    best = F.min_by(F.struct("pivot", "far"), F.struct(F.col("pivot").isNull(), "far", "pivot"))
    return matched.groupBy("id").agg(F.first("pose").alias("pose"), F.first("home").alias("home"), best.alias("b")).select(
        "id", "pose", "home", F.col("b.pivot").alias("pivot"), F.col("b.far").alias("far")
    )


def _assign(points: DataFrame, pivots: DataFrame, tree: Tree) -> DataFrame:
    near = pivots.select("id", "pose", F.lit(LIMIT).alias("radius"))
    return meet(points.select("id", "pose", "home", F.col("home").alias("cell")), near, tree, _closest, CLOSEST, _one_each)


def pivot_clusters(points: DataFrame, tree: Tree) -> DataFrame:
    """``(id, pose, home, pivot, far)``: every point with its closest pivot. ``points`` is ``(id, pose, home)``, written."""
    n, turn, active, pivots = points.count(), 0, points, []
    hashed = F.xxhash64(F.lit(9), "id")
    while not active.isEmpty():
        share = min(1.0, FIRST * FASTER**turn / n)
        bound = int(share * 2**63)
        candidates = active.withColumn("hash", hashed).filter(F.shiftrightunsigned("hash", 1) < bound if share < 1 else F.lit(True))
        candidates = materialise(candidates, "candidates")
        left = candidates.select("id", "pose", "hash", F.col("home").alias("cell"))
        right = candidates.select("id", "pose", "hash", F.lit(LIMIT).alias("radius"))
        lost = meet(left, right, tree, _beaten, "id bigint")
        chosen = materialise(candidates.join(lost, "id", "left_anti").select("id", "pose", "home"), "pivots")
        pivots.append(chosen)
        matched = materialise(_assign(active, chosen, tree), "absorbed")
        active = matched.filter("pivot is null").select("id", "pose", "home")
        turn += 1
    every = pivots[0]
    for p in pivots[1:]:
        every = every.unionByName(p)
    return materialise(_assign(points, every, tree), "members")


def touching(members: DataFrame, sizes: DataFrame, tree: Tree) -> DataFrame:
    """``(a, b)``: pairs of pivots that join all clusters of which some members are similar.

    ``sizes`` is ``(pivot, n, far, least)``, one row per pivot; both are read several times.
    """
    reach = sizes.filter("n > 0").select(F.col("pivot").alias("id"), (F.col("far") + LIMIT).alias("radius"))
    pivots = members.filter("id = pivot").select("id", "pose").join(reach, "id")
    left = members.select("id", "pose", "home", "pivot", F.col("home").alias("cell"))
    facing = materialise(meet(left, materialise(pivots, "reach"), tree, _facing, FACING), "facing")
    sure = materialise(facing.select(F.col("pivot").alias("a"), F.explode("near").alias("b")).distinct(), "sure")
    joined = components(sure, "a", sure, "a", "b")
    whole = lambda name: joined.select(F.col("node").alias(name), F.col("component").alias(f"whole_{name}"))
    maybe = facing.select("pivot", F.explode("maybe").alias("b")).distinct()
    maybe = maybe.join(whole("pivot"), "pivot", "left").join(whole("b"), "b", "left")
    maybe = maybe.select("pivot", "b", F.coalesce("whole_pivot", "pivot").alias("whole"), F.coalesce("whole_b", "b").alias("other"))
    maybe = materialise(maybe.filter("whole <> other"), "maybe")
    if maybe.isEmpty():
        return sure
    # both sides of a pair must face each other
    at = facing.select("id", "pose", "home", "pivot", F.explode("maybe").alias("b")).join(sendable(maybe), ["pivot", "b"])
    border = materialise(at.groupBy("id").agg(*(F.first(c).alias(c) for c in ("pose", "home", "whole"))), "border")
    left = border.select("id", "pose", "whole", F.col("home").alias("cell"))
    right = border.select("id", "pose", "whole", F.lit(LIMIT).alias("radius"))
    return sure.unionByName(materialise(meet(left, right, tree, _links, "a bigint, b bigint").distinct(), "more"))


def clusters(records: DataFrame, least: int = 3) -> DataFrame:
    """``(id, pose, cluster_id)`` of every record in a cluster of at least ``least`` members, one row each.

    cluster_id is the cluster's smallest id; pose is packed into bytes.

    * null ids, null, short, non-finite and all-zero poses: left out; a record delivered again: once;
    * equal poses: similar, at distance 0; equal distances to two pivots: the lower id; empty input: no row;
    * further columns are not carried on.
    """
    with scratch(records.sparkSession):
        points = materialise(usable(records), "poses")
        tree = grown(points)
        points = placed(points, tree)
        if points.isEmpty():
            empty = points.select("id", "pose", F.col("id").alias("cluster_id"))
            return materialise(empty, "clusters", keep=True)
        members = pivot_clusters(points, tree)
        sizes = members.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far"), F.min("id").alias("least"))
        sizes = materialise(sizes, "sizes")
        links = touching(members, sizes, tree)
        joined = components(links, "a", links, "a", "b").withColumnsRenamed({"node": "pivot", "component": "whole"})
        whole = materialise(sizes.join(joined, "pivot", "left").withColumn("whole", F.coalesce("whole", "pivot")), "whole")
        of = whole.groupBy("whole").agg(F.min("least").alias("cluster_id"), F.sum("n").alias("size")).filter(F.col("size") >= least)
        named = materialise(whole.join(of, "whole").select("pivot", "n", "cluster_id"), "named")
        found = spread_join(members.select("id", "pose", "pivot"), named, "pivot", "n", "id")
        return materialise(found.select("id", "pose", "cluster_id"), "clusters", keep=True)


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster_id, n_members, medoid_id, typical_ids)``: the members with the least mean squared distance to all others.

    Those are the members closest to the cluster's mean, so no pair is compared; ties go to the lower id. ``members`` is
    read twice. A large cluster's members are spread where they meet its mean, and each task passes on only its best.
    """

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, m = scaled_poses(b.column("pose"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cluster_id"), lists(m)], ["id", "cluster_id", "v"])

    rows = members.select("id", "cluster_id", "pose").mapInArrow(scaled, "id bigint, cluster_id bigint, v array<double>")
    mean = rows.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_members"), F.array(*(F.avg(F.get("v", F.lit(i))) for i in range(VALUES))).alias("mean")
    )
    gap = F.aggregate(F.zip_with("v", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    met = spread_join(rows, materialise(mean, "means"), "cluster_id", "n_members", "id")
    near = met.select("cluster_id", "n_members", "id", F.round(gap, 12).alias("gap"))
    # the limit on the row number is applied before the rows travel, too
    order = Window.partitionBy("cluster_id").orderBy("gap", "id")
    few = near.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= typical)
    best = few.groupBy("cluster_id").agg(F.first("n_members").alias("n_members"), F.array_sort(F.collect_list(F.struct("gap", "id"))).alias("all"))
    return best.select(
        "cluster_id",
        "n_members",
        F.col("all")[0]["id"].alias("medoid_id"),
        F.array_join(F.transform(F.slice("all", 1, typical), lambda x: x["id"].cast("string")), ",").alias("typical_ids"),
    )
