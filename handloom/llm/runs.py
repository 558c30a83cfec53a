"""Repeated consecutive events: adjacent agglomeration.

The rows of a track are runs of one, in a linked list; a priority queue holds the neighbouring runs that may join, most
similar first, and merges go on until no neighbours meet the similarity and gap limits. Similarity of two runs is that of
the rows that touch, so a merge changes no other distance and the order of merges cannot change the result.

For the same reason a track can be cut: every ``SPAN`` frame numbers of a track are a group of their own, and only the
runs at a group's ends, which may go on, meet again a level up, ``SPAN`` groups at a time. No task ever holds a track.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from handloom.llm.poses import scaled_poses
from handloom.runtime import materialise

#: Bits of frame numbers, then of groups, that are taken together at a level.
SPAN_BITS = 12

RUN_SCHEMA = (
    "file string, hand string, grp bigint, first_idx bigint, last_idx bigint, n bigint, head array<double>, "
    "tail array<double>, open boolean"
)


def agglomerate(mergeable: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Start of the run of each of n items, from the n - 1 links between neighbours."""
    n = len(mergeable) + 1
    start, end = list(range(n)), list(range(n))  # of the run that ends, or starts, here
    links = np.nonzero(mergeable)[0]
    queue = list(zip(distance[links].tolist(), links.tolist(), strict=True))
    heapq.heapify(queue)
    while queue:
        _, i = heapq.heappop(queue)
        s, e = start[i], end[i + 1]
        end[s], start[e] = e, s
    out, at = np.empty(n, np.int64), 0
    while at < n:
        out[at : end[at] + 1] = at
        at = end[at] + 1
    return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = pc.list_flatten(column)
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _merged(table: pa.Table, limit: float, gap: int, bits: int, span: int, least: int) -> pa.RecordBatch:
    """Runs of the sorted runs in ``table``; groups (file, hand, grp) in it are whole.

    Runs of one group of the level below do not join here: they did not there, and others may have been between them.
    """
    first, last, n = (table.column(c).to_numpy() for c in ("first_idx", "last_idx", "n"))
    head, tail = _matrix(table.column("head").combine_chunks()), _matrix(table.column("tail").combine_chunks())
    keys = [table.column(c).combine_chunks() for c in ("file", "hand", "grp")]
    same = np.ones(max(len(first) - 1, 0), bool)
    for k in keys:
        code = pc.fill_null(k.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        same &= code[1:] == code[:-1]
    distance = np.sqrt(((tail[:-1] - head[1:]) ** 2).sum(axis=1))
    apart = (last[:-1] >> (bits - span)) != (first[1:] >> (bits - span))
    run = agglomerate(same & apart & (first[1:] - last[:-1] <= gap) & (distance <= limit), distance)
    starts = np.nonzero(run == np.arange(len(run)))[0]
    ends = np.append(starts[1:], len(run)) - 1
    begins, stops = np.append(True, ~same)[starts], np.append(~same, True)[ends]
    grp = keys[2].to_numpy()[starts]
    low, high = grp << bits, (grp + 1) << bits
    goes_on = (begins & (first[starts] - low < gap)) | (stops & (high - last[ends] <= gap))
    size = np.add.reduceat(n, starts)
    keep = goes_on | (size >= least)
    s, e = starts[keep], ends[keep]
    columns = [keys[0].take(pa.array(s)), keys[1].take(pa.array(s)), pa.array(grp[keep] >> span), pa.array(first[s]), pa.array(last[e]), pa.array(size[keep])]
    lists = [pa.ListArray.from_arrays(np.arange(len(s) + 1, dtype=np.int32) * m.shape[1], m.ravel()) for m in (head[s], tail[e])]
    return pa.RecordBatch.from_arrays(
        [*columns, *lists, pa.array(goes_on[keep])],
        ["file", "hand", "grp", "first_idx", "last_idx", "n", "head", "tail", "open"],
    )


def _whole_groups(batches: Iterator[pa.RecordBatch], prepare: Callable[[pa.RecordBatch], pa.Table]) -> Iterator[pa.Table]:
    """Batches of a sorted partition as tables that end where a group ends; the last group waits for the next batch."""
    held: list[pa.Table] = []
    for batch in batches:
        t = prepare(batch)
        if not t.num_rows:
            continue
        last = [t.column(c)[t.num_rows - 1] for c in ("file", "hand", "grp")]
        inside = None
        for c, v in zip(("file", "hand", "grp"), last, strict=True):
            eq = pc.fill_null(pc.equal(t.column(c), v), False) if v.is_valid else pc.is_null(t.column(c))
            inside = eq if inside is None else pc.and_(inside, eq)
        cut = pc.index(inside, True).as_py()
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = [t.slice(cut)]
        elif held and all(held[-1].column(c)[held[-1].num_rows - 1] == v for c, v in zip(("file", "hand", "grp"), last, strict=True)):
            held.append(t)
        else:
            if held:
                yield pa.concat_tables(held)
            held = [t]
    if held:
        yield pa.concat_tables(held)


def _level(runs: DataFrame, prepare, limit: float, gap: int, bits: int, least: int) -> DataFrame:
    sorted_runs = runs.repartition("file", "hand", "grp").sortWithinPartitions("file", "hand", "grp", "first_idx")

    span = SPAN_BITS

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches, prepare):
            yield _merged(t, limit, gap, bits, span, least)

    return sorted_runs.mapInArrow(work, RUN_SCHEMA)


def _as_runs(states: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> Callable[[pa.RecordBatch], pa.Table]:
    """Rows ``(file, hand, grp, first_idx, state)`` as runs of one; ``states`` says which are usable, and their vectors."""

    def prepare(batch: pa.RecordBatch) -> pa.Table:
        ok, m = states(batch.column("state"))
        t = pa.Table.from_batches([batch]).filter(pa.array(ok))
        lists = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], m.ravel())
        idx = t.column("first_idx")
        return pa.table(
            {"file": t.column("file"), "hand": t.column("hand"), "grp": t.column("grp"), "first_idx": idx, "last_idx": idx, "n": pa.array(np.ones(len(m), np.int64)), "head": lists, "tail": lists}
        )

    return prepare


def _same(batch: pa.RecordBatch) -> pa.Table:
    return pa.Table.from_batches([batch])


def collapse(rows: DataFrame, states, limit: float, gap: int, least: int) -> DataFrame:
    """``(file, hand, first_idx, last_idx, n)`` of every maximal run of at least ``least`` rows.

    ``rows`` has ``file, hand, frame_idx, state``, each (file, frame_idx) once. A row joins the one before it in its track
    if it comes at most ``gap`` frame numbers later and their states are at most ``limit`` apart.

    * a null file is a file, rows with a null hand, frame_idx or state are to be left out before; empty input: no row;
    * equal distances: any order of merging gives the same runs.
    """
    start = rows.select("file", "hand", F.shiftright("frame_idx", SPAN_BITS).alias("grp"), F.col("frame_idx").alias("first_idx"), "state")
    level = materialise(_level(start, _as_runs(states), limit, gap, SPAN_BITS, least), "runs")
    out = ["file", "hand", "first_idx", "last_idx", "n"]
    done, bits = [], SPAN_BITS
    while True:
        done.append(level.filter("not open").select(*out))
        waiting = level.filter("open")
        # grp is that of the next level already: one group left in each track means nothing more can meet
        deep = waiting.groupBy("file", "hand").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty()
        if deep or bits > 62 - SPAN_BITS:
            done.append(waiting.select(*out))
            break
        bits += SPAN_BITS
        level = materialise(_level(waiting.drop("open"), _same, limit, gap, bits, least), "runs")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    return found.filter(F.col("n") >= least)


def numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """States that are single numbers: equal or not."""
    v = column.to_numpy(zero_copy_only=False).astype(np.float64)
    return np.ones(len(v), bool), v[:, None]


poses = scaled_poses


def usable_pose(pose: str) -> Column:
    """63 finite values, landmark 9 (values 28 to 30, from 1) having a length."""
    inside = (F.array_max(pose) < float("inf")) & (F.array_min(pose) > float("-inf"))  # NaN counts as the greatest
    unit = F.get(pose, F.lit(27)) != 0
    for i in (28, 29):
        unit |= F.get(pose, F.lit(i)) != 0
    return F.coalesce((F.size(pose) == 63) & (F.size(F.array_compact(pose)) == 63) & inside & unit, F.lit(False))


def single_poses(frames: DataFrame) -> DataFrame:
    """``(file, frame_idx, hand, state)`` of unmirrored frames with a usable pose and finite vectors, each (file, frame_idx) once.

    hand is L if (x_vec x y_vec) . z_vec < 0, else R. Of differing copies of a frame that are usable the one with the least
    hash counts.
    """
    vectors = ("x_vec", "y_vec", "z_vec")
    x, y, z = ([F.get(v, F.lit(i)).cast("double") for i in range(3)] for v in vectors)
    d = (x[1] * y[2] - x[2] * y[1]) * z[0] + (x[2] * y[0] - x[0] * y[2]) * z[1] + (x[0] * y[1] - x[1] * y[0]) * z[2]
    good = usable_pose("aligned")
    for v in [*x, *y, *z]:
        good &= v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    for v in vectors:
        good &= F.size(v) == 3
    return (
        frames.filter(~F.coalesce("is_mirror", F.lit(False)) & F.col("frame_idx").isNotNull())
        .filter(good)
        .select("file", "frame_idx", F.when(d < 0, "L").otherwise("R").alias("hand"), F.col("aligned").alias("state"))
        .groupBy("file", "frame_idx")
        .agg(F.min_by(F.struct("hand", "state"), F.xxhash64("hand", "state")).alias("p"))
        .select("file", "frame_idx", F.col("p.hand").alias("hand"), F.col("p.state").alias("state"))
    )
