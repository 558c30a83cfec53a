"""From landmarks to angles, codes, cosines, hands and bases. One DataFrame in, one out; poses are 63 values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from handloom.functions import vec
from handloom.functions.codes import BEND_BITS

#: Landmarks of the bending angles, the vertex in the middle.
BENDING = [(2, 3, 4), (5, 6, 7), (6, 7, 8), (9, 10, 11), (10, 11, 12), (13, 14, 15), (14, 15, 16), (17, 18, 19), (18, 19, 20)]
#: Landmarks of the unsigned spread angles, seen from the origin.
SPREAD = [(6, 10), (10, 14), (14, 18)]
#: Landmarks of the signed spread angle, seen from landmark 0: thumb, index, little finger.
SIGNED = (3, 6, 18)
#: States overlap; a state holds its lower bound, not its upper.
BENDING_STATES = [(0.0, 60.0), (30.0, 90.0), (60.0, 120.0), (90.0, 150.0), (120.0, 180.0)]
SPREAD_STATES = [(0.0, 15.0), (7.5, 22.5), (15.0, 30.0), (22.5, 37.5), (30.0, 60.0)]
#: The chain of each finger starts at the wrist.
FINGERS = [1, 5, 9, 13, 17]
N_ANGLES, N_STATES = 13, 5


def _added(df: DataFrame, make: Callable[[pa.RecordBatch], list[pa.Array]], fields: str) -> DataFrame:
    """``df`` with the columns that ``make`` gives for a batch; they replace columns of the same names.

    Thirteen angles and 66 bits as column expressions outgrow what the JVM compiles into one method and take seconds to
    plan, and filters pushed into them repeat them; over Arrow batches they are a few array operations.
    """
    new = StructType.fromDDL(fields)
    taken = {f.name.lower() for f in new}
    old = [f for f in df.schema if f.name.lower() not in taken]
    names = [f.name for f in old]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *make(b)], [*names, *new.fieldNames()])

    return df.mapInArrow(work, StructType([*old, *new]))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; a null row, a null entry or another length gives NaN."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    out = np.full((len(column), width), np.nan)
    flat = pc.list_flatten(column.filter(fits)).to_numpy(zero_copy_only=False)
    out[fits.to_numpy(zero_copy_only=False).astype(bool)] = flat.astype(np.float64).reshape(-1, width)
    return out


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = m.ravel()
    values = pa.array(flat.astype(kind.to_pandas_dtype()), kind, mask=np.isnan(flat))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), values)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1] + a[..., 2] * b[..., 2]


def _norm(a: np.ndarray) -> np.ndarray:
    return np.sqrt(_dot(a, a))


def _unit(a: np.ndarray, eps: float) -> np.ndarray:
    return a / (_norm(a) + eps)[..., None]


def _degrees(cosine: np.ndarray) -> np.ndarray:
    out = np.degrees(np.arccos(np.clip(cosine, -1.0, 1.0)))
    return np.where(np.isfinite(out), out, np.nan)


def thetas(poses: np.ndarray) -> np.ndarray:
    """13 angles of each of n poses of 63 values; NaN where a landmark is not finite."""
    with np.errstate(all="ignore"):
        at = poses.reshape(-1, 21, 3)
        a, b, c = (at[:, [t[i] for t in BENDING]] for i in range(3))
        u, v = a - b, c - b
        bends = _degrees(_dot(u, v) / (_norm(u) * _norm(v) + 1e-12))
        thumb, index, little = (_unit(at[:, m] - at[:, 0], 1e-8) for m in SIGNED)
        side = _dot(np.cross(thumb, index), np.cross(index, little))
        signed = np.where(side >= 0, 1.0, -1.0) * _degrees(_dot(index, thumb))
        p, q = (at[:, [t[i] for t in SPREAD]] for i in range(2))
        spreads = _degrees(_dot(p, q) / (_norm(p) * _norm(q) + 1e-12))
    return np.hstack([bends, signed[:, None], spreads])


def code_bits(theta: np.ndarray) -> np.ndarray:
    """66 bits of each row of angles; NaN sets none."""
    n = len(BENDING)
    parts = []
    for x, states in ((theta[:, :n], BENDING_STATES), (theta[:, n:], SPREAD_STATES)):
        low, high = np.array(states).T
        parts.append(((x[:, :, None] >= low) & (x[:, :, None] < high)).reshape(len(x), -1))
    return np.hstack([*parts, (theta[:, n] < 0)[:, None]])


def _code_columns(theta: np.ndarray) -> list[pa.Array]:
    bits = code_bits(theta)
    size = bits.shape[1]
    text = pa.py_buffer((bits.astype(np.uint8) + ord("0")).tobytes())
    ends = pa.py_buffer((np.arange(len(bits) + 1, dtype=np.int32) * size).tobytes())
    bend = bits[:, :BEND_BITS] @ (np.int64(1) << np.arange(BEND_BITS, dtype=np.int64))
    spread = bits[:, BEND_BITS:] @ (np.int64(1) << np.arange(size - BEND_BITS, dtype=np.int64))
    return [pa.StringArray.from_buffers(len(bits), ends, text), pa.array(bend.astype(np.int64)), pa.array(spread.astype(np.int64))]


CODE_FIELDS = "code string, m_bend bigint, m_spread bigint"


def with_theta(df: DataFrame, pose: str = "aligned", name: str = "theta") -> DataFrame:
    """``df`` with 13 angles in degrees; an angle is null where a landmark it needs is missing or not finite.

    A bone without length makes an angle of 90. Angles are computed in double.
    """
    return _added(df, lambda b: [_lists(thetas(_matrix(b.column(pose), 63)), pa.float64())], f"{name} array<double>")


def with_code(df: DataFrame, theta: str = "theta") -> DataFrame:
    """``df`` with ``code``, ``m_bend`` and ``m_spread`` of 13 angles. A null angle sets no bit."""
    return _added(df, lambda b: _code_columns(_matrix(b.column(theta), N_ANGLES)), CODE_FIELDS)


def with_theta_and_code(df: DataFrame, pose: str = "aligned") -> DataFrame:
    """Both in one pass."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        theta = thetas(_matrix(b.column(pose), 63))
        return [_lists(theta, pa.float64()), *_code_columns(theta)]

    return _added(df, make, f"theta array<double>, {CODE_FIELDS}")


def out_of_range(theta: str = "theta") -> Column:
    """How many angles of a row lie outside the range of their states."""
    bad = F.lit(0)
    for i in range(N_ANGLES):
        x = F.get(theta, F.lit(i))
        top = (BENDING_STATES if i < len(BENDING) else SPREAD_STATES)[-1][1]
        bad = bad + F.coalesce(((x < 0) | (x > top)).cast("int"), F.lit(0))
    return bad


def bone_cosines(poses: np.ndarray) -> np.ndarray:
    """15 cosines between following bones of each of n poses; 0 where a bone has no length, NaN where not finite."""
    with np.errstate(all="ignore"):
        at = poses.reshape(-1, 21, 3)
        chains = at[:, [[0, f, f + 1, f + 2, f + 3] for f in FINGERS]]
        bones = np.diff(chains, axis=2)
        u, v = bones[:, :, :-1], bones[:, :, 1:]
        size = _norm(u) * _norm(v)
        return np.clip(_dot(u, v) / np.where(size > 1e-8, size, 1.0), -1.0, 1.0).reshape(len(poses), -1)


def with_bone_cosines(df: DataFrame, pose: str = "aligned", name: str = "cosines") -> DataFrame:
    """``df`` with 15 cosines between following bones, float; null for null, short and non-finite poses."""
    return _added(df, lambda b: [_lists(bone_cosines(_matrix(b.column(pose), 63)), pa.float32())], f"{name} array<float>")


def hand(x_vec: str = "x_vec", y_vec: str = "y_vec", z_vec: str = "z_vec") -> Column:
    """L if (x cross y) . z is negative, R if not, null if it is not a number."""
    x, y, z = (vec.vector(F.col(c)) for c in (x_vec, y_vec, z_vec))
    d = vec.number(vec.dot(vec.cross(x, y), z))
    return F.when(d < 0, "L").when(d >= 0, "R")


REQUIRED = ("label", "aligned", "x_vec", "y_vec", "z_vec")


def swap_hands(df: DataFrame, strict: bool = False) -> DataFrame:
    """The mirrored hand: x_vec negated as a whole, label L for R and R for L, all else passed through; other columns go.

    A missing column raises KeyError. A label other than L and R, or a pose that is not of 63 values, gives no row;
    with ``strict`` it fails the job.
    """
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise KeyError(f"columns missing: {', '.join(missing)}")
    good = F.coalesce(F.col("label").isin("L", "R"), F.lit(False)) & F.coalesce(F.size("aligned") == 63, F.lit(False))
    if strict:
        df = df.withColumn("label", F.when(good, F.col("label")).otherwise(F.raise_error(F.lit("label must be L or R, pose of 63 values"))))
    else:
        df = df.filter(good)
    rest = [c for c in df.columns if c not in REQUIRED]
    return df.select(
        *rest,
        F.when(F.col("label") == "L", "R").otherwise("L").alias("label"),
        "aligned",
        F.transform("x_vec", lambda v: -v).alias("x_vec"),
        "y_vec",
        "z_vec",
    )


def flip_handedness(raw: Column) -> Column:
    """The detector sees a mirrored image: its Right is Left, all else is Right."""
    return F.when(raw == "Right", "Left").otherwise("Right")


def basis(points: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit x, y and z of n poses (n, 21, 3): z is the palm's normal, y points along the hand.

    For right hands z and x are turned round, which makes the basis left-handed; labels by ``hand`` are thus the opposite.
    """
    with np.errstate(all="ignore"):
        turn = np.where(right, -1.0, 1.0)[:, None]
        wrist = points[:, 0]
        z = _unit(np.cross(points[:, 5] - wrist, points[:, 17] - wrist), 1e-8) * turn
        x = _unit(np.cross(_unit(points[:, 9] - wrist, 1e-8), z), 1e-8)
        return x * turn, _unit(np.cross(z, x), 1e-8), z


def _is_right(column: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.equal(column, "Right"), False).to_numpy(zero_copy_only=False).astype(bool)


def with_basis(df: DataFrame, pose: str, handedness: str) -> DataFrame:
    """``df`` with the vectors ``x_vec, y_vec, z_vec`` of a centred pose."""

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        points = _matrix(b.column(pose), 63).reshape(-1, 21, 3)
        return [_lists(v, pa.float64()) for v in basis(points, _is_right(b.column(handedness)))]

    return _added(df, make, "x_vec array<double>, y_vec array<double>, z_vec array<double>")


def align(df: DataFrame, landmarks: str, handedness: str, width: str, height: str) -> DataFrame:
    """``df`` with ``aligned``, the basis and ``wrist_px`` of raw landmarks (63 values, landmark-major).

    Centred on landmark 0, divided by the length of landmark 9 if it has one, turned into the basis; outputs are float.
    """

    def make(b: pa.RecordBatch) -> list[pa.Array]:
        raw = _matrix(b.column(landmarks), 63).reshape(-1, 21, 3)
        w, h = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (width, height))
        with np.errstate(all="ignore"):
            points = raw - raw[:, :1]
            far = _norm(points[:, 9])
            points = points / np.where(far > 0, far, 1.0)[:, None, None]
            axes = basis(points, _is_right(b.column(handedness)))
            turned = np.stack([_dot(points, v[:, None]) for v in axes], axis=2)
        wrist = raw[:, 0] * np.stack([w, h, w], axis=1)
        return [_lists(m, pa.float32()) for m in (wrist, turned.reshape(-1, 63), *axes)]

    kinds = ", ".join(f"{n} array<float>" for n in ("wrist_px", "aligned", "x_vec", "y_vec", "z_vec"))
    return _added(df, make, kinds)


def state_names(code: Column, angle: int) -> Column:
    """The intervals whose bits are set for an angle of a code, or N/A."""
    bending = angle < len(BENDING)
    names = [f"{lo:.0f}-{hi:.0f}" if bending else f"{lo:.1f}-{hi:.1f}" for lo, hi in (BENDING_STATES if bending else SPREAD_STATES)]
    have = F.filter(
        F.array(*(F.when(F.substring(code, angle * N_STATES + s + 1, 1) == "1", F.lit(n)) for s, n in enumerate(names))),
        lambda x: x.isNotNull(),
    )
    return F.when(F.size(have) == 0, F.lit("N/A")).otherwise(F.array_join(have, "|"))


def all_state_names(code: Column) -> tuple[Column, Column]:
    """Intervals of the nine bending and the four spread angles, angles set apart by semicolons."""
    n = len(BENDING)
    return (
        F.concat_ws(";", *(state_names(code, i) for i in range(n))),
        F.concat_ws(";", *(state_names(code, i) for i in range(n, N_ANGLES))),
    )
