"""Recordings as frames: ``file, frame_idx, aligned, x_vec, y_vec, z_vec, is_mirror``."""

from __future__ import annotations

import fnmatch
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from handloom.sources.cache import cached, files_key

SCHEMA = (
    "file string, frame_idx bigint, aligned array<float>, x_vec array<float>, y_vec array<float>, z_vec array<float>, is_mirror boolean"
)
#: Frames that are read from a file at a time.
BATCH_ROWS = 4096


def single(frames: DataFrame, *keys: str) -> DataFrame:
    """Each key once; rows with a null key are left out. Copies of a row are equal, so any of them stands for all."""
    return frames.filter(" and ".join(f"{k} is not null" for k in keys)).dropDuplicates(list(keys))


def unmirrored(frames: DataFrame) -> DataFrame:
    """Frames not flagged as mirrored; recordings without the flag stay whole."""
    return frames.filter(~F.coalesce("is_mirror", F.lit(False)))


def oriented(frames: DataFrame) -> DataFrame:
    """Frames with a pose and all three vectors."""
    return frames.filter("aligned is not null and x_vec is not null and y_vec is not null and z_vec is not null")


def file_meta(frames: DataFrame) -> DataFrame:
    """``(file, n_frames)`` of unmirrored frames."""
    return unmirrored(frames).groupBy("file").agg(F.count(F.lit(1)).alias("n_frames"))


class H5Partition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class H5Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = {k.lower(): v for k, v in options.items()}
        self.where, self.most = given["path"], int(given.get("maxfiles", "0"))

    def partitions(self) -> list[InputPartition]:
        found = h5_paths(self.where)
        return [H5Partition(p) for p in (found[: self.most] if self.most and os.path.isdir(self.where) else found)]

    def read(self, partition: H5Partition):
        import h5py

        with h5py.File(partition.path, "r") as f:
            if "aligned_63d" not in f:
                return
            for start in range(0, len(f["aligned_63d"]), BATCH_ROWS):
                yield _batch(f, os.path.basename(partition.path), start)


def _batch(f, name: str, start: int) -> pa.RecordBatch:
    """Rows of an open file from ``start`` on, one slice of each dataset; datasets it lacks give nulls."""
    end = min(start + BATCH_ROWS, len(f["aligned_63d"]))
    n, columns = end - start, []
    for dataset, width in (("aligned_63d", 63), ("x_vec", 3), ("y_vec", 3), ("z_vec", 3)):
        if dataset in f:
            values = np.ascontiguousarray(f[dataset][start:end], np.float32)
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
            columns.append(pa.ListArray.from_arrays(ends, pa.array(values.ravel())))
        else:
            columns.append(pa.nulls(n, pa.list_(pa.float32())))
    flags = pa.array(np.asarray(f["is_mirror"][start:end], bool)) if "is_mirror" in f else pa.nulls(n, pa.bool_())
    frames = pa.array(np.arange(start, end, dtype=np.int64))
    return pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), frames, *columns, flags], [c.split()[0] for c in SCHEMA.split(", ")])


class H5Source(DataSource):
    """``spark.read.format("hand_h5").load(path)``: one task per HDF5 file; needs h5py on the executors."""

    @classmethod
    def name(cls) -> str:
        return "hand_h5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return H5Reader(dict(self.options))


def h5_paths(where: str) -> list[str]:
    """Sorted paths of a pattern, a file, or a folder's own ``*.h5``; FileNotFoundError if there are none."""
    import glob

    if "*" in where or "?" in where:
        found = sorted(glob.glob(where))
    elif os.path.isfile(where):
        found = [where]
    else:
        found = sorted(os.path.join(where, n) for n in (os.listdir(where) if os.path.isdir(where) else ()) if fnmatch.fnmatch(n, "*.h5"))
    if not found:
        raise FileNotFoundError(where)
    return found


def load(spark: SparkSession, where: str, cache: str | None = None) -> DataFrame:
    """Frames of a Parquet table or of HDF5 files, mirrored ones left out.

    With ``cache``, a folder that all executors share, they are kept there as Parquet and read from it the next time,
    unless a file of ``where`` has changed since.
    """
    if cache:
        return cached(spark, cache, files_key(spark, where, "frames"), lambda: load(spark, where))
    if where.rstrip("/").endswith(".parquet"):
        return unmirrored(spark.read.parquet(where))
    spark.dataSource.register(H5Source)
    return unmirrored(spark.read.format("hand_h5").load(where))
