"""Many tiny files into few of good size, none of their records lost or doubled.

Write: one row per record key, spread by an adaptive REBALANCE: rows are shuffled by recording, and the sizes seen at
run time merge small output partitions and split large ones near the target size, so neither a hot recording nor a
thousand small ones make bad files. Only frames that several files hold are grouped with their poses; all others travel
once, in the rebalancing. Commit: the multiset checksum of what was written, read back from the files, must
equal that of the input, which another job derives from the tiny files without the write. Only then does the commit row
appear that readers go by; a write that broke off is never seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handloom.runtime import materialise, sendable
from handloom.sources.tiny_files import frames_of

KEYS = ["file", "frame_idx"]
#: Target size of an output partition in bytes of shuffle data.
TARGET_BYTES = 128 << 20
COMMITS = "commits"


def _preferred(payload):
    """The copy of a record that counts: one that says whether it is mirrored, then the latest, then the lowest id."""
    return F.max_by(payload, F.struct(F.col("is_mirror").isNotNull(), "delivered_at", -F.col("path_id")))


def single_frames(frames: DataFrame) -> DataFrame:
    """``(file, frame_idx, aligned, is_mirror, n_holders)``: each frame once, with the number of files holding it."""
    picked = frames.groupBy(*KEYS).agg(
        _preferred(F.struct("aligned", "is_mirror")).alias("p"), F.count(F.lit(1)).alias("n_holders")
    )
    return picked.select(*KEYS, F.col("p.aligned").alias("aligned"), F.col("p.is_mirror").alias("is_mirror"), "n_holders")


def held(frames: DataFrame) -> DataFrame:
    """What ``single_frames`` must give, with hashes in place of poses, from another aggregation: poses do not travel."""
    body = F.xxhash64("aligned").alias("body")
    slim = frames.select(*KEYS, body, "is_mirror", "delivered_at", "path_id")
    picked = slim.groupBy(*KEYS).agg(
        _preferred(F.struct("body", "is_mirror")).alias("p"), F.count(F.lit(1)).alias("n_holders")
    )
    return picked.select(*KEYS, F.col("p.body").alias("body"), F.col("p.is_mirror").alias("is_mirror"), "n_holders")


def gathered(frames: DataFrame, expected: DataFrame) -> DataFrame:
    """``single_frames``, but only frames with several holders are grouped. ``expected`` is what ``held`` gives, written."""
    contested = sendable(expected.filter("n_holders > 1").select(*KEYS))
    alone = frames.join(contested, KEYS, "left_anti").select(*KEYS, "aligned", "is_mirror", F.lit(1).cast("bigint").alias("n_holders"))
    return alone.unionByName(single_frames(frames.join(contested, KEYS, "left_semi")))


def written_checksum(rows: DataFrame) -> tuple[int, int, int]:
    return _digest(rows.select(*KEYS, F.xxhash64("aligned").alias("body"), "is_mirror", "n_holders"))


def _digest(rows: DataFrame) -> tuple[int, int, int]:
    """Rows, sum and xor of row hashes: equal for equal multisets, whatever the order."""
    h = F.xxhash64("file", "frame_idx", "body", "is_mirror", "n_holders")
    n, total, xor = rows.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(h.cast("decimal(20,0)")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0))
    ).first()
    return int(n), int(total), int(xor)


class ChecksumMismatch(RuntimeError):
    """What was written is not what the tiny files hold; nothing was committed."""


def compact(files: DataFrame, target: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write the frames of ``files`` under ``target`` and return the committed table.

    * null file or start: taken from the path, rows that have neither there are left out;
    * null entries, empty and broken-off files: the frames that are there count;
    * frames in several files: once, with ``n_holders`` files; equal candidates tie on the lowest path_id;
    * empty input: an empty committed table; further columns of ``files`` are not carried on.
    """
    spark = files.sparkSession
    if spark.conf.get("spark.sql.adaptive.enabled") != "true":
        raise RuntimeError("REBALANCE needs spark.sql.adaptive.enabled: without it partitions are neither merged nor split")
    frames = frames_of(files)
    run = uuid.uuid4().hex
    data = f"{target}/data-{run}"
    expected = materialise(held(frames), "held")
    once = gathered(frames, expected)
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(target_bytes))  # of the session: queries that run in it meanwhile see it too
    try:
        once.hint("rebalance", "file").sortWithinPartitions(*KEYS).write.parquet(data)
    finally:
        spark.conf.set(name, before)
    table = spark.read.schema(once.schema).parquet(data)
    want, have = _digest(expected), written_checksum(table)
    if want != have:
        raise ChecksumMismatch(f"expected {want}, found {have} in {data}")
    commit = [(run, data, *map(str, have))]
    spark.createDataFrame(commit, "run string, data string, n string, total string, digest string").coalesce(1).write.mode(
        "append"
    ).parquet(f"{target}/{COMMITS}")
    return table


def committed(spark: SparkSession, target: str) -> DataFrame:
    """All committed rows under ``target``; data of writes that did not commit is not read."""
    paths = [r.data for r in spark.read.parquet(f"{target}/{COMMITS}").select("data").collect()]
    return spark.read.parquet(*paths)


def frames_in_several_files(table: DataFrame) -> DataFrame:
    return table.filter("n_holders > 1").select(*KEYS)
