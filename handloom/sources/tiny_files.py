"""Frames from deliveries of tiny files: one input row is one file that holds consecutive frames of a recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a path names the recording, and where it holds the number of the first frame.
RECORDING = r"(?i)(file_crop---[a-z0-9]{10})"
START = r"(?i)(?:part-|__)(\d+)"


def recording_of(file: Column, path: Column) -> Column:
    """The recording's name in lower case, ``file_crop---xxxxxxxxxx.h5``; null if neither file nor path has it."""
    named = F.nullif(F.regexp_extract(path, RECORDING, 1), F.lit(""))
    return F.lower(F.coalesce(file, F.concat(named, F.lit(".h5"))))


def start_of(start_idx: Column, path: Column) -> Column:
    return F.coalesce(start_idx, F.regexp_extract(path, START, 1).try_cast("bigint"))


def frames_of(files: DataFrame) -> DataFrame:
    """``(file, frame_idx, aligned, is_mirror, path_id, delivered_at)``, one row per frame that a file holds.

    The announced ``n_rows`` is not used: a broken-off file has the frames it has. Null entries, empty files and rows
    of which neither recording nor start is known give no frame. is_mirror is null where the file lacks it.
    """
    each = files.select(
        recording_of(F.col("file"), F.col("path")).alias("file"),
        start_of(F.col("start_idx"), F.col("path")).alias("start"),
        "path_id",
        "delivered_at",
        "is_mirror",
        F.posexplode("aligned_63d").alias("pos", "aligned"),
    )
    return each.filter("file is not null and start is not null and aligned is not null").select(
        "file",
        (F.col("start") + F.col("pos")).alias("frame_idx"),
        "aligned",
        F.get("is_mirror", F.col("pos")).alias("is_mirror"),
        "path_id",
        "delivered_at",
    )
