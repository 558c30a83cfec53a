"""Tables kept from one run to the next, as Parquet named by what they were made of."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_key(spark: SparkSession, where: str, *more: object) -> str:
    """A name for the files at a path or pattern: it changes with their names, sizes and times, and with ``more``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for status in fs.globStatus(path) or []:
        for f in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return _name(sorted(found), *more)


def rows_key(df: DataFrame, *more: object) -> str:
    """A name for the rows of a table, whatever their order: it changes with any value in them, and with ``more``."""
    h = F.xxhash64(*df.columns)
    n, low, high = df.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first()
    return _name(df.schema.simpleString(), n, low, high, *more)


def _name(*parts: object) -> str:
    return hashlib.md5(repr(parts).encode(), usedforsecurity=False).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``key``, made and written first if it is not there whole."""
    path = f"{folder.rstrip('/')}/{key}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
