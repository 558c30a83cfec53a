"""Where intermediate tables live, how lineage is cut, and joins that keep to their time when a key is hot."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that may be sent to all tasks. Wider rows than some 100 bytes ask for fewer.
SMALL_ROWS = 100_000
#: Rows of a key that one task takes in a join; keys with more are spread.
HOT_ROWS = 1 << 16

_local = threading.local()


def _scratches() -> list[list[str]]:
    """Of this thread, the tables of every ``scratch`` that is open, the innermost last."""
    if not hasattr(_local, "open"):
        _local.open = []
    return _local.open


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local master may do without the setting."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not there:
        there = spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-"))
        there = spark.sparkContext.getCheckpointDir()
    return there.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; all intermediate tables are in it."""
    return f"{shared_dir(spark)}/handloom/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if _scratches():
        _scratches()[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is; one that is not there is no error."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results that were not read yet cannot be read any more."""
    remove(spark, run_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those that were made with ``keep``."""
    _scratches().append([])
    try:
        yield
    finally:
        for path in _scratches().pop():
            remove(spark, path)


def materialise(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and return the written table.

    Unlike ``checkpoint()`` the plan runs once only, and what comes back is columnar with statistics.
    A lost executor costs nothing: the files are not on it. With ``keep`` the table outlives the innermost ``scratch``.
    """
    spark = df.sparkSession
    path, opened = fresh_path(spark, label), _scratches()
    if keep and opened:
        opened[-1].remove(path)
        if len(opened) > 1:
            opened[-2].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sendable(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked to be sent to all tasks if it has at most ``most`` rows, else as it is: the join then shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def spread_join(rows: DataFrame, per_key: DataFrame, key: str, n: str, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``per_key`` (one row per key) on ``key``, rows of a hot key in as many tasks as they need.

    ``n`` names the column of ``per_key`` with the key's number of rows in ``rows``. Rows of a key with more than
    HOT_ROWS are spread by the hash of ``by``, and that key's one row is repeated for every part. ``per_key`` is read
    several times: pass it materialised. Null keys match nothing.
    """
    most = HOT_ROWS
    while (hot := per_key.filter(F.col(n) > most).select(key, F.ceil(F.col(n) / most).cast("int").alias("parts"))).limit(
        SMALL_ROWS + 1
    ).count() > SMALL_ROWS:
        most *= 2
    if hot.isEmpty():
        return rows.join(per_key, key, how)
    parts, part = free_name(rows.columns + per_key.columns, "parts"), free_name(rows.columns + per_key.columns, "part")
    hot = F.broadcast(hot.withColumnRenamed("parts", parts))  # at most SMALL_ROWS keys
    many = F.coalesce(F.col(parts), F.lit(1))
    left = rows.join(hot, key, "left").withColumn(part, F.pmod(F.xxhash64(by), many).cast("int")).drop(parts)
    right = per_key.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), many - 1))).drop(parts)
    return left.join(right, [key, part], how).drop(part)


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or ``wanted`` with underscores in front until no column has that name (case ignored)."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = "_" + wanted
    return wanted


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
