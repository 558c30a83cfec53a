"""Running totals over orders that are too long for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from handloom.runtime import free_name, materialise

#: Rows of an order that are sorted in one place, roughly.
RANGE_ROWS = 1 << 16


def buckets(rows: int) -> int:
    """A power of two, so that each of so many buckets has about RANGE_ROWS rows or fewer."""
    return 1 << max(0, (rows // RANGE_ROWS).bit_length())


def ranged(df: DataFrame, order: list[Column], name: str = "range") -> DataFrame:
    """``df``, written, with the number of a row's range in ``order``: ranges of sampled bounds hold about as many rows each.

    ``df`` is read three times: pass it materialised.
    """
    return materialise(df.repartitionByRange(buckets(df.count()), *order).withColumn(name, F.spark_partition_id()), "ranges")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: the number of a row in ``order``, from 0. ``order`` must be total. ``df`` is read three times."""
    at, one = free_name([*df.columns, name], "range"), free_name([*df.columns, name], "one")
    rows = ranged(df.withColumn(one, F.lit(1)), order, at)
    return running_total(rows, [], F.col(at), order, one, name).drop(at, one)


def running_total(
    df: DataFrame, by: list[str], bucket: Column, order: list[Column], value: str, name: str, whole: str | None = None
) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows before this one, within ``by``. With ``whole``: over all of ``by``.

    ``bucket`` must grow with ``order``: rows of a lower bucket come first. Buckets are summed (combined map-side), the
    sums are summed up per ``by`` - as many rows as there are buckets - and rows are ordered only within their bucket.
    ``order`` must be total, else rows that tie get any of their places. Null values count as 0, null keys are keys.
    ``df`` is read twice.
    """
    b, part, base = (free_name(df.columns, c) for c in ("bucket", "part", "base"))
    # one column, so that a null key equals itself, and that a partitioning by ``by`` alone, which an earlier join may
    # have left, does not do for the window: rows are sent out by bucket whatever lies below
    cut = df.withColumn(b, F.struct(F.struct(F.lit(0).alias("_"), *by).alias("by"), bucket.alias("at")))
    sums = cut.groupBy(b).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias(part))
    one = Window.partitionBy(f"{b}.by")
    before = one.orderBy(f"{b}.at").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(b, F.coalesce(F.sum(part).over(before), F.lit(0)).alias(base), *([F.sum(part).over(one).alias(whole)] if whole else []))
    within = Window.partitionBy(b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = cut.repartition(b).withColumn(part, F.coalesce(F.sum(F.coalesce(F.col(value), F.lit(0))).over(within), F.lit(0)))
    return ranked.join(bases, b).withColumn(name, F.col(base) + F.col(part)).drop(b, part, base)
