"""Per-key results when a few keys hold most rows: exact offset chunking.

1. Count the rows of every key in every input partition (one scan, combined map-side).
2. Prefix-sum those counts: the number of the first row of each (key, partition).
3. Number the rows: offset + position of the row in its partition. Rows travel by (partition, key), so no task ever
   gets more of a key than one input partition holds, however common the key is.
4. Cut each key's numbers into chunks of equal size, make one state per chunk, and merge the states of a key in
   chunk order.

Everything runs on the JVM in whole-stage code. No step has the rows of one key in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handloom.runtime import quoted

#: Rows of one key that make one state.
CHUNK_ROWS = 1 << 20
#: Bits that monotonically_increasing_id keeps for the position in a partition.
POSITION_BITS = 33


def number_rows(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, value, row_no, chunk)``: rows of each key numbered from 0 without gaps, in input order.

    Null keys form a group of their own. Input order is partition by partition; it is that of the files for a scan.
    ``df`` must read files, or be passed through ``materialise``: both passes over it need the same partitions. A row that
    the first pass did not count in its partition fails the job. (Totals made of the numbers would be right in any case,
    as a row's number only says which chunk it counts in.)
    """
    # in a struct a null key equals itself, so rows keep their partitioning by (part, key) through the join
    slim = df.select(F.struct(quoted(key).alias("k")).alias("key"), quoted(value).alias("value"))
    counts = slim.groupBy(F.spark_partition_id().alias("part"), "key").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "key", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    placed = slim.withColumn("place", F.monotonically_increasing_id())
    placed = placed.withColumn("part", F.shiftright("place", POSITION_BITS).cast("int"))
    within = Window.partitionBy("part", "key").orderBy("place")
    numbered = placed.withColumn("rank", F.row_number().over(within) - 1)
    apart = F.raise_error(F.lit("the two passes over the rows have different partitions")).cast("bigint")
    row_no = F.when(F.col("rank") < F.col("n"), F.col("offset") + F.col("rank")).otherwise(apart)
    return numbered.join(offsets, ["part", "key"], "left").select(
        F.col("key.k").alias("key"),
        "value",
        row_no.alias("row_no"),
        F.floor(row_no / chunk_rows).cast("bigint").alias("chunk"),
    )


def chunk_states(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One state per (key, chunk): rows, values, sum, first and last value with their row numbers."""
    return (
        number_rows(df, key, value, chunk_rows)
        .groupBy("key", "chunk")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count("value").alias("n_values"),
            F.sum("value").alias("total"),
            F.min("row_no").alias("first_no"),
            F.min_by("value", "row_no").alias("first_value"),
            F.max("row_no").alias("last_no"),
            F.max_by("value", "row_no").alias("last_value"),
        )
    )


def key_totals(df: DataFrame, key: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(key, n_rows, n_values, total, first_value, last_value, n_chunks)``, one row per key.

    * null keys: one row with key null;
    * null values: counted in n_rows, not in n_values; total is null where a key has no value;
    * repeated rows: all counted; ties cannot occur, every row has its own number;
    * empty input: no row; further columns of ``df``, whatever their names, are ignored.
    """
    return (
        chunk_states(df, key, value, chunk_rows)
        .groupBy("key")
        .agg(
            F.sum("n").alias("n_rows"),
            F.sum("n_values").alias("n_values"),
            F.sum("total").alias("total"),
            F.min_by("first_value", "first_no").alias("first_value"),
            F.max_by("last_value", "last_no").alias("last_value"),
            F.count(F.lit(1)).alias("n_chunks"),
        )
    )


def heavy_keys(totals: DataFrame, per_mille: int) -> DataFrame:
    """The rows of ``key_totals`` whose key has at least ``per_mille`` thousandths of all rows. Null keys never qualify.

    ``totals`` is used twice (shares, and the whole they are shares of): pass it materialised.
    """
    whole = totals.groupBy().agg(F.sum("n_rows").alias("n")).scalar()
    return totals.filter(F.col("key").isNotNull() & (F.col("n_rows") * 1000 >= whole * per_mille))
