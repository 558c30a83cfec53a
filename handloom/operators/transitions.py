"""Token transitions within tracks: pairs of tokens at most ``delta_t`` places apart in a recording and hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handloom.operators.prefix import running_total
from handloom.runtime import free_name, materialise

#: Frame numbers (as a power of two) whose rows are put in order together, and places of a track that are.
FRAME_BITS, PLACES = 14, 1 << 14


def check(delta_t: int, min_transitions: int = 0) -> None:
    if delta_t < 1:
        raise ValueError("delta_t must be at least 1")
    if min_transitions < 0:
        raise ValueError("min_transitions must not be negative")


def track_rows(tokens: DataFrame) -> DataFrame:
    """``(file, frame_idx, hand, token)`` of rows with hand L or R and a token, each (file, frame_idx) once."""
    return (
        tokens.filter("hand in ('L', 'R') and token is not null and frame_idx is not null")
        .groupBy("file", "frame_idx")
        .agg(F.min(F.struct("hand", "token")).alias("s"))
        .select("file", "frame_idx", F.col("s.hand").alias("hand"), F.col("s.token").alias("token"))
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``place``, the number of a row in its track, gaps in frame_idx closed up, and ``length`` of the track.

    Tracks are numbered in parts by frame number. ``rows`` is read twice.
    """
    one = free_name(rows.columns, "one")
    bucket = F.shiftright("frame_idx", FRAME_BITS)
    numbered = running_total(rows.withColumn(one, F.lit(1)), ["file", "hand"], bucket, [F.col("frame_idx")], one, "place", "length")
    return numbered.drop(one)


def long_tracks(rows: DataFrame, delta_t: int) -> DataFrame:
    """``(file, hand, n)`` of tracks with more than ``delta_t`` rows; shorter ones take no part at all."""
    return rows.groupBy("file", "hand").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > delta_t)


def lag_pairs(rows: DataFrame, delta_t: int) -> DataFrame:
    """``(file, hand, src, dst)`` for every row and each of the next ``delta_t`` rows of its track.

    Tracks are cut into blocks of places; a block also gets the first rows of the next one to look ahead to. Places and
    lengths come from sums by range of frame numbers, so no task has a whole track. A null file is a file.
    """
    check(delta_t)
    size = max(PLACES, 2 * delta_t)
    kept = placed(materialise(rows, "tracks")).filter(F.col("length") > delta_t)
    block = F.floor(F.col("place") / size)
    copied = kept.withColumn(
        "block",
        F.explode(F.when((F.col("place") % size < delta_t) & (F.col("place") >= size), F.array(block, block - 1)).otherwise(F.array(block))),
    ).repartition("file", "hand", "block")
    ahead = Window.partitionBy("file", "hand", "block").orderBy("place")
    nexts = F.array(*(F.lead("token", d).over(ahead) for d in range(1, delta_t + 1)))
    own = copied.withColumn("nexts", nexts).filter(F.col("block") == block)
    pairs = own.select("file", "hand", F.col("token").alias("src"), F.explode("nexts").alias("dst"))
    return pairs.filter("dst is not null")


def count(tokens: DataFrame, delta_t: int = 1, min_transitions: int = 0, k: int | None = None) -> DataFrame:
    """``(src, dst, n)``: transitions over all tracks, both hands together; self transitions count.

    * null or other hands, null tokens and frame numbers: left out; rows delivered again: once;
    * tracks of at most ``delta_t`` rows: left out; counts below ``min_transitions``: left out;
    * with ``k``, a token outside 0..k-1 fails the job; empty input: no row; a null file is a file.
    """
    check(delta_t, min_transitions)
    rows = track_rows(tokens)
    if k is not None:
        inside = (F.col("token") >= 0) & (F.col("token") < k)
        rows = rows.withColumn("token", F.when(inside, F.col("token")).otherwise(F.raise_error(F.lit(f"token outside 0..{k - 1}")).cast("int")))
    pairs = lag_pairs(rows, delta_t).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    return pairs.filter(F.col("n") >= max(min_transitions, 1))


def count_by_file(tokens: DataFrame, delta_t: int = 1) -> DataFrame:
    """``(file, src, dst, n)``: what ``merge`` sums up."""
    return lag_pairs(track_rows(tokens), delta_t).groupBy("file", "src", "dst").agg(F.count(F.lit(1)).alias("n"))


def merge(parts: DataFrame, min_transitions: int = 0) -> DataFrame:
    """``(src, dst, n)`` of counts per recording, each (file, src, dst) once; rows with a null are left out."""
    once = parts.filter("src is not null and dst is not null and n is not null").groupBy("file", "src", "dst").agg(F.max("n").alias("n"))
    return once.groupBy("src", "dst").agg(F.sum("n").alias("n")).filter(F.col("n") >= max(min_transitions, 1))


def matrix_stats(counts: DataFrame) -> DataFrame:
    """``(nnz, most, total)`` of ``(src, dst, n)``: entries over 0, the greatest and the sum, 0 where there is none."""
    zero = F.lit(0)
    return counts.agg(
        F.count_if(F.col("n") > 0).alias("nnz"), F.coalesce(F.max("n"), zero).alias("most"), F.coalesce(F.sum("n"), zero).alias("total")
    )
