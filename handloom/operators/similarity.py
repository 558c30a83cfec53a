"""Similarity of tokens by what they go over into: cosine of matrix rows without the two columns of the pair itself.

With a zero diagonal the two columns add nothing to the dot product, only to the norms, so

    S_ij = sum_c V_ic V_jc / sqrt((N_i - V_ij^2) (N_j - V_ji^2)),  N_i = sum_c V_ic^2,

where V = C + C^T (or C), diagonal removed. Rows are cut into blocks and every pair of blocks is one product in one task:
the matrix is never in one place, and k may be large.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.runtime import materialise

#: Matrix rows in a block.
BLOCK = 256


def symmetrised(counts: DataFrame, symmetrize: bool = True) -> DataFrame:
    """``(i, j, v)`` without the diagonal: C + C^T, or C. Negative counts and negative tokens fail the job."""
    inside = (F.col("src") >= 0) & (F.col("dst") >= 0)
    good = F.when(F.col("n") >= 0, F.col("n")).otherwise(F.raise_error(F.lit("negative count")).cast("bigint"))
    good = F.when(inside, good).otherwise(F.raise_error(F.lit("negative token")).cast("bigint"))
    c = counts.filter("src is not null and dst is not null and n is not null and src <> dst").select(
        F.col("src").alias("i"), F.col("dst").alias("j"), good.alias("v")
    )
    both = c.unionByName(c.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")) if symmetrize else c
    return both.groupBy("i", "j").agg(F.sum("v").alias("v")).filter("v > 0")


def row_shares(matrix: DataFrame) -> DataFrame:
    """``(i, j, p)``: each row divided by its sum."""
    sums = matrix.groupBy("i").agg(F.sum("v").alias("s"))
    return matrix.join(sums, "i").select("i", "j", (F.col("v") / F.col("s")).alias("p"))


def _product(exclude: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(pdf.i.to_numpy(), return_inverse=True)
        cols, c = np.unique(pdf.j.to_numpy(), return_inverse=True)
        m = np.zeros((len(rows), len(cols)))
        m[r, c] = pdf.v.to_numpy(float)
        low, high = int(pdf.bi.iloc[0]), int(pdf.bj.iloc[0])
        a, b = np.nonzero(rows // BLOCK == low)[0], np.nonzero(rows // BLOCK == high)[0]
        dot = m[a] @ m[b].T
        own = (m**2).sum(axis=1)
        na, nb = np.repeat(own[a][:, None], len(b), 1), np.repeat(own[b][None], len(a), 0)
        if exclude:
            at = np.searchsorted(cols, rows)
            there = (at < len(cols)) & (cols[np.minimum(at, len(cols) - 1)] == rows)
            def toward(x, y):  # noqa: E306
                out = np.zeros((len(x), len(y)))
                ok = there[y]
                out[:, ok] = m[np.ix_(x, at[y][ok])]
                return out
            na, nb = na - toward(a, b) ** 2, nb - toward(b, a).T ** 2
        i, j = np.nonzero((dot > 0) & (rows[a][:, None] < rows[b][None]))
        return pd.DataFrame({"i": rows[a][i], "j": rows[b][j], "sim": dot[i, j] / np.sqrt(na[i, j] * nb[i, j])})

    return work


def pair_cosine(matrix: DataFrame, exclude: bool = True) -> DataFrame:
    """``(i, j, sim)`` for i < j with a shared column; all other pairs are 0 and every token is 1 with itself.

    ``matrix`` is ``(i, j, v)``, v positive. ``exclude`` False gives the plain cosine.
    """
    matrix = materialise(matrix, "matrix")  # read for its size, then for its tiles
    n = matrix.agg(F.max("i")).first()[0]
    blocks = 0 if n is None else n // BLOCK + 1
    own = F.floor(F.col("i") / BLOCK).cast("int")
    tiles = matrix.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(max(blocks - 1, 0)))))
    tiles = tiles.select(F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "i", "j", "v")
    return tiles.groupBy("bi", "bj").applyInPandas(_product(exclude), "i int, j int, sim double")


def similarity(counts: DataFrame, symmetrize: bool = True, exclude: bool = True, cold_start: str | None = None, k: int | None = None) -> DataFrame:
    """``(i, j, sim)`` of transition counts, for i < j.

    * nulls: left out; self transitions: no effect; tokens without transitions: similar to none but themselves, or with
      ``cold_start='uniform'`` (needs ``k``) taken to go over into every other token alike;
    * an empty matrix: no row; further columns are ignored.
    """
    matrix = symmetrised(counts, symmetrize)
    if cold_start == "uniform":
        if k is None:
            raise ValueError("cold_start needs k")
        tokens = counts.sparkSession.range(k).select(F.col("id").cast("int").alias("i"))
        cold = tokens.join(matrix.select("i").distinct(), "i", "left_anti")
        even = cold.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).filter("i <> j").withColumn("v", F.lit(1).cast("bigint"))
        matrix = matrix.unionByName(even)
    elif cold_start is not None:
        raise ValueError("cold_start must be None or 'uniform'")
    return pair_cosine(matrix, exclude)


def edges(sims: DataFrame, tau: float) -> DataFrame:
    """Pairs more similar than ``tau``."""
    return sims.filter(F.col("sim") > tau).select("i", "j")
