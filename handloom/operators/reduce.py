"""Sampling, projections to two dimensions, and k-means over poses."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handloom.functions.pose import with_bone_cosines
from handloom.runtime import materialise, spread_join

#: Rows of a sample that a pluggable reducer may get in one place.
MOST_SAMPLED = 100_000


def subsample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same for the same keys and seed. Fewer if there are fewer; nulls in key count."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def finite(pose: str, size: int = 63):
    good = F.forall(pose, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(pose) == size) & good, F.lit(False))


def pca_2d(df: DataFrame, key: str, values: str = "aligned", size: int = 63) -> DataFrame:
    """``(key, x, y)``: centred scores on the two leading directions, each turned so that its largest loading is positive.

    Rows with a null, short or non-finite array are left out.
    """
    rows = df.filter(finite(values, size)).select(key, array_to_vector(F.col(values).cast("array<double>")).alias("raw"))
    if rows.isEmpty():
        return rows.select(key, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="raw", outputCol="centred").fit(rows).transform(rows)
    model = PCA(k=2, inputCol="centred", outputCol="score").fit(centred)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, d]).argmax(), d] > 0 else -1.0 for d in range(2)]
    score = vector_to_array("score")
    return model.transform(centred).select(key, (score[0] * sign[0]).alias("x"), (score[1] * sign[1]).alias("y"))


Reducer = Callable[[pd.DataFrame], pd.DataFrame]


def overview(df: DataFrame, key: str, n: int = 10_000, seed: int = 42, reducer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A seeded sample in two dimensions, by ``pca_2d`` unless another reducer is given."""
    picked = subsample(df.filter(finite("aligned")), n, key, seed)
    return reducer(picked) if reducer else pca_2d(picked, key)


def per_group(df: DataFrame, group: str, key: str, reducer: Reducer, n: int = 2_000, seed: int = 42, least: int = 5) -> DataFrame:
    """``(group, key, x, y)``: a seeded sample of each group, reduced on its own; groups under ``least`` rows give none.

    ``reducer`` maps a pandas frame with ``key`` and ``aligned`` to one with ``key, x, y``. Every task passes on at most
    ``n`` rows of a group, and the reducer gets no more. ``pca_groups`` projects whole groups.
    """
    if n > MOST_SAMPLED:
        raise ValueError(f"samples of at most {MOST_SAMPLED} rows")
    good = df.filter(finite("aligned") & F.col(group).isNotNull()).withColumn("_h", F.xxhash64(F.lit(seed), key))
    cut = good.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_h", key))).filter(F.col("_r") <= n)
    kinds = dict(df.dtypes)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < least:
            return pd.DataFrame(columns=[group, key, "x", "y"])
        out = reducer(pdf[[key, "aligned"]])
        return out.assign(**{group: pdf[group].iloc[0]})[[group, key, "x", "y"]]

    return cut.select(group, key, "aligned").groupBy(group).applyInPandas(work, f"{group} {kinds[group]}, {key} {kinds[key]}, x double, y double")


def pca_groups(df: DataFrame, group: str, key: str, values: str = "aligned", size: int = 63, least: int = 5) -> DataFrame:
    """``(group, key, x, y)``: centred scores of every row on the two leading directions of its group.

    Directions come from sums of products per group, made within batches and then over all, so no group is collected;
    each is turned so that its largest loading is positive. Rows of large groups are spread where they meet their
    directions. Null groups, groups under ``least`` rows and unusable arrays give no row.
    """
    good = df.filter(finite(values, size) & F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(key).alias("k"), F.col(values).alias("v"))
    good = materialise(good, "usable")
    kind = dict(df.dtypes)[group]

    def products(batches):
        for b in batches:
            m = np.hstack([pa.compute.list_flatten(b.column("v")).to_numpy().astype(float).reshape(-1, size), np.ones((b.num_rows, 1))])
            names, at = np.unique(b.column("g").to_numpy(zero_copy_only=False), return_inverse=True)
            parts = [m[at == i].T @ m[at == i] for i in range(len(names))]
            rows = np.concatenate(parts) if parts else np.empty((0, size + 1))
            g = b.column("g").take(pa.array([int(np.argmax(at == i)) for i in range(len(names))], pa.int64()))
            g = g.take(pa.array(np.repeat(np.arange(len(names)), size + 1)))
            i = pa.array(np.tile(np.arange(size + 1), len(names)))
            yield pa.RecordBatch.from_arrays([g, i, *(pa.array(c) for c in rows.T)], ["g", "i", *sums])

    def axes(rows: pd.DataFrame) -> pd.DataFrame:
        total = rows.sort_values("i")[sums].to_numpy()
        n = total[-1, -1]
        mean = total[-1, :-1] / n
        _, vectors = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
        two = vectors[:, ::-1][:, :2].T
        two = two * np.sign(two[np.arange(2), np.abs(two).argmax(axis=1)])[:, None]
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "n": [int(n)], "axes": [two.ravel().tolist()], "off": [(two @ mean).tolist()]})

    sums = [f"s{j}" for j in range(size + 1)]
    partial = good.select("g", "v").mapInArrow(products, f"g {kind}, i bigint, " + ", ".join(f"{s} double" for s in sums))
    whole = partial.groupBy("g", "i").agg(*(F.sum(s).alias(s) for s in sums))
    found = whole.groupBy("g").applyInPandas(axes, f"g {kind}, n bigint, axes array<double>, off array<double>")
    met = spread_join(good, materialise(found.filter(F.col("n") >= least), "axes"), "g", "n", "k")
    dot = lambda part: F.aggregate(F.zip_with("v", part, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return met.select(
        F.col("g").alias(group),
        F.col("k").alias(key),
        (dot(F.slice("axes", 1, size)) - F.col("off")[0]).alias("x"),
        (dot(F.slice("axes", size + 1, size)) - F.col("off")[1]).alias("y"),
    )


def feature_stats(df: DataFrame, values: str) -> DataFrame:
    """``(least, most, n_values, n_missing)`` over all entries of an array column; nulls and NaN are missing, infinity is not."""
    x = F.col("x").cast("double")
    known = F.when(x.isNotNull() & ~F.isnan(x), x)
    return df.select(F.explode(values).alias("x")).agg(
        F.min(known).alias("least"), F.max(known).alias("most"), F.count(known).alias("n_values"), (F.count(F.lit(1)) - F.count(known)).alias("n_missing")
    )


def pose_features(df: DataFrame, cosines: bool = False) -> DataFrame:
    """``df`` with ``pose``, and with ``cosines`` with ``angles`` (three times the bone cosines), as vectors.

    Rows with a null, short or non-finite array are left out.
    """
    rows = df.filter(finite("aligned")).withColumn("pose", array_to_vector(F.col("aligned").cast("array<double>")))
    if not cosines:
        return rows
    thrice = F.transform("cosines", lambda v: F.coalesce(v.cast("double") * 3, F.lit(0.0)))
    return with_bone_cosines(rows).withColumn("angles", array_to_vector(thrice)).drop("cosines")


def fit_kmeans(df: DataFrame, k: int, cosines: bool = False, seed: int = 42) -> PipelineModel | None:
    """A k-means model of poses, or of poses scaled to unit variance beside three times their bone cosines.

    It is saved and loaded as every Spark model is. Without a usable row there is none.
    """
    rows = pose_features(df.select("aligned"), cosines)
    if rows.isEmpty():
        return None
    stages, column = [], "pose"
    if cosines:
        stages.append(StandardScaler(withMean=True, withStd=True, inputCol="pose", outputCol="scaled").fit(rows))
        stages.append(VectorAssembler(inputCols=["scaled", "angles"], outputCol="both"))
        column = "both"
    ready = PipelineModel(stages).transform(rows)
    return PipelineModel([*stages, KMeans(k=k, seed=seed, featuresCol=column, predictionCol="cluster").fit(ready)])


def assign_kmeans(model: PipelineModel | None, df: DataFrame, key: str) -> DataFrame:
    """``(key, cluster)`` of usable rows, of the model's own rows or of new ones."""
    rows = df.select(key, "aligned")
    if model is None:
        return rows.filter(finite("aligned")).select(key, F.lit(0).alias("cluster"))
    return model.transform(pose_features(rows, len(model.stages) > 1)).select(key, "cluster")


def kmeans(df: DataFrame, key: str, k: int, cosines: bool = False, seed: int = 42) -> tuple[DataFrame, float]:
    """``(key, cluster)`` and the cost; without a usable row no cluster and no cost."""
    model = fit_kmeans(df, k, cosines, seed)
    return assign_kmeans(model, df, key), model.stages[-1].summary.trainingCost if model else 0.0


def elbow(df: DataFrame, ks: list[int], cosines: bool = False, seed: int = 42) -> list[tuple[int, float]]:
    """The cost for each k."""
    models = [(k, fit_kmeans(df, k, cosines, seed)) for k in ks]
    return [(k, model.stages[-1].summary.trainingCost) for k, model in models if model]


def silhouette(df: DataFrame, ks: list[int], cosines: bool = False, seed: int = 42) -> list[tuple[int, float]]:
    """The mean silhouette of all usable rows for each k, by squared distance, which takes no pairs. One cluster has none."""
    out = []
    for k in ks:
        model = fit_kmeans(df, k, cosines, seed)
        if model:
            rows = model.transform(pose_features(df.select("aligned"), cosines))
            if rows.select("cluster").distinct().limit(2).count() == 2:
                judge = ClusteringEvaluator(featuresCol="both" if cosines else "pose", predictionCol="cluster")
                out.append((k, judge.evaluate(rows)))
    return out
