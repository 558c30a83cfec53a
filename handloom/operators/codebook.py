"""The codebook: codes ranked by frequency, and tokens of codes by lookup or best overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from handloom.functions.codes import masks
from handloom.functions.pose import all_state_names, with_theta_and_code
from handloom.operators.prefix import numbered
from handloom.runtime import materialise, sendable

#: A model of more classes than this is refused where it would be sent to all tasks.
MOST_CLASSES = 1 << 16


def encode(frames: DataFrame, pose: str = "aligned") -> DataFrame:
    """``frames`` with theta, code, m_bend and m_spread."""
    return with_theta_and_code(frames, pose)


def code_frequency(codes: DataFrame) -> DataFrame:
    """``(code, cnt, first_file, first_idx)``: frames of each code and where it comes first, by file and frame_idx.

    Codes made by ``encode`` are never null; a null code from elsewhere is a code of its own.
    """
    seen = codes.groupBy("code").agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct("file", "frame_idx")).alias("first")
    )
    return seen.select("code", "cnt", F.col("first.file").alias("first_file"), F.col("first.frame_idx").alias("first_idx"))


def totals(codes: DataFrame) -> DataFrame:
    """``(n_files, n_frames, n_codes)``: recordings, frames and distinct codes; a null file or code is none."""
    return codes.agg(
        F.count_distinct("file").alias("n_files"), F.count(F.lit(1)).alias("n_frames"), F.count_distinct("code").alias("n_codes")
    )


def train(codes: DataFrame, top_k: int | None = 1024) -> DataFrame:
    """``(label, code, m_bend, m_spread, cnt)``: the ``top_k`` most frequent codes, label 0 the most frequent.

    Equal counts keep the order in which codes are first seen. ``top_k`` None keeps every code, as the legacy training
    does; such codes are numbered range by range, however many there are.
    """
    order = [F.desc("cnt"), F.asc("first_file"), F.asc("first_idx"), F.asc("code")]
    counted = code_frequency(codes)
    if top_k is None:
        ranked = numbered(materialise(counted, "codes"), order, "label").withColumn("label", F.col("label").cast("int"))
    else:
        ranked = counted.orderBy(*order).limit(top_k).withColumn("label", F.row_number().over(Window.orderBy(*order)) - 1)
    m = masks(F.col("code"))
    return ranked.select("label", "code", m["m_bend"].alias("m_bend"), m["m_spread"].alias("m_spread"), "cnt")


def histogram(model: DataFrame, n: int | None = 20) -> DataFrame:
    """``(rnk, label, code, cnt, bending_states, spread_states)`` of the ``n`` most frequent classes.

    Equal counts are ranked by label, then by code; nulls come last.
    """
    order = [F.desc("cnt"), F.asc_nulls_last("label"), F.asc_nulls_last("code")]
    top = model.orderBy(*order)
    top = top.limit(n) if n is not None else top
    bending, spread = all_state_names(F.col("code"))
    ranked = top.withColumn("rnk", F.row_number().over(Window.orderBy(*order)))
    return ranked.select("rnk", "label", "code", "cnt", bending.alias("bending_states"), spread.alias("spread_states"))


def lookup(codes: DataFrame, model: DataFrame, name: str = "token") -> DataFrame:
    """``codes`` with the label of its code, null for codes out of the model."""
    small = model.select(F.col("code").alias("_code"), F.col("label").cast("int").alias(name))
    return codes.join(small, F.col("code") == F.col("_code"), "left").drop("_code")


def out_of_model(codes: DataFrame, model: DataFrame) -> DataFrame:
    """``(code, m_bend, m_spread)``, once each, of codes the model lacks."""
    return codes.select("code", "m_bend", "m_spread").filter("code is not null").distinct().join(model.select("code"), "code", "left_anti")


class Classes:
    """A model's classes by label, those with a null left out; at most MOST_CLASSES: the bound of what every task gets."""

    def __init__(self, model: DataFrame):
        rows = model.select("label", "m_bend", "m_spread").dropna()
        found = rows.orderBy("label").limit(MOST_CLASSES + 1).toPandas()
        if len(found) > MOST_CLASSES:
            raise ValueError(f"a model of more than {MOST_CLASSES} classes")
        self.label, self.bend, self.spread = (found[c].to_numpy(np.int64) for c in ("label", "m_bend", "m_spread"))

    def overlap(self, bend: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Labels of the classes that share most bits, ties to the lower label, and the bits shared."""
        best, over = np.zeros(len(bend), np.int64), np.zeros(len(bend), np.int64)
        for s in range(0, len(bend), 1024):
            e = s + 1024
            shared = np.bitwise_count(bend[s:e, None] & self.bend) + np.bitwise_count(spread[s:e, None] & self.spread)
            at = shared.argmax(axis=1)
            best[s:e], over[s:e] = self.label[at], shared[np.arange(len(at)), at]
        return best, over

    def tokens(self, bend: np.ndarray, spread: np.ndarray) -> np.ndarray:
        """The label of each code, or that of the class with the best overlap; each distinct code is compared once."""
        kind = np.dtype([("b", np.int64), ("s", np.int64)])
        pairs = np.empty(len(bend), kind)
        pairs["b"], pairs["s"] = bend, spread
        codes, back = np.unique(pairs, return_inverse=True)
        known = {(b, s): label for b, s, label in zip(self.bend[::-1], self.spread[::-1], self.label[::-1], strict=True)}
        found = np.array([known.get((c["b"], c["s"]), -1) for c in codes], np.int64)
        new = found < 0
        found[new] = self.overlap(codes["b"][new], codes["s"][new])[0]
        return found[back]


def best_overlap(unknown: DataFrame, model: DataFrame) -> DataFrame:
    """``(code, token, overlap)``: for each distinct unknown code the class that shares most bits, ties to the lower label.

    The model goes to all tasks: its size is the ``top_k`` it was trained with, and is checked here. An empty model gives
    null tokens.
    """
    classes = Classes(model)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xb, xs = b.column("m_bend").to_numpy(), b.column("m_spread").to_numpy()
            none = None if len(classes.label) else np.ones(len(xb), bool)
            best, over = classes.overlap(xb, xs) if none is None else (np.zeros(len(xb)), np.zeros(len(xb)))
            yield pa.RecordBatch.from_arrays(
                [b.column("code"), pa.array(best.astype(np.int32), mask=none), pa.array(over.astype(np.int32), mask=none)],
                ["code", "token", "overlap"],
            )

    return unknown.select("code", "m_bend", "m_spread").mapInArrow(match, "code string, token int, overlap int")


def predict(codes: DataFrame, model: DataFrame, name: str = "token") -> DataFrame:
    """``codes`` with a token for every code: its label, or that of the class with the best overlap.

    One pass, no shuffle: only the two numbers of a code travel to the Python workers, and the model, whose size is
    checked. Null codes and an empty model give null; of classes with the same code the lower label counts.
    """
    classes = Classes(model)
    if not len(classes.label):
        return codes.withColumn(name, F.lit(None).cast("int"))

    @F.pandas_udf("int")
    def token(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bend, spread in parts:
            yield pd.Series(classes.tokens(bend.to_numpy(np.int64), spread.to_numpy(np.int64)).astype(np.int32))

    whole = F.col("code").isNotNull() & F.col("m_bend").isNotNull() & F.col("m_spread").isNotNull()
    found = token(F.coalesce("m_bend", F.lit(0).cast("bigint")), F.coalesce("m_spread", F.lit(0).cast("bigint")))
    return codes.withColumn(name, F.when(whole, found))


def samples(codes: DataFrame, classes: DataFrame, per_class: int = 3) -> DataFrame:
    """``(rnk, label, code, sample, file, frame_idx, aligned, theta)``: first frames of each class in scan order.

    ``classes`` is a histogram of at most MOST_CLASSES rows. Classes without a frame give one row with nulls. Every task
    passes on no more than its own first frames of a class, so a hot class is sorted in many places.
    """
    wanted = codes.join(sendable(classes.select("code"), MOST_CLASSES), "code", "left_semi")
    order = Window.partitionBy("code").orderBy("file", "frame_idx")
    first = wanted.withColumn("sample", F.row_number().over(order)).filter(F.col("sample") <= per_class)
    return classes.select("rnk", "label", "code").join(first.select("code", "sample", "file", "frame_idx", "aligned", "theta"), "code", "left")
