"""Codebooks and matrices on disk: Parquet, and the JSON and NumPy files other tools read."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handloom.functions.codes import legacy_code, masks
from handloom.operators.codebook import MOST_CLASSES

#: File names of the JSON form, with codes as text, and as packed text (legacy).
LABELS, CODES, COUNTS = "theta_labels_str.json", "theta_ltb_str.json", "theta_counts_str.json"
OLD_LABELS, OLD_COUNTS, META = "theta_labels.json", "theta_freq.json", "theta_meta.json"
#: The largest matrix written dense.
MOST_TOKENS = 4096


def _read(folder: str, name: str):
    with open(os.path.join(folder, name), encoding="utf-8") as f:
        return json.load(f)


def _write(folder: str, name: str, what) -> None:
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        json.dump(what, f)


def save_json(model: DataFrame, folder: str, top_k: int) -> str:
    """Write a model of at most MOST_CLASSES rows; returns the path of the meta file."""
    rows = (
        model.select("label", "code", "cnt", legacy_code(F.col("m_bend"), F.col("m_spread")).alias("packed"))
        .orderBy("label")
        .limit(MOST_CLASSES + 1)
        .collect()
    )
    if len(rows) > MOST_CLASSES:
        raise ValueError(f"a model of more than {MOST_CLASSES} classes")
    os.makedirs(folder, exist_ok=True)
    _write(folder, LABELS, {r.code: r.label for r in rows})
    _write(folder, CODES, {str(r.label): r.code for r in rows})
    _write(folder, COUNTS, {str(r.label): r.cnt for r in rows})
    _write(folder, OLD_LABELS, {r.packed: r.label for r in rows})
    _write(folder, OLD_COUNTS, {r.packed: r.cnt for r in rows})
    # fixed values: the keys that readers of this form look for
    sizes = {"q": 5, "n_bits": 66, "n_angles": 13, "n_bending": 9, "n_spread": 4}
    _write(folder, META, {"n_classes": len(rows), **sizes, "top_k": top_k, "has_new_architecture": True})
    return os.path.join(folder, META)


def load_json(spark: SparkSession, folder: str) -> DataFrame:
    """A model from either JSON form, as ``(label, code, m_bend, m_spread, cnt)``."""
    from handloom.functions.codes import plain_code

    if _read(folder, META).get("has_new_architecture"):
        counts = _read(folder, COUNTS)
        rows = [(label, code, counts[str(label)]) for code, label in _read(folder, LABELS).items()]
    else:
        counts = _read(folder, OLD_COUNTS)
        rows = [(label, code, counts[code]) for code, label in _read(folder, OLD_LABELS).items()]
    raw = spark.createDataFrame(rows, "label int, raw string, cnt bigint").withColumn("m", masks(F.col("raw")))
    raw = raw.select("label", F.col("m.m_bend").alias("m_bend"), F.col("m.m_spread").alias("m_spread"), "cnt")
    return raw.select("label", plain_code(F.col("m_bend"), F.col("m_spread")).alias("code"), "m_bend", "m_spread", "cnt")


def save_matrix(pairs: DataFrame, path: str, k: int, row: str, col: str, value: str, mirror: bool = False, diagonal: float = 0.0) -> None:
    """Write sparse entries as a dense k x k ``.npy``; k is at most MOST_TOKENS, which bounds what comes to the driver."""
    if k > MOST_TOKENS:
        raise ValueError(f"dense matrices of at most {MOST_TOKENS} tokens")
    out = np.zeros((k, k))
    got = pairs.filter(F.col(row).between(0, k - 1) & F.col(col).between(0, k - 1)).select(row, col, value).toPandas()
    out[got[row], got[col]] = got[value]
    if mirror:
        out[got[col], got[row]] = got[value]
    if diagonal:
        np.fill_diagonal(out, diagonal)
    np.save(path, out)
