"""Hands from images, by a detector that the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.functions.pose import align, flip_handedness

#: Gives (handedness as detected, 63 landmark values) for every hand of an image's bytes, and the image's size.
Detector = Callable[[bytes], tuple[list[tuple[str, list[float]]], int, int]]


def hands(images: DataFrame, make_detector: Callable[[], Detector]) -> DataFrame:
    """``(path, hand_idx, handedness, aligned, x_vec, y_vec, z_vec, wrist_px)`` of images (``path, content``).

    The detector is made once per task; images without a hand give no row.
    """

    def detect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for pdf in frames:
            rows = []
            for path, content in zip(pdf.path, pdf.content, strict=True):
                found, width, height = detector(content)
                rows += [(path, i, side, width, height, marks) for i, (side, marks) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["path", "hand_idx", "raw", "width", "height", "landmarks"])

    raw = images.select("path", "content").mapInPandas(
        detect, "path string, hand_idx int, raw string, width int, height int, landmarks array<double>"
    )
    sided = raw.withColumn("handedness", flip_handedness(F.col("raw")))
    return align(sided, "landmarks", "handedness", "width", "height").drop("raw", "width", "height", "landmarks")
