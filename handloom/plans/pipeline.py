"""From frames to tokens, transitions, similarities and groups of similar tokens."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from handloom.functions.pose import hand
from handloom.operators import codebook, similarity, transitions
from handloom.operators.components import components
from handloom.runtime import materialise
from handloom.sources.frames import oriented
from handloom.sources.models import save_matrix

#: Names of the files that ``save`` writes, in the order used there. Keys of the description are fixed too.
OUTPUTS = ("similarity_matrix.npy", "transition_matrix.npy", "symmetrized_matrix.npy", "pipeline_meta.json", "super_cluster_map.json")
Tokenizer = Callable[[DataFrame], DataFrame]


def model_tokenizer(model: DataFrame) -> Tokenizer:
    """Frames with a token by the model: the built-in kind of tokenizer."""
    return lambda frames: codebook.predict(codebook.encode(frames), model)


def tokenise(frames: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``(file, frame_idx, hand, token)`` of oriented frames; a tokenizer is anything that adds ``token``."""
    if not callable(tokenizer):
        raise AttributeError("a tokenizer must be callable")
    return tokenizer(oriented(frames)).withColumn("hand", hand()).select("file", "frame_idx", "hand", "token")


@dataclass(frozen=True)
class Result:
    tokens: DataFrame
    counts: DataFrame
    sims: DataFrame
    k: int
    delta_t: int
    min_transitions: int

    def groups(self, tau: float = 0.9) -> DataFrame:
        """``(token, super_cluster)`` for all tokens 0..k-1; a group's number is its least token."""
        every = self.counts.sparkSession.range(self.k).select(F.col("id").cast("int").alias("token"))
        found = components(every, "token", similarity.edges(self.sims, tau), "i", "j")
        return found.withColumnsRenamed({"node": "token", "component": "super_cluster"})

    def save(self, folder: str, tau: float = 0.9) -> dict[str, str]:
        """Dense matrices, the group of each token and a description, as other tools expect them; for k up to 4096.

        The files are results, written where the driver runs; ``groups`` and the tables are what stays distributed.
        """
        os.makedirs(folder, exist_ok=True)
        names = OUTPUTS
        paths = {n: os.path.join(folder, n) for n in names}
        save_matrix(self.sims, paths[names[0]], self.k, "i", "j", "sim", mirror=True, diagonal=1.0)
        save_matrix(self.counts, paths[names[1]], self.k, "src", "dst", "n")
        half = similarity.symmetrised(self.counts).withColumn("v", F.col("v") / 2)
        save_matrix(half, paths[names[2]], self.k, "i", "j", "v")
        meta = {"k": self.k, "delta_t": self.delta_t, "min_transitions": self.min_transitions, "shape": [self.k, self.k]}
        with open(paths[names[3]], "w", encoding="utf-8") as f:
            json.dump(meta, f)
        found = self.groups(tau).filter(F.col("token").between(0, self.k - 1)).orderBy("token").collect()  # k rows, checked above
        with open(paths[names[4]], "w", encoding="utf-8") as f:
            json.dump({str(r.token): r.super_cluster for r in found}, f)
        return paths


def run(frames: DataFrame, tokenizer: Tokenizer, k: int = 1024, delta_t: int = 10, min_transitions: int = 0) -> Result:
    """A new result each time; nothing is carried from one run to the next. ``min_transitions`` applies to the sums."""
    tokens = materialise(tokenise(frames, tokenizer), "tokens")
    counts = materialise(transitions.count(tokens, delta_t, min_transitions, k), "counts")
    return Result(tokens, counts, similarity.similarity(counts), k, delta_t, min_transitions)


#: Names of the angles, in order.
ANGLES = (
    "thumb index_PIP index_DIP middle_PIP middle_DIP ring_PIP ring_DIP pinky_PIP pinky_DIP"
    " thumb-index index-middle middle-ring ring-pinky"
).split()


def report(codes: DataFrame, model: DataFrame, top_n: int = 1024, per_class: int = 3) -> DataFrame:
    """``(rnk, sample, text)``: what was read, then each class and its first frames, in lines to be written in that order."""
    head = F.format_string("%d recordings, %d frames, %d distinct codes", "n_files", "n_frames", "n_codes")
    first = codebook.totals(codes).select(F.lit(0).alias("rnk"), F.lit(0).alias("sample"), head.alias("text"))
    top = codebook.histogram(model, top_n)
    heads = top.select(
        "rnk",
        F.lit(0).alias("sample"),
        F.format_string(
            "#%d label %d, %d frames, code %s\n  bending %s\n  spread %s", "rnk", "label", "cnt", "code", "bending_states", "spread_states"
        ).alias("text"),
    )
    found = codebook.samples(codes, top, per_class).filter("sample is not null")
    points = F.concat_ws(
        "\n", *(F.format_string(f"    point {m:2d} %8.4f %8.4f %8.4f", *(F.get("aligned", F.lit(3 * m + c)) for c in range(3))) for m in range(21))
    )
    theta = [F.get("theta", F.lit(i)) for i in range(len(ANGLES))]
    shown = [F.when(x.isNotNull(), F.format_string("%.2f", x)).otherwise("-") for x in theta]
    angles = F.concat_ws("\n", *(F.concat(F.lit(f"    {name:13s} "), x) for name, x in zip(ANGLES, shown, strict=True)))
    body = found.select("rnk", "sample", F.format_string("  sample %d: %s frame %d\n%s\n%s", "sample", "file", "frame_idx", points, angles).alias("text"))
    return first.unionByName(heads).unionByName(body)


def save_report(codes: DataFrame, model: DataFrame, folder: str, top_n: int = 1024, per_class: int = 3) -> str:
    """Write the report as text files under ``folder``, in order of their names. It grows with top_n, not with the frames."""
    lines = report(codes, model, top_n, per_class).orderBy("rnk", "sample").select("text")
    lines.write.mode("overwrite").text(folder)
    return folder
