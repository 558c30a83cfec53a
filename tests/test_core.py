"""Operators of the core on small inputs, against values worked out by hand or by brute force."""

import json
import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from handloom.functions import codes, pose
from handloom.operators import codebook, compaction, components, hot_keys, prefix, reduce, similarity, transitions
from handloom import runtime
from handloom.plans import pipeline
from handloom.runtime import fresh_path, materialise
from handloom.sources import cache, frames, images, models
from handloom.streaming import accumulate

FRAME = "file string, frame_idx bigint, aligned array<float>, x_vec array<float>, y_vec array<float>, z_vec array<float>, is_mirror boolean"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bits_at_the_edges():
    theta = np.full((1, 13), np.nan)
    expected = {0: "10000", 30: "11000", 59.9: "11000", 60: "01100", 90: "00110", 120: "00011", 150: "00001", 180: "00000"}
    for x, bits in expected.items():
        theta[0, 0] = x
        assert "".join("01"[int(b)] for b in pose.code_bits(theta)[0][:5]) == bits
    for x, bits, sign in ((0, "10000", 0), (7.5, "11000", 0), (15, "01100", 0), (22.5, "00110", 0), (30, "00011", 0), (37.5, "00001", 0), (60, "00000", 0), (-10, "00000", 1), (-0.0, "10000", 0)):
        theta[0, 9] = x
        got = pose.code_bits(theta)[0]
        assert "".join("01"[int(b)] for b in got[45:50]) == bits and got[65] == sign


def test_zero_pose_has_right_angles(spark):
    df = spark.createDataFrame([("a", 0, [0.0] * 63, None, None, None, None), ("a", 1, None, None, None, None, None), ("a", 2, [math.nan] * 63, None, None, None, None), ("a", 3, [1.0], None, None, None, None)], FRAME)
    got = {r.frame_idx: r for r in codebook.encode(df).collect()}
    assert got[0].code == "00110" * 9 + "0" * 21 and got[0].theta == [90.0] * 13
    for i in (1, 2, 3):
        assert got[i].code == "0" * 66 and got[i].theta == [None] * 13


def test_bone_cosines_of_missing_and_zero_poses(spark):
    df = spark.createDataFrame([(0, [0.0] * 63), (1, None), (2, [math.nan] * 63)], "id int, aligned array<float>")
    got = {r.id: r.cosines for r in pose.with_bone_cosines(df).collect()}
    assert got[0] == [0.0] * 15 and got[1] == [None] * 15 and got[2] == [None] * 15


def test_hand_and_swap(spark):
    vectors = [([1.0, 0, 0], [0.0, 1, 0], [0.0, 0, 1]), ([-1.0, 0, 0], [0.0, 1, 0], [0.0, 0, 1]), ([1.0, 0, 0], [2.0, 0, 0], [0.0, 0, 1]), ([math.nan, 0, 0], [0.0, 1, 0], [0.0, 0, 1]), (None, None, None)]
    floats = [tuple(None if x is None else [float(y) for y in x] for x in v) for v in vectors]
    df = spark.createDataFrame([(i, "L", [0.5] * 63, *v) for i, v in enumerate(floats)], "i int, label string, aligned array<float>, x_vec array<float>, y_vec array<float>, z_vec array<float>")
    assert [r.h for r in df.select("i", pose.hand().alias("h")).orderBy("i").collect()] == ["R", "L", "R", None, None]
    swapped = pose.swap_hands(df).orderBy("i").collect()
    assert swapped[0].x_vec == [-1.0, 0.0, 0.0] and swapped[0].label == "R"
    back = pose.swap_hands(pose.swap_hands(df)).orderBy("i").collect()
    assert [r.label for r in back] == ["L"] * 5 and back[1].x_vec == [-1.0, 0.0, 0.0]
    with pytest.raises(KeyError):
        pose.swap_hands(df.drop("aligned"))
    with pytest.raises(Exception, match="label"):
        pose.swap_hands(df.withColumn("label", F.lit("X")), strict=True).collect()


def test_basis_is_orthonormal_and_turned_for_right(spark):
    rng = np.random.default_rng(1)
    data = [(i, side, [float(x) for x in rng.normal(size=63)]) for i, side in enumerate(["Left", "Right"])]
    df = spark.createDataFrame(data, "id int, side string, raw array<double>").withColumns({"w": F.lit(10), "h": F.lit(20)})
    for r in pose.align(df, "raw", "side", "w", "h").collect():
        m = np.array([r.x_vec, r.y_vec, r.z_vec])
        assert np.allclose(m @ m.T, np.eye(3), atol=1e-5)
        assert np.linalg.det(m) == pytest.approx(1 if r.side == "Left" else -1, abs=1e-4)
        assert np.linalg.norm(r.aligned[27:30]) == pytest.approx(1, abs=1e-5) and r.aligned[:3] == [0.0] * 3


def test_codes_go_round(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(["0", "1"], 66)) for _ in range(40)] + ["0" * 66, "1" * 66]
    df = spark.createDataFrame([(t,) for t in texts], "code string").withColumn("m", codes.masks(F.col("code")))
    df = df.select("code", "m.*").withColumn("old", codes.legacy_code(F.col("m_bend"), F.col("m_spread")))
    back = df.withColumn("n", codes.masks(F.col("old")))
    assert back.filter("n.m_bend <> m_bend or n.m_spread <> m_spread or n is null").count() == 0
    assert back.filter(codes.plain_code(F.col("m_bend"), F.col("m_spread")) != F.col("code")).count() == 0
    bad = spark.createDataFrame([(None,), ("",), ("0" * 65,), ("AAAAAAAAAAAA",), ("////////////\n",)], "c string")
    assert bad.filter(codes.masks(F.col("c")).isNotNull()).count() == 0


def test_codebook_ties_and_overlap(spark):
    b, a, c = ("1" + "0" * 65), ("01" + "0" * 64), ("001" + "0" * 63)
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate([b, a, c, a, b, c])], "file string, frame_idx bigint, code string")
    df = df.select("*", codes.masks(F.col("code")).alias("m")).select("file", "frame_idx", "code", "m.*")
    model = codebook.train(df, 2)
    assert [(r.label, r.code) for r in model.orderBy("label").collect()] == [(0, b), (1, a)]
    unknown = spark.createDataFrame([("0" * 65 + "1",), ("01" + "1" * 64,), ("11" + "0" * 64,)], "code string")
    unknown = unknown.select("code", codes.masks(F.col("code")).alias("m")).select("code", "m.*")
    got = {r.code: (r.token, r.overlap) for r in codebook.best_overlap(unknown, model).collect()}
    assert got == {"0" * 65 + "1": (0, 0), "01" + "1" * 64: (1, 1), "11" + "0" * 64: (0, 1)}
    assert {r.code: r.token for r in codebook.predict(df, model).collect()} == {b: 0, a: 1, c: 0}


def test_transitions_by_hand(spark):
    tokens = [("f", i, h, t) for i, (h, t) in enumerate(zip("LRLRLR", [0, 1, 0, 2, 1, 0], strict=True))]
    df = spark.createDataFrame([*tokens, tokens[0], ("f", 9, None, 1), ("f", 10, "L", None), ("g", 0, "L", 2)], "file string, frame_idx bigint, hand string, token int")
    assert rows(transitions.count(df, 1)) == [(0, 0, 1), (0, 1, 1), (1, 2, 1), (2, 0, 1)]
    assert rows(transitions.count(df, 2)) == [(0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 2, 1), (2, 0, 1)]
    assert rows(transitions.count(df, 3)) == [] and rows(transitions.count(df, 2, 2)) == [(0, 1, 2)]
    assert rows(transitions.merge(transitions.count_by_file(df, 2))) == rows(transitions.count(df, 2))
    assert transitions.count(df.limit(0), 1).count() == 0
    with pytest.raises(ValueError):
        transitions.count(df, 0)
    with pytest.raises(Exception, match="token outside"):
        transitions.count(df, 1, k=2).collect()


def test_long_tracks_are_cut_without_a_trace(spark, monkeypatch):
    rng = np.random.default_rng(3)
    track = rng.integers(0, 5, 200).tolist()
    idx = np.cumsum(rng.integers(1, 9, 200)).tolist()
    df = spark.createDataFrame([("f", i, "L", t) for i, t in zip(idx, track, strict=True)], "file string, frame_idx bigint, hand string, token int")
    monkeypatch.setattr(transitions, "PLACES", 8)
    monkeypatch.setattr(transitions, "FRAME_BITS", 4)
    want = {}
    for d in range(1, 4):
        for x, y in zip(track, track[d:], strict=False):
            want[x, y] = want.get((x, y), 0) + 1
    assert {(r.src, r.dst): r.n for r in transitions.count(df, 3).collect()} == want


def test_similarity_values(spark):
    upper = [(0, 1, 2), (0, 2, 1), (0, 3, 1), (1, 2, 3), (1, 3, 2), (2, 2, 7)]
    df = spark.createDataFrame(upper, "src int, dst int, n bigint")
    got = {(r.i, r.j): r.sim for r in similarity.similarity(df).collect()}
    want = {(0, 1): 5 / 26**0.5, (0, 2): 6 / 45**0.5, (0, 3): 4 / 20**0.5, (1, 2): 2 / 8**0.5, (1, 3): 2 / 13**0.5, (2, 3): 7 / 50**0.5}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(Exception, match="negative"):
        similarity.similarity(df.withColumn("n", -F.col("n"))).collect()


@pytest.mark.parametrize("symmetrize", [True, False])
def test_similarity_against_removed_columns(spark, monkeypatch, symmetrize):
    monkeypatch.setattr(similarity, "BLOCK", 5)
    rng = np.random.default_rng(4)
    c = rng.integers(0, 4, (12, 12)) * rng.integers(0, 2, (12, 12))
    df = spark.createDataFrame([(i, j, int(c[i, j])) for i in range(12) for j in range(12)], "src int, dst int, n bigint")
    got = {(r.i, r.j): r.sim for r in similarity.similarity(df, symmetrize).collect()}
    v = (c + c.T if symmetrize else c).astype(float)
    np.fill_diagonal(v, 0)
    for i in range(12):
        for j in range(i + 1, 12):
            keep = [k for k in range(12) if k not in (i, j)]
            a, b = v[i, keep], v[j, keep]
            want = a @ b / np.linalg.norm(a) / np.linalg.norm(b) if a.any() and b.any() else 0.0
            assert got.get((i, j), 0.0) == pytest.approx(want)


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(50, 51), (51, 50), (60, 60), (None, 3)]
    got = components.components(spark.createDataFrame([(70,), (None,)], "t int"), "t", spark.createDataFrame(chain, "i int, j int"), "i", "j")
    want = {(i, 0) for i in range(41)} | {(50, 50), (51, 50), (60, 60), (70, 70)}
    assert set(map(tuple, got.collect())) == want


def test_hot_keys(spark):
    data = [(0, i % 7, "x") for i in range(500)] + [(1, None, "x"), (None, 4, "x"), (None, None, "x")]
    df = spark.createDataFrame(data, "label int, cnt bigint, key string").repartition(5)
    df = materialise(df, "test")
    got = {r.key: (r.n_rows, r.n_values, r.total) for r in hot_keys.key_totals(df, "label", "cnt", 64).collect()}
    assert got == {0: (500, 500, sum(i % 7 for i in range(500))), 1: (1, 0, None), None: (2, 1, 4)}
    numbered = hot_keys.number_rows(df, "label", "cnt", 64).filter("key = 0").collect()
    assert sorted(r.row_no for r in numbered) == list(range(500)) and max(r.chunk for r in numbered) == 7
    assert [r.key for r in hot_keys.heavy_keys(hot_keys.key_totals(df, "label", "cnt"), 25).collect()] == [0]
    assert hot_keys.key_totals(df.limit(0), "label", "cnt").count() == 0
    chance = F.udf(lambda: random.randrange(3), "int").asNondeterministic()
    moving = spark.range(500).select(chance().alias("label"), F.lit(1).alias("cnt"))
    with pytest.raises(Exception, match="different partitions"):
        hot_keys.key_totals(moving, "label", "cnt").collect()


def test_running_total(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(50)] + [("b", 3, None)], "k string, t bigint, v bigint")
    got = {(r.k, r.t): r.s for r in prefix.running_total(df, ["k"], F.floor(F.col("t") / 7), [F.col("t")], "v", "s").collect()}
    assert got == {("a", i): i * (i - 1) // 2 for i in range(50)} | {("b", 3): 0}


TINY = "path_id bigint, path string, file string, start_idx bigint, n_rows int, aligned_63d array<array<float>>, is_mirror array<boolean>, delivered_at timestamp, pos int"


def test_compaction(spark):
    import datetime

    t = datetime.datetime(2026, 1, 1)
    name = "file_crop---ABCDEFGHIJ"
    data = [
        (1, f"in/{name}/part-000003.h5", None, None, 2, [[1.0], [2.0]], None, t, 1),
        (2, f"in/{name}__4-9.h5", f"{name}.h5", None, 9, [[2.0], None, [3.0]], [True, None, False], t, 1),
        (3, "lost.h5", None, None, 1, [[9.0]], None, t, 1),
        (4, f"in/{name}/part-1.h5", None, 0, 1, None, None, t, 1),
        (5, None, f"{name}.h5", 20, 0, [], None, t, 1),
    ]
    df = spark.createDataFrame(data, TINY)
    target = fresh_path(spark, "test")
    out = compaction.compact(df, target)
    low = f"{name.lower()}.h5"
    want = [(low, 3, [1.0], None, 1), (low, 4, [2.0], True, 2), (low, 6, [3.0], False, 1)]
    assert sorted(map(tuple, out.collect())) == want and sorted(map(tuple, compaction.committed(spark, target).collect())) == want
    assert rows(compaction.frames_in_several_files(out)) == [(low, 4)]
    assert compaction.compact(df.limit(0), fresh_path(spark, "test")).count() == 0


def test_compaction_commits_only_what_is_whole(spark, monkeypatch):
    df = spark.createDataFrame([(1, "p", "file_crop---abcdefghij.h5", 0, 1, [[1.0]], None, None, 1)], TINY)
    monkeypatch.setattr(compaction, "written_checksum", lambda t: (0, 0, 0))
    target = fresh_path(spark, "test")
    with pytest.raises(compaction.ChecksumMismatch):
        compaction.compact(df, target)
    with pytest.raises(Exception, match="(?i)path"):
        compaction.committed(spark, target)


def _random_frames(spark, n=60):
    rng = np.random.default_rng(5)
    data = []
    for f in "ab":
        for i in range(n):
            x, y, z = (rng.normal(size=3).tolist() for _ in range(3))
            data.append((f, i, (rng.integers(0, 3) + np.linspace(0, 1, 63) ** 2).tolist(), x, y, z, None if f == "a" else bool(i % 2)))
    return spark.createDataFrame(data, FRAME)


def test_pipeline_and_files(spark, tmp_path):
    df = _random_frames(spark)
    model = codebook.train(codebook.encode(df), 16)
    result = pipeline.run(df, pipeline.model_tokenizer(model), 16, 2)
    paths = result.save(str(tmp_path / "out"))
    s = np.load(paths["similarity_matrix.npy"])
    assert s.shape == (16, 16) and np.allclose(s, s.T) and (np.diag(s) == 1).all() and s.max() <= 1 + 1e-9
    c = np.load(paths["transition_matrix.npy"])
    assert c.sum() == result.counts.agg(F.sum("n")).first()[0]
    assert result.groups().count() == 16
    groups = json.loads((tmp_path / "out" / "super_cluster_map.json").read_text())
    assert groups == {str(r.token): r.super_cluster for r in result.groups().collect()}
    coded = materialise(codebook.encode(df), "codes")
    pipeline.save_report(coded, model, str(tmp_path / "report"), 5)
    text = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    n_codes = coded.select("code").distinct().count()
    assert text.startswith(f"2 recordings, 120 frames, {n_codes} distinct codes\n#1 label 0, ") and text.count("point 20") == 3
    models.save_json(model, str(tmp_path / "model"), 16)
    assert rows(models.load_json(spark, str(tmp_path / "model"))) == rows(model.select("label", "code", "m_bend", "m_spread", "cnt"))
    with pytest.raises(AttributeError):
        pipeline.tokenise(df, None)
    assert pipeline.report(codebook.encode(df).persist(), model, 5).count() > 0


def test_frames(spark):
    df = _random_frames(spark, 10)
    assert {r.file: r.n_frames for r in frames.file_meta(df).collect()} == {"a": 10, "b": 5}
    assert frames.single(df.union(df), "file", "frame_idx").count() == 20
    with pytest.raises(FileNotFoundError):
        frames.h5_paths("/nowhere/at/all")


def test_stream_adds_up(spark, tmp_path):
    tokens = [(f, i, "L", t) for f in "ab" for i, t in enumerate([0, 1, 1, 2])]
    kind = "file string, frame_idx bigint, hand string, token int"
    for f in "ab":
        spark.createDataFrame([t for t in tokens if t[0] == f], kind).coalesce(1).write.parquet(str(tmp_path / "in" / f))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    accumulate.accumulate(stream, str(tmp_path / "t"), str(tmp_path / "c"), 1).awaitTermination()
    whole = transitions.count(spark.createDataFrame(tokens, kind), 1)
    assert rows(accumulate.accumulated(spark, str(tmp_path / "t"))) == rows(whole)


def test_kmeans_without_usable_poses_and_with_clashing_columns(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(10 * (i % 2), 0.1, 63)], "x", "y") for i in range(20)]
    df = spark.createDataFrame(data + [(98, None, "x", "y"), (99, [1.0], "x", "y")], "id bigint, aligned array<float>, cluster string, pose string")
    got, _ = reduce.kmeans(df, "id", 2)
    of = dict(map(tuple, got.collect()))
    assert sorted(of) == list(range(20)) and len({of[0], of[1]}) == 2 and all(of[i] == of[i % 2] for i in of)
    assert reduce.kmeans(df.filter("id > 90"), "id", 2, cosines=True)[0].count() == 0


# ---- intermediate tables, and keys that hold most rows


def test_only_a_local_master_may_lack_a_shared_folder():
    class Unset:
        master = "spark://somewhere:7077"

        def get(self, name, default=None):
            return default

        def getConf(self):
            return self

        def getCheckpointDir(self):
            return None

    class Session:
        conf = sparkContext = Unset()

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        runtime.shared_dir(Session())


def _folders(spark):
    there = Path(runtime.run_dir(spark).removeprefix("file:"))
    return {p.name for p in there.iterdir()} if there.exists() else set()


def test_intermediate_tables_go(spark):
    df = spark.range(3)
    before = _folders(spark)
    with runtime.scratch(spark):
        materialise(df, "gone")
        with runtime.scratch(spark):
            materialise(df, "gone")
            inner = materialise(df, "inner", keep=True)
        assert inner.count() == 3
        kept = materialise(inner, "kept", keep=True)
    left = _folders(spark) - before
    assert len(left) == 1 and left.pop().startswith("kept") and kept.count() == 3
    runtime.release(spark)
    assert not _folders(spark)


def _most_in_a_task(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_spread_join_splits_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 16)
    data = [(0, i) for i in range(400)] + [(k, k) for k in range(1, 20)] + [(None, 1)]
    rows_ = spark.createDataFrame(data, "k int, id int")
    keys = rows_.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("x", F.col("k") * 2)
    keys = materialise(keys, "keys")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        joined = materialise(runtime.spread_join(rows_, keys, "k", "n", "id"), "joined")
        assert rows(joined.select("k", "id", "x")) == sorted([(k, i, 2 * k) for k, i in data if k is not None], key=str)
        plan = runtime.spread_join(rows_, keys, "k", "n", "id")
        assert _most_in_a_task(plan) < 400
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_a_hot_track_is_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(transitions, "FRAME_BITS", 4)
    monkeypatch.setattr(transitions, "PLACES", 16)
    df = spark.createDataFrame([("f", i, "L", i % 3) for i in range(600)] + [(None, 1, "L", 0)], "file string, frame_idx bigint, hand string, token int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        joined = df.join(df.select("file", "hand").distinct(), ["file", "hand"])  # leaves a partitioning by track
        whole = prefix.running_total(joined, ["file", "hand"], F.shiftright("frame_idx", 4), [F.col("frame_idx")], "token", "s", "t")
        assert _most_in_a_task(whole) < 400 and whole.agg(F.max("t")).first()[0] == 600
        assert _most_in_a_task(transitions.lag_pairs(df, 1)) < 400
        assert transitions.count(df, 1).agg(F.sum("n")).first()[0] == 599
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_components_with_a_hub(spark, monkeypatch):
    monkeypatch.setattr(runtime, "HOT_ROWS", 8)
    monkeypatch.setattr(components, "HOT_ROWS", 8)
    edges = [(7, i) for i in range(8, 60)] + [(i, i + 1) for i in range(100, 110)] + [(60, 3), (59, 60)]
    df = spark.createDataFrame(edges, "i int, j int")
    got = components.components(df.select("i"), "i", df, "i", "j")
    assert set(map(tuple, got.collect())) == {(i, 3) for i in [3, *range(7, 61)]} | {(i, 100) for i in range(100, 111)}


def test_rows_are_numbered_range_by_range(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 8)
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "v int")
    assert rows(prefix.numbered(df, [F.desc("v")], "n")) == rows(df.withColumn("n", (100 - F.col("v")).cast("bigint")))


# ---- sources


H5PY = """
import numpy as np

class File(dict):
    def __init__(self, path, mode):
        super().__init__(np.load(path))
    def __enter__(self):
        return self
    def __exit__(self, *error):
        pass
"""


def test_hdf5_files_through_a_stand_in(spark, tmp_path, monkeypatch):
    (tmp_path / "h5py.py").write_text(H5PY)
    spark.sparkContext.addPyFile(str(tmp_path / "h5py.py"))
    monkeypatch.setattr(frames, "BATCH_ROWS", 2)
    folder = tmp_path / "in"
    folder.mkdir()
    pose = np.arange(5 * 63, dtype=np.float32).reshape(5, 63)
    turn = np.ones((5, 3), np.float32)
    made = {
        "b.h5": {"aligned_63d": pose, "x_vec": turn, "y_vec": turn, "z_vec": turn, "is_mirror": np.array([0, 1, 0, 0, 1], bool)},
        "a.h5": {"aligned_63d": pose[:2]},
        "c.h5": {"other": pose},
        "d.txt": {"aligned_63d": pose},
    }
    for name, data in made.items():
        with open(folder / name, "wb") as f:
            np.savez(f, **data)
    whole = spark.dataSource.register(frames.H5Source) or spark.read.format("hand_h5").load(str(folder))
    got = {(r.file, r.frame_idx): r for r in whole.collect()}
    assert sorted(got) == [("a.h5", 0), ("a.h5", 1), *(("b.h5", i) for i in range(5))]
    assert got["b.h5", 3].aligned == pose[3].tolist() and got["b.h5", 1].is_mirror and got["b.h5", 0].x_vec == [1.0] * 3
    assert got["a.h5", 1].is_mirror is None and got["a.h5", 1].z_vec is None
    assert whole.rdd.getNumPartitions() == 3
    assert frames.load(spark, str(folder)).count() == 5 and frames.load(spark, str(folder / "b.h5")).count() == 3
    assert frames.oriented(whole).count() == 5
    assert {r.file for r in spark.read.format("hand_h5").option("maxFiles", 1).load(str(folder)).collect()} == {"a.h5"}
    assert frames.load(spark, str(folder / "*.h5"), str(tmp_path / "kept")).count() == 5
    with open(folder / "e.h5", "wb") as f:
        np.savez(f, aligned_63d=pose)
    assert frames.load(spark, str(folder / "*.h5"), str(tmp_path / "kept")).count() == 10  # a new file, a new key


def test_tables_are_kept_by_what_they_are_made_of(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(4)

    df = spark.range(9)
    for seed in (1, 1, 2):
        key = cache.rows_key(df, "overview", seed)
        assert cache.cached(spark, str(tmp_path), key, make).count() == 4
    assert len(made) == 2 and cache.rows_key(df.repartition(5)) == cache.rows_key(df) != cache.rows_key(df.limit(8))


def test_hands_of_images(spark):
    def stub():
        def detect(content):
            side, n = content.decode().split()
            return [(side, [m / 63 + i for m in range(63)]) for i in range(int(n))], 100, 50

        return detect

    df = spark.createDataFrame([("a", b"Right 2"), ("b", b"Left 0"), ("c", b"Left 1")], "path string, content binary")
    got = {(r.path, r.hand_idx): r for r in images.hands(df, stub).collect()}
    assert {k: r.handedness for k, r in got.items()} == {("a", 0): "Left", ("a", 1): "Left", ("c", 0): "Right"}
    assert got["a", 1].wrist_px == pytest.approx([100.0, 50 * (1 + 1 / 63), 100 * (1 + 2 / 63)])
    assert got["a", 0].aligned[:3] == [0.0] * 3 and len(got["a", 0].aligned) == 63


# ---- reduction


def test_projection_of_whole_groups(spark):
    rng = np.random.default_rng(6)
    poses = rng.normal(size=(60, 63)) * np.linspace(3, 1, 63)
    data = [(i, "ab"[i % 2], p.tolist(), "x") for i, p in enumerate(poses)] + [(90, None, poses[0].tolist(), "x"), (91, "a", None, "x"), (92, "c", poses[0].tolist(), "x")]
    df = spark.createDataFrame(data, "id bigint, g string, aligned array<double>, v string")
    got = {r.id: (r.x, r.y) for r in reduce.pca_groups(df, "g", "id").collect()}
    assert sorted(got) == list(range(60))
    for k in (0, 1):
        m = poses[k::2] - poses[k::2].mean(axis=0)
        _, _, axes = np.linalg.svd(m, full_matrices=False)
        two = axes[:2] * np.sign(axes[:2][np.arange(2), np.abs(axes[:2]).argmax(axis=1)])[:, None]
        assert np.allclose([got[i] for i in range(k, 60, 2)], m @ two.T)


def test_a_reducer_gets_a_sample_of_each_group(spark):
    data = [(i, "ab"[i % 4 == 0], [float(i)] * 63) for i in range(80)] + [(90 + i, "c", [0.0] * 63) for i in range(3)]
    df = spark.createDataFrame(data, "id bigint, g string, aligned array<double>")
    first = lambda pdf: pdf.assign(x=[a[0] for a in pdf["aligned"]], y=float(len(pdf)))
    got = reduce.per_group(df, "g", "id", first, n=15).collect()
    assert Counter(r.g for r in got) == {"a": 15, "b": 15} and all(r.x == r.id and r.y == 15 for r in got)
    assert rows(reduce.per_group(df.repartition(3), "g", "id", first, n=15)) == sorted(map(tuple, got), key=str)


def test_kmeans_models_are_kept_and_judged(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rng = np.random.default_rng(7)
    data = [(i, (rng.normal(size=63) * 0.05 + np.sin(np.arange(63) * (1 + i % 3))).tolist()) for i in range(45)]
    df = spark.createDataFrame(data, "id bigint, aligned array<float>")
    model = reduce.fit_kmeans(df, 3, cosines=True)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    of = dict(map(tuple, reduce.assign_kmeans(again, df, "id").collect()))
    assert of == dict(map(tuple, reduce.assign_kmeans(model, df, "id").collect())) and len(set(of.values())) == 3
    costs = dict(reduce.elbow(df, [2, 3]))
    assert costs[3] < costs[2]
    scores = dict(reduce.silhouette(df, [2, 3]))
    assert scores[3] > scores[2]


def test_cold_tokens_go_over_into_all_others(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, 2, 3)], "src int, dst int, n bigint")
    got = {(r.i, r.j): r.sim for r in similarity.similarity(df, cold_start="uniform", k=5).collect()}
    v = np.zeros((5, 5))
    v[0, 1] = v[1, 0] = 2
    v[1, 2] = v[2, 1] = 3
    v[3, [0, 1, 2, 4]] = v[4, [0, 1, 2, 3]] = 1
    for i in range(5):
        for j in range(i + 1, 5):
            keep = [c for c in range(5) if c not in (i, j)]
            a, b = v[i, keep], v[j, keep]
            assert got.get((i, j), 0.0) == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b) if a.any() and b.any() else 0.0)
    with pytest.raises(ValueError):
        similarity.similarity(df, cold_start="uniform")
    with pytest.raises(Exception, match="negative token"):
        similarity.similarity(df.withColumn("src", F.lit(-1))).collect()
