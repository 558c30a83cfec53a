"""Operators for training data on small inputs, against brute force."""

import math
import time
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from handloom.functions.codes import legacy_code, masks
from handloom.llm import cooccurrence, heavy_items, mix, pivot_clusters, runs, subjects, subtitles, tokenise
from handloom.operators import prefix

tokenizers = pytest.importorskip("tokenizers")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- heavy items


def test_reed_solomon_corrects_two_symbols():
    rng = np.random.default_rng(1)
    bend, spread = rng.integers(0, 1 << 45, 30), rng.integers(0, 1 << 21, 30)
    for word, b, s in zip(heavy_items.encode(bend, spread).astype(np.int64), bend, spread, strict=True):
        assert heavy_items._message(heavy_items.correct(word)) == (b, s)
        for n in (1, 2):
            bad = word.copy()
            at = rng.choice(15, n, replace=False)
            bad[at] ^= rng.integers(1, 64, n)
            assert heavy_items._message(heavy_items.correct(bad)) == (b, s)


def _codes(rng, n):
    return ["".join(rng.choice(["0", "1"], 66)) for _ in range(n)]


def test_codes_are_decoded_as_by_the_columns(spark):
    rng = np.random.default_rng(12)
    texts = _codes(rng, 50) + ["", None, "0" * 65, "0" * 65 + "2", "A" * 12, "A" * 12 + "\n", "/" * 12 + "\n", "A" * 11 + "=\n", "é" * 33, "A" * 11 + "éa", "0" * 64 + "é"]
    df = spark.createDataFrame([(t, "f", 1) for t in texts], "bitstring string, file string, cnt bigint")
    m = masks(F.col("bitstring"))
    both = df.union(df.withColumn("bitstring", legacy_code(m["m_bend"], m["m_spread"])))
    want = both.select("file", m["m_bend"].alias("b"), m["m_spread"].alias("s"), "cnt").filter("b is not null")
    assert rows(heavy_items.usable_counts(both)) == rows(want)


@pytest.mark.parametrize("rounds,groups", [(6, 4096), (1, 4096), (6, 8)])
def test_heavy_codes_are_all_found(spark, monkeypatch, rounds, groups):
    monkeypatch.setattr(heavy_items, "ROUNDS", rounds)
    monkeypatch.setattr(heavy_items, "MOST_GROUPS", groups)
    rng = np.random.default_rng(2)
    codes = _codes(rng, 120)
    data = [(f"f{i % 9}", codes[min(int(rng.exponential(12)), 119)], int(rng.integers(1, 9)), "x") for i in range(1500)]
    data += [(None, codes[0], 50, "x"), ("f", None, 5, "x"), ("f", codes[1], None, "x"), ("f", codes[1][:60], 9, "x"), ("f", "", 9, "x")]
    df = spark.createDataFrame(data, "file string, bitstring string, cnt bigint, m_bend string")
    m = masks(F.col("bitstring"))
    again = df.filter("file = 'f1'").withColumn("bitstring", F.coalesce(legacy_code(m["m_bend"], m["m_spread"]), "bitstring"))
    once = {}
    for f, c, n, _ in data:
        if c is not None and len(c) == 66 and n is not None:
            once[f, c] = max(once.get((f, c), 0), n)
    sums = Counter()
    for (_, c), n in once.items():
        sums[c] += n
    total = sum(sums.values())
    got = {r.bitstring: (r.frames, r.total) for r in heavy_items.heavy_codes(df.union(again), 0.02).collect()}
    assert got == {c: (n, total) for c, n in sums.items() if n >= 0.02 * total}
    assert heavy_items.heavy_codes(df.limit(0), 0.02).count() == 0


# ---- co-occurrence


@pytest.mark.parametrize("block", [2048, 4])
def test_pairs_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cooccurrence, "BLOCK", block)
    rng = np.random.default_rng(3)
    data = [(f"b{rng.integers(0, 12)}", int(rng.integers(0, 20)), 1) for _ in range(300)] + [("hot", i, 1) for i in range(20)] * 2
    data += [(None, 1, 1), ("b0", None, 1), ("empty", None, 1)]
    df = spark.createDataFrame(data, "file string, label int, n int")
    baskets = {}
    for f, x, _ in data:
        if f is not None:
            baskets.setdefault(f, set()).update([x] if x is not None else [])
    pairs = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    single = Counter(x for b in baskets.values() for x in b)
    items = cooccurrence.distinct_items(df, "file", "label")
    assert {(r.a, r.b): r.n for r in cooccurrence.pair_counts(items, block).collect()} == pairs
    for r in cooccurrence.together(df, "file", "label").collect():
        assert (r.n, r.n_a, r.n_b, r.whole) == (pairs[r.a, r.b], single[r.a], single[r.b], len(baskets))
        assert r.lift == pytest.approx(r.n * r.whole / r.n_a / r.n_b) and r.pmi == pytest.approx(math.log2(r.lift))
    assert cooccurrence.together(df.limit(0), "file", "label").count() == 0


def test_recordings_without_a_usable_label_count(spark):
    data = [(f"b{i % 40}", int(j)) for i in range(40) for j in {i % 5, (i + 1) % 5}] + [("none", None), ("none", None)]
    df = spark.createDataFrame(data, "file string, label int")
    got = rows(cooccurrence.together(df, "file", "label"))
    assert got and {r[5] for r in got} == {41}
    few = rows(cooccurrence.together(df, "file", "label", 8))
    assert few == [r for r in got if r[2] >= 8] and few
    assert cooccurrence.together(df, "file", "label", 9).count() == 0


def test_links_count_once(spark):
    data = [("f", 1, 2, 3), ("f", 1, 2, 3), ("f", 2, 1, 4), ("g", 1, 3, 1), ("g", 1, 1, 9), ("g", 2, 3, None), (None, None, 3, 1)]
    df = spark.createDataFrame(data, "file string, src int, dst int, n bigint")
    got = {(r.a, r.b): (r.n, r.n_a, r.n_b, r.whole, r.lift) for r in cooccurrence.joined_by(df, "file", "src", "dst", "n").collect()}
    assert got == {(1, 2): (7, 8, 7, 8, 7 * 16 / 56), (1, 3): (1, 8, 1, 8, 2.0)}


# ---- runs


def test_agglomeration_merges_what_may_merge():
    got = runs.agglomerate(np.array([True, True, False, True]), np.array([3.0, 1.0, 0.0, 2.0]))
    assert got.tolist() == [0, 0, 0, 3, 3]


@pytest.mark.parametrize("bits", [12, 2])
def test_runs_against_a_plain_loop(spark, monkeypatch, bits):
    monkeypatch.setattr(runs, "SPAN_BITS", bits)
    rng = np.random.default_rng(4)
    data = []
    for f, n in (("a", 400), ("b", 3), ("c", 1), (None, 50)):
        idx = np.cumsum(rng.choice([1, 2, 9, 13], n, p=[0.6, 0.2, 0.15, 0.05]))
        data += [(f, int(i), "LR"[int(rng.random() < 0.2)], int(rng.random() < 0.15)) for i in idx]
    want = set()
    for f in ("a", "b", "c", None):
        for h in "LR":
            track = [(i, t) for g, i, k, t in data if g == f and k == h]
            at = 0
            while at < len(track):
                end = at
                while end + 1 < len(track) and track[end + 1][1] == track[end][1] and track[end + 1][0] - track[end][0] <= 12:
                    end += 1
                if end - at >= 2:
                    want.add((f, h, track[at][0], track[end][0], end - at + 1))
                at = end + 1
    df = spark.createDataFrame(data, "file string, frame_idx bigint, hand string, state int")
    got = runs.collapse(df, runs.numbers, 0.0, 12, 3)
    assert set(map(tuple, got.collect())) == want and got.count() == len(want)
    assert runs.collapse(df.limit(0), runs.numbers, 0.0, 12, 3).count() == 0


def test_unusable_poses_do_not_end_a_run(spark):
    good = [1.0] * 63
    v = ([1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0])
    poses = [good, None, [0.0] * 63, [x * 50 for x in good], [math.nan] * 63, good, good[:5]]
    data = [("f", i, p, *v, None) for i, p in enumerate(poses)] + [("f", 0, good, *v, None), ("f", 7, good, *v, True), ("f", 8, good, None, v[1], v[2], False)]
    df = spark.createDataFrame(data, "file string, frame_idx bigint, aligned array<float>, x_vec array<float>, y_vec array<float>, z_vec array<float>, is_mirror boolean")
    assert rows(runs.collapse(runs.single_poses(df), runs.poses, 0.15, 12, 3)) == [("f", "R", 0, 5, 3)]


# ---- tokens

ODD = ["", None, " ", "Hello world's  end\n\n", "a" * 500, "<|endoftext|>", "naïve café ½² ٣", "\x1c\x85 x\xa0", "😀👍🏽", "日本語テキスト", "00:01:02,345 --> 00:01:04,000", "don't DON'T 'll"]


def test_ids_equal_a_public_tokenizer(spark, monkeypatch):
    path = tokenise.default_path()
    reference = tokenizers.Tokenizer.from_file(path)
    reference.encode_special_tokens = True
    rng = np.random.default_rng(5)
    letters = list("aeinrst  '\n\t01é中ß😀.,-")
    texts = ODD + ["".join(rng.choice(letters, rng.integers(0, 80))) for _ in range(300)] + ["long text " * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "ids bigint, text string").repartition(3)
    want = {i: reference.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    monkeypatch.setattr(tokenise, "FLUSH_IDS", 50)
    got = tokenise.token_ids(df.withColumnRenamed("ids", "doc_id"), "doc_id", "text")
    assert {r.doc_id: list(r.ids) for r in got.collect()} == want
    counted = tokenise.token_counts(df.withColumnRenamed("ids", "doc_id"), "doc_id", "text")
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == {i: len(x) for i, x in want.items()}
    assert tokenise.decoded_right(df.withColumnRenamed("ids", "doc_id"), "doc_id", "text").filter("not same").count() == 0


def test_bounded_tables_and_long_texts(monkeypatch):
    monkeypatch.setattr(tokenise, "MAX_STATES", 20)
    monkeypatch.setattr(tokenise, "MAX_PIECES", 5)
    monkeypatch.setattr(tokenise, "LONG_TEXT", 50)
    path = tokenise.default_path()
    enc, reference = tokenise.Encoder(path), tokenizers.Tokenizer.from_file(path)
    text = "The transducer forgets its states, " + "xyz" * 200 + " and starts anew without changing a token."
    assert list(enc.encode(text)) == reference.encode(text, add_special_tokens=False).ids
    assert enc.decode(enc.encode(text)) == text


# ---- mixing


def _mix_input(spark):
    rng = np.random.default_rng(6)
    data = [(i, ["a", "b", "c"][int(rng.choice(3, p=[0.7, 0.25, 0.05]))], int(rng.integers(0, 40))) for i in range(400)]
    sized = spark.createDataFrame(data, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([(" A ", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    return data, sized, targets


@pytest.mark.parametrize("ranges", [1 << 16, 16])
def test_mix_keeps_shares_repeats_and_budget(spark, monkeypatch, ranges):
    monkeypatch.setattr(prefix, "RANGE_ROWS", ranges)
    data, sized, targets = _mix_input(spark)
    total = sum(n for *_, n in data)
    got = sorted(mix.mix(sized, targets, total // 4).collect(), key=lambda r: (r.finish, r.source, r.copy, r.doc_id))
    at = 0
    for r in got:
        assert r.starts_at == at
        at += r.n_tokens
    assert at <= total // 4
    repeats = Counter((r.source, r.doc_id) for r in got)
    most = {"a": 1, "b": 2, "c": 2}
    assert all(n <= most[s] for (s, _), n in repeats.items())
    have = Counter()
    for r in got:
        have[r.source] += r.n_tokens
    left = {s: sum(n for _, x, n in data if x == s) * most[s] for s in most}
    if left["c"] > have["c"]:  # none has run out: shares stand to each other as the targets do
        assert have["a"] / have["b"] == pytest.approx(0.4 / 0.3, rel=0.1)


def test_missed_sources_against_the_definition(spark):
    data, sized, targets = _mix_input(spark)
    total = sum(n for *_, n in data)
    supply = {s: sum(n for _, x, n in data if x == s) * k for s, k in (("a", 1), ("b", 2), ("c", 2), ("none", 3))}
    want = {s for s, share in (("a", 0.4), ("b", 0.3), ("c", 0.2), ("none", 0.1)) if supply[s] < share * total}
    assert {r.source for r in mix.reached(sized, targets).filter("missed").collect()} == want
    docs = spark.createDataFrame([(1, "x y", "A "), (2, None, "b"), (3, "", None), (4, "z", "other")], "doc_id bigint, text string, source string")
    assert rows(mix.sized_documents(docs, targets).select("doc_id", "source", "n_tokens")) == [(1, "a", 2), (2, "b", 0)]
    assert mix.mix(sized.limit(0), targets).count() == 0
    again = targets.unionByName(targets.withColumn("target_share", F.lit(0.05))).union(targets.selectExpr("null", "0.5", "1"))
    assert rows(mix.reached(sized, again)) == rows(mix.reached(sized, targets))


def test_unused_rounds_are_not_queued_and_change_nothing(spark):
    _, sized, targets = _mix_input(spark)
    many = targets.withColumn("max_repeats", F.lit(50))
    budget = sized.agg(F.sum("n_tokens")).first()[0]
    every = sorted(mix.schedule(sized, many).collect(), key=lambda r: (r.finish, r.source, r.copy, r.doc_id))
    at, want = 0, []
    for r in every:
        if at + r.n_tokens <= budget:
            want.append((r.doc_id, r.source, r.copy, at))
        at += r.n_tokens
    assert rows(mix.mix(sized, many).select("doc_id", "source", "copy", "starts_at")) == sorted(want, key=str)
    assert mix.schedule(sized, many, budget).count() < len(every)


def test_a_hot_source_is_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 64)
    sized = spark.createDataFrame([(i, "a" if i % 20 else "b", 3) for i in range(2000)], "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    for name, value in (("autoBroadcastJoinThreshold", -1), ("adaptive.coalescePartitions.enabled", False)):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        planned = mix.schedule(sized, targets)
        tasks = planned.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 4 and max(r["count"] for r in tasks) < 0.5 * planned.count()
    finally:
        for name in ("autoBroadcastJoinThreshold", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{name}")


def test_missed_sources_come_from_the_mix(spark):
    _, sized, targets = _mix_input(spark)
    plan = mix.mix(sized, targets, 1000)._jdf.queryExecution().toString()
    assert "starts_at" in plan and "ranges-" in plan  # ordered by ranges of finish times, then cut
    got = {r.source: r for r in mix.reached(sized, targets).collect()}
    mixed = {r.source: r.t for r in mix.mix(sized, targets).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert {s: r.tokens for s, r in got.items() if r.tokens} == mixed
    assert got["none"].missed and got["none"].tokens == 0


# ---- clusters


@pytest.mark.parametrize("small,block,first,leaf", [(8192, 20_000, 4096, 1024), (5, 7, 4, 6)])
def test_clusters_are_the_components(spark, monkeypatch, small, block, first, leaf):
    monkeypatch.setattr(pivot_clusters, "SMALL", small)
    monkeypatch.setattr(pivot_clusters, "LEAF", leaf)
    monkeypatch.setattr(pivot_clusters, "BLOCK", block)
    monkeypatch.setattr(pivot_clusters, "FIRST", first)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(4, 63))
    base[:, 27:30] = [1.0, 0.0, 0.0]
    step = np.zeros(63)
    step[40] = 0.1  # a chain: neighbours are similar, ends are not
    poses = [base[0] + rng.normal(size=63) * 0.004 for _ in range(30)] + [base[1] + i * step for i in range(12)] + [base[2]] * 5 + [base[3]]
    for p in poses:
        p[27:30] = [1.0, 0.0, 0.0]
    n = len(poses)
    data = [(i, (p * (100 if i % 3 == 0 else 1)).tolist(), "x") for i, p in enumerate(poses)]
    data += [data[3], (n, None, "x"), (n + 1, [0.0] * 63, "x"), (n + 2, [math.inf] * 63, "x"), (None, poses[0].tolist(), "x")]
    df = spark.createDataFrame(data, "feature_id bigint, aligned array<float>, pose string")
    m = np.array(poses).astype(np.float32).astype(float)
    near = np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2)) <= 0.12
    root = list(range(n))
    for _ in range(n):
        root = [min(root[j] for j in range(n) if near[i, j]) for i in range(n)]
    sizes = Counter(root)
    want = {(i, r) for i, r in enumerate(root) if sizes[r] >= 3}
    members = pivot_clusters.clusters(df)
    assert set(map(tuple, members.select("id", "cluster_id").collect())) == want
    for r in pivot_clusters.described(members).collect():
        ids = [i for i, c in want if c == r.cluster_id]
        spread = {i: ((m[ids] - m[i]) ** 2).sum() for i in ids}
        assert r.n_members == len(ids) and spread[r.medoid_id] <= min(spread.values()) + 1e-6
    assert pivot_clusters.clusters(df.limit(0)).count() == 0


# ---- subjects

SUBTITLE = """1
00:00:01,000 --> 00:00:02,000
- The <i>verdict</i> is in.

2
00:00:03,000 --> 00:00:04,000
[door slams]

2
00:00:03,000 --> 00:00:04,000
[door slams]

3
OO:00:05,000 --&gt; 00:00:06,000
OTHO: Objection,
Your Honour!

4
00:00:07,000 --> 00:00:08,000
Downloaded from somewhere.example
"""


def test_spoken_cues():
    assert len(subtitles.cues(SUBTITLE)) == 4
    said = [s for s in map(subtitles.spoken, subtitles.cues(SUBTITLE)) if s]
    assert [s.strip("- ").replace("  ", " ") for s in said] == ["The verdict is in.", "Objection, Your Honour!"]
    assert subtitles.cues("") == [] and subtitles.spoken_words("no cue at all") == []
    assert subtitles.spoken_words(SUBTITLE.replace("\n", "\r\n")) == subtitles.spoken_words(SUBTITLE)


def test_long_texts_are_read_once():
    times = "1\n00:00:01,000 --> 00:00:02,000\n"
    for piece in ("<", "{", "&lt;", "&lt;i", "<b> ", "A", "[ ", "\n", "00:", ". ", "x.", "1\n"):
        text = times + piece * 300_000
        began = time.time()
        subtitles.spoken_words(text)
        assert time.time() - began < 5, piece
    assert subtitles.plain("a <i>b</i> {c} &lt;i&gt;d <e") == "a  b     d <e"
    rules = subjects.Rules({}, {"w0": [(frozenset({"w0", "w9"}), "law", 0.9)]})
    assert rules.area_of([f"w{i}" for i in range(200_000)]) == "law" and rules.area_of(["w0"]) is None


def test_adverts_have_an_address_or_a_handle():
    for advert in ("Subtitles by Otho_12", "www.somewhere.net", "Go to SOMEWHERE.EXAMPLE now!", "sync by n17crew"):
        assert subtitles.spoken(advert) is None, advert
    for said in ("Stop.Now", "He left...and came back.", "Room B12, please.", "In 1984 she left.", "It was 3.5 metres."):
        assert subtitles.spoken(said) is not None, said


def _cued(spark, data):
    return spark.createDataFrame(data, "areas array<string>, words array<string>")


def test_rules_against_brute_force(spark):
    rng = np.random.default_rng(9)
    data = []
    for _ in range(300):
        tagged = rng.random() < 0.4
        words = [f"w{i:02d}" for i in range(12) if rng.random() < (0.5 if tagged == (i % 2 == 0) else 0.25)]
        data.append((["law"] if tagged else [], words))
    found, chance = subjects.mine(_cued(spark, data))
    n, k = Counter(), Counter()
    for areas, words in data:
        for size in (1, 2, 3):
            for w in combinations(words, size):
                n[frozenset(w)] += 1
                k[frozenset(w)] += bool(areas)
    telling = {w for w in n if len(w) == 1 and k[w] >= 3 and k[w] / n[w] >= subjects.LEAST_LIFT * chance["law"]}
    assert {w for w, *_ in found if len(w) == 1} == {w for w in telling if k[w] / n[w] >= subjects.LEAST_CONFIDENCE}
    sure = {w: k[w] / (n[w] + 1) for w in n}
    for w, area, c, m in found:
        assert area == "law" and (c, m) == (k[w] / n[w], n[w])
    words = set().union(*telling)
    for w in n:  # what beats all of its parts is found
        parts = [frozenset(x) for size in range(1, len(w)) for x in combinations(w, size)]
        if len(w) > 1 and w <= words and k[w] >= 3 and k[w] / n[w] >= subjects.LEAST_CONFIDENCE and all(sure[w] > sure[x] + subjects.GAIN for x in parts):
            assert w in {x for x, *_ in found}


def test_long_repeated_cues_are_mined_in_time(spark):
    rng = np.random.default_rng(10)
    lyric = [f"sing{i:02d}" for i in range(40)]
    data = [(["music"], lyric)] * 6 + [([], ["rain", "again"])] * 60
    data += [(["music"] if rng.random() < 0.5 else [], [w for w in lyric if rng.random() < 0.8]) for _ in range(30)]
    began = time.time()
    subjects.mine(_cued(spark, data))
    assert time.time() - began < 60


def test_areas_of_held_out_documents(spark):
    rng = np.random.default_rng(8)
    terms = {"law": ["verdict", "plaintiff", "clause", "appeal"], "music": ["chorus", "violin", "tempo", "encore"]}

    def text(share, area):
        out = []
        for i in range(20):
            line = f"Careful with the {rng.choice(terms[area])}, please." if i < share else rng.choice(["Where is the key?", "It rains again.", "Sit down, please."])
            out.append(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\n{line}\n")
        return "\n".join(out)

    data, truth = [], {}
    for i in range(120):
        area, share = ["law", "music"][i % 2], [1, 10][i % 3 > 0]
        data.append((i, text(share, area)))
        truth[i] = {area} if share == 10 else set()
    docs = spark.createDataFrame([*data, (900, None), (901, ""), (902, " ")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, a) for i in range(60) for a in (truth[i] or {"none"})] + [(1, None), (None, "law")], "doc_id bigint, subject string")
    areas = spark.createDataFrame([("law", ""), ("music", "")], "subject string, gloss string")
    rules = subjects.learn(docs, labels, areas)
    found = subjects.area_shares(docs, rules).filter(F.col("n_cues") >= subjects.SHARE * F.col("n_spoken")).collect()
    got = {i: {r.subject for r in found if r.doc_id == i} for i in range(60, 120)}
    assert np.mean([got[i] == truth[i] for i in got]) >= 0.9
    nothing = subjects.learn(docs, labels.limit(0), areas)
    assert subjects.area_shares(docs, nothing).count() == 0


def _subtitles(rows):
    """``(doc_id, text)`` of ``(doc_id, lines)``."""
    return [(i, "\n".join(f"{k}\n00:00:{k:02d},000 --> 00:00:{k:02d},900\n{line}\n" for k, line in enumerate(lines))) for i, lines in rows]


@pytest.mark.parametrize("n_labelled", [20, 2100])
def test_other_documents_are_mined_along_however_many_are_labelled(spark, n_labelled):
    odd = [f"{''.join(chr(97 + int(d)) for d in f'{i:04d}')} nothing today" for i in range(n_labelled)]  # no upload twice
    rows = [(i, ["The verdict stands." if i % 2 else "It rains again.", odd[i]]) for i in range(n_labelled)]
    rows += [(5000 + i, ["The verdict, plaintiff.", f"Weather {'x' * (i + 3)}."]) for i in range(40)]  # without a label
    rows += [(6000 + i, ["It rains again.", f"Weather {'y' * (i + 3)}."]) for i in range(60)]
    rows += [(9000, ["Plaintiff.", "Nobody here."])]
    docs = spark.createDataFrame(_subtitles(rows), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, "law" if i % 2 else "none") for i in range(n_labelled)], "doc_id bigint, subject string")
    rules = subjects.learn(docs, labels, spark.createDataFrame([("law", "")], "subject string, gloss string"))
    assert rules.single["verdict"][0] == "law"
    assert [r.subject for r in subjects.area_shares(docs, rules).filter("doc_id = 9000").collect()] == ["law"]


def test_rules_come_from_all_labelled_documents(spark):
    ids = spark.range(20_100).orderBy(F.xxhash64("id"), "id").collect()
    law = {r.id for r in ids[-20:]}  # the last by hash
    rows = [(r.id, ["The verdict stands." if r.id in law else "It rains again.", "".join(chr(97 + int(d)) for d in f"{r.id:05d}")]) for r in ids]
    docs = spark.createDataFrame(_subtitles(rows), "doc_id bigint, text string")
    labels = spark.createDataFrame([(r.id, "law" if r.id in law else "none") for r in ids], "doc_id bigint, subject string")
    rules = subjects.learn(docs, labels, spark.createDataFrame([("law", "")], "subject string, gloss string"))
    found = subjects.area_shares(docs, rules).select("doc_id").distinct().collect()
    assert law <= {r.doc_id for r in found}
