"""Queries and SQL of the operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handloom.llm import cooccurrence, heavy_items, mix, pivot_clusters, runs, subjects, tokenise
from handloom.runtime import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- most frequent items

_USABLE_SQL = r"""
with b as (select file, cnt, bitstring, hex(from_base64(case when regexp_full_match(bitstring, '[A-Za-z0-9+/]{12}\n') then substr(bitstring, 1, 12) end)) as h
  from histogram where cnt is not null and (regexp_full_match(bitstring, '[01]{66}') or regexp_full_match(bitstring, '[A-Za-z0-9+/]{12}\n'))),
u as (select file, cnt, case when h is null then bitstring else array_to_string(list_transform(range(66),
    lambda i: (cast('0x' || substr(h, cast(2 * (i // 8) + 1 as bigint), 2) as int) >> cast(i % 8 as int)) & 1), '') end as bitstring
  from b where h is null or cast('0x' || substr(h, 17, 2) as int) < 4),
o as (select file, bitstring, max(cnt) as cnt from u group by file, bitstring),
t as (select sum(cnt) as total from o)
"""


@query(_USABLE_SQL + "select bitstring from o group by bitstring having sum(cnt) >= 0.004 * (select total from t)")
def p2_found(spark, folder):
    return heavy_items.heavy_codes(table(spark, folder, "histogram"), 0.004).select("bitstring")


@query(
    _USABLE_SQL
    + "select bitstring, cast(sum(cnt) as bigint) as frames from o group by bitstring having sum(cnt) >= 0.001 * (select total from t)"
)
def p2_frequent_codes(spark, folder):
    return heavy_items.heavy_codes(table(spark, folder, "histogram"), 0.001).select("bitstring", "frames")


# ---- items that appear together

_TOGETHER_SQL = """
with i as (select distinct file, label from histogram where file is not null and label >= 0),
m as (select label, count(*) as m from i group by label),
w as (select count(distinct file) as whole from histogram),
p as (select x.label as a, y.label as b, count(*) as n from i x join i y on x.file = y.file and x.label < y.label group by 1, 2),
o as (select file, src, dst, max(n) as n from transitions where n is not null and src <> dst group by 1, 2, 3),
q as (select least(src, dst) as a, greatest(src, dst) as b, sum(n) as n from o group by 1, 2),
e as (select label, sum(n) as m from (select a as label, n from q union all select b, n from q) group by 1),
v as (select sum(n) as whole from q),
r as (
  select 'recording' as kind, a as label_a, b as label_b, cast(p.n as bigint) as n, cast(x.m as bigint) as n_a, cast(y.m as bigint) as n_b,
    cast(whole as bigint) as whole, cast(p.n as double) * whole / (cast(x.m as double) * y.m) as lift
  from p join m x on x.label = a join m y on y.label = b, w
  union all
  select 'transition', a, b, cast(q.n as bigint), cast(x.m as bigint), cast(y.m as bigint), cast(whole as bigint),
    cast(q.n as double) * 2 * whole / (cast(x.m as double) * y.m)
  from q join e x on x.label = a join e y on y.label = b, v)
"""


def _pairs(spark, folder, least: int = 1):
    """Pairs of labels, by recording and by transition. A recording without a usable label is a recording all the same."""
    label = F.when(F.col("label") >= 0, F.col("label")).alias("label")
    listed = cooccurrence.together(table(spark, folder, "histogram").select("file", label), "file", "label", least)
    joined = cooccurrence.joined_by(table(spark, folder, "transitions"), "file", "src", "dst", "n")
    both = listed.withColumn("kind", F.lit("recording")).unionByName(joined.withColumn("kind", F.lit("transition")))
    return both.withColumnsRenamed({"a": "label_a", "b": "label_b"})


@query(
    _TOGETHER_SQL
    + """select kind, label_a, label_b from r where kind = 'recording' and n >= 8 and n * 100 >= 3 * whole and lift >= 4
    or kind = 'transition' and n >= 20 and n * 1000 >= 2 * whole and lift >= 5"""
)
def p5_found(spark, folder):
    return (
        _pairs(spark, folder, 8)
        .filter(
            "kind = 'recording' and n >= 8 and n * 100 >= 3 * whole and lift >= 4"
            " or kind = 'transition' and n >= 20 and n * 1000 >= 2 * whole and lift >= 5"
        )
        .select("kind", "label_a", "label_b")
    )


@query(_TOGETHER_SQL + "select kind, label_a, label_b, n, n_a, n_b, whole, lift, log2(lift) as pmi from r")
def p5_pairs(spark, folder):
    return _pairs(spark, folder).select("kind", "label_a", "label_b", "n", "n_a", "n_b", "whole", "lift", "pmi")


# ---- repeated consecutive events

_RUNS_SQL = """
with t as (select distinct 'token' as kind, file, hand, frame_idx, token, null::double[] as pose from tokens where hand in ('L', 'R') and token is not null),
h as (
  select file, frame_idx, any_value(aligned) as aligned, any_value(x_vec) as x, any_value(y_vec) as y, any_value(z_vec) as z, any_value(is_mirror) as is_mirror
  from hand_frames group by file, frame_idx),
g as (
  select file, frame_idx, list_transform(aligned, lambda v: v::double) as a,
    list_transform(list_concat(x, y, z), lambda v: v::double) as o
  from h where is_mirror is not true and len(aligned) = 63 and len(x) = 3 and len(y) = 3 and len(z) = 3),
f as (
  select file, frame_idx, a, sqrt(a[28] * a[28] + a[29] * a[29] + a[30] * a[30]) as u,
    (o[2] * o[6] - o[3] * o[5]) * o[7] + (o[3] * o[4] - o[1] * o[6]) * o[8] + (o[1] * o[5] - o[2] * o[4]) * o[9] as d
  from g where len(list_filter(a, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(a, lambda v: v <> 0)) > 0
    and len(list_filter(o, lambda v: v is null or not isfinite(v))) = 0),
s as (
  select * from t union all
  select 'pose', file, case when d < 0 then 'L' else 'R' end, frame_idx, null, list_transform(a, lambda v: v / u) from f where u > 0),
b as (
  select *, lag(frame_idx) over w as pi, lag(token) over w as pt, lag(pose) over w as pp
  from s window w as (partition by kind, file, hand order by frame_idx)),
c as (
  select *, sum(case when frame_idx - pi <= 12 and (kind = 'token' and token = pt or kind = 'pose' and list_distance(pose, pp) <= 0.15)
    then 0 else 1 end) over (partition by kind, file, hand order by frame_idx) as run
  from b)
"""


def _runs(spark, folder):
    words = (
        table(spark, folder, "tokens")
        .filter("hand in ('L', 'R') and token is not null and frame_idx is not null")
        .groupBy("file", "frame_idx")
        .agg(F.min(F.struct("hand", "token")).alias("s"))
        .select("file", "frame_idx", F.col("s.hand").alias("hand"), F.col("s.token").alias("state"))
    )
    frames = runs.single_poses(table(spark, folder, "hand_frames"))
    spoken = runs.collapse(words, runs.numbers, 0.0, 12, 3).withColumn("kind", F.lit("token"))
    return spoken.unionByName(runs.collapse(frames, runs.poses, 0.15, 12, 3).withColumn("kind", F.lit("pose")))


@query(
    _RUNS_SQL
    + "select kind, file, hand, min(frame_idx) as first_idx, max(frame_idx) as last_idx from c group by kind, file, hand, run having count(*) >= 3"
)
def p6_found(spark, folder):
    return _runs(spark, folder).select("kind", "file", "hand", "first_idx", "last_idx")


@query(
    _RUNS_SQL
    + """select kind, file, hand, min(frame_idx) as first_idx, count(*) as n_frames, max(frame_idx) - min(frame_idx) + 1 as duration
    from c group by kind, file, hand, run having count(*) >= 3"""
)
def p6_events(spark, folder):
    return _runs(spark, folder).select(
        "kind", "file", "hand", "first_idx", F.col("n").alias("n_frames"), (F.col("last_idx") - F.col("first_idx") + 1).alias("duration")
    )


# ---- encoding of the whole corpus


@query()
def p7_ids(spark, folder):
    return tokenise.token_ids(table(spark, folder, "documents"), "doc_id", "text")


@query("select doc_id, true as same from documents")
def p7_decoded(spark, folder):
    return tokenise.decoded_right(table(spark, folder, "documents"), "doc_id", "text")


# ---- mixing sources to target weights


def _sized(spark, folder):
    targets = table(spark, folder, "mix_targets")
    return materialise(mix.sized_documents(table(spark, folder, "documents"), targets), "sized"), targets


@query()
def p8_found(spark, folder):
    sized, targets = _sized(spark, folder)
    return mix.reached(sized, targets).filter("missed").select("source")


@query()
def p8_mix(spark, folder):
    return mix.mix(*_sized(spark, folder))


@query()
def p8_shares(spark, folder):
    sized, targets = _sized(spark, folder)
    return mix.shares(materialise(mix.mix(sized, targets), "mix"), targets)


# ---- subject area of each document


def _subjects(spark, folder):
    said = materialise(subjects.dialogue(table(spark, folder, "documents")), "dialogue")
    rules = subjects.learn_said(said, table(spark, folder, "subject_labels"), table(spark, folder, "subject_areas"))
    return subjects.shares_said(said, rules)


@query()
def p9_found(spark, folder):
    return _subjects(spark, folder).filter(F.col("n_cues") >= subjects.SHARE * F.col("n_spoken")).select("doc_id", "subject").distinct()


@query()
def p9_composition(spark, folder):
    """Documents and spoken cues of each area."""
    every = _subjects(spark, folder)
    return every.groupBy("subject").agg(
        F.count_if(F.col("n_cues") >= subjects.SHARE * F.col("n_spoken")).alias("n_documents"), F.sum("n_cues").alias("n_cues")
    )


# ---- similarity clusters

_CLUSTER_SQL = """
with recursive h as (select feature_id, any_value(aligned) as aligned from hand_features group by feature_id),
f as (select feature_id, list_transform(aligned, lambda v: v::double) as a from h where len(aligned) = 63),
g as (
  select feature_id, a, sqrt(a[28] * a[28] + a[29] * a[29] + a[30] * a[30]) as u from f
  where len(list_filter(a, lambda v: v is null or not isfinite(v))) = 0 and len(list_filter(a, lambda v: v <> 0)) > 0),
p as (select feature_id as id, cast(list_transform(a, lambda v: v / u) as double[63]) as v from g where u > 0),
e as (select x.id as a, y.id as b from p x join p y on x.id <> y.id and array_distance(x.v, y.v) <= 0.12),
c(id, root) as (
  select id, id from p
  union
  select e.b, c.root from c join e on e.a = c.id where c.root < e.b),
m as (select id, min(root) as cluster_id from c group by id)
"""


def _clusters(spark, folder):
    return pivot_clusters.clusters(table(spark, folder, "hand_features"))


@query(
    _CLUSTER_SQL
    + "select id as feature_id, cluster_id from m where cluster_id in (select cluster_id from m group by cluster_id having count(*) >= 3)"
)
def p4_found(spark, folder):
    return _clusters(spark, folder).select(F.col("id").alias("feature_id"), "cluster_id")


@query(
    _CLUSTER_SQL
    + """, k as (select cluster_id, count(*) as n_members from m group by 1 having count(*) >= 3),
    x as (select m.id, cluster_id, cast(v as double[]) as v from m join p on p.id = m.id join k using (cluster_id)),
    u as (select id, cluster_id, unnest(range(63)) as d, unnest(v) as val from x),
    mu as (select cluster_id, d, avg(val) as mean from u group by 1, 2),
    gp as (select cluster_id, id, round(sum((val - mean) * (val - mean)), 12) as gap from u join mu using (cluster_id, d) group by 1, 2),
    r as (select cluster_id, id, row_number() over (partition by cluster_id order by gap, id) as r from gp)
    select cluster_id, n_members, min(id) filter (where r = 1) as medoid_id, string_agg(cast(id as varchar), ',' order by r) as typical_ids
    from r join k using (cluster_id) where r <= 3 group by cluster_id, n_members"""
)
def p4_clusters(spark, folder):
    return pivot_clusters.described(materialise(_clusters(spark, folder), "clusters"))
