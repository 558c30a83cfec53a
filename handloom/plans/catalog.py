"""The queries of the core: name, plan over a folder of tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from handloom.functions import codes, pose
from handloom.operators import codebook, compaction, components, hot_keys, reduce, similarity, transitions
from handloom.plans import oracle as o
from handloom.plans import pipeline
from handloom.runtime import fresh_path, materialise
from handloom.sources import frames, images
from handloom.streaming import accumulate

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


# ---- a few keys holding most records


def _label_totals(spark, folder):
    return materialise(hot_keys.key_totals(table(spark, folder, "histogram"), "label", "cnt"), "label-totals")


@query("select label from histogram where label >= 0 group by label having count(*) * 1000 >= 25 * (select count(*) from histogram)")
def p1_found(spark, folder):
    return hot_keys.heavy_keys(_label_totals(spark, folder), 25).filter("key >= 0").select(F.col("key").alias("label"))


@query(
    "select label, count(*) as n_rows, count(cnt) as n_counted, cast(sum(cnt) as bigint) as frames from histogram group by label"
)
def p1_label_totals(spark, folder):
    totals = hot_keys.key_totals(table(spark, folder, "histogram"), "label", "cnt")
    return totals.select(
        F.col("key").alias("label"), "n_rows", F.col("n_values").alias("n_counted"), F.col("total").alias("frames")
    )


# ---- far too many small files

_FRAMES_SQL = r"""
with f as (
  select lower(coalesce(file, nullif(regexp_extract(path, '(?i)(file_crop---[a-z0-9]{10})', 1), '') || '.h5')) as file,
         coalesce(start_idx, try_cast(regexp_extract(path, '(?i)(?:part-|__)(\d+)', 1) as bigint)) as start_idx, aligned_63d
  from h5_files),
e as (select file, start_idx, aligned_63d, unnest(range(len(aligned_63d))) as pos from f where file is not null and start_idx is not null),
g as (select file, start_idx + pos as frame_idx from e where aligned_63d[pos + 1] is not null)
"""


def _compacted(spark, folder):
    return compaction.compact(table(spark, folder, "h5_files"), fresh_path(spark, "frames"))


@query(_FRAMES_SQL + "select file, frame_idx from g group by file, frame_idx having count(*) > 1")
def p3_found(spark, folder):
    return compaction.frames_in_several_files(_compacted(spark, folder))


@query(_FRAMES_SQL + "select file, cast(count(distinct frame_idx) as bigint) as n_frames, cast(count(*) as bigint) as n_held from g group by file")
def p3_recordings(spark, folder):
    return _compacted(spark, folder).groupBy("file").agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum("n_holders").alias("n_held")
    )


# ---- geometry and features


def _r6(x):
    return F.round(x, 6) + F.lit(0.0)


def _frames(spark, folder):
    return frames.single(table(spark, folder, "hand_frames"), "file", "frame_idx")


def _features(spark, folder):
    return frames.single(table(spark, folder, "hand_features"), "feature_id")


def _codes(spark, folder):
    return codebook.encode(_frames(spark, folder))


@query(f"with {o.FRAMES}, {o.theta_ctes()} select file, frame_idx, {', '.join(f'{o.r6(f"t{k}")} as theta_{k}' for k in range(13))} from th")
def pose_theta(spark, folder):
    thetas = pose.with_theta(_frames(spark, folder))
    return thetas.select("file", "frame_idx", *(_r6(F.get("theta", F.lit(k))).alias(f"theta_{k}") for k in range(13)))


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()} select file, frame_idx, code, m_bend, m_spread from co")
def pose_code(spark, folder):
    return _codes(spark, folder).select("file", "frame_idx", "code", "m_bend", "m_spread")


_LACKING = " + ".join(f"case when t{k} is null then 1 else 0 end" for k in range(13))
_OUTSIDE = " + ".join(f"case when t{k} < 0 or t{k} > {180 if k < 9 else 60} then 1 else 0 end" for k in range(13))


@query(
    f"""with {o.FRAMES}, {o.theta_ctes()} select file, count(*) as n_frames, count(*) filter (where {_LACKING} > 0) as n_incomplete,
    cast(sum({_OUTSIDE}) as bigint) as n_outside from th group by file"""
)
def theta_quality(spark, folder):
    return (
        pose.with_theta(_frames(spark, folder))
        .groupBy("file")
        .agg(
            F.count(F.lit(1)).alias("n_frames"),
            F.count_if(F.exists("theta", lambda x: x.isNull())).alias("n_incomplete"),
            F.sum(pose.out_of_range()).alias("n_outside"),
        )
    )


@query(f"with {o.FEATURES}, {o.DOUBLES} select feature_id, {', '.join(f'{o.r6(f"cast({x} as double)")} as cos_{i}' for i, x in enumerate(o.bone_cosines()))} from f")
def bone_cosine_features(spark, folder):
    found = pose.with_bone_cosines(_features(spark, folder))
    return found.select("feature_id", *(_r6(F.get("cosines", F.lit(i)).cast("double")).alias(f"cos_{i}") for i in range(15)))


@query(
    f"with {o.FEATURES}, {o.DOUBLES}, c as (select unnest([{', '.join(f'cast({x} as double)' for x in o.bone_cosines())}]) as x from f)"
    " select min(x) as least, max(x) as most, count(x) as n_values, count(*) - count(x) as n_missing from c"
)
def feature_stats(spark, folder):
    return reduce.feature_stats(pose.with_bone_cosines(_features(spark, folder)), "cosines")


@query(f"with {o.FRAMES} select file, frame_idx, {o.HAND} as hand from h")
def hand_label(spark, folder):
    return _frames(spark, folder).select("file", "frame_idx", pose.hand().alias("hand"))


@query(f"with {o.FRAMES} select {o.HAND} as hand, count(*) as n from h group by 1")
def hand_counts(spark, folder):
    return _frames(spark, folder).groupBy(pose.hand().alias("hand")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with {o.FEATURES} select feature_id, case when label = 'L' then 'R' else 'L' end as label, aligned[1]::double as a1,
    {', '.join(f"-x_vec[{c + 1}]::double + 0.0 as x{c}, y_vec[{c + 1}]::double + 0.0 as y{c}, z_vec[{c + 1}]::double + 0.0 as z{c}" for c in range(3))}
    from h where label in ('L', 'R') and len(aligned) = 63"""
)
def mirror_swap(spark, folder):
    swapped = pose.swap_hands(_features(spark, folder).drop("image_id"))
    parts = [(F.get(f"{v}_vec", F.lit(c)).cast("double") + F.lit(0.0)).alias(f"{v}{c}") for v in "xyz" for c in range(3)]
    return swapped.select("feature_id", "label", F.get("aligned", F.lit(0)).cast("double").alias("a1"), *parts)


@query("with h as (select feature_id, any_value(label) as label from hand_features where feature_id is not null group by 1) select feature_id, case when label = 'Right' then 'Left' else 'Right' end as handedness from h")
def handedness_flip(spark, folder):
    return _features(spark, folder).select("feature_id", pose.flip_handedness(F.col("label")).alias("handedness"))


def _basis_sql(a0: str) -> str:
    """``b3``: basis of the pose in list ``a``, for hands named by ``side``."""
    at = lambda m: [f"{a0}[{3 * m + c + 1}]" for c in range(3)]
    turn = "(case when side = 'Right' then -1.0 else 1.0 end)"
    zc = o.cross(o.minus(at(5), at(0)), o.minus(at(17), at(0)))
    yv = o.minus(at(9), at(0))
    z, y, x = ([f"{n}{c}" for c in range(3)] for n in ("bz", "yt", "bx"))
    xc, yc = o.cross(y, z), o.cross(z, x)
    each = lambda v, n, t="": ", ".join(f"{v[c]} / ({o.norm(v)} + 1e-8){t} as {n}{c}" for c in range(3))
    return f"""b1 as (select *, {each(zc, 'bz', f' * {turn}')}, {each(yv, 'yt')} from g),
b2 as (select *, {each(xc, 'bx')} from b1),
b3 as (select *, {each(yc, 'by')}, {', '.join(f'bx{c} * {turn} as fx{c}' for c in range(3))} from b2)"""


_SIDE = "case when label in ('R', 'Right') then 'Right' else 'Left' end as side"


def _sided(spark, folder):
    side = F.when(F.col("label").isin("R", "Right"), "Right").otherwise("Left")
    return _features(spark, folder).withColumn("side", side)


@query(
    f"with {o.FEATURES}, {o.DOUBLES}, g as (select *, {_SIDE} from f), {_basis_sql('a')} select feature_id, "
    + ", ".join(f"case when not isnan({s}{c}) then {o.r6(f'{s}{c}')} end as {n}{c}" for n, s in (("x", "fx"), ("y", "by"), ("z", "bz")) for c in range(3))
    + " from b3"
)
def orthonormal_basis(spark, folder):
    found = pose.with_basis(_sided(spark, folder).select("feature_id", "aligned", "side"), "aligned", "side")
    parts = [(f"{v}{c}", F.get(f"{v}_vec", F.lit(c))) for v in "xyz" for c in range(3)]
    return found.select("feature_id", *(F.when(~F.isnan(x), _r6(x)).alias(n) for n, x in parts))


def _aligned_sql() -> str:
    far = o.norm(o.minus(o.point(9), o.point(0)))
    centred = ", ".join(f"({o.point(m)[c]} - {o.point(0)[c]}) / s" for m in range(21) for c in range(3))
    axes = [[f"{n}{c}" for c in range(3)] for n in ("fx", "by", "bz")]
    outs = ", ".join(
        f"{o.dot([f'l[3 * m + {c + 1}]' for c in range(3)], axis)} as {n}" for n, axis in zip(("px", "py", "pz"), axes, strict=True)
    )
    rounded = ", ".join(f"cast(cast({n} as float) as double) + 0.0 as {n[1]}" for n in ("px", "py", "pz"))
    return f"""with {o.FEATURES}, {o.DOUBLES}, e as (select *, {far} as d, {_SIDE} from f),
e2 as (select *, case when d > 0 then d else 1.0 end as s from e where len(a) = 63 and len(list_filter(a, lambda v: v is null or not isfinite(v))) = 0),
g as (select *, [{centred}] as l from e2),
{_basis_sql('l')}, m as (select *, unnest(range(21)) as m from b3), q as (select feature_id, m as landmark, {outs} from m)
select feature_id, cast(landmark as int) as landmark, {rounded} from q"""


@query(_aligned_sql())
def aligned_pose(spark, folder):
    raw = _sided(spark, folder).filter(reduce.finite("aligned")).select("feature_id", "side", F.col("aligned").alias("raw"))
    found = pose.align(raw.withColumns({"w": F.lit(640), "h": F.lit(480)}), "raw", "side", "w", "h")
    points = found.select("feature_id", "aligned", F.explode(F.sequence(F.lit(0), F.lit(20))).alias("landmark"))
    values = [(F.get("aligned", F.col("landmark") * 3 + c).cast("double") + F.lit(0.0)).alias(n) for c, n in enumerate("xyz")]
    return points.select("feature_id", "landmark", *values)


def _reader():
    """A stand-in for a landmark detector: the image's bytes are the handedness it would find and the landmarks."""

    def detect(content: bytes):
        side, *marks = content.decode().split(",")
        return [(side, [float(x) for x in marks])] if len(marks) == 63 else [], 640, 480

    return detect


@query(
    f"""with {o.FEATURES}, {o.DOUBLES} select cast(feature_id as varchar) as path, cast(0 as int) as hand_idx,
    case when label = 'Right' then 'Left' else 'Right' end as handedness,
    {', '.join(f"cast(cast(a[{c + 1}] * {w} as float) as double) as wrist_{n}" for c, (n, w) in enumerate((('x', 640), ('y', 480), ('z', 640))))}
    from f where len(a) = 63 and len(list_filter(a, lambda v: v is null or not isfinite(v))) = 0"""
)
def image_hands(spark, folder):
    """Hands of images, the images being made of the feature table and the detector reading them back."""
    rows = _features(spark, folder).filter(reduce.finite("aligned"))
    text = F.concat_ws(",", F.coalesce("label", F.lit("")), F.transform("aligned", lambda v: v.cast("double").cast("string")))
    found = images.hands(rows.select(F.col("feature_id").cast("string").alias("path"), F.to_binary(text, F.lit("utf-8")).alias("content")), _reader)
    wrist = [F.get("wrist_px", F.lit(c)).cast("double").alias(f"wrist_{n}") for c, n in enumerate("xyz")]
    return found.select("path", "hand_idx", "handedness", *wrist)


# ---- sources, filters, metadata


@query(f"with {o.FRAMES} select file, count(*) as n_frames from h where is_mirror is not true group by file")
def file_meta(spark, folder):
    return frames.file_meta(_frames(spark, folder))


@query(f"with {o.FRAMES} select file, frame_idx from h where is_mirror is not true")
def mirror_filter(spark, folder):
    return frames.unmirrored(_frames(spark, folder)).select("file", "frame_idx")


@query(f"with {o.FRAMES} select file, frame_idx from h where aligned is not null and x_vec is not null and y_vec is not null and z_vec is not null")
def oriented_frames(spark, folder):
    return frames.oriented(_frames(spark, folder)).select("file", "frame_idx")


# ---- codebook


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()} select code, count(*) as cnt from co group by code")
def code_frequency(spark, folder):
    return codebook.code_frequency(_codes(spark, folder)).select("code", "cnt")


_RANKED = "rk as (select code, count(*) as cnt, min(row(file, frame_idx)) as first from co group by code), tk as (select code, cnt, row_number() over (order by cnt desc, first) - 1 as label from rk)"


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {_RANKED} select cast(label as int) as label, code, cnt from tk where label < 256")
def codebook_topk(spark, folder):
    return codebook.train(_codes(spark, folder), 256).select("label", "code", "cnt")


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {_RANKED} select cast(label as int) as label, code, cnt from tk")
def codebook_all(spark, folder):
    """The legacy training: every code gets a label."""
    return codebook.train(_codes(spark, folder), None).select("label", "code", "cnt")


@query(
    f"""with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()} select count(distinct file) as n_files, count(*) as n_frames,
    count(distinct code) as n_codes from co"""
)
def codebook_totals(spark, folder):
    return codebook.totals(_codes(spark, folder))


def _states_sql(first: int, last: int) -> str:
    parts = []
    for k in range(first, last):
        names = [f"{lo:.0f}-{hi:.0f}" if k < 9 else f"{lo:.1f}-{hi:.1f}" for lo, hi in (pose.BENDING_STATES if k < 9 else pose.SPREAD_STATES)]
        have = ", ".join(f"case when substr(code, {5 * k + s + 1}, 1) = '1' then '{n}' end" for s, n in enumerate(names))
        parts.append(f"coalesce(nullif(concat_ws('|', {have}), ''), 'N/A')")
    return "concat_ws(';', " + ", ".join(parts) + ")"


@query(
    f"""select cast(row_number() over (order by cnt desc, label, code) as int) as rnk, label, code, cnt, {_states_sql(0, 9)} as bending_states,
    {_states_sql(9, 13)} as spread_states from model order by cnt desc, label, code limit 20"""
)
def codebook_histogram(spark, folder):
    return codebook.histogram(table(spark, folder, "model"), 20)


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()} select file, frame_idx, label as token from co left join model using (code)")
def token_lookup(spark, folder):
    return codebook.lookup(_codes(spark, folder), table(spark, folder, "model")).select("file", "frame_idx", "token")


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {o.PREDICT} select code, token, overlap from bo")
def token_oov_fallback(spark, folder):
    model = table(spark, folder, "model")
    coded = materialise(_codes(spark, folder).select("code", "m_bend", "m_spread"), "codes")
    return codebook.best_overlap(codebook.out_of_model(coded, model), model)


@query(f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {o.PREDICT} select file, frame_idx, token from pr")
def token_predict(spark, folder):
    return codebook.predict(_codes(spark, folder), table(spark, folder, "model")).select("file", "frame_idx", "token")


@query(
    f"""with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {_RANKED},
    sm as (select code, file, frame_idx, row_number() over (partition by code order by file, frame_idx) as sample from co)
    select cast(label + 1 as int) as rnk, cast(label as int) as label, cast(sample as int) as sample, file, frame_idx
    from tk left join sm on sm.code = tk.code and sample <= 3 where label < 20"""
)
def class_samples(spark, folder):
    coded = materialise(_codes(spark, folder), "codes")
    top = codebook.histogram(codebook.train(coded, 256), 20)
    return codebook.samples(coded, top).select("rnk", "label", "sample", "file", "frame_idx")


@query()
def class_report(spark, folder):
    coded = materialise(_codes(spark, folder), "codes")
    return pipeline.report(coded, codebook.train(coded, 256), 20)


@query(
    f"""with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {_RANKED},
    sm as (select code, file, frame_idx, row_number() over (partition by code order by file, frame_idx) as sample from co)
    select 0 as rnk, 0 as sample, printf('%d recordings, %d frames, %d distinct codes', count(distinct file), count(*), count(distinct code)) as text from co
    union all select cast(label + 1 as int), 0, printf('#%d label %d, %d frames, code %s', label + 1, label, cnt, code) || chr(10)
      || '  bending ' || {_states_sql(0, 9)} || chr(10) || '  spread ' || {_states_sql(9, 13)} from tk where label < 20
    union all select cast(label + 1 as int), cast(sample as int), printf('  sample %d: %s frame %d', sample, file, frame_idx)
      from tk join sm using (code) where sample <= 3 and label < 20"""
)
def class_report_heads(spark, folder):
    """The report without the points and angles under each sample."""
    coded = materialise(_codes(spark, folder), "codes")
    text = F.substring_index("text", "\n    point", 1)
    return pipeline.report(coded, codebook.train(coded, 256), 20).select("rnk", "sample", text.alias("text"))


_BYTE = "list_sum(list_transform(range(8), lambda j: case when substr(code, cast(8 * b + j + 1 as bigint), 1) = '1' then (1 << cast(j as int)) else 0 end))"


@query(f"select label, to_base64(unhex(array_to_string(list_transform(range(9), lambda b: printf('%02X', cast({_BYTE} as int))), ''))) || chr(10) as packed from model")
def packed_codes(spark, folder):
    return table(spark, folder, "model").select("label", codes.legacy_code(F.col("m_bend"), F.col("m_spread")).alias("packed"))


# ---- transitions and similarity


def _counts_sql(delta: int, least: int = 1) -> str:
    return f"with {o.TRACKS}, {o.pairs(delta)} select src, dst, count(*) as n from lp group by src, dst having count(*) >= {least}"


@query(_counts_sql(10))
def transition_counts(spark, folder):
    return transitions.count(table(spark, folder, "tokens"), 10, k=1024)


@query(_counts_sql(1, 3))
def transition_counts_min(spark, folder):
    return transitions.count(table(spark, folder, "tokens"), 1, 3, k=1024)


@query(f"with {o.TRACKS} select file, hand, count(*) as n from tr group by file, hand having count(*) > 20")
def transition_short_track_skip(spark, folder):
    return transitions.long_tracks(transitions.track_rows(table(spark, folder, "tokens")), 20)


@query(f"with {o.TRACKS}, {o.pairs(2)} select file, src, dst, count(*) as n from lp group by file, src, dst")
def transition_counts_by_file(spark, folder):
    return transitions.count_by_file(table(spark, folder, "tokens"), 2)


@query(f"with {o.MERGED} select src, dst, n from c")
def transition_merge(spark, folder):
    return transitions.merge(table(spark, folder, "transitions"))


@query(f"with {o.MERGED} select count(*) as nnz, cast(coalesce(max(n), 0) as bigint) as most, cast(coalesce(sum(n), 0) as bigint) as total from c")
def transition_stats(spark, folder):
    return transitions.matrix_stats(transitions.merge(table(spark, folder, "transitions")))


@query(_counts_sql(1))
def streaming_counts(spark, folder):
    """The token rows as a stream of files, accumulated batch by batch."""
    tokens = spark.readStream.schema(table(spark, folder, "tokens").schema).parquet(f"{folder}/tokens.parquet*")
    where = fresh_path(spark, "stream")
    accumulate.accumulate(tokens, f"{where}/counts", f"{where}/progress", 1).awaitTermination()
    return accumulate.accumulated(spark, f"{where}/counts")


def _merged(spark, folder):
    return transitions.merge(table(spark, folder, "transitions"))


@query(f"with {o.MERGED}, {o.matrix()} select i, j, v / 2.0 as w from v")
def symmetrized_matrix(spark, folder):
    return similarity.symmetrised(_merged(spark, folder)).select("i", "j", (F.col("v") / 2).alias("w"))


@query(f"with {o.MERGED}, {o.matrix()}, rs as (select i, sum(v) as s from v group by i) select v.i, v.j, {o.r6('v / s')} as p from v join rs using (i)")
def row_probability(spark, folder):
    return similarity.row_shares(similarity.symmetrised(_merged(spark, folder))).select("i", "j", _r6(F.col("p")).alias("p"))


@query(f"with {o.MERGED}, {o.matrix()}, {o.sims()} select i, j, {o.r6('sim')} as sim from ss")
def similarity_excluded(spark, folder):
    return similarity.similarity(_merged(spark, folder)).select("i", "j", _r6(F.col("sim")).alias("sim"))


@query(f"with {o.MERGED}, {o.matrix()}, {o.sims(False)} select i, j, {o.r6('sim')} as sim from ss")
def similarity_plain(spark, folder):
    return similarity.similarity(_merged(spark, folder), exclude=False).select("i", "j", _r6(F.col("sim")).alias("sim"))


@query(f"with {o.MERGED}, {o.matrix(False)}, {o.sims()} select i, j, {o.r6('sim')} as sim from ss")
def similarity_asymmetric(spark, folder):
    return similarity.similarity(_merged(spark, folder), symmetrize=False).select("i", "j", _r6(F.col("sim")).alias("sim"))


@query(
    f"with {o.MERGED}, {o.matrix().replace('v as', 'w as', 1)}, cold as (select cast(range as int) as i from range(1024) where range not in (select i from w)), "
    f"v as (select i, j, v from w union all select i, cast(range as int), 1 from cold, range(1024) where range <> i), {o.sims()} select i, j, {o.r6('sim')} as sim from ss"
)
def similarity_cold_start(spark, folder):
    """Tokens that no transition names are taken to go over into every other token alike."""
    sims = similarity.similarity(_merged(spark, folder), cold_start="uniform", k=1024)
    return sims.select("i", "j", _r6(F.col("sim")).alias("sim"))


@query(
    f"with recursive {o.MERGED}, v as (select * from (select i, j, cast(sum(v) as bigint) as v from (select src as i, dst as j, n as v from c where src <> dst and n >= 5 union all select dst, src, n from c where src <> dst and n >= 5) group by 1, 2)), {o.sims()}, ed as (select i, j from ss where sim > 0.97), {o.COMPONENTS} select token, super_cluster from cc"
)
def super_clusters(spark, folder):
    counts = transitions.merge(table(spark, folder, "transitions"), 5)
    sims = similarity.similarity(counts)
    tokens = spark.range(1024).select(F.col("id").cast("int").alias("token"))
    found = components.components(tokens, "token", similarity.edges(sims, 0.97), "i", "j")
    return found.select(F.col("node").alias("token"), F.col("component").alias("super_cluster"))


def _run_sql(last: str) -> str:
    tokens = f"pt as (select file, frame_idx, {o.HAND} as hand, token from pr where aligned is not null and x_vec is not null and y_vec is not null and z_vec is not null), tr as (select * from pt where hand is not null and token is not null)"
    counts = "c as (select src, dst, count(*) as n from lp group by src, dst)"
    return f"with {o.FRAMES}, {o.theta_ctes()}, {o.code_ctes()}, {o.PREDICT}, {tokens}, {o.pairs(5)}, {counts}, {o.matrix()}, {o.sims()} {last}"


def _run(spark, folder):
    return pipeline.run(_frames(spark, folder), pipeline.model_tokenizer(table(spark, folder, "model")), 1024, 5)


@query(_run_sql("select src, dst, n from c"))
def pipeline_counts(spark, folder):
    return _run(spark, folder).counts


@query(_run_sql(f"select i, j, {o.r6('sim')} as sim from ss"))
def pipeline_similarity(spark, folder):
    return _run(spark, folder).sims.select("i", "j", _r6(F.col("sim")).alias("sim"))


# ---- reduction


@query()
def pca_2d(spark, folder):
    return reduce.pca_2d(_features(spark, folder), "feature_id")


@query()
def overview_2d(spark, folder):
    """A seeded sample in two dimensions."""
    return reduce.overview(_features(spark, folder), "feature_id", 10_000)


@query()
def group_projection(spark, folder):
    """Every pose on the two leading directions of its hand's label."""
    return reduce.pca_groups(_features(spark, folder), "label", "feature_id")


@query()
def kmeans_tokens(spark, folder):
    return reduce.kmeans(_features(spark, folder), "feature_id", 16, cosines=True)[0]


@query()
def subsample(spark, folder):
    return reduce.subsample(_features(spark, folder), 1000, "feature_id").select("feature_id")


@query("with h as (select distinct feature_id from hand_features where feature_id is not null) select least(1000, count(*)) as n, least(1000, count(*)) as n_distinct, least(1000, count(*)) as n_known from h")
def subsample_size(spark, folder):
    """How many rows a sample has, how many of them differ, and how many are rows of the table."""
    features = _features(spark, folder).select("feature_id")
    picked = materialise(reduce.subsample(features, 1000, "feature_id"), "sample")
    known = picked.join(features.withColumn("there", F.lit(True)), "feature_id", "left")
    return known.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("feature_id").alias("n_distinct"), F.count("there").alias("n_known")
    )


@query()
def kmeans_quality(spark, folder):
    """Cost and silhouette by number of clusters."""
    features = materialise(_features(spark, folder).select("aligned"), "features")
    costs, scores = reduce.elbow(features, [4, 8, 16]), dict(reduce.silhouette(features, [4, 8, 16]))
    return spark.createDataFrame([(k, cost, scores.get(k)) for k, cost in costs], "k int, cost double, silhouette double")
