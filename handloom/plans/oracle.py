"""SQL that must give the same rows as the plans, written from the formulas and not from the plans."""

from __future__ import annotations

from handloom.functions.pose import BENDING, BENDING_STATES, FINGERS, SIGNED, SPREAD, SPREAD_STATES

AXES = range(3)


def r6(x: str) -> str:
    return f"round({x}, 6) + 0.0"


FRAMES = """h as (
  select file, frame_idx, any_value(aligned) as aligned, any_value(x_vec) as x_vec, any_value(y_vec) as y_vec, any_value(z_vec) as z_vec,
    any_value(is_mirror) as is_mirror
  from hand_frames where file is not null and frame_idx is not null group by file, frame_idx)"""
FEATURES = """h as (
  select feature_id, any_value(label) as label, any_value(aligned) as aligned, any_value(x_vec) as x_vec, any_value(y_vec) as y_vec,
    any_value(z_vec) as z_vec
  from hand_features where feature_id is not null group by feature_id)"""
DOUBLES = "f as (select * exclude (aligned), aligned, list_transform(aligned, lambda v: v::double) as a from h)"


def point(m: int) -> list[str]:
    return [f"a[{3 * m + c + 1}]" for c in AXES]


def minus(p, q):
    return [f"({x} - {y})" for x, y in zip(p, q, strict=True)]


def dot(p, q):
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(p, q, strict=True)) + ")"


def norm(p):
    return f"sqrt({dot(p, p)})"


def cross(p, q):
    return [f"({p[i]} * {q[j]} - {p[j]} * {q[i]})" for i, j in ((1, 2), (2, 0), (0, 1))]


def clipped(x: str) -> str:
    return f"case when not isnan({x}) then degrees(acos(greatest(-1.0, least(1.0, {x})))) end"


def theta_ctes() -> str:
    """``f`` with a as doubles, then ``th``: the 13 angles as t0..t12."""
    ratio = [f"{dot(minus(point(a), point(b)), minus(point(c), point(b)))} / ({norm(minus(point(a), point(b)))} * {norm(minus(point(c), point(b)))} + 1e-12)" for a, b, c in BENDING]
    ratio += [f"{dot(point(a), point(b))} / ({norm(point(a))} * {norm(point(b))} + 1e-12)" for a, b in SPREAD]
    units = []
    for name, m in zip("tip", SIGNED, strict=True):
        v = minus(point(m), point(0))
        units += [f"{v[c]} / ({norm(v)} + 1e-8) as u{name}{c}" for c in AXES]
    t, i, p = ([f"u{n}{c}" for c in AXES] for n in "tip")
    angles = [f"{clipped(f'q{k}')} as t{k if k < 9 else k + 1}" for k in range(len(ratio))]
    side = dot(cross(t, i), cross(i, p))
    signed = f"case when not isnan({side}) and {side} >= 0 then 1 else -1 end * ({clipped(dot(i, t))}) as t9"
    return (
        f"{DOUBLES}, qs as (select *, {', '.join(f'{x} as q{k}' for k, x in enumerate(ratio))}, {', '.join(units)} from f), "
        f"th as (select *, {', '.join(angles)}, {signed} from qs)"
    )


def code_ctes(source: str = "th") -> str:
    """``co``: code, m_bend and m_spread of t0..t12."""
    bits = []
    for k in range(13):
        bits += [f"case when t{k} >= {lo} and t{k} < {hi} then '1' else '0' end" for lo, hi in (BENDING_STATES if k < 9 else SPREAD_STATES)]
    bits.append("case when t9 < 0 then '1' else '0' end")
    mask = lambda a, b: f"cast(list_sum(list_transform(range({a}, {b}), lambda i: case when substr(code, cast(i + 1 as bigint), 1) = '1' then (1::bigint << cast(i - {a} as int)) else 0 end)) as bigint)"
    return f"cd as (select *, {' || '.join(bits)} as code from {source}), co as (select *, {mask(0, 45)} as m_bend, {mask(45, 66)} as m_spread from cd)"


def bone_cosines() -> list[str]:
    out = []
    for base in FINGERS:
        chain = [0, base, base + 1, base + 2, base + 3]
        for x, y, z in zip(chain, chain[1:], chain[2:], strict=False):
            u, v = minus(point(y), point(x)), minus(point(z), point(y))
            size = f"{norm(u)} * {norm(v)}"
            q = f"{dot(u, v)} / (case when {size} > 1e-8 then {size} else 1.0 end)"
            out.append(f"case when not isnan({q}) then cast(greatest(-1.0, least(1.0, {q})) as float) end")
    return out


def vectors(*names: str) -> list[list[str]]:
    return [[f"({n}[{c + 1}]::double)" for c in AXES] for n in names]


_X, _Y, _Z = vectors("x_vec", "y_vec", "z_vec")
HANDEDNESS = dot(cross(_X, _Y), _Z)
HAND = f"case when isnan({HANDEDNESS}) then null when {HANDEDNESS} < 0 then 'L' when {HANDEDNESS} >= 0 then 'R' end"

#: ``pr``: codes with their token, by lookup or best overlap with the lowest label. Classes with a null are no classes.
PREDICT = """md as (
  select code, m_bend, m_spread, min(label) as label from model
  where code is not null and m_bend is not null and m_spread is not null and label is not null group by code, m_bend, m_spread),
un as (select distinct code, m_bend, m_spread from co where code not in (select code from md)),
ov as (select un.code, label, bit_count(un.m_bend & md.m_bend) + bit_count(un.m_spread & md.m_spread) as overlap from un, md),
bo as (select code, min(label) as token, any_value(overlap) as overlap from ov where overlap = (select max(overlap) from ov x where x.code = ov.code) group by code),
pr as (select co.*, coalesce(md.label, bo.token) as token from co left join md on md.code = co.code left join bo on bo.code = co.code)"""

TRACKS = """tr as (select distinct file, frame_idx, hand, token from tokens where hand in ('L', 'R') and token is not null and frame_idx is not null)"""


def pairs(delta: int, source: str = "tr") -> str:
    return f"""rn as (select *, row_number() over (partition by file, hand order by frame_idx) as r, count(*) over (partition by file, hand) as n from {source}),
lp as (select a.file, a.hand, a.token as src, b.token as dst from rn a join rn b on a.file = b.file and a.hand = b.hand and b.r - a.r between 1 and {delta} where a.n > {delta})"""


MERGED = """ot as (select file, src, dst, max(n) as n from transitions where src is not null and dst is not null and n is not null group by 1, 2, 3),
c as (select src, dst, cast(sum(n) as bigint) as n from ot group by 1, 2 having sum(n) >= 1)"""


def matrix(symmetrize: bool = True) -> str:
    both = " union all select dst, src, n from c where src <> dst" if symmetrize else ""
    return f"v as (select i, j, cast(sum(v) as bigint) as v from (select src as i, dst as j, n as v from c where src <> dst{both}) group by 1, 2 having sum(v) > 0)"


def sims(exclude: bool = True) -> str:
    less = lambda x: f" - cast(coalesce({x}.v, 0) as double) * coalesce({x}.v, 0)" if exclude else ""
    return f"""nn as (select i, sum(cast(v as double) * v) as s from v group by 1),
dd as (select a.i, b.i as j, sum(cast(a.v as double) * b.v) as d from v a join v b on a.j = b.j and a.i < b.i group by 1, 2),
ss as (select dd.i, dd.j, d / sqrt((x.s{less('p')}) * (y.s{less('q')})) as sim
  from dd join nn x on x.i = dd.i join nn y on y.i = dd.j left join v p on p.i = dd.i and p.j = dd.j left join v q on q.i = dd.j and q.j = dd.i)"""


#: ``cc``: the least token each token of 0..1023 is joined to, from edges ``ed`` (i, j).
COMPONENTS = """be as (select i as a, j as b from ed union all select j, i from ed),
reach(id, root) as (select cast(range as int), cast(range as int) from range(1024) union select be.b, reach.root from reach join be on be.a = reach.id where reach.root < be.b),
cc as (select id as token, min(root) as super_cluster from reach group by id)"""
