"""The same queries in DuckDB's SQL, written apart from the operators."""

from __future__ import annotations

LINE = 50.005

TRACE = """
base as (select user_id // 25 as rec, ts, event_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k from events),
seqd as (select *, row_number() over (partition by rec order by ts, event_id) - 1 as seq,
         1000 + least(cast(round(value * 100) as bigint), 10000) // 5 as v_cms from base),
ints as (select *, cast(coalesce(sum(v_cms) over (partition by rec order by seq rows between unbounded preceding and 1 preceding), 0) as bigint) // 10 as odo_cm from seqd),
pos as (select *, (odo_cm % 38850)::double as d, 9425 / pi() as r from ints),
trace as (
  select rec, seq, seq * 100 / 1000.0::double as t, v_cms / 100.0::double as v, odo_cm / 100.0::double as odo, (k * 10 // 9) / 10.0::double as dop,
    case when event_type = 'error' and k < 10 then 2 else 3 end as fix,
    round((case when d < 10000 then d when d < 19425 then 10000 + r * cos(-pi() / 2 + (d - 10000) / r) when d < 29425 then 29425 - d else r * cos(pi() / 2 + (d - 29425) / r) end) / 100, 6) as x,
    round((case when d < 10000 then 0.0 when d < 19425 then r + r * sin(-pi() / 2 + (d - 10000) / r) when d < 29425 then 2 * r else r + r * sin(pi() / 2 + (d - 29425) / r) end) / 100, 6) as y,
    (odo_cm + 33850) // 38850 as lap_no from pos)"""
CLEAN = TRACE + """,
clean as (select * from trace where not (fix >= 0 and fix < 3) and not dop > 10)"""
STEPS = """,
steps as (select *, t - lag(t) over w as dt, lag(v) over w as v0, lag(x) over w as x0, lag(y) over w as y0, lag(lap_no) over w as n0, lag(t) over w as t0, lag(odo) over w as odo0
          from {t} window w as (partition by rec order by seq))"""


def laps(table: str = "trace", base: str = TRACE, tweak: str = "") -> str:
    """CTEs down to ``laps``, ``valid`` and ``samples`` of a table of fixes."""
    return base + STEPS.format(t=table) + f""",
marked as (select *, ({LINE}::double - x0) / (x - x0) as r, (x0 - {LINE}::double) * (x - {LINE}::double) < 0 and abs(y0 + (y - y0) * (({LINE}::double - x0) / (x - x0))) < 15 as hit from steps),
counted as (select *, cast(sum(case when hit then 1 else 0 end) over (partition by rec order by seq) as bigint) as g from marked),
cross_ as (select rec, seq, g - 1 as lap_id, round(t0 + (t - t0) * r, 3) as t_cross, t, t0, odo, odo0, v, v0, x, x0, y, y0 from counted where hit),
cuts as (select rec, lap_id, t_cross as t, (t_cross - t0) / (t - t0) as sh, odo0 + (odo - odo0) * sh as odo, v0 + (v - v0) * sh as v, x0 + (x - x0) * sh as x, y0 + (y - y0) * sh as y from cross_),
spans as (select rec, lap_id, t_cross as t_start, lead(t_cross) over (partition by rec order by lap_id) as t_finish from cross_),
whole as (select * from spans where t_finish is not null),
rows_ as (
  select s.rec, w.lap_id, s.t, s.odo, s.v, s.x, s.y, 1 as kind from counted s join whole w on s.rec = w.rec and s.g - 1 = w.lap_id
  union all select c.rec, w.lap_id, c.t, c.odo, c.v, c.x, c.y, 0 from cuts c join whole w on c.rec = w.rec and c.lap_id = w.lap_id
  union all select c.rec, w.lap_id, c.t, c.odo, c.v, c.x, c.y, 2 from cuts c join whole w on c.rec = w.rec and c.lap_id - 1 = w.lap_id),
samples as (select rec, lap_id, t, v, x, y, kind, t - first_value(t) over w as elapsed, odo - first_value(odo) over w as dist, t - lag(t) over w as dt
            from rows_ window w as (partition by rec, lap_id order by t, kind)),
laps0 as (
  select w.rec, w.lap_id, w.t_start, w.t_finish, round(w.t_finish - w.t_start, 3) as lap_s, n + 2 as samples, round(dist_m, 3) as dist_m, round(max_dt, 3) as max_dt, v_max, v_min
  from whole w join (select rec, lap_id, count(*) filter (kind = 1) as n, max(dist) as dist_m, max(dt) as max_dt, max(v) filter (kind = 1) as v_max, min(v) filter (kind = 1) as v_min from samples group by all) a
  on w.rec = a.rec and w.lap_id = a.lap_id),
laps as (select {tweak or "*"} from laps0),
enough as (select * from laps where samples >= 20 and lap_s >= 5),
timed as (select * from (select *, median(lap_s) over (partition by rec) as m from enough) where lap_s >= 0.5::double * m and lap_s <= 1.6::double * m),
valid as (select * exclude (m, m2) from (select *, median(dist_m) over (partition by rec) as m2 from timed) where dist_m >= 0.9::double * m2 and dist_m <= 1.1::double * m2),
cand as (select * from (select *, max_dt > 0.35 as dropout, count(*) filter (not max_dt > 0.35) over (partition by rec) as nc from valid) where not dropout or nc = 0),
best as (select rec, lap_id, lap_s from (select *, row_number() over (partition by rec order by lap_s, lap_id) as q from cand) where q = 1),
vs as (select s.* from samples s join valid v on s.rec = v.rec and s.lap_id = v.lap_id),
totals_ as (select rec, lap_id, max(dist) as total from vs group by all)"""


LAPS = laps()
INTERP = """,
both_ as (select rec, lap_id, dist, 0 as g, null::bigint as i, {{'x': dist, 'y': elapsed}} as p from vs
          union all select rec, lap_id, dist, 1, i, null from asked),
swept as (select rec, lap_id, dist, g, i, last_value(p ignore nulls) over (partition by rec, lap_id order by dist, g rows between unbounded preceding and current row) as a,
                 first_value(p ignore nulls) over (partition by rec, lap_id order by dist, g rows between current row and unbounded following) as b from both_),
{name} as (select rec, lap_id, i, case when a is null then b.y when b is null or a.x = b.x then a.y else a.y + (b.y - a.y) * ((dist - a.x) / (b.x - a.x)) end as elapsed from swept where g = 1)"""
GRID = LAPS + """,
asked as (select rec, lap_id, i / 399.0::double * total as dist, i from totals_, range(0, 400) u(i) where total > 0)""" + INTERP.format(name="grid")
SPLITS = LAPS + """,
mid(no, mx, my) as (values (1, 50.005::double, 60.0::double), (2, -30.0::double, 30.0::double)),
near as (select rec, lap_id, no, dist from (select vs.rec, vs.lap_id, no, dist, row_number() over (partition by vs.rec, vs.lap_id, no order by (x - mx) ** 2 + (y - my) ** 2, dist) as q from vs, mid) where q = 1),
asked as (select rec, lap_id, dist, row_number() over (partition by rec, lap_id order by dist, e) - 1 as i from (
  select rec, lap_id, dist, 1 as e from near union all select rec, lap_id, 0.0, 0 from totals_ union all select rec, lap_id, total, 2 from totals_))""" + INTERP.format(name="at_") + """,
splits as (select * from (select rec, lap_id, i as sector, round(lead(elapsed) over (partition by rec, lap_id order by i) - elapsed, 4) as split_s from at_) where split_s is not null)"""
CLEAN_GRID = GRID.replace(LAPS, laps("clean", CLEAN).replace("join valid v on s.rec", "join (select * from cand where not dropout) v on s.rec"))
IDEAL = CLEAN_GRID + """,
ideal as (select rec, i, max(e) over (partition by rec order by i) as ideal_s from (select rec, i, min(elapsed) as e from grid group by all))"""
LONG_G = TRACE + """,
h as (select *, t - lag(t) over w as a, lead(t) over w - t as b, lag(v) over w as va, lead(v) over w as vb from trace window w as (partition by rec order by seq)),
slope as (select *, case when a is null then (vb - v) / b when b is null then (v - va) / a else (a * a * vb + (b * b - a * a) * v - b * b * va) / (a * b * (a + b)) end as s from h),
gs as (select rec, seq, t, v, odo, least(greatest(s / 9.80665::double, -2.0), 2.0) as long_g from slope),
theta as (select rec, round(least(greatest(coalesce(quantile_cont(case when long_g < -0.05 and v > 4 then -long_g end, 0.25), 0.16), 0.16), 0.30), 6)::double as theta from gs group by rec)"""


def step(c: str, w: str = "w") -> str:
    """Change from the row before to the one after, halved inside."""
    return f"case when lag({c}) over {w} is null then lead({c}) over {w} - {c} when lead({c}) over {w} is null then {c} - lag({c}) over {w} else (lead({c}) over {w} - lag({c}) over {w}) / 2 end"


FORCES = f""",
f0 as (select rec, seq, t, v, median(x) over w as mx, median(y) over w as my from trace window w as (partition by rec order by seq rows between 2 preceding and 2 following)),
f1 as (select *, avg(mx) over w as sx, avg(my) over w as sy, avg(v) over (partition by rec order by seq rows between 4 preceding and 4 following) as sp from f0 window w as (partition by rec order by seq rows between 5 preceding and 5 following)),
f2 as (select *, {step('t')} as ft, {step('sx')} as gx, {step('sy')} as gy, {step('sp')} as gsp from f1 window w as (partition by rec order by seq)),
f3 as (select *, atan2(gy / ft, gx / ft) as psi from f2),
f4 as (select *, psi - lag(psi) over w as sd, first_value(psi) over w as psi0 from f3 window w as (partition by rec order by seq)),
f5 as (select *, psi0 + sum(coalesce(case when sd - 2 * pi() * floor((sd + pi()) / (2 * pi())) = -pi() and sd > 0 then pi() else sd - 2 * pi() * floor((sd + pi()) / (2 * pi())) end, 0.0)) over (partition by rec order by seq) as turned from f4),
f6 as (select *, avg(turned) over (partition by rec order by seq rows between 5 preceding and 5 following) as hd from f5),
forces as (select rec, seq, t, coalesce(hd, 0) as heading, coalesce(least(greatest(sp * (({step('hd')}) / ft) / 9.80665::double, -3.0), 3.0), 0.0) as lat_g, coalesce(least(greatest(gsp / ft / 9.80665::double, -2.0), 2.0), 0.0) as long_g from f6 window w as (partition by rec order by seq))"""
LATERAL = LONG_G + FORCES + """,
lat as (select gs.*, forces.lat_g from gs join forces using (rec, seq)),
env as (select rec, round(greatest(coalesce(quantile_cont(case when v > 4 then sqrt(lat_g ** 2 + long_g ** 2) end, 0.98), 0.3), 0.3), 4)::double as envelope_g from lat group by rec)"""
HISTORY = """
hist as (select o_orderkey as fingerprint, o_orderpriority as track, strftime(o_orderdate, '%Y-%m-%d') as date, o_totalprice as best,
         o_orderstatus <> 'P' as verified, o_custkey % 17 = 0 as degraded, o_custkey % 13 = 0 as dropout from orders),
good as (select * from hist where verified and not degraded and not dropout),
pbs as (select track, date, best, fingerprint from (select *, min(best) over (partition by track order by date, best, fingerprint rows between unbounded preceding and 1 preceding) as b from good where date is not null) where b is null or best < b)"""
PLACES = """
places as (select c_custkey as place, 45 + (c_custkey * 37 % 1000) / 10000.0::double as lat, 7 + (c_custkey * 91 % 1000) / 10000.0::double as lon, 500.0::double + c_custkey % 400 as diag from customer),
tracks as (select s_name as track, 45 + (s_suppkey * 53 % 1000) / 10000.0::double as k_lat, 7 + (s_suppkey * 29 % 1000) / 10000.0::double as k_lon, 600.0::double + s_suppkey % 500 as k_diag from supplier)"""


def islands(table: str, inside: str, order: str = "seq") -> str:
    return f"""(select *, sum(case when inside and not prev then 1 else 0 end) over (partition by rec order by {order}) as island from
      (select *, coalesce(lag(inside) over (partition by rec order by {order}), false) as prev from (select *, coalesce({inside}, false) as inside from {table}))) """


def _smooth_g(width: int) -> str:
    return f"sm as (select rec, seq, t, v, odo, avg(long_g) over (partition by rec order by seq rows between {width // 2} preceding and {(width - 1) // 2} following) as long_g from gs)"



def at(name: str, asked: str, extra: str, table: str = "vs", y: tuple[str, ...] = ("elapsed", "v"), keys: str = "rec, lap_id", x: str = "dist") -> str:
    """A CTE ``name``: the rows of ``asked`` (keys, x, extra) with ``y`` of ``table`` at x, by one sweep, clamped at both ends."""
    pack = ", ".join(f"{c} := {c}" for c in y)
    value = ", ".join(f"case when a is null then b.{c} when b is null or a._x = b._x then a.{c} else a.{c} + (b.{c} - a.{c}) * (({x} - a._x) / (b._x - a._x)) end as {c}" for c in y)
    nulls, kinds = ", ".join("null" for _ in extra.split(",")), ", ".join(f"{c} double" for c in y)
    return f""",
{name}_b as (select {keys}, {x}, 1 as _g, {extra}, cast(null as struct(_x double, {kinds})) as p from {asked} union all select {keys}, {x}, 0, {nulls}, struct_pack(_x := {x}, {pack}) from {table}),
{name}_s as (select *, last_value(p ignore nulls) over (partition by {keys} order by {x}, _g rows between unbounded preceding and current row) as a,
  first_value(p ignore nulls) over (partition by {keys} order by {x}, _g rows between current row and unbounded following) as b from {name}_b),
{name} as (select {keys}, {x}, {extra}, {value} from {name}_s where _g = 1)"""


def gradient(y: str, x: str, w: str) -> str:
    """Second-order differences on uneven steps, one-sided at the ends."""
    h, k = f"({x} - lag({x}) over {w})", f"(lead({x}) over {w} - {x})"
    y0, y2 = f"lag({y}) over {w}", f"lead({y}) over {w}"
    return f"case when {h} is null then ({y2} - {y}) / {k} when {k} is null then ({y} - {y0}) / {h} else ({h} * {h} * {y2} + ({k} * {k} - {h} * {h}) * {y} - {k} * {k} * {y0}) / ({h} * {k} * ({h} + {k})) end"


#: Curvature of clean laps, pooled on cells; corners; their windows on the valid laps.
PROFILE = LAPS + f""",
okl as (select rec, lap_id, lap_s from cand where not dropout),
length_ as (select s.rec, max(dist) as length from samples s join best using (rec, lap_id) group by s.rec),
c0 as (select * from (select s.*, dist - lag(dist) over (partition by rec, lap_id order by dist) as st from samples s join okl using (rec, lap_id)) where st is null or st > 1e-9),
c1 as (select *, {gradient('x', 'dist', 'w')} as dx, {gradient('y', 'dist', 'w')} as dy from c0 window w as (partition by rec, lap_id order by dist)),
c2 as (select *, atan2(dy, dx) as a, atan2(dy, dx) - lag(atan2(dy, dx)) over w as st2 from c1 window w as (partition by rec, lap_id order by dist)),
c3 as (select *, first_value(a) over w + sum(coalesce(case when st2 - 2 * pi() * floor((st2 + pi()) / (2 * pi())) = -pi() and st2 > 0 then pi() else st2 - 2 * pi() * floor((st2 + pi()) / (2 * pi())) end, 0.0)) over w as psi from c2 window w as (partition by rec, lap_id order by dist rows between unbounded preceding and current row)),
c4 as (select *, {gradient('psi', 'dist', 'w')} as k0, dist - lag(dist) over w as st3, count(*) over (partition by rec, lap_id) as n from c3 window w as (partition by rec, lap_id order by dist)),
c5 as (select c4.*, wd from c4 join (select rec, lap_id, cast(greatest(round_even(8.0::double / greatest(median(st3), 1e-9), 0), 1) as integer) as wd from c4 group by all) using (rec, lap_id)),
curve_ as (select rec, lap_id, dist, case when n >= wd and wd > 1 then avg(k0) over (partition by rec, lap_id order by dist rows between wd // 2 preceding and (wd - 1) // 2 following) else k0 end as kappa from c5),
cells_ as (select t.rec, lap_id, total, length, cast(greatest(round_even(length / 0.75::double, 0), 16) as integer) as m from (select rec, lap_id, max(dist) as total, count(*) as n from curve_ group by all) t join length_ using (rec) where n >= 8),
cgrid as (select rec, lap_id, i / (m - 1)::double * total as dist, i, i / (m - 1)::double * length as s_m from (select *, unnest(range(0, m))::integer as i from cells_))""" + at("pooled_", "cgrid", "i, s_m", "curve_", ("kappa",)) + """,
profile as (select rec, i, max(s_m) as s_m, median(kappa) as kappa from pooled_ group by all)"""
CORNERS = PROFILE + """,
oq as (select rec, log10(greatest(abs(kappa), 0.0001)) as q from profile), obx as (select rec, min(q) as lo, max(q) as hi from oq group by rec),
opl as (select oq.rec, least(floor((q - lo) / case when hi > lo then hi - lo else 1.0 end * 128), 127)::integer as b from oq join obx using (rec)),
oct_ as (select rec, b, count(*) as n from opl group by all), ohs as (select obx.rec, u.b, coalesce(n, 0) as n, lo + (hi - lo) * (u.b + 0.5::double) / 128 as m from obx cross join (select unnest(range(0, 128))::integer as b) u left join oct_ on oct_.rec = obx.rec and oct_.b = u.b),
oc as (select *, sum(n) over w as w0, sum(n * m) over w as s0, sum(n) over (partition by rec) as w, sum(n * m) over (partition by rec) as s from ohs window w as (partition by rec order by b)),
ov as (select rec, b, m, round(w0::double * (w - w0)::double * (s0 / w0 - (s - s0) / (w - w0)) ** 2, 6) as v from oc where w0 > 0 and w - w0 > 0),
thr as (select rec, round(10.0::double ** m, 8) as thr from (select *, row_number() over (partition by rec order by v desc, b) as r from ov) where r = 1),
d0 as (select p.*, thr, sign(kappa) as sg, (kappa + lag(kappa) over w) / 2 * (s_m - lag(s_m) over w) as area, abs(kappa) >= 0.8::double * thr as inn from profile p join thr using (rec) window w as (partition by p.rec order by i)),
d1 as (select *, sum(case when inn and (not coalesce(pin, false) or sg <> ps) then 1 else 0 end) over (partition by rec order by i) as part from (select *, lag(inn) over w as pin, lag(sg) over w as ps from d0 window w as (partition by rec order by i))),
d2 as (select rec, part, min(s_m) as a, max(s_m) as b, max(abs(kappa)) as top, any_value(thr) as thr, any_value(sg) as sg, min(i) as i0, max(i) as i1 from d1 where inn group by rec, part having max(abs(kappa)) >= any_value(thr)),
d3 as (select *, sum(case when a - pb > 10 or sg <> psg then 1 else 0 end) over (partition by rec order by a) as g from (select *, lag(b) over w as pb, lag(sg) over w as psg from d2 window w as (partition by rec order by a))),
d4 as (select rec, g, min(a) as a, max(b) as b, min(i0) as i0, max(i1) as i1, arg_max(sg, top) as sg from d3 group by all),
d5 as (select d4.rec, g, any_value(d4.a) as a, any_value(d4.b) as b, any_value(d4.sg) as sg, abs(degrees(sum(case when i > i0 then area else 0 end))) as turn, sum(abs(kappa) * s_m) / sum(abs(kappa)) as apex from d4 join d0 on d0.rec = d4.rec and i between i0 and i1 group by d4.rec, g),
corners as (select rec, cast(row_number() over (partition by rec order by a) as integer) as cid, round(a, 3) as enter, round(b, 3) as exit, round(apex, 3) as apex, cast(sg as integer) as direction, round(turn, 3) as turn_deg from d5 where b - a >= 8 and turn >= 30)"""
#: Each lap's windows; ``vs`` may have drifted odometers, which are then matched by place, sample by sample.
PLACED = """,
ends_ as (select rec, cid, 0 as edge, enter as d from corners union all select rec, cid, 1, exit from corners),
wb as (select t.rec, lap_id, cid, edge, d, total, length, d * total / length as scaled from totals_ t join length_ using (rec) join ends_ using (rec)),
hd0 as (select rec, lap_id, t, x, y, dist, row_number() over w - 1 as i, count(*) over (partition by rec, lap_id) as n, lag(x) over w as xa, lead(x) over w as xb, lag(y) over w as ya, lead(y) over w as yb, lag(dist) over w as da, lead(dist) over w as db from vs window w as (partition by rec, lap_id order by t, dist)),
hd1 as (select *, case when xa is null then xb - x when xb is null then x - xa else (xb - xa) / 2 end as gx, case when ya is null then yb - y when yb is null then y - ya else (yb - ya) / 2 end as gy from hd0),
hd as (select *, case when sqrt(gx ** 2 + gy ** 2) > 0 then gx / sqrt(gx ** 2 + gy ** 2) else 0 end as hx, case when sqrt(gx ** 2 + gy ** 2) > 0 then gy / sqrt(gx ** 2 + gy ** 2) else 0 end as hy from hd1),
hb as (select hd.* from hd join best using (rec, lap_id)),
ask_ as (select rec, d as dist, cid, edge from ends_)""" + at("anch", "ask_", "cid, edge", "hb", ("x", "y", "hx", "hy"), "rec") + """,
df as (select wb.*, (select count(*) from hd where hd.rec = wb.rec and hd.lap_id = wb.lap_id and hd.dist < wb.scaled) as c, (select count(*) from hd where hd.rec = wb.rec and hd.lap_id = wb.lap_id) as m from wb where abs(total - length) / length > 0.005),
pm as (select df.rec, df.lap_id, df.cid, df.edge, hd.i, hd.x, hd.y, hd.dist, coalesce(xa, hd.x) as xa, coalesce(ya, hd.y) as ya, coalesce(da, hd.dist) as da, coalesce(xb, hd.x) as xb, coalesce(yb, hd.y) as yb, coalesce(db, hd.dist) as db, anch.x as ax, anch.y as ay
  from df join hd on hd.rec = df.rec and hd.lap_id = df.lap_id and hd.i between least(c, m - 1) - greatest(5, floor(m * 0.02)) and least(c, m - 1) + greatest(5, floor(m * 0.02)) join anch on anch.rec = df.rec and anch.cid = df.cid and anch.edge = df.edge where anch.hx * hd.hx + anch.hy * hd.hy >= 0.5),
pn as (select * from (select *, row_number() over (partition by rec, lap_id, cid, edge order by (x - ax) ** 2 + (y - ay) ** 2, i) as q from pm) where q = 1),
pf as (select *, case when (x - xa) ** 2 + (y - ya) ** 2 > 0 then least(greatest(((ax - xa) * (x - xa) + (ay - ya) * (y - ya)) / ((x - xa) ** 2 + (y - ya) ** 2), 0), 1) else 0 end as fa,
  case when (xb - x) ** 2 + (yb - y) ** 2 > 0 then least(greatest(((ax - x) * (xb - x) + (ay - y) * (yb - y)) / ((xb - x) ** 2 + (yb - y) ** 2), 0), 1) else 0 end as fb from pn),
pz as (select *, (xa + fa * (x - xa) - ax) ** 2 + (ya + fa * (y - ya) - ay) ** 2 as ea, (x + fb * (xb - x) - ax) ** 2 + (y + fb * (yb - y) - ay) ** 2 as eb from pf),
found_ as (select rec, lap_id, cid, edge, case when ea <= eb then da + fa * (dist - da) else dist + fb * (db - dist) end as found from pz where least(ea, eb) <= 9),
proj as (select rec, lap_id, cid, edge, max(least(greatest(coalesce(found, scaled), 0), total)) over (partition by rec, lap_id order by cid, edge rows between unbounded preceding and current row) as dist from wb left join found_ using (rec, lap_id, cid, edge)),
win as (select p.rec, p.lap_id, cid, max(dist) filter (edge = 0) as enter, max(dist) filter (edge = 1) as exit, any_value(total) as total from proj p join totals_ using (rec, lap_id) group by p.rec, p.lap_id, cid)"""
STATS_ = """,
sask as (select rec, lap_id, enter as dist, cid, 0 as e from win union all select rec, lap_id, exit, cid, 1 from win union all select rec, lap_id, (enter + exit) / 2, cid, 2 from win)""" + at("sat", "sask", "cid, e") + """,
spair as (select rec, lap_id, cid, max(elapsed) filter (e = 0) as e0, max(elapsed) filter (e = 1) as e1, max(v) filter (e = 0) as v0, max(v) filter (e = 1) as v1, max(v) filter (e = 2) as v2 from sat group by all),
slow as (select w.rec, w.lap_id, cid, min(struct_pack(v := v, d := dist)) as p from win w join vs on vs.rec = w.rec and vs.lap_id = w.lap_id and dist between enter and exit group by all),
cstats as (select w.rec, w.lap_id, w.cid, round(e1 - e0, 4) as time_s, enter, exit, coalesce(p.d, (enter + exit) / 2) as apex, v0 as v_enter, v1 as v_exit, coalesce(p.v, v2) as v_apex from win w join spair using (rec, lap_id, cid) left join slow using (rec, lap_id, cid)),
steady as (select c.* from cstats c join okl using (rec, lap_id))"""
WINDOWS = CORNERS + PLACED
STATS = WINDOWS + STATS_
#: Sessions whose odometers have drifted, but not the best lap's: the corners are those of the session as it is.
DRIFTED = CORNERS.replace("vs as (", "vs0 as (").replace("totals_ as (select rec, lap_id, max(dist) as total from vs group by all)", """vs as (select vs0.* replace (dist + case when (vs0.lap_id - best.lap_id + 3000) % 3 = 1 then dist * 0.02::double + 3 * (1 - cos(dist / 388.5::double * 2 * pi())) else 0.0 end as dist) from vs0 join best using (rec)),
totals_ as (select rec, lap_id, max(dist) as total from vs group by all)""") + PLACED
PHASES = WINDOWS + """,
pask as (select rec, lap_id, enter + (exit - enter) * p / 3 + (enter + (exit - enter) * (p + 1) / 3 - (enter + (exit - enter) * p / 3)) * j / 63 as dist, cid, p as phase, j from win, (select unnest(range(0, 3)) as p) a, (select unnest(range(0, 64)) as j) b)""" + at("pat", "pask", "cid, phase, j", y=("v",)) + """,
pstep as (select *, (1 / greatest(v, 1 / 3.6::double) + lag(1 / greatest(v, 1 / 3.6::double)) over w) / 2 * (dist - lag(dist) over w) as s from pat window w as (partition by rec, lap_id, cid, phase order by j)),
ptime as (select rec, lap_id, cid, phase, sum(s) as time_s from pstep group by all),
ploss as (select p.rec, p.lap_id, p.cid, p.phase, p.time_s - b.time_s as loss from ptime p join best using (rec) join ptime b on b.rec = p.rec and b.lap_id = best.lap_id and b.cid = p.cid and b.phase = p.phase join okl on okl.rec = p.rec and okl.lap_id = p.lap_id where p.lap_id <> best.lap_id),
pmed as (select rec, cid, phase, median(loss) as loss from ploss group by all)"""
SEGMENTS = """,
gask as (select rec, lap_id, 0.0::double as dist, 0 as part from totals_ union all select rec, lap_id, enter, 2 * cid - 1 from win union all select rec, lap_id, exit, 2 * cid from win union all select t.rec, t.lap_id, t.total, 2 * max(cid) + 1 from totals_ t join win using (rec, lap_id) group by t.rec, t.lap_id, t.total)""" + at("gat", "gask", "part", y=("elapsed",)) + """,
segs as (select rec, lap_id, cast(part as integer) as part, round(nx - elapsed, 4) as time_s from (select *, lead(elapsed) over (partition by rec, lap_id order by part) as nx from gat) where nx is not null)"""
#: Each lap's own forces, brake events by walking along its fragments, and coasts.
LAP_G = LONG_G[len(TRACE) :] + """,
l0 as (select *, row_number() over w - 1 as i, t - lag(t) over w as st, count(*) over (partition by rec, lap_id) as n from vs window w as (partition by rec, lap_id order by t, dist)),
l1 as (select l0.*, um, wa, wb_ from l0 join (select rec, lap_id, median(st) filter (st > 0) as um, case when any_value(n) < 3 then 1 else cast(greatest(round_even(0.1::double / greatest(median(st), 1e-9), 0), 1) as integer) end as wa, case when any_value(n) < 3 then 1 else cast(greatest(round_even(0.3::double / greatest(median(st), 1e-9), 0), 1) as integer) end as wb_ from l0 group by all) using (rec, lap_id)),
l2 as (select *, case when st > 0 then st when st is not null then um end as a from l1),
l3 as (select *, lead(a) over w as b, lag(v) over w as va, lead(v) over w as vb from l2 window w as (partition by rec, lap_id order by i)),
l4 as (select *, case when n < 3 then 0.0 else least(greatest(case when a is null then (vb - v) / b when b is null then (v - va) / a else (a * a * vb + (b * b - a * a) * v - b * b * va) / (a * b * (a + b)) end / 9.80665::double, -2.0), 2.0) end as raw from l3),
l5 as (select *, case when n >= wa and wa > 1 then avg(raw) over (partition by rec, lap_id order by i rows between wa // 2 preceding and (wa - 1) // 2 following) else raw end as g from l4),
lg as (select l5.*, theta, case when n >= wb_ and wb_ > 1 then avg(g) over (partition by rec, lap_id order by i rows between wb_ // 2 preceding and (wb_ - 1) // 2 following) else g end as gate from l5 join theta using (rec)),
isl as (select *, sum(case when inn and not coalesce(pin, false) then 1 else 0 end) over (partition by rec, lap_id order by i) as isl from (select *, lag(inn) over (partition by rec, lap_id order by i) as pin from (select *, g < -0.35::double * theta as inn from lg))),
fr as (select rec, lap_id, row_number() over (partition by rec, lap_id order by min(i)) as k, min(i) as i0, max(i) as i1, min(dist) as d0, max(dist) as d1, min(elapsed) as t0, max(elapsed) as t1, max(-g) as peak from isl where inn group by rec, lap_id, isl having bool_or(g < -theta)),
fc as (select f.*, (select max(gate) from lg where lg.rec = f.rec and lg.lap_id = f.lap_id and lg.i between p.i1 and f.i0) > 0.5 or f.d0 - p.d1 > 25 as cut, (select min(cid) from win w where w.rec = f.rec and w.lap_id = f.lap_id and f.d0 between greatest(w.enter - 40, 0) and w.exit) as corner, f.t1 - f.t0 >= 0.25 as settled
  from fr f left join fr p on p.rec = f.rec and p.lap_id = f.lap_id and p.k = f.k - 1),
walk(rec, lap_id, k, g, d0, t0, corner, settled, d1, t1, peak, n) as (
  select rec, lap_id, k, 1, d0, t0, corner, settled, d1, t1, peak, 1 from fc where k = 1 union all
  select f.rec, f.lap_id, f.k, case when ap then w.g + 1 else w.g end, case when ap or (not w.settled and f.settled) then f.d0 else w.d0 end, case when ap or (not w.settled and f.settled) then f.t0 else w.t0 end,
    case when ap or (not w.settled and f.settled) then f.corner else w.corner end, case when ap then f.settled else w.settled or f.settled end, f.d1, f.t1, case when ap then f.peak else greatest(w.peak, f.peak) end, case when ap then 1 else w.n + 1 end
  from (select w.*, f.k as fk, f.cut or coalesce(w.corner <> f.corner, false) as ap from walk w join fc f on f.rec = w.rec and f.lap_id = w.lap_id and f.k = w.k + 1) w join fc f on f.rec = w.rec and f.lap_id = w.lap_id and f.k = w.fk),
brakes as (select rec, lap_id, d0, t0, d1, t1, peak, t1 - t0 as seconds, n from (select *, row_number() over (partition by rec, lap_id, g order by k desc) as q from walk) where q = 1 and t1 - t0 >= 0.25),
csl as (select *, sum(case when inn and not coalesce(pin, false) then 1 else 0 end) over (partition by rec, lap_id order by i) as isl from (select *, lag(inn) over (partition by rec, lap_id order by i) as pin from (select *, g < -0.03 and g > -theta and v > 4 as inn from lg))),
coasts as (select rec, lap_id, min(dist) as d0, max(dist) as d1, max(elapsed) - min(elapsed) as seconds from csl where inn group by rec, lap_id, isl having max(elapsed) - min(elapsed) >= 0.25)"""
BRAKES = "recursive " + STATS + LAP_G
#: Of speeds that change slowly, so that there are spans without brake and throttle.
CALM = "recursive " + laps("calm", TRACE + ", calm as (select * replace (avg(v) over (partition by rec order by seq rows between 50 preceding and 50 following) as v) from trace)") + ", win as (select 0 as rec, 0 as lap_id, 0 as cid, 0.0 as enter, 0.0 as exit where false)" + LAP_G.replace("from trace window", "from calm window")
POINTS = BRAKES + """,
amax as (select rec, greatest(quantile_cont(peak, 0.9), 0.3) as amax from brakes group by rec),
bl as (select * from (select c.rec, c.lap_id, c.cid, c.apex, c.v_apex, b.d0 as dist, b.peak, row_number() over (partition by c.rec, c.lap_id, c.cid order by b.d0 desc, b.peak desc) as q from cstats c join brakes b on b.rec = c.rec and b.lap_id = c.lap_id and b.d0 between c.enter - 30 and c.exit) where q = 1)""" + at("bat", "bl", "cid, apex, v_apex, peak", y=("v",)) + """,
points as (select bat.rec, lap_id, cid, dist as onset, peak, apex - (v * v - v_apex * v_apex) / (2 * amax * 9.80665::double) as optimal, peak / amax as commit_ from bat join amax using (rec) where v > v_apex)"""
REASONS = BRAKES + PHASES[len(WINDOWS) :] + """,
typ as (select rec, lap_id from (select *, row_number() over (partition by rec order by lap_s, lap_id) as q, count(*) over (partition by rec) as n from okl) where q = (n + 1) // 2),
loss_ as (select s.rec, s.cid, round(median(s.time_s - b.time_s), 6) as loss, stddev_samp(s.time_s) as line from steady s join best using (rec) join cstats b on b.rec = s.rec and b.lap_id = best.lap_id and b.cid = s.cid group by s.rec, s.cid having (select count(*) from okl where okl.rec = s.rec) >= 3 and median(s.time_s - b.time_s) > 1e-9),
two as (select rec, lap_id, 0 as w from best union all select rec, lap_id, 1 from typ),
sw as (select two.rec, two.lap_id, w, cid, enter * total / length as enter, exit * total / length as exit from two join totals_ using (rec, lap_id) join length_ using (rec) join corners using (rec)),
ev as (select sw.*, (select v_apex from cstats c where c.rec = sw.rec and c.lap_id = sw.lap_id and c.cid = sw.cid) as v, coalesce((select sum(seconds) from brakes b where b.rec = sw.rec and b.lap_id = sw.lap_id and b.d0 between enter - 30 and exit), 0) as br,
  coalesce((select sum(seconds) from coasts b where b.rec = sw.rec and b.lap_id = sw.lap_id and b.d1 >= enter and b.d0 <= exit), 0) as co from sw),
evd as (select b.rec, b.cid, greatest(b.v - t.v, 0) * 3.6 as apex, greatest(t.br - b.br, 0) as brake, greatest(t.co - b.co, 0) as coast from ev b join ev t on t.rec = b.rec and t.cid = b.cid and t.w = 1 where b.w = 0),
ph as (select p.rec, cid, coalesce(sum(loss) filter (phase = 0), 0) as p0, coalesce(sum(loss) filter (phase = 1), 0) as p1, coalesce(sum(loss) filter (phase = 2), 0) as p2 from ploss p join typ using (rec, lap_id) group by all),
rk as (select l.rec, l.cid, loss, coalesce(line, 0) as line, coalesce(apex, 0) as apex, coalesce(brake, 0) as brake, coalesce(coast, 0) as coast, coalesce(p0, 0) as p0, coalesce(p1, 0) as p1, coalesce(p2, 0) as p2, row_number() over (partition by l.rec order by loss desc, l.cid) as rank from loss_ l left join evd using (rec, cid) left join ph using (rec, cid)),
sg_ as (select *, [apex / (apex + 3.0::double), brake / (brake + 0.3::double), coast / (coast + 0.3::double), line / (line + 0.15::double)] as st from rk),
why as (select *, list_max(st) as s, case when rank > 3 or list_max(st) <= 1e-12 then 'none' else ['apex', 'brake', 'coast', 'line'][list_position(st, list_max(st))] end as reason from sg_)"""
#: Laps with outages, and what fills them: every donor lap's every sample is tried.
HOLED = laps("holed", TRACE + ", holed as (select * from trace where not (lap_no % 3 <> 0 and seq % 89 < lap_no % 14))") + """,
p0 as (select rec, lap_id, row_number() over w - 1 as i, t, x, y, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as dd from vs window w as (partition by rec, lap_id order by t, dist)),
pt as (select *, sum(dd) over (partition by rec, lap_id order by i) as s, count(*) over (partition by rec, lap_id) as k, lead(t) over w - t as dt, lead(x) over w as bx, lead(y) over w as by_, coalesce(lag(x) over w, x) as px, coalesce(lag(y) over w, y) as py, coalesce(lead(x, 2) over w, lead(x) over w) as nx, coalesce(lead(y, 2) over w, lead(y) over w) as ny from p0 window w as (partition by rec, lap_id order by i)),
gp as (select pt.*, greatest(cast(round_even(dt / greatest(coalesce(u, 0.1), 0.001), 0) as integer) - 1, 1) as missing, sqrt((bx - x) ** 2 + (by_ - y) ** 2) as chord from pt left join (select rec, lap_id, median(dt) as u from pt where dt > 0 and dt <= 0.35 group by all) using (rec, lap_id) where dt > 0.35 and k >= 3)"""


def _fills(gaps: str, donors: str, own: str) -> str:
    """CTEs down to ``fills``; ``donors`` is (rec, ref, donor, k, x, y, s, n)."""
    return f""",
dn as ({donors}),
nr as (select g.rec, g.lap_id, g.i, d.ref, d.donor, any_value(chord) as chord, min(struct_pack(d2 := (d.x - g.x) ** 2 + (d.y - g.y) ** 2, k := d.k, s := d.s, x := d.x, y := d.y)) as a, min(struct_pack(d2 := (d.x - g.bx) ** 2 + (d.y - g.by_) ** 2, k := d.k, s := d.s, x := d.x, y := d.y)) as b
  from {gaps} g join dn d on d.rec = g.rec and {own} where g.missing > 3 and d.n >= 3 group by g.rec, g.lap_id, g.i, d.ref, d.donor),
ft as (select *, sqrt(greatest(a.d2, b.d2)) as error from nr where a.k <> b.k and sqrt(greatest(a.d2, b.d2)) <= greatest(0.25 * chord, 5) and abs(b.s - a.s) / greatest(chord, 1e-6) between 0.4 and 3),
bs as (select * from (select *, row_number() over (partition by rec, lap_id, i order by ref, round(error, 9), donor) as q from ft) where q = 1),
bp as (select g.rec, g.lap_id, g.i, abs(d.k - b.a.k) as j, abs(b.b.k - b.a.k) as n, g.t + g.dt * abs(d.k - b.a.k) / abs(b.b.k - b.a.k) as t, b.ref, b.donor, b.error, g.x as gx, g.y as gy, g.bx - g.x as ex, g.by_ - g.y as ey, b.b.x - b.a.x as dx, b.b.y - b.a.y as dy, d.x - b.a.x as ux, d.y - b.a.y as uy
  from {gaps} g join bs b using (rec, lap_id, i) join dn d on d.rec = b.rec and d.ref = b.ref and d.donor = b.donor and d.k between least(b.a.k, b.b.k) and greatest(b.a.k, b.b.k)),
fills as (
  select rec, lap_id, i, j, n, t, case when j = 0 then gx when j = n then gx + ex else gx + ((ex * dx + ey * dy) * ux - (ey * dx - ex * dy) * uy) / (dx * dx + dy * dy) end as x, case when j = 0 then gy when j = n then gy + ey else gy + ((ey * dx - ex * dy) * ux + (ex * dx + ey * dy) * uy) / (dx * dx + dy * dy) end as y,
    case when ref then 'reference' else 'borrowed' end as source, case when not ref then donor end as donor, error from bp
  union all select rec, lap_id, i, j, n, t0 + dt * f, 0.5 * (2 * x + (bx - px) * f + (2 * px - 5 * x + 4 * bx - nx) * f ** 2 + (3 * x - px - 3 * bx + nx) * f ** 3), 0.5 * (2 * y + (by_ - py) * f + (2 * py - 5 * y + 4 * by_ - ny) * f ** 2 + (3 * y - py - 3 * by_ + ny) * f ** 3), case when missing <= 3 then 'curve' else 'uncovered' end, null, 0.0
    from (select g.*, g.t as t0, missing + 1 as n, j, j / (missing + 1)::double as f from (select *, unnest(range(0, missing + 2)) as j from {gaps} g where not exists (select 1 from bs where bs.rec = g.rec and bs.lap_id = g.lap_id and bs.i = g.i)) g)),
fill_len as (select rec, lap_id, i, any_value(source) as source, any_value(donor) as donor, any_value(error) as error, sum(st) as fill_m from (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as st from fills window w as (partition by rec, lap_id, i order by j)) group by rec, lap_id, i)"""


FILLS = HOLED + _fills("gp", "select rec, false as ref, lap_id as donor, i as k, x, y, s, k as n from pt", "d.donor <> g.lap_id")
ALONE = HOLED + """,
lastl as (select rec, max(lap_id) as lap_id from pt group by rec), ag as (select gp.* from gp join lastl using (rec, lap_id)),
whole1 as (select rec, min(lap_id) as lap_id from pt where not exists (select 1 from gp where gp.rec = pt.rec and gp.lap_id = pt.lap_id) group by rec),
cl as (select rec, i as k, x, y, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as dd from pt join whole1 using (rec, lap_id) where i % 2 = 0 window w as (partition by rec order by i))""" + _fills("ag", "select rec, true as ref, -1 as donor, k, x, y, sum(dd) over (partition by rec order by k) as s, count(*) over (partition by rec) as n from cl", "true")


LOOPS = LAPS + """,
lp0 as (select vs.rec, vs.t as o, vs.x, vs.y from vs join best using (rec, lap_id)),
lp1 as (select * from lp0 union all select rec, (select max(o) + 1 from lp0 z where z.rec = f.rec), f.x, f.y from (select *, row_number() over (partition by rec order by o) as q from lp0) f where q = 1),
lp2 as (select *, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as d from lp1 window w as (partition by rec order by o)),
lp3 as (select rec, x, y, sum(d) over (partition by rec order by o) as s from lp2),
lp4 as (select rec, m / 512 * i as s, i from (select rec, max(s) as m from lp3 group by rec), range(0, 512) u(i))""" + at("loops_", "lp4", "i", "lp3", ("x", "y"), "rec", "s") + """,
lt as (select l.rec, way, shift, l.x, l.y, r.x as u, r.y as v from loops_ l, (values (1), (-1)) w(way), range(0, 512) h(shift) join loops_ r on r.rec = 0 and r.i = ((way * l.i + shift) % 512 + 512) % 512),
lm as (select rec, way, shift, avg(x) as mx, avg(y) as my, avg(u) as mu, avg(v) as mv, avg(x * x) as xx, avg(y * y) as yy, avg(u * u) as uu, avg(v * v) as vv, avg(x * u) as xu, avg(x * v) as xv, avg(y * u) as yu, avg(y * v) as yv from lt group by all),
ls as (select *, xx - mx * mx + yy - my * my as spread, uu - mu * mu + vv - mv * mv as aim, hand, xu - mx * mu + hand * (yv - my * mv) as c, xv - mx * mv - hand * (yu - my * mu) as s from lm, (values (1), (-1)) g(hand)),
lfit as (select * from (select *, sqrt(greatest(aim - (c * c + s * s) / spread, 0)) as rms, sqrt(c * c + s * s) / spread as scale, row_number() over (partition by rec order by sqrt(greatest(aim - (c * c + s * s) / spread, 0)), shift, way) as q from ls) where q = 1)"""


ORACLE: dict[str, str] = {
    "quality_gate_fraction": f"with {TRACE} select rec, count(*) as fixes, count(*) filter (v > 3 and (fix < 3 or dop > 10)) as dropped, round(count(*) filter (v > 3 and (fix < 3 or dop > 10)) / count(*) filter (v > 3)::double, 6) as fraction from trace group by rec",
    "timing_quality": f"with {TRACE}, f as (select rec, round(count(*) filter (v > 3 and (fix < 3 or dop > 10)) / count(*) filter (v > 3)::double, 6) as fraction from trace group by rec) select rec, fraction, rec = 1 or fraction >= 0.08 as degraded, case when rec = 1 and fraction >= 0.08 then 'media clock, weak GPS' when rec = 1 then 'media clock' when fraction >= 0.08 then 'weak GPS' else 'good' end as summary from f",
    "moving_time": f"with {CLEAN}{STEPS.format(t='clean')} select rec, round(coalesce(sum(dt) filter (dt > 0 and dt <= 1 and v0 >= 4), 0), 3) as moving_s from steps group by rec",
    "gap_runs": f"with {CLEAN}{STEPS.format(t='clean')}, r as (select rec, seq, cast(sum(case when dt > 1 then 1 else 0 end) over (partition by rec order by seq) as bigint) as run from steps) select rec, run, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from r group by all",
    "dropout_gaps": f"with {CLEAN}{STEPS.format(t='clean')}, u as (select rec, median(dt) as usual from steps where dt > 0 and dt < 1 group by rec) select s.rec, seq, round(t - dt, 3) as t0, round(t, 3) as t1, cast(greatest(round_even(dt / usual, 0) - 1, 1) as bigint) as missing from steps s join u on s.rec = u.rec where dt > 0.35",
    "true_clock_runs": f"""with {CLEAN}, f as (select rec, seq, t * 1.001::double as naive, case when seq % 97 = 0 then 0 else seq * 100 + 1 end as ts from clean),
      j as (select *, coalesce(ts > 0 and lag(ts) over w > 0 and (ts - lag(ts) over w) / 1000.0::double between 0.02 and 0.4, false) as joined from f window w as (partition by rec order by seq)),
      r as (select *, sum(case when joined then 0 else 1 end) over (partition by rec order by seq) as run from j),
      c as (select *, case when count(*) over (partition by rec, run) > 1 then first_value(naive) over x + (ts - first_value(ts) over x) / 1000.0::double else naive end as t1 from r window x as (partition by rec, run order by seq))
      select rec, seq, round(max(t1) over (partition by rec order by seq), 4) as t from c""",
    "boxcar_speed": f"""with {CLEAN}{STEPS.format(t='clean')}, r as (select *, sum(case when dt > 1 then 1 else 0 end) over (partition by rec order by seq) as run from steps)
      select rec, seq, round(case when count(*) over (partition by rec, run) >= 13 then avg(v) over (partition by rec, run order by seq rows between 6 preceding and 6 following) else v end, 6) as v_smooth from r""",
    "odometer": f"with {CLEAN}{STEPS.format(t='clean')} select rec, round(sum(coalesce(case when dt > 0.35 then greatest(sqrt((x - x0) ** 2 + (y - y0) ** 2), 0.5 * (v0 + v) * dt) else sqrt((x - x0) ** 2 + (y - y0) ** 2) end, 0)), 3) as odo_m, count(*) as n from steps group by rec",
    "path_distance": f"with {TRACE}{STEPS.format(t='trace')} select rec, round(sum(sqrt((x - x0) ** 2 + (y - y0) ** 2)), 3) as path_m from steps group by rec",
    "bbox_centroid": f"with {TRACE} select rec, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, round((min(x) + max(x)) / 2, 6) as mid_x, round((min(y) + max(y)) / 2, 6) as mid_y from trace group by rec",
    "spike_filter": f"""with {TRACE}, s as (select * replace (case when seq % 101 = 50 then x + 300 else x end as x) from trace),
      b as (select rec, count(*) as n, quantile_cont(x, 0.01) as x0, quantile_cont(x, 0.99) as x1, quantile_cont(y, 0.01) as y0, quantile_cont(y, 0.99) as y1 from s group by rec),
      m as (select *, greatest(0.5 * greatest(x1 - x0, y1 - y0), 1) as mg from b),
      k as (select s.*, lag(x) over w as px, lag(y) over w as py, lead(x) over w as nx, lead(y) over w as ny from s window w as (partition by rec order by seq)),
      f as (select *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2) > 50 and sqrt((nx - x) ** 2 + (ny - y) ** 2) > 50 and sqrt((nx - px) ** 2 + (ny - py) ** 2) < 50, false) as spike from k)
      select f.rec, count(*) as n, cast(sum(seq) as bigint) as seq_sum from f join m on f.rec = m.rec where m.n < 10 or (not spike and x between x0 - mg and x1 + mg and y between y0 - mg and y1 + mg) group by f.rec""",
    "trimmed_trace": f"""with {TRACE}, z as (select rec, seq, case when seq < 7 then 0.0 else v end as v from trace),
      m as (select *, min(v) over (partition by rec order by seq rows between current row and 4 following) as lo, lead(seq, 4) over (partition by rec order by seq) as l4 from z),
      e as (select rec, min(seq) filter (lo > 3 and l4 is not null) as a, max(seq) filter (v > 3) as b from m group by rec),
      i as (select z.rec, z.seq, coalesce(seq between a and b, false) as inn from z join e on z.rec = e.rec), c as (select *, count(*) filter (inn) over (partition by rec) as n from i)
      select rec, count(*) as n, min(seq) as first_seq, max(seq) as last_seq from c where inn or n < 10 group by rec""",
    "lap_crossings": f"with {LAPS} select rec, lap_id, t_cross from cross_",
    "lap_table": f"with {LAPS} select rec, lap_id, lap_s, samples, dist_m, round(lap_s - min(lap_s) over (partition by rec), 3) as delta_s from valid",
    "valid_laps": f"with {LAPS} select rec, lap_id, lap_s, samples from valid",
    "excluded_laps": f"with {laps('thin', TRACE + ', thin as (select * from trace where not (lap_no % 7 = 3 and seq % 2 = 0 and v > 25))', '* replace (case when lap_id % 5 = 0 then round(lap_s * 1.7::double, 3) else lap_s end as lap_s)')} select rec, lap_id, lap_s, samples from enough e where not exists (select 1 from valid v where v.rec = e.rec and v.lap_id = e.lap_id)",
    "dropout_laps": f"with {laps('clean', CLEAN)} select rec, lap_id, max_dt, max_dt > 0.35 as dropout from valid",
    "best_lap": f"with {LAPS} select rec, lap_id, lap_s from best",
    "capped_selection": f"with {LAPS} select rec, lap_id, lap_s from (select *, row_number() over (partition by rec order by lap_s, lap_id) as q from valid) where q <= 6",
    "lap_at_time": f"with {LAPS} select t.rec, t.seq, v.lap_id from trace t left join valid v on t.rec = v.rec and t.t >= v.t_start and t.t < v.t_finish",
    "sector_splits": f"with {SPLITS} select rec, lap_id, cast(sector as integer) as sector, split_s from splits",
    "session_best_splits": f"with {SPLITS} select rec, cast(sector as integer) as sector, min(split_s) as best_s from splits where split_s > 0 group by all",
    "theoretical_best": f"with {SPLITS}, b as (select rec, sector, min(split_s) filter (split_s > 0) as b from splits group by all) select rec, round(case when count(*) = count(b) then sum(b) end, 4) as theoretical_s from b group by rec",
    "best_rolling_lap": f"""with {LAPS}, okl as (select rec, lap_id from cand where not dropout),
      h0 as (select s.rec, s.lap_id, s.t, s.x, s.y, row_number() over w - 1 as i, dist / max(dist) over (partition by rec, lap_id) as share, lag(s.x) over w as xa, lead(s.x) over w as xb, lag(s.y) over w as ya, lead(s.y) over w as yb,
             lag(s.t) over w as ta, lead(s.t) over w as tb from samples s join okl using (rec, lap_id) window w as (partition by rec, lap_id order by t, dist)),
      h1 as (select *, case when xa is null then xb - x when xb is null then x - xa else (xb - xa) / 2 end as gx, case when ya is null then yb - y when yb is null then y - ya else (yb - ya) / 2 end as gy from h0),
      h as (select *, case when sqrt(gx ** 2 + gy ** 2) > 0 then gx / sqrt(gx ** 2 + gy ** 2) else 0 end as hx, case when sqrt(gx ** 2 + gy ** 2) > 0 then gy / sqrt(gx ** 2 + gy ** 2) else 0 end as hy from h1),
      m as (select rec, lap_id - 1 as lap_id, count(*) as m from h group by all),
      an as (select a.rec, a.lap_id, a.i, a.t, a.x, a.y, a.hx, a.hy, m.m, count(b.i) as c from h a join m on m.rec = a.rec and m.lap_id = a.lap_id left join h b on b.rec = a.rec and b.lap_id = a.lap_id + 1 and b.share < a.share group by all),
      met as (select a.rec, a.lap_id, a.i, a.t as at_, a.x as ax, a.y as ay, b.i as j, b.x, b.y, b.t, coalesce(b.xa, b.x) as xa, coalesce(b.ya, b.y) as ya, coalesce(b.ta, b.t) as ta, coalesce(b.xb, b.x) as xb, coalesce(b.yb, b.y) as yb, coalesce(b.tb, b.t) as tb
              from an a join h b on b.rec = a.rec and b.lap_id = a.lap_id + 1 and b.i between least(c, m - 1) - greatest(5, floor(m * 0.02)) and least(c, m - 1) + greatest(5, floor(m * 0.02)) where a.hx * b.hx + a.hy * b.hy >= 0.5),
      nr as (select * from (select *, row_number() over (partition by rec, lap_id, i order by (x - ax) ** 2 + (y - ay) ** 2, j) as q from met) where q = 1),
      u as (select *, (x - xa) ** 2 + (y - ya) ** 2 as la, (xb - x) ** 2 + (yb - y) ** 2 as lb from nr),
      f as (select *, case when la > 0 then least(greatest(((ax - xa) * (x - xa) + (ay - ya) * (y - ya)) / la, 0), 1) else 0 end as fa, case when lb > 0 then least(greatest(((ax - x) * (xb - x) + (ay - y) * (yb - y)) / lb, 0), 1) else 0 end as fb from u),
      z as (select *, (xa + fa * (x - xa) - ax) ** 2 + (ya + fa * (y - ya) - ay) ** 2 as da, (x + fb * (xb - x) - ax) ** 2 + (y + fb * (yb - y) - ay) ** 2 as db from f),
      w as (select rec, min(case when da <= db then ta + fa * (t - ta) else t + fb * (tb - t) end - at_) as w from z where least(da, db) <= 9 group by rec)
      select best.rec, round(least(lap_s, coalesce(w, lap_s)), 4) as rolling_s from best left join w on best.rec = w.rec""",
    "sector_crossings": f"""with recursive {TRACE}{STEPS.format(t='trace')},
      ev as (select rec, seq, 0 as no, t0 + (t - t0) * ((50.005::double - x0) / (x - x0)) as tc from steps where (x0 - 50.005::double) * (x - 50.005::double) < 0 and abs(y0 + (y - y0) * ((50.005::double - x0) / (x - x0))) < 15
        union all select rec, seq, 1, t0 + (t - t0) * ((50.005::double - x0) / (x - x0)) from steps where (x0 - 50.005::double) * (x - 50.005::double) < 0 and abs(y0 + (y - y0) * ((50.005::double - x0) / (x - x0)) - 60) < 15
        union all select rec, seq, 2, t0 + (t - t0) * ((30.0005::double - y0) / (y - y0)) from steps where (y0 - 30.0005::double) * (y - 30.0005::double) < 0 and abs(x0 + (x - x0) * ((30.0005::double - y0) / (y - y0)) + 30) < 15),
      walk(rec, n, seq) as (select rec, 0, min(seq) from ev where no = 0 group by rec union all select w.rec, w.n + 1, min(e.seq) from walk w join ev e on e.rec = w.rec and e.no = (w.n + 1) % 3 and e.seq > w.seq group by w.rec, w.n)
      select walk.rec, walk.n, walk.n % 3 as line, walk.seq, round(tc, 3) as t_cross from walk join ev on ev.rec = walk.rec and ev.seq = walk.seq and ev.no = walk.n % 3""",
    "lap_channels": f"with {LAPS} select rec, lap_id, count(*) as n, max(round(dist, 3)) as distance_m, round(avg(round(v * 3.6::double, 3)), 3) as mean_kmh from vs group by all",
    "laps_pivot": f"with {SPLITS} select s.rec, s.lap_id, max(split_s) filter (sector = 0) as s1, max(split_s) filter (sector = 1) as s2, max(split_s) filter (sector = 2) as s3, max(v.lap_s) as lap_s from splits s join valid v on s.rec = v.rec and s.lap_id = v.lap_id group by s.rec, s.lap_id",
    "pace_stats": f"with {LAPS}, a as (select rec, count(*) as n, min(lap_s) as best_s, median(lap_s) as m, stddev_samp(lap_s) as s from valid group by rec) select rec, n, best_s, round(m, 4) as median_s, round(s, 4) as sigma_s, round(round(m, 4) - best_s, 4) as gap_s, round(s / round(m, 4) * 100, 4) as cov_pct from a",
    "lap_time_trend": f"with {LAPS} select rec, lap_id, lap_s from valid",
    "theil_sen": f"with {LAPS}, p as (select rec, lap_s, row_number() over (partition by rec order by lap_id) as i from valid) select a.rec, (select count(*) from p c where c.rec = a.rec) as n, round(case when (select count(*) from p c where c.rec = a.rec) >= 6 then median((b.lap_s - a.lap_s) / (b.i - a.i)) end, 4) as slope from p a join p b on a.rec = b.rec and b.i > a.i group by a.rec",
    "race_pace": f"with {LAPS}, m as (select rec, avg(lap_s) over w as m, count(*) over w as k from valid window w as (partition by rec order by lap_id rows between 2 preceding and current row)) select rec, round(min(m), 4) as race_pace_s from m where k = 3 group by rec",
    "within_pct": f"with {LAPS}, b as (select *, min(lap_s) over (partition by rec) as b from valid) select rec, count(*) filter (lap_s <= b * 1.02::double) as within, count(*) as n from b group by rec",
    "pb_mask": f"with {LAPS} select rec, lap_id, lap_s, coalesce(lap_s < min(lap_s) over (partition by rec order by lap_id rows between unbounded preceding and 1 preceding), true) as is_pb from valid",
    "median_lap": f"with {LAPS}, r as (select *, row_number() over (partition by rec order by lap_s, lap_id) as q, count(*) over (partition by rec) as n from valid) select rec, lap_id, lap_s from r where q = (n + 1) // 2",
    "session_totals": f"with {TRACE} select rec, count(*) as fixes, round(max(t) - min(t), 3) as duration_s, round(max(odo) - min(odo), 3) as driven_m, max(v) as vmax_mps from trace group by rec",
    "lap_speed_stats": f"with {LAPS} select rec, lap_id, round(v_max * 3.6::double, 3) as vmax_kmh, round(v_min * 3.6::double, 3) as vmin_kmh, round(dist_m / lap_s * 3.6::double, 3) as mean_kmh from valid",
    "sector_spreads": f"with {SPLITS}, a as (select rec, cast(sector as integer) as sector, count(*) as n, stddev_samp(split_s) as s, median(split_s) as m, min(split_s) as b from splits group by all having count(*) > 1), o as (select rec, sector, n, round(s, 4) as sigma_s, round(m, 4) as median_s, round(m - b, 4) as loss_s, round(s * (m - b), 6) as score from a) select *, cast(row_number() over (partition by rec order by score desc, sector) as integer) as rank from o",
    "delta_grid": f"with {GRID}, b as (select g.rec, g.i, g.elapsed as e from grid g join best on g.rec = best.rec and g.lap_id = best.lap_id) select g.rec, g.lap_id, cast(g.i as integer) as i, round(g.elapsed - b.e, 4) + 0.0::double as delta_s from grid g join b on g.rec = b.rec and g.i = b.i",
    "ideal_envelope": f"with {IDEAL} select rec, cast(i as integer) as i, round(ideal_s, 4) as ideal_s from ideal",
    "delta_to_ideal": f"with {IDEAL} select g.rec, g.lap_id, cast(g.i as integer) as i, round(g.elapsed - d.ideal_s, 4) + 0.0::double as delta_s from grid g join ideal d on g.rec = d.rec and g.i = d.i",
    "delta_between": f"with {GRID} select a.rec, a.lap_id, cast(a.i as integer) as i, round(b.elapsed - a.elapsed, 4) + 0.0::double as delta_s from grid a join grid b on a.rec = b.rec and a.i = b.i and b.lap_id = a.lap_id + 1",
    "ideal_gap": f"with {IDEAL}, b as (select c.rec, min(c.lap_s) as best_s from cand c where not dropout group by c.rec) select b.rec, best_s, round(ideal_s, 4) as ideal_s, round(best_s - round(ideal_s, 4), 4) + 0.0::double as gap_s from b join ideal d on d.rec = b.rec and d.i = 399",
    "ideal_total": f"with {IDEAL} select rec, round(ideal_s, 4) as ideal_s from ideal where i = 399",
    "reference_lap_delta": f"with {GRID}, b as (select g.i, g.elapsed as e from grid g join best on g.rec = best.rec and g.lap_id = best.lap_id where g.rec = 0) select g.rec, g.lap_id, cast(g.i as integer) as i, round(g.elapsed - b.e, 4) + 0.0::double as delta_s from grid g join b on g.i = b.i where g.rec <> 0",
    "otsu_threshold": f"""with {TRACE}, q as (select rec, log10(greatest(abs(v / 1000), 0.0001)) as q from trace), bx as (select rec, min(q) as lo, max(q) as hi from q group by rec),
      pl as (select q.rec, least(floor((q - lo) / case when hi > lo then hi - lo else 1.0 end * 128), 127)::integer as b from q join bx on q.rec = bx.rec),
      ct as (select rec, b, count(*) as n from pl group by all), hs as (select bx.rec, u.b, coalesce(n, 0) as n, lo + (hi - lo) * (u.b + 0.5::double) / 128 as m from bx cross join (select unnest(range(0, 128))::integer as b) u left join ct on ct.rec = bx.rec and ct.b = u.b),
      c as (select *, sum(n) over w as w0, sum(n * m) over w as s0, sum(n) over (partition by rec) as w, sum(n * m) over (partition by rec) as s from hs window w as (partition by rec order by b)),
      v as (select rec, b, m, round(w0::double * (w - w0)::double * (s0 / w0 - (s - s0) / (w - w0)) ** 2, 6) as v from c where w0 > 0 and w - w0 > 0)
      select rec, b as bin, round(10.0::double ** m, 8) as threshold from (select *, row_number() over (partition by rec order by v desc, b) as r from v) where r = 1""",
    "long_g": f"with {LONG_G} select rec, seq, round(long_g, 5) + 0.0::double as long_g from gs",
    "brake_threshold": f"with {LONG_G} select rec, theta from theta",
    "brake_islands": f"""with {LONG_G}, g as (select gs.*, theta from gs join theta on gs.rec = theta.rec),
      i as {islands('g', 'long_g < -0.35::double * theta')}
      select rec, round(min(t), 3) as t0, round(max(t), 3) as t1, round(max(-long_g), 4) as peak_g, round(min(odo), 3) as d0, round(max(odo), 3) as d1 from i where inside group by rec, island having bool_or(long_g < -theta)""",
    "coast_spans": f"""with {LONG_G}, {_smooth_g(5)}, g as (select sm.*, theta from sm join theta on sm.rec = theta.rec),
      i as {islands('g', 'long_g > -theta and long_g < -0.03::double and v > 4')}
      select rec, t0, t1 from (select rec, round(min(t), 3) as t0, round(max(t), 3) as t1 from i where inside group by rec, island) where round(t1 - t0, 3) >= 0.25""",
    "grip_envelope": f"with {LATERAL} select rec, envelope_g from env",
    "grip_utilization": f"with {LATERAL} select lat.rec, seq, round(least(sqrt(lat_g ** 2 + long_g ** 2) / envelope_g, 1.2::double), 4) as utilisation from lat join env on lat.rec = env.rec",
    "rainbow_buckets": f"with {TRACE}, b as (select rec, min(v) as lo, max(v) as hi from trace group by rec) select t.rec, seq, cast(case when hi <= lo then 8 else least(greatest(floor((v - lo) / (hi - lo) * 16), 0), 15) end as integer) as bucket from trace t join b on t.rec = b.rec",
    "trust_label": f"with {HISTORY} select fingerprint, case when not verified then 'provisional' when degraded then 'estimated' when dropout then 'dropout' else 'trusted' end as label from hist",
    "prior_best": f"with {HISTORY} select track, min(best) as prior_best from good group by track",
    "pb_series": f"with {HISTORY} select track, date, best, fingerprint from pbs",
    "track_summary": f"with {HISTORY}, b as (select track, best, date as best_date from (select *, row_number() over (partition by track order by best, date) as q from good) where q = 1) select h.track, count(*) as sessions, any_value(b.best) as best, any_value(best_date) as best_date, coalesce(any_value(n.n), 0)::bigint as pb_count from hist h left join b on h.track = b.track left join (select track, count(*) as n from pbs group by track) n on n.track = h.track group by h.track",
    "library_upsert": f"with {HISTORY}, u as (select fingerprint, track, date, best, 0 as nw from hist where fingerprint % 4 <> 1 union all select fingerprint, track, date, round(best - 1, 2), 1 from hist where fingerprint % 3 = 0) select fingerprint, track, best from (select *, row_number() over (partition by fingerprint order by nw desc, date desc, best desc) as q from u) where q = 1",
    "fingerprint": f"""with {HISTORY}, n as (select fingerprint, printf('/card/DCIM/g%s%02d%04d.mp4', case fingerprint % 3 when 0 then 'X' when 1 then 'H' else 'q' end, fingerprint % 7, fingerprint % 10000) as name from hist), u as (select *, upper(regexp_replace(name, '^.*/', '')) as up from n)
      select fingerprint, name, case when regexp_matches(up, '^G[XHLP][0-9]{{6}}\\.MP4$') then regexp_replace(up, '^(G[XHLP])[0-9]{{2}}([0-9]{{4}})\\.MP4$', '\\1\\2') else regexp_replace(up, '\\.[^.]*$', '') end as print from u""",
    "track_match": f"""with {PLACES}, d as (select place, track, round(2 * 6371000.0::double * asin(sqrt(sin((radians(k_lat) - radians(lat)) / 2) ** 2 + cos(radians(lat)) * cos(radians(k_lat)) * sin(radians(k_lon - lon) / 2) ** 2)), 3) as distance_m, round(greatest(diag, k_diag) / least(diag, k_diag), 10) as ratio from places, tracks)
      select * from d where distance_m <= 750 and ratio <= 2""",
    "track_detect": f"""with {PLACES}, d as (select place, track, round(6371000.0::double * sqrt((radians(k_lon - lon) * cos(radians((lat + k_lat) / 2))) ** 2 + radians(k_lat - lat) ** 2), 3) as distance_m from places, tracks)
      select place, track, distance_m from (select *, row_number() over (partition by place order by distance_m, track desc) as q from d where distance_m <= 1500) where q = 1""",
    "index_at_time": f"with {TRACE} select a.rec, a.seq as asked, coalesce(b.seq, z.seq) as seq from trace a asof left join trace b on b.rec = a.rec and b.t >= a.t + 0.05::double join (select rec, max(seq) as seq from trace group by rec) z on z.rec = a.rec",
    "lap_completions": f"with {LAPS} select rec, lap_id as lap_no, round(sum(lap_s) over (partition by rec order by lap_id rows between unbounded preceding and current row), 3) as done_s from valid",
    "pit_brackets": f"with {LAPS}, p as (select rec, lap_id, case when lap_s >= 21 then lap_id end as stop from valid) select rec, lap_id as lap_no, max(stop) over (partition by rec order by lap_id rows between unbounded preceding and 1 preceding) as pit_before, min(stop) over (partition by rec order by lap_id rows between 1 following and unbounded following) as pit_after from p",
    "lap_residuals": f"with {LAPS}, p as (select rec, lap_s as m, floor(lap_s * 4) / 4 as r from valid) select rec, count(*) as n, round(avg(m - r), 6) as mean, round(median(m - r), 6) as median, round(stddev_pop(m - r), 6) as std, round(sqrt(avg((m - r) ** 2)), 6) as rms, round(sum(m * r) / sum(r ** 2), 6) as rate from p group by rec",
    "lap_labels": f"""with {LAPS}, q as (select rec, lap_id, lap_s, cast(round(lap_s * 1000) as bigint) as ms, cast(floor(lap_s * 100) as bigint) as s from valid)
      select rec, lap_id, 'Lap ' || (lap_id + 1) as label, printf('%d:%02d.%03d', ms // 60000, ms // 1000 % 60, ms % 1000) as clock, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) else printf('%d:%02d', s // 60, s % 60) end as duration from q""",
    "pedal_intensity": f"with {LONG_G} select gs.rec, seq, round(case when long_g < 0 then case when -long_g < 0.18 then 0.0 else -least(-long_g / theta, 1.0) end else least(long_g / 0.5::double, 1.0) end, 4) + 0.0::double as pedal from gs join theta on gs.rec = theta.rec",
    "median_start_line": f"""with {TRACE}, o as (select *, row_number() over w - 1 as i, count(*) over (partition by rec) as n, lead(x, 20) over w - x as hx, lead(y, 20) over w - y as hy from trace window w as (partition by rec order by seq)),
      m as (select *, sqrt(hx * hx + hy * hy) as k from o where i = n // 2)
      select rec, round(x + hy / k * 5, 4) as x1, round(y - hx / k * 5, 4) as y1, round(x - hy / k * 5, 4) as x2, round(y + hx / k * 5, 4) as y2 from m""",
    "pb_moments": """with h as (select o_orderkey as fingerprint, o_orderpriority as track, o_totalprice as best, o_orderstatus <> 'P' and o_custkey % 17 <> 0 and o_custkey % 13 <> 0 as good from orders),
      p as (select track, min(best) as b from h where fingerprint % 5 <> 0 and good group by track)
      select fingerprint, h.track, case when not good then 'none' when b is null then 'first' when best < b then 'beat' else 'none' end as moment from h left join p on p.track = h.track where fingerprint % 5 = 0""",
    "local_frame": """with p as (select c_custkey as place, 45 + (c_custkey * 37 % 1000) / 10000.0::double as lat, 7 + (c_custkey * 91 % 1000) / 10000.0::double as lon, 500.0::double + c_custkey % 400 as alt from customer),
      c as (select place, (1 + alt / 6378000.0::double) * 6378000 * cos(radians(lat)) * cos(radians(lon)) as x, (1 + alt / 6378000.0::double) * 6378000 * cos(radians(lat)) * sin(radians(lon)) as y, (1 + alt / 6378000.0::double) * 6357000 * sin(radians(lat)) as z from p),
      o as (select radians(45.05::double) as a, radians(7.05::double) as b, 6378000 * cos(a) * cos(b) as x, 6378000 * cos(a) * sin(b) as y, 6357000 * sin(a) as z),
      d as (select place, c.x - o.x as dx, c.y - o.y as dy, c.z - o.z as dz, a, b from c, o)
      select place, round(-dx * sin(b) + dy * cos(b), 3) + 0.0::double as east,
        round((-dx * 6378000 * sin(a) * cos(b) - dy * 6378000 * sin(a) * sin(b) + dz * 6357000 * cos(a)) / sqrt((6378000 * sin(a)) ** 2 + (6357000 * cos(a)) ** 2), 3) + 0.0::double as north,
        round((dx * cos(a) * cos(b) + dy * cos(a) * sin(b) + dz * 6357000 / 6378000 * sin(a)) / sqrt(cos(a) ** 2 + (6357000.0::double / 6378000 * sin(a)) ** 2), 3) + 0.0::double as up from d""",
    "track_maps": f"""with {TRACE}, b as (select rec, min(v) as lo, max(v) as hi from trace group by rec), q as (select t.rec, seq, cast(case when hi <= lo then 8 else least(greatest(floor((v - lo) / (hi - lo) * 16), 0), 15) end as integer) as bucket from trace t join b on t.rec = b.rec),
      r as (select *, sum(c) over (partition by rec order by seq) as run from (select *, case when bucket <> lag(bucket) over (partition by rec order by seq) then 1 else 0 end as c from q))
      select rec, cast(run as bigint) as run, bucket, count(*) as points from r group by all""",
    "locked_seeks": f"""with {LAPS}, s as (select vs.*, total from vs join totals_ using (rec, lap_id)),
      a as (select s.rec, s.lap_id, s.t, s.dist / s.total as share from s join valid v on v.rec = s.rec and v.lap_id = s.lap_id + 1 where kind = 1),
      k as (select a.*, a.share * z.total as d from a join totals_ z on z.rec = a.rec and z.lap_id = a.lap_id + 1),
      lo as (select k.rec, k.lap_id, k.t, k.d, max(struct_pack(d := s.dist, t := s.t)) as p from k join s on s.rec = k.rec and s.lap_id = k.lap_id + 1 and s.dist <= k.d group by all),
      hi as (select k.rec, k.lap_id, k.t, k.d, min(struct_pack(d := s.dist, t := s.t)) as p from k join s on s.rec = k.rec and s.lap_id = k.lap_id + 1 and s.dist >= k.d group by all)
      select k.rec, k.lap_id, round(k.t, 3) as t, round(case when hi.p is null then lo.p.t when hi.p.d = lo.p.d then lo.p.t else lo.p.t + (hi.p.t - lo.p.t) * ((k.d - lo.p.d) / (hi.p.d - lo.p.d)) end, 3) as t_other
      from k left join lo using (rec, lap_id, t, d) left join hi using (rec, lap_id, t, d)""",
    "curvature_profile": f"with {PROFILE} select rec, i, round(s_m, 3) as s_m, round(kappa, 6) + 0.0::double as kappa from profile",
    "corner_detect": f"with {CORNERS} select * from corners",
    "corner_projection": f"with {WINDOWS} select rec, lap_id, cid, edge, round(dist, 3) as dist from proj",
    "corner_projection_drifted": f"with {DRIFTED} select rec, lap_id, cid, edge, round(dist, 3) as dist from proj",
    "corner_times_drifted": f"with {DRIFTED}{STATS_} select rec, lap_id, cid, time_s from cstats",
    "corner_stats": f"with {STATS} select rec, lap_id, cid, time_s, round(enter, 3) as enter, round(exit, 3) as exit, round(apex, 3) as apex, round(v_enter, 3) as v_enter, round(v_exit, 3) as v_exit, round(v_apex, 3) as v_apex from cstats",
    "corner_deltas": f"with {STATS} select c.rec, c.lap_id, c.cid, round(c.time_s - b.time_s, 4) + 0.0::double as delta_s, round(c.v_apex - b.v_apex, 4) + 0.0::double as apex_delta from cstats c join best using (rec) join cstats b on b.rec = c.rec and b.lap_id = best.lap_id and b.cid = c.cid",
    "corner_bests": f"with {STATS} select rec, cid, min(time_s) as best_s, max(v_apex) as best_apex from cstats group by all",
    "corner_report": f"with {STATS}, a as (select rec, cid, count(time_s) as n, min(time_s) as b, median(time_s) as m, stddev_samp(time_s) as s, median(v_apex) as v from cstats group by all) select rec, cid, n, round(b, 4) as best_s, round(m, 4) as median_s, round(s, 4) as sigma_s, round(m - b, 4) as loss_s, round(v * 3.6, 3) as apex_kmh, round(coalesce(s * (m - b), 0.0), 6) as score from a",
    "corner_spreads": f"with {STATS}, a as (select rec, cid, count(time_s) as n, stddev_samp(time_s) as s, median(time_s) as m, min(time_s) as b from steady group by all having count(time_s) > 1), o as (select rec, cid, n, round(s, 4) as sigma_s, round(m, 4) as median_s, round(m - b, 4) as loss_s, round(s * (m - b), 6) as score from a) select *, cast(row_number() over (partition by rec order by score desc, cid) as integer) as rank from o",
    "segment_times": f"with {WINDOWS}{SEGMENTS} select rec, lap_id, part, case when part % 2 = 1 then cast((part + 1) // 2 as bigint) end as cid, time_s from segs",
    "straights_report": f"""with {STATS}{SEGMENTS}, q as (select s.rec, cast(part // 2 as integer) as k, count(*) as n, min(time_s) as b, median(time_s) as m, stddev_samp(time_s) as s from segs s join okl using (rec, lap_id) where part % 2 = 0 group by s.rec, part // 2),
      lc as (select rec, max(cid) as last from steady group by rec),
      tr as (select rec, k, max(v) as tb, median(v) as tm from (select rec, cid - 1 as k, v_enter as v from steady union all select rec, last, v from (select vs.rec, last, v, row_number() over (partition by vs.rec, vs.lap_id order by dist desc) as q from vs join okl using (rec, lap_id) join lc using (rec)) where q = 1) group by rec, k),
      ex as (select s.rec, s.cid as k, (median(s.v_exit) - any_value(b.v_exit)) * 3.6 as d from steady s join best using (rec) join cstats b on b.rec = s.rec and b.lap_id = best.lap_id and b.cid = s.cid group by s.rec, s.cid)
      select q.rec, q.k, case when q.k = 0 then 'S/F → C1' when q.k = last then 'C' || q.k || ' → S/F' else 'C' || q.k || ' → C' || (q.k + 1) end as label, case when q.k = 0 then last else q.k end as ring, n, round(b, 4) as best_s, round(m, 5) as median_s, round(s, 4) as sigma_s,
        round(tb * 3.6, 3) as trap_best_kmh, round(tm * 3.6, 3) as trap_median_kmh, round(d, 3) as exit_delta_kmh, round(coalesce(greatest(-d, 0) * greatest(m - b, 0), 0), 5) as leverage from q join lc using (rec) left join tr on tr.rec = q.rec and tr.k = q.k left join ex on ex.rec = q.rec and ex.k = q.k""",
    "phase_matrix": f"with {PHASES} select rec, cid, cast(phase as integer) as phase, round(loss, 4) + 0.0::double as loss_s, round(greatest(loss, 0) / nullif(sum(greatest(loss, 0)) over (partition by rec), 0), 4) as share from pmed",
    "phase_shares": f"with {PHASES} select rec, round(sum(greatest(loss, 0)) filter (phase = 0), 4) as entry_s, round(sum(greatest(loss, 0)) filter (phase = 1), 4) as apex_s, round(sum(greatest(loss, 0)) filter (phase = 2), 4) as exit_s from pmed group by rec",
    "brake_events_merged": f"with {BRAKES} select rec, lap_id, round(d0, 4) as d0, round(t0, 4) as t0, round(d1, 4) as d1, round(peak, 4) as peak_g, round(seconds, 4) as seconds, n::bigint as fragments from brakes",
    "lap_coasting": f"with {CALM} select rec, lap_id, round(d0, 4) as d0, round(d1, 4) as d1, round(seconds, 4) as seconds from coasts",
    "brake_points": f"with {POINTS} select rec, lap_id, cid, round(onset, 3) as onset, round(peak, 3) as peak_g, round(optimal, 3) as optimal, round(optimal - onset, 3) as metres_later, round(commit_, 3) as commit from points",
    "brake_consistency": f"with {POINTS}, o as (select p.*, onset * length / total as o from points p join okl using (rec, lap_id) join totals_ using (rec, lap_id) join length_ using (rec)) select rec, cid, count(*) as n, round(median(o), 3) as median_m, round(stddev_samp(o), 4) as sigma_m, round(max(o) - min(o), 3) as span_m, round(median(commit_) * 100, 3) as commit_pct, round(median(optimal - onset), 3) as later_m from o group by all",
    "reasons": f"with {REASONS} select rec, cast(rank as integer) as rank, cid, reason, round(loss, 4) as loss_s, round(case when reason = 'none' then 0 else loss * s end, 4) as contribution_s, round(apex, 4) as apex, round(brake, 4) as brake, round(coast, 4) as coast, round(line, 4) as line, round(p0, 4) + 0.0::double as entry_s, round(p1, 4) + 0.0::double as apex_s, round(p2, 4) + 0.0::double as exit_s from why",
    "gap_fills": f"with {FILLS} select f.rec, f.lap_id, cast(f.i as integer) as i, missing, round(dt, 3) as dt, round(chord, 3) as chord_m, round(fill_m, 3) as fill_m, round(error, 3) as error_m, source, donor from fill_len f join gp using (rec, lap_id, i)",
    "gap_fill_points": f"with {FILLS} select rec, lap_id, cast(i as integer) as i, cast(j as integer) as j, round(t, 3) as t, round(x, 3) + 0.0::double as x, round(y, 3) + 0.0::double as y, source from fills where j > 0 and j < n",
    "gap_fills_from_reference": f"with {ALONE} select rec, source, count(*) as gaps, round(sum(fill_m), 2) as fill_m, round(max(error), 3) as worst_m from fill_len group by all",
    "drawn_laps": f"with {FILLS} select rec, lap_id, 'measured' as source, count(*) as points from pt group by rec, lap_id union all select rec, lap_id, source, count(*) from fills where j > 0 and j < n group by rec, lap_id, source",
    "gg_hull": f"""with recursive {LATERAL}, q as (select distinct rec, cast(round(lat_g * 10000) as bigint) as x, cast(round(long_g * 10000) as bigint) as y from lat),
      st as (select rec, min(struct_pack(x := x, y := y)) as p from q group by rec),
      wrap(rec, i, x, y, dx, dy) as (select rec, 0, p.x, p.y, 0.0::double, -1.0::double from st union all
        select rec, i + 1, b.x, b.y, b.x - x, b.y - y from (
          select w.rec, w.i, w.x, w.y, min(struct_pack(a := round(case when a < -1e-12 then a + 2 * pi() else abs(a) end, 12), d := -((q.x - w.x) ** 2 + (q.y - w.y) ** 2), x := q.x, y := q.y)) as b
          from (select * from wrap) w join q on q.rec = w.rec and (q.x <> w.x or q.y <> w.y), lateral (select atan2(w.dx * (q.y - w.y) - w.dy * (q.x - w.x), w.dx * (q.x - w.x) + w.dy * (q.y - w.y)) as a) group by w.rec, w.i, w.x, w.y) z
          join st using (rec) where not (b.x = st.p.x and b.y = st.p.y))
      select rec, i, x / 10000.0::double as x, y / 10000.0::double as y from wrap""",
    "camera_payloads": f"""with {TRACE}, f as (select rec, seq // 600 + 1 as chapter, seq, v, fix, row_number() over (partition by rec, seq // 600 order by seq) - 1 as i, count(*) over (partition by rec, seq // 600) as m from trace)
      select rec, cast(chapter as integer) as chapter, count(*) as fixes, round(sum(round(v * 1000) / 1000), 2) as v_sum, round(any_value(60 * (chapter - 1) + (m - 1) // 10 + ((m - 1) % 10) / ((m - 1) % 10 + 1)::double), 3) as last_s, min(946684800000 + 8766 * 86400000::bigint + seq * 100)::bigint as first_ms, count(*) filter (fix < 3) as weak from f group by rec, chapter""",
    "camera_fixes": f"""with {TRACE}, f as (select rec, seq // 600 + 1 as chapter, seq, v, fix, row_number() over (partition by rec, seq // 600 order by seq) - 1 as i, count(*) over (partition by rec, seq // 600) as m from trace)
      select rec, cast(chapter as integer) as chapter, count(*) as fixes, round(sum(round(v * 1000) / 1000), 2) as v_sum, round(any_value(60 * (chapter - 1) + (m - 1) // 10 + ((m - 1) % 10) / ((m - 1) % 10 + 1)::double), 3) as last_s, min(946684800000 + 8766 * 86400000::bigint + seq * 100)::bigint as first_ms, count(*) filter (fix < 3) as weak from f group by rec, chapter
      qualify row_number() over (order by rec // 10000, printf('GX%02d%04d', chapter, rec % 10000)) <= 64""",
    "camera_seek": f"""with {LAPS}, pay as (select rec, seq // 10 as n, seq // 10 as a, seq // 10 + 1 as b from trace where seq < 600 group by all), z as (select rec, max(n) as n from pay group by rec)
      select l.rec, l.lap_id, cast(coalesce(p.n, z.n) as integer) as n, coalesce(p.a, z.n)::double as t_in, p.n is null as at_end from laps l join z using (rec) left join pay p on p.rec = l.rec and l.t_start >= p.a and l.t_start < p.b""",
    "recut_laps": f"""with {TRACE}, s as (select *, lag(x) over w as x0, lag(y) over w as y0, lag(t) over w as t0 from trace window w as (partition by rec order by seq)),
      c as (select *, 50.005::double + case when rec % 4 = 0 then 500 when rec % 2 = 0 then 10 else 0 end as lx from s)
      select rec, cast(row_number() over (partition by rec order by seq) - 1 as bigint) as lap_id, round(t0 + (t - t0) * ((lx - x0) / (x - x0)), 3) as t_cross from c where (x0 - lx) * (x - lx) < 0 and abs(y0 + (y - y0) * ((lx - x0) / (x - x0))) < 15""",
    "undone_lines": f"""with {TRACE}, r as (select distinct rec from trace)
      select rec, case when rec % 4 = 0 then 2 when rec % 2 = 0 then 1 else 0 end::bigint as version0, round(50.005::double + case when rec % 4 = 0 then 500 when rec % 2 = 0 then 10 else 0 end, 3) as x0,
        case when rec % 4 = 0 then 1 else 0 end::bigint as version1, round(50.005::double + case when rec % 4 = 0 then 10 else 0 end, 3) as x1, 0::bigint as version2, 50.005::double as x2 from r""",
    "global_frame": f"with {PLACES} select place, round(lat, 7) as lat, round(lon, 7) as lon, round(diag, 3) as alt from places",
    "gps_forces": f"with {TRACE}{FORCES} select rec, seq, round(lat_g, 5) + 0.0::double as lat_g, round(long_g, 5) + 0.0::double as long_g from forces",
    "gg_cloud": f"with {LAPS}{LATERAL[len(TRACE):]}, inw as (select lat.*, count(*) over (partition by lat.rec) as n from lat join valid v on v.rec = lat.rec and lat.t >= v.t_start and lat.t < v.t_finish) select rec, round(t, 3) as t, round(lat_g, 4) + 0.0::double as lat_g, round(long_g, 4) + 0.0::double as long_g from (select *, row_number() over (partition by rec order by t) - 1 as i from inw) where i % ceil(n / 4000.0)::bigint = 0",
    "corner_grip": f"with {STATS}{LATERAL[len(TRACE):]}" + at("fat", "vs", "lap_id, dist", "lat", ("lat_g", "long_g"), "rec", "t") + ", m as (select w.rec, w.lap_id, w.cid, median(sqrt(f.lat_g ** 2 + f.long_g ** 2)) as g from win w join fat f on f.rec = w.rec and f.lap_id = w.lap_id and f.dist between enter and exit group by all) select w.rec, w.lap_id, w.cid, round(coalesce(least(g / envelope_g, 1.1::double), 0.0), 4) as grip from win w left join m using (rec, lap_id, cid) join env using (rec)",
    "delta_curves": f"with {GRID}" + at("cv", "asked", "i") + ", b as (select cv.rec, i, dist as x_m, elapsed as e from cv join best using (rec, lap_id)) select cv.rec, cv.lap_id, cast(cv.i as integer) as i, round(x_m, 4) as x_m, round(elapsed, 4) as x_s, round(v * 3.6, 4) as speed_kmh, round(elapsed - e, 4) + 0.0::double as delta_s from cv join b on b.rec = cv.rec and b.i = cv.i",
    "last_deltas": f"with {LAPS}, e as (select rec, lap_id, max(elapsed) as e from vs group by all) select e.rec, e.lap_id, round(e.e - b.e, 4) + 0.0::double as delta_s from e join best using (rec) join e b on b.rec = e.rec and b.lap_id = best.lap_id",
    "delta_at_time": f"with {LAPS}, onl as (select t.rec, t.seq, t.t, v.lap_id from trace t left join valid v on v.rec = t.rec and t.t >= v.t_start and t.t < v.t_finish), oq as (select rec, lap_id, t, seq from onl where lap_id is not null)" + at("da", "oq", "seq", y=("dist",), x="t") + """, dk as (select da.rec, da.dist / z.total * bz.total as bd, da.seq, da.lap_id, da.t, da.dist as own, da.t - f.t0 as el from da join totals_ z using (rec, lap_id) join (select rec, lap_id, min(t) as t0 from vs group by all) f using (rec, lap_id) join best using (rec) join totals_ bz on bz.rec = da.rec and bz.lap_id = best.lap_id),
      bv as (select vs.rec, dist as bd, elapsed from vs join best using (rec, lap_id))""" + at("db", "dk", "seq, lap_id, own, el", "bv", ("elapsed",), "rec", "bd") + " select rec, seq, lap_id, round(own, 5) as dist, round(el, 3) as elapsed, round(el - elapsed, 4) + 0.0::double as delta_s from db union all select rec, seq, null, null, null, null from onl where lap_id is null",
    "ideal_delta_to_best": f"with {IDEAL} select d.rec, cast(d.i as integer) as i, round(d.i / 399.0::double * total, 3) as x_m, round(ideal_s - g.elapsed, 4) + 0.0::double as delta_s from ideal d join best using (rec) join grid g on g.rec = d.rec and g.lap_id = best.lap_id and g.i = d.i join totals_ z on z.rec = d.rec and z.lap_id = best.lap_id",
    "corner_markers": f"with {STATS}, mk as (select rec, lap_id, enter as dist, cid, 0 as e from cstats union all select rec, lap_id, apex, cid, 1 from cstats)" + at("mat", "mk", "cid, e", y=("t", "x", "y")) + " select rec, lap_id, cid, round(max(t) filter (e = 0), 3) as t_enter, round(max(x) filter (e = 1), 3) + 0.0::double as x, round(max(y) filter (e = 1), 3) + 0.0::double as y from mat group by rec, lap_id, cid",
    "lap_stats": f"""with {BRAKES}{FORCES}, sv as (select rec, lap_id, max(v) * 3.6 as hi, min(v) * 3.6 as lo, max(dist) as d from vs group by all), sg as (select v.rec, v.lap_id, max(abs(lat_g)) as lat, greatest(max(-long_g), 0) as br from valid v join forces f on f.rec = v.rec and f.t >= v.t_start and f.t < v.t_finish group by all),
      sb as (select rec, lap_id, sum(seconds) as bs, count(*) as bn from brakes group by all), sc as (select rec, lap_id, sum(seconds) as cs from coasts group by all)
      select v.rec, v.lap_id, lap_s, round(hi, 4) as vmax_kmh, round(lo, 4) as vmin_kmh, round(d * 3.6 / lap_s, 4) as mean_kmh, round(lat, 4) as lateral_g, round(br, 4) + 0.0::double as braking_g, round(coalesce(bs, 0), 4) as brake_s, round(coalesce(cs, 0), 4) as coast_s, round(coalesce(cs, 0) / lap_s, 4) as coast_share, coalesce(bn, 0) as brake_n
      from valid v join sv using (rec, lap_id) left join sg using (rec, lap_id) left join sb using (rec, lap_id) left join sc using (rec, lap_id)""",
    "session_tops": f"with {BRAKES}, m as (select rec, lap_id, max(v) * 3.6 as v from vs group by all) select m.rec, round(max(v), 4) as vmax_kmh, min(lap_id) filter (v = (select max(v) from m b where b.rec = m.rec)) as vmax_lap, round(coalesce((select max(seconds) from coasts c where c.rec = m.rec), 0), 4) as longest_coast_s from m group by m.rec",
    "session_headlines": f"with {TRACE}{STEPS.format(t='trace')}, c as (select user_id // 25 as rec, min(epoch_ms(ts)) as a, max(epoch_ms(ts)) as b from events group by 1) select s.rec, round(max(t) - min(t), 3) as duration_s, round(coalesce(sum(dt) filter (dt > 0 and dt <= 1 and v0 >= 4), 0), 3) as moving_s, round(sum(sqrt((x - x0) ** 2 + (y - y0) ** 2)), 3) as distance_m, any_value(printf('%02d:%02d', a // 3600000 % 24, a // 60000 % 60)) as start_clock, any_value(printf('%02d:%02d', b // 3600000 % 24, b // 60000 % 60)) as end_clock from steps s join c on c.rec = s.rec group by s.rec",
    "lap_channels_forces": f"with {LAPS}{FORCES}" + at("ch", "vs", "lap_id, dist, v", "forces", ("long_g", "lat_g"), "rec", "t") + " select rec, lap_id, round(t, 3) as time_s, round(long_g, 4) + 0.0::double as g_long, round(lat_g, 4) + 0.0::double as g_lat from ch",
    "library_entries": "with " + SPLITS.replace(LAPS, laps("clean", CLEAN)) + """, th as (select rec, round(case when count(*) = count(b) then sum(b) end, 4) as theoretical from (select rec, sector, min(split_s) filter (split_s > 0) as b from splits group by all) group by rec),
      q as (select rec, rec = 1 or round(count(*) filter (v > 3 and (fix < 3 or dop > 10)) / count(*) filter (v > 3)::double, 6) >= 0.08 as degraded from trace group by rec)
      select q.rec, printf('GX%04d', q.rec) as fingerprint, printf('GX01%04d', q.rec) as stem, 'Track ' || (q.rec % 3) as track, '2024-01-01' as date, (select count(*) from valid v where v.rec = q.rec) as lap_count, best.lap_s as best, theoretical, q.rec % 2 = 0 as verified, degraded, coalesce((select max_dt > 0.35 from valid v where v.rec = q.rec and v.lap_id = best.lap_id), false) as dropout
      from q left join best using (rec) left join th using (rec)""",
    "library_search": f"with {HISTORY} select fingerprint, date, case when fingerprint % 7 > 0 then best end as best, cast(row_number() over (order by case when fingerprint % 7 > 0 then best end desc nulls last, fingerprint) as integer) as place from hist where track = '1-URGENT' and lower(track || ' ' || date) like '%1995-01%'",
    "laps_table": f"with {STATS}{SPLITS[len(LAPS):]}, en as (select rec, lap_id, arg_min(v, dist) * 3.6 as e from vs group by all), sp as (select rec, lap_id, count(*) as n, max(split_s) filter (sector = 0) as s1 from splits group by all) select v.rec, v.lap_id, v.lap_id + 1 as lap, lap_s, dist_m, round(e, 3) as entry_kmh, case when max_dt > 0.35 then 'dropout' else '' end as flag, cast(sp.n as integer) as sectors, round(s1, 3) as s1, round(c.time_s, 3) as c1_s, round(c.v_apex * 3.6, 3) as c1_kmh from valid v join en using (rec, lap_id) left join sp using (rec, lap_id) left join cstats c on c.rec = v.rec and c.lap_id = v.lap_id and c.cid = 1",
    "share_card": f"with {IDEAL}, b as (select c.rec, min(c.lap_s) as best_s from cand c where not dropout group by c.rec) select b.rec, best_s, round(best_s - round(ideal_s, 4), 4) + 0.0::double as to_ideal_s, case when b.rec % 2 = 0 then 'verified' else 'provisional' end as stamp from b left join ideal d on d.rec = b.rec and d.i = 399",
    "suggested_sector": f"with {LAPS}, o as (select vs.rec, vs.x, vs.y, row_number() over w - 1 as i, count(*) over (partition by vs.rec) as n, lead(x, 5) over w - lag(x, 5) over w as hx, lead(y, 5) over w - lag(y, 5) over w as hy from vs join best using (rec, lap_id) window w as (partition by vs.rec order by t)), m as (select *, sqrt(hx * hx + hy * hy) as k from o where i = floor((n - 1) * 0.75)) select rec, round(x + hy / k * 15, 4) as x1, round(y - hx / k * 15, 4) as y1, round(x - hy / k * 15, 4) as x2, round(y + hx / k * 15, 4) as y2 from m",
    "transponder_offset": f"with {LAPS}, r as (select rec, lap_id + 7 as lap_no, floor(lap_s * 50) / 50 as ref_s from valid where floor(lap_s * 50) / 50 <= 72), s as (select v.rec, s.shift, corr(lap_s, ref_s) as r, count(*) as k from valid v, range(0, 41) s(shift), r where lap_s <= 72 and r.rec = v.rec and r.lap_no = v.lap_id + s.shift group by all), n as (select rec, count(*) as n from valid group by rec) select rec, cast(shift as integer) as shift, round(r, 6) as r from (select s.*, row_number() over (partition by s.rec order by r desc, shift) as q from s join n using (rec) where k >= greatest(5, 0.7 * n) and not isnan(r)) where q = 1",
    "resampled_lines": f"with {LAPS}, rb as (select vs.rec, vs.t, vs.x, vs.y, coalesce(sqrt((x - lag(x) over w) ** 2 + (y - lag(y) over w) ** 2), 0) as d from vs join best using (rec, lap_id) window w as (partition by vs.rec order by t)), rl as (select rec, x, y, sum(d) over (partition by rec order by t) as s from rb), rq as (select rec, m * i / 399 as s, i from (select rec, max(s) as m from rl group by rec), range(0, 400) u(i))" + at("rs", "rq", "i", "rl", ("x", "y"), "rec", "s") + " select rec, cast(i as integer) as i, round(s, 3) as s, round(x, 3) + 0.0::double as x, round(y, 3) + 0.0::double as y from rs",
    "peak_start_line": f"""with {TRACE}, o as (select *, coalesce(lag(x, 5) over w, x) as xa, coalesce(lag(y, 5) over w, y) as ya, coalesce(lead(x, 5) over w, x) as xb, coalesce(lead(y, 5) over w, y) as yb, row_number() over (partition by rec order by v desc, seq) as q from trace window w as (partition by rec order by seq)),
      m as (select *, xb - xa as hx, yb - ya as hy, sqrt((xb - xa) ** 2 + (yb - ya) ** 2) as k from o where q = 1)
      select rec, round(x + hy / k * 15, 4) as x1, round(y - hx / k * 15, 4) as y1, round(x - hy / k * 15, 4) as x2, round(y + hx / k * 15, 4) as y2 from m""",
    "clock_used": f"with {CLEAN}, f as (select rec, seq, case when seq % 97 = 0 then 0 else seq * 100 + 1 end as ts from clean), j as (select *, coalesce(ts > 0 and lag(ts) over w > 0 and (ts - lag(ts) over w) / 1000.0::double between 0.02 and 0.4, false) as j from f window w as (partition by rec order by seq)), k as (select *, j or coalesce(lead(j) over (partition by rec order by seq), false) as o from j) select rec, count(*) as fixes, count(*) filter (o) as on_clock, count(*) filter (o) > 0 as used, min(ts) filter (ts > 0) as first_ms, max(ts) filter (ts > 0) as last_ms from k group by rec",
    "restored_lines": f"with {TRACE} select distinct rec, round(50.005::double + case when rec % 2 = 0 then 10 else 0 end, 3) as x1, rec % 2 = 1 as reverted from trace",
    "gap_reconstruct": f"""with {CLEAN}, s as (select *, t - lag(t) over w as dt, lag(t) over w as t0, lag(x) over w as xa, lag(y) over w as ya, lag(x, 2) over w as xp, lag(y, 2) over w as yp, lead(x) over w as xn, lead(y) over w as yn from clean window w as (partition by rec order by seq)),
      u as (select rec, median(dt) as u from s where dt > 0 and dt < 1 group by rec),
      g as (select s.*, greatest(cast(round_even(dt / u, 0) as integer) - 1, 1) as m, coalesce(xp, xa) as px, coalesce(yp, ya) as py, coalesce(xn, x) as nx, coalesce(yn, y) as ny from s join u using (rec) where dt > 0.35),
      j as (select *, j / (m + 1)::double as f from (select *, unnest(range(1, m + 1)) as j from g))
      select rec, seq, cast(j as integer) as j, round(t0 + dt * f, 3) as t, round(0.5 * (2 * xa + (x - px) * f + (2 * px - 5 * xa + 4 * x - nx) * f ** 2 + (3 * xa - px - 3 * x + nx) * f ** 3), 6) + 0.0::double as x,
        round(0.5 * (2 * ya + (y - py) * f + (2 * py - 5 * ya + 4 * y - ny) * f ** 2 + (3 * ya - py - 3 * y + ny) * f ** 3), 6) + 0.0::double as y, case when m <= 3 then 'curve' else 'long curve' end as fill from j""",
    "corner_deltas_reference": f"with {STATS} select c.rec, c.lap_id, c.cid, round(c.time_s - b.time_s, 4) + 0.0::double as delta_s, round(c.v_apex - b.v_apex, 4) + 0.0::double as apex_delta from cstats c left join (select s.* from cstats s join best using (rec, lap_id) where s.rec = 0) b on b.cid = c.cid where c.rec <> 0",
    "segment_speeds": f"with {CLEAN}{STEPS.format(t='clean')} select rec, seq, round(case when dt <= 0.35 then (v + v0) / 2 end, 4) as segment from steps",
    "speeds_at": f"with {GRID}" + at("cv", "asked", "i") + ", b as (select cv.rec, i, dist as x_m from cv join best using (rec, lap_id)), sc as (select cv.rec, cv.lap_id, b.x_m, cv.v * 3.6 as speed_kmh from cv join b on b.rec = cv.rec and b.i = cv.i), sl as (select rec, max(x_m) as length from b group by rec), sk as (select v.rec, v.lap_id, length * k / 10 as x_m, k from valid v join sl using (rec), range(0, 11) u(k))" + at("sx", "sk", "k", "sc", ("speed_kmh",), "rec, lap_id", "x_m") + " select rec, lap_id, cast(k as integer) as k, round(speed_kmh, 3) as speed_kmh from sx",
    "trace_jitter": f"""with {TRACE}, a as (select rec, seq, x, y, x - avg(x) over w as rx, y - avg(y) over w as ry from trace window w as (partition by rec order by seq rows between 20 preceding and 20 following)),
      b as (select *, rx - avg(rx) over n as qx, ry - avg(ry) over n as qy, atan2(y - lag(y) over w, x - lag(x) over w) as h from a window n as (partition by rec order by seq rows between 4 preceding and 4 following), w as (partition by rec order by seq)),
      c as (select *, h - lag(h) over (partition by rec order by seq) as d from b), e as (select *, degrees(atan2(sin(d), cos(d))) as t from c), f as (select *, t - lag(t) over (partition by rec order by seq) as q from e)
      select rec, round(sqrt(var_pop(qx) + var_pop(qy)), 4) as across_m, round(stddev_pop(q), 3) as heading_deg from f group by rec""",
    "loop_fit": f"with {LOOPS} select rec, cast(shift as integer) as shift, way, hand = -1 as mirror, round(scale, 4) as scale, round(rms, 3) as rms from lfit",
    "fitted_start_line": f"""with {TRACE}, o as (select *, lag(x) over w as x0, lag(y) over w as y0, lag(t) over w as t0, lag(odo) over w as odo0, coalesce(lag(x, 5) over w, x) as xa, coalesce(lag(y, 5) over w, y) as ya, coalesce(lead(x, 5) over w, x) as xb, coalesce(lead(y, 5) over w, y) as yb, row_number() over (partition by rec order by v desc, seq) as q, count(*) over (partition by rec) as n from trace window w as (partition by rec order by seq)),
      m as (select *, xb - xa as hx, yb - ya as hy, sqrt((xb - xa) ** 2 + (yb - ya) ** 2) as k from o where q = 1 and n >= 11),
      l as (select rec, try, f, x + hy / k * 15 * f as x1, y - hx / k * 15 * f as y1, x - hy / k * 15 * f as x2, y + hx / k * 15 * f as y2 from m, (values (0, 1.0::double), (1, 1.15::double), (2, 1.3::double), (3, 1.5::double)) w(try, f)),
      s as (select o.rec, try, seq, o.t, o.t0, o.odo, o.odo0, (l.x2 - l.x1) * (o.y0 - l.y1) - (l.y2 - l.y1) * (o.x0 - l.x1) as a, (l.x2 - l.x1) * (o.y - l.y1) - (l.y2 - l.y1) * (o.x - l.x1) as b,
        (o.x - o.x0) * (l.y1 - o.y0) - (o.y - o.y0) * (l.x1 - o.x0) as c, (o.x - o.x0) * (l.y2 - o.y0) - (o.y - o.y0) * (l.x2 - o.x0) as d from o join l using (rec)),
      h as (select *, round(t0 + (t - t0) * (abs(a) / (abs(a) + abs(b))), 3) as tc from s where a * b < 0 and c * d < 0),
      g as (select *, odo0 + (odo - odo0) * ((tc - t0) / (t - t0)) as oc from h),
      p as (select rec, try, lead(seq) over w - seq + 2 as samples, round(lead(tc) over w - tc, 3) as lap_s, round(lead(oc) over w - oc, 3) as dist_m from g window w as (partition by rec, try order by seq)),
      e as (select *, median(lap_s) over (partition by rec, try) as ml from p where lap_s is not null and samples >= 20 and lap_s >= 5),
      b2 as (select *, median(dist_m) over (partition by rec, try) as md from e where lap_s between 0.5::double * ml and 1.6::double * ml),
      n as (select rec, try, count(*) as laps from b2 where dist_m between 0.9::double * md and 1.1::double * md group by all),
      r as (select l.*, coalesce(laps, 0) as laps, max(coalesce(laps, 0)) filter (l.try = 0) over (partition by l.rec) as base from l left join n using (rec, try))
      select rec, f as factor, laps, round(x1, 4) as x1, round(y1, 4) as y1, round(x2, 4) as x2, round(y2, 4) as y2 from (select *, row_number() over (partition by rec order by case when try > 0 then 0 else 1 end, try) as z from r where try = 0 or laps > base) where z = 1""",
    "report_page": f"with {LAPS} select rec, cast(length('<!doctype html><title>Laps</title><table><tr><th>lap_id</th><th>lap_s</th></tr>') + 1 + sum(length('<tr><td>' || lap_id || '</td><td>' || lap_s || '</td></tr>')) + count(*) - 1 + length('</table>') as integer) as letters from valid group by rec",
    "opportunities": f"with {REASONS} select rec, cast(rank as integer) as rank, cid, round(loss, 5) as loss_s, reason from why where round(loss, 2) > 0",
}

ORACLE["lines_latlon"] = ORACLE["median_start_line"].replace(", 4)", ", 2)")
