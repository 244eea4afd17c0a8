"""Checked queries for windows, series formulas, evaluation, runs, sources and models.

Array outputs are compared as exploded rows (window/sample id, position, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.operators import evaluate, runs, scale, series, timefeat, windows
from tidepool.plans.order import with_row_index
from tidepool.plans.suite import HOURLY_SQL, hourly_events, query, rounded, table
from tidepool.sources import io

L, P, LABEL = 12, 3, 4


def _long(df: DataFrame, key: str, parts: dict[str, Column], two_d: set[str] = frozenset()) -> DataFrame:
    """(key, part, step, feat, val) rows of 1-D (feat 0) or 2-D (time × feature) array columns."""
    out = None
    for name, c in parts.items():
        if name in two_d:
            a = df.select(key, F.posexplode_outer(c).alias("step", "_r")).select(
                key, "step", F.posexplode_outer("_r").alias("feat", "val"))
        else:
            a = df.select(key, F.posexplode_outer(c).alias("step", "val")).withColumn("feat", F.lit(0))
        a = a.select(key, F.lit(name).alias("part"), "step", "feat", F.round(F.col("val").cast("double"), 6).alias("val"))
        out = a if out is None else out.unionByName(a)
    return out


def _indexed_hourly(spark, sf):
    return with_row_index(hourly_events(spark, sf), ["hour"])


_E_HOURLY = f"""
h as {HOURLY_SQL},
e as (select hour, value, cast(n as double) as n, row_number() over (order by hour) - 1 as i,
             count(*) over () as cnt from h)"""


# ------------------------------------------------------------------------------------ windows

@query("sliding_windows", f"""
with {_E_HOURLY},
s as (select i as w from e where i <= cnt - {L + P})
select s.w as window_id, 'x' as part, e.i - s.w as step, 0 as feat, round(e.value, 6) as val
  from s join e on e.i between s.w and s.w + {L - 1}
union all select s.w, 'x', e.i - s.w, 1, round(e.n, 6) from s join e on e.i between s.w and s.w + {L - 1}
union all select s.w, 'y', e.i - s.w - {L}, 0, round(e.value, 6) from s join e on e.i between s.w + {L} and s.w + {L + P - 1}
""")
def q_sliding_windows(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    w = windows.sliding_windows_indexed(idx, L, P, ["value", "n"], "value", n=n)
    return _long(w, "window_id", {"x": F.col("x"), "y": F.col("y")}, {"x"})


@query("sliding_windows_raw", f"""
with e as (select row_number() over (order by user_id, ts, event_id) - 1 as i,
                  row_number() over (partition by user_id order by ts desc, event_id desc) as back,
                  sum(value) over (partition by user_id order by ts, event_id rows between current row and {L - 1} following) as sx,
                  sum(value) over (partition by user_id order by ts, event_id rows between {L} following and {L + P - 1} following) as sy from events)
select i as window_id, round(sx, 6) as x_sum, round(sy, 6) as y_sum from e where back >= {L + P}""")
def q_sliding_windows_raw(spark, sf):
    """Windows of every user's raw events, each summed up."""
    ev = table(spark, sf, "events")
    w = windows.sliding_windows(ev, L, P, ["ts", "event_id"], ["value"], "value", ["user_id"])
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(w.select("window_id", add(F.flatten("x")).alias("x_sum"), add(F.col("y")).alias("y_sum")))


_MARKS = ["month", "day", "weekday", "hour_of_day"]
_MARK_SQL = ("month(hour) / 12.0 as m0, day(hour) / 31.0 as m1, (isodow(hour) - 1) / 7.0 as m2, "
             "hour(hour) / 23.0 as m3")


@query("seq2seq_windows", f"""
with h as {HOURLY_SQL},
e as (select hour, value, cast(n as double) as n, {_MARK_SQL}, row_number() over (order by hour) - 1 as i,
             count(*) over () as cnt from h),
s as (select i as w from e where i <= cnt - {L + P}),
xm as (select s.w, e.i - s.w as step, e.* from s join e on e.i between s.w and s.w + {L - 1}),
dk as (select s.w, e.i - (s.w + {L - LABEL}) as step, e.* from s join e on e.i between s.w + {L - LABEL} and s.w + {L - 1}),
ym as (select s.w, e.i - (s.w + {L - LABEL}) as step, e.* from s join e on e.i between s.w + {L - LABEL} and s.w + {L + P - 1}),
yy as (select s.w, e.i - s.w - {L} as step, e.value from s join e on e.i between s.w + {L} and s.w + {L + P - 1})
select w as window_id, 'x' as part, step, 0 as feat, round(value, 6) as val from xm
union all select w, 'x', step, 1, round(n, 6) from xm
union all select w, 'x_mark', step, 0, round(m0, 6) from xm union all select w, 'x_mark', step, 1, round(m1, 6) from xm
union all select w, 'x_mark', step, 2, round(m2, 6) from xm union all select w, 'x_mark', step, 3, round(m3, 6) from xm
union all select w, 'dec_inp', step, 0, round(value, 6) from dk union all select w, 'dec_inp', step, 1, round(n, 6) from dk
union all select s.w, 'dec_inp', {LABEL} + p.k, f.k, 0.0 from s, range(0, {P}) p(k), range(0, 2) f(k)
union all select w, 'y_mark', step, 0, round(m0, 6) from ym union all select w, 'y_mark', step, 1, round(m1, 6) from ym
union all select w, 'y_mark', step, 2, round(m2, 6) from ym union all select w, 'y_mark', step, 3, round(m3, 6) from ym
union all select w, 'y', step, 0, round(value, 6) from yy""")
def q_seq2seq_windows(spark, sf):
    h = hourly_events(spark, sf)
    h = h.select("hour", "value", "n", (F.month("hour") / 12.0).alias("month"), (F.dayofmonth("hour") / 31.0).alias("day"),
                 (F.weekday("hour") / 7.0).alias("weekday"), (F.hour("hour") / 23.0).alias("hour_of_day"))
    idx, n = with_row_index(h, ["hour"])
    w = windows.seq2seq_windows_indexed(idx, L, P, LABEL, ["value", "n"], _MARKS, "value", n=n)
    return _long(w, "window_id", {c: F.col(c) for c in ["x", "x_mark", "dec_inp", "y_mark", "y"]},
                 {"x", "x_mark", "dec_inp", "y_mark"})


@query("overlap_windows", f"""
with {_E_HOURLY},
m as (select *, {_MARK_SQL} from e),
s as (select i as w from e where i <= cnt - {L + P}),
xx as (select s.w, m.i - s.w as step, m.* from s join m on m.i between s.w and s.w + {L - 1}),
yy as (select s.w, m.i - (s.w + {L - LABEL}) as step, m.* from s join m on m.i between s.w + {L - LABEL} and s.w + {L + P - 1})
select w as window_id, 'seq_x' as part, step, 0 as feat, round(value, 6) as val from xx
union all select w, 'seq_x', step, 1, round(n, 6) from xx
union all select w, 'seq_y', step, 0, round(value, 6) from yy
union all select w, 'seq_y', step, 1, round(n, 6) from yy
union all select w, 'seq_x_mark', step, f.k, round([m0, m1, m2, m3][f.k + 1], 6) from xx, range(0, 4) f(k)
union all select w, 'seq_y_mark', step, f.k, round([m0, m1, m2, m3][f.k + 1], 6) from yy, range(0, 4) f(k)""")
def q_overlap_windows(spark, sf):
    h = hourly_events(spark, sf)
    h = h.select("hour", "value", "n", (F.month("hour") / 12.0).alias("month"), (F.dayofmonth("hour") / 31.0).alias("day"),
                 (F.weekday("hour") / 7.0).alias("weekday"), (F.hour("hour") / 23.0).alias("hour_of_day"))
    idx, _ = with_row_index(h, ["hour"])
    w = windows.overlap_windows_indexed(idx, L, LABEL, P, ["value", "n"], _MARKS)
    parts = ["seq_x", "seq_y", "seq_x_mark", "seq_y_mark"]
    return _long(w, "window_id", {c: F.col(c) for c in parts}, set(parts))


_EV_IDX = "(select event_id, value, user_id, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as cnt from events)"


@query("strided_windows", f"""
with e as {_EV_IDX},
s as (select i as w from e where i % 10 = 0 and i <= cnt - 50)
select s.w // 10 as window_id, 'x' as part, e.i - s.w as step, 0 as feat, round(e.value, 6) as val
  from s join e on e.i between s.w and s.w + 49
union all
select s.w // 10, 'labels', e.i - s.w, 0, round(cast(e.user_id % 2 as double), 6) from s join e on e.i between s.w and s.w + 49""")
def q_strided_windows(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value", "user_id")
    idx, _ = with_row_index(ev, ["ts", "event_id"])
    w = windows.strided_windows_indexed(idx, 50, 10, ["value"], F.col("user_id") % 2)
    return _long(w, "window_id", {"x": F.col("x"), "labels": F.col("labels")}, {"x"})


@query("tiling_windows", f"""
with e as {_EV_IDX}
select i // 100 as window_id, 'x' as part, i % 100 as step, 0 as feat, round(value, 6) as val
from e where i // 100 < cnt // 100""")
def q_tiling_windows(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts", "value", "user_id")
    idx, _ = with_row_index(ev, ["ts", "event_id"])
    w = windows.tiling_windows_indexed(idx, 100, ["value"])
    return _long(w, "window_id", {"x": F.col("x")}, {"x"})


@query("pad_series", """
with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
                  count(*) over (partition by user_id) as len from events),
u as (select distinct user_id, least(len, 80) as length from e)
select u.user_id, u.length, p.k as pos, coalesce(round(e.value, 6), 0.0) as val, p.k < u.length as mask
from u cross join range(0, 80) p(k) left join e on e.user_id = u.user_id and e.pos = p.k""")
def q_pad_series(spark, sf):
    ev = table(spark, sf, "events")
    w = windows.pad_series(ev, ["user_id"], ["ts", "event_id"], ["value"], max_len=80)
    z = w.select("user_id", "length", F.posexplode_outer(F.arrays_zip(F.col("x").alias("r"), F.col("mask").alias("m")))
                 .alias("pos", "z"))
    return z.select("user_id", "length", "pos", F.round(F.element_at("z.r", 1), 6).alias("val"), F.col("z.m").alias("mask"))


@query("pad_series_long", """
with e as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
                  count(*) over (partition by user_id) as len from events),
u as (select distinct user_id, len from e), m as (select max(len) as top from e)
select u.user_id, u.len as length, p.k as pos, coalesce(round(e.value, 6), 0.0) as value, p.k < u.len as mask
from u, m, lateral (select unnest(range(0, m.top)) as k) p left join e on e.user_id = u.user_id and e.pos = p.k""")
def q_pad_series_long(spark, sf):
    return rounded(windows.pad_series_long(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["value"]))


@query("last_window", """
with e as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) - 1 as back,
                  count(*) over (partition by user_id) as len from events),
u as (select distinct user_id, len from e)
select u.user_id, p.k as pos, coalesce(round(e.value, 6), 0.0) as val, case when e.value is null then 0.0::double else 1.0::double end as mask
from u cross join range(0, 30) p(k) left join e on e.user_id = u.user_id and e.back = 29 - p.k""")
def q_last_window(spark, sf):
    ev = table(spark, sf, "events")
    w = windows.last_window(ev, ["user_id"], ["ts", "event_id"], "value", 30)
    z = w.select("user_id", F.posexplode_outer(F.arrays_zip(F.col("insample").alias("v"), F.col("mask").alias("m")))
                 .alias("pos", "z"))
    return z.select("user_id", "pos", F.round("z.v", 6).alias("val"), F.col("z.m").alias("mask"))


_EMB = "(select vec_id, label, t - 1 as t, cast(v as double) as v from embeddings, unnest(embedding) with ordinality as u(v, t))"


@query("patch", f"""
with e as {_EMB}
select p.vec_id, k.k as patch, j.j as pos, round(p.v, 6) as val
from range(0, 8) k(k), range(0, 16) j(j), e p
where p.t = least(k.k * 8 + j.j, 63)""")
def q_patch(spark, sf):
    emb = table(spark, sf, "embeddings")
    pad = windows.segment_padding(64, 16) + 8
    p = emb.select("vec_id", windows.patch(F.transform("embedding", lambda v: v.cast("double")), 16, 8, pad).alias("p"))
    z = p.select("vec_id", F.posexplode_outer("p").alias("patch", "_r")).select(
        "vec_id", "patch", F.posexplode_outer("_r").alias("pos", "val"))
    return z.select("vec_id", "patch", "pos", F.round("val", 6).alias("val"))


@query("multiscale_tails", f"""
with e as {_EMB}
select vec_id, 1 as scale, t - 56 as pos, round(v, 6) as val from e where t >= 56
union all select vec_id, 2, t - 48, round(v, 6) from e where t >= 48""")
def q_multiscale_tails(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    m = emb.select("vec_id", windows.multiscale_tails("x", [1, 2], 8).alias("m"))
    z = m.select("vec_id", F.posexplode_outer("m").alias("s", "_r")).select(
        "vec_id", (F.col("s") + 1).alias("scale"), F.posexplode_outer("_r").alias("pos", "val"))
    return z.select("vec_id", "scale", "pos", F.round("val", 6).alias("val"))


# ------------------------------------------------------------------------------------ series formulas

def _emb(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda v: v.cast("double")).alias("x"))


def _explode1(df: DataFrame, key: str, c: Column, name: str = "val") -> DataFrame:
    return df.select(key, F.posexplode_outer(c).alias("t", name)).select(key, "t", F.round(name, 6).alias(name))


def _ma_sql(k: int, alias: str) -> str:
    h = (k - 1) // 2
    return (f"{alias} as (select a.vec_id, a.t, avg(b.v) as trend from e a, range({-h}, {h + 1}) o(o), e b "
            f"where b.vec_id = a.vec_id and b.t = least(greatest(a.t + o.o, 0), 63) group by 1, 2)")


@query("moving_average", f"""
with e as {_EMB}, {_ma_sql(5, 'ma')}
select vec_id, t, round(trend, 6) as val from ma""")
def q_moving_average(spark, sf):
    return _explode1(_emb(spark, sf), "vec_id", series.moving_average("x", 5))


@query("decompose", f"""
with e as {_EMB}, {_ma_sql(5, 'ma')}
select e.vec_id, e.t, round(e.v - ma.trend, 6) as seasonal, round(ma.trend, 6) as trend
from e join ma on e.vec_id = ma.vec_id and e.t = ma.t""")
def q_decompose(spark, sf):
    d = _emb(spark, sf).select("vec_id", series.decompose("x", 5).alias("d"))
    z = d.select("vec_id", F.posexplode_outer(F.arrays_zip("d.seasonal", "d.trend")).alias("t", "z"))
    return z.select("vec_id", "t", F.round("z.seasonal", 6).alias("seasonal"), F.round("z.trend", 6).alias("trend"))


@query("decompose_multi", f"""
with e as {_EMB}, {_ma_sql(3, 'm3')}, {_ma_sql(7, 'm7')}
select e.vec_id, e.t, round(e.v - (m3.trend + m7.trend) / 2, 6) as seasonal, round((m3.trend + m7.trend) / 2, 6) as trend
from e join m3 on e.vec_id = m3.vec_id and e.t = m3.t join m7 on e.vec_id = m7.vec_id and e.t = m7.t""")
def q_decompose_multi(spark, sf):
    d = _emb(spark, sf).select("vec_id", series.decompose_multi("x", [3, 7]).alias("d"))
    z = d.select("vec_id", F.posexplode_outer(F.arrays_zip("d.seasonal", "d.trend")).alias("t", "z"))
    return z.select("vec_id", "t", F.round("z.seasonal", 6).alias("seasonal"), F.round("z.trend", 6).alias("trend"))


@query("difference", f"""
with e as {_EMB}
select vec_id, t, round(v - coalesce(lag(v) over (partition by vec_id order by t), 0.5), 6) as val from e""")
def q_difference(spark, sf):
    return _explode1(_emb(spark, sf), "vec_id", series.difference("x", 0.5))


@query("exp_smooth", f"""
with e as {_EMB}
select a.vec_id, a.t, round(pow(0.7, a.t + 1) * 0.25 + sum(0.3 * pow(0.7, a.t - b.t) * b.v), 6) as val
from e a join e b on a.vec_id = b.vec_id and b.t <= a.t group by a.vec_id, a.t""")
def q_exp_smooth(spark, sf):
    return _explode1(_emb(spark, sf), "vec_id", series.exp_smooth("x", 0.3, 0.25))


@query("level_smooth", f"""
with e as {_EMB}
select a.vec_id, a.t,
       round(pow(0.7, a.t + 1) * 0.25 + sum(pow(0.7, a.t - b.t) * (0.3 * (b.v - 0.5 * b.v) + 0.7 * (0.1 * b.v))), 6) as val
from e a join e b on a.vec_id = b.vec_id and b.t <= a.t group by a.vec_id, a.t""")
def q_level_smooth(spark, sf):
    e = _emb(spark, sf)
    season = F.transform("x", lambda v: v * 0.5)
    growth = F.transform("x", lambda v: v * 0.1)
    return _explode1(e, "vec_id", series.level_smooth("x", season, growth, 0.3, 0.25))


@query("damped_trend", f"""
with e as {_EMB}
select e.vec_id, h.h - 1 as t, round(e.v * (select sum(pow(0.9, i.i)) from range(1, h.h + 1) i(i)), 6) as val
from e, range(1, 7) h(h) where e.t = 63""")
def q_damped_trend(spark, sf):
    e = _emb(spark, sf)
    return _explode1(e, "vec_id", series.damped_trend(F.element_at("x", -1), 0.9, 6))


_DFT = f"""
e as {_EMB},
dft as (select e.vec_id, f.f, sum(e.v * cos(2 * pi() * f.f * e.t / 64)) as re, -sum(e.v * sin(2 * pi() * f.f * e.t / 64)) as im
        from e, range(1, 32) f(f) group by 1, 2),
top as (select *, sqrt(re * re + im * im) as amp, atan2(im, re) as phase,
               row_number() over (partition by vec_id order by sqrt(re * re + im * im) desc) as rk from dft)"""


@query("fourier_extrapolate", f"""
with {_DFT}
select top.vec_id, s.s as t, round(sum(2 * amp / 64 * cos(2 * pi() * (f / 64.0) * s.s + phase)), 6) as val
from top, range(0, 72) s(s) where rk <= 3 group by 1, 2""")
def q_fourier_extrapolate(spark, sf):
    return _explode1(_emb(spark, sf), "vec_id", series.fourier_extrapolate("x", 3, 8))


@query("top_frequencies", f"""
with {_DFT}
select vec_id, rk - 1 as rank, round(f / 64.0, 6) as freq, round(amp, 6) as amplitude, round(phase, 6) as phase
from top where rk <= 3""")
def q_top_frequencies(spark, sf):
    t = _emb(spark, sf).select("vec_id", series.top_frequencies("x", 3).alias("c"))
    z = t.select("vec_id", F.posexplode_outer("c").alias("rank", "c"))
    return z.select("vec_id", "rank", F.round("c.freq", 6).alias("freq"), F.round("c.amplitude", 6).alias("amplitude"),
                    F.round("c.phase", 6).alias("phase"))


@query("lowpass", f"""
with e as {_EMB},
dft as (select e.vec_id, f.f, sum(e.v * cos(2 * pi() * f.f * e.t / 64)) as re, -sum(e.v * sin(2 * pi() * f.f * e.t / 64)) as im
        from e, range(0, 4) f(f) group by 1, 2)
select d.vec_id, s.s as t,
       round(sum(case when f = 0 then re else 2 * (re * cos(2 * pi() * f * s.s / 64) - im * sin(2 * pi() * f * s.s / 64)) end) / 64, 6)
       as val
from dft d, range(0, 64) s(s) group by 1, 2""")
def q_lowpass(spark, sf):
    return _explode1(_emb(spark, sf), "vec_id", series.lowpass("x", 4))


@query("autocorrelation", f"""
with e as {_EMB}
select a.vec_id, tau.tau as t, round(sum(a.v * b.v), 6) as val
from e a, range(0, 64) tau(tau), e b where b.vec_id = a.vec_id and b.t = (a.t + tau.tau) % 64 group by 1, 2""")
def q_autocorrelation(spark, sf):
    return _explode1(_emb(spark, sf), "vec_id", series.autocorrelation("x"))


_AC_SQL = f"""
e as {_EMB},
ac as (select a.vec_id, tau.tau as lag, round(sum(a.v * b.v), 9) as c
       from e a, range(0, 64) tau(tau), e b where b.vec_id = a.vec_id and b.t = (a.t + tau.tau) % 64 group by 1, 2),
rk as (select *, row_number() over (partition by vec_id order by c desc, lag) as r, max(c) over (partition by vec_id) as mx from ac),
tp as (select vec_id, r, lag, exp(c - mx) / sum(exp(c - mx)) over (partition by vec_id) as weight from rk where r <= 4)"""


@query("top_lags", f"""
with {_AC_SQL}
select vec_id, r - 1 as rank, lag, round(weight, 6) as weight from tp""")
def q_top_lags(spark, sf):
    # correlations are symmetric in the lag (ties): compare them at 9 decimals so ties are exact on both sides
    ac = _emb(spark, sf).select("vec_id", series.autocorrelation("x").alias("ac"))
    ac = ac.select("vec_id", F.transform("ac", lambda v: F.round(v, 9)).alias("ac"))
    e = ac.select("vec_id", series.top_lags("ac", 1.0, 64).alias("l"))
    z = e.select("vec_id", F.posexplode_outer("l").alias("rank", "l"))
    return z.select("vec_id", "rank", F.col("l.lag").cast("long").alias("lag"), F.round("l.weight", 6).alias("weight"))


@query("time_delay_aggregate", f"""
with {_AC_SQL}
select e.vec_id, e.t, round(sum(tp.weight * b.v), 6) as val
from e join tp on tp.vec_id = e.vec_id join e b on b.vec_id = e.vec_id and b.t = (e.t + tp.lag) % 64 group by 1, 2""")
def q_time_delay_aggregate(spark, sf):
    e = _emb(spark, sf).select("vec_id", "x", series.autocorrelation("x").alias("ac"))
    e = e.select("vec_id", "x", F.transform("ac", lambda v: F.round(v, 9)).alias("ac"))
    lags = e.select("vec_id", "x", series.top_lags("ac", 1.0, 64).alias("l"))
    return _explode1(lags, "vec_id", series.time_delay_aggregate("x", "l"))


@query("instance_normalize", f"""
with e as (select vec_id, t // 4 as step, t % 4 as ch, v from {_EMB}),
s as (select vec_id, ch, avg(v) as m, sqrt(var_pop(v) + 1e-5) as sd from e group by 1, 2)
select e.vec_id, e.step, e.ch, round((e.v - s.m) / s.sd, 6) as val, round(s.m, 6) as mean, round(s.sd, 6) as std
from e join s on e.vec_id = s.vec_id and e.ch = s.ch""")
def q_instance_normalize(spark, sf):
    e = _emb(spark, sf)
    w = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, 4)).alias("w"))
    n = scale.instance_normalize(w, "w", "n", "m", "s")
    z = n.select("vec_id", "m", "s", F.posexplode_outer("n").alias("step", "_r")).select(
        "vec_id", "m", "s", "step", F.posexplode_outer("_r").alias("ch", "val"))
    return z.select("vec_id", "step", "ch", F.round("val", 6).alias("val"),
                    F.round(F.element_at("m", F.col("ch") + 1), 6).alias("mean"),
                    F.round(F.element_at("s", F.col("ch") + 1), 6).alias("std"))


@query("scale_windows", f"""
with {_E_HOURLY},
p as (select min(value) as lv, max(value) as hv, min(n) as ln, max(n) as hn from e),
s as (select i as w from e where i <= cnt - {L + P})
select s.w as window_id, 'x' as part, e.i - s.w as step, 0 as feat,
       round((e.value - lv) / case when hv = lv then 1 else hv - lv end, 6) as val
  from s join e on e.i between s.w and s.w + {L - 1}, p
union all select s.w, 'x', e.i - s.w, 1, round((e.n - ln) / case when hn = ln then 1 else hn - ln end, 6)
  from s join e on e.i between s.w and s.w + {L - 1}, p""")
def q_scale_windows(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    params = scale.fit_scaler(idx, ["value", "n"], "minmax")
    w = windows.sliding_windows_indexed(idx, L, P, ["value", "n"], "value", n=n)
    off, den = params.offsets_and_denominators()
    w = w.withColumn("x", scale.scale_array_column("x", off, den))
    return _long(w, "window_id", {"x": F.col("x")}, {"x"})


@query("unscale_target", """select event_id, round(value, 6) as value from events""")
def q_unscale_target(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "value")
    p = scale.fit_target_scaler(ev, "value", "mean")
    return rounded(scale.unscale_target(scale.scale_target(ev, p, "value"), p, ["value"]))


@query("scale_target", """
with e as (select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as i, count(*) over () as n from orders),
p as (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from e where i < cast(floor(n * (1 - 0.2::double)) as bigint))
select o_orderkey, round((o_totalprice - m) / case when s = 0 then 1 else s end, 6) as o_totalprice from e, p""")
def q_scale_target(spark, sf):
    from tidepool.operators.split import chronological_split

    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    idx, n = with_row_index(o, ["o_orderdate", "o_orderkey"])
    train, _, _ = chronological_split(idx, n, 0.2)
    p = scale.fit_target_scaler(train, "o_totalprice", scale.target_policy("small", None, "regression"))
    return rounded(scale.scale_target(idx, p, "o_totalprice").select("o_orderkey", "o_totalprice"))


# ------------------------------------------------------------------------------------ evaluation

_REG = ("(select l_orderkey * 10 + l_linenumber as row_id, l_quantity as y, "
        "l_quantity * 0.9 + sqrt(l_tax + 1) * 3 as yhat from lineitem)")


def _reg(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_quantity").alias("y"),
                     (F.col("l_quantity") * 0.9 + F.sqrt(F.col("l_tax") + 1) * 3).alias("yhat"))


@query("regression_metrics", f"""
with d as {_REG}, m as (select avg(y) as my from d)
select round(avg((y - yhat) * (y - yhat)), 6) as mse, round(sqrt(avg((y - yhat) * (y - yhat))), 6) as rmse,
       round(avg(abs(y - yhat)), 6) as mae,
       round(case when sum((y - my) * (y - my)) = 0 then case when sum((y - yhat) * (y - yhat)) = 0 then 1.0 else 0.0 end
             else 1 - sum((y - yhat) * (y - yhat)) / sum((y - my) * (y - my)) end, 6) as r2
from d, m""")
def q_regression_metrics(spark, sf):
    return rounded(evaluate.regression_metrics(_reg(spark, sf)))


_MULTI_SQL = f"""
with {_E_HOURLY},
s as (select i as w from e where i <= cnt - {L + P}),
pairs as (select s.w, e.i - s.w - {L} as h, e.value as y, last.value as yhat
          from s join e on e.i between s.w + {L} and s.w + {L + P - 1} join e last on last.i = s.w + {L - 1})"""


@query("regression_metrics_multi", _MULTI_SQL + """,
ph as (select h, avg((y - yhat) * (y - yhat)) as mse, avg(abs(y - yhat)) as mae,
              1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) as r2 from pairs group by h)
select round(avg(mse), 6) as mse, round(sqrt(avg(mse)), 6) as rmse, round(avg(mae), 6) as mae, round(avg(r2), 6) as r2
from ph""")
def q_regression_metrics_multi(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    w = windows.sliding_windows_indexed(idx, L, P, ["value"], "value", n=n)
    scored = w.select("window_id", "y", F.array_repeat(F.element_at(F.element_at("x", -1), 1), P).alias("yhat"))
    return rounded(evaluate.regression_metrics_multi(scored))


_CLS = ("(select l_orderkey * 10 + l_linenumber as row_id, l_returnflag as y, "
        "case when l_discount < 0.03 then 'A' when l_discount < 0.07 then 'N' else 'R' end as yhat from lineitem)")


def _cls(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.col("l_returnflag").alias("y"),
                     F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R")
                     .alias("yhat"))


@query("accuracy", f"select round(avg(case when y = yhat then 1.0 else 0.0 end), 6) as accuracy from {_CLS}")
def q_accuracy(spark, sf):
    return rounded(evaluate.accuracy(_cls(spark, sf)))


@query("confusion_matrix", f"""
with d as {_CLS}, l as (select y as label from d union select yhat from d)
select a.label as truth, b.label as pred, count(d.row_id) as count
from l a cross join l b left join d on d.y = a.label and d.yhat = b.label group by 1, 2""")
def q_confusion_matrix(spark, sf):
    return evaluate.confusion_matrix(_cls(spark, sf))


@query("precision_recall_f1", f"""
with d as {_CLS},
c as (select y as c from d union select yhat from d),
pc as (select c.c, (select count(*) from d where y = c.c and yhat = c.c) as tp,
              (select count(*) from d where y = c.c) as support, (select count(*) from d where yhat = c.c) as pred_n from c),
m as (select c, support, case when pred_n > 0 then tp / pred_n else 0.0 end as p,
             case when support > 0 then tp / support else 0.0 end as r from pc)
select round(sum(p * support) / sum(support), 6) as precision, round(sum(r * support) / sum(support), 6) as recall,
       round(sum(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end * support) / sum(support), 6) as f1 from m""")
def q_precision_recall_f1(spark, sf):
    return rounded(evaluate.precision_recall_f1(_cls(spark, sf)))


@query("precision_recall_f1_binary", """
with d as (select quality as y, toxic as yhat from labels),
s as (select sum(case when y = 1 and yhat = 1 then 1 else 0 end) as tp, sum(case when yhat = 1 then 1 else 0 end) as pp,
             sum(case when y = 1 then 1 else 0 end) as ap from d),
m as (select case when pp > 0 then tp / pp else 0.0 end as p, case when ap > 0 then tp / ap else 0.0 end as r from s)
select round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1
from m""")
def q_precision_recall_f1_binary(spark, sf):
    lab = table(spark, sf, "labels").select(F.col("quality").alias("y"), F.col("toxic").alias("yhat"))
    return rounded(evaluate.precision_recall_f1(lab, n_truth_classes=2))


_ROC = "(select vec_id, case when label = 1 then 1 else 0 end as y, cast(embedding[1] as double) as score from embeddings)"


def _roc(spark, sf) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.when(F.col("label") == 1, 1).otherwise(0).alias("y"),
                    F.element_at("embedding", 1).cast("double").alias("score"))


@query("roc_curve", f"""
with d as {_ROC},
g as (select score, sum(y) as pos, sum(1 - y) as neg from d group by 1),
c as (select score, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tps,
             sum(neg) over (order by score desc rows between unbounded preceding and current row) as fps,
             sum(pos) over () as p, sum(neg) over () as n from g)
select 'inf'::double as threshold, 0.0 as fpr, 0.0 as tpr
union all select round(score, 6), round(fps / n, 6), round(tps / p, 6) from c""")
def q_roc_curve(spark, sf):
    return rounded(evaluate.roc_curve(_roc(spark, sf)))


@query("roc_auc", f"""
with d as {_ROC},
g as (select score, sum(y) as pos, sum(1 - y) as neg from d group by 1),
c as (select *, sum(pos) over (order by score desc rows between unbounded preceding and current row) as tps from g)
select round(sum(neg * (2 * tps - pos)) / (2.0 * sum(pos) * sum(neg)), 6) as auc from c""")
def q_roc_auc(spark, sf):
    return rounded(evaluate.roc_auc(_roc(spark, sf)))


def _residual_sql() -> str:
    def edge(k: str, p: str = "") -> str:
        return f"(case when {k} = 30 then {p}hi else {p}lo + {k} * (({p}hi - {p}lo) / 30.0::double) end)"
    return f"""
with nn as (select cast(y - yhat as double) as value from {_REG}),
rng0 as (select min(value) as vmin, max(value) as vmax from nn),
rng as (select case when vmin = vmax then vmin - 0.5 else vmin end as lo, case when vmin = vmax then vmax + 0.5 else vmax end as hi
        from rng0),
b0 as (select value, lo, hi, least(greatest(cast(floor((value - lo) * (30.0::double / (hi - lo))) as integer), 0), 29) as k
       from nn, rng),
b1 as (select *, case when value < {edge('k')} and k > 0 then k - 1 else k end as k1 from b0),
b2 as (select *, case when value >= {edge('(k1 + 1)')} and k1 < 29 then k1 + 1 else k1 end as bin from b1),
counts as (select bin, count(*) as cnt from b2 group by 1),
spine as (select lo, hi, unnest(range(0, 30)) as bin from rng)
select 'residual' as "column", s.bin as bin, round({edge('s.bin', 's.')}, 6) as lo, round({edge('(s.bin + 1)', 's.')}, 6) as hi,
       coalesce(c.cnt, 0) as "count"
from spine s left join counts c on s.bin = c.bin"""


@query("residual_histogram", _residual_sql())
def q_residual_histogram(spark, sf):
    return rounded(evaluate.residual_histogram(_reg(spark, sf)))


@query("pred_vs_true", _MULTI_SQL + """
select w as row_id, h, round(y, 6) as y, round(yhat, 6) as yhat from pairs""")
def q_pred_vs_true(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    w = windows.sliding_windows_indexed(idx, L, P, ["value"], "value", n=n)
    scored = w.select(F.col("window_id").alias("row_id"), "y",
                      F.array_repeat(F.element_at(F.element_at("x", -1), 1), P).alias("yhat"))
    pairs, _ = evaluate.pred_vs_true(scored)
    return rounded(pairs)


@query("pred_vs_true_range", _MULTI_SQL + """
select round(least(min(y), min(yhat)), 6) as lo, round(greatest(max(y), max(yhat)), 6) as hi from pairs""")
def q_pred_vs_true_range(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    w = windows.sliding_windows_indexed(idx, L, P, ["value"], "value", n=n)
    scored = w.select(F.col("window_id").alias("row_id"), "y",
                      F.array_repeat(F.element_at(F.element_at("x", -1), 1), P).alias("yhat"))
    _, rng = evaluate.pred_vs_true(scored)
    return rounded(rng)


@query("pred_vs_true_line", _MULTI_SQL + """
select w as row_id, round(y, 6) as y, round(yhat, 6) as yhat from pairs where h = 0""")
def q_pred_vs_true_line(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    w = windows.sliding_windows_indexed(idx, L, P, ["value"], "value", n=n)
    scored = w.select(F.col("window_id").alias("row_id"), "y",
                      F.array_repeat(F.element_at(F.element_at("x", -1), 1), P).alias("yhat"))
    return rounded(evaluate.pred_vs_true_line(scored))


@query("compare_models", f"""
with {_E_HOURLY},
s as (select i as w from e where i <= cnt - {L + P}),
xm as (select s.w, avg(e.value) as mean_x from s join e on e.i between s.w and s.w + {L - 1} group by 1)
select s.w as row_id, round(t.value, 6) as truth, round(last.value, 6) as naive, round(xm.mean_x, 6) as mean
from s join e t on t.i = s.w + {L + P - 1} join e last on last.i = s.w + {L - 1} join xm on xm.w = s.w""")
def q_compare_models(spark, sf):
    idx, n = _indexed_hourly(spark, sf)
    w = windows.sliding_windows_indexed(idx, L, P, ["value"], "value", n=n).withColumnRenamed("window_id", "row_id")
    flat = F.transform("x", lambda r: F.element_at(r, 1))
    naive = w.select("row_id", "y", F.array_repeat(F.element_at(flat, -1), P).alias("yhat"))
    mean = w.select("row_id", "y", F.array_repeat(F.aggregate(flat, F.lit(0.0), lambda a, v: a + v) / L, P).alias("yhat"))
    return rounded(evaluate.compare_models({"naive": naive, "mean": mean}))


@query("cv_summary", f"""
with f as (select l_orderkey, l_linenumber, row_number() over (order by md5(concat_ws(':', cast(l_orderkey as varchar),
             cast(l_linenumber as varchar), '42')), l_orderkey, l_linenumber) - 1 as ri, count(*) over () as n from lineitem),
q as (select *, n // 5 as q, n % 5 as rem from f),
fo as (select l_orderkey * 10 + l_linenumber as row_id,
              case when ri < rem * (q + 1) then ri // (q + 1) else rem + (ri - rem * (q + 1)) // q end as fold from q),
d as (select fo.fold, r.* from {_REG} r join fo on r.row_id = fo.row_id),
s as (select fold, 1 - sum((y - yhat) * (y - yhat)) / (var_pop(y) * count(*)) as score from d group by fold)
select round(avg(score), 4) as mean, round(stddev_pop(score), 4) as std, count(*) as folds from s""")
def q_cv_summary(spark, sf):
    from tidepool.operators.split import kfold

    li = table(spark, sf, "lineitem")
    folded = kfold(li, ["l_orderkey", "l_linenumber"], 5, 42)
    scored = folded.select("fold", F.col("l_quantity").alias("y"),
                           (F.col("l_quantity") * 0.9 + F.sqrt(F.col("l_tax") + 1) * 3).alias("yhat"))
    e = F.col("y") - F.col("yhat")
    scores = scored.groupBy("fold").agg((1 - F.sum(e * e) / (F.var_pop("y") * F.count(F.lit(1)))).alias("score"))
    return evaluate.cv_summary(scores)


@query("prediction_rows", f"select row_id, round(yhat, 6) as yhat, y from {_REG} order by row_id limit 100")
def q_prediction_rows(spark, sf):
    return rounded(evaluate.prediction_rows(_reg(spark, sf)))


@query("prediction_export", """
select vec_id as "index", label as true_value, case when 1 / (1 + exp(-embedding[1])) >= 0.5 then 1 else 0 end as prediction,
       round(greatest(1 - 1 / (1 + exp(-embedding[1])), 1 / (1 + exp(-embedding[1]))), 6) as confidence from embeddings""")
def q_prediction_export(spark, sf):
    e = table(spark, sf, "embeddings")
    p1 = 1 / (1 + F.exp(-F.element_at("embedding", 1).cast("double")))
    scored = e.select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"),
                      F.when(p1 >= 0.5, 1).otherwise(0).alias("yhat"), F.array(1 - p1, p1).alias("probability"))
    return rounded(io.prediction_export(scored))


# ------------------------------------------------------------------------------------ runs table

_RUNS = ("(select user_id as project, event_id as run_id, event_type as model_type, ts as created_at, "
         "case when event_id % 3 = 0 then true when event_id % 3 = 1 then false end as is_time_series from events)")


def _runs(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    return ev.select(F.col("user_id").alias("project"), F.col("event_id").alias("run_id"),
                     F.col("event_type").alias("model_type"), F.col("ts").alias("created_at"),
                     F.when(F.col("event_id") % 3 == 0, True).when(F.col("event_id") % 3 == 1, False)
                     .alias("is_time_series"))


@query("latest_runs", f"""
select project, run_id, row_number() over (partition by project order by created_at desc, run_id desc) as rank from {_RUNS}""")
def q_latest_runs(spark, sf):
    return runs.latest_runs(_runs(spark, sf)).select("project", "run_id", "rank")


@query("active_runs", f"""
select project, created_at, run_id from (select *, row_number() over (partition by project order by created_at desc,
       run_id desc) as rk from {_RUNS}) where rk = 1""")
def q_active_runs(spark, sf):
    return runs.active_runs(_runs(spark, sf))


@query("filter_runs_by_task", f"select run_id from {_RUNS} where coalesce(is_time_series, false) = false")
def q_filter_runs_by_task(spark, sf):
    return runs.filter_runs_by_task(_runs(spark, sf), False).select("run_id")


@query("run_counts", f"select project, count(*) as runs from {_RUNS} group by 1")
def q_run_counts(spark, sf):
    return runs.run_counts(_runs(spark, sf))


# ------------------------------------------------------------------------------------ sources

@query("series_arrays_to_long", f"""
select vec_id, t, round(v, 6) as d0, round(v * 2, 6) as d1 from {_EMB}""")
def q_series_arrays_to_long(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("d0"),
                                               F.transform("embedding", lambda v: v.cast("double") * 2).alias("d1"))
    return rounded(io.series_arrays_to_long(e, "vec_id", ["d0", "d1"]))


@query("series_lengths", """
select vec_id, len(embedding) as len_d0, least(len(embedding), 40) as len_d1,
       len(embedding) <> least(len(embedding), 40) as ragged, len(embedding) as length from embeddings""")
def q_series_lengths(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("d0"),
                                               F.slice("embedding", 1, 40).alias("d1"))
    return io.series_lengths(e, "vec_id", ["d0", "d1"])


@query("load_forecast_table", f"select hour as date, n, round(value, 6) as value from {HOURLY_SQL}")
def q_load_forecast_table(spark, sf):
    h = hourly_events(spark, sf)
    return rounded(io.load_forecast_table(h, "value", "M"))


@query("calendar_encoded_forecast_table", f"""
select hour as date, month(hour) as month, day(hour) as day, isodow(hour) - 1 as weekday, hour(hour) as hour_mark
from {HOURLY_SQL}""")
def q_forecast_marks(spark, sf):
    h = io.load_forecast_table(hourly_events(spark, sf), "value", "S")
    return timefeat.calendar_marks(h, "date", "h").select("date", "month", "day", "weekday",
                                                          F.col("hour").alias("hour_mark"))
