"""Checked queries of the series formulas on rows: every user's raw events are a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import long_series
from tidepool.plans.suite import query, rounded, table

BY = {"order_by": ["ts", "event_id"], "partition_by": ["user_id"]}
_E = """
e as (select user_id, event_id, value, value / 99 as x, row_number() over (partition by user_id order by ts, event_id) - 1 as t,
             count(*) over (partition by user_id) as n from events)"""


def _events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "event_id", "ts", "value", (F.col("value") / 99).alias("x"))


def _trend_sql(k: int, alias: str) -> str:
    h = k // 2
    return (f"{alias} as (select a.event_id, avg(b.value) as trend from e a, range({-h}, {h + 1}) o(o), e b "
            f"where b.user_id = a.user_id and b.t = least(greatest(a.t + o.o, 0), a.n - 1) group by 1)")


@query("moving_average_rows", f"with {_E}, {_trend_sql(5, 'm')} select event_id, round(trend, 6) as trend from m")
def q_moving_average_rows(spark, sf):
    return rounded(long_series.moving_average_rows(_events(spark, sf), "value", 5, **BY).select("event_id", "trend"))


@query("decompose_rows", f"""with {_E}, {_trend_sql(25, 'm')}
select e.event_id, round(trend, 6) as trend, round(value - trend, 6) as seasonal from e join m on m.event_id = e.event_id""")
def q_decompose_rows(spark, sf):
    return rounded(long_series.decompose_rows(_events(spark, sf), "value", [25], **BY).select("event_id", "trend", "seasonal"))


@query("decompose_multi_rows", f"""with {_E}, {_trend_sql(3, 'a')}, {_trend_sql(7, 'b')}
select e.event_id, round((a.trend + b.trend) / 2, 6) as trend, round(value - (a.trend + b.trend) / 2, 6) as seasonal
from e join a on a.event_id = e.event_id join b on b.event_id = e.event_id""")
def q_decompose_multi_rows(spark, sf):
    return rounded(long_series.decompose_rows(_events(spark, sf), "value", [3, 7], **BY).select("event_id", "trend", "seasonal"))


@query("difference_rows", f"""with {_E}
select event_id, round(value - coalesce(lag(value) over (partition by user_id order by t), 0.5), 6) as difference from e""")
def q_difference_rows(spark, sf):
    return rounded(long_series.difference_rows(_events(spark, sf), "value", start=0.5, **BY).select("event_id", "difference"))


def _recursive(step: str) -> str:
    return f"""with recursive {_E},
r as (select user_id, event_id, t, 2 / 3.0::double * 0.25 + {step} as s from e where t = 0
      union all select e.user_id, e.event_id, e.t, 2 / 3.0::double * r.s + {step} from r join e on e.user_id = r.user_id and e.t = r.t + 1)
select event_id, round(s, 6) as level from r"""


@query("exp_smooth_rows", _recursive("(1 - 2 / 3.0::double) * value"))
def q_exp_smooth_rows(spark, sf):
    return rounded(long_series.exp_smooth_rows(_events(spark, sf), "value", 1 / 3, v0=0.25, **BY).select("event_id", "level"))


@query("level_smooth_rows", _recursive("(1 - 2 / 3.0::double) * (value - 0.5 * value) + 2 / 3.0::double * 0.1 * value"))
def q_level_smooth_rows(spark, sf):
    out = long_series.level_smooth_rows(_events(spark, sf), "value", F.col("value") * 0.5, F.col("value") * 0.1, 1 / 3, v0=0.25, **BY)
    return rounded(out.select("event_id", "level"))


@query("damped_trend_rows", f"""with {_E}
select e.user_id, h.h as step, round(e.value * (select sum(pow(0.9, i.i)) from range(1, h.h + 1) i(i)), 6) as trend
from e, range(1, 7) h(h) where e.t = e.n - 1""")
def q_damped_trend_rows(spark, sf):
    return rounded(long_series.damped_trend_rows(_events(spark, sf), "value", 0.9, 6, **BY))


def _modes(first: int, low: str, high: str) -> str:
    """The transform's coefficients for frequencies from ``low`` to below ``high``."""
    return f"""d as (
select user_id, n, f.f as f, sum(value * cos(2 * pi() * ((f.f * t) % n) / n)) as re, -sum(value * sin(2 * pi() * ((f.f * t) % n) / n)) as im
from e, range({first}, 512) f(f) where f.f >= {low} and f.f < {high} group by all)"""


_BEST = "b as (select *, row_number() over (partition by user_id order by re * re + im * im desc, f) as rank from d)"
_WAVE = "(re * cos(2 * pi() * ((f * p.t) % p.n) / p.n) - im * sin(2 * pi() * ((f * p.t) % p.n) / p.n))"


@query("top_frequencies_rows", f"""with {_E}, {_modes(1, '1', 'n / 2.0')}, {_BEST}
select user_id, rank, round(f / n::double, 6) as freq, round(sqrt(re * re + im * im), 6) as amplitude, round(atan2(im, re), 6) as phase
from b where rank <= 3""")
def q_top_frequencies_rows(spark, sf):
    return rounded(long_series.top_frequencies_rows(_events(spark, sf), "value", 3, **BY))


@query("fourier_extrapolate_rows", f"""with {_E}, {_modes(1, '1', 'n / 2.0')}, {_BEST},
p as (select user_id, n, t from e union all select user_id, n, n + h.h from e, range(0, 4) h(h) where t = 0)
select p.user_id, p.t, round(coalesce(sum(2 / p.n::double * {_WAVE}), 0), 6) as seasonal
from p left join b on b.user_id = p.user_id and b.rank <= 2 group by p.user_id, p.t""")
def q_fourier_extrapolate_rows(spark, sf):
    return rounded(long_series.fourier_extrapolate_rows(_events(spark, sf), "value", 2, 4, **BY))


@query("lowpass_rows", f"""with {_E}, {_modes(0, '0', 'least(4, n // 2)')}
select p.user_id, p.t, round(coalesce(sum(case when f = 0 then 1 else 2 end / p.n::double * {_WAVE}), 0), 6) as smooth
from e p left join d on d.user_id = p.user_id group by p.user_id, p.t""")
def q_lowpass_rows(spark, sf):
    return rounded(long_series.lowpass_rows(_events(spark, sf), "value", 4, **BY))


_LAGS = """c as (select a.user_id, a.n, l.l as lag, sum(a.x * b.x) as corr from e a, range(0, 21) l(l), e b
where l.l < a.n and b.user_id = a.user_id and b.t = (a.t + l.l) % a.n group by all),
w as (select *, row_number() over (partition by user_id order by corr desc, lag) as rank from c
      qualify rank <= greatest(1, cast(floor(1.5 * ln(n)) as integer))),
v as (select *, exp(corr - max(corr) over u) / sum(exp(corr - corr0)) over u as weight
      from (select *, max(corr) over (partition by user_id) as corr0 from w) window u as (partition by user_id))"""


@query("autocorrelation_rows", f"with {_E}, {_LAGS} select user_id, lag, round(corr, 6) as corr from c")
def q_autocorrelation_rows(spark, sf):
    return rounded(long_series.autocorrelation_rows(_events(spark, sf), "x", 20, **BY))


@query("top_lags_rows", f"with {_E}, {_LAGS} select user_id, rank, lag, round(weight, 6) as weight from v")
def q_top_lags_rows(spark, sf):
    return rounded(long_series.top_lags_rows(_events(spark, sf), "x", 1.5, 20, **BY))


@query("time_delay_aggregate_rows", f"""with {_E}, {_LAGS}
select e.user_id, e.t, round(sum(v.weight * b.x), 6) as delayed
from e join v on v.user_id = e.user_id join e b on b.user_id = e.user_id and b.t = (e.t + v.lag) % e.n group by e.user_id, e.t""")
def q_time_delay_aggregate_rows(spark, sf):
    return rounded(long_series.time_delay_aggregate_rows(_events(spark, sf), "x", 1.5, 20, **BY))
