"""Checked queries for the remaining preparation operators: decoder-input scaling, inverse
scalers, value/mark assembly and the null-column summary."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import features, profile, scale, windows
from tidepool.plans.order import with_row_index
from tidepool.plans.suite import (
    EVENTS_NULLS_SQL,
    HOURLY_SQL,
    events_with_nulls,
    hourly_events,
    query,
    rounded,
    table,
)

L, P, LABEL = 12, 3, 4


@query("scale_decoder_input", f"""
with h as {HOURLY_SQL},
e as (select hour, value, cast(n as double) as n, row_number() over (order by hour) - 1 as i, count(*) over () as cnt
      from h),
p as (select min(value) as lv, max(value) as hv, min(n) as ln, max(n) as hn from e),
s as (select i as w from e where i <= cnt - {L + P}),
dk as (select s.w, e.i - (s.w + {L - LABEL}) as step, e.value, e.n from s join e on e.i between s.w + {L - LABEL} and s.w + {L - 1})
select w as window_id, step, 0 as feat, round((value - lv) / case when hv = lv then 1 else hv - lv end, 6) as val from dk, p
union all select w, step, 1, round((n - ln) / case when hn = ln then 1 else hn - ln end, 6) from dk, p
union all select s.w, {LABEL} + k.k, 0, round((0 - lv) / case when hv = lv then 1 else hv - lv end, 6) from s, range(0, {P}) k(k), p
union all select s.w, {LABEL} + k.k, 1, round((0 - ln) / case when hn = ln then 1 else hn - ln end, 6) from s, range(0, {P}) k(k), p""")
def q_scale_decoder_input(spark, sf):
    h = hourly_events(spark, sf)
    idx, n = with_row_index(h, ["hour"])
    params = scale.fit_scaler(idx, ["value", "n"], "minmax")
    w = windows.seq2seq_windows_indexed(idx, L, P, LABEL, ["value", "n"], ["n"], "value", n=n)
    w = scale.scale_decoder_input(w, params, "dec_inp", LABEL, scale_placeholders=True)
    z = w.select("window_id", F.posexplode_outer("dec_inp").alias("step", "_r")).select(
        "window_id", "step", F.posexplode_outer("_r").alias("feat", "val"))
    return z.select("window_id", "step", "feat", F.round("val", 6).alias("val"))


@query("inverse_standard_scale", f"select hour, round(value, 6) as value, round(cast(n as double), 6) as n from {HOURLY_SQL}")
def q_inverse_standard_scale(spark, sf):
    h = hourly_events(spark, sf)
    scaled, params = scale.standard_scale(h, ["value", "n"])
    return rounded(scale.inverse_standard_scale(scaled, params).select("hour", "value", "n"))


@query("assemble_value_and_mark", f"""
with h as {HOURLY_SQL}
select hour, 'values' as part, 0 as pos, round(cast(n as double), 6) as val from h
union all select hour, 'values', 1, round(value, 6) from h
union all select hour, 'marks', 0, round(month(hour) / 12.0, 6) from h
union all select hour, 'marks', 1, round(day(hour) / 31.0, 6) from h
union all select hour, 'marks', 2, round((isodow(hour) - 1) / 7.0, 6) from h
union all select hour, 'marks', 3, round(hour(hour) / 23.0, 6) from h""")
def q_assemble_value_and_mark(spark, sf):
    h = hourly_events(spark, sf)
    h = h.select("hour", "n", "value", (F.month("hour") / 12.0).alias("m_month"), (F.dayofmonth("hour") / 31.0).alias("m_day"),
                 (F.weekday("hour") / 7.0).alias("m_weekday"), (F.hour("hour") / 23.0).alias("m_hour"))
    out, names, target_idx, _ = features.assemble_value_and_mark(
        h, "value", ["m_month", "m_day", "m_weekday", "m_hour"], exclude=["hour"])
    assert names == ["n", "value"] and target_idx == 1, (names, target_idx)
    v = out.select("hour", F.lit("values").alias("part"), F.posexplode_outer("values").alias("pos", "val"))
    m = out.select("hour", F.lit("marks").alias("part"), F.posexplode_outer("marks").alias("pos", "val"))
    return rounded(v.unionByName(m))


@query("instance_denormalize", """
select vec_id, (t - 1) // 4 as step, (t - 1) % 4 as ch, round(cast(v as double), 6) as val
from embeddings, unnest(embedding) with ordinality as u(v, t)""")
def q_instance_denormalize(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    w = e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("x", i * 4 + 1, 4)).alias("w"))
    n = scale.instance_normalize(w, "w", "n", "m", "s")
    back = n.select("vec_id", scale.instance_denormalize("n", "m", "s").alias("b"))
    z = back.select("vec_id", F.posexplode_outer("b").alias("step", "_r")).select(
        "vec_id", "step", F.posexplode_outer("_r").alias("ch", "val"))
    return z.select("vec_id", "step", "ch", F.round("val", 6).alias("val"))


_TIME_COLS = [("orders", "o_orderdate"), ("lineitem", "l_shipdate")]


@query("describe_time", "\nunion all\n".join(
    f"select '{c}' as \"column\", count({c}) as count, round(avg(epoch({c})), 3) as mean_epoch_s, min({c}) as min, "
    f"quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.75) as p75, "
    f"max({c}) as max from {t}" for t, c in _TIME_COLS))
def q_describe_time(spark, sf):
    parts = [profile.describe_time(table(spark, sf, t).select(c)) for t, c in _TIME_COLS]
    out = parts[0].unionByName(parts[1])
    return out.withColumn("mean_epoch_s", F.round("mean_epoch_s", 3))


@query("columns_with_nulls", f"""
select sum(case when c > 0 then 1 else 0 end) as columns_with_nulls from (
  select count(*) - count(event_id) as c from {EVENTS_NULLS_SQL} union all
  select count(*) - count(ts) from {EVENTS_NULLS_SQL} union all
  select count(*) - count(user_id) from {EVENTS_NULLS_SQL} union all
  select count(*) - count(event_type) from {EVENTS_NULLS_SQL} union all
  select count(*) - count(value) from {EVENTS_NULLS_SQL})""")
def q_columns_with_nulls(spark, sf):
    return profile.columns_with_nulls(events_with_nulls(spark, sf))
