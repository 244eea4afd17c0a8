"""Checked queries for profiling, cleaning, scaling, time features, encoding and splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.operators import clean, features, profile, scale, split, timefeat
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

# Lineitem columns and the dtype names the reference would report for them.
LINEITEM_DTYPES = [
    ("l_orderkey", "int64"), ("l_partkey", "int64"), ("l_suppkey", "int64"), ("l_linenumber", "int64"),
    ("l_quantity", "float64"), ("l_extendedprice", "float64"), ("l_discount", "float64"), ("l_tax", "float64"),
    ("l_returnflag", "object"), ("l_linestatus", "object"), ("l_shipdate", "datetime64[ns]"),
]
# all numeric columns of lineitem, in table order
LINEITEM_MEASURES = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
IQR_COLUMNS = CORR_COLUMNS = HIST_COLUMNS = LINEITEM_MEASURES


def _union(parts: list[str]) -> str:
    return "\nunion all\n".join(parts)


# ------------------------------------------------------------------------------------ profile

@query("profile_shape", "select count(*) as n_rows, case when count(*) = 0 then 0 else 11 end as n_cols from lineitem")
def q_profile_shape(spark, sf):
    return profile.profile_shape(table(spark, sf, "lineitem"))


@query("profile_schema", _union([
    f"select {i} as position, '{c}' as \"column\", '{d}' as dtype, count({c}) as non_null from lineitem"
    for i, (c, d) in enumerate(LINEITEM_DTYPES)]))
def q_profile_schema(spark, sf):
    return profile.profile_schema(table(spark, sf, "lineitem"))


@query("profile_nulls", _union([
    f"select '{c}' as \"column\", count(*) - count({c}) as null_count, "
    f"round((count(*) - count({c})) / count(*) * 100, 2) as null_pct from {EVENTS_NULLS_SQL}"
    for c in ["event_id", "ts", "user_id", "event_type", "value"]]))
def q_profile_nulls(spark, sf):
    return profile.profile_nulls(events_with_nulls(spark, sf))


@query("describe_numeric", _union([
    f"select '{c}' as \"column\", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, "
    f"round(min({c}), 6) as min, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, "
    f"round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as max from lineitem"
    for c in LINEITEM_MEASURES]))
def q_describe_numeric(spark, sf):
    return rounded(profile.describe_numeric(table(spark, sf, "lineitem"), LINEITEM_MEASURES))


@query("describe_categorical", """
with f as (
  select 'c_name' as "column", c_name as v, count(*) as freq from customer where c_name is not null group by 2
  union all
  select 'c_mktsegment', c_mktsegment, count(*) from customer where c_mktsegment is not null group by 2),
r as (select *, row_number() over (partition by "column" order by freq desc, v asc) as rn from f),
s as (select "column", sum(freq) as cnt, count(*) as uniq from f group by 1)
select r."column" as "column", s.cnt as "count", s.uniq as "unique", r.v as top, r.freq as freq
from r join s on r."column" = s."column" where rn = 1""")
def q_describe_categorical(spark, sf):
    return profile.describe_categorical(table(spark, sf, "customer"), ["c_name", "c_mktsegment"])


@query("preview", "select * from lineitem order by l_orderkey, l_linenumber limit 50")
def q_preview(spark, sf):
    return profile.preview(table(spark, sf, "lineitem"), 50, ["l_orderkey", "l_linenumber"])


@query("histogram")
def q_histogram(spark, sf):
    return rounded(profile.histogram(table(spark, sf, "lineitem")))


def _hist_sql() -> str:
    def edge(k: str, p: str = "") -> str:
        return f"(case when {k} = 30 then {p}hi else {p}lo + {k} * (({p}hi - {p}lo) / 30.0::double) end)"
    longs = _union([f"select '{c}' as col, cast({c} as double) as value from lineitem" for c in HIST_COLUMNS])
    return f"""
with long as ({longs}),
nn as (select * from long where value is not null),
rng0 as (select col, min(value) as vmin, max(value) as vmax from nn group by 1),
rng as (select col, case when vmin = vmax then vmin - 0.5 else vmin end as lo,
                    case when vmin = vmax then vmax + 0.5 else vmax end as hi from rng0),
b0 as (select nn.col, value, lo, hi,
              least(greatest(cast(floor((value - lo) * (30.0::double / (hi - lo))) as integer), 0), 29) as k
       from nn join rng on nn.col = rng.col),
b1 as (select *, case when value < {edge('k')} and k > 0 then k - 1 else k end as k1 from b0),
b2 as (select *, case when value >= {edge('(k1 + 1)')} and k1 < 29 then k1 + 1 else k1 end as bin from b1),
counts as (select col, bin, count(*) as cnt from b2 group by 1, 2),
spine as (select col, lo, hi, unnest(range(0, 30)) as bin from rng)
select s.col as "column", s.bin as bin, round({edge('s.bin', 's.')}, 6) as lo,
       round({edge('(s.bin + 1)', 's.')}, 6) as hi, coalesce(c.cnt, 0) as "count"
from spine s left join counts c on s.col = c.col and s.bin = c.bin"""


from tidepool.plans.suite import ORACLE, oracle_text  # noqa: E402

ORACLE["histogram"] = oracle_text(_hist_sql())


def _corr_sql() -> str:
    parts = []
    cols = CORR_COLUMNS
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"select '{a}' as col_i, '{b}' as col_j, round(corr({a}, {b}), 6) as r from lineitem")
            parts.append(f"select '{b}' as col_i, '{a}' as col_j, round(corr({a}, {b}), 6) as r from lineitem")
        parts.append(f"select '{a}' as col_i, '{a}' as col_j, case when stddev_samp({a}) > 0 then 1.0::double end as r "
                     f"from lineitem")
    return _union(parts)


@query("correlation_matrix", _corr_sql())
def q_correlation_matrix(spark, sf):
    return rounded(profile.correlation_matrix(table(spark, sf, "lineitem"), CORR_COLUMNS))


# ------------------------------------------------------------------------------------ cleaning

_REPEATED = "(select * from lineitem union all select * from lineitem where l_linenumber % 3 = 0)"


def _with_repeats(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.unionAll(li.where("l_linenumber % 3 = 0"))


@query("drop_duplicates", f"select distinct * from {_REPEATED}")
def q_drop_duplicates(spark, sf):
    return clean.drop_duplicates(_with_repeats(spark, sf))


@query("duplicate_report", f"""
with u as {_REPEATED}, d as (select distinct * from u)
select (select count(*) from u) as rows_before, (select count(*) from d) as rows_after,
       (select count(*) from u) - (select count(*) from d) as removed""")
def q_duplicate_report(spark, sf):
    return clean.duplicate_report(_with_repeats(spark, sf))


@query("drop_columns", "select * exclude (l_partkey, l_suppkey) from lineitem")
def q_drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "lineitem"), ["l_partkey", "no_such_column", "l_suppkey"])[0]


def _iqr_sql() -> str:
    ctes = ["s0 as (select " + ", ".join(IQR_COLUMNS) + " from lineitem)"]
    for k, c in enumerate(IQR_COLUMNS, start=1):
        prev = f"s{k - 1}"
        lo = f"(a{k} - 1.5::double * (b{k} - a{k}))"
        hi = f"(b{k} + 1.5::double * (b{k} - a{k}))"
        keep = f"({c} >= {lo} and {c} <= {hi})"
        ctes.append(f"q{k} as (select count(*) as n{k}, quantile_cont({c}, 0.25) as a{k}, "
                    f"quantile_cont({c}, 0.75) as b{k} from {prev})")
        ctes.append(f"m{k} as (select count(*) as r{k} from {prev}, q{k} where not coalesce({keep}, false))")
        ctes.append(f"s{k} as (select {prev}.* from {prev}, q{k}, m{k} where case when n{k} <= 3 or b{k} - a{k} = 0 "
                    f"or r{k} = 0 or r{k} >= n{k} then true else {keep} end)")
    return "with " + ",\n".join(ctes) + f"\nselect l_orderkey, l_linenumber from s{len(IQR_COLUMNS)}"


@query("iqr_filter", _iqr_sql())
def q_iqr_filter(spark, sf):
    out, _ = clean.iqr_filter(table(spark, sf, "lineitem"), 1.5, IQR_COLUMNS)
    return out.select("l_orderkey", "l_linenumber")


@query("fill_mean", f"select event_id, round(coalesce(value, avg(value) over ()), 6) as value from {EVENTS_NULLS_SQL}")
def q_fill_mean(spark, sf):
    return rounded(clean.fill_mean(events_with_nulls(spark, sf), ["value"]).select("event_id", "value"))


@query("fill_median", f"select event_id, round(coalesce(value, median(value) over ()), 6) as value from {EVENTS_NULLS_SQL}")
def q_fill_median(spark, sf):
    return rounded(clean.fill_median(events_with_nulls(spark, sf), ["value"]).select("event_id", "value"))


@query("fill_zero", f"select event_id, coalesce(value, 0.0) as value from {EVENTS_NULLS_SQL}")
def q_fill_zero(spark, sf):
    return clean.fill_zero(events_with_nulls(spark, sf), ["value"]).select("event_id", "value")


@query("fill_constant", f"select event_id, coalesce(event_type, '99') as event_type, coalesce(value, 99.0) as value "
                        f"from {EVENTS_NULLS_SQL}")
def q_fill_constant(spark, sf):
    return clean.fill_constant(events_with_nulls(spark, sf), 99, ["event_type", "value"]).select(
        "event_id", "event_type", "value")


_MODE_SQL = (f"(select event_type from {EVENTS_NULLS_SQL} where event_type is not null "
             f"group by 1 order by count(*) desc, 1 limit 1)")


@query("fill_mode", f"select event_id, coalesce(event_type, {_MODE_SQL}) as event_type from {EVENTS_NULLS_SQL}")
def q_fill_mode(spark, sf):
    return clean.fill_mode(events_with_nulls(spark, sf), ["event_type"]).select("event_id", "event_type")


@query("fill_missing", f"""
select event_id, coalesce(event_type, {_MODE_SQL}) as event_type, round(coalesce(value, avg(value) over ()), 6) as value
from {EVENTS_NULLS_SQL}""")
def q_fill_missing(spark, sf):
    out = clean.fill_missing(events_with_nulls(spark, sf), "auto", ["event_type", "value"])
    return rounded(out.select("event_id", "event_type", "value"))


@query("fill_report", f"""
select 'event_type' as "column", count(*) filter (event_type is null) as nulls_before, 0 as nulls_after,
       count(*) filter (event_type is null) as filled from {EVENTS_NULLS_SQL}
union all select 'value', count(*) filter (value is null), 0, count(*) filter (value is null) from {EVENTS_NULLS_SQL}""")
def q_fill_report(spark, sf):
    before = events_with_nulls(spark, sf)
    return clean.fill_report(before, clean.fill_missing(before, "auto", ["event_type", "value"]), ["event_type", "value"])


@query("fill_forward", f"""
select event_id, last_value(value ignore nulls) over (order by ts, event_id
       rows between unbounded preceding and current row) as value from {EVENTS_NULLS_SQL}""")
def q_fill_forward(spark, sf):
    return clean.fill_forward(events_with_nulls(spark, sf), ["value"], ["ts", "event_id"]).select("event_id", "value")


@query("fill_backward", f"""
select event_id, first_value(value ignore nulls) over (order by ts, event_id
       rows between current row and unbounded following) as value from {EVENTS_NULLS_SQL}""")
def q_fill_backward(spark, sf):
    return clean.fill_backward(events_with_nulls(spark, sf), ["value"], ["ts", "event_id"]).select("event_id", "value")


@query("fill_forward_series", f"""
select event_id, last_value(value ignore nulls) over (partition by user_id order by ts, event_id
       rows between unbounded preceding and current row) as value from {EVENTS_NULLS_SQL}""")
def q_fill_forward_series(spark, sf):
    return clean.fill_forward(events_with_nulls(spark, sf), ["value"], ["ts", "event_id"], ["user_id"]).select(
        "event_id", "value")


_NONFINITE_SQL = """
(select event_id, case when event_id % 7 = 0 then 'nan'::double when event_id % 11 = 0 then 'inf'::double
                       when event_id % 13 = 0 then '-inf'::double else value end as value from events)"""


def _events_nonfinite(spark, sf):
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan")))
                     .when(F.col("event_id") % 11 == 0, F.lit(float("inf")))
                     .when(F.col("event_id") % 13 == 0, F.lit(float("-inf")))
                     .otherwise(F.col("value")).alias("value"))


@query("nan_to_zero", f"""
select event_id, case when isnan(value) then 0.0 when value = 'inf'::double then 1.7976931348623157e308
                      when value = '-inf'::double then -1.7976931348623157e308 else value end as value
from {_NONFINITE_SQL}""")
def q_nan_to_zero(spark, sf):
    return clean.nan_to_zero(_events_nonfinite(spark, sf), ["value"])


@query("nonfinite_to_null", f"""
select event_id, case when isnan(value) or isinf(value) then null else value end as value from {_NONFINITE_SQL}""")
def q_nonfinite_to_null(spark, sf):
    return clean.nonfinite_to_null_all(_events_nonfinite(spark, sf), ["value"])


@query("interpolate_linear", f"""
with e as (select *, row_number() over (partition by user_id order by ts, event_id) as i from {EVENTS_NULLS_SQL}),
f as (select *,
  last_value(case when value is not null then i end ignore nulls) over
      (partition by user_id order by i rows between unbounded preceding and current row) as pi,
  last_value(value ignore nulls) over
      (partition by user_id order by i rows between unbounded preceding and current row) as pv,
  first_value(case when value is not null then i end ignore nulls) over
      (partition by user_id order by i rows between current row and unbounded following) as ni,
  first_value(value ignore nulls) over
      (partition by user_id order by i rows between current row and unbounded following) as nv
  from e)
select event_id, round(case when value is not null then value when pi is null then nv when ni is null then pv
                            else pv + (nv - pv) * (i - pi) / (ni - pi) end, 6) as value from f""")
def q_interpolate_linear(spark, sf):
    out = clean.interpolate_linear(events_with_nulls(spark, sf), ["value"], ["ts", "event_id"], ["user_id"])
    return rounded(out.select("event_id", "value"))


@query("subsample", """
with e as (select event_id, row_number() over (partition by user_id order by ts, event_id) - 1 as pos,
                  count(*) over (partition by user_id) as len from events)
select event_id from e where len <= 64 or pos % 2 = 0""")
def q_subsample(spark, sf):
    return clean.subsample(table(spark, sf, "events").select("event_id", "ts", "user_id"), ["ts", "event_id"], ["user_id"], limit=64, factor=2).select(
        "event_id")


# ------------------------------------------------------------------------------------ scaling

_CHRONO_SQL = """(select *, row_number() over (order by ts, event_id) - 1 as i, count(*) over () as n from events)"""


def _chrono_train_scaler(spark, sf, method):
    ev = table(spark, sf, "events").select("event_id", "ts", "value")
    indexed, n = with_row_index(ev, ["ts", "event_id"])
    train, _, _ = split.chronological_split(indexed, n, 0.2)
    params = scale.fit_scaler(train, ["value"], method)
    return rounded(scale.apply_scaler(indexed, params).select("event_id", "value"))


@query("scaler_minmax", f"""
with e as {_CHRONO_SQL},
p as (select min(value) as lo, max(value) as hi from e where i < cast(floor(n * (1 - 0.2::double)) as bigint))
select event_id, round((value - lo) / case when hi - lo = 0 then 1 else hi - lo end, 6) as value from e, p""")
def q_scaler_minmax(spark, sf):
    return _chrono_train_scaler(spark, sf, "minmax")


@query("scaler_mean", f"""
with e as {_CHRONO_SQL},
p as (select avg(value) as m, stddev_pop(value) as s from e where i < cast(floor(n * (1 - 0.2::double)) as bigint))
select event_id, round((value - m) / case when s = 0 then 1 else s end, 6) as value from e, p""")
def q_scaler_mean(spark, sf):
    return _chrono_train_scaler(spark, sf, "mean")


_WEIGHTED_SQL = f"""
with h as {HOURLY_SQL},
e as (select *, row_number() over (order by hour) - 1 as i, count(*) over () as cnt from h),
w as (select *, greatest(0, least(i, cnt - 24 - 1) - greatest(0, i - 24 + 1) + 1) as wt from e)"""


@query("scaler_windowed_mean", _WEIGHTED_SQL + """,
m as (select sum(wt * value) / sum(wt) as mv, sum(wt * n) / sum(wt) as mn, sum(wt) as sw from w where wt > 0),
v as (select sum(wt * (value - mv) * (value - mv)) / sw as vv, sum(wt * (n - mn) * (n - mn)) / sw as vn
      from w, m where wt > 0 group by sw)
select 'value' as "column", round(mv, 6) as mean, round(sqrt(vv), 6) as std from m, v
union all
select 'n', round(mn, 6), round(sqrt(vn), 6) from m, v""")
def q_scaler_windowed_mean(spark, sf):
    h = hourly_events(spark, sf)
    indexed, n = with_row_index(h, ["hour"])
    p = scale.fit_scaler_windowed(indexed, ["value", "n"], n, 24, 1, "mean")
    return rounded(spark.createDataFrame([(c, p.mean[i], p.std[i]) for i, c in enumerate(p.columns)],
                                         "column string, mean double, std double"))


@query("scaler_windowed_minmax", _WEIGHTED_SQL + """
select 'value' as "column", round(min(value), 6) as min, round(max(value), 6) as max from w where wt > 0
union all
select 'n', round(min(n), 6), round(max(n), 6) from w where wt > 0""")
def q_scaler_windowed_minmax(spark, sf):
    h = hourly_events(spark, sf)
    indexed, n = with_row_index(h, ["hour"])
    p = scale.fit_scaler_windowed(indexed, ["value", "n"], n, 24, 1, "minmax")
    return rounded(spark.createDataFrame([(c, float(p.min[i]), float(p.max[i])) for i, c in enumerate(p.columns)],
                                         "column string, min double, max double"))


@query("standard_scale", f"""
with h as {HOURLY_SQL},
e as (select *, row_number() over (order by hour) - 1 as i, count(*) over () as cnt from h),
p as (select avg(value) as mv, stddev_pop(value) as sv, avg(n) as mn, stddev_pop(n) as sn
      from e where i < floor(cnt * 0.7::double))
select hour, round((value - mv) / case when sv = 0 then 1 else sv end, 6) as value,
       round((n - mn) / case when sn = 0 then 1 else sn end, 6) as n from e, p""")
def q_standard_scale(spark, sf):
    h = hourly_events(spark, sf)
    indexed, n = with_row_index(h, ["hour"])
    rng = split.border_ranges(n, 0)
    train = indexed.where(F.col("row_idx") < rng["train"][1])
    out, _ = scale.standard_scale(indexed, ["value", "n"], fit_on=train)
    return rounded(out.select("hour", "value", "n"))


@query("series_normalize_standardization", """
select event_id, round((value - avg(value) over ()) / (stddev_samp(value) over () + 2.220446049250313e-16), 6) as value
from events""")
def q_series_norm_std(spark, sf):
    out, _ = scale.series_normalize(table(spark, sf, "events"), ["value"], "standardization")
    return rounded(out.select("event_id", "value"))


@query("series_normalize_minmax", """
select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over () + 2.220446049250313e-16), 6)
       as value from events""")
def q_series_norm_minmax(spark, sf):
    out, _ = scale.series_normalize(table(spark, sf, "events"), ["value"], "minmax")
    return rounded(out.select("event_id", "value"))


@query("series_normalize_per_sample_std", """
select event_id, round((value - avg(value) over (partition by user_id)) / stddev_samp(value) over (partition by user_id), 6)
       as value from events""")
def q_series_norm_ps_std(spark, sf):
    out, _ = scale.series_normalize(table(spark, sf, "events"), ["value"], "per_sample_std", ["user_id"])
    return rounded(out.select("event_id", "value"))


@query("series_normalize_per_sample_minmax", """
select event_id, round((value - min(value) over (partition by user_id)) /
       (max(value) over (partition by user_id) - min(value) over (partition by user_id) + 2.220446049250313e-16), 6)
       as value from events""")
def q_series_norm_ps_minmax(spark, sf):
    out, _ = scale.series_normalize(table(spark, sf, "events"), ["value"], "per_sample_minmax", ["user_id"])
    return rounded(out.select("event_id", "value"))


# ------------------------------------------------------------------------------------ time

def _parse_time_sql(first: str, second: str) -> str:
    return f"""
with s as (select event_id, case event_id % 3 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S')
                                 when 1 then strftime(ts, '%m/%d/%Y %H:%M:%S') else strftime(ts, '%d-%m-%Y %H:%M') end as s from events)
select event_id, coalesce(try_strptime(s, '%Y-%m-%d %H:%M:%S'), try_strptime(s, '{first}/%Y %H:%M:%S'), try_strptime(s, '{second}/%Y %H:%M:%S'),
                          try_strptime(s, '{first.replace('/', '-')}-%Y %H:%M'), try_strptime(s, '{second.replace('/', '-')}-%Y %H:%M')) as ts from s"""


def _parsed(spark, sf, day_first: bool) -> DataFrame:
    """ISO, slashed and dashed texts: those with a day up to 12 can be read in two ways."""
    ev = table(spark, sf, "events")
    s = (F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
         .when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy HH:mm:ss")).otherwise(F.date_format("ts", "dd-MM-yyyy HH:mm")))
    return ev.select("event_id", timefeat.parse_time(s, day_first=day_first).alias("ts"))


@query("parse_time", _parse_time_sql("%m/%d", "%d/%m"))
def q_parse_time(spark, sf):
    return _parsed(spark, sf, False)


@query("parse_time_day_first", _parse_time_sql("%d/%m", "%m/%d"))
def q_parse_time_day_first(spark, sf):
    return _parsed(spark, sf, True)


@query("infer_granularity", f"""
with a as (select epoch(ts) - lag(epoch(ts)) over (order by ts) as gap from events),
b as (select epoch(hour) - lag(epoch(hour)) over (order by hour) as gap from {HOURLY_SQL}),
c as (select epoch(d) - lag(epoch(d)) over (order by d) as gap from (select distinct o_orderdate as d from orders)),
g as (select 'events' as source, median(gap) as median_gap from a
      union all select 'events_hourly', median(gap) from b
      union all select 'order_days', median(gap) from c)
select source, round(median_gap, 6) as median_gap,
       case when median_gap >= 2419200 then 'month' when median_gap >= 86400 then 'day'
            when median_gap >= 3600 then 'hour' else 'minute' end as granularity from g""")
def q_infer_granularity(spark, sf):
    ev = table(spark, sf, "events")
    days = table(spark, sf, "orders").select(F.col("o_orderdate").alias("d")).distinct()
    rows = []
    for name, df, c in [("events", ev, "ts"), ("events_hourly", hourly_events(spark, sf), "hour"), ("order_days", days, "d")]:
        gap = timefeat.median_gap_seconds(df, c)
        rows.append((name, gap, timefeat.granularity_from_gap(gap)))
    return rounded(spark.createDataFrame(rows, "source string, median_gap double, granularity string"))


@query("time_encoding", f"""
select hour as t, round((year(hour) - 2000) / 100.0, 6) as year, round(month(hour) / 12.0, 6) as month,
       round(day(hour) / 31.0, 6) as day, round((isodow(hour) - 1) / 7.0, 6) as weekday,
       round(hour(hour) / 23.0, 6) as hour from {HOURLY_SQL}""")
def q_time_encoding(spark, sf):
    h = hourly_events(spark, sf).select(F.col("hour").alias("t"))
    out, names, gran = timefeat.time_encoding(h, "t", "auto")
    return rounded(out.select("t", *names))


@query("calendar_marks", """
select event_id, month(ts) as month, day(ts) as day, isodow(ts) - 1 as weekday, hour(ts) as hour,
       minute(ts) // 15 as minute from events""")
def q_calendar_marks(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "ts")
    return timefeat.calendar_marks(ev, "ts", freq="t").drop("ts")


@query("sort_chronologically", "select event_id, row_number() over (order by ts, event_id) - 1 as row_idx from events")
def q_sort_chronologically(spark, sf):
    out, _ = timefeat.sort_chronologically(table(spark, sf, "events").select("event_id", "ts"), "ts", ["event_id"])
    return out.select("event_id", "row_idx")


# ------------------------------------------------------------------------------------ encoding

@query("label_dictionary", f"""
select label, cast(row_number() over (order by label) - 1 as integer) as code
from (select distinct coalesce(event_type, 'nan') as label from {EVENTS_NULLS_SQL})""")
def q_label_dictionary(spark, sf):
    return features.fit_label_encoder(events_with_nulls(spark, sf), "event_type").table


@query("label_encode", """
select l_orderkey, l_linenumber, cast(dense_rank() over (order by l_returnflag) - 1 as integer) as l_returnflag
from lineitem""")
def q_label_encode(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    d = features.fit_label_encoder(li, "l_returnflag")
    return features.label_encode(li, d)


@query("label_decode", f"""
select event_id, cast(dense_rank() over (order by coalesce(event_type, 'nan')) - 1 as integer) as code,
       coalesce(event_type, 'nan') as label from {EVENTS_NULLS_SQL}""")
def q_label_decode(spark, sf):
    ev = events_with_nulls(spark, sf).select("event_id", "event_type")
    d = features.fit_label_encoder(ev, "event_type")
    coded = features.label_encode(ev, d, out_col="code").select("event_id", "code")
    return features.label_decode(coded, d, "code", "label")


@query("infer_task")
def q_infer_task(spark, sf):
    cu = table(spark, sf, "customer")
    rows = [(t, *features.infer_task(cu, t)) for t in ["c_mktsegment", "c_acctbal"]]
    return spark.createDataFrame(rows, "target string, task_type string, n_classes bigint")


ORACLE["infer_task"] = """
select 'c_mktsegment' as target, 'classification' as task_type, count(distinct coalesce(c_mktsegment, 'nan')) as n_classes
from customer
union all select 'c_acctbal', 'regression', 1"""


@query("assemble_features", """
with e as (select c_custkey, cast(c_custkey as double) as f0, cast(c_nationkey as double) as f1,
                  cast(dense_rank() over (order by coalesce(c_name, 'nan')) - 1 as double) as f2,
                  cast(dense_rank() over (order by coalesce(c_mktsegment, 'nan')) - 1 as double) as f3 from customer)
select c_custkey, 0 as pos, f0 as value from e union all select c_custkey, 1, f1 from e
union all select c_custkey, 2, f2 from e union all select c_custkey, 3, f3 from e""")
def q_assemble_features(spark, sf):
    cu = table(spark, sf, "customer")
    out, names, _ = features.assemble_features(cu, "c_acctbal")
    assert names == ["c_custkey", "c_nationkey", "c_name", "c_mktsegment"], names
    return out.select("c_custkey", F.posexplode("features").alias("pos", "value"))


# ------------------------------------------------------------------------------------ splitting

_MD5_LINEITEM = ("row_number() over (order by md5(concat_ws(':', cast(l_orderkey as varchar), "
                 "cast(l_linenumber as varchar), '42')), l_orderkey, l_linenumber) - 1")


@query("random_split", f"""
with r as (select l_orderkey, l_linenumber, {_MD5_LINEITEM} as ri, count(*) over () as n from lineitem)
select l_orderkey, l_linenumber, case when ri < ceil(n * 0.2::double) then 'test' else 'train' end as side from r""")
def q_random_split(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return split.random_split_labels(li, ["l_orderkey", "l_linenumber"], 0.2, 42)


@query("chronological_split", f"""
with e as {_CHRONO_SQL}
select event_id, case when i < cast(floor(n * (1 - 0.2::double)) as bigint) then 'train' else 'test' end as side,
       case when i < cast(floor(n * (1 - 0.2::double)) as bigint) then i else i - cast(floor(n * (1 - 0.2::double)) as bigint) end as side_idx from e""")
def q_chronological_split(spark, sf):
    indexed, n = with_row_index(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"])
    train, test, _ = split.chronological_split(indexed, n, 0.2)
    a = train.select("event_id", F.lit("train").alias("side"), F.col("row_idx").alias("side_idx"))
    b = test.select("event_id", F.lit("test").alias("side"), F.col("row_idx").alias("side_idx"))
    return a.unionByName(b)


@query("border_split", f"""
with h as {HOURLY_SQL},
e as (select hour, row_number() over (order by hour) - 1 as i, count(*) over () as n from h),
b as (select *, cast(floor(n * 0.7::double) as bigint) as ntr, cast(floor(n * 0.2::double) as bigint) as nte from e)
select hour, 'train' as side, i as side_idx from b where i < ntr
union all select hour, 'val', i - (ntr - 24) from b where i >= ntr - 24 and i < n - nte
union all select hour, 'test', i - (n - nte - 24) from b where i >= n - nte - 24""")
def q_border_split(spark, sf):
    indexed, n = with_row_index(hourly_events(spark, sf), ["hour"])
    return split.border_split(indexed, n, 24).select("hour", "side", "side_idx")


@query("fixed_border_split", """
with d as (select 2 * event_id + k as event_id, ts from events, range(0, 2) r(k)),
e as (select event_id, row_number() over (order by ts, event_id) - 1 as i from d)
select event_id, 'train' as side, i as side_idx from e where i < 8640
union all select event_id, 'val', i - (8640 - 24) from e where i >= 8640 - 24 and i < 8640 + 2880
union all select event_id, 'test', i - (11520 - 24) from e where i >= 11520 - 24 and i < 14400""")
def q_fixed_border_split(spark, sf):
    """Each event twice, so that every side has rows at the checked scale factor."""
    ev = table(spark, sf, "events").select("ts", F.explode(F.array(F.col("event_id") * 2, F.col("event_id") * 2 + 1)).alias("event_id"))
    indexed, _ = with_row_index(ev, ["ts", "event_id"])
    return split.fixed_border_split(indexed, "hourly", 24).select("event_id", "side", "side_idx")


@query("tail_holdout", f"""
with e as {_CHRONO_SQL}
select event_id, i - cast(floor(n * 0.8::double) as bigint) as row_idx from e where i >= cast(floor(n * 0.8::double) as bigint)""")
def q_tail_holdout(spark, sf):
    indexed, n = with_row_index(table(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"])
    return split.tail_holdout(indexed, n, 0.8).select("event_id", "row_idx")


_FOLD_SQL = f"""
with r as (select l_orderkey, l_linenumber, {_MD5_LINEITEM} as ri, count(*) over () as n from lineitem),
q as (select *, n // 5 as q, n % 5 as rem from r)
select l_orderkey, l_linenumber,
       cast(case when ri < rem * (q + 1) then ri // (q + 1) else rem + (ri - rem * (q + 1)) // q end as integer) as fold
from q"""


@query("kfold", _FOLD_SQL)
def q_kfold(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return split.kfold(li, ["l_orderkey", "l_linenumber"], 5, 42)


@query("fold_holdout", f"""
with f as ({_FOLD_SQL}),
rest as (select *, row_number() over (order by md5(concat_ws(':', cast(l_orderkey as varchar),
         cast(l_linenumber as varchar), '42')), l_orderkey, l_linenumber) - 1 as ri, count(*) over () as n
         from f where fold <> 0)
select l_orderkey, l_linenumber, 'test' as side from f where fold = 0
union all
select l_orderkey, l_linenumber, case when ri < ceil(n * 0.2::double) then 'val' else 'train' end from rest""")
def q_fold_holdout(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    folded = split.kfold(li, ["l_orderkey", "l_linenumber"], 5, 42)
    train, val, test = split.fold_holdout(folded, 0, ["l_orderkey", "l_linenumber"])
    cols = ["l_orderkey", "l_linenumber"]
    return (test.select(*cols, F.lit("test").alias("side"))
            .unionByName(val.select(*cols, F.lit("val").alias("side")))
            .unionByName(train.select(*cols, F.lit("train").alias("side"))))


@query("limit_series", """
select event_id from events where user_id in (select distinct user_id from events order by user_id limit 50)""")
def q_limit_series(spark, sf):
    return split.limit_series(table(spark, sf, "events"), "user_id", 50).select("event_id")
