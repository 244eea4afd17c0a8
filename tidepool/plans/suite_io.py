"""Checked queries for sources, sinks and loaders. Round trips write data Spark derives from the
driver's tables into the session's checkpoint folder (a shared folder on a cluster) and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import evaluate, series, split
from tidepool.plans.suite import query, rounded, table
from tidepool.session import scratch_folder
from tidepool.sources import io

_LI_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"]
_LI_SQL = "select l_orderkey, l_linenumber, l_quantity, l_returnflag from lineitem"


def _scratch(spark, name: str) -> str:
    return f"{scratch_folder(spark, 'io')}/{name}"


@query("read_table_csv", _LI_SQL)
def q_read_table_csv(spark, sf):
    path = _scratch(spark, "csv")
    table(spark, sf, "lineitem").select(*_LI_COLS).write.option("header", True).csv(path)
    # a directory of CSV parts: the format is given, charset detection and inference run as for a file
    return io.read_table(spark, path, fmt="csv")


def _names_sql(text: str) -> str:
    return f"select l_orderkey, l_linenumber, {text} as label from lineitem"


def _names(spark, sf, prefix: str, suffix: str = "") -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.concat(F.lit(prefix), "l_returnflag", F.lit(suffix)).alias("label"))


@query("read_csv_latin1", _names_sql("'é×ü-' || l_returnflag"))
def q_read_csv_latin1(spark, sf):
    path = _scratch(spark, "latin1")
    _names(spark, sf, "é×ü-").write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return io.read_table(spark, path, fmt="csv")


@query("read_csv_gb18030", _names_sql("'数据' || l_returnflag || '鎔镕㐀'"))
def q_read_csv_gb18030(spark, sf):
    """Bytes of GB18030, some outside GBK; a session of its own lets Spark's writer use that charset."""
    path = _scratch(spark, "gb18030")
    writer = spark.newSession()
    writer.conf.set("spark.sql.legacy.javaCharsets", "true")
    _names(writer, sf, "数据", "鎔镕㐀").write.option("header", True).option("encoding", "GB18030").csv(path)
    return io.read_table(spark, path, fmt="csv")


@query("read_csv_multiline", _names_sql("'line one' || chr(10) || 'line \"two\", ' || l_returnflag"))
def q_read_csv_multiline(spark, sf):
    path = _scratch(spark, "multiline")
    _names(spark, sf, 'line one\nline "two", ').write.option("header", True).option("escape", '"').csv(path)
    return io.read_table(spark, path, fmt="csv")


@query("m4_select_group", """
with u as (select user_id, list(value order by event_id) as vs from events where user_id % 6 = 2 and event_id % 7 <> 0 and event_id % 5 <> 0 group by 1)
select cast(user_id as varchar) as M4id, round(list_sum(vs), 6) as total, len(vs) as n from u""")
def q_m4_select_group(spark, sf):
    """Value arrays with nulls and NaN in them, as the source's padded rows have."""
    ev = table(spark, sf, "events")
    v = F.when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value"))
    pattern = F.element_at(F.array(*[F.lit(p) for p in _PATTERNS]), (F.col("user_id") % 6 + 1).cast("int"))
    items = ev.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", v.alias("v")))).alias("it"))
    rows = items.select(F.col("user_id").cast("string").alias("M4id"), pattern.alias("SP"), F.transform("it", lambda s: s["v"]).alias("values"))
    group = io.m4_select_group(rows, "Monthly").where(F.size("values") > 0)
    return rounded(group.select("M4id", F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("total"), F.size("values").alias("n")))


@query("read_matching", _LI_SQL)
def q_read_matching(spark, sf):
    path = _scratch(spark, "parts")
    table(spark, sf, "lineitem").select(*_LI_COLS).write.option("header", True).csv(path)
    return io.read_matching(spark, path, r"part-\d+", ".csv", header=True, inferSchema=True).drop("source_file")


@query("read_first_supported", _LI_SQL)
def q_read_first_supported(spark, sf):
    path = _scratch(spark, "first")
    rows = table(spark, sf, "lineitem").select(*_LI_COLS)
    rows.limit(5).write.parquet(f"{path}/a.unknown")  # skipped: not a format that the reader knows
    rows.write.option("header", True).csv(f"{path}/b.csv")
    return io.read_first_supported(spark, path)


@query("write_dataset", _LI_SQL)
def q_write_dataset(spark, sf):
    root = _scratch(spark, "datasets")
    path = io.write_dataset(table(spark, sf, "lineitem").select(*_LI_COLS), root, "lineitem_clean")
    return spark.read.parquet(path)


_MD5 = ("row_number() over (order by md5(concat_ws(':', cast(l_orderkey as varchar), cast(l_linenumber as varchar), "
        "'42')), l_orderkey, l_linenumber) - 1")


@query("save_load_split", f"""
with r as (select l_orderkey, l_linenumber, {_MD5} as ri, count(*) over () as n from lineitem)
select l_orderkey, l_linenumber, case when ri < ceil(n * 0.2::double) then 'test' else 'train' end as side from r""")
def q_save_load_split(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    train, test = split.random_split(li, ["l_orderkey", "l_linenumber"], 0.2, 42)
    root = _scratch(spark, "split")
    io.save_split(train, test, {"task_type": "regression", "feature_names": ["l_linenumber"]}, root)
    tr, te, meta = io.load_split(spark, root)
    assert meta["task_type"] == "regression"
    return tr.withColumn("side", F.lit("train")).unionByName(te.withColumn("side", F.lit("test")))


_ANOMALY_SQL = """
with e as (select event_id, value, case when event_type = 'error' then 1 else 0 end as lab from events),
tr as (select value, row_number() over (order by event_id) - 1 as i, count(*) over () as n from e where event_id % 3 <> 0),
te as (select value, lab, row_number() over (order by event_id) - 1 as row_idx from e where event_id % 3 = 0),
p as (select avg(value) as m, case when stddev_pop(value) = 0 then 1 else stddev_pop(value) end as s from tr)
"""


def _anomaly_sides(spark, sf):
    """Train on two thirds of the events, test on the others, labels beside."""
    ev = table(spark, sf, "events")
    train, test = ev.where("event_id % 3 <> 0").select("event_id", "value"), ev.where("event_id % 3 = 0")
    labels = test.select("event_id", F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"))
    return train, test.select("event_id", "value"), labels


@query("load_anomaly_triplet", _ANOMALY_SQL + "select row_idx, round((value - m) / s, 6) as value, lab as label from te, p")
def q_load_anomaly_triplet(spark, sf):
    train, test, labels = _anomaly_sides(spark, sf)
    _, _, scaled = io.load_anomaly_triplet(train, test, labels, "event_id")
    return rounded(scaled.select("row_idx", "value", "label"))


@query("anomaly_validation_tail", _ANOMALY_SQL + """
select i - cast(floor(n * 0.8::double) as bigint) as row_idx, round((value - m) / s, 6) as value
from tr, p where i >= cast(floor(n * 0.8::double) as bigint)""")
def q_anomaly_validation_tail(spark, sf):
    train, test, _ = _anomaly_sides(spark, sf)
    _, val, _ = io.load_anomaly_triplet(train, test, None, "event_id")
    return rounded(val.select("row_idx", "value"))


_PATTERNS = ["Yearly", "Quarterly", "Monthly", "Weekly", "Daily", "Hourly"]


def _m4_like(spark, sf) -> DataFrame:
    ev = table(spark, sf, "events")
    pattern = F.element_at(F.array(*[F.lit(p) for p in _PATTERNS]), (F.col("user_id") % 6 + 1).cast("int"))
    return ev.groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("user_id").cast("string").alias("M4id"), pattern.alias("SP"), "n")


@query("m4_lookup", """
with u as (select cast(user_id as varchar) as M4id,
                  case user_id % 6 when 0 then 'Yearly' when 1 then 'Quarterly' when 2 then 'Monthly'
                       when 3 then 'Weekly' when 4 then 'Daily' else 'Hourly' end as SP, count(*) as n
           from events group by user_id)
select M4id, SP, n,
       case SP when 'Yearly' then 6 when 'Quarterly' then 8 when 'Monthly' then 18 when 'Weekly' then 13
               when 'Daily' then 14 else 48 end as horizon,
       case SP when 'Quarterly' then 4 when 'Monthly' then 12 when 'Hourly' then 24 else 1 end as frequency,
       case when SP in ('Yearly', 'Quarterly', 'Monthly') then 1.5::double else 10.0::double end as history_size
from u""")
def q_m4_lookup(spark, sf):
    return io.m4_lookup(_m4_like(spark, sf))


_EPOCHS_SQL = ("(select user_id % 20 as epoch, avg(value) as train_loss, min(value) as val_loss, max(value) as train_metric, "
               "stddev_pop(value) as val_metric, count(*) / 8.0 as seconds from events group by 1)")


def _epochs(spark, sf) -> DataFrame:
    """A per-epoch table: the statistics of twenty groups of users."""
    return (table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("epoch"))
            .agg(F.avg("value").alias("train_loss"), F.min("value").alias("val_loss"), F.max("value").alias("train_metric"),
                 F.stddev_pop("value").alias("val_metric"), (F.count("*") / 8.0).alias("seconds")))


@query("training_history", f"""
select count(*) as epochs, round(max_by(train_loss, epoch), 6) as final_train_loss, round(max_by(val_loss, epoch), 6) as final_val_loss,
       round(max_by(train_metric, epoch), 6) as final_train_metric, round(max_by(val_metric, epoch), 6) as final_val_metric,
       round(avg(seconds), 2) as avg_epoch_seconds from {_EPOCHS_SQL}""")
def q_training_history(spark, sf):
    return evaluate.training_history(_epochs(spark, sf))


@query("write_history", f"""
select epoch, round(train_loss, 6) as train_loss, round(val_loss, 6) as val_loss, round(train_metric, 6) as train_metric,
       round(val_metric, 6) as val_metric from {_EPOCHS_SQL}""")
def q_write_history(spark, sf):
    path = _scratch(spark, "history")
    io.write_history(_epochs(spark, sf), path)
    schema = "epoch bigint, train_loss double, val_loss double, train_metric double, val_metric double"
    return rounded(spark.read.option("header", True).schema(schema).csv(path))


def _gauss_sql(tag: str, pos: str = "") -> str:
    def uniform(u: str) -> str:
        return f"cast(('0x' || substr(md5(concat_ws(':', '42', '{tag}', cast(vec_id as varchar), {pos}'{u}')), 1, 13))::bigint as double)"
    return f"sqrt(-2.0 * ln(({uniform('u1')} + 1.0) / 4503599627370497.0)) * cos(2 * pi() * ({uniform('u2')} / 4503599627370496.0))"


@query("augment", f"""
with e as (select vec_id, t - 1 as t, cast(v as double) as v from embeddings, unnest(embedding) with ordinality as u(v, t))
select vec_id, t, round(v * ({_gauss_sql('scale')} * 0.1 + 1.0) + {_gauss_sql('shift')} * 0.1
                        + {_gauss_sql('jitter', 'cast(t as varchar), ')} * 0.1, 6) as val from e""")
def q_augment(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    a = e.select("vec_id", series.augment("x", 0.1, 42, F.col("vec_id")).alias("a"))
    return rounded(a.select("vec_id", F.posexplode_outer("a").alias("t", "val")))
