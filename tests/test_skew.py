"""A third of all rows in one series: results stay exact and no task holds the hot series."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.operators import clean, windows
from tidepool.plans.order import halo_frames, with_row_index

from .conftest import SF_CHECK


def _skewed(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet").select("event_id", "ts", "user_id", "value")
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    return ev.select("event_id", "ts", hot.alias("user_id"),
                     F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")).alias("value"))


def test_hot_series_fill_is_exact(spark):
    df = _skewed(spark)
    got = clean.fill_forward(df, ["value"], ["ts", "event_id"], ["user_id"], bucket_rows=256)
    exp = df.select("event_id", F.last("value", True).over(
        Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)).alias("e"))
    assert got.join(exp, "event_id").where(~F.col("e").eqNullSafe(F.col("value"))).count() == 0


def test_hot_series_windows_are_exact_and_bucketed(spark):
    df = _skewed(spark)
    w = windows.sliding_windows(df, 8, 2, ["ts", "event_id"], ["value"], "value", ["user_id"], bucket_rows=256)
    naive = df.withColumn("x", F.collect_list("event_id").over(
        Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 9))).where(F.size("x") == 10)
    assert w.count() == naive.count()
    # the hot series is spread over many buckets, each bounded by bucket size + halo
    idx, n = with_row_index(df, ["user_id", "ts", "event_id"])
    hot_rows = df.where(F.col("user_id") == -1).count()
    assert hot_rows > n // 4
    staged = halo_frames(idx, 10, {"v": F.col("value")}, partition_by=["user_id"], bucket_rows=256)
    assert staged.count() == naive.count()
    b = F.floor(F.col("row_idx") / 256)
    per_bucket = idx.groupBy(b.alias("b")).count().agg(F.max("count")).first()[0]
    assert per_bucket <= 256


def test_salted_dictionary_join_keeps_unseen_labels(spark, monkeypatch):
    from tidepool.operators import features
    from tidepool.plans.order import join_group_stats

    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet").select("event_id", "event_type")
    d = features.fit_label_encoder(ev, "event_type")
    expected = features.label_encode(ev, d, out_col="code")
    monkeypatch.setattr(features, "MAX_BROADCAST_BYTES", -1)  # force the salted path
    extra = ev.limit(1).withColumn("event_type", F.lit("unseen"))
    got = features.label_encode(ev.unionByName(extra), d, out_col="code")
    assert got.count() == ev.count() + 1 and got.where(F.col("code").isNull()).count() == 1
    assert expected.exceptAll(got.where(F.col("event_type") != "unseen")).count() == 0
    stats = ev.groupBy("event_type").count()
    assert join_group_stats(ev, stats, ["event_type"]).count() == ev.count()


def test_hot_groups_are_salted_and_others_are_not(spark):
    from tidepool.plans.order import join_group_stats

    df = spark.range(600).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    stats = df.groupBy("k").agg(F.sum("v").alias("s"))
    exact = sorted((r.v, r.s) for r in join_group_stats(df, stats, ["k"]).collect())
    salted = join_group_stats(df, stats, ["k"], salt=4, hot_rows=100)
    assert sorted((r.v, r.s) for r in salted.collect()) == exact and len(exact) == 600
