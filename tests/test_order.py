import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidepool.plans import order
from tidepool.plans.order import Desc, fill_ordered, halo_frames, with_prefix_sums, with_row_index, with_series_position

from .conftest import SF_CHECK


def _events(spark):
    ev = spark.read.parquet(f"{SF_CHECK}/events.parquet")
    return ev.withColumn("v", F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")))


def test_row_index_equals_row_number(spark):
    ev = _events(spark)
    idx, n = with_row_index(ev, ["ts", "event_id"], num_partitions=7)
    naive = ev.withColumn("rn", F.row_number().over(Window.orderBy("ts", "event_id")) - 1)
    assert n == ev.count()
    assert idx.join(naive, "event_id").where(F.col("rn") != F.col("row_idx")).count() == 0
    assert sorted(r[0] for r in idx.select("row_idx").collect()) == list(range(n))


@pytest.mark.parametrize("runs", [2, 4096])
def test_many_ranges_use_an_offset_table(spark, monkeypatch, runs):
    """Above the bound on literals no offset reaches the plan or the driver, and the index is the same."""
    ev = _events(spark)
    few, n = with_row_index(ev, ["ts", "event_id"], num_partitions=6)
    monkeypatch.setattr(order, "MAX_LITERAL_OFFSETS", 2)
    monkeypatch.setattr(order, "RANGES_PER_RUN", runs)
    for parts in (6, 150):
        many, m = with_row_index(ev, ["ts", "event_id"], num_partitions=parts)
        assert m == n and many.join(few.select("event_id", F.col("row_idx").alias("i")), "event_id").where("i = row_idx").count() == n
        many._jdf.queryExecution().optimizedPlan().toString()
        assert "array(" not in many._jdf.queryExecution().analyzed().toString()
    sums = with_prefix_sums(ev.select("event_id", F.lit(1).alias("one"), F.lit(0.5).alias("half")), ["event_id"], ["one", "half"], num_partitions=9)
    assert sums.where("one_cum <> event_id + 1 or half_cum <> (event_id + 1) / 2").count() == 0


def test_partition_count_follows_counted_bytes(spark, monkeypatch):
    li = spark.read.parquet(f"{SF_CHECK}/lineitem.parquet")
    rows, size = order.counted(li)
    assert rows == li.count() and 8 * rows * len(li.columns) < size < 40 * rows * len(li.columns)
    base = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert order.target_partitions(li) == base
    monkeypatch.setattr(order, "TARGET_PARTITION_BYTES", 1 << 18)
    assert order.target_partitions(li) == -(-size // (1 << 18)) > base


def test_a_join_does_not_inflate_the_partition_count(spark):
    """600,000 rows after a join of two tables are a few ranges, not the product of the tables' sizes."""
    sf = "/root/testdata/sf0.1"
    joined = spark.read.parquet(f"{sf}/lineitem.parquet").join(spark.read.parquet(f"{sf}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows, size = order.counted(joined)
    assert rows == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    assert order.target_partitions(joined, (rows, size)) <= 32
    idx, n = with_row_index(joined.select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])
    filled = fill_ordered(idx, ["l_quantity"], n_rows=n)
    assert n == rows and filled._jdf.queryExecution().toRdd().getNumPartitions() <= 64


def test_rows_are_stored_with_any_column_names_and_types(spark):
    df = spark.sql("select id, id as `Id.x y`, null as nothing, cast(id as string) as `a;b`, array(id) as xs from range(50)")
    idx, n = with_row_index(df, [F.col("id") % 7, Desc("id")], num_partitions=3)
    assert idx.columns == [*df.columns, "row_idx"] and n == 50
    assert [t for _, t in idx.dtypes][:5] == [t for _, t in df.dtypes]
    rows = sorted(idx.collect(), key=lambda r: r["row_idx"])
    assert [r["id"] for r in rows] == sorted(range(50), key=lambda i: (i % 7, -i)) and rows[0]["nothing"] is None


def test_bucketed_fill_equals_global_window(spark):
    ev = _events(spark)
    idx, _ = with_row_index(ev, ["user_id", "ts", "event_id"])
    for backward in (False, True):
        got = fill_ordered(idx, ["v"], partition_by=["user_id"], backward=backward, bucket_rows=37)
        w = Window.partitionBy("user_id").orderBy("ts", "event_id")
        if backward:
            exp = F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))
        else:
            exp = F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        naive = ev.select("event_id", exp.alias("e"))
        assert got.join(naive, "event_id").where(~F.col("e").eqNullSafe(F.col("v"))).count() == 0


def test_halo_frames_equal_global_frames(spark):
    ev = _events(spark)
    idx, n = with_row_index(ev, ["ts", "event_id"])
    got = halo_frames(idx, 9, {"x": F.col("value")}, bucket_rows=64, keep=["event_id"])
    naive = ev.withColumn("x", F.collect_list("value").over(
        Window.orderBy("ts", "event_id").rowsBetween(0, 8))).where(F.size("x") == 9)
    assert got.count() == n - 8
    assert got.alias("a").join(naive.alias("b"), "event_id").where(F.col("a.x") != F.col("b.x")).count() == 0


def test_series_position_and_prefix_sums(spark):
    ev = _events(spark)
    idx, _ = with_row_index(ev, ["user_id", "ts", "event_id"])
    pos = with_series_position(idx, ["user_id"], position_col="p")
    naive = ev.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)
    assert pos.join(naive, "event_id").where(F.col("p") != F.col("rn")).count() == 0
    cum = with_prefix_sums(ev.select("event_id", F.lit(1).alias("one")), ["event_id"], ["one"], num_partitions=5)
    assert cum.where(F.col("one_cum") != F.col("event_id") + 1).count() == 0


def test_row_index_needs_no_cache(spark):
    """600,000 rows: the index is dense with nothing cached, in every execution, and leaves nothing cached."""
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_orderkey", "l_linenumber")
    idx, n = with_row_index(li, ["l_orderkey", "l_linenumber"])
    for _ in range(2):
        spark.catalog.clearCache()
        got = idx.agg(F.count("*"), F.countDistinct("row_idx"), F.min("row_idx"), F.max("row_idx")).first()
        assert tuple(got) == (n, n, 0, n - 1)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_range_ids_of_nulls_nan_and_descending_keys(spark):
    rows = [(i, None if i % 7 == 0 else float("nan") if i % 11 == 0 else (i * 37 % 50) / 3, None if i % 5 == 0 else "é" * (i % 4) + "a") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, x double, s string").repartition(3)
    keys = [order.Desc("x"), "s", order.Desc("id")]
    exact = df.withColumn("rn", F.row_number().over(Window.orderBy(F.col("x").desc(), "s", F.col("id").desc())) - 1)
    for parts in (1, 5, 40):
        idx, n = with_row_index(df, keys, num_partitions=parts)
        assert n == 300 and idx.join(exact, "id").where("rn <> row_idx").count() == 0
    assert with_row_index(df.limit(0), keys)[1] == 0 and with_row_index(df.limit(0), keys)[0].collect() == []


def test_index_over_times_and_dates(spark):
    ev = _events(spark).select("event_id", F.col("ts").cast("timestamp").alias("t"), F.col("ts").cast("timestamp_ntz").alias("u"), F.col("ts").cast("date").alias("d"))
    for key in ("t", "u", "d"):
        idx, n = with_row_index(ev, [key, "event_id"], num_partitions=3)
        naive = ev.withColumn("rn", F.row_number().over(Window.orderBy(key, "event_id")) - 1)
        assert idx.join(naive, "event_id").where("rn <> row_idx").count() == 0


def test_index_over_other_types_and_extreme_values(spark):
    extreme = F.when(F.col("id") % 5 == 0, float("inf")).when(F.col("id") % 7 == 0, float("-inf")).otherwise(F.col("id") / 3)
    df = spark.range(200).select("id", (F.col("id") * 7 % 50 / 3).cast("decimal(20,6)").alias("d"), F.md5(F.col("id").cast("string")).cast("binary").alias("b"),
                                 (F.col("id") % 2 == 0).alias("t"), extreme.alias("x"), (F.lit(2**63 - 1) - F.col("id")).alias("l"),
                                 F.concat(F.lit('q"\\\n,'), F.col("id").cast("string")).alias("s"), extreme.cast("float").alias("f"))
    for key in ("d", "b", "t", "x", "l", "s", "f"):
        idx, _ = with_row_index(df, [key, "id"], num_partitions=4)
        naive = df.withColumn("rn", F.row_number().over(Window.orderBy(key, "id")) - 1)
        assert idx.join(naive, "id").where("rn <> row_idx").count() == 0


def test_backward_fill_reads_no_row_twice(spark):
    """A frame up to the end of its bucket is evaluated anew for each row, quadratic in the bucket."""
    rows = spark.range(300).select("id", (F.col("id") % 3).alias("k"), F.when(F.col("id") % 11 == 4, F.col("id")).alias("v"), F.when(F.col("id") % 7 == 1, F.col("id")).alias("w"))
    idx, _ = with_row_index(rows, ["k", "id"], num_partitions=5)
    after, before = (Window.partitionBy("k").orderBy("id").rowsBetween(*s) for s in ((0, Window.unboundedFollowing), (Window.unboundedPreceding, 0)))
    want = sorted(map(tuple, rows.select("id", F.first("v", True).over(after), F.last("w", True).over(before)).collect()))
    both = fill_ordered(idx, ["w"], partition_by=["k"], bucket_rows=13, backward_columns=["v"])
    assert sorted(map(tuple, both.select("id", "v", "w").collect())) == want
    for out in (both, fill_ordered(idx, ["v"], backward=True, bucket_rows=13)):
        assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
