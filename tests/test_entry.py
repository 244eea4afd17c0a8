import duckdb

import __spark_entry__ as entry

from .conftest import SF_SMALL

FAST = ["profile_nulls", "fill_forward_series", "random_split", "sliding_windows", "roc_auc", "moving_average",
        "precision_recall_f1", "latest_runs", "series_arrays_to_long"]


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"mse", "rmse", "mae", "r2"}


def test_every_query_is_registered_with_unique_columns():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 100


def test_selected_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in ("events", "lineitem", "embeddings", "labels", "orders", "customer"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    qs, sql = entry.queries(), entry.oracle_sql()
    for name in FAST:
        sdf = qs[name](spark, SF_SMALL)
        cur = con.execute(sql[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(sdf.columns), name
        a = sorted(tuple(str(r[c]) for c in sorted(cols)) for r in sdf.collect())
        b = sorted(tuple(str(dict(zip(cols, r))[c]) for c in sorted(cols)) for r in cur.fetchall())
        assert a == b, name
