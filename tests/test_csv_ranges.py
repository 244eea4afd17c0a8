"""CSV texts with line ends in quoted fields, read in byte ranges."""

import csv
import random

import pytest

from tidepool.sources import io


@pytest.fixture
def small_ranges(spark):
    """Files are read in ranges of a few hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def rows_of(n, seed):
    rnd = random.Random(seed)
    words = ["plain", 'with "quotes"', "a\nline", "two\n\nlines", "comma, here", "", "漢字\n字", "x" * 700 + "\n" + "y" * 700]
    return [(i, rnd.choice(words), rnd.random() < .5 and "end\n" or "end", round(rnd.random(), 3)) for i in range(n)]


def write(path, rows, encoding, newline="\n"):
    with open(path, "w", encoding=encoding, newline="") as f:
        out = csv.writer(f, lineterminator=newline)
        out.writerow(["id", "text", "last part", "x"])
        out.writerows(rows)


@pytest.mark.parametrize("encoding,newline", [("utf-8", "\n"), ("gb18030", "\n"), ("utf-8-sig", "\r\n")])
def test_records_across_ranges(spark, tmp_path, small_ranges, encoding, newline):
    rows, path = rows_of(120, 1), str(tmp_path / "t.csv")
    write(path, rows, encoding, newline)
    survey = io.survey_csv(spark, path)
    assert survey.multi_line and survey.ranges.count() > 20
    df = io.read_table(spark, path)
    assert df.columns == ["id", "text", "last part", "x"] and dict(df.dtypes)["id"] == "int" and dict(df.dtypes)["x"] == "double"
    assert df.rdd.getNumPartitions() > 20
    got = sorted((r[0], r[1] or "", r[2], r[3]) for r in df.collect())
    assert got == rows


def test_folder_of_files_each_with_a_header(spark, tmp_path, small_ranges):
    rows = rows_of(60, 2)
    (tmp_path / "t").mkdir()
    for k in range(3):
        write(str(tmp_path / "t" / f"{k}.csv"), rows[k::3], "utf-8")
    got = sorted((r[0], r[1] or "", r[2], r[3]) for r in io.read_table(spark, str(tmp_path / "t"), fmt="csv").collect())
    assert got == rows


def test_a_charset_copy_in_many_parts_keeps_every_row(spark, tmp_path, small_ranges):
    path = str(tmp_path / "t.csv")
    write(path, [(i, "漢字", "一", 0.5) for i in range(300)], "gb18030")
    assert sorted(r[0] for r in io.read_table(spark, path).collect()) == list(range(300))


def test_header_alone_and_odd_names(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_text('"a\nb",c,c,\n', encoding="utf-8")
    df = io.read_table(spark, str(path))
    assert df.columns == ["a\nb", "c1", "c2", "_c3"] and df.collect() == []
