import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronolode.functions.calendar import period_start
from chronolode.functions.encoding import Bands, HourOfDay, discretize
from chronolode.operators.profile import (
    band_counts,
    box_stats,
    correlation_matrix,
    describe_frame,
    histogram,
    mean_by,
    missing_by_period,
)
from chronolode.sources.observations import USUAL_NULLS, nan_to_null, read_observations, with_month_start, with_timestamp
from chronolode.sources.scratch import checkpoint_folder, fixed_partitions, materialise
from chronolode.sources.tables import load, to_table, write_table

CSV = """No,year,month,day,hour,pm2.5,cbwd
1,2010,1,1,0,NA,NW
2,2010,1,1,1,129,
3,2010,1,1,2,,cv
4,2010,2,1,3,-,NE
"""
SCHEMA = "no int, year int, month int, day int, hour int, pm25 double, cbwd string"


@pytest.fixture
def csv(tmp_path):
    path = tmp_path / "observations.csv"
    path.write_text(CSV.replace("-", "NaN"))
    return str(path)


def test_csv_scan_renames_and_nulls(spark, csv):
    rows = read_observations(spark, csv, SCHEMA).orderBy("no").collect()
    assert [r["pm25"] for r in rows] == [None, 129.0, None, None]
    assert [r["cbwd"] for r in rows] == ["NW", None, "cv", "NE"]


def test_csv_scan_with_many_tokens(spark, csv):
    rows = read_observations(spark, csv, SCHEMA, null_values=("NA", "NaN", "cv")).orderBy("no").collect()
    assert [r["pm25"] for r in rows] == [None, 129.0, None, None]
    assert [r["cbwd"] for r in rows] == ["NW", None, None, "NE"]


def test_usual_null_texts(spark, tmp_path):
    path = tmp_path / "nulls.csv"
    path.write_text("a,b\n" + "".join(f"{t},1\n" for t in (*USUAL_NULLS, "2.5")))
    rows = read_observations(spark, str(path), "a double, b int", USUAL_NULLS).collect()
    assert [r["a"] for r in rows] == [None] * len(USUAL_NULLS) + [2.5]


def test_malformed_numbers_are_an_error(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text(CSV)
    for tokens in (("NA",), ("NA", "?")):
        with pytest.raises(Exception):
            read_observations(spark, str(path), SCHEMA, null_values=tokens).collect()


def test_time_from_parts(spark, csv):
    df = read_observations(spark, csv, SCHEMA)
    df = with_month_start(with_timestamp(df, {c: c for c in ("year", "month", "day", "hour")}), "year", "month")
    assert dict(df.dtypes)["ts"] == "timestamp_ntz"
    row = df.where("no = 4").first()
    assert (row["ts"], row["month_start"]) == (dt.datetime(2010, 2, 1, 3), dt.datetime(2010, 2, 1))
    missing = missing_by_period(df, "pm25", "ts").collect()
    assert [(r["period"], round(r["missing_pct"], 3)) for r in missing] == [
        (dt.datetime(2010, 1, 1), 66.667),
        (dt.datetime(2010, 2, 1), 100.0),
    ]


def test_periods_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        rows = [(dt.datetime(2017, 10, 15, 0, 30),)]  # an hour that this zone skipped
        ts = spark.createDataFrame(rows, "ts timestamp_ntz")
        got = ts.select(*[period_start(F.col("ts"), u).alias(u) for u in ("hour", "day", "month", "year")]).first()
        assert list(got) == [dt.datetime(2017, 10, 15), dt.datetime(2017, 10, 15), dt.datetime(2017, 10, 1), dt.datetime(2017, 1, 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    with pytest.raises(ValueError):
        period_start(F.col("ts"), "week")


def test_nan_to_null_and_small_tables(spark):
    df = to_table(spark, [(float("nan"), "NaN"), (1.0, "x")], "a double, b string")
    assert [tuple(r) for r in nan_to_null(df).collect()] == [(None, "NaN"), (1.0, "x")]


def test_sink_writes_nested_columns_as_json(spark, tmp_path):
    path = str(tmp_path / "out")
    write_table(spark.createDataFrame([("m", {"alpha": "1.0"}, None)], "n string, p map<string,string>, x double"), path)
    row = spark.read.option("header", True).option("escape", "\\").csv(path).first()
    assert (row["n"], row["p"], row["x"]) == ("m", '{"alpha":"1.0"}', "NA")
    write_table(spark.range(3), str(tmp_path / "parquet"), "parquet")
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 3


def test_scratch_uses_the_folder_of_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert checkpoint_folder(spark) == folder
    copy = materialise(spark.range(5), "five")
    assert copy.inputFiles() and all(folder in f for f in copy.inputFiles())
    fixed = fixed_partitions(spark.range(100), 7, "id")
    assert fixed.rdd.getNumPartitions() == 7 and fixed.count() == 100


def one_column(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double")


def test_histogram_puts_the_maximum_in_the_last_bin(spark):
    rows = histogram(one_column(spark, [0, 5, 10, None]), "x", 5).collect()
    assert [r["n"] for r in rows] == [1, 0, 1, 0, 1]
    assert (rows[0]["lo"], rows[-1]["hi"]) == (0.0, 10.0)
    same = histogram(one_column(spark, [3, 3]), "x", 4).collect()
    assert sum(r["n"] for r in same) == 2 and (same[0]["lo"], same[-1]["hi"]) == (2.5, 3.5)
    assert histogram(one_column(spark, [None]), "x", 4).count() == 0


def test_band_counts_list_empty_bands(spark):
    rows = band_counts(one_column(spark, [0, 35, 36, 400, None]), "x", [-0.1, 35, 75, 150, float("inf")], list("abcd"))
    assert [(r["band"], r["n"]) for r in rows.collect()] == [("a", 2), ("b", 1), ("c", 0), ("d", 1)]


def test_box_stats_hide_outliers_and_list_all_keys(spark):
    rows = [(1, float(v)) for v in [1, 2, 3, 4, 5, 100]] + [(2, 7.0), (2, None)]
    got = box_stats(spark.createDataFrame(rows, "m int, x double"), "m", "x", [1, 2, 3]).collect()
    first = got[0]
    assert (first["q1"], first["median"], first["q3"]) == (2.25, 3.5, 4.75)
    assert (first["whisker_lo"], first["whisker_hi"]) == (1.0, 5.0)
    assert (got[1]["n"], got[1]["whisker_lo"], got[1]["whisker_hi"]) == (1, 7.0, 7.0)
    assert (got[2]["n"], got[2]["median"], got[2]["whisker_hi"]) == (0, None, None)


def test_correlation_skips_incomplete_pairs(spark):
    rows = [(1.0, 2.0, 5.0), (2.0, 4.0, None), (3.0, 6.0, 1.0), (None, 1.0, 2.0)]
    got = {(r["a"], r["b"]): r["r"] for r in correlation_matrix(spark.createDataFrame(rows, "x double, y double, z double"), list("xyz")).collect()}
    assert len(got) == 9 and got["x", "y"] == pytest.approx(1) == pytest.approx(got["y", "x"])
    assert got["x", "z"] == pytest.approx(-1) and got["z", "z"] == pytest.approx(1)


def test_mean_by_and_description(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "k string, x double")
    assert [(r["k"], r["mean"]) for r in mean_by(df, "k", "x").collect()] == [("b", 5.0), ("a", 2.0)]
    row = describe_frame(df, "x", ["k"]).first()
    assert (row["n_rows"], row["first_ts"], row["last_ts"], row["features"]) == (4, 1.0, 9.0, "k")


def test_row_wise_items_on_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10.0, 6), (2, 90.0, 23)], "id int, x double, hour int")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    rules = [Bands("X", "x", (0.0, 50.0, 100.0), ("low", "high")), HourOfDay("TIME", "hour")]
    query = discretize(stream, rules, ["id"]).writeStream.format("memory").queryName("items").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("items").collect()) == [
        (1, "X=low", "TIME=Morning"),
        (2, "X=high", "TIME=Night"),
    ]


def test_hot_value_does_not_change_counts(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2000, 1.0).otherwise(F.col("id") * 1.0).alias("x"))
    assert histogram(df, "x", 10).agg(F.sum("n")).first()[0] == 3000


def test_load_turns_nan_into_null(spark, tmp_path):
    spark.createDataFrame([(1, float("nan")), (2, 1.0)], "id int, x double").write.parquet(str(tmp_path / "t.parquet"))
    assert sorted((r["id"], r["x"]) for r in load(spark, str(tmp_path), "t").collect()) == [(1, None), (2, 1.0)]


def test_usual_nulls_are_the_default(spark, tmp_path):
    path = tmp_path / "nulls.csv"
    path.write_text("a,b\n1,n/a\n2,NULL\n3,7\n")
    assert [r["b"] for r in read_observations(spark, str(path), "a int, b double").orderBy("a").collect()] == [None, None, 7.0]
