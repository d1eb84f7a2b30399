from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewell.operators.canonical import SOURCES, canonical
from tidewell.sources import first_deliveries
from tidewell.sources.readers import delimited, images, modality, partitions, templated
from tidewell.sources.sinks import Results, write_delimited, write_events


def test_gzip_csv_with_bad_fields(spark, tmp_path):
    (tmp_path / "t.csv.gz").write_bytes(gzip.compress(b"a,b,c\n1,2.5,x\nbad,,y\n3\n"))
    got = delimited(spark, str(tmp_path / "t.csv.gz"), "a int, b double, c string", ["c", "a"], parts=2)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("x", 1), ("y", None), (None, 3)], key=repr)


def test_event_table_round_trip_and_pruning(spark, small, tmp_path):
    events = canonical(spark.read.parquet(f"{small}/features.parquet"), SOURCES["features"])
    write_events(events, str(tmp_path / "e"))
    lab = modality(spark, str(tmp_path / "e"), "lab", [50912], ["subject_id", "value_num"])
    assert lab.count() == events.where("modality = 'lab' and type = '50912'").count() > 0
    plan = lab._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(modality" in plan and "PushedFilters" in plan
    assert {r.modality for r in partitions(spark.read.parquet(str(tmp_path / "e")), "modality").collect()} == {"chart", "lab", "input", "output"}


def test_first_delivery_wins(spark):
    rows = spark.createDataFrame([(1, "2100-01-02", 5.0), (1, "2100-01-01", 4.0), (1, None, 1.0), (2, None, None), (None, "2100-01-01", 3.0)], "event_id int, s string, v double")
    got = first_deliveries(rows.withColumn("storetime", F.col("s").cast("timestamp_ntz")), ["v"])
    assert sorted(map(tuple, got.collect())) == [(1, 4.0), (2, None)]


def test_results_refuse_unknown_and_replace_once(spark, tmp_path):
    store = Results(spark, str(tmp_path / "r"), {"t": StructType.fromDDL("k string, v double, note string")})
    assert store.read("t").count() == 0
    store.templates()
    row = lambda k, v: spark.createDataFrame([(k, v)], "k string, v double")
    store.append("t", row("a", 1.0))
    for _ in range(2):
        store.replace("t", row(None, 2.0), k=[None, "b"])
    assert sorted(map(tuple, store.read("t").collect()), key=repr) == sorted([("a", 1.0, None), (None, 2.0, None)], key=repr)
    # A version that wasn't finished isn't the table.
    (tmp_path / "r" / "t" / "v-999999999999-x").mkdir()
    assert store.read("t").count() == 2
    with pytest.raises(ValueError):
        store.append("t", row("a", 1.0).withColumn("other", F.lit(1)))
    with pytest.raises(KeyError):
        store.append("nope", row("a", 1.0))


def test_small_readers_and_writers(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jpg").write_bytes(b"12")
    assert images(spark, str(tmp_path / "d")).first().length == 2
    assert [r.path for r in templated(spark.createDataFrame([(1, "a"), (2, None)], "i int, n string"), "r/{i}/{n}.jpg").orderBy("i").collect()] == ["r/1/a.jpg", None]
    write_delimited(spark.range(3), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 3
