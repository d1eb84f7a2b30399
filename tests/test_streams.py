"""Files that arrive one after the other: repeated, late and odd rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidewell.operators.canonical import canonical
from tidewell.streaming import crossings, daily_counts, ingest

SPEC = {"subject_id": "s", "time": "t", "modality": "m", "type": "k", "value_num": "v", "_once": "e", "_stored": "st"}
SCHEMA = "e bigint, s bigint, t timestamp_ntz, st timestamp_ntz, m string, k string, v double"


def _at(day, hour=0):
    return dt.datetime(2100, 1, day, hour)


def _write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def test_a_repeated_delivery_counts_once_over_files(spark, tmp_path):
    row = (1, 9, _at(1), _at(1, 1), "chart", "220045", 80.0)
    _write(spark, tmp_path / "in", [row, row, (2, 9, _at(1), None, "chart", "220045", 9999.0), (None, 9, _at(1), _at(1), "chart", "220045", 1.0)], SCHEMA)
    out = str(tmp_path / "out")
    assert ingest(spark, str(tmp_path / "in"), SPEC, out).count() == 2
    _write(spark, tmp_path / "in", [(1, 9, _at(1), _at(2), "chart", "220045", 80.0), (3, 9, _at(2), _at(2), "lab", "50912", 1.0)], SCHEMA)
    got = ingest(spark, str(tmp_path / "in"), SPEC, out)
    assert sorted((r.value_num, r.keep) for r in got.collect()) == [(1.0, True), (80.0, True), (9999.0, False)]


def test_finished_days_only(spark, tmp_path):
    rows = [(_at(1, h), "a", 1.0) for h in range(3)] + [(_at(2), "a", 5.0), (_at(5), "a", 7.0), (None, "a", 9.0), (_at(1), None, None)]
    _write(spark, tmp_path / "in", rows, "t timestamp_ntz, k string, v double")
    got = {(r.day, r.kind): (r.n, r.total) for r in daily_counts(spark, str(tmp_path / "in"), "t", "k", "v").collect()}
    assert got == {("2100-01-01", "a"): (3, 3.0), ("2100-01-02", "a"): (1, 5.0), ("2100-01-01", None): (1, None)}


def test_crossings_take_rows_of_one_time_together(spark, tmp_path):
    rows = [("u", _at(1), 60.0), ("u", _at(2), 30.0), ("u", _at(2), 30.0), ("u", _at(3), -50.0), ("w", _at(1), None), ("w", None, 500.0), (None, _at(1), 500.0)]
    _write(spark, tmp_path / "in", rows, "k string, t timestamp_ntz, v double")
    got = crossings(spark, str(tmp_path / "in"), "k", "t", "v", 100.0).collect()
    assert [(r.k, r.crossed_us) for r in got] == [("u", int(_at(2).replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000)]


def test_the_first_delivery_counts(spark):
    rows = [(1, 9, _at(1), _at(3), "chart", "220045", 5.0), (1, 9, _at(1), _at(2), "chart", "220045", 4.0), (None, 9, _at(1), _at(1), "chart", "x", 1.0)]
    got = canonical(spark.createDataFrame(rows, SCHEMA).withColumn("clash", F.lit(1)), SPEC).collect()
    assert [r.value_num for r in got] == [4.0]
