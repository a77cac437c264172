"""Feeds, documents, stored facts and their round trips."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from gridspark.functions import scalars as S
from gridspark.sources import documents

DAY = "2026-07-0{0}"


def hours(spark, days=2, series=("a", "b")):
    rows = [(s, dt.datetime(2026, 7, 1 + d, h), 100.0 * (1 + i) + h, "observed" if h != 23 else "reference_forecast_fallback", 90.0 + h, 95.0 + h) for i, s in enumerate(series) for d in range(days) for h in range(24)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, actual_mw double, actual_source string, reference_mw double, forecast_mw double").withColumns({"p95_lower_mw": F.col("forecast_mw") - 5, "p95_upper_mw": F.col("forecast_mw") + 5})


def test_intraday_feed_stops_and_falls_back(spark):
    text = ["update", "PEAK,TIME", "1,2", "DATE,TIME,a,f,u,s", "2026/7/1,0:00,310,300,80,400", "2026/7/1,1:00,0,305,81,400", "2026/7/1,23:00,,311,82,401", "", "2026/7/2,0:00,9,9,9,9", "DATE,TIME,a,b,c", "2026/7/1,0:05,1,2,3"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)] + [("none", 0, "x")], "source_file string, seq int, line string")
    got = {r.ts.hour: (r.actual_mw, r.actual_source, r.reference_mw) for r in documents.intraday_feed(lines, F.lit("2026-07-02 01:00:00").cast("timestamp_ntz")).collect()}
    assert got == {0: (3100.0, "observed", 3000.0), 1: (None, None, 3050.0), 23: (3110.0, "reference_forecast_fallback", 3110.0)}
    assert documents.intraday_feed(lines).where("actual_source = 'reference_forecast_fallback'").count() == 0


def test_documents_round_trip(spark):
    h = hours(spark)
    actual, forecast = documents.actual_documents(h), documents.forecast_documents(h.where("series_id = 'a' or hour(ts) < 20"), "boosted_v1_intraday_residual")
    assert {(r.series_id, r.available) for r in forecast.collect()} == {("a", True), ("b", False)}
    got = documents.comparable_rows(actual, forecast)
    assert sorted((r.series_id, r.ts, r.actual_mw, r.forecast_mw) for r in got.collect()) == sorted((r.series_id, r.ts, r.actual_mw, r.forecast_mw) for r in h.where("series_id = 'a' and hour(ts) < 23").collect())
    rows = documents.document_rows(forecast, "boosted")
    assert rows.count() == 48 and {r.model for r in rows.collect()} == {"boosted_v1"} and documents.document_rows(forecast, "other").count() == 0


def test_stored_facts_of_old_versions(spark, tmp_path):
    h = hours(spark, 2, ("a",)).withColumn("date", F.to_date("ts"))
    h.where("date = '2026-07-01'").select("series_id", "ts", "actual_mw", "date").write.partitionBy("date").parquet(str(tmp_path / "t"))
    h.where("date = '2026-07-02'").select("series_id", "ts", "actual_mw", "actual_source", "date").write.mode("append").partitionBy("date").parquet(str(tmp_path / "t"))
    t = documents.stored_facts(spark, str(tmp_path / "t"))
    assert {r.actual_source for r in t.where("date = '2026-07-01'").collect()} == {"observed_legacy"} and "supply_mw" in t.columns
    late = documents.stored_facts(spark, str(tmp_path / "t"), "2026-07-02")
    assert late.count() == 24 and "PartitionFilters: [isnotnull(date" in late._jdf.queryExecution().toString()


def test_blocks_ledgers_and_archives(spark):
    b = spark.createDataFrame([("a", dt.datetime(2026, 7, 1, 3), 1.0, 1), ("a", dt.datetime(2026, 7, 1, 3), 2.0, 2), ("a", dt.datetime(2026, 7, 9), 3.0, 3)], "series_id string, ts timestamp_ntz, temp_c double, block int")
    assert [r.temp_c for r in documents.observed_range(b, F.lit("2026-07-01").cast("date"), F.lit("2026-07-02").cast("date")).collect()] == [2.0]
    taken = lambda n, d: spark.createDataFrame([("a", dt.date(2026, 7, d), dt.datetime(2026, 7, d, i)) for i in range(n)], "series_id string, day date, taken_at timestamp_ntz")
    kept = documents.append_calibrations(taken(5, 1).union(taken(3, 2)), taken(20, 3), per_day=4, days=2)
    assert {(r.day.day, r.n) for r in kept.groupBy("day").agg(F.count("*").alias("n")).collect()} == {(2, 3), (3, 4)}
    docs = documents.actual_documents(hours(spark, 3))
    archive = documents.monthly_archive(docs, F.lit("2026-09-02").cast("date"), 62).collect()
    assert {(r.series_id, r.month, r.days) for r in archive} == {("a", "2026-07", 1), ("b", "2026-07", 1)}
    status = documents.status_rows(hours(spark).where("hour(ts) <> 5"), spark.createDataFrame([("a", "x")], "series_id string, file string"), F.lit("2026-07-02").cast("date"))
    assert {(r.series_id, r.days, r.missing_hours, r.failed_files, r.has_today) for r in status.collect()} == {("a", 2, 2, 1, True), ("b", 2, 2, 0, True)}


def test_area_pairs(spark):
    slots = spark.createDataFrame([("a", dt.date(2026, 7, d), s, 1000.0 * s) for d in (1, 2) for s in range(1, 49 - (d - 1))], "series_id string, day date, slot int, kwh double")
    got = documents.area_pairs(slots, slots.withColumn("kwh", F.col("kwh") * 2)).collect()
    assert len(got) == 24 and all(r.forecast_mw == 2 * r.actual_mw and r.actual_delta_mw == 2.0 for r in got)


def test_small_expressions(spark):
    r = spark.createDataFrame([(dt.datetime(2026, 1, 1, 20), float("nan"), 0.25, {"peak_a": None, "peak_b": 2.0, "min": 3.0})], "ts timestamp_ntz, x double, y double, m map<string, double>").select(
        S.to_local(F.col("ts")).alias("local"), S.first_number(F.col("x"), F.col("y")).alias("n"), S.compact_json(F.lit(None).cast("int").alias("a"), F.col("y")).alias("j"), S.event_id(F.lit("drop"), F.col("ts")).alias("id"), S.round_tenth(F.col("y")).alias("r"), S.prefixed(F.col("m"), "none", "peak").alias("p")
    ).first()
    assert r.local == dt.datetime(2026, 1, 2, 5) and r.n == 0.25 and r.j == '{"y":0.25}' and r.id == "drop-202601012000" and r.r == 0.2 and r.p == 2.0
