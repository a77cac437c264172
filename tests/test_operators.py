"""Operators on small series; each fixture has two series, so a missing partition key fails."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from gridspark import tables
from gridspark.functions import constants as C
from gridspark.functions import scalars as S
from gridspark.operators import anomaly, features, intervals, intraday, joins, metrics, quality, weather_prep
from gridspark.plans import baseline
from gridspark.sources import files, sinks
from gridspark.streaming import ingest

DAY = dt.datetime(2024, 3, 4)


def hours(n, start=DAY):
    return [start + dt.timedelta(hours=i) for i in range(n)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture()
def history(spark):
    rows = [(s, t, level + 10.0 * t.hour) for s, level in (("a", 1000.0), ("b", 2000.0)) for t in hours(24 * 100, dt.datetime(2024, 1, 1))]
    return frame(spark, rows, "series_id string, ts timestamp_ntz, actual_mw double")


def test_lags_are_in_time_not_rows(spark):
    rows = [("a", t, float(i)) for i, t in enumerate(hours(60)) if i != 30] + [("b", t, 100.0 + i) for i, t in enumerate(hours(60))]
    out = {(r.series_id, r.ts): r for r in features.lag_features(frame(spark, rows, "series_id string, ts timestamp_ntz, actual_mw double")).collect()}
    assert out["a", DAY + dt.timedelta(hours=54)].lag_24h is None and out["b", DAY + dt.timedelta(hours=54)].lag_24h == 130.0
    assert out["a", DAY + dt.timedelta(hours=31)].lag_1h is None and out["a", DAY + dt.timedelta(hours=25)].lag_1h == 24.0


def test_baseline_of_a_constant_history_and_no_leak(spark, history):
    cal = tables.calendar(history.select(F.to_date("ts").alias("day")))
    targets = frame(spark, [(s, dt.date(2024, 4, 1)) for s in "ab"], "series_id string, target date")
    f = baseline.seasonal_baseline(history, targets, cal).orderBy("series_id", "ts").collect()
    assert len(f) == 48 and f[3].forecast_mw == pytest.approx(1030.0) and f[24].forecast_mw == pytest.approx(2000.0)
    assert all(r.p99_lower_mw <= r.p95_lower_mw <= r.forecast_mw <= r.p95_upper_mw <= r.p99_upper_mw for r in f)
    changed = history.withColumn("actual_mw", F.when(F.col("ts") >= F.lit(dt.datetime(2024, 4, 1)), -1.0).otherwise(F.col("actual_mw")))
    assert baseline.seasonal_baseline(changed, targets, cal).orderBy("series_id", "ts").collect() == f


def test_calendar_runs(spark):
    days = frame(spark, [(dt.date(2024, 4, 25),), (dt.date(2024, 5, 10),)], "day date")
    c = {r.day: r for r in tables.calendar(days).collect()}
    assert c[dt.date(2024, 5, 6)].run_before == 3  # Friday to Sunday, all holidays
    assert c[dt.date(2024, 5, 7)].days_since_off == 2 and c[dt.date(2024, 4, 29)].is_holiday
    assert c[dt.date(2024, 5, 6)].last_biz_day == dt.date(2024, 5, 2)


def test_alert_limits(spark):
    facts = frame(spark, [("a", DAY, 1000.0, 92.0), ("a", DAY + dt.timedelta(hours=1), 1301.0, 97.0), ("b", DAY, 700.0, 91.9)], "series_id string, ts timestamp_ntz, actual_mw double, usage_pct double")
    assert [(r.severity) for r in anomaly.reserve_risk(facts).orderBy("ts").collect()] == ["warning", "critical"]
    bands = facts.select("series_id", "ts", F.lit(900.0).alias("forecast_mw"), F.lit(850.0).alias("p95_lower_mw"), F.lit(950.0).alias("p95_upper_mw"), F.lit(800.0).alias("p99_lower_mw"), F.lit(1001.0).alias("p99_upper_mw"))
    got = {(r.series_id, r.type): r.severity for r in anomaly.spike_drop(facts, bands).collect()}
    assert got == {("a", "spike"): "critical", ("b", "drop"): "critical"}  # 1000 is inside 99 %


def test_drift_needs_a_run(spark):
    values = [0, 3000, 3000, 3000, 3000, 3000, -9000, 0]
    rows = [(s, t, 10000.0 + v * k) for s, k in (("a", 1), ("b", 0)) for t, v in zip(hours(8), values, strict=True)]
    facts = frame(spark, rows, "series_id string, ts timestamp_ntz, actual_mw double")
    f = facts.select("series_id", "ts", F.lit(10000.0).alias("forecast_mw"))
    got = anomaly.drift(facts, f).collect()
    assert len(got) == 1 and got[0].series_id == "a" and got[0].ts == DAY + dt.timedelta(hours=1) and got[0].end_ts == DAY + dt.timedelta(hours=5)


def test_conformal_rank_is_conservative(spark):
    rows = [("a", float(i)) for i in range(1, 25)] + [("b", 5.0)]
    got = {r.series_id: r["quantile"] for r in metrics.conformal_quantile(frame(spark, rows, "series_id string, x double"), F.col("x"), 0.95, "series_id").collect()}
    assert got == {"a": 24.0, "b": 5.0}


def test_half_widths(spark):
    df = frame(spark, [(100.0, 100.0), (600.0, 5000.0), (-5.0, None)], "lo double, hi double")
    lo, hi = intervals.calibrated_half_widths(F.col("lo"), F.col("hi"))
    got = df.select(lo.alias("a"), hi.alias("b")).collect()
    assert (got[0].a, got[0].b) == (625.0, 625.0) and (got[2].a, got[2].b) == (625.0, 625.0)
    # 5000 is capped at 2.5 * 900 = 2250, then 600 + 2250 is shared at 1 : 1.6 and scaled.
    assert got[1].a == pytest.approx(2850 / 2.6 * 1.25) and got[1].b == pytest.approx(2850 / 2.6 * 1.6 * 1.25)


def test_gate_allows_four_mismatches(spark):
    rows = [(4, True, 0, True, 24, 0, "PASSED"), (5, True, 0, True, 24, 0, "WARNING"), (0, False, 0, True, 23, 0, "FAILED"), (0, True, 0, True, 24, 24, "FAILED"), (0, True, 1, True, 24, 0, "WARNING")]
    df = frame(spark, rows, "freq_mismatch int, expected_count_ok boolean, duplicates int, monotonic boolean, rows int, n_null int, want string")
    assert quality.quality_gate(df).where("status <> want").count() == 0


def test_upsert_and_freeze(spark):
    facts = frame(spark, [("a", DAY, 1.0, None), ("a", hours(2)[1], 2.0, C.FALLBACK), ("b", DAY, None, None)], "series_id string, ts timestamp_ntz, actual_mw double, actual_source string")
    feed = frame(spark, [("a", DAY, 9.0, 5.0), ("a", hours(2)[1], 8.0, 5.0), ("b", DAY, None, 5.0), ("b", hours(30)[29], None, 6.0)], "series_id string, ts timestamp_ntz, feed_mw double, reference_mw double")
    got = {(r.series_id, r.ts.hour): (r.actual_mw, r.actual_source) for r in joins.upsert_actuals(facts, feed, "2024-03-05").collect()}
    assert got == {("a", 0): (1.0, "observed"), ("a", 1): (8.0, "observed"), ("b", 0): (5.0, C.FALLBACK), ("b", 5): (None, None)}


def test_nearest_within(spark):
    a = frame(spark, [("a", DAY), ("a", DAY), ("b", DAY), ("a", DAY + dt.timedelta(hours=1))], "k string, t timestamp_ntz")
    b = frame(spark, [("a", DAY + dt.timedelta(seconds=s), s) for s in (-90, 60, 120)] + [("b", DAY + dt.timedelta(seconds=121), 121)], "k string, u timestamp_ntz, s int")
    got = joins.nearest_within(a, b, ["k"], "t", "u", 120).collect()
    assert sorted(((r.k, r.s, r.apart_s) for r in got), key=str) == [("a", 60, 60), ("a", 60, 60), ("a", None, None), ("b", None, None)]


def test_intraday_changes_only_later_hours(spark):
    rows = [(s, t, (1000.0 + e if t.hour < 5 else None), 1000.0) for s, e in (("a", 300.0), ("b", -5000.0)) for t in hours(24)]
    got = intraday.correct(frame(spark, rows, "series_id string, ts timestamp_ntz, actual_mw double, forecast_mw double")).collect()
    by = {(r.series_id, r.ts.hour): r.adjustment_mw for r in got}
    assert all(by[s, h] == 0 for s in "ab" for h in range(5))
    assert by["a", 5] == pytest.approx(180.0) and by["a", 6] == pytest.approx(180 * 0.92) and by["b", 5] == pytest.approx(-1200.0)


def test_interpolation_and_extremes(spark):
    p = frame(spark, [("a", DAY, 10.0), ("a", hours(4)[3], 16.0), ("b", DAY, 1.0)], "series_id string, ts timestamp_ntz, temp_c double")
    got = {(r.series_id, r.ts.hour): r.temp_c for r in weather_prep.interpolate_hours(p).collect()}
    assert got == {("a", 0): 10.0, ("a", 1): 12.0, ("a", 2): 14.0, ("a", 3): 16.0, ("b", 0): 1.0}
    x = frame(spark, [("a", DAY.date(), 20.0, 9.0)], "series_id string, day date, day_max double, day_min double")
    out = [r.temp_c for r in weather_prep.stretch_to_extremes(weather_prep.interpolate_hours(p), x).where("series_id = 'a'").orderBy("ts").collect()]
    assert max(out) == pytest.approx(20.0) and min(out) == pytest.approx(9.0)


def test_scalars(spark):
    r = frame(spark, [("2024/3/4", "7:05", " 1.5 ", "x")], "d string, t string, n string, bad string").select(S.local_timestamp(F.col("d"), F.col("t")).cast("string").alias("ts"), S.safe_double(F.col("n")).alias("n"), S.safe_double(F.col("bad")).alias("bad"), S.add_source(F.lit("a+b"), "b").alias("s"), S.lead_bucket(F.lit(120)).alias("l")).first()
    assert tuple(r) == ("2024-03-04 07:05:00", 1.5, None, "a+b", "0-120")


def test_multi_section_files(spark, tmp_path):
    head = "2024/3/4 23:55 UPDATE\n\nDATE,TIME,actual,forecast,usage,supply\n"
    body = "".join(f"2024/3/4,{h}:00,{100 + h},{101 + h},80,{150}\n" for h in range(24))
    five = "\nDATE,TIME,now,solar,share\n" + "".join(f"2024/3/4,{m // 60}:{m % 60:02d},{100},{5},1\n" for m in range(0, 1440, 5))
    (tmp_path / "20240304_power.csv").write_bytes((head.replace("UPDATE", "更新") + body + five).encode("cp932"))
    (tmp_path / "20240305_power.csv").write_text("nothing here\n")
    (tmp_path / "readme_power.csv").write_text("no date\n")
    lines = files.read_lines(spark, str(tmp_path))
    sections = files.daily_sections(lines)
    rows = files.hourly_rows(sections)
    assert rows.count() == 24 and rows.agg(F.max("actual_mw")).first()[0] == 1230.0
    assert files.five_minute_rows(sections).count() == 288
    assert [r.reason for r in files.quarantined(sections, lines).collect()] == ["no hourly table"]


def test_weather_documents(spark):
    doc = json.dumps({"hourly": {"time": ["2024-03-04T00:00", "2024-03-04T01:00"], "temperature_2m": [10.0, None], "apparent_temperature": [None, 1.0], "relative_humidity_2m": [50.0, 60.0]}})
    got = files.weather_response(frame(spark, [(doc,)], "value string")).orderBy("ts").collect()
    assert got[0].apparent_temp_c == 10.0 and got[1].discomfort_index is None and len(got) == 2
    station = json.dumps({"20240304090000": {"temp": [5.5, 0], "humidity": [40, 0]}, "20240304091000": {"temp": [9.0, 0]}})
    assert [(r.ts.hour, r.temp_c, r.wind_mps) for r in files.station_observations(frame(spark, [(station,)], "value string")).collect()] == [(9, 5.5, None)]


def test_stream_upsert_is_idempotent(spark, tmp_path):
    schema = "series_id string, ts timestamp_ntz, actual_mw double, actual_source string"
    frame(spark, [("a", DAY, 1.0, C.FALLBACK), ("b", DAY, 2.0, C.OBSERVED)], schema).write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.upsert_stream(ingest.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
        frame(spark, [("a", DAY, 3.0, C.OBSERVED)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.upsert_stream(ingest.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {r.series_id: r.actual_mw for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": 3.0, "b": 2.0}


def test_retention_and_vintages(spark):
    snaps = frame(spark, [("a", DAY + dt.timedelta(hours=h)) for h in range(5)] + [("a", DAY - dt.timedelta(days=40))], "series_id string, taken timestamp_ntz")
    assert sinks.retained(snaps, ["series_id"], "taken", F.lit(DAY + dt.timedelta(days=1)), 21, 3).count() == 3
    ledger = frame(spark, [("a", DAY, hours(2)[1])], "series_id string, captured_at timestamp_ntz, ts timestamp_ntz")
    new = frame(spark, [("a", DAY, hours(3)[2]), ("a", hours(2)[1], hours(3)[2]), ("a", hours(4)[3], hours(3)[2])], "series_id string, captured_at timestamp_ntz, ts timestamp_ntz")
    assert [r.captured_at for r in sinks.append_vintages(ledger, new).collect()] == [hours(2)[1]]


def test_lags_across_stretches(spark, monkeypatch):
    """Cutting a series into stretches changes nothing, gaps included."""
    from gridspark.operators import features

    rows = [("a", DAY + dt.timedelta(hours=h), float(h)) for h in range(1500) if h % 97 and not 500 <= h < 530]
    hourly = frame(spark, rows, "series_id string, ts timestamp_ntz, actual_mw double")
    whole = sorted(features.lag_features(hourly).collect(), key=lambda r: r.ts)
    monkeypatch.setattr(features, "STRETCH_HOURS", 400)
    assert sorted(features.lag_features(hourly).collect(), key=lambda r: r.ts) == whole and len(whole) == len(rows)
