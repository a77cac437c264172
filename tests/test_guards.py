"""Guard rules on one day of two series."""

from __future__ import annotations

import datetime as dt
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark import queries as grid
from gridspark import rule_queries  # noqa: F401
from gridspark.operators import guards
from tests.test_queries import TABLES

DAY = dt.datetime(2024, 7, 6)


@pytest.fixture()
def rows(spark):
    data = [(s, DAY + dt.timedelta(hours=h), 1000.0 + (peak if h == 14 else 0.0), 900.0, 0.0, 0.0, off) for s, peak, off in (("a", 2000.0, 0), ("b", 0.0, 1)) for h in range(24)]
    df = spark.createDataFrame(data, "series_id string, ts timestamp_ntz, forecast_mw double, raw_mw double, lag_24h_hourly_delta double, recent_same_business_type_delta_mean double, is_non_business_day int")
    more = {"p95_lower_mw": F.col("forecast_mw") - 10, "p95_upper_mw": F.col("forecast_mw") + 10, "consec_holiday_len": F.lit(3), "days_since_holiday_end": F.lit(1), "temp_anomaly_doy": F.lit(2.0), "lag_24h": F.lit(-4000.0), "lag_24h_business_type_mismatch": F.lit(0), "temp_delta_24h": F.lit(1.0)}
    return df.withColumns(more)


def by_hour(df, series):
    return {r.ts.hour: r for r in df.where(F.col("series_id") == series).collect()}


def test_spikes_are_flattened_with_their_bands(rows):
    out = guards.flatten_spikes(rows)
    a = by_hour(out, "a")
    # 2000 over both neighbours: 0.75 of what stands over 450, at most 700.
    assert a[14].forecast_mw == pytest.approx(2300.0) and a[14].p95_upper_mw == pytest.approx(2310.0) and a[13].forecast_mw == 1000.0
    assert all(r.forecast_mw == 1000.0 for r in by_hour(out, "b").values()) and out.columns == rows.columns and out.count() == 48
    # Support, a warm day, or a day off leaves it.
    for other in ({"lag_24h_hourly_delta": F.lit(600.0)}, {"temp_delta_24h": F.lit(3.0)}, {"is_non_business_day": F.lit(1)}):
        assert by_hour(guards.flatten_spikes(rows.withColumns(other)), "a")[14].forecast_mw == 3000.0


def test_morning_spikes_and_slopes(rows):
    spike = rows.withColumn("forecast_mw", F.when(F.hour("ts") == 9, 3000.0).otherwise(1000.0))
    assert by_hour(guards.flatten_spikes(spike), "a")[9].forecast_mw == pytest.approx(3000 - 0.75 * 1300)
    # A climb of 5000 on a warming day: the anchor is between both neighbours, 400 over it.
    steep = rows.withColumn("forecast_mw", F.when(F.hour("ts") < 9, 1000.0).when(F.hour("ts") == 9, 6000.0).otherwise(6200.0)).withColumn("temp_delta_24h", F.lit(2.0))
    assert by_hour(guards.flatten_spikes(steep), "a")[9].forecast_mw == pytest.approx(6000 - 1400)


def test_early_rise_is_blocked(rows):
    a = by_hour(guards.block_post_holiday_rise(rows), "a")
    assert a[3].forecast_mw == 900.0 and a[0].forecast_mw == 1000.0 and a[7].forecast_mw == 1000.0


def test_cap_over_yesterday(rows):
    a = by_hour(guards.cap_over_yesterday(rows), "a")
    assert a[12].forecast_mw == pytest.approx(-4000 + 2500 + 1200) and a[9].forecast_mw == 1000.0


def test_other_rules_leave_quiet_days(rows):
    for rule in (guards.block_hot_day_fall, guards.lift_morning_shape):
        assert [r.forecast_mw for r in rule(rows).orderBy("series_id", "ts").collect()] == [r.forecast_mw for r in rows.orderBy("series_id", "ts").collect()]


def test_analogous_days(spark):
    d = lambda m, n: dt.date(2024, m, n)
    days = spark.createDataFrame([("a", d(5, 1), False, 0, 1.0), ("a", d(6, 3), False, 0, 9.0), ("a", d(6, 4), True, 0, 1.0), ("a", d(6, 5), False, 1, 2.0), ("b", d(6, 6), False, 0, 1.0), ("a", d(2, 1), False, 0, 1.0)], "series_id string, day date, is_off boolean, run int, temp_anomaly double")
    targets = spark.createDataFrame([("a", d(6, 10), False, 0, 1.0)], days.schema)
    assert [(r.day, r["rank"]) for r in guards.analogous_days(days, targets).orderBy("rank").collect()] == [(d(6, 5), 1), (d(5, 1), 2)]


def test_analogous_days_look_further_back_only_when_short(spark):
    d = lambda y, m, n: dt.date(y, m, n)
    days = spark.createDataFrame([("a", d(2020, 1, 5), False, 0, 1.0), ("a", d(2021, 12, 6), False, 0, 1.0), ("a", d(2024, 2, 7), False, 0, None), ("a", d(2024, 4, 7), False, 0, 1.0)] + [("b", d(2024, 6, n), False, 0, 1.0) for n in range(1, 9)], "series_id string, day date, is_off boolean, run int, temp_anomaly double")
    targets = spark.createDataFrame([("a", d(2025, 1, 10), False, 0, 1.0), ("b", d(2024, 6, 9), False, 0, 1.0), ("c", d(2024, 6, 9), False, 0, 1.0)], days.schema)
    got = {}
    for r in guards.analogous_days(days, targets).orderBy("series_id", "rank").collect():
        got.setdefault(r.series_id, []).append(r.day)
    assert got == {"a": [d(2024, 2, 7), d(2021, 12, 6), d(2020, 1, 5)], "b": [d(2024, 6, n) for n in (8, 7, 6, 5, 4)]}
    assert guards.analogous_days(days.limit(0), targets).count() == 0


def test_analog_shift(spark):
    at = lambda n, h: dt.datetime(2024, 6, n, h)
    rows = spark.createDataFrame([("a", at(n, h), a, 1000.0) for n, a in ((1, 1100.0), (2, 1300.0), (3, None)) for h in (0, 1)], "series_id string, ts timestamp_ntz, actual_mw double, forecast_mw double")
    one = spark.createDataFrame([("a", dt.date(2024, 6, 3), dt.date(2024, 6, 2)), ("a", dt.date(2024, 6, 3), dt.date(2024, 6, 1))], "series_id string, target date, day date")
    got = {r.ts: (r.forecast_mw, r.n_analogs) for r in guards.analog_shift(rows, one).collect()}
    assert got[at(3, 1)] == (pytest.approx(1140.0), 2) and got[at(1, 0)] == (1000.0, 0)
    assert {r.forecast_mw for r in guards.analog_shift(rows, one.limit(1)).where("n_analogs = 1").collect()} == {1150.0}


def test_midday_softens_with_the_day(rows):
    falling = rows.withColumns({"lag_24h_hourly_delta": F.lit(-600.0), "recent_same_business_type_delta_mean": F.lit(-800.0), "recent_same_business_type_delta_q25": F.lit(-1500.0), "same_day_latest_actual_hour": F.lit(11), "same_day_latest_hourly_delta": F.lit(0.0), "same_day_recent_hourly_delta_mean": F.lit(0.0)})
    assert by_hour(guards.pull_midday(falling), "a")[12].forecast_mw == pytest.approx(1000 - 0.75 * 700)
    soft = falling.withColumn("same_day_latest_hourly_delta", F.lit(-300.0))
    assert by_hour(guards.pull_midday(soft), "a")[12].forecast_mw == pytest.approx(1000 - 0.75 * 1500)


def test_daytime_guard(rows):
    warm = rows.withColumns({"forecast_mw": F.lit(800.0), "raw_mw": F.lit(900.0), "lag_24h": F.lit(5000.0), "temp_anomaly_7d": F.lit(0.0), "lag_168h_off": F.lit(0), "consec_holiday_len": F.lit(0), "cooling_delta_24h": F.lit(0.0)})
    assert by_hour(guards.guard_daytime(warm), "a")[12].forecast_mw == 1150.0 and by_hour(guards.guard_daytime(warm), "b")[12].forecast_mw == 800.0
    assert by_hour(guards.guard_daytime(warm), "a")[16].forecast_mw == 800.0  # demand usually falls then
    hot = warm.withColumns({"temp_anomaly_7d": F.lit(2.0), "lag_168h_off": F.lit(1)})
    assert by_hour(guards.guard_daytime(hot), "a")[12].forecast_mw == 1200.0


def test_chain_keeps_every_hour_and_its_stages(rows):
    full = rows.withColumns({"temp_anomaly_7d": F.lit(0.0), "lag_168h_off": F.lit(0), "recent_same_business_type_mean": F.lit(1000.0), "cooling_delta_24h": F.lit(0.0), "actual_mw": F.lit(1.0), **{c: F.lit(None).cast("double") for c in ("recent_same_business_type_delta_q25", "same_day_latest_hourly_delta", "same_day_recent_hourly_delta_mean", "same_day_latest_actual_mw")}, "same_day_latest_actual_hour": F.lit(None).cast("int")})
    got = guards.guard_chain(full)
    assert got.count() == 48 and {"analog_mw", "guarded_mw", "midday_mw", "shaped_mw"} <= set(got.columns)
    assert all(r.analog_mw == (3000.0 if r.series_id == "a" and r.ts.hour == 14 else 1000.0) for r in got.collect())


def test_every_rule_query_moves_rows():
    """At sf0.01, by the SQL that the driver holds against Spark: no rule compares zeros with zeros."""
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, sql in grid.ORACLE_SQL.items():
        if re.match(r"(g|ic)\d\d", name) and "shift_mw" in sql.rsplit("SELECT", 1)[-1]:
            assert c.sql(f"SELECT count(DISTINCT shift_mw) FROM ({sql})").fetchall()[0][0] > 1, name
