"""The boosted model, humidity ladder, bias correction and insights on small series."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridspark import tables
from gridspark.operators import features, weather_prep
from gridspark.plans import boosted, reports

START = dt.datetime(2024, 1, 1)


def test_boosted_model_beats_the_level_and_ignores_the_target_day(spark):
    rows = [(s, START + dt.timedelta(hours=h), level + 3000 * math.sin(math.pi * (h % 24) / 12) + (h * 7919 % 97)) for s, level in (("a", 20000.0), ("b", 40000.0)) for h in range(24 * 35)]
    h = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, actual_mw double")
    build = lambda x: features.slot_features(features.lag_features(x), tables.calendar(x.select(F.to_date("ts").alias("day")))).cache()
    day = dt.date(2024, 2, 4)
    model = boosted.fit(build(h), day, trees=5)
    target = build(h).where(F.to_date("ts") == day)
    got = boosted.predict(model, target).join(h, ["series_id", "ts"])
    assert got.count() == 48 and got.agg(F.avg(F.abs(F.col("forecast_mw") - F.col("actual_mw")))).first()[0] < 1500
    assert got.where("p99_lower_mw > p95_lower_mw OR p95_lower_mw > forecast_mw OR p95_upper_mw > p99_upper_mw").count() == 0
    hidden = h.withColumn("actual_mw", F.when(F.to_date("ts") == F.lit(day), 0.0).otherwise(F.col("actual_mw")))
    same = boosted.predict(model, build(hidden).where(F.to_date("ts") == day))
    order = lambda x: [r.forecast_mw for r in x.orderBy("series_id", "ts").collect()]
    assert order(same) == order(got)
    with pytest.raises(ValueError, match="training rows"):
        boosted.fit(build(h), dt.date(2024, 1, 16), trees=2)


def test_humidity_ladder(spark):
    schema = "series_id string, ts timestamp_ntz, temp_c double, humidity_pct double, weather_source string"
    at = lambda h: START + dt.timedelta(hours=h)
    f = spark.createDataFrame([("a", at(h), 20.0, 55.0 if h == 0 else None, "forecast") for h in (0, 1, 9, 10)], schema)
    o = spark.createDataFrame([("a", at(-1), 20.0, 40.0, "observed")], schema)
    s = spark.createDataFrame([("a", at(9), 20.0, 66.0, "other"), ("a", at(1), 20.0, 1.0, "other")], schema)
    got = [(r.humidity_pct, r.weather_source) for r in weather_prep.fill_humidity(f, o, s).orderBy("ts").collect()]
    assert got == [(55.0, "forecast"), (40.0, "forecast+humidity_carried"), (66.0, "forecast+humidity_secondary"), (52.0, "forecast+humidity_seasonal")]


def test_continuity_bias(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    o = spark.createDataFrame([("a", at(h), 10.0 + 0.5 * h) for h in range(4)], "series_id string, ts timestamp_ntz, temp_c double")
    f = spark.createDataFrame([("a", at(4 + h), 10.0) for h in range(5)] + [("b", at(4), 10.0)], "series_id string, ts timestamp_ntz, temp_c double")
    got = [r.temp_c for r in weather_prep.continuity_bias(o, f).where("series_id = 'a'").orderBy("ts").collect()]
    assert got == pytest.approx([10 + 1.4, 10 + 1.4 * 0.6, 10 + 1.4 * 0.36, 10.0, 10.0])


def test_insights_keep_their_order_and_limit(spark):
    rows = [("a", START + dt.timedelta(hours=h), 30000.0 + (5000 if h == 9 else 0), 29000.0 - (3000 if h == 17 else 0), 30000.0) for h in range(24)]
    got = reports.insights(spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, actual_mw double, model_mw double, reference_mw double")).orderBy("rank").collect()
    assert [r.code for r in got] == ["reference_closer_overall", "morning_ramp_underestimated", "daytime_level_underestimated", "afternoon_plateau_underestimated", "large_single_hour_miss"]
