"""Refits at cut-offs against fits of the rows themselves, and features as of a time against those of known rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import tables as tb
from gridspark.operators import features
from gridspark.plans import refit

DAY = dt.datetime(2024, 3, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for s in ("a", "b"):
        for h in range(24 * 12):
            x1, x2 = rng.gauss(30000, 2000), rng.gauss(29000, 1500)
            data.append((s, DAY + dt.timedelta(hours=h), 500 + 0.6 * x1 + 0.3 * x2 + rng.gauss(0, 200) if rng.random() > 0.05 else None, x1, x2 if rng.random() > 0.05 else None))
    return spark.createDataFrame(data, "series_id string, ts timestamp_ntz, actual_mw double, x1 double, x2 double").cache()


def cutoffs(spark, days, series=("a", "b")):
    return spark.createDataFrame([(s, (DAY + dt.timedelta(days=d)).date()) for s in series for d in days], "series_id string, cutoff date")


@pytest.mark.parametrize("train_days", [None, 3])
def test_every_cutoff_equals_its_own_fit(spark, rows, train_days):
    held = rows.toPandas()
    got = refit.holdout(rows, ("x1", "x2"), cutoffs(spark, (2, 5, 11)), 2, train_days, 30000.0, 1000.0).toPandas()
    assert set(got.cutoff.astype(str)) == {"2024-03-03", "2024-03-06", "2024-03-12"}
    for (s, cut), own in got.groupby(["series_id", "cutoff"]):
        days = (held.ts.dt.date - cut).map(lambda d: d.days)
        known = held[(held.series_id == s) & held.actual_mw.notna() & held.x2.notna()]
        past = known[(days < 0) & ((days >= -train_days) if train_days else True)]
        z = np.column_stack([np.ones(len(past)), past.x1, past.x2])
        beta = np.linalg.lstsq(z, past.actual_mw, rcond=None)[0]
        test = known[days.between(0, 1)].sort_values("ts")
        assert set(own.n_train) == {len(past)}
        assert own.sort_values("ts").ts.tolist() == test.ts.tolist()
        assert np.allclose(own.sort_values("ts").forecast_mw, np.column_stack([np.ones(len(test)), test.x1, test.x2]) @ beta, rtol=1e-7)


def test_cutoffs_without_a_fit_have_no_rows(spark, rows):
    assert refit.holdout(rows, ("x1", "x2"), cutoffs(spark, (0,))).count() == 0  # nothing before it
    flat = rows.withColumn("x2", F.col("x1"))
    assert refit.holdout(flat, ("x1", "x2"), cutoffs(spark, (5,))).count() == 0  # columns that say the same
    assert refit.holdout(flat, ("x1", "x2"), cutoffs(spark, (5,)), ridge=1.0).count() > 0
    assert refit.holdout(rows.limit(0), ("x1",), cutoffs(spark, (5,))).count() == 0
    before = refit.moments_before(refit.day_moments(rows, ("x1",)), cutoffs(spark, (30,), ("a", "c"))).collect()
    assert {(r.series_id, r.n > 0) for r in before} == {("a", True), ("c", False)}


def test_report(spark):
    tested = spark.createDataFrame([("a", DAY.date(), 100.0, 90.0, 120.0, 7), ("a", DAY.date(), 100.0, 110.0, 80.0, 7)], "series_id string, cutoff date, actual_mw double, forecast_mw double, other double, n_train long")
    r = refit.holdout_report(tested, "other").first()
    assert (r.hours, r.n_train, r.mae, r.rmse, r.wape, r.reference_mae, r.improvement_pct, r.better) == (2, 7, 10.0, 10.0, 10.0, 20.0, 50.0, "model")


def test_inference_equals_training(spark):
    rng = random.Random(6)
    hours = [(s, DAY + dt.timedelta(hours=h), round(rng.uniform(1, 9), 2)) for s in ("a", "b") for h in range(24 * 40) if rng.random() > 0.1]
    h = spark.createDataFrame(hours, "series_id string, ts timestamp_ntz, actual_mw double")
    targets = h.select("series_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("as_of"))
    cal = tb.calendar(h.select(F.to_date("ts").alias("day")))
    names = ("roll_4w_mean", "roll_4w_std", "recent_same_business_type_mean", "recent_same_business_type_delta_mean")
    value = lambda x: None if x is None else round(x, 9)
    rows_of = lambda df: sorted((r.series_id, r.ts, *[value(r[n]) for n in names]) for r in df.collect())
    assert rows_of(features.inference_slots(h, targets, cal)) == rows_of(features.slot_features(features.lag_features(h), cal))
    # Two days ahead of the same hour: nothing later than as_of is looked at.
    early = targets.withColumn("as_of", F.col("as_of") - F.expr("INTERVAL 14 DAYS"))
    shorter = h.where(F.col("ts") < DAY + dt.timedelta(days=20))
    at = early.where(F.col("as_of") < DAY + dt.timedelta(days=20))
    assert rows_of(features.inference_slots(h, at, cal)) == rows_of(features.inference_slots(shorter, at, cal))
    assert features.inference_slots(h, targets.limit(0), cal).count() == 0
