"""Replays as of an origin, their intervals and the gate, on small hand cases."""

from __future__ import annotations

import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark import tables as tb
from gridspark.operators import joins, metrics
from gridspark.plans import fixed_origin, replay
from tests.conftest import SF

T0 = dt.datetime(2024, 1, 1)


def hour(n):
    return T0 + dt.timedelta(hours=n)


def plan(spark, facts, captures, lead=0, from_hour=0):
    f = spark.createDataFrame(facts, "series_id string, ts timestamp_ntz, actual_mw double")
    c = spark.createDataFrame(captures, "series_id string, captured_at timestamp_ntz")
    cal = tb.calendar(f.select(F.to_date("ts").alias("day")))
    return fixed_origin.replay(f, fixed_origin.origins(c, lead, from_hour), cal)


def facts_of(days, seed=1, series="a"):
    r = random.Random(seed)
    return [(series, hour(n), 30000.0 + r.randrange(-3000, 3000)) for n in range(24 * days)]


def test_nothing_known_later_changes_a_forecast(spark):
    """Actuals from the origin's hour on, and those of the target day, are never read."""
    facts = facts_of(31)
    target = 24 * 29  # a Tuesday, so that the day before has its type
    origin = hour(target - 24 + 9) + dt.timedelta(minutes=40)  # 09:40 of the day before
    at = lambda rows: {r.ts: (r.champion_mw, r.raw_mw, r.shift_mw, r.candidate_mw) for r in plan(spark, rows, [("a", origin)], 1).collect()}
    base = at(facts)
    assert len(base) == 24
    later = [(s, t, x + 5000 if t >= hour(target - 24 + 9) else x) for s, t, x in facts]
    assert at(later) == base
    before = [(s, t, x + 5000 if t == hour(target - 24 + 8) else x) for s, t, x in facts]
    assert at(before) != base


def test_origin_in_the_target_day_reads_nothing_of_it(spark):
    facts = facts_of(30)
    target = 24 * 28
    rows = plan(spark, facts, [("a", hour(target + 15))]).collect()
    assert {r.as_of for r in rows} == {hour(target)} and len(rows) == 24
    changed = [(s, t, x + 900 if t >= hour(target) else x) for s, t, x in facts]
    assert {(r.ts, r.candidate_mw) for r in plan(spark, changed, [("a", hour(target + 15))]).collect()} == {(r.ts, r.candidate_mw) for r in rows}


def test_forecasts_and_calibration_by_hand(spark):
    """Each target against plain Python: means of known slots, then the last three whole days of its type that are over."""
    facts = facts_of(35, seed=5)
    captures = [("a", hour(24 * d + 10)) for d in range(35)] + [("a", hour(24 * d + 20)) for d in range(35)] + [("a", None)]
    for lead in (0, 1):
        got = {r.ts: r for r in plan(spark, facts, captures, lead, 5).collect()}
        off = lambda t: t.weekday() >= 5 or (t.month, t.day) in tb.C.FIXED_HOLIDAYS
        raw, shifts = {}, {}
        for d in range(lead, 35):
            midnight = hour(24 * d)
            as_of = min(midnight, hour(24 * (d - lead) + 10))
            for n in range(24):
                t = midnight + dt.timedelta(hours=n)
                week = [x for _, u, x in facts if u < as_of and u.hour == t.hour and u.weekday() == t.weekday()][-4:]
                kind = [x for _, u, x in facts if u < as_of and u.hour == t.hour and off(u) == off(t)][-8:]
                if week and kind:
                    raw[t] = (np.mean(week), np.mean(kind), as_of)
        actual = {t: x for _, t, x in facts}
        residual = {}
        for day in sorted({t.date() for t in raw}):
            own = [t for t in raw if t.date() == day]
            if len(own) == 24:
                residual[day] = np.mean([actual[t] - raw[t][1] for t in own])
            as_of = raw[own[0]][2]
            past = [residual[k] for k in sorted(residual) if k < day and off(k) == off(day) and dt.datetime.combine(k, dt.time()) + dt.timedelta(days=1) <= as_of][-3:]
            shift = float(np.clip(np.median(past) * 0.25, -1000, 1000)) if len(past) == 3 else 0.0
            shifts[day] = shift if abs(shift) >= 0.05 else 0.0
        assert set(got) == set(raw) and any(shifts.values())
        for t, r in got.items():
            assert (r.champion_mw, r.raw_mw) == pytest.approx(raw[t][:2]) and r.shift_mw == pytest.approx(shifts[t.date()]) and r.candidate_mw == pytest.approx(r.raw_mw + r.shift_mw)
            assert r.candidate_p99_lower <= r.candidate_p95_lower <= r.candidate_mw <= r.candidate_p95_upper <= r.candidate_p99_upper


def test_replay_of_empty_tables(spark):
    assert plan(spark, [], [("a", hour(3))]).count() == 0
    assert plan(spark, facts_of(3), []).count() == 0


def paired(spark, days):
    """Rows of two hours a day with errors (new, old)."""
    rows = [("a", hour(24 * d + h), 100.0, 100.0 + new, 100.0 - old) for d, (new, old) in enumerate(days) for h in (1, 2)]
    return spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, actual_mw double, m double, r double")


def test_ratio_interval_equals_numpy_over_the_same_draws(spark):
    days = [(1.0 + d % 3, 2.0 + d % 4) for d in range(9)]
    got = metrics.paired_ratio_bootstrap(paired(spark, days), "m", "r", 500, 7).first()
    pick = np.array([[int(hashlib.md5(f"7|{b}|{k}".encode()).hexdigest()[:13], 16) % 9 for k in range(9)] for b in range(500)])
    new, old = (np.array(x)[pick].mean(axis=1) for x in zip(*days))
    assert got.valid and got.days == 9 and got.better_days == sum(a < b for a, b in days)
    assert (got.ratio_low, got.ratio_high) == pytest.approx(tuple(np.quantile(new / old, [0.025, 0.975])))
    assert (got.low, got.high) == pytest.approx(tuple(np.quantile(new - old, [0.025, 0.975])))
    assert got.mae_ratio == pytest.approx(sum(a for a, _ in days) / sum(b for _, b in days))


def test_interval_needs_days_and_finite_errors(spark):
    short = metrics.paired_ratio_bootstrap(paired(spark, [(1.0, 2.0)] * 6), "m", "r", 50).first()
    assert (short.valid, short.days, short.ratio_high, short.low) == (False, 6, None, None)
    bad = metrics.paired_ratio_bootstrap(paired(spark, [(1.0, 2.0)] * 6 + [(float("inf"), 1.0)]), "m", "r", 50).first()
    assert (bad.valid, bad.days, bad.ratio_high) == (False, 7, None)
    zero = metrics.paired_ratio_bootstrap(paired(spark, [(1.0, 0.0)] * 8), "m", "r", 50).first()
    assert zero.valid and zero.ratio_low is None and zero.mae_ratio is None and zero.low == pytest.approx(1.0)
    assert metrics.paired_bootstrap(paired(spark, [(1.0, 2.0)] * 6), "m", "r", 50).count() == 0


def test_interval_shuffles_one_row_a_day(spark):
    df = metrics.paired_ratio_bootstrap(paired(spark, [(1.0, 2.0)] * 9), "m", "r", 50)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "Join" not in text


def gate(spark, segments, cover=(95.0, 95.0, 99.0, 99.0), interval=(True, 0.9), phase="holdout"):
    """segments: name -> ((new mae, rmse, max, shape), (old ...)); '' is the whole."""
    kind = "series_id string, regime string, band string, n long, mae double, rmse double, max_error double, shape_mae double"
    side = lambda i: spark.createDataFrame([("a", k[7:] if k.startswith("regime.") else None, k[5:] if k.startswith("band.") else None, 1, *map(float, v[i])) for k, v in segments.items()], kind)
    c = spark.createDataFrame([("a", *cover)], "series_id string, champion_p95 double, candidate_p95 double, champion_p99 double, candidate_p99 double")
    i = spark.createDataFrame([("a", *interval)], "series_id string, valid boolean, ratio_high double")
    return replay.recovery_gate(side(0), side(1), c, i, phase).first()


OLD = (100, 100, 100, 100)


@pytest.mark.parametrize(
    "whole, segment, mode",
    [
        ((91, 99, 100, 100), 101, "strict"),  # 9 % better, nothing else worse, one segment 1 % worse
        ((92.5, 92, 90, 120), 101, "balanced"),  # shape worse, but all balanced limits
        ((94, 94, 94, 97), 100, "conservative"),
        ((94, 94, 94, 97), 100.5, "failed"),  # conservative allows no segment to get worse
        ((91, 101, 100, 100), 100, "failed"),  # RMSE worse
        ((97, 99, 99, 99), 100, "failed"),
    ],
)
def test_modes(spark, whole, segment, mode):
    got = gate(spark, {"": (whole, OLD), "band.morning": ((segment, 1, 1, 1), OLD)})
    assert got.mode == mode and got.passed == (mode != "failed")
    assert ("recovery_below_threshold" in got.failures) == (mode == "failed")


def test_each_failure_has_its_name(spark):
    good = {"": ((80, 80, 80, 80), OLD)}
    assert gate(spark, good).failures == ""
    assert gate(spark, good, cover=(95.0, 92.9, 99.0, 99.0)).failures == "p95_coverage_regressed"
    assert gate(spark, good, cover=(95.0, 93.0, 99.0, 97.9)).failures == "p99_coverage_regressed"
    assert gate(spark, good, cover=(95.0, None, 99.0, 99.0)).failures == "p95_coverage_regressed"
    assert gate(spark, good, interval=(True, 1.0)).failures == "interval_does_not_confirm"
    assert gate(spark, good, interval=(False, None)).failures == "interval_does_not_confirm"
    worse = gate(spark, {**good, "regime.business": ((100.5, 1, 1, 1), OLD), "band.evening": ((106, 1, 1, 1), OLD)})
    assert worse.failures == "band.evening_mae_regressed,recovery_below_threshold,regime.business_mae_regressed" and worse.regressed == "band.evening"
    early = gate(spark, {"": ((100, 99, 99, 99), OLD), "regime.business": ((104, 1, 1, 1), OLD)}, interval=(False, None), phase="development")
    assert (early.mode, early.failures) == ("development", "overall_mae_not_improved")


def test_masks_read_the_days_of_their_targets_only(spark):
    facts = spark.createDataFrame(facts_of(10), "series_id string, ts timestamp_ntz, actual_mw double")
    targets = spark.createDataFrame([("a", hour(24 * 8).date()), ("a", hour(24 * 9).date())], "series_id string, target date")
    rows = joins.mask_target_actuals(facts, targets, days=3).collect()
    assert len(rows) == 2 * 4 * 24 and all((r.actual_mw is None) == (r.ts.date() >= r.target) for r in rows)
    origins = spark.createDataFrame([("a", hour(24 * 8 + 9) + dt.timedelta(minutes=5))], "series_id string, captured_at timestamp_ntz")
    rows = joins.mask_unknown(facts, origins, days=2).collect()
    assert {r.ts for r in rows} == {hour(n) for n in range(24 * 6, 24 * 10)} and all((r.actual_mw is None) == (r.ts >= hour(24 * 8 + 9)) for r in rows)
