"""The ordered corrector on small days worked out by hand, and that every rule moves hours of the tables."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from gridspark import corrector_queries as cq
from gridspark.operators import corrector
from tests.test_queries import TABLES

DAY = dt.datetime(2024, 7, 4)
FEATURES = ("is_non_business_day", "lag_24h", "lag_24h_hourly_delta", "recent_same_business_type_mean", "recent_same_business_type_delta_mean", "lag_24h_business_type_mismatch", "temp_c", "temp_delta_1h", "temp_delta_24h", "cooling_delta_1h", "cooling_delta_24h", "discomfort_index", "humidity")
SCHEMA = "series_id string, ts timestamp_ntz, actual_mw double, forecast_mw double, " + ", ".join(f"{f} double" for f in FEATURES)


class Days:
    """Small days, each a series of one table that is corrected once for all tests."""

    def __init__(self):
        self.rows, self.got = [], None

    def add(self, actuals, forecasts, features=None, carried=None):
        features = features or {}
        of = lambda f, h: features[f][h] if isinstance(features.get(f), list) else features.get(f)
        f = forecasts if isinstance(forecasts, list) else [forecasts] * 24
        num = lambda v: None if v is None else float(v)
        name = f"d{len(self.rows) // 24}"
        self.rows += [(name, DAY + dt.timedelta(hours=h), num(actuals.get(h)), float(f[h]), *[num(of(n, h)) for n in FEATURES], num(carried and carried[0]), num(carried and carried[1])) for h in range(24)]
        return name

    def run(self, spark, **switches):
        df = spark.createDataFrame(self.rows, SCHEMA + ", carried_mw double, carried_hour double")
        self.got = {}
        for r in corrector.correct(df, **switches).collect():
            self.got.setdefault(r.series_id, {})[r.ts.hour] = (r.corrected_mw, r.reasons)


DAYS, SHAPED = Days(), Days()


@pytest.fixture(scope="module")
def shaped(spark):
    SHAPED.run(spark, shape_guard=True)
    return SHAPED.got


@pytest.fixture(scope="module")
def got(spark):
    DAYS.run(spark)
    return DAYS.got


_D1 = DAYS.add({h: 1000.0 + d for h, d in ((0, 100), (1, 200), (2, 300))}, 1000.0, {"lag_24h_hourly_delta": 5000})


def test_residuals_fade_with_the_lead(got):
    at = got[_D1]
    # Mean 200, of which 0.6, then 0.92 an hour to a tenth.
    assert [at[h][0] for h in (2, 3, 4, 5)] == [1000.0, 1120.0, 1110.4, 1101.6] and at[3][1] == "observed_residual" and at[2][1] == ""


_D2 = DAYS.add({h: 5000.0 for h in range(3)}, 1000.0)


def test_adjustments_are_capped(got):
    at = got[_D2]
    assert at[3][0] == 2200.0


_D3 = DAYS.add({0: 2000.0, 1: 1800.0}, 1000.0, carried=(-800, 23))
_D4 = DAYS.add({0: 2000.0, 1: 900.0}, 1000.0)
_D5 = DAYS.add({}, 1000.0, carried=(-800, 23))
_D6 = DAYS.add({}, 1000.0, carried=(-800, 15))


def test_early_and_day_boundary(got):
    at = got[_D3]
    assert at[2] == (1450.0, "early_carryover") and at[1] == (1000.0, "")
    assert got[_D4][2] == (1000.0, "")  # of different signs
    at = got[_D5]
    assert at[0] == (700.0, "day_boundary") == at[23]  # 800 * 0.5 * 0.75
    assert got[_D6][0][1] == ""  # too old


hot = {"lag_24h": 9000, "recent_same_business_type_mean": 1000, "temp_delta_24h": -5, "lag_24h_business_type_mismatch": 1, "is_non_business_day": 1}
_D7 = DAYS.add({}, 9000.0, hot)


def test_priors_and_their_cap(got):
    at = got[_D7]
    # Day level -700 (capped), then the prior -500 of what stands 900 over the usual level; together no more than 900.
    assert at[5] == (8100.0, "day_level,transition_prior,prior_stack_cap")


hot = {"lag_24h": 9000, "recent_same_business_type_mean": 5000, "lag_24h_business_type_mismatch": 1, "is_non_business_day": 1}
_D8 = DAYS.add({h: 8500.0 for h in range(8)}, 9000.0, hot)


def test_transition_after_the_morning(got):
    at = got[_D8]
    # Over by 9000 - 5900 = 3100, of which 0.55 is 1705: capped at 1200; then the residual of -500 by 0.6.
    assert at[12][1] == "transition,observed_residual" and at[12][0] == pytest.approx(7800 - 300 * 0.92**4, abs=0.06)


_D9 = DAYS.add({h: 2000.0 for h in range(13)}, 1000.0, {"lag_24h_hourly_delta": 0, "recent_same_business_type_delta_mean": -10})


def test_afternoon_damping_without_support(got):
    at = got[_D9]
    # 600, of which 0.4 is kept up to six hours ahead.
    assert at[13] == (1240.0, "observed_residual,afternoon_damping") and at[19][1] == "observed_residual"


actual = {5: 20000.0, 6: 21500.0, 7: 23000.0}
_D10 = DAYS.add(actual, [20500.0, *[20500.0] * 5, 22000.0, 23800.0, 23400.0, 23600.0] + [24000.0] * 14, {"is_non_business_day": 0})


def test_morning_ramp_is_restored(got):
    at = got[_D10]
    # Residuals -500, -500, -800: -360; floor 23000 + 375 an hour, restored to it.
    assert at[8] == (23375.0, "observed_residual,morning_ramp") and at[9] == (23600.0, "observed_residual,morning_ramp")


_D11 = DAYS.add({h: 20000.0 for h in range(12)}, [21000.0] * 12 + [19800.0] * 12, {"is_non_business_day": 1})


def test_continuity_floor_of_days_off(got):
    at = got[_D11]
    # -600 at 12 h gives 19200, under 20000 - 500.
    assert at[12] == (19500.0, "observed_residual,continuity_floor")


_D12 = DAYS.add({h: 20000.0 for h in range(16)}, [21000.0] * 16 + [20000.0] * 8, {"is_non_business_day": 0})
falling = {h: 20000.0 for h in range(15)} | {15: 19000.0}
_D13 = DAYS.add(falling, [21000.0] * 15 + [20000.0] + [19000.0] * 8, {"is_non_business_day": 0, "lag_24h_hourly_delta": -900, "recent_same_business_type_delta_mean": -700})


def test_near_floor_and_its_damping(got):
    at = got[_D12]
    assert at[16] == (19850.0, "observed_residual,near_floor")
    at = got[_D13]
    # Floor 19000 - 150 - 250; 18400 is 200 short, a quarter of that is less than 100.
    assert at[16] == (18400.0, "observed_residual")


actual = {6: 20000.0, 7: 22000.0, 8: 24000.0}
_D14 = DAYS.add(actual, [19900.0] * 6 + [20000.0, 22000.0, 24000.0] + [24100.0] * 15, {"is_non_business_day": 0, "lag_24h_hourly_delta": 1000})


def test_observed_ramp_lifts_as_far_as_support_goes(got):
    at = got[_D14]
    # Climb 2000 by 0.85, but half of the support of 1000 an hour.
    assert at[9] == (24500.0, "observed_ramp") and at[10] == (25000.0, "observed_ramp") and at[11] == (24100.0, "")


_D15 = DAYS.add({h: 21000.0 for h in range(12)}, 20000.0, {"is_non_business_day": 0, "temp_delta_24h": 4, "lag_24h_hourly_delta": 2000, "recent_same_business_type_delta_mean": 2000})
_D16 = DAYS.add({h: 21000.0 for h in range(12)}, 20000.0, {"is_non_business_day": 0, "lag_24h_hourly_delta": 2000})


def test_daytime_lift(got):
    at = got[_D15]
    # Adjusted by 600; pressure 1000 leaves 200 of it after a slack of 200: 110, less than the floor's 0.5 * (20700 - 20600).
    assert at[12] == (20710.0, "observed_residual,daytime_lift")
    assert "daytime_lift" not in got[_D16][12][1]


actual = {h: 30000.0 for h in range(12)} | {12: 29000.0}
_D17 = DAYS.add(actual, [30000.0] * 12 + [29000.0] + [31000.0] * 11, {"is_non_business_day": 0, "lag_24h_hourly_delta": 400})


def test_post_lunch_cap(got):
    at = got[_D17]
    assert at[13] == (30100.0, "post_lunch")  # 31000 - 900; the cap is 29640
    assert at[14][1] == "post_lunch" and at[15][1] == ""


actual = {6: 20000.0, 7: 20500.0, 8: 21000.0}
_D18 = DAYS.add(actual, [21000.0] * 6 + [21000.0, 21500.0, 22000.0] + [24000.0] * 15, {"is_non_business_day": 0, "temp_delta_24h": 3, "lag_24h_hourly_delta": 500})
_D19 = DAYS.add(actual, [21000.0] * 6 + [21000.0, 21500.0, 22000.0] + [24000.0] * 15, {"is_non_business_day": 0, "lag_24h_hourly_delta": [500.0] * 10 + [None] + [500.0] * 13})


def test_morning_warm_and_anchor(got):
    at = got[_D18]
    # -600 leaves 23400; cap 21000 + 800: 1200 of 1600 is more than 800, leaving 22600; anchor 21000 + 500: 1000 more.
    assert at[9] == (21600.0, "observed_residual,morning_warm,morning_anchor")
    at = got[_D19]
    assert at[9][1] == "observed_residual,morning_anchor" and at[10][1] == "observed_residual" and at[11][1] == "observed_residual"  # support unknown from 10 h on


_D20 = DAYS.add({h: 30000.0 for h in range(14)}, [30000.0] * 11 + [30800.0] * 3 + [32000.0] * 10, {"is_non_business_day": 1, "lag_24h_hourly_delta": -100})
_D21 = DAYS.add({h: 30000.0 for h in range(14)}, [30000.0] * 11 + [31500.0] * 3 + [32000.0] * 10, {"is_non_business_day": 1, "lag_24h_hourly_delta": -100})


def test_afternoon_anchor(got):
    at = got[_D20]
    # -480 leaves 31520; cap 30000 + 350: 0.75 of 1170 is 877.5.
    assert at[14] == (30642.5, "observed_residual,afternoon_anchor")
    at = got[_D21]
    # Severe: -900 leaves 31100, of which all over 30000 goes.
    assert at[14] == (30000.0, "observed_residual,afternoon_anchor")


actual = {h: 30000.0 for h in range(14)} | {14: 29500.0, 15: 28900.0}
_D22 = DAYS.add(actual, [30000.0] * 14 + [29500.0, 28900.0, 28800.0, 30500.0] + [28000.0] * 6, {"is_non_business_day": 0, "lag_24h_hourly_delta": -100, "recent_same_business_type_delta_mean": -100})


def test_evening_decline_looks_at_the_corrected_hour_before(got):
    at = got[_D22]
    # 17 h rebounds by 1700 over 16 h: all over 28800 + 600 goes, at most 900.
    assert at[16] == (28800.0, "") and at[17] == (29600.0, "evening_decline") and at[18][1] == ""


actual = {h: 30000.0 for h in range(13)}
_D23 = SHAPED.add(actual, [30000.0] * 15 + [28000.0, 27900.0, 26900.0] + [26000.0] * 6, {"is_non_business_day": 0})
_D24 = DAYS.add(actual, [30000.0] * 15 + [28000.0] * 9, {"is_non_business_day": 0})


def test_shape_guard_carries_on(got, shaped):
    at = shaped[_D23]
    assert at[15] == (29000.0, "shape_guard") and at[16] == (28000.0, "shape_guard") and at[17] == (27000.0, "shape_guard")
    assert got[_D24][15] == (28000.0, "")


_D25 = DAYS.add({h: 30000.0 for h in range(12)}, [30000.0] * 12 + [33000.0] * 12)
falling = {h: 30000.0 for h in range(17)} | {17: 29000.0}
low = [30000.0] * 17 + [29000.0] + [20000.0] * 6
_D26 = DAYS.add(falling, low, {"is_non_business_day": 0})
_D27 = DAYS.add(falling, low, {"is_non_business_day": 0, "lag_24h_hourly_delta": -1000, "recent_same_business_type_delta_mean": -950})


def test_ramp_guard_and_decline_support(got):
    at = got[_D25]
    assert [at[h][0] for h in (12, 13, 14, 15)] == [31800.0, 32400.0, 33000.0, 33000.0]
    assert got[_D26][18][0] == 27400.0
    assert got[_D27][18][0] == 26400.0


_D28 = DAYS.add({}, 1000.0)
_D29 = DAYS.add({0: 900.0, 4: 900.0, 9: 900.0}, 1000.0)
_D30 = DAYS.add({h: 900.0 for h in range(24)}, 1000.0)


def test_odd_days(got):
    assert all(v == (1000.0, "") for v in got[_D28].values())
    gaps = got[_D29]  # hours that do not follow each other
    assert gaps[10] == (940.0, "observed_residual") and gaps[5][1] == ""
    assert all(v[1] == "" for v in got[_D30].values())


def test_fallback_hours_and_bands(spark):
    rows = [("a", DAY + dt.timedelta(hours=h), 1300.0 if h < 4 else None, 1000.0, "forecast_fallback" if h == 3 else "observed", 900.0, 1100.0) for h in range(6)]
    df = spark.createDataFrame(rows, "series_id string, ts timestamp_ntz, actual_mw double, forecast_mw double, actual_source string, p95_lower_mw double, p95_upper_mw double")
    got = {r.ts.hour: r for r in corrector.correct(df).collect()}
    assert got[4].n_observed == 3 and got[3].corrected_mw == 1180.0 and (got[3].p95_lower_mw, got[3].p95_upper_mw) == (1080.0, 1280.0)
    assert corrector.correct(df.limit(0)).count() == 0


def test_every_rule_moves_hours_of_the_tables():
    """By the SQL, which test_queries and the driver hold against Spark."""
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    hours = dict(c.sql(f"SELECT rule, count(*) FROM ({cq._corrector_sql() + cq._TRACE}) GROUP BY 1").fetchall())
    assert set(corrector.RULES) - set(hours) == {"shape_guard"}  # off by default
    assert c.sql(f"SELECT count(*) FROM ({cq._corrector_sql(True, True, True) + cq._HOURS}) WHERE reasons LIKE '%shape_guard%'").fetchall()[0][0] > 0
