"""Gates of the experts, merged weather, digests of snapshots and the limits of ledgers, on rows worked out by hand."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from gridspark import model_queries
from gridspark import queries as grid
from gridspark.operators import quality, weather_prep
from gridspark.plans import experts
from gridspark.sources import documents, sinks
from tests.test_queries import TABLES

DAY = dt.datetime(2024, 7, 4)
SCHEMA = "series_id string, ts timestamp_ntz, is_non_business_day int, lag_24h double, lag_last_biz_hour double, lag_last_nonhol_hour double, lag_24h_business_type_mismatch int, cooling_delta_24h double, a double, b double, c double, part boolean"


def gated(spark, level=None, **of):
    base = {"is_non_business_day": 0, "lag_24h": 1000.0, "lag_last_biz_hour": 1.0, "lag_last_nonhol_hour": 1.0, "lag_24h_business_type_mismatch": 0, "cooling_delta_24h": -2.0, "a": 1100.0, "b": 1200.0, "c": 1300.0, "part": False} | of
    rows = spark.createDataFrame([("s", DAY + dt.timedelta(hours=h), *base.values()) for h in range(24)], SCHEMA)
    one = lambda d, n: {"direct": F.col(d), "lag_residual": F.lit(40.0), "non_business": F.col(n)}
    got = experts.gated(rows, one("a", "b"), one("b", "c"), one("c", "a"), {"direct": F.lit(7.0), "non_business": F.lit(8.0)}, F.col("part"), level)
    assert got.count() == 24
    r = got.first()
    return r.legacy_mw, r.forecast_mw, r.gates


def test_views_and_their_gates(spark):
    # Legacy (1100 + 1040) / 2; views (1200 + 1040) / 2 and (1300 + 1040) / 2.
    assert gated(spark) == (1070.0, 1145.0, "")
    # Half of the cooling is gone: the lag expert has a quarter.
    assert gated(spark, lag_24h_business_type_mismatch=1) == (1070.0, 1197.5, "attenuated")
    assert gated(spark, part=True) == (1070.0, 1250.0, "partial_lags")
    # Days off: specialists in halves (1250 and 1200), 0.4 of the full view.
    assert gated(spark, is_non_business_day=1) == (1100.0, pytest.approx(0.4 * 1100 + 0.6 * 1225), "specialist")
    assert gated(spark, c=9000.0) == (1070.0, 1570.0, "trust_region")
    assert gated(spark, lag_last_biz_hour=None) == (1070.0, 7.0, "lags_unavailable")
    assert gated(spark, lag_24h=None, is_non_business_day=1) == (1100.0, 8.0, "lags_unavailable,specialist")
    assert gated(spark, level=F.lit(2145.0)) == (1070.0, 1345.0, "daily_level")
    assert gated(spark, level=F.lit(99999.0))[1] == 1895.0


def test_every_gate_decides_hours_of_the_tables():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    gates = {g for (x,) in c.sql(f"SELECT gates FROM ({grid.ORACLE_SQL['m06_m11_gated_experts']})").fetchall() for g in x.split(",")}
    assert {"lags_unavailable", "partial_lags", "attenuated", "specialist", "trust_region", "daily_level"} <= gates
    assert model_queries.experts is experts


def test_merged_weather(spark):
    at = lambda h: DAY + dt.timedelta(hours=h)
    schema = "series_id string, ts timestamp_ntz, temp_c double, humidity_pct double"
    official = spark.createDataFrame([("a", at(0), 20.04, None), ("a", at(0), 19.0, 55.0), ("a", at(2), None, 50.0)], schema)
    fallback = spark.createDataFrame([("a", at(0), 1.0, 2.0), ("a", at(1), 18.25, None), ("a", at(2), 17.0, 3.0), ("b", at(0), None, None)], schema)
    got = {(r.series_id, r.ts.hour): tuple(r)[2:] for r in weather_prep.merge_sources(official, fallback, ("temp_c", "humidity_pct")).collect()}
    assert got == {("a", 0): (20.0, "official", 55.0, "official"), ("a", 1): (18.2, "fallback", None, None), ("a", 2): (17.0, "fallback", 50.0, "official"), ("b", 0): (None, None, None, None)}
    assert weather_prep.merge_sources(official, fallback.limit(0), ("temp_c",)).count() == 2


def test_digests_do_not_depend_on_partitions_and_find_one_cell(spark):
    rows = spark.createDataFrame([("a", DAY + dt.timedelta(hours=h), h * 1.5, None if h % 5 == 0 else h) for h in range(60)], "series_id string, ts timestamp_ntz, x double, y int")
    digests = lambda df: {(r.day, r.column_name): (r.n, r.n_known, r.digest) for r in quality.snapshot_digests(df, ("x", "y")).collect()}
    want = digests(rows)
    assert digests(rows.repartition(7, "x")) == want == digests(rows.orderBy(F.desc("ts")).coalesce(1)) and len(want) == 6
    changed = rows.withColumn("y", F.when(F.hour("ts") == 5, F.lit(None)).otherwise(F.col("y"))).where(F.col("ts") < DAY + dt.timedelta(hours=48))
    found = quality.changed_digests(quality.snapshot_digests(rows, ("x", "y")), quality.snapshot_digests(changed, ("x", "y"))).collect()
    day = lambda n: (DAY + dt.timedelta(days=n)).date()
    # Hour 5 of the first day was unknown already.
    assert {(r.day, r.column_name, r.change) for r in found} == {(day(1), "y", "changed"), (day(2), "x", "removed"), (day(2), "y", "removed")}


def test_vintage_ledger_counts_what_it_holds(spark):
    at = lambda d, h: DAY + dt.timedelta(days=d, hours=h)
    schema = "series_id string, captured_at timestamp_ntz, ts timestamp_ntz, mw double"
    ledger = spark.createDataFrame([("a", at(0, h), at(1, 5), 1.0) for h in range(3)] + [("a", at(-130, 0), at(-129, 0), 1.0)], schema)
    captures = spark.createDataFrame([("a", at(0, h), at(1, 5), 2.0) for h in range(8)] + [("a", at(2, 0), at(1, 5), 2.0), ("b", at(0, 0), at(1, 0), 2.0)], schema)
    got = sinks.append_vintages(ledger, captures, 5)
    assert got.columns == captures.columns
    assert {(r.series_id, r.captured_at) for r in got.collect()} == {("a", at(0, 3)), ("a", at(0, 4)), ("b", at(0, 0))}
    assert sinks.append_vintages(ledger.limit(0), captures, 5).count() == 6
    assert sinks.retained_vintages(ledger, F.lit(DAY.date())).count() == 3


def test_calibrations_keep_a_day_of_hours_and_two_weeks(spark):
    rows = spark.createDataFrame([("a", (DAY + dt.timedelta(days=d)).date(), DAY + dt.timedelta(days=d, minutes=m)) for d in range(20) for m in range(30)], "series_id string, day date, taken_at timestamp_ntz")
    kept = documents.append_calibrations(rows.limit(0), rows)
    assert kept.count() == 24 * 14
