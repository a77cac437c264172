"""Registered queries that run a stateful stream over the tables, with DuckDB SQL for what it gives."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as tb
from .queries import _days, _out, _r, _register
from .streaming import ingest, stateful

_DELAY_DAYS = 1


def _drain(spark: SparkSession, rows: DataFrame, make, tag: str) -> DataFrame:
    """What a stream over ``rows`` gives, its input, checkpoint and output in the shared folder."""
    stateful.state_store(spark)
    folder = f"{tb.shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{folder}/in")
    stream = ingest.read_stream(spark, f"{folder}/in", rows.schema, 1_000_000).withWatermark("ts", f"{_DELAY_DAYS} DAYS")
    return stateful.drained(make(stream), f"{folder}/out", f"{folder}/state")


# Every day whose end lies a day or more before the last hour is closed.
_CLOSED = f"CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) FROM wk) - INTERVAL {_DELAY_DAYS} DAYS"
_WEEK = "wk AS (SELECT h.series_id, h.ts, CAST(h.ts AS DATE) AS day, h.actual_mw, w.actual_mw AS week_mw FROM hourly h JOIN hourly w ON w.series_id = h.series_id AND w.ts = h.ts - INTERVAL 168 HOURS)"
_LEDGER_SQL = f"""WITH {tb.DEMAND_CTES}, {_WEEK},
    dr AS (SELECT series_id, day, avg(actual_mw - week_mw) AS residual FROM wk WHERE {_CLOSED} GROUP BY 1, 2 HAVING count(*) = 24),
    rr AS (SELECT dr.*, CASE WHEN c.is_off THEN 'non_business' ELSE 'business' END AS regime FROM dr JOIN calendar c ON c.day = dr.day),
    rk AS (SELECT *, row_number() OVER w AS i, median(residual) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS middle FROM rr WINDOW w AS (PARTITION BY series_id, regime ORDER BY day))
    SELECT series_id, regime, CAST(day AS VARCHAR) AS day, least(i, 10) AS held, {_r('residual', 'CASE WHEN i >= 3 THEN greatest(-1000.0, least(1000.0, middle * 0.25)) ELSE 0.0 END AS shift_mw')} FROM rk"""


def _week_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.demand(spark, sf_dir)
    week = h.select("series_id", (F.col("ts") + F.expr("INTERVAL 168 HOURS")).alias("ts"), F.col("actual_mw").alias("week_mw"))
    return h.join(week, ["series_id", "ts"]).withColumn("ts", F.col("ts").cast("timestamp"))


@_register(_LEDGER_SQL)
def st12_ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.written(_week_rows(spark, sf_dir), "week")
    cal = tb.calendar(_days(rows), tb.DEMAND_HOLIDAYS)
    cal = tb.written(cal.select("day", "is_off"), "calendar")
    return _out(_drain(spark, rows, lambda s: stateful.regime_ledger(s, "week_mw", cal, last=10), "ledger"))


# Hours whose MW are a multiple of five never got an actual; the hour a week before is the reference.
_MISSING = "CAST(actual_mw AS BIGINT) % 5 = 0"


@_register(
    f"WITH {tb.DEMAND_CTES}, {_WEEK} SELECT series_id, CAST(day AS VARCHAR) AS day, CAST(hour(ts) AS BIGINT) AS hour, {_r(f'CASE WHEN {_MISSING} THEN week_mw ELSE actual_mw END AS actual_mw')}, CASE WHEN {_MISSING} THEN 'reference_forecast_fallback' ELSE 'observed' END AS actual_source FROM wk WHERE {_CLOSED}"
)
def st06_day_end_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _week_rows(spark, sf_dir).select("series_id", "ts", F.expr(f"CASE WHEN NOT {_MISSING} THEN actual_mw END").alias("actual_mw"), F.col("week_mw").alias("reference_mw"))
    return _out(_drain(spark, rows, stateful.day_end, "day-end"))
