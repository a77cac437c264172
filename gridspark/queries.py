"""Registered queries over the event and order tables, and the same rows as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as tb
from .functions import constants as C
from .functions import scalars as S
from .operators import anomaly, features, intervals, intraday, joins, metrics, quality, weather_prep
from .plans import baseline, evaluation, reports
from .sources import files, sinks

DIGITS = 4
#: Added before rounding: means of a few cents end in a 5 at the digit after the last, where engines differ.
OFF_TIES = tb.OFF_TIES
#: Alert limits at the scale of these tables: MW and percent for a warning and a critical breach, MW for drift.
BREACH, DRIFT = ((3.0, 1.0), (5.0, 2.0)), 8.0
#: And of the reports' limits in MW.
SCALE = 0.01


def _out(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles rounded, times and days as text, so that engines agree on every value."""
    columns = []
    for name, kind in df.dtypes:
        if keep and name not in keep:
            continue
        c = F.col(name)
        columns.append((F.round(c + OFF_TIES, DIGITS) if kind == "double" else c.cast("string") if kind.startswith(("timestamp", "date")) else c.cast("long") if kind in ("int", "smallint", "tinyint") else c).alias(name))
    return df.select(*columns)


def _days(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_date("ts").alias("day"))


def _r(*columns: str) -> str:
    parts = [c.rpartition(" AS ")[::2] for c in columns]
    return ", ".join(f"round({value or name} + {OFF_TIES:.12f}, {DIGITS}) AS {name}" for value, name in parts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Inputs and baseline ---------------------------------------------------------------------------------------------

_DAYS = "SELECT CAST(ts AS DATE) AS day FROM hourly"


def _baseline_cte(history: str, targets: str) -> str:
    """CTE ``fc`` of the seasonal baseline over CTEs history (series_id, ts, actual_mw), targets and calendar."""
    doy = "CAST(dayofyear(t.target) AS INT)"
    first = "CAST(date_trunc('year', h.day) AS DATE)"
    season = lambda n: f"year(t.target) - year(h.day) BETWEEN 1 AND 5 AND h.day BETWEEN {first} + greatest(0, {doy} - {n} - 1) AND {first} + least(364, {doy} + {n} - 1)"
    return f"""hh AS (SELECT s.*, CAST(ts AS DATE) AS day, hour(ts) AS hour, c.is_holiday FROM {history} s JOIN calendar c ON c.day = CAST(s.ts AS DATE) WHERE actual_mw IS NOT NULL),
    tt AS (SELECT x.series_id, x.target, c.is_holiday AS th FROM {targets} x JOIN calendar c ON c.day = x.target),
    usual AS (SELECT t.series_id, t.target, h.hour, h.actual_mw FROM tt t JOIN hh h ON t.series_id = h.series_id AND isodow(t.target) = isodow(h.day) AND NOT h.is_holiday WHERE h.day < t.target AND (h.day >= t.target - 84 OR ({season(28)}))),
    rest AS (SELECT t.series_id, t.target, h.day, h.hour, h.actual_mw FROM tt t JOIN hh h ON t.series_id = h.series_id AND t.th AND h.is_holiday WHERE h.day < t.target AND {season(30)}),
    enough AS (SELECT series_id, target FROM rest GROUP BY 1, 2 HAVING count(DISTINCT day) >= 4),
    rr AS (SELECT * FROM usual WHERE (series_id, target) NOT IN (SELECT (series_id, target) FROM enough) UNION ALL SELECT series_id, target, hour, actual_mw FROM rest WHERE (series_id, target) IN (SELECT (series_id, target) FROM enough)),
    ff AS (SELECT series_id, target, hour, avg(actual_mw) AS m, coalesce(stddev_samp(actual_mw), 0) AS s, count(*) AS n FROM rr GROUP BY 1, 2, 3 HAVING count(*) >= 4),
    fc AS (SELECT series_id, CAST(target AS TIMESTAMP) + to_hours(CAST(hour AS INT)) AS ts, m AS forecast_mw, m - 1.96 * s AS p95_lower_mw, m + 1.96 * s AS p95_upper_mw, m - 2.576 * s AS p99_lower_mw, m + 2.576 * s AS p99_upper_mw, n FROM ff)"""


_BANDS = ("forecast_mw", "p95_lower_mw", "p95_upper_mw", "p99_lower_mw", "p99_upper_mw")
_HOURLY_TARGETS = "targets AS (SELECT DISTINCT series_id, CAST(ts AS DATE) AS target FROM hourly)"
_HOURLY_FC = tb.with_ctes("hourly", more=f"{tb.calendar_ctes(_DAYS)}, {_HOURLY_TARGETS}, {_baseline_cte('hourly', 'targets')}")


def _forecast(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = tb.hourly(spark, sf_dir)
    targets = h.select("series_id", F.to_date("ts").alias("target")).distinct()
    return h, baseline.seasonal_baseline(h, targets, tb.calendar(_days(h)))


@_register(_HOURLY_FC + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r(*_BANDS)}, n FROM fc")
def m01_baseline_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_forecast(spark, sf_dir)[1])


_DAILY_FC = tb.with_ctes("daily", more=f"dts AS (SELECT series_id, CAST(day AS TIMESTAMP) AS ts, actual_mw FROM daily), {tb.calendar_ctes('SELECT day FROM daily')}, targets AS (SELECT series_id, day AS target FROM daily), {_baseline_cte('dts', 'targets')}")


@_register(_DAILY_FC + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r(*_BANDS)}, n FROM fc")
def m02_baseline_seasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years of days: same-season weekdays, and holidays from holidays."""
    d = tb.daily(spark, sf_dir)
    h = d.select("series_id", F.col("day").cast("timestamp_ntz").alias("ts"), "actual_mw")
    targets = d.select("series_id", F.col("day").alias("target"))
    return _out(baseline.seasonal_baseline(h, targets, tb.calendar(d)))


# Alerts ------------------------------------------------------------------------------------------------------------


def _facts(h: DataFrame) -> DataFrame:
    most = h.groupBy("series_id").agg(F.max("actual_mw").alias("supply_mw"))
    return h.join(most, "series_id").withColumn("usage_pct", 100 * F.col("actual_mw") / F.col("supply_mw"))


_ALERTS = (
    _HOURLY_FC[:-1]
    + f""", u AS (SELECT *, 100 * actual_mw / max(actual_mw) OVER (PARTITION BY series_id) AS usage_pct FROM hourly),
    j AS (SELECT u.*, fc.* EXCLUDE (series_id, ts), greatest(actual_mw - p99_upper_mw, p99_lower_mw - actual_mw) AS breach FROM u JOIN fc USING (series_id, ts)),
    sp AS (SELECT series_id, ts, CASE WHEN actual_mw > p99_upper_mw THEN 'spike' ELSE 'drop' END AS type, CASE WHEN breach >= {BREACH[1][0]} OR (actual_mw > 0 AND breach / actual_mw * 100 >= {BREACH[1][1]}) THEN 'critical' WHEN breach >= {BREACH[0][0]} OR (actual_mw > 0 AND breach / actual_mw * 100 >= {BREACH[0][1]}) THEN 'warning' END AS severity, ts AS end_ts, breach AS value FROM j WHERE breach > 0),
    rs AS (SELECT series_id, CAST(ts AS DATE) AS day, ts, actual_mw - forecast_mw AS r, row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts) AS i FROM j),
    ew AS (SELECT a.series_id, a.day, a.ts, a.i, a.r, sum(CASE WHEN b.i = 1 THEN pow(0.7, a.i - 1) ELSE 0.3 * pow(0.7, a.i - b.i) END * b.r) AS e FROM rs a JOIN rs b ON a.series_id = b.series_id AND a.day = b.day AND b.i <= a.i GROUP BY ALL),
    sd AS (SELECT *, CASE WHEN e > {DRIFT} THEN 1 WHEN e < -{DRIFT} THEN -1 ELSE 0 END AS side FROM ew),
    ch AS (SELECT *, coalesce(CAST(side <> lag(side) OVER w AS INT), 1) AS c FROM sd WINDOW w AS (PARTITION BY series_id, day ORDER BY i)),
    ru AS (SELECT *, sum(c) OVER (PARTITION BY series_id, day ORDER BY i) AS run FROM ch),
    al AS (SELECT series_id, ts, 'reserve_risk' AS type, CASE WHEN usage_pct >= 97 THEN 'critical' ELSE 'warning' END AS severity, ts AS end_ts, usage_pct AS value FROM u WHERE usage_pct >= 92
      UNION ALL SELECT * FROM sp WHERE severity IS NOT NULL
      UNION ALL SELECT series_id, min(ts), 'drift', 'warning', max(ts), avg(r) FROM ru WHERE side <> 0 GROUP BY series_id, day, run HAVING count(*) >= 3) """
)


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _forecast(spark, sf_dir)
    return anomaly.detect(_facts(h), f, BREACH, DRIFT)


@_register(_ALERTS + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, type, severity, CAST(end_ts AS VARCHAR) AS end_ts, {_r('value')} FROM al")
def an01_04_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_alerts(spark, sf_dir))


@_register(_ALERTS + "SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CASE max(CASE WHEN type = 'reserve_risk' THEN CASE severity WHEN 'critical' THEN 2 ELSE 1 END END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'normal' END AS severity, count(*) FILTER (severity = 'critical') AS n_critical, count(*) FILTER (severity = 'warning') AS n_warning FROM al GROUP BY series_id, CAST(ts AS DATE)")
def an05_severity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(anomaly.severity_rollup(_alerts(spark, sf_dir)))


@_register(_ALERTS + "SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning FROM al GROUP BY series_id, CAST(ts AS DATE)")
def snk04_alert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(sinks.alert_documents(_alerts(spark, sf_dir)).drop("document"))


# Features ------------------------------------------------------------------------------------------------------------

_LAGS_SQL = ", ".join(f"l{n}.actual_mw AS lag_{n}h" for n in features.LAGS)
_LAGS_JOIN = " ".join(f"LEFT JOIN hourly l{n} ON l{n}.series_id = h.series_id AND l{n}.ts = h.ts - INTERVAL {n} HOURS" for n in features.LAGS)
_LAGGED = f"lg AS (SELECT h.*, {_LAGS_SQL}, h.actual_mw - l1.actual_mw AS hourly_delta, l24.actual_mw - l25.actual_mw AS lag_24h_hourly_delta, l168.actual_mw - l169.actual_mw AS lag_168h_hourly_delta FROM hourly h {_LAGS_JOIN})"
_LAG_COLUMNS = (*[f"lag_{n}h" for n in features.LAGS], "hourly_delta", "lag_24h_hourly_delta", "lag_168h_hourly_delta")


@_register(tb.with_ctes("hourly", more=_LAGGED) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('actual_mw', *_LAG_COLUMNS)} FROM lg")
def fe02_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(features.lag_features(tb.hourly(spark, sf_dir)).drop("clock"))


_SLOTS = f"""{_LAGGED}, {tb.calendar_ctes(_DAYS)},
    sl AS (SELECT lg.*, CAST(ts AS DATE) AS day, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, CAST(c.is_off AS INT) AS off FROM lg JOIN calendar c ON c.day = CAST(lg.ts AS DATE)),
    sm AS (SELECT *, avg(actual_mw) OVER a AS roll_4w_mean, coalesce(stddev_samp(actual_mw) OVER a, 0) AS roll_4w_std, avg(actual_mw) OVER b AS recent_same_business_type_mean, avg(hourly_delta) OVER b AS recent_same_business_type_delta_mean FROM sl
      WINDOW a AS (PARTITION BY series_id, hour, dayofweek ORDER BY ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series_id, hour, off ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))"""
_SLOT_COLUMNS = ("roll_4w_mean", "roll_4w_std", "recent_same_business_type_mean", "recent_same_business_type_delta_mean")


@_register(tb.with_ctes("hourly", more=_SLOTS) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, CAST(off AS BIGINT) AS is_non_business_day, {_r(*_SLOT_COLUMNS)} FROM sm")
def fe03_slot_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir)
    return _out(features.slot_features(features.lag_features(h), tb.calendar(_days(h))), "series_id", "ts", "is_non_business_day", *_SLOT_COLUMNS)


_CAL_COLUMNS = ("consec_holiday_len", "days_since_holiday_end", "lag_24h_dsh", "lag_24h_consec", "lag_168h_dsh", "major_holiday_season", "lag_24h_business_type_mismatch", "lag_24h_mismatch_x_business_hour")
_GAP_COLUMNS = ("lag_last_biz_hour", "lag_last_nonhol_hour", "lag_24h_to_last_biz_gap", "lag_24h_to_same_business_type_gap", "lag_24h_gap_x_business_hour")
_CALENDAR_SQL = f"""{_SLOTS}, cl AS (SELECT sm.*, c.run_before AS consec_holiday_len, c.days_since_off AS days_since_holiday_end, p.days_since_off AS lag_24h_dsh, p.run_before AS lag_24h_consec, w.days_since_off AS lag_168h_dsh,
      CASE WHEN dayofyear(sm.day) BETWEEN 115 AND 132 THEN 1 WHEN dayofyear(sm.day) BETWEEN 220 AND 235 THEN 2 WHEN dayofyear(sm.day) BETWEEN 358 AND 366 OR dayofyear(sm.day) <= 10 THEN 3 ELSE 0 END AS major_holiday_season,
      CAST(CAST(p.is_off AS INT) <> off AS INT) AS mm, b.actual_mw AS lag_last_biz_hour, o.actual_mw AS lag_last_nonhol_hour
      FROM sm LEFT JOIN calendar c ON c.day = sm.day LEFT JOIN calendar p ON p.day = sm.day - 1 LEFT JOIN calendar w ON w.day = sm.day - 7
      LEFT JOIN hourly b ON b.series_id = sm.series_id AND b.ts = CAST(c.last_biz_day AS TIMESTAMP) + to_hours(CAST(sm.hour AS INT)) LEFT JOIN hourly o ON o.series_id = sm.series_id AND o.ts = CAST(c.last_open_day AS TIMESTAMP) + to_hours(CAST(sm.hour AS INT))),
    cm AS (SELECT *, mm AS lag_24h_business_type_mismatch, mm * CAST(hour BETWEEN 8 AND 18 AS INT) AS lag_24h_mismatch_x_business_hour, lag_last_biz_hour - lag_24h AS lag_24h_to_last_biz_gap, recent_same_business_type_mean - lag_24h AS lag_24h_to_same_business_type_gap,
      mm * CAST(hour BETWEEN 6 AND 18 AS INT) * (recent_same_business_type_mean - lag_24h) AS lag_24h_gap_x_business_hour FROM cl)"""


@_register(tb.with_ctes("hourly", more=_CALENDAR_SQL) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {', '.join(f'CAST({c} AS BIGINT) AS {c}' for c in _CAL_COLUMNS)}, {_r(*_GAP_COLUMNS)} FROM cm")
def fe05_calendar_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir)
    cal = tb.calendar(_days(h))
    return _out(features.calendar_features(features.slot_features(features.lag_features(h), cal), h, cal), "series_id", "ts", *_CAL_COLUMNS, *_GAP_COLUMNS)


_WEATHER_COLUMNS = (
    "temp_c", "cooling_degree", "heating_degree", "humidity", "discomfort_index",
    "cooling_degree_3h_mean", "cooling_degree_6h_mean", "heating_degree_3h_mean", "heating_degree_6h_mean", "temp_c_72h_mean", "cooling_degree_72h_mean", "heating_degree_72h_mean",
    "temp_anomaly_7d", "temp_anomaly_doy", "temp_delta_1h", "temp_delta_2h", "temp_delta_24h", "temp_delta_168h", "cooling_delta_1h", "cooling_delta_24h", "cooling_delta_168h", "humidity_delta_24h", "discomfort_delta_24h",
)


def _weather_sql(past_only: bool) -> str:
    roll = lambda c, n, least=1: f"CASE WHEN count({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) >= {least} THEN avg({c}) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END AS {c}_{n}h_mean"
    rolls = ", ".join([roll(c, n) for c in ("cooling_degree", "heating_degree") for n in (3, 6)] + [roll(c, 72, 24) for c in ("temp_c", "cooling_degree", "heating_degree")])
    same = "PARTITION BY series_id, month(ts), hour(ts)" + (" ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING" if past_only else "")
    clip = lambda x, n: f"CASE WHEN {x} IS NOT NULL THEN greatest(-{n}, least({n}, {x})) END"
    deltas = ", ".join([f"w.temp_c - l{n}.temp_c AS temp_delta_{n}h" for n in features.WEATHER_LAGS] + [f"w.cooling_degree - l{n}.cooling_degree AS cooling_delta_{n}h" for n in features.WEATHER_LAGS if n != 2])
    lags = " ".join(f"LEFT JOIN w0 l{n} ON l{n}.series_id = w.series_id AND l{n}.ts = w.ts - INTERVAL {n} HOURS" for n in features.WEATHER_LAGS)
    return f"""w00 AS (SELECT *, greatest(0, temp_c - 22) AS cooling_degree, greatest(0, 18 - temp_c) AS heating_degree, greatest(20, least(100, humidity_pct)) AS humidity FROM weather),
    w0 AS (SELECT *, 0.81 * temp_c + 0.01 * humidity * (0.99 * temp_c - 14.3) + 46.3 AS discomfort_index FROM w00),
    wr AS (SELECT *, {rolls}, temp_c - CASE WHEN count(temp_c) OVER q >= 24 THEN avg(temp_c) OVER q END AS temp_anomaly_7d, temp_c - avg(temp_c) OVER ({same}) AS temp_anomaly_doy FROM w0 WINDOW q AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)),
    wf AS (SELECT w.*, {deltas}, {clip('w.humidity - l24.humidity', 30)} AS humidity_delta_24h, {clip('w.discomfort_index - l24.discomfort_index', 8)} AS discomfort_delta_24h FROM wr w {lags})"""


@_register(tb.with_ctes("weather", more=_weather_sql(True)) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r(*_WEATHER_COLUMNS)} FROM wf")
def fe08_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(features.weather_features(tb.weather(spark, sf_dir)), "series_id", "ts", *_WEATHER_COLUMNS)


@_register(tb.with_ctes("weather", more=_weather_sql(False)) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('temp_anomaly_doy')} FROM wf")
def fe09_anomaly_all_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(features.weather_features(tb.weather(spark, sf_dir), past_only=False), "series_id", "ts", "temp_anomaly_doy")


_MORNING = ("temp_delta_24h", "temp_anomaly_7d", "temp_anomaly_doy", "humidity_delta_24h", "discomfort_delta_24h")
_PRODUCTS = (*[f"business_morning_x_{x}" for x in _MORNING], "business_daytime_x_discomfort_index", "business_late_afternoon_x_temp_delta_1h", "business_late_afternoon_x_cooling_delta_1h", "holiday_x_heat", "post_holiday_x_heat", "business_hour_x_post_holiday_heat")
_ON = lambda a, b: f"CAST(off = 0 AND hour BETWEEN {a} AND {b} AS DOUBLE)"
_AFTER = "CAST(days_since_holiday_end BETWEEN 1 AND 2 AS DOUBLE)"
_WARM = "CASE WHEN temp_anomaly_7d IS NOT NULL THEN greatest(0, temp_anomaly_7d) END"
_PRODUCT_SQL = [*[f"{_ON(5, 11)} * {x} AS business_morning_x_{x}" for x in _MORNING], f"{_ON(9, 18)} * discomfort_index AS business_daytime_x_discomfort_index", *[f"{_ON(15, 18)} * {x} AS business_late_afternoon_x_{x}" for x in ("temp_delta_1h", "cooling_delta_1h")], f"consec_holiday_len * ({_WARM}) AS holiday_x_heat", f"{_AFTER} * ({_WARM}) AS post_holiday_x_heat", f"CAST(hour BETWEEN 9 AND 18 AS DOUBLE) * {_AFTER} * ({_WARM}) AS business_hour_x_post_holiday_heat"]
_CONTEXT = ("same_day_latest_actual_hour", "same_day_latest_actual_mw", "same_day_latest_hourly_delta", "same_day_recent_hourly_delta_mean", "recent_same_business_type_delta_q25")


@_register(tb.with_ctes("hourly", "weather", more=f"{_CALENDAR_SQL}, {_weather_sql(True)}") + f"SELECT cm.series_id, CAST(cm.ts AS VARCHAR) AS ts, {_r(*_PRODUCT_SQL)} FROM cm LEFT JOIN wf ON wf.series_id = cm.series_id AND wf.ts = cm.ts")
def fe12_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir)
    return _out(features.build_features(h, tb.weather(spark, sf_dir), tb.calendar(_days(h))), "series_id", "ts", *_PRODUCTS)


@_register(
    tb.with_ctes("hourly", more=f"""{_SLOTS},
    cx AS (SELECT *, last_value(hour IGNORE NULLS) OVER d AS same_day_latest_actual_hour, last_value(actual_mw IGNORE NULLS) OVER d AS same_day_latest_actual_mw, last_value(hourly_delta IGNORE NULLS) OVER d AS same_day_latest_hourly_delta,
      list(hourly_delta) FILTER (hourly_delta IS NOT NULL) OVER d AS dl, list(hourly_delta) FILTER (hourly_delta IS NOT NULL) OVER k AS kl FROM sm
      WINDOW d AS (PARTITION BY series_id, day ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k AS (PARTITION BY series_id, hour, off ORDER BY ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))""")
    + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, CAST(same_day_latest_actual_hour AS BIGINT) AS same_day_latest_actual_hour, {_r('same_day_latest_actual_mw', 'same_day_latest_hourly_delta', 'list_avg(dl[-2:]) AS same_day_recent_hourly_delta_mean', 'CASE WHEN len(kl) >= 3 THEN list_aggregate(kl, ' + chr(39) + 'quantile_cont' + chr(39) + ', 0.25) ELSE list_avg(kl) END AS recent_same_business_type_delta_q25')} FROM cx"
)
def fe15_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir)
    rows = features.slot_features(features.lag_features(h), tb.calendar(_days(h)))
    return _out(features.context_features(rows), "series_id", "ts", *_CONTEXT)


_PARTS = ", ".join(f"avg(CASE WHEN hour(ts) BETWEEN {a} AND {b} THEN actual_mw END) AS actual_mw_{n}" for n, a, b in C.DAY_PARTS)
_STATS = ("actual_mw_mean", "actual_mw_min", "actual_mw_max", "actual_mw_std", *[f"actual_mw_{n}" for n, _, _ in C.DAY_PARTS])


@_register(tb.with_ctes("hourly", more=f"dd AS (SELECT series_id, CAST(ts AS DATE) AS day, avg(actual_mw) AS actual_mw_mean, min(actual_mw) AS actual_mw_min, max(actual_mw) AS actual_mw_max, stddev_pop(actual_mw) AS actual_mw_std, {_PARTS} FROM hourly GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) = 24)") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, {_r(*_STATS)} FROM dd")
def fe16_daily_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(features.daily_features(tb.hourly(spark, sf_dir)))


# Metrics and evaluation ------------------------------------------------------------------------------------------------

_METRICS = ("mae", "bias", "wape", "rmse", "mape", "max_error", "shape_mae")
_BAND_SQL = "CASE WHEN hour(ts) <= 5 THEN 'overnight' WHEN hour(ts) <= 10 THEN 'morning' WHEN hour(ts) <= 15 THEN 'daytime' WHEN hour(ts) <= 18 THEN 'late_afternoon' ELSE 'evening' END"
_BUNDLE = f"""{tb.calendar_ctes('SELECT CAST(ts AS DATE) AS day FROM pairs')},
    er AS (SELECT p.*, {_BAND_SQL} AS band, CASE WHEN c.is_off THEN 'non_business' ELSE 'business' END AS regime, model_mw - actual_mw AS e,
      CASE WHEN hour(ts) = lag(hour(ts)) OVER w + 1 THEN (model_mw - lag(model_mw) OVER w) - (actual_mw - lag(actual_mw) OVER w) END AS s FROM pairs p JOIN calendar c ON c.day = CAST(p.ts AS DATE) WINDOW w AS (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts)),
    mb AS (SELECT series_id, regime, band, count(e) AS n, avg(abs(e)) AS mae, avg(e) AS bias, sum(abs(e)) * 100 / sum(abs(actual_mw)) AS wape, sqrt(avg(e * e)) AS rmse, avg(CASE WHEN actual_mw <> 0 THEN abs(e / actual_mw) END) * 100 AS mape, max(abs(e)) AS max_error, avg(abs(s)) AS shape_mae FROM er GROUP BY GROUPING SETS ((series_id), (series_id, regime), (series_id, band)))"""


def _bundle(spark: SparkSession, sf_dir: str, column: str = "model_mw") -> DataFrame:
    p = tb.pairs(spark, sf_dir)
    return metrics.metric_bundle(p, column, tb.calendar(_days(p)))


@_register(tb.with_ctes("pairs", more=_BUNDLE) + f"SELECT series_id, regime, band, n, {_r(*_METRICS)} FROM mb")
def a07_metric_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_bundle(spark, sf_dir))


def _card_sql(by: str, name: str) -> str:
    return tb.with_ctes("pairs", more=f"""ab AS (SELECT *, abs(model_mw - actual_mw) AS m, abs(reference_mw - actual_mw) AS r FROM pairs),
    sc AS (SELECT series_id, {by} AS {name}, count(*) AS n, avg(m) AS model_mae, avg(r) AS reference_mae, sum(m) / sum(actual_mw) * 100 AS model_wape, sum(r) / sum(actual_mw) * 100 AS reference_wape, sqrt(avg(m * m)) AS model_rmse, sqrt(avg(r * r)) AS reference_rmse,
      first(hour(ts) ORDER BY round(m, 6) DESC, ts) AS worst_hour, count(*) FILTER (m < r) AS wins, count(*) FILTER (r < m) AS losses FROM ab GROUP BY 1, 2)""") + f"""SELECT series_id, CAST({name} AS {'VARCHAR' if name == 'day' else 'BIGINT'}) AS {name}, n, {_r('model_mae', 'reference_mae', 'model_wape', 'reference_wape', 'model_rmse', 'reference_rmse')}, worst_hour, wins, losses, n - wins - losses AS ties,
      CASE WHEN abs(model_mae - reference_mae) <= {100.0 * SCALE} AND abs(model_wape - reference_wape) <= 0.2 THEN 'close' WHEN model_mae < reference_mae AND model_wape < reference_wape AND model_rmse - reference_rmse <= {300.0 * SCALE} THEN 'model_better' WHEN model_mae > reference_mae AND model_wape > reference_wape AND model_rmse - reference_rmse >= -{300.0 * SCALE} THEN 'reference_better' ELSE 'mixed' END AS verdict FROM sc"""


@_register(_card_sql("CAST(ts AS DATE)", "day"))
def ev01_daily_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.scorecard(tb.pairs(spark, sf_dir), "model_mw", "reference_mw", F.col("series_id"), F.to_date("ts").alias("day"), scale=SCALE))


@_register(_card_sql("hour(ts)", "hour"))
def a21_hourly_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.scorecard(tb.pairs(spark, sf_dir), "model_mw", "reference_mw", F.col("series_id"), F.hour("ts").alias("hour"), scale=SCALE))


@_register(tb.with_ctes("pairs") + f"SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_r('max(actual_mw) AS actual_mw_peak')}, first(hour(ts) ORDER BY actual_mw DESC, ts) AS actual_mw_peak_hour, {_r('max(model_mw) AS model_mw_peak')}, first(hour(ts) ORDER BY model_mw DESC, ts) AS model_mw_peak_hour FROM pairs GROUP BY series_id, CAST(ts AS DATE)")
def a10_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.peaks(tb.pairs(spark, sf_dir), "actual_mw", "model_mw"))


@_register(_HOURLY_FC + f"SELECT series_id, count(*) AS n, {_r('avg(CAST(actual_mw BETWEEN p95_lower_mw AND p95_upper_mw AS INT)) * 100 AS coverage_pct', 'avg(p95_upper_mw - p95_lower_mw) AS mean_width')}, count(*) FILTER (actual_mw > p95_upper_mw) AS above, count(*) FILTER (actual_mw < p95_lower_mw) AS below, CASE WHEN count(*) < 24 THEN 'insufficient' WHEN avg(CAST(actual_mw BETWEEN p95_lower_mw AND p95_upper_mw AS INT)) * 100 < 94 THEN 'under' WHEN avg(CAST(actual_mw BETWEEN p95_lower_mw AND p95_upper_mw AS INT)) * 100 > 96 THEN 'over' ELSE 'ok' END AS flag FROM hourly JOIN fc USING (series_id, ts) GROUP BY series_id")
def a12_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _forecast(spark, sf_dir)
    return _out(metrics.coverage_flags(metrics.coverage(h.join(f, ["series_id", "ts"]), "p95_lower_mw", "p95_upper_mw", "series_id")))


@_register(tb.with_ctes("pairs", more=f"q AS (SELECT series_id, {_BAND_SQL} AS band, abs(model_mw - actual_mw) AS v FROM pairs), k AS (SELECT *, row_number() OVER (PARTITION BY series_id, band ORDER BY v) AS i, count(*) OVER (PARTITION BY series_id, band) AS n FROM q)") + f"SELECT series_id, band, n, {_r('v AS quantile')} FROM k WHERE i = least(n, CAST(ceil((n + 1) * 0.95::DOUBLE) AS BIGINT))")
def a15_conformal_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir).withColumn("band", S.band(F.hour("ts")))
    return _out(metrics.conformal_quantile(p, F.abs(F.col("model_mw") - F.col("actual_mw")), 0.95, "series_id", "band"))


_DRAWS = """dy AS (SELECT series_id, CAST(ts AS DATE) AS day, avg(abs(model_mw - actual_mw)) - avg(abs(reference_mw - actual_mw)) AS diff FROM pairs GROUP BY 1, 2),
    dk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS days FROM dy),
    pk AS (SELECT series_id, draw, ('0x' || substr(md5('42|' || draw || '|' || k), 1, 13))::BIGINT % days AS k FROM dk, (SELECT unnest(range(2000)) AS draw)),
    me AS (SELECT series_id, draw, avg(diff) AS mean FROM pk JOIN dk USING (series_id, k) GROUP BY 1, 2),
    en AS (SELECT series_id, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM me GROUP BY 1)"""


@_register(tb.with_ctes("pairs", more=_DRAWS) + f"SELECT series_id, count(*) AS days, {_r('avg(diff) AS mean_difference', 'any_value(low) AS low', 'any_value(high) AS high')} FROM dy JOIN en USING (series_id) GROUP BY series_id HAVING count(*) >= 7")
def a23_paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.paired_bootstrap(tb.pairs(spark, sf_dir), "model_mw", "reference_mw"))


_BUCKET = "CASE WHEN l * 60 <= 120 THEN '0-120' WHEN l * 60 <= 240 THEN '120-240' WHEN l * 60 <= 480 THEN '240-480' ELSE '480-1440' END"
_VINTAGE = f"""mv AS (SELECT * FROM (SELECT *, {_BUCKET.replace('l *', 'lead_h *')} AS bucket, row_number() OVER (PARTITION BY series_id, ts, {_BUCKET.replace('l *', 'lead_h *')} ORDER BY lead_h) AS i FROM vintages) WHERE i = 1),
    vr AS (SELECT series_id, bucket, band, count(*) AS n, count(DISTINCT CAST(ts AS DATE)) AS days, avg(abs(model_mw - actual_mw)) AS model_mae, avg(abs(reference_mw - actual_mw)) AS reference_mae FROM (SELECT *, {_BAND_SQL} AS band FROM mv) GROUP BY GROUPING SETS ((series_id, bucket), (series_id, bucket, band)))"""


@_register(tb.with_ctes("vintages", more=_VINTAGE) + f"SELECT series_id, bucket, band, n, days, {_r('model_mae', 'reference_mae', 'model_mae / reference_mae AS ratio')} FROM vr")
def ev02_vintage_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(evaluation.vintage_report(evaluation.matched_vintages(tb.vintages(spark, sf_dir))))


@_register(tb.with_ctes("vintages", more=_VINTAGE) + f"SELECT series_id, min(days) AS days, {_r('max(model_mae / reference_mae) AS worst_ratio')}, count(*) AS buckets, CASE WHEN min(days) < 14 OR count(*) < 4 THEN 'collecting' WHEN max(model_mae / reference_mae) <= 1 THEN 'qualified' ELSE 'not_qualified' END AS status FROM vr WHERE band IS NULL GROUP BY series_id")
def ev03_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(evaluation.qualification(evaluation.vintage_report(evaluation.matched_vintages(tb.vintages(spark, sf_dir)))))


@_register(tb.with_ctes("pairs", more=_BUNDLE) + f"SELECT series_id, n, {_r('mae', 'wape')}, CASE WHEN n < 72 THEN 'insufficient' WHEN mae > 12 OR wape > 60 THEN 'degraded' WHEN mae > 10 OR wape > 50 THEN 'review_required' ELSE 'healthy' END AS health FROM mb WHERE regime IS NULL AND band IS NULL")
def ev16_model_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(evaluation.model_health(_bundle(spark, sf_dir), (10.0, 12.0), (50.0, 60.0)))


@_register(tb.with_ctes("pairs", more=f"{_BUNDLE}, {_BUNDLE.split('er AS', 1)[1].join(['er2 AS', '']).replace('model_mw', 'reference_mw').replace('FROM er GROUP', 'FROM er2 GROUP').replace('mb AS', 'mb2 AS')}") + f"SELECT a.series_id, a.regime, a.band, a.n, {_r('a.mae AS mae', 'b.mae AS champion_mae')}, (a.n < 24 OR a.mae <= b.mae) AS passes FROM mb a JOIN mb2 b ON a.series_id = b.series_id AND a.regime IS NOT DISTINCT FROM b.regime AND a.band IS NOT DISTINCT FROM b.band")
def ev07_segment_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(evaluation.segment_gate(_bundle(spark, sf_dir), _bundle(spark, sf_dir, "reference_mw")), "series_id", "regime", "band", "n", "mae", "champion_mae", "passes")


@_register(tb.with_ctes("pairs", more=_BUNDLE) + f"SELECT series_id, metric, {_r('value')}, CAST(lim AS DOUBLE) AS \"limit\" FROM (SELECT series_id, 'mae' AS metric, mae AS value, 8.0 AS lim FROM mb WHERE regime IS NULL AND band IS NULL UNION ALL SELECT series_id, 'wape', wape, 40.0 FROM mb WHERE regime IS NULL AND band IS NULL UNION ALL SELECT series_id, 'max_error', max_error, 30.0 FROM mb WHERE regime IS NULL AND band IS NULL) WHERE value > lim")
def ev08_absolute_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(evaluation.absolute_gate(_bundle(spark, sf_dir), {"mae": 8.0, "wape": 40.0, "max_error": 30.0}))


@_register(tb.with_ctes("pairs", more="dr AS (SELECT series_id, ts, model_mw AS champion_mw, reference_mw AS challenger_mw, reference_mw - model_mw AS change, avg(abs(reference_mw - model_mw)) OVER (PARTITION BY series_id) AS mean_abs_change, row_number() OVER (PARTITION BY series_id ORDER BY abs(reference_mw - model_mw) DESC, ts) AS rank FROM pairs)") + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('champion_mw', 'challenger_mw', 'change', 'mean_abs_change')}, rank FROM dr WHERE rank <= 5")
def ev11_prediction_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir)
    return _out(evaluation.prediction_drift(p.withColumnRenamed("model_mw", "forecast_mw"), p.withColumnRenamed("reference_mw", "forecast_mw")))


@_register(tb.with_ctes("pairs", more="tk AS (SELECT series_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, abs(model_mw - actual_mw) AS abs_error, row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY round(abs(model_mw - actual_mw), 6) DESC, ts) AS rank FROM pairs)") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, hour, {_r('abs_error')}, rank FROM tk WHERE rank <= 3")
def tk01_top_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir).select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.abs(F.col("model_mw") - F.col("actual_mw")).alias("abs_error"))
    return _out(joins.top_rows(p, ["series_id", "day"], 3, F.round("abs_error", 6).desc(), F.col("hour")))


# Joins, quality, sources, streams -------------------------------------------------------------------------------------


@_register(tb.with_ctes("hourly") + f"""SELECT a.series_id, CAST(a.ts AS VARCHAR) AS ts, {_r('a.actual_mw AS actual_mw', 'any_value(b.actual_mw) AS other_mw')}, CAST(0 AS BIGINT) AS apart_s FROM hourly a JOIN hourly b ON a.series_id = b.series_id AND a.ts = b.ts GROUP BY a.series_id, a.ts, a.actual_mw""")
def j12_nearest_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hour meets its copy captured at the same time; hours apart are out of tolerance."""
    h = tb.hourly(spark, sf_dir)
    other = h.select("series_id", F.col("ts").alias("other_ts"), F.col("actual_mw").alias("other_mw"))
    return _out(joins.nearest_within(h, other, ["series_id"], "ts", "other_ts", 120), "series_id", "ts", "actual_mw", "other_mw", "apart_s")


@_register(tb.with_ctes("hourly") + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('actual_mw', 'last_value(actual_mw IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest_actual_mw')} FROM hourly")
def j13_latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(joins.latest_before(tb.hourly(spark, sf_dir), ["series_id"], "ts", "actual_mw"))


_TOP = "hx AS (SELECT series_id, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, actual_mw, row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY actual_mw DESC, ts) AS k FROM hourly)"


@_register(tb.with_ctes("hourly", more=_TOP) + f"SELECT h.series_id, CAST(h.day AS VARCHAR) AS day, CAST(h.hour AS BIGINT) AS hour, {_r('h.actual_mw AS actual_mw')}, count(*) AS n_events FROM hx h JOIN hx e ON h.series_id = e.series_id AND h.day = e.day AND e.k <= 2 AND abs(h.hour - e.hour) <= 2 GROUP BY h.series_id, h.day, h.hour, h.actual_mw")
def j15_neighbour_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir).select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "actual_mw")
    events = joins.top_rows(h, ["series_id", "day"], 2, F.desc("actual_mw"), F.col("hour"))
    return _out(joins.neighbour_hours(events, h))


@_register(tb.with_ctes("hourly", more="sq AS (SELECT *, CAST(ts AS DATE) AS day, date_diff('minute', lag(ts) OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts), ts) AS step FROM hourly)") + "SELECT series_id, CAST(day AS VARCHAR) AS day, count(*) AS rows, count(*) = 24 AS expected_count_ok, CAST(0 AS BIGINT) AS duplicates, true AS monotonic, count(*) FILTER (step <> 60) AS freq_mismatch, CASE WHEN count(*) <> 24 THEN 'FAILED' WHEN count(*) FILTER (step <> 60) > 4 THEN 'WARNING' ELSE 'PASSED' END AS status FROM sq GROUP BY series_id, day")
def dq01_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir).withColumns({"day": F.to_date("ts"), "seq": F.col("ts")})
    return _out(quality.quality_gate(quality.series_quality(h)), "series_id", "day", "rows", "expected_count_ok", "duplicates", "monotonic", "freq_mismatch", "status")


@_register(tb.with_ctes("daily", more="sp AS (SELECT series_id, CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day FROM daily GROUP BY series_id)") + "SELECT sp.series_id, CAST(sp.day AS VARCHAR) AS day FROM sp LEFT JOIN daily d ON d.series_id = sp.series_id AND d.day = sp.day WHERE d.day IS NULL")
def dq04_missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(quality.missing_days(tb.daily(spark, sf_dir).select("series_id", "day")))


@_register(tb.with_ctes("half_hours", more="fd AS (SELECT series_id, day FROM half_hours GROUP BY 1, 2 HAVING count(*) = 48), hm AS (SELECT h.*, kwh * 2 / 1000 AS mw, (slot - 1) // 2 AS hour FROM half_hours h JOIN fd USING (series_id, day))") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, CAST(hour AS BIGINT) AS hour, {_r('avg(mw) AS mean_mw', 'arg_max(mw, slot) - arg_min(mw, slot) AS delta_mw')} FROM hm GROUP BY series_id, day, hour")
def src10_half_hour_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(files.half_hour_area(tb.half_hours(spark, sf_dir)))


_SOURCED = "CASE WHEN hour(ts) % 3 = 0 THEN 'reference_forecast_fallback' WHEN hour(ts) % 3 = 1 THEN 'observed_legacy' END"


@_register(tb.with_ctes("hourly", more=f"x AS (SELECT series_id, ts, actual_mw, {_SOURCED} AS actual_source FROM hourly UNION ALL SELECT series_id, ts, actual_mw + 1, 'observed' FROM hourly WHERE hour(ts) % 2 = 0), y AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY CASE actual_source WHEN 'observed' THEN 3 WHEN 'observed_legacy' THEN 2 WHEN 'reference_forecast_fallback' THEN 1 ELSE 0 END DESC, actual_mw DESC) AS i FROM x)") + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('actual_mw')}, actual_source FROM y WHERE i = 1")
def set_dedup1_best_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, hour = tb.hourly(spark, sf_dir), F.hour("ts")
    x = h.withColumn("actual_source", F.when(hour % 3 == 0, C.FALLBACK).when(hour % 3 == 1, C.OBSERVED_LEGACY))
    fresh = h.where(hour % 2 == 0).select("series_id", "ts", F.col("actual_mw") + 1, F.lit(C.OBSERVED))
    return _out(joins.best_source(x.union(fresh)))


@_register(tb.with_ctes("hourly", more="f AS (SELECT series_id, ts, CASE WHEN hour(ts) % 4 <> 0 THEN actual_mw * 2 END AS feed_mw, actual_mw + 5 AS reference_mw FROM hourly), o AS (SELECT series_id, ts, CASE WHEN hour(ts) % 2 = 0 AND hour(ts) % 8 <> 0 THEN actual_mw END AS a FROM hourly)") + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('coalesce(a, feed_mw, CASE WHEN CAST(ts AS DATE) < DATE ' + chr(39) + '2024-01-20' + chr(39) + ' THEN reference_mw END) AS actual_mw')}, CASE WHEN a IS NOT NULL OR feed_mw IS NOT NULL THEN 'observed' WHEN CAST(ts AS DATE) < DATE '2024-01-20' THEN 'reference_forecast_fallback' END AS actual_source FROM o JOIN f USING (series_id, ts)")
def st03_upsert_actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, hour = tb.hourly(spark, sf_dir), F.hour("ts")
    held = h.select("series_id", "ts", F.when((hour % 2 == 0) & (hour % 8 != 0), F.col("actual_mw")).alias("actual_mw"), F.lit(None).cast("string").alias("actual_source"))
    feed = h.select("series_id", "ts", F.when(hour % 4 != 0, F.col("actual_mw") * 2).alias("feed_mw"), (F.col("actual_mw") + 5).alias("reference_mw"))
    return _out(joins.upsert_actuals(held, feed, "2024-01-20"))


@_register(tb.with_ctes("weather", more="p AS (SELECT series_id, ts, temp_c, lead(ts) OVER w AS ts2, lead(temp_c) OVER w AS v2 FROM weather WHERE hour(ts) % 3 = 0 WINDOW w AS (PARTITION BY series_id ORDER BY ts)), g AS (SELECT *, CASE WHEN ts2 IS NULL THEN 0 ELSE date_diff('hour', ts, ts2) END AS hs FROM p), e AS (SELECT *, unnest(range(greatest(1, hs))) AS k FROM g)") + f"SELECT series_id, CAST(ts + to_hours(k) AS VARCHAR) AS ts, {_r('temp_c + CASE WHEN hs > 0 THEN k / hs ELSE 0 END * (coalesce(v2, temp_c) - temp_c) AS temp_c')} FROM e")
def w_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(weather_prep.interpolate_hours(tb.weather(spark, sf_dir).where(F.hour("ts") % 3 == 0)))


_INTRADAY = f"""px AS (SELECT series_id, ts, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INT) AS hour, CASE WHEN hour(ts) < 12 THEN actual_mw END AS actual_mw, model_mw AS f FROM pairs),
    ob AS (SELECT *, actual_mw - f AS r, row_number() OVER w AS i, actual_mw - lead(actual_mw) OVER w AS sl FROM px WHERE actual_mw IS NOT NULL WINDOW w AS (PARTITION BY series_id, day ORDER BY hour DESC)),
    ct AS (SELECT series_id, day, count(*) AS n, max(hour) AS lh, arg_max(actual_mw, hour) AS lm, arg_max(r, hour) AS lr, avg(r) FILTER (i <= 3) AS mr, abs(sum(sign(r))) AS ss, avg(r) AS ar, max(sl) FILTER (i = 1) AS s1, max(sl) FILTER (i = 2) AS s0 FROM ob GROUP BY 1, 2),
    ix AS (SELECT p.*, coalesce(c.n, 0) AS n, p.hour - coalesce(c.lh, -1) AS ld, c.lh, c.lm, c.mr, c.ss, c.ar, c.s1, c.s0, y.lr AS yr, p.hour + 24 - y.lh AS age FROM px p LEFT JOIN ct c ON c.series_id = p.series_id AND c.day = p.day LEFT JOIN ct y ON y.series_id = p.series_id AND y.day = p.day - 1),
    iy AS (SELECT *, CASE WHEN mr IS NOT NULL THEN greatest(-1200, least(1200, mr * 0.6)) END * pow(0.92, ld - 1) AS base, CASE WHEN ss = 2 AND abs(ar) >= 500 THEN greatest(-700, least(700, ar * 0.5)) * pow(0.92, ld - 1) END AS early,
      CASE WHEN age <= 8 AND yr IS NOT NULL THEN greatest(-500, least(500, yr * 0.5 * pow(0.75, age))) END AS carry, coalesce(-(coalesce(s0, 0) + s1) >= 500, false) AS relaxed, CAST(least(greatest(ld, 1), 3) AS INT) AS k FROM ix),
    iz AS (SELECT *, CASE WHEN n >= 3 THEN base WHEN n = 2 THEN early ELSE carry END AS shift, CASE WHEN n >= 3 THEN 'residual_mean' WHEN n = 2 AND early IS NOT NULL THEN 'early_carryover' WHEN n < 2 AND carry IS NOT NULL THEN 'day_boundary' END AS rule, lm - CASE WHEN relaxed THEN [1600, 2800, 4200][k] ELSE [1600, 2600, 3600][k] END AS low, lm + [1800, 2400, 3000][k] AS high FROM iy),
    fi AS (SELECT *, f + coalesce(shift, 0) AS moved, CASE WHEN ld > 0 AND ld <= 3 AND coalesce(lh >= 10, false) THEN greatest(low, least(high, f + coalesce(shift, 0))) WHEN ld > 0 THEN f + coalesce(shift, 0) ELSE f END AS final FROM iz)"""


@_register(tb.with_ctes("pairs", more=_INTRADAY) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('actual_mw', 'f AS forecast_mw', 'final - f AS adjustment_mw', 'final AS corrected_mw')}, array_to_string(list_filter([CASE WHEN ld > 0 AND coalesce(shift, 0) <> 0 THEN rule END, CASE WHEN ld > 0 AND abs(final - moved) > 1e-9 THEN 'ramp_guard' END], lambda x: x IS NOT NULL), ',') AS reasons FROM fi")
def ic_intraday_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline corrected as at noon of every day: actuals of later hours are hidden."""
    p = tb.pairs(spark, sf_dir).select("series_id", "ts", F.when(F.hour("ts") < 12, F.col("actual_mw")).alias("actual_mw"), F.col("model_mw").alias("forecast_mw"))
    return _out(intraday.correct(p))



_CAPPED = lambda own, other: f"greatest(least({own}, greatest(500, least(3000, greatest({other}, 900) * 2.5))), 500)"
_BANDED = f"""b0 AS (SELECT series_id, ts, model_mw * 100 AS forecast_mw, least(model_mw, reference_mw) * 100 AS q025, greatest(actual_mw, reference_mw) * 130 AS q975 FROM pairs),
    b1 AS (SELECT *, greatest(500, forecast_mw - least(q025, forecast_mw)) AS l1, greatest(500, greatest(q975, forecast_mw) - forecast_mw) AS h1 FROM b0),
    b2 AS (SELECT *, {_CAPPED('l1', 'h1')} AS l2, {_CAPPED('h1', 'l1')} AS h2 FROM b1),
    b3 AS (SELECT *, greatest(500, (l2 + h2) / 2.6) AS s, greatest(l2, h2) > least(l2, h2) * 1.6 AS uneven FROM b2),
    b4 AS (SELECT *, least(s, 3000) AS ns, least(least(greatest(500, l2 + h2 - s), s * 1.6), 3000) AS nl FROM b3),
    b5 AS (SELECT *, CASE WHEN uneven THEN CASE WHEN l2 >= h2 THEN nl ELSE ns END ELSE l2 END * 1.25 AS lo, CASE WHEN uneven THEN CASE WHEN h2 >= l2 THEN nl ELSE ns END ELSE h2 END * 1.25 AS hi FROM b4)"""


@_register(tb.with_ctes("pairs", more=_BANDED) + f"SELECT series_id, CAST(ts AS VARCHAR) AS ts, {_r('forecast_mw', 'q025', 'q975', 'forecast_mw - lo AS p95_lower_mw', 'forecast_mw + hi AS p95_upper_mw', 'forecast_mw - 2 * lo AS p99_lower_mw', 'forecast_mw + 2 * hi AS p99_upper_mw')} FROM b5")
def i01_calibrated_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir)
    r = p.select("series_id", "ts", (F.col("model_mw") * 100).alias("forecast_mw"), (F.least("model_mw", "reference_mw") * 100).alias("q025"), (F.greatest("actual_mw", "reference_mw") * 130).alias("q975"))
    return _out(intervals.assemble_bands(r))


_FLOORS = f"""{tb.calendar_ctes('SELECT CAST(ts AS DATE) AS day FROM pairs')},
    fx AS (SELECT series_id, CAST(ts AS DATE) AS day, hour(ts) AS hour, {_BAND_SQL} AS band, abs(model_mw - actual_mw) * 100 AS e FROM pairs), fd AS (SELECT series_id, day FROM fx GROUP BY 1, 2 HAVING count(DISTINCT hour) = 24),
    nr AS (SELECT t.series_id, t.day AS target, d.day, c.is_off AS off, tc.is_off AS target_off, row_number() OVER (PARTITION BY t.series_id, t.day ORDER BY d.day DESC) AS i FROM (SELECT DISTINCT series_id, day FROM fx) t JOIN fd d ON d.series_id = t.series_id AND d.day < t.day JOIN calendar c ON c.day = d.day JOIN calendar tc ON tc.day = t.day),
    fq AS (SELECT n.series_id, n.target, x.band, x.e, row_number() OVER (PARTITION BY n.series_id, n.target, x.band ORDER BY x.e) AS i, count(*) OVER (PARTITION BY n.series_id, n.target, x.band) AS n FROM nr n JOIN fx x ON x.series_id = n.series_id AND x.day = n.day WHERE n.i <= 28 AND n.off = n.target_off)"""


@_register(tb.with_ctes("pairs", more=_FLOORS) + f"SELECT series_id, CAST(target AS VARCHAR) AS target, band, n, {_r('greatest(500, least(3000, e)) AS floor_mw')} FROM fq WHERE n >= 3 AND i = least(n, CAST(ceil((n + 1) * 0.95::DOUBLE) AS BIGINT))")
def i02_conformal_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors at a hundred times their size, so that floors differ."""
    p = tb.pairs(spark, sf_dir)
    p = p.withColumns({c: F.col(c) * 100 for c in ("actual_mw", "model_mw")})
    targets = p.select("series_id", F.to_date("ts").alias("target")).distinct()
    return _out(intervals.conformal_floors(p, targets, tb.calendar(_days(p)), least=3))


# Reports ---------------------------------------------------------------------------------------------------------------

_SHAPE = "st AS (SELECT * FROM (SELECT series_id, CAST(ts AS DATE) AS day, hour(ts) AS to_hour, lag(hour(ts)) OVER w AS from_hour, actual_mw - lag(actual_mw) OVER w AS actual_delta, model_mw - lag(model_mw) OVER w AS model_delta, reference_mw - lag(reference_mw) OVER w AS reference_delta FROM pairs WINDOW w AS (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts)) WHERE to_hour = from_hour + 1)"
_BREAKS = "sb AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY round(abs(model_delta - actual_delta), 6) DESC, to_hour) AS rank FROM st WHERE abs(model_delta - actual_delta) >= 15)"


@_register(tb.with_ctes("pairs") + f"""SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {_BAND_SQL.replace("'morning'", "'morning_ramp'")} AS band, count(*) AS hours, {_r('avg(abs(model_mw - actual_mw)) AS model_mae', 'avg(abs(reference_mw - actual_mw)) AS reference_mae', 'avg(model_mw - actual_mw) AS model_bias')},
    CASE WHEN abs(avg(model_mw - actual_mw)) < greatest(100, 0.35 * avg(abs(model_mw - actual_mw))) THEN 'mixed' WHEN avg(model_mw - actual_mw) > 0 THEN 'over' ELSE 'under' END AS direction FROM pairs GROUP BY ALL""")
def rp03_band_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(reports.band_summary(tb.pairs(spark, sf_dir)))


@_register(tb.with_ctes("pairs", more=_SHAPE) + f"SELECT series_id, CAST(day AS VARCHAR) AS day, to_hour, from_hour, {_r('actual_delta', 'model_delta', 'reference_delta', 'model_delta - actual_delta AS model_delta_error', 'reference_delta - actual_delta AS reference_delta_error')} FROM st")
def rp04_shape_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(reports.shape_transitions(tb.pairs(spark, sf_dir)))


@_register(tb.with_ctes("pairs", more=f"{_SHAPE}, {_BREAKS}") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, to_hour, from_hour, {_r('actual_delta', 'model_delta', 'reference_delta', 'model_delta - actual_delta AS model_delta_error', 'reference_delta - actual_delta AS reference_delta_error')}, rank FROM sb WHERE rank <= 5")
def tk02_shape_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(reports.shape_breaks(reports.shape_transitions(tb.pairs(spark, sf_dir)), 15.0))


@_register(tb.with_ctes("pairs", more="pk AS (SELECT series_id, CAST(ts AS DATE) AS day, max(actual_mw) AS actual_peak, first(hour(ts) ORDER BY actual_mw DESC, ts) AS actual_hour, max(model_mw) AS model_peak, first(hour(ts) ORDER BY model_mw DESC, ts) AS model_hour, first(model_mw - actual_mw ORDER BY actual_mw DESC, ts) AS error_at_peak FROM pairs GROUP BY 1, 2)") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, {_r('actual_peak')}, actual_hour, {_r('model_peak')}, model_hour, {_r('error_at_peak')}, model_hour - actual_hour AS time_error FROM pk")
def rp02_peak_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(reports.peak_summary(tb.pairs(spark, sf_dir)))


_INSIGHTS = f"""mc AS (SELECT *, abs(model_mw - actual_mw) AS m, abs(reference_mw - actual_mw) AS r, CAST(ts AS DATE) AS day FROM pairs),
    sc AS (SELECT series_id, day, avg(m) AS mm, avg(r) AS rm, sum(m) / sum(actual_mw) * 100 AS mw, sum(r) / sum(actual_mw) * 100 AS rw, sqrt(avg(m * m)) AS mq, sqrt(avg(r * r)) AS rq, max(m) AS miss FROM mc GROUP BY 1, 2),
    sv AS (SELECT *, CASE WHEN abs(mm - rm) <= {100.0 * SCALE} AND abs(mw - rw) <= 0.2 THEN 'close' WHEN mm < rm AND mw < rw AND mq - rq <= {300.0 * SCALE} THEN 'model_better' WHEN mm > rm AND mw > rw AND mq - rq >= -{300.0 * SCALE} THEN 'reference_better' ELSE 'mixed' END AS verdict FROM sc),
    bb AS (SELECT series_id, day, {_BAND_SQL} AS band, avg(model_mw - actual_mw) AS bias FROM mc GROUP BY ALL),
    pk AS (SELECT series_id, day, first(hour(ts) ORDER BY model_mw DESC, ts) - first(hour(ts) ORDER BY actual_mw DESC, ts) AS te, first(model_mw - actual_mw ORDER BY actual_mw DESC, ts) AS pe FROM mc GROUP BY 1, 2),
    {_SHAPE}, bk AS (SELECT * FROM (SELECT *, model_delta - actual_delta AS de, row_number() OVER (PARTITION BY series_id, day ORDER BY round(abs(model_delta - actual_delta), 6) DESC, to_hour) AS i FROM st WHERE abs(model_delta - actual_delta) >= {reports.LARGE_BREAK * SCALE}) WHERE i = 1),
    al AS (SELECT series_id, day, CASE verdict WHEN 'model_better' THEN 1 WHEN 'reference_better' THEN 2 ELSE 3 END AS o, CASE verdict WHEN 'model_better' THEN 'model_closer_overall' WHEN 'reference_better' THEN 'reference_closer_overall' ELSE 'mixed_assessment' END AS code, CASE verdict WHEN 'reference_better' THEN 'warning' ELSE 'info' END AS severity, mm - rm AS value FROM sv WHERE verdict <> 'close'
      UNION ALL SELECT series_id, day, 4, 'morning_ramp_underestimated', 'warning', bias FROM bb WHERE band = 'morning' AND bias <= {-500 * SCALE} UNION ALL SELECT series_id, day, 5, 'morning_ramp_overestimated', 'info', bias FROM bb WHERE band = 'morning' AND bias >= {500 * SCALE}
      UNION ALL SELECT series_id, day, 6, 'daytime_level_underestimated', 'warning', bias FROM bb WHERE band = 'daytime' AND bias <= {-700 * SCALE} UNION ALL SELECT series_id, day, 7, 'afternoon_plateau_underestimated', 'warning', bias FROM bb WHERE band = 'late_afternoon' AND bias <= {-500 * SCALE}
      UNION ALL SELECT series_id, day, 8, 'large_single_hour_miss', 'warning', miss FROM sc WHERE miss >= {reports.LARGE_MISS * SCALE} UNION ALL SELECT series_id, day, CASE WHEN de < 0 THEN 9 ELSE 10 END, CASE WHEN de < 0 THEN 'sharp_model_drop_mismatch' ELSE 'sharp_model_rise_mismatch' END, 'warning', de FROM bk WHERE de <> 0
      UNION ALL SELECT series_id, day, 11, 'peak_timing_miss', 'warning', CAST(te AS DOUBLE) FROM pk WHERE abs(te) >= {reports.PEAK_HOURS} UNION ALL SELECT series_id, day, 12, 'peak_level_underestimated', 'warning', pe FROM pk WHERE pe <= {-reports.PEAK_LEVEL * SCALE} UNION ALL SELECT series_id, day, 13, 'peak_level_overestimated', 'info', pe FROM pk WHERE pe >= {reports.PEAK_LEVEL * SCALE}),
    ar AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY o) AS rank FROM al)"""


@_register(tb.with_ctes("pairs", more=_INSIGHTS) + f"SELECT series_id, CAST(day AS VARCHAR) AS day, rank, code, severity, {_r('value')} FROM ar WHERE rank <= {reports.INSIGHTS}")
def rp05_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(reports.insights(tb.pairs(spark, sf_dir), scale=SCALE))
