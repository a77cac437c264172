"""More registered queries: choices of days and origins, diagnostics, guards; with the same rows as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as tb
from .functions import constants as C
from .functions import scalars as S
from .operators import diagnostics, features, guards, history, intraday_rules, joins, weather_prep
from .plans import replay
from .queries import _BAND_SQL, _BUNDLE, _CALENDAR_SQL, _DAYS, _HOURLY_FC, _bundle, _days, _forecast, _out, _r, _register, _weather_sql

_DAY = "CAST(ts AS DATE)"
_TS = "CAST(ts AS VARCHAR) AS ts"

# Days, windows and origins ---------------------------------------------------------------------------------------------

_COMPLETE = f"cd AS (SELECT series_id, {_DAY} AS day, count(DISTINCT hour(ts)) AS hours FROM hourly GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) = 24), rk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS rank FROM cd)"


@_register(tb.with_ctes("hourly", more=_COMPLETE) + "SELECT series_id, CAST(day AS VARCHAR) AS day, hours, rank FROM rk WHERE rank <= 5")
def f09_last_complete_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(history.complete_days(tb.hourly(spark, sf_dir), last=5))


@_register(tb.with_ctes("hourly", more="w AS (SELECT *, max(ts) OVER (PARTITION BY series_id) AS last_ts FROM hourly)") + f"SELECT series_id, {_TS}, {_r('actual_mw')} FROM w WHERE ts >= last_ts - INTERVAL 14 DAYS AND {_DAY} < (SELECT max({_DAY}) FROM hourly)")
def f08_f12_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weeks of training rows, without the day on which the report is made."""
    h = tb.hourly(spark, sf_dir)
    made = h.agg(F.max(F.to_date("ts")).alias("made"))
    rows = history.training_window(h, 14).join(F.broadcast(made))
    return _out(history.before_day(rows, F.col("made")), "series_id", "ts", "actual_mw")


@_register(tb.with_ctes("vintages", more=f"o AS (SELECT series_id, {_DAY} AS target, captured_at, count(*) AS n, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY captured_at) AS i FROM vintages WHERE CAST(captured_at AS DATE) = {_DAY} GROUP BY 1, 2, 3)") + "SELECT series_id, CAST(target AS VARCHAR) AS target, CAST(captured_at AS VARCHAR) AS captured_at, n FROM o WHERE i = 1")
def j14_first_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(history.first_origins(tb.vintages(spark, sf_dir)))


_GAPS = f"g AS (SELECT series_id, {_DAY} AS day, hour(ts) AS hour, model_mw - actual_mw AS gap FROM pairs WHERE hour(ts) % 3 <> 0), e AS (SELECT series_id, {_DAY} AS day, hour(ts) AS hour FROM pairs)"


@_register(tb.with_ctes("pairs", more=f"{_GAPS}, c AS (SELECT e.*, g.hour AS from_hour, g.gap, row_number() OVER (PARTITION BY e.series_id, e.day, e.hour ORDER BY (g.hour = e.hour) DESC, abs(g.gap) DESC, g.hour) AS i FROM e LEFT JOIN g ON g.series_id = e.series_id AND g.day = e.day AND abs(g.hour - e.hour) <= 1)") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, hour, from_hour, {_r('gap AS value')} FROM c WHERE i = 1")
def j16_exact_or_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir).select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), (F.col("model_mw") - F.col("actual_mw")).alias("gap"))
    return _out(history.exact_or_neighbour(p.select("series_id", "day", "hour"), p.where(F.col("hour") % 3 != 0), "gap"))


@_register(tb.with_ctes("pairs", "hourly", more="a AS (SELECT * FROM hourly WHERE hour(ts) % 2 = 0), m AS (SELECT series_id, ts, model_mw FROM pairs WHERE hour(ts) % 3 = 0), f AS (SELECT series_id, ts, reference_mw FROM pairs WHERE hour(ts) % 5 = 0)") + f"SELECT series_id, {_TS}, {_r('actual_mw AS actual', 'model_mw AS model', 'reference_mw AS reference')} FROM a FULL JOIN m USING (series_id, ts) FULL JOIN f USING (series_id, ts)")
def j17_set04_union_of_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, p, hour = tb.hourly(spark, sf_dir), tb.pairs(spark, sf_dir), F.hour("ts")
    one = lambda df, c, n: df.where(hour % n == 0).select("series_id", "ts", F.col(c).alias("value"))
    return _out(history.union_of_hours(("actual", one(h, "actual_mw", 2)), ("model", one(p, "model_mw", 3)), ("reference", one(p, "reference_mw", 5))))


@_register(tb.with_ctes("hourly") + f"SELECT series_id, CAST({_DAY} AS VARCHAR) AS day FROM hourly WHERE hour(ts) < 6 INTERSECT SELECT series_id, CAST({_DAY} AS VARCHAR) FROM hourly WHERE hour(ts) >= 20")
def set05_common_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.hourly(spark, sf_dir)
    days = lambda on: h.where(on).select("series_id", F.to_date("ts").alias("day"))
    return _out(days(F.hour("ts") < 6).intersect(days(F.hour("ts") >= 20)))


@_register("WITH e AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, event_id, value FROM events), l AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY event_id DESC) AS i FROM e) " + f"SELECT series_id, {_TS}, event_id, {_r('value AS actual_mw')} FROM l WHERE i = 1")
def set_dedup2_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tb.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("value").alias("actual_mw"))
    return _out(history.keep_last(e, "event_id"))


@_register("WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 ELSE 1 END, ts, event_id) AS i FROM events) SELECT user_id, event_type, event_id FROM e WHERE i = 1")
def set06_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a user's events one: a purchase before others, then the earliest."""
    e = tb.read_table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return _out(diagnostics.first_wins(e, ["user_id"], F.struct((F.col("event_type") != "purchase"), "ts", "event_id")), "user_id", "event_type", "event_id")


_TAIL = f"""r AS (SELECT series_id, {_DAY} AS day, sign(model_mw - actual_mw) AS s, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY ts DESC) AS i FROM pairs),
    f AS (SELECT *, first(s) OVER (PARTITION BY series_id, day ORDER BY i) AS s1 FROM r), b AS (SELECT *, sum(CASE WHEN s = s1 AND s <> 0 THEN 0 ELSE 1 END) OVER (PARTITION BY series_id, day ORDER BY i) AS o FROM f)"""


@_register(tb.with_ctes("pairs", more=_TAIL) + "SELECT series_id, CAST(day AS VARCHAR) AS day, count(*) FILTER (o = 0) AS tail, CAST(max(s1) AS BIGINT) AS sign FROM b GROUP BY 1, 2")
def win11_same_sign_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir).withColumn("e", F.col("model_mw") - F.col("actual_mw"))
    return _out(history.same_sign_tail(p, "e"))


_SLOPE = f"""s AS (SELECT series_id, {_DAY} AS day, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 3.6e9 AS h, temp_c - lag(temp_c) OVER w AS d FROM weather WINDOW w AS (PARTITION BY series_id, {_DAY} ORDER BY ts)),
    k AS (SELECT *, d / h AS slope, row_number() OVER (PARTITION BY series_id, day ORDER BY ts DESC) AS i FROM s WHERE h BETWEEN 0.5 AND 1.5)"""


@_register(tb.with_ctes("weather", more=_SLOPE) + f"SELECT series_id, CAST(day AS VARCHAR) AS day, count(*) AS n, {_r('median(slope) AS slope')} FROM k WHERE i <= 3 GROUP BY 1, 2")
def win16_recent_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(history.recent_slope(tb.weather(spark, sf_dir), "temp_c"))


@_register(tb.with_ctes("weather", more="x AS (SELECT *, greatest(0, temp_c - 22) AS c FROM weather)") + f"SELECT series_id, {_TS}, {_r('avg(c) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 2 HOURS PRECEDING AND CURRENT ROW) AS cooling_degree_3h_timed', 'avg(c) OVER (PARTITION BY series_id ORDER BY ts RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW) AS cooling_degree_6h_timed')} FROM x")
def win05_timed_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tb.weather(spark, sf_dir).withColumn("cooling_degree", S.degree(F.col("temp_c"), C.COOLING_BASE))
    return _out(history.timed_degree_means(w, "cooling_degree"), "series_id", "ts", "cooling_degree_3h_timed", "cooling_degree_6h_timed")


_NOW = "2024-01-20 06:00:00"


@_register(tb.with_ctes("hourly", more=f"n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS step FROM hourly WHERE ts > TIMESTAMP '{_NOW}')") + f"SELECT series_id, {_TS}, {_r('actual_mw')}, step FROM n WHERE step <= 3")
def tk08_next_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(history.next_hours(tb.hourly(spark, sf_dir), F.lit(_NOW).cast("timestamp_ntz")))


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with gaps in the actuals and their sources."""
    hour, late = F.hour("ts"), F.col("reference_mw")
    source = F.when(hour % 7 == 3, F.lit(None)).when(hour == 23, C.FALLBACK).otherwise(C.OBSERVED)
    return tb.pairs(spark, sf_dir).withColumn("actual_source", source).withColumn("actual_mw", F.when(hour % 7 == 3, None).when(hour == 23, late).otherwise(F.col("actual_mw")))


_SOURCED = "so AS (SELECT series_id, ts, model_mw, reference_mw, CASE WHEN hour(ts) % 7 = 3 THEN NULL WHEN hour(ts) = 23 THEN reference_mw ELSE actual_mw END AS actual_mw, CASE WHEN hour(ts) % 7 = 3 THEN NULL WHEN hour(ts) = 23 THEN 'reference_forecast_fallback' ELSE 'observed' END AS actual_source FROM pairs)"
_LATE = f"{_DAY} BETWEEN (SELECT max({_DAY}) FROM so) - 2 AND (SELECT max({_DAY}) FROM so) - 1 AND actual_mw IS NULL"


@_register(tb.with_ctes("pairs", more=_SOURCED) + f"SELECT series_id, {_TS}, {_r(f'CASE WHEN {_LATE} THEN reference_mw ELSE actual_mw END AS actual_mw')}, CASE WHEN {_LATE} THEN 'reference_forecast_fallback' ELSE actual_source END AS actual_source FROM so")
def st06_finalized_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sourced(spark, sf_dir)
    rows = rows.join(F.broadcast(rows.agg(F.max(F.to_date("ts")).alias("today"))))
    return _out(history.finalize_fallback(rows, F.col("today")), "series_id", "ts", "actual_mw", "actual_source")


@_register(tb.with_ctes("pairs", more=_SOURCED) + f"""SELECT series_id, CAST({_DAY} + 1 AS VARCHAR) AS target, count(DISTINCT hour(ts)) FILTER (actual_source = 'observed') AS observed,
    NOT coalesce(count(DISTINCT hour(ts)) FILTER (actual_source = 'observed') = 24 OR (count(DISTINCT hour(ts)) FILTER (actual_source = 'observed') = 23 AND max(hour(ts)) FILTER (actual_source = 'observed') = 22 AND bool_or(hour(ts) = 23 AND actual_source = 'reference_forecast_fallback')), false) AS switch FROM so GROUP BY series_id, {_DAY}""")
def m10_partial_lag_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(history.partial_lag_days(_sourced(spark, sf_dir)))


_FACTS = "fa AS (SELECT series_id, ts, CASE WHEN hour(ts) < 18 THEN 1.0::DOUBLE END AS actual_mw, CASE WHEN hour(ts) % 4 <> 0 THEN temp_c END AS temp_c, CASE WHEN hour(ts) % 4 = 0 THEN NULL WHEN hour(ts) % 5 = 0 THEN 'forecast' ELSE 'observed' END AS temp_source FROM weather WHERE hour(ts) < 21), fo AS (SELECT series_id, ts, temp_c + 1 AS new_c FROM weather WHERE hour(ts) >= 12)"


@_register(tb.with_ctes("weather", more=f"{_FACTS}, bo AS (SELECT *, new_c IS NOT NULL AND (fa.ts IS NULL OR temp_c IS NULL OR (actual_mw IS NULL AND NOT coalesce(temp_source = 'observed', false))) AS fresh, fa.ts IS NULL AS virtual FROM fa FULL JOIN fo ON fa.series_id = fo.series_id AND fa.ts = fo.ts)") + f"SELECT coalesce(series_id, series_id_1) AS series_id, CAST(coalesce(ts, ts_1) AS VARCHAR) AS ts, {_r('actual_mw', 'CASE WHEN fresh THEN new_c ELSE temp_c END AS temp_c')}, CASE WHEN fresh THEN 'forecast' ELSE temp_source END AS temp_source, virtual FROM bo")
def j08_w_extend_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a day until 21 h, whose demand ends at 18 h, extended by a forecast from noon on."""
    w, hour = tb.weather(spark, sf_dir), F.hour("ts")
    facts = w.where(hour < 21).select("series_id", "ts", F.when(hour < 18, 1.0).alias("actual_mw"), F.when(hour % 4 != 0, F.col("temp_c")).alias("temp_c"), F.when(hour % 4 == 0, None).when(hour % 5 == 0, "forecast").otherwise("observed").alias("temp_source"))
    return _out(history.extend_weather(facts, w.where(hour >= 12).select("series_id", "ts", (F.col("temp_c") + 1).alias("temp_c"))))


# Diagnostics -----------------------------------------------------------------------------------------------------------

_STAGES = ("raw_mw", "blended_mw", "final_mw")
_LONG = "lo AS (SELECT series_id, ts, actual_mw, i AS stage_order, ['raw_mw', 'blended_mw', 'final_mw'][i + 1] AS stage, [reference_mw, (reference_mw + model_mw) / 2, model_mw][i + 1] AS value FROM pairs, (SELECT unnest([0, 1, 2]) AS i)), de AS (SELECT *, value - lag(value) OVER (PARTITION BY series_id, ts ORDER BY stage_order) AS delta FROM lo)"


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir).withColumns({"raw_mw": F.col("reference_mw"), "blended_mw": (F.col("reference_mw") + F.col("model_mw")) / 2, "final_mw": F.col("model_mw")})
    return diagnostics.stage_rows(p, _STAGES)


@_register(tb.with_ctes("pairs", more=_LONG) + f"SELECT series_id, stage, count(*) AS n, {_r('avg(abs(value - actual_mw)) AS mae', 'avg(value - actual_mw) AS bias', 'sqrt(avg((value - actual_mw) * (value - actual_mw))) AS rmse')} FROM lo GROUP BY 1, 2")
def a20_stage_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.stage_metrics(_stages(spark, sf_dir)))


@_register(tb.with_ctes("pairs", more=_LONG) + f"SELECT series_id, {_TS}, stage, {_r('value', 'delta')} FROM de")
def win18_stage_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.stage_deltas(_stages(spark, sf_dir)), "series_id", "ts", "stage", "value", "delta")


_SHIFTS = f"sh AS (SELECT series_id, {_DAY} AS day, hour(ts) AS hour, arg_max(value, stage_order) - arg_min(value, stage_order) AS net, max(abs(delta)) AS largest FROM de GROUP BY 1, 2, 3), sr AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY round(greatest(abs(net), coalesce(largest, 0)), 6) DESC, hour) AS rank FROM sh)"


@_register(tb.with_ctes("pairs", more=f"{_LONG}, {_SHIFTS}") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, hour, {_r('net', 'largest')}, rank FROM sr WHERE rank <= 5")
def tk06_stage_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.top_stage_shifts(_stages(spark, sf_dir)))


_OFF = f"{tb.calendar_ctes(_DAYS)}, "
_JOINED = f"jf AS (SELECT h.actual_mw, fc.*, {_BAND_SQL.replace('hour(ts)', 'hour(h.ts)')} AS band, CASE WHEN c.is_off THEN 'non_business' ELSE 'business' END AS regime FROM hourly h JOIN fc ON fc.series_id = h.series_id AND fc.ts = h.ts JOIN calendar c ON c.day = CAST(h.ts AS DATE))"


def _regimes(rows: DataFrame) -> DataFrame:
    cal = tb.calendar(_days(rows)).select(F.col("day").alias("of"), F.when(F.col("is_off"), "non_business").otherwise("business").alias("kind"))
    return rows.join(F.broadcast(cal), F.to_date("ts") == F.col("of")).drop("of")


@_register(_HOURLY_FC[:-1] + f", {_JOINED} SELECT series_id, regime, band, count(*) AS n, {_r('avg(CAST(actual_mw BETWEEN p95_lower_mw AND p95_upper_mw AS INT)) * 100 AS coverage_pct')}, count(*) FILTER (actual_mw > p95_upper_mw) AS above, count(*) FILTER (actual_mw < p95_lower_mw) AS below, {_r('avg(p95_upper_mw - p95_lower_mw) AS mean_width')} FROM jf GROUP BY GROUPING SETS ((series_id), (series_id, regime), (series_id, band))")
def a13_coverage_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _forecast(spark, sf_dir)
    return _out(diagnostics.coverage_bundle(_regimes(h.join(f, ["series_id", "ts"])), "kind"))


@_register(_HOURLY_FC[:-1] + f", {_JOINED}, sq AS (SELECT series_id, regime, band, count(*) AS n, quantile_cont(abs(forecast_mw - actual_mw), 0.95) AS half_width FROM jf GROUP BY GROUPING SETS ((series_id, regime), (series_id, band))) SELECT series_id, regime, band, n, {_r('half_width')} FROM sq WHERE n >= 3")
def i05_shadow_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _forecast(spark, sf_dir)
    return _out(diagnostics.shadow_half_width(_regimes(h.join(f, ["series_id", "ts"])), "kind", "forecast_mw", least=3))


_HISTORY = f"""dr AS (SELECT series_id, {_DAY} AS day, {_BAND_SQL} AS band, model_mw - actual_mw AS e, dense_rank() OVER (PARTITION BY series_id ORDER BY {_DAY} DESC) AS i FROM pairs),
    bd AS (SELECT series_id, band, day, avg(e) AS bias, avg(abs(e)) AS mae FROM dr WHERE i <= 7 GROUP BY 1, 2, 3)"""


@_register(tb.with_ctes("pairs", more=_HISTORY) + f"SELECT series_id, band, count(*) AS days, count(*) FILTER (bias > 2) AS over, count(*) FILTER (bias < -2) AS under, {_r('avg(bias) AS bias', 'avg(mae) AS mae')}, 2 * greatest(count(*) FILTER (bias > 2), count(*) FILTER (bias < -2)) > count(*) AS repeated FROM bd GROUP BY 1, 2")
def a24_band_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.band_history(tb.pairs(spark, sf_dir), "model_mw", miss=2.0))


@_register(tb.with_ctes("pairs", more=f"{_SOURCED}, v AS (SELECT *, coalesce(actual_mw, reference_mw) AS value FROM so)") + f"SELECT series_id, CAST({_DAY} AS VARCHAR) AS day, {_r('max(value) AS peak_mw')}, first(hour(ts) ORDER BY value DESC, ts) AS peak_hour, first(actual_mw IS NOT NULL ORDER BY value DESC, ts) AS peak_is_actual, count(actual_mw) AS n_actual FROM v GROUP BY series_id, {_DAY}")
def a11_day_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.day_summary(_sourced(spark, sf_dir)))


@_register(tb.with_ctes("pairs", more=_SOURCED) + f"SELECT series_id, CAST({_DAY} AS VARCHAR) AS day, count(*) AS rows, count(actual_mw) AS comparable, count(*) FILTER (actual_source = 'observed') AS observed, count(*) FILTER (actual_source = 'reference_forecast_fallback') AS fallback, CASE WHEN count(actual_mw) < 24 THEN 'intraday' WHEN count(*) FILTER (actual_source = 'reference_forecast_fallback') > 0 THEN 'final_with_fallback' ELSE 'final' END AS state FROM so GROUP BY series_id, {_DAY}")
def dq05_dq06_day_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.source_summary(_sourced(spark, sf_dir)))


@_register(tb.with_ctes("hourly") + f"SELECT series_id, CAST({_DAY} AS VARCHAR) AS day, count(*) AS n, count(*) FILTER (NOT actual_mw BETWEEN 20 AND 120) AS out_of_range, count(*) FILTER (actual_mw < 0) AS negative, bool_and(actual_mw = 0) AS all_zero, coalesce(array_to_string((list(hour(ts) ORDER BY ts) FILTER (NOT actual_mw BETWEEN 20 AND 120))[1:3], ','), '') AS examples FROM hourly GROUP BY series_id, {_DAY}")
def dq02_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.range_check(tb.hourly(spark, sf_dir), "actual_mw", 20.0, 120.0))


_FOCUS = f"""pe AS (SELECT series_id, {_DAY} AS day, hour(ts) AS hour, actual_mw, model_mw, abs(model_mw - actual_mw) AS e, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY actual_mw DESC, ts) AS ka, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY model_mw DESC, ts) AS km, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY round(abs(model_mw - actual_mw), 6) DESC, ts) AS ke FROM pairs),
    fo AS (SELECT *, CASE WHEN ke <= 3 THEN 4 ELSE 0 END + CASE WHEN km = 1 THEN 2 ELSE 0 END + CASE WHEN ka = 1 THEN 3 ELSE 0 END AS score FROM pe), fr AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY score DESC, hour) AS i FROM fo WHERE score > 0)"""


@_register(tb.with_ctes("pairs", more=_FOCUS) + "SELECT series_id, CAST(day AS VARCHAR) AS day, hour, CAST(score AS BIGINT) AS score, array_to_string(list_filter([CASE WHEN ke <= 3 THEN 'miss' END, CASE WHEN km = 1 THEN 'model_peak' END, CASE WHEN ka = 1 THEN 'peak' END], lambda x: x IS NOT NULL), ',') AS kinds FROM fr WHERE i <= 4")
def tk05_focus_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir).select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), "actual_mw", "model_mw", F.round(F.abs(F.col("model_mw") - F.col("actual_mw")), 6).alias("e"))
    top = lambda n, c: joins.top_rows(p, ["series_id", "day"], n, F.desc(c), F.col("hour"))
    return _out(diagnostics.focus_hours({"miss": (4, top(3, "e")), "peak": (3, top(1, "actual_mw")), "model_peak": (2, top(1, "model_mw"))}, 4))


@_register(_HOURLY_FC[:-1] + f""", pf AS (SELECT *, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY forecast_mw DESC, ts) AS i FROM fc), su AS (SELECT series_id, ts, actual_mw * 1.1 AS supply_mw FROM hourly WHERE hour(ts) % 2 = 0), us AS (SELECT series_id, quantile_cont(supply_mw, 0.75) AS usual_mw FROM su GROUP BY 1),
    ex AS (SELECT p.series_id, p.ts, 100 * forecast_mw / nullif(coalesce(supply_mw, usual_mw), 0) AS usage_pct FROM pf p LEFT JOIN su ON su.series_id = p.series_id AND su.ts = p.ts LEFT JOIN us ON us.series_id = p.series_id WHERE i = 1) SELECT series_id, CAST({_DAY} AS VARCHAR) AS day, CAST(ts AS VARCHAR) AS peak_ts, {_r('usage_pct')}, CASE WHEN usage_pct >= 97 THEN 'critical' WHEN usage_pct >= 92 THEN 'warning' WHEN usage_pct IS NOT NULL THEN 'normal' END AS severity FROM ex""")
def an06_j22_expected_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _forecast(spark, sf_dir)
    return _out(diagnostics.expected_severity(f, h.where(F.hour("ts") % 2 == 0).select("series_id", "ts", (F.col("actual_mw") * 1.1).alias("supply_mw"))))


_NOTWORSE = f"""ag AS (SELECT *, max({_DAY}) OVER (PARTITION BY series_id) - {_DAY} AS age FROM pairs), wi AS (SELECT ag.*, n FROM ag, (SELECT unnest([7, 14, 28]) AS n) WHERE age < n),
    wo AS (SELECT series_id, n, avg(abs(model_mw - actual_mw)) <= avg(abs(reference_mw - actual_mw)) AND sum(abs(model_mw - actual_mw)) / sum(abs(actual_mw)) <= sum(abs(reference_mw - actual_mw)) / sum(abs(actual_mw)) AS ok FROM wi GROUP BY 1, 2)"""


@_register(tb.with_ctes("pairs", more=_NOTWORSE) + "SELECT series_id, count(*) AS windows, bool_and(ok) AS passes FROM wo GROUP BY 1")
def ev18_windows_not_worse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.windows_not_worse(tb.pairs(spark, sf_dir), "model_mw", "reference_mw", (7, 14, 28)))


_AREA = """ar AS (SELECT series_id, 'all' AS scope, actual_mw, reference_mw - actual_mw AS e FROM pairs UNION ALL SELECT series_id, '9-18', actual_mw, reference_mw - actual_mw FROM pairs WHERE hour(ts) BETWEEN 9 AND 18
      UNION ALL SELECT series_id, 'matched_reference', actual_mw, reference_mw - actual_mw FROM pairs WHERE hour(ts) % 2 = 0 UNION ALL SELECT series_id, 'matched_served', actual_mw, model_mw - actual_mw FROM pairs WHERE hour(ts) % 2 = 0)"""


@_register(tb.with_ctes("pairs", more=_AREA) + f"SELECT series_id, scope, count(*) AS n, {_r('avg(abs(e)) AS mae', 'avg(e) AS bias', 'sum(abs(e)) * 100 / sum(abs(actual_mw)) AS wape')} FROM ar GROUP BY 1, 2")
def ev15_j19_area_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir)
    served = p.where(F.hour("ts") % 2 == 0).select("series_id", "ts", F.col("model_mw").alias("served_mw"))
    return _out(diagnostics.area_benchmark(p, served))


# Guards ----------------------------------------------------------------------------------------------------------------

#: Rules have their own limits in MW; the tables are derived demand.
_G = 1
_GUARD_CTES = f"""{_CALENDAR_SQL}, {_weather_sql(True)},
    gj AS (SELECT cm.series_id, cm.ts, cm.day, CAST(cm.hour AS INT) AS hour, cm.off, cm.mm, cm.lag_24h, cm.lag_24h_hourly_delta AS ld, cm.recent_same_business_type_mean AS um, cm.recent_same_business_type_delta_mean AS ud, cm.consec_holiday_len AS len, cm.days_since_holiday_end AS since,
      cm.actual_mw AS act, c7.is_off AS off7, wf.temp_anomaly_7d AS t7, wf.discomfort_delta_24h AS dd, last_value(cm.hourly_delta IGNORE NULLS) OVER d AS sd, list(cm.hourly_delta) FILTER (cm.hourly_delta IS NOT NULL) OVER d AS dl, list(cm.hourly_delta) FILTER (cm.hourly_delta IS NOT NULL) OVER k AS kl, wf.temp_delta_24h AS td, wf.cooling_delta_24h AS cd, wf.temp_anomaly_doy AS ta, cm.roll_4w_mean AS raw, (cm.roll_4w_mean + cm.lag_24h) / 2 AS f,
      last_value(cm.hour IGNORE NULLS) OVER d AS seen, last_value(cm.actual_mw IGNORE NULLS) OVER d AS seen_mw
      FROM cm LEFT JOIN wf ON wf.series_id = cm.series_id AND wf.ts = cm.ts LEFT JOIN calendar c7 ON c7.day = cm.day - 7 WINDOW d AS (PARTITION BY cm.series_id, cm.day ORDER BY cm.hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), k AS (PARTITION BY cm.series_id, cm.hour, cm.off ORDER BY cm.ts ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
    gx AS (SELECT *, coalesce(seen >= 10 AND (sd <= -300 OR list_avg(dl[-2:]) <= -300), false) AS softer, CASE WHEN len(kl) >= 3 THEN list_aggregate(kl, 'quantile_cont', 0.25) ELSE list_avg(kl) END AS q25, greatest(ld, ud) AS sup, least(ld, ud) AS low, greatest(0, coalesce(td, 0), coalesce(cd, 0)) AS warm, greatest(0, coalesce(td, 0), coalesce(cd, 0), coalesce(ta, 0)) AS warmer FROM gj WHERE raw IS NOT NULL AND lag_24h IS NOT NULL),
    gr AS (SELECT g.*, lag(g.f) OVER (PARTITION BY g.series_id, g.day ORDER BY g.ts) AS before, s.f AS then_f FROM gx g LEFT JOIN gx s ON s.series_id = g.series_id AND s.day = g.day AND s.hour = g.seen)"""
_GUARD_SQL = "WITH " + tb.DEMAND_CTES + ", " + _GUARD_CTES.replace(tb.calendar_ctes(_DAYS) + ",", "")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every hour of demand, the mean of its slot as raw forecast, and that mixed with yesterday as
    forecast."""
    h = tb.demand(spark, sf_dir)
    rows = features.build_features(h, tb.weather(spark, sf_dir), tb.calendar(_days(h), tb.DEMAND_HOLIDAYS))
    return tb.written(rows.withColumns({"raw_mw": F.col("roll_4w_mean"), "forecast_mw": (F.col("roll_4w_mean") + F.col("lag_24h")) / 2}).where("roll_4w_mean is not null and lag_24h is not null"), "guard-rows")


_SHIFTS: dict[str, str] = {}


def _guard(name: str, shift: str, rule, over_raw: float | None = None) -> None:
    """Register ``rule``, with ``shift`` as the SQL of its move; ``over_raw``: over the raw forecast and so
    many MW more, which stands over yesterday and the usual level where the mixed one does not."""
    _SHIFTS[name] = shift
    over = f"(SELECT * REPLACE (raw + {over_raw} AS f) FROM gr)" if over_raw is not None else "gr"

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _guarded(spark, sf_dir)
        if over_raw is not None:
            before = before.withColumn("forecast_mw", F.col("raw_mw") + over_raw)
        return _out(rule(before.withColumn("before_mw", F.col("forecast_mw"))).withColumn("shift_mw", F.col("forecast_mw") - F.col("before_mw")), "series_id", "ts", "raw_mw", "forecast_mw", "shift_mw")

    query.__name__ = name
    _register(_GUARD_SQL + f", gs AS (SELECT series_id, ts, raw AS raw_mw, f, coalesce(CAST({shift} AS DOUBLE), 0) AS shift_mw FROM {over}) " + f"SELECT series_id, {_TS}, {_r('raw_mw', 'f + shift_mw AS forecast_mw', 'shift_mw')} FROM gs")(query)


_RETURN = "off = 0 AND mm > 0"
_SHARE = "CASE hour " + " ".join(f"WHEN {h} THEN {s}" for h, s in guards.RETURN_SHARES.items()) + " END"
_STRONG = f"coalesce(hour >= 9 AND sup >= {700 * _G}, false)"
_OVER = f"(f - (um + {500 * _G} + least(warmer * {100 * _G}, {300 * _G}) + CASE WHEN {_STRONG} THEN least(sup * 0.35, {650 * _G}) ELSE 0 END))"
_KEEP = f"({300 * _G} + least(warm * {120 * _G}, {300 * _G}))"
_HEAT = "((coalesce(len >= 3 AND since <= 1, false) OR coalesce(off = 0 AND off7, false)) AND coalesce(t7 >= 2, false))"
_WARMDAY = "coalesce(off = 0 AND ta >= 1, false)"
_LATE = f"({_WARMDAY} AND hour BETWEEN 15 AND 19 AND coalesce(ud <= 0 AND ld <= 500, false))"
_DAYTIME = f"""CASE WHEN hour BETWEEN 10 AND 19 AND ({_HEAT} OR {_WARMDAY}) THEN least(CASE WHEN f < raw AND NOT {_LATE} THEN raw ELSE f END + least(greatest(CASE WHEN {_HEAT} THEN 300 END, CASE WHEN {_WARMDAY} AND f <= raw THEN CASE WHEN {_LATE} THEN 0 ELSE 250 END END, 0), 900),
    CASE WHEN NOT coalesce(mm > 0, false) THEN lag_24h + 2500 + least(warm * 1200, 5000) END) - f END"""


def _week_before(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows plus lag_168h_off: whether the day a week before was off."""
    cal = tb.calendar(_days(tb.demand(spark, sf_dir)), tb.DEMAND_HOLIDAYS)
    before = cal.select(F.date_add("day", 7).alias("day"), F.col("is_off").cast("int").alias("lag_168h_off"))
    return rows.withColumn("day", F.to_date("ts")).join(F.broadcast(before), "day", "left")


_guard("g02_block_post_holiday_rise", "CASE WHEN hour BETWEEN 1 AND 6 AND len >= 3 AND since <= 1 AND f > raw THEN raw - f END", guards.block_post_holiday_rise)
_guard("g03_block_hot_day_fall", "CASE WHEN hour BETWEEN 10 AND 19 AND ta >= 1 AND raw > f THEN raw - f END", guards.block_hot_day_fall)
_guard("g04_cap_over_yesterday", f"CASE WHEN hour BETWEEN 10 AND 19 AND ta >= 1 AND mm = 0 AND f > lag_24h + {2500 * _G} + least({1200 * _G} * greatest(0, coalesce(td, 0)), {5000 * _G}) THEN lag_24h + {2500 * _G} + least({1200 * _G} * greatest(0, coalesce(td, 0)), {5000 * _G}) - f END", lambda r: guards.cap_over_yesterday(r, 2500 * _G, 1200 * _G, 5000 * _G), over_raw=0.0)
_guard("g05_warm_day_offset", f"CASE WHEN hour BETWEEN 10 AND 19 AND off = 0 AND ta >= 1 AND NOT coalesce(hour >= 15 AND ud <= 0 AND ld <= {500 * _G}, false) THEN {250 * _G} END", lambda r: guards.warm_day_offset(r, scale=_G))
_guard("g06_limit_analog_fall", f"CASE WHEN hour BETWEEN 7 AND 15 AND off = 1 AND raw - f > {_G} AND (coalesce(sup >= {500 * _G}, false) OR coalesce(raw <= um + {900 * _G}, false)) THEN raw - f END", lambda r: guards.limit_analog_fall(r, scale=_G))
_guard("g07_lift_morning_shape", f"CASE WHEN hour BETWEEN 6 AND 7 AND off = 1 AND before + sup - f >= {700 * _G} AND (before + sup - {250 * _G} - f) * 0.75 >= {100 * _G} THEN least((before + sup - {250 * _G} - f) * 0.75, {800 * _G}) END", guards.lift_morning_shape)
_guard(
    "g08_g09_lift_return_shortfall",
    f"CASE WHEN {_RETURN} AND hour BETWEEN 6 AND 11 AND um - lag_24h >= {6000 * _G} AND coalesce(ud - (f - before) >= {800 * _G}, true) AND NOT coalesce(seen >= 7 AND hour - seen BETWEEN 1 AND 3 AND then_f - seen_mw >= {1200 * _G}, false) AND um - {1000 * _G} > f THEN least((um - {1000 * _G} - f) * {_SHARE}, {1000 * _G}) END",
    lambda r: guards.lift_return_shortfall(r, scale=_G),
)
_guard("g10_cap_return_excess", f"CASE WHEN {_RETURN} AND hour BETWEEN 8 AND 11 AND um - lag_24h >= {1000 * _G} AND {_OVER} > 0 THEN -least({_OVER} * CASE WHEN {_STRONG} THEN 0.25 ELSE 0.6 END, {900 * _G}) END", lambda r: guards.cap_return_excess(r, scale=_G), over_raw=1500.0)
_guard("g11_cap_afternoon_analog", f"CASE WHEN hour BETWEEN 13 AND 16 AND off = 0 AND f - raw >= {600 * _G} AND warm >= 0.5 AND coalesce(sup <= {900 * _G}, true) AND f - raw > {_KEEP} THEN {_KEEP} - (f - raw) END", lambda r: guards.cap_afternoon_analog(r, scale=_G))
_guard("g11b_cap_declining_analog", f"CASE WHEN hour BETWEEN 13 AND 20 AND off = 0 AND mm = 0 AND f - raw >= {300 * _G} AND warm <= 0 AND sup <= {200 * _G} AND f - raw > {100 * _G} THEN {100 * _G} - (f - raw) END", lambda r: guards.cap_declining_analog(r, scale=_G))
_guard("g12_limit_afternoon_fall", f"CASE WHEN hour BETWEEN 13 AND 16 AND off = 0 AND raw - f > {600 * _G} AND warm >= 0.5 AND coalesce(sup >= {-700 * _G}, true) AND coalesce(raw <= um + {900 * _G}, true) THEN raw - f - {300 * _G} END", lambda r: guards.limit_afternoon_fall(r, scale=_G))
_FALLS = "list_filter([ld, ud, CASE WHEN softer THEN q25 END], lambda x: x <= -500)"
_PULL_OVER = f"(f - (before + CASE WHEN softer THEN list_min({_FALLS}) ELSE list_avg({_FALLS}) END))"
_PULL = f"CASE WHEN hour = 12 AND off = 0 AND {_PULL_OVER} >= 300 THEN -least({_PULL_OVER} * 0.75, CASE WHEN softer THEN 1200 ELSE 900 END) END"
_guard("g13_pull_midday", _PULL, guards.pull_midday)




_SPIKE = """CASE WHEN e.off = 0 AND e.nxt IS NOT NULL THEN coalesce(
    CASE WHEN slope AND (e.f - mid - 400) * 0.75 >= 100 THEN least((e.f - mid - 400) * 0.75, 1400) WHEN local AND NOT slope AND (e.f - mid - 700) * 0.75 >= 150 THEN least((e.f - mid - 700) * 0.75, 1400) END,
    CASE WHEN e.hour BETWEEN 13 AND 17 AND coalesce(e.sup <= 500, true) AND coalesce(wx <= 2, true) AND coalesce(e.sd <= 900, true) AND peak >= 600 AND (e.f - mid - 450) * 0.75 >= 100 THEN least((e.f - mid - 450) * 0.75, 700) END, 0.0) ELSE 0.0 END"""
_SPIKES = f"""p0 AS MATERIALIZED (SELECT *, lead(f) OVER w AS nxt, row_number() OVER w AS i FROM FROMS WINDOW w AS (PARTITION BY series_id, day ORDER BY hour)),
    p1 AS (SELECT series_id, day, i, hour, 0.0::DOUBLE AS cut, f AS prev FROM p0 WHERE i = 1 UNION ALL SELECT e.series_id, e.day, e.i, e.hour, z.cut, e.f - z.cut FROM p1 r JOIN p0 e ON e.series_id = r.series_id AND e.day = r.day AND e.i = r.i + 1,
      LATERAL (SELECT e.f - greatest(r.prev, e.nxt) AS peak, (r.prev + e.nxt) / 2 AS mid, e.f - r.prev - e.sup AS beyond, greatest(e.td, e.cd) AS wx) x,
      LATERAL (SELECT coalesce(e.hour BETWEEN 8 AND 11 AND peak >= 1000 AND e.f - e.nxt >= 800 AND beyond >= 1000, false) AS sharp) y0,
      LATERAL (SELECT sharp AND coalesce(wx <= 3.5, true) AS local, coalesce(e.hour BETWEEN 8 AND 10 AND e.f - r.prev >= 4000 AND beyond >= 900 AND (coalesce(wx BETWEEN 1.5 AND 6, false) OR coalesce(e.dd >= 2, false)), false) AND NOT (sharp AND NOT coalesce(wx <= 3.5, true)) AS slope) y,
      LATERAL (SELECT CAST({_SPIKE} AS DOUBLE) AS cut) z)"""


@_register(_GUARD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + _SPIKES.replace("FROMS", "(SELECT * REPLACE (f + CASE WHEN (hour * 7 + day(ts)) % 5 = 0 THEN 1500 ELSE 0 END AS f) FROM gr)") + f" SELECT p0.series_id, CAST(p0.ts AS VARCHAR) AS ts, {_r('p0.f AS before_mw', 'p1.cut AS shift_mw')} FROM p0 JOIN p1 USING (series_id, day, hour)")
def g14_flatten_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over forecasts with a spike of 1,500 MW in every fifth hour."""
    spiky = F.when((F.hour("ts") * 7 + F.dayofmonth("ts")) % 5 == 0, 1500.0).otherwise(0.0)
    before = _guarded(spark, sf_dir).withColumn("forecast_mw", F.col("forecast_mw") + spiky).withColumn("before_mw", F.col("forecast_mw"))
    return _out(guards.flatten_spikes(before).withColumn("shift_mw", F.col("before_mw") - F.col("forecast_mw")), "series_id", "ts", "before_mw", "shift_mw")


@_register(_GUARD_SQL + f", gs AS (SELECT series_id, ts, raw AS raw_mw, f, coalesce(CAST({_DAYTIME} AS DOUBLE), 0) AS shift_mw FROM gr) SELECT series_id, {_TS}, {_r('raw_mw', 'f + shift_mw AS forecast_mw', 'shift_mw')} FROM gs")
def g03_g05_guard_daytime(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _week_before(_guarded(spark, sf_dir), spark, sf_dir).withColumn("before_mw", F.col("forecast_mw"))
    return _out(guards.guard_daytime(before).withColumn("shift_mw", F.col("forecast_mw") - F.col("before_mw")), "series_id", "ts", "raw_mw", "forecast_mw", "shift_mw")


_ANALOGS = """wd AS (SELECT series_id, CAST(ts AS DATE) AS day, sum(temp_c) AS t, count(*) AS n FROM weather WHERE hour(ts) BETWEEN 10 AND 17 AND temp_c IS NOT NULL GROUP BY 1, 2),
    wn AS (SELECT *, sum(t) OVER w AS bt, sum(n) OVER w AS bn FROM wd WINDOW w AS (PARTITION BY series_id ORDER BY day RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING)),
    pf AS (SELECT d.series_id, d.day, d.n_actual, c.is_off, c.run_before AS run, CASE WHEN bn >= 8 THEN t / n - bt / bn END AS anomaly FROM (SELECT series_id, day, count(act) AS n_actual FROM gr GROUP BY 1, 2) d JOIN calendar c ON c.day = d.day LEFT JOIN wn ON wn.series_id = d.series_id AND wn.day = d.day),
    an0 AS (SELECT t.series_id, t.day AS target, d.day, row_number() OVER (PARTITION BY t.series_id, t.day ORDER BY d.day DESC) AS rank FROM pf t JOIN pf d ON d.series_id = t.series_id AND d.is_off = t.is_off AND d.day < t.day AND d.n_actual >= 12 AND abs(d.run - t.run) <= 2 AND coalesce(abs(d.anomaly - t.anomaly) <= 4, true) AND least(abs(month(d.day) - month(t.day)), 12 - abs(month(d.day) - month(t.day))) <= 1),
    an AS (SELECT * FROM an0 WHERE rank <= 5)"""


def _analogs(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    cal = tb.calendar(_days(tb.demand(spark, sf_dir)), tb.DEMAND_HOLIDAYS)
    days = tb.written(guards.day_profile(rows, tb.weather(spark, sf_dir), cal), "day-profiles")
    return guards.analogous_days(days, days)


@_register(_GUARD_SQL + f", {_ANALOGS} SELECT series_id, CAST(target AS VARCHAR) AS target, CAST(day AS VARCHAR) AS day, rank FROM an")
def j20_analogous_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_analogs(_guarded(spark, sf_dir), spark, sf_dir))


def _chain_sql() -> str:
    sql = _GUARD_SQL.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_ANALOGS}, sh AS (SELECT an.series_id, target, hour, avg(act - f) AS r FROM an JOIN gr ON gr.series_id = an.series_id AND gr.day = an.day GROUP BY 1, 2, 3), ns AS (SELECT series_id, target, count(*) AS n FROM an GROUP BY 1, 2),
    c0 AS (SELECT g.* REPLACE (g.f + CASE WHEN r IS NOT NULL THEN greatest(-2500, least(2500, r * CASE WHEN n = 1 THEN 0.5 ELSE 0.7 END)) ELSE 0 END AS f, g.f AS raw), coalesce(n, 0) AS n_analogs FROM gr g LEFT JOIN sh ON sh.series_id = g.series_id AND sh.target = g.day AND sh.hour = g.hour LEFT JOIN ns ON ns.series_id = g.series_id AND ns.target = g.day),
    c1 AS (SELECT *, f AS analog_mw FROM c0)"""
    at = 1
    daytime = [_SHIFTS[f"{n}"] for n in ("g06_limit_analog_fall", "g07_lift_morning_shape", "g08_g09_lift_return_shortfall", "g10_cap_return_excess", "g11_cap_afternoon_analog", "g11b_cap_declining_analog", "g12_limit_afternoon_fall")]
    for shift in (_SHIFTS["g02_block_post_holiday_rise"], _DAYTIME, *daytime, "guarded", _SHIFTS["g13_pull_midday"]):
        if shift == "guarded":
            sql, at = sql + f", c{at + 1} AS (SELECT *, f AS guarded_mw FROM c{at})", at + 1
            continue
        sql += f", h{at} AS (SELECT g.* REPLACE (lag(g.f) OVER (PARTITION BY g.series_id, g.day ORDER BY g.ts) AS before, s.f AS then_f) FROM c{at} g LEFT JOIN c{at} s ON s.series_id = g.series_id AND s.day = g.day AND s.hour = g.seen), c{at + 1} AS (SELECT * REPLACE (f + coalesce(CAST({shift} AS DOUBLE), 0) AS f) FROM h{at})"
        at += 1
    return sql + ", " + _SPIKES.replace("FROMS", f"c{at}") + f" SELECT p0.series_id, CAST(p0.ts AS VARCHAR) AS ts, n_analogs, {_r('raw AS raw_mw', 'analog_mw', 'guarded_mw', 'p0.f AS midday_mw', 'p0.f - p1.cut AS shaped_mw')} FROM p0 JOIN p1 USING (series_id, day, hour)"


@_register(_chain_sql())
def g01_g14_guard_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of analogous days, then all guards in their order; the forecast after each stage."""
    rows = _week_before(_guarded(spark, sf_dir), spark, sf_dir).withColumn("raw_mw", F.col("forecast_mw"))
    rows = tb.written(guards.analog_shift(rows, _analogs(rows, spark, sf_dir)), "analog-rows")
    return _out(guards.guard_chain(rows), "series_id", "ts", "n_analogs", "raw_mw", "analog_mw", "guarded_mw", "midday_mw", "shaped_mw")


# Intraday rules ----------------------------------------------------------------------------------------------------------

#: Every day is looked at as of these hours, from which on its actuals are hidden: a day for each.
_ORIGIN_HOURS = (1, 5, 9, 12, 15, 17, 19)
_IC_SQL = _GUARD_SQL + f""", ih AS (SELECT g.* REPLACE (g.series_id || '@' || o AS series_id), CASE WHEN g.hour < o THEN h.actual_mw END AS a, wf.cooling_degree AS cool, wf.heating_degree AS heat FROM gr g JOIN hourly h ON h.series_id = g.series_id AND h.ts = g.ts LEFT JOIN wf ON wf.series_id = g.series_id AND wf.ts = g.ts, (SELECT unnest({list(_ORIGIN_HOURS)}) AS o) og),
    il AS (SELECT series_id, day, list(hour ORDER BY hour) AS hs, list(a ORDER BY hour) AS xs, list(a - f ORDER BY hour) AS rs FROM ih WHERE a IS NOT NULL GROUP BY 1, 2),
    im AS (SELECT series_id, day, len(hs) AS n, hs[-1] AS lh, list_avg(rs[-3:]) AS mr, coalesce(len(hs) >= 3 AND hs[-1] - hs[-2] = 1 AND hs[-2] - hs[-3] = 1, false) AS ok, xs, rs FROM il),
    io AS (SELECT i.*, coalesce(m.n, 0) AS n, m.lh, i.hour - coalesce(m.lh, -1) AS lead, m.mr, CASE WHEN ok THEN xs[-3] END AS a1, CASE WHEN ok THEN xs[-2] END AS a2, CASE WHEN ok THEN xs[-1] END AS a3, CASE WHEN ok THEN rs[-3] END AS r1, CASE WHEN ok THEN rs[-2] END AS r2, CASE WHEN ok THEN rs[-1] END AS r3,
      t.off AS off_then, t.mm AS mm_then, t.um AS um_then, t.lag_24h AS lag_then FROM ih i LEFT JOIN im m ON m.series_id = i.series_id AND m.day = i.day LEFT JOIN ih t ON t.series_id = i.series_id AND t.day = i.day AND t.hour = m.lh)"""


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _guarded(spark, sf_dir).withColumn("origin", F.explode(F.array(*[F.lit(h) for h in _ORIGIN_HOURS])))
    hidden = {"series_id": F.concat_ws("@", "series_id", "origin"), "actual_mw": F.when(F.hour("ts") < F.col("origin"), F.col("actual_mw"))}
    return intraday_rules.observed(rows.withColumns(hidden).drop("origin"))


def _ic(name: str, value: str, rule) -> None:
    """Register a rule's value for every hour; ``value`` is its SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _out(_observed(spark, sf_dir).withColumn("shift_mw", F.coalesce(rule(intraday_rules).cast("double"), F.lit(0.0))), "series_id", "ts", "forecast_mw", "n_observed", "lead", "shift_mw")

    query.__name__ = name
    _register(_IC_SQL + f", iv AS (SELECT *, coalesce(CAST({value} AS DOUBLE), 0) AS shift_mw FROM io) SELECT series_id, {_TS}, {_r('f AS forecast_mw')}, CAST(n AS BIGINT) AS n_observed, CAST(lead AS BIGINT) AS lead, {_r('shift_mw')} FROM iv")(query)


_FADE = "greatest(0, 1 - n / 3)"
_HOT = f"lead > 0 AND mm > 0 AND off = 1 AND lag_24h - um > {1500 * _G}"
_BIAS = f"(f - (um + {900 * _G} + least({900 * _G}, (greatest(0, coalesce(t7, 0)) * 120 + greatest(0, coalesce(cool, 0)) * 160) * {_G})))"
_MEAN = "((a3 - a1) / 2)"
_FLOOR = f"least(a3 - {500 * _G} + least(greatest({_MEAN}, 0) * 0.25, {300 * _G}) - f, {900 * _G})"
_ic("ic07_day_level_scale", f"CASE WHEN lag_24h - um > {600 * _G} AND -td > 1.5 AND coalesce(heat, 0) <= 7 AND {_FADE} > 0 THEN greatest({-700 * _G}, least({700 * _G}, -(lag_24h - um - {600 * _G}) * 0.25 * least(1, -td / 5) * {_FADE})) END", lambda x: x.day_level_scale(scale=_G))
_ic("ic08_transition_bias", f"CASE WHEN lh >= 6 AND mr <= {-300 * _G} AND {_HOT} AND {_BIAS} > 0 THEN -least({1200 * _G}, {_BIAS} * 0.55) END", lambda x: x.transition_bias(scale=_G))
_ic("ic09_transition_prior", f"CASE WHEN coalesce(lh < 6, true) AND {_HOT} AND f > um + {900 * _G} THEN -least({500 * _G}, (f - um - {900 * _G}) * 0.25) END", lambda x: x.transition_prior(scale=_G))
_ic("ic10_positive_multiplier", f"CASE WHEN coalesce(lh < 6 AND hour BETWEEN 6 AND 11 AND {_HOT} AND f > um + {900 * _G}, false) THEN 0.0 ELSE 1.0 END", lambda x: x.positive_multiplier(scale=_G))
_ic("ic11_capped_stack", f"CASE WHEN n <= 1 AND lead > 0 AND lag_24h < f - {900 * _G} THEN f - {900 * _G} ELSE lag_24h END - f", lambda x: x.capped_stack(F.col("forecast_mw"), F.col("lag_24h"), scale=_G) - F.col("forecast_mw"))
_ic(
    "ic13_recovery_factor",
    f"CASE WHEN coalesce(mr < 0 AND {_MEAN} > 0 AND greatest(a2 - a1, a3 - a2) >= {1000 * _G} AND off_then = 1 AND mm_then > 0 AND lag_then > um_then AND a3 >= um_then - {1200 * _G} AND r3 < 0 AND r1 < r2 AND r2 < r3, false) THEN CASE WHEN {_MEAN} >= {500 * _G} AND a3 >= um_then THEN 0.2 ELSE 0.4 END ELSE 1.0 END",
    lambda x: x.recovery_factor(scale=_G),
)
_ic(
    "ic14_slope_factor",
    f"CASE WHEN coalesce(mr * 0.6 > {300 * _G} AND lh >= 12 AND (a3 - a2 <= {-300 * _G} OR (a2 - a1 - (a3 - a2) >= {500 * _G} AND a3 - a2 <= {400 * _G})) AND least(r1, r2, r3) >= {300 * _G} AND r2 - r3 >= {300 * _G} AND (um_then IS NULL OR a3 >= um_then - {1200 * _G}), false) THEN 0.4 ELSE 1.0 END",
    lambda x: x.slope_factor(F.col("mean_residual") * 0.6, scale=_G),
)
_ic("ic20_continuity_restore", f"CASE WHEN lh >= 10 AND hour BETWEEN 10 AND 17 AND lead BETWEEN 1 AND 2 AND off = 1 AND a3 - a2 >= {-300 * _G} AND {_MEAN} >= {-300 * _G} AND {_FLOOR} >= {100 * _G} THEN {_FLOOR} END", lambda x: x.continuity_restore(F.col("forecast_mw"), scale=_G))


# Replays and gates -------------------------------------------------------------------------------------------------------

_ORIGINS = f"og AS (SELECT series_id, {_DAY} AS target, min(captured_at) AS captured_at FROM vintages WHERE CAST(captured_at AS DATE) = {_DAY} GROUP BY 1, 2)"


@_register(tb.with_ctes("vintages", more=_ORIGINS) + f"SELECT p.series_id, CAST(o.target AS VARCHAR) AS target, CAST(o.captured_at AS VARCHAR) AS captured_at, count(*) AS n, {_r('avg(abs(model_mw - actual_mw)) AS model_mw_mae', 'avg(abs(reference_mw - actual_mw)) AS reference_mw_mae')} FROM pairs p JOIN og o ON o.series_id = p.series_id AND o.target = CAST(p.ts AS DATE) WHERE p.ts > o.captured_at GROUP BY p.series_id, o.target, o.captured_at")
def ev12_origin_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(replay.origin_replay(tb.pairs(spark, sf_dir), history.first_origins(tb.vintages(spark, sf_dir)), ["model_mw", "reference_mw"]))


@_register(_HOURLY_FC[:-1] + f", pairs AS ({tb.CTES['pairs']}), bt AS (SELECT p.series_id, p.ts, p.actual_mw, p.model_mw, f.forecast_mw FROM pairs p JOIN fc f ON f.series_id = p.series_id AND f.ts = p.ts), bm AS (SELECT series_id, count(DISTINCT {_DAY}) AS days, count(*) AS n, avg(abs(forecast_mw - actual_mw)) AS baseline_mae, avg(abs(model_mw - actual_mw)) AS model_mae FROM bt GROUP BY 1) SELECT series_id, days, n, {_r('baseline_mae', 'model_mae', '(baseline_mae - model_mae) / nullif(baseline_mae, 0) * 100 AS improvement_pct')} FROM bm")
def ev05_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(replay.backtest(tb.pairs(spark, sf_dir), _forecast(spark, sf_dir)[1], "model_mw"))


_OLD = _BUNDLE.split("er AS", 1)[1].join(["er2 AS", ""]).replace("model_mw", "reference_mw").replace("FROM er GROUP", "FROM er2 GROUP").replace("mb AS", "mb2 AS")
_IMPROVED = {c: f"(b.{c} - a.{c}) / nullif(b.{c}, 0) * 100" for c in ("mae", "rmse", "max_error", "shape_mae")}
_GATE = f"""{_BUNDLE}, {_OLD}, cc AS (SELECT a.series_id, {', '.join(f"max({x}) FILTER (a.regime IS NULL AND a.band IS NULL) AS {c}" for c, x in _IMPROVED.items())}, max(-({_IMPROVED['mae']})) FILTER (NOT (a.regime IS NULL AND a.band IS NULL) AND a.n >= 24) AS worst
    FROM mb a JOIN mb2 b ON a.series_id = b.series_id AND a.regime IS NOT DISTINCT FROM b.regime AND a.band IS NOT DISTINCT FROM b.band GROUP BY 1)"""
_MODE = "CASE " + " ".join(f"WHEN coalesce(worst, 0) <= {m['worst']} AND " + " AND ".join(f"{k} >= {v}" for k, v in m.items() if k != "worst") + f" THEN '{name}'" for name, m in replay.MODES.items()) + " ELSE 'rejected' END"


@_register(tb.with_ctes("pairs", more=_GATE) + f"SELECT series_id, {_r('mae', 'rmse', 'max_error', 'shape_mae', 'worst')}, {_MODE} AS mode FROM cc")
def ev09_ev13_replay_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(replay.replay_gate(replay.contract_comparison(_bundle(spark, sf_dir), _bundle(spark, sf_dir, "reference_mw"))))


@_register(tb.with_ctes("pairs") + f"SELECT series_id, count(*) AS hours, count(DISTINCT {_DAY}) AS days, avg(abs(model_mw - actual_mw)) <= avg(abs(reference_mw - actual_mw)) AS not_worse, CASE WHEN count(*) < 480 OR count(DISTINCT {_DAY}) < 2 THEN 'collecting' WHEN avg(abs(model_mw - actual_mw)) <= avg(abs(reference_mw - actual_mw)) THEN 'ready' ELSE 'worse' END AS status FROM pairs GROUP BY series_id")
def ev17_shadow_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(replay.shadow_evidence(tb.pairs(spark, sf_dir), "model_mw", "reference_mw", hours=480))


# Weather and more diagnostics --------------------------------------------------------------------------------------------

_FACTS2 = "f2 AS (SELECT series_id, ts, CASE WHEN hour(ts) % 5 <> 0 THEN 1.0::DOUBLE END AS actual_mw, CASE WHEN hour(ts) % 3 <> 0 THEN temp_c END AS temp_c, CASE WHEN hour(ts) % 4 <> 0 THEN humidity_pct END AS humidity_pct, CASE WHEN hour(ts) % 3 <> 0 THEN 'forecast' END AS weather_source FROM weather), w2 AS (SELECT series_id, ts, temp_c + 1 AS nt, humidity_pct + 1 AS nh, CASE WHEN hour(ts) % 2 = 0 THEN 'station_observed' ELSE 'archive' END AS ns FROM weather WHERE hour(ts) < 20)"
_TAKE = lambda c, n: f"CASE WHEN actual_mw IS NOT NULL AND ({c} IS NULL OR coalesce(contains(ns, 'observed'), false)) THEN {n} ELSE {c} END AS {c}"


@_register(tb.with_ctes("weather", more=_FACTS2) + f"SELECT series_id, {_TS}, {_r(_TAKE('temp_c', 'nt'), _TAKE('humidity_pct', 'nh'))}, {_TAKE('weather_source', 'ns')} FROM f2 LEFT JOIN w2 USING (series_id, ts)")
def j07_w_enrich_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, hour = tb.weather(spark, sf_dir), F.hour("ts")
    facts = w.select("series_id", "ts", F.when(hour % 5 != 0, 1.0).alias("actual_mw"), F.when(hour % 3 != 0, F.col("temp_c")).alias("temp_c"), F.when(hour % 4 != 0, F.col("humidity_pct")).alias("humidity_pct"), F.when(hour % 3 != 0, "forecast").alias("weather_source"))
    new = w.where(hour < 20).select("series_id", "ts", (F.col("temp_c") + 1).alias("temp_c"), (F.col("humidity_pct") + 1).alias("humidity_pct"), F.when(hour % 2 == 0, "station_observed").otherwise("archive").alias("weather_source"))
    return _out(weather_prep.enrich_weather(facts, new), "series_id", "ts", "temp_c", "humidity_pct", "weather_source")


_LADDER = f"""fh AS (SELECT series_id, ts, CASE WHEN hour(ts) % 6 = 0 THEN humidity_pct END AS h FROM weather), ob AS (SELECT series_id, max(ts) AS st, arg_max(humidity_pct, ts) AS seen FROM weather WHERE ts <= TIMESTAMP '{_NOW}' GROUP BY 1), fb AS (SELECT series_id, ts, humidity_pct - 2 AS other FROM weather WHERE hour(ts) % 2 = 0),
    la AS (SELECT fh.*, CASE WHEN ts > st AND ts <= st + INTERVAL 3 HOURS THEN seen END AS held, other, CAST(MAP {{{', '.join(f'{m}: {v}' for m, v in C.SEASONAL_HUMIDITY.items())}}}[month(ts)] AS DOUBLE) AS sea FROM fh LEFT JOIN ob USING (series_id) LEFT JOIN fb USING (series_id, ts))"""


@_register(tb.with_ctes("weather", more=_LADDER) + f"SELECT series_id, {_TS}, {_r('coalesce(h, held, other, sea) AS humidity_pct')}, CASE WHEN h IS NOT NULL THEN 'own' WHEN held IS NOT NULL THEN 'forward_fill' WHEN other IS NOT NULL THEN 'fallback' ELSE 'seasonal' END AS humidity_source FROM la")
def w_humidity_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, hour = tb.weather(spark, sf_dir), F.hour("ts")
    forecast = w.select("series_id", "ts", "temp_c", F.when(hour % 6 == 0, F.col("humidity_pct")).alias("humidity_pct"))
    seen = w.where(F.col("ts") <= F.lit(_NOW).cast("timestamp_ntz"))
    other = w.where(hour % 2 == 0).select("series_id", "ts", (F.col("humidity_pct") - 2).alias("humidity_pct"))
    return _out(weather_prep.humidity_ladder(forecast, seen, other), "series_id", "ts", "humidity_pct", "humidity_source")


_MEDIAN = f"""wt AS (SELECT series_id, ts, temp_c + hour(ts) % 3 AS seen_c, temp_c FROM weather), mb3 AS (SELECT series_id, greatest(-2.5, least(2.5, median(seen_c - temp_c))) AS bias FROM wt WHERE ts <= TIMESTAMP '{_NOW}' AND ts >= TIMESTAMP '{_NOW}' - INTERVAL 40 HOURS GROUP BY 1 HAVING abs(greatest(-2.5, least(2.5, median(seen_c - temp_c)))) >= 0.5),
    wa AS (SELECT wt.*, bias, ts > TIMESTAMP '{_NOW}' AND {_DAY} = DATE '{_NOW[:10]}' AS ahead FROM wt LEFT JOIN mb3 USING (series_id)), ws AS (SELECT *, row_number() OVER (PARTITION BY series_id, ahead ORDER BY ts) - 1 AS step FROM wa)"""


@_register(tb.with_ctes("weather", more=_MEDIAN) + f"SELECT series_id, {_TS}, {_r('CASE WHEN ahead AND step < 3 THEN temp_c + coalesce(bias, 0) * pow(0.6, step) ELSE temp_c END AS temp_c')} FROM ws")
def w_bias2_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, now = tb.weather(spark, sf_dir), F.lit(_NOW).cast("timestamp_ntz")
    rows = w.select("series_id", "ts", F.when(F.col("ts") <= now, 1.0).alias("actual_mw"), "temp_c")
    return _out(weather_prep.median_bias(rows, w.withColumn("temp_c", F.col("temp_c") + F.hour("ts") % 3), now, lookback=40, least=0.5), "series_id", "ts", "temp_c")


@_register(_HOURLY_FC[:-1] + f", bq AS (SELECT h.*, fc.* EXCLUDE (series_id, ts) FROM hourly h JOIN fc USING (series_id, ts)) SELECT series_id, CAST({_DAY} AS VARCHAR) AS day, count(*) AS hours, count(*) FILTER (actual_mw BETWEEN p95_lower_mw AND p95_upper_mw) AS inside95, count(*) FILTER (actual_mw BETWEEN p99_lower_mw AND p99_upper_mw) AS inside99, coalesce(string_agg(hour(ts)::VARCHAR, ',' ORDER BY hour(ts)) FILTER (NOT actual_mw BETWEEN p95_lower_mw AND p95_upper_mw), '') AS outside95_hours, {_r('median((p95_upper_mw - p95_lower_mw) / 2) AS width95', 'median((p99_upper_mw - p99_lower_mw) / 2) AS width99')}, count(*) FILTER (abs(forecast_mw - actual_mw) >= 10 AND actual_mw BETWEEN p95_lower_mw AND p95_upper_mw) AS covered_misses FROM bq GROUP BY series_id, {_DAY}")
def rp16_band_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    h, f = _forecast(spark, sf_dir)
    return _out(diagnostics.band_quality(h.join(f, ["series_id", "ts"]), "forecast_mw", 10.0))


@_register(tb.with_ctes("pairs", more=f"fg AS (SELECT series_id, {_DAY} AS day, hour(ts) AS hour, model_mw - reference_mw AS gap, row_number() OVER (PARTITION BY series_id, {_DAY} ORDER BY round(abs(model_mw - reference_mw), 6) DESC, ts) AS rank FROM pairs WHERE abs(model_mw - reference_mw) >= 5)") + f"SELECT series_id, CAST(day AS VARCHAR) AS day, hour, {_r('gap')}, rank FROM fg WHERE rank <= 3")
def rp12_freeze_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.freeze_gaps(tb.pairs(spark, sf_dir), "model_mw", "reference_mw", 5.0))


@_register(f"WITH {tb.calendar_ctes('SELECT CAST(o_orderdate AS DATE) AS day FROM orders')} SELECT CAST(day AS VARCHAR) AS day, run_before >= 3 AND days_since_off <= 1 AS post_holiday_early_morning FROM calendar")
def an07_day_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(diagnostics.day_context(tb.calendar(tb.daily(spark, sf_dir))))


_LEDGER = f"""{tb.calendar_ctes('SELECT CAST(ts AS DATE) AS day FROM pairs')}, rl AS (SELECT series_id, CAST(ts AS DATE) AS day, avg(actual_mw - model_mw) AS residual FROM pairs GROUP BY 1, 2 HAVING count(DISTINCT hour(ts)) = 24),
    rg AS (SELECT rl.*, CASE WHEN c.is_off THEN 'non_business' ELSE 'business' END AS regime FROM rl JOIN calendar c ON c.day = rl.day), rr2 AS (SELECT *, row_number() OVER (PARTITION BY series_id, regime ORDER BY day DESC) AS rank FROM rg)"""


@_register(tb.with_ctes("pairs", more=_LEDGER) + f"SELECT series_id, regime, CAST(day AS VARCHAR) AS day, {_r('residual')}, rank FROM rr2 WHERE rank <= 5")
def st12_regime_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = tb.pairs(spark, sf_dir)
    return _out(diagnostics.regime_ledger(p, "model_mw", tb.calendar(_days(p)), 5))


_BASE = f"greatest({-1200 * _G}, least({1200 * _G}, mr * 0.6))"
_FADED = f"({_BASE} * pow(0.92, lead - 1))"


def _damped(off: str, seen: str, hours: str, leads: str, base: float, weak: float, factor: float, least: float, more: str = "true") -> str:
    return f"CASE WHEN mr IS NOT NULL AND {more} AND {off} AND {_BASE} >= {base * _G} AND lh BETWEEN {seen} AND hour BETWEEN {hours} AND lead BETWEEN {leads} AND sup <= {weak * _G} AND {_FADED} * (1 - {factor}) >= {least * _G} THEN -({_FADED} * (1 - {factor})) END"


_ic("ic15_morning_damping", _damped("off <> 1", "7 AND 10", "10 AND 13", "2 AND 4", 300, 1800, 0.4, 100, f"greatest(a2 - a1, a3 - a2) >= {1000 * _G}"), lambda x: x.morning_damping(x.base_adjustment(scale=_G), scale=_G))
_ic("ic16_afternoon_damping", _damped("off <> 1", "11 AND 20", "13 AND 23", "1 AND 6", 250, 900, 0.4, 100), lambda x: x.afternoon_damping(x.base_adjustment(scale=_G), scale=_G))
_ic("ic17_evening_damping", _damped("off = 1", "12 AND 23", "17 AND 20", "2 AND 6", 350, 600, 0.45, 120), lambda x: x.evening_damping(x.base_adjustment(scale=_G), scale=_G))
_ic(
    "ic18_evening_negative_damping",
    f"CASE WHEN mr IS NOT NULL AND off = 1 AND {_BASE} <= {-500 * _G} AND lh >= 16 AND hour BETWEEN 18 AND 20 AND lead BETWEEN 1 AND 3 AND a3 - a2 >= {600 * _G} AND {_MEAN} >= {300 * _G} AND sup >= 0 AND -{_FADED} * 0.55 >= {120 * _G} THEN -{_FADED} * 0.55 END",
    lambda x: x.evening_negative_damping(x.base_adjustment(scale=_G), scale=_G),
)
