"""Registered queries of features as of a time and of refits at many cut-offs, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import tables as tb
from .functions import constants as C
from .operators import features, quality, weather_prep
from .plans import experts, priorities, refit
from .corrector_queries import DEMAND_SQL, demand_rows
from .queries import _CALENDAR_SQL, _DAYS, _days, _out, _r, _register

_TS = "CAST(ts AS VARCHAR) AS ts"

# Every hour of demand as of its midnight, and three days ahead as of the end of the table.
_TARGETS = f"""{tb.calendar_ctes('SELECT CAST(ts + INTERVAL 3 DAYS AS DATE) AS day FROM hourly', tb.DEMAND_HOLIDAYS).replace('calendar AS', 'calendar3 AS').replace('cal0', 'cb0').replace('cal1', 'cb1').replace('cal2', 'cb2')},
    dl AS (SELECT h.*, h.actual_mw - l.actual_mw AS delta FROM hourly h LEFT JOIN hourly l ON l.series_id = h.series_id AND l.ts = h.ts - INTERVAL 1 HOURS),
    fx AS (SELECT dl.*, hour(ts) AS hour, isodow(ts) AS dow, c.is_off FROM dl JOIN calendar3 c ON c.day = CAST(ts AS DATE)),
    tg0 AS (SELECT series_id, ts, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS as_of FROM hourly UNION ALL SELECT series_id, e + to_hours(CAST(h AS INT)), e FROM (SELECT series_id, CAST(max(CAST(ts AS DATE)) + 1 AS TIMESTAMP) AS e FROM hourly GROUP BY 1), range(72) r(h)),
    tg AS (SELECT tg0.*, hour(ts) AS hour, isodow(ts) AS dow, c.is_off FROM tg0 JOIN calendar3 c ON c.day = CAST(ts AS DATE)),
    wk AS (SELECT t.series_id, t.ts, f.actual_mw, row_number() OVER (PARTITION BY t.series_id, t.ts ORDER BY f.ts DESC) AS i FROM tg t JOIN fx f ON f.series_id = t.series_id AND f.hour = t.hour AND f.dow = t.dow AND f.ts < t.as_of),
    kd AS (SELECT t.series_id, t.ts, f.actual_mw, f.delta, row_number() OVER (PARTITION BY t.series_id, t.ts ORDER BY f.ts DESC) AS i FROM tg t JOIN fx f ON f.series_id = t.series_id AND f.hour = t.hour AND f.is_off = t.is_off AND f.ts < t.as_of),
    wa AS (SELECT series_id, ts, avg(actual_mw) AS roll_4w_mean, coalesce(stddev_samp(actual_mw), 0) AS roll_4w_std FROM wk WHERE i <= 4 GROUP BY 1, 2), ka AS (SELECT series_id, ts, avg(actual_mw) AS um, avg(delta) AS ud FROM kd WHERE i <= 8 GROUP BY 1, 2)"""


def slot_targets(h: DataFrame, ahead: int = 3) -> DataFrame:
    """(series_id, ts, as_of): the hours of ``h`` as of their midnights, and of days after them as of the last one's end."""
    past = h.select("series_id", "ts", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("as_of"))
    end = h.groupBy("series_id").agg(F.date_add(F.max(F.to_date("ts")), 1).cast("timestamp_ntz").alias("as_of"))
    hours = end.select("series_id", "as_of", F.explode(F.sequence(F.lit(0), F.lit(24 * ahead - 1))).alias("h"))
    return past.unionByName(hours.select("series_id", (F.col("as_of") + F.make_dt_interval(hours=F.col("h"))).alias("ts"), "as_of"))


@_register("WITH " + tb.DEMAND_CTES + ", " + _TARGETS + f" SELECT t.series_id, CAST(t.ts AS VARCHAR) AS ts, CAST(t.as_of AS VARCHAR) AS as_of, {_r('roll_4w_mean', 'coalesce(roll_4w_std, 0) AS roll_4w_std', 'um AS recent_same_business_type_mean', 'ud AS recent_same_business_type_delta_mean')} FROM tg t LEFT JOIN wa ON wa.series_id = t.series_id AND wa.ts = t.ts LEFT JOIN ka ON ka.series_id = t.series_id AND ka.ts = t.ts")
def win06_inference_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.written(tb.demand(spark, sf_dir), "demand")
    targets = slot_targets(h)
    return _out(features.inference_slots(h, targets, tb.calendar(_days(targets), tb.DEMAND_HOLIDAYS)), "series_id", "ts", "as_of", "roll_4w_mean", "roll_4w_std", "recent_same_business_type_mean", "recent_same_business_type_delta_mean")


#: Features of the fit, what they are moved and scaled by, and how many last days are cut-offs.
_FIT, _CENTRE, _UNIT, _CUTS = ("lag_24h", "roll_4w_mean"), 30000.0, 1000.0, 14
_Z = f"(lag_24h - {_CENTRE}) / {_UNIT} AS z1, (roll_4w_mean - {_CENTRE}) / {_UNIT} AS z2, (actual_mw - {_CENTRE}) / {_UNIT} AS y"
_SUMS = {"n": "count(*)", "s1": "sum(z1)", "s2": "sum(z2)", "s11": "sum(z1 * z1)", "s12": "sum(z1 * z2)", "s22": "sum(z2 * z2)", "m0": "sum(y)", "m1": "sum(z1 * y)", "m2": "sum(z2 * y)"}


def _det(a: str) -> str:
    """Determinant of a 3 x 3 matrix, given as nine names."""
    x = a.split()
    return f"({x[0]} * ({x[4]} * {x[8]} - {x[5]} * {x[7]}) - {x[1]} * ({x[3]} * {x[8]} - {x[5]} * {x[6]}) + {x[2]} * ({x[3]} * {x[7]} - {x[4]} * {x[6]}))"


def _refit_sql(train_days: int | None) -> str:
    """The normal equations of each cut-off over its own rows, solved by Cramer's rule."""
    window = f" AND f.day >= k.cutoff - {train_days}" if train_days else ""
    whole = _det("n s1 s2 s1 s11 s12 s2 s12 s22")
    parts = [_det(a) for a in ("m0 s1 s2 m1 s11 s12 m2 s12 s22", "n m0 s2 s1 m1 s12 s2 m2 s22", "n s1 m0 s1 s11 m1 s2 s12 m2")]
    return (
        "WITH " + tb.DEMAND_CTES + ", " + _CALENDAR_SQL.replace(tb.calendar_ctes(_DAYS) + ",", "")
        + f""", fr AS (SELECT series_id, ts, day, actual_mw, lag_24h, roll_4w_mean, {_Z} FROM cm WHERE lag_24h IS NOT NULL AND roll_4w_mean IS NOT NULL),
    ks AS (SELECT series_id, day AS cutoff FROM (SELECT DISTINCT series_id, day, max(day) OVER (PARTITION BY series_id) AS hi FROM fr) WHERE day > hi - {_CUTS}),
    mo AS (SELECT k.series_id, k.cutoff, {', '.join(f'{v} AS {k}' for k, v in _SUMS.items())} FROM ks k JOIN fr f ON f.series_id = k.series_id AND f.day < k.cutoff{window} GROUP BY 1, 2),
    be AS (SELECT *, {', '.join(f'{p} / {whole} AS b{i}' for i, p in enumerate(parts))} FROM mo WHERE n >= 3),
    te AS (SELECT f.*, b.cutoff, b.n AS n_train, (b0 + b1 * z1 + b2 * z2) * {_UNIT} + {_CENTRE} AS forecast_mw FROM be b JOIN fr f ON f.series_id = b.series_id AND f.day = b.cutoff),
    rp AS (SELECT series_id, cutoff, count(*) AS hours, max(n_train) AS n_train, avg(abs(forecast_mw - actual_mw)) AS mae, sqrt(avg((forecast_mw - actual_mw) ** 2)) AS rmse, sum(abs(forecast_mw - actual_mw)) / sum(abs(actual_mw)) * 100 AS wape, avg(abs(roll_4w_mean - actual_mw)) AS reference_mae FROM te GROUP BY 1, 2)
    SELECT series_id, CAST(cutoff AS VARCHAR) AS cutoff, hours, n_train, {_r('mae', 'rmse', 'wape', 'reference_mae', '(reference_mae - mae) / nullif(reference_mae, 0) * 100 AS improvement_pct')}, CASE WHEN mae < reference_mae THEN 'model' WHEN mae > reference_mae THEN 'reference' ELSE 'tie' END AS better FROM rp"""
    )


def _refit(spark: SparkSession, sf_dir: str, train_days: int | None) -> DataFrame:
    h = tb.written(tb.demand(spark, sf_dir), "demand")
    cal = tb.calendar(_days(h), tb.DEMAND_HOLIDAYS)
    rows = features.slot_features(features.lag_features(h), cal).select("series_id", "ts", "day", "actual_mw", *_FIT)
    rows = tb.written(rows.where("lag_24h is not null and roll_4w_mean is not null"), "fit-rows")
    last = rows.groupBy("series_id").agg(F.max("day").alias("hi"))
    cutoffs = rows.select("series_id", "day").distinct().join(last, "series_id").where(F.col("day") > F.date_sub("hi", _CUTS)).select("series_id", F.col("day").alias("cutoff"))
    return _out(refit.holdout_report(refit.holdout(rows, _FIT, cutoffs, 1, train_days, _CENTRE, _UNIT), "roll_4w_mean"))


@_register(_refit_sql(None))
def ev06_m14_rolling_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits on all days before each of the last days, tested on that day against the mean of its slots."""
    return _refit(spark, sf_dir, None)


@_register(_refit_sql(10))
def m14_refits_in_a_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with fits on the ten days before each cut-off."""
    return _refit(spark, sf_dir, 10)


# Experts with fixed coefficients over the features of demand; every eleventh hour knows no lag, every seventh day has
# lags in part only.
_EXPERTS = {
    "full": {"direct": {"roll_4w_mean": 0.6, "recent_same_business_type_mean": 0.4, "humidity_delta_24h": 60.0}, "lag_residual": {"roll_4w_mean": 0.3, "lag_24h": -0.3}, "non_business": {"roll_4w_mean": 1.0}},
    "no_humidity": {"direct": {"roll_4w_mean": 0.5, "recent_same_business_type_mean": 0.5}, "lag_residual": {"roll_4w_mean": 0.4, "lag_24h": -0.4}, "non_business": {"recent_same_business_type_mean": 1.0}},
    "robust": {"direct": {"recent_same_business_type_mean": 1.0}, "lag_residual": {"recent_same_business_type_mean": 0.2, "lag_24h": -0.2}, "non_business": {"roll_4w_mean": 0.7, "recent_same_business_type_mean": 0.3}},
    "unavailable": {"direct": {"roll_4w_mean": 0.98}, "non_business": {"recent_same_business_type_mean": 0.97}},
}
_SHORT = {"roll_4w_mean": "raw", "recent_same_business_type_mean": "um", "lag_24h": "lag_24h", "humidity_delta_24h": "hd"}
_SAID = {f"{v}_{m}": " + ".join(f"{_SHORT[f]} * {w}::DOUBLE" for f, w in of.items()) for v, models in _EXPERTS.items() for m, of in models.items()}


def _view_sql(name: str) -> str:
    direct, lag = _SAID[f"{name}_direct"], _SAID[f"{name}_lag_residual"]
    both = f"((1 - share) * ({direct}) + share * (lag_24h + ({lag})))"
    return f"(CASE WHEN off = 0 THEN CASE WHEN NOT part AND {both} IS NOT NULL THEN {both} ELSE {direct} END ELSE 0.5 * ({direct}) + 0.5 * ({_SAID[f'{name}_non_business']}) END)"


_LEGACY = f"(CASE WHEN off = 0 AND lag_24h IS NOT NULL AND hd IS NOT NULL THEN 0.5 * ({_SAID['full_direct']}) + 0.5 * (lag_24h + ({_SAID['full_lag_residual']})) ELSE {_SAID['full_direct']} END)"
_GATED = f""", e0 AS (SELECT cm.series_id, cm.ts, cm.day, cm.off, cm.mm, cm.roll_4w_mean AS raw, cm.recent_same_business_type_mean AS um, humidity_delta_24h AS hd, cooling_delta_24h AS cd, CASE WHEN (day(cm.ts) * 5 + cm.hour) % 11 <> 0 THEN cm.lag_24h END AS lag_24h, lag_last_biz_hour AS lb, lag_last_nonhol_hour AS ln, day(cm.ts) % 7 = 0 AS part
      FROM cm LEFT JOIN wf ON wf.series_id = cm.series_id AND wf.ts = cm.ts WHERE cm.roll_4w_mean IS NOT NULL AND cm.lag_24h IS NOT NULL),
    e1 AS (SELECT *, CASE WHEN coalesce(mm > 0 AND off = 0 AND cd IS NOT NULL, false) THEN 0.5 * greatest(0, least(1, (cd + 4) / 4)) ELSE 0.5 END AS share, lag_24h IS NULL OR lb IS NULL OR ln IS NULL AS gone FROM e0),
    e2 AS (SELECT *, {_LEGACY} AS legacy, 0.5 * {_view_sql('no_humidity')} + 0.5 * {_view_sql('robust')} AS v FROM e1),
    e3 AS (SELECT *, CASE WHEN v - legacy IS NOT NULL THEN legacy + greatest(-500, least(500, v - legacy)) END AS held FROM e2),
    e4 AS (SELECT *, CASE WHEN gone THEN CASE WHEN off = 1 THEN {_SAID['unavailable_non_business']} ELSE {_SAID['unavailable_direct']} END WHEN off = 1 THEN 0.4 * legacy + 0.6 * held ELSE held END AS f FROM e3),
    e5 AS (SELECT *, CASE WHEN count(f) OVER d = 24 THEN greatest(-750, least(750, 0.2 * (avg(um) OVER d - avg(f) OVER d))) ELSE 0 END AS moved FROM e4 WINDOW d AS (PARTITION BY series_id, day))"""


@_register(DEMAND_SQL + _GATED + f" SELECT series_id, {_TS}, {_r('legacy AS legacy_mw', 'f + moved AS forecast_mw')}, concat_ws(',', CASE WHEN gone THEN 'lags_unavailable' END, CASE WHEN part AND NOT gone THEN 'partial_lags' END, CASE WHEN share < 0.5 AND NOT part AND NOT gone THEN 'attenuated' END, CASE WHEN off = 1 THEN 'specialist' END, CASE WHEN abs(v - legacy) > 500 AND NOT gone THEN 'trust_region' END, CASE WHEN moved <> 0 THEN 'daily_level' END) AS gates FROM e5")
def m06_m11_gated_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.written(demand_rows(spark, sf_dir), "expert-rows")
    rows = rows.withColumn("lag_24h", F.when((F.dayofmonth("ts") * 5 + F.col("hour")) % 11 != 0, F.col("lag_24h")))
    said = {v: {m: experts.linear(of) for m, of in models.items()} for v, models in _EXPERTS.items()}
    level = F.avg("recent_same_business_type_mean").over(W.partitionBy("series_id", F.to_date("ts")))
    got = experts.gated(rows.drop("forecast_mw"), said["full"], said["no_humidity"], said["robust"], said["unavailable"], F.dayofmonth("ts") % 7 == 0, level)
    return _out(got, "series_id", "ts", "legacy_mw", "forecast_mw", "gates")


@_register(tb.with_ctes("weather", more="of AS (SELECT series_id, ts, temp_c + 0.3 AS temp_c, CASE WHEN hour(ts) % 4 <> 0 THEN humidity_pct END AS humidity_pct FROM weather WHERE hour(ts) % 3 <> 0), fb AS (SELECT series_id, ts, temp_c, humidity_pct FROM weather WHERE hour(ts) % 5 <> 0)") + f" SELECT series_id, CAST(coalesce(o.ts, f.ts) AS VARCHAR) AS ts, {_r('round_even(coalesce(o.temp_c, f.temp_c) * 10, 0) / 10 AS temp_c', 'round_even(coalesce(o.humidity_pct, f.humidity_pct) * 10, 0) / 10 AS humidity_pct')}, CASE WHEN o.temp_c IS NOT NULL THEN 'official' WHEN f.temp_c IS NOT NULL THEN 'fallback' END AS temp_c_source, CASE WHEN o.humidity_pct IS NOT NULL THEN 'official' WHEN f.humidity_pct IS NOT NULL THEN 'fallback' END AS humidity_pct_source FROM of o FULL JOIN fb f USING (series_id, ts)")
def w_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, hour = tb.weather(spark, sf_dir), F.hour("ts")
    official = w.where(hour % 3 != 0).select("series_id", "ts", (F.col("temp_c") + 0.3).alias("temp_c"), F.when(hour % 4 != 0, F.col("humidity_pct")).alias("humidity_pct"))
    return _out(weather_prep.merge_sources(official, w.where(hour % 5 != 0), ("temp_c", "humidity_pct")))


_HEX = "('0x' || substr(md5(concat_ws('|', series_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), name, value)), 1, 15))::BIGINT"


@_register("WITH " + tb.DEMAND_CTES + f", cells AS (SELECT series_id, ts, 'actual_mw' AS name, CAST(CAST(actual_mw AS BIGINT) AS VARCHAR) AS value FROM hourly UNION ALL SELECT series_id, ts, 'is_peak', CASE WHEN hour(ts) BETWEEN 9 AND 18 THEN CAST(hour(ts) AS VARCHAR) END FROM hourly) SELECT series_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, name AS column_name, count(*) AS n, count(value) AS n_known, CAST(sum(CAST({_HEX.replace(', value)', ', coalesce(value, chr(1)))')} AS HUGEINT)) AS VARCHAR) AS digest FROM cells GROUP BY 1, 2, 3")
def rp20_snapshot_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.demand(spark, sf_dir).select("series_id", "ts", F.col("actual_mw").cast("long").alias("actual_mw"), F.when(F.hour("ts").between(9, 18), F.hour("ts")).alias("is_peak"))
    return _out(quality.snapshot_digests(h, ("actual_mw", "is_peak")))


# Priorities and evidence over demand: the mixed forecast against the week before; published is the mixed forecast,
# recalculated the mean of the slots.
_BAND_CASE = "CASE " + " ".join(f"WHEN hour BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in C.TIME_BANDS) + " END"
_BAND_PICK = lambda k: "CASE band " + " ".join(f"WHEN '{b[0]}' THEN {b[k]}" for b in C.TIME_BANDS) + " END"
_BAND_ORDER = "CASE band " + " ".join(f"WHEN '{b[0]}' THEN {i + 1}" for i, b in enumerate(C.TIME_BANDS)) + " END"
_EVENTS = f""", pr AS (SELECT series_id, ts, day, CAST(hour AS INT) AS hour, actual_mw AS a, (roll_4w_mean + lag_24h) / 2 AS m, lag_168h AS r, roll_4w_mean AS raw, lag_24h_hourly_delta AS ld, recent_same_business_type_delta_mean AS ud FROM cm WHERE roll_4w_mean IS NOT NULL AND lag_24h IS NOT NULL),
    ms AS (SELECT *, abs(m - a) AS miss, row_number() OVER (PARTITION BY series_id, day ORDER BY round(abs(m - a), 6) DESC, hour) AS i FROM pr),
    dt AS (SELECT *, hour - 1 AS from_hour, (m - lag(m) OVER w) - (a - lag(a) OVER w) AS de FROM pr WINDOW w AS (PARTITION BY series_id, day ORDER BY ts)),
    br AS (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY round(abs(de), 6) DESC, hour) AS i FROM dt WHERE abs(de) >= 1500),
    bg AS (SELECT series_id, day, {_BAND_CASE} AS band, avg(abs(m - a)) - avg(abs(r - a)) AS gap FROM pr WHERE r IS NOT NULL GROUP BY 1, 2, 3),
    fg AS (SELECT *, abs(m - raw) AS gap, row_number() OVER (PARTITION BY series_id, day ORDER BY round(abs(m - raw), 6) DESC, ts) AS i FROM pr WHERE abs(m - raw) >= 500),
    ev AS (SELECT series_id, day, '{priorities.KINDS[0]}' AS kind, 0 AS ko, i, 'top_miss_h' || hour AS event_id, miss AS score, hour AS fh, hour AS th FROM ms WHERE i <= 3 AND miss >= 1000
      UNION ALL SELECT series_id, day, '{priorities.KINDS[1]}', 1, i, 'shape_break_' || from_hour || '_' || hour, abs(de), from_hour, hour FROM br WHERE i <= {priorities.reports.BREAKS}
      UNION ALL SELECT series_id, day, '{priorities.KINDS[2]}', 2, {_BAND_ORDER}, 'band_gap_' || band, gap, {_BAND_PICK(1)}, {_BAND_PICK(2)} FROM bg WHERE gap >= 300
      UNION ALL SELECT series_id, day, '{priorities.KINDS[3]}', 3, i, 'freeze_gap_h' || hour, gap, hour, hour FROM fg WHERE i <= 3),
    ek AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY round(score, 6) DESC, ko, i) AS rank FROM ev) WHERE rank <= 6)"""
_KEPT = f"series_id, CAST(day AS VARCHAR) AS day, rank, kind, event_id, {_r('score AS score_mw')}, CASE WHEN score >= 1500 THEN 'warning' ELSE 'info' END AS severity, CAST(fh AS BIGINT) AS from_hour, CAST(th AS BIGINT) AS to_hour, rank <= 3 AS must_discuss"
_PRIORITY_SQL = "WITH " + tb.DEMAND_CTES + ", " + _CALENDAR_SQL.replace(tb.calendar_ctes(_DAYS) + ",", "") + _EVENTS


def _priority_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = tb.written(tb.demand(spark, sf_dir), "demand")
    rows = features.slot_features(features.lag_features(h), tb.calendar(_days(h), tb.DEMAND_HOLIDAYS)).where("roll_4w_mean is not null and lag_24h is not null")
    mixed = (F.col("roll_4w_mean") + F.col("lag_24h")) / 2
    return tb.written(rows.withColumns({"model_mw": mixed, "reference_mw": F.col("lag_168h"), "published_mw": mixed, "recalculated_mw": F.col("roll_4w_mean")}), "priority-rows")


@_register(_PRIORITY_SQL + f" SELECT {_KEPT} FROM ek")
def tk04_rp13_priority_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(priorities.priority_events(_priority_rows(spark, sf_dir)))


@_register(_PRIORITY_SQL + f""", lf AS (SELECT series_id, day, hour, 'error' AS source, a - m AS v FROM pr UNION ALL SELECT series_id, day, hour, 'error', a - r FROM pr UNION ALL SELECT series_id, day, hour, 'shape', ld FROM pr UNION ALL SELECT series_id, day, hour, 'shape', ud FROM pr UNION ALL SELECT series_id, day, hour, 'serving', raw FROM pr),
    ee AS (SELECT e.series_id, e.day, e.event_id, count(*) AS n, sum(v) AS total, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM ek e JOIN lf ON lf.series_id = e.series_id AND lf.day = e.day AND lf.hour BETWEEN e.fh - 1 AND e.th + 1 WHERE v IS NOT NULL GROUP BY 1, 2, 3)
    SELECT ek.series_id, CAST(ek.day AS VARCHAR) AS day, ek.rank, ek.event_id, ek.rank <= 3 AS must_discuss, coalesce(ee.n, 0) AS n_facts, coalesce(sources, '') AS sources, {_r('coalesce(total, 0) AS facts_sum')} FROM ek LEFT JOIN ee ON ee.series_id = ek.series_id AND ee.day = ek.day AND ee.event_id = ek.event_id""")
def j21_rp19_evidence_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _priority_rows(spark, sf_dir)
    errors = rows.withColumns({"model": F.col("actual_mw") - F.col("model_mw"), "reference": F.col("actual_mw") - F.col("reference_mw")})
    facts = priorities.hourly_facts(errors, "error", "model", "reference").unionByName(priorities.hourly_facts(rows, "shape", "lag_24h_hourly_delta", "recent_same_business_type_delta_mean")).unionByName(priorities.hourly_facts(rows, "serving", "recalculated_mw"))
    got = priorities.evidence_bundles(priorities.priority_events(rows), facts)
    total = F.aggregate("evidence", F.lit(0.0), lambda acc, x: acc + x["value"])
    return _out(got.select("series_id", "day", "rank", "event_id", "must_discuss", F.size("evidence").alias("n_facts"), "sources", total.alias("facts_sum")))
