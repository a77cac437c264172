"""Registered queries of the ordered intraday corrector, over derived demand at its real limits, with DuckDB SQL.

Every day is looked at as of every hour: a series, day and hour of origin is a day of its own, whose later actuals are
hidden.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as tb
from .functions import scalars as S
from .operators import corrector, features
from .queries import _CALENDAR_SQL, _DAYS, _out, _r, _register, _weather_sql

_TS = "CAST(ts AS VARCHAR) AS ts"


def demand_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of every hour of demand, the mean of its slot as raw forecast, and that mixed with yesterday as forecast."""
    h = tb.demand(spark, sf_dir)
    cal = tb.calendar(h.select(F.to_date("ts").alias("day")), tb.DEMAND_HOLIDAYS)
    rows = features.build_features(h, tb.weather(spark, sf_dir), cal)
    rows = rows.withColumn("apparent_temp_c", S.apparent_temperature(F.col("temp_c"), F.col("humidity")))
    return rows.withColumns({"raw_mw": F.col("roll_4w_mean"), "forecast_mw": (F.col("roll_4w_mean") + F.col("lag_24h")) / 2}).where("roll_4w_mean is not null and lag_24h is not null")


_OWN = ("series_id", "ts", "actual_mw", "forecast_mw", *corrector.FEATURES)


def as_of_every_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tb.written(demand_rows(spark, sf_dir).select(*[c for c in _OWN if c != "apparent_cooling_delta_24h"]), "demand-rows")
    carried = corrector.carried_residuals(known)
    held = known.withColumn("day", F.to_date("ts")).join(carried, ["series_id", "day"], "left").drop("day")
    each = held.withColumn("origin", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return each.withColumns({"series_id": F.concat_ws("@", "series_id", "origin"), "actual_mw": F.when(F.hour("ts") < F.col("origin"), F.col("actual_mw"))}).drop("origin")


DEMAND_SQL = "WITH RECURSIVE " + tb.DEMAND_CTES + ", " + _CALENDAR_SQL.replace(tb.calendar_ctes(_DAYS) + ",", "") + ", " + _weather_sql(True)

_APPARENT = "coalesce(temp_c + 0.33 * (humidity / 100 * 6.105 * exp(17.27 * temp_c / (237.7 + temp_c))) - 0.70 * 1.0 - 4.0, temp_c)"
#: Rows as of every hour (x0), what the day has shown (y0) and both joined with running sums (z0).
_STATE = f""", x00 AS (SELECT cm.series_id, cm.ts, cm.day, CAST(cm.hour AS INT) AS hour, cm.actual_mw AS a, cm.off AS off1, coalesce(cm.off = 1, false) AS off, cm.mm, cm.lag_24h, cm.lag_24h_hourly_delta AS ld, cm.recent_same_business_type_mean AS um, cm.recent_same_business_type_delta_mean AS ud, (cm.roll_4w_mean + cm.lag_24h) / 2 AS f,
      greatest(cm.lag_24h_hourly_delta, cm.recent_same_business_type_delta_mean) AS sup, temp_c, temp_delta_1h AS td1, temp_delta_24h AS td, cooling_degree AS cool, cooling_delta_1h AS cd1, cooling_delta_24h AS cd, heating_degree AS heat, temp_anomaly_7d AS t7, humidity AS hum, discomfort_index AS di, {_APPARENT} AS app
      FROM cm LEFT JOIN wf ON wf.series_id = cm.series_id AND wf.ts = cm.ts WHERE roll_4w_mean IS NOT NULL AND lag_24h IS NOT NULL),
    x0 AS (SELECT x.* REPLACE (x.series_id || '@' || o AS series_id, CASE WHEN x.hour < o THEN a END AS a), c.r AS carried, c.hour AS carried_hour FROM x00 x LEFT JOIN (SELECT series_id, day + 1 AS day, arg_max(a - f, hour) AS r, max(hour) AS hour FROM x00 GROUP BY 1, 2) c ON c.series_id = x.series_id AND c.day = x.day, (SELECT CAST(unnest(range(24)) AS INT) AS o) t),
    y00 AS (SELECT series_id, day, list(hour ORDER BY hour) AS h, list(a ORDER BY hour) AS x, list(a - f ORDER BY hour) AS r, list(WGT ORDER BY hour) AS w FROM x0 WHERE a IS NOT NULL GROUP BY 1, 2),
    y0 AS (SELECT series_id, day, len(h) AS n, h[-1] AS lh, x[-1] AS lm, r[-1] AS r3, r[-2] AS r2, r[-3] AS r1, list_avg(r[-3:]) AS rm, list_max(r[-3:]) AS rx, list_sum(list_transform(list_zip(r[-3:], w[-3:]), lambda z: z[1] * z[2])) / list_sum(w[-3:]) AS rw,
      CASE WHEN h[-1] - h[-2] = 1 THEN x[-1] - x[-2] END AS slope, CASE WHEN h[-1] - h[-2] = 1 AND h[-2] - h[-3] = 1 THEN x[-3] END AS a1, CASE WHEN h[-1] - h[-2] = 1 AND h[-2] - h[-3] = 1 THEN x[-2] END AS a2, CASE WHEN h[-1] - h[-2] = 1 AND h[-2] - h[-3] = 1 THEN x[-1] END AS a3,
      coalesce(h[-1] - h[-2] = 1 AND x[-2] - x[-1] >= 500, false) OR coalesce(h[-2] - h[-3] = 1 AND h[-2] >= h[-1] - 1 AND x[-3] - x[-2] >= 500, false) AS falling FROM y00),
    z00 AS (SELECT x.*, x.f AS f0, coalesce(y.n, 0) AS n, y.* EXCLUDE (series_id, day, n), x.hour - coalesce(y.lh, -1) AS lead, t.off1 AS off_then, t.mm AS mm_then, t.um AS um_then, t.lag_24h AS lag_then,
      sum(coalesce(x.sup, 0)) OVER d AS s_all, sum(greatest(coalesce(x.sup, 0), 0)) OVER d AS s_up, count(x.sup) OVER d AS s_n FROM x0 x LEFT JOIN y0 y ON y.series_id = x.series_id AND y.day = x.day LEFT JOIN x0 t ON t.series_id = x.series_id AND t.day = x.day AND t.hour = y.lh WINDOW d AS (PARTITION BY x.series_id, x.day ORDER BY x.hour)),
    z0 AS (SELECT *, CASE WHEN s_n - max(CASE WHEN hour = lh THEN s_n END) OVER d = lead THEN s_all - max(CASE WHEN hour = lh THEN s_all END) OVER d END AS cum, CASE WHEN s_n - max(CASE WHEN hour = lh THEN s_n END) OVER d = lead THEN s_up - max(CASE WHEN hour = lh THEN s_up END) OVER d END AS cup, a3 - a2 AS late, (a3 - a1) / 2 AS ms FROM z00 WINDOW d AS (PARTITION BY series_id, day))"""


def _t(x: str) -> str:
    return f"(round_even(({x}) * 10, 0) / 10)"


def _bias(i: int, name: str, by: str) -> str:
    return f", v{i} AS (SELECT *, CASE WHEN lead > 0 THEN coalesce({_t(by)}, 0.0) ELSE 0.0 END AS d_{name} FROM z{i}), z{i + 1} AS (SELECT * REPLACE (CASE WHEN d_{name} <> 0 THEN {_t(f'f + d_{name}')} ELSE f END AS f) FROM v{i})"


def _step(i: int, name: str, by: str) -> str:
    return f", v{i} AS (SELECT *, CASE WHEN n >= 3 AND lead > 0 THEN coalesce({by}, 0.0) ELSE 0.0 END AS d_{name} FROM z{i}), z{i + 1} AS (SELECT * REPLACE ({_t(f'adj + d_{name}')} AS adj) FROM v{i})"


_EARLY = f"CASE WHEN n = 2 AND r3 * r2 >= 0 AND abs(rm) >= 500 THEN {_t('greatest(-700, least(700, rm * 0.5))')} END"
_HOT = "lead > 0 AND mm > 0 AND off1 = 1 AND lag_24h - um > 1500"
_WARM = "least(900, greatest(0, coalesce(t7, 0)) * 120 + greatest(0, coalesce(cool, 0)) * 160)"
_F3 = "greatest(0, 1 - n / 3)"
_BIASES = [
    ("day_level", f"CASE WHEN n < 3 AND lag_24h - um > 600 AND -td > 1.5 AND coalesce(heat, 0) <= 7 AND {_F3} > 0 THEN greatest(-700, least(700, -(lag_24h - um - 600) * 0.25 * least(1, -td / 5) * {_F3})) END"),
    ("early_carryover", _EARLY),
    ("day_boundary", f"CASE WHEN n < 3 AND {_EARLY} IS NULL AND 24 - carried_hour BETWEEN 0 AND 8 THEN greatest(-500, least(500, carried * 0.5 * pow(0.75, 24 - carried_hour))) END"),
    ("transition", f"CASE WHEN n >= 3 AND lh >= 6 AND rm <= -300 AND {_HOT} AND f > um + 900 + {_WARM} THEN {_t(f'-least(1200, (f - (um + 900 + {_WARM})) * 0.55)')} END"),
    ("transition_prior", f"CASE WHEN coalesce(lh < 6, true) AND {_HOT} AND f > um + 900 THEN {_t('-least(500, (f - (um + 900)) * 0.25)')} END"),
]
_RECOVERY = "CASE WHEN coalesce(rm < 0 AND ms > 0 AND greatest(a2 - a1, late) >= 1000 AND off_then = 1 AND mm_then > 0 AND lag_then > um_then AND a3 >= um_then - 1200 AND r3 < 0 AND r1 < r2 AND r2 < r3, false) THEN CASE WHEN ms >= 500 AND a3 >= um_then THEN 0.2 ELSE 0.4 END ELSE 1.0 END"
_MITIGATED = f"CASE WHEN coalesce(lh < 6 AND hour BETWEEN 6 AND 11 AND {_HOT} AND f > um + 900, false) THEN 0.0 ELSE 1.0 END"
_ROLLS = "coalesce(base > 300 AND lh >= 12 AND (late <= -300 OR (a2 - a1 - late >= 500 AND late <= 400)) AND least(r1, r2, r3) >= 300 AND r2 - r3 >= 300 AND (um_then IS NULL OR a3 >= um_then - 1200), false)"


def _keep(factor: float, least: float, on: str) -> str:
    change = f"({_t(f'adj * {factor}')} - adj)"
    return f"CASE WHEN {on} AND abs({change}) >= {least} THEN {change} END"


def _damp(off: str, seen: str, hours: str, leads: str, base: int, weak: int, factor: float, least: int, more: str = "true") -> str:
    return _keep(factor, least, f"{more} AND positive AND adj > 0 AND off = {off} AND base >= {base} AND lh BETWEEN {seen} AND hour BETWEEN {hours} AND lead BETWEEN {leads} AND sup <= {weak}")


def _cut(over: str, share: str, most: str, least: str, on: str) -> str:
    cut = _t(f"least(({over}) * {share}, {most})")
    return f"CASE WHEN {on} AND ({over}) > 0 AND {cut} >= {least} THEN -{cut} END"


def _raise(lift: str, least: int, on: str) -> str:
    return f"CASE WHEN {on} AND {_t(lift)} >= {least} THEN {_t(lift)} END"


_LM = _t("lm")
_RAMP_FLOOR = f"({_LM} + {_t('least(ms * 0.25, 900)')} * lead)"
_NEAR_SLOPE = _t("coalesce(slope, 0)")
_NEAR_FLOOR = f"greatest({_LM} - 150 - least(greatest(-{_NEAR_SLOPE}, 0) * 0.25, 400), um - 1200)"
_TAIL = "(off AND r2 > 0 AND r3 >= 350 AND (r2 + r3) / 2 >= 450 AND greatest(r2, r3) >= 600)"
_BY = lambda a, b: f"CASE WHEN off THEN {b} ELSE {a} END"
_GATE = f"(CAST(r1 > 0 AS INT) + CAST(r2 > 0 AS INT) + CAST(r3 > 0 AS INT) >= 2 AND r3 >= {_BY(600, 350)} AND rm >= {_BY(600, 450)} AND rx >= {_BY(1000, 700)})"
_LIFTS = f"((base >= CASE WHEN {_TAIL} THEN 0 WHEN off THEN 250 ELSE 600 END AND ({_GATE} OR {_TAIL})) OR (NOT off AND r3 >= 900 AND rx >= 900 AND base >= 0))"
_HEAT = "(coalesce(td, 0) >= 3 OR coalesce(cd, 0) >= 1 OR CASE WHEN off THEN coalesce(di, 0) >= 70 OR coalesce(hum, 0) >= 85 ELSE coalesce(di, 0) >= 76.5 OR coalesce(app, 0) >= 30 END)"
_DAY_FLOOR = f"greatest({_LM} + least(greatest({_NEAR_SLOPE}, 0) * 0.25, 900) * lead - 300 - (f + adj), 0) * 0.5"
_PRESSURE = f"greatest({_t('r3')}, {_t(f'CASE WHEN {_TAIL} THEN (r2 + r3) / 2 ELSE rm END')}, {_t(f'CASE WHEN {_TAIL} THEN greatest(r2, r3) ELSE rx END')} * 0.75)"
_DAY_LIFT = f"least(greatest({_DAY_FLOOR}, greatest({_PRESSURE} - greatest(adj, 0) - {_BY(200, 0)}, 0) * {_BY(0.55, 0.8)}), {_BY(900, 800)})"
_HIGH, _BYSUP = "(r3 <= -400)", "(NOT off AND r3 > -400 AND r3 <= 300)"
_ABOVE = f"(f + adj - ({_LM} + cum + CASE WHEN {_BYSUP} THEN 1200 ELSE 0 END))"
_STEEP = "coalesce(CASE WHEN off THEN late >= 4000 AND ms >= 2500 AND cum >= 2500 ELSE late >= 3000 AND ms >= 3000 AND cum >= 2500 AND -r3 <= 650 END, false)"
_SEVERE = "(r3 <= -1200 AND rm <= -700)"
_STEPS = [
    ("positive_mitigation", f"CASE WHEN positive AND {_t(f'adj * {_MITIGATED}')} < adj THEN {_t(f'adj * {_MITIGATED}')} - adj END"),
    ("slope_damping", f"CASE WHEN positive AND {_ROLLS} AND lead <= 3 AND f + adj > {_t('greatest(lm, um_then)')} + 300 AND {_t('adj * 0.4')} < adj THEN {_t('adj * 0.4')} - adj END"),
    ("morning_damping", _damp("false", "7 AND 10", "10 AND 13", "2 AND 4", 300, 1800, 0.4, 100, "greatest(a2 - a1, late) >= 1000")),
    ("afternoon_damping", _damp("false", "11 AND 20", "13 AND 23", "1 AND 6", 250, 900, 0.4, 100)),
    ("evening_damping", _damp("true", "12 AND 23", "17 AND 20", "2 AND 6", 350, 600, 0.45, 120)),
    ("morning_ramp", _raise(f"least(greatest({_t(f'least({_RAMP_FLOOR}, f) - f')} - adj, 0), 700, -adj)", 100, f"NOT positive AND base < 0 AND NOT off AND lh >= 7 AND hour BETWEEN 6 AND 11 AND lead BETWEEN 1 AND 2 AND least(a2 - a1, late) >= 1000 AND ms >= 1000 AND f + adj < {_RAMP_FLOOR}")),
    ("evening_negative_damping", _keep(0.45, 120, "negative AND off AND base <= -500 AND lh >= 16 AND hour BETWEEN 18 AND 20 AND lead BETWEEN 1 AND 3 AND late >= 600 AND ms >= 300 AND sup >= 0")),
    ("continuity_floor", _raise(f"least({_LM} - 500 + least(greatest({_t('ms')}, 0) * 0.25, 300) - (f + adj), 900)", 100, "negative AND off AND lh >= 10 AND hour BETWEEN 10 AND 17 AND lead BETWEEN 1 AND 2 AND late >= -300 AND ms >= -300")),
    ("near_floor", _raise(f"least({_NEAR_FLOOR} - (f + adj), 700, -adj) * CASE WHEN coalesce({_NEAR_SLOPE} <= -500 AND sup <= -500, false) THEN 0.25 ELSE 1.0 END", 100, f"negative AND adj <= -500 AND lh >= 10 AND hour BETWEEN 10 AND 20 AND lead BETWEEN 1 AND 2 AND {_NEAR_FLOOR} > f + adj")),
    ("observed_ramp", _raise(f"least({_LM} + least({_t(f'least(CASE WHEN off THEN late * 1.0 ELSE ms * 0.85 END, 2200)')}, greatest(sup * 0.5, 0)) * lead - (f + adj), {_BY(1200, 700)})", 100, "lh BETWEEN 7 AND 10 AND hour BETWEEN 8 AND 11 AND lead BETWEEN 1 AND 2 AND r3 > -500 AND CASE WHEN off THEN late >= 2000 AND ms >= 1200 ELSE least(a2 - a1, late) >= 1200 AND ms >= 1200 END AND sup >= 700")),
    ("daytime_lift", _raise(_DAY_LIFT, 100, f"lh BETWEEN 8 AND 15 AND lead BETWEEN 1 AND 3 AND hour BETWEEN {_BY(10, 12)} AND {_BY(17, 15)} AND {_LIFTS} AND coalesce(slope, 0) >= -800 AND {_HEAT} AND (off OR hour NOT IN (12, 13) OR coalesce(ld >= 600 AND ud >= 600, false))")),
    ("post_lunch", _cut(f"f + adj - ({_LM} + greatest(sup, 0) * 0.35 + 500)", "1.0", "900", "100", "NOT off AND lh BETWEEN 12 AND 13 AND hour BETWEEN 13 AND 14 AND lead BETWEEN 1 AND 2 AND slope <= -700 AND sup <= 900")),
    ("morning_warm", _cut(f"f + adj - ({_LM} + {_t('greatest(400, least(1800, coalesce(slope, 0) + 300))')} * lead)", "0.75", "800", "100", "NOT off AND base <= -500 AND lh BETWEEN 6 AND 10 AND hour BETWEEN 8 AND 11 AND lead BETWEEN 1 AND 2 AND (coalesce(td, 0) >= 2 OR coalesce(cd, 0) >= 0.8)")),
    ("morning_anchor", _cut(_ABOVE, f"CASE WHEN {_BYSUP} THEN 0.5 WHEN off THEN 0.75 ELSE 1.0 END", "1000", f"CASE WHEN {_BYSUP} THEN 150 ELSE 100 END", f"lh >= 8 AND lh <= {_BY(12, 9)} AND hour BETWEEN 9 AND 13 AND lead BETWEEN 1 AND 4 AND (({_HIGH} AND NOT {_STEEP}) OR ({_BYSUP} AND (coalesce(td, 0) >= 3 OR coalesce(cd, 0) >= 2) AND {_ABOVE} >= 1200))")),
    ("afternoon_anchor", _cut(f"f + adj - ({_LM} + cup * CASE WHEN {_SEVERE} THEN 0.35 ELSE 0.6 END + CASE WHEN {_SEVERE} THEN 0 ELSE 350 END)", f"CASE WHEN {_SEVERE} THEN 1.0 ELSE 0.75 END", f"CASE WHEN {_SEVERE} THEN 1500 ELSE 1200 END", f"CASE WHEN {_SEVERE} THEN 150 ELSE 100 END", f"lh BETWEEN 12 AND 15 AND hour BETWEEN 14 AND 17 AND lead BETWEEN 1 AND 3 AND ((r3 <= -500 AND rm <= -500) OR {_SEVERE}) AND (slope IS NULL OR slope <= CASE WHEN {_SEVERE} THEN 1500 ELSE 900 END)")),
]


def _last_rules(i: int, shape: bool) -> str:
    """Evening decline and shape guard, hour after hour by recursion, then the ramp guard."""
    allowed = "least((greatest(coalesce(e.td1, 0), coalesce(e.cd1, 0), 0) + greatest(coalesce(e.temp_c, 0) - 30, 0)) * 120, 400)"
    now, floor = "(e.f + e.adj)", f"({_t('e.lm')} - 300)"
    rebound = f"({now} - r.plain > 800)"
    strong = "coalesce(e.um IS NOT NULL AND e.ld <= -800 AND e.ud <= -800, false)"
    over = f"({now} - {allowed} - CASE WHEN {rebound} THEN greatest(r.plain, {floor}) + 600 WHEN {strong} THEN e.um + 300 ELSE greatest({floor}, e.um) + 600 END)"
    cut = _t(f"least({over} * CASE WHEN {rebound} THEN 1.0 ELSE 0.75 END, 900)")
    evening = "e.n >= 3 AND e.lh >= 15 AND e.hour BETWEEN 16 AND 21 AND e.lead BETWEEN 1 AND 2 AND e.late <= -500 AND e.ms <= -300"
    on = f"coalesce({evening} AND e.ld <= 200 AND e.ud <= 200 AND {over} > 0 AND ({rebound} OR {over} >= CASE WHEN {strong} THEN 250 ELSE 500 END) AND {cut} >= 100, false)"
    lost = f"(CASE WHEN {on} THEN {cut} ELSE 0.0 END)"
    plain = lambda cut: f"CASE WHEN e.lead > 0 AND e.n >= 3 THEN {_t('e.f + ' + _t(f'e.adj - {cut}'))} ELSE e.f END"
    low = f"coalesce(e.lh >= 12 AND NOT e.falling AND e.hour BETWEEN 15 AND 19 AND e.hour = r.hour + 1 AND p.plain < r.shaped - 1000, false)" if shape else "false"
    up = ["1800", "2400", "3000"]
    pick = lambda values: f"{list(map(float, values))}[greatest(least(lead, 3), 1)]"
    backed = "coalesce(NOT off AND ld IS NOT NULL AND ud IS NOT NULL AND sup <= -900, false)"
    drop = f"CASE WHEN falling AND {backed} THEN greatest({pick((1600, 2800, 4200))}, {pick((2600, 4800, 6500))}) WHEN falling THEN {pick((1600, 2800, 4200))} ELSE {pick((1600, 2600, 3600))} END"
    held = f"least(greatest(shaped, lm - {drop}), lm + {pick(up)})"
    ramped = f"coalesce(lh >= 10 AND lead BETWEEN 1 AND 3 AND {held} <> shaped, false)"
    return f""", q0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY hour) AS i FROM z{i}),
    q1 AS (SELECT series_id, day, i, hour, 0.0::DOUBLE AS d_evening_decline, 0.0::DOUBLE AS d_shape_guard, {plain('0.0').replace('e.', 'q0.')} AS plain, {plain('0.0').replace('e.', 'q0.')} AS shaped FROM q0 WHERE i = 1
      UNION ALL SELECT e.series_id, e.day, e.i, e.hour, -p.lost, CASE WHEN {low} THEN {_t('r.shaped - 1000')} - p.plain ELSE 0.0 END, p.plain, CASE WHEN {low} THEN {_t('r.shaped - 1000')} ELSE p.plain END
      FROM q1 r JOIN q0 e ON e.series_id = r.series_id AND e.day = r.day AND e.i = r.i + 1, LATERAL (SELECT l.lost, {plain('l.lost')} AS plain FROM (SELECT {lost} AS lost) l) p),
    q2 AS (SELECT q0.*, q1.d_evening_decline, q1.d_shape_guard, q1.shaped FROM q0 JOIN q1 USING (series_id, day, hour)),
    q3 AS (SELECT *, CASE WHEN {ramped} THEN {_t(held)} - shaped ELSE 0.0 END AS d_ramp_guard, CASE WHEN {ramped} THEN {_t(held)} ELSE shaped END AS final FROM q2)"""


def _corrector_sql(damp: bool = False, deweight: bool = False, shape: bool = False) -> str:
    weight = "CASE WHEN hour = 12 AND NOT off AND abs(a - f) >= 600 THEN 0.25 ELSE 1.0 END::DOUBLE" if deweight else "1.0::DOUBLE"
    sql, i = DEMAND_SQL + _STATE.replace("WGT", weight), 0
    for name, by in _BIASES:
        sql, i = sql + _bias(i, name, by), i + 1
    primed = "max(CASE WHEN d_day_level <> 0 OR d_transition_prior <> 0 THEN 1 END) OVER (PARTITION BY series_id, day) = 1"
    sql += f", zp AS (SELECT *, {primed} AS primed FROM z{i})" + _bias(i, "prior_stack_cap", "CASE WHEN n < 3 AND primed AND n <= 1 AND f < f0 - 900 THEN f0 - 900 - f END").replace(f"FROM z{i})", "FROM zp)", 1)
    i += 1
    base = "rw * 0.6" + (" * CASE WHEN rw < 0 AND lh >= 12 THEN 0.5 ELSE 1.0 END" if damp else "")
    start = _t(f"CASE WHEN base < 0 THEN base * {_RECOVERY} ELSE base END * pow(0.92, lead - 1)")
    sql += f", zb AS (SELECT *, CASE WHEN n >= 3 THEN greatest(-1200, least(1200, {base})) END AS base FROM z{i}), zc AS (SELECT *, CASE WHEN n >= 3 AND lead > 0 THEN {start} ELSE 0.0 END AS d_observed_residual FROM zb), z{i + 1} AS (SELECT *, d_observed_residual AS adj, d_observed_residual > 0 AS positive FROM zc)"
    i += 1
    for name, by in _STEPS:
        if name == "evening_negative_damping":
            sql += f", zn AS (SELECT *, adj < 0 AS negative FROM z{i})" + _step(i, name, by).replace(f"FROM z{i})", "FROM zn)", 1)
        else:
            sql += _step(i, name, by)
        i += 1
    return sql + _last_rules(i, shape)


_MOVED = ", ".join(f"CASE WHEN abs(d_{n}) > 1e-9 THEN '{n}' END" for n in corrector.RULES)
_HOURS = f" SELECT series_id, {_TS}, {_r('f0 AS forecast_mw', 'final AS corrected_mw')}, CAST(n AS BIGINT) AS n_observed, CAST(lh AS BIGINT) AS last_hour, concat_ws(',', {_MOVED}) AS reasons FROM q3"
_MOVES = ", ".join(f"{{'step': {i}, 'rule': '{n}', 'mw': d_{n}}}" for i, n in enumerate(corrector.RULES))
_TRACE = f", tr AS (SELECT series_id, ts, unnest([{_MOVES}]) AS m FROM q3) SELECT series_id, {_TS}, CAST(m.step AS BIGINT) AS step, m.rule AS rule, {_r('m.mw AS mw')} FROM tr WHERE abs(m.mw) > 1e-9"
_KEEP = ("series_id", "ts", "forecast_mw", "corrected_mw", "n_observed", "last_hour", "reasons")


@_register(_corrector_sql() + _HOURS)
def ic01_32_corrector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(corrector.correct(as_of_every_hour(spark, sf_dir)), *_KEEP)


@_register(_corrector_sql() + _TRACE)
def ic31_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(corrector.trace(corrector.correct(as_of_every_hour(spark, sf_dir))))


@_register(_corrector_sql(True, True, True) + _HOURS)
def ic04_12_29_optional_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With negative damping, the lighter midday and the shape guard, which are off by default."""
    return _out(corrector.correct(as_of_every_hour(spark, sf_dir), True, True, True), *_KEEP)
