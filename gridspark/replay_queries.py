"""Registered queries of replays as of an origin and of the gate that reads them, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables as tb
from .functions.constants import Z95, Z99
from .operators import metrics
from .plans import fixed_origin, replay
from .queries import _BUNDLE, _days, _out, _r, _register

_DRAWS, _SEED = 20000, 20260821


def _replay_sql(lead: int, from_hour: int) -> str:
    """CTE ``rp``: the rows of fixed_origin.replay, each target reading all facts before its as_of."""
    bands = ", ".join(f"{n}_mw {'-' if e == 'lower' else '+'} {z}::DOUBLE * spread AS {n}_{p}_{e}" for n in ("champion", "candidate") for p, z in (("p95", Z95), ("p99", Z99)) for e in ("lower", "upper"))
    return f"""WITH {tb.DEMAND_CTES},
    og AS (SELECT event_type AS series_id, CAST(ts AS DATE) + {lead} AS target, min(ts) AS captured_at FROM events WHERE hour(ts) >= {from_hour} GROUP BY 1, 2),
    tg AS (SELECT o.series_id, o.target, least(date_trunc('hour', captured_at), CAST(o.target AS TIMESTAMP)) AS as_of, CAST(o.target AS TIMESTAMP) + to_hours(CAST(h AS INT)) AS ts, CAST(h AS INT) AS hour, isodow(o.target) AS dow, c.is_off FROM og o JOIN calendar c ON c.day = o.target, range(24) r(h)),
    fx AS (SELECT f.*, hour(ts) AS hour, isodow(ts) AS dow, c.is_off FROM hourly f JOIN calendar c ON c.day = CAST(f.ts AS DATE)),
    wk AS (SELECT t.series_id, t.ts, f.actual_mw, row_number() OVER (PARTITION BY t.series_id, t.ts ORDER BY f.ts DESC) AS i FROM tg t JOIN fx f ON f.series_id = t.series_id AND f.hour = t.hour AND f.dow = t.dow AND f.ts < t.as_of),
    kd AS (SELECT t.series_id, t.ts, f.actual_mw, row_number() OVER (PARTITION BY t.series_id, t.ts ORDER BY f.ts DESC) AS i FROM tg t JOIN fx f ON f.series_id = t.series_id AND f.hour = t.hour AND f.is_off = t.is_off AND f.ts < t.as_of),
    wa AS (SELECT series_id, ts, avg(actual_mw) AS champion_mw, coalesce(stddev_samp(actual_mw), 0) AS spread FROM wk WHERE i <= 4 GROUP BY 1, 2), ka AS (SELECT series_id, ts, avg(actual_mw) AS raw_mw FROM kd WHERE i <= 8 GROUP BY 1, 2),
    rw AS (SELECT t.series_id, t.target, t.as_of, t.ts, t.is_off, h.actual_mw, champion_mw, raw_mw, spread FROM tg t JOIN hourly h ON h.series_id = t.series_id AND h.ts = t.ts JOIN wa ON wa.series_id = t.series_id AND wa.ts = t.ts JOIN ka ON ka.series_id = t.series_id AND ka.ts = t.ts),
    rd AS (SELECT series_id, target, any_value(as_of) AS as_of, any_value(is_off) AS is_off, avg(actual_mw - raw_mw) AS residual, count(*) AS hours FROM rw GROUP BY 1, 2),
    ls AS (SELECT a.series_id, a.target, b.residual, row_number() OVER (PARTITION BY a.series_id, a.target ORDER BY b.target DESC) AS i FROM rd a JOIN rd b ON a.series_id = b.series_id AND a.is_off = b.is_off AND b.hours = 24 AND b.target < a.target AND CAST(b.target + 1 AS TIMESTAMP) <= a.as_of),
    sh AS (SELECT series_id, target, greatest(-{fixed_origin.CAP}, least({fixed_origin.CAP}, median(residual) * {fixed_origin.SHARE})) AS shift FROM ls WHERE i <= {fixed_origin.LAST} GROUP BY 1, 2 HAVING count(*) = {fixed_origin.LAST}),
    sc AS (SELECT rw.*, CASE WHEN abs(shift) >= 0.05 THEN shift ELSE 0.0 END AS shift_mw, raw_mw + CASE WHEN abs(shift) >= 0.05 THEN shift ELSE 0.0 END AS candidate_mw FROM rw LEFT JOIN sh ON sh.series_id = rw.series_id AND sh.target = rw.target),
    rp AS (SELECT *, {bands} FROM sc)"""


def _replayed(spark: SparkSession, sf_dir: str, lead: int, from_hour: int) -> DataFrame:
    h = tb.written(tb.demand(spark, sf_dir), "demand")
    captures = tb.read_table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.col("ts").alias("captured_at"))
    return fixed_origin.replay(h, fixed_origin.origins(captures, lead, from_hour), tb.calendar(_days(h), tb.DEMAND_HOLIDAYS))


_COLUMNS = [f"{n}_{p}_{e}" for n in ("champion", "candidate") for p in ("p95", "p99") for e in ("lower", "upper")]


@_register(_replay_sql(1, 5) + f" SELECT series_id, CAST(ts AS VARCHAR) AS ts, CAST(target AS VARCHAR) AS target, CAST(as_of AS VARCHAR) AS as_of, is_off, {_r('actual_mw', 'champion_mw', 'raw_mw', 'shift_mw', 'candidate_mw', *_COLUMNS)} FROM rp")
def ev12_f04_fixed_origin_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(_replayed(spark, sf_dir, 1, 5))


_INTERVAL_SQL = f"""dy AS (SELECT series_id, CAST(ts AS DATE) AS day, avg(abs(candidate_mw - actual_mw)) AS new, avg(abs(champion_mw - actual_mw)) AS old FROM rp GROUP BY 1, 2),
    dk AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS days FROM dy),
    pk AS (SELECT series_id, draw, ('0x' || substr(md5('{_SEED}|' || draw || '|' || k), 1, 13))::BIGINT % days AS k FROM dk, (SELECT unnest(range({_DRAWS})) AS draw)),
    me AS (SELECT series_id, draw, avg(new) / nullif(avg(old), 0) AS ratio, avg(new) - avg(old) AS diff FROM pk JOIN dk USING (series_id, k) GROUP BY 1, 2),
    en AS (SELECT series_id, quantile_cont(ratio, 0.025) AS ratio_low, quantile_cont(ratio, 0.975) AS ratio_high, quantile_cont(diff, 0.025) AS low, quantile_cont(diff, 0.975) AS high FROM me GROUP BY 1),
    iv AS (SELECT series_id, count(*) >= {metrics.LEAST_DAYS} AS valid, count(*) AS days, count(*) FILTER (new < old) AS better_days, sum(new) / nullif(sum(old), 0) AS mae_ratio, any_value(ratio_low) AS ratio_low, any_value(ratio_high) AS ratio_high, avg(new) - avg(old) AS mean_difference, any_value(low) AS low, any_value(high) AS high FROM dy JOIN en USING (series_id) GROUP BY 1)"""


@_register(_replay_sql(0, 0) + f", {_INTERVAL_SQL} SELECT series_id, valid, days, better_days, {', '.join(_r(f'CASE WHEN valid THEN {c} END AS {c}') for c in ('mae_ratio', 'ratio_low', 'ratio_high', 'mean_difference', 'low', 'high'))} FROM iv")
def a23_ratio_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(metrics.paired_ratio_bootstrap(_replayed(spark, sf_dir, 0, 0), "candidate_mw", "champion_mw", _DRAWS, _SEED))


def _bundle_sql(name: str) -> str:
    """The metric bundle of a forecast of ``rp`` as CTE mb_<name>."""
    body = "er AS" + _BUNDLE.split("er AS", 1)[1]
    return body.replace("er AS (SELECT p.*", f"er_{name} AS (SELECT p.series_id, p.ts, p.actual_mw").replace("FROM pairs p", "FROM rp p").replace("model_mw", f"{name}_mw").replace("FROM er GROUP", f"FROM er_{name} GROUP").replace("mb AS", f"mb_{name} AS")


def _gate_sql() -> str:
    names = ("mae", "rmse", "max_error", "shape_mae")
    modes = replay.MODES
    limits = sorted({m["worst"] for m in modes.values()})
    over = {x: f"over_{i}" for i, x in enumerate(limits)}
    whole = "(regime IS NULL AND band IS NULL)"
    mode = "CASE " + " ".join(f"WHEN len({over[m['worst']]}) = 0 AND " + " AND ".join(f"{k}_pct >= {v}" for k, v in m.items() if k != "worst") + f" THEN '{name}'" for name, m in modes.items()) + " ELSE 'failed' END"
    lost = {b: f"CASE WHEN candidate_{b} >= champion_{b} - {x} THEN NULL ELSE '{b}_coverage_regressed' END" for b, x in replay.COVERAGE_LOSS.items()}
    failures = f"""[CASE WHEN mae_not THEN 'overall_mae_not_improved' END, CASE WHEN rmse_not THEN 'overall_rmse_not_improved' END, {', '.join(lost.values())},
      CASE WHEN mode = 'failed' THEN 'recovery_below_threshold' END, CASE WHEN valid AND ratio_high < 1 THEN NULL ELSE 'interval_does_not_confirm' END]"""
    cover = ", ".join(f"avg(CASE WHEN actual_mw BETWEEN {n}_{p}_lower AND {n}_{p}_upper THEN 1.0 ELSE 0.0 END) * 100 AS {n}_{p}" for p in ("p95", "p99") for n in ("champion", "candidate"))
    return f"""{_bundle_sql('candidate')}, {_bundle_sql('champion')},
    sg AS (SELECT a.series_id, a.regime, a.band, CASE WHEN a.regime IS NOT NULL THEN 'regime.' || a.regime ELSE 'band.' || a.band END AS segment, {', '.join(f'a.{c} AS new_{c}, b.{c} AS old_{c}' for c in names)}
      FROM mb_candidate a JOIN mb_champion b ON a.series_id = b.series_id AND a.regime IS NOT DISTINCT FROM b.regime AND a.band IS NOT DISTINCT FROM b.band),
    ga AS (SELECT series_id, {', '.join(f'max((old_{c} - new_{c}) / nullif(old_{c}, 0) * 100) FILTER {whole.replace("(", "(WHERE ", 1)} AS {c}_pct' for c in names)},
      bool_or({whole} AND new_mae >= old_mae) AS mae_not, bool_or({whole} AND new_rmse >= old_rmse) AS rmse_not,
      {', '.join(f"list_sort(coalesce(list(segment) FILTER (WHERE NOT {whole} AND new_mae > old_mae * {1 + x / 100}::DOUBLE), [])) AS {n}" for x, n in over.items())},
      coalesce(list(segment || '_mae_regressed') FILTER (WHERE NOT {whole} AND new_mae > old_mae * CASE WHEN regime IS NOT NULL THEN {replay.REGIME_GROWTH['holdout']} ELSE {replay.BAND_GROWTH} END::DOUBLE), []) AS grown FROM sg GROUP BY 1),
    cv AS (SELECT series_id, {cover} FROM rp GROUP BY 1),
    gm AS (SELECT ga.*, cv.* EXCLUDE (series_id), iv.valid, iv.ratio_high, {mode} AS mode FROM ga LEFT JOIN cv ON cv.series_id = ga.series_id LEFT JOIN iv ON iv.series_id = ga.series_id),
    gf AS (SELECT *, array_to_string(list_sort(list_concat(list_filter({failures}, lambda x: x IS NOT NULL), grown)), ',') AS failures FROM gm)
    SELECT series_id, {_r(*[f'{c}_pct' for c in names])}, array_to_string({over[modes['balanced']['worst']]}, ',') AS regressed, mode, failures, failures = '' AS passed FROM gf"""


@_register(_replay_sql(0, 0) + f", {_INTERVAL_SQL}, {_gate_sql()}")
def ev10_ev13_recovery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tb.written(_replayed(spark, sf_dir, 0, 0), "replay")
    cal = tb.calendar(_days(rows), tb.DEMAND_HOLIDAYS)
    bundle = lambda name: metrics.metric_bundle(rows.select("series_id", "ts", "actual_mw", f"{name}_mw"), f"{name}_mw", cal)
    interval = metrics.paired_ratio_bootstrap(rows, "candidate_mw", "champion_mw", _DRAWS, _SEED)
    return _out(replay.recovery_gate(bundle("candidate"), bundle("champion"), fixed_origin.coverages(rows), interval))
