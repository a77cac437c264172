"""Replays of forecasts as of their origins, back-tests against a baseline, and the gates that a candidate has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least improvements in percent of MAE, RMSE, largest error and shape, and the most that a segment may get worse, by
#: mode; the first mode that holds counts.
MODES = {
    "strict": {"mae": 8.0, "rmse": 0.0, "max_error": 0.0, "shape_mae": 0.0, "worst": 1.0},
    "balanced": {"mae": 7.0, "rmse": 8.0, "max_error": 10.0, "worst": 1.0},
    "conservative": {"mae": 5.0, "rmse": 5.0, "max_error": 5.0, "shape_mae": 2.0, "worst": 0.0},
}


def improvement(candidate: Column, champion: Column) -> Column:
    """Percent by which an error got smaller; null where the champion's is zero or unknown."""
    return (champion - candidate) / F.nullif(champion, F.lit(0.0)) * 100


def origin_replay(rows: DataFrame, origins: DataFrame, forecasts: list[str], lower: str | None = None, upper: str | None = None) -> DataFrame:
    """(series_id, target, captured_at, n, <forecast>_mae ..., coverage_pct): errors of the hours after each target's
    origin. rows: (series_id, ts, actual_mw, forecasts); origins: (series_id, target, captured_at), one for each target,
    so the join never multiplies rows."""
    j = rows.withColumn("target", F.to_date("ts")).join(origins.select("series_id", "target", "captured_at"), ["series_id", "target"]).where(F.col("ts") > F.col("captured_at"))
    parts = [F.avg(F.abs(F.col(f) - F.col("actual_mw"))).alias(f"{f}_mae") for f in forecasts]
    if lower is not None and upper is not None:
        parts.append((F.avg(F.col("actual_mw").between(F.col(lower), F.col(upper)).cast("int")) * 100).alias("coverage_pct"))
    return j.groupBy("series_id", "target", "captured_at").agg(F.count("*").alias("n"), *parts)


def backtest(rows: DataFrame, baseline: DataFrame, forecast: str) -> DataFrame:
    """(series_id, days, n, baseline_mae, model_mae, improvement_pct) over the hours that both forecasts have."""
    j = rows.join(baseline.select("series_id", "ts", F.col("forecast_mw").alias("baseline_mw")), ["series_id", "ts"])
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("actual_mw")))
    out = j.groupBy("series_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count("*").alias("n"), mae("baseline_mw").alias("baseline_mae"), mae(forecast).alias("model_mae"))
    return out.withColumn("improvement_pct", improvement(F.col("model_mae"), F.col("baseline_mae")))


def contract_comparison(candidate: DataFrame, champion: DataFrame, least_hours: int = 24) -> DataFrame:
    """(series_id, improvements of mae, rmse, max_error and shape_mae in percent, worst): two metric bundles; worst is
    the largest regression of MAE in a segment with hours enough."""
    names = ["mae", "rmse", "max_error", "shape_mae"]
    side = lambda df, p: df.select("series_id", F.coalesce("regime", F.lit("")).alias("regime"), F.coalesce("band", F.lit("")).alias("band"), F.col("n").alias(f"{p}_n"), *[F.col(c).alias(f"{p}_{c}") for c in names])
    j = side(candidate, "new").join(side(champion, "old"), ["series_id", "regime", "band"])
    j = j.withColumns({c: improvement(F.col(f"new_{c}"), F.col(f"old_{c}")) for c in names})
    whole = (F.col("regime") == "") & (F.col("band") == "")
    return j.groupBy("series_id").agg(*[F.max(F.when(whole, F.col(c))).alias(c) for c in names], F.max(F.when(~whole & (F.col("new_n") >= least_hours), -F.col("mae"))).alias("worst"))


def replay_gate(comparison: DataFrame) -> DataFrame:
    """comparison plus mode: the first mode of MODES whose limits hold, or rejected."""
    mode = F.lit("rejected")
    for name, limits in reversed(MODES.items()):
        holds = F.coalesce(F.col("worst"), F.lit(0.0)) <= limits["worst"]
        for metric, least in limits.items():
            if metric != "worst":
                holds = holds & (F.col(metric) >= least)
        mode = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(mode)
    return comparison.withColumn("mode", mode)


#: Most that the MAE of a day type may grow in each phase, and that of a band in any, as a factor; most that the coverage of the
#: two bands may fall, in points.
REGIME_GROWTH, BAND_GROWTH = {"development": 1.05, "holdout": 1.0}, 1.05
COVERAGE_LOSS = {"p95": 2.0, "p99": 1.0}


def recovery_gate(candidate: DataFrame, champion: DataFrame, coverage: DataFrame, interval: DataFrame, phase: str = "holdout") -> DataFrame:
    """(series_id, mae_pct, rmse_pct, max_error_pct, shape_mae_pct, regressed, mode, failures, passed).

    candidate, champion: metric bundles; coverage: (series_id, champion_p95, candidate_p95, champion_p99, candidate_p99)
    in percent; interval: ``paired_ratio_bootstrap`` of the two. In the holdout phase one of MODES has to hold - no
    segment, however few its hours, may get worse by more than the mode's worst - and the upper end of the ratio's
    interval has to lie below 1; in the development phase neither is asked. A missing coverage or interval fails.
    regressed and failures are names, sorted and comma-joined; regressed are segments worse than the balanced limit.
    """
    names = ["mae", "rmse", "max_error", "shape_mae"]
    side = lambda df, p: df.select("series_id", F.coalesce("regime", F.lit("")).alias("regime"), F.coalesce("band", F.lit("")).alias("band"), *[F.col(c).alias(f"{p}_{c}") for c in names])
    j = side(candidate, "new").join(side(champion, "old"), ["series_id", "regime", "band"])
    whole = (F.col("regime") == "") & (F.col("band") == "")
    segment = F.when(F.col("regime") != "", F.concat(F.lit("regime."), "regime")).otherwise(F.concat(F.lit("band."), "band"))
    worse = lambda growth: ~whole & (F.col("new_mae") > F.col("old_mae") * growth)
    factor = F.when(F.col("regime") != "", REGIME_GROWTH[phase]).otherwise(BAND_GROWTH)
    limits = sorted({m["worst"] for m in MODES.values()})
    g = j.groupBy("series_id").agg(
        *[F.max(F.when(whole, improvement(F.col(f"new_{c}"), F.col(f"old_{c}")))).alias(f"{c}_pct") for c in names],
        F.bool_or(whole & (F.col("new_mae") >= F.col("old_mae"))).alias("mae_not"),
        F.bool_or(whole & (F.col("new_rmse") >= F.col("old_rmse"))).alias("rmse_not"),
        *[F.array_sort(F.collect_list(F.when(worse(1 + x / 100), segment))).alias(f"over_{i}") for i, x in enumerate(limits)],
        F.collect_list(F.when(worse(factor), F.concat(segment, F.lit("_mae_regressed")))).alias("grown"),
    )
    mode = F.lit("failed")
    for name, least in reversed(MODES.items()):
        holds = F.size(f"over_{limits.index(least['worst'])}") == 0
        for metric, value in least.items():
            if metric != "worst":
                holds = holds & (F.col(f"{metric}_pct") >= value)
        mode = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(mode)
    g = g.join(coverage, "series_id", "left").join(interval.select("series_id", "valid", "ratio_high"), "series_id", "left")
    g = g.withColumn("mode", mode if phase == "holdout" else F.lit("development"))
    lost = lambda b: ~F.coalesce(F.col(f"candidate_{b}") >= F.col(f"champion_{b}") - COVERAGE_LOSS[b], F.lit(False))
    rules = {"overall_mae_not_improved": F.col("mae_not"), "overall_rmse_not_improved": F.col("rmse_not"), **{f"{b}_coverage_regressed": lost(b) for b in COVERAGE_LOSS}}
    if phase == "holdout":
        rules["recovery_below_threshold"] = F.col("mode") == "failed"
        rules["interval_does_not_confirm"] = ~F.coalesce(F.col("valid") & (F.col("ratio_high") < 1), F.lit(False))
    found = F.array_compact(F.array(*[F.when(c, name) for name, c in rules.items()]))
    failures = F.array_join(F.array_sort(F.concat(found, "grown")), ",")
    g = g.withColumns({"failures": failures, "regressed": F.array_join(f"over_{limits.index(MODES['balanced']['worst'])}", ",")})
    return g.select("series_id", *[f"{c}_pct" for c in names], "regressed", "mode", "failures", (F.col("failures") == "").alias("passed"))


def shadow_evidence(rows: DataFrame, candidate: str, champion: str, hours: int = 72, days: int = 2) -> DataFrame:
    """(series_id, hours, days, not_worse, status): whether a candidate that has run beside the champion has evidence
    enough - final hours and days - and is no worse on them."""
    r = rows.where(F.col(candidate).isNotNull() & F.col(champion).isNotNull() & F.col("actual_mw").isNotNull())
    mae = lambda c: F.avg(F.abs(F.col(c) - F.col("actual_mw")))
    s = r.groupBy("series_id").agg(F.count("*").alias("hours"), F.count_distinct(F.to_date("ts")).alias("days"), (mae(candidate) <= mae(champion)).alias("not_worse"))
    return s.withColumn("status", F.when((F.col("hours") < hours) | (F.col("days") < days), "collecting").when(F.col("not_worse"), "ready").otherwise("worse"))
