"""Diagnostics of a forecast by stage, regime, band and day; all are grouped sums over error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S


def stage_rows(rows: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """Long rows (series_id, ts, actual_mw, stage_order, stage, value) of a column for each stage, in their order."""
    each = F.array(*[F.struct(F.lit(i).alias("stage_order"), F.lit(s).alias("stage"), F.col(s).alias("value")) for i, s in enumerate(stages)])
    return rows.select("series_id", "ts", "actual_mw", F.explode(each).alias("x")).select("series_id", "ts", "actual_mw", "x.*")


def stage_metrics(long: DataFrame) -> DataFrame:
    """(series_id, stage, n, mae, bias, rmse) of each stage."""
    e = F.col("value") - F.col("actual_mw")
    return long.groupBy("series_id", "stage").agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))


def stage_deltas(long: DataFrame) -> DataFrame:
    """long plus delta: the change against the stage before; the first has none."""
    return long.withColumn("delta", F.col("value") - F.lag("value").over(W.partitionBy("series_id", "ts").orderBy("stage_order")))


def top_stage_shifts(long: DataFrame, most: int = 5) -> DataFrame:
    """(series_id, day, hour, net, largest, rank): the hours of a day whose stages move the forecast most."""
    d = stage_deltas(long).groupBy("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg((F.max_by("value", "stage_order") - F.min_by("value", "stage_order")).alias("net"), F.max(F.abs("delta")).alias("largest"))
    size = F.round(F.greatest(F.abs("net"), F.coalesce("largest", F.lit(0.0))), 6)
    return d.withColumn("rank", F.row_number().over(W.partitionBy("series_id", "day").orderBy(size.desc(), "hour"))).where(F.col("rank") <= most)


def coverage_bundle(rows: DataFrame, regime: str, lower: str = "p95_lower_mw", upper: str = "p95_upper_mw") -> DataFrame:
    """(series_id, regime, band, n, coverage_pct, above, below, mean_width) overall, by regime and by band."""
    r = rows.withColumns({"regime": F.col(regime), "band": S.band(F.hour("ts"))})
    inside = F.col("actual_mw").between(F.col(lower), F.col(upper))
    return r.groupingSets([["series_id"], ["series_id", "regime"], ["series_id", "band"]], "series_id", "regime", "band").agg(
        F.count("*").alias("n"), (F.avg(inside.cast("int")) * 100).alias("coverage_pct"), F.count_if(F.col("actual_mw") > F.col(upper)).alias("above"), F.count_if(F.col("actual_mw") < F.col(lower)).alias("below"), F.avg(F.col(upper) - F.col(lower)).alias("mean_width")
    )


def shadow_half_width(rows: DataFrame, regime: str, forecast: str, least: int = 24) -> DataFrame:
    """(series_id, regime, band, n, half_width): the 95 % quantile of absolute errors by regime and by band where there
    are hours enough."""
    r = rows.withColumns({"regime": F.col(regime), "band": S.band(F.hour("ts")), "e": F.abs(F.col(forecast) - F.col("actual_mw"))})
    q = r.groupingSets([["series_id", "regime"], ["series_id", "band"]], "series_id", "regime", "band").agg(F.count("e").alias("n"), F.percentile("e", 0.95).alias("half_width"))
    return q.where(F.col("n") >= least)


def band_history(rows: DataFrame, forecast: str, days: int = 7, miss: float = 0.0) -> DataFrame:
    """(series_id, band, days, over, under, bias, mae, repeated): the last ``days`` days of each series by band; a band
    misses repeatedly if most of its days err beyond ``miss`` in one direction."""
    d = rows.withColumns({"day": F.to_date("ts"), "band": S.band(F.hour("ts")), "e": F.col(forecast) - F.col("actual_mw")})
    recent = d.select("series_id", "day").distinct().withColumn("i", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("day")))).where(F.col("i") <= days).drop("i")
    by_day = d.join(recent, ["series_id", "day"]).groupBy("series_id", "band", "day").agg(F.avg("e").alias("bias"), F.avg(F.abs("e")).alias("mae"))
    out = by_day.groupBy("series_id", "band").agg(F.count("*").alias("days"), F.count_if(F.col("bias") > miss).alias("over"), F.count_if(F.col("bias") < -miss).alias("under"), F.avg("bias").alias("bias"), F.avg("mae").alias("mae"))
    return out.withColumn("repeated", 2 * F.greatest("over", "under") > F.col("days"))


def day_summary(rows: DataFrame) -> DataFrame:
    """(series_id, day, peak_mw, peak_hour, peak_is_actual, n_actual): actuals, with the reference forecast for hours that have none."""
    r = rows.withColumn("value", F.coalesce("actual_mw", "reference_mw")).where("value is not null")
    first = F.struct("value", -F.hour("ts"))
    d = r.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("peak_mw"), F.max_by(F.struct(F.hour("ts").alias("h"), F.col("actual_mw").isNotNull().alias("a")), first).alias("x"), F.count("actual_mw").alias("n_actual"))
    return d.select("series_id", "day", "peak_mw", F.col("x.h").alias("peak_hour"), F.col("x.a").alias("peak_is_actual"), "n_actual")


def focus_hours(sources: dict[str, tuple[int, DataFrame]], most: int = 12) -> DataFrame:
    """(series_id, day, hour, score, kinds): hours named by several sources of (weight, (series_id, day, hour)); the
    ``most`` with the largest sum of weights, earliest first of equals."""
    long = None
    for kind, (weight, df) in sorted(sources.items()):
        part = df.select("series_id", "day", "hour", F.lit(weight).alias("weight"), F.lit(kind).alias("kind")).distinct()
        long = part if long is None else long.union(part)
    hours = long.groupBy("series_id", "day", "hour").agg(F.sum("weight").alias("score"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    return hours.withColumn("rank", F.row_number().over(W.partitionBy("series_id", "day").orderBy(F.desc("score"), "hour"))).where(F.col("rank") <= most).drop("rank")


def range_check(rows: DataFrame, value: str, low: float, high: float, examples: int = 3) -> DataFrame:
    """(series_id, day, n, out_of_range, negative, all_zero, examples): values beyond [low, high], the first few by time."""
    bad = ~F.col(value).between(low, high)
    d = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count(value).alias("n"), F.count_if(bad).alias("out_of_range"), F.count_if(F.col(value) < 0).alias("negative"), F.bool_and(F.col(value) == 0).alias("all_zero"), F.array_sort(F.collect_list(F.when(bad, F.hour("ts")))).alias("hours"))
    return d.withColumn("examples", F.array_join(F.slice("hours", 1, examples), ",")).drop("hours")


def source_summary(rows: DataFrame, observed: str = "observed", fallback: str = "reference_forecast_fallback") -> DataFrame:
    """(series_id, day, rows, comparable, observed, fallback, state): what a day's rows came from, and whether the day is
    final (24 hours, none by fallback), final_with_fallback or intraday."""
    d = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(
        F.count("*").alias("rows"), F.count_if(F.col("actual_mw").isNotNull() & F.col("model_mw").isNotNull()).alias("comparable"), F.count_if(F.col("actual_source") == observed).alias("observed"), F.count_if(F.col("actual_source") == fallback).alias("fallback"), F.count("actual_mw").alias("held")
    )
    return d.withColumn("state", F.when(F.col("held") < 24, "intraday").when(F.col("fallback") > 0, "final_with_fallback").otherwise("final")).drop("held")


def expected_severity(forecast: DataFrame, supply: DataFrame, warning: float = 92.0, critical: float = 97.0) -> DataFrame:
    """(series_id, day, peak_ts, usage_pct, severity) of a forecast day: its peak against the supply of that hour, or else
    the upper quartile of the series' supply. supply: (series_id, ts, supply_mw)."""
    peak = forecast.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.max_by(F.struct("ts", "forecast_mw"), F.struct("forecast_mw", -F.hour("ts"))).alias("x")).select("series_id", "day", F.col("x.ts").alias("ts"), "x.forecast_mw")
    usual = supply.groupBy("series_id").agg(F.percentile("supply_mw", 0.75).alias("usual_mw"))
    r = peak.join(supply, ["series_id", "ts"], "left").join(usual, "series_id", "left")
    pct = 100 * F.col("forecast_mw") / F.nullif(F.coalesce("supply_mw", "usual_mw"), F.lit(0.0))
    severity = F.when(pct >= critical, "critical").when(pct >= warning, "warning").when(pct.isNotNull(), "normal")
    return r.select("series_id", "day", F.col("ts").alias("peak_ts"), pct.alias("usage_pct"), severity.alias("severity"))


def windows_not_worse(rows: DataFrame, candidate: str, champion: str, windows: tuple[int, ...]) -> DataFrame:
    """(series_id, windows, passes): whether a candidate's MAE and WAPE are no worse than the champion's over each of the
    last n days, and how many windows have rows."""
    last = F.max(F.to_date("ts")).over(W.partitionBy("series_id"))
    r = rows.withColumns({"age": F.datediff(last, F.to_date("ts")), "window": F.explode(F.array(*[F.lit(n) for n in windows]))}).where("age < window")
    size = lambda c: F.avg(F.abs(F.col(c) - F.col("actual_mw")))
    share = lambda c: F.sum(F.abs(F.col(c) - F.col("actual_mw"))) / F.sum(F.abs("actual_mw"))
    m = r.groupBy("series_id", "window").agg(((size(candidate) <= size(champion)) & (share(candidate) <= share(champion))).alias("ok"))
    return m.groupBy("series_id").agg(F.count("*").alias("windows"), F.bool_and("ok").alias("passes"))


def area_benchmark(rows: DataFrame, served: DataFrame | None = None) -> DataFrame:
    """(series_id, scope, n, mae, bias, wape) of a published forecast: all hours, hours 9 to 18, and (with ``served``) the
    hours for which both are known, for either of them."""
    e = lambda c: F.col(c) - F.col("actual_mw")
    scopes = [("all", F.lit(True), "reference_mw"), ("9-18", F.hour("ts").between(9, 18), "reference_mw")]
    if served is not None:
        rows = rows.join(served, ["series_id", "ts"], "left")
        scopes += [("matched_reference", F.col("served_mw").isNotNull(), "reference_mw"), ("matched_served", F.col("served_mw").isNotNull(), "served_mw")]
    each = F.explode(F.array_compact(F.array(*[F.when(on, F.struct(F.lit(name).alias("scope"), e(c).alias("e"))) for name, on, c in scopes]))).alias("x")
    long = rows.select("series_id", "actual_mw", each).select("series_id", "actual_mw", "x.scope", "x.e")
    return long.groupBy("series_id", "scope").agg(F.count("e").alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("bias"), (F.sum(F.abs("e")) * 100 / F.sum(F.abs("actual_mw"))).alias("wape"))


def first_wins(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """Of rows with equal keys the first in ``order``."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rows.columns), order).alias("x")).select("x.*")


def band_quality(rows: DataFrame, forecast: str, miss: float = 1000.0) -> DataFrame:
    """(series_id, day, hours, inside95, inside99, outside95_hours, width95, width99, covered_misses) of a day's bands:
    hours inside, the hours outside, median half widths, and large errors that the 95 % band still held."""
    inside = lambda p: F.col("actual_mw").between(F.col(f"p{p}_lower_mw"), F.col(f"p{p}_upper_mw"))
    width = lambda p: F.median((F.col(f"p{p}_upper_mw") - F.col(f"p{p}_lower_mw")) / 2)
    outside = F.array_join(F.array_sort(F.collect_list(F.when(~inside(95), F.hour("ts")))), ",")
    return rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("hours"), F.count_if(inside(95)).alias("inside95"), F.count_if(inside(99)).alias("inside99"), outside.alias("outside95_hours"), width(95).alias("width95"), width(99).alias("width99"), F.count_if((F.abs(F.col(forecast) - F.col("actual_mw")) >= miss) & inside(95)).alias("covered_misses"))


def freeze_gaps(rows: DataFrame, published: str, recalculated: str, least: float = 300.0, most: int = 3) -> DataFrame:
    """(series_id, day, hour, gap, rank): the hours of a day whose published forecast is farthest from the one that would
    be made now."""
    gap = F.col(published) - F.col(recalculated)
    g = rows.select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), gap.alias("gap")).where(F.abs("gap") >= least)
    return g.withColumn("rank", F.row_number().over(W.partitionBy("series_id", "day").orderBy(F.round(F.abs("gap"), 6).desc(), "hour"))).where(F.col("rank") <= most)


def day_context(calendar: DataFrame, run: int = 3, since: int = 1) -> DataFrame:
    """(day, post_holiday_early_morning): the first days after a long run of days off."""
    return calendar.select("day", ((F.col("run_before") >= run) & (F.col("days_since_off") <= since)).alias("post_holiday_early_morning"))


def regime_ledger(rows: DataFrame, forecast: str, calendar: DataFrame, last: int = 60) -> DataFrame:
    """(series_id, regime, day, residual, rank): mean residuals of complete days by day type, the latest ``last`` of each."""
    off = calendar.select("day", F.when(F.col("is_off"), "non_business").otherwise("business").alias("regime"))
    d = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.avg(F.col("actual_mw") - F.col(forecast)).alias("residual"), F.count_distinct(F.hour("ts")).alias("hours")).where("hours = 24").drop("hours")
    d = d.join(F.broadcast(off), "day")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("series_id", "regime").orderBy(F.desc("day")))).where(F.col("rank") <= last)
