"""Daily reports as tables: bands, shape transitions, peaks and insight rules of every series and day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from ..operators import metrics

LARGE_BREAK, LARGE_MISS, PEAK_LEVEL, PEAK_HOURS = 1500.0, 1200.0, 800.0, 2
BREAKS, INSIGHTS = 5, 5
#: Bands of the report: name, first hour, last hour.
REPORT_BANDS = (("overnight", 0, 5), ("morning_ramp", 6, 10), ("daytime", 11, 15), ("late_afternoon", 16, 18), ("evening", 19, 23))


def band_summary(rows: DataFrame, model: str = "model_mw", reference: str = "reference_mw") -> DataFrame:
    """MAEs, the model's bias and its direction per series, day and band."""
    e, r = F.col(model) - F.col("actual_mw"), F.col(reference) - F.col("actual_mw")
    by = ["series_id", F.to_date("ts").alias("day"), S.band(F.hour("ts"), REPORT_BANDS).alias("band")]
    out = rows.groupBy(*by).agg(F.count("*").alias("hours"), F.avg(F.abs(e)).alias("model_mae"), F.avg(F.abs(r)).alias("reference_mae"), F.avg(e).alias("model_bias"))
    return out.withColumn("direction", S.error_direction(F.col("model_bias"), F.col("model_mae")))


def shape_transitions(rows: DataFrame, model: str = "model_mw", reference: str = "reference_mw") -> DataFrame:
    """Changes from each hour to the next of actual and forecasts, and the forecasts' errors in them."""
    by = W.partitionBy("series_id", F.to_date("ts")).orderBy("ts")
    delta = lambda c: F.col(c) - F.lag(c).over(by)
    t = rows.select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("to_hour"), F.lag(F.hour("ts")).over(by).alias("from_hour"), delta("actual_mw").alias("actual_delta"), delta(model).alias("model_delta"), delta(reference).alias("reference_delta"))
    t = t.where(F.col("to_hour") == F.col("from_hour") + 1)
    return t.withColumns({"model_delta_error": F.col("model_delta") - F.col("actual_delta"), "reference_delta_error": F.col("reference_delta") - F.col("actual_delta")})


def shape_breaks(transitions: DataFrame, least: float = LARGE_BREAK, most: int = BREAKS) -> DataFrame:
    """The largest errors in shape of each day."""
    size = F.abs("model_delta_error")
    rank = F.row_number().over(W.partitionBy("series_id", "day").orderBy(F.round(size, 6).desc(), "to_hour"))
    return transitions.where(size >= least).withColumn("rank", rank).where(F.col("rank") <= most)


def peak_summary(rows: DataFrame, model: str = "model_mw") -> DataFrame:
    """Hours and levels of the actual and the model's peak, and the model's error at the actual one."""
    at = lambda c, *more: F.max(F.struct(F.col(c).alias("v"), (-F.hour("ts")).alias("h"), *more))
    p = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(at("actual_mw", F.col(model).alias("m")).alias("a"), at(model).alias("m"))
    return p.select("series_id", "day", F.col("a.v").alias("actual_peak"), (-F.col("a.h")).alias("actual_hour"), F.col("m.v").alias("model_peak"), (-F.col("m.h")).alias("model_hour"), (F.col("a.m") - F.col("a.v")).alias("error_at_peak"), (F.col("a.h") - F.col("m.h")).alias("time_error"))


def insights(rows: DataFrame, scale: float = 1.0, most: int = INSIGHTS) -> DataFrame:
    """(series_id, day, rank, code, severity, value): the first rules that hold for a day, in their order. ``scale``
    multiplies every limit in MW; a rule that holds for several bands counts once."""
    day = metrics.scorecard(rows, "model_mw", "reference_mw", F.col("series_id"), F.to_date("ts").alias("day"), scale=scale)
    gap = F.col("model_mae") - F.col("reference_mae")
    bands, peak = band_summary(rows), peak_summary(rows)
    worst = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.max(F.abs(F.col("model_mw") - F.col("actual_mw"))).alias("miss"))
    breaks = shape_breaks(shape_transitions(rows), LARGE_BREAK * scale, 1)

    def rule(table: DataFrame, order: int, code: str, severity: str, holds: Column, value: Column) -> DataFrame:
        return table.where(holds).select("series_id", "day", F.lit(order).alias("order"), F.lit(code).alias("code"), F.lit(severity).alias("severity"), value.alias("value"))

    c, of = F.col, lambda band, limit: (F.col("band") == band) & (F.col("model_bias") <= limit * scale)
    found = [
        rule(day, 1, "model_closer_overall", "info", c("verdict") == "model_better", gap),
        rule(day, 2, "reference_closer_overall", "warning", c("verdict") == "reference_better", gap),
        rule(day, 3, "mixed_assessment", "info", c("verdict") == "mixed", gap),
        rule(bands, 4, "morning_ramp_underestimated", "warning", of("morning_ramp", -500.0), c("model_bias")),
        rule(bands, 5, "morning_ramp_overestimated", "info", (c("band") == "morning_ramp") & (c("model_bias") >= 500.0 * scale), c("model_bias")),
        rule(bands, 6, "daytime_level_underestimated", "warning", of("daytime", -700.0), c("model_bias")),
        rule(bands, 7, "afternoon_plateau_underestimated", "warning", of("late_afternoon", -500.0), c("model_bias")),
        rule(worst, 8, "large_single_hour_miss", "warning", c("miss") >= LARGE_MISS * scale, c("miss")),
        rule(breaks, 9, "sharp_model_drop_mismatch", "warning", c("model_delta_error") < 0, c("model_delta_error")),
        rule(breaks, 10, "sharp_model_rise_mismatch", "warning", c("model_delta_error") > 0, c("model_delta_error")),
        rule(peak, 11, "peak_timing_miss", "warning", F.abs("time_error") >= PEAK_HOURS, c("time_error").cast("double")),
        rule(peak, 12, "peak_level_underestimated", "warning", c("error_at_peak") <= -PEAK_LEVEL * scale, c("error_at_peak")),
        rule(peak, 13, "peak_level_overestimated", "info", c("error_at_peak") >= PEAK_LEVEL * scale, c("error_at_peak")),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    rank = F.row_number().over(W.partitionBy("series_id", "day").orderBy("order"))
    return every.withColumn("rank", rank).where(F.col("rank") <= most).drop("order")
