"""Correction of the rest of a day from the residuals of its observed hours.

Residuals, last observed hour and slopes are one row for each series and day; every rule joins that row to the hours
after it. Bands move with the point forecast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S

LOOKBACK, LEAST_OBSERVED, SHRINK, CAP, DECAY = 3, 3, 0.6, 1200.0, 0.92
EARLY_LEAST, EARLY_SHRINK, EARLY_CAP = 500.0, 0.5, 700.0
CARRY_SHRINK, CARRY_DECAY, CARRY_HOURS, CARRY_CAP = 0.5, 0.75, 8, 500.0
RISE, DROP, DROP_RELAXED = (1800.0, 2400.0, 3000.0), (1600.0, 2600.0, 3600.0), (1600.0, 2800.0, 4200.0)
GUARD_FROM, RELAX_DROP = 10, 500.0


def residual_context(rows: DataFrame) -> DataFrame:
    """One row for each series and day of (series_id, ts, actual_mw, forecast_mw), with null actuals ahead: last
    observed hour and value, residual count, mean of the last residuals, their sign agreement, last two slopes."""
    r = rows.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")}).where("actual_mw is not null and forecast_mw is not null")
    by = W.partitionBy("series_id", "day").orderBy(F.desc("hour"))
    r = r.withColumns({"residual": F.col("actual_mw") - F.col("forecast_mw"), "i": F.row_number().over(by), "slope": F.col("actual_mw") - F.lead("actual_mw").over(by)})
    late = lambda c: F.when(F.col("i") <= LOOKBACK, c)
    return r.groupBy("series_id", "day").agg(
        F.count("*").alias("n_observed"),
        F.max("hour").alias("last_hour"),
        F.max_by("actual_mw", "hour").alias("last_mw"),
        F.max_by("residual", "hour").alias("last_residual"),
        F.avg(late(F.col("residual"))).alias("mean_residual"),
        F.abs(F.sum(F.signum("residual"))).alias("sign_sum"),
        F.avg("residual").alias("all_residual"),
        F.max(F.when(F.col("i") == 1, F.col("slope"))).alias("slope_1"),
        F.max(F.when(F.col("i") == 2, F.col("slope"))).alias("slope_0"),
    )


def correct(rows: DataFrame) -> DataFrame:
    """rows plus adjustment_mw, corrected_mw and reasons. With three residuals or more: their mean, shrunk, capped and
    fading with the lead. With two of one sign: an early carry-over. With none: the last residual of the day before,
    fading with its age. Near hours are kept within a ramp around the last actual. Observed hours never change."""
    context = residual_context(rows)
    yesterday = context.select("series_id", F.date_add("day", 1).alias("day"), F.col("last_residual").alias("carried"), F.col("last_hour").alias("carried_hour"))
    r = rows.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")}).join(context, ["series_id", "day"], "left").join(yesterday, ["series_id", "day"], "left")
    n, lead = F.coalesce("n_observed", F.lit(0)), F.col("hour") - F.coalesce("last_hour", F.lit(-1))
    base = S.clip(F.col("mean_residual") * SHRINK, -CAP, CAP) * F.pow(F.lit(DECAY), lead - 1)
    early = F.when((F.col("sign_sum") == 2) & (F.abs("all_residual") >= EARLY_LEAST), S.clip(F.col("all_residual") * EARLY_SHRINK, -EARLY_CAP, EARLY_CAP) * F.pow(F.lit(DECAY), lead - 1))
    age = F.col("hour") + 24 - F.col("carried_hour")
    carry = F.when(age <= CARRY_HOURS, S.clip(F.col("carried") * CARRY_SHRINK * F.pow(F.lit(CARRY_DECAY), age), -CARRY_CAP, CARRY_CAP))
    rule = F.when(n >= LEAST_OBSERVED, "residual_mean").when(early.isNotNull() & (n == 2), "early_carryover").when(carry.isNotNull() & (n < 2), "day_boundary")
    shift = F.when(n >= LEAST_OBSERVED, base).when(n == 2, early).otherwise(carry)
    ahead = lead > 0
    moved = F.col("forecast_mw") + F.coalesce(shift, F.lit(0.0))
    relaxed = F.coalesce(-(F.coalesce("slope_0", F.lit(0.0)) + F.col("slope_1")) >= RELAX_DROP, F.lit(False))
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.least(F.greatest(lead, F.lit(1)), F.lit(3)).cast("int"))
    low = F.col("last_mw") - F.when(relaxed, at(DROP_RELAXED)).otherwise(at(DROP))
    guarded = (F.col("last_hour") >= GUARD_FROM) & (lead <= 3)
    final = F.when(ahead & F.coalesce(guarded, F.lit(False)), F.greatest(low, F.least(F.col("last_mw") + at(RISE), moved))).when(ahead, moved).otherwise(F.col("forecast_mw"))
    reasons = F.array_compact(F.array(F.when(ahead & (F.coalesce(shift, F.lit(0.0)) != 0), rule), F.when(ahead & (F.abs(final - moved) > 1e-9), "ramp_guard")))
    columns = [c for c in rows.columns]
    return r.select(*columns, (final - F.col("forecast_mw")).alias("adjustment_mw"), final.alias("corrected_mw"), F.array_join(reasons, ",").alias("reasons"))
