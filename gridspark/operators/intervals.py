"""Calibration of forecast bands: half widths, conformal floors, regime shifts, band assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from .metrics import conformal_quantile

FLOOR, CAP, SCALE = 500.0, 3000.0, 1.25
ASYMMETRY, ASYMMETRY_BASE, REBALANCE = 2.5, 900.0, 1.6
WINDOW_DAYS, COVERAGE, LEAST_HOURS = 28, 0.95, 24


def calibrated_half_widths(lower: Column, upper: Column, least: Column | float | None = None) -> tuple[Column, Column]:
    """Ordered, floored, capped and rebalanced half widths of a band; ``least`` raises the floor of a row."""
    floor = F.lit(FLOOR)
    if least is not None:
        least = least if isinstance(least, Column) else F.lit(least)
        floor = F.least(F.greatest(floor, F.coalesce(F.when(least > 0, least), floor)), F.lit(CAP))
    lo, hi = F.greatest(F.coalesce(lower, F.lit(0.0)), floor), F.greatest(F.coalesce(upper, F.lit(0.0)), floor)

    def capped(own: Column, other: Column) -> Column:
        cap = F.least(F.lit(CAP), F.greatest(other, F.greatest(floor, F.lit(ASYMMETRY_BASE))) * ASYMMETRY)
        return F.greatest(F.least(own, F.greatest(floor, cap)), floor)

    lo, hi = capped(lo, hi), capped(hi, lo)
    large, small, total = F.greatest(lo, hi), F.least(lo, hi), lo + hi
    new_small = F.greatest(floor, total / (REBALANCE + 1))
    new_large = F.least(F.least(F.greatest(floor, total - new_small), new_small * REBALANCE), F.lit(CAP))
    new_small = F.least(new_small, F.lit(CAP))
    uneven = large > small * REBALANCE
    out = [F.when(uneven, F.when(own >= other, new_large).otherwise(new_small)).otherwise(own) for own, other in ((lo, hi), (hi, lo))]
    # Equal sides are never uneven, so the larger one is one of the two.
    return out[0] * SCALE, out[1] * SCALE


def assemble_bands(rows: DataFrame, least: str | None = None) -> DataFrame:
    """Bands around forecast_mw from raw q025 and q975 columns: calibrated 95 %, and one more half width for 99 %."""
    f = F.col("forecast_mw")
    lo, hi = calibrated_half_widths(f - F.least("q025", "forecast_mw"), F.greatest("q975", "forecast_mw") - f, F.col(least) if least else None)
    return rows.withColumns({"p95_lower_mw": f - lo, "p95_upper_mw": f + hi, "p99_lower_mw": f - 2 * lo, "p99_upper_mw": f + 2 * hi})


def conformal_floors(rows: DataFrame, targets: DataFrame, calendar: DataFrame, forecast: str = "model_mw", days: int = WINDOW_DAYS, share: float = COVERAGE, least: int = LEAST_HOURS) -> DataFrame:
    """(series_id, target, band, n, floor_mw): the conformal quantile of absolute errors of the last ``days`` complete
    days before each target that have its day type, within the widths that bands may have."""
    off = calendar.select("day", "is_off")
    r = rows.withColumns({"day": F.to_date("ts"), "band": S.band(F.hour("ts")), "abs_error": F.abs(F.col(forecast) - F.col("actual_mw"))})
    complete = r.groupBy("series_id", "day").agg(F.count_distinct(F.hour("ts")).alias("h")).where("h = 24").select("series_id", "day").join(F.broadcast(off), "day")
    t = targets.join(F.broadcast(off.withColumnRenamed("day", "target").withColumnRenamed("is_off", "target_off")), "target")
    # Complete days are numbered; targets stand among them as markers and take the number before, so each meets its
    # ``days`` numbers by an equi-join, however long the series.
    numbered = complete.withColumn("k", F.row_number().over(W.partitionBy("series_id").orderBy("day")))
    facts = numbered.select("series_id", "day", F.lit(1).alias("fact"), "k", F.lit(None).cast("boolean").alias("target_off"))
    marks = t.select("series_id", F.col("target").alias("day"), F.lit(0).alias("fact"), F.lit(None).cast("int").alias("k"), "target_off").distinct()
    upto = W.partitionBy("series_id").orderBy("day", "fact").rowsBetween(W.unboundedPreceding, 0)
    last = facts.unionByName(marks).withColumn("last", F.max("k").over(upto)).where("fact = 0 and last is not null")
    near = last.select("series_id", F.col("day").alias("target"), "target_off", F.explode(F.sequence(F.greatest(F.lit(1), F.col("last") - days + 1), F.col("last"))).alias("k"))
    picked = near.join(numbered, ["series_id", "k"]).where(F.col("is_off") == F.col("target_off")).select("series_id", "target", "day")
    q = conformal_quantile(picked.join(r, ["series_id", "day"]), F.col("abs_error"), share, "series_id", "target", "band")
    return q.where(F.col("n") >= least).select("series_id", "target", "band", "n", S.clip(F.col("quantile"), FLOOR, CAP).alias("floor_mw"))


def regime_shift(daily_errors: DataFrame, share: float = 0.25, cap: float = 1000.0, last: int = 3) -> DataFrame:
    """(series_id, day, regime, shift_mw): a quarter of the median mean residual of the last days of the same regime,
    capped; from rows (series_id, day, regime, residual)."""
    past = W.partitionBy("series_id", "regime").orderBy("day").rowsBetween(-last, -1)
    held = F.sort_array(F.collect_list("residual").over(past))
    n = F.size(held)
    middle = (F.get(held, F.floor((n - 1) / 2).cast("int")) + F.get(held, F.floor(n / 2).cast("int"))) / 2
    shift = S.clip(middle * share, -cap, cap)
    return daily_errors.select("series_id", "day", "regime", F.when(F.abs(shift) >= 0.05, shift).otherwise(0.0).alias("shift_mw"))
