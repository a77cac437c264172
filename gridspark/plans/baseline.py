"""The seasonal baseline forecast for all target days of all series in one query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import Z95, Z99

WEEKS, YEARS, SEASON_DAYS, HOLIDAY_DAYS, LEAST = 12, 5, 28, 30, 4


def _bands(grouped) -> DataFrame:
    return grouped.agg(F.avg("actual_mw").alias("forecast_mw"), F.coalesce(F.stddev_samp("actual_mw"), F.lit(0.0)).alias("sd"), F.count("actual_mw").alias("n"))


def seasonal_baseline(hourly: DataFrame, targets: DataFrame, calendar: DataFrame, weeks: int = WEEKS, least: int = LEAST) -> DataFrame:
    """(series_id, ts, forecast_mw, p95/p99 bands, n) for every (series_id, target) day and hour with enough history.

    A working target uses the same weekday of the last weeks and of the same season in the years before, without
    holidays. A holiday uses holidays of the season in the years before, if they are on enough days, else the former.
    A target is exploded to the days it may read - at most 12 and 5 x 9 of its weekday, or 5 x 61 around a holiday - and
    meets history by (series, day), so cost grows with the targets and no series is one group.
    """
    off = calendar.select("day", "is_holiday")
    h = hourly.where("actual_mw is not null").withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")}).join(F.broadcast(off), "day")
    t = targets.join(F.broadcast(off.withColumnRenamed("day", "target").withColumnRenamed("is_holiday", "target_holiday")), "target")

    def season(days: int, step: int):
        """Days around the target's place in the year, of each of the years before; with step 7 of its weekday."""

        def of_year(age):
            start = F.make_date(F.year("target") - age, F.lit(1), F.lit(1))
            first = F.date_add(start, F.greatest(F.lit(0), F.dayofyear("target") - days - 1))
            last = F.date_add(start, F.least(F.lit(364), F.dayofyear("target") + days - 1))
            first = F.date_add(first, F.pmod(F.weekday("target") - F.weekday(first), F.lit(step)))
            return F.filter(F.sequence(first, F.greatest(first, last), F.expr(f"INTERVAL {step} DAYS")), lambda day: day <= last)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(YEARS)), of_year))

    recent = F.sequence(F.date_sub("target", 7 * weeks), F.date_sub("target", 7), F.expr("INTERVAL 7 DAYS"))
    reads = lambda df, days: df.select("series_id", "target", F.explode(days).alias("day"))
    usual = reads(t, F.array_distinct(F.concat(recent, season(SEASON_DAYS, 7)))).join(h.where(~F.col("is_holiday")), ["series_id", "day"])
    rest = reads(t.where("target_holiday"), season(HOLIDAY_DAYS, 1)).join(h.where("is_holiday"), ["series_id", "day"])
    enough = rest.groupBy("series_id", "target").agg(F.count_distinct("day").alias("days")).where(F.col("days") >= least).select("series_id", "target")
    columns = ["series_id", "target", "hour", "actual_mw"]
    rows = usual.join(enough, ["series_id", "target"], "left_anti").select(columns).unionByName(rest.join(enough, ["series_id", "target"], "left_semi").select(columns))
    f = _bands(rows.groupBy("series_id", "target", "hour")).where(F.col("n") >= least)
    m, s = F.col("forecast_mw"), F.col("sd")
    at = (F.col("target").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))).alias("ts")
    return f.select("series_id", at, "forecast_mw", (m - Z95 * s).alias("p95_lower_mw"), (m + Z95 * s).alias("p95_upper_mw"), (m - Z99 * s).alias("p99_lower_mw"), (m + Z99 * s).alias("p99_upper_mw"), "n")
