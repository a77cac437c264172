"""Rules of the intraday correction beyond the mean residual: day level, changes of day type, damping, floors.

Rows are hours with their features, forecast_mw and actual_mw (null ahead). ``observed`` adds what the day has shown so
far, one row for each series and day joined to its hours; a rule is an expression over a row then, in MW. ``scale``
multiplies every limit in MW.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def observed(rows: DataFrame) -> DataFrame:
    """rows plus n_observed, last_hour, lead and the last three observed hours: a1, a2, a3 (the latest) and residuals r1,
    r2, r3, known only if the three hours follow each other."""
    r = rows.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")})
    seen = r.where("actual_mw is not null and forecast_mw is not null").groupBy("series_id", "day").agg(F.sort_array(F.collect_list(F.struct("hour", "actual_mw", (F.col("actual_mw") - F.col("forecast_mw")).alias("residual")))).alias("x"))
    last = lambda k: F.get(F.col("x"), F.size("x") - k)
    running = (last(1)["hour"] - last(2)["hour"] == 1) & (last(2)["hour"] - last(3)["hour"] == 1)
    of = {f"{c}{3 - k}": F.when(running, last(k + 1)[f]) for c, f in (("a", "actual_mw"), ("r", "residual")) for k in range(3)}
    residuals = F.slice("x", F.greatest(F.size("x") - 2, F.lit(1)), 3)
    mean = F.aggregate(residuals, F.lit(0.0), lambda a, v: a + v["residual"]) / F.size(residuals)
    seen = seen.select("series_id", "day", F.size("x").alias("n_observed"), last(1)["hour"].alias("last_hour"), mean.alias("mean_residual"), *[c.alias(n) for n, c in of.items()])
    # The features of the last observed hour decide where a rule looks at that hour.
    at = r.select("series_id", "day", F.col("hour").alias("last_hour"), *[F.col(c).alias(f"{n}_then") for c, n in (("is_non_business_day", "off"), ("lag_24h_business_type_mismatch", "mismatch"), ("recent_same_business_type_mean", "usual"), ("lag_24h", "lag"))])
    seen = seen.join(at, ["series_id", "day", "last_hour"], "left")
    return r.join(seen, ["series_id", "day"], "left").withColumns({"n_observed": F.coalesce("n_observed", F.lit(0)), "lead": F.col("hour") - F.coalesce("last_hour", F.lit(-1))})


def day_level_scale(overheat: float = 600.0, drop: float = 1.5, weight: float = 0.25, most: float = 700.0, fade_hours: int = 3, heating: float = 7.0, scale: float = 1.0) -> Column:
    """Yesterday far over the usual level and a cooler day: part of the excess comes off, fading as hours are observed."""
    over, cooler = F.col("lag_24h") - F.col("recent_same_business_type_mean"), -F.col("temp_delta_24h")
    fade = F.greatest(F.lit(0.0), 1 - F.col("n_observed") / fade_hours)
    on = (over > overheat * scale) & (cooler > drop) & (F.coalesce("heating_degree", F.lit(0.0)) <= heating) & (fade > 0)
    return F.when(on, S.clip(-(over - overheat * scale) * weight * F.least(F.lit(1.0), cooler / 5) * fade, -most * scale, most * scale))


def _hot_return(overheat: float, scale: float) -> Column:
    """An off day after a working day whose level was far over the usual one of off days."""
    return (F.col("lead") > 0) & (F.col("lag_24h_business_type_mismatch") > 0) & (F.col("is_non_business_day") == 1) & (F.col("lag_24h") - F.col("recent_same_business_type_mean") > overheat * scale)


def transition_bias(from_hour: int = 6, residual: float = -300.0, overheat: float = 1500.0, allowed: float = 900.0, per_anomaly: float = 120.0, per_degree: float = 160.0, most_weather: float = 900.0, share: float = 0.55, most: float = 1200.0, scale: float = 1.0) -> Column:
    """Residuals of the morning are clearly negative: what the forecast has over the usual level, an allowance and one
    for the weather comes off in part."""
    warm = F.greatest(F.lit(0.0), F.coalesce("temp_anomaly_7d", F.lit(0.0))) * per_anomaly + F.greatest(F.lit(0.0), F.coalesce("cooling_degree", F.lit(0.0))) * per_degree
    over = F.col("forecast_mw") - (F.col("recent_same_business_type_mean") + allowed * scale + F.least(F.lit(most_weather * scale), warm * scale))
    on = (F.col("last_hour") >= from_hour) & (F.col("mean_residual") <= residual * scale) & _hot_return(overheat, scale) & (over > 0)
    return F.when(on, -F.least(F.lit(most * scale), over * share))


def transition_prior(off_hour: int = 6, overheat: float = 1500.0, allowed: float = 900.0, share: float = 0.25, most: float = 500.0, scale: float = 1.0) -> Column:
    """The same before the morning is observed, weaker and without the weather."""
    over = F.col("forecast_mw") - (F.col("recent_same_business_type_mean") + allowed * scale)
    on = F.coalesce(F.col("last_hour") < off_hour, F.lit(True)) & _hot_return(overheat, scale) & (over > 0)
    return F.when(on, -F.least(F.lit(most * scale), over * share))


def positive_multiplier(off_hour: int = 6, hours: tuple[int, int] = (6, 11), overheat: float = 1500.0, allowed: float = 900.0, multiplier: float = 0.0, scale: float = 1.0) -> Column:
    """What is kept of positive residuals of the night in the morning of such a day."""
    on = (F.col("last_hour") < off_hour) & F.col("hour").between(*hours) & _hot_return(overheat, scale) & (F.col("forecast_mw") > F.col("recent_same_business_type_mean") + allowed * scale)
    return F.when(F.coalesce(on, F.lit(False)), multiplier).otherwise(1.0)


def capped_stack(before: Column, after: Column, most_observed: int = 1, most: float = 900.0, scale: float = 1.0) -> Column:
    """``after``, with priors that together take off too much before anything is observed held to a limit."""
    low = before - most * scale
    return F.when((F.col("n_observed") <= most_observed) & (F.col("lead") > 0) & (after < low), low).otherwise(after)


def recovery_factor(slope: float = 1000.0, tolerance: float = 1200.0, factor: float = 0.4, strong: float = 0.2, strong_slope: float = 500.0, scale: float = 1.0) -> Column:
    """What is kept of a negative correction where an off day after a working day recovers: demand rises, is near the
    usual level or over it, and its negative residuals shrink hour by hour."""
    c = F.col
    mean, steepest = (c("a3") - c("a1")) / 2, F.greatest(c("a2") - c("a1"), c("a3") - c("a2"))
    on = (c("mean_residual") < 0) & (mean > 0) & (steepest >= slope * scale) & (c("off_then") == 1) & (c("mismatch_then") > 0) & (c("lag_then") > c("usual_then")) & (c("a3") >= c("usual_then") - tolerance * scale) & (c("r3") < 0) & (c("r1") < c("r2")) & (c("r2") < c("r3"))
    kept = F.when((mean >= strong_slope * scale) & (c("a3") >= c("usual_then")), min(factor, strong)).otherwise(factor)
    return F.when(F.coalesce(on, F.lit(False)), kept).otherwise(1.0)


def slope_factor(base: Column, from_hour: int = 12, base_least: float = 300.0, residual: float = 300.0, improved: float = 300.0, slower: float = 500.0, drop: float = 300.0, latest: float = 400.0, tolerance: float = 1200.0, factor: float = 0.4, scale: float = 1.0) -> Column:
    """What is kept of a positive correction in the afternoon where demand falls or rises more slowly and the positive
    residuals shrink."""
    c = F.col
    first, second = c("a2") - c("a1"), c("a3") - c("a2")
    rolling = (second <= -drop * scale) | ((first - second >= slower * scale) & (second <= latest * scale))
    near = c("usual_then").isNull() | (c("a3") >= c("usual_then") - tolerance * scale)
    on = (base > base_least * scale) & (c("last_hour") >= from_hour) & rolling & (F.least("r1", "r2", "r3") >= residual * scale) & (c("r2") - c("r3") >= improved * scale) & near
    return F.when(F.coalesce(on, F.lit(False)), factor).otherwise(1.0)


def continuity_restore(before: Column, from_hour: int = 10, hours: tuple[int, int] = (10, 17), leads: int = 2, slope_least: float = -300.0, slack: float = 500.0, share: float = 0.25, most_slope: float = 300.0, most: float = 900.0, least: float = 100.0, scale: float = 1.0) -> Column:
    """Near hours of an off day whose demand does not fall: a forecast far under the last actual is lifted back."""
    c = F.col
    latest, mean = c("a3") - c("a2"), (c("a3") - c("a1")) / 2
    floor = c("a3") - slack * scale + F.least(F.greatest(mean, F.lit(0.0)) * share, F.lit(most_slope * scale))
    lift = F.least(floor - before, F.lit(most * scale))
    on = (c("last_hour") >= from_hour) & c("hour").between(*hours) & c("lead").between(1, leads) & (c("is_non_business_day") == 1) & (latest >= slope_least * scale) & (mean >= slope_least * scale) & (lift >= least * scale)
    return F.when(on, lift)


def _support() -> Column:
    return F.greatest("lag_24h_hourly_delta", "recent_same_business_type_delta_mean")


def base_adjustment(share: float = 0.6, most: float = 1200.0, scale: float = 1.0) -> Column:
    """The correction that a day's last residuals ask for before it fades with the lead."""
    return S.clip(F.col("mean_residual") * share, -most * scale, most * scale)


def faded(base: Column, decay: float = 0.92) -> Column:
    return base * F.pow(F.lit(decay), F.col("lead") - 1)


def _positive_damping(base: Column, off: int, seen: tuple[int, int], hours: tuple[int, int], leads: tuple[int, int], base_least: float, weak: float, factor: float, least: float, scale: float) -> Column:
    """A positive correction without the support of yesterday's or the recent change keeps a share of itself."""
    gone = faded(base) * (1 - factor)
    day = F.coalesce(F.col("is_non_business_day") == 1, F.lit(False)) == bool(off)
    on = day & (base >= base_least * scale) & F.col("last_hour").between(*seen) & F.col("hour").between(*hours) & F.col("lead").between(*leads) & (_support() <= weak * scale) & (gone >= least * scale)
    return F.when(on, -gone)


def morning_damping(base: Column, ramp: float = 1000.0, scale: float = 1.0) -> Column:
    """Working mornings with a steep ramp so far: hours 10 to 13, two to four ahead."""
    steep = F.greatest(F.col("a2") - F.col("a1"), F.col("a3") - F.col("a2")) >= ramp * scale
    return F.when(steep, _positive_damping(base, 0, (7, 10), (10, 13), (2, 4), 300.0, 1800.0, 0.4, 100.0, scale))


def afternoon_damping(base: Column, scale: float = 1.0) -> Column:
    """Working days from 13 h on, up to six hours ahead."""
    return _positive_damping(base, 0, (11, 20), (13, 23), (1, 6), 250.0, 900.0, 0.4, 100.0, scale)


def evening_damping(base: Column, scale: float = 1.0) -> Column:
    """Evenings (17 to 20) of off days."""
    return _positive_damping(base, 1, (12, 23), (17, 20), (2, 6), 350.0, 600.0, 0.45, 120.0, scale)


def evening_negative_damping(base: Column, base_least: float = 500.0, latest: float = 600.0, mean: float = 300.0, factor: float = 0.45, least: float = 120.0, scale: float = 1.0) -> Column:
    """Evenings (18 to 20) of off days whose demand rises: a negative correction keeps a share where yesterday or the
    recent mean does not fall."""
    c, gone = F.col, -faded(base) * (1 - factor)
    on = (c("is_non_business_day") == 1) & (base <= -base_least * scale) & (c("last_hour") >= 16) & c("hour").between(18, 20) & c("lead").between(1, 3) & (c("a3") - c("a2") >= latest * scale) & ((c("a3") - c("a1")) / 2 >= mean * scale) & (_support() >= 0) & (gone >= least * scale)
    return F.when(on, gone)
