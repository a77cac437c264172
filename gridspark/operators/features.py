"""Hourly features of every series in one pass: lags, slot means, calendar, weather and their products.

All frames share a partition by series, so Spark shuffles the facts once; slot windows use subsets of rows. Lags are
ranges in time, not rows, so a gap gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import constants as C
from ..functions import scalars as S

LAGS = (1, 24, 25, 48, 168, 169, 336)
WEATHER_LAGS = (1, 2, 24, 168)


def _clock() -> Column:
    """Hours since the epoch; NTZ days have 24 hours."""
    return (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")).cast("long")


#: Hours of a stretch of a series that one task holds for lags by the clock.
STRETCH_HOURS = 4096


def lag_hours(value: Column, hours: int, *by: str) -> Column:
    """The value exactly ``hours`` before; needs the column ``clock``. One row for each series and hour."""
    at = W.partitionBy("series_id", *by).orderBy("clock").rangeBetween(-hours, -hours)
    return F.first(value).over(at)


def lag_features(hourly: DataFrame, lags: tuple[int, ...] = LAGS) -> DataFrame:
    """hourly plus clock and lag_<n>h columns, and hour-to-hour deltas of today, yesterday and last week.

    A series is cut into stretches, and the hours that the next stretch looks back to stand in both, so that a long
    history is many groups."""
    stretch, late = F.floor(F.col("clock") / STRETCH_HOURS), F.pmod(F.col("clock"), F.lit(STRETCH_HOURS)) >= STRETCH_HOURS - max(lags)
    out = hourly.withColumn("clock", _clock()).withColumn("stretch", F.explode(F.when(late, F.array(stretch, stretch + 1)).otherwise(F.array(stretch))))
    out = out.select("*", *[lag_hours(F.col("actual_mw"), n, "stretch").alias(f"lag_{n}h") for n in lags]).where(F.col("stretch") == stretch).drop("stretch")
    return out.withColumns({"hourly_delta": F.col("actual_mw") - F.col("lag_1h"), "lag_24h_hourly_delta": F.col("lag_24h") - F.col("lag_25h"), "lag_168h_hourly_delta": F.col("lag_168h") - F.col("lag_169h")})


def slot_features(lagged: DataFrame, calendar: DataFrame) -> DataFrame:
    """Means of the last rows of the same slot, the row itself left out: 4 of the hour and weekday, 8 of the hour and
    day type; deltas skip nulls inside the 8."""
    cal = calendar.select("day", F.col("is_off").cast("int").alias("is_non_business_day"), F.col("is_holiday").cast("int").alias("is_holiday"), F.col("is_weekend").cast("int").alias("is_weekend"))
    d = lagged.withColumn("day", F.to_date("ts")).join(F.broadcast(cal), "day").withColumns({"hour": F.hour("ts"), "dayofweek": F.weekday("ts"), "month": F.month("ts")})
    week = W.partitionBy("series_id", "hour", "dayofweek").orderBy("ts").rowsBetween(-4, -1)
    kind = W.partitionBy("series_id", "hour", "is_non_business_day").orderBy("ts").rowsBetween(-8, -1)
    mean = F.avg("actual_mw").over(week)
    return d.withColumns(
        {
            "roll_4w_mean": mean,
            "roll_4w_std": F.coalesce(F.stddev_samp("actual_mw").over(week), F.lit(0.0)),
            "recent_same_business_type_mean": F.avg("actual_mw").over(kind),
            "recent_same_business_type_delta_mean": F.avg("hourly_delta").over(kind),
        }
    )


def inference_slots(hourly: DataFrame, targets: DataFrame, calendar: DataFrame) -> DataFrame:
    """The columns of ``slot_features`` for hours that may lie ahead: for each target (series_id, ts, as_of) they look
    at the last 4 or 8 known values of its slot before as_of.

    Each known row holds the figures of its slot up to itself; targets stand among those rows as markers at their as_of,
    and take the last figures before them. So every slot is sorted once, however many targets ask."""
    cal = F.broadcast(calendar.select("day", F.col("is_off").cast("int").alias("is_non_business_day")))
    keyed = lambda df: df.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts"), "dayofweek": F.weekday("ts")}).join(cal, "day")
    known = keyed(lag_features(hourly, (1, 24, 25, 168, 169)).select("series_id", "ts", "actual_mw", "hourly_delta"))
    asked = keyed(targets.select("series_id", "ts", "as_of"))
    slots = (("dayofweek", 4), ("is_non_business_day", 8))
    out = asked
    for kind, k in slots:
        upto = W.partitionBy("series_id", "hour", kind).orderBy("ts").rowsBetween(1 - k, 0)
        figures = F.struct(F.avg("actual_mw").over(upto).alias("mean"), F.coalesce(F.stddev_samp("actual_mw").over(upto), F.lit(0.0)).alias("std"), F.avg("hourly_delta").over(upto).alias("delta"))
        facts = known.select("series_id", "hour", kind, F.col("ts").alias("at"), F.lit(1).alias("fact"), figures.alias("figures"), F.lit(None).cast("timestamp_ntz").alias("ts"))
        marks = asked.select("series_id", "hour", kind, F.col("as_of").alias("at"), F.lit(0).alias("fact"), F.lit(None).cast(facts.schema["figures"].dataType).alias("figures"), "ts")
        # At equal times the marker comes first: what is known is before as_of.
        order = W.partitionBy("series_id", "hour", kind).orderBy("at", "fact").rowsBetween(W.unboundedPreceding, 0)
        last = facts.unionByName(marks).withColumn("figures", F.last("figures", ignorenulls=True).over(order)).where("fact = 0")
        names = {"dayofweek": {"mean": "roll_4w_mean", "std": "roll_4w_std"}, "is_non_business_day": {"mean": "recent_same_business_type_mean", "delta": "recent_same_business_type_delta_mean"}}[kind]
        found = last.select("series_id", "ts", F.col("at").alias("as_of"), *[F.col(f"figures.{f}").alias(n) for f, n in names.items()]).distinct()
        out = out.join(found, ["series_id", "ts", "as_of"], "left")
    return out.withColumn("roll_4w_std", F.coalesce("roll_4w_std", F.lit(0.0)))


def calendar_features(rows: DataFrame, hourly: DataFrame, calendar: DataFrame) -> DataFrame:
    """Columns of the day, of the days one and seven before, and demand at this hour of the last working days."""
    cal = calendar.select("day", "last_biz_day", "last_open_day", F.col("run_before").alias("consec_holiday_len"), F.col("days_since_off").alias("days_since_holiday_end"))
    before = lambda n, *cols: calendar.select(F.date_add("day", n).alias("day"), *[F.col(c).alias(a) for c, a in cols])
    out = rows.join(F.broadcast(cal), "day", "left")
    out = out.join(F.broadcast(before(1, ("days_since_off", "lag_24h_dsh"), ("run_before", "lag_24h_consec"), ("is_off", "off_before"))), "day", "left")
    out = out.join(F.broadcast(before(7, ("days_since_off", "lag_168h_dsh"))), "day", "left")
    at = lambda day, name: hourly.select("series_id", F.to_date("ts").alias(day), F.hour("ts").alias("hour"), F.col("actual_mw").alias(name))
    out = out.join(at("last_biz_day", "lag_last_biz_hour"), ["series_id", "last_biz_day", "hour"], "left")
    out = out.join(at("last_open_day", "lag_last_nonhol_hour"), ["series_id", "last_open_day", "hour"], "left")
    mismatch = (F.col("off_before").cast("int") != F.col("is_non_business_day")).cast("int")
    between = lambda a, b: F.col("hour").between(a, b).cast("int")
    return out.withColumns({"major_holiday_season": S.season_zone(F.col("day")), "lag_24h_business_type_mismatch": mismatch}).withColumns(
        {
            "lag_24h_mismatch_x_business_hour": F.col("lag_24h_business_type_mismatch") * between(8, 18),
            "lag_24h_to_last_biz_gap": F.col("lag_last_biz_hour") - F.col("lag_24h"),
            "lag_24h_to_same_business_type_gap": F.col("recent_same_business_type_mean") - F.col("lag_24h"),
            "lag_24h_gap_x_business_hour": F.col("lag_24h_business_type_mismatch") * between(6, 18) * (F.col("recent_same_business_type_mean") - F.col("lag_24h")),
        }
    )


def weather_features(weather: DataFrame, past_only: bool = True) -> DataFrame:
    """Degrees, discomfort, anomalies, deltas and rolling means of (series_id, ts, temp_c, humidity_pct). Rolling means
    are over rows. The anomaly against the month and hour looks at the past only, or at all rows."""
    w = weather.withColumns({"clock": _clock(), "cooling_degree": S.degree(F.col("temp_c"), C.COOLING_BASE), "heating_degree": S.degree(F.col("temp_c"), C.HEATING_BASE, cooling=False), "humidity": S.clip(F.col("humidity_pct"), 20.0, 100.0)})
    w = w.withColumn("discomfort_index", S.discomfort_index(F.col("temp_c"), F.col("humidity")))
    rows = W.partitionBy("series_id").orderBy("clock")
    roll = lambda c, n, least=1: F.when(F.count(c).over(rows.rowsBetween(1 - n, 0)) >= least, F.avg(c).over(rows.rowsBetween(1 - n, 0)))
    week = rows.rowsBetween(-168, -1)
    slot = W.partitionBy("series_id", F.month("ts"), F.hour("ts"))
    same = slot.orderBy("clock").rowsBetween(W.unboundedPreceding, -1) if past_only else slot
    new = {f"{c}_{n}h_mean": roll(c, n) for c in ("cooling_degree", "heating_degree") for n in (3, 6)}
    new |= {f"{c}_72h_mean": roll(c, 72, 24) for c in ("temp_c", "cooling_degree", "heating_degree")}
    new |= {"temp_anomaly_7d": F.col("temp_c") - F.when(F.count("temp_c").over(week) >= 24, F.avg("temp_c").over(week)), "temp_anomaly_doy": F.col("temp_c") - F.avg("temp_c").over(same)}
    for n in WEATHER_LAGS:
        new[f"temp_delta_{n}h"] = F.col("temp_c") - lag_hours(F.col("temp_c"), n)
        if n != 2:
            new[f"cooling_delta_{n}h"] = F.col("cooling_degree") - lag_hours(F.col("cooling_degree"), n)
    new["humidity_delta_24h"] = S.clip(F.col("humidity") - lag_hours(F.col("humidity"), 24), -30.0, 30.0)
    new["discomfort_delta_24h"] = S.clip(F.col("discomfort_index") - lag_hours(F.col("discomfort_index"), 24), -8.0, 8.0)
    return w.withColumns(new)


def interaction_features(rows: DataFrame) -> DataFrame:
    """Products of day type, hour and weather of rows that have both families."""
    c, business = F.col, F.col("is_non_business_day") == 0
    on = lambda a, b: (business & c("hour").between(a, b)).cast("double")
    warm, after = S.clip(c("temp_anomaly_7d"), 0.0, float("inf")), c("days_since_holiday_end").between(1, 2).cast("double")
    new = {f"business_morning_x_{x}": on(5, 11) * c(x) for x in ("temp_delta_24h", "temp_anomaly_7d", "temp_anomaly_doy", "humidity_delta_24h", "discomfort_delta_24h")}
    new |= {"business_daytime_x_discomfort_index": on(9, 18) * c("discomfort_index")}
    new |= {f"business_late_afternoon_x_{x}": on(15, 18) * c(x) for x in ("temp_delta_1h", "cooling_delta_1h")}
    new |= {"holiday_x_heat": c("consec_holiday_len") * warm, "post_holiday_x_heat": after * warm, "business_hour_x_post_holiday_heat": c("hour").between(9, 18).cast("double") * after * warm}
    return rows.withColumns(new)


def context_features(rows: DataFrame) -> DataFrame:
    """What is known of the same day before each hour: the latest actual, its hour, the latest and the mean of the last
    two deltas; and lower quartiles of deltas of the same slot (three or more, else their mean)."""
    day = W.partitionBy("series_id", "day").orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    deltas = F.slice(F.reverse(F.collect_list("hourly_delta").over(day)), 1, 2)
    kind = W.partitionBy("series_id", "hour", "is_non_business_day").orderBy("ts").rowsBetween(-8, -1)
    held = F.sort_array(F.collect_list("hourly_delta").over(kind))
    n = F.size(held)
    place = (n - 1) * 0.25
    low = F.floor(place).cast("int")
    quarter = F.get(held, low) + (place - low) * (F.coalesce(F.get(held, low + 1), F.get(held, low)) - F.get(held, low))
    q25 = F.when(n >= 3, quarter).when(n > 0, F.aggregate(held, F.lit(0.0), lambda a, x: a + x) / n)
    out = rows.withColumns(
        {
            "same_day_latest_actual_hour": F.last(F.when(F.col("actual_mw").isNotNull(), F.col("hour")), ignorenulls=True).over(day),
            "same_day_latest_actual_mw": F.last("actual_mw", ignorenulls=True).over(day),
            "same_day_latest_hourly_delta": F.last("hourly_delta", ignorenulls=True).over(day),
            "same_day_recent_hourly_delta_mean": F.aggregate(deltas, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(deltas), F.lit(0)),
            "recent_same_business_type_delta_q25": q25,
        }
    )
    midday = (F.col("is_non_business_day") == 0) & F.col("hour").between(11, 13)
    sources = {"lag_24h_delta": "lag_24h_hourly_delta", "recent_delta_mean": "recent_same_business_type_delta_mean", "recent_delta_q25": "recent_same_business_type_delta_q25", "same_day_recent_delta_mean": "same_day_recent_hourly_delta_mean"}
    return out.withColumns({f"business_midday_x_{k}": F.when(midday, F.col(v)).otherwise(F.lit(0.0)) for k, v in sources.items()})


def build_features(hourly: DataFrame, weather: DataFrame, calendar: DataFrame, past_only: bool = True) -> DataFrame:
    """Every feature of every (series_id, ts) of ``hourly``."""
    rows = calendar_features(slot_features(lag_features(hourly), calendar), hourly, calendar)
    w = weather_features(weather, past_only).drop("clock", "humidity_pct")
    return context_features(interaction_features(rows.join(w, ["series_id", "ts"], "left")))


def daily_features(hourly: DataFrame, demand: tuple[str, ...] = ("actual_mw",)) -> DataFrame:
    """One row for each complete day (hours 0-23): mean, min, max, population deviation and part means of each column."""
    d = hourly.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts")})
    parts = {f"{c}_{name}": F.avg(F.when(F.col("hour").between(a, b), F.col(c))) for c in demand for name, a, b in C.DAY_PARTS}
    stats = {f"{c}_{name}": f(c) for c in demand for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_pop))}
    aggregates = [v.alias(k) for k, v in (stats | parts).items()]
    out = d.groupBy("series_id", "day").agg(F.count_distinct(F.when(F.col("actual_mw").isNotNull(), F.col("hour"))).alias("hours"), *aggregates)
    return out.where("hours = 24").drop("hours")
