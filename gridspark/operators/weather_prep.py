"""Weather preparation: hourly interpolation, stretching to known extremes, humidity ladder, bias correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S


def interpolate_hours(points: DataFrame, value: str = "temp_c") -> DataFrame:
    """Time-linear values on an hourly grid between the first and last point of each series (series_id, ts, value)."""
    p = points.where(F.col(value).isNotNull()).select("series_id", "ts", value)
    nxt = W.partitionBy("series_id").orderBy("ts")
    p = p.withColumns({"ts2": F.lead("ts").over(nxt), "v2": F.lead(value).over(nxt)})
    hours = F.timestamp_diff("HOUR", F.col("ts"), F.coalesce("ts2", "ts"))
    grid = p.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.coalesce(hours, F.lit(0)).cast("int") - F.when(F.col("ts2").isNotNull(), 1).otherwise(0)))))
    share = F.coalesce(F.col("k") / F.nullif(hours, F.lit(0)), F.lit(0.0))
    return grid.select("series_id", (F.col("ts") + F.make_dt_interval(hours=F.col("k"))).alias("ts"), (F.col(value) + share * (F.coalesce("v2", value) - F.col(value))).alias(value))


def stretch_to_extremes(rows: DataFrame, extremes: DataFrame, value: str = "temp_c", least: float = 0.05) -> DataFrame:
    """A day's curve stretched from its minimum so that its maximum is ``day_max``, then from its maximum so that its
    minimum is ``day_min``; differences under ``least`` change nothing."""
    day = W.partitionBy("series_id", "day")
    r = rows.withColumn("day", F.to_date("ts")).join(extremes, ["series_id", "day"], "left")
    for target, own, other in (("day_max", F.max, F.min), ("day_min", F.min, F.max)):
        peak, base = own(value).over(day), other(value).over(day)
        delta = F.col(target) - peak
        moved = F.col(value) + delta * (F.col(value) - base) / (peak - base)
        r = r.withColumn(value, F.when((F.abs(delta) >= least) & (peak != base), moved).otherwise(F.col(value)))
    return r.drop("day_max", "day_min", "day")


def fill_humidity(forecast: DataFrame, observed: DataFrame, secondary: DataFrame, hours: int = 3) -> DataFrame:
    """humidity_pct of forecast rows: its own, the last observation carried for a few hours, the secondary source, the
    month's constant; apparent temperature and discomfort follow, and the source list names what was used."""
    last = observed.where("humidity_pct is not null").groupBy("series_id").agg(F.max_by("humidity_pct", "ts").alias("last_h"), F.max("ts").alias("last_ts"))
    other = secondary.select("series_id", "ts", F.col("humidity_pct").alias("other_h"))
    r = forecast.join(last, "series_id", "left").join(other, ["series_id", "ts"], "left")
    lead = F.timestamp_diff("HOUR", F.col("last_ts"), F.col("ts"))
    carried = F.when((lead > 0) & (lead <= hours), F.col("last_h"))
    source = F.when(F.col("humidity_pct").isNotNull(), F.col("weather_source"))
    for c, name in ((carried, "humidity_carried"), (F.col("other_h"), "humidity_secondary")):
        source = F.coalesce(source, F.when(c.isNotNull(), S.add_source(F.col("weather_source"), name)))
    source = F.coalesce(source, S.add_source(F.col("weather_source"), "humidity_seasonal"))
    humidity = F.coalesce("humidity_pct", carried, "other_h", S.seasonal_humidity(F.to_date("ts")))
    r = r.withColumns({"weather_source": source, "humidity_pct": humidity})
    return r.withColumns({"apparent_temp_c": S.apparent_temperature(F.col("temp_c"), F.col("humidity_pct")), "discomfort_index": S.discomfort_index(F.col("temp_c"), F.col("humidity_pct"))}).drop("last_h", "last_ts", "other_h")


def continuity_bias(observed: DataFrame, forecast: DataFrame, hours: int = 3, least: float = 1.5, share: float = 0.7, cap: float = 2.5, fade: float = 0.6, most_slope: float = 1.0) -> DataFrame:
    """forecast (series_id, ts, temp_c) with its first hours moved toward the last observation and its recent slope."""
    o = observed.where("temp_c is not null")
    by = W.partitionBy("series_id").orderBy(F.desc("ts"))
    o = o.withColumns({"i": F.row_number().over(by), "gap_h": F.timestamp_diff("MINUTE", F.lead("ts").over(by), F.col("ts")) / 60, "slope": F.col("temp_c") - F.lead("temp_c").over(by)})
    slopes = F.percentile(F.when(F.col("i").between(1, 3) & F.col("gap_h").between(0.5, 1.5), F.col("slope") / F.col("gap_h")), F.lit(0.5))
    last = o.groupBy("series_id").agg(S.clip(slopes, -most_slope, most_slope).alias("slope"), F.max_by("temp_c", "ts").alias("last_c"), F.max("ts").alias("last_ts"))
    f = forecast.join(last, "series_id", "left").withColumn("step", F.row_number().over(W.partitionBy("series_id").orderBy("ts")) - 1)
    lead = F.timestamp_diff("MINUTE", F.col("last_ts"), F.col("ts")) / 60
    gap = F.col("last_c") + F.coalesce("slope", F.lit(0.0)) * lead - F.col("temp_c")
    first = F.first(gap).over(W.partitionBy("series_id").orderBy("ts").rowsBetween(W.unboundedPreceding, 0))
    shift = F.when((F.abs(first) >= least) & (F.col("step") < hours), S.clip(first * share, -cap, cap) * F.pow(F.lit(fade), F.col("step"))).otherwise(0.0)
    return f.withColumns({"shift_c": shift}).withColumn("temp_c", F.col("temp_c") + F.coalesce("shift_c", F.lit(0.0))).drop("slope", "last_c", "last_ts", "step")


def enrich_weather(facts: DataFrame, weather: DataFrame, official: str = "observed") -> DataFrame:
    """Facts with demand take what they lack from ``weather``, and all of it where it is an official observation; each of
    the columns by itself. Both: (series_id, ts, temp_c, humidity_pct, weather_source)."""
    new = weather.select("series_id", "ts", *[F.col(c).alias(f"new_{c}") for c in ("temp_c", "humidity_pct", "weather_source")])
    j = facts.join(new, ["series_id", "ts"], "left")
    fresh = F.coalesce(F.col("new_weather_source").contains(official), F.lit(False))
    take = lambda c: F.when(F.col("actual_mw").isNotNull() & (F.col(c).isNull() | fresh), F.col(f"new_{c}")).otherwise(F.col(c))
    return j.select(*[take(c).alias(c) if c in ("temp_c", "humidity_pct", "weather_source") else F.col(c) for c in facts.columns])


def prefer_station(first: Column, last: Column, today: Column, most_days: int = 3, age: int = 2) -> Column:
    """Whether station data are asked for first: short ranges that end lately."""
    return (F.datediff(last, first) <= most_days) & (last >= F.date_sub(today, age))


def humidity_ladder(forecast: DataFrame, observed: DataFrame, fallback: DataFrame, hours: int = 3) -> DataFrame:
    """Forecast rows (series_id, ts, temp_c, humidity_pct) with a humidity each, and humidity_source: their own, the last
    observation for a few hours after it, the fallback's, or the month's constant."""
    last = observed.where("humidity_pct is not null").groupBy("series_id").agg(F.max("ts").alias("seen_ts"), F.max_by("humidity_pct", "ts").alias("seen"))
    j = forecast.join(last, "series_id", "left").join(fallback.select("series_id", "ts", F.col("humidity_pct").alias("other")), ["series_id", "ts"], "left")
    held = F.when((F.col("ts") > F.col("seen_ts")) & (F.col("ts") <= F.col("seen_ts") + F.make_dt_interval(hours=F.lit(hours))), F.col("seen"))
    steps = (("own", F.col("humidity_pct")), ("forward_fill", held), ("fallback", F.col("other")), ("seasonal", S.seasonal_humidity(F.to_date("ts"))))
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(n)) for n, v in steps])
    return j.select(*[F.coalesce(*[v for _, v in steps]).alias(c) if c == "humidity_pct" else F.col(c) for c in forecast.columns], source.alias("humidity_source"))


def median_bias(rows: DataFrame, observed: DataFrame, now: Column, lookback: int = 4, horizon: int = 3, least: float = 1.5, most: float = 2.5, decay: float = 0.6) -> DataFrame:
    """rows (series_id, ts, actual_mw, temp_c) whose next few hours of today without demand are moved by the median of
    observed less forecast temperature of the last hours, clipped and fading; small biases are let be."""
    o = observed.select("series_id", "ts", F.col("temp_c").alias("seen_c")).where((F.col("ts") <= now) & (F.col("ts") >= now - F.make_dt_interval(hours=F.lit(lookback))))
    bias = rows.join(o, ["series_id", "ts"]).groupBy("series_id").agg(S.clip(F.median(F.col("seen_c") - F.col("temp_c")), -most, most).alias("bias")).where(F.abs("bias") >= least)
    j = rows.join(bias, "series_id", "left")
    ahead = (F.to_date("ts") == F.to_date(now)) & (F.col("ts") > now) & F.col("actual_mw").isNull()
    step = F.row_number().over(W.partitionBy("series_id", ahead).orderBy("ts")) - 1
    moved = F.when(ahead & (step < horizon), F.col("temp_c") + F.coalesce("bias", F.lit(0.0)) * F.pow(F.lit(decay), step)).otherwise(F.col("temp_c"))
    return j.select(*[moved.alias(c) if c == "temp_c" else F.col(c) for c in rows.columns])


def merge_sources(official: DataFrame, fallback: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """All keys of either source with, for each column, the official value where there is one, else the fallback's, to
    a tenth, and <column>_source. Of repeated keys in a source a column's largest value counts, so no row multiplies."""
    one = lambda df, tag: df.groupBy(*keys).agg(*[F.max(c).alias(f"__{tag}_{c}") for c in columns])
    both = one(official, "o").join(one(fallback, "f"), list(keys), "full")
    out = list(keys)
    for c in columns:
        o, f = F.col(f"__o_{c}"), F.col(f"__f_{c}")
        out += [(F.rint(F.coalesce(o, f) * 10) / 10).alias(c), F.when(o.isNotNull(), "official").when(f.isNotNull(), "fallback").alias(f"{c}_source")]
    return both.select(*out)
