"""Choices of days, origins and tails over hourly rows (series_id, ts, ...): complete days, training windows, first
origins, neighbours, runs. Each is one aggregate or window partitioned by series (and day)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def complete_days(rows: DataFrame, value: str = "actual_mw", last: int | None = None) -> DataFrame:
    """(series_id, day, hours, rank) of days with a known value in every hour 0-23; rank 1 is the latest. With ``last``
    only so many days of a series."""
    d = rows.where(F.col(value).isNotNull()).groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count_distinct(F.hour("ts")).alias("hours")).where("hours = 24")
    d = d.withColumn("rank", F.row_number().over(W.partitionBy("series_id").orderBy(F.desc("day"))))
    return d if last is None else d.where(F.col("rank") <= last)


def training_window(rows: DataFrame, days: int = 90, value: str = "actual_mw") -> DataFrame:
    """The rows of each series from ``days`` before its last known value on."""
    last = rows.where(F.col(value).isNotNull()).groupBy("series_id").agg(F.max("ts").alias("last_ts"))
    return rows.join(last, "series_id").where(F.col("ts") >= F.col("last_ts") - F.make_dt_interval(days=F.lit(days))).drop("last_ts")


def before_day(rows: DataFrame, cut: Column) -> DataFrame:
    """Rows of days strictly before ``cut``."""
    return rows.where(F.to_date("ts") < cut)


def first_origins(captures: DataFrame) -> DataFrame:
    """(series_id, target, captured_at, n): the earliest capture inside each target day, and its rows."""
    day = captures.where(F.to_date("captured_at") == F.to_date("ts")).groupBy("series_id", F.to_date("ts").alias("target"), "captured_at").agg(F.count("*").alias("n"))
    return day.groupBy("series_id", "target").agg(F.min_by(F.struct("captured_at", "n"), "captured_at").alias("x")).select("series_id", "target", "x.captured_at", "x.n")


def exact_or_neighbour(events: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """For events (series_id, day, hour): the row of that hour, or else of the hours beside it the one with the largest
    absolute value; (.., from_hour, value), nulls where there is none."""
    near = events.withColumn("from_hour", F.explode(F.array(*[F.col("hour") + d for d in (0, -1, 1)])))
    held = near.join(rows.select("series_id", "day", F.col("hour").alias("from_hour"), F.col(value).alias("value")), ["series_id", "day", "from_hour"])
    first = F.struct(F.col("from_hour") == F.col("hour"), F.abs("value"), -F.col("from_hour"))
    best = held.groupBy("series_id", "day", "hour").agg(F.max_by(F.struct("from_hour", "value"), first).alias("x"))
    return events.join(best, ["series_id", "day", "hour"], "left").select("series_id", "day", "hour", "x.from_hour", "x.value")


def keep_last(rows: DataFrame, by: str) -> DataFrame:
    """Of rows of one series and time the one that came last."""
    return rows.groupBy("series_id", "ts").agg(F.max_by(F.struct(*rows.columns), by).alias("x")).select("x.*")


def union_of_hours(*tables: tuple[str, DataFrame]) -> DataFrame:
    """One row per (series_id, ts) that any (name, (series_id, ts, value)) table has, a column for each: a long union and
    one pre-aggregated group-by in place of a chain of outer joins."""
    names = [name for name, _ in tables]
    long = None
    for name, df in tables:
        part = df.select("series_id", "ts", *[(F.col("value") if n == name else F.lit(None).cast("double")).alias(n) for n in names])
        long = part if long is None else long.unionByName(part)
    return long.groupBy("series_id", "ts").agg(*[F.max(n).alias(n) for n in names])


def same_sign_tail(rows: DataFrame, value: str) -> DataFrame:
    """(series_id, day, tail, sign): how many of a day's last values have one sign; a zero ends the run."""
    day = W.partitionBy("series_id", "day").orderBy(F.desc("ts"))
    r = rows.where(F.col(value).isNotNull()).withColumns({"day": F.to_date("ts"), "sign": F.signum(value).cast("int")})
    r = r.withColumn("last_sign", F.first("sign").over(day)).withColumn("other", F.sum(F.when((F.col("sign") == F.col("last_sign")) & (F.col("sign") != 0), 0).otherwise(1)).over(day.rowsBetween(W.unboundedPreceding, 0)))
    return r.groupBy("series_id", "day").agg(F.count_if(F.col("other") == 0).alias("tail"), F.max("last_sign").alias("sign"))


def recent_slope(rows: DataFrame, value: str, last: int = 3, gap: tuple[float, float] = (0.5, 1.5)) -> DataFrame:
    """(series_id, day, n, slope): the median of a day's last hourly slopes whose ends are about an hour apart."""
    w = W.partitionBy("series_id", "day").orderBy("ts")
    r = rows.where(F.col(value).isNotNull()).withColumn("day", F.to_date("ts"))
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 3.6e9
    r = r.withColumns({"hours": hours, "slope": (F.col(value) - F.lag(value).over(w)) / hours}).where(F.col("hours").between(*gap))
    r = r.withColumn("i", F.row_number().over(W.partitionBy("series_id", "day").orderBy(F.desc("ts")))).where(F.col("i") <= last)
    return r.groupBy("series_id", "day").agg(F.count("*").alias("n"), F.median("slope").alias("slope"))


def timed_degree_means(rows: DataFrame, column: str, hours: tuple[int, ...] = (3, 6)) -> DataFrame:
    """Means over the rows of the last n hours by the clock, whatever rows are missing."""
    w = W.partitionBy("series_id").orderBy((F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")).cast("long"))
    return rows.withColumns({f"{column}_{n}h_timed": F.avg(column).over(w.rangeBetween(1 - n, 0)) for n in hours})


def next_hours(rows: DataFrame, now: Column, n: int = 3) -> DataFrame:
    """The first ``n`` hours of each series after ``now``."""
    r = rows.where(F.col("ts") > now)
    return r.withColumn("step", F.row_number().over(W.partitionBy("series_id").orderBy("ts"))).where(F.col("step") <= n)


def finalize_fallback(rows: DataFrame, today: Column, days: int = 2, source: str = "reference_forecast_fallback") -> DataFrame:
    """Hours of the ``days`` days before ``today`` that never got an actual take a positive reference forecast, marked so."""
    late = F.to_date("ts").between(F.date_sub(today, days), F.date_sub(today, 1)) & F.col("actual_mw").isNull() & (F.col("reference_mw") > 0)
    return rows.withColumns({"actual_mw": F.when(late, F.col("reference_mw")).otherwise(F.col("actual_mw")), "actual_source": F.when(late, F.lit(source)).otherwise(F.col("actual_source"))})


def partial_lag_days(rows: DataFrame, fallback: str = "reference_forecast_fallback") -> DataFrame:
    """(series_id, target, observed, switch): whether the day before has too few observed hours for its lags; hours 0-22
    observed and hour 23 by fallback are enough. rows: (series_id, ts, actual_mw, actual_source)."""
    seen = (F.col("actual_source") != fallback) & F.col("actual_mw").isNotNull()
    d = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count_distinct(F.when(seen, F.hour("ts"))).alias("observed"), F.max(F.when(seen, F.hour("ts"))).alias("last_seen"), F.bool_or((F.hour("ts") == 23) & (F.col("actual_source") == fallback)).alias("late"))
    enough = (F.col("observed") == 24) | ((F.col("observed") == 23) & (F.col("last_seen") == 22) & F.col("late"))
    return d.select("series_id", F.date_add("day", 1).alias("target"), "observed", (~F.coalesce(enough, F.lit(False))).alias("switch"))


def extend_weather(facts: DataFrame, forecast: DataFrame) -> DataFrame:
    """Facts (series_id, ts, actual_mw, temp_c, temp_source) with the forecast's weather where there is neither demand
    nor observed weather, and virtual rows for hours that only the forecast has."""
    f = forecast.select("series_id", "ts", F.col("temp_c").alias("new_c"))
    both = facts.withColumn("known", F.lit(True)).join(f, ["series_id", "ts"], "full_outer")
    fresh = F.col("new_c").isNotNull() & (F.col("known").isNull() | F.col("temp_c").isNull() | (F.col("actual_mw").isNull() & ~F.coalesce(F.col("temp_source") == "observed", F.lit(False))))
    return both.select("series_id", "ts", "actual_mw", F.when(fresh, F.col("new_c")).otherwise(F.col("temp_c")).alias("temp_c"), F.when(fresh, F.lit("forecast")).otherwise(F.col("temp_source")).alias("temp_source"), F.col("known").isNull().alias("virtual"))
