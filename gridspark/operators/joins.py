"""Joins over time: nearest within a tolerance, latest before, neighbours, masks, upserts and overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import constants as C


def observed(facts: DataFrame) -> DataFrame:
    """Rows with an actual that was observed; a null source counts as observed."""
    return facts.where(F.col("actual_mw").isNotNull() & (F.coalesce("actual_source", F.lit(C.OBSERVED)) != C.FALLBACK))


def _days_read(facts: DataFrame, asked: DataFrame, day: Column, days: int, ahead: int) -> DataFrame:
    """Facts once for each asked row of their series whose day is within ``days`` after, or ``ahead`` before, theirs: an
    equi-join on series and day, so rows grow with what is asked and never with the length of a series besides."""
    reads = asked.withColumn("__day", F.explode(F.sequence(F.date_sub(day, days), F.date_add(day, ahead))))
    return facts.withColumn("__day", F.to_date("ts")).join(reads, ["series_id", "__day"]).drop("__day")


def mask_target_actuals(facts: DataFrame, targets: DataFrame, days: int = 400) -> DataFrame:
    """facts of the target day and of ``days`` days before it, once for each of the series' targets (series_id, target);
    actuals of the target day are null, all else of its rows stays."""
    j = _days_read(facts, targets, F.col("target"), days, 0)
    return j.withColumn("actual_mw", F.when(F.to_date("ts") < F.col("target"), F.col("actual_mw")))


def mask_unknown(facts: DataFrame, origins: DataFrame, days: int = 400, ahead: int = 1) -> DataFrame:
    """facts as known at origins (series_id, captured_at), from ``days`` days before to ``ahead`` after: actuals from the
    origin's hour on are null."""
    j = _days_read(facts, origins, F.to_date("captured_at"), days, ahead)
    known = F.col("ts") < F.date_trunc("hour", "captured_at").cast("timestamp_ntz")
    return j.withColumn("actual_mw", F.when(known, F.col("actual_mw")))


def nearest_within(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, seconds: int) -> DataFrame:
    """Each left row with the right row of the same keys nearest in time, at most ``seconds`` apart (earlier wins a tie),
    and apart_s; nulls where there is none. Repeated left rows each keep theirs.

    Right rows are keyed by buckets of that width and met in the left row's bucket and its two neighbours, so the join
    stays an equi-join of bounded fan-out."""
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    times = left.select(*by, left_at).distinct().withColumn("__at", epoch(left_at))
    probe = times.withColumn("__slot", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("__at") / seconds) + k)))
    held = right.withColumns({"__to": epoch(right_at), "__slot": F.floor(epoch(right_at) / seconds)})
    apart = F.abs(F.col("__at") - F.col("__to"))
    met = probe.join(held, [*by, "__slot"]).where(apart <= seconds)
    others = [c for c in right.columns if c not in by]
    best = met.groupBy(*by, left_at).agg(F.min_by(F.struct(*others, apart.alias("apart_s")), F.struct(apart, "__to")).alias("__x"))
    return left.join(best.select(*by, left_at, "__x.*"), [*by, left_at], "left")


def latest_before(rows: DataFrame, by: list[str], order: str, *columns: str) -> DataFrame:
    """Adds latest_<column>: the last non-null value strictly earlier in each group."""
    past = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.select("*", *[F.last(c, ignorenulls=True).over(past).alias(f"latest_{c}") for c in columns])


def neighbour_hours(events: DataFrame, facts: DataFrame, radius: int = 2) -> DataFrame:
    """facts within ``radius`` hours of the events of their series and day (series_id, day, hour), each once, with the
    number of events that it is near."""
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.col("hour") - radius), F.least(F.lit(23), F.col("hour") + radius)))
    near = events.select("series_id", "day", around.alias("hour")).groupBy("series_id", "day", "hour").agg(F.count("*").alias("n_events"))
    return facts.join(near, ["series_id", "day", "hour"])


def overlay(base: DataFrame, over: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """base with columns from over where it has them; rows of either side stay."""
    o = over.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    j = base.join(o, keys, "full_outer")
    return j.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def source_rank(source: Column) -> Column:
    return F.when(source == C.OBSERVED, 3).when(source == C.OBSERVED_LEGACY, 2).when(source == C.FALLBACK, 1).when(source.isNull(), 0).otherwise(2)


def best_source(rows: DataFrame, keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """One row for each key, of the best source (then the largest value)."""
    order = W.partitionBy(*keys).orderBy(source_rank(F.col("actual_source")).desc(), F.col("actual_mw").desc_nulls_last())
    return rows.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")


def upsert_actuals(facts: DataFrame, feed: DataFrame, today) -> DataFrame:
    """Facts after a feed (series_id, ts, feed_mw, reference_mw): an observed value stays, the feed's value replaces
    anything else, a blank of a past day takes the reference forecast as a tagged fallback, a blank of today stays."""
    j = facts.join(feed, ["series_id", "ts"], "full_outer")
    was = F.col("actual_mw").isNotNull() & (F.coalesce("actual_source", F.lit(C.OBSERVED)) != C.FALLBACK)
    fed, past = F.col("feed_mw").isNotNull(), F.to_date("ts") < F.lit(today).cast("date")
    fall = past & F.col("reference_mw").isNotNull()
    value = F.when(was, F.col("actual_mw")).when(fed, F.col("feed_mw")).when(F.col("actual_mw").isNotNull(), F.col("actual_mw")).when(fall, F.col("reference_mw"))
    source = F.when(was, F.coalesce("actual_source", F.lit(C.OBSERVED))).when(fed, C.OBSERVED).when(F.col("actual_mw").isNotNull(), F.col("actual_source")).when(fall, C.FALLBACK)
    return j.select("series_id", "ts", value.alias("actual_mw"), source.alias("actual_source"))


def freeze_observed(existing: DataFrame, new: DataFrame, facts: DataFrame) -> DataFrame:
    """New forecasts, but an hour that is observed keeps the forecast it had."""
    seen = observed(facts).select("series_id", "ts", F.lit(True).alias("seen"))
    old = existing.select("series_id", "ts", F.col("forecast_mw").alias("old_mw"))
    j = new.join(old, ["series_id", "ts"], "left").join(seen, ["series_id", "ts"], "left")
    keep = F.col("seen") & F.col("old_mw").isNotNull()
    return j.withColumn("forecast_mw", F.when(keep, F.col("old_mw")).otherwise(F.col("forecast_mw"))).drop("old_mw", "seen")


def top_rows(rows: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group, with their rank."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)
