"""Forecasts of past days as of an origin, from what was known then, for a champion and a calibrated candidate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S
from ..functions.constants import Z95, Z99
from ..operators import features

#: Online calibration: share of the median residual of the last days of the same type, its cap in MW, how many days.
SHARE, CAP, LAST = 0.25, 1000.0, 3


def origins(captures: DataFrame, lead_days: int = 0, from_hour: int = 0) -> DataFrame:
    """(series_id, target, captured_at): the first capture, not before an hour of the day, ``lead_days`` before each
    target. captures: (series_id, captured_at), repeated or not; null times are left out."""
    c = captures.where(F.col("captured_at").isNotNull() & (F.hour("captured_at") >= from_hour))
    return c.groupBy("series_id", F.date_add(F.to_date("captured_at"), lead_days).alias("target")).agg(F.min("captured_at").alias("captured_at"))


def known_before(origin: DataFrame) -> DataFrame:
    """origins plus as_of: facts before it may be read. It is the origin's whole hour, or the target's midnight if that
    is earlier, so nothing of the target day is read whenever the origin was."""
    hour = F.date_trunc("hour", "captured_at").cast("timestamp_ntz")
    return origin.withColumn("as_of", F.least(hour, F.col("target").cast("timestamp_ntz")))


def replay(facts: DataFrame, origin: DataFrame, calendar: DataFrame) -> DataFrame:
    """(series_id, ts, target, as_of, is_off, actual_mw, champion_mw, raw_mw, shift_mw, candidate_mw, and p95 and p99
    bands of both): every hour of every target that has an actual and both forecasts.

    The champion is the mean of the last 4 weeks of the hour's slot, the raw candidate that of the last 8 days of the
    same type, both from facts before as_of. The candidate adds a share of the median mean residual of the last 3 whole
    days of the same type that were over by as_of, and nothing while there are fewer. Bands are those of the slot's
    spread. Facts are sorted once for each slot, however many origins ask; no fact is repeated for an origin.
    """
    o = known_before(origin)
    at = (F.col("target").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("h"))).alias("ts")
    asked = o.select("series_id", "target", "as_of", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("h")).select("series_id", at, "as_of")
    slots = features.inference_slots(facts, asked, calendar).where("roll_4w_mean is not null and recent_same_business_type_mean is not null")
    rows = slots.join(facts.where("actual_mw is not null").select("series_id", "ts", "actual_mw"), ["series_id", "ts"])
    rows = rows.select("series_id", "ts", F.to_date("ts").alias("target"), "as_of", F.col("is_non_business_day").cast("boolean").alias("is_off"), "actual_mw", F.col("roll_4w_mean").alias("champion_mw"), F.col("recent_same_business_type_mean").alias("raw_mw"), F.col("roll_4w_std").alias("spread"))
    return _banded(rows.join(calibration(rows), ["series_id", "target"]))


def calibration(rows: DataFrame, share: float = SHARE, cap: float = CAP, last: int = LAST, reach: int = 60) -> DataFrame:
    """(series_id, target, shift_mw) for each target of rows (series_id, target, as_of, is_off, ts, actual_mw, raw_mw).

    The days looked at are the ``reach`` entries of the same type before the target, the size that the ledger has."""
    day = rows.groupBy("series_id", "target", "as_of", "is_off").agg(F.avg(F.col("actual_mw") - F.col("raw_mw")).alias("residual"), F.count_distinct(F.hour("ts")).alias("hours"))
    entry = F.when(F.col("hours") == 24, F.struct("target", "residual"))
    past = W.partitionBy("series_id", "is_off").orderBy("target").rowsBetween(-reach, -1)
    over = F.filter(F.collect_list(entry).over(past), lambda e: F.date_add(e["target"], 1).cast("timestamp_ntz") <= F.col("as_of"))
    day = day.withColumn("over", over).withColumn("used", F.array_sort(F.transform(F.slice("over", F.greatest(F.lit(1), F.size("over") - last + 1), last), lambda e: e["residual"])))
    n = F.size("used")
    middle = (F.get("used", F.floor((n - 1) / 2).cast("int")) + F.get("used", F.floor(n / 2).cast("int"))) / 2
    shift = S.clip(middle * share, -cap, cap)
    return day.select("series_id", "target", F.when((n == last) & (F.abs(shift) >= 0.05), shift).otherwise(0.0).alias("shift_mw"))


def _banded(rows: DataFrame) -> DataFrame:
    r = rows.withColumn("candidate_mw", F.col("raw_mw") + F.col("shift_mw"))
    ends = {f"{name}_{p}_{end}": F.col(f"{name}_mw") + sign * z * F.col("spread") for name in ("champion", "candidate") for p, z in (("p95", Z95), ("p99", Z99)) for end, sign in (("lower", -1), ("upper", 1))}
    return r.withColumns(ends).drop("spread")


def coverages(rows: DataFrame) -> DataFrame:
    """(series_id, champion_p95, candidate_p95, champion_p99, candidate_p99): percent of hours inside the bands."""
    inside = lambda name, p: (F.avg(F.col("actual_mw").between(F.col(f"{name}_{p}_lower"), F.col(f"{name}_{p}_upper")).cast("int")) * 100).alias(f"{name}_{p}")
    return rows.groupBy("series_id").agg(*[inside(name, p) for p in ("p95", "p99") for name in ("champion", "candidate")])
