"""Evaluation plans: matched vintages, gates, replay, model health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S


def matched_vintages(vintages: DataFrame, model: str = "model_mw", reference: str = "reference_mw", last_days: int | None = None) -> DataFrame:
    """One row for each series, target hour and lead bucket: the capture with the smallest positive lead; optionally of
    the last days with data only."""
    lead = F.timestamp_diff("MINUTE", F.col("captured_at"), F.col("ts"))
    v = vintages.withColumns({"lead_min": lead, "bucket": S.lead_bucket(lead)}).where("bucket is not null")
    one = v.groupBy("series_id", "ts", "bucket").agg(F.min_by(F.struct("captured_at", "lead_min", "actual_mw", model, reference), "lead_min").alias("x")).select("series_id", "ts", "bucket", "x.*")
    if last_days is None:
        return one
    day = F.dense_rank().over(W.partitionBy("series_id").orderBy(F.desc(F.to_date("ts"))))
    return one.withColumn("__d", day).where(F.col("__d") <= last_days).drop("__d")


def vintage_report(matched: DataFrame, model: str = "model_mw", reference: str = "reference_mw") -> DataFrame:
    """MAE of model and reference and their ratio per series and bucket, overall and by band."""
    m, r = F.abs(F.col(model) - F.col("actual_mw")), F.abs(F.col(reference) - F.col("actual_mw"))
    b = matched.withColumn("band", S.band(F.hour("ts")))
    sets = [[F.col("series_id"), F.col("bucket")], [F.col("series_id"), F.col("bucket"), F.col("band")]]
    out = b.groupingSets(sets, "series_id", "bucket", "band").agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("days"), F.avg(m).alias("model_mae"), F.avg(r).alias("reference_mae"))
    return out.withColumn("ratio", F.try_divide("model_mae", "reference_mae"))


def qualification(report: DataFrame, least_days: int = 14, most_ratio: float = 1.0) -> DataFrame:
    """collecting, qualified or not_qualified for each series from the buckets of its overall rows."""
    r = report.where("band is null").groupBy("series_id").agg(F.min("days").alias("days"), F.max("ratio").alias("worst_ratio"), F.count("*").alias("buckets"))
    status = F.when((F.col("days") < least_days) | (F.col("buckets") < 4), "collecting").when(F.col("worst_ratio") <= most_ratio, "qualified").otherwise("not_qualified")
    return r.withColumn("status", status)


def segment_gate(candidate: DataFrame, champion: DataFrame, least: int = 24, tolerance: float = 1.0) -> DataFrame:
    """Segments of (series_id, regime, band, n, mae, ...) where a candidate's MAE passes, at ``tolerance`` times the
    champion's; too few hours pass."""
    keys = ["series_id", "regime", "band"]
    other = champion.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("mae").alias("champion_mae"))
    same = None
    for k in keys:
        e = F.col(k).eqNullSafe(F.col(f"o_{k}"))
        same = e if same is None else same & e
    j = candidate.join(other, same).drop(*[f"o_{k}" for k in keys])
    return j.withColumn("passes", (F.col("n") < least) | (F.col("mae") <= tolerance * F.col("champion_mae")))


def absolute_gate(metrics: DataFrame, limits: dict[str, float]) -> DataFrame:
    """(series_id, metric, value, limit) of every overall metric above its limit."""
    m = metrics.where("regime is null and band is null")
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("limit")) for k, v in limits.items()])
    return m.select("series_id", F.explode(rows).alias("x")).select("series_id", "x.*").where("value > limit")


def model_health(metrics: DataFrame, mae: tuple[float, float], wape: tuple[float, float], least: int = 72) -> DataFrame:
    """insufficient, degraded, review_required or healthy for each series, from (warning, critical) limits."""
    m = metrics.where("regime is null and band is null")
    over = lambda k: (F.col("mae") > mae[k]) | (F.col("wape") > wape[k])
    return m.select("series_id", "n", "mae", "wape", F.when(F.col("n") < least, "insufficient").when(over(1), "degraded").when(over(0), "review_required").otherwise("healthy").alias("health"))


def prediction_drift(champion: DataFrame, challenger: DataFrame, top: int = 5) -> DataFrame:
    """The largest changes between two forecasts of the same hours, per series, with the mean absolute change."""
    j = champion.select("series_id", "ts", F.col("forecast_mw").alias("champion_mw")).join(challenger.select("series_id", "ts", F.col("forecast_mw").alias("challenger_mw")), ["series_id", "ts"], "full_outer")
    d = j.withColumn("change", F.col("challenger_mw") - F.col("champion_mw"))
    by = W.partitionBy("series_id")
    d = d.withColumns({"mean_abs_change": F.avg(F.abs("change")).over(by), "rank": F.row_number().over(by.orderBy(F.abs("change").desc_nulls_last(), "ts"))})
    return d.where(F.col("rank") <= top)
