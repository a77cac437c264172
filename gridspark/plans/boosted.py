"""Median regression by boosted trees over the features of all series, with split-conformal bands.

One global model is fitted on every series' rows; a second one predicts the change against the same hour yesterday, and
working rows blend the two. Quantile trees are not at hand, so bands come from residual quantiles of held-out days by day
type and band of the day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.intervals import assemble_bands

BLEND, HELD_OUT_DAYS, LEAST_ROWS = 0.5, 7, 336
#: Features that a target day may use: nothing of the day itself but its calendar and weather.
COLUMNS = ("hour", "dayofweek", "month", "is_non_business_day", "lag_24h", "lag_48h", "lag_168h", "roll_4w_mean", "roll_4w_std", "recent_same_business_type_mean")


@dataclass
class Boosted:
    direct: PipelineModel
    change: PipelineModel
    residuals: DataFrame  #: regime, band, q025, q975
    columns: tuple[str, ...]


def _fit(rows: DataFrame, label: Column, columns: tuple[str, ...], trees: int, seed: int) -> PipelineModel:
    stages = [
        StringIndexer(inputCol="series_id", outputCol="series_index", handleInvalid="keep"),
        VectorAssembler(inputCols=[*columns, "series_index"], outputCol="x", handleInvalid="skip"),
        GBTRegressor(featuresCol="x", labelCol="label", predictionCol="y", lossType="absolute", maxIter=trees, maxDepth=4, seed=seed, maxBins=64),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("label", label))


def _predict(model: PipelineModel, rows: DataFrame, name: str) -> DataFrame:
    return model.transform(rows).drop("x", "series_index").withColumnRenamed("y", name)


def _blended(model: Boosted, rows: DataFrame) -> DataFrame:
    out = _predict(model.change, _predict(model.direct, rows, "__direct"), "__change")
    mixed = (1 - BLEND) * F.col("__direct") + BLEND * (F.col("lag_24h") + F.col("__change"))
    value = F.when(F.col("is_non_business_day") == 0, mixed).otherwise(F.col("__direct"))
    return out.withColumn("forecast_mw", value).drop("__direct", "__change")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"regime": F.when(F.col("is_non_business_day") == 1, "non_business").otherwise("business"), "band": S.band(F.hour("ts"))})


def fit(features: DataFrame, before, columns: tuple[str, ...] = COLUMNS, trees: int = 20, seed: int = 7) -> Boosted:
    """Fit on complete feature rows with an actual before a day; the last days of them only calibrate the bands."""
    rows = features.where(F.to_date("ts") < F.lit(before).cast("date")).na.drop(subset=["actual_mw", *columns])
    cut = F.date_sub(F.lit(before).cast("date"), HELD_OUT_DAYS)
    train, held = rows.where(F.to_date("ts") < cut), rows.where(F.to_date("ts") >= cut)
    n = train.count()
    if n < LEAST_ROWS:
        raise ValueError(f"{n} complete training rows before {before}; at least {LEAST_ROWS} are needed")
    model = Boosted(_fit(train, F.col("actual_mw"), columns, trees, seed), _fit(train, F.col("actual_mw") - F.col("lag_24h"), columns, trees, seed), None, columns)
    error = F.col("actual_mw") - F.col("forecast_mw")
    model.residuals = _groups(_blended(model, held)).groupBy("regime", "band").agg(F.percentile(error, F.lit(0.025)).alias("r025"), F.percentile(error, F.lit(0.975)).alias("r975"))
    return model


def predict(model: Boosted, features: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """(series_id, ts, forecast_mw and bands, model_name) of feature rows that are complete; ``fallback`` rows stand in
    where a forecast is missing."""
    rows = features.na.drop(subset=list(model.columns))
    out = _groups(_blended(model, rows)).join(F.broadcast(model.residuals), ["regime", "band"], "left")
    out = out.withColumns({"q025": F.col("forecast_mw") + F.coalesce("r025", F.lit(0.0)), "q975": F.col("forecast_mw") + F.coalesce("r975", F.lit(0.0))})
    names = ["series_id", "ts", "forecast_mw", "p95_lower_mw", "p95_upper_mw", "p99_lower_mw", "p99_upper_mw"]
    out = assemble_bands(out).select(*names, F.lit("boosted_median").alias("model_name"))
    if fallback is None:
        return out
    rest = fallback.join(out, ["series_id", "ts"], "left_anti").select(*names, F.lit("seasonal_baseline").alias("model_name"))
    return out.unionByName(rest)
