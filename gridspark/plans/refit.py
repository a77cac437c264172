"""Linear refits at many cut-offs at once, and the rolling temporal hold-out that they serve.

A day's rows become one Gram matrix and one moment vector; sums of those over all days before a cut-off are all that a
least-squares fit needs. So each cut-off's fit is a prefix sum (or a difference of two, for a training window) and one
small solve, whatever the length of the history, and no fit reads the rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def scaled(names: tuple[str, ...], centre: float, unit: float) -> list:
    """The design of a row: 1 and the features, moved and scaled so that sums of squares keep their digits."""
    return [F.lit(1.0), *[(F.col(n) - centre) / unit for n in names]]


def day_moments(rows: DataFrame, features: tuple[str, ...], target: str = "actual_mw", centre: float = 0.0, unit: float = 1.0) -> DataFrame:
    """One row for each series and day: n, and the sums of products of the design (upper triangle) and of it with the
    target. Rows with an unknown feature or target do not count."""
    z, y = scaled(features, centre, unit), (F.col(target) - centre) / unit
    known = rows.dropna(subset=[*features, target])
    products = [z[i] * z[j] for i in range(len(z)) for j in range(i, len(z))] + [v * y for v in z]
    sums = [F.sum(p).alias(f"s{k}") for k, p in enumerate(products)]
    return known.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *sums)


def moments_before(moments: DataFrame, cutoffs: DataFrame, train_days: int | None = None) -> DataFrame:
    """(series_id, cutoff, n, m): sums of the days before each cut-off (series_id, cutoff), of the last ``train_days``
    only if given. Cut-offs stand in the order of days as markers, so each series is sorted once."""
    sums = [c for c in moments.columns if c[0] == "s" and c[1:].isdigit()]
    none = [F.lit(0).cast("long").alias("n"), *[F.lit(0.0).alias(c) for c in sums]]
    markers = cutoffs.select("series_id", F.col("cutoff").alias("day"), *none, F.lit(True).alias("mark"))
    all_days = moments.select("series_id", "day", "n", *sums, F.lit(False).alias("mark")).unionByName(markers.distinct())
    past = W.partitionBy("series_id").orderBy(F.unix_date("day")).rangeBetween(-train_days if train_days else W.unboundedPreceding, -1)
    held = all_days.select("series_id", F.col("day").alias("cutoff"), "mark", F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n"), F.array(*[F.coalesce(F.sum(c).over(past), F.lit(0.0)) for c in sums]).alias("m"))
    return held.where("mark").drop("mark")


def solve(before: DataFrame, width: int, ridge: float = 0.0) -> DataFrame:
    """(series_id, cutoff, n, beta): least squares for each row of ``moments_before``; null where rows are fewer than
    columns or do not determine them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = np.triu_indices(width)
        for batch in batches:
            m = batch.column("m").flatten().to_numpy().reshape(-1, len(upper[0]) + width)
            gram = np.zeros((len(m), width, width))
            gram[:, upper[0], upper[1]] = m[:, : len(upper[0])]
            gram = gram + np.triu(gram, 1).transpose(0, 2, 1) + ridge * np.eye(width)
            fits = (batch.column("n").to_numpy() >= width) & (np.linalg.cond(gram) < 1e12 if len(m) else np.empty(0, bool))
            beta = np.full((len(m), width), np.nan)
            beta[fits] = np.linalg.solve(gram[fits], m[fits, len(upper[0]) :, None])[..., 0]
            betas = pa.array([b.tolist() if ok else None for b, ok in zip(beta, fits, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("series_id", "cutoff", "n")), betas], ["series_id", "cutoff", "n", "beta"])

    return before.select("series_id", "cutoff", F.col("n").cast("long").alias("n"), "m").mapInArrow(run, "series_id string, cutoff date, n long, beta array<double>")


def holdout(rows: DataFrame, features: tuple[str, ...], cutoffs: DataFrame, days: int = 1, train_days: int | None = None, centre: float = 0.0, unit: float = 1.0, ridge: float = 0.0) -> DataFrame:
    """Forecasts of the ``days`` days from each cut-off on by the fit on all days before it: series_id, cutoff, ts,
    actual_mw, forecast_mw, n_train. Cut-offs without a fit have no rows."""
    before = moments_before(day_moments(rows, features, centre=centre, unit=unit), cutoffs, train_days)
    fits = solve(before, len(features) + 1, ridge).where("beta is not null").withColumnRenamed("n", "n_train")
    ahead = fits.select("*", F.explode(F.sequence(F.col("cutoff"), F.date_add("cutoff", days - 1))).alias("day"))
    tested = rows.dropna(subset=[*features, "actual_mw"]).withColumn("day", F.to_date("ts")).join(ahead, ["series_id", "day"])
    said = sum((F.get("beta", F.lit(i)) * z for i, z in enumerate(scaled(features, centre, unit))), F.lit(0.0))
    others = [c for c in rows.columns if c not in ("series_id", "ts", "actual_mw", "forecast_mw", "day", "cutoff", "n_train")]
    return tested.select("series_id", "cutoff", "ts", "actual_mw", (said * unit + centre).alias("forecast_mw"), "n_train", *others)


def holdout_report(tested: DataFrame, reference: str) -> DataFrame:
    """One row for each series and cut-off: hours, training rows, errors of the fit and of ``reference``, improvement in
    percent and which is better."""
    e, r = F.abs(F.col("forecast_mw") - F.col("actual_mw")), F.abs(F.col(reference) - F.col("actual_mw"))
    known = tested.where(F.col(reference).isNotNull())
    out = known.groupBy("series_id", "cutoff").agg(F.count("*").alias("hours"), F.max("n_train").alias("n_train"), F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (F.sum(e) / F.sum(F.abs("actual_mw")) * 100).alias("wape"), F.avg(r).alias("reference_mae"))
    return out.withColumn("improvement_pct", F.try_divide(F.col("reference_mae") - F.col("mae"), F.col("reference_mae")) * 100).withColumn("better", F.when(F.col("mae") < F.col("reference_mae"), "model").when(F.col("mae") > F.col("reference_mae"), "reference").otherwise("tie"))
