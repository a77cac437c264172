"""Error metrics, scorecards, coverage and quantiles of forecasts against actuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import scalars as S


def with_errors(rows: DataFrame, forecast: str, prefix: str = "") -> DataFrame:
    """Adds error (forecast - actual) and shape error (difference of consecutive hours' deltas, else null)."""
    by = W.partitionBy("series_id", F.to_date("ts")).orderBy("ts")
    step = F.hour("ts") == F.lag(F.hour("ts")).over(by) + 1
    shape = (F.col(forecast) - F.lag(forecast).over(by)) - (F.col("actual_mw") - F.lag("actual_mw").over(by))
    return rows.withColumns({f"{prefix}error": F.col(forecast) - F.col("actual_mw"), f"{prefix}shape_error": F.when(step, shape)})


def metric_columns(prefix: str = "") -> list[Column]:
    """n, MAE, bias, WAPE, RMSE, MAPE (actuals of zero left out), largest error and shape MAE, in percent and MW."""
    e, a = F.col(f"{prefix}error"), F.col("actual_mw")
    return [
        F.count(e).alias(f"{prefix}n"),
        F.avg(F.abs(e)).alias(f"{prefix}mae"),
        F.avg(e).alias(f"{prefix}bias"),
        F.try_divide(F.sum(F.abs(e)) * 100, F.sum(F.when(e.isNotNull(), F.abs(a)))).alias(f"{prefix}wape"),
        F.sqrt(F.avg(e * e)).alias(f"{prefix}rmse"),
        (F.avg(F.when(a != 0, F.abs(e / a))) * 100).alias(f"{prefix}mape"),
        F.max(F.abs(e)).alias(f"{prefix}max_error"),
        F.avg(F.abs(F.col(f"{prefix}shape_error"))).alias(f"{prefix}shape_mae"),
    ]


def metric_bundle(rows: DataFrame, forecast: str, calendar: DataFrame) -> DataFrame:
    """Metrics overall, by day type and by band of every series, from one pass: (series_id, regime, band, metrics)."""
    off = calendar.select("day", F.when(F.col("is_off"), "non_business").otherwise("business").alias("regime"))
    r = with_errors(rows, forecast).withColumns({"day": F.to_date("ts"), "band": S.band(F.hour("ts"))}).join(F.broadcast(off), "day", "left")
    sets = [["series_id"], ["series_id", "regime"], ["series_id", "band"]]
    return r.groupingSets([[F.col(c) for c in s] for s in sets], "series_id", "regime", "band").agg(*metric_columns())


#: Forecasts are close if their MAEs (MW) and WAPEs (percent) differ by no more; a better mean with an RMSE that is worse
#: by more than RISK (MW) is a mixed result.
CLOSE, RISK = (100.0, 0.2), 300.0


def scorecard(rows: DataFrame, model: str, reference: str, *by: Column, scale: float = 1.0) -> DataFrame:
    """Model against reference for each group: MAE, WAPE and RMSE of both, hour of the model's largest error (the first
    of equals), wins and ties, and a verdict. ``scale`` multiplies the verdict's limits in MW."""
    m, r = F.abs(F.col(model) - F.col("actual_mw")), F.abs(F.col(reference) - F.col("actual_mw"))
    total = F.sum("actual_mw")
    out = rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(m).alias("model_mae"),
        F.avg(r).alias("reference_mae"),
        (F.sum(m) / total * 100).alias("model_wape"),
        (F.sum(r) / total * 100).alias("reference_wape"),
        F.sqrt(F.avg(m * m)).alias("model_rmse"),
        F.sqrt(F.avg(r * r)).alias("reference_rmse"),
        F.max_by(F.hour("ts"), F.struct(F.round(m, 6), -F.unix_date(F.to_date("ts")), -F.hour("ts"))).alias("worst_hour"),
        F.count_if(m < r).alias("wins"),
        F.count_if(r < m).alias("losses"),
    )
    gap, wape, rmse = (F.col(f"model_{x}") - F.col(f"reference_{x}") for x in ("mae", "wape", "rmse"))
    close = (F.abs(gap) <= CLOSE[0] * scale) & (F.abs(wape) <= CLOSE[1])
    model, other = (gap < 0) & (wape < 0), (gap > 0) & (wape > 0)
    verdict = F.when(gap.isNull() | wape.isNull(), "insufficient").when(close, "close").when(model & (rmse <= RISK * scale), "model_better").when(other & (rmse >= -RISK * scale), "reference_better").otherwise("mixed")
    return out.withColumns({"ties": F.col("n") - F.col("wins") - F.col("losses"), "verdict": verdict})


def peaks(rows: DataFrame, *columns: str) -> DataFrame:
    """Per series and day the largest value of each column and its first hour."""
    top = lambda c: F.max(F.struct(F.col(c), -F.hour("ts")))
    out = rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(*[top(c).alias(c) for c in columns])
    return out.select("series_id", "day", *[x for c in columns for x in (F.col(f"{c}.{c}").alias(f"{c}_peak"), (-F.col(f"{c}.col2")).alias(f"{c}_peak_hour"))])


def coverage(rows: DataFrame, lower: str, upper: str, *by: str) -> DataFrame:
    """Share of actuals inside a band in percent, mean width, hours outside above and below."""
    a, lo, hi = F.col("actual_mw"), F.col(lower), F.col(upper)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), (F.avg(a.between(lo, hi).cast("int")) * 100).alias("coverage_pct"), F.avg(hi - lo).alias("mean_width"), F.count_if(a > hi).alias("above"), F.count_if(a < lo).alias("below"))


def coverage_flags(table: DataFrame, target: float = 95.0, tolerance: float = 1.0, least: int = 24) -> DataFrame:
    """under, over or ok for rows of enough hours, else insufficient."""
    c = F.col("coverage_pct")
    flag = F.when(F.col("n") < least, "insufficient").when(c < target - tolerance, "under").when(c > target + tolerance, "over").otherwise("ok")
    return table.withColumn("flag", flag)


def conformal_quantile(rows: DataFrame, value: Column, share: float, *by: str) -> DataFrame:
    """Finite-sample upper quantile of each group: the value of rank min(n, ceil((n + 1) share)), no interpolation."""
    v = rows.withColumn("v", value).where("v is not null")
    ranked = v.withColumns({"i": F.row_number().over(W.partitionBy(*by).orderBy("v")), "n": F.count("*").over(W.partitionBy(*by))})
    return ranked.where(F.col("i") == F.least(F.col("n"), F.ceil((F.col("n") + 1) * share))).select(*by, "n", F.col("v").alias("quantile"))


def _daily_errors(rows: DataFrame, model: str, reference: str) -> DataFrame:
    """(series_id, day, new, old): mean absolute errors of the days on which both forecasts have them."""
    m, r = F.abs(F.col(model) - F.col("actual_mw")), F.abs(F.col(reference) - F.col("actual_mw"))
    return rows.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.avg(m).alias("new"), F.avg(r).alias("old")).where("new is not null and old is not null")


def _resampled(days: DataFrame, draws: int, seed: int) -> DataFrame:
    """(series_id, x, n, sums): the days of a series in order, and for each draw the sums of new and old over n days drawn
    with repetition. Only the daily errors are shuffled, one row a day; a series' days are one row of two doubles a day,
    and its draws are made inside that row. A pick is a function of seed, draw and place, so reruns agree."""
    held = days.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("day", "new", "old"))).alias("x"), F.count("*").cast("int").alias("n"))
    spot = lambda b, k: (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), b.cast("string"), k.cast("string"))), 1, 13), 16, 10).cast("long") % F.col("n")).cast("int")
    zero = F.struct(F.lit(0.0).alias("new"), F.lit(0.0).alias("old"))

    def draw(b: Column) -> Column:
        picked = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.get("x", spot(b, k)))
        return F.aggregate(picked, zero, lambda acc, d: F.struct((acc["new"] + d["new"]).alias("new"), (acc["old"] + d["old"]).alias("old")))

    return held.withColumn("sums", F.when(F.col("n") >= LEAST_DAYS, F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), draw)))


def _quantile(values: str, share: float) -> Column:
    """The quantile of an ordered array, linear between neighbours; null for an empty one."""
    at = (F.size(values) - 1) * F.lit(share)
    low = F.floor(at).cast("int")
    a, b = F.get(values, low), F.get(values, F.ceil(at).cast("int"))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


#: Days below which an interval says nothing.
LEAST_DAYS = 7


def paired_bootstrap(rows: DataFrame, model: str, reference: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """95 % interval of the difference of daily MAEs per series, from hashed draws of whole days: (series_id, days,
    mean_difference, low, high); series of fewer than 7 days have no row."""
    drawn = _resampled(_daily_errors(rows, model, reference), draws, seed).where(F.col("n") >= LEAST_DAYS)
    d = drawn.withColumn("diffs", F.array_sort(F.transform("sums", lambda s: (s["new"] - s["old"]) / F.col("n"))))
    total = F.aggregate("x", F.lit(0.0), lambda acc, y: acc + y["new"] - y["old"])
    return d.select("series_id", F.col("n").cast("long").alias("days"), (total / F.col("n")).alias("mean_difference"), _quantile("diffs", 0.025).alias("low"), _quantile("diffs", 0.975).alias("high"))


def paired_ratio_bootstrap(rows: DataFrame, model: str, reference: str, draws: int = 20000, seed: int = 20260821) -> DataFrame:
    """95 % intervals of the ratio and of the difference of daily MAEs per series: (series_id, valid, days, better_days,
    mae_ratio, ratio_low, ratio_high, mean_difference, low, high).

    With fewer than 7 days, or a daily error that is not finite, valid is false and the intervals are null. A draw whose
    reference errors are all zero has no ratio and is left out of the ratio's interval, which is null if none is left."""
    drawn = _resampled(_daily_errors(rows, model, reference), draws, seed)
    finite = ~F.exists("x", lambda d: F.isnan(d["new"]) | F.isnan(d["old"]) | (F.abs(d["new"]) == float("inf")) | (F.abs(d["old"]) == float("inf")))
    d = drawn.withColumn("valid", finite & (F.col("n") >= LEAST_DAYS)).withColumn("sums", F.when(F.col("valid"), F.col("sums")))
    d = d.withColumns({
        "ratios": F.array_sort(F.filter(F.transform("sums", lambda s: s["new"] / F.nullif(s["old"], F.lit(0.0))), lambda v: v.isNotNull())),
        "diffs": F.array_sort(F.transform("sums", lambda s: (s["new"] - s["old"]) / F.col("n"))),
    })

    total = lambda c: F.aggregate("x", F.lit(0.0), lambda acc, y: acc + y[c])
    parts = {
        "mae_ratio": total("new") / F.nullif(total("old"), F.lit(0.0)),
        "ratio_low": _quantile("ratios", 0.025),
        "ratio_high": _quantile("ratios", 0.975),
        "mean_difference": (total("new") - total("old")) / F.col("n"),
        "low": _quantile("diffs", 0.025),
        "high": _quantile("diffs", 0.975),
    }
    better = F.size(F.filter("x", lambda y: y["new"] < y["old"])).cast("long")
    return d.select("series_id", "valid", F.col("n").cast("long").alias("days"), better.alias("better_days"), *[F.when(F.col("valid"), c).alias(k) for k, c in parts.items()])
