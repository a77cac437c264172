"""Reserve, spike/drop and drift alerts of hourly facts against forecast bands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WARNING_PCT, CRITICAL_PCT = 92.0, 97.0
WARNING_BREACH, CRITICAL_BREACH = (300.0, 1.0), (500.0, 2.0)
ALPHA, DRIFT_MW, SUSTAINED = 0.3, 800.0, 3


def reserve_risk(facts: DataFrame, warning: float = WARNING_PCT, critical: float = CRITICAL_PCT) -> DataFrame:
    """Hours whose usage_pct reaches a limit."""
    severity = F.when(F.col("usage_pct") >= critical, "critical").otherwise("warning")
    return facts.where(F.col("usage_pct") >= warning).select("series_id", "ts", F.lit("reserve_risk").alias("type"), severity.alias("severity"), F.col("ts").alias("end_ts"), F.col("usage_pct").alias("value"))


def spike_drop(facts: DataFrame, forecast: DataFrame, warning: tuple = WARNING_BREACH, critical: tuple = CRITICAL_BREACH) -> DataFrame:
    """Hours outside the 99 % band by enough MW or percent of the actual; the 95 % band alone never alerts."""
    j = facts.where("actual_mw is not null").join(forecast, ["series_id", "ts"])
    above, below = F.col("actual_mw") - F.col("p99_upper_mw"), F.col("p99_lower_mw") - F.col("actual_mw")
    breach = F.when(above > 0, above).when(below > 0, below)
    share = F.when(F.col("actual_mw") > 0, breach / F.col("actual_mw") * 100).otherwise(F.lit(0.0))
    over = lambda limit: (breach >= limit[0]) | (share >= limit[1])
    severity = F.when(over(critical), "critical").when(over(warning), "warning")
    kind = F.when(above > 0, "spike").otherwise("drop")
    out = j.select("series_id", "ts", kind.alias("type"), severity.alias("severity"), F.col("ts").alias("end_ts"), breach.alias("value"))
    return out.where("severity is not null")


def drift(facts: DataFrame, forecast: DataFrame, alpha: float = ALPHA, limit: float = DRIFT_MW, sustained: int = SUSTAINED) -> DataFrame:
    """Runs of joined rows of a day whose smoothed residual stays beyond a limit on one side."""
    j = facts.where("actual_mw is not null").join(forecast, ["series_id", "ts"]).select("series_id", F.to_date("ts").alias("day"), "ts", (F.col("actual_mw") - F.col("forecast_mw")).alias("residual"))
    by = W.partitionBy("series_id", "day").orderBy("ts")
    held = F.collect_list("residual").over(by.rowsBetween(W.unboundedPreceding, 0))
    smooth = F.aggregate(F.slice(held, 2, 10_000), held[0], lambda acc, x: alpha * x + (1 - alpha) * acc)
    side = F.when(F.col("ewma") > limit, 1).when(F.col("ewma") < -limit, -1).otherwise(0)
    e = j.withColumn("ewma", smooth).withColumn("side", side)
    new = F.coalesce((F.col("side") != F.lag("side").over(by)).cast("int"), F.lit(1))
    runs = e.withColumn("run", F.sum(new).over(by.rowsBetween(W.unboundedPreceding, 0))).where("side <> 0")
    found = runs.groupBy("series_id", "day", "run").agg(F.min("ts").alias("ts"), F.max("ts").alias("end_ts"), F.avg("residual").alias("value"), F.count("*").alias("n"))
    return found.where(F.col("n") >= sustained).select("series_id", "ts", F.lit("drift").alias("type"), F.lit("warning").alias("severity"), "end_ts", "value")


def detect(facts: DataFrame, forecast: DataFrame, breach: tuple = (WARNING_BREACH, CRITICAL_BREACH), limit: float = DRIFT_MW, alpha: float = ALPHA, sustained: int = SUSTAINED) -> DataFrame:
    """All three kinds from one join of facts and forecast; nothing is merged, an hour may have several."""
    c = F.col
    j = facts.join(forecast, ["series_id", "ts"], "left").withColumns({"day": F.to_date("ts"), "residual": c("actual_mw") - c("forecast_mw")})
    above, below = c("actual_mw") - c("p99_upper_mw"), c("p99_lower_mw") - c("actual_mw")
    out = F.when(above > 0, above).when(below > 0, below)
    share = F.when(c("actual_mw") > 0, out / c("actual_mw") * 100).otherwise(F.lit(0.0))
    over = lambda x: (out >= x[0]) | (share >= x[1])
    day = W.partitionBy("series_id", "day", c("residual").isNull()).orderBy("ts")
    upto = day.rowsBetween(W.unboundedPreceding, 0)
    held = F.collect_list("residual").over(upto)
    smooth = F.aggregate(F.slice(held, 2, 10_000), F.get(held, F.lit(0)), lambda acc, x: alpha * x + (1 - alpha) * acc)
    j = j.withColumn("ewma", smooth).withColumn("side", F.when(c("ewma") > limit, 1).when(c("ewma") < -limit, -1).otherwise(0))
    j = j.withColumn("new", F.coalesce((c("side") != F.lag("side").over(day)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(upto))
    run = W.partitionBy("series_id", "day", c("residual").isNull(), "run")
    j = j.withColumns({"first_ts": F.min("ts").over(run), "last_ts": F.max("ts").over(run), "mean": F.avg("residual").over(run), "hours": F.count("residual").over(run)})
    alert = lambda on, kind, severity, end, value: F.when(on, F.struct(kind.alias("type"), severity.alias("severity"), end.alias("end_ts"), value.alias("value")))
    alerts = F.array_compact(
        F.array(
            alert(c("usage_pct") >= WARNING_PCT, F.lit("reserve_risk"), F.when(c("usage_pct") >= CRITICAL_PCT, "critical").otherwise("warning"), c("ts"), c("usage_pct")),
            alert(over(breach[1]) | over(breach[0]), F.when(above > 0, "spike").otherwise("drop"), F.when(over(breach[1]), "critical").otherwise("warning"), c("ts"), out),
            alert((c("side") != 0) & (c("ts") == c("first_ts")) & (c("hours") >= sustained), F.lit("drift"), F.lit("warning"), c("last_ts"), c("mean")),
        )
    )
    return j.select("series_id", "ts", F.explode(alerts).alias("x")).select("series_id", "ts", "x.*")


def severity_rollup(alerts: DataFrame) -> DataFrame:
    """Worst reserve severity and alert counts of each series and day."""
    rank = F.when(F.col("severity") == "critical", 2).otherwise(1)
    reserve = F.max(F.when(F.col("type") == "reserve_risk", rank))
    named = F.when(reserve == 2, "critical").when(reserve == 1, "warning").otherwise("normal")
    return alerts.groupBy("series_id", F.to_date("ts").alias("day")).agg(named.alias("severity"), F.count_if(F.col("severity") == "critical").alias("n_critical"), F.count_if(F.col("severity") == "warning").alias("n_warning"))
