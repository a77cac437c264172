"""Tables and documents written by the engine: partition upserts, day documents, append-only ledgers and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def write_hourly(facts: DataFrame, path: str) -> None:
    """Overwrite the days that ``facts`` has, and only those."""
    days = facts.withColumn("date", F.to_date("ts"))
    days.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def day_documents(rows: DataFrame, *fields: Column) -> DataFrame:
    """(series_id, date, document): the JSON of each day's rows in order of time."""
    item = F.struct("ts", *fields)
    return rows.where("ts is not null").groupBy("series_id", F.to_date("ts").alias("date")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("series"))).alias("document"))


def alert_documents(alerts: DataFrame) -> DataFrame:
    """(series_id, date, counts by severity, document) of a day's alerts."""
    item = F.struct("ts", "type", "severity", "value")
    return alerts.groupBy("series_id", F.to_date("ts").alias("date")).agg(F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warning"), F.to_json(F.sort_array(F.collect_list(item))).alias("document"))


def retained(snapshots: DataFrame, by: list[str], taken_at: str, today: Column, days: int, per_group: int) -> DataFrame:
    """Snapshots of the last ``days`` and of these the latest ``per_group`` of each group; ties go by nothing, so
    taken_at identifies a snapshot."""
    recent = snapshots.where(F.col(taken_at) >= today - F.make_dt_interval(days=F.lit(days)))
    rank = F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc(taken_at)))
    return recent.withColumn("__i", rank).where(F.col("__i") <= per_group).drop("__i")


def snapshot_index(snapshots: DataFrame, by: list[str], taken_at: str) -> DataFrame:
    return snapshots.groupBy(*by).agg(F.count_distinct(taken_at).alias("n_snapshots"), F.max(taken_at).alias("latest"))


def append_vintages(ledger: DataFrame, captures: DataFrame, most: int = 48) -> DataFrame:
    """The rows of ``captures`` (series_id, captured_at, ts, ...) that a ledger gains: future hours only, captures that
    it doesn't have, and of each target day no more than make ``most`` with those it has, the first ones."""
    keys = ["series_id", F.to_date("ts").alias("target")]
    new = captures.where(F.col("ts") > F.col("captured_at")).withColumn("target", F.to_date("ts"))
    new = new.join(ledger.select("series_id", "captured_at").distinct(), ["series_id", "captured_at"], "left_anti")
    held = ledger.groupBy(*keys).agg(F.count_distinct("captured_at").alias("__held"))
    rank = F.dense_rank().over(W.partitionBy("series_id", "target").orderBy("captured_at"))
    out = new.withColumn("__i", rank).join(held, ["series_id", "target"], "left")
    return out.where(F.col("__i") + F.coalesce("__held", F.lit(0)) <= most).select(captures.columns)


def retained_vintages(ledger: DataFrame, today: Column, days: int = 120) -> DataFrame:
    """The ledger without captures older than ``days``."""
    return ledger.where(F.to_date("captured_at") >= F.date_sub(today, days))
