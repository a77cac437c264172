"""Structured Streaming jobs: incremental ingest with provenance, idempotent captures, windowed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import constants as C
from ..operators.joins import best_source


def read_stream(spark: SparkSession, path: str, schema, per_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, each once; the query's checkpoint remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def hourly_windows(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Hourly sums of (series_id, ts, value) events; an hour is final once the watermark has passed it."""
    e = events.withWatermark("ts", late)
    return e.groupBy("series_id", F.window("ts", "1 hour")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("actual_mw")).select("series_id", F.col("window.start").alias("ts"), "actual_mw")


def final_hour_fallback(feed: DataFrame, now) -> DataFrame:
    """The reference forecast, tagged, for hour 23 without an actual between half an hour and two hours after it."""
    age = F.timestamp_diff("MINUTE", F.col("ts"), F.lit(now)) - 60
    use = (F.hour("ts") == 23) & F.col("actual_mw").isNull() & (F.col("reference_mw") > 0) & age.between(30, 120)
    return feed.withColumns({"actual_source": F.when(use, C.FALLBACK).otherwise(F.when(F.col("actual_mw").isNotNull(), C.OBSERVED)), "actual_mw": F.when(use, F.col("reference_mw")).otherwise(F.col("actual_mw"))})


def upsert_stream(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the best-sourced row of each (series_id, ts) in a table partitioned by date: each micro-batch rewrites only
    the days that it touches, from a staged copy, so a batch that is run again gives the same table."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumn("date", F.to_date("ts"))
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        exists = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
        if exists:
            old = spark.read.schema(new.schema).parquet(path).join(new.select("date").distinct(), "date", "left_semi")
            new = old.select(new.columns).unionByName(new)
        staged = f"{checkpoint}/staged/{epoch}"
        best_source(new).write.mode("overwrite").parquet(staged)
        spark.read.schema(new.schema).parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)
        staged_path = spark._jvm.org.apache.hadoop.fs.Path(staged)
        staged_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(staged_path, True)

    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_captures(captures: DataFrame, late: str = "2 days") -> DataFrame:
    """Captures of (series_id, ts, captured_at) once each, future hours only."""
    future = captures.where(F.col("ts") > F.col("captured_at")).withWatermark("captured_at", late)
    return future.dropDuplicatesWithinWatermark(["series_id", "ts", "captured_at"])
