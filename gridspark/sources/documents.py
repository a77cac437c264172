"""Published documents and feeds as rows, and back: intraday feeds, forecast and actual documents, stored facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import constants as C
from ..functions import scalars as S
from .files import UNIT, half_hour_area

_SERIES = "series array<struct<ts: string, actualMw: double, actualSource: string, referenceMw: double, forecastMw: double, p95LowerMw: double, p95UpperMw: double>>, model struct<name: string>"


def intraday_feed(lines: DataFrame, now: Column | None = None) -> DataFrame:
    """(source_file, ts, actual_mw, actual_source, reference_mw, usage_pct, supply_mw) of the first hourly block of each
    feed: from its header to the first line that begins with no date. Only positive actuals count; with ``now``, hour 23
    without one takes the reference forecast between half an hour and two hours after it has ended."""
    heads = lines.where(F.col("line").startswith("DATE,TIME")).groupBy("source_file").agg(F.min("seq").alias("head"))
    body = lines.join(heads, "source_file").where("seq > head")
    ends = body.where(~F.trim("line").rlike("^[0-9]{4}")).groupBy("source_file").agg(F.min("seq").alias("end"))
    p = F.split(F.trim("line"), ",")
    rows = body.join(ends, "source_file", "left").where((F.col("end").isNull() | (F.col("seq") < F.col("end"))) & (F.size(p) >= 6))
    c = [F.trim(F.get(p, i)) for i in range(6)]
    mw = lambda x: F.when(S.safe_double(x) > 0, F.round(S.safe_double(x) * UNIT, 1))
    out = rows.select("source_file", S.local_timestamp(c[0], c[1]).cast("timestamp_ntz").alias("ts"), mw(c[2]).alias("actual_mw"), mw(c[3]).alias("reference_mw"), S.safe_double(c[4]).alias("usage_pct"), mw(c[5]).alias("supply_mw")).where("ts is not null")
    late = F.lit(False)
    if now is not None:
        age = F.timestamp_diff("MINUTE", F.col("ts"), now) - 60
        late = (F.hour("ts") == 23) & F.col("actual_mw").isNull() & F.col("reference_mw").isNotNull() & age.between(30, 120)
    source = F.when(F.col("actual_mw").isNotNull(), C.OBSERVED).when(late, C.FALLBACK)
    return out.withColumn("actual_source", source).withColumn("actual_mw", F.when(late, F.col("reference_mw")).otherwise(F.col("actual_mw")))


def observed_range(blocks: DataFrame, first: Column, last: Column) -> DataFrame:
    """Rows (series_id, ts, ...) of overlapping observation blocks from ``first`` to ``last`` day, the latest of each time
    by block."""
    inside = blocks.where(F.to_date("ts").between(first, last))
    return inside.groupBy("series_id", "ts").agg(F.max_by(F.struct(*blocks.columns), "block").alias("x")).select("x.*")


def area_pairs(actual: DataFrame, forecast: DataFrame) -> DataFrame:
    """(series_id, day, hour, actual_mw, forecast_mw, actual_delta_mw, forecast_delta_mw) of complete half-hour days that
    both tables have."""
    side = lambda df, n: half_hour_area(df).select("series_id", "day", "hour", F.col("mean_mw").alias(f"{n}_mw"), F.col("delta_mw").alias(f"{n}_delta_mw"))
    return side(actual, "actual").join(side(forecast, "forecast"), ["series_id", "day", "hour"])


def model_family(name: Column) -> Column:
    """A model's name without the mark of its intraday correction."""
    return F.regexp_replace(name, "_intraday_residual$", "")


def document_rows(documents: DataFrame, family: str | None = None) -> DataFrame:
    """(series_id, date, model, ts, actual_mw, actual_source, reference_mw, forecast_mw, p95_lower_mw, p95_upper_mw) of
    documents (series_id, date, document); with ``family`` those of models whose family begins so."""
    d = documents.select("series_id", "date", F.from_json("document", _SERIES).alias("d")).select("series_id", "date", model_family(F.col("d.model.name")).alias("model"), F.explode("d.series").alias("x"))
    if family is not None:
        d = d.where(F.col("model").startswith(family))
    x = lambda name: F.col(f"x.{name}")
    return d.select("series_id", "date", "model", F.try_to_timestamp(x("ts")).cast("timestamp_ntz").alias("ts"), x("actualMw").alias("actual_mw"), x("actualSource").alias("actual_source"), x("referenceMw").alias("reference_mw"), x("forecastMw").alias("forecast_mw"), x("p95LowerMw").alias("p95_lower_mw"), x("p95UpperMw").alias("p95_upper_mw"))


def comparable_rows(actual_documents: DataFrame, forecast_documents: DataFrame) -> DataFrame:
    """(series_id, ts, actual_mw, reference_mw, forecast_mw): hours with an observed actual and a forecast."""
    a = document_rows(actual_documents).where((F.col("actual_source") == C.OBSERVED) & F.col("actual_mw").isNotNull()).select("series_id", "ts", "actual_mw", "reference_mw")
    f = document_rows(forecast_documents).where("forecast_mw is not null").select("series_id", "ts", "forecast_mw")
    return a.join(f, ["series_id", "ts"])


def stored_facts(spark: SparkSession, path: str, first: str | None = None) -> DataFrame:
    """Facts written by day, from ``first`` on (other days are not read). Tables of older versions lack columns: they are
    null, and an actual without a source is an old observation."""
    t = spark.read.option("mergeSchema", "true").parquet(path)
    if first is not None:
        t = t.where(F.col("date") >= F.lit(first).cast("date"))
    for name, kind in (("actual_mw", "double"), ("reference_mw", "double"), ("usage_pct", "double"), ("supply_mw", "double"), ("actual_source", "string")):
        if name not in t.columns:
            t = t.withColumn(name, F.lit(None).cast(kind))
    return t.withColumn("actual_source", F.when(F.col("actual_mw").isNotNull(), F.coalesce("actual_source", F.lit(C.OBSERVED_LEGACY))))


def actual_documents(rows: DataFrame) -> DataFrame:
    """(series_id, date, document) of (series_id, ts, actual_mw, actual_source, reference_mw); missing values are left
    out of the JSON."""
    return _documents(rows, F.col("actual_mw").alias("actualMw"), F.col("actual_source").alias("actualSource"), F.col("reference_mw").alias("referenceMw"))


def forecast_documents(rows: DataFrame, model: str) -> DataFrame:
    """(series_id, date, available, document) of (series_id, ts, forecast_mw, p95_lower_mw, p95_upper_mw): a day is
    available with 24 finite values; otherwise its document says so and has no series."""
    d = _documents(rows.where(S.finite(F.col("forecast_mw")).isNotNull()), F.col("forecast_mw").alias("forecastMw"), F.col("p95_lower_mw").alias("p95LowerMw"), F.col("p95_upper_mw").alias("p95UpperMw"), model=model)
    days = rows.groupBy("series_id", F.to_date("ts").alias("date")).agg((F.count(S.finite(F.col("forecast_mw"))) == 24).alias("available"))
    out = days.join(d, ["series_id", "date"], "left")
    missing = F.to_json(F.struct(F.lit(False).alias("available"), F.struct(F.lit(model).alias("name")).alias("model")))
    return out.withColumn("document", F.when(F.col("available"), F.col("document")).otherwise(missing))


def _documents(rows: DataFrame, *fields: Column, model: str | None = None) -> DataFrame:
    item = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"), *fields)
    parts = [F.sort_array(F.collect_list(item)).alias("series")]
    if model is not None:
        parts.append(F.struct(F.lit(model).alias("name")).alias("model"))
    return rows.where("ts is not null").groupBy("series_id", F.to_date("ts").alias("date")).agg(F.to_json(F.struct(*parts)).alias("document"))


def status_rows(facts: DataFrame, failed: DataFrame, today: Column) -> DataFrame:
    """One row per series: days held, first and last day, hours missing inside them, failed files and whether today has
    any actual."""
    day = F.to_date("ts")
    held = facts.where("actual_mw is not null").groupBy("series_id").agg(F.count_distinct(day).alias("days"), F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count_distinct("ts").alias("hours"), F.bool_or(day == today).alias("has_today"))
    held = held.withColumn("missing_hours", (F.datediff("last_day", "first_day") + 1) * 24 - F.col("hours"))
    bad = failed.groupBy("series_id").agg(F.count("*").alias("failed_files"))
    return held.join(bad, "series_id", "left").withColumn("failed_files", F.coalesce("failed_files", F.lit(0))).drop("hours")


def append_calibrations(ledger: DataFrame, rows: DataFrame, per_day: int = 24, days: int = 14) -> DataFrame:
    """ledger and rows (series_id, day, taken_at, ...) together: a snapshot that stands in both once, the latest
    ``per_day`` of a day, and the last ``days`` days of each series."""
    every = ledger.unionByName(rows).dropDuplicates(["series_id", "day", "taken_at"])
    rank = lambda by, order: F.dense_rank().over(W.partitionBy(*by).orderBy(F.desc(order)))
    return every.withColumns({"by_day": rank(["series_id", "day"], "taken_at"), "by_series": rank(["series_id"], "day")}).where((F.col("by_day") <= per_day) & (F.col("by_series") <= days)).drop("by_day", "by_series")


def monthly_archive(documents: DataFrame, today: Column, keep_days: int = 62) -> DataFrame:
    """(series_id, month, days, archive) of the day documents older than ``keep_days``: one array of a month's documents."""
    old = documents.where(F.col("date") < F.date_sub(today, keep_days))
    item = F.struct(F.col("date").cast("string").alias("date"), "document")
    return old.groupBy("series_id", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), F.to_json(F.sort_array(F.collect_list(item))).alias("archive"))
