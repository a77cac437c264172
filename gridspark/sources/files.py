"""Scans of raw utility, weather and area files, distributed over files and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions import scalars as S

#: Values are in units of ten megawatts.
UNIT = 10


def text_of(content: Column) -> Column:
    """Bytes as text: UTF-8 without its mark if valid, else Windows-31J (spark.sql.legacy.javaCharsets must be on)."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, F.regexp_replace(content.cast("string"), "^﻿", "")).otherwise(F.decode(content, "windows-31j"))


def read_lines(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(source_file, file_date, seq, line) of the latest file of each date; the date is the first eight digits of its
    name, and files without a valid one are left out. Files, then lines, are what Spark spreads."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    f = f.withColumn("file_date", F.try_to_date(F.regexp_extract(F.element_at(F.split("path", "/"), -1), r"(\d{8})", 1), "yyyyMMdd")).where("file_date is not null")
    last = f.groupBy("file_date").agg(F.max("path").alias("path"))
    f = f.join(last, ["file_date", "path"], "left_semi")
    return f.select(F.col("path").alias("source_file"), "file_date", F.posexplode(F.split(text_of(F.col("content")), r"\r?\n")).alias("seq", "line"))


def daily_sections(lines: DataFrame) -> DataFrame:
    """lines with the section that each data line is in: hourly (DATE,TIME and four values), five_min (three values) or
    summary; header and blank lines have none."""
    hourly, five = F.col("line").rlike("^DATE,TIME(,[^,]*){4}$"), F.col("line").rlike("^DATE,TIME(,[^,]*){3}$")
    header = F.when(hourly, "hourly").when(five, "five_min").when(F.col("line").rlike("^[^0-9,][^,]*(,[^,]*)+$"), "summary")
    by = W.partitionBy("source_file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    s = lines.withColumn("header", header).withColumn("section", F.last("header", ignorenulls=True).over(by))
    return s.where(F.col("header").isNull() & (F.trim("line") != "")).drop("header")


def hourly_rows(sections: DataFrame) -> DataFrame:
    """(source_file, file_date, seq, ts, actual_mw, forecast_mw, usage_pct, supply_mw) of the hourly tables."""
    p = F.split("line", ",")
    h = sections.where("section = 'hourly'").select("*", *[F.trim(F.get(p, i)).alias(f"c{i}") for i in range(6)])
    mw = lambda c: S.safe_double(F.col(c)) * UNIT
    return h.select("source_file", "file_date", "seq", S.local_timestamp(F.col("c0"), F.col("c1")).cast("timestamp_ntz").alias("ts"), mw("c2").alias("actual_mw"), mw("c3").alias("forecast_mw"), S.safe_double(F.col("c4")).alias("usage_pct"), mw("c5").alias("supply_mw")).where("ts is not null")


def five_minute_rows(sections: DataFrame) -> DataFrame:
    p = F.split("line", ",")
    f = sections.where("section = 'five_min'").select("*", *[F.trim(F.get(p, i)).alias(f"c{i}") for i in range(5)])
    return f.select("source_file", "file_date", "seq", S.local_timestamp(F.col("c0"), F.col("c1")).cast("timestamp_ntz").alias("ts"), (S.safe_double(F.col("c2")) * UNIT).alias("actual_mw"), (S.safe_double(F.col("c3")) * UNIT).alias("solar_mw")).where("ts is not null")


def quarantined(sections: DataFrame, lines: DataFrame) -> DataFrame:
    """Files without an hourly or a five-minute table, and why."""
    has = sections.groupBy("source_file").agg(F.collect_set("section").alias("found"))
    j = lines.select("source_file").distinct().join(has, "source_file", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    reason = F.when(~F.array_contains("found", "hourly"), "no hourly table").when(~F.array_contains("found", "five_min"), "no five-minute table")
    return j.select("source_file", reason.alias("reason")).where("reason is not null")


def weather_response(documents: DataFrame, body: str = "value") -> DataFrame:
    """(ts, temp_c, apparent_temp_c, humidity_pct, discomfort_index) of responses with parallel hourly arrays."""
    schema = "hourly struct<time: array<string>, temperature_2m: array<double>, apparent_temperature: array<double>, relative_humidity_2m: array<double>>"
    h = documents.select(F.from_json(body, schema)["hourly"].alias("h")).select(F.explode(F.arrays_zip("h.time", "h.temperature_2m", "h.apparent_temperature", "h.relative_humidity_2m")).alias("x"))
    rows = h.select(F.try_to_timestamp("x.time").cast("timestamp_ntz").alias("ts"), F.col("x.temperature_2m").alias("temp_c"), F.coalesce("x.apparent_temperature", "x.temperature_2m").alias("apparent_temp_c"), F.col("x.relative_humidity_2m").alias("humidity_pct"))
    return rows.withColumn("discomfort_index", F.round(S.discomfort_index(F.col("temp_c"), F.col("humidity_pct")), 1))


def station_observations(documents: DataFrame, body: str = "value") -> DataFrame:
    """Hourly (ts, temp_c, humidity_pct, wind_mps) of a map of yyyyMMddHHmmss to [value, flag] measurements."""
    m = T.MapType(T.StringType(), T.StructType([T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("temp", "humidity", "wind")]))
    r = documents.select(F.explode(F.from_json(body, m)).alias("at", "x")).select(F.try_to_timestamp("at", F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz").alias("ts"), "x")
    r = r.where((F.minute("ts") == 0) & (F.second("ts") == 0))
    return r.select("ts", *[F.get(f"x.{n}", F.lit(0)).alias(a) for n, a in (("temp", "temp_c"), ("humidity", "humidity_pct"), ("wind", "wind_mps"))]).groupBy("ts").agg(*[F.max(c).alias(c) for c in ("temp_c", "humidity_pct", "wind_mps")])


def forecast_points(documents: DataFrame, body: str = "value") -> DataFrame:
    """(ts, temp_c) three-hourly points of a forecast document; an empty text is missing."""
    schema = "pointTimeSeries struct<timeDefines: array<struct<dateTime: string>>, temperature: array<string>>"
    x = documents.select(F.from_json(body, schema)["pointTimeSeries"].alias("p")).select(F.explode(F.arrays_zip(F.col("p.timeDefines").alias("d"), F.col("p.temperature").alias("t"))).alias("x"))
    return x.select(F.try_to_timestamp("x.d.dateTime").cast("timestamp_ntz").alias("ts"), S.safe_double(F.col("x.t")).alias("temp_c"))


def half_hour_area(rows: DataFrame, value: str = "kwh") -> DataFrame:
    """Hours of (series_id, day, slot 1-48, kwh) days that have all 48 slots: mean MW and change inside the hour."""
    full = rows.groupBy("series_id", "day").agg(F.count_distinct("slot").alias("n")).where("n = 48").select("series_id", "day")
    mw = F.col(value) * 2 / 1000
    h = rows.join(full, ["series_id", "day"], "left_semi").withColumns({"hour": F.floor((F.col("slot") - 1) / 2).cast("int"), "mw": mw})
    return h.groupBy("series_id", "day", "hour").agg(F.avg("mw").alias("mean_mw"), (F.max_by("mw", "slot") - F.min_by("mw", "slot")).alias("delta_mw"))
