"""Input tables of the engine, derived from the event and order tables; every series is a value of ``series_id``."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import constants as C

#: Added before rounding, so that no value ends in a tie.
OFF_TIES = 1.37e-8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where it is unset, a temporary folder is used with a
    local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what several branches of a query read."""
    path = f"{shared_folder(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, actual_mw): events of a type in an hour. Money-like sums are decimal, so order never matters."""
    e = read_table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("actual_mw"))


#: MW of a working day by hour, of which a day off has a share by day and by night: a plain load curve.
LOAD_CURVE = (26000, 25000, 24500, 24300, 24500, 25500, 28000, 32000, 36000, 38500, 39500, 39800, 38000, 39500, 39700, 39500, 39000, 38500, 37500, 36000, 34000, 32000, 30000, 28000)
OFF_SHARES = (0.78, 0.92)
#: A day off in the middle of the tables, so that they have a run of three days off and a return from it.
DEMAND_HOLIDAYS = (*C.FIXED_HOLIDAYS, (1, 19))
#: MW of a whole mean hour, and of a whole mean day, that an hour or a day has more than the mean.
HOUR_MW, DAY_MW = 1500.0, 9000.0


def demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, actual_mw): every hour of every day of ``hourly`` on a load curve; what the hour's and the day's
    events have over their mean is added, so rules meet their real limits in MW."""
    h = hourly(spark, sf_dir)
    of = h.groupBy("series_id").agg((F.sum(F.col("actual_mw").cast("decimal(18,2)")).cast("double") / F.count("*")).alias("mean"), F.min(F.to_date("ts")).alias("lo"), F.max(F.to_date("ts")).alias("hi"))
    days = h.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.sum(F.col("actual_mw").cast("decimal(18,2)")).cast("double").alias("total"), F.count("*").alias("n"))
    grid = of.select("series_id", "mean", F.explode(F.sequence("lo", "hi")).alias("day")).join(days, ["series_id", "day"], "left")
    cal = calendar(h.select(F.to_date("ts").alias("day")), DEMAND_HOLIDAYS).select("day", "is_off")
    grid = grid.join(F.broadcast(cal), "day").select("*", F.explode(F.sequence(F.lit(0), F.lit(23))).alias("hour"))
    grid = grid.withColumn("ts", (F.col("day").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("hour"))))
    curve = F.element_at(F.array(*[F.lit(x) for x in LOAD_CURVE]), F.col("hour") + 1)
    share = F.when(F.col("is_off"), F.when(F.col("hour").between(7, 19), OFF_SHARES[0]).otherwise(OFF_SHARES[1])).otherwise(1.0)
    more = HOUR_MW * (F.coalesce(F.col("actual_mw"), F.col("mean")) / F.col("mean") - 1) + DAY_MW * (F.coalesce(F.col("total") / F.col("n"), F.col("mean")) / F.col("mean") - 1)
    return grid.join(h, ["series_id", "ts"], "left").select("series_id", "ts", F.round(curve * share + more + OFF_TIES).alias("actual_mw"))


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, temp_c, humidity_pct)."""
    e = read_table(spark, sf_dir, "events")
    mean = lambda x: F.sum(x).cast("double") / F.count(x)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg((10 + mean(F.col("value").cast("decimal(18,2)")) / 4).alias("temp_c"), (mean(k) % 60 + 30).alias("humidity_pct"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, actual_mw): orders of a priority in a day."""
    o = read_table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("actual_mw"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, ts, actual_mw, model_mw, reference_mw): the mean of the four hours of the same slot before, and the
    hour a week before; rows that have all three."""
    h = hourly(spark, sf_dir)
    slot = W.partitionBy("series_id", F.hour("ts"), F.weekday("ts")).orderBy("ts").rowsBetween(-4, -1)
    week = h.select("series_id", (F.col("ts") + F.expr("INTERVAL 168 HOURS")).alias("ts"), F.col("actual_mw").alias("reference_mw"))
    return h.withColumn("model_mw", F.avg("actual_mw").over(slot)).join(week, ["series_id", "ts"]).where("model_mw is not null")


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pairs captured at several leads: captured_at is 1, 3, 6, 12 and 24 hours before ts."""
    p = pairs(spark, sf_dir).withColumn("lead_h", F.explode(F.array(*[F.lit(x) for x in (1, 3, 6, 12, 24)])))
    return p.withColumn("captured_at", F.col("ts") - F.make_dt_interval(hours=F.col("lead_h")))


def half_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, day, slot 1-48, kwh): a week's events dealt over the half hours of its first day, so that days with
    all their slots exist."""
    e = read_table(spark, sf_dir, "events")
    slot = (F.col("event_id") % 48 + 1).cast("int")
    return e.groupBy(F.col("event_type").alias("series_id"), F.to_date(F.date_trunc("week", "ts")).alias("day"), slot.alias("slot")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("kwh"))


def calendar(days: DataFrame, holidays: tuple = C.FIXED_HOLIDAYS) -> DataFrame:
    """One row per day from 60 days before the first ``day`` of ``days`` to its last: holiday, weekend, runs of
    non-working days and the last working days. It grows with the days covered, never with the series."""
    span = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    d = span.select(F.explode(F.sequence(F.date_sub("lo", 60), F.col("hi"))).alias("day"))
    fixed = F.lit(False)
    for month, dom in holidays:
        fixed = fixed | ((F.month("day") == month) & (F.dayofmonth("day") == dom))
    d = d.withColumn("is_holiday", fixed).withColumn("is_weekend", F.weekday("day") >= 5)
    d = d.withColumn("is_off", F.col("is_holiday") | F.col("is_weekend"))
    # The whole calendar is one ordered list of days; it is small whatever the data are.
    before = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    on, off = F.when(~F.col("is_off"), F.col("day")), F.when(F.col("is_off"), F.col("day"))
    d = d.withColumn("last_biz_day", F.max(on).over(before)).withColumn("last_open_day", F.max(F.when(~F.col("is_holiday"), F.col("day"))).over(before))
    d = d.withColumn("last_off_day", F.max(off).over(before))
    d = d.withColumn("run_before", F.when(F.col("last_biz_day").isNotNull(), F.least(F.lit(60), F.datediff("day", "last_biz_day") - 1)).otherwise(0))
    gap = F.datediff("day", "last_off_day")
    since = F.when(F.col("is_off") | gap.isNull() | (gap > 8), 0).otherwise(F.least(F.lit(7), gap))
    return d.withColumn("days_since_off", since).drop("last_off_day")


#: The same tables as DuckDB common table expressions, by name and in this order.
CTES = {
    "hourly": "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS actual_mw FROM events GROUP BY 1, 2",
    "weather": "SELECT event_type AS series_id, date_trunc('hour', ts) AS ts, 10 + CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) / 4 AS temp_c, CAST(sum(CAST(json_extract_string(props, '$.k') AS INT)) AS DOUBLE) / count(*) % 60 + 30 AS humidity_pct FROM events GROUP BY 1, 2",
    "daily": "SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS actual_mw FROM orders GROUP BY 1, 2",
    "pairs": "SELECT * FROM (SELECT h.series_id, h.ts, h.actual_mw, avg(h.actual_mw) OVER (PARTITION BY h.series_id, hour(h.ts), isodow(h.ts) ORDER BY h.ts ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS model_mw, w.actual_mw AS reference_mw FROM hourly h LEFT JOIN hourly w ON h.series_id = w.series_id AND h.ts = w.ts + INTERVAL 168 HOURS) WHERE model_mw IS NOT NULL AND reference_mw IS NOT NULL",
    "vintages": "SELECT p.*, l AS lead_h, ts - to_hours(l) AS captured_at FROM pairs p, (SELECT unnest([1, 3, 6, 12, 24]) AS l)",
    "half_hours": "SELECT event_type AS series_id, CAST(date_trunc('week', ts) AS DATE) AS day, CAST(event_id % 48 + 1 AS INT) AS slot, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS kwh FROM events GROUP BY 1, 2, 3",
}


def calendar_ctes(days_sql: str, holidays: tuple = C.FIXED_HOLIDAYS) -> str:
    """calendar() over the column ``day`` of a query."""
    fixed = " OR ".join(f"(month(day) = {m} AND day(day) = {d})" for m, d in holidays)
    return f"""cal0 AS (SELECT CAST(unnest(generate_series(lo - INTERVAL 60 DAYS, hi, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT CAST(min(day) AS TIMESTAMP) AS lo, CAST(max(day) AS TIMESTAMP) AS hi FROM ({days_sql}))),
    cal1 AS (SELECT day, ({fixed}) AS is_holiday, isodow(day) >= 6 AS is_weekend, ({fixed}) OR isodow(day) >= 6 AS is_off FROM cal0),
    cal2 AS (SELECT *, max(CASE WHEN NOT is_off THEN day END) OVER b AS last_biz_day, max(CASE WHEN NOT is_holiday THEN day END) OVER b AS last_open_day, max(CASE WHEN is_off THEN day END) OVER b AS last_off FROM cal1 WINDOW b AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    calendar AS (SELECT day, is_holiday, is_weekend, is_off, last_biz_day, last_open_day, CASE WHEN last_biz_day IS NOT NULL THEN least(60, day - last_biz_day - 1) ELSE 0 END AS run_before,
      CASE WHEN is_off OR last_off IS NULL OR day - last_off > 8 THEN 0 ELSE least(7, day - last_off) END AS days_since_off FROM cal2)"""


def with_ctes(*names: str, more: str = "") -> str:
    """A WITH clause of these tables, and of those they need."""
    needs = {"pairs": ("hourly",), "vintages": ("pairs", "hourly")}
    wanted = {n for name in names for n in (name, *needs.get(name, ()))}
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in wanted]
    return "WITH " + ", ".join([*parts, more] if more else parts) + " "


#: demand() as tables ``hourly`` and ``calendar``, for SQL that is written over those names; weather is as it is.
DEMAND_CTES = (
    f"events_hourly AS ({CTES['hourly']}), weather AS ({CTES['weather']}), {calendar_ctes('SELECT CAST(ts AS DATE) AS day FROM events_hourly', DEMAND_HOLIDAYS)}, "
    + f"""dm AS (SELECT series_id, CAST(sum(CAST(actual_mw AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean, min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi FROM events_hourly GROUP BY 1),
    dd AS (SELECT series_id, CAST(ts AS DATE) AS day, CAST(sum(CAST(actual_mw AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM events_hourly GROUP BY 1, 2),
    dg AS (SELECT g.series_id, g.mean, CAST(g.day AS DATE) AS day, h AS hour, CAST(g.day AS TIMESTAMP) + to_hours(h) AS ts FROM (SELECT series_id, mean, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS day FROM dm) g, (SELECT CAST(unnest(range(24)) AS INT) AS h) x),
    hourly AS (SELECT dg.series_id, dg.ts, round(CAST({list(LOAD_CURVE)}[dg.hour + 1] AS DOUBLE) * CASE WHEN c.is_off THEN CASE WHEN dg.hour BETWEEN 7 AND 19 THEN {OFF_SHARES[0]} ELSE {OFF_SHARES[1]} END ELSE 1.0 END::DOUBLE + ({HOUR_MW}::DOUBLE * (coalesce(e.actual_mw, mean) / mean - 1) + {DAY_MW}::DOUBLE * (coalesce(total / n, mean) / mean - 1)) + {OFF_TIES:.12f}::DOUBLE) AS actual_mw
      FROM dg JOIN calendar c ON c.day = dg.day LEFT JOIN dd ON dd.series_id = dg.series_id AND dd.day = dg.day LEFT JOIN events_hourly e ON e.series_id = dg.series_id AND e.ts = dg.ts)"""
)
