"""Checks of parsed series: counts, duplicates, gaps, ranges, the gate, missing days, and publish assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def series_quality(rows: DataFrame, expected: int = 24, *by: str, value: str = "actual_mw") -> DataFrame:
    """Per group of (ts, seq in file order): rows, expected_count_ok, missing and duplicate timestamps, whether the
    file is in order, gaps other than an hour in time order, nulls, negatives, and up to three examples of these."""
    by = by or ("series_id", "day")
    in_time = W.partitionBy(*by).orderBy("ts")
    step = F.timestamp_diff("MINUTE", F.lag("ts").over(in_time), F.col("ts"))
    r = rows.withColumns({"step": step, "back": F.col("ts") < F.lag("ts").over(W.partitionBy(*by).orderBy("seq"))})
    negative = F.col(value) < 0
    return r.groupBy(*by).agg(
        F.count("*").alias("rows"),
        (F.count("*") == expected).alias("expected_count_ok"),
        F.count_if(F.col("ts").isNull()).alias("missing_ts"),
        (F.count("ts") - F.count_distinct("ts")).alias("duplicates"),
        (F.count_if("back") == 0).alias("monotonic"),
        F.count_if(F.col("step") != 60).alias("freq_mismatch"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
        F.count_if(negative).alias("n_negative"),
        F.array_join(F.slice(F.sort_array(F.collect_list(F.when(negative, F.col(value)))), 1, 3).cast("array<string>"), ",").alias("examples"),
    )


def quality_gate(table: DataFrame, most_mismatches: int = 4) -> DataFrame:
    """FAILED, WARNING or PASSED for each row of series_quality; exactly ``most_mismatches`` still passes."""
    failed = (F.col("rows") == 0) | ~F.col("expected_count_ok") | (F.col("n_null") == F.col("rows"))
    warning = (F.col("duplicates") > 0) | ~F.col("monotonic") | (F.col("freq_mismatch") > most_mismatches)
    return table.withColumn("status", F.when(failed, "FAILED").when(warning, "WARNING").otherwise("PASSED"))


def missing_days(days: DataFrame, yesterday=None) -> DataFrame:
    """(series_id, day) between a series' first day and the earlier of its last day and yesterday without a row."""
    last = F.max("day") if yesterday is None else F.least(F.max("day"), F.lit(yesterday).cast("date"))
    span = days.groupBy("series_id").agg(F.min("day").alias("lo"), last.alias("hi")).where("lo <= hi")
    return span.select("series_id", F.explode(F.sequence("lo", "hi")).alias("day")).join(days, ["series_id", "day"], "left_anti")


def publish_failures(forecast: DataFrame, facts: DataFrame, least_hours: int = 24) -> DataFrame:
    """(series_id, day, check) for every assertion that a published day breaks: 24 hours, finite values, ordered bands,
    enough observed hours."""
    day = forecast.withColumn("day", F.to_date("ts")).groupBy("series_id", "day").agg(
        (F.count_distinct("ts") != 24).alias("rows_not_24"),
        (F.count_if(F.col("forecast_mw").isNull() | F.isnan("forecast_mw")) > 0).alias("forecast_missing"),
        (F.count_if(~((F.col("p99_lower_mw") <= F.col("p95_lower_mw")) & (F.col("p95_upper_mw") <= F.col("p99_upper_mw")))) > 0).alias("bands_unordered"),
    )
    seen = facts.where("actual_mw is not null").groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count_distinct("ts").alias("hours"))
    d = day.join(seen, ["series_id", "day"], "left").withColumn("few_observed", F.coalesce("hours", F.lit(0)) < least_hours)
    checks = ("rows_not_24", "forecast_missing", "bands_unordered", "few_observed")
    return d.select("series_id", "day", F.explode(F.array_compact(F.array(*[F.when(F.col(c), c) for c in checks]))).alias("check"))


def hour_sources(facts: DataFrame, fallback: str) -> DataFrame:
    """Observed, fallback and missing hours of each series and day, from columns actual_mw and actual_source."""
    source = F.coalesce("actual_source", F.lit("observed"))
    held = F.col("actual_mw").isNotNull()
    return facts.groupBy("series_id", F.to_date("ts").alias("day")).agg(F.count_if(held & (source != fallback)).alias("observed"), F.count_if(held & (source == fallback)).alias("fallback"), (24 - F.count_if(held)).alias("missing"))


def snapshot_digests(rows: DataFrame, columns: tuple[str, ...], keys: tuple[str, ...] = ("series_id", "ts")) -> DataFrame:
    """(series_id, day, column_name, n, n_known, digest): the digest of a column on a day is the sum of hashes of its
    cells with their keys. Sums merge, so partitions and order are of no account and nothing is sorted; one changed cell
    changes its column's digest of its day. Values count by their text; unknown ones count too."""
    cells = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("cell"))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.col("cell.name"), F.coalesce("cell.value", F.lit("\x01")))
    number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    out = cells.groupBy("series_id", F.to_date("ts").alias("day"), F.col("cell.name").alias("column_name"))
    return out.agg(F.count("*").alias("n"), F.count("cell.value").alias("n_known"), F.sum(number).cast("string").alias("digest"))


def changed_digests(before: DataFrame, after: DataFrame) -> DataFrame:
    """(series_id, day, column_name, change) of two versions' digests: added, removed or changed."""
    keys = ["series_id", "day", "column_name"]
    b, a = (d.select(*keys, F.col("digest").alias(n)) for d, n in ((before, "b"), (after, "a")))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("changed")
    return b.join(a, keys, "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, change.alias("change"))
