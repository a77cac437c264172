"""What of a day needs to be explained first, and the facts around it.

Events of four kinds - large misses, breaks in shape, bands worse than the reference, published hours far from a fresh
forecast - become rows of one shape in one union, ranked by their MW. Facts of any number of tables are one long table
of (hour, source, name, value), so an event meets all of them in one equi-join on its hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import constants as C
from ..functions import scalars as S
from ..operators import diagnostics
from . import reports

#: Least MW of an event, by kind; kept events of a day, and those that must be discussed.
MISS_MW, BREAK_MW, BAND_MW, GAP_MW = 1000.0, 1000.0, 300.0, 500.0
MOST_EVENTS, FORCED, MISSES = 6, 3, 3
WARNING_MW = 1500.0
KINDS = ("large_absolute_error", "shape_break", "time_band_underperformance", "published_recalculated_gap")


def _event(kind: str, rank: Column, score: Column, first: Column, last: Column, detail: Column) -> list[Column]:
    name = F.concat_ws("_", F.lit({"large_absolute_error": "top_miss", "shape_break": "shape_break", "time_band_underperformance": "band_gap", "published_recalculated_gap": "freeze_gap"}[kind]), detail)
    return ["series_id", "day", F.lit(kind).alias("kind"), F.lit(KINDS.index(kind)).alias("kind_order"), rank.alias("place"), name.alias("event_id"), score.alias("score_mw"), first.alias("from_hour"), last.alias("to_hour")]


def priority_events(rows: DataFrame, model: str = "model_mw", reference: str = "reference_mw", published: str = "published_mw", recalculated: str = "recalculated_mw") -> DataFrame:
    """Per series and day at most six events by falling score (large misses first among equals, then in the order of
    kinds and ranks): kind, event_id, score_mw, severity, from_hour, to_hour, rank and must_discuss for the first three.

    rows: one for each series and hour; hours without an actual take part in gaps only."""
    known = rows.where(F.col("actual_mw").isNotNull() & F.col(model).isNotNull())
    hourly = known.select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.abs(F.col(model) - F.col("actual_mw")).alias("miss"))
    rank = F.row_number().over(W.partitionBy("series_id", "day").orderBy(F.round("miss", 6).desc(), "hour"))
    misses = hourly.withColumn("r", rank).where((F.col("r") <= MISSES) & (F.col("miss") >= MISS_MW))
    breaks = reports.shape_breaks(reports.shape_transitions(known, model, reference)).where(F.abs("model_delta_error") >= BREAK_MW)
    compared = known.where(F.col(reference).isNotNull())
    bands = compared.groupBy("series_id", F.to_date("ts").alias("day"), S.band(F.hour("ts")).alias("band")).agg((F.avg(F.abs(F.col(model) - F.col("actual_mw"))) - F.avg(F.abs(F.col(reference) - F.col("actual_mw")))).alias("gap"))
    at = lambda k: F.element_at(F.create_map(*[F.lit(x) for name, *hours in C.TIME_BANDS for x in (name, hours[k])]), F.col("band"))
    order = F.element_at(F.create_map(*[F.lit(x) for i, (name, *_) in enumerate(C.TIME_BANDS) for x in (name, i + 1)]), F.col("band"))
    gaps = diagnostics.freeze_gaps(rows.where(F.col(published).isNotNull() & F.col(recalculated).isNotNull()), published, recalculated, GAP_MW)
    events = misses.select(*_event(KINDS[0], F.col("r"), F.col("miss"), F.col("hour"), F.col("hour"), F.concat(F.lit("h"), F.col("hour").cast("string"))))
    events = events.unionByName(breaks.select(*_event(KINDS[1], F.col("rank"), F.abs("model_delta_error"), F.col("from_hour"), F.col("to_hour"), F.concat_ws("_", F.col("from_hour").cast("string"), F.col("to_hour").cast("string")))))
    events = events.unionByName(bands.where(F.col("gap") >= BAND_MW).select(*_event(KINDS[2], order, F.col("gap"), at(0), at(1), F.col("band"))))
    events = events.unionByName(gaps.select(*_event(KINDS[3], F.col("rank"), F.abs("gap"), F.col("hour"), F.col("hour"), F.concat(F.lit("h"), F.col("hour").cast("string")))))
    place = F.row_number().over(W.partitionBy("series_id", "day").orderBy(F.round("score_mw", 6).desc(), "kind_order", "place"))
    kept = events.withColumn("rank", place).where(F.col("rank") <= MOST_EVENTS)
    severity = F.when(F.col("score_mw") >= WARNING_MW, "warning").otherwise("info")
    return kept.select("series_id", "day", "rank", "kind", "event_id", "score_mw", severity.alias("severity"), "from_hour", "to_hour", (F.col("rank") <= FORCED).alias("must_discuss"))


def hourly_facts(rows: DataFrame, source: str, *columns: str) -> DataFrame:
    """(series_id, day, hour, source, name, value): the known values of these columns, a row each."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    return rows.select("series_id", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"), F.lit(source).alias("source"), each.alias("x")).select("series_id", "day", "hour", "source", "x.name", "x.value").where("value is not null")


def evidence_bundles(events: DataFrame, facts: DataFrame, radius: int = 1) -> DataFrame:
    """events plus evidence: all facts (``hourly_facts``) of their hours and ``radius`` hours around, as an array of
    (hour, source, name, value) in that order; and sources, those that say something. An event without facts has an
    empty array."""
    around = F.explode(F.sequence(F.greatest(F.lit(0), F.col("from_hour") - radius), F.least(F.lit(23), F.col("to_hour") + radius)))
    hours = events.select("series_id", "day", "event_id", around.alias("hour"))
    met = hours.join(facts, ["series_id", "day", "hour"]).groupBy("series_id", "day", "event_id")
    found = met.agg(F.sort_array(F.collect_list(F.struct("hour", "source", "name", "value"))).alias("evidence"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    none = F.array().cast(found.schema["evidence"].dataType)
    return events.join(found, ["series_id", "day", "event_id"], "left").withColumns({"evidence": F.coalesce("evidence", none), "sources": F.coalesce("sources", F.lit(""))})
