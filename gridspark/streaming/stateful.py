"""Stateful streams with timers on event time: a ledger of whole days by day type, and the end of a day.

Both need the RocksDB state store (``state_store``). A timer is set for the end of each day; what a day gives is decided
when the watermark has passed it, so results do not depend on the order in which rows within the watermark arrive.
State lies in the query's checkpoint, so a lost executor's keys are read from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C


def state_store(spark: SparkSession) -> None:
    """Streams of the session keep their state in RocksDB, which timers and maps of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _closes(wait: str, days: int = 1):
    """Milliseconds of the end of ``day`` (or of ``days`` days from its start), and a wait more."""
    return F.unix_millis(F.date_add("day", days).cast("timestamp") + F.expr(f"INTERVAL {wait}"))


class _Ledger(StatefulProcessor):
    """Open days of one series and day type, hour by hour, and the last whole days that are closed."""

    def __init__(self, last: int, share: float, cap: float, recent: int):
        self.last, self.share, self.cap, self.recent = last, share, cap, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "day int", "closes long, hours array<double>")
        self.held = handle.getValueState("held", "days array<int>, residuals array<double>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            # Rows without a residual are dropped here: a filter before would be moved ahead of the watermark, which
            # they are to move on.
            for (day, closes), of_day in part.dropna(subset=["residual"]).groupby(["number", "closes"]):
                place = (int(day),)
                hours = list(self.open.getValue(place)[1]) if self.open.containsKey(place) else [None] * 24
                for hour, residual in zip(of_day["hour"], of_day["residual"]):
                    # An hour that comes twice keeps the smaller residual, whichever comes first.
                    hours[hour] = float(residual) if hours[hour] is None else min(hours[hour], float(residual))
                self.open.updateValue(place, (int(closes), hours))
                self.handle.registerTimer(int(closes))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((place[0], hours) for place, (closes, hours) in list(self.open.iterator()) if closes <= now)
        days, residuals = map(list, self.held.get()) if self.held.exists() else ([], [])
        out = []
        for day, hours in due:
            self.open.removeKey((day,))
            if any(x is None for x in hours):
                continue
            days, residuals = [*days, day][-self.last :], [*residuals, sum(hours) / 24][-self.last :]
            near = sorted(residuals[-self.recent :])
            middle = (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2
            shift = max(-self.cap, min(self.cap, middle * self.share)) if len(near) == self.recent else 0.0
            out.append((*key, day, residuals[-1], len(days), shift))
        if out:
            self.held.update((days, residuals))
            yield pd.DataFrame(out, columns=["series_id", "regime", "number", "residual", "held", "shift_mw"])


def regime_ledger(rows: DataFrame, forecast: str, calendar: DataFrame, wait: str = "0 HOURS", last: int = 60, share: float = 0.25, cap: float = 1000.0, recent: int = 3) -> DataFrame:
    """(series_id, regime, day, residual, held, shift_mw): a row for each day of 24 hours once the watermark has passed
    its end and ``wait``: its mean residual, how many days its day type then holds (at most ``last``), and the shift
    that follows from the latest ``recent`` of them (0 while there are fewer).

    rows: a stream (series_id, ts timestamp, actual_mw, <forecast>) with a watermark on ts. Rows without an actual or a
    forecast are no hours, but move the watermark on; days short of an hour give no row and leave the state; rows behind the watermark are dropped.
    """
    off = calendar.select("day", F.when(F.col("is_off"), "non_business").otherwise("business").alias("regime"))
    r = rows.withColumns({"day": F.to_date("ts"), "hour": F.hour("ts"), "residual": (F.col("actual_mw") - F.col(forecast)).cast("double")})
    r = r.join(F.broadcast(off), "day")
    r = r.select("series_id", "regime", "ts", "hour", "residual", F.unix_date("day").alias("number"), _closes(wait).alias("closes"))
    out = r.groupBy("series_id", "regime").transformWithStateInPandas(_Ledger(last, share, cap, recent), "series_id string, regime string, number int, residual double, held int, shift_mw double", "Append", "EventTime")
    return out.select("series_id", "regime", F.date_from_unix_date("number").alias("day"), "residual", "held", "shift_mw")


class _DayEnd(StatefulProcessor):
    """The hours of one day of one series: the actual and the reference forecast of each."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getValueState("hours", "actual array<double>, reference array<double>, ends long, leaves long, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        actual, reference, ends, leaves, closed = self.hours.get() if self.hours.exists() else ([None] * 24, [None] * 24, None, None, False)
        actual, reference, late = list(actual), list(reference), set()
        for part in (p.dropna(subset=["number"]) for p in rows):
            for hour, a, r, e, x in zip(part["hour"], part["actual_mw"], part["reference_mw"], part["ends"], part["leaves"]):
                ends, leaves = int(e), int(x)
                # Readings of an hour that differ: the largest counts, whichever comes first.
                if pd.notna(a) and (actual[hour] is None or a > actual[hour]):
                    actual[hour] = float(a)
                    late.add(hour)
                if pd.notna(r) and (reference[hour] is None or r > reference[hour]):
                    reference[hour] = float(r)
        if ends is None:
            return
        self.hours.update((actual, reference, ends, leaves, closed))
        if not closed:
            self.handle.registerTimer(ends)
        self.handle.registerTimer(leaves)
        if closed and late:
            yield self._rows(key, [(h, actual[h], C.OBSERVED) for h in sorted(late)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.hours.exists():
            return
        actual, reference, ends, leaves, closed = self.hours.get()
        if not closed:
            found = [(h, a, C.OBSERVED) if a is not None else (h, r, C.FALLBACK) for h, (a, r) in enumerate(zip(actual, reference)) if a is not None or (r is not None and r > 0)]
            if found:
                yield self._rows(key, found)
        if leaves <= expiredTimerInfo.getExpiryTimeInMs():
            self.hours.clear()
        else:
            self.hours.update((actual, reference, ends, leaves, True))

    @staticmethod
    def _rows(key, found) -> pd.DataFrame:
        return pd.DataFrame([(*key, *x) for x in found], columns=["series_id", "number", "hour", "actual_mw", "actual_source"])


def day_end(rows: DataFrame, wait: str = "0 HOURS", days: int = 2) -> DataFrame:
    """(series_id, day, hour, actual_mw, actual_source): the hours of each day once the watermark has passed its end and
    ``wait``. Hours without an actual take a positive reference forecast, marked as a fallback; hours with neither have
    no row. An actual that comes within ``days`` days of the day's end replaces what was given: a further row, marked
    as observed, which the reader prefers (``operators.joins.best_source``). After that the day leaves the state.

    rows: a stream (series_id, ts timestamp, actual_mw, reference_mw) with a watermark on ts that is long enough for
    such late rows; state is kept by series and day, so a busy series is many keys.
    """
    r = rows.withColumn("day", F.to_date("ts"))
    r = r.select("series_id", F.unix_date("day").alias("number"), "ts", F.hour("ts").alias("hour"), "actual_mw", "reference_mw", _closes(wait).alias("ends"), _closes(wait, 1 + days).alias("leaves"))
    out = r.groupBy("series_id", "number").transformWithStateInPandas(_DayEnd(), "series_id string, number int, hour int, actual_mw double, actual_source string", "Append", "EventTime")
    return out.select("series_id", F.date_from_unix_date("number").alias("day"), "hour", "actual_mw", "actual_source")


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream gives for the rows that are there now, as a Parquet table at ``path``."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
