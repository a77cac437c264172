"""Streams with timers give what the batch queries give, in whatever order rows come."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from gridspark import tables as tb
from gridspark.operators import diagnostics, history
from gridspark.streaming import ingest, stateful

T0 = dt.datetime(2024, 1, 1)
ROWS = "series_id string, ts timestamp, actual_mw double, reference_mw double"


def hour(n):
    return T0 + dt.timedelta(hours=n)


def run(spark, tmp_path, make, batches, delay):
    """Batches as files that come one after another, one each trigger."""
    stateful.state_store(spark)
    folder = tmp_path / "in"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, ROWS).coalesce(1).write.mode("append").parquet(str(folder))
        stream = ingest.read_stream(spark, str(folder), ROWS, 1).withWatermark("ts", delay)
        out = stateful.drained(make(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    return out


def facts(days=9, seed=3):
    r = random.Random(seed)
    return [(s, hour(n), 1000.0 + r.randrange(500), 1000.0) for s in ("a", "b") for n in range(24 * days)]


@pytest.mark.parametrize("seed", [1, 2])
def test_ledger_in_any_order_is_the_batch_ledger(spark, tmp_path, seed):
    rows = [x for x in facts() if x[:2] != ("b", hour(30))]  # the second day of b is short of an hour
    cal = tb.calendar(spark.createDataFrame([(hour(0).date(),), (hour(24 * 20).date(),)], "day date"))
    shuffled = random.Random(seed).sample(rows, len(rows))
    third = len(rows) // 3
    late = [("z", hour(24 * 15), None, None)]  # moves the watermark on, and is no hour itself
    batches = [shuffled[:third], shuffled[third : 2 * third], shuffled[2 * third :] + shuffled[:5] + late]
    got = run(spark, tmp_path, lambda s: stateful.regime_ledger(s, "reference_mw", cal, last=4), batches, "12 days").collect()
    # Nothing is closed before the watermark passes it: 15 days less 12 are the first three days.
    assert {r.day for r in got} == {hour(24 * d).date() for d in range(3)}
    end = spark.createDataFrame([("z", hour(24 * 40), None, None)], ROWS)
    end.write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.read_stream(spark, str(tmp_path / "in"), ROWS, 1).withWatermark("ts", "12 days")
    got = stateful.drained(stateful.regime_ledger(stream, "reference_mw", cal, last=4), str(tmp_path / "out"), str(tmp_path / "check")).collect()
    batch = spark.createDataFrame(rows, ROWS)
    ledger = diagnostics.regime_ledger(batch, "reference_mw", cal, 100)
    want = {(r.series_id, r.regime, r.day): r.residual for r in ledger.collect()}
    assert len(got) == len(want) == 17
    assert {(r.series_id, r.regime, r.day): round(r.residual, 6) for r in got} == {k: round(v, 6) for k, v in want.items()}
    for series, regime in {(r.series_id, r.regime) for r in got}:
        own = sorted((r for r in got if (r.series_id, r.regime) == (series, regime)), key=lambda r: r.day)
        assert [r.held for r in own] == [min(i + 1, 4) for i in range(len(own))]
        for i, r in enumerate(own):
            near = sorted(x.residual for x in own[max(0, i - 2) : i + 1])
            assert r.shift_mw == pytest.approx(near[1] * 0.25 if len(near) == 3 else 0.0)


@pytest.mark.parametrize("seed", [1, 2])
def test_day_end_in_any_order_is_the_batch_result(spark, tmp_path, seed):
    r = random.Random(9)
    rows = [(s, t, None if r.random() < 0.3 else a, None if r.random() < 0.1 else 0.0 if r.random() < 0.1 else ref) for s, t, a, ref in facts(2)]
    shuffled = random.Random(seed).sample(rows, len(rows))
    batches = [shuffled[:40], shuffled[40:], [("z", hour(24 * 3), None, None)]]
    make = lambda s: stateful.day_end(s, days=5)
    got = run(spark, tmp_path, make, batches, "60 hours").collect()
    # The watermark stands at 12:00 of the first day: nothing yet.
    assert got == []
    got = run(spark, tmp_path, make, [[("z", hour(24 * 5), None, None)]], "60 hours").collect()
    batch = history.finalize_fallback(spark.createDataFrame(rows, ROWS).withColumn("actual_source", F.when(F.col("actual_mw").isNotNull(), "observed")), F.lit(hour(48).date()), 2)
    want = {(x.series_id, x.ts): (x.actual_mw, x.actual_source) for x in batch.collect() if x.actual_mw is not None}
    place = lambda x: (x.series_id, dt.datetime.combine(x.day, dt.time(x.hour)))
    assert len(got) == len(want) and {place(x): (x.actual_mw, x.actual_source) for x in got} == want
    # An actual that comes after its day was closed replaces a fallback, and is given at once.
    missed = next(k for k, v in want.items() if v[1] != "observed" and k[1] >= hour(24 * 2 + 12 - 24))
    again = run(spark, tmp_path, make, [[(missed[0], missed[1], 77.0, None)]], "60 hours")
    new = again.where("actual_mw = 77.0").collect()
    assert (again.count() - len(want), [(place(x), x.actual_source) for x in new]) in ((1, [(missed, "observed")]), (0, []))
