"""Priority events and their evidence on a day worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridspark.plans import priorities

DAY = dt.datetime(2024, 7, 4)


@pytest.fixture(scope="module")
def rows(spark):
    data = []
    for h in range(24):
        model = {2: 12000.0, 12: 11200.0, 20: 11100.0}.get(h, 10000.0)  # misses of 2000, 1200, 1100
        fresh = 10600.0 if h == 5 else 10450.0 if h == 6 else model  # a gap of 600, one too small
        data.append(("a", DAY + dt.timedelta(hours=h), 10000.0, model, 10000.0, model, fresh))
        data.append(("b", DAY + dt.timedelta(hours=h), 10000.0 if h < 3 else None, 10000.0, None, None, None))
    return spark.createDataFrame(data, "series_id string, ts timestamp_ntz, actual_mw double, model_mw double, reference_mw double, published_mw double, recalculated_mw double")


def test_events_are_ranked_over_their_kinds(rows):
    got = priorities.priority_events(rows).orderBy("rank").collect()
    # Both sides of the spike break the shape by 2000; the miss of equal size comes first. Bands: 2000 / 6 over night.
    assert [(r.event_id, r.score_mw, r.severity, r.must_discuss) for r in got] == [
        ("top_miss_h2", 2000.0, "warning", True),
        ("shape_break_1_2", 2000.0, "warning", True),
        ("shape_break_2_3", 2000.0, "warning", True),
        ("top_miss_h12", 1200.0, "info", False),
        ("top_miss_h20", 1100.0, "info", False),
        ("freeze_gap_h5", 600.0, "info", False),
    ]
    assert {r.series_id for r in got} == {"a"} and priorities.priority_events(rows.limit(0)).count() == 0
    later = priorities.priority_events(rows.where(F.hour("ts") < 6).withColumn("published_mw", F.lit(None).cast("double"))).collect()
    assert {r.event_id for r in later} >= {"band_gap_overnight"}


def test_evidence_of_several_tables(rows):
    events = priorities.priority_events(rows).where("rank in (1, 2)")
    facts = priorities.hourly_facts(rows, "error", "model_mw", "reference_mw").unionByName(priorities.hourly_facts(rows.where(F.hour("ts") == 3), "serving", "recalculated_mw"))
    got = {r.event_id: r for r in priorities.evidence_bundles(events, facts).collect()}
    assert [(x.hour, x.source, x.name) for x in got["top_miss_h2"].evidence] == [(h, "error", n) for h in (1, 2) for n in ("model_mw", "reference_mw")] + [(3, "error", "model_mw"), (3, "error", "reference_mw"), (3, "serving", "recalculated_mw")]
    assert len(got["shape_break_1_2"].evidence) == 9 and got["top_miss_h2"].sources == "error,serving"
    none = priorities.evidence_bundles(events, facts.limit(0)).collect()
    assert len(none) == 2 and all(r.evidence == [] and r.sources == "" for r in none)
