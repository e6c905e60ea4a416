"""Continuous aggregates: what a refresh and a repair write, replays, and readers against full computations."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from termloom.operators.rollups import RELATIONS, Store
from termloom.sources import ledger as L

AT = datetime.datetime


def files(store):
    root = store.data.removeprefix("file:")
    return {os.path.join(d, f).removeprefix(root): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def rows(df):
    names = sorted(c for c in df.columns if c != "_part")
    return sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect())))


@pytest.fixture()
def events(spark, sf_dir):
    return L.event_store(spark, sf_dir)


@pytest.mark.parametrize("name", ["position_change_hourly", "signal_stats_daily", "position_cumulative_hourly"])
def test_repairs_write_only_what_late_rows_touch(spark, events, tmp_path, name):
    store = Store(spark, str(tmp_path), RELATIONS[name])
    late = events.where("ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-06' AND hour(ts) IN (3, 4, 5)")
    early = events.where("NOT (ts >= TIMESTAMP_NTZ'2024-01-05' AND ts < TIMESTAMP_NTZ'2024-01-06' AND hour(ts) IN (3, 4, 5))")
    assert rows(store.read(early)) == rows(RELATIONS[name].compute(early))  # nothing stored yet
    store.refresh(early, AT(2024, 1, 15))
    assert store.mark() == AT(2024, 1, 15) and rows(store.read(early)) == rows(RELATIONS[name].compute(early))
    store.refresh(early, AT(2024, 1, 10))  # goes nowhere
    before = files(store)
    assert store.repair(events) == [] and files(store) == before  # an empty log: nothing is written
    store.invalidate(late, "b1")
    store.invalidate(late, "b1")  # the batch comes again
    touched = store.repair(events)
    after = files(store)
    same = {f for f in before if after.get(f) == before[f]}
    if name == "position_cumulative_hourly":
        assert touched == ["2024-01-05"] and all(("_part=2024-01-0" in f and f.split("_part=")[1][:10] < "2024-01-05") for f in same) and len(same) >= 4
    else:
        assert {f.split("_part=")[1][:10] for f in set(before) - same} == set(touched) == {"2024-01-05" if "hourly" in name else "2024-01-01"}
    assert store.invalid() == ([], []) and rows(store.read(events)) == rows(RELATIONS[name].compute(events))
    store.refresh(events, AT(2024, 1, 25))
    assert rows(store.read(events)) == rows(RELATIONS[name].compute(events))


def test_partitions_without_rows_go_and_late_rows_above_the_mark_need_no_repair(spark, events, tmp_path):
    store = Store(spark, str(tmp_path), RELATIONS["position_change_hourly"])
    store.refresh(events, AT(2024, 1, 12, 7))
    gone = events.where("NOT (ts >= TIMESTAMP_NTZ'2024-01-03' AND ts < TIMESTAMP_NTZ'2024-01-04')")
    store.invalidate(events.where("ts >= TIMESTAMP_NTZ'2024-01-03' AND ts < TIMESTAMP_NTZ'2024-01-04'"), "taken back")
    assert store.repair(gone) == ["2024-01-03"]
    assert not any("2024-01-03" in f for f in files(store)) and rows(store.read(gone)) == rows(RELATIONS["position_change_hourly"].compute(gone))
    store.invalidate(events.where("ts >= TIMESTAMP_NTZ'2024-01-12 07:00:00'"), "new")
    assert store.invalid()[0] == [] and store.repair(gone) == []


def test_scans_are_bounded(spark, events, tmp_path):
    store = Store(spark, str(tmp_path), RELATIONS["position_change_hourly"])
    store.refresh(events, AT(2024, 1, 20))
    plan = store.read(events)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-20" in plan and "LessThan(bucket,2024-01-20" in plan
    assert store.read(events).where(F.col("bucket") < F.lit("2024-01-02")).count() == RELATIONS["position_change_hourly"].compute(events).where(F.col("bucket") < F.lit("2024-01-02")).count()
