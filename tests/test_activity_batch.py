"""The activity batch over several cycles: calendar, dirty accounts, gates, a cycle that runs again, against full computations."""

import datetime
import shutil

from pyspark.sql import functions as F

from termloom.operators import behavior as B
from termloom.operators.activity_batch import ActivityBatch
from termloom.sources import ledger as L


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_cycles(spark, sf_dir, tmp_path):
    ev = L.event_store(spark, sf_dir)
    part = lambda a, b: ev.where(f"ts >= TIMESTAMP_NTZ'{a}' AND ts < TIMESTAMP_NTZ'{b}'")
    at = datetime.datetime.fromisoformat
    batch = ActivityBatch(spark, str(tmp_path), ev.schema, windows=(7, 14, 30), active_days=20, buckets=4)
    did = batch.run(part("2024-01-01", "2024-01-10 12:00:00"), at("2024-01-10 12:00:00"))
    assert did["days"].startswith("2024-01-01,") and did["days"].endswith("2024-01-10") and (did["profiles"], did["affinity"], did["cohorts"]) == ("all", "all", "made")

    day = batch.stored_days()
    did = batch.run(part("2024-01-10 12:00:00", "2024-01-10 18:00:00"), at("2024-01-10 18:00:00"))
    assert did["days"] == "2024-01-10" and (did["profiles"], did["affinity"], did["cohorts"]) == ("dirty", "new", "not due") and batch.stored_days() == day
    so_far = ev.where("ts < TIMESTAMP_NTZ'2024-01-10 18:00:00'")
    assert rows(batch.affinities(), "account", "term", "interactions", "capital", "last_at") == rows(B.affinity_totals(so_far), "account", "term", "interactions", "capital", "last_at")
    assert rows(batch.days(), "day", "account", "atoms", "deposit_volume") == rows(B.daily_activity(so_far), "day", "account", "atoms", "deposit_volume")
    fresh = B.profiles(B.daily_activity(so_far), "2024-01-10 18:00:00", (7, 14, 30), 20)
    changed = part("2024-01-10 12:00:00", "2024-01-10 18:00:00").select("account").distinct()
    of_changed = lambda df: rows(df.join(changed, "account", "left_semi"), "account", "frequency", "volume", "deposits_7d", "last_day")
    assert of_changed(batch.profiles()) == of_changed(fresh)

    late = part("2024-01-10 18:00:00", "2024-01-19")
    done, batch.marks.done = batch.marks.done, lambda job: None
    batch.run(late, at("2024-01-19 00:00:00"))
    batch.marks.done = done
    newest = max((tmp_path / "checkpoint").glob("version=*"), key=lambda p: int(p.name.partition("=")[2]))
    shutil.rmtree(newest)  # as if the cycle had failed before its checkpoint
    did = batch.run(late, at("2024-01-19 00:00:00"))
    assert did["cohorts"] == "made" and batch.checkpoint().cycle == 2 and batch.checkpoint().cohorts == "2024-01-19"
    whole = ev.where("ts < TIMESTAMP_NTZ'2024-01-19'")
    people = B.profiles(B.daily_activity(whole), "2024-01-19 00:00:00", (7, 14, 30), 20)
    assert rows(batch.scores.read(), "account", "r", "f", "m") == rows(B.rfm(people, "2024-01-19 00:00:00"), "account", "r", "f", "m")
    first = whole.where("event_type <> 'click'").groupBy("account").agg(F.min("ts").alias("first_seen"))
    assert rows(batch.cohorts(), "account", "cohort_week", "period_offset", "action_count") == rows(B.cohorts(first, B.daily_activity(whole)), "account", "cohort_week", "period_offset", "action_count")


def test_a_lost_day_is_found_and_nothing_comes_of_nothing(spark, sf_dir, tmp_path):
    ev = L.event_store(spark, sf_dir)
    batch = ActivityBatch(spark, str(tmp_path), ev.schema, windows=(7, 14, 30), active_days=20, buckets=2)
    assert batch.fill_days(ev.limit(0), datetime.date(2024, 1, 5)) == []
    batch.history.append(ev.where("ts < TIMESTAMP_NTZ'2024-01-08'"), 0)
    batch.fill_days(ev.limit(0), datetime.date(2024, 1, 7))
    shutil.rmtree(tmp_path / "days" / "_day=2024-01-04")
    assert batch.fill_days(ev.limit(0), datetime.date(2024, 1, 7)) == ["2024-01-04"]
    assert batch.days().count() == B.daily_activity(ev.where("ts < TIMESTAMP_NTZ'2024-01-08'")).count()
