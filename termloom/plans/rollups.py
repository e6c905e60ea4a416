"""Queries of continuous aggregates: stored buckets, late rows repaired, the newest buckets computed when read."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from termloom.operators.rollups import RELATIONS, Store
from termloom.plans import behavior, market, streams  # noqa: F401  (their twins are registered first)
from termloom.plans.base import ORACLE_SQL, QUERIES, stamp
from termloom.session import shared_folder
from termloom.sources import ledger as L

#: Rows of one hour of the first days come after the buckets that they belong to have been stored.
LATE = "ts < TIMESTAMP_NTZ'2024-01-10' AND hour(ts) = 5"
FIRST, SECOND = datetime.datetime(2024, 1, 20), datetime.datetime(2024, 1, 25, 13)
#: The full computation that each relation has to equal.
FULL = {
    "share_price_stats_hourly": "m1_share_price_stats_hourly", "share_price_stats_daily": "m1_share_price_stats_daily", "signal_stats_hourly": "m2_signal_hourly", "signal_stats_daily": "m2_signal_daily",
    "position_change_hourly": "m3_position_change_hourly", "position_change_daily": "m3_position_change_daily", "position_cumulative_hourly": "m4_position_cumulative",
}


def kept_up(spark, d, name: str) -> tuple[Store, object]:
    """A store that was refreshed, repaired after late rows, and refreshed again; and its source."""
    ev = L.event_store(spark, d)
    late = ev.where(LATE)
    store = Store(spark, f"{shared_folder(spark)}/rollups-{uuid.uuid4().hex}", RELATIONS[name])
    daily = RELATIONS[name].part == "month"
    store.refresh(ev.where(f"NOT ({LATE})"), FIRST)
    store.invalidate(late, "0")
    store.repair(ev)
    store.refresh(ev, SECOND.replace(hour=0) if daily else SECOND)
    return store, ev


def _read(name: str):
    def run(spark, d):
        """Stored and repaired buckets below the mark, computed ones above it: as the full computation."""
        store, ev = kept_up(spark, d, name)
        return store.read(ev).withColumn("bucket", stamp("bucket"))

    return run


for _name, _full in FULL.items():
    QUERIES[f"a13_hybrid_{_name}"] = _read(_name)
    ORACLE_SQL[f"a13_hybrid_{_name}"] = ORACLE_SQL[_full]


def s4_repaired(spark, d):
    """What is stored after a repair, without what is computed above the mark."""
    store, _ = kept_up(spark, d, "position_change_hourly")
    return store.stored().where(F.col("bucket") < F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")).drop("_part").withColumn("bucket", stamp("bucket"))


QUERIES["s4_repaired_buckets"] = s4_repaired
ORACLE_SQL["s4_repaired_buckets"] = f"SELECT * FROM ({ORACLE_SQL['m3_position_change_hourly']}) WHERE bucket < '2024-01-20'"
