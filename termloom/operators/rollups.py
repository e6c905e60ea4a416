"""Continuous aggregates: rollups kept as partitioned tables that refresh forward, repair what late rows have touched, and read on into rows not yet stored.

A store keeps a rollup's buckets up to its mark, in partitions of a day or a month. A refresh
computes the buckets from the mark to a new one. Rows that come late are noted in an
invalidation log, a row for each partition that they lie in below the mark; a repair reads
the log, computes just those partitions anew from the source (the scan is pruned to their
ranges of time) and overwrites them, and nothing else is written. Reading gives the stored
buckets below the mark and, computed there and then, those above it, so that a reader sees
what a full computation would give once the log is empty.

Running sums (forward rollups) depend on all that came before: a repair of theirs goes on
from the first touched partition, starting at the sums stored before it.

Log entries lie under the name of the batch that wrote them and the mark is a versioned table, so
batches, refreshes and repairs that run twice give what they give once. A repair that fails
between writing and clearing its log is done again. One job at a time writes a store.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import market as M
from termloom.sources import ledger as L
from termloom.sources import sinks

PART = "_part"
Instant = datetime.datetime


@dataclass(frozen=True)
class Rollup:
    """compute gives rows with a bucket from events with ts; part is the unit of a partition. forward: the measures that are running sums by the keys."""

    name: str
    part: str
    compute: Callable[[DataFrame], DataFrame]
    forward: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()


def _signals(unit: str) -> Callable[[DataFrame], DataFrame]:
    def compute(ev: DataFrame) -> DataFrame:
        moved = ev.where(F.col("event_type").isin(L.KINDS["Deposited"], L.KINDS["Redeemed"]))
        return moved.groupBy(M.trunc(unit).alias("bucket"), *M.POSITION, F.col("event_type").alias("signal_type")).agg(F.sum("amount").alias("delta"), F.count(F.lit(1)).alias("n"))

    return compute


#: The seven stored relations, over the event store.
RELATIONS = {
    r.name: r
    for r in (
        Rollup("share_price_stats_hourly", "day", lambda ev: M.price_stats(L.price_ticks(ev), "hour")),
        Rollup("share_price_stats_daily", "month", lambda ev: M.price_stats(L.price_ticks(ev), "day")),
        Rollup("signal_stats_hourly", "day", _signals("hour")),
        Rollup("signal_stats_daily", "month", _signals("day")),
        Rollup("position_change_hourly", "day", lambda ev: M.position_rollup(L.position_changes(ev), "hour")),
        Rollup("position_change_daily", "month", lambda ev: M.position_rollup(L.position_changes(ev), "day")),
        Rollup("position_cumulative_hourly", "day", lambda ev: M.cumulative(M.position_rollup(L.position_changes(ev), "hour")), tuple(M.MEASURES.values()), M.POSITION),
    )
}


def _at(instant: Instant):
    return F.expr(f"TIMESTAMP_NTZ'{instant:%Y-%m-%d %H:%M:%S}'")


class Store:
    """A rollup's stored buckets, mark and invalidation log under root."""

    def __init__(self, spark: SparkSession, root: str, rollup: Rollup) -> None:
        self.spark, self.rollup = spark, rollup
        self.data, self.marks, self.log = (f"{root}/{rollup.name}/{x}" for x in ("data", "mark", "log"))

    def start_of(self, column: str = "ts"):
        """The partition that a time lies in, named by its first day."""
        return F.date_format(M.trunc(self.rollup.part, column), "yyyy-MM-dd")

    def part_range(self, name: str) -> tuple[Instant, Instant]:
        start = datetime.datetime.strptime(name, "%Y-%m-%d")
        return start, start + datetime.timedelta(days=1) if self.rollup.part == "day" else (start + datetime.timedelta(days=32)).replace(day=1)

    def mark(self) -> Instant | None:
        """Buckets that begin before it are stored; None before the first refresh."""
        return sinks.read_current(self.spark, self.marks).first().mark if sinks.numbered(self.spark, self.marks) else None

    def stored(self) -> DataFrame | None:
        if self.mark() is None or not self._exists(self.data):
            return None
        return self.spark.read.parquet(self.data).withColumn(PART, F.col(PART).cast("string"))

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _exists(self, path: str) -> bool:
        fs, place = self._fs(path)
        return fs.exists(place) and any(s.getPath().getName().startswith(PART) for s in fs.listStatus(place))

    def _write(self, rows: DataFrame, since: Instant, parts: list[str] | None = None) -> None:
        """Overwrite the partitions that rows has; parts names all that should be written, and what of them has no rows goes."""
        rows.withColumn(PART, self.start_of("bucket")).repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.data)
        if parts:
            have = {r[0] for r in rows.select(self.start_of("bucket")).distinct().collect()}  # a row a partition
            for name in set(parts) - have:
                fs, place = self._fs(f"{self.data}/{PART}={name}")
                fs.delete(place, True)

    def _compute(self, source: DataFrame, since: Instant | None, until: Instant) -> DataFrame:
        """All buckets in [since, until), with what was summed before since."""
        rows = source.where(F.col("ts") < _at(until))
        if since is not None:
            rows = rows.where(F.col("ts") >= _at(since))
        return self._on(self.rollup.compute(rows), since)

    def _on(self, fresh: DataFrame, since: Instant | None) -> DataFrame:
        forward, keys = self.rollup.forward, list(self.rollup.keys)
        stored = self.stored() if forward and since is not None else None
        if stored is None:
            return fresh
        before = stored.where(F.col("bucket") < _at(since)).groupBy(*keys).agg(F.max_by(F.struct(*forward), "bucket").alias("before"))
        joined = fresh.join(before, keys, "left")
        return joined.select(*[(F.col(c) + F.coalesce(F.col(f"before.{c}"), F.lit(0))).alias(c) if c in forward else F.col(c) for c in fresh.columns])

    def refresh(self, source: DataFrame, until: Instant) -> None:
        """Store the buckets up to until (the start of a bucket); the partition that the old mark lies in is written anew."""
        mark = self.mark()
        if mark is not None and until <= mark:
            return
        since = None if mark is None else self.part_range(f"{mark:%Y-%m-%d}" if self.rollup.part == "day" else f"{mark:%Y-%m}-01")[0]
        self._write(self._compute(source, since, until), since or until)
        sinks.write_version(self.spark.createDataFrame([(until,)], "mark timestamp_ntz"), self.marks)

    def invalidate(self, late: DataFrame, batch: str) -> None:
        """Note the partitions that rows of a late batch (already in the source) lie in below the mark."""
        mark = self.mark()
        if mark is not None:
            late.where(F.col("ts") < _at(mark)).select(self.start_of().alias("part")).distinct().coalesce(1).write.mode("overwrite").parquet(f"{self.log}/batch={batch}")

    def invalid(self) -> tuple[list[str], list[str]]:
        """The partitions in the log, in order, and the paths of its entries."""
        fs, place = self._fs(self.log)
        if not fs.exists(place):
            return [], []
        entries = [s.getPath().toString() for s in fs.listStatus(place) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        parts = {r.part for r in self.spark.read.schema("part string").parquet(*entries).distinct().collect()} if entries else set()  # a row a partition
        return sorted(parts), entries

    def repair(self, source: DataFrame) -> list[str]:
        """Compute the partitions in the log anew; returns their names. The log is empty afterwards."""
        parts, entries = self.invalid()
        mark = self.mark()
        if parts:
            if self.rollup.forward:
                since = self.part_range(parts[0])[0]
                self._write(self._compute(source, since, mark), since)
            else:
                ranges = [(a, min(b, mark)) for a, b in _joined([self.part_range(p) for p in parts])]
                inside = F.lit(False)
                for a, b in ranges:
                    inside = inside | ((F.col("ts") >= _at(a)) & (F.col("ts") < _at(b)))
                bounded = source.where((F.col("ts") >= _at(ranges[0][0])) & (F.col("ts") < _at(ranges[-1][1]))).where(inside)
                self._write(self.rollup.compute(bounded), ranges[0][0], parts)
        for path in entries:
            fs, place = self._fs(path)
            fs.delete(place, True)
        return parts

    def read(self, source: DataFrame) -> DataFrame:
        """The stored buckets below the mark and those of the source's rows from the mark on."""
        mark, stored = self.mark(), self.stored()
        if mark is None:
            return self.rollup.compute(source)
        fresh = self._on(self.rollup.compute(source.where(F.col("ts") >= _at(mark))), mark)
        return fresh if stored is None else stored.where(F.col("bucket") < _at(mark)).select(*fresh.columns).unionByName(fresh)


def _joined(ranges: list[tuple[Instant, Instant]]) -> list[tuple[Instant, Instant]]:
    """Ranges in order, those that meet as one."""
    out: list[tuple[Instant, Instant]] = []
    for a, b in ranges:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out
