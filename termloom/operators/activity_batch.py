"""The user-activity batch: missing days filled in, marked accounts drained, and what is due once a day or week done then.

A cycle takes up the events that came since the last one, marks their accounts, and

1. fills every day of the calendar, from the first event to today, that has no rollup yet (and
   those that the new events fall into), all in one job that overwrites whole days,
2. drains the marked accounts and makes their profiles anew, from their own history only;
   the first cycle of a day makes all profiles, as their windows have moved,
3. scores RFM and segments: of everybody in the first cycle of a day, else of the drained
   accounts, ranked among everybody,
4. adds the new events to the topic affinities; the first cycle of a day sums them anew,
5. makes the retention cohorts once seven days have passed since the last time.

What a cycle writes lies under its number and replaces itself, and the checkpoint is
written last, so a cycle that fails is run again with the same number and result.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termloom.operators import behavior as B
from termloom.sources import sinks
from termloom.sources.history import History, Marks
from termloom.sources.merge_table import MergeTable

DAY = "_day"
SCORES = StructType([StructField("account", LongType()), StructField("r", LongType()), StructField("f", LongType()), StructField("m", LongType()), StructField("segment", StringType()), StructField("made", LongType())])
CHECKPOINT = "cycle long, sweep string, cohorts string"


class ActivityBatch:
    def __init__(self, spark: SparkSession, root: str, events: StructType, windows: tuple[int, ...] = (7, 30, 90), active_days: int = 30, buckets: int = 64) -> None:
        self.spark, self.root, self.windows, self.active_days, self.buckets = spark, root, windows, active_days, buckets
        self.history = History(spark, f"{root}/events", events, ["account"], buckets)
        self.marks = Marks(spark, f"{root}/dirty", StructType([events["account"]]))
        self.scores = MergeTable(spark, f"{root}/scores", SCORES, ["account"], {c: "latest" for c in ("r", "f", "m", "segment")}, "made", buckets)

    # --- what is stored ------------------------------------------------------

    def checkpoint(self):
        """The last cycle's number, and the days of the last full sweep and of the last cohorts; None before the first."""
        return sinks.read_current(self.spark, f"{self.root}/checkpoint").first() if sinks.numbered(self.spark, f"{self.root}/checkpoint") else None

    def days(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/days").drop(DAY)

    def profiles(self) -> DataFrame:
        return self._profiles().read().drop("made")

    def affinities(self) -> DataFrame:
        return sinks.read_current(self.spark, f"{self.root}/affinity").drop("number")

    def cohorts(self) -> DataFrame:
        return sinks.read_current(self.spark, f"{self.root}/cohorts")

    def _profile(self, events: DataFrame, now: datetime.datetime) -> DataFrame:
        return B.profiles(B.daily_activity(events), f"{now:%Y-%m-%d %H:%M:%S}", windows=self.windows, active_days=self.active_days)

    def _profiles(self) -> MergeTable:
        nobody = self.spark.createDataFrame([], self.history.schema)
        schema = self._profile(nobody, datetime.datetime(2000, 1, 1)).withColumn("made", F.lit(0).cast("long")).schema
        return MergeTable(self.spark, f"{self.root}/profiles", schema, ["account"], {c: "latest" for c in schema.names if c not in ("account", "made")}, "made", self.buckets)

    def stored_days(self) -> set[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/days")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return {s.getPath().getName().partition("=")[2] for s in fs.listStatus(place) if s.getPath().getName().startswith(DAY)} if fs.exists(place) else set()

    # --- a cycle -------------------------------------------------------------

    def fill_days(self, new: DataFrame, today: datetime.date) -> list[str]:
        """Roll up the days that are missing and those of the new events; returns them. Days without events stay without a rollup and are looked at again."""
        events = self.history.read()
        first = events.agg(F.min("ts").alias("x")).first().x
        if first is None:
            return []
        calendar = {f"{first.date() + datetime.timedelta(days=k)}" for k in range((today - first.date()).days + 1)}
        touched = {r.d for r in new.select(F.date_format("ts", "yyyy-MM-dd").alias("d")).distinct().collect()}  # a row a day
        due = sorted((calendar - self.stored_days()) | (touched & calendar))
        if due:
            after = datetime.date.fromisoformat(due[-1]) + datetime.timedelta(days=1)
            bounded = events.where((F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{due[0]} 00:00:00'")) & (F.col("ts") < F.expr(f"TIMESTAMP_NTZ'{after} 00:00:00'")))
            rows = B.daily_activity(bounded).withColumn(DAY, F.date_format("day", "yyyy-MM-dd")).where(F.col(DAY).isin(due))
            rows.repartition(DAY).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(f"{self.root}/days")
        return due

    def _add_affinities(self, new: DataFrame, number: int, sweep: bool) -> None:
        """Totals with the new events; each row says the cycle that it is of, so that a cycle that runs again adds nothing twice."""
        path = f"{self.root}/affinity"
        have = sinks.read_current(self.spark, path) if sinks.numbered(self.spark, path) else None
        if have is not None and (have.agg(F.max("number")).first()[0] or -1) >= number:
            return
        totals = B.affinity_totals(self.history.read() if sweep or have is None else new)
        whole = totals if sweep or have is None else B.affinity_merge(have.drop("number"), totals)
        sinks.write_version(whole.withColumn("number", F.lit(number).cast("long")), path)

    def run(self, new: DataFrame, now: datetime.datetime) -> dict[str, str]:
        """One cycle over the events that are new; returns what each step did."""
        before = self.checkpoint()
        number, today = (before.cycle + 1 if before else 0), f"{now:%Y-%m-%d}"
        sweep = before is None or before.sweep < today
        did = {}
        self.history.append(new, number)
        self.marks.mark(new.select("account"), number)
        did["days"] = ",".join(self.fill_days(new, now.date()))

        job = f"cycle-{number}"
        dirty = self.marks.claim(job)
        profiles = self._profiles()
        chosen = self.history.read() if sweep else self.history.lookup(dirty)
        profiles.write(self._profile(chosen, now).withColumn("made", F.lit(number).cast("long")), number)
        did["profiles"] = "all" if sweep else "dirty"

        people, as_of = profiles.read().drop("made"), f"{now:%Y-%m-%d %H:%M:%S}"
        seen = chosen.where("event_type <> 'click'").groupBy("account").agg(F.min("ts").alias("first_seen"))
        scored = B.rfm(people, as_of).join(B.segments(people, seen, as_of), "account")
        scored = scored if sweep else scored.join(dirty, "account", "left_semi")
        self.scores.write(scored.withColumn("made", F.lit(number).cast("long")), number)
        did["scores"] = did["profiles"]

        self._add_affinities(new, number, sweep)
        did["affinity"] = "all" if sweep else "new"

        due = before is None or (now.date() - datetime.date.fromisoformat(before.cohorts)).days >= 7
        if due:
            first = self.history.read().where("event_type <> 'click'").groupBy("account").agg(F.min("ts").alias("first_seen"))
            sinks.write_version(B.cohorts(first, self.days()), f"{self.root}/cohorts")
        did["cohorts"] = "made" if due else "not due"
        sinks.write_version(self.spark.createDataFrame([(number, today if sweep else before.sweep, today if due else before.cohorts)], CHECKPOINT), f"{self.root}/checkpoint")
        self.marks.done(job)
        return did
