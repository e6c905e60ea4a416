"""Streaming queries; each equals its batch form, which is what the oracle computes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from termloom.plans import market  # noqa: F401  (its twins are registered first)
from termloom.plans.base import ORACLE_SQL, query
from termloom.sources.ledger import position_changes
from termloom.streaming import jobs as S
from termloom.streaming import positions as P


@query("s3_tumbling_windows", "w AS (SELECT max(ts) AS top FROM dep) SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, term, curve, count(*) AS n, CAST(sum(assets) AS BIGINT) AS volume FROM dep, w WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w.top - INTERVAL 3 HOUR GROUP BY ALL")
def s3(spark, d):
    """Windows that the watermark has closed by the end of the input."""
    out = S.run_to_end(S.tumbling_volume(S.event_stream(spark, d)))
    return spark.read.parquet(out).select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "term", "curve", "n", "volume")


#: The events as they arrive: what comes in a batch, by SQL of both engines; a few events of the first days come with the last batch.
_LATE = "seq % 50 = 0 AND ts < TIMESTAMP_NTZ'2024-01-10'"
_ARRIVALS = (f"ts < TIMESTAMP_NTZ'2024-01-10' AND NOT ({_LATE})", "ts >= TIMESTAMP_NTZ'2024-01-10' AND ts < TIMESTAMP_NTZ'2024-01-20'", f"ts >= TIMESTAMP_NTZ'2024-01-20' OR ({_LATE})")


def _arriving(spark, d, consume) -> None:
    """Lets the events arrive in three batches, each an appended folder of part files, and has consume(sf_dir) called after each."""
    from termloom.plans.base import table

    root = f"{S.shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    events = table(spark, d, "events").withColumn("seq", F.col("event_id"))
    for batch in _ARRIVALS:
        events.where(batch).drop("seq").write.mode("append").parquet(f"{root}/events.parquet")
        consume(root)


@query("s4_late_rows", f"w AS (SELECT max(ts) AS top FROM dep) SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, term, curve, count(*) AS n, CAST(sum(assets) AS BIGINT) AS volume FROM dep, w WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= w.top - INTERVAL 3 HOUR AND NOT ({_LATE}) GROUP BY ALL".replace("TIMESTAMP_NTZ", "TIMESTAMP "))
def s4(spark, d):
    """Several batches and restarts; rows that come after the watermark has passed their window are dropped."""
    folder = f"{S.shared_folder(spark)}/late-{uuid.uuid4().hex}"
    _arriving(spark, d, lambda root: S.run_to_end(S.tumbling_volume(S.event_stream(spark, root, 10_000)), folder=folder))
    return spark.read.parquet(f"{folder}/out").select(F.date_format("bucket", "yyyy-MM-dd HH:mm:ss").alias("bucket"), "term", "curve", "n", "volume")


@query("s5_compacted_fold", "SELECT account, CAST(sum(amount) AS BIGINT) AS amount, count(*) AS events FROM ev GROUP BY account")
def s5_compacted(spark, d):
    """The fold over several batches, made one base after every second."""
    folder = f"{S.shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    keys, measures = ["account"], ["amount", "events"]
    fold = S.merge_sums(f"{folder}/sums", keys, measures, compact_every=2)

    def consume(root: str) -> None:
        S.run_to_end(S.event_stream(spark, root, 10_000).select("account", "amount", F.lit(1).cast("long").alias("events")), fold, "append", folder)

    _arriving(spark, d, consume)
    return S.merged(spark, f"{folder}/sums", keys, measures)


@query("s5_stateful_fold", "SELECT account, CAST(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE 0 END) AS BIGINT) AS deposited, count(*) AS events FROM ev GROUP BY account")
def s5(spark, d):
    folder = f"{S.shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    keys, measures = ["account"], ["deposited", "events"]
    rows = S.event_stream(spark, d).select("account", F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(0).alias("deposited"), F.lit(1).cast("long").alias("events"))
    S.run_to_end(rows, S.merge_sums(f"{folder}/sums", keys, measures), "append", folder)
    return S.merged(spark, f"{folder}/sums", keys, measures)


@query("s5_position_state")
def s5_positions(spark, d):
    """Order-dependent state: cost basis and realised profit over three arrivals with restarts, some changes out of order, into a keyed table."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", P.STORE)
    folder = f"{S.shared_folder(spark)}/positions-{uuid.uuid4().hex}"
    table = P.positions_table(spark.range(0), f"{folder}/table", buckets=8)

    def consume(root: str) -> None:
        changes = position_changes(S.event_stream(spark, root, 10_000))
        S.run_to_end(P.standings(changes, "25 days"), P.into(table), "update", folder)

    _arriving(spark, d, consume)
    return table.read().select("account", "term", "curve", "shares", "deposited", F.round("cost_basis", 6).alias("cost_basis"), F.round("realized_pnl", 4).alias("realized_pnl"), "closed")


ORACLE_SQL["s5_position_state"] = ORACLE_SQL["p8_position_tracking"]


@query("s6_dedupe_stream", "SELECT event_type, count(*) AS n FROM ev GROUP BY event_type")
def s6(spark, d):
    out = S.run_to_end(S.first_seen_events(S.event_stream(spark, d)))
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("s8_retention", "SELECT count(*) AS kept, strftime(min(ts), '%Y-%m-%d') >= '2024-01-17' AS fresh FROM ev WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14 DAY")
def s8(spark, d):
    """A table in partitions of a day: those that are too old go, the others stay as they are."""
    from termloom.sources import sinks
    from termloom.sources.ledger import event_store

    root = f"{S.shared_folder(spark)}/retained-{uuid.uuid4().hex}"
    event_store(spark, d).select("seq", "ts", F.date_format("ts", "yyyy-MM-dd").alias("_day")).repartition("_day").write.partitionBy("_day").parquet(root)
    sinks.drop_partitions(spark, root, "_day", "2024-01-17")
    return spark.read.parquet(root).agg(F.count(F.lit(1)).alias("kept"), (F.date_format(F.min("ts"), "yyyy-MM-dd") >= "2024-01-17").alias("fresh"))
