"""Streaming twins of the rollups and folds: file source, watermark, availableNow."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import shared_folder
from termloom.sources.sinks import numbered


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int = 1) -> DataFrame:
    """The event store, one file or a folder of part files, as a stream, with ts as a timestamp (watermarks need one)."""
    store = f"{sf_dir}/events.parquet"
    reader = spark.readStream.schema(spark.read.parquet(store).schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        raw = reader.parquet(store)
    else:  # a file source takes folders, so the one file is picked by name
        raw = reader.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select(
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("account"), "event_type", F.round(F.col("value") * 100).cast("long").alias("amount"),
        (F.get_json_object("props", "$.k").cast("long") % 10).alias("term"), (F.col("event_id") % 2).alias("curve"))


def tumbling_volume(events: DataFrame, width: str = "1 hour", lateness: str = "3 hours") -> DataFrame:
    """Deposits and their volume by window and vault; rows later than lateness are dropped by the watermark."""
    deposits = events.where("event_type = 'purchase'").withWatermark("ts", lateness)
    return deposits.groupBy(F.window("ts", width).alias("w"), "term", "curve").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("volume")).select(F.col("w.start").alias("bucket"), "term", "curve", "n", "volume")


def first_seen_events(events: DataFrame, lateness: str = "40 days") -> DataFrame:
    """Each event once, by its natural key within the watermark."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["seq"])


def run_to_end(stream: DataFrame, fold: Callable[[DataFrame, int], None] | None = None, mode: str = "append", folder: str | None = None) -> str:
    """Run a stream over what there is now (trigger availableNow) into Parquet under the shared folder, or through fold per batch; returns the output path.

    Offsets and state live under the same folder, so a second call with it goes on where
    the first ended; the file sink commits a batch once, whatever is retried.
    """
    folder = folder or f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    query = (writer.foreachBatch(fold) if fold else writer.format("parquet").option("path", f"{folder}/out")).start()
    query.awaitTermination()
    return f"{folder}/out"


def merge_sums(path: str, keys: list[str], measures: list[str], compact_every: int = 20) -> Callable[[DataFrame, int], None]:
    """A foreachBatch fold of additive measures: each batch writes its own sums under its batch id, so a replayed batch replaces itself; every so many batches all sums so far become one base. Read with merged()."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures]).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            state = merged(batch.sparkSession, path, keys, measures)
            state.write.mode("overwrite").parquet(f"{path}/base={batch_id}")
            _forget(batch.sparkSession, path, batch_id)

    return fold


def _parts(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The newest complete base, and the batches after it."""
    bases = numbered(spark, path, "base=")
    base = bases[-1] if bases else None
    return base, [b for b in numbered(spark, path, "batch=") if base is None or b > base]


def _forget(spark: SparkSession, path: str, base: int) -> None:
    """Delete what a complete base holds; the base before it stays for readers that are at it."""
    old = [f"batch={b}" for b in numbered(spark, path, "batch=") if b <= base] + [f"base={b}" for b in numbered(spark, path, "base=")[:-2]]
    for name in old:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merged(spark: SparkSession, path: str, keys: list[str], measures: list[str]) -> DataFrame:
    """The state that merge_sums() has folded: its newest base and the batches since."""
    base, batches = _parts(spark, path)
    parts = [f"{path}/batch={b}" for b in batches] + ([f"{path}/base={base}"] if base is not None else [])
    return spark.read.parquet(*parts).groupBy(*keys).agg(*[F.sum(m).alias(m) for m in measures])
