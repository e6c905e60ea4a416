"""Helpers that several operators share: input normalisation, lineage cuts and joins on heavy keys."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.session import shared_folder

#: Bytes that a batch handed to a Python task may have.
BATCH_BYTES = 4 << 20

_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("tables written in each open scope", default=())


def bound_batches(spark: SparkSession) -> None:
    """Hand rows to Python tasks in batches of at most BATCH_BYTES, unless the session asks for less: a worker holds a batch at a time.

    This is a setting of the session and stays, because results are computed when they are
    asked for; it bounds bytes only, so it changes no result and no number of rows.
    """
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        asked = int(spark.conf.get(setting, str(BATCH_BYTES)))
    except ValueError:  # with a unit
        return
    if not 0 < asked <= BATCH_BYTES:
        asked = BATCH_BYTES
    spark.conf.set(setting, str(asked))


def materialize(df: DataFrame, name: str, outlives_scope: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, survives lost executors. Inside dropped_after() the table goes at its end, unless it outlives the scope."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    scopes = _scopes.get()[:-1] if outlives_scope else _scopes.get()
    if scopes:
        scopes[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def dropped_after(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize() writes within are deleted at the end; what is returned from it must only read tables that outlive it."""
    written: list[str] = []
    token = _scopes.set((*_scopes.get(), written))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in written:
            _delete(spark, path)


def discard(df: DataFrame) -> None:
    """Delete a table made by materialize() once nothing reads it any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


#: Keys with more than one in HEAVY of all rows are dealt out; there are fewer than HEAVY of them, whatever the input.
HEAVY, LEAST_HEAVY = 1000, 1000


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, spread_by: Column, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) to keys, a written table with one row for each key and its number of rows in column count; rows of heavy keys are dealt out by spread_by.

    The heavy keys (fewer than HEAVY) are broadcast with their number of salts, so that
    rows pass once and no key sends more than its fair share to one task.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    pieces = F.ceil(F.col(count) / F.lit(max(LEAST_HEAVY, total // HEAVY))).cast("int")
    heavy = keys.where(pieces > 1).select(*on, pieces.alias("__salts"))
    salt = F.when(F.col("__salts").isNull(), F.lit(0)).otherwise(F.pmod(spread_by, F.col("__salts")).cast("int"))
    left = rows.join(F.broadcast(heavy), on, "left").withColumn("__salt", salt).drop("__salts")
    right = keys.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(pieces, F.lit(1)) - 1)))
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def text_of(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_keys(column: str) -> list[Column]:
    """Two independent 64-bit hashes that together stand for a text (k1, k2)."""
    text = text_of(column)
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("termloom"), text).alias("k2")]


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct, so that no name of theirs clashes with a working column."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt out evenly if it is scanned in fewer pieces than there are cores (small inputs in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
