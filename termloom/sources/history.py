"""An event history dealt to hash buckets of its keys, so that the history of some keys is read without the others'; and sets of marked keys that are drained once.

Batches have numbers and replace what a batch of their number wrote, so a replay changes
nothing. Marks are claimed by a named job: a job that fails and runs again gets the claim
that it had, and what is marked meanwhile waits for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.sources.sinks import numbered

BUCKET = "_bucket"


def _names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith(prefix)) if fs.exists(place) else []


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class History:
    """Rows of batches under root, in buckets by keys."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], buckets: int = 64) -> None:
        self.spark, self.root, self.schema, self.keys, self.buckets = spark, root, schema, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, batch: int) -> None:
        placed = rows.select(*self.schema.names).withColumn(BUCKET, self._bucket())
        placed.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/batch={batch}")

    def folders(self, buckets: set[int] | None = None) -> list[str]:
        out = []
        for batch in numbered(self.spark, self.root, "batch="):
            out += [f"{self.root}/batch={batch}/{n}" for n in _names(self.spark, f"{self.root}/batch={batch}", f"{BUCKET}=") if buckets is None or int(n.partition("=")[2]) in buckets]
        return out

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        return self._read(self.folders())

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        wanted = keys.select(*self.keys).distinct()
        found = {r[0] for r in wanted.select(self._bucket().alias(BUCKET)).distinct().collect()}  # a row a bucket at most
        return self._read(self.folders(found)).join(wanted, self.keys, "left_semi")


class Marks:
    """A set of marked keys under root."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType) -> None:
        self.spark, self.root, self.schema = spark, root, schema

    def mark(self, keys: DataFrame, batch: int) -> None:
        keys.select(*self.schema.names).distinct().write.mode("overwrite").parquet(f"{self.root}/marks/batch={batch}")

    def claim(self, job: str) -> DataFrame:
        """The keys that are marked and that no job has claimed; for a job that has claimed before and isn't done, those of its claim."""
        claim = f"{self.root}/claims/{job}"
        if "_SUCCESS" not in _names(self.spark, claim, "_SUCCESS"):
            taken = {r.batch for other in _names(self.spark, f"{self.root}/claims", "") if other != job for r in self._claimed(other)}
            free = [(b,) for b in numbered(self.spark, f"{self.root}/marks", "batch=") if b not in taken]
            self.spark.createDataFrame(free, "batch long").coalesce(1).write.mode("overwrite").parquet(claim)
        paths = [f"{self.root}/marks/batch={r.batch}" for r in self._claimed(job)]
        return self.spark.read.schema(self.schema).parquet(*paths).distinct() if paths else self.spark.createDataFrame([], self.schema)

    def _claimed(self, job: str) -> list:
        return self.spark.read.schema("batch long").parquet(f"{self.root}/claims/{job}").collect()  # a row a batch

    def done(self, job: str) -> None:
        """Forget a job's claim and the marks it took."""
        for r in self._claimed(job):
            _delete(self.spark, f"{self.root}/marks/batch={r.batch}")
        _delete(self.spark, f"{self.root}/claims/{job}")
