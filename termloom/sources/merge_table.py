"""A keyed table that takes batches without being rewritten: hash buckets, deltas merged when read, compaction of the buckets that have many.

A batch is reduced to a row for each of its keys and written as a delta, one file in each
bucket that its keys fall into and nothing elsewhere. Reading merges the base of each bucket
with its deltas. Compaction makes a new base of those buckets only whose deltas have grown
many; a small manifest (a versioned table, a row a bucket) says which base counts for a
bucket and up to which batch it holds the deltas.

A batch has a number and replaces what a batch of its number wrote before; buckets that have
been compacted past it keep what they have, so a batch that is replayed changes nothing, at
any time. The files that a compaction replaces stay until the next one, for readers that
are at them. One job at a time writes a table; readers need no lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.sources import sinks

BUCKET = "_bucket"


class MergeTable:
    """Buckets go by the keys, or by some of them. merge tells for each column that isn't a key how rows of one key become one: sum, min, max, or latest (by the column order, which is kept as its maximum)."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, keys: list[str], merge: dict[str, str], order: str | None = None, buckets: int = 64, bucket_by: list[str] | None = None) -> None:
        if set(schema.names) != {*keys, *merge, *([order] if order else [])} or ("latest" in merge.values() and not order):
            raise ValueError("every column is a key, merged, or the order")
        self.spark, self.root, self.schema, self.keys, self.merge, self.order, self.buckets = spark, root, schema, keys, merge, order, buckets
        self.bucket_by = bucket_by or keys

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _merged(self, rows: DataFrame, *also: str) -> DataFrame:
        """A row for each key."""
        late = [c for c, how in self.merge.items() if how == "latest"]
        how = {"sum": F.sum, "min": F.min, "max": F.max}
        found = [how[h](c).cast(self.schema[c].dataType).alias(c) for c, h in self.merge.items() if h != "latest"]
        if late:
            found.append(F.max_by(F.struct(*late), self.order).alias("_late"))
        if self.order:
            found.append(F.max(self.order).alias(self.order))
        one = rows.groupBy(*self.keys, *also).agg(*found)
        return one.select(*[F.col(f"_late.{c}").alias(c) if c in late else F.col(c) for c in self.schema.names], *also)

    # --- state ---------------------------------------------------------------

    def _manifest(self) -> dict[int, tuple[int, int]]:
        """For each compacted bucket the generation of its base and the last batch in it."""
        if not sinks.numbered(self.spark, f"{self.root}/manifest"):
            return {}
        return {r.bucket: (r.generation, r.batch) for r in sinks.read_current(self.spark, f"{self.root}/manifest").collect()}  # a row a bucket

    def _batches(self) -> list[int]:
        return sinks.numbered(self.spark, f"{self.root}/delta", "batch=")

    def _list(self, path: str, prefix: str) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName().startswith(prefix)] if fs.exists(place) else []

    def _delete(self, path: str) -> None:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def live(self, buckets: set[int] | None = None) -> list[str]:
        """The folders that make up the table (of some buckets): a base for each compacted bucket, and the deltas after it."""
        manifest, wanted = self._manifest(), lambda b: buckets is None or b in buckets
        out = [f"{self.root}/base/generation={g}/{BUCKET}={b}" for b, (g, _) in manifest.items() if wanted(b)]
        for batch in self._batches():
            for name in self._list(f"{self.root}/delta/batch={batch}", f"{BUCKET}="):
                b = int(name.partition("=")[2])
                if wanted(b) and batch > manifest.get(b, (0, -1))[1]:
                    out.append(f"{self.root}/delta/batch={batch}/{name}")
        return out

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    # --- what users call -----------------------------------------------------

    def write(self, rows: DataFrame, batch: int) -> None:
        """Take a batch: a delta in the buckets of its keys."""
        one = self._merged(rows.select(*self.schema.names)).withColumn(BUCKET, self.bucket())
        one.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/delta/batch={batch}")

    def read(self) -> DataFrame:
        return self._merged(self._rows(self.live()))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, or values of the columns that buckets go by; only their buckets are read. There are no more bucket numbers than buckets."""
        on = [k for k in self.keys if k in keys.columns]
        found = {r[0] for r in keys.select(self.bucket().alias(BUCKET)).distinct().collect()}
        return self._merged(self._rows(self.live(found)).join(keys.select(*on).distinct(), on, "left_semi"))

    def compact(self, least_deltas: int = 8) -> list[int]:
        """Make one base of each bucket with so many deltas or more; returns these buckets."""
        manifest, batches = self._manifest(), self._batches()
        deltas: dict[int, int] = {}
        for folder in self.live():
            if "/delta/" in folder:
                b = int(folder.rpartition("=")[2])
                deltas[b] = deltas.get(b, 0) + 1
        due = {b for b, n in deltas.items() if n >= least_deltas}
        if not due:
            return []
        generation = max([g for g, _ in manifest.values()], default=0) + 1
        old = {int(x.partition("=")[2]) for x in self._list(f"{self.root}/base", "generation=")}
        rows = self._merged(self._rows(self.live(due))).withColumn(BUCKET, self.bucket())
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.root}/base/generation={generation}")
        self._forget(manifest, old)  # what the manifest before the one that now becomes the last needed
        new = manifest | {b: (generation, batches[-1]) for b in due}
        sinks.write_version(self.spark.createDataFrame([(b, g, n) for b, (g, n) in new.items()], "bucket int, generation int, batch long").coalesce(1), f"{self.root}/manifest")
        return sorted(due)

    def _forget(self, manifest: dict[int, tuple[int, int]], generations: set[int]) -> None:
        """Delete what no reader of the manifest can want: bases it doesn't name, and deltas that are in bases of all their buckets."""
        for g in generations:
            for name in self._list(f"{self.root}/base/generation={g}", f"{BUCKET}="):
                if manifest.get(int(name.partition("=")[2]), (0, 0))[0] != g:
                    self._delete(f"{self.root}/base/generation={g}/{name}")
        for batch in self._batches():
            names = self._list(f"{self.root}/delta/batch={batch}", f"{BUCKET}=")
            for name in names:
                if batch <= manifest.get(int(name.partition("=")[2]), (0, -1))[1]:
                    self._delete(f"{self.root}/delta/batch={batch}/{name}")
