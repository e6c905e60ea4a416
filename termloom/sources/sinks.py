"""Sinks: versioned result tables that readers never see half-written, quarantine, and a sink that keeps nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession


def numbered(spark: SparkSession, root: str, prefix: str = "version=") -> list[int]:
    """Complete versions under root (or numbered folders of another prefix), oldest first; one counts once its job has committed (_SUCCESS)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(prefix)]
    done = [p for p in names if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().partition("=")[2]) for p in done)


def write_version(df: DataFrame, root: str, keep: int = 2) -> int:
    """Write df as the next version of the table at root and drop versions older than the keep newest; returns its number. Readers go on with the last complete version meanwhile."""
    spark = df.sparkSession
    have = numbered(spark, root)
    new = (have[-1] if have else 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/version={new}")
    for old in [*have, new][:-keep]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/version={old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return new


def drop_partitions(spark: SparkSession, root: str, column: str, before: str) -> list[str]:
    """Delete the partitions of the table at root (written by partitionBy of one column) whose value sorts before another; returns their values. Nothing else is read or written."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {s.getPath().getName().partition("=")[2]: s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith(f"{column}=")}
    old = sorted(v for v in found if v < before)
    for v in old:
        fs.delete(found[v], True)
    return old


def read_current(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version of the table at root."""
    have = numbered(spark, root)
    if not have:
        raise FileNotFoundError(root)
    return spark.read.parquet(f"{root}/version={have[-1]}")


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """The rows for which valid holds, and the others (also where it is null): none is lost."""
    from pyspark.sql import functions as F

    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def discard(df: DataFrame) -> None:
    """Run df in full and keep nothing."""
    df.write.format("noop").mode("overwrite").save()
