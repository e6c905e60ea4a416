"""Positions in a total order over a whole table, without one task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.session import written


def with_position(df: DataFrame, order: list[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """df with each row's 1-based position by the columns in order (which must tell all rows apart).

    Rows are range-partitioned and sorted within partitions, then written with their place
    in their partition; the partitions' sizes, one row each, are prefix-summed.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumns({"_part": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_place") + 1).drop("_part", "_place", "_before")  # a row per partition


def exact_quantiles(df: DataFrame, column: str, ties: str, wanted: dict[str, float], by: str | None = None) -> DataFrame:
    """One row (one for each value of by) with the exact quantiles of a column, interpolated between the two rows around each: nulls don't count.

    Rows are ranked by a distributed sort; only the rows around a quantile are looked at
    then, so no task holds the values. The number of groups has to be small.
    """
    rows = df.where(F.col(column).isNotNull()).select(F.col(by).alias("_by") if by else F.lit(0).alias("_by"), F.col(column).cast("double").alias("_value"), F.col(ties).alias("_tie"))
    ranked = with_position(rows, ["_by", "_value", "_tie"], "_position")
    groups = ranked.groupBy("_by").agg(F.count(F.lit(1)).alias("_n"), (F.min("_position") - 1).alias("_before"))
    within = ranked.join(F.broadcast(groups), "_by").withColumn("_at", F.col("_position") - F.col("_before"))  # a row a group
    out = []
    for name, q in wanted.items():
        place = (F.col("_n") - 1) * F.lit(q) + 1
        low, high = F.max(F.when(F.col("_at") == F.floor(place), F.col("_value"))), F.max(F.when(F.col("_at") == F.ceil(place), F.col("_value")))
        out.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    found = within.groupBy("_by").agg(*out)
    return found.withColumnRenamed("_by", by) if by else found.drop("_by")


def tile_of(position: Column, count: Column, tiles: int) -> Column:
    """What ntile(tiles) gives the row at position of count: the first count % tiles tiles have one row more."""
    small, extra = F.floor(count / tiles), count % tiles
    in_large = position <= extra * (small + 1)
    return F.when(in_large, F.floor((position - 1) / (small + 1)) + 1).otherwise(extra + F.floor((position - 1 - extra * (small + 1)) / F.greatest(small, F.lit(1))) + 1).cast("long")
