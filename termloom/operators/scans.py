"""Running sums within keys by pieces, so that a key with a large share of all rows is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sums(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], piece: Column) -> DataFrame:
    """rows with the sums (by name: the column to add up) from the first row of their key to themselves, in the order given.

    piece cuts a key's rows into stretches of the order (a day of a time, say): it must never
    fall where the order rises, and the order must tell a key's rows apart. Each piece is
    summed first, a row a key and piece; these totals are carried forward within the key; and only the
    rows of a piece are ordered together, by the same partitioning that the carried totals
    come in. What a task has to order is a piece, whatever a key holds.
    """
    cut = rows.withColumn("_piece", piece)
    totals = cut.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_piece").alias("_p"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums])
    same = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = W.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    met = cut.join(carried, same)
    return met.select(*rows.columns, *[(F.col(f"_{n}") + F.sum(c).over(inside)).alias(n) for n, c in sums.items()])
