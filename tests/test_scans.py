"""Running sums by pieces against a window, with one key of nine tenths of all rows."""

import random

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators import market as M
from termloom.operators.scans import running_sums


def test_equal_to_a_window_on_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(None if rng.random() < 0.02 else 1 if rng.random() < 0.9 else rng.randint(2, 30), i * 37 % 5000, i, rng.randint(-50, 50)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k long, at long, seq long, n long").repartition(5)
    got = running_sums(df, ["k"], ["at", "seq"], {"total": F.col("n"), "rows": F.lit(1).cast("long")}, F.floor(F.col("at") / 100))
    window = W.partitionBy("k").orderBy("at", "seq").rowsBetween(W.unboundedPreceding, 0)
    expected = df.withColumns({"total": F.sum("n").over(window), "rows": F.count(F.lit(1)).over(window)})
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, expected.collect()), key=repr)
    assert running_sums(df.limit(0), ["k"], ["at"], {"total": F.col("n")}, F.col("at")).count() == 0


def test_no_order_of_a_whole_key(spark, sf_dir):
    from termloom.sources import ledger as L

    folded = M.fold_positions(L.position_changes(L.event_store(spark, sf_dir)))
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" +-:").startswith("Window")]
    assert any("_piece" in w.split("], [")[1] for w in windows)  # rows are ordered within a piece of a position
    assert all("_piece" in w for w in windows)  # and totals of pieces within a position
