"""Positions as stream state against a fold in order: several batches, restarts, late changes, timers, stubs."""

import datetime

import pytest
from pyspark.sql import functions as F

from termloom.streaming import jobs, positions

SHAPE = "account long, term long, curve long, seq long, shares_delta long, assets_in long, assets_out long, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def change(account, minute, seq, shares, assets):
    return (account, 1, 0, seq, shares, assets if shares > 0 else 0, assets if shares < 0 else 0, START + datetime.timedelta(minutes=minute))


def expected(batches):
    by_key = {}
    for rows in batches:
        for a, t, c, seq, delta, came, went, at in rows:
            by_key.setdefault((a, t, c), []).append((int((at - datetime.datetime(1970, 1, 1)).total_seconds() * 1e6), seq, delta, came, went))
    out = {}
    for key, changes in by_key.items():
        shares, deposited, _, basis, realized, deposits, n = positions.fold(positions.NEW, changes)
        out[key] = (shares, deposited, round(basis, 9), round(realized, 6), shares <= 0, deposits == 0, n)
    return out


def test_fold_by_hand():
    assert positions.fold(positions.NEW, [(2, 0, -5, 0, 80), (1, 0, 10, 100, 0)]) == (5, 100, 10, 10.0, 30.0, 1, 2)
    assert positions.fold(positions.NEW, [(1, 0, -5, 0, 80)]) == (-5, 0, 0, 0.0, 80.0, 0, 1)  # a stub


@pytest.mark.parametrize("lateness", ["30 minutes", "10 days"])
def test_batches_and_restarts(spark, tmp_path, lateness):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", positions.STORE)
    batches = [
        [change(1, 0, 1, 10, 100), change(1, 5, 3, -4, 60), change(2, 3, 2, -7, 70), change(3, 1, 9, 2, 3)],
        [change(1, 40, 5, 10, 300), change(2, 50, 6, 20, 50), change(1, 35, 4, -1, 5), change(1, 35, 10, 1, 9)],  # 35 comes after 40
        [change(2, 45, 7, 3, 90), change(4, 200, 8, 1, 1)],  # before what is there, within the lateness
        [change(1, 230, 11, -16, 900), change(4, 201, 12, -1, 2)],
    ]
    table = positions.positions_table(spark.range(0), str(tmp_path / "table"), 4)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
        jobs.run_to_end(positions.standings(stream, lateness), positions.into(table), "update", str(tmp_path / "job"))
        got = {(r.account, r.term, r.curve): (r.shares, r.deposited, round(r.cost_basis, 9), round(r.realized_pnl, 6), r.closed, r.stub, r.changes) for r in table.read().collect()}
        assert got == expected(batches[: k + 1])
    late = [change(1, 1, 20, 1000, 1)]  # the watermark is past it unless ten days are allowed
    spark.createDataFrame(late, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 100).parquet(str(tmp_path / "in"))
    jobs.run_to_end(positions.standings(stream, lateness), positions.into(table), "update", str(tmp_path / "job"))
    assert table.read().where(F.col("account") == 1).first().changes == len([r for b in batches for r in b if r[0] == 1]) + (lateness == "10 days")


def test_many_positions_are_folded_at_once():
    import numpy as np

    rng = np.random.default_rng(5)
    changes = np.column_stack([np.zeros((400, 1), int), rng.integers(0, 9, (400, 1)), rng.integers(0, 2, (400, 2)), rng.integers(0, 50, (400, 1)), np.arange(400), rng.integers(-9, 10, 400), rng.integers(0, 99, (400, 2))])
    held = np.zeros((0, len(positions.HELD)), np.int64)
    for part in np.array_split(changes[np.argsort(changes[:, 4], kind="stable")], 3):
        held = positions.fold_all(held, part)
    by_key = {}
    for r in changes.tolist():
        by_key.setdefault(tuple(r[:4]), []).append(tuple(r[4:]))
    got = {tuple(r[:4].tolist()): (*r[4:7].tolist(), *r[7:9].copy().view(np.float64).tolist(), *r[9:].tolist()) for r in held}
    assert got == {k: positions.fold(positions.NEW, v) for k, v in by_key.items()}
