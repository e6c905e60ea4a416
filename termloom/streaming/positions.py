"""Positions as keyed stream state: deposits and redemptions folded in the order of their time, whatever the order they come in.

Cost basis and realised profit depend on the order of a position's changes, so they can't be
sums of batches. Positions are kept in buckets, by a hash of their key. The state of a position is what the watermark has passed, folded, and a list of
the changes above it, which wait. Each batch that touches a position gives its standing with the
waiting changes folded on in order, so the newest row of a key is always what a full
computation over the rows so far gives; a timer at the oldest waiting change of a bucket folds for good what the
watermark has passed, so that the list holds no more than the lateness allows. Changes that come
after the watermark has passed them are dropped.

A redemption that comes before any deposit makes a stub: negative shares, no deposits yet.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from termloom.session import shared_folder
from termloom.sources.merge_table import MergeTable

KEYS = ["account", "term", "curve"]
#: A bucket's state, and what a position holds in it, as 64-bit numbers (basis and realized are doubles): shares, assets_in, shares acquired, cost basis, realised profit, deposits, changes.
STATE = "positions binary, waiting binary"
HELD = ("nulls", *KEYS, "shares", "deposited", "acquired", "basis", "realized", "deposits", "changes")
#: A change: its position (nulls has a bit for each key that is null), its time and number, and what it does.
CHANGED = ("nulls", *KEYS, "at", "seq", "delta", "assets_in", "assets_out")
OUT = "account long, term long, curve long, shares long, deposited long, cost_basis double, realized_pnl double, closed boolean, stub boolean, changes long"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEW = (0, 0, 0, 0.0, 0.0, 0, 0)


def fold(state: tuple, changes: list[tuple]) -> tuple:
    """The state after changes (at, seq, delta, assets_in, assets_out) in the order of time, then number."""
    shares, deposited, acquired, basis, realized, deposits, n = state
    for _, _, delta, came, went in sorted(changes):
        shares, deposited, acquired, n = shares + delta, deposited + came, acquired + max(delta, 0), n + 1
        basis = deposited / acquired if acquired else 0.0
        if delta < 0:
            realized += went + delta * basis
        deposits += delta > 0
    return shares, deposited, acquired, basis, realized, deposits, n


def _rows_at(keys: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct keys of all, sorted, and for each of the arrays the place of its rows' keys among them."""
    parts = [keys, *more]
    distinct, at = np.unique(np.vstack(parts), axis=0, return_inverse=True)
    return distinct, np.split(at.ravel(), np.cumsum([len(p) for p in parts])[:-1])


def fold_all(held: np.ndarray, changes: np.ndarray) -> np.ndarray:
    """The states (rows of HELD, by key) of many positions after changes (rows of CHANGED): what fold() gives for each."""
    keys, (own, key) = _rows_at(held[:, :4], changes[:, :4])
    state = np.zeros((len(keys), len(HELD)), np.int64)
    state[:, :4] = keys
    state[own] = held
    if not len(changes):
        return state
    order = np.lexsort((*changes[:, :3:-1].T, key))
    key, (delta, came, went) = key[order], changes[order, 6:].T
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    end, piece = np.append(begin[1:], len(key)) - 1, np.cumsum(np.diff(key, prepend=-1) != 0) - 1

    def running(x: np.ndarray, column: str) -> np.ndarray:
        """The running sums of x within a position, on top of what it held."""
        total = np.cumsum(x)
        return total - (total - x)[begin][piece] + state[key, HELD.index(column)]

    deposited, acquired = running(came, "deposited"), running(np.maximum(delta, 0), "acquired")
    basis = np.where(acquired != 0, deposited / np.where(acquired != 0, acquired, 1), 0.0)
    realized, out = state[:, HELD.index("realized")].copy().view(np.float64), delta < 0
    np.add.at(realized, key[out], (went + delta * basis)[out])  # one after the other, as fold() adds them
    after = {"shares": running(delta, "shares"), "deposited": deposited, "acquired": acquired, "deposits": running((delta > 0).astype(np.int64), "deposits"), "changes": running(np.ones(len(key), np.int64), "changes"), "basis": basis.view(np.int64)}
    for column, values in after.items():
        state[key[end], HELD.index(column)] = values[end]
    state[:, HELD.index("realized")] = realized.view(np.int64)
    return state


class Positions(StatefulProcessor):
    """The positions of a bucket: their states and waiting changes are two packed tables, read and written once a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bucket = handle.getValueState("bucket", STATE)

    def _settle(self, new: np.ndarray, watermark_ms: int) -> tuple[np.ndarray, np.ndarray]:
        """Fold for good what the watermark has passed; the states then, and what waits."""
        packed = self.bucket.get() if self.bucket.exists() else (b"", b"")
        held, waiting = (np.frombuffer(bytes(p), np.int64).reshape(-1, len(c)) for p, c in zip(packed, (HELD, CHANGED), strict=True))
        waiting = np.vstack([waiting, new])
        due = waiting[:, 4] <= watermark_ms * 1000
        state, rest = fold_all(held, waiting[due]), waiting[~due]
        self.bucket.update((state.tobytes(), rest.tobytes()))
        if len(rest):
            self.handle.registerTimer(int(rest[:, 4].min()) // 1000 + 1)
        return state, rest

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = np.vstack([part[list(CHANGED)].astype("int64").to_numpy() for part in rows])
        now = fold_all(*self._settle(new, timerValues.getCurrentWatermarkInMs()))
        _, (own, touched) = _rows_at(now[:, :4], new[:, :4])
        now = dict(zip(HELD, now[np.isin(own, touched)].T, strict=True))
        named = {k: pd.Series(now[k]).astype("Int64").mask((now["nulls"] >> i & 1) == 1) for i, k in enumerate(KEYS)}
        yield pd.DataFrame(named | {
            "shares": now["shares"], "deposited": now["deposited"], "cost_basis": now["basis"].copy().view(np.float64), "realized_pnl": now["realized"].copy().view(np.float64),
            "closed": now["shares"] <= 0, "stub": now["deposits"] == 0, "changes": now["changes"],
        })

    def handleExpiredTimer(self, key: Any, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._settle(np.zeros((0, len(CHANGED)), np.int64), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


def standings(changes: DataFrame, lateness: str, buckets: int = 1024) -> DataFrame:
    """A row with the standing of each position that a batch touches; changes is a stream of position changes with a timestamp ts.

    A state is a bucket of positions, by a hash of the key: a call into Python and its few reads and writes of
    state are paid once a bucket and batch, not once a position. A bucket's tables (88 bytes a position, 72 a
    waiting change) are held at once, so buckets should grow with the positions; their number is fixed for the life of a checkpoint.
    """
    named = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in KEYS]
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(k).isNull(), 1 << i).otherwise(0) for i, k in enumerate(KEYS)]).cast("long").alias("nulls")
    bucket = F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).alias("bucket")
    rows = changes.withWatermark("ts", lateness).select(bucket, nulls, *named, "ts", F.unix_micros("ts").alias("at"), "seq", F.col("shares_delta").alias("delta"), "assets_in", "assets_out")
    return rows.groupBy("bucket").transformWithStateInPandas(Positions(), OUT, "Update", "EventTime")


def into(table: MergeTable) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: a batch is a delta of the table under its own number, so a batch that is run again replaces itself."""
    return lambda batch, number: table.write(batch, number)


def positions_table(df: DataFrame, root: str | None = None, buckets: int = 64) -> MergeTable:
    """A keyed table of standings: of a position the one that knows most changes counts."""
    from pyspark.sql.types import StructType

    spark = df.sparkSession
    schema = StructType.fromDDL(OUT)
    return MergeTable(spark, root or f"{shared_folder(spark)}/positions-{uuid.uuid4().hex}", schema, KEYS, {c: "latest" for c in schema.names if c not in (*KEYS, "changes")}, "changes", buckets)
