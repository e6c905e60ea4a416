"""Vectors: packing at full or half precision, exact top-k in blocks, weighted means that fade with age, and experiment arms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Vectors on either side of a block.
BLOCK_ROWS = 8192
#: Components of a vector that are summed in a row.
PIECE = 64
#: Stored number types by name.
PRECISIONS = {"full": np.float64, "half": np.float16}
FOUND = "query_id long, vec_id long, similarity double"


def usable(vector: Column) -> Column:
    """Vectors with a direction: not null, no null or non-finite component, not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def units(column: pa.Array) -> np.ndarray:
    """The vectors of a list column, of one length each, scaled to length 1."""
    m = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def pack(rows: DataFrame, vector_col: str, precision: str = "full") -> DataFrame:
    """rows with the column packed (the vector at length 1, little-endian numbers of the precision) in place of vector_col; rows without a usable vector are left out."""
    others = [f for f in rows.schema.fields if f.name != vector_col]
    kept = rows.where(usable(F.col(vector_col))).select(*[F.col(f"`{f.name}`") for f in others], vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = units(b.column(b.num_columns - 1)).astype(PRECISIONS[precision]) if b.num_rows else []
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes() for x in m], pa.binary())], [*b.schema.names[:-1], "packed"])

    return kept.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["packed binary"]))


def unpacked(column: pa.ChunkedArray, precision: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), PRECISIONS[precision]).reshape(len(column), -1).astype(np.float64)


def best_in_block(queries: pa.Table, rows: pa.Table, k: int, precision: str) -> pa.Table:
    """query_id, vec_id, similarity of each query's k nearest rows with another id, by cosine, ties by id."""
    parts = []
    if queries.num_rows and rows.num_rows:
        q, x = unpacked(queries.column("packed"), "full"), unpacked(rows.column("packed"), precision)
        if precision != "full":
            x /= np.linalg.norm(x, axis=1, keepdims=True)
        names = rows.column("vec_id").to_numpy()
        at = np.argsort(names, kind="stable")
        names, x = names[at], x[at]
        for start in range(0, len(q), 256):  # bounds the matrix of similarities
            ids = queries.column("query_id").to_numpy()[start : start + 256]
            sim = np.round(q[start : start + 256] @ x.T, 9)
            sim[ids[:, None] == names[None, :]] = -np.inf
            order = np.argsort(-sim, axis=1, kind="stable")[:, :k]  # rows stand by id
            best = np.take_along_axis(sim, order, 1)
            good = np.isfinite(best)
            parts.append(pa.table({"query_id": np.broadcast_to(ids[:, None], best.shape)[good], "vec_id": names[order][good], "similarity": best[good]}))
    return pa.concat_tables(parts) if parts else pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})


def first_k(found: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, place, similarity: the k nearest of what blocks have found."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")).cast("long")
    return found.withColumn("place", place).where(F.col("place") <= k).select("query_id", "vec_id", "place", "similarity")


def top_k(queries: DataFrame, rows: DataFrame, k: int, query_col: str = "query_id", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, place, similarity of each query's k nearest other rows by cosine, ties by id: exact, all queries against all rows.

    Both sides are dealt into blocks of about BLOCK_ROWS vectors, and each block of queries
    meets each block of rows in a task of its own; a block hands on k rows a query. Block
    numbers are of one type on both sides: cogrouped sides of different types are hashed differently.
    """
    n_queries, n_rows = (max(1, -(-df.count() // BLOCK_ROWS)) for df in (queries, rows))
    side = lambda df, name, own, other, n_own, n_other: df.withColumn(own, F.pmod(F.xxhash64(name), F.lit(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))
    q = side(pack(queries.select(F.col(query_col).cast("long").alias("query_id"), vector_col), vector_col), "query_id", "qb", "rb", n_queries, n_rows)
    x = side(pack(rows.select(F.col(id_col).cast("long").alias("vec_id"), vector_col), vector_col), "vec_id", "rb", "qb", n_rows, n_queries)
    found = q.groupBy("qb", "rb").cogroup(x.groupBy("qb", "rb")).applyInArrow(lambda a, b: best_in_block(a, b, k, "full"), FOUND)
    return first_k(found, k).withColumn("similarity", F.round("similarity", 5))


def interest_vectors(events: DataFrame, vectors: DataFrame, weights: dict[str, float], as_of: str, half_life_days: float = 7, window_days: int = 30) -> DataFrame:
    """account, vector (of length 1), event_count, last_event_at: what an account was interested in, newer events counting more.

    events has account, item, event_type and ts, vectors has item and vector. An event
    counts its type's weight times 2 to the power of minus its age over the half-life; other
    types, events of other items, and those older than the window don't count. Events of an account
    and item are summed before they meet the item's vector, whose components are summed side by side,
    PIECE of them in a row, so that no vector of an account is held but its sum.
    """
    now = F.expr(f"TIMESTAMP_NTZ'{as_of}'")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    age = F.timestamp_diff("SECOND", F.col("ts"), now) / F.lit(86400.0)
    recent = events.where((F.col("ts") > now - F.expr(f"INTERVAL {window_days} DAY")) & (F.col("ts") <= now) & F.col("event_type").isin(*weights))
    worth = known[F.col("event_type")] * F.pow(F.lit(2.0), -age / F.lit(float(half_life_days)))
    summed = recent.groupBy("account", "item").agg(F.sum(worth).alias("weight"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    met = summed.join(vectors.where(usable(F.col("vector"))).select("item", "vector"), "item")
    width = vectors.agg(F.max(F.size("vector"))).first()[0] or 0
    pieces = met.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(max(0, (width - 1) // PIECE)))))
    x = [F.sum(F.col("weight") * F.get("vector", F.col("piece") * PIECE + i).cast("double")) for i in range(min(width, PIECE))]
    sums = pieces.groupBy("account", "piece").agg(F.array_compact(F.array(*x) if x else F.array().cast("array<double>")).alias("xs"), F.sum("n").alias("event_count"), F.max("last").alias("last_event_at"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("piece", "xs"))), lambda p: p["xs"])
    whole = sums.groupBy("account").agg(F.flatten(parts).alias("vector"), F.max("event_count").alias("event_count"), F.max("last_event_at").alias("last_event_at"))
    normed = whole.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v)))
    unit = F.transform("vector", lambda v: F.when(F.col("norm") > 0, v / F.col("norm")).otherwise(F.lit(0.0)))
    return normed.select("account", unit.alias("vector"), "event_count", "last_event_at")


def bucket_of(subject: Column, experiment: Column, buckets: int = 10_000) -> Column:
    """The bucket of a subject in an experiment, the same wherever it is computed; other experiments deal anew."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", experiment, subject.cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def assign(subjects: DataFrame, arms: DataFrame, assigned: DataFrame | None = None, buckets: int = 10_000) -> DataFrame:
    """account, experiment, variant: every account of subjects in every experiment of arms, by hash buckets dealt to variants in proportion to their shares.

    arms has experiment, variant and share (a row a variant, few). Who is in assigned keeps
    the variant of then, whatever the shares are now; of several there the least counts.
    """
    order = W.partitionBy("experiment").orderBy("variant")
    ends = F.sum("share").over(order) / F.sum("share").over(W.partitionBy("experiment"))
    ranges = arms.withColumn("until", F.round(ends * buckets).cast("long")).withColumn("since", F.coalesce(F.lag("until").over(order), F.lit(0).cast("long")))
    experiments = ranges.groupBy("experiment").agg(F.collect_list(F.struct("since", "until", "variant")).alias("ranges"))
    every = subjects.select("account").distinct().join(F.broadcast(experiments))  # arms: a row a variant
    bucket = bucket_of(F.col("account"), F.col("experiment"), buckets)
    variant = F.filter("ranges", lambda r: (r["since"] <= bucket) & (bucket < r["until"]))[0]["variant"]
    fresh = every.select("account", "experiment", variant.alias("variant"))
    if assigned is None:
        return fresh
    held = assigned.groupBy("account", "experiment").agg(F.min("variant").alias("held"))
    return fresh.join(held, ["account", "experiment"], "left").select("account", "experiment", F.coalesce("held", "variant").alias("variant"))
