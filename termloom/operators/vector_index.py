"""An inverted-file vector index: every row lies in the cell of its nearest centre; searches look into the nearest cells, or, exactly, into all that may hold a better row.

Centres come from a bounded sample (SAMPLED rows by a hash of their ids, in its order, so that
reruns agree however the rows arrive) by k-means; all rows are then dealt to them. Cells are sorted into the files, so that a scan for a few
cells skips the others; a cell with more than a block of rows is several parts. Vectors are
stored at length 1, at half precision (2 bytes a number) or full.

Cosine similarity is what distance between vectors of length 1 says: a row at distance r
from its cell's centre is at least d - r away from a query at distance d from that centre.
An exact search first looks into a query's nearest cells, and then into every cell that
this bound doesn't rule out against the k-th row found so far.

Rows without a usable vector (null, empty, zero, null or non-finite components) aren't
indexed and are never queries. All vectors have one length. Repeated rows are rows of their
own; a query never finds rows with its own id.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import vectors as V
from termloom.session import shared_folder, written

#: Rows that k-means sees, its rounds, the most cells, and rows of a part.
SAMPLED, ROUNDS, MOST_CELLS, PART_ROWS = 16_384, 8, 4096, 8192
#: Distances are computed from similarities; what rounding may take from them.
SLACK = 1e-4


def centres_of(sample: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """n centres of vectors of length 1, by k-means begun at random rows; a centre that loses all its rows begins anew at the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(n, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        near = nearest(sample, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, sample)
        full = counts > 0
        centres = np.where(full[:, None], sums / np.maximum(counts, 1)[:, None], centres)
        lost = np.flatnonzero(~full)
        if len(lost):
            far = np.argsort(np.linalg.norm(sample - centres[near], axis=1))[::-1]
            centres[lost] = sample[far[: len(lost)]]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for start in range(0, len(x), 4096):
        out[start : start + 4096] = distances(x[start : start + 4096], centres).argmin(axis=1)
    return out


@dataclass
class VectorIndex:
    """Where an index lies, and what is known of its cells (a number each, MOST_CELLS at most)."""

    path: str
    precision: str
    centres: np.ndarray
    radius: np.ndarray
    parts: np.ndarray

    def rows(self, spark: SparkSession) -> DataFrame:
        """vec_id, cell, part, packed."""
        return spark.read.schema("vec_id long, cell int, part int, packed binary").parquet(self.path)

    def probes(self, queries: np.ndarray, n: int) -> list[np.ndarray]:
        """The n nearest cells of each query."""
        return list(np.argsort(distances(queries, self.centres), axis=1, kind="stable")[:, :n])

    def open_cells(self, queries: np.ndarray, least: np.ndarray, done: int) -> list[np.ndarray]:
        """The cells after the done nearest ones that may hold a row at least as similar to a query as least says."""
        d = distances(queries, self.centres)
        order = np.argsort(d, axis=1, kind="stable")
        reach = np.maximum(0, d - self.radius - SLACK)
        may = 1 - reach**2 / 2 >= least[:, None] - 1e-9
        np.put_along_axis(may, order[:, :done], False, axis=1)
        return [np.flatnonzero(m) for m in may]


def build(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cells: int | None = None, precision: str = "half", root: str | None = None) -> VectorIndex:
    """Index all rows; cells is about the square root of their number unless given. The index lies under root, by default in the shared folder, until it is deleted."""
    spark = rows.sparkSession
    path = f"{root or shared_folder(spark)}/vector-index-{uuid.uuid4().hex}"
    packed = V.pack(rows.select(F.col(id_col).cast("long").alias("vec_id"), vector_col), vector_col)
    total = packed.count()
    n = min(MOST_CELLS, cells or max(1, round(total**0.5)))
    drawn = packed.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // SAMPLED))) == 0)
    sample = drawn.select("vec_id", "packed").orderBy(F.xxhash64("vec_id"), "vec_id", "packed").limit(2 * SAMPLED).toArrow()
    centres = centres_of(V.unpacked(sample.column(1), "full"), n) if sample.num_rows else np.zeros((1, 1))
    shared = spark.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = V.unpacked(pa.chunked_array([b.column(1)]), "full")
            cell = nearest(x, shared.value)
            kept = x.astype(V.PRECISIONS[precision])
            far = np.linalg.norm(x - shared.value[cell], axis=1)
            yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "cell": pa.array(cell.astype(np.int32)), "packed": pa.array([v.tobytes() for v in kept], pa.binary()), "far": pa.array(far)})

    placed = written(packed.mapInArrow(dealt, "vec_id long, cell int, packed binary, far double"), "vector-cells")
    radius, parts = np.zeros(len(centres)), np.ones(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row a cell
        radius[r.cell], parts[r.cell] = r.far, -(-r.n // PART_ROWS)
    index = VectorIndex(path, precision, centres, radius, parts)
    part = F.pmod(F.xxhash64("vec_id"), _parts_of_cell(parts)).cast("int")
    placed.select("vec_id", "cell", part.alias("part"), "packed").repartitionByRange("cell", "part").sortWithinPartitions("cell", "part").write.parquet(path)
    return index


def _parts_of_cell(parts: np.ndarray) -> Column:
    """The number of parts of a row's cell; only cells of several parts are named."""
    several = {int(c): int(p) for c, p in enumerate(parts) if p > 1}
    if not several:
        return F.lit(1)
    known = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.col("cell")), F.lit(1))


def _look(index: VectorIndex, wanted: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity of the k nearest rows of each wanted (query_id, packed, cell): queries of a cell meet its parts in blocks."""
    spark = wanted.sparkSession
    wanted = written(wanted, "probes")
    blocks = {r.cell: -(-r["count"] // V.BLOCK_ROWS) for r in wanted.groupBy("cell").count().collect()}  # a row a cell
    meeting = spark.createDataFrame([(c, p, b, n) for c, n in blocks.items() for p in range(int(index.parts[c])) for b in range(n)], "cell int, part int, block int, blocks int")
    first = meeting.where("part = 0 AND block = 0").select("cell", "blocks")
    dealt = wanted.join(first, "cell").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    queries = dealt.select("cell", "block", "query_id", "packed").join(meeting.drop("blocks"), ["cell", "block"])
    rows = index.rows(spark).where(F.col("cell").isin(*blocks)) if len(blocks) <= 1000 else index.rows(spark)  # few cells: the scan skips the others
    copies = rows.join(meeting.drop("blocks"), ["cell", "part"])
    precision = index.precision
    return queries.groupBy("cell", "part", "block").cogroup(copies.groupBy("cell", "part", "block")).applyInArrow(lambda a, b: V.best_in_block(a, b, k, precision), V.FOUND)


def _ask(index: VectorIndex, packed: DataFrame, cells, explode: str = "explode") -> DataFrame:
    """query_id, packed, cell for the cells that cells(index, batch) gives for each query; with their rank in that order if exploded by position."""
    shared = packed.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                found = cells(shared.value, b)
                yield pa.RecordBatch.from_pydict({"query_id": b.column(0), "packed": b.column(1), "cells": pa.array([c.astype(np.int32).tolist() for c in found], pa.list_(pa.int32()))})

    asked = packed.mapInArrow(run, "query_id long, packed binary, cells array<int>")
    return asked.select("query_id", "packed", F.explode("cells").alias("cell") if explode == "explode" else F.posexplode("cells").alias("rank", "cell"))


def search(index: VectorIndex, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, query_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, vec_id, place, similarity of each query's k nearest rows in its probes nearest cells; of all rows if exact, which asks for an index of full precision.

    A query id stands for one query. Tasks hold a part of a cell and a block of the queries that look into it.
    """
    if exact and index.precision != "full":
        raise ValueError("an exact search needs vectors at full precision")
    packed = V.pack(queries.select(F.col(query_col).cast("long").alias("query_id"), vector_col), vector_col)
    q = lambda b: V.unpacked(pa.chunked_array([b.column(1)]), "full")
    found = _look(index, _ask(index, packed, lambda i, b: i.probes(q(b), probes)), k)
    if exact:
        found = written(V.first_k(found, k).drop("place"), "found")
        kth = found.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("similarity")).alias("least"))
        after = packed.join(kth, "query_id", "left").select("query_id", "packed", F.coalesce("least", F.lit(-2.0)).alias("least"))
        more = _ask(index, after, lambda i, b: i.open_cells(q(b), b.column(2).to_numpy(), probes))
        found = found.unionByName(_look(index, more, k))
    return V.first_k(found, k)


def probes_for(index: VectorIndex, queries: DataFrame, truth: DataFrame, target: float = 0.95, query_col: str = "query_id", vector_col: str = "embedding") -> int:
    """The least number of cells to look into that recalls the target share of truth (query_id, vec_id: what an exact search finds for these queries).

    Each true row's cell has a rank in its query's order of cells; the ranks are counted, a row
    a rank, and the smallest that covers the target is the answer. The queries should be
    others than those that the answer is for, and a few hundred are enough; where there are
    none, nothing is known, and the answer is all cells.
    """
    packed = V.pack(queries.select(F.col(query_col).cast("long").alias("query_id"), vector_col), vector_col)
    asked = _ask(index, packed, lambda i, b: i.probes(V.unpacked(pa.chunked_array([b.column(1)]), "full"), len(i.centres)), "posexplode")
    lie = truth.select("query_id", "vec_id").join(index.rows(queries.sparkSession).select("vec_id", "cell"), "vec_id")
    counts = lie.join(asked.select("query_id", "cell", "rank"), ["query_id", "cell"]).groupBy("rank").count().orderBy("rank").collect()  # a row a cell at most
    total, held = sum(r["count"] for r in counts), 0
    for r in counts:
        held += r["count"]
        if held >= target * total:
            return r["rank"] + 1
    return len(index.centres)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """n (rows of truth) and recall, the share of them that found has: one row."""
    hits = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n"), (F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
