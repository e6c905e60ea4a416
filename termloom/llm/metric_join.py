"""Embedding near-duplicates (operator 3): an exact metric range join with pivots.

Unit vectors have cosine >= t exactly when their distance is at most r = sqrt(2 - 2t).
Pivots on two levels partition the vectors. The fine ones make cells: a vector lies in the
cell of its nearest pivot. The coarse ones gather neighbouring cells into groups of about a
block of vectors, which are what is sent around; a cell above a block is a few groups by
itself. By the triangle inequality a vector has to visit a cell only if its distance to the
cell's pivot lies within r of the distances that the cell's own vectors have, and if it
lies within r of the plane between the two pivots; it is copied once to each group of
earlier cells in which it has a cell to visit. Groups join independently, in blocks of
bounded bytes on both sides, so that a cell with a third of all vectors is spread over many
tasks. Equal vectors are joined once, as one vector with a multiplicity.

Defined results for odd input: vectors that are null, empty, zero or hold null or
non-finite components link with nothing (n_links 0, a component of their own); vectors of
different lengths don't link; rows with equal vectors all link with each other, rows with
a null id too, but such ids are never a component's id (kept is false there, and
component_id is null if a component has no other id); repeated rows count as vectors of
their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize
from termloom.llm.components import block_labels, connected_components, forest_labels

#: Vectors a fine pivot should get on average; the most pivots, which go to every task (times 8 bytes a component); vectors sampled for each.
PER_PIVOT, MOST_PIVOTS, SAMPLED = 32, 4096, 4
#: Bytes of vectors on either side of a block, and the rows and columns compared at a time.
BLOCK_BYTES, TILE = 8 << 20, 1024
#: Added to bounds, so that rounding never loses a pair.
SLACK = 1e-5


def block_rows(dim: int) -> int:
    """Vectors on either side of a block."""
    return max(256, BLOCK_BYTES // (8 * dim))


def _usable(column: str) -> Column:
    numbers = F.col(column)
    fine = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return numbers.isNotNull() & (F.size(numbers) > 0) & fine & F.exists(numbers, lambda x: x != 0)


def _matrix(vectors: list[bytes]) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that squares neither overflow nor vanish."""
    m = np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _packed(rows: DataFrame) -> DataFrame:
    """rows with column vector (array<double>) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(2)
            values, at = np.asarray(flat.flatten(), np.float64), np.concatenate([[0], np.cumsum(np.asarray(flat.value_lengths(), np.int64))])
            yield pa.RecordBatch.from_pydict({"rid": b.column(0), "n": b.column(1), "vector": pa.array([values[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())})

    return rows.mapInArrow(run, "rid long, n long, vector binary")


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Half of the pivots as they come in the sample (dense regions get more), half farthest first (small clusters get one too)."""
    n = min(n, len(sample))
    chosen = list(range((n + 1) // 2))
    near = (sample @ sample[chosen].T).max(axis=1)
    while len(chosen) < n:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, sample @ sample[chosen[-1]])
    return sample[chosen]


class Cells:
    """Pivots in the order of their groups, and what is known of their cells; small and bounded, goes to every task."""

    def __init__(self, pivots: np.ndarray, threshold: float, n_groups: int) -> None:
        self.r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        coarse = choose_pivots(pivots, n_groups)
        self.pivots = pivots[np.argsort((pivots @ coarse.T).argmax(axis=1), kind="stable")]
        n = len(pivots)
        self.near, self.far, self.homes = np.full(n, np.inf), np.zeros(n), np.zeros(n, np.int64)

    def distances(self, unit: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * unit @ self.pivots.T))

    def form_groups(self, rows: int) -> None:
        """Groups of consecutive cells with about rows vectors; a larger cell becomes parts of its own. first_group and parts by cell, first_cell by group."""
        self.first_cell, self.first_group = [], np.zeros(len(self.pivots), np.int64)
        self.parts = np.maximum(1, -(-self.homes // rows))
        held = rows
        for c, n in enumerate(self.homes.tolist()):
            if held + n > rows:
                self.first_cell.append(c)
                held = 0
            self.first_group[c] = len(self.first_cell) - 1
            held += n
            if self.parts[c] > 1:
                self.first_cell += [c] * (int(self.parts[c]) - 1)
                held = rows
        self.guests = np.zeros(len(self.first_cell), np.int64)

    def visits(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which cells before its own each vector has to visit; a pair in two cells meets in the earlier one."""
        r = self.r + SLACK
        own = d[np.arange(len(d)), home][:, None]
        gaps = np.sqrt(np.maximum(0, 2 - 2 * self.pivots[home] @ self.pivots.T))
        near_plane = d**2 - own**2 <= 2 * r * np.maximum(gaps, 1e-12)
        return near_plane & (d <= self.far + r) & (d >= self.near - r) & (np.arange(len(self.pivots)) < home[:, None])

    def placed(self, unit: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The group of each vector, and a matrix of the groups that it visits besides."""
        d = self.distances(unit)
        home = d.argmin(axis=1)
        part = draw % self.parts[home]
        group = self.first_group[home] + part
        new = np.diff(self.first_cell, prepend=-1) > 0  # parts of one cell are visited together
        visits = np.logical_or.reduceat(self.visits(d, home), np.asarray(self.first_cell)[new], axis=1)[:, np.cumsum(new) - 1]
        numbers = np.arange(len(self.first_cell))
        visits &= numbers < group[:, None]
        visits |= (numbers >= self.first_group[home][:, None]) & (numbers < group[:, None])  # earlier parts of its own cell
        return group, visits


def _links(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links within one block: rid, the links found (by multiplicity), and the smallest rid of its group here."""
    block = block.sort_values("guest", kind="stable")
    unit, rid, n = _matrix(block.vector.tolist()), block.rid.to_numpy(), block.n.to_numpy()
    single = unit.astype(np.float32)
    homes = int((~block.guest).sum())
    links, edges = np.zeros(len(rid), np.int64), [np.zeros((0, 2), np.int64)]
    inner = bool(block.inner.any())  # this block compares its homes with each other, too
    for i in range(0, homes, TILE):
        rows = slice(i, min(i + TILE, homes))
        for j in range(i if inner else homes, len(rid), TILE):
            close = single[rows] @ single[j : j + TILE].T >= threshold - 1e-4
            if inner and i == j:
                close &= np.arange(i, rows.stop)[:, None] < np.arange(j, min(j + TILE, len(rid)))  # a pair of homes once
            if not close.any():
                continue
            x, y = np.flatnonzero(close.any(1)) + i, np.flatnonzero(close.any(0)) + j
            sure = close[np.ix_(x - i, y - j)] & (unit[x] @ unit[y].T >= threshold)  # in double precision
            links[x] += sure @ n[y]
            links[y] += sure.T @ n[x]
            low_x, low_y = block_labels(sure, rid[x], rid[y])
            edges += [np.column_stack([rid[x], low_x]), np.column_stack([rid[y], low_y])]
    edge = np.concatenate(edges)
    label = forest_labels(rid, edge[edge[:, 0] != edge[:, 1]])
    some = links > 0
    return pd.DataFrame({"rid": rid[some], "links": links[some], "label": label[some]})


def _joined(packed: DataFrame, threshold: float, dim: int, count: int) -> DataFrame:
    """(rid, links, label) of every block, for vectors of one length."""
    spark, rows = packed.sparkSession, block_rows(dim)
    n_pivots = max(1, min(MOST_PIVOTS, -(-count // PER_PIVOT)))
    low = F.pmod(F.xxhash64("vector"), F.lit(1 << 20)) < F.lit(int(1.3 * SAMPLED * n_pivots / count * (1 << 20)) + 64)  # few go on to the sort
    sample = packed.where(low).orderBy(F.xxhash64("vector"), "rid").limit(SAMPLED * n_pivots).select("vector").toArrow().column(0).to_pylist()
    cells = Cells(choose_pivots(_matrix(sample), n_pivots), threshold, -(-count // rows))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                yield part, _matrix(part.column(2).to_pylist())

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, unit in batches_of(batches):
            d = cells.distances(unit)
            home = d.argmin(axis=1)
            found = pd.DataFrame({"cell": home, "own": d[np.arange(len(d)), home]}).groupby("cell").own.agg(["size", "min", "max"])
            yield pa.RecordBatch.from_pydict({"cell": pa.array(found.index.to_numpy(np.int64)), "n": pa.array(found["size"].to_numpy(np.int64)), "near": pa.array(found["min"].to_numpy()), "far": pa.array(found["max"].to_numpy())})

    for c, n, near, far in packed.mapInArrow(sizes, "cell long, n long, near double, far double").groupBy("cell").agg(F.sum("n"), F.min("near"), F.max("far")).collect():  # a row a pivot
        cells.homes[c], cells.near[c], cells.far[c] = n, near, far
    cells.form_groups(rows)

    def drawn(b: pa.RecordBatch) -> np.ndarray:
        return (b.column(0).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)

    def guests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells.first_cell), np.int64)
        for b, unit in batches_of(batches):
            total += cells.placed(unit, drawn(b))[1].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"group": pa.array(np.arange(len(total))), "n": pa.array(total)})

    for g, n in packed.mapInArrow(guests, "group long, n long").groupBy("group").agg(F.sum("n")).collect():  # a row a group
        cells.guests[g] = n
    known = spark.sparkContext.broadcast(cells)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its group, once for every part of the group's guests, and to one part of the guests of each group that it visits."""
        cells = known.value
        guest_parts = np.maximum(1, -(-cells.guests // rows))
        for b, unit in batches_of(batches):
            draw = drawn(b)
            group, visits = cells.placed(unit, draw)
            copies = guest_parts[group]
            at_home = np.repeat(np.arange(len(group)), copies)
            part = np.arange(len(at_home)) - np.repeat(np.cumsum(copies) - copies, copies)
            guest, visited = np.nonzero(visits)
            take = pa.array(np.concatenate([at_home, guest]))
            moved = b.take(take)
            yield pa.RecordBatch.from_pydict({
                "group": pa.array(np.concatenate([group[at_home], visited])), "part": pa.array(np.concatenate([part, draw[guest] // 7 % guest_parts[visited]])),
                "guest": pa.array(np.arange(len(take)) >= len(at_home)), "inner": pa.array(np.concatenate([part == 0, np.zeros(len(guest), bool)])),
                "rid": moved.column(0), "n": moved.column(1), "vector": moved.column(2),
            })

    blocks = packed.mapInArrow(spread, "group long, part long, guest boolean, inner boolean, rid long, n long, vector binary")
    return blocks.groupBy("group", "part").applyInPandas(lambda x: _links(x, threshold), "rid long, links long, label long")


def _classes(distinct: DataFrame, threshold: float) -> DataFrame:
    """(c1, c2, n_links, component_id) of each distinct vector."""
    distinct = materialize(distinct, "embeddings")
    found = None
    lengths = distinct.groupBy("dim").count().where("count > 1").orderBy("dim").toLocalIterator()
    few = []
    for dim, count in lengths:
        if count <= block_rows(dim):
            few.append(dim)
            continue
        packed = materialize(_packed(distinct.where(F.col("dim") == dim).select("rid", "n", "vector")), "packed")
        part = _joined(packed, threshold, dim, count)
        found = part if found is None else found.unionByName(part)
    if few:  # lengths that fit one block each, all of them in one job
        whole = _packed(distinct.where(F.col("dim").isin(few)).select("rid", "n", "vector")).withColumn("guest", F.lit(False)).withColumn("inner", F.lit(True))
        part = whole.groupBy(F.octet_length("vector").alias("bytes")).applyInPandas(lambda x: _links(x, threshold), "rid long, links long, label long")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = distinct.sparkSession.createDataFrame([], "rid long, links long, label long")
    found = materialize(found, "links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("label <> rid").select(F.col("rid").alias("src"), F.col("label").alias("dst")))
    known = distinct.select("rid", "n", "first_id", "k1", "k2").join(links, "rid", "left").join(component.withColumnRenamed("node", "rid"), "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    firsts = known.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return known.join(firsts, "component").select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    doubles = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), doubles.alias("vector"))
    keys = [F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("termloom"), "vector").alias("k2")]
    fine = rows.where(_usable("vector"))
    distinct = fine.groupBy("vector").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id"))
    with dropped_after(vectors.sparkSession):
        classes = materialize(_classes(distinct.select(F.monotonically_increasing_id().alias("rid"), "n", "first_id", "vector", *keys, F.size("vector").alias("dim")), threshold), "classes", outlives_scope=True)
    keyed = rows.select("vec_id", *[F.when(_usable("vector"), k).alias(n) for k, n in zip(keys, ("k1", "k2"), strict=True)])
    joined = keyed.join(classes, (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component_id = F.when(F.col("c1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component_id.alias("component_id"),
        F.coalesce(F.col("vec_id") == component_id, F.lit(False)).alias("kept"),
    )
