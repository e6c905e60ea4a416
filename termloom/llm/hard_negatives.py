"""Hard-negative mining (operator 12) with a vector-approximation file.

Vectors become whole numbers. Every dimension is quantised into cells, and a row is written
as one code a dimension beside its numbers. For an anchor a small table holds the least and
the most that each cell of each dimension can add to a score, so that looking up a row's
codes and adding gives a lower and an upper bound of its score. Only rows whose bounds let
them enter an anchor's first places or one of its score windows are scored exactly.

Anchors and rows are dealt into blocks of bounded size, and every block of anchors meets
every block of rows once for the positives and once for the negatives; a block hands on at
most the asked-for number of rows of an anchor or window, and a window function merges
these. Rows of a block are ordered by label, so the positives of an anchor look at one
stretch of it, whatever share of the table a label has. Vectors are never all in one task,
and nothing but the edges of the cells (bounded by the dimensions) goes through the driver.

Defined results for odd input: rows with a null label, or a vector that is null, empty or
holds null or non-finite components, take no part; nor do vectors whose length isn't that
of most rows (of equally many the longer), or whose scores could leave 64 bits. Rows are
told apart by themselves, not by id: repeated rows are other rows, with the same id; a null
id comes last among ties and is never that of an anchor unless the caller's condition says so. Ties
go by the smaller id. An empty table, or one without anchors, gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize

#: Cells of a dimension, and rows (at least so many wanted) that choose their edges; a sample changes the speed only.
CELLS, SAMPLED = 64, 16_384
#: Rows and anchors of a block.
BLOCK, LEAST_BLOCK = 16_384, 1_024
LAST = (1 << 63) - 1


def _quantised(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float, anchor: Column) -> DataFrame:
    """row_id, order (the id, LAST if null), label, anchor and numbers (floor(scale * x)) of the rows that take part."""
    wide = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    fits = F.aggregate(F.col(vector_col), F.lit(0.0), lambda s, x: s + F.pow(F.abs(x.cast("double") * F.lit(float(scale))) + 1, F.lit(2.0))) < F.lit(float(1 << 62))
    usable = F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0)
    used = rows.where(usable).where(fine).where(fits)
    return used.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("order"), F.col(label_col).cast("string").alias("label"),
        F.coalesce(anchor, F.lit(False)).alias("anchor"), wide.alias("numbers"),
    ).withColumn("row_id", F.monotonically_increasing_id())


class Cells:
    """The edges of all dimensions' cells, and what follows from them."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray, cells: int) -> None:
        inner = np.quantile(sample, np.arange(1, cells) / cells, axis=0, method="lower").astype(np.int64).T if len(sample) else np.zeros((len(low), 0), np.int64)
        self.inner = np.clip(inner, low[:, None], high[:, None] + 1)  # a cell begins at its edge
        self.least = np.concatenate([low[:, None], self.inner], axis=1)
        self.most = np.concatenate([self.inner - 1, high[:, None]], axis=1)
        self.reach = np.maximum(np.abs(low), np.abs(high)).astype(np.float64)

    def codes(self, numbers: np.ndarray) -> np.ndarray:
        """The cell of each component, a byte each."""
        return np.stack([np.searchsorted(edges, column, side="right") for edges, column in zip(self.inner, numbers.T, strict=True)], axis=1).astype(np.uint8)

    def table(self, anchor: np.ndarray) -> tuple[np.ndarray, float]:
        """What each cell of each dimension adds to the lower (real) and upper (imaginary) bound of a score, and how far sums of these may be off."""
        a = anchor[:, None]
        one, other = a * self.least, a * self.most
        largest = float((np.abs(anchor) * self.reach).sum())
        exact = largest < 1 << 24
        out = np.empty(one.shape, np.complex64 if exact else np.complex128)
        out.real, out.imag = np.minimum(one, other), np.maximum(one, other)
        return out, 0.0 if largest < 1 << 50 else largest * 1e-12


def _fit_cells(rows: DataFrame, total: int, cells: int) -> Cells:
    """Edges at the quantiles of a sample of about SAMPLED rows, by a hash of the row; the outermost ones from all rows."""

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                m = _matrix(b.column(0))
                low = m.min(axis=0) if low is None else np.minimum(low, m.min(axis=0))
                high = m.max(axis=0) if high is None else np.maximum(high, m.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_pydict({"dim": pa.array(range(len(low)), pa.int32()), "low": pa.array(low), "high": pa.array(high)})

    found = rows.select("numbers").mapInArrow(extremes, "dim int, low long, high long").groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("dim").collect()  # a row a dimension
    sample = rows.where(F.pmod(F.xxhash64("row_id"), F.lit(max(1, total // SAMPLED))) == 0).select("numbers").toArrow()
    matrix = _matrix(sample.column(0).combine_chunks()) if sample.num_rows else np.zeros((0, len(found)), np.int64)
    return Cells(matrix, np.array([r.low for r in found]), np.array([r.high for r in found]), cells)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.int64).reshape(len(column), -1)


def _unpacked(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


class Block:
    """Rows of a block, ordered by label, with their codes by dimension."""

    def __init__(self, rows: pa.Table) -> None:
        label = np.array(rows.column("label").to_pylist(), object)
        at = np.argsort(label, kind="stable")
        self.labels = label[at]
        self.row_id, self.order = (rows.column(c).to_numpy()[at] for c in ("row_id", "order"))
        self.numbers = _unpacked(rows.column("numbers"), np.int64)[at]
        self.codes = np.ascontiguousarray(_unpacked(rows.column("codes"), np.uint8)[at].T).astype(np.intp)

    def bounds(self, table: np.ndarray, slack: float, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        total = table[0].take(self.codes[0, start:end])
        for cells, codes in zip(table[1:], self.codes[1:, start:end], strict=True):
            total += cells.take(codes)
        return total.real - slack, total.imag + slack

    def stretch(self, label: str) -> tuple[int, int]:
        return int(np.searchsorted(self.labels, label, "left")), int(np.searchsorted(self.labels, label, "right"))

    def first(self, found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """Places in found of the k first by score, then id."""
        return np.lexsort((self.row_id[found], self.order[found], -scores))[:k]


def kth_largest(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -np.inf


def block_positives(block: Block, cells: Cells, row_id: int, label: str, numbers: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k first other rows of the block with the anchor's label (their places, their scores)."""
    start, end = block.stretch(label)
    if start == end:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lower, upper = block.bounds(*cells.table(numbers), start, end)
    found = start + np.flatnonzero(upper >= kth_largest(lower, k + 1))  # one more, as the anchor may be among them
    found = found[block.row_id[found] != row_id]
    scores = block.numbers[found] @ numbers
    first = block.first(found, scores, k)
    return found[first], scores[first]


def window_of(score: int, window: tuple[int, int]) -> tuple[int, int]:
    """Scores n with window[0] * score <= 100 * n <= window[1] * score."""
    return -(-window[0] * score // 100), window[1] * score // 100


def block_negatives(block: Block, cells: Cells, label: str, numbers: np.ndarray, windows: dict[int, tuple[int, int]], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each positive score, the k first rows of the block with another label in its window (places, scores)."""
    start, end = block.stretch(label)
    if end - start == len(block.labels):
        return
    lower, upper = block.bounds(*cells.table(numbers), 0, len(block.labels))
    lower[start:end] = upper[start:end] = -np.inf
    for positive, (least, most) in windows.items():
        certain = lower[(lower >= least) & (upper <= most)]
        found = np.flatnonzero((upper >= max(least, kth_largest(certain, k))) & (lower <= most))
        scores = block.numbers[found] @ numbers
        inside = (scores >= least) & (scores <= most)
        found, scores = found[inside], scores[inside]
        first = block.first(found, scores, k)
        yield positive, found[first], scores[first]


def _meet(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_row_blocks: int, work, schema: str) -> DataFrame:
    """work(anchors, rows) for every block of anchors and every block of rows: each side is copied once for each block of the other."""
    own = anchors.select(*[F.col(c).alias(c) for c in anchors.columns])  # told apart from the rows, which come from the same file
    one = own.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_row_blocks - 1))))
    other = rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1))))
    return one.groupBy("ab", "rb").cogroup(other.groupBy("ab", "rb")).applyInArrow(work, schema)


def mine(rows: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), cells: int = CELLS) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are the rows where anchor holds. An anchor's positives are its first other rows
    of its label; for each, the first rows of other labels follow whose score n satisfies
    window[0] * p <= 100 * n <= window[1] * p, p being the positive's score. Scores are inner products of
    floor(scale * x); higher ones come first, then smaller ids. All anchors meet all rows in
    blocks, so the work is their product, a table look-up a dimension each.
    """
    spark = rows.sparkSession
    with dropped_after(spark):
        usable = materialize(_quantised(rows, id_col, vector_col, label_col, scale, anchor), "vector-numbers")
        sizes = usable.groupBy(F.size("numbers").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"))
        most = sizes.agg(F.max(F.struct("n", "dim", "anchors")).alias("x")).first().x
        total, dim, n_anchors = (most.n, most.dim, most.anchors) if most else (0, 0, 0)
        usable = usable.where(F.size("numbers") == dim)
        model = _fit_cells(usable, total, cells)
        shared = spark.sparkContext.broadcast(model)
        per_block = min(BLOCK, max(LEAST_BLOCK, -(-total // (2 * spark.sparkContext.defaultParallelism))))
        n_rows, n_blocks = max(1, -(-total // per_block)), max(1, -(-n_anchors // BLOCK))

        def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                numbers = _matrix(b.column(4)) if b.num_rows else np.zeros((0, dim), np.int64)
                codes = shared.value.codes(numbers) if b.num_rows else numbers
                yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([x.tobytes() for x in numbers], pa.binary()), pa.array([x.tobytes() for x in codes], pa.binary())], ["row_id", "order", "label", "anchor", "numbers", "codes"])

        shape = "row_id long, order long, label string, anchor boolean, numbers binary, codes binary"
        file = materialize(usable.select("row_id", "order", "label", "anchor", "numbers").mapInArrow(approximate, shape), "vector-approximations", outlives_scope=True)
        base = file.withColumn("rb", F.pmod(F.xxhash64("row_id"), F.lit(n_rows)).cast("int")).select("row_id", "order", "label", "numbers", "codes", "rb")
        chosen = file.where("anchor").withColumn("ab", F.pmod(F.xxhash64(F.lit("anchor"), "row_id"), F.lit(n_blocks)).cast("int")).select("row_id", "order", "label", "numbers", "ab")

        def find_positives(anchors: pa.Table, others: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("a_row", "p_row", "p_order", "p_score")}
            if anchors.num_rows and others.num_rows:
                block, numbers = Block(others), _unpacked(anchors.column("numbers"), np.int64)
                for row, label, own in zip(anchors.column("row_id").to_pylist(), anchors.column("label").to_pylist(), numbers, strict=True):
                    at, scores = block_positives(block, shared.value, row, label, own, positives)
                    for c, v in zip(out, ([row] * len(at), block.row_id[at].tolist(), block.order[at].tolist(), scores.tolist()), strict=True):
                        out[c] += v
            return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

        def find_negatives(anchors: pa.Table, others: pa.Table) -> pa.Table:
            out: dict[str, list] = {c: [] for c in ("a_row", "p_score", "n_row", "n_order", "n_score")}
            if anchors.num_rows and others.num_rows:
                block, numbers = Block(others), _unpacked(anchors.column("numbers"), np.int64)
                for row, label, own, scores in zip(*(anchors.column(c).to_pylist() for c in ("row_id", "label")), numbers, anchors.column("scores").to_pylist(), strict=True):
                    windows = {p: w for p in scores if (w := window_of(p, window))[0] <= w[1]}
                    for p, at, n_scores in block_negatives(block, shared.value, label, own, windows, negatives) if windows else ():
                        for c, v in zip(out, ([row] * len(at), [p] * len(at), block.row_id[at].tolist(), block.order[at].tolist(), n_scores.tolist()), strict=True):
                            out[c] += v
            return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

        found = _meet(chosen, base, n_blocks, n_rows, find_positives, "a_row long, p_row long, p_order long, p_score long")
        place = F.row_number().over(W.partitionBy("a_row").orderBy(F.desc("p_score"), "p_order", "p_row"))
        best = materialize(found.withColumn("place", place).where(F.col("place") <= positives), "positives", outlives_scope=True)
        windows = best.groupBy("a_row").agg(F.collect_set("p_score").alias("scores"))
        seeking = chosen.join(windows, chosen["row_id"] == windows["a_row"]).select("row_id", "label", "numbers", "ab", "scores")
        against = _meet(seeking, base, n_blocks, n_rows, find_negatives, "a_row long, p_score long, n_row long, n_order long, n_score long")
        rank = F.row_number().over(W.partitionBy("a_row", "p_score").orderBy(F.desc("n_score"), "n_order", "n_row")).cast("int")
        against = against.withColumn("rank", rank).where(F.col("rank") <= negatives)
        anchor_ids = chosen.select(F.col("row_id").alias("a_row"), F.col("order").alias("a_order"))
        kind = rows.schema[id_col].dataType
        name = lambda c: F.nullif(F.col(c), F.lit(LAST)).cast(kind)
        return best.join(against, ["a_row", "p_score"]).join(anchor_ids, "a_row").select(
            name("a_order").alias("anchor_id"), name("p_order").alias("positive_id"), "rank", name("n_order").alias("negative_id"),
            F.col("p_score").alias("positive_score"), F.col("n_score").alias("negative_score"),
        )
