"""Connected components of a link graph, by minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialize


def block_labels(close: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row (and column) reaches over the links of a block, a matrix of booleans; ids_b is None for a block against itself."""
    big = np.iinfo(np.int64).max
    a, b = ids_a.copy(), (ids_a if ids_b is None else ids_b).copy()
    while True:
        low_a = np.minimum(a, np.where(close, b[None, :], big).min(axis=1, initial=big))
        low_b = np.minimum(b, np.where(close, low_a[:, None], big).min(axis=0, initial=big))
        if ids_b is None:
            low_a = low_b = np.minimum(low_a, low_b)
        if (low_a == a).all() and (low_b == b).all():
            return a, b
        a, b = low_a, low_b


def forest_labels(ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The smallest id that each of ids reaches over edges, pairs of ids; halving of paths keeps the rounds few."""
    order = np.argsort(ids, kind="stable")
    label = np.arange(len(ids))  # places in the sorted order, so that the smallest label is the smallest id
    at = np.searchsorted(ids[order], edges)
    while len(at):
        low = np.minimum(label[at[:, 0]], label[at[:, 1]])
        new = label.copy()
        for side in (0, 1):
            np.minimum.at(new, at[:, side], low)
            np.minimum.at(new, label[at[:, side]], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    out = np.empty(len(ids), np.int64)
    out[order] = ids[order][label]
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (src long, dst long); component is the smallest node reachable.

    In a round every node moves up to its smallest neighbour, or that one's, and edges are
    drawn between what the nodes have become: those within one vanish, equal ones are one,
    so the graph shrinks until no edge is left. Minima are combined before they are
    shuffled, and a hub is split by adaptive skew joins. Every round is written to the
    shared folder, so a lost executor costs at most one round. An edge with
    a null end, or from a node to itself, links nothing and gives no row; repeated edges
    count once; an empty table gives an empty result; other columns are ignored.
    """
    def drawn(between: DataFrame) -> DataFrame:
        low, high = F.least("src", "dst"), F.greatest("src", "dst")
        return materialize(between.where("src <> dst").select(low.alias("src"), high.alias("dst")).distinct(), "cc-edges")  # no nulls: they compare as null

    edges, labels = drawn(edges.select("src", "dst")), None
    while True:
        ends = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = materialize(ends.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("d")).select("node", F.least("node", "d").alias("up")), "cc-up")
        higher = up.select(F.col("node").alias("up"), F.col("up").alias("higher"))
        top = materialize(up.join(higher, "up").select("node", F.col("higher").alias("top")), "cc-top")
        if labels is None:
            step = top.select("node", F.col("top").alias("component"))
        else:
            step = labels.join(top.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
        step = materialize(step, "cc-labels")
        moved = edges.join(top.select(F.col("node").alias("src"), F.col("top").alias("a")), "src").join(top.select(F.col("node").alias("dst"), F.col("top").alias("b")), "dst")
        left = drawn(moved.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        for table in (edges, up, top, *([] if labels is None else [labels])):
            discard(table)
        edges, labels = left, step
        if not edges.limit(1).count():
            discard(edges)
            return labels
