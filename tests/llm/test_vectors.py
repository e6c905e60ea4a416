"""The metric range join against brute force."""

from collections import Counter

import numpy as np
import pytest

from termloom.llm import metric_join


def brute(rows, threshold=0.95):
    def usable(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, float) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            low = min([label[i], *(label[j] for j in links[i])])
            for j in (i, *links[i]):
                label[j] = min(label[j], low)
    first = {}
    for i, (name, _) in enumerate(rows):
        if name is not None:
            first[label[i]] = min(first.get(label[i], name), name)
    return [(name, len(links[i]), first.get(label[i]), name is not None and first.get(label[i]) == name) for i, (name, _) in enumerate(rows)]


def vectors():
    rng = np.random.default_rng(5)
    rows, centres = [], rng.normal(size=(6, 8))
    for i in range(160):
        c = centres[i % 6] if i % 3 else rng.normal(size=8)
        rows.append((i, (c + rng.normal(size=8) * 0.12).tolist()))
    rows += [(200 + i, rows[1][1]) for i in range(9)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [None] + [1.0] * 7), (304, [float("nan")] + [1.0] * 7), (305, [float("inf")] + [1.0] * 7), (None, rows[1][1]), (None, rng.normal(size=8).tolist()), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (5, rows[5][1])]
    return rows


@pytest.mark.parametrize("rows, per_pivot", [(4096, 64), (16, 8), (16, 1000), (40, 2)])
def test_range_join(spark, monkeypatch, rows, per_pivot):
    monkeypatch.setattr(metric_join, "block_rows", lambda dim: rows)
    monkeypatch.setattr(metric_join, "PER_PIVOT", per_pivot)
    given = vectors()
    df = spark.createDataFrame([(i, v, "clash", 1) for i, v in given], "vec_id long, embedding array<double>, rid string, n int").repartition(4)
    got = [tuple(r) for r in metric_join.near_duplicates(df).collect()]
    assert Counter(map(repr, got)) == Counter(map(repr, brute(given)))


def copies(n, clusters, rows=256):
    """How often a vector is sent around, on clustered vectors or (0 clusters) ones without structure."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    if clusters:
        x = rng.normal(size=(clusters, 64))[rng.integers(0, clusters, n)] + 0.15 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    n_pivots = -(-n // metric_join.PER_PIVOT)
    cells = metric_join.Cells(metric_join.choose_pivots(x[: metric_join.SAMPLED * n_pivots], n_pivots), 0.95, -(-n // rows))
    d = cells.distances(x)
    home = d.argmin(axis=1)
    own = d[np.arange(n), home]
    cells.homes = np.bincount(home, minlength=n_pivots)
    for c in range(n_pivots):
        if cells.homes[c]:
            cells.near[c], cells.far[c] = own[home == c].min(), own[home == c].max()
    cells.form_groups(rows)
    return 1 + np.mean([v for k in range(0, n, 512) for v in cells.placed(x[k : k + 512], np.arange(k, min(k + 512, n)))[1].sum(axis=1)])


def test_pruning_of_clustered_vectors():
    small, large = copies(10_000, 150), copies(50_000, 750)
    assert small < 1.3 and large < 1.1 * small, (small, large)  # flat: a vector stays in its group, whatever their number
    assert copies(4000, 0) > 5  # without structure nothing can be pruned


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert metric_join.near_duplicates(df).count() == 0


def test_forest_labels():
    rng = np.random.default_rng(3)
    ids = rng.permutation(400)[:300] * 7
    edges = np.array([(ids[i], ids[i + 1]) for i in range(0, 99)] + [(ids[100 + int(x)], ids[100 + int(y)]) for x, y in rng.integers(0, 150, (80, 2))])
    from termloom.llm.components import forest_labels

    expected = dict(zip(ids.tolist(), ids.tolist(), strict=True))
    for _ in ids:
        for a, b in edges.tolist():
            expected[a] = expected[b] = min(expected[a], expected[b])
    assert forest_labels(ids, edges).tolist() == [expected[i] for i in ids.tolist()]
    assert forest_labels(ids, edges[:0]).tolist() == ids.tolist()


def test_components(spark):
    from termloom.llm.components import connected_components

    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, None), (None, None), (1, 2), (2, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
