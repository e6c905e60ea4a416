"""Vector search against brute force, recall of the index, half precision, interest vectors and experiment arms."""

import datetime
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import vector_index as X
from termloom.operators import vectors as V


def clustered(n, dims=16, clusters=12, seed=1, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    rows = [(i, (centres[i % clusters] + spread * rng.normal(size=dims)).tolist()) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(20)]  # copies
    return rows + [(9001, None), (9002, [0.0] * dims), (9003, [float("nan")] * dims), (9004, [])]


def brute(rows, queries, k):
    usable = [(i, np.array(v) / np.linalg.norm(v)) for i, v in rows if v and any(v) and all(map(math.isfinite, v))]
    out = set()
    for q, v in usable:
        if q in queries:
            near = sorted((-round(float(v @ w), 9), i) for i, w in usable if i != q)[:k]
            out |= {(q, i, place + 1) for place, (_, i) in enumerate(near)}
    return out


def frames(spark, rows):
    e = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return e, e.where("vec_id % 29 = 0 OR vec_id >= 9000").select(F.col("vec_id").alias("query_id"), "embedding")


def places(df):
    return {(r.query_id, r.vec_id, r.place) for r in df.collect()}


@pytest.mark.parametrize("block", [8192, 60])
def test_exact_searches(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    monkeypatch.setattr(X, "PART_ROWS", block)
    rows = clustered(600)
    e, q = frames(spark, rows)
    expected = brute(rows, {i for i, _ in rows if i % 29 == 0 or i >= 9000}, 5)
    assert places(V.top_k(q, e, 5)) == expected
    for cells, probes in ((12, 1), (40, 3), (1, 1)):
        index = X.build(e, cells=cells, precision="full")
        assert (block == 60) == (index.parts.max() > 1) or cells == 40
        assert places(X.search(index, q, 5, probes, exact=True)) == expected
    with pytest.raises(ValueError):
        X.search(X.build(e), q, 5, exact=True)


def test_blocks_meet_when_partitions_are_not_coalesced(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    rows = clustered(600)
    e, q = frames(spark, rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = places(V.top_k(q, e, 5))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute(rows, {i for i, _ in rows if i % 29 == 0 or i >= 9000}, 5)


def test_recall_and_half_precision(spark):
    rows = clustered(4000, dims=32, clusters=25, seed=2)
    e, q = frames(spark, rows)
    others = e.where("vec_id % 29 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
    index = X.build(e)
    assert index.rows(spark).count() == 4020 and index.rows(spark).agg(F.max(F.octet_length("packed"))).first()[0] == 64  # every row, 2 bytes a number
    probes = X.probes_for(index, others, V.top_k(others, e, 10), 0.98)
    assert probes < len(index.centres) / 3
    wanted = V.top_k(q, e, 10)
    assert X.recall(X.search(index, q, 10, probes), wanted).first().recall >= 0.95
    assert X.recall(X.search(index, q, 10, len(index.centres)), wanted).first().recall >= 0.995  # what half precision costs


def test_recall_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 60)
    e, q = frames(spark, clustered(600))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        truth = V.top_k(q, e, 10)
        others = e.where("vec_id % 29 = 7").select(F.col("vec_id").alias("query_id"), "embedding")
        index = X.build(e)
        found = X.recall(X.search(index, q, 10, X.probes_for(index, others, V.top_k(others, e, 10), 0.99)), truth).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.n == 10 * q.where("query_id < 9000").count()  # all but those without a usable vector
    assert found.recall >= 0.95


def test_an_index_does_not_depend_on_the_order_of_rows(spark):
    e, q = frames(spark, clustered(300))
    other = e.repartition(5).sortWithinPartitions(F.desc("vec_id"))
    one, two = X.build(e, cells=9), X.build(other, cells=9)
    assert (one.centres == two.centres).all()
    cells = [{(r.vec_id, r.cell) for r in i.rows(spark).collect()} for i in (one, two)]
    assert cells[0] == cells[1]


def test_without_other_queries_all_cells_are_searched(spark):
    e, q = frames(spark, clustered(300))
    none = q.where("query_id < 0")
    index = X.build(e, cells=9)
    assert X.probes_for(index, none, V.top_k(none, e, 10), 0.99) == 9


def test_an_index_of_nothing(spark):
    e, q = frames(spark, [(9001, None), (9002, [0.0])])
    index = X.build(e, precision="full")
    assert X.search(index, q, 3, exact=True).count() == 0 and V.top_k(q, e, 3).count() == 0


def test_few_cells_are_read(spark):
    rows = clustered(2000, clusters=8)
    e, _ = frames(spark, rows)
    index = X.build(e, cells=16, precision="full")
    one = e.where("vec_id = 5").select(F.col("vec_id").alias("query_id"), "embedding")
    plan = X.search(index, one, 3, probes=2)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(cell" in plan or "cell" in plan.split("PushedFilters")[1][:200]


def test_interest_vectors(spark):
    at = lambda days: datetime.datetime(2024, 1, 31) - datetime.timedelta(days=days)
    events = spark.createDataFrame([(1, 10, "view", at(7)), (1, 11, "buy", at(0)), (1, 12, "view", at(1)), (1, 10, "noise", at(1)), (1, 11, "view", at(31)), (2, 99, "view", at(1)), (3, 10, "view", at(2)), (3, 13, "view", at(2))], "account long, item long, event_type string, ts timestamp_ntz")
    items = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 2.0]), (12, None), (13, [-1.0, 0.0])], "item long, vector array<double>")
    got = {r.account: r for r in V.interest_vectors(events, items, {"view": 1.0, "buy": 4.0}, "2024-01-31 00:00:00").collect()}
    assert set(got) == {1, 3} and got[1].event_count == 2 and got[1].last_event_at == at(0)
    assert np.allclose(got[1].vector, np.array([0.5, 8.0]) / math.hypot(0.5, 8.0))
    assert got[3].vector == [0.0, 0.0]  # what cancels out has no direction


@pytest.mark.parametrize("piece", [64, 3])
def test_components_are_summed_side_by_side(spark, monkeypatch, piece):
    monkeypatch.setattr(V, "PIECE", piece)
    now = datetime.datetime(2024, 1, 31)
    items = [(i, np.random.default_rng(i).normal(size=8).tolist()) for i in range(4)]
    events = spark.createDataFrame([(a, i, "view", now) for a in range(5) for i in range(4) for _ in range(a * i + 1)], "account long, item long, event_type string, ts timestamp_ntz")
    df = V.interest_vectors(events, spark.createDataFrame(items, "item long, vector array<double>"), {"view": 1.0}, "2024-01-31 00:00:00")
    for r in df.collect():
        whole = sum((r.account * i + 1) * np.array(v) for i, v in items)
        assert np.allclose(r.vector, whole / np.linalg.norm(whole)) and r.event_count == sum(r.account * i + 1 for i in range(4))
    assert "posexplode" not in df._jdf.queryExecution().optimizedPlan().toString()  # else sums are kept for each account and component


def test_experiment_arms(spark):
    arms = spark.createDataFrame([("x", "a", 1), ("x", "b", 3), ("y", "only", 5)], "experiment string, variant string, share long")
    people = spark.range(4000).select(F.col("id").alias("account"))
    first = V.assign(people, arms)
    assert first.count() == 8000 and first.where("experiment = 'x'").groupBy("variant").count().count() == 2
    share = first.where("variant = 'a'").count() / 4000
    assert 0.22 < share < 0.28
    later = V.assign(people, spark.createDataFrame([("x", "c", 1)], "experiment string, variant string, share long"), first.where("account < 100"))
    assert later.where("variant = 'c'").count() == 3900 and later.where("account < 100 AND variant = 'c'").count() == 0
