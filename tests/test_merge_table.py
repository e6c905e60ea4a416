"""The keyed merge table: what batches write, replays, compaction, readers between, against a plain fold."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from termloom.sources.merge_table import MergeTable

SCHEMA = StructType([StructField("k", LongType()), StructField("n", LongType()), StructField("name", StringType()), StructField("first", LongType()), StructField("at", LongType())])


def table(spark, root, buckets=16):
    return MergeTable(spark, str(root), SCHEMA, ["k"], {"n": "sum", "name": "latest", "first": "min"}, "at", buckets)


def batch(spark, rows):
    return spark.createDataFrame([(k, n, name, at, at) for k, n, name, at in rows], SCHEMA)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def folded(batches):
    out = {}
    for rows in batches.values():
        for k, n, name, at in rows:
            old = out.get(k, (0, None, at, -1))
            out[k] = (old[0] + n, name if at >= old[3] else old[1], min(old[2], at), max(old[3], at))
    return out


def content(df):
    return {r.k: (r.n, r.name, r.first, r["at"]) for r in df.collect()}


def test_batches_write_their_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    batches = {0: [(k, 1, f"a{k}", 10) for k in range(200)]}
    t.write(batch(spark, batches[0]), 0)
    before = files(tmp_path)
    batches[1] = [(5, 7, "late", 5), (5, 1, "newer", 20), (900, 2, "new", 21)]
    t.write(batch(spark, batches[1]), 1)
    assert len(set(files(tmp_path)) - set(before)) <= 2 and all(files(tmp_path)[f] == at for f, at in before.items())
    assert content(t.read()) == folded(batches)
    t.write(batch(spark, batches[1]), 1)  # comes again
    assert content(t.read()) == folded(batches)
    assert content(t.lookup(spark.createDataFrame([(5,), (77,), (12345,)], "k long"))) == {k: v for k, v in folded(batches).items() if k in (5, 77)}


def test_compaction_touches_the_buckets_that_are_due(spark, tmp_path):
    t = table(spark, tmp_path)
    batches = {0: [(k, 1, "base", 1) for k in range(100)]}
    t.write(batch(spark, batches[0]), 0)
    assert len(t.compact(1)) == 16 and content(t.read()) == folded(batches)
    for i in range(1, 5):
        batches[i] = [(3, i, f"v{i}", i + 1)] + ([(4, 1, "x", 9)] if i == 2 else [])
        t.write(batch(spark, batches[i]), i)
    reader = t.read()
    before = files(tmp_path / "base")
    due = t.compact(3)
    assert len(due) == 1 and len(set(files(tmp_path / "base")) - set(before)) == 1
    assert content(t.read()) == folded(batches) == content(reader)  # a reader from before the compaction still reads
    for i in (0, 1, 4):  # replays after compaction
        t.write(batch(spark, batches[i]), i)
    assert content(t.read()) == folded(batches)
    batches[5] = [(3, 1, "last", 50), (200, 5, "new", 51)]
    t.write(batch(spark, batches[5]), 5)
    t.compact(1)
    t.compact(1)
    assert content(t.read()) == folded(batches) and t.compact(1) == []


def test_pruned_lookup_and_empty_table(spark, tmp_path):
    t = table(spark, tmp_path, 64)
    assert t.read().count() == 0 and t.compact() == []
    t.write(batch(spark, [(k, 1, "a", 1) for k in range(1000)]), 0)
    folders = t.live({r[0] for r in spark.createDataFrame([(1,)], "k long").select(t.bucket()).collect()})
    assert len(folders) == 1 and len(t.live()) == 64
    t.write(t.read().limit(0), 1)
    assert t.read().agg(F.sum("n")).first()[0] == 1000
    with pytest.raises(ValueError):
        MergeTable(spark, str(tmp_path), SCHEMA, ["k"], {"n": "sum"}, "at")
