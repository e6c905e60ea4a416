"""Bucketed history and marks: what is read shrinks with the keys, replays change nothing, claims survive a retry."""

from pyspark.sql.types import LongType, StructField, StructType

from termloom.sources.history import History, Marks

SCHEMA = StructType([StructField("k", LongType()), StructField("n", LongType())])


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_lookups_read_the_buckets_of_their_keys(spark, tmp_path):
    h = History(spark, str(tmp_path), SCHEMA, ["k"], buckets=32)
    assert h.read().count() == 0
    h.append(frame(spark, [(k, 1) for k in range(1000)]), 0)
    h.append(frame(spark, [(5, 2), (6, 2)]), 1)
    h.append(frame(spark, [(5, 2), (6, 2)]), 1)  # comes again
    assert h.read().count() == 1002
    one = h.lookup(frame(spark, [(5, 0)]))
    assert sorted(map(tuple, one.collect())) == [(5, 1), (5, 2)]
    assert len(one.inputFiles()) == 2 and len(h.read().inputFiles()) >= 32
    few, many = (len(h.lookup(frame(spark, [(k, 0) for k in range(n)])).inputFiles()) for n in (3, 12))
    assert few < many < len(h.read().inputFiles())


def test_claims(spark, tmp_path):
    m = Marks(spark, str(tmp_path), StructType.fromDDL("k long"))
    keys = lambda df: sorted(r.k for r in df.collect())
    assert keys(m.claim("empty")) == []
    m.done("empty")
    m.mark(frame(spark, [(1, 0), (2, 0), (2, 0)]), 0)
    m.mark(frame(spark, [(3, 0)]), 1)
    assert keys(m.claim("a")) == [1, 2, 3]
    m.mark(frame(spark, [(4, 0), (1, 0)]), 2)
    assert keys(m.claim("a")) == [1, 2, 3]  # runs again after a failure
    assert keys(m.claim("b")) == [1, 4]  # marked meanwhile
    m.done("a")
    m.done("b")
    assert keys(m.claim("c")) == []
