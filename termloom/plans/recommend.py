"""Queries of recommendations: vector index, interest vectors, experiment arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from termloom.operators import vector_index as X
from termloom.operators import vectors as V
from termloom.plans.base import AS_OF, query, stamp, table
from termloom.sources import ledger as L

_TOP = """q AS (SELECT vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 50 = 0)
SELECT query_id, vec_id, k AS place, round(sim, 5) AS similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS k FROM (
    SELECT query_id, vec_id, round(list_cosine_similarity(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 9) AS sim FROM q JOIN embeddings e ON e.vec_id <> q.query_id))
WHERE k <= 5"""


def _asked(embeddings):
    """The stated query set: every row whose id is divisible by 50."""
    return embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query("n26_exact_top_k", _TOP)
def n26(spark, d):
    """Exact cosine top-k: a stated query set against every row, block by block; each block keeps k a query."""
    e = table(spark, d, "embeddings")
    return V.top_k(_asked(e), e, k=5)


@query("n26_index_top_k", _TOP)
def n26_index(spark, d):
    """The same by the index: two cells a query first, then every cell that the k-th row so far doesn't rule out."""
    e = table(spark, d, "embeddings")
    found = X.search(X.build(e, precision="full"), _asked(e), k=5, probes=2, exact=True)
    return found.withColumn("similarity", F.round("similarity", 5))


@query("n26_index_recall", "SELECT (SELECT count(*) FROM embeddings) AS indexed, (SELECT count(*) FROM embeddings WHERE vec_id % 50 = 0) * 10 AS wanted, TRUE AS recalled")
def n26_recall(spark, d):
    """An index at half precision, searched in as many cells as other queries need, against the exact search: whether it recalls 0.95 of the ten nearest."""
    e = table(spark, d, "embeddings")
    index = X.build(e)
    others = e.where("vec_id % 50 = 25").select(F.col("vec_id").alias("query_id"), "embedding")
    found = X.search(index, _asked(e), k=10, probes=X.probes_for(index, others, V.top_k(others, e, k=10), 0.99))
    rows = index.rows(spark).agg(F.count(F.lit(1)).alias("indexed"))
    return rows.join(X.recall(found, V.top_k(_asked(e), e, k=10))).select("indexed", F.col("n").alias("wanted"), (F.col("recall") >= 0.95).alias("recalled"))


#: What an event of a kind is worth to an account's interests.
_WORTH = {"view": 1.0, "click": 2.0, "signup": 3.0, "purchase": 5.0}


@query("n26_interest_vectors", f"""w AS (
  SELECT user_id AS account, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item, count(*) AS n, max(ts) AS last,
    sum(CASE event_type WHEN 'view' THEN 1.0::DOUBLE WHEN 'click' THEN 2.0 WHEN 'signup' THEN 3.0 ELSE 5.0 END * pow(2.0, -(date_diff('second', ts, TIMESTAMP '{AS_OF}') / 86400.0) / 7.0)) AS weight
  FROM events WHERE event_type <> 'error' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND ts <= TIMESTAMP '{AS_OF}' GROUP BY ALL),
m AS (SELECT w.*, embedding FROM w JOIN embeddings e ON e.vec_id = w.item),
p AS (SELECT account, dim - 1 AS dim, sum(weight * CAST(embedding[dim] AS DOUBLE)) AS x FROM m, (SELECT unnest(range(1, 65)) AS dim) GROUP BY ALL),
f AS (SELECT account, CAST(sum(n) AS BIGINT) AS event_count, strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last_event_at FROM m GROUP BY account)
SELECT p.account, p.dim, round(p.x / sqrt(sum(p.x * p.x) OVER (PARTITION BY p.account)), 5) AS x, event_count, last_event_at FROM p JOIN f USING (account)""")
def n26_interest(spark, d):
    """An account's interests, a row a component: events of 30 days on items with a vector, worth half after a week."""
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("account"), F.get_json_object("props", "$.k").cast("long").alias("item"), "event_type", "ts")
    items = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"))
    found = V.interest_vectors(events, items, _WORTH, AS_OF)
    return found.select("account", "event_count", stamp("last_event_at"), F.posexplode("vector").alias("dim", "x")).select("account", F.col("dim").cast("long").alias("dim"), F.round("x", 5).alias("x"), "event_count", "last_event_at")


@query("n26_experiment_arms", """arm(experiment, variant, since, until) AS (VALUES ('feed', 'control', 0, 5000), ('feed', 'dense', 5000, 8000), ('feed', 'sparse', 8000, 10000), ('rank', 'control', 0, 2500), ('rank', 'fresh', 2500, 10000)),
a AS (SELECT account, min(ts) AS first FROM ev GROUP BY account)
SELECT account, experiment, CASE WHEN experiment = 'feed' AND first < TIMESTAMP '2024-01-01 06:00:00' THEN 'control' ELSE variant END AS variant
FROM a JOIN arm ON CAST('0x' || left(md5(experiment || ':' || account), 8) AS BIGINT) % 10000 >= since AND CAST('0x' || left(md5(experiment || ':' || account), 8) AS BIGINT) % 10000 < until""")
def n26_arms(spark, d):
    """Arms of two experiments; accounts of the first hours were in an earlier run of one, whose arm they keep."""
    arms = spark.createDataFrame([("feed", "control", 50), ("feed", "dense", 30), ("feed", "sparse", 20), ("rank", "control", 1), ("rank", "fresh", 3)], "experiment string, variant string, share long")
    ev = L.event_store(spark, d)
    before = ev.where("ts < TIMESTAMP_NTZ'2024-01-01 06:00:00'").select("account", F.lit("feed").alias("experiment"), F.lit("control").alias("variant"))
    return V.assign(ev, arms, before)
