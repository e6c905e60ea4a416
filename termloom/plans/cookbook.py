"""Operators' queries over the graph: registry, stages, artifacts, what two stores have of each other; and curves at their limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import curves as V
from termloom.functions.keccak import triple_id_of
from termloom.plans.base import query, stamp, table
from termloom.plans.graph import edges, nodes, public, work
from termloom.sources import ledger as L

#: Predicates that every registry begins with.
SEEDS = (
    "created-by", "deposited-in", "endorsed", "follows", "has-tag", "is-about", "member-of", "part-of", "references", "related-to", "similar-to", "staked-on", "subcategory-of", "trusted-in-the-context-of",
)
_SEED_ROWS = ", ".join(f"('{s}')" for s in SEEDS)
#: Predicates of the triples, with labels; one of them isn't public.
_PREDICATES = (("returned", "Returned by", "private"), ("supplied", "Supplied to", "public"))


def predicates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*((s, s.replace("-", " "), "public") for s in SEEDS), *_PREDICATES], "slug string, label string, visibility string")


@query("k5_triples_of_three_terms", """SELECT e.subject, s.label AS subject_label, e.predicate, CASE WHEN e.predicate = 'supplied' THEN 'Supplied to' END AS predicate_label, e.object, o.label AS object_label
FROM edges e LEFT JOIN shown s ON s.id = e.subject LEFT JOIN shown o ON o.id = e.object WHERE e.weight >= 2""")
def k5(spark, d):
    """All three terms are looked up; those that aren't public stay as ids with a null label."""
    label = public(nodes(spark, d)).select("id", "label")
    side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    named = predicates(spark).where("visibility = 'public'").select(F.col("slug").alias("predicate"), F.col("label").alias("predicate_label"))
    rows = edges(spark, d).where("weight >= 2").join(side("subject"), "subject", "left").join(side("object"), "object", "left").join(F.broadcast(named), "predicate", "left")  # a registry
    return rows.select("subject", "subject_label", "predicate", "predicate_label", "object", "object_label")


@query("k7_feed_by_kind", """f AS (SELECT seq, event_type, CASE event_type WHEN 'signup' THEN 'p' || (seq % 200 + 1) WHEN 'view' THEN 's' || (seq % 10 + 1) || ' supplied' WHEN 'click' THEN 'supplied' ELSE 'account' END AS entity FROM ev)
SELECT seq, event_type, entity FROM f WHERE (event_type = 'signup' AND entity IN (SELECT id FROM shown)) OR (event_type = 'view' AND entity IN (SELECT subject || ' ' || predicate FROM edges)) OR event_type = 'click' OR event_type IN ('purchase', 'error')""")
def k7(spark, d):
    """Four kinds of entity: atoms by their visibility, triples by being there, predicates by the registry, accounts always."""
    kind, n = F.col("event_type"), F.col("seq")
    entity = F.when(kind == "signup", F.concat(F.lit("p"), n % 200 + 1)).when(kind == "view", F.concat(F.lit("s"), n % 10 + 1, F.lit(" supplied"))).when(kind == "click", "supplied").otherwise("account")
    feed = L.event_store(spark, d).select("seq", "event_type", entity.alias("entity"))
    seen = {
        "signup": public(nodes(spark, d)).select(F.col("id").alias("entity")), "view": edges(spark, d).select(F.concat_ws(" ", "subject", "predicate").alias("entity")).distinct(),
        "click": predicates(spark).where("visibility = 'public'").select(F.col("slug").alias("entity")),
    }
    shown = [feed.where(kind == k).join(rows, "entity", "left_semi") for k, rows in seen.items()]
    return reduce(DataFrame.unionByName, shown, feed.where(kind.isin("purchase", "error"))).select("seq", "event_type", "entity")


@query("k8_registry", f"SELECT slug, coalesce(e.n, 0) AS triples FROM (SELECT * FROM (VALUES {_SEED_ROWS}) t(slug) UNION ALL SELECT DISTINCT predicate FROM edges) LEFT JOIN (SELECT predicate, count(*) AS n FROM edges GROUP BY 1) e ON e.predicate = slug ORDER BY slug")
def k8(spark, d):
    """Seeds and what came since, by name, with their triples (cookbook 5 and 31)."""
    used = edges(spark, d).groupBy(F.col("predicate").alias("slug")).agg(F.count(F.lit(1)).alias("triples"))
    return predicates(spark).select("slug").join(used, "slug", "left").fillna(0, ["triples"]).orderBy("slug")


@query("k9_stage_funnel", "SELECT stage, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, count(*) AS n FROM work GROUP BY stage")
def k9(spark, d):
    """The stages folded: a row each, a column a status."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return work(spark, d).groupBy("stage").agg(*map(of, ("pending", "completed", "failed", "skipped")), F.count(F.lit(1)).alias("n"))


_WANTED = "SELECT 's' || l_suppkey AS subject, 'shipped' AS predicate, 'p' || l_partkey AS object FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT subject, predicate, object FROM edges WHERE weight >= 2"


@query("k17_ensure_triples", f"SELECT subject, predicate, object, predicate = 'shipped' AS created FROM (SELECT DISTINCT * FROM ({_WANTED}))")
def k17(spark, d):
    """Triples that are wanted, each once, and whether they are new."""
    have = edges(spark, d).select("subject", "predicate", "object")
    shipped = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.lit("shipped").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object"))
    wanted = shipped.unionByName(edges(spark, d).where("weight >= 2").select("subject", "predicate", "object")).distinct()
    known = have.withColumn("known", F.lit(True))
    return wanted.join(known, ["subject", "predicate", "object"], "left").select("subject", "predicate", "object", F.col("known").isNull().alias("created"))


@query("k17_ensure_accounts", "SELECT account, account NOT IN (SELECT c_custkey FROM customer) AS created FROM (SELECT DISTINCT account FROM ev)")
def k17_accounts(spark, d):
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("account"), F.lit(True).alias("known"))
    return L.event_store(spark, d).select("account").distinct().join(known, "account", "left").select("account", F.col("known").isNull().alias("created"))


@query("k15_known_answer", "SELECT page_id, '0x57946a02776dbd4eec339ecf5cdf6e0005b8de381fb3d9a2bf303da083bf5166' AS triple_id FROM pages")
def k15(spark, d):
    """The published example of a triple's id."""
    parts = ("0x05bb6d28ed5ca3c5206f33f5818da27b3b0bbf6401cd40f082e8db7fcf481787", "0xdb3dc8c92d6141c4e0c9b453b00fc1f237624ef8373b6ae9972d09557d8aaa8d", "0x39afce29ac0e4be2400fa0421b537f63ad2d78d7f8b4be4ff839a162ff3e5ffc")
    # the page's number, taken off again, keeps the rows from being one constant
    given = table(spark, d, "pages").select("page_id", *[F.regexp_replace(F.concat(F.lit(p), F.lit("#"), F.col("page_id")), "#.*$", "").alias(c) for c, p in zip("spo", parts, strict=True)])
    return given.select("page_id", triple_id_of(F.col("s"), F.col("p"), F.col("o")).alias("triple_id"))


# --- cookbook ---------------------------------------------------------------


@query("k21_oldest_pending", "SELECT id, stage, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM work WHERE status = 'pending' ORDER BY work.ts, id LIMIT 25")
def k21_9(spark, d):
    return work(spark, d).where("status = 'pending'").orderBy("ts", "id").limit(25).select("id", "stage", stamp("ts"))


_LEASES = "SELECT id, stage, ts + attempts * INTERVAL 1 HOUR AS until FROM work WHERE status = 'skipped'"


@query("k21_leases", f"SELECT stage, until >= TIMESTAMP '2024-01-15' AS active, count(*) AS n, strftime(min(until), '%Y-%m-%d %H:%M:%S') AS next FROM ({_LEASES}) GROUP BY ALL")
def k21_10(spark, d):
    """Leases that hold and that have run out."""
    leases = work(spark, d).where("status = 'skipped'").select("stage", (F.col("ts") + F.make_interval(hours=F.col("attempts").cast("int"))).alias("next"))
    active = F.col("next") >= F.expr("TIMESTAMP_NTZ'2024-01-15'")
    return leases.groupBy("stage", active.alias("active")).agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("next")).withColumn("next", stamp("next"))


#: Artifacts of pages: a kind, a version, a status, an error.
_ARTIFACTS = "SELECT page_id, 'p' || (page_id % 100 + 1) AS node_id, CASE page_id % 3 WHEN 0 THEN 'opengraph' WHEN 1 THEN 'favicon' ELSE 'microdata' END AS kind, 'v' || (page_id % 2 + 1) AS version, CASE WHEN page_id % 5 = 0 THEN 'failed' ELSE 'ready' END AS status, CASE WHEN page_id % 5 = 0 THEN CASE WHEN page_id % 2 = 0 THEN 'TIMEOUT' ELSE 'TOO_LARGE' END END AS code FROM pages"


def _artifacts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_id")
    kind = F.when(n % 3 == 0, "opengraph").when(n % 3 == 1, "favicon").otherwise("microdata")
    error = F.when(n % 5 == 0, F.concat(F.lit('{"code": "'), F.when(n % 2 == 0, "TIMEOUT").otherwise("TOO_LARGE"), F.lit('"}')))
    return table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), n % 100 + 1).alias("node_id"), kind.alias("kind"), F.concat(F.lit("v"), n % 2 + 1).alias("version"), F.when(n % 5 == 0, "failed").otherwise("ready").alias("status"), error.alias("error"))


@query("k21_artifact_status", f"SELECT kind, version, status, count(*) AS n FROM ({_ARTIFACTS}) GROUP BY ALL ORDER BY kind, version, status")
def k21_14(spark, d):
    return _artifacts(spark, d).groupBy("kind", "version", "status").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "version", "status")


@query("k21_recent_artifacts", f"SELECT a.page_id, a.kind, n.label FROM ({_ARTIFACTS}) a JOIN nodes n ON n.id = a.node_id ORDER BY a.page_id DESC LIMIT 25")
def k21_15(spark, d):
    label = nodes(spark, d).select(F.col("id").alias("node_id"), "label")
    return _artifacts(spark, d).join(label, "node_id").orderBy(F.desc("page_id")).limit(25).select("page_id", "kind", "label")


@query("k21_failed_artifacts", f"SELECT page_id, kind, code FROM ({_ARTIFACTS}) WHERE status = 'failed' ORDER BY page_id DESC LIMIT 25")
def k21_16(spark, d):
    failed = _artifacts(spark, d).where("status = 'failed'").orderBy(F.desc("page_id")).limit(25)
    return failed.select("page_id", "kind", F.get_json_object("error", "$.code").alias("code"))


@query("k21_terms_and_nodes", "SELECT CASE WHEN n.id IS NULL THEN 'only_terms' WHEN t.id IS NULL THEN 'only_nodes' ELSE 'both' END AS place, count(*) AS n FROM (SELECT DISTINCT 'p' || (seq % 1000 + 1) AS id FROM atom) t FULL JOIN (SELECT id FROM nodes WHERE id LIKE 'p%') n USING (id) GROUP BY 1")
def k21_25(spark, d):
    """What the market store and the graph have of each other's atoms (25, 26)."""
    terms = L.atoms_created(L.event_store(spark, d)).select(F.concat(F.lit("p"), F.col("seq") % 1000 + 1).alias("id")).distinct().withColumn("term", F.lit(True))
    graph = nodes(spark, d).where("id LIKE 'p%'").select("id", F.lit(True).alias("node"))
    place = F.when(F.col("node").isNull(), "only_terms").when(F.col("term").isNull(), "only_nodes").otherwise("both")
    return terms.join(graph, "id", "full").groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


@query("k21_triples_of_terms", "SELECT subject, predicate, object, 's' || (seq % 10 + 1) = subject AS matched, CAST(count(*) AS BIGINT) AS n FROM (SELECT seq, 's' || (seq % 10 + 1) AS s FROM triple) t JOIN edges e ON e.subject = t.s WHERE e.weight >= 3 GROUP BY ALL")
def k21_27(spark, d):
    """Indexed triples and what the graph has for their subjects (27, 28)."""
    seen = L.triples_created(L.event_store(spark, d)).groupBy(F.concat(F.lit("s"), F.col("seq") % 10 + 1).alias("subject")).agg(F.count(F.lit(1)).alias("n"))
    return edges(spark, d).where("weight >= 3").join(seen, "subject").select("subject", "predicate", "object", F.lit(True).alias("matched"), "n")


# --- curves at their limits -------------------------------------------------


@query("v18_curve_errors", """r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN x > 30 THEN NULL ELSE CAST((x * 50 + 29) // 30 AS VARCHAR) END AS withdrawn, CASE WHEN x > 30 THEN 'assets_exceed_total' END AS withdraw_error, CASE WHEN x > 50 THEN NULL ELSE CAST(x * 30 // 50 AS VARCHAR) END AS redeemed, CASE WHEN x > 50 THEN 'shares_exceed_total' END AS redeem_error, 'division_by_zero' AS deposit_error FROM r""")
def v18(spark, d):
    """A vault of 30 assets and 50 shares: what is too much is an error in its row; deposits into shares without assets are one everywhere."""
    x, assets, shares = F.col("l_quantity").cast("decimal(38,0)"), F.lit(30), F.lit(50)
    out = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", V.preview(V.Linear(), "withdraw", x, assets, shares).alias("w"), V.preview(V.Linear(), "redeem", x, assets, shares).alias("r"), V.preview(V.Linear(), "deposit", x, F.lit(0), shares).alias("d"))
    return out.select("l_orderkey", "l_linenumber", F.col("w.value").alias("withdrawn"), F.col("w.error").alias("withdraw_error"), F.col("r.value").alias("redeemed"), F.col("r.error").alias("redeem_error"), F.col("d.error").alias("deposit_error"))


@query("v19_fee_total", "SELECT l_orderkey, l_linenumber, CAST((x * 100 + 9999) // 10000 + (x * 50 + 9999) // 10000 + (x * 25 + 9999) // 10000 AS VARCHAR) AS total_fees FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) * 1000 AS x FROM lineitem)")
def v19(spark, d):
    """The checked sum of all parts of an atom deposit's fees."""
    quote = V.quote(V.Linear(), "deposit", F.col("l_quantity").cast("decimal(38,0)") * 1000, F.lit(10**6), F.lit(10**6), V.Fees(protocol=100, entry=50, exit=25, wallet=25), "atom")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", quote["total_fees"].alias("total_fees"))
