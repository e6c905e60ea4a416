"""Queries of the knowledge graph (parts and suppliers as atoms, who supplies what as triples) and of bonding curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions import curves as V
from termloom.functions import keccak
from termloom.operators.market import trunc
from termloom.plans import base
from termloom.operators.ranking import exact_quantiles
from termloom.plans.base import query, stamp, table
from termloom.sources import ledger as L

base.CTES |= {
    "nodes": "SELECT 'p' || p_partkey AS id, p_name AS label, p_brand AS class, CASE WHEN p_size % 5 = 0 THEN 'archived' ELSE 'active' END AS status, CASE WHEN p_size % 3 = 0 THEN 'private' ELSE 'public' END AS visibility, p_partkey AS created FROM part UNION ALL SELECT 's' || s_suppkey, s_name, 'supplier', 'active', 'public', s_suppkey FROM supplier",
    "shown": "SELECT * FROM nodes WHERE status = 'active' AND visibility = 'public'",
    "edges": "SELECT 's' || l_suppkey AS subject, CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'supplied' END AS predicate, 'p' || l_partkey AS object, count(*) AS weight FROM lineitem GROUP BY ALL",
    "adj": "SELECT subject AS source, 'out' AS direction, predicate, object AS neighbor, weight FROM edges UNION ALL SELECT object, 'in', predicate, subject, weight FROM edges",
    "work": "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'completed' WHEN 2 THEN 'failed' ELSE 'skipped' END AS status, CASE user_id % 3 WHEN 0 THEN 'parse' WHEN 1 THEN 'classify' ELSE 'enrich' END AS stage, CASE WHEN event_id % 8 = 2 THEN 'MAX_ATTEMPTS_EXCEEDED' ELSE 'TIMEOUT' END AS code, CAST(json_extract_string(props, '$.k') AS BIGINT) % 6 AS attempts, value AS seconds, ts FROM events",
}


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(
        F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_name").alias("label"), F.col("p_brand").alias("class"), F.when(F.col("p_size") % 5 == 0, "archived").otherwise("active").alias("status"),
        F.when(F.col("p_size") % 3 == 0, "private").otherwise("public").alias("visibility"), F.col("p_partkey").alias("created"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.col("s_name").alias("label"), F.lit("supplier").alias("class"), F.lit("active").alias("status"), F.lit("public").alias("visibility"), F.col("s_suppkey").alias("created"))
    return p.unionByName(s)


def public(df: DataFrame) -> DataFrame:
    return df.where((F.col("status") == "active") & (F.col("visibility") == "public"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("s"), "l_suppkey").alias("subject"), F.when(F.col("l_returnflag") == "R", "returned").otherwise("supplied").alias("predicate"), F.concat(F.lit("p"), "l_partkey").alias("object")).agg(F.count(F.lit(1)).alias("weight"))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    """Both directions of every triple, by one explode instead of two scans."""
    both = F.explode(F.array(F.struct(F.col("subject").alias("source"), F.lit("out").alias("direction"), F.col("object").alias("neighbor")), F.struct(F.col("object").alias("source"), F.lit("in").alias("direction"), F.col("subject").alias("neighbor")))).alias("e")
    return edges(spark, d).select(both, "predicate", "weight").select("e.source", "e.direction", "predicate", "e.neighbor", "weight")


def work(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    m = F.col("event_id") % 4
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.when(m == 0, "pending").when(m == 1, "completed").when(m == 2, "failed").otherwise("skipped").alias("status"),
        F.when(F.col("user_id") % 3 == 0, "parse").when(F.col("user_id") % 3 == 1, "classify").otherwise("enrich").alias("stage"),
        F.when(F.col("event_id") % 8 == 2, "MAX_ATTEMPTS_EXCEEDED").otherwise("TIMEOUT").alias("code"), (k % 6).alias("attempts"), F.col("value").alias("seconds"), "ts")


def page(df: DataFrame, order: list, limit: int = 25, offset: int = 0) -> DataFrame:
    """A page in a total order, limit clamped to 1..100."""
    return df.orderBy(*order).offset(max(offset, 0)).limit(min(max(limit, 1), 100))


def search(df: DataFrame, column: str, text: str) -> DataFrame:
    """Case-insensitive substring; percent, underscore and backslash are ordinary characters."""
    return df.where(F.contains(F.lower(column), F.lower(F.lit(text))))


@query("k1_atom_search", "SELECT id, label, class FROM shown WHERE contains(lower(label), lower('Re')) AND class <> 'supplier' ORDER BY created DESC, id DESC LIMIT 25 OFFSET 5")
def k1(spark, d):
    hits = search(public(nodes(spark, d)).where("class <> 'supplier'"), "label", "Re")
    return page(hits, [F.desc("created"), F.desc("id")], 25, 5).select("id", "label", "class")


@query("k1_literal_search", "SELECT id, CASE created % 4 WHEN 0 THEN '100%' WHEN 1 THEN 'A_B' WHEN 2 THEN 'c:\\d' END AS found FROM nodes WHERE created % 4 < 3")
def k1_literal(spark, d):
    """Per cent signs, underscores and backslashes are ordinary characters, in labels and in what is searched for."""
    label = F.when(F.col("created") % 4 == 0, "up 100% now").when(F.col("created") % 4 == 1, "xa_by").when(F.col("created") % 4 == 2, "at C:\\Dir").otherwise("100 axb c:/d")
    named = nodes(spark, d).select("id", label.alias("label"))
    found = [search(named, "label", text).select("id", F.lit(text).alias("found")) for text in ("100%", "A_B", "c:\\d")]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("k2_atom_degree", "SELECT n.id, n.label, coalesce(x.o, 0) AS out_degree, coalesce(x.i, 0) AS in_degree FROM nodes n LEFT JOIN (SELECT source, count(*) FILTER (direction = 'out') AS o, count(*) FILTER (direction = 'in') AS i FROM adj GROUP BY 1) x ON x.source = n.id WHERE n.id IN ('s1', 's2', 'p1', 'p2', 'p3')")
def k2(spark, d):
    ids = ["s1", "s2", "p1", "p2", "p3"]
    count = lambda x: F.count(F.when(F.col("direction") == x, 1))
    degree = adjacency(spark, d).where(F.col("source").isin(ids)).groupBy(F.col("source").alias("id")).agg(count("out").alias("out_degree"), count("in").alias("in_degree"))
    return nodes(spark, d).where(F.col("id").isin(ids)).select("id", "label").join(degree, "id", "left").fillna(0, ["out_degree", "in_degree"])


@query("k3_atom_artifacts", "SELECT page_id, 'p' || (page_id % 100 + 1) AS node_id, md5(url) AS source_hash FROM pages WHERE 'p' || (page_id % 100 + 1) IN (SELECT id FROM shown)")
def k3(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), F.col("page_id") % 100 + 1).alias("node_id"), F.md5("url").alias("source_hash"))
    return pages.join(public(nodes(spark, d)).select(F.col("id").alias("node_id")), "node_id", "left_semi")


@query("k4_triples_of_atom", "SELECT subject, predicate, object, weight FROM edges WHERE subject = 'p7' OR predicate = 'p7' OR object = 'p7'")
def k4(spark, d):
    return edges(spark, d).where((F.col("subject") == "p7") | (F.col("predicate") == "p7") | (F.col("object") == "p7"))


@query("k5_expanded_triples", "SELECT e.subject, s.label AS subject_label, e.predicate, e.object, o.label AS object_label FROM edges e LEFT JOIN shown s ON s.id = e.subject LEFT JOIN shown o ON o.id = e.object WHERE e.weight >= 2")
def k5(spark, d):
    """Terms that aren't public stay as ids with a null label."""
    label = public(nodes(spark, d)).select("id", "label")
    side = lambda c: label.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label"))
    return edges(spark, d).where("weight >= 2").join(side("subject"), "subject", "left").join(side("object"), "object", "left").select("subject", "subject_label", "predicate", "object", "object_label")


def match(triples: DataFrame, **pattern: str | None) -> DataFrame:
    """Triples that agree with the given terms; a term left out matches anything."""
    for column, value in pattern.items():
        if value is not None:
            triples = triples.where(F.col(column) == value)
    return triples


@query("k6_triple_pattern", "SELECT * FROM edges WHERE subject = 's3' AND predicate = 'returned'")
def k6(spark, d):
    return match(edges(spark, d), subject="s3", predicate="returned", object=None)


@query("k7_event_feed", "f AS (SELECT seq, event_type, CASE WHEN event_type IN ('signup', 'purchase') THEN 'p' || (seq % 200 + 1) ELSE 's' || (seq % 10 + 1) END AS entity FROM ev) SELECT seq, event_type, entity FROM f WHERE EXISTS (SELECT 1 FROM shown WHERE shown.id = f.entity)")
def k7(spark, d):
    """The four-way visibility test is one semi-join on the entity, whatever its kind."""
    entity = F.when(F.col("event_type").isin("signup", "purchase"), F.concat(F.lit("p"), F.col("seq") % 200 + 1)).otherwise(F.concat(F.lit("s"), F.col("seq") % 10 + 1))
    feed = L.event_store(spark, d).select("seq", "event_type", entity.alias("entity"))
    return feed.join(public(nodes(spark, d)).select(F.col("id").alias("entity")), "entity", "left_semi")


@query("k8_predicate_registry", "SELECT predicate AS slug, count(*) AS triples, CAST(sum(weight) AS BIGINT) AS weight FROM edges GROUP BY 1 ORDER BY 1")
def k8(spark, d):
    return edges(spark, d).groupBy(F.col("predicate").alias("slug")).agg(F.count(F.lit(1)).alias("triples"), F.sum("weight").alias("weight")).orderBy("slug")


@query("k9_stats", "SELECT (SELECT count(*) FROM nodes) AS atoms, (SELECT count(*) FROM shown) AS public_atoms, (SELECT count(*) FROM edges) AS triples, (SELECT count(*) FROM events) AS events")
def k9(spark, d):
    n = nodes(spark, d).agg(F.count(F.lit(1)).alias("atoms"), F.count(F.when((F.col("status") == "active") & (F.col("visibility") == "public"), 1)).alias("public_atoms"))
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n.crossJoin(one(edges(spark, d), "triples")).crossJoin(one(table(spark, d, "events"), "events"))  # one row each


@query("k9_pipeline_stats", "SELECT stage, status, count(*) AS n FROM work GROUP BY ALL")
def k9b(spark, d):
    return work(spark, d).groupBy("stage", "status").agg(F.count(F.lit(1)).alias("n"))


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("k10_schema", "SELECT table_name, column_name, ordinal_position AS position FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ")")
def k10(spark, d):
    """Columns of the tables, from their schemas; no data is read."""
    rows = [(t, c, i) for t in TABLES for i, c in enumerate(table(spark, d, t).columns, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


@query("k11_events_hourly", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, event_type, count(*) AS n FROM ev GROUP BY ALL")
def k11(spark, d):
    return L.event_store(spark, d).groupBy(trunc("hour").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", stamp("bucket"))


@query("k12_neighbourhood", "s AS (SELECT id FROM shown ORDER BY created DESC, id DESC LIMIT 1) SELECT a.direction, a.predicate, a.neighbor, n.label FROM adj a JOIN s ON s.id = a.source LEFT JOIN shown n ON n.id = a.neighbor")
def k12(spark, d):
    seed = page(public(nodes(spark, d)), [F.desc("created"), F.desc("id")], 1).select(F.col("id").alias("source"))
    names = public(nodes(spark, d)).select(F.col("id").alias("neighbor"), "label")
    return adjacency(spark, d).join(F.broadcast(seed), "source").join(names, "neighbor", "left").select("direction", "predicate", "neighbor", "label")  # the seed is one row


@query("k13_adjacency", "SELECT source, direction, predicate, neighbor, weight FROM adj")
def k13(spark, d):
    return adjacency(spark, d)


@query("k13_node_stats", "SELECT source AS id, count(*) AS degree, count(DISTINCT predicate) AS predicates, CAST(sum(weight) AS BIGINT) AS weight FROM adj GROUP BY 1")
def k13b(spark, d):
    return adjacency(spark, d).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("predicate").alias("predicates"), F.sum("weight").alias("weight"))


@query("k13_predicate_stats", "SELECT predicate, count(*) AS triples, count(DISTINCT subject) AS subjects, count(DISTINCT object) AS objects FROM edges GROUP BY 1")
def k13c(spark, d):
    return edges(spark, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("triples"), F.countDistinct("subject").alias("subjects"), F.countDistinct("object").alias("objects"))


@query("k13_pattern_stats", "SELECT subject, predicate, count(*) AS matches, round(1.0 * count(*) / (SELECT count(*) FROM edges), 9) AS selectivity FROM edges GROUP BY ALL")
def k13d(spark, d):
    """Selectivity is a pattern's share of all triples (our choice; the source leaves it open)."""
    e = edges(spark, d)
    total = e.agg(F.count(F.lit(1)).alias("total"))
    counts = e.groupBy("subject", "predicate").agg(F.count(F.lit(1)).alias("matches"))
    return counts.crossJoin(F.broadcast(total)).select("subject", "predicate", "matches", F.round(F.col("matches") / F.col("total"), 9).alias("selectivity"))  # the total is one row


@query("k14_atom_ids")
def k14(spark, d):
    return table(spark, d, "pages").select("page_id", keccak.atom_id_of(F.col("url")).alias("atom_id"))


@query("k15_triple_ids")
def k15(spark, d):
    url = F.col("url")
    ids = table(spark, d, "pages").select("page_id", keccak.atom_id_of(url).alias("s"), keccak.atom_id_of(F.lit("links to")).alias("p"), keccak.atom_id_of(F.concat(url, F.lit("#"))).alias("o"))
    return ids.select("page_id", keccak.triple_id_of(F.col("s"), F.col("p"), F.col("o")).alias("triple_id"))


@query("k16_term_ids", "SELECT page_id, CASE WHEN regexp_full_match(t, '0x[0-9a-fA-F]{64}') THEN t END AS term_id FROM (SELECT page_id, regexp_replace(trim(CASE page_id % 3 WHEN 0 THEN ' atom:0x' WHEN 1 THEN 'triple:0x' ELSE '' END || sha256(url)), '^(atom|triple):', '') AS t FROM pages)")
def k16(spark, d):
    raw = F.concat(F.when(F.col("page_id") % 3 == 0, " atom:0x").when(F.col("page_id") % 3 == 1, "triple:0x").otherwise(""), F.sha2("url", 256))
    bare = F.regexp_replace(F.trim(raw), "^(atom|triple):", "")
    return table(spark, d, "pages").select("page_id", F.when(bare.rlike("^0x[0-9a-fA-F]{64}$"), bare).alias("term_id"))


@query("k17_ensure_nodes", "SELECT DISTINCT 'p' || l_partkey AS id FROM lineitem WHERE 'p' || l_partkey NOT IN (SELECT id FROM nodes WHERE created % 2 = 0)")
def k17(spark, d):
    """Insert if absent: what an anti-join leaves is what is created."""
    wanted = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("id")).distinct()
    return wanted.join(nodes(spark, d).where("created % 2 = 0").select("id"), "id", "left_anti")


@query("k18_stage_candidates", "SELECT id, stage FROM work WHERE status = 'pending' AND attempts < 3 ORDER BY ts, id LIMIT 100")
def k18(spark, d):
    return work(spark, d).where("status = 'pending' AND attempts < 3").orderBy("ts", "id").limit(100).select("id", "stage")


@query("k19_dead_letters", "SELECT id, stage, code FROM work WHERE status = 'failed' AND (code = 'MAX_ATTEMPTS_EXCEEDED' OR attempts >= 4) ORDER BY ts, id LIMIT 100")
def k19(spark, d):
    return work(spark, d).where("status = 'failed' AND (code = 'MAX_ATTEMPTS_EXCEEDED' OR attempts >= 4)").orderBy("ts", "id").limit(100).select("id", "stage", "code")


@query("k20_primary_artifact", "SELECT stage AS node_id, arg_max(id, (ts, id)) AS artifact_id FROM work WHERE status = 'completed' GROUP BY stage")
def k20(spark, d):
    return work(spark, d).where("status = 'completed'").groupBy(F.col("stage").alias("node_id")).agg(F.max_by("id", F.struct("ts", "id")).alias("artifact_id"))


@query("k22_raw_type", "SELECT page_id, CASE WHEN regexp_matches(t, '^https?://') THEN 'url' WHEN regexp_matches(t, '^ipfs://') THEN 'ipfs' WHEN json_valid(t) AND regexp_matches(t, '^\\s*[\\[{]') THEN 'json' ELSE 'string' END AS raw_type FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'ipfs://' || md5(url) WHEN 2 THEN '{\"u\": \"' || md5(url) || '\"}' ELSE md5(url) END AS t FROM pages)")
def k22(spark, d):
    m, h = F.col("page_id") % 4, F.md5("url")
    t = F.when(m == 0, F.col("url")).when(m == 1, F.concat(F.lit("ipfs://"), h)).when(m == 2, F.concat(F.lit('{"u": "'), h, F.lit('"}'))).otherwise(h)
    is_json = t.rlike(r"^\s*[\[{]") & F.get_json_object(t, "$").isNotNull()
    return table(spark, d, "pages").select("page_id", F.when(t.rlike("^https?://"), "url").when(t.startswith("ipfs://"), "ipfs").when(is_json, "json").otherwise("string").alias("raw_type"))


# --- K21: the cookbook; the other entries are covered by the queries named in the README ---


@query("k21_class_mix", "SELECT class, count(*) AS n FROM shown GROUP BY 1 ORDER BY n DESC, class")
def k21_3(spark, d):
    return public(nodes(spark, d)).groupBy("class").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "class")


@query("k21_recent_claims", "SELECT e.subject, e.predicate, e.object, n.label FROM edges e LEFT JOIN nodes n ON n.id = e.object WHERE e.predicate = 'returned' ORDER BY n.created DESC, e.subject LIMIT 50")
def k21_4(spark, d):
    n = nodes(spark, d).select(F.col("id").alias("object"), "label", "created")
    return edges(spark, d).where("predicate = 'returned'").join(n, "object", "left").orderBy(F.desc_nulls_last("created"), "subject").limit(50).select("subject", "predicate", "object", "label")


@query("k21_highest_degree", "SELECT a.source AS id, count(*) AS degree FROM adj a JOIN shown s ON s.id = a.source GROUP BY 1 ORDER BY degree DESC, id LIMIT 20")
def k21_6(spark, d):
    return adjacency(spark, d).groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("degree")).join(public(nodes(spark, d)).select("id"), "id", "left_semi").orderBy(F.desc("degree"), "id").limit(20)


@query("k21_failure_codes", "SELECT stage, code, count(*) AS n FROM work WHERE status = 'failed' GROUP BY ALL ORDER BY n DESC, stage, code")
def k21_11(spark, d):
    return work(spark, d).where("status = 'failed'").groupBy("stage", "code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "stage", "code")


@query("k21_stage_durations", "SELECT stage, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95, count(*) AS n FROM work WHERE status = 'completed' GROUP BY stage")
def k21_13(spark, d):
    done = work(spark, d).where("status = 'completed'")
    cuts = exact_quantiles(done, "seconds", "id", {"p50": 0.5, "p95": 0.95}, by="stage")
    counts = done.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    return cuts.join(counts, "stage").select("stage", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@query("k21_domain_coverage", "SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host, count(*) AS pages, count(DISTINCT md5(html)) AS contents FROM pages GROUP BY 1 ORDER BY pages DESC, host LIMIT 50")
def k21_17(spark, d):
    return table(spark, d, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.countDistinct(F.md5("html")).alias("contents")).orderBy(F.desc("pages"), "host").limit(50)


@query("k21_store_summary", "SELECT event_type, count(*) AS n, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq, count(DISTINCT account) AS accounts FROM ev GROUP BY 1")
def k21_18(spark, d):
    return L.event_store(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.countDistinct("account").alias("accounts"))


@query("k21_creation_by_hour", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS bucket, count(*) FILTER (event_type = 'signup') AS atoms, count(*) FILTER (event_type = 'view') AS triples FROM ev WHERE event_type IN ('signup', 'view') GROUP BY 1")
def k21_20(spark, d):
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    return L.event_store(spark, d).where(F.col("event_type").isin("signup", "view")).groupBy(trunc("hour").alias("bucket")).agg(kind("signup").alias("atoms"), kind("view").alias("triples")).withColumn("bucket", stamp("bucket"))


@query("k21_active_writers", "SELECT c.c_custkey AS account, count(DISTINCT o.o_orderkey) AS orders, count(DISTINCT e.seq) AS events FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey LEFT JOIN ev e ON e.account = c.c_custkey GROUP BY 1 ORDER BY events DESC, orders DESC, account LIMIT 50")
def k21_30(spark, d):
    """Two fan-outs are aggregated before they are joined, so neither multiplies the other."""
    orders = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("account")).agg(F.countDistinct("o_orderkey").alias("orders"))
    events = L.event_store(spark, d).groupBy("account").agg(F.countDistinct("seq").alias("events"))
    everyone = table(spark, d, "customer").select(F.col("c_custkey").alias("account"))
    return everyone.join(orders, "account", "left").join(events, "account", "left").fillna(0).orderBy(F.desc("events"), F.desc("orders"), "account").limit(50)


@query("g2_page_two", "SELECT id, label FROM shown ORDER BY created DESC, id DESC LIMIT 100 OFFSET 100")
def g2(spark, d):
    return page(public(nodes(spark, d)), [F.desc("created"), F.desc("id")], 500, 100).select("id", "label")


@query("b10_shards", "SELECT term, curve, count(*) AS events, 1 AS shards FROM ev GROUP BY ALL")
def b10(spark, d):
    """Four workers, each of which keeps its shard's events only: every vault is with one of them, whole; the hash itself is not part of the contract."""
    ev = L.event_store(spark, d).select("term", "curve")
    shard = F.pmod(F.xxhash64("term", "curve"), F.lit(4))
    of_worker = [ev.where(shard == n).groupBy("term", "curve").agg(F.count(F.lit(1)).alias("events")).withColumn("worker", F.lit(n)) for n in range(4)]
    everything = of_worker[0].unionByName(of_worker[1]).unionByName(of_worker[2]).unionByName(of_worker[3])
    return everything.groupBy("term", "curve").agg(F.sum("events").alias("events"), F.count_distinct("worker").cast("int").alias("shards"))


# --- V: bonding curves ------------------------------------------------------

_LIN = {
    "deposit": "x * s // a", "mint": "(x * a + s - 1) // s", "withdraw": "(x * s + a - 1) // a", "redeem": "x * a // s", "price": "1000000000000000000::HUGEINT * a // s",
}
_ROWS = "r AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS HUGEINT) * 1000 AS x, CAST(round(l_extendedprice * 100) AS HUGEINT) + 100000 AS a, CAST(l_orderkey AS HUGEINT) * 10 + 100000 AS s FROM lineitem)"


def _vault_rows(spark, d):
    dec = lambda c: c.cast("decimal(38,0)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", dec(F.col("l_quantity") * 1000).alias("x"), (dec(F.round(F.col("l_extendedprice") * 100)) + 100000).alias("a"), (dec(F.col("l_orderkey") * 10) + 100000).alias("s"))


for _i, (_op, _formula) in enumerate(_LIN.items(), 1):
    query(f"v{_i}_linear_{_op}", f"{_ROWS} SELECT l_orderkey, l_linenumber, CAST({_formula} AS VARCHAR) AS value FROM r")(
        lambda spark, d, op=_op: _vault_rows(spark, d).select("l_orderkey", "l_linenumber", V.preview(V.Linear(), op, F.col("x"), F.col("a"), F.col("s"))["value"].alias("value")))

PROGRESSIVE = V.OffsetProgressive(2 * V.WAD, V.WAD // 2)
_U = "1000000000000000000::HUGEINT"
#: A whole square root in 128-bit SQL: a Newton step from the double's root, then at most one off.
_ROOT = "(CASE WHEN r * r > v THEN r - 1 WHEN (r + 1) * (r + 1) <= v THEN r + 1 ELSE r END)"


def _rooted(inner: str) -> str:
    return f"{_ROWS}, p AS (SELECT *, s + {_U} // 2 AS t FROM r), i AS (SELECT *, ({inner}) * {_U} AS v FROM p), j AS (SELECT *, CAST(sqrt(CAST(v AS DOUBLE)) AS HUGEINT) AS g FROM i), k AS (SELECT *, (g + v // g) // 2 AS r FROM j)"


_PRO = {
    "deposit": f"{_rooted(f't * t // {_U} + x')} SELECT l_orderkey, l_linenumber, CAST({_ROOT} - t AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM k",
    "redeem": f"{_ROWS}, p AS (SELECT *, s + {_U} // 2 AS t FROM r) SELECT l_orderkey, l_linenumber, CAST(t * t // {_U} - (t - x) * (t - x) // {_U} AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM p",
    "mint": f"{_ROWS}, p AS (SELECT *, s + {_U} // 2 AS t FROM r) SELECT l_orderkey, l_linenumber, CAST(((t + x) * (t + x) + {_U} - 1) // {_U} - t * t // {_U} AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM p",
    "withdraw": f"{_rooted(f't * t // {_U} - x')} SELECT l_orderkey, l_linenumber, CAST(t - {_ROOT} AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM k",
    "price": f"{_ROWS} SELECT l_orderkey, l_linenumber, CAST((s + {_U} // 2) * 2 AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS error FROM r",
}
for _i, (_op, _sql) in enumerate(_PRO.items(), 7):
    query(f"v{_i}_progressive_{_op}", _sql)(lambda spark, d, op=_op: _vault_rows(spark, d).select("l_orderkey", "l_linenumber", V.preview(PROGRESSIVE, op, F.col("x"), F.col("a"), F.col("s")).alias("r")).select("l_orderkey", "l_linenumber", "r.value", "r.error"))


@query("v12_fee_on_raw", "SELECT l_orderkey, l_linenumber, CAST((CAST(round(l_extendedprice * 100) AS HUGEINT) * 25 + 9999) // 10000 AS BIGINT) AS fee FROM lineitem")
def v12(spark, d):
    """Below 10^38 the exact decimal stays in the JVM."""
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(20,0)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.ceil(cents * 25 / 10000).cast("long").alias("fee"))


@query("v13_market_cap", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS HUGEINT) * CAST(round(l_extendedprice * 100) AS HUGEINT) // 1000 AS BIGINT) AS cap FROM lineitem")
def v13(spark, d):
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(18,0)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.col("l_quantity").cast("decimal(10,0)") * cents / 1000).cast("long").alias("cap"))


_FEES = V.Fees(protocol=100, entry=50, exit=25, wallet=25, fraction=150)


def _fee_sql(op: str, kind: str) -> str:
    rates = [100, 25] if op == "redeem" else [100, 50, *{"basic": [], "atom": [25], "triple": [150]}[kind]]
    base_amount = "x * a // s" if op == "redeem" else "x"
    fees = " + ".join(f"(b * {r} + 9999) // 10000" for r in rates)
    shares = "x" if op == "redeem" else "(b - f) * s // a"
    return f"{_ROWS}, q AS (SELECT *, {base_amount} AS b FROM r), z AS (SELECT *, {fees} AS f FROM q) SELECT l_orderkey, l_linenumber, CAST({shares} AS VARCHAR) AS shares, CAST(b AS VARCHAR) AS assets_before, CAST(b - f AS VARCHAR) AS assets_after, CAST(f AS VARCHAR) AS total_fees, CAST(NULL AS VARCHAR) AS error FROM z"


for _id, _op, _kind in (("v14_deposit_with_fees", "deposit", "basic"), ("v15_redeem_with_fees", "redeem", "basic"), ("v16_atom_deposit", "deposit", "atom"), ("v17_triple_deposit", "deposit", "triple")):
    query(_id, _fee_sql(_op, _kind))(lambda spark, d, op=_op, kind=_kind: _vault_rows(spark, d).select("l_orderkey", "l_linenumber", V.quote(V.Linear(), op, F.col("x"), F.col("a"), F.col("s"), _FEES, kind).alias("q")).select("l_orderkey", "l_linenumber", "q.*"))
