"""Queries of raw envelopes, projections on them, graph operations, sinks and leases.

The raw log is made from the events: six types, amounts as texts, atoms' bytes in
hexadecimal (some of them no text), some payloads cut short or lacking a field, an unknown
type, and some events taken back. The oracles know these from the event numbers, so they
never parse a payload.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.columns import json_merge
from termloom.operators import graph_sink as G
from termloom.operators import leases
from termloom.operators import market as M
from termloom.plans import base
from termloom.plans.base import AS_OF, query, stamp, table
from termloom.session import shared_folder
from termloom.sources import envelopes as E
from termloom.sources import ledger as L
from termloom.sources import sinks
from termloom.sources.merge_table import MergeTable


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def _object(**fields: str) -> str:
    return "concat('{', " + ", ', ', ".join(f"""'"{k}": "', {v}, '"'""" for k, v in fields.items()) + ", '}')"


#: SQL of both engines over the event store.
_NAME = "CASE WHEN seq % 101 = 0 THEN 'ProxyUpgraded' WHEN event_type = 'purchase' THEN 'Deposited' WHEN event_type = 'error' THEN 'Redeemed' WHEN event_type = 'click' THEN 'SharePriceChanged' WHEN event_type = 'signup' THEN 'AtomCreated' WHEN seq % 2 = 0 THEN 'TripleCreated' ELSE 'ProtocolFeeAccrued' END"
_WHO, _TO = _text("account"), _text("account + seq % 3")
_NET, _HALF, _FEE = (_text(f"CAST(floor(amount {x}) AS BIGINT)") for x in ("* 0.98", "/ 2.0", "/ 50.0"))
_TERM, _CURVE = f"concat('T', {_text('term')})", _text("curve")
_PRICE = f"concat({_text('amount % 500 + 1')}, '000000000000000000')"
_BYTES = f"CASE seq % 4 WHEN 0 THEN concat('0x', hex(concat('Atom ', {_text('seq')}))) WHEN 1 THEN '0x4100' WHEN 2 THEN '0xfffe' ELSE 'none' END"
_DATA = {
    "AtomCreated": _object(creator=_WHO, term_id=f"concat('T', {_text('seq')})", atom_data=_BYTES, atom_wallet="'w'"),
    "TripleCreated": _object(creator=_WHO, term_id=f"concat('R', {_text('seq')})", subject_id=_TERM, predicate_id=f"concat('P', {_CURVE})", object_id=f"concat('T', {_text('seq % 7')})"),
    "Deposited": _object(sender=_WHO, receiver=_TO, term_id=_TERM, curve_id=_CURVE, assets=_text("amount"), assets_after_fees=_NET, shares=_HALF, total_shares=_text("amount"), vault_type="'0'"),
    "Redeemed": _object(sender=_WHO, receiver=_TO, term_id=_TERM, curve_id=_CURVE, shares=_HALF, total_shares=_text("amount"), assets=_text("amount"), fees="'0'"),
    "SharePriceChanged": _object(term_id=_TERM, curve_id=_CURVE, share_price=_PRICE, total_assets=_text("amount"), total_shares=_text("amount")),
    "ProtocolFeeAccrued": _object(epoch=_text("seq % 11"), sender=_WHO, amount=_FEE),
    "ProxyUpgraded": _object(version="'2'"),
}
_PAYLOAD = f"CASE {_NAME} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _DATA.items()) + " END"
_CUT = f"CASE WHEN seq % 97 = 0 THEN substr({_PAYLOAD}, 1, 12) WHEN seq % 89 = 0 THEN replace({_PAYLOAD}, '\"term_id\"', '\"other\"') ELSE {_PAYLOAD} END"

base.CTES |= {
    "named": f"SELECT *, account + seq % 3 AS recipient, CAST(floor(amount * 0.98) AS BIGINT) AS net, CAST(floor(amount / 2.0) AS BIGINT) AS half, CAST(floor(amount / 50.0) AS BIGINT) AS fee, 'T' || term AS term_id, {_NAME} AS name FROM ev",
    "raw": "SELECT *, CASE WHEN name = 'ProxyUpgraded' THEN 'unknown_type' WHEN seq % 97 = 0 THEN 'malformed' WHEN seq % 89 = 0 AND name <> 'ProtocolFeeAccrued' THEN 'missing_field' END AS problem FROM named",
    "good": "SELECT * FROM raw WHERE problem IS NULL",
    "touched": "SELECT account, ts, seq, CASE name WHEN 'AtomCreated' THEN 'atom' WHEN 'TripleCreated' THEN 'triple' WHEN 'Deposited' THEN 'deposit' WHEN 'Redeemed' THEN 'redemption' ELSE 'fee' END AS reason FROM good WHERE name <> 'SharePriceChanged' UNION ALL SELECT recipient, ts, seq, CASE name WHEN 'Deposited' THEN 'deposit' ELSE 'redemption' END FROM good WHERE name IN ('Deposited', 'Redeemed')",
    "held": "SELECT term_id, curve, holder, CAST(sum(d) AS BIGINT) AS shares FROM (SELECT term_id, curve, recipient AS holder, half AS d FROM good WHERE name = 'Deposited' UNION ALL SELECT term_id, curve, account, -half FROM good WHERE name = 'Redeemed') GROUP BY ALL",
}


def _envelopes(spark: SparkSession, d: str) -> DataFrame:
    ev = L.event_store(spark, d)
    return ev.select(
        "seq", (F.col("seq") * 3).alias("block_number"), F.lit(0).alias("log_index"), "ts", F.expr(_NAME).alias("event_type"), F.expr(_CUT).alias("event_data"), (F.col("seq") % 53 != 0).alias("is_canonical"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return E.parse(_envelopes(spark, d))


def _long(c: str) -> Column:
    return F.col(c).cast("long").alias(c.rpartition(".")[2])


@query("p19_parse", "SELECT seq, CASE WHEN problem IS NULL THEN name ELSE 'Unknown' END AS kind, problem FROM raw")
def p19(spark, d):
    return _parsed(spark, d).select("seq", "kind", "problem")


@query("a2_event_decode", "SELECT seq, CAST(account AS VARCHAR) AS sender, CAST(recipient AS VARCHAR) AS receiver, term_id, CAST(curve AS VARCHAR) AS curve_id, amount AS assets, net AS assets_after_fees, half AS shares, CASE WHEN name = 'Deposited' THEN '0' END AS vault_type, name AS kind FROM good WHERE name IN ('Deposited', 'Redeemed')")
def a2(spark, d):
    p = _parsed(spark, d)
    one = lambda k, net: E.typed(p, k).select("seq", "sender", "receiver", "term_id", "curve_id", _long("assets"), F.col(net).cast("long").alias("assets_after_fees"), _long("shares"), "vault_type", F.lit(k).alias("kind"))
    both = one("Deposited", "assets_after_fees").unionByName(one("Redeemed", "assets"))
    return both.withColumn("assets_after_fees", F.when(F.col("kind") == "Deposited", F.col("assets_after_fees")).otherwise(F.floor(F.col("assets") * F.lit("0.98").cast("decimal(3,2)")).cast("long")))


@query("a6_typed_event_scan", "SELECT seq, name AS kind, CASE WHEN name IN ('AtomCreated', 'TripleCreated') THEN NULL WHEN name = 'SharePriceChanged' THEN NULL ELSE CAST(account AS VARCHAR) END AS sender, CASE WHEN name = 'ProtocolFeeAccrued' THEN 3 WHEN name = 'AtomCreated' THEN 4 WHEN name IN ('TripleCreated', 'SharePriceChanged') THEN 5 WHEN name = 'Redeemed' THEN 8 ELSE 9 END AS fields FROM good WHERE seq > 1000 ORDER BY seq LIMIT 500")
def a6(spark, d):
    """Payloads rebuilt from their fields; null fields are left out."""
    rows = E.rebuilt(_parsed(spark, d), 1000, 500)
    return rows.select("seq", "kind", F.get_json_object("event_data", "$.sender").alias("sender"), F.size(F.json_object_keys("event_data")).cast("long").alias("fields"))


@query("a12_dead_letters", "SELECT problem, count(*) AS n, CAST(min(seq) AS BIGINT) AS first_seq, CAST(max(seq) AS BIGINT) AS last_seq, (SELECT CAST(min(seq) - 1 AS BIGINT) FROM raw WHERE problem = 'malformed') AS pinned FROM raw WHERE problem IS NOT NULL GROUP BY problem")
def a12(spark, d):
    """Events that no typed parser takes; the checkpoint stays before the first that is broken."""
    good, bad = sinks.quarantine(_parsed(spark, d), F.col("problem").isNull())
    pinned = bad.agg((F.min(F.when(F.col("problem") == "malformed", F.col("seq"))) - 1).alias("pinned"))
    counts = bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    return counts.crossJoin(F.broadcast(pinned))


@query("s7_canonical", "SELECT name, count(*) AS n FROM raw WHERE seq % 53 <> 0 GROUP BY name")
def s7(spark, d):
    return E.canonical(_envelopes(spark, d)).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("p1_event_log", "SELECT seq || '-0' AS event_id, name AS kind, CASE WHEN name IN ('Deposited', 'Redeemed') THEN amount WHEN name = 'ProtocolFeeAccrued' THEN fee END AS amount FROM good")
def p1(spark, d):
    """All types; deliveries that come twice count once."""
    p = _parsed(spark, d).where("kind <> 'Unknown'")
    twice = p.unionByName(p.where("log_index = 0"))
    amount = F.coalesce("payload.assets", "payload.amount").cast("long").alias("amount")
    return twice.select(F.concat_ws("-", "seq", "log_index").alias("event_id"), "kind", amount).dropDuplicates(["event_id"])


@query("p2_account_registry", "SELECT CAST(account AS VARCHAR) AS account, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM touched GROUP BY account")
def p2(spark, d):
    seen = E.accounts_of(_parsed(spark, d)).groupBy("account").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return seen.select("account", stamp("first_seen"), stamp("last_seen"))


@query("p3_core_entities", """SELECT 'atom' AS kind, 'T' || seq AS id, CASE seq % 4 WHEN 0 THEN 'Atom ' || seq WHEN 1 THEN '0x4100' WHEN 2 THEN '0xfffe' ELSE 'none' END AS data, CAST(account AS VARCHAR) AS creator FROM good WHERE name = 'AtomCreated'
UNION ALL SELECT 'triple', 'R' || seq, term_id || ' P' || curve || ' T' || (seq % 7), CAST(account AS VARCHAR) FROM good WHERE name = 'TripleCreated' UNION ALL SELECT DISTINCT 'predicate', 'P' || curve, NULL, NULL FROM good WHERE name = 'TripleCreated'""")
def p3(spark, d):
    """Atoms with the text of their bytes, triples, and the predicates that they bring along."""
    p = _parsed(spark, d)
    atoms = E.typed(p, "AtomCreated").select(F.lit("atom").alias("kind"), F.col("term_id").alias("id"), E.decoded(F.col("atom_data")).alias("data"), "creator")
    t = E.typed(p, "TripleCreated")
    triples = t.select(F.lit("triple").alias("kind"), F.col("term_id").alias("id"), F.concat_ws(" ", "subject_id", "predicate_id", "object_id").alias("data"), "creator")
    none = F.lit(None).cast("string")
    return atoms.unionByName(triples).unionByName(t.select(F.lit("predicate").alias("kind"), F.col("predicate_id").alias("id"), none.alias("data"), none.alias("creator")).distinct())


_VAULTS = """SELECT term_id, CAST(curve AS VARCHAR) AS curve_id, CAST(coalesce(sum(CASE WHEN name = 'Deposited' THEN net WHEN name = 'Redeemed' THEN -amount END), 0) AS BIGINT) AS total_deposits, CAST(coalesce(sum(CASE WHEN name = 'Redeemed' THEN amount END), 0) AS BIGINT) AS total_redemptions,
 CAST(coalesce(arg_max(amount * (amount % 500 + 1), seq) FILTER (name = 'SharePriceChanged'), 0) AS BIGINT) AS market_cap FROM good WHERE name IN ('Deposited', 'Redeemed', 'SharePriceChanged') GROUP BY ALL"""


def _vaults(spark: SparkSession, d: str) -> DataFrame:
    """Sums of what came and went, and the last price; the cap is shares times price in units of 1e18, rounded down."""
    p, of = _parsed(spark, d).where(F.col("kind").isin("Deposited", "Redeemed", "SharePriceChanged")), lambda k: F.col("kind") == k
    n = lambda f: F.col(f"payload.{f}").cast("decimal(38,0)")
    cap = F.expr("(CAST(payload.total_shares AS DECIMAL(18,0)) * CAST(payload.share_price AS DECIMAL(38,0))) div 1000000000000000000")
    return p.groupBy(F.col("payload.term_id").alias("term_id"), F.col("payload.curve_id").alias("curve_id")).agg(
        F.coalesce(F.sum(F.when(of("Deposited"), n("assets_after_fees")).when(of("Redeemed"), -n("assets"))), F.lit(0)).cast("long").alias("total_deposits"),
        F.coalesce(F.sum(F.when(of("Redeemed"), n("assets"))), F.lit(0)).cast("long").alias("total_redemptions"),
        F.coalesce(F.max_by(F.when(of("SharePriceChanged"), cap), F.when(of("SharePriceChanged"), F.col("seq"))), F.lit(0)).cast("long").alias("market_cap"),
    )


#: Buckets of the keyed sinks here; a table of many keys takes more.
_BUCKETS = 8


def _keyed(spark: SparkSession, rows, name: str, keys: list[str]) -> MergeTable:
    """A keyed sink in which a key's row is what its batches add up to."""
    return MergeTable(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", rows.schema, keys, {c: "sum" for c in rows.columns if c not in keys}, buckets=_BUCKETS)


@query("p5_vault_state_dual", _VAULTS)
def p5(spark, d):
    """The same frame into two keyed sinks; the second one takes it from the first, and what it holds is read back."""
    state = _vaults(spark, d)
    market, graph = (_keyed(spark, state, name, ["term_id", "curve_id"]) for name in ("market", "graph"))
    market.write(state, 0)
    graph.write(market.read(), 0)
    return graph.read()


_HOLDERS = "SELECT term_id, CAST(curve AS VARCHAR) AS curve_id, count(*) AS holder_count, CAST(sum(shares) AS BIGINT) AS held FROM held WHERE shares > 0 GROUP BY ALL"


def _holders(spark: SparkSession, d: str) -> DataFrame:
    """What receivers got and senders gave; holders of nothing are pruned."""
    p = _parsed(spark, d).where(F.col("kind").isin("Deposited", "Redeemed"))
    came = F.col("kind") == "Deposited"
    shares = F.col("payload.shares").cast("decimal(38,0)")
    moves = p.select("payload.term_id", "payload.curve_id", F.when(came, F.col("payload.receiver")).otherwise(F.col("payload.sender")).alias("holder"), F.when(came, shares).otherwise(-shares).alias("delta"))
    held = moves.groupBy("term_id", "curve_id", "holder").agg(F.sum("delta").alias("shares")).where("shares > 0")
    return held.groupBy("term_id", "curve_id").agg(F.count(F.lit(1)).alias("holder_count"), F.sum("shares").cast("long").alias("held"))


@query("p6_vault_holders", _HOLDERS)
def p6(spark, d):
    return _holders(spark, d)


@query("p7_vault_holders_dual", _HOLDERS)
def p7(spark, d):
    """Into a keyed sink; the batch comes again after the first was compacted, which changes nothing."""
    holders = _holders(spark, d)
    sink = _keyed(spark, holders, "holders", ["term_id", "curve_id"])
    sink.write(holders, 0)
    again = sink.read()
    sink.compact(1)
    sink.write(again, 0)
    return sink.read()


@query("p10_cap_history", "SELECT term_id, seq, amount * (amount % 500 + 1) AS cap, seq = max(seq) OVER (PARTITION BY term_id) AS latest FROM good WHERE name = 'SharePriceChanged'")
def p10(spark, d):
    """Every cap of a term, and which one its summary shows: the last."""
    price = E.typed(_parsed(spark, d), "SharePriceChanged")
    cap = F.expr("(CAST(total_shares AS DECIMAL(18,0)) * CAST(share_price AS DECIMAL(38,0))) div 1000000000000000000").cast("long").alias("cap")
    history = price.select("term_id", "seq", cap)
    last = history.groupBy("term_id").agg(F.max("seq").alias("last"))
    return history.join(last, "term_id").select("term_id", "seq", "cap", (F.col("seq") == F.col("last")).alias("latest"))


@query("p11_protocol_totals", """b AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (name = 'AtomCreated') AS atoms, count(*) FILTER (name = 'TripleCreated') AS triples, coalesce(sum(net) FILTER (name = 'Deposited'), 0) AS deposited, coalesce(sum(amount) FILTER (name = 'Redeemed'), 0) AS redeemed, coalesce(sum(fee) FILTER (name = 'ProtocolFeeAccrued'), 0) AS fees FROM good GROUP BY 1)
SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(atoms) OVER w AS BIGINT) AS atoms, CAST(sum(triples) OVER w AS BIGINT) AS triples, CAST(sum(deposited) OVER w AS BIGINT) AS deposited, CAST(sum(redeemed) OVER w AS BIGINT) AS redeemed, CAST(sum(fees) OVER w AS BIGINT) AS fees FROM b WINDOW w AS (ORDER BY b.day ROWS UNBOUNDED PRECEDING)""")
def p11(spark, d):
    """Running totals with redemptions and fees, a row a day; the window runs over one row a day."""
    from pyspark.sql import Window as W

    p, of = _parsed(spark, d).where("kind <> 'Unknown'"), lambda k: F.col("kind") == k
    n = lambda f: F.col(f"payload.{f}").cast("decimal(38,0)")
    days = p.groupBy(M.trunc("day").alias("day")).agg(
        F.count(F.when(of("AtomCreated"), 1)).alias("atoms"), F.count(F.when(of("TripleCreated"), 1)).alias("triples"), F.sum(F.when(of("Deposited"), n("assets_after_fees")).otherwise(0)).alias("deposited"),
        F.sum(F.when(of("Redeemed"), n("assets")).otherwise(0)).alias("redeemed"), F.sum(F.when(of("ProtocolFeeAccrued"), n("amount")).otherwise(0)).alias("fees"),
    )
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.select(F.date_format("day", "yyyy-MM-dd").alias("day"), *[F.sum(c).over(w).cast("long").alias(c) for c in ("atoms", "triples", "deposited", "redeemed", "fees")])


@query("p12_account_stats", "SELECT CAST(who AS VARCHAR) AS account, CAST(sum(own) AS BIGINT) AS deposited, CAST(sum(own + given + taken) AS BIGINT) AS volume, CAST(sum(taken) AS BIGINT) AS redeemed FROM (SELECT recipient AS who, net AS own, 0 AS given, 0 AS taken FROM good WHERE name = 'Deposited' UNION ALL SELECT account, 0, net, 0 FROM good WHERE name = 'Deposited' AND account <> recipient UNION ALL SELECT account, 0, 0, amount FROM good WHERE name = 'Redeemed') GROUP BY who")
def p12(spark, d):
    """Deposits count for who receives them; who deposits for another has the volume only."""
    p = _parsed(spark, d).where(F.col("kind").isin("Deposited", "Redeemed"))
    net, out = F.col("payload.assets_after_fees").cast("decimal(38,0)"), F.col("payload.assets").cast("decimal(38,0)")
    row = lambda who, own, given, taken: F.struct(F.col(f"payload.{who}").alias("account"), *[(x if not isinstance(x, int) else F.lit(x)).cast("decimal(38,0)").alias(n) for n, x in (("own", own), ("given", given), ("taken", taken))])
    came = F.array_compact(F.array(row("receiver", net, 0, 0), F.when(F.col("payload.sender") != F.col("payload.receiver"), row("sender", 0, net, 0))))
    rows = p.select(F.explode(F.when(F.col("kind") == "Deposited", came).otherwise(F.array(row("sender", 0, 0, out)))).alias("r")).select("r.*")
    return rows.groupBy("account").agg(F.sum("own").cast("long").alias("deposited"), F.sum(F.col("own") + F.col("given") + F.col("taken")).cast("long").alias("volume"), F.sum("taken").cast("long").alias("redeemed"))


@query("p13_activity_marker", "SELECT DISTINCT CAST(account AS VARCHAR) AS account, reason FROM touched WHERE reason <> 'fee'")
def p13(spark, d):
    """Sender and receiver are both marked where they differ."""
    return E.accounts_of(_parsed(spark, d)).where("reason <> 'fee'").select("account", "reason").distinct()


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return G.applied(G.operations(_parsed(spark, d)))


@query("p14_graph_atoms", "SELECT 'atom:T' || seq AS key, CASE seq % 4 WHEN 0 THEN 'Atom ' || seq WHEN 1 THEN '0x4100' WHEN 2 THEN '0xfffe' ELSE 'none' END AS data, CAST(account AS VARCHAR) AS creator FROM good WHERE name = 'AtomCreated'")
def p14(spark, d):
    return _graph(spark, d)[0].where("kind = 'atom'").select("key", F.col("fields.data").alias("data"), F.col("fields.creator").alias("creator"))


@query("p15_draft_reconcile", """f AS (SELECT term_id || ' P' || curve || ' T' || (seq % 7) AS spo, min('R' || seq) AS fact FROM good WHERE name = 'TripleCreated' GROUP BY 1), d AS (SELECT 'D' || seq AS id, 'T' || (seq % 10) || ' P' || (seq % 3) || ' T' || (seq % 7) AS spo FROM ev)
SELECT d.id AS key, coalesce(f.fact, d.id) AS target, f.fact IS NOT NULL AS became FROM d LEFT JOIN f USING (spo)""")
def p15(spark, d):
    """Drafts give way to facts of the same subject, predicate and object; what refers to them follows."""
    t = E.typed(_parsed(spark, d), "TripleCreated")
    facts = t.select(F.col("term_id").alias("id"), F.col("subject_id").alias("subject"), F.col("predicate_id").alias("predicate"), F.col("object_id").alias("object"))
    named = lambda prefix, m: F.concat(F.lit(prefix), (F.col("seq") % m).cast("string"))
    drafts = L.event_store(spark, d).select(F.concat(F.lit("D"), F.col("seq").cast("string")).alias("id"), named("T", 10).alias("subject"), named("P", 3).alias("predicate"), named("T", 7).alias("object"))
    left, moved = G.reconciled(drafts, facts, drafts.select(F.col("id").alias("key"), F.col("id").alias("target")))
    kept = left.select(F.col("id").alias("key"), F.lit(True).alias("draft"))
    return moved.join(kept, "key", "left").select("key", "target", F.col("draft").isNull().alias("became"))


@query("p16_graph_flows", """SELECT key, kind, CAST(sum(CASE WHEN what = 'deposited' THEN x END) AS BIGINT) AS deposited, CAST(sum(CASE WHEN what = 'shares' THEN x END) AS BIGINT) AS shares, CAST(sum(CASE WHEN what = 'assets' THEN x END) AS BIGINT) AS assets FROM (
SELECT 'account:' || recipient AS key, 'account' AS kind, 'deposited' AS what, net AS x FROM good WHERE name = 'Deposited' UNION ALL SELECT 'account:' || account, 'account', 'deposited', -amount FROM good WHERE name = 'Redeemed'
UNION ALL SELECT 'position:' || recipient || ':' || term_id || ':' || curve, 'position', 'shares', half FROM good WHERE name = 'Deposited' UNION ALL SELECT 'position:' || account || ':' || term_id || ':' || curve, 'position', 'shares', -half FROM good WHERE name = 'Redeemed'
UNION ALL SELECT 'vault:' || term_id || ':' || curve, 'vault', unnest(['assets', 'shares']), unnest([net, half]) FROM good WHERE name = 'Deposited' UNION ALL SELECT 'vault:' || term_id || ':' || curve, 'vault', unnest(['assets', 'shares']), unnest([-amount, -half]) FROM good WHERE name = 'Redeemed') GROUP BY ALL""")
def p16(spark, d):
    """Sums of deposits and, negative, of redemptions (P17) on accounts, positions and vaults."""
    n = lambda k: F.col("amounts")[k].cast("long").alias(k)
    return _graph(spark, d)[0].where("amounts IS NOT NULL").select("key", "kind", n("deposited"), n("shares"), n("assets"))


@query("p17_graph_edges", "SELECT 'flow:' || seq || '-0' AS key, 'flow' AS kind, 'account:' || CASE WHEN name = 'Deposited' THEN recipient ELSE account END AS source, 'vault:' || term_id || ':' || curve AS target, CASE WHEN name = 'Deposited' THEN net ELSE -amount END AS assets FROM good WHERE name IN ('Deposited', 'Redeemed') UNION ALL SELECT 'triple:R' || seq, 'triple', 'atom:' || term_id, 'atom:T' || (seq % 7), NULL FROM good WHERE name = 'TripleCreated'")
def p17(spark, d):
    return _graph(spark, d)[1].select("key", "kind", "source", "target", F.col("fields")["assets"].cast("long").alias("assets"))


@query("p18_graph_prices", "SELECT 'vault:' || term_id || ':' || curve AS key, CAST(arg_max(amount % 500 + 1, seq) AS VARCHAR) || '000000000000000000' AS price, CAST(arg_max(amount, seq) AS BIGINT) AS total_assets FROM good WHERE name = 'SharePriceChanged' GROUP BY 1")
def p18(spark, d):
    fields = F.col("fields")
    return _graph(spark, d)[0].where(F.col("kind") == "vault").where(fields["price"].isNotNull()).select("key", fields["price"].alias("price"), fields["total_assets"].cast("long").alias("total_assets"))


@query("a8_graph_sink_ops", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'account' AS kind, account AS k FROM (SELECT account FROM good WHERE name IN ('AtomCreated', 'TripleCreated', 'Redeemed', 'ProtocolFeeAccrued') UNION ALL SELECT recipient FROM good WHERE name = 'Deposited') UNION ALL SELECT DISTINCT 'atom', seq FROM good WHERE name = 'AtomCreated') GROUP BY kind")
def a8(spark, d):
    return _graph(spark, d)[0].where(F.col("kind").isin("account", "atom")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- sinks ------------------------------------------------------------------


@query("a7_keyed_upsert", "SELECT account, CAST(max(seq) AS BIGINT) AS last_seq, arg_max(amount, seq) AS amount FROM ev GROUP BY account")
def a7(spark, d):
    """Three batches, newest first and the middle one twice, with a compaction between: the last row of each key stays."""
    ev = L.event_store(spark, d)
    batches = [ev.where(f"ts >= TIMESTAMP_NTZ'{a}' AND ts < TIMESTAMP_NTZ'{b}'").select("account", F.col("seq").alias("last_seq"), "amount") for a, b in (("2024-01-20", "9999-01-01"), ("2024-01-10", "2024-01-20"), ("0001-01-01", "2024-01-10"))]
    sink = MergeTable(spark, f"{shared_folder(spark)}/upsert-{uuid.uuid4().hex}", batches[0].schema, ["account"], {"amount": "latest"}, "last_seq", buckets=_BUCKETS)
    for number in (0, 1, 1):
        sink.write(batches[number], number)
    sink.compact(2)
    for number in (1, 2):
        sink.write(batches[number], number)
    return sink.read()


@query("a11_checkpoints", "SELECT name AS projection, sink, CAST(max(seq) AS BIGINT) AS last_seq, CAST(max(seq) * 3 AS BIGINT) AS block FROM good, (VALUES ('market'), ('graph')) s(sink) GROUP BY ALL")
def a11(spark, d):
    """The last event and block of each projection in each sink; a batch that is applied again moves nothing back."""
    p = _parsed(spark, d).where("kind <> 'Unknown'")
    marks = p.groupBy(F.col("kind").alias("projection")).agg(F.max("seq").alias("last_seq"), F.max("block_number").alias("block"))
    marks = marks.crossJoin(F.broadcast(spark.createDataFrame([("market",), ("graph",)], "sink string"))).select("projection", "sink", "last_seq", "block")
    sink = MergeTable(spark, f"{shared_folder(spark)}/marks-{uuid.uuid4().hex}", marks.schema, ["projection", "sink"], {"last_seq": "max", "block": "max"}, buckets=_BUCKETS)
    sink.write(marks, 0)
    sink.write(sink.read().withColumns({"last_seq": F.col("last_seq") - 5, "block": F.col("block") - 15}), 1)
    return sink.read()


@query("m10_account_pnl_state", "SELECT account, CAST(sum(assets_in) AS BIGINT) AS deposited, CAST(sum(assets_out) AS BIGINT) AS withdrawn, CAST(sum(assets_out) - sum(assets_in) AS BIGINT) AS net, CAST(max(seq) AS BIGINT) AS last_seq, 2 AS snapshots FROM chg GROUP BY account")
def m10(spark, d):
    """Sums of what two batches bring, each batch twice, and a snapshot after each: the state is the sum, a snapshot is kept once."""
    root = f"{shared_folder(spark)}/pnl-{uuid.uuid4().hex}"
    changes = L.position_changes(L.event_store(spark, d))
    sums = lambda rows: rows.groupBy("account").agg(F.sum("assets_in").alias("deposited"), F.sum("assets_out").alias("withdrawn"), F.max("seq").alias("last_seq"))
    halves = [sums(changes.where(f"ts {side} TIMESTAMP_NTZ'2024-01-16'")) for side in ("<", ">=")]
    state = MergeTable(spark, f"{root}/state", halves[0].schema, ["account"], {"deposited": "sum", "withdrawn": "sum", "last_seq": "max"}, buckets=_BUCKETS)
    taken = None
    for number in (0, 0, 1, 1):
        state.write(halves[number], number)
        snapshot = state.read().select("account", F.lit(number).alias("at"), (F.col("withdrawn") - F.col("deposited")).alias("net"))
        taken = taken or MergeTable(spark, f"{root}/snapshots", snapshot.schema, ["account", "at"], {"net": "max"}, buckets=_BUCKETS)
        taken.write(snapshot, number)
    last = taken.read().groupBy("account").agg(F.max_by("net", "at").alias("net"), (F.max("at") + 1).cast("int").alias("snapshots"))
    return state.read().join(last, "account").select("account", "deposited", "withdrawn", "net", "last_seq", "snapshots")


@query("f_json_merge", """SELECT page_id, '1' AS a, CASE WHEN page_id % 2 = 0 THEN 'new' ELSE 'old' END AS b, CASE WHEN page_id % 2 = 0 THEN CAST(page_id AS VARCHAR) END AS c FROM pages""")
def f_merge(spark, d):
    right = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('{"b": "new", "c": '), F.col("page_id").cast("string"), F.lit("}")))
    merged = json_merge(F.lit('{"a": 1, "b": "old"}'), right)
    return table(spark, d, "pages").select("page_id", *[F.get_json_object(merged, f"$.{k}").alias(k) for k in "abc"])


# --- K18: leases ------------------------------------------------------------

#: What stage a page's node is in: status, attempts, minutes until the lease ends, error.
_STATES = (
    ("pending", 0, None, None), ("processing", 1, 10, None), ("processing", 1, -10, None), ("processing", 3, -10, None), ("failed", 1, None, '{"code": "NET", "retriable": true}'), ("failed", 1, None, '{"code": "BAD", "retriable": false}'),
    ("completed", 1, None, None), ("skipped", 0, None, '{"code": "SKIPPED"}'), ("failed", 3, None, '{"code": "MAX_ATTEMPTS_EXCEEDED"}'), ("failed", 4, None, '{"code": "X", "details": {"maxAttempts": 4}}'),
)


def _now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _case(values: list, cast: str = "STRING") -> str:
    return f"CAST(CASE page_id % {len(_STATES)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)) for i, v in enumerate(values)) + f" END AS {cast})"


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes whose first stage is as above; the second one waits for it."""
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), "page_id", (_now() - F.make_interval(mins=F.col("page_id").cast("int"))).alias("created_at"))
    minutes = F.expr(_case([s[2] for s in _STATES], "INT"))
    first = dict(status=F.expr(_case([s[0] for s in _STATES])), attempts=F.expr(_case([s[1] for s in _STATES], "INT")), started_at=F.lit(None).cast("timestamp"), lease_until=_now() + F.make_interval(mins=minutes), error=F.expr(_case([s[3] for s in _STATES])), run=F.when(minutes.isNotNull(), F.concat(F.lit("run"), F.col("page_id").cast("string"))))
    waiting = dict(status=F.lit("pending"), attempts=F.lit(0), started_at=F.lit(None).cast("timestamp"), lease_until=F.lit(None).cast("timestamp"), error=F.lit(None).cast("string"), run=F.lit(None).cast("string"))
    out = pages.select("id", "created_at", *[v.alias(f"parse_{k}") for k, v in first.items()], *[v.alias(f"classification_{k}") for k, v in waiting.items()], *[v.alias(f"enrichment_{k}") for k, v in waiting.items()])
    return out


def _shown(nodes: DataFrame, stage: str = "parse") -> DataFrame:
    until = F.date_format(f"{stage}_lease_until", "HH:mm").alias("until")
    return nodes.select("id", F.col(f"{stage}_status").alias("status"), F.col(f"{stage}_attempts").cast("long").alias("attempts"), until, F.get_json_object(f"{stage}_error", "$.code").alias("code"), F.col(f"{stage}_run").alias("run"))


_CODES = [None if s[3] is None else s[3].split('"')[3] for s in _STATES]
_UNTIL = {10: "00:10", -10: "23:50", None: None}


def _expected(**changes: tuple[list[int], object]) -> str:
    """The oracle: the states as they are, with other values where an operation changes them (shape numbers, value)."""
    given = {"status": [s[0] for s in _STATES], "attempts": [s[1] for s in _STATES], "until": [_UNTIL[s[2]] for s in _STATES], "code": list(_CODES), "run": ["run#" if s[2] is not None else None for s in _STATES]}
    for field, (shapes, value) in changes.items():
        for i in shapes:
            given[field][i] = value(given[field][i]) if callable(value) else value
    run = f"replace({_case(given['run'])}, '#', CAST(page_id AS STRING))"
    return f"SELECT page_id AS id, {_case(given['status'])} AS status, {_case(given['attempts'], 'BIGINT')} AS attempts, {_case(given['until'])} AS until, {_case(given['code'])} AS code, {run} AS run FROM pages"


def _all(nodes: DataFrame, **more) -> DataFrame:
    """An answer of the run of every node that has one, and one of a run that lost its lease."""
    rows = nodes.where("parse_run IS NOT NULL").select("id", F.col("parse_run").alias("run"), *[v.alias(k) for k, v in more.items()])
    return rows.unionByName(nodes.select("id", F.lit("other").alias("run"), *[v.alias(k) for k, v in more.items()]))


@query("k18_claim", _expected(status=([0, 2, 4], "processing"), attempts=([0, 2, 4], lambda n: n + 1), until=([0, 2, 4], "00:05"), code=([4], None), run=([0, 2, 4], "a#")))
def k18_claim(spark, d):
    nodes = _nodes(spark, d)
    requests = nodes.select("id", F.concat(F.lit("b"), F.col("id").cast("string")).alias("run")).unionByName(nodes.select("id", F.concat(F.lit("a"), F.col("id").cast("string")).alias("run")))
    return _shown(leases.claim(nodes, requests, "parse", _now(), 300, 3))


@query("k18_claim_next_stage", f"SELECT page_id AS id, CASE WHEN page_id % {len(_STATES)} = 6 THEN 'processing' ELSE 'pending' END AS status FROM pages")
def k18_next(spark, d):
    nodes = _nodes(spark, d)
    return leases.claim(nodes, nodes.select("id", F.lit("r").alias("run")), "classification", _now(), 300, 3).select("id", F.col("classification_status").alias("status"))


@query("k18_candidates", f"SELECT page_id AS id FROM pages WHERE page_id % {len(_STATES)} IN (0, 2, 4) ORDER BY page_id DESC LIMIT 40")
def k18_list(spark, d):
    return leases.candidates(_nodes(spark, d), "parse", _now(), 3, 40, failed_too=True).select("id")


@query("k18_complete", _expected(status=([1, 2, 3], "completed"), until=([1, 2, 3], None)))
def k18_complete(spark, d):
    nodes = _nodes(spark, d)
    return _shown(leases.complete(nodes, _all(nodes), "parse"))


@query("k18_fail", _expected(status=([1, 2, 3], "failed"), until=([1, 2, 3], None), code=([1, 2, 3], "NEW")))
def k18_fail(spark, d):
    nodes = _nodes(spark, d)
    return _shown(leases.fail(nodes, _all(nodes, error=F.lit('{"code": "NEW", "retriable": true}')), "parse"))


@query("k18_skip", _expected(status=([1, 2, 3], "skipped"), until=([1, 2, 3], None), code=([1, 2, 3], "SKIPPED")))
def k18_skip(spark, d):
    nodes = _nodes(spark, d)
    return _shown(leases.skip(nodes, _all(nodes, reason=F.lit("no use")), "parse"))


@query("k18_release", _expected(status=([1, 2, 3], "pending"), attempts=([1, 2, 3], lambda n: n - 1), until=([1, 2, 3], None), run=([1, 2, 3], None)))
def k18_release(spark, d):
    nodes = _nodes(spark, d)
    return _shown(leases.release(nodes, _all(nodes), "parse"))


@query("k18_renew", _expected(until=([1], "01:00")))
def k18_renew(spark, d):
    nodes = _nodes(spark, d)
    return _shown(leases.renew(nodes, _all(nodes), "parse", _now(), 3600))


@query("k18_reap", _expected(status=([3], "failed"), until=([3], None), code=([3], "MAX_ATTEMPTS_EXCEEDED")))
def k18_reap(spark, d):
    return _shown(leases.reap(_nodes(spark, d), "parse", _now(), 3))


@query("k18_requeue", _expected(status=([0, 2, 3, 4, 5, 6, 7, 8, 9], "pending"), attempts=([0, 2, 3, 4, 5, 6, 7, 8, 9], 0), until=([2, 3], None), code=([4, 5, 7, 8, 9], None), run=([2, 3], None)))
def k18_requeue(spark, d):
    nodes = _nodes(spark, d)
    return _shown(leases.requeue(nodes, nodes, "parse", _now()))


@query("k18_reset", _expected(status=([4, 5, 7, 8, 9], "pending"), attempts=([4, 5, 7, 8, 9], 0), code=([4, 5, 7, 8, 9], None)))
def k18_reset(spark, d):
    return _shown(leases.reset(_nodes(spark, d), "parse"))


@query("k19_stage_dead_letters", f"SELECT page_id AS id FROM pages WHERE page_id % {len(_STATES)} IN (8, 9)")
def k19(spark, d):
    return leases.dead_letters(_nodes(spark, d), "parse").select("id")
