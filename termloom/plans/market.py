"""Queries of sources, projections and market analytics."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.operators import market as M
from termloom.operators.ranking import with_position
from termloom.plans.base import AS_OF, query, stamp, table
from termloom.session import shared_folder
from termloom.sources import ledger as L
from termloom.sources import sinks
from termloom.sources.history import Marks
from termloom.sources.merge_table import MergeTable

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
START, END = "2024-01-10 00:00:00", "2024-01-24 12:00:00"


def _ev(spark: SparkSession, d: str) -> DataFrame:
    return L.event_store(spark, d)


# --- A: sources and sinks ---------------------------------------------------


@query("a3_bulk_insert_dedupe", "SELECT seq, account, event_type, row_number() OVER (ORDER BY ts, seq) AS number FROM ev")
def a3(spark, d):
    """Two deliveries, the second half of the events in both: each event once, numbered without gaps in the order of time."""
    ev = _ev(spark, d)
    twice = ev.unionByName(ev.where("ts >= TIMESTAMP_NTZ'2024-01-15'")).select("ts", "seq", "account", "event_type")
    return with_position(twice.dropDuplicates(["seq", "account", "event_type"]), ["ts", "seq"], "number").select("seq", "account", "event_type", "number")


@query("a4_sequence_lookup", "SELECT o_orderkey AS pos, ev.seq, ev.account FROM orders JOIN ev ON ev.seq = o_custkey")
def a4(spark, d):
    """A whole batch of lookups by number: the orders' customer keys stand for the numbers asked for, with repeats and some that no event has."""
    wanted = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("seq"))
    return wanted.join(_ev(spark, d), "seq").select("pos", "seq", "account")


@query("a5_raw_event_scan", "SELECT seq, account, event_type FROM ev WHERE event_type IN ('purchase', 'error') AND seq > 2000 ORDER BY seq LIMIT 500")
def a5(spark, d):
    return _ev(spark, d).where(F.col("event_type").isin("purchase", "error") & (F.col("seq") > 2000)).select("seq", "account", "event_type").orderBy("seq").limit(500)


@query("a13_rollup_rows", f"SELECT {STAMP.format('bucket')} AS bucket, term, curve, close_price FROM ohlc WHERE term = 3 ORDER BY ohlc.bucket DESC, curve LIMIT 100")
def a13(spark, d):
    return M.price_stats(L.price_ticks(_ev(spark, d)).where("term = 3")).orderBy(F.desc("bucket"), "curve").limit(100).select(stamp("bucket"), "term", "curve", "close_price")


@query("a15_artifact_writer", """SELECT 'artifact:' || sha256(CAST(to_json({'artifactKind': 'webpage', 'artifactVersion': '1', 'nodeId': CAST(page_id AS VARCHAR), 'sourceHash': sha256(coalesce(html, '')), 'sourceUri': url}) AS VARCHAR)) AS id,
CAST(page_id AS VARCHAR) AS node_id, 'webpage' AS kind, url AS source_uri, sha256(coalesce(html, '')) AS source_hash, 2 AS written FROM pages""")
def a15(spark, d):
    """Artifact rows whose id is a hash of what they are made from, in order of the names: the same artifact written by two batches, one of which comes twice, is one row."""
    text = lambda c: c.cast("string")
    made = table(spark, d, "pages").select(text(F.col("page_id")).alias("node_id"), F.lit("webpage").alias("kind"), F.col("url").alias("source_uri"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("source_hash"))
    material = F.to_json(F.struct(F.col("kind").alias("artifactKind"), F.lit("1").alias("artifactVersion"), F.col("node_id").alias("nodeId"), F.col("source_hash").alias("sourceHash"), F.col("source_uri").alias("sourceUri")), {"ignoreNullFields": "false"})
    rows = made.select(F.concat(F.lit("artifact:"), F.sha2(material, 256)).alias("id"), "*", F.lit(1).alias("written"))
    sink = MergeTable(spark, f"{shared_folder(spark)}/artifacts-{uuid.uuid4().hex}", rows.schema, ["id"], {"node_id": "max", "kind": "max", "source_uri": "max", "source_hash": "max", "written": "sum"}, buckets=8)
    for batch in (0, 0, 1):
        sink.write(rows, batch)
    return sink.read()


# --- P: projections ---------------------------------------------------------


@query("p4_vault_state", "SELECT f.*, coalesce(l.share_price, 0) AS share_price, coalesce(l.total_shares, 0) AS total_shares, coalesce(l.total_shares * l.share_price, 0) AS market_cap FROM (SELECT term, curve, CAST(sum(assets_in) - sum(assets_out) AS BIGINT) AS total_deposits, CAST(sum(assets_out) AS BIGINT) AS total_redemptions FROM chg GROUP BY ALL) f LEFT JOIN latest l USING (term, curve)")
def p4(spark, d):
    ev = _ev(spark, d)
    flows = L.position_changes(ev).groupBy("term", "curve").agg((F.sum("assets_in") - F.sum("assets_out")).alias("total_deposits"), F.sum("assets_out").alias("total_redemptions"))
    state = flows.join(M.latest_prices(L.price_ticks(ev)), ["term", "curve"], "left").fillna(0, ["share_price", "total_shares"])
    return state.select("term", "curve", "total_deposits", "total_redemptions", "share_price", "total_shares", (F.col("total_shares") * F.col("share_price")).alias("market_cap"))


@query("p8_position_tracking", """r AS (SELECT *, sum(shares_delta) OVER w AS shares_after, coalesce(CAST(sum(assets_in) OVER w AS DOUBLE) / nullif(CAST(sum(greatest(shares_delta, 0)) OVER w AS DOUBLE), 0), 0) AS cost_basis FROM chg WINDOW w AS (PARTITION BY account, term, curve ORDER BY ts, seq ROWS UNBOUNDED PRECEDING))
SELECT account, term, curve, CAST(sum(shares_delta) AS BIGINT) AS shares, CAST(sum(assets_in) AS BIGINT) AS deposited, round(last(cost_basis ORDER BY ts, seq), 6) AS cost_basis, round(sum(CASE WHEN shares_delta < 0 THEN assets_out + shares_delta * cost_basis ELSE 0 END), 4) AS realized_pnl, last(shares_after ORDER BY ts, seq) <= 0 AS closed FROM r GROUP BY ALL""")
def p8(spark, d):
    at = F.struct("ts", "seq")
    folded = M.fold_positions(L.position_changes(_ev(spark, d)))
    return folded.groupBy(*M.POSITION).agg(
        F.sum("shares_delta").alias("shares"), F.sum("assets_in").alias("deposited"), F.round(F.max_by("cost_basis", at), 6).alias("cost_basis"), F.round(F.sum("realized"), 4).alias("realized_pnl"), (F.max_by("shares_after", at) <= 0).alias("closed"))


@query("p9_signals", "SELECT seq, account, term, curve, assets AS delta, 'deposit' AS signal_type FROM dep UNION ALL SELECT seq, account, term, curve, assets, 'redemption' FROM red")
def p9(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "deposit").otherwise("redemption")
    return _ev(spark, d).where(F.col("event_type").isin("purchase", "error")).select("seq", "account", "term", "curve", F.col("amount").alias("delta"), kind.alias("signal_type"))


@query("p10_term_aggregates", "SELECT 'predicate_object' AS kind, predicate || ':' || object AS key, count(*) AS n FROM triple GROUP BY ALL UNION ALL SELECT 'subject_predicate', subject || ':' || predicate, count(*) FROM triple GROUP BY ALL")
def p10(spark, d):
    keys = F.explode(F.array(F.struct(F.lit("predicate_object").alias("kind"), F.concat_ws(":", "predicate", "object").alias("key")), F.struct(F.lit("subject_predicate").alias("kind"), F.concat_ws(":", "subject", "predicate").alias("key")))).alias("k")
    return L.triples_created(_ev(spark, d)).select(keys).groupBy("k.kind", "k.key").agg(F.count(F.lit(1)).alias("n"))


@query("p11_protocol_stats", f"""b AS (SELECT date_trunc('day', ts) AS day, count(*) FILTER (event_type = 'signup') AS atoms, count(*) FILTER (event_type = 'view') AS triples, count(*) FILTER (event_type = 'purchase') AS deposits, CAST(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE 0 END) AS BIGINT) AS volume FROM ev GROUP BY 1)
SELECT {STAMP.format('day')} AS day, CAST(sum(atoms) OVER w AS BIGINT) AS total_atoms, CAST(sum(triples) OVER w AS BIGINT) AS total_triples, CAST(sum(deposits) OVER w AS BIGINT) AS total_deposits, CAST(sum(volume) OVER w AS BIGINT) AS total_volume FROM b WINDOW w AS (ORDER BY b.day ROWS UNBOUNDED PRECEDING)""")
def p11(spark, d):
    """A history row per batch (a day); the window runs over one row a day."""
    of = lambda t: F.col("event_type") == t
    days = _ev(spark, d).groupBy(M.trunc("day").alias("day")).agg(F.count(F.when(of("signup"), 1)).alias("atoms"), F.count(F.when(of("view"), 1)).alias("triples"), F.count(F.when(of("purchase"), 1)).alias("deposits"), F.sum(F.when(of("purchase"), F.col("amount")).otherwise(0)).alias("volume"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    return days.select(stamp("day"), *[F.sum(c).over(w).alias(f"total_{c}") for c in ("atoms", "triples", "deposits", "volume")])


@query("p12_leaderboard_marker", f"SELECT account, count(DISTINCT term * 2 + curve) AS dirty_vaults, CAST(sum(assets_in) AS BIGINT) AS total_deposits, CAST(sum(assets_out) AS BIGINT) AS total_redemptions, CAST(sum(assets_in + assets_out) AS BIGINT) AS total_volume, {STAMP.format('max(ts)')} AS last_activity FROM chg GROUP BY account")
def p12(spark, d):
    return L.position_changes(_ev(spark, d)).groupBy("account").agg(
        F.countDistinct(F.col("term") * 2 + F.col("curve")).alias("dirty_vaults"), F.sum("assets_in").alias("total_deposits"), F.sum("assets_out").alias("total_redemptions"), F.sum(F.col("assets_in") + F.col("assets_out")).alias("total_volume"), F.max("ts").alias("last_activity"),
    ).withColumn("last_activity", stamp("last_activity"))


def _summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*M.POSITION).agg(F.sum("shares_delta").alias("shares"), F.sum("assets_in").alias("assets_in"), F.sum("assets_out").alias("assets_out"))


def _positions(spark: SparkSession, root: str, changes: DataFrame, by: list[str]) -> MergeTable:
    """Positions as sums of batches, in buckets by some of their keys."""
    schema = _summed(changes).schema
    return MergeTable(spark, root, schema, list(M.POSITION), {c: "sum" for c in schema.names if c not in M.POSITION}, buckets=16, bucket_by=by)


@query("p20_leaderboard_refresh", "dirty AS (SELECT DISTINCT term, curve FROM red WHERE ts >= TIMESTAMP '2024-01-25'), h AS (SELECT DISTINCT p.account FROM pos p JOIN dirty USING (term, curve) WHERE p.shares > 0) SELECT pos.account, CAST(sum(shares) AS BIGINT) AS shares, CAST(sum(assets_in - assets_out) AS BIGINT) AS net_in FROM pos JOIN h USING (account) GROUP BY pos.account")
def p20(spark, d):
    """Dirty vaults of the newest batch, expanded to their holders (M11); of the positions, kept by vault and by account, only their buckets are read."""
    root, changes = f"{shared_folder(spark)}/board-{uuid.uuid4().hex}", L.position_changes(_ev(spark, d))
    by_vault, by_account = (_positions(spark, f"{root}/{name}", changes, by) for name, by in (("vaults", ["term", "curve"]), ("accounts", ["account"])))
    marks = Marks(spark, f"{root}/dirty", StructType.fromDDL("term long, curve long"))
    for number, batch in enumerate((changes.where("ts < TIMESTAMP_NTZ'2024-01-25'"), changes.where("ts >= TIMESTAMP_NTZ'2024-01-25'"))):
        for kept in (by_vault, by_account):
            kept.write(_summed(batch), number)
    marks.mark(batch.where("shares_delta <= 0 AND assets_in = 0").select("term", "curve"), 1)
    dirty = marks.claim("refresh")
    holders = by_vault.lookup(dirty).where("shares > 0").select("account").distinct()
    return by_account.lookup(holders).groupBy("account").agg(F.sum("shares").alias("shares"), F.sum(F.col("assets_in") - F.col("assets_out")).alias("net_in"))


# --- M: market --------------------------------------------------------------


def _ohlc_sql(unit: str) -> str:
    return f"SELECT {STAMP.format(f'''date_trunc('{unit}', ts)''')} AS bucket, term, curve, first(share_price ORDER BY ts, seq) AS open_price, max(share_price) AS high_price, min(share_price) AS low_price, last(share_price ORDER BY ts, seq) AS close_price, last(total_assets ORDER BY ts, seq) AS total_assets, last(total_shares ORDER BY ts, seq) AS total_shares, count(*) AS ticks FROM tick GROUP BY ALL"


for _unit, _name in (("hour", "hourly"), ("day", "daily")):
    query(f"m1_share_price_stats_{_name}", _ohlc_sql(_unit))(lambda spark, d, u=_unit: M.price_stats(L.price_ticks(_ev(spark, d)), u).withColumn("bucket", stamp("bucket")))
    query(f"m2_signal_{_name}", f"SELECT {STAMP.format(f'''date_trunc('{_unit}', ts)''')} AS bucket, account, term, curve, event_type AS signal_type, CAST(sum(amount) AS BIGINT) AS delta, count(*) AS n FROM ev WHERE event_type IN ('purchase', 'error') GROUP BY ALL")(
        lambda spark, d, u=_unit: _ev(spark, d).where(F.col("event_type").isin("purchase", "error")).groupBy(M.trunc(u).alias("bucket"), "account", "term", "curve", F.col("event_type").alias("signal_type")).agg(F.sum("amount").alias("delta"), F.count(F.lit(1)).alias("n")).withColumn("bucket", stamp("bucket")))
    query(f"m3_position_change_{_name}", f"SELECT {STAMP.format(f'''date_trunc('{_unit}', ts)''')} AS bucket, account, term, curve, CAST(sum(shares_delta) AS BIGINT) AS shares_delta, CAST(sum(assets_in) AS BIGINT) AS assets_in, CAST(sum(assets_out) AS BIGINT) AS assets_out, CAST(sum(greatest(shares_delta, 0)) AS BIGINT) AS shares_in, CAST(sum(greatest(-shares_delta, 0)) AS BIGINT) AS shares_out, count(*) AS changes FROM chg GROUP BY ALL")(
        lambda spark, d, u=_unit: M.position_rollup(L.position_changes(_ev(spark, d)), u).withColumn("bucket", stamp("bucket")))


@query("m4_position_cumulative", f"SELECT * REPLACE ({STAMP.format('bucket')} AS bucket) FROM cum")
def m4(spark, d):
    return M.cumulative(M.position_rollup(L.position_changes(_ev(spark, d)))).withColumn("bucket", stamp("bucket"))


@query("m5_cumulative_refresh", f"SELECT * REPLACE ({STAMP.format('bucket')} AS bucket) FROM cum WHERE cum.bucket > (SELECT max(bucket) FROM cum WHERE bucket < TIMESTAMP '2024-01-20 00:00:00')")
def m5(spark, d):
    """Only new buckets are summed; equals the full recomputation from there on."""
    rollup = M.position_rollup(L.position_changes(_ev(spark, d)))
    old = M.cumulative(rollup.where(F.col("bucket") < F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")))
    return M.cumulative_refresh(old, rollup).withColumn("bucket", stamp("bucket"))


def _board_sql(start: str, end: str, sort: str, limit: int, having: str = "TRUE", rank_all: bool = False) -> str:
    return f"""act AS (SELECT DISTINCT account FROM chg WHERE ts >= date_trunc('day', TIMESTAMP '{start}') AND ts < date_trunc('day', TIMESTAMP '{end}') + INTERVAL 1 DAY),
e AS (SELECT account, term, curve, last(cum ORDER BY bucket) AS x FROM cum JOIN act USING (account) WHERE bucket <= date_trunc('hour', TIMESTAMP '{end}') GROUP BY ALL),
s AS (SELECT account, term, curve, last(cum ORDER BY bucket) AS x FROM cum JOIN act USING (account) WHERE bucket <= date_trunc('hour', TIMESTAMP '{start}') GROUP BY ALL),
ps AS (SELECT term, curve, coalesce(last(close_price ORDER BY bucket) FILTER (bucket <= date_trunc('hour', TIMESTAMP '{start}')), first(close_price ORDER BY bucket)) AS p FROM ohlc GROUP BY ALL),
pe AS (SELECT term, curve, coalesce(last(close_price ORDER BY bucket) FILTER (bucket <= date_trunc('hour', TIMESTAMP '{end}')), last(close_price ORDER BY bucket)) AS p FROM ohlc GROUP BY ALL),
q AS (SELECT e.account, e.x.cum_shares AS sh, e.x.cum_assets_in AS ai, e.x.cum_assets_out AS ao, e.x.cum_shares_in AS si, e.x.cum_shares_out AS so, coalesce(s.x.cum_shares, 0) AS sh0, coalesce(s.x.cum_assets_in, 0) AS ai0, coalesce(s.x.cum_assets_out, 0) AS ao0, coalesce(s.x.cum_shares_in, 0) AS si0, coalesce(s.x.cum_shares_out, 0) AS so0, coalesce(ps.p, 0) AS p0, coalesce(pe.p, 0) AS p1
  FROM e LEFT JOIN s USING (account, term, curve) LEFT JOIN ps USING (term, curve) LEFT JOIN pe USING (term, curve)),
pp AS (SELECT account, CAST(sh * p1 - (ai - ao) AS DOUBLE) AS un, (ao - ao0) - (so - so0) * coalesce(ai / nullif(CAST(si AS DOUBLE), 0), 0) AS re, sh > 0 AS act, ai - ai0 AS d, ao - ao0 AS r, sh * p1 AS eq, sh0 * p0 - (ai0 - ao0) + ao0 - so0 * coalesce(ai0 / nullif(CAST(si0 AS DOUBLE), 0), 0) AS st FROM q),
ag AS (SELECT account, sum(un) AS unrealized_pnl, sum(re) AS realized_pnl, sum(un + re) AS total_pnl, count(*) AS positions, count(*) FILTER (act) AS active_positions, count(*) FILTER (un + re > 0) AS winners, count(*) FILTER (un + re < 0) AS losers, CAST(sum(d) AS BIGINT) AS deposits, CAST(sum(r) AS BIGINT) AS redemptions, CAST(sum(d + r) AS BIGINT) AS total_volume, CAST(sum(eq) AS BIGINT) AS equity, max(un + re) AS best_trade, min(un + re) AS worst_trade, sum(st) AS st FROM pp GROUP BY account HAVING {having}),
sc AS (SELECT *, CASE WHEN deposits > 0 THEN total_pnl / deposits * 100 ELSE 0 END AS pnl_pct, CASE WHEN deposits > 0 THEN realized_pnl / deposits * 100 ELSE 0 END AS realized_pct, CASE WHEN deposits > 0 THEN unrealized_pnl / deposits * 100 ELSE 0 END AS unrealized_pct, winners / CAST(positions AS DOUBLE) * 100 AS win_rate, total_pnl - st AS pnl_change FROM ag)
""" + ("" if rank_all else f"""SELECT row_number() OVER (ORDER BY round({sort}, 4) DESC NULLS LAST, account) AS rank, account, positions, active_positions, winners, losers, deposits, redemptions, total_volume, equity, {", ".join(f"round({c}, 4) AS {c}" for c in ("unrealized_pnl", "realized_pnl", "total_pnl", "best_trade", "worst_trade", "pnl_change", "pnl_pct", "realized_pct", "unrealized_pct"))}, round(win_rate, 2) AS win_rate, round(total_pnl / 100.0, 4) AS total_pnl_scaled FROM sc ORDER BY rank LIMIT {limit}""")


@query("m6_pnl_leaderboard", _board_sql(START, END, "total_pnl", 100))
def m6(spark, d):
    ev = _ev(spark, d)
    return M.leaderboard(L.position_changes(ev), L.price_ticks(ev), START, END, scale=100.0)


@query("m6_pnl_leaderboard_filtered", _board_sql("2024-01-20 03:30:00", AS_OF, "win_rate", 25, "count(*) >= 3 AND sum(d + r) >= 1000 AND sum(d) >= 500"))
def m6b(spark, d):
    ev = _ev(spark, d)
    return M.leaderboard(L.position_changes(ev), L.price_ticks(ev), "2024-01-20 03:30:00", AS_OF, limit=25, sort_by="win_rate", min_positions=3, min_volume=1000, min_deposit=500, scale=100.0)


_PERIODS = {"24h": ("2024-01-30 00:00:00", AS_OF), "7d": ("2024-01-24 00:00:00", AS_OF), "30d": ("2024-01-01 00:00:00", AS_OF), "all": ("2000-01-01 00:00:00", AS_OF)}


def _cache_sql() -> str:
    import re

    out, selects = [], []
    for i, (period, (start, end)) in enumerate(_PERIODS.items()):
        body = _board_sql(start, end, "total_pnl", 0, rank_all=True).rstrip()
        for n in ("act", "e", "s", "ps", "pe", "q", "pp", "ag", "sc"):
            body = re.sub(rf"(^|FROM |JOIN )({n})( AS \(| |\b)(?=.*)", lambda m, n=n: f"{m[1]}{n}{i}{m[3]}" if m[1] else f"{n}{i}{m[3]}", body, flags=re.M)
            body = re.sub(rf"\b{n}\.(?=[a-z])", f"{n}{i}.", body)
        out.append(body)
        for key in M.SORT_KEYS:
            value = f"round({key}, {2 if key == 'win_rate' else 4})" if key != "total_volume" else "CAST(total_volume AS DOUBLE)"
            selects.append(f"SELECT '{period}' AS period, account, '{key}' AS sort_key, {value} AS key_value FROM sc{i}")
    return ",\n".join(out) + "\nSELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, sort_key ORDER BY key_value DESC NULLS LAST, account) AS rank FROM (" + " UNION ALL ".join(selects) + ")) WHERE rank <= 100"


@query("m7_leaderboard_cache", _cache_sql())
def m7(spark, d):
    """All four periods, written as the next version of the cache; readers see the version before until it is complete."""
    ev = _ev(spark, d)
    root = f"{shared_folder(spark)}/leaderboard-{uuid.uuid4().hex}"
    sinks.write_version(M.leaderboard_cache(L.position_changes(ev), L.price_ticks(ev), _PERIODS), root)
    return sinks.read_current(spark, root)


@query("m8_leaderboard_current", "v AS (SELECT date_trunc('week', ts) AS version, account, assets FROM dep), a AS (SELECT max(version) AS version FROM v) SELECT v.account, CAST(sum(v.assets) AS BIGINT) AS assets FROM v JOIN a USING (version) GROUP BY v.account")
def m8(spark, d):
    """A board is written anew each week, under its week as version; readers take the newest."""
    rows = L.deposits(_ev(spark, d)).select(M.trunc("week").alias("version"), "account", "assets")
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").groupBy("account").agg(F.sum("assets").alias("assets"))  # the active version is one row


@query("m9_account_pnl", "SELECT account, CAST(sum(shares * coalesce(share_price, 0)) AS BIGINT) AS equity, CAST(sum(shares * coalesce(share_price, 0) - (assets_in - assets_out)) AS BIGINT) AS unrealized, count(*) FILTER (shares * coalesce(share_price, 0) > assets_in - assets_out) AS winners, count(*) FILTER (shares * coalesce(share_price, 0) < assets_in - assets_out) AS losers FROM pos LEFT JOIN latest USING (term, curve) GROUP BY account")
def m9(spark, d):
    ev = _ev(spark, d)
    pos = L.position_changes(ev).groupBy(*M.POSITION).agg(F.sum("shares_delta").alias("shares"), (F.sum("assets_in") - F.sum("assets_out")).alias("net"))
    value = F.col("shares") * F.coalesce("share_price", F.lit(0))
    return pos.join(M.latest_prices(L.price_ticks(ev)), ["term", "curve"], "left").groupBy("account").agg(
        F.sum(value).alias("equity"), F.sum(value - F.col("net")).alias("unrealized"), F.count(F.when(value > F.col("net"), 1)).alias("winners"), F.count(F.when(value < F.col("net"), 1)).alias("losers"))


@query("m12_market_caps", "SELECT term, CAST(sum(total_shares * share_price) AS BIGINT) AS market_cap, count(*) AS vaults FROM latest GROUP BY term")
def m12(spark, d):
    return M.latest_prices(L.price_ticks(_ev(spark, d))).groupBy("term").agg(F.sum(F.col("total_shares") * F.col("share_price")).alias("market_cap"), F.count(F.lit(1)).alias("vaults"))


@query("m13_cap_history_repair", "SELECT t.seq, t.term, t.total_shares * t.share_price AS market_cap, ev.amount AS stale FROM tick t JOIN ev ON ev.seq = t.seq WHERE t.total_shares * t.share_price <> ev.amount")
def m13(spark, d):
    ev = _ev(spark, d)
    history = ev.where("event_type = 'click'").select("seq", F.col("amount").alias("stale"))
    cap = F.col("total_shares") * F.col("share_price")
    return L.price_ticks(ev).join(history, "seq").where(cap != F.col("stale")).select("seq", "term", cap.alias("market_cap"), "stale")


@query("m14_snapshot_repair", "SELECT l.term, l.curve, l.share_price, coalesce(h.n, 0) AS holder_count FROM latest l LEFT JOIN (SELECT term, curve, count(*) AS n FROM pos WHERE shares > 0 GROUP BY ALL) h USING (term, curve)")
def m14(spark, d):
    ev = _ev(spark, d)
    holders = L.position_changes(ev).groupBy("term", "curve", "account").agg(F.sum("shares_delta").alias("s")).where("s > 0").groupBy("term", "curve").agg(F.count(F.lit(1)).alias("n"))
    return M.latest_prices(L.price_ticks(ev)).join(holders, ["term", "curve"], "left").select("term", "curve", "share_price", F.coalesce("n", F.lit(0)).alias("holder_count"))


@query("m15_sequence_backfill", "SELECT d.account, strftime(d.ts, '%Y-%m-%d') AS day, CAST(min(ev.seq) AS BIGINT) AS first_seq, count(*) AS n FROM dep d JOIN ev ON ev.account = d.account AND ev.ts = d.ts AND ev.amount = d.assets GROUP BY ALL")
def m15(spark, d):
    ev = _ev(spark, d)
    typed = L.deposits(ev).select("account", "ts", F.col("assets").alias("amount"))
    return typed.join(ev.select("account", "ts", "amount", "seq"), ["account", "ts", "amount"]).groupBy("account", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("n"))


@query("m16_net_flows", f"SELECT coalesce(d.term, r.term) AS term, coalesce(d.a, 0) AS deposited, coalesce(r.a, 0) AS redeemed, coalesce(d.a, 0) - coalesce(r.a, 0) AS net_flow FROM (SELECT term, CAST(sum(assets) AS BIGINT) AS a FROM dep WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY term) d FULL JOIN (SELECT term, CAST(sum(assets) AS BIGINT) AS a FROM red WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY GROUP BY term) r USING (term)")
def m16(spark, d):
    ev = _ev(spark, d).where(F.col("ts") >= F.expr(f"TIMESTAMP_NTZ'{AS_OF}' - INTERVAL 7 DAY"))
    side = lambda df, name: df.groupBy("term").agg(F.sum("assets").alias(name))
    both = side(L.deposits(ev), "deposited").join(side(L.redemptions(ev), "redeemed"), "term", "full").fillna(0)
    return both.withColumn("net_flow", F.col("deposited") - F.col("redeemed"))


@query("m17_checkpoint_lag", "c AS (SELECT event_type AS projection, max(seq) AS last_seq FROM ev WHERE ts < TIMESTAMP '2024-01-25' GROUP BY 1), h AS (SELECT max(seq) AS head FROM ev) SELECT projection, CAST(head - last_seq AS BIGINT) AS lag FROM c CROSS JOIN h")
def m17(spark, d):
    ev = _ev(spark, d)
    head = ev.agg(F.max("seq").alias("head"))
    marks = ev.where("ts < TIMESTAMP_NTZ'2024-01-25'").groupBy(F.col("event_type").alias("projection")).agg(F.max("seq").alias("last_seq"))
    return marks.crossJoin(F.broadcast(head)).select("projection", (F.col("head") - F.col("last_seq")).alias("lag"))  # head is one row
