"""Queries of user-behaviour analytics."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from termloom.operators import behavior as B
from termloom.operators.activity_batch import ActivityBatch
from termloom.operators.market import trunc
from termloom.plans.base import AS_OF, query, stamp, table
from termloom.session import shared_folder
from termloom.sources import ledger as L
from termloom.sources.history import History, Marks
from termloom.sources.merge_table import MergeTable

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
NOW = f"TIMESTAMP '{AS_OF}'"


def _daily(spark, d):
    return B.daily_activity(L.event_store(spark, d))


def _profile(spark, d):
    return B.profiles(_daily(spark, d), AS_OF, windows=(7, 14, 30), active_days=20)  # the tables hold one month


def _seen(spark, d):
    return L.event_store(spark, d).where("event_type <> 'click'").groupBy("account").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("n1_aggregate_day", "SELECT account, atoms, triples, deposits, redemptions, deposit_volume, redemption_volume, unique_vaults, deposit_volume - redemption_volume AS net_flow FROM daily WHERE day = TIMESTAMP '2024-01-15 00:00:00'")
def n1(spark, d):
    """One UTC day, as a half-open range on the raw time column so that files are pruned by it."""
    day = F.expr("TIMESTAMP_NTZ'2024-01-15 00:00:00'")
    ev = L.event_store(spark, d).where((F.col("ts") >= day) & (F.col("ts") < day + F.expr("INTERVAL 1 DAY")))
    return B.daily_activity(ev).withColumn("net_flow", F.col("deposit_volume") - F.col("redemption_volume")).drop("day")


@query("n2_today_rollup", "SELECT account, count(*) FILTER (kind = 'atom') AS atoms, count(*) FILTER (kind = 'deposit') AS deposits, CAST(coalesce(sum(amount) FILTER (kind = 'deposit'), 0) AS BIGINT) AS deposit_volume FROM (SELECT account, 'atom' AS kind, 0 AS amount, ts FROM atom UNION ALL SELECT account, 'triple', 0, ts FROM triple UNION ALL SELECT account, 'deposit', assets, ts FROM dep UNION ALL SELECT account, 'redemption', assets, ts FROM red) WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' GROUP BY account")
def n2(spark, d):
    ev = L.event_store(spark, d).where(F.col("ts") >= F.expr("TIMESTAMP_NTZ'2024-01-29 00:00:00'"))
    part = lambda df, kind, amount: df.select("account", F.lit(kind).alias("kind"), amount.cast("long").alias("amount"))
    rows = part(L.atoms_created(ev), "atom", F.lit(0)).unionByName(part(L.triples_created(ev), "triple", F.lit(0))).unionByName(part(L.deposits(ev), "deposit", F.col("assets"))).unionByName(part(L.redemptions(ev), "redemption", F.col("assets")))
    kind = lambda k: F.col("kind") == k
    return rows.groupBy("account").agg(F.count(F.when(kind("atom"), 1)).alias("atoms"), F.count(F.when(kind("deposit"), 1)).alias("deposits"), F.coalesce(F.sum(F.when(kind("deposit"), F.col("amount"))), F.lit(0)).alias("deposit_volume"))


@query("n3_activity_profile", f"SELECT * EXCLUDE (ratio, last_day), round(ratio, 6) AS ratio, {STAMP.format('last_day')} AS last_day FROM scope")
def n3(spark, d):
    return _profile(spark, d).withColumns({"ratio": F.round("ratio", 6), "last_day": stamp("last_day")})


#: What came last, after the stored profiles were made.
_NEWEST = "ts >= TIMESTAMP_NTZ'2024-01-30 12:00:00'"


def _refreshed(spark, d, changed) -> tuple[DataFrame, DataFrame, History]:
    """Profiles by account, the accounts that changed made anew from their own history; these accounts; and the history, in buckets by account.

    The other accounts' profiles, whose other events are in the newest batch too, are brought up with the batch that
    they came in; which accounts a refresh is asked for is the caller's.
    """
    root, ev = f"{shared_folder(spark)}/profiles-{uuid.uuid4().hex}", L.event_store(spark, d)
    history = History(spark, f"{root}/events", ev.schema, ["account"], buckets=16)
    marks = Marks(spark, f"{root}/dirty", StructType([ev.schema["account"]]))
    profile = lambda rows: B.profiles(B.daily_activity(rows), AS_OF, windows=(7, 14, 30), active_days=20)
    history.append(ev.where(f"NOT ({_NEWEST})"), 0)
    first = profile(history.read()).withColumn("made", F.lit(0))
    store = MergeTable(spark, f"{root}/profiles", first.schema, ["account"], {c: "latest" for c in first.columns if c not in ("account", "made")}, "made", buckets=16)
    store.write(first, 0)
    newest = ev.where(_NEWEST)
    history.append(newest, 1)
    marks.mark(newest.select("account"), 1)
    every = marks.claim("refresh")
    store.write(profile(history.lookup(every)).withColumn("made", F.lit(1)), 1)
    marks.done("refresh")
    return store.read().drop("made"), changed(newest).select("account").distinct(), history


_RFM = f"a AS (SELECT account, date_diff('day', last_day, {NOW}) AS rec, frequency, ln(1.0 + CAST(volume AS DOUBLE)) AS mon FROM scope WHERE is_active), s AS (SELECT account, ntile(5) OVER (ORDER BY rec, account) AS r, ntile(5) OVER (ORDER BY frequency, account) AS f, ntile(5) OVER (ORDER BY mon, account) AS m, count(*) OVER () AS n FROM a), z AS (SELECT scope.account, CASE WHEN n < 50 THEN 3 ELSE r END AS r, CASE WHEN n < 50 THEN 3 ELSE f END AS f, CASE WHEN n < 50 THEN 3 ELSE m END AS m FROM scope LEFT JOIN s USING (account))"


@query("n4_rfm_scores", f"{_RFM} SELECT * FROM z")
def n4(spark, d):
    return B.rfm(_profile(spark, d), AS_OF)


@query("n5_rfm_for_accounts", f"{_RFM} SELECT z.* FROM z WHERE account IN (SELECT account FROM dep WHERE ts >= TIMESTAMP '2024-01-30 12:00:00')")
def n5(spark, d):
    """Quintiles over everybody, rows of the changed accounts only; of these alone the history is read again."""
    profiles, dirty, _ = _refreshed(spark, d, L.deposits)
    return B.rfm(profiles, AS_OF).join(dirty, "account", "left_semi")


_SEG = f"t AS (SELECT quantile_cont(volume, 0.99) AS whale, quantile_cont(frequency, 0.9) AS power, quantile_cont(frequency, 0.5) AS median FROM scope WHERE is_active), g AS (SELECT scope.account, scope.frequency, scope.atoms_30d, scope.triples_30d, scope.deposit_volume_30d, scope.redemption_volume_30d, CASE WHEN volume >= greatest(whale, 1) THEN 'whale' WHEN frequency >= power AND ratio BETWEEN 0.2 AND 0.8 THEN 'power_user' WHEN is_active AND first_seen > {NOW} - INTERVAL 14 DAY THEN 'new' WHEN is_active AND frequency >= median THEN 'active' WHEN is_active THEN 'casual' ELSE 'dormant' END AS segment FROM scope JOIN seen USING (account) CROSS JOIN t)"


@query("n6_segments", f"{_SEG} SELECT account, segment FROM g")
def n6(spark, d):
    return B.segments(_profile(spark, d), _seen(spark, d), AS_OF)


@query("n7_segments_for_accounts", f"{_SEG} SELECT account, segment FROM g WHERE account IN (SELECT account FROM red WHERE ts >= TIMESTAMP '2024-01-30 12:00:00')")
def n7(spark, d):
    profiles, dirty, history = _refreshed(spark, d, L.redemptions)
    seen = history.lookup(dirty).where("event_type <> 'click'").groupBy("account").agg(F.min("ts").alias("first_seen"))
    return B.segments(profiles, seen, AS_OF).join(dirty, "account", "left_semi")


_SCORE = f"round(ln(1.0 + interactions) * ln(1.0 + CAST(capital AS DOUBLE)) * CASE WHEN last_at > {NOW} - INTERVAL {{0}} DAY THEN 1.0 ELSE 0.5 END, 6)"


@query("n8_topic_affinity", f"SELECT account, term, interactions, capital, score FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY score DESC, term) AS k FROM (SELECT *, {_SCORE.format(10)} AS score FROM affinity)) WHERE k <= 50")
def n8(spark, d):
    return B.affinity_scores(B.affinity_totals(L.event_store(spark, d)), AS_OF, recent_days=10).drop("last_at")


@query("n9_topic_affinity_incremental", f"SELECT account, term, interactions, capital, {_SCORE.format(10)} AS score FROM affinity")
def n9(spark, d):
    """A first batch plus a delta gives what the full computation gives."""
    ev, cut = L.event_store(spark, d), F.expr("TIMESTAMP_NTZ'2024-01-20 00:00:00'")
    merged = B.affinity_merge(B.affinity_totals(ev.where(F.col("ts") < cut)), B.affinity_totals(ev.where(F.col("ts") >= cut)))
    return B.affinity_scores(merged, AS_OF, recent_days=10, top=None).drop("last_at")


@query("n10_affinity_prune", f"SELECT account, term, score FROM (SELECT *, row_number() OVER (PARTITION BY account ORDER BY score DESC, term) AS k FROM (SELECT *, {_SCORE.format(30)} AS score FROM affinity)) WHERE k <= 3")
def n10(spark, d):
    return B.affinity_scores(B.affinity_totals(L.event_store(spark, d)), AS_OF, top=3).select("account", "term", "score")


_COHORT = "c AS (SELECT seen.account, date_trunc('week', first_seen) AS cohort_week FROM seen), k AS (SELECT account, date_trunc('week', day) AS week, CAST(sum(atoms + triples + deposits + redemptions) AS BIGINT) AS action_count FROM daily GROUP BY ALL HAVING sum(atoms + triples + deposits + redemptions) > 0), r AS (SELECT c.account, c.cohort_week, date_diff('day', c.cohort_week, k.week) // 7 AS period_offset, k.action_count FROM c JOIN k ON k.account = c.account AND k.week >= c.cohort_week)"


@query("n11_retention_cohorts", f"{_COHORT} SELECT account, {STAMP.format('cohort_week')} AS cohort_week, period_offset, action_count FROM r")
def n11(spark, d):
    return B.cohorts(_seen(spark, d), _daily(spark, d)).withColumn("cohort_week", stamp("cohort_week"))


for _unit in ("week", "month"):
    query(f"n12_{_unit}ly_rollup", f"SELECT {STAMP.format(f'''date_trunc('{_unit}', day)''')} AS bucket, account, CAST(sum(atoms) AS BIGINT) AS atoms, CAST(sum(deposits) AS BIGINT) AS deposits, CAST(sum(deposit_volume) AS BIGINT) AS deposit_volume, CAST(sum(redemption_volume) AS BIGINT) AS redemption_volume FROM daily GROUP BY ALL")(
        lambda spark, d, u=_unit: _daily(spark, d).groupBy(trunc(u, "day").alias("bucket"), "account").agg(*[F.sum(c).alias(c) for c in ("atoms", "deposits", "deposit_volume", "redemption_volume")]).withColumn("bucket", stamp("bucket")))


@query("n13_trending_topics", f"SELECT term, CAST(sum(CASE WHEN last_at > {NOW} - INTERVAL 7 DAY THEN interactions ELSE 0 END) AS BIGINT) AS recent, CAST(sum(CASE WHEN last_at > {NOW} - INTERVAL 14 DAY AND last_at <= {NOW} - INTERVAL 7 DAY THEN interactions ELSE 0 END) AS BIGINT) AS prior, count(DISTINCT CASE WHEN last_at > {NOW} - INTERVAL 7 DAY THEN account END) AS recent_users FROM affinity GROUP BY term")
def n13(spark, d):
    recent = F.col("last_at") > B.since(AS_OF, 7)
    prior = (F.col("last_at") > B.since(AS_OF, 14)) & ~recent
    t = B.affinity_totals(L.event_store(spark, d))
    return t.groupBy("term").agg(F.sum(F.when(recent, F.col("interactions")).otherwise(0)).alias("recent"), F.sum(F.when(prior, F.col("interactions")).otherwise(0)).alias("prior"), F.count(F.when(recent, 1)).alias("recent_users"))  # (account, term) is unique in the totals


@query("n14_dau_wau_mau", f"x AS (SELECT day, count(DISTINCT account) AS dau FROM daily GROUP BY day) SELECT {STAMP.format('day')} AS day, dau, CAST(sum(dau) OVER (ORDER BY x.day ROWS 6 PRECEDING) AS BIGINT) AS wau, CAST(sum(dau) OVER (ORDER BY x.day ROWS 29 PRECEDING) AS BIGINT) AS mau FROM x")
def n14(spark, d):
    """Row frames over one row a day, as the definition has it (sums of daily actives)."""
    days = _daily(spark, d).groupBy("day").agg(F.countDistinct("account").alias("dau"))
    frame = lambda n: F.sum("dau").over(W.orderBy("day").rowsBetween(-n, 0))
    return days.select("day", "dau", frame(6).alias("wau"), frame(29).alias("mau")).withColumn("day", stamp("day"))


@query("n15_segment_distribution", f"{_SEG} SELECT segment, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM g GROUP BY segment")
def n15(spark, d):
    counts = n6(spark, d).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


@query("n16_retention_matrix", f"{_COHORT}, z AS (SELECT cohort_week, count(DISTINCT account) AS size FROM r WHERE period_offset = 0 GROUP BY 1) SELECT {STAMP.format('r.cohort_week')} AS cohort_week, r.period_offset, count(DISTINCT r.account) AS active, any_value(z.size) AS size, round(100.0 * count(DISTINCT r.account) / any_value(z.size), 2) AS rate FROM r JOIN z USING (cohort_week) GROUP BY r.cohort_week, r.period_offset")
def n16(spark, d):
    counts = B.cohorts(_seen(spark, d), _daily(spark, d)).groupBy("cohort_week", "period_offset").agg(F.countDistinct("account").alias("active"))
    size = F.max(F.when(F.col("period_offset") == 0, F.col("active"))).over(W.partitionBy("cohort_week"))
    return counts.withColumn("size", size).where("size IS NOT NULL").withColumns({"rate": F.round(100.0 * F.col("active") / F.col("size"), 2), "cohort_week": stamp("cohort_week")})


@query("n17_top_creators", "SELECT account, atoms_30d, triples_30d FROM profile WHERE atoms_30d > 0")
def n17(spark, d):
    return _profile(spark, d).where("atoms_30d > 0").select("account", "atoms_30d", "triples_30d")


@query("n17_whale_tracker", f"{_SEG} SELECT account, deposit_volume_30d, redemption_volume_30d, deposit_volume_30d - redemption_volume_30d AS net_flow_30d FROM g WHERE segment = 'whale'")
def n17b(spark, d):
    p = _profile(spark, d)
    whales = B.segments(p, _seen(spark, d), AS_OF).where("segment = 'whale'").select("account")
    return p.join(whales, "account", "left_semi").select("account", "deposit_volume_30d", "redemption_volume_30d", (F.col("deposit_volume_30d") - F.col("redemption_volume_30d")).alias("net_flow_30d"))


@query("n18_rfm_distribution", f"{_RFM} SELECT * FROM (SELECT 'recency' AS dimension, r AS score, count(*) AS n FROM z GROUP BY r UNION ALL SELECT 'frequency', f, count(*) FROM z GROUP BY f UNION ALL SELECT 'monetary', m, count(*) FROM z GROUP BY m) WHERE score IS NOT NULL")
def n18(spark, d):
    """Three histograms from one pass: the scores are unpivoted, not scanned three times."""
    long = n4(spark, d).withColumnsRenamed({"r": "recency", "f": "frequency", "m": "monetary"}).unpivot("account", ["recency", "frequency", "monetary"], "dimension", "score")
    return long.where("score IS NOT NULL").groupBy("dimension", "score").agg(F.count(F.lit(1)).alias("n"))


@query("n19_content_engagement", f"SELECT {STAMP.format('''date_trunc('hour', ts)''')} AS bucket, event_id % 20 AS content_id, count(*) FILTER (event_type = 'view') AS impressions, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'purchase') AS deposits, round(avg(CASE WHEN event_type = 'view' AND regexp_matches(json_extract_string(props, '$.k'), '^\\d+(\\.\\d+)?$') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END), 6) AS avg_dwell FROM events GROUP BY ALL")
def n19(spark, d):
    dwell = F.get_json_object("props", "$.k")
    kind = lambda k: F.count(F.when(F.col("event_type") == k, 1))
    guard = (F.col("event_type") == "view") & dwell.rlike(r"^\d+(\.\d+)?$")
    return table(spark, d, "events").groupBy(trunc("hour").alias("bucket"), (F.col("event_id") % 20).alias("content_id")).agg(
        kind("view").alias("impressions"), kind("click").alias("clicks"), kind("purchase").alias("deposits"), F.round(F.avg(F.when(guard, F.expr("try_cast(get_json_object(props, '$.k') AS DOUBLE)"))), 6).alias("avg_dwell"),
    ).withColumn("bucket", stamp("bucket"))


# --- funnels ----------------------------------------------------------------

_S0 = "s0 AS (SELECT account, min(ts) AS at FROM atom GROUP BY account)"
_FIRST = "SELECT account, CAST({i} AS BIGINT) AS step, strftime(arg_min(ts, (ts, seq)), '%Y-%m-%d %H:%M:%S') AS completed_at, arg_min(seq, (ts, seq)) AS event_id FROM {src} GROUP BY account"


def _done(steps):
    return B.funnel(steps).withColumn("completed_at", stamp("completed_at"))


@query("n20_funnel_first_atom", _FIRST.format(i=0, src="atom"))
def n20(spark, d):
    return _done([B.first_by(L.atoms_created(L.event_store(spark, d)))])


@query("n21_onboarding_funnel", f"{_S0}, x AS (SELECT d.* FROM dep d JOIN s0 USING (account) WHERE d.ts >= s0.at AND d.ts <= s0.at + INTERVAL 30 DAY) {_FIRST.format(i=0, src='atom')} UNION ALL {_FIRST.format(i=1, src='x')}")
def n21(spark, d):
    ev = L.event_store(spark, d)
    start = B.first_by(L.atoms_created(ev))
    return _done([start, B.first_by(B.within(L.deposits(ev), start, 30, strict=False))])


@query("n22_activation_funnel", f"f0 AS (SELECT account, min(ts) AS at FROM dep GROUP BY account), x AS (SELECT d.* FROM dep d JOIN f0 USING (account) WHERE d.ts > f0.at AND d.ts <= f0.at + INTERVAL 7 DAY) {_FIRST.format(i=0, src='dep')} UNION ALL {_FIRST.format(i=1, src='x')}")
def n22(spark, d):
    dep = L.deposits(L.event_store(spark, d))
    start = B.first_by(dep)
    return _done([start, B.first_by(B.within(dep, start, 7, strict=True))])


@query("n23_creator_funnel", f"{_S0}, x AS (SELECT t.* FROM triple t JOIN s0 USING (account) WHERE t.ts > s0.at AND t.ts <= s0.at + INTERVAL 90 DAY), y AS (SELECT a.*, row_number() OVER (PARTITION BY a.account ORDER BY a.ts, a.seq) AS k FROM atom a JOIN s0 USING (account) WHERE a.ts >= s0.at AND a.ts <= s0.at + INTERVAL 90 DAY) {_FIRST.format(i=0, src='atom')} UNION ALL {_FIRST.format(i=1, src='x')} UNION ALL SELECT account, CAST(2 AS BIGINT), {STAMP.format('ts')}, seq FROM y WHERE k = 5")
def n23(spark, d):
    ev = L.event_store(spark, d)
    atoms = L.atoms_created(ev)
    start = B.first_by(atoms)
    return _done([start, B.first_by(B.within(L.triples_created(ev), start, 90, strict=True)), B.nth_by(B.within(atoms, start, 90, strict=False), 5)])


@query("n24_cross_feature_funnel", f"{_S0}, x AS (SELECT d.* FROM dep d JOIN s0 USING (account) WHERE d.ts >= s0.at AND d.ts <= s0.at + INTERVAL 10 DAY AND EXISTS (SELECT 1 FROM atom a WHERE a.account = d.account AND a.term = d.term AND d.ts >= a.ts AND d.ts <= a.ts + INTERVAL 10 DAY)) {_FIRST.format(i=0, src='atom')} UNION ALL {_FIRST.format(i=1, src='x')}")
def n24(spark, d):
    """A deposit on an atom of one's own, 10 days here (24 hours by default); a semi-join, so several atoms make no copies."""
    ev = L.event_store(spark, d)
    atoms = L.atoms_created(ev)
    start = B.first_by(atoms)
    near = B.within(L.deposits(ev), start, 10, strict=False).alias("d")
    own = atoms.select("account", "term", F.col("ts").alias("made")).alias("a")
    same = (F.col("d.account") == F.col("a.account")) & (F.col("d.term") == F.col("a.term")) & (F.col("d.ts") >= F.col("a.made")) & (F.col("d.ts") <= F.col("a.made") + F.expr("INTERVAL 10 DAY"))
    return _done([start, B.first_by(near.join(own, same, "left_semi"))])


@query("n25_funnel_conversion", f"{_S0}, x AS (SELECT d.* FROM dep d JOIN s0 USING (account) WHERE d.ts >= s0.at AND d.ts <= s0.at + INTERVAL 30 DAY), f AS ({_FIRST.format(i=0, src='atom')} UNION ALL {_FIRST.format(i=1, src='x')}) SELECT step, count(DISTINCT account) AS users FROM f GROUP BY step")
def n25(spark, d):
    return n21(spark, d).groupBy("step").agg(F.countDistinct("account").alias("users"))


@query("p22_activity_batch", f"{_SEG}, {_RFM} SELECT z.account, z.r, z.f, z.m, g.segment, scope.frequency, scope.volume FROM z JOIN g ON g.account = z.account JOIN scope ON scope.account = z.account")
def p22(spark, d):
    """Three cycles: a first one, one later that day, and one days afterwards that fills the days between; what is stored equals a computation over all events."""
    ev = L.event_store(spark, d)
    batch = ActivityBatch(spark, f"{shared_folder(spark)}/activity-{uuid.uuid4().hex}", ev.schema, windows=(7, 14, 30), active_days=20, buckets=8)
    ends = ("0001-01-01 00:00:00", "2024-01-20 06:00:00", "2024-01-20 18:00:00", AS_OF)
    for since, until in zip(ends, ends[1:], strict=False):
        new = ev.where(f"ts >= TIMESTAMP_NTZ'{since}' AND ts < TIMESTAMP_NTZ'{until}'")
        batch.run(new, datetime.datetime.fromisoformat(until))
    return batch.scores.read().drop("made").join(batch.profiles().select("account", "frequency", "volume"), "account")
