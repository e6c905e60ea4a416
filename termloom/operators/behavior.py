"""User-behaviour analytics: daily rollups, profiles, RFM, segments, affinity, cohorts and funnels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators.market import trunc
from termloom.operators.ranking import exact_quantiles, tile_of, with_position

COUNTS = ("atoms", "triples", "deposits", "redemptions", "deposit_volume", "redemption_volume")


def daily_activity(ev: DataFrame) -> DataFrame:
    """One row per day and account: counts, volumes and distinct vaults; one aggregation over one scan."""
    of = lambda kind: F.col("event_type") == kind
    vault = F.when(F.col("event_type").isin("purchase", "error"), F.col("term") * 2 + F.col("curve"))
    return ev.where("event_type <> 'click'").groupBy(trunc("day").alias("day"), "account").agg(
        F.count(F.when(of("signup"), 1)).alias("atoms"), F.count(F.when(of("view"), 1)).alias("triples"), F.count(F.when(of("purchase"), 1)).alias("deposits"), F.count(F.when(of("error"), 1)).alias("redemptions"),
        F.coalesce(F.sum(F.when(of("purchase"), F.col("amount"))), F.lit(0)).alias("deposit_volume"), F.coalesce(F.sum(F.when(of("error"), F.col("amount"))), F.lit(0)).alias("redemption_volume"), F.size(F.collect_set(vault)).cast("long").alias("unique_vaults"),
    )


def since(as_of: str, days: int) -> Column:
    return F.expr(f"TIMESTAMP_NTZ'{as_of}' - INTERVAL {days} DAY")


def profiles(daily: DataFrame, as_of: str, windows: tuple[int, ...] = (7, 30, 90), active_days: int = 30) -> DataFrame:
    """Window sums and all-time counts per account, with frequency, volume, creator/trader ratio and whether it was active lately."""
    sums = [F.coalesce(F.sum(F.when(F.col("day") >= since(as_of, n), F.col(c))), F.lit(0)).alias(f"{c}_{n}d") for n in windows for c in COUNTS]
    out = daily.groupBy("account").agg(*sums, F.sum("atoms").alias("atoms_all"), F.sum("triples").alias("triples_all"), F.sum("unique_vaults").alias("vaults_touched"), F.max("day").alias("last_day"))
    n = windows[-1]
    made, traded = F.col(f"atoms_{n}d") + F.col(f"triples_{n}d"), F.col(f"deposits_{n}d") + F.col(f"redemptions_{n}d")
    return out.withColumns({
        "frequency": made + traded, "volume": F.col(f"deposit_volume_{n}d") + F.col(f"redemption_volume_{n}d"),
        "ratio": made / F.nullif((made + traded).cast("double"), F.lit(0.0)), "is_active": F.col("last_day") > since(as_of, active_days),
    })


def rfm(profile: DataFrame, as_of: str, least_population: int = 50) -> DataFrame:
    """account and its three quintile scores over the active population (3 each if that is small, null if inactive).

    Quintiles need a total order; ties go by account. The three orders are one distributed
    sort by measure, value and account with prefix-summed partition sizes, so no task sees
    more than its range; a place among all is one among its measure's, which all have as many rows.
    """
    days = F.datediff(F.lit(as_of).cast("date"), F.col("last_day"))
    active = profile.where("is_active").select("account", days.alias("recency"), "frequency", F.log1p(F.col("volume").cast("double")).alias("monetary"))
    population = active.agg(F.count(F.lit(1)).alias("population"))
    measures = ("recency", "frequency", "monetary")
    rows = active.select("account", F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(c).cast("double").alias("value")) for k, c in enumerate(measures)])).alias("x")).select("account", "x.*")
    placed = with_position(rows, ["measure", "value", "account"]).crossJoin(F.broadcast(population))  # the population is one row
    place = F.col("position") - F.col("measure") * F.col("population")
    score = F.when(F.col("population") < least_population, 3).otherwise(tile_of(place, F.col("population"), 5)).cast("long")
    scored = placed.withColumn("score", score).groupBy("account").agg(*[F.max(F.when(F.col("measure") == k, F.col("score"))).alias(c) for k, c in enumerate(("r", "f", "m"))])
    return profile.select("account").join(scored, "account", "left")


def segments(profile: DataFrame, first_seen: DataFrame, as_of: str) -> DataFrame:
    """account, segment: the ladder from whale down to dormant; thresholds are one row."""
    pair = lambda c: F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value"))
    active = profile.where("is_active").select("account", F.explode(F.array(pair("volume"), pair("frequency"))).alias("x")).select("account", "x.*")
    cuts = exact_quantiles(active, "value", "account", {"whale": 0.99, "power": 0.9, "median": 0.5}, by="measure")
    of = lambda measure, c: F.max(F.when(F.col("measure") == measure, F.col(c))).alias(c)
    cut = cuts.agg(of("volume", "whale"), of("frequency", "power"), of("frequency", "median"))
    rows = profile.join(first_seen.select("account", "first_seen"), "account", "left").join(F.broadcast(cut), F.lit(True), "left")  # one row
    ladder = (
        F.when(F.col("volume") >= F.greatest("whale", F.lit(1.0)), "whale")
        .when((F.col("frequency") >= F.col("power")) & F.col("ratio").between(0.2, 0.8), "power_user")
        .when(F.col("is_active") & (F.col("first_seen") > since(as_of, 14)), "new")
        .when(F.col("is_active") & (F.col("frequency") >= F.col("median")), "active")
        .when(F.col("is_active"), "casual").otherwise("dormant")
    )
    return rows.select("account", ladder.alias("segment"))


def affinity_totals(ev: DataFrame) -> DataFrame:
    capital = F.sum(F.when(F.col("event_type") == "purchase", F.col("amount")).otherwise(0))
    return ev.where(F.col("event_type").isin("purchase", "error", "signup")).groupBy("account", "term").agg(F.count(F.lit(1)).alias("interactions"), capital.alias("capital"), F.max("ts").alias("last_at"))


def affinity_scores(totals: DataFrame, as_of: str, recent_days: int = 30, top: int | None = 50) -> DataFrame:
    """Scores of (account, term) totals; with top, only each account's best."""
    fresh = F.when(F.col("last_at") > since(as_of, recent_days), 1.0).otherwise(0.5)
    scored = totals.withColumn("score", F.round(F.log1p("interactions") * F.log1p(F.col("capital").cast("double")) * fresh, 6))
    if top is None:
        return scored
    best = W.partitionBy("account").orderBy(F.desc("score"), "term")
    return scored.withColumn("place", F.row_number().over(best)).where(F.col("place") <= top).drop("place")


def affinity_merge(before: DataFrame, delta: DataFrame) -> DataFrame:
    """Totals after a delta: counts add up, the later time stays."""
    return before.unionByName(delta).groupBy("account", "term").agg(F.sum("interactions").alias("interactions"), F.sum("capital").alias("capital"), F.max("last_at").alias("last_at"))


def cohorts(first_seen: DataFrame, daily: DataFrame) -> DataFrame:
    """account, cohort_week (Monday of first sight), period_offset in weeks, action_count; active weeks only."""
    weeks = daily.groupBy("account", trunc("week", "day").alias("week")).agg(F.sum(F.col("atoms") + F.col("triples") + F.col("deposits") + F.col("redemptions")).alias("action_count")).where("action_count > 0")
    starts = first_seen.select("account", trunc("week", "first_seen").alias("cohort_week"))
    joined = starts.join(weeks, "account").where(F.col("week") >= F.col("cohort_week"))
    return joined.select("account", "cohort_week", F.floor(F.datediff("week", "cohort_week") / 7).cast("long").alias("period_offset"), "action_count")


def first_by(rows: DataFrame, key: str = "account") -> DataFrame:
    """Each key's earliest row (by ts, then seq) as key, completed_at, event_id."""
    return rows.groupBy(key).agg(F.min(F.struct("ts", "seq")).alias("x")).select(key, F.col("x.ts").alias("completed_at"), F.col("x.seq").alias("event_id"))


def within(rows: DataFrame, step0: DataFrame, days: int, strict: bool) -> DataFrame:
    """rows of accounts in step0 from its time on (or strictly after it), at most days later: an equi-join with a range filter."""
    start = step0.select("account", F.col("completed_at").alias("start"))
    after = F.col("ts") > F.col("start") if strict else F.col("ts") >= F.col("start")
    return rows.join(start, "account").where(after & (F.col("ts") <= F.col("start") + F.expr(f"INTERVAL {days} DAY"))).drop("start")


def funnel(steps: list[DataFrame]) -> DataFrame:
    """Steps' (account, completed_at, event_id) with their index."""
    out = None
    for i, step in enumerate(steps):
        row = step.select("account", F.lit(i).cast("long").alias("step"), "completed_at", "event_id")
        out = row if out is None else out.unionByName(row)
    return out


def nth_by(rows: DataFrame, n: int) -> DataFrame:
    """Each account's n-th row in order of (ts, seq)."""
    place = F.row_number().over(W.partitionBy("account").orderBy("ts", "seq"))
    return rows.withColumn("place", place).where(F.col("place") == n).select("account", F.col("ts").alias("completed_at"), F.col("seq").alias("event_id"))
