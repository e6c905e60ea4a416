"""Market rollups, cumulative positions, as-of prices and the period profit-and-loss leaderboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators.scans import running_sums

POSITION = ("account", "term", "curve")
VAULT = ("term", "curve")
SORT_KEYS = ("total_pnl", "realized_pnl", "unrealized_pnl", "pnl_pct", "win_rate", "total_volume")


def trunc(unit: str, column: str = "ts") -> Column:
    """date_trunc that stays free of time zones, as the stored timestamps are."""
    return F.date_trunc(unit, F.col(column)).cast("timestamp_ntz")


def price_stats(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """Open, high, low, close and last totals by bucket and vault: one aggregation, no sort."""
    at = F.struct("ts", "seq")
    return ticks.groupBy(trunc(unit).alias("bucket"), *VAULT).agg(
        F.min_by("share_price", at).alias("open_price"), F.max("share_price").alias("high_price"), F.min("share_price").alias("low_price"), F.max_by("share_price", at).alias("close_price"),
        F.max_by("total_assets", at).alias("total_assets"), F.max_by("total_shares", at).alias("total_shares"), F.count(F.lit(1)).alias("ticks"),
    )


def latest_prices(ticks: DataFrame) -> DataFrame:
    at = F.struct("ts", "seq")
    return ticks.groupBy(*VAULT).agg(*[F.max_by(c, at).alias(c) for c in ("share_price", "total_assets", "total_shares")])


def position_rollup(changes: DataFrame, unit: str = "hour") -> DataFrame:
    zero = F.lit(0).cast("long")
    return changes.groupBy(trunc(unit).alias("bucket"), *POSITION).agg(
        F.sum("shares_delta").alias("shares_delta"), F.sum("assets_in").alias("assets_in"), F.sum("assets_out").alias("assets_out"),
        F.sum(F.greatest("shares_delta", zero)).alias("shares_in"), F.sum(F.greatest(-F.col("shares_delta"), zero)).alias("shares_out"), F.count(F.lit(1)).alias("changes"),
    )


MEASURES = {"shares_delta": "cum_shares", "assets_in": "cum_assets_in", "assets_out": "cum_assets_out", "shares_in": "cum_shares_in", "shares_out": "cum_shares_out"}


def cumulative(rollup: DataFrame) -> DataFrame:
    """Running sums per position over its buckets, a month of a position at a time."""
    summed = running_sums(rollup, list(POSITION), ["bucket"], {n: F.col(c) for c, n in MEASURES.items()}, trunc("month", "bucket"))
    return summed.select("bucket", *POSITION, *MEASURES.values())


def cumulative_refresh(snapshot: DataFrame, rollup: DataFrame) -> DataFrame:
    """New cumulative rows for buckets after the last one in snapshot, from the deltas and each position's last snapshot row."""
    mark = snapshot.agg(F.max("bucket").alias("mark"))
    fresh = rollup.join(F.broadcast(mark), F.col("bucket") > F.col("mark")).drop("mark")  # mark is one row
    last = snapshot.groupBy(*POSITION).agg(F.max_by(F.struct(*MEASURES.values()), "bucket").alias("last"))
    joined = cumulative(fresh).join(last, list(POSITION), "left")
    return joined.select("bucket", *POSITION, *[(F.col(n) + F.coalesce(F.col(f"last.{n}"), F.lit(0))).alias(n) for n in MEASURES.values()])


def as_of(rows: DataFrame, keys: tuple[str, ...], time: str, limit: Column, values: list[str]) -> DataFrame:
    """The values of each key's latest row at or before limit: one aggregation with partial combining."""
    return rows.where(F.col(time) <= limit).groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(time)).alias("x")).select(*keys, "x.*")


def as_of_forward(rows: DataFrame, keys: tuple[str, ...], time: str, limit: Column, value: str) -> DataFrame:
    """As as_of() for one value, but the earliest later one where a key has none by then."""
    early = F.max_by(value, F.when(F.col(time) <= limit, F.col(time)))
    return rows.groupBy(*keys).agg(F.coalesce(early, F.min_by(value, time)).alias(value))


def account_pnl(
    changes: DataFrame, ticks: DataFrame, start: str, end: str, excluded_accounts: DataFrame | None = None, min_positions: int = 0, min_volume: int = 0, min_deposit: int = 0, term: int | None = None,
) -> DataFrame:
    """Profit and loss of every account over a period.

    Positions are read as of the end and the start hour (both whole hours included); the
    start price of a vault is the hourly close by then or else the earliest later one, the
    end price the close by then or else the latest price there is. Both snapshots come out
    of one aggregation by position; prices are small aggregates by vault.
    """
    boards = period_pnl(changes, ticks, {"": (start, end)}, excluded_accounts, term)
    kept = boards.where((F.col("positions") >= min_positions) & (F.col("total_volume") >= min_volume) & (F.col("deposits") >= min_deposit))
    return kept.drop("period")


def period_pnl(changes: DataFrame, ticks: DataFrame, periods: dict[str, tuple[str, str]], excluded_accounts: DataFrame | None = None, term: int | None = None) -> DataFrame:
    """account_pnl() without its filters for several periods at once, with the period's name: changes and prices are read and summed once, whatever the number of periods.

    Cumulative values as of an hour are sums up to it, so the snapshots at both ends of all
    periods are sums of one aggregation by position; only then a position becomes a row for
    each period in which its account did something.
    """
    at = lambda unit, t: F.expr(f"date_trunc('{unit}', TIMESTAMP_NTZ'{t}')").cast("timestamp_ntz")
    hour, day = F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 DAY")
    limits = list(dict.fromkeys(t for ends in periods.values() for t in ends))
    last = F.greatest(*[at("hour", t) for t in limits], at("hour", limits[0]))
    if term is not None:
        changes = changes.where(F.col("term") == term)
    within = [F.max((F.col("ts") >= at("day", start)) & (F.col("ts") < at("day", end) + day)) for start, end in periods.values()]
    active = changes.groupBy("account").agg(F.array(*within).alias("active")).where(F.exists("active", lambda x: x))
    if excluded_accounts is not None:
        active = active.join(excluded_accounts, "account", "left_anti")
    zero = F.lit(0).cast("long")
    each = {"shares": F.col("shares_delta"), "assets_in": F.col("assets_in"), "assets_out": F.col("assets_out"), "shares_in": F.greatest("shares_delta", zero), "shares_out": F.greatest(-F.col("shares_delta"), zero)}
    until = lambda t: F.struct(*[F.coalesce(F.sum(F.when(F.col("ts") < at("hour", t) + hour, v)), zero).alias(n) for n, v in each.items()])
    own = changes.where(F.col("ts") < last + hour).join(active, "account")  # the bound reaches the scan
    first_at = F.min("ts").alias("first_at")
    positions = own.groupBy(*POSITION).agg(F.first("active").alias("active"), first_at, *[until(t).alias(f"cum_{k}") for k, t in enumerate(limits)])
    closes = price_stats(ticks).select("bucket", *VAULT, "close_price")
    by_then = lambda t: F.max_by("close_price", F.when(F.col("bucket") <= at("hour", t), F.col("bucket")))
    prices = closes.groupBy(*VAULT).agg(
        *[F.coalesce(by_then(start), F.min_by("close_price", "bucket")).alias(f"start_{k}") for k, (start, _) in enumerate(periods.values())],
        *[F.coalesce(by_then(end), F.max_by("close_price", "bucket")).alias(f"end_{k}") for k, (_, end) in enumerate(periods.values())])
    wide = positions.join(prices, list(VAULT), "left")
    per_period = [
        F.when(F.col("active")[k] & (F.col("first_at") < at("hour", end) + hour), F.struct(F.lit(name).alias("period"), F.col(f"cum_{limits.index(start)}").alias("start"), F.col(f"cum_{limits.index(end)}").alias("end"), F.coalesce(f"start_{k}", zero).alias("price_start"), F.coalesce(f"end_{k}", zero).alias("price_end")))
        for k, (name, (start, end)) in enumerate(periods.items())
    ]
    priced = wide.select("account", F.explode(F.array_compact(F.array(*per_period))).alias("p")).select("account", "p.*")
    basis = lambda at: F.coalesce(F.col(f"{at}.assets_in").cast("double") / F.nullif(F.col(f"{at}.shares_in").cast("double"), F.lit(0.0)), F.lit(0.0))
    period = lambda c: F.col(f"end.{c}") - F.col(f"start.{c}")
    per_position = priced.select(
        "period", "account", (F.col("end.shares") * F.col("price_end") - (F.col("end.assets_in") - F.col("end.assets_out"))).cast("double").alias("unrealized"),
        (period("assets_out") - period("shares_out") * basis("end")).alias("realized"), (F.col("end.shares") > 0).cast("long").alias("is_active"),
        period("assets_in").alias("deposited"), period("assets_out").alias("redeemed"), (F.col("end.shares") * F.col("price_end")).alias("equity"),
        (F.col("start.shares") * F.col("price_start") - (F.col("start.assets_in") - F.col("start.assets_out")) + F.col("start.assets_out") - F.col("start.shares_out") * basis("start")).alias("at_start"),
    ).withColumn("pnl", F.col("unrealized") + F.col("realized"))
    by_account = per_position.groupBy("period", "account").agg(
        F.sum("unrealized").alias("unrealized_pnl"), F.sum("realized").alias("realized_pnl"), F.sum("pnl").alias("total_pnl"), F.count(F.lit(1)).alias("positions"), F.sum("is_active").alias("active_positions"),
        F.count(F.when(F.col("pnl") > 0, 1)).alias("winners"), F.count(F.when(F.col("pnl") < 0, 1)).alias("losers"), F.sum("deposited").alias("deposits"), F.sum("redeemed").alias("redemptions"),
        F.sum(F.col("deposited") + F.col("redeemed")).alias("total_volume"), F.sum("equity").alias("equity"), F.max("pnl").alias("best_trade"), F.min("pnl").alias("worst_trade"), F.sum("at_start").alias("pnl_at_start"),
    )
    share = lambda c: F.when(F.col("deposits") > 0, F.col(c) / F.col("deposits") * 100).otherwise(0.0)
    return by_account.withColumns({"pnl_pct": share("total_pnl"), "realized_pct": share("realized_pnl"), "unrealized_pct": share("unrealized_pnl"), "win_rate": F.col("winners") / F.col("positions") * 100, "pnl_change": F.col("total_pnl") - F.col("pnl_at_start")})


def leaderboard(changes: DataFrame, ticks: DataFrame, start: str, end: str, limit: int = 100, offset: int = 0, sort_by: str = "total_pnl", scale: float = 1e18, stats: DataFrame | None = None, **filters) -> DataFrame:
    """account_pnl() ranked: always descending, nulls last, ties by account; filters are those of account_pnl()."""
    scored = account_pnl(changes, ticks, start, end, **filters)
    key = F.round(F.col(sort_by if sort_by in SORT_KEYS else "total_pnl"), 4)
    limit, offset = min(max(limit, 1), 10_000), max(offset, 0)
    top = scored.orderBy(key.desc_nulls_last(), "account").limit(limit + offset)  # only these rows meet in one task
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(key.desc_nulls_last(), "account")).cast("long")).where(F.col("rank") > offset)
    if stats is not None:
        ranked = ranked.join(stats, "account", "left")
    return _rounded(ranked.drop("pnl_at_start").withColumn("total_pnl_scaled", F.round(F.col("total_pnl") / F.lit(scale), 4)))


def _rounded(df: DataFrame) -> DataFrame:
    four = ("unrealized_pnl", "realized_pnl", "total_pnl", "best_trade", "worst_trade", "pnl_change", "pnl_pct", "realized_pct", "unrealized_pct")
    return df.withColumns({c: F.round(F.col(c), 4) for c in four} | {"win_rate": F.round("win_rate", 2)})


def leaderboard_cache(changes: DataFrame, ticks: DataFrame, periods: dict[str, tuple[str, str]], top: int = 100) -> DataFrame:
    """The top of every period by every sort key, over all accounts.

    The filter on the row number is pushed below the shuffle (a group limit), so every task
    passes on at most top rows a period and key.
    """
    boards = _rounded(period_pnl(changes, ticks, periods))
    ranks = F.explode(F.array(*[F.struct(F.lit(k).alias("sort_key"), F.col(k).cast("double").alias("key_value")) for k in SORT_KEYS])).alias("r")
    out = boards.select("period", "account", ranks).select("period", "account", "r.*")
    rank = F.row_number().over(W.partitionBy("period", "sort_key").orderBy(F.desc_nulls_last("key_value"), "account")).cast("long")
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


def fold_positions(changes: DataFrame) -> DataFrame:
    """Every change with the position's running cost basis and the profit it realizes.

    The cost basis only moves with deposits, so it is a ratio of two running sums; a
    redemption realizes what it returns less its shares at the basis of that moment (all of
    it before any deposit). A day of a position is summed at a time.
    """
    zero = F.lit(0).cast("long")
    sums = {"shares_after": F.col("shares_delta"), "_came": F.col("assets_in"), "_acquired": F.greatest("shares_delta", zero)}
    summed = running_sums(changes, list(POSITION), ["ts", "seq"], sums, trunc("day"))
    basis = F.coalesce(F.col("_came") / F.nullif(F.col("_acquired").cast("double"), F.lit(0.0)), F.lit(0.0))
    return summed.withColumn("cost_basis", basis).drop("_came", "_acquired").withColumn(
        "realized", F.when(F.col("shares_delta") < 0, F.col("assets_out") + F.col("shares_delta") * F.col("cost_basis")).otherwise(0.0))
