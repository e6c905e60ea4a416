"""How the driver's tables stand for chain data, as DataFrames and as DuckDB CTEs, and the registry decorator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The instant that stands for "now" in every query.
AS_OF = "2024-01-31 00:00:00"

#: CTEs that oracle queries may name; with_() adds those that a query needs.
CTES = {
    "ev": "SELECT event_id AS seq, ts, user_id AS account, event_type, CAST(round(value * 100) AS BIGINT) AS amount, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS term, event_id % 2 AS curve FROM events",
    "dep": "SELECT seq, ts, account, term, curve, amount AS assets, amount // (1 + seq % 3) AS shares FROM ev WHERE event_type = 'purchase'",
    "red": "SELECT seq, ts, account, term, curve, amount AS assets, amount // (1 + seq % 3) AS shares FROM ev WHERE event_type = 'error'",
    "tick": "SELECT seq, ts, term, curve, amount % 500 + 1 AS share_price, amount AS total_assets, amount // 2 + 1 AS total_shares FROM ev WHERE event_type = 'click'",
    "atom": "SELECT seq, ts, account, term FROM ev WHERE event_type = 'signup'",
    "triple": "SELECT seq, ts, account, term AS subject, curve AS predicate, seq % 7 AS object FROM ev WHERE event_type = 'view'",
    "chg": "SELECT seq, ts, account, term, curve, shares AS shares_delta, assets AS assets_in, CAST(0 AS BIGINT) AS assets_out FROM dep UNION ALL SELECT seq, ts, account, term, curve, -shares, 0, assets FROM red",
    "hourly": "SELECT date_trunc('hour', ts) AS bucket, account, term, curve, CAST(sum(shares_delta) AS BIGINT) AS shares_delta, CAST(sum(assets_in) AS BIGINT) AS assets_in, CAST(sum(assets_out) AS BIGINT) AS assets_out, CAST(sum(greatest(shares_delta, 0)) AS BIGINT) AS shares_in, CAST(sum(greatest(-shares_delta, 0)) AS BIGINT) AS shares_out, count(*) AS changes FROM chg GROUP BY ALL",
    "cum": "SELECT bucket, account, term, curve, CAST(sum(shares_delta) OVER w AS BIGINT) AS cum_shares, CAST(sum(assets_in) OVER w AS BIGINT) AS cum_assets_in, CAST(sum(assets_out) OVER w AS BIGINT) AS cum_assets_out, CAST(sum(shares_in) OVER w AS BIGINT) AS cum_shares_in, CAST(sum(shares_out) OVER w AS BIGINT) AS cum_shares_out FROM hourly WINDOW w AS (PARTITION BY account, term, curve ORDER BY bucket ROWS UNBOUNDED PRECEDING)",
    "ohlc": "SELECT date_trunc('hour', ts) AS bucket, term, curve, first(share_price ORDER BY ts, seq) AS open_price, max(share_price) AS high_price, min(share_price) AS low_price, last(share_price ORDER BY ts, seq) AS close_price, last(total_assets ORDER BY ts, seq) AS total_assets, last(total_shares ORDER BY ts, seq) AS total_shares, count(*) AS ticks FROM tick GROUP BY ALL",
    "latest": "SELECT term, curve, last(share_price ORDER BY ts, seq) AS share_price, last(total_assets ORDER BY ts, seq) AS total_assets, last(total_shares ORDER BY ts, seq) AS total_shares FROM tick GROUP BY ALL",
    "pos": "SELECT account, term, curve, CAST(sum(shares_delta) AS BIGINT) AS shares, CAST(sum(assets_in) AS BIGINT) AS assets_in, CAST(sum(assets_out) AS BIGINT) AS assets_out FROM chg GROUP BY ALL",
    "acts": "SELECT date_trunc('day', ts) AS day, account, event_type, amount, term, curve FROM ev",
    "daily": "SELECT day, account, count(*) FILTER (event_type = 'signup') AS atoms, count(*) FILTER (event_type = 'view') AS triples, count(*) FILTER (event_type = 'purchase') AS deposits, count(*) FILTER (event_type = 'error') AS redemptions, CAST(coalesce(sum(amount) FILTER (event_type = 'purchase'), 0) AS BIGINT) AS deposit_volume, CAST(coalesce(sum(amount) FILTER (event_type = 'error'), 0) AS BIGINT) AS redemption_volume, count(DISTINCT CASE WHEN event_type IN ('purchase', 'error') THEN term * 2 + curve END) AS unique_vaults FROM acts WHERE event_type <> 'click' GROUP BY ALL",
    "seen": "SELECT account, min(ts) AS first_seen, max(ts) AS last_seen FROM ev WHERE event_type <> 'click' GROUP BY account",
    "profile": "SELECT account, {w}, CAST(sum(atoms) AS BIGINT) AS atoms_all, CAST(sum(triples) AS BIGINT) AS triples_all, CAST(sum(unique_vaults) AS BIGINT) AS vaults_touched, max(day) AS last_day FROM daily GROUP BY account".replace(
        "{w}", ", ".join(f"CAST(coalesce(sum({c}) FILTER (day >= TIMESTAMP '{AS_OF}' - INTERVAL {n} DAY), 0) AS BIGINT) AS {c}_{n}d" for n in (7, 14, 30) for c in ("atoms", "triples", "deposits", "redemptions", "deposit_volume", "redemption_volume"))),
    "scope": "SELECT *, atoms_30d + triples_30d + deposits_30d + redemptions_30d AS frequency, deposit_volume_30d + redemption_volume_30d AS volume, (atoms_30d + triples_30d) / nullif(CAST(atoms_30d + triples_30d + deposits_30d + redemptions_30d AS DOUBLE), 0) AS ratio, last_day > TIMESTAMP '" + AS_OF + "' - INTERVAL 20 DAY AS is_active FROM profile",
    "affinity": "SELECT account, term, count(*) AS interactions, CAST(sum(CASE WHEN event_type = 'purchase' THEN amount ELSE 0 END) AS BIGINT) AS capital, max(ts) AS last_at FROM ev WHERE event_type IN ('purchase', 'error', 'signup') GROUP BY ALL",
}


def with_(sql: str) -> str:
    """sql (a SELECT, or CTEs and a SELECT that begin without WITH) with the shared CTEs it names."""
    names = list(CTES)
    need: set[str] = set()

    def add(text: str) -> None:
        for name in names:
            if name not in need and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                add(CTES[name])

    add(sql)
    shared = [f"{n} AS ({CTES[n]})" for n in names if n in need]
    own = sql.strip()
    if not shared:
        return own if own.upper().startswith("SELECT") else f"WITH {own}"
    return "WITH " + ",\n".join(shared) + ("\n" if own.upper().startswith("SELECT") else ",\n") + own


def query(name: str, sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_(sql)
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(column: str):
    """A timestamp column as text, the same in any session time zone."""
    return F.date_format(F.col(column), "yyyy-MM-dd HH:mm:ss").alias(column)
