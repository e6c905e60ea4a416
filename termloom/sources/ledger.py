"""The event store and its typed views, bound to the events table (see FIXTURES.md, section 8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event kinds of the store and the event_type that stands for each.
KINDS = {"Deposited": "purchase", "Redeemed": "error", "SharePriceChanged": "click", "AtomCreated": "signup", "TripleCreated": "view"}


def event_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, ts, account, event_type, amount, term, curve; only the columns a query uses are read."""
    term = F.get_json_object("props", "$.k").cast("long") % 10
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("seq"), F.col("ts"), F.col("user_id").alias("account"), "event_type",
        F.round(F.col("value") * 100).cast("long").alias("amount"), term.alias("term"), (F.col("event_id") % 2).alias("curve"),
    )


def _fact(ev: DataFrame, kind: str) -> DataFrame:
    return ev.where(F.col("event_type") == KINDS[kind])


def _transfer(ev: DataFrame, kind: str) -> DataFrame:
    return _fact(ev, kind).select("seq", "ts", "account", "term", "curve", F.col("amount").alias("assets"), F.expr("amount div (1 + seq % 3)").alias("shares"))


def deposits(ev: DataFrame) -> DataFrame:
    return _transfer(ev, "Deposited")


def redemptions(ev: DataFrame) -> DataFrame:
    return _transfer(ev, "Redeemed")


def price_ticks(ev: DataFrame) -> DataFrame:
    return _fact(ev, "SharePriceChanged").select("seq", "ts", "term", "curve", (F.col("amount") % 500 + 1).alias("share_price"), F.col("amount").alias("total_assets"), F.expr("amount div 2 + 1").alias("total_shares"))


def atoms_created(ev: DataFrame) -> DataFrame:
    return _fact(ev, "AtomCreated").select("seq", "ts", "account", "term")


def triples_created(ev: DataFrame) -> DataFrame:
    return _fact(ev, "TripleCreated").select("seq", "ts", "account", F.col("term").alias("subject"), F.col("curve").alias("predicate"), (F.col("seq") % 7).alias("object"))


def position_changes(ev: DataFrame) -> DataFrame:
    """One row per deposit or redemption with its signed share delta; a single scan, no union."""
    shares = F.expr("amount div (1 + seq % 3)")
    is_deposit = F.col("event_type") == KINDS["Deposited"]
    zero = F.lit(0).cast("long")
    return ev.where(F.col("event_type").isin(KINDS["Deposited"], KINDS["Redeemed"])).select(
        "seq", "ts", "account", "term", "curve", F.when(is_deposit, shares).otherwise(-shares).alias("shares_delta"),
        F.when(is_deposit, F.col("amount")).otherwise(zero).alias("assets_in"), F.when(is_deposit, zero).otherwise(F.col("amount")).alias("assets_out"),
    )
