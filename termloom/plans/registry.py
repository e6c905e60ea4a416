"""All (query, oracle) pairs of the graph and market operators, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.plans import atoms, behavior, cookbook, envelopes, graph, market, recommend, rollups, streams  # noqa: F401  (importing registers)
from termloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The period profit-and-loss leaderboard."""
    return market.m6(spark, sf_dir)
