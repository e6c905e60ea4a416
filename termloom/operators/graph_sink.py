"""Operations on a graph of accounts, atoms, triples and vaults: upserts, increments, and drafts that become facts.

An operation is a row: op ("node", "edge" or "add"), key, kind, at (its order), the source
and target of an edge, fields (map of texts, the last value of each wins) and amounts (map
of numbers, summed). Operations are made of typed events and applied by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.sources import envelopes as E

_NO_FIELDS = "map<string,string>"
_NO_AMOUNTS = "map<string,decimal(38,0)>"


def _op(op: str, key: Column, kind: str, fields: dict[str, Column] | None = None, amounts: dict[str, Column] | None = None, ends: tuple[Column, Column] | None = None) -> Column:
    both = [x for k, v in (fields or {}).items() for x in (F.lit(k), v.cast("string"))]
    sums = [x for k, v in (amounts or {}).items() for x in (F.lit(k), v.cast("decimal(38,0)"))]
    source, target = ends or (F.lit(None).cast("string"), F.lit(None).cast("string"))
    return F.struct(
        F.lit(op).alias("op"), key.alias("key"), F.lit(kind).alias("kind"), source.alias("source"), target.alias("target"),
        (F.create_map(*both) if both else F.create_map()).cast(_NO_FIELDS).alias("fields"), (F.create_map(*sums) if sums else F.create_map()).cast(_NO_AMOUNTS).alias("amounts"),
    )


def operations(parsed: DataFrame) -> DataFrame:
    """All operations of typed events, in one pass: an atom makes three nodes, a triple two nodes and an edge, a deposit or redemption six operations (redeemed amounts count negative), a price one and a fee one."""
    p, kind = F.col("payload"), F.col("kind")
    named = lambda prefix, *parts: F.concat_ws(":", F.lit(prefix), *parts)
    account = lambda who: named("account", p[who])
    vault = named("vault", p["term_id"], F.coalesce(p["curve_id"], F.lit("1")))

    def flow(sign: int, holder: str, assets: str) -> Column:
        amount, shares = p[assets].cast("decimal(38,0)") * sign, p["shares"].cast("decimal(38,0)") * sign
        position = named("position", p[holder], p["term_id"], p["curve_id"])
        return F.array(
            _op("node", account(holder), "account", {"id": p[holder]}), _op("add", account(holder), "account", None, {"deposited": amount}),
            _op("edge", F.concat_ws("-", named("flow", F.col("seq").cast("string")), F.col("log_index").cast("string")), "flow", {"assets": amount}, None, (account(holder), vault)),
            _op("node", position, "position", {"account": p[holder], "term": p["term_id"]}), _op("add", position, "position", None, {"shares": shares}), _op("add", vault, "vault", None, {"assets": amount, "shares": shares}),
        )

    made = (
        F.when(kind == "AtomCreated", F.array(_op("node", account("creator"), "account", {"id": p["creator"]}), _op("node", vault, "vault", {"term": p["term_id"]}), _op("node", named("atom", p["term_id"]), "atom", {"data": E.decoded(p["atom_data"]), "creator": p["creator"]})))
        .when(kind == "TripleCreated", F.array(
            _op("node", account("creator"), "account", {"id": p["creator"]}), _op("node", vault, "vault", {"term": p["term_id"]}),
            _op("edge", named("triple", p["term_id"]), "triple", {"predicate": p["predicate_id"]}, None, (named("atom", p["subject_id"]), named("atom", p["object_id"]))),
        ))
        .when(kind == "Deposited", flow(1, "receiver", "assets_after_fees")).when(kind == "Redeemed", flow(-1, "sender", "assets"))
        .when(kind == "SharePriceChanged", F.array(_op("node", vault, "vault", {"price": p["share_price"], "total_assets": p["total_assets"]})))
        .when(kind == "ProtocolFeeAccrued", F.array(_op("node", account("sender"), "account", {"id": p["sender"]})))
    )
    return parsed.select(F.struct("ts", "seq", "log_index").alias("at"), F.explode(made).alias("o")).select("o.*", "at")


def applied(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key, kind, fields, amounts) and edges (key, kind, source, target, fields) after all operations: of each field the last value, of each amount the sum. An amount that is added before its node comes makes the node."""
    nodes = ops.where("op <> 'edge'")
    last = nodes.select("key", "kind", "at", F.explode("fields").alias("name", "value")).groupBy("key", "name").agg(F.max_by("value", "at").alias("value"))
    fields = last.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("fields"))
    sums = nodes.select("key", F.explode("amounts").alias("name", "value")).groupBy("key", "name").agg(F.sum("value").alias("value")).groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("amounts"))
    known = nodes.groupBy("key").agg(F.min("kind").alias("kind")).join(fields, "key", "left").join(sums, "key", "left")
    edges = ops.where("op = 'edge'").groupBy("key").agg(F.max_by(F.struct("kind", "source", "target", "fields"), "at").alias("e")).select("key", "e.*")
    return known, edges


def reconciled(drafts: DataFrame, facts: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drafts (id, subject, predicate, object) that have become facts (the same columns) give way to them: the drafts left, and references (key, target) that now name the fact.

    If several facts agree in subject, predicate and object, the smallest id counts.
    """
    spo = ["subject", "predicate", "object"]
    fact = facts.groupBy(*spo).agg(F.min("id").alias("fact"))
    became = drafts.join(fact, spo).select(F.col("id").alias("target"), "fact")
    moved = references.join(became, "target", "left").select("key", F.coalesce("fact", "target").alias("target"))
    return drafts.join(fact, spo, "left_anti"), moved
