"""Raw event envelopes: typed payloads or "Unknown", never lost; and the text that an atom's bytes stand for.

An envelope has seq, block_number, log_index, ts, event_type (case counts), event_data
(JSON) and is_canonical. All values of a payload are texts, so that amounts of any size
survive; numbers are made of them where they are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.columns import let

#: Fields of each type's payload; those marked with a question mark may be absent.
PAYLOADS = {
    "AtomCreated": ("creator", "term_id", "atom_data", "atom_wallet"),
    "TripleCreated": ("creator", "term_id", "subject_id", "predicate_id", "object_id"),
    "Deposited": ("sender", "receiver", "term_id", "curve_id", "assets", "assets_after_fees", "shares", "total_shares", "vault_type?"),
    "Redeemed": ("sender", "receiver", "term_id", "curve_id", "shares", "total_shares", "assets", "fees", "vault_type?"),
    "SharePriceChanged": ("term_id", "curve_id", "share_price", "total_assets", "total_shares", "vault_type?"),
    "ProtocolFeeAccrued": ("epoch", "sender", "amount"),
}


def canonical(envelopes: DataFrame) -> DataFrame:
    """Envelopes that a reorganisation of the chain has not taken back."""
    return envelopes.where("is_canonical")


def parse(envelopes: DataFrame) -> DataFrame:
    """envelopes with kind (a type, or "Unknown"), problem (null, "unknown_type", "malformed" or "missing_field") and payload, a struct of every field of any type (texts, null where a type has none)."""
    fields = sorted({f.rstrip("?") for known in PAYLOADS.values() for f in known})
    kind = F.col("event_type")

    def found(p: Column) -> Column:
        lacking = F.lit(False)
        for name, known in PAYLOADS.items():
            lacking = F.when(kind == name, reduce(lambda a, b: a | b, [p[f].isNull() for f in known if not f.endswith("?")])).otherwise(lacking)
        whole = F.try_parse_json("event_data").isNotNull() & F.trim("event_data").startswith("{")
        problem = F.when(~F.coalesce(kind.isin(*PAYLOADS), F.lit(False)), "unknown_type").when(~F.coalesce(whole, F.lit(False)), "malformed").when(lacking, "missing_field")
        return let(problem, lambda x: F.struct(F.when(x.isNull(), kind).otherwise("Unknown").alias("kind"), x.alias("problem"), F.when(x.isNull(), p).alias("payload")))

    out = envelopes.withColumn("_found", let(F.from_json("event_data", ", ".join(f"{f} string" for f in fields)), found))
    return out.select(*envelopes.columns, "_found.kind", "_found.problem", "_found.payload")


def typed(parsed: DataFrame, kind: str) -> DataFrame:
    """The rows of one type with its fields as columns."""
    return parsed.where(F.col("kind") == kind).select("seq", "block_number", "log_index", "ts", *[F.col(f"payload.{f.rstrip('?')}").alias(f.rstrip("?")) for f in PAYLOADS[kind]])


def rebuilt(parsed: DataFrame, after: int, most: int) -> DataFrame:
    """seq, log_index, kind and the payload as JSON rebuilt from its fields, of all known types after a sequence number, in order, at most so many; null fields are left out."""
    shown = F.create_map(*[x for kind, known in PAYLOADS.items() for x in (F.lit(kind), F.array(*[F.lit(f.rstrip("?")) for f in known]))])
    fields = F.element_at(shown, F.col("kind"))
    as_map = F.from_json(F.to_json("payload"), "map<string,string>")
    there = F.filter(fields, lambda f: F.element_at(as_map, f).isNotNull())
    text = F.to_json(F.map_from_arrays(there, F.transform(there, lambda f: F.element_at(as_map, f))))
    return parsed.where((F.col("kind") != "Unknown") & (F.col("seq") > after)).select("seq", "log_index", "kind", text.alias("event_data")).orderBy("seq", "log_index").limit(most)


def decoded(data: Column) -> Column:
    """The text of hexadecimal bytes with or without 0x; the hexadecimal text itself if they are not UTF-8, or hold a NUL, or are no bytes."""
    digits = F.regexp_replace(data, "^0[xX]", "")
    fine = digits.rlike("^(?:[0-9a-fA-F]{2})*$") & ~F.lower(digits).rlike("^(?:..)*00")
    content = F.unhex(F.when(fine, digits))
    return F.when(F.coalesce(F.is_valid_utf8(content.cast("string")), F.lit(False)), content.cast("string")).otherwise(data)


def accounts_of(parsed: DataFrame) -> DataFrame:
    """(account, ts, seq, reason): every account that an event touches: creators, senders, receivers, payers of fees."""
    p = F.col("payload")
    touch = lambda who, reason: F.when(p[who].isNotNull(), F.struct(p[who].alias("account"), F.lit(reason).alias("reason")))
    by_kind = (
        F.when(F.col("kind") == "AtomCreated", F.array(touch("creator", "atom"))).when(F.col("kind") == "TripleCreated", F.array(touch("creator", "triple")))
        .when(F.col("kind") == "Deposited", F.array(touch("sender", "deposit"), touch("receiver", "deposit"))).when(F.col("kind") == "Redeemed", F.array(touch("sender", "redemption"), touch("receiver", "redemption")))
        .when(F.col("kind") == "ProtocolFeeAccrued", F.array(touch("sender", "fee")))
    )
    return parsed.select("ts", "seq", F.explode(F.array_distinct(F.array_compact(by_kind))).alias("a")).select("a.account", "ts", "seq", "a.reason")
