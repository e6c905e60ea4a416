"""Candidates of an input: ranked, told apart by their signatures, and merged field by field with the source of each value.

Everything here is grouped by the input, so a task holds the candidates of an input and
never those of a class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_first(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each input with its classes, an array of struct(class, confidence, priority, registered): the surest first, then by priority and by the order of registration; the first is the winner."""
    order = F.struct((-F.col("confidence")).alias("less"), "priority", "registered", "class", "confidence")
    listed = F.transform(F.array_sort(F.collect_list(order)), lambda c: F.struct(c["class"].alias("class"), c["confidence"].alias("confidence"), c["priority"].alias("priority"), c["registered"].alias("registered")))
    return candidates.groupBy(*keys).agg(listed.alias("classes"))


def signature(canonical: Column, same_as: Column, schema_type: Column, title: Column) -> Column:
    """What two atoms that are the same have in common: the canonical id, the other ids in any order, the type and the title, whatever their case."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    others = F.array_sort(F.transform(F.coalesce(same_as, F.array().cast("array<string>")), F.lower))
    return F.concat_ws("::", low(canonical), F.array_join(others, "|"), low(schema_type), low(title))


def ranked_atoms(atoms: DataFrame, keys: list[str]) -> DataFrame:
    """atoms with place (from 1 in their input), each signature of an input once: resolvers in their order, within one the surest atoms, then the smaller canonical id.

    atoms has keys, resolver_order, confidence, canonical, same_as, schema_type, title. Of
    atoms that are the same the first in this order stays.
    """
    own = F.struct("resolver_order", (-F.col("confidence")).alias("less"), F.lower(F.coalesce("canonical", F.lit(""))).alias("id"), F.struct("title", "schema_type", F.array_sort("same_as")).alias("rest"))
    marked = atoms.withColumns({"_order": own, "_signature": signature(F.col("canonical"), F.col("same_as"), F.col("schema_type"), F.col("title"))})
    row = F.struct(*[F.col(f"`{c}`") for c in atoms.columns if c not in keys])
    once = marked.groupBy(*keys, "_signature").agg(F.min_by(row, "_order").alias("row"), F.min("_order").alias("_order"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_order", "_signature")).cast("long")
    return once.withColumn("place", place).select(*keys, "row.*", "place")


def merged_fields(ranked: DataFrame, keys: list[str], fields: dict[str, Column], source: str) -> DataFrame:
    """keys, field, value, source: of each field the first value by place that is there, and where it comes from."""
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), F.nullif(F.trim(value.cast("string")), F.lit("")).alias("value")) for name, value in fields.items()]))
    rows = ranked.select(*keys, "place", F.col(source).alias("source"), listed.alias("x")).where("x.value IS NOT NULL")
    first = rows.groupBy(*keys, "x.field").agg(F.min(F.struct("place", "x.value", "source")).alias("first"))
    return first.select(*keys, "field", "first.value", "first.source")
