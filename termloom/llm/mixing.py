"""Mixing sources to target weights (operator 5).

Every document gets a hash-random key; documents are range-sorted by that key
within their source, a distributed prefix sum of sizes runs along that order and
the source is cut at its exact budget, after as many whole epochs as fit.

Defined results for odd input: a null text has size 0; a null source is a source
of its own, last in the order of weights; a null doc_id only feeds the key (as the
empty string), which the text feeds too, so that rows without ids spread over all ranges; repeated rows are separate rows, and which of two rows that agree in
doc_id, size and text comes first makes no difference to the result as a set; an
empty table gives an empty result; other columns are ignored (mix) or passed on
untouched, whatever their names (draw).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import materialize, text_of

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(column: str) -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3) -> DataFrame:
    """(source, source_size, target) from one row per source (source, source_size).

    Sources in code-point order, null last, weigh weights[0], weights[1], ... repeating.
    Targets share the total by weight, at most most_epochs times a source's size; what is
    above goes to the others by weight until none is above. In closed form: order the
    sources by cap/weight; those before the first place at which the level (what is left
    over the weight left) does not exceed the next cap/weight are capped, and that level
    holds for the rest. The
    windows run over one row per source, never over documents.
    """
    n = len(weights)
    order = W.orderBy(F.col("source").asc_nulls_last())
    place = ((F.row_number().over(order) - 1) % n).cast("int")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), place + 1).cast("double")
    ranked = sizes.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, everything = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    levels = (
        ranked.withColumn("total", F.sum(F.col("source_size").cast("double")).over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("gone", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone")))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("final", F.min(F.when(F.col("fits"), F.struct(F.row_number().over(by_ratio).alias("k"), "level"))).over(everything)["level"])
        .withColumn("open", F.max(F.col("fits").cast("int")).over(by_ratio.rowsBetween(W.unboundedPreceding, 0)))
    )
    target = F.when(F.col("open") == 1, F.least(F.col("final") * F.col("weight"), F.col("cap"))).otherwise(F.col("cap"))
    return levels.select("source", "source_size", target.alias("target"))


#: Up to this many sources the table of one row per source is broadcast (about 100 bytes a row); beyond it is joined by shuffle.
MOST_BROADCAST_SOURCES = 50_000


def _sized(docs: DataFrame, text_col: str, id_col: str, source_col: str, seed: str, with_row: bool = False) -> DataFrame:
    """The working columns _id, _source (never null, null sorts last), _size, _key and _tie; with_row, docs' own columns go along in one struct, so that no name of theirs can clash."""
    source = F.col(source_col).cast("string")
    as_text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"), F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("_source"), word_count(text_col).alias("_size"),
        F.md5(F.concat_ws("|", F.lit(seed), as_text(F.col(id_col)), as_text(source), F.md5(text_of(text_col)))).alias("_key"), F.xxhash64(text_of(text_col)).alias("_tie"),
        *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if with_row else []),
    )


def _placed(sized: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """Each row with its source's plan and the key range it lies in."""
    share = F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    return sized.join(F.broadcast(plan) if few else plan, "_source").withColumn("_range", F.floor(share * F.col("ranges")).cast("long"))


def _plan(small: DataFrame, weights: tuple[int, ...], most_epochs: int, rows_per_range: int) -> tuple[DataFrame, bool]:
    """One row per source: its target, whole epochs, and the key range that its last epoch's cut falls into with the words before it."""
    totals = small.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.ceil(F.count(F.lit(1)) / F.lit(rows_per_range)).cast("long").alias("ranges"))
    totals = materialize(totals, "mix-sources")
    few = totals.count() <= MOST_BROADCAST_SOURCES
    targets = source_targets(totals.select(F.col("_source").alias("source"), "source_size"), weights, most_epochs)
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = (
        targets.withColumnRenamed("source", "_source").join(totals.select("_source", "ranges"), "_source")
        .withColumn("epochs", epochs).withColumn("rest", goal - epochs * F.col("source_size"))
    )
    sums = _placed(small, plan, few).groupBy("_source", "_range").agg(F.sum("_size").alias("range_size"), F.first("rest").alias("rest"))
    through = F.sum("range_size").over(W.partitionBy("_source").orderBy("_range").rowsBetween(W.unboundedPreceding, 0))
    crossing = (
        sums.withColumn("through", through).where(F.col("through") > F.col("rest"))
        .groupBy("_source").agg(F.min(F.struct("_range", (F.col("through") - F.col("range_size")).alias("offset"))).alias("cut"))
    )
    plan = plan.join(crossing, "_source", "left").select(
        "_source", "source_size", "target", "epochs", "rest", "ranges",
        F.coalesce(F.col("cut._range"), F.col("ranges")).alias("cut_range"), F.coalesce(F.col("cut.offset"), F.lit(0)).alias("cut_offset"),
    )
    return materialize(plan, "mix-plan"), few


def _taken(sized: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """sized with _taken; only the one range of each source that the cut falls into is sorted."""
    placed = _placed(sized, plan, few)
    whole = placed.where(F.col("_range") != F.col("cut_range")).withColumn("_part", F.when(F.col("_range") < F.col("cut_range"), F.col("_size")).otherwise(F.lit(0).cast("long")))
    order = W.partitionBy("_source", "_range").orderBy("_key", "_id", "_size", "_tie").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("cut_offset") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    cut = placed.where(F.col("_range") == F.col("cut_range")).withColumn("_part", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("rest") - before)).cast("long"))
    return whole.unionByName(cut).withColumn("_taken", F.col("epochs") * F.col("_size") + F.col("_part"))


def mix(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "mix", rows_per_range: int = 5_000) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    taken is epochs * size plus what of the document lies before the cut in the last,
    partial epoch; a source's taken words are its target rounded to a whole number. Keys
    are md5(seed, id, source, md5(text)). A source's key space is cut into equal ranges of about
    rows_per_range rows, so a source with a third of all rows is summed in as many pieces;
    range totals are prefix-summed per source, and only the range that the cut falls into
    is sorted row by row.
    """
    small = materialize(_sized(docs, text_col, id_col, source_col, seed), "mix-sizes")
    plan, few = _plan(small, weights, most_epochs, rows_per_range)
    return _taken(small, plan, few).select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def draw(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), most_epochs: int = 3, seed: str = "mix", rows_per_range: int = 5_000, length_col: str | None = "n_chars") -> DataFrame:
    """The mixed corpus itself, with the columns of docs: a document appears once for each whole epoch it is taken in; the one at a cut ends at the cut's word (its words joined by single spaces).

    Documents without words carry nothing to a mix and appear once. length_col, where docs
    has it, is set to the length of a text that was cut.
    """
    small = materialize(_sized(docs, text_col, id_col, source_col, seed).select("_source", "_size", "_key"), "mix-sizes")
    plan, few = _plan(small, weights, most_epochs, rows_per_range)
    taken = _taken(_sized(docs, text_col, id_col, source_col, seed, with_row=True), plan, few)
    copies = F.when(F.col("_size") == 0, F.lit(1)).otherwise(F.ceil(F.col("_taken") / F.col("_size"))).cast("int")
    rows = taken.where(copies > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies)))
    words = F.least(F.col("_size"), F.col("_taken") - (F.col("_copy") - 1) * F.col("_size"))
    own = lambda c: F.col(f"_row.`{c}`")
    text = F.coalesce(own(text_col).cast("string"), F.lit(""))
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    rows = rows.withColumn("_cut", words < F.col("_size")).withColumn("_text", F.when(F.col("_cut"), head).otherwise(own(text_col)))
    out = {c: own(c) for c in docs.columns} | {text_col: F.col("_text")}
    if length_col in docs.columns:
        out[length_col] = F.when(F.col("_cut"), F.length("_text").cast(docs.schema[length_col].dataType)).otherwise(own(length_col))
    return rows.select(*[v.alias(c) for c, v in out.items()])
