"""A training corpus from documents in five stages; each calls one operator of termloom.llm.

Documents that score as toxic go; of each class of near-duplicates one document stays;
strings that repeat across what is left are cut out; sources are mixed to their target
weights (a document comes once for each epoch it is taken in); the mix is encoded.

Defined results for odd input, in every stage: null and empty texts are never toxic, never
copies, lose nothing and take no part of a mix's words (they are passed on once); very
long texts are treated whole; of rows that agree in doc_id and text one stays after the
near-duplicates, rows with the same doc_id and other texts are documents of their own;
rows with a null doc_id take part; columns of documents are passed on, whatever their
names; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termloom.llm import bpe, lsh_forest, mixing, suffix_dedup, toxicity
from termloom.llm.common import materialize, table
from termloom.llm.queries import tokenizer_file

#: No SQL for thresholds learned from labels, MinHash, suffixes and BPE; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that operator 8 predicts to be toxic; it learns from the labelled documents among docs, or takes a built-in lexicon if none is labelled."""
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of operator 4: the one with the smallest doc_id (null last), then text."""
    return lsh_forest.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose texts have lost what operator 1 finds repeated: every occurrence, the first one too, as that operator is defined."""
    return suffix_dedup.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus that operator 5 draws from docs: a document once for each epoch it is taken in, the one at a cut shortened."""
    return mixing.draw(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests by operator 6."""
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), most_remembered=150_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
