"""Token counts (operator 10) from pre-token frequencies, without materialising ids.

Texts become pre-token frequencies; the distinct pre-tokens of all documents form one
dictionary in which the pieces of each are counted once; frequencies are joined to it and
summed per document.

Defined results for odd input: null is the empty text (0 tokens); texts of any length are
counted whole; every row is counted for itself, so repeated rows and rows with a null
doc_id keep their own counts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import materialize, salted_join, text_of
from termloom.llm.unicode_classes import Classes, library_classes

#: How the byte-level tokenizer cuts a text (a public pattern; fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Spaces where a text can't be cut into stretches that are split alone.
ODD_SPACE = r" (?=\s|\Z)"
#: The most frequent pre-tokens, which tasks look up in a broadcast table of at most this many entries and these bytes each.
HEAD_ENTRIES, HEAD_BYTES = 250_000, 32
#: Stretches whose sums a task remembers, and distinct stretches it holds before it hands them to the shuffle.
REMEMBERED, MOST_HELD = 250_000, 400_000
#: Longer stretches are cut at once and longer pre-tokens go straight to the shuffle, so that what a task holds is bounded in bytes too.
LONG = 256


class PreTokens:
    """Cuts texts into stretches (what stands between single spaces), whose pre-tokens don't depend on their neighbours."""

    def __init__(self, special: list[str], classes: Classes) -> None:
        self.whole, self.plain = (tuple(map(c.compile, (PRE_TOKEN, ODD_SPACE))) for c in (classes, classes.ascii()))
        self.special = set(special)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def stretches(self, text: str) -> tuple[list[str], list[str], int]:
        """Stretches that follow a space, pre-tokens of the rest, and the number of special strings (a token each)."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        spaced: list[str] = []
        loose: list[str] = []
        special = 0
        for part in parts:
            if part in self.special:
                special += 1
                continue
            pattern, odd_space = self.plain if part.isascii() else self.whole
            if odd_space.search(part):
                loose += pattern.findall(part)
            elif part:
                units = part.split(" ")
                loose += pattern.findall(units[0])
                spaced += units[1:]
        return spaced, loose, special

    def tokens(self, stretch: str) -> list[str]:
        """The pre-tokens of a stretch that follows a space."""
        return (self.plain if stretch.isascii() else self.whole)[0].findall(" " + stretch)

    def count(self, text: str) -> tuple[Counter, int]:
        """Frequencies of pre-tokens, and the number of special strings."""
        spaced, loose, special = self.stretches(text)
        out = Counter(loose)
        for stretch, n in Counter(spaced).items():
            for t in self.tokens(stretch):
                out[t] += n
        return out, special


class Summer:
    """Pieces of texts as far as a bounded table of frequent pre-tokens knows them, and the frequencies of the others."""

    def __init__(self, cutter: PreTokens, head: dict[str, int]) -> None:
        self.cutter, self.head = cutter, head
        self.known: dict[str, int] = {}  # stretches whose pre-tokens are all in head

    def sum(self, text: str) -> tuple[int, dict[str, int]]:
        spaced, loose, total = self.cutter.stretches(text)
        head, rest = self.head, {}
        for t in loose:
            if (k := head.get(t)) is None:
                rest[t] = rest.get(t, 0) + 1
            else:
                total += k
        pieces = list(map(self.known.get, spaced))
        total += sum(filter(None, pieces))
        if None in pieces:
            for stretch, n in Counter([s for s, k in zip(spaced, pieces, strict=True) if k is None]).items():
                tokens = self.cutter.tokens(stretch)
                found = [head.get(t) for t in tokens]
                if None in found:
                    for t, k in zip(tokens, found, strict=True):
                        if k is None:
                            rest[t] = rest.get(t, 0) + n
                        else:
                            total += k * n
                else:
                    total += sum(found) * n
                    if len(stretch) <= 64:
                        if len(self.known) >= REMEMBERED:
                            self.known.clear()
                        self.known[stretch] = sum(found)
        return total, rest


def pre_token_dictionary(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """(token, n_uses, n_pieces): each distinct pre-token of all texts, how often it is used, and its number of pieces, counted once."""
    spark = docs.sparkSession
    model, classes = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read()), spark.sparkContext.broadcast(library_classes())

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, units, seen = PreTokens(_special(model.value), classes.value), Counter(), Counter()
        table = lambda found: pa.RecordBatch.from_pydict({"token": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})

        def give() -> pa.RecordBatch:
            for stretch, n in units.items():
                for t in cutter.tokens(stretch):
                    seen[t] += n
            out = table(seen)
            units.clear(), seen.clear()
            return out

        for batch in batches:
            for t in batch.column(0):
                spaced, loose, _ = cutter.stretches(t.as_py())
                if spaced and len(max(spaced, key=len)) > LONG:
                    loose += [x for s in spaced if len(s) > LONG for x in cutter.tokens(s)]
                    spaced = [s for s in spaced if len(s) <= LONG]
                if loose and len(max(loose, key=len)) > LONG:
                    yield table(Counter(x for x in loose if len(x) > LONG))
                    loose = [x for x in loose if len(x) <= LONG]
                units.update(spaced)
                seen.update(loose)
                if len(units) + len(seen) > MOST_HELD:
                    yield give()
        yield give()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(model.value)
        tok.no_truncation(), tok.no_padding()
        for batch in batches:
            found = tok.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_pydict({"token": batch.column(0), "n_uses": batch.column(1), "n_pieces": pa.array([len(e.ids) for e in found], pa.int64())})

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(distinct, "token string, n long").groupBy("token").agg(F.sum("n").alias("n_uses"))
    return counted.mapInArrow(pieces, "token string, n_uses long, n_pieces long")


def _special(model: str) -> list[str]:
    import json

    return [t["content"] for t in json.loads(model)["added_tokens"]]


def _least_uses(dictionary: DataFrame) -> int:
    """The smallest number of uses that at most HEAD_ENTRIES entries have: exact counts of uses up to 4,096, above them steps of 1/64 of a power of two, so that counting them takes a few thousand rows."""
    power = F.floor(F.log2("n_uses"))
    step = F.when(F.col("n_uses") <= 4096, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), power - 6).cast("long"))
    below = (F.floor(F.col("n_uses") / step) * step).cast("long")
    total = 0
    for least, n in sorted(dictionary.groupBy(below.alias("least")).count().collect(), reverse=True):
        total += n
        if total > HEAD_ENTRIES:
            return least + 1 if least <= 4096 else least + int(2 ** (least.bit_length() - 7))
    return 1


def count_tokens(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", limit: int = 512) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    The dictionary is written once. Its most frequent entries (HEAD_ENTRIES at most, short
    ones only, so at most 250,000 * 32 bytes of strings whatever the input) go to every task,
    which sums them on the spot; all other frequencies are shuffled by pre-token, joined
    to the dictionary and summed per row. Rows get an id when they are written, so that
    equal documents stay apart.
    """
    spark = docs.sparkSession
    model, classes = spark.sparkContext.broadcast(open(tokenizer_path, encoding="utf-8").read()), spark.sparkContext.broadcast(library_classes())
    dictionary = materialize(pre_token_dictionary(docs, tokenizer_path, text_col), "token-dictionary")
    short = dictionary.where(F.octet_length("token") <= HEAD_BYTES)
    top = short.where(F.col("n_uses") >= _least_uses(short)).select("token", "n_pieces")
    head = spark.sparkContext.broadcast(dict(zip(*(c.to_pylist() for c in top.toArrow().columns), strict=True)))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summer = Summer(PreTokens(_special(model.value), classes.value), head.value)
        for batch in batches:
            sums, tokens, counts = [], [], []
            for t in batch.column(1):
                total, rest = summer.sum(t.as_py())
                sums.append(total)
                tokens.append(list(rest))
                counts.append(list(rest.values()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": batch.column(2), "head_tokens": pa.array(sums, pa.int64()), "tokens": pa.array(tokens, pa.list_(pa.string())), "counts": pa.array(counts, pa.list_(pa.int32()))})

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, head_tokens long, tokens array<string>, counts array<int>")
    rows = materialize(rows.withColumn("row_id", F.monotonically_increasing_id()), "token-frequencies")
    tail = rows.select("row_id", F.explode(F.arrays_zip("tokens", "counts")).alias("x")).select("row_id", F.col("x.tokens").alias("token"), F.col("x.counts").alias("n"))
    sums = salted_join(tail, dictionary, ["token"], "n_uses", F.col("row_id")).groupBy("row_id").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("tail_tokens"))
    total = (F.col("head_tokens") + F.coalesce(F.col("tail_tokens"), F.lit(0))).cast("long")
    return rows.select("row_id", "doc_id", "n_bytes", "head_tokens").join(sums, "row_id", "left").select("doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
