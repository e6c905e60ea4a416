"""Substring dedup over sliding sentence spans (operator 2).

Texts are cut into sentences (clauses count: they also end at commas, colons and line
breaks; a stretch without any such mark for long is cut by winnowing: after each word whose
hash is the smallest, or as small, in a window of CUT_WINDOW words. Cuts then depend on
nearby words only and are never further apart, so equal passages are cut alike wherever
they stand, and one of 4 * CUT_WINDOW + WORDS - 3 = 49 words without marks always has a
run of its own). In scripts without spaces characters are winnowed in the same way, and what
lies between two cuts counts as a word and as a sentence. For every sentence the
shortest run of at least SENTENCES consecutive sentences with at least WORDS words is
hashed. Runs are joined over all documents; the sentences of every occurrence but the
first (in order of doc_id, nulls last, then place) are removed.

Defined results for odd input: a null text is empty and keeps nothing; long texts are
treated whole; rows that agree in doc_id and text are the same document: they get the same
result, and one never removes sentences of the other; rows that share a doc_id but not
the text are documents of their own; an empty table gives an empty result; other columns
pass through remove() and are ignored by scan().
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize, salted_join, text_of, whole_row

SENTENCES, WORDS = 3, 20
#: A sentence of LONG_WORDS is also cut after every word whose hash is the smallest in some window of CUT_WINDOW.
LONG_WORDS, CUT_WINDOW = 16, 8
#: The same window in characters, for words of more than that many ideographs or kana, and of letters of Thai, Lao, Tibetan, Burmese or Khmer: about two and five characters go to a cut, as to a word.
IDEOGRAPH_WINDOW, LETTER_WINDOW = 3, 8
#: What is removed per document travels by broadcast below this many bytes (they are summed first), by shuffle above.
MOST_BROADCAST_BYTES = 48 << 20

_MARKS = ".!?,;:|\\n。！？，；：、．｡､…؟،؛।॥"
_SENTENCE = re.compile(rf"[^{_MARKS}]*(?:[{_MARKS}]+\s*|\Z)")  # re's \s is what str.split() splits at
_WORD = re.compile(r"\s*\S+\s*")
_LETTERS = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff"
_UNSPACED = re.compile(f"[{_LETTERS}\u3005-\u3007\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_LETTER = re.compile(f"[{_LETTERS}]")


def _cuts(units: list[str], window: int) -> list[bool]:
    """Whether each unit's hash is the smallest, ties included, in any window of that many units."""
    h = [zlib.crc32(x.encode()) for x in units]
    least = [min(h[i : i + window]) for i in range(len(h) - window + 1)]
    return [x == max(least[max(0, i - window + 1) : i + 1], default=None) for i, x in enumerate(h)]


def _pieces(word: str) -> list[str]:
    """A word, with the white space around it, cut between characters, if it is of a script without spaces and long; nothing if not."""
    plain = word.strip()
    window = LETTER_WINDOW if _LETTER.search(plain) else IDEOGRAPH_WINDOW
    if len(plain) <= window or not _UNSPACED.search(plain):
        return []
    begin = word.index(plain)
    ends = [begin + i for i, cut in enumerate(_cuts([c.lower() for c in plain], window), 1) if cut and i < len(plain)]
    return [word[i:j] for i, j in zip([0, *ends], [*ends, len(word)], strict=True)]


def split(text: str) -> tuple[list[str], list[int], list[str]]:
    """The sentences of a text, which joined give the text, their numbers of words, and what is compared of them (case and white space don't count)."""
    parts, words, plain = [], [], []
    for s in _SENTENCE.findall(text):
        if not s:
            continue
        low = s.lower().split()
        unspaced = not s.isascii() and _UNSPACED.search(s)
        if len(low) < LONG_WORDS and not unspaced:
            parts.append(s), words.append(len(low)), plain.append(" ".join(low))
            continue
        cuts = _cuts(low, CUT_WINDOW) if len(low) >= LONG_WORDS else [False] * len(low)
        cuts[-1] = True
        held, at = [], 0
        for i, (w, cut) in enumerate(zip(_WORD.findall(s), cuts, strict=True), 1):
            if unspaced and (pieces := _pieces(w)):
                for x in pieces:
                    parts.append("".join([*held, x])), words.append(i - at), plain.append(" ".join(parts[-1].lower().split()))
                    held, at = [], i - 1
                at = i
                continue
            held.append(w)
            if cut:
                parts.append("".join(held)), words.append(i - at), plain.append(" ".join(low[at:i]))
                held, at = [], i
    return parts, words, plain


#: An odd multiplier and its inverse modulo 2**64: hashes of runs come from prefix sums, shifted back to the run's start.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNDO = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each shortest run: its hash, its first sentence, and its number of sentences. Case and white space don't count."""
    _, words, plain = split(text)
    at = [i for i, n in enumerate(words) if n]
    if len(at) < SENTENCES:
        return (np.zeros(0, np.int64),) * 3
    blake = hashlib.blake2b
    h = np.frombuffer(b"".join(blake(plain[i].encode(), digest_size=8).digest() for i in at), np.uint64)
    n = np.cumsum([0, *(words[i] for i in at)])
    first = np.arange(len(at))
    last = np.maximum(np.searchsorted(n, n[:-1] + WORDS), first + SENTENCES)  # one past the run's last sentence
    fits = last <= len(at)
    first, last = first[fits], last[fits]
    if not len(first):
        return (np.zeros(0, np.int64),) * 3
    with np.errstate(over="ignore"):
        power, undo = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(at), b)])) for b in (_BASE, _UNDO))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
        run = (sums[last] - sums[first]) * undo[first] + (last - first).astype(np.uint64)
        run ^= run >> np.uint64(29)
        run *= np.uint64(0xBF58476D1CE4E5B9)
        run ^= run >> np.uint64(32)
    places = np.asarray(at, np.int64)
    return run.view(np.int64), places[first], places[last - 1] - places[first] + 1


def _keys(text_col: str, id_col: str) -> tuple[Column, Column, Column]:
    """What tells documents apart: doc_id and a hash of the text; without a doc_id a second hash."""
    text = text_of(text_col)
    return F.col(id_col), F.xxhash64(text), F.when(F.col(id_col).isNull(), F.xxhash64(F.lit("termloom"), text))


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    doc_id, k1, k2 = _keys(text_col, id_col)
    return docs.select(doc_id.alias("doc_id"), k1.alias("k1"), k2.alias("k2"), text_of(text_col).alias("text"))


def repeated_spans(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, k1, k2, place, n, later) of every repeated span; later is false for the first of each, k1 and k2 are the text's hashes.

    A hash per sentence is counted (combined before the shuffle); only occurrences of hashes
    that were seen twice go on. Occurrences of a very common passage are dealt out by salt.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for begin in range(0, b.num_rows, 500):
                part = b.slice(begin, 500)
                found = [spans(t) for t in part.column(3).to_pylist()]
                at = pa.array(np.cumsum([0, *(len(f[0]) for f in found)]).astype(np.int32))
                span, place, n = (np.concatenate(x) for x in zip(*found, strict=True))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (span.astype(np.int64), place.astype(np.int32), n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *lists], names=["doc_id", "k1", "k2", "spans", "places", "sizes"])

    # written once, a row a document, so that texts are cut only once for counting and joining
    written = _keyed(docs, text_col, id_col).mapInArrow(emit, f"doc_id {kind}, k1 long, k2 long, spans array<bigint>, places array<int>, sizes array<int>")
    written = materialize(written.where(F.size("spans") > 0), "spans-written")
    occurrences = written.select("doc_id", "k1", "k2", F.inline(F.arrays_zip(F.col("spans").alias("span"), F.col("places").alias("place"), F.col("sizes").alias("n"))))
    repeated = materialize(written.select(F.explode("spans").alias("span")).groupBy("span").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1"), "spans-repeated")
    dealt_by = F.xxhash64("doc_id", "k1", "place")
    held = materialize(salted_join(occurrences, repeated, ["span"], "uses", dealt_by).drop("uses"), "spans-held")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2", "place")
    first = materialize(held.groupBy("span").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("uses")), "spans-first")
    return salted_join(held, first, ["span"], "uses", dealt_by).select("doc_id", "k1", "k2", "place", "n", (order != F.col("first")).alias("later"))


def _stretches(runs: list[int] | None) -> list[int]:
    """Packed runs as maximal stretches of sentences: [first, end, first, end, ...]."""
    if not runs:
        return []
    first, n = np.divmod(np.sort(np.array(runs, np.int64)), 1 << 31)
    end = np.maximum.accumulate(first + n)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > end[:-1]]))
    return np.column_stack([first[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]]).ravel().tolist()


def _merged(by_doc: DataFrame, kind: str) -> DataFrame:
    """Each document's later runs as stretches, and the number of its sentences in any repeated run, first ones too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            everything = [_stretches(r) for r in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "k1": b.column(1), "k2": b.column(2), "runs": pa.array([_stretches(r) for r in b.column(4).to_pylist()], pa.list_(pa.int32())),
                "repeated": pa.array([sum(s[1::2]) - sum(s[::2]) for s in everything], pa.int64()),
            })

    return by_doc.mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, runs array<int>, repeated long")


def _removals(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(row, runs, repeated): each row of docs, whole, with the stretches of sentences to remove (null or empty: none) and the number of its repeated ones."""
    packed = F.shiftleft(F.col("place").cast("long"), 31) + F.col("n")
    with dropped_after(docs.sparkSession):
        runs = repeated_spans(docs, text_col, id_col).groupBy("doc_id", "k1", "k2").agg(F.collect_set(packed).alias("any"), F.collect_set(F.when(F.col("later"), packed)).alias("later"))
        runs = materialize(_merged(runs, docs.schema[id_col].dataType.simpleString()), "spans-runs", outlives_scope=True)
    size = runs.agg(F.coalesce(F.sum(F.size("runs") * 4 + 56), F.lit(0))).first()[0]
    keys = _keys(text_col, id_col)
    keyed = docs.select(*[k.alias(f"d_{n}") for n, k in zip(("id", "k1", "k2"), keys, strict=True)], whole_row(docs).alias("row"))
    same = F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_k1") == F.col("k1")) & F.col("d_k2").eqNullSafe(F.col("k2"))
    return keyed.join(F.broadcast(runs) if size <= MOST_BROADCAST_BYTES else runs, same, "left").select("row", "runs", "repeated")


def _cut(text: str, runs: list[int] | None) -> tuple[str, int, int]:
    """The text left, its number of sentences and how many are removed."""
    parts = split(text)[0]
    if not runs:
        return text, len(parts), 0
    kept, at, removed = [], 0, 0
    for first, end in zip(runs[::2], runs[1::2], strict=True):
        kept += parts[at:first]
        removed += end - first
        at = end
    return "".join(kept + parts[at:]), len(parts), removed


def remove(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the repeated sentences taken out of their texts; length_col, where there is one, follows."""
    columns = docs.columns
    place, schema = columns.index(text_col), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).flatten()
            kept = [t if t is None else _cut(t, r)[0] if r else t for t, r in zip(own[place].to_pylist(), b.column(1).to_pylist(), strict=True)]
            own[place] = pa.array(kept, own[place].type)
            yield pa.RecordBatch.from_arrays(own, names=columns)

    kept = _removals(docs, text_col, id_col).select("row", "runs").mapInArrow(run, schema)
    if length_col in columns:
        kept = kept.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(schema[length_col].dataType)))
    return kept


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_sentences, n_repeated (sentences in repeated spans, first ones too), n_removed (sentences), removed_bytes, kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [_cut(t, r) for t, r in zip(texts, b.column(2).to_pylist(), strict=True)]
            kept = [f[0].encode() for f in found]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "n_sentences": pa.array([f[1] for f in found], pa.int64()), "n_repeated": pa.array([x or 0 for x in b.column(3).to_pylist()], pa.int64()), "n_removed": pa.array([f[2] for f in found], pa.int64()),
                "removed_bytes": pa.array([len(t.encode()) - len(k) for t, k in zip(texts, kept, strict=True)], pa.int64()), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            })

    rows = _removals(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), "text", "doc_id")
    return rows.select("row.doc_id", "row.text", "runs", "repeated").mapInArrow(run, f"doc_id {kind}, n_sentences long, n_repeated long, n_removed long, removed_bytes long, kept_sha256 string")
