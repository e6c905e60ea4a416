"""Toxicity (operator 8): a weighted lexicon matched by Aho-Corasick.

Texts are folded first: compatibility forms, accents, homoglyphs of other scripts, and
digits or signs standing for letters inside words (l, i and 1 count as one letter). The
lexicon holds stems of four letters or more that match at the start of a word, shorter
words that match whole, and, for scripts without spaces, runs of characters that match
anywhere; its weights are log odds learned from labelled documents. Hits inside exception phrases don't count. A text's weight is
the sum over its distinct entries, damped by their repetitions and normalised by length (as much as
explains the training rows best); a logistic curve fitted on them turns it into a score.

Defined results for odd input: a null or empty text has no hits and the score of a text
without any; long texts are scored whole; rows are independent, so repeated rows agree; a
row with a null doc_id is not held out and is scored, but never used for training, as
with labels that are null; without labels a small built-in lexicon serves; empty tables
give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize, text_of

#: Letters of other scripts that look like Latin ones, in code-point order of the look-alike.
HOMOGLYPHS = {
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
}
#: Digits and signs that stand for letters inside a word.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "i"}
#: The lexicon where there are no labels to learn one from, and phrases in which its words mean no offence.
BASE_LEXICON = ("clown", "disgusting", "dumb", "fool", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
EXCEPTIONS = ("clown fish", "circus clown", "fool proof", "foolproof", "sore loser", "trash bag", "trash bin", "trash can", "white trash bag")
#: Labelled documents that the lexicon and the curve are fitted on, at most; a hash of doc_id picks them. The lexicon itself has no bound of its own: it can't hold more than the words of these documents.
TRAINING_ROWS = 20_000
#: Letters of stems (shorter words are entries as they are), characters of runs in scripts without spaces, and what an entry needs: the share of toxic documents and the surprise (nats) over the base rate of PURE or of MIXED.
STEM_LETTERS, RUN_CHARACTERS, PURE, MIXED = (4, 8), (2, 4), (0.8, 16.0), (0.5, 40.0)
#: How strongly a text's length may count against its weight; the training rows decide.
LENGTH_POWERS = (0.05, 0.1, 0.2, 0.4, 0.8)

_TABLE = str.maketrans(HOMOGLYPHS)
_MIXED = regex.compile(r"[a-z0-9@$!|]*(?:[a-z][0-9@$!|]+[a-z]|(?<![a-z0-9@$!|])[0-9@$]+[a-z]{2})[a-z0-9@$!|]*")
_SPELLED = regex.compile(r"(?<![a-z])(?:[a-z][.\-_*]){3,}[a-z](?![a-z])")
_RUNS = regex.compile(r"([a-z])\1{2,}")
_SIGNS, _SIGN = str.maketrans(SUBSTITUTES), regex.compile("[" + "".join(map(regex.escape, SUBSTITUTES)) + "]")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")


def fold(text: str) -> str:
    """text with look-alikes, accents, invisible marks, digit substitutes, letters spelled with dots, letters drawn out and case folded away."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text)).translate(_TABLE)
    if _SIGN.search(text):
        text = _MIXED.sub(lambda m: m[0].rstrip("!|").translate(_SIGNS) + m[0][len(m[0].rstrip("!|")) :], text)
    text = _SPELLED.sub(lambda m: m[0][::2], text)
    return _RUNS.sub(r"\1", text).replace("l", "i")


_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")
_WORD = regex.compile(r"[^\W\d_\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]+")


def words_of(folded: str) -> set[str]:
    """The distinct words of a folded text, and the runs of characters of scripts without spaces."""
    out = set(_WORD.findall(folded))
    if not folded.isascii():
        for run in _UNSPACED.findall(folded):
            out.update(run[i : i + k] for k in range(RUN_CHARACTERS[0], RUN_CHARACTERS[1] + 1) for i in range(len(run) - k + 1))
    return out


@dataclass
class Lexicon:
    """Entries with weights, exception phrases (all folded), and the curve of the score."""

    weights: dict[str, float]
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = -1.2
    length_power: float = 0.1

    def matcher(self) -> Matcher:
        return Matcher(self)


def kind(entry: str) -> str:
    """How an entry matches: "run" anywhere, "word" as a whole word, "stem" at the start of a word."""
    return "run" if _UNSPACED.fullmatch(entry) else "word" if len(entry) < STEM_LETTERS[0] else "stem"


class Matcher:
    def __init__(self, lexicon: Lexicon) -> None:
        import ahocorasick

        self.lexicon, self.automaton = lexicon, None
        entries = {s: (len(s), s, kind(s)) for s in lexicon.weights if s} | {x: (len(x), x, "exception") for x in lexicon.exceptions if x}
        if entries:
            self.automaton = ahocorasick.Automaton()
            for s, x in entries.items():
                self.automaton.add_word(s, x)
            self.automaton.make_automaton()

    def hits(self, folded: str) -> Counter:
        """How often each entry occurs, as its kind asks, outside exception phrases."""
        out: Counter = Counter()
        if self.automaton is None:
            return out
        found, spared = [], []
        for last, (length, entry, how) in self.automaton.iter(folded):
            begin, end = last + 1 - length, last + 1
            if how != "run" and begin and _WORD.match(folded, begin - 1):
                continue
            if how in ("word", "exception") and end < len(folded) and _WORD.match(folded, end):
                continue
            if how == "exception":
                spared.append((begin, end))
            else:
                found.append((begin, entry))
        if spared:  # as stretches that don't overlap, in order
            spared.sort()
            merged = [list(spared[0])]
            for begin, end in spared[1:]:
                if begin <= merged[-1][1]:
                    merged[-1][1] = max(end, merged[-1][1])
                else:
                    merged.append([begin, end])
            starts = [a for a, _ in merged]
            found = [(b, e) for b, e in found if not (k := bisect_right(starts, b)) or b >= merged[k - 1][1]]
        out.update(e for _, e in found)
        return out

    def raw_weight(self, text: str) -> tuple[float, int]:
        """The weight of a text before its length counts, and its number of hits."""
        hits = self.hits(fold(text))
        return sum(self.lexicon.weights[s] * (1 + math.log(n)) for s, n in sorted(hits.items())), sum(hits.values())

    def score(self, text: str) -> tuple[float, int]:
        x, n = self.raw_weight(text)
        x = float(normalised(x, len(text), self.lexicon.length_power))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.lexicon.slope * x + self.lexicon.bias)))), n


def normalised(weight: float, length: float, power: float) -> float:
    """A weight divided by what a text of that length should have more than one of a thousand characters."""
    return weight / (1 + power * np.log1p(length / 1000))


def held_out(id_col: str) -> Column:
    """Rows kept from training: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str) -> DataFrame:
    """(text, toxic) of the bounded training sample, equal texts once."""
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(F.col(id_col).alias("label_id")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(TRAINING_ROWS)
    )
    rows = docs.select(F.col(id_col).alias("label_id"), text_of(text_col).alias("text")).join(F.broadcast(picked), "label_id")  # at most TRAINING_ROWS rows of two numbers
    return rows.groupBy(F.xxhash64("text"), F.xxhash64(F.lit("termloom"), "text")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic")


def learn(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Lexicon:
    """A lexicon from the rows of labels that are not held out.

    Word counts of at most TRAINING_ROWS documents are summed in Spark; the entries that
    reach the driver are those whose share of toxic documents is far above the base rate,
    all of them. A stem is left out if a shorter form of it is in the lexicon and tells as
    much; a word that has a stem of the lexicon but is mostly in clean documents becomes
    an exception.
    """
    with dropped_after(docs.sparkSession):
        return _learned(materialize(_training(docs, labels, text_col, id_col, label_col), "toxicity-training"))


def _learned(train: DataFrame) -> Lexicon:
    n_toxic, n_all = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    base = Lexicon({fold(w): 3.0 for w in BASE_LEXICON}, tuple(fold(x) for x in EXCEPTIONS))
    if not n_toxic or n_toxic == n_all:
        return base

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[y].update(words_of(fold(t)))
            seen = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(seen, pa.string()), "stems": pa.array([kind(w) == "stem" for w in seen], pa.bool_()),
                "toxic": pa.array([counts[1][w] for w in seen], pa.int64()), "clean": pa.array([counts[0][w] for w in seen], pa.int64()),
            })

    by_word = train.mapInArrow(words, "word string, stems boolean, toxic long, clean long").groupBy("word", "stems").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    by_word = materialize(by_word, "toxicity-words")
    lengths = F.when(F.col("stems"), F.sequence(F.lit(STEM_LETTERS[0]), F.least(F.length("word"), F.lit(STEM_LETTERS[1])))).otherwise(F.array(F.length("word")))
    entries = by_word.withColumn("k", F.explode(lengths)).groupBy(F.expr("substring(word, 1, k)").alias("entry")).agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    rate, share = F.lit(n_toxic / n_all), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    surprise = (F.col("toxic") + F.col("clean")) * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    enough = [(share >= F.lit(least)) & (surprise >= F.lit(nats)) for least, nats in (PURE, MIXED)]
    strong = entries.where((F.col("toxic") > 0) & (share > rate) & (enough[0] | enough[1])).collect()  # words of the bounded sample
    weights: dict[str, float] = {}
    shares: dict[str, float] = {}
    for entry, toxic, clean in sorted(strong, key=lambda r: (len(r[0]), r[0])):
        shorter = [shares[entry[:k]] for k in range(STEM_LETTERS[0], len(entry)) if entry[:k] in shares]
        if not shorter or toxic / (toxic + clean) > max(shorter) + 0.1:
            shares[entry] = toxic / (toxic + clean)
            weights[entry] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_all - n_toxic + 1))
    stems = sorted({s[: STEM_LETTERS[0]] for s in weights if kind(s) == "stem"})
    clean_words = by_word.where("stems AND clean >= 5 AND clean > 4 * toxic").join(
        F.broadcast(train.sparkSession.createDataFrame([(s,) for s in stems], "stem string")), F.substring("word", 1, STEM_LETTERS[0]) == F.col("stem")).select("word").collect()
    spared = tuple(sorted(w for (w,) in clean_words if any(w[:k] in weights for k in range(STEM_LETTERS[0], STEM_LETTERS[1] + 1))))
    lexicon = Lexicon(weights or base.weights, (*base.exceptions, *spared))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = lexicon.matcher()
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"x": pa.array([m.raw_weight(t)[0] for t in texts], pa.float64()), "length": pa.array([len(t) for t in texts], pa.float64()), "y": b.column(1)})

    x, length, y = (c.to_numpy() for c in train.mapInArrow(weigh, "x double, length double, y int").toArrow().columns)  # at most TRAINING_ROWS rows of three numbers
    _, lexicon.length_power, lexicon.slope, lexicon.bias = min((loss, p, slope, bias) for p in LENGTH_POWERS for slope, bias, loss in [_fit(normalised(x, length, p), y)])
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Slope and bias of a logistic curve, by Newton steps with a weak prior, and its loss."""
    order = np.lexsort((y, x))
    x, y = x[order].astype(float), y[order].astype(float)
    m = np.column_stack([x, np.ones_like(x)])
    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(m @ beta, -30, 30)))
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 0.05 * np.eye(2), m.T @ (y - p) - 0.05 * beta)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope, bias = max(float(beta[0]), 1e-3), float(beta[1])
    margin = np.clip(slope * x + bias, -30, 30) * np.where(y > 0, 1, -1)
    return slope, bias, float(np.log1p(np.exp(-margin)).sum())


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", id_col: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_hits. The lexicon (bounded by the training sample) goes to every task; no shuffle."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)
    id_kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value.matcher()
        for b in batches:
            found = [m.score(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(0), "held_out": b.column(1), "score": pa.array([s for s, _ in found], pa.float64()),
                "predicted": pa.array([int(s >= threshold) for s, _ in found], pa.int32()), "n_hits": pa.array([n for _, n in found], pa.int64()),
            })

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_kind}, held_out boolean, score double, predicted int, n_hits long")


def reject(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score at or above threshold; all columns stay. Null and empty texts, which say nothing, stay whatever a text without words scores."""
    known = docs.sparkSession.sparkContext.broadcast(lexicon)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value.matcher()
        for b in batches:
            yield b.filter(pa.array([not (text := t.as_py()) or m.score(text)[0] < threshold for t in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
