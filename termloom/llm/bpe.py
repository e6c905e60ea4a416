"""BPE encoding and decoding (operator 6) by a queue of merge ranks over a linked symbol list.

Encoding: special strings are cut out of the raw text first; the rest is normalised
(NFC, white space, lower case, by the library's character tables), split into words, mapped to byte symbols, and merged: all
adjacent pairs that have a rank wait in a priority queue; the lowest (rank, place) is
merged by relinking its neighbours, and entries whose symbols have meanwhile changed are
stale and skipped. Decoding joins the vocabulary strings of the ids.

Defined results for odd input: null is the empty text (no tokens, empty hashes' input);
texts of any length are encoded whole; rows are independent, so repeated rows repeat
their result and a null doc_id is passed on; an empty table gives an empty result;
columns other than the id and text columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import text_of
from termloom.llm.unicode_classes import Classes, library_classes

#: Characters that str.split() takes for white space but Unicode's White_Space does not.
NOT_WHITE = re.compile("[\x1c-\x1f]")
#: Longer stretches and words aren't remembered, so that what a task holds is bounded.
REMEMBERED_LENGTH = 64
#: Marks that are a word of their own after a word.
STOPS = frozenset(",.!?;:")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where printable, else from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class MergeTable:
    """Merges and vocabulary of one BPE model."""

    def __init__(self, vocab: dict[str, int], merges: list, end_of_word: str = "") -> None:
        self.vocab = vocab
        self.end_of_word = end_of_word
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(a, b): (i, a + b) for i, (a, b) in enumerate(pairs)}

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols left when no adjacent pair has a rank."""
        n = len(symbols)
        if n < 2:
            return symbols
        rank = self.rank
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := rank.get((symbols[i], symbols[i + 1])):
                queue.append((found[0], i, found[1]))
        heapify(queue)
        alive = [*symbols, None]
        while queue:
            at, i, merged = heappop(queue)
            left = alive[i]
            if left is None or (j := after[i]) >= n:
                continue
            found = rank.get((left, alive[j]))
            if not found or found != (at, merged):
                continue  # stale: a neighbour was merged meanwhile
            alive[i], alive[j] = merged, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := rank.get((merged, alive[k])):
                    heappush(queue, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := rank.get((alive[h], merged))):
                heappush(queue, (found[0], h, found[1]))
        return [s for s in alive if s is not None]

    def word_ids(self, symbols: list[str]) -> list[int]:
        if self.end_of_word and symbols:
            symbols = [*symbols[:-1], symbols[-1] + self.end_of_word]
        vocab = self.vocab
        return [vocab[s] for s in self.merge(symbols) if s in vocab]


class WordBpe:
    """The encoder and decoder of a lower-casing tokenizer file with word ends; other normalisers or pre-tokenizers are refused."""

    def __init__(self, model: str, classes: Classes, most_chunks: int = 200_000, most_pieces: int = 300_000) -> None:
        spec = json.loads(model)
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or split["type"] != "Split" or not split["invert"] or level["type"] != "ByteLevel" or spec["decoder"] or spec["post_processor"]:
            raise ValueError("not a tokenizer of this kind")
        self.table = MergeTable(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"] or "")
        self.words, self.white, self.odd = classes.compile(split["pattern"]["Regex"]), re.compile(f"[{classes.spaces}]+"), re.compile(f"[{classes.odd}]")
        self.ascii_words, self.lower = classes.ascii().compile(split["pattern"]["Regex"]), classes.lower
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.string_of = {str(i): s for s, i in [*self.table.vocab.items(), *self.special.items()]}
        self.symbols = byte_symbols()
        self.most_chunks, self.most_pieces, self.chunks, self.pieces = most_chunks, most_pieces, {}, {}

    def piece_ids(self, piece: str) -> str:
        """The ids of one pre-token, joined by spaces; short ones are remembered, up to a bound."""
        found = self.pieces.get(piece)
        if found is None:
            symbols = self.symbols
            found = " ".join(map(str, self.table.word_ids([symbols[b] for b in piece.encode()])))
            if len(piece) <= REMEMBERED_LENGTH:
                if len(self.pieces) >= self.most_pieces:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def chunk_ids(self, chunk: str) -> str:
        """The ids of a stretch without white space."""
        odd = not chunk.isascii() and self.odd.search(chunk) is not None
        low = self.odd_lower(chunk) if odd else chunk.lower() if chunk.isascii() else unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()  # capital sigma never becomes a final one
        if odd:
            found = " ".join(x for x in map(self.piece_ids, self.words.findall(low)) if x)
        elif low.isalpha():  # one word, as most are
            found = self.piece_ids(low)
        elif low[-1:] in STOPS and low[:-1].isalpha():
            found = f"{self.piece_ids(low[:-1])} {self.piece_ids(low[-1])}"
        else:
            found = " ".join(x for x in map(self.piece_ids, (self.ascii_words if low.isascii() else self.words).findall(low)) if x)
        if len(chunk) <= REMEMBERED_LENGTH:
            if len(self.chunks) >= self.most_chunks:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def odd_lower(self, chunk: str) -> str:
        """Composed and lower-cased by the library's tables, for the rare characters that Python's know differently or not at all."""
        from tokenizers import normalizers

        return "".join(self.lower.get(c, c.lower()) for c in normalizers.NFC().normalize_str(chunk))

    def segment_ids(self, text: str) -> str:
        chunks, known = (self.white.split(text) if NOT_WHITE.search(text) else text.split()), self.chunks
        return " ".join(filter(None, [known[c] if c in known else self.chunk_ids(c) for c in chunks]))

    def encode(self, text: str) -> str:
        """The ids of a text, as decimal numbers joined by one space."""
        if "<|" not in text:
            return self.segment_ids(text)
        return " ".join(filter(None, [str(self.special[x]) if x in self.special else self.segment_ids(x) for x in self.cut.split(text)]))

    def decode(self, ids: str) -> str:
        """The vocabulary strings of the ids; without a decoder in the file they are joined by one space."""
        return " ".join(map(self.string_of.__getitem__, ids.split(" "))) if ids else ""


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded"), most_remembered: int = 500_000) -> DataFrame:
    """One row per document: doc_id and the outputs asked for, in that order, of ids (decimal, joined by one space), decoded, n_tokens, ids_sha256 and decoded_sha256.

    The model file (under 2 MB) is read by the driver and broadcast. No shuffle; only what
    is asked for leaves a task. A task remembers the ids of most_remembered stretches and
    words at most, which changes its speed and memory only.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((open(model_path, encoding="utf-8").read(), library_classes()))
    kinds = {"ids": "string", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    schema = ", ".join([f"doc_id {docs.schema[id_col].dataType.simpleString()}", *(f"{o} {kinds[o]}" for o in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordBpe(*model.value, most_remembered * 2 // 5, most_remembered * 3 // 5)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            out: dict[str, list] = {o: [] for o in outputs}
            for t in batch.column(1):
                ids = coder.encode(t.as_py())
                decoded = coder.decode(ids)
                row = {"ids": ids, "decoded": decoded, "n_tokens": ids.count(" ") + 1 if ids else 0}
                for o in outputs:
                    out[o].append(sha(row[o[:-7]]) if o.endswith("_sha256") else row[o])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | {o: pa.array(v, pa.int64() if o == "n_tokens" else pa.string()) for o, v in out.items()})

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)
