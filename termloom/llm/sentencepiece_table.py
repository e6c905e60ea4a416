"""SentencePiece encoding and decoding (operator 11) by a table of distinct marked words.

A piece that holds a white-space marker after another character holds nothing but markers,
so no merge crosses from a character to the marker that follows it: a text falls into
chunks (markers and the word after them) that are segmented alike wherever they stand.
Where no piece holds a letter beside another character, a chunk ends between these as well,
and characters that no piece holds, such as the line feed, stand alone.
The distinct chunks of all texts form one table, in which each is segmented once; texts are
the ids of their chunks, joined back by position. The most used entries, up to a bound in
bytes, are looked up where the texts are; the places of all others are filled by a join
with the table. Decoding joins the vocabulary strings of the ids: byte pieces become text
again run by run, and the marker put before the text is taken off.

Defined results for odd input: null is the empty text (no ids, decoded to the empty text);
texts of any length are encoded whole, chunks of any length too; every row is encoded for
itself, so repeated rows and rows with a null doc_id keep their own results; an empty table
gives an empty result; other columns are ignored. A marker character in a text can't be
told from a blank, as in the library, and comes back as a blank.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush
from math import inf
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import materialize, salted_join, text_keys, text_of

MARKER = "▁"
#: Bytes of the most used chunks and their ids that every task can look up, packed, with what an entry takes besides its strings.
HEAD_BYTES, ENTRY_BYTES = 64 << 20, 13
#: So many of the most used of them are kept in a dictionary as well, if they aren't long.
QUICK, QUICK_CHUNK = 150_000, 64
#: Up to so many characters pairs are looked through instead of queued.
SHORT = 48
#: Chunks longer than this go straight to the shuffle; of shorter ones a task counts this many before it hands them on.
LONG_CHUNK, MOST_HELD = 256, 200_000
#: Bits of the bitmap of chunks that the table holds beyond the head, as a power of two (16 MB).
BITS = 27
#: In a coded text: an open chunk, one that is in no table, the end of the codes, and the code of the most used chunk.
OPEN, OWN, END, FIRST_CODE = "\x00", "\x01", "\x02", 3


@dataclass
class PieceModel:
    """What encoding and decoding need of a model file: ids of the mergeable pieces with their scores, byte ids, and the pieces by id."""

    score: dict[str, float]
    id_of: dict[str, int]
    byte_ids: list[int]
    strings: list[bytes]  # by id; what must break a run of bytes (control and unknown pieces) begins with 0xff
    dummy_prefix: bool
    alone: str  # control characters that no piece holds
    numerals: str | None  # of the pieces' characters those that \w holds beside letters; None if a piece holds a letter beside another character (markers before it excepted)
    bytes_of: dict[str, bytes] = field(init=False)
    byte_set: frozenset[int] = field(init=False)
    marked: frozenset[str] = field(init=False)  # ids of pieces that begin with a marker

    def __post_init__(self) -> None:
        self.bytes_of = {str(i): s for i, s in enumerate(self.strings)}
        self.byte_set = frozenset(self.byte_ids)
        self.marked = frozenset(str(i) for p, i in self.id_of.items() if p[0] == MARKER)

    def merge(self, chunk: str) -> list[str]:
        """The pieces of a chunk: of all adjacent pairs that form a piece the best scored is joined, the leftmost first, until none is left. Short chunks look through the scores of their pairs, long ones keep them in a queue."""
        if len(chunk) <= SHORT:
            return self._merge_short(chunk)
        symbols: list[str | None] = [*chunk]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        score = self.score
        queue = []
        for i in range(n - 1):
            if (s := score.get(pair := symbols[i] + symbols[i + 1])) is not None:
                queue.append((-s, i, pair))
        heapify(queue)
        while queue:
            _, i, pair = heappop(queue)
            if symbols[i] is None or (j := after[i]) >= n or symbols[i] + symbols[j] != pair:
                continue  # stale
            symbols[i], symbols[j] = pair, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score.get(new := pair + symbols[k])) is not None:
                    heappush(queue, (-s, i, new))
            if (h := before[i]) >= 0 and (s := score.get(new := symbols[h] + pair)) is not None:
                heappush(queue, (-s, h, new))
        return [s for s in symbols if s is not None]

    def _merge_short(self, chunk: str) -> list[str]:
        symbols, score, none = [*chunk], self.score.get, -inf
        scores = [score(a + b, none) for a, b in zip(chunk, chunk[1:], strict=False)]
        while scores and (best := max(scores)) > none:
            i = scores.index(best)
            symbols[i : i + 2] = [joined := symbols[i] + symbols[i + 1]]
            del scores[i]
            if i:
                scores[i - 1] = score(symbols[i - 1] + joined, none)
            if i < len(scores):
                scores[i] = score(joined + symbols[i + 1], none)
        return symbols

    def ids(self, chunk: str) -> str:
        """The ids of a chunk, joined by commas; characters without a piece are spelled in bytes."""
        pieces = self.merge(chunk.replace(" ", MARKER))
        found = list(map(self.id_of.get, pieces))
        if None in found:
            found = [i for piece, one in zip(pieces, found, strict=True) for i in ((one,) if one is not None else (self.byte_ids[b] for b in piece.encode()))]
        return ",".join(map(str, found))

    def decode(self, ids: str) -> str:
        """The text of ids joined by commas."""
        if not ids:
            return ""
        split = ids.split(",")
        try:
            text = b"".join(map(self.bytes_of.__getitem__, split)).decode()
        except UnicodeDecodeError:  # broken runs of bytes, control or unknown pieces
            return self._decode_slowly([int(i) for i in split])
        return text[1:] if self.dummy_prefix and split[0] in self.marked else text

    def _decode_slowly(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        first = True

        def close() -> None:
            data = bytes(run)
            run.clear()
            while data:
                for n in range(1, min(4, len(data)) + 1):
                    try:
                        out.append(data[:n].decode())
                    except UnicodeDecodeError:
                        continue
                    data = data[n:]
                    break
                else:
                    out.append("�")
                    data = data[1:]

        for i in ids:
            if i in self.byte_set:
                run += self.strings[i]
                continue
            close()
            if out:
                first = False
            s = self.strings[i]
            text = s[1:].decode() if s[:1] == b"\xff" else s.decode()
            if first and self.dummy_prefix and s[:1] == b" ":
                text, first = text[1:], False
            if text:
                out.append(text)
        close()
        return "".join(out)


def read_model(path: str) -> PieceModel:
    """The model of a file; kinds whose chunks can't be segmented alone are refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    norm, kinds = proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
    normal = {p: (i, s) for i, (p, s, t) in enumerate(pieces) if t == kinds.NORMAL}
    crossing = [p for p in normal if MARKER in p.lstrip(MARKER)]
    other = {t for _, _, t in pieces} - {kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN}
    if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or crossing or other:
        raise ValueError("not a merge model that keeps texts as they are and white space before words")
    byte_ids = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == kinds.BYTE}
    if len(byte_ids) != 256:
        raise ValueError("not a model with a piece for each byte")
    unknown = proto.trainer_spec.unk_surface if proto.trainer_spec.HasField("unk_surface") else " ⁇ "
    shown = {kinds.NORMAL: lambda p: p.replace(MARKER, " ").encode(), kinds.BYTE: lambda p: bytes([int(p[3:5], 16)]), kinds.CONTROL: lambda p: b"\xff", kinds.UNKNOWN: lambda p: b"\xff" + unknown.encode()}
    held = set("".join(normal))
    return PieceModel(
        score={p: s for p, (_, s) in normal.items()}, id_of={p: i for p, (i, _) in normal.items()}, byte_ids=[byte_ids[b] for b in range(256)],
        strings=[shown[t](p) for p, _, t in pieces], dummy_prefix=norm.add_dummy_prefix, alone="".join(c for c in "\n\r\t" if c not in held),
        numerals="".join(sorted(c for c in held if c.isalnum() and not c.isalpha() and not c.isdecimal())) if all(len({c.isalpha() for c in p.lstrip(MARKER)}) < 2 for p in normal) else None,
    )


class Chunks:
    """Cuts a text into chunks; a blank stands for the marker. Characters that no piece holds may fall on either side of a cut."""

    def __init__(self, model: PieceModel) -> None:
        self.start = " " if model.dummy_prefix else ""
        end, other = re.escape(model.alone), re.escape(model.numerals or "")
        word = rf" +[^ {end}]*|[^ {end}]+" if model.numerals is None else rf" *[^\W\d_{other}]+| *(?:[^\w {end}]+|[\d_{other}]+)+| +"
        self.cut = re.compile(word + (f"|[{end}]+" if end else "")).findall

    def of(self, text: str) -> list[str]:
        return self.cut(self.start + text.replace(MARKER, " ")) if text else []


def chunk_table(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """(chunk, n_uses, ids): each distinct chunk that all texts use at least twice, how often they do, and its ids joined by commas, segmented once.

    Tasks count their chunks before the shuffle, so that a chunk that every document holds
    is a row for each task there. A chunk with a single use is segmented once where it stands.
    """
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = Chunks(model.value).of, Counter()
        given = lambda found: pa.RecordBatch.from_pydict({"chunk": pa.array(list(found), pa.string()), "n": pa.array(list(found.values()), pa.int64())})
        for batch in batches:
            for t in batch.column(0):
                chunks = cut(t.as_py())
                if chunks and len(max(chunks, key=len)) > LONG_CHUNK:
                    yield given(Counter(c for c in chunks if len(c) > LONG_CHUNK))
                    chunks = [c for c in chunks if len(c) <= LONG_CHUNK]
                seen.update(chunks)
                if len(seen) > MOST_HELD:
                    yield given(seen)
                    seen.clear()
        yield given(seen)

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = model.value.ids
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"chunk": batch.column(0), "n_uses": batch.column(1), "ids": pa.array([ids(c.as_py()) for c in batch.column(0)], pa.string())})

    counted = docs.select(text_of(text_col).alias("text")).mapInArrow(distinct, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n_uses"))
    return counted.where("n_uses > 1").mapInArrow(segment, "chunk string, n_uses long, ids string")


def _least_uses(table: DataFrame, most_bytes: int, most: int) -> tuple[int, int]:
    """The smallest numbers of uses whose entries, with all more used ones, fit most_bytes, and are no more than most: uses are exact up to 4,096, above that in steps of 1/64 of a power of two, so that a few thousand rows tell; 1 if all do."""
    step = F.when(F.col("n_uses") <= 4096, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n_uses")) - 6).cast("long"))
    size = F.octet_length("chunk") + F.octet_length("ids") + F.lit(ENTRY_BYTES)
    sizes = table.groupBy((F.floor(F.col("n_uses") / step) * step).cast("long").alias("least")).agg(F.sum(size.cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    out = []
    for bound, column in ((most_bytes, "bytes"), (most, "n")):
        total, found = 0, 1
        for r in sorted(sizes, reverse=True):
            total += r[column]
            if total > bound:
                found = r.least + 1 if r.least <= 4096 else r.least + (1 << (r.least.bit_length() - 7))
                break
        out.append(found)
    return out[0], out[1]


def _head(table: DataFrame, least: int, least_quick: int) -> Head:
    """The entries with at least so many uses (HEAD_BYTES at most), packed where they are; a chunk, the byte 255, which no text holds, and its ids."""
    top = table.where(F.col("n_uses") >= least)
    entry = F.concat(F.encode("chunk", "UTF-8"), F.unhex(F.lit("FF")), F.encode("ids", "UTF-8"))
    found = top.select(F.crc32("chunk").alias("key"), entry.alias("entry")).orderBy("key").toArrow().combine_chunks()
    entries = found.column(1).combine_chunks().cast(pa.large_binary())
    ends = np.frombuffer(entries.buffers()[1], np.int64)[entries.offset : entries.offset + len(entries) + 1] if len(entries) else np.zeros(1, np.int64)
    packed = entries.buffers()[2].to_pybytes()[: int(ends[-1])] if len(entries) else b""
    quick = top.where((F.col("n_uses") >= least_quick) & (F.length("chunk") <= QUICK_CHUNK)).select("chunk", "ids").toArrow()
    return Head(dict(zip(quick.column(0).to_pylist(), quick.column(1).to_pylist(), strict=True)), found.column(0).to_numpy().astype(np.uint32), ends.copy(), packed)


def _bitmap(chunks: DataFrame) -> bytes:
    """2**BITS bits, of which those at the leading bits of the chunks' crc32 are set; the most that comes to the driver is one long for each 64 of them."""
    bit = F.shiftright(F.crc32("chunk"), 32 - BITS)
    words = chunks.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit & 63 AS INT))")).alias("bits"))
    found = words.toArrow()
    out = np.zeros(1 << (BITS - 6), "<i8")
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


#: What encode_decode() can return besides the id, in Spark's types.
OUTPUTS = {"ids": "string", "decoded": "string", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def _digest(model: PieceModel, ids: str, outputs: tuple[str, ...]) -> list:
    found: dict = {"ids": ids, "n_tokens": ids.count(",") + 1 if ids else 0}
    if "decoded" in outputs or "decoded_sha256" in outputs:
        found["decoded"] = model.decode(ids)
    return [hashlib.sha256(found[o[:-7]].encode()).hexdigest() if o.endswith("_sha256") else found[o] for o in outputs]


def _columns(rows: list[list], outputs: tuple[str, ...]) -> dict[str, pa.Array]:
    return {o: pa.array([r[k] for r in rows], pa.int64() if o == "n_tokens" else pa.string()) for k, o in enumerate(outputs)}


class Head:
    """The most used chunks and their ids: the first in a dictionary, all in one string of bytes, ordered by crc32."""

    def __init__(self, quick: dict[str, str], keys: np.ndarray, ends: np.ndarray, packed: bytes) -> None:
        self.quick, self.keys, self.ends, self.packed = quick, keys, ends, packed

    def find(self, chunks: list[str]) -> dict[str, str]:
        """The ids of those of the chunks that the head holds."""
        encoded = [c.encode() + b"\xff" for c in chunks]
        keys = np.fromiter((crc32(e[:-1]) for e in encoded), np.uint32, len(encoded))
        first, last = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        out = {}
        for k in np.flatnonzero(first < last).tolist():
            for at in range(int(first[k]), int(last[k])):
                entry = self.packed[self.ends[at] : self.ends[at + 1]]
                if entry.startswith(encoded[k]):
                    out[chunks[k]] = entry[len(encoded[k]) :].decode()
        return out


class Encoder:
    """Encodes texts as far as the head and what stands once allow; chunks that the table holds beyond the head stay open."""

    def __init__(self, model: PieceModel, head: Head, bitmap: bytes | None) -> None:
        self.model, self.cut, self.bitmap = model, Chunks(model).of, bitmap
        self.shift = 33 - (8 * len(bitmap)).bit_length() if bitmap else 0
        self.head = head
        self.codes = {c: chr(k if k < 0xD800 else k + 0x800) for k, c in enumerate(head.quick, FIRST_CODE)} if bitmap else {}
        self.ids_of = {k: head.quick[c] for c, k in self.codes.items()}

    def in_table(self, chunk: str) -> bool:
        if self.bitmap is None:
            return False
        bit = crc32(chunk.encode()) >> self.shift
        return bool(self.bitmap[bit >> 3] >> (bit & 7) & 1)

    def settle(self, chunks: list[str]) -> tuple[dict[str, str], list[str]]:
        """Of distinct chunks that aren't in the dictionary: the ids of those that are in the head or in no table, and those that stay open."""
        known = self.head.find(chunks)
        opened = [c for c in chunks if c not in known and self.in_table(c)]
        out = set(opened)
        return known | {c: self.model.ids(c) for c in chunks if c not in known and c not in out}, opened

    def open_chunks(self, text: str) -> list[str]:
        """The distinct chunks of a text whose ids the table has to tell, by their place in it."""
        quick = self.head.quick
        rest = [c for c in dict.fromkeys(self.cut(text)) if c not in quick]
        known = self.head.find(rest)
        return [c for c in rest if c not in known and self.in_table(c)]

    def encode(self, text: str) -> tuple[str | None, bytes | None]:
        """The ids of a text, or, if some are open, its coded form."""
        chunks = self.cut(text)
        ids = list(map(self.head.quick.get, chunks))
        if None not in ids:
            return ",".join(ids), None
        own, opened = self.settle(list(dict.fromkeys(c for c, k in zip(chunks, ids, strict=True) if k is None)))
        if not opened:
            return ",".join([own[c] if k is None else k for c, k in zip(chunks, ids, strict=True)]), None
        numbers = {c: str(k) for k, c in enumerate(opened)}
        coded = "".join([self.codes[c] if k is not None else OPEN if c in numbers else OWN for c, k in zip(chunks, ids, strict=True)])
        rest = [numbers[c] if c in numbers else own[c] for c, k in zip(chunks, ids, strict=True) if k is None]
        return None, zlib.compress(f"{coded}{END}{';'.join(rest)}".encode(), 1)

    def filled(self, coded: bytes, found: dict[int, str]) -> str:
        """The ids of a text from its coded form and the ids of its open chunks."""
        codes, _, tail = zlib.decompress(coded).decode().partition(END)
        rest = iter(tail.split(";"))
        return ",".join([found[int(next(rest))] if k == OPEN else next(rest) if k == OWN else self.ids_of[k] for k in codes])


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", id_col: str = "doc_id", outputs: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """One row per document: doc_id and the outputs asked for, in that order, of ids (decimal, joined by commas), decoded, n_tokens, ids_sha256 and decoded_sha256.

    The table is written once. Its most used entries (HEAD_BYTES at most, whatever the
    input) go to every task with a bitmap (of fixed size) of the others; a text whose chunks
    are in the head or not in the table is finished in its task. The open chunks of other
    texts are joined to the table (chunks with very many uses are dealt out by salt), a row
    for each text and chunk; the ids that come back meet the coded texts, which are
    about half as large as the input, by the texts' two hashes, and are put in their places.
    A bit that two chunks share only sends one more chunk to the join.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    model = sc.broadcast(read_model(model_path))
    kind = docs.schema[id_col].dataType.simpleString()
    asked = ", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)
    table = materialize(chunk_table(docs, model_path, text_col), "piece-table")
    least, least_quick = _least_uses(table, HEAD_BYTES, QUICK)
    others = table.where(F.col("n_uses") < least)
    known = sc.broadcast((_head(table, least, least_quick), _bitmap(others) if least > 2 else None))

    def open_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, *known.value)
        for batch in batches:
            found = [encoder.open_chunks(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"k1": batch.column(0), "k2": batch.column(1), "chunks": pa.array(found, pa.list_(pa.string()))})

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, *known.value)
        nothing = [None] * len(outputs)
        for batch in batches:
            rows, coded = [], []
            for t in batch.column(3):
                ids, form = encoder.encode(t.as_py())
                rows.append(nothing if ids is None else _digest(model.value, ids, outputs))
                coded.append(form)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "k1": batch.column(1), "k2": batch.column(2)} | _columns(rows, outputs) | {"coded": pa.array(coded, pa.binary())})

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, *known.value)
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                row = [batch.column(2 + i)[k].as_py() for i in range(len(outputs))]
                if (coded := batch.column(1)[k].as_py()) is not None:
                    found = {x["place"]: model.value.ids(x["chunk"]) if x["ids"] is None else x["ids"] for x in batch.column(2 + len(outputs))[k].as_py()}
                    row = _digest(model.value, encoder.filled(coded, found), outputs)
                rows.append(row)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)} | _columns(rows, outputs))

    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), *text_keys(text_col), text.alias("text")).mapInArrow(encode, f"doc_id {kind}, k1 long, k2 long, {asked}, coded binary")
    if least <= 2:  # the head is the whole table: nothing is open
        return rows.select("doc_id", *outputs)
    asked_for = docs.select(*text_keys(text_col), text.alias("text")).mapInArrow(open_chunks, "k1 long, k2 long, chunks array<string>").select("k1", "k2", F.posexplode("chunks").alias("place", "chunk"))
    joined = salted_join(asked_for, others, ["chunk"], "n_uses", F.col("k1"), "left")
    answer = F.struct("place", "ids", F.when(F.col("ids").isNull(), F.col("chunk")).alias("chunk"))
    found = joined.groupBy("k1", "k2").agg(F.collect_set(answer).alias("found"))  # the chunks of one text, however many documents have it
    rows = rows.withColumn("k1", F.when(F.col("coded").isNull(), F.monotonically_increasing_id()).otherwise(F.col("k1")))  # finished rows ask for nothing and lie anywhere
    return rows.join(found, ["k1", "k2"], "left").select("doc_id", "coded", *outputs, "found").mapInArrow(fill, f"doc_id {kind}, {asked}")
