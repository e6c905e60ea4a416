"""Media columns: MPEG transport streams (operator 7).

write_stream() stores a payload losslessly as the elementary stream of a one-programme
transport stream (188-byte packets, PAT and PMT with CRC, one PES packet an access unit,
PCR and random-access flag at the points where a reader may start). read_stream() parses
any such stream: it finds the programme through PAT and PMT, checks continuity counters,
reassembles the PES packets and returns payload, timestamps and random-access points.

Defined results for odd input: a null text is the empty payload (padded to 192 spaces);
texts of any length are stored whole; every row is its own stream, so repeated rows and
ties give equal values; a null doc_id is passed on; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import text_of

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, MEDIA_PID, NULL_PID = 0x0000, 0x0100, 0x0101, 0x1FFF
PROGRAMME, STREAM_TYPE, STREAM_ID = 1, 0x06, 0xBD  # private data in PES packets
UNIT = 192 * 16  # payload bytes of an access unit
TICKS = 3600  # 90 kHz ticks between access units
RANDOM_ACCESS_EVERY = 8  # access units


@lru_cache(1)
def _crc_table() -> tuple[int, ...]:
    out = []
    for n in range(256):
        c = n << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return tuple(out)


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2; 0 over a section with its own CRC at the end."""
    c, table = 0xFFFFFFFF, _crc_table()
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ table[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id, 0xB0 | (len(body) + 9) >> 8, (len(body) + 9) & 255, number >> 8, number & 255, 0xC1, 0, 0]) + body
    return head + section_crc(head).to_bytes(4, "big")


@lru_cache(1)
def _table_packets() -> tuple[bytes, bytes]:
    pat = _section(0x00, 1, bytes([PROGRAMME >> 8, PROGRAMME & 255, 0xE0 | PMT_PID >> 8, PMT_PID & 255]))
    pmt = _section(0x02, PROGRAMME, bytes([0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0, STREAM_TYPE, 0xE0 | MEDIA_PID >> 8, MEDIA_PID & 255, 0xF0, 0]))
    packet = lambda pid, s: (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0]) + s).ljust(PACKET, b"\xff")
    return packet(PAT_PID, pat), packet(PMT_PID, pmt)


def _stamp(prefix: int, ticks: int) -> bytes:
    t = ticks & (1 << 33) - 1
    return bytes([prefix << 4 | t >> 29 & 0x0E | 1, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1])


def _unit_packets(data: bytes, index: int, counter: int) -> tuple[list[bytes], int]:
    """The packets of one access unit; counter is the next continuity counter."""
    ticks, entry = (index + 1) * TICKS, index % RANDOM_ACCESS_EVERY == 0
    length = 8 + len(data)
    pes = b"\x00\x00\x01" + bytes([STREAM_ID, length >> 8, length & 255, 0x80 | 0x04, 0x80, 5]) + _stamp(2, ticks) + data
    out, at = [], 0
    while at < len(pes):
        field = b""
        if entry and not at:
            base = ticks - TICKS
            field = bytes([0x50]) + (base << 15 | 0x3F << 9).to_bytes(6, "big")
        room = PACKET - 4 - (1 + len(field) if field else 0)
        chunk = pes[at : at + room]
        if short := room - len(chunk):
            if field:
                field += b"\xff" * short
            else:
                field = b"\x00" + b"\xff" * (short - 2) if short > 1 else None
        head = bytes([SYNC, (0x40 if not at else 0) | MEDIA_PID >> 8, MEDIA_PID & 255, (0x10 if field == b"" else 0x30) | counter])
        adaptation = b"" if field == b"" else b"\x00" if field is None else bytes([len(field)]) + field
        out.append(head + adaptation + chunk)
        counter = counter + 1 & 15
        at += len(chunk)
    return out, counter


def write_stream(payload: bytes) -> bytes:
    """payload as a transport stream; PAT and PMT come before every random-access point."""
    out, counter, tables = [], 0, 0
    pat, pmt = _table_packets()
    for index, at in enumerate(range(0, max(len(payload), 1), UNIT)):
        if index % RANDOM_ACCESS_EVERY == 0:
            out += [pat[:3] + bytes([0x10 | tables]) + pat[4:], pmt[:3] + bytes([0x10 | tables]) + pmt[4:]]
            tables = tables + 1 & 15
        packets, counter = _unit_packets(payload[at : at + UNIT], index, counter)
        out += packets
    return b"".join(out)


@dataclass
class Stream:
    """What read_stream() finds; stamps are in 90 kHz ticks, None where a PES packet has none."""

    payload: bytes = b""
    packets: int = 0
    pids: int = 0
    programmes: dict[int, int] = field(default_factory=dict)
    stream_types: dict[int, int] = field(default_factory=dict)
    continuity_errors: int = 0
    transport_errors: int = 0
    crc_errors: int = 0
    stamps: list[int | None] = field(default_factory=list)
    decode_stamps: list[int | None] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)
    payloads: dict[int, bytes] = field(default_factory=dict)
    truncated_units: int = 0

    def feature(self) -> str:
        first, last = (self.stamps[0], self.stamps[-1]) if self.stamps else (None, None)
        return f"packets={self.packets};pids={self.pids};programmes={len(self.programmes)};streams={len(self.stream_types)};units={len(self.stamps)};pts={first}-{last};random_access={len(self.random_access)};continuity_errors={self.continuity_errors};crc_errors={self.crc_errors};truncated={self.truncated_units}"


#: Stream ids whose packets have no optional header (program map, padding, private 2, ECM, EMM, DSM-CC, H.222.1 type E, directory); padding has no payload either.
BARE_STREAMS, PADDING_STREAM = frozenset((0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)), 0xBE


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def _sections(chunks: list[tuple[bool, bytes]]) -> Iterator[bytes]:
    """Whole sections from the payloads of one table PID: the pointer field of a start packet says where a section begins, and what stands before that ends the one in hand."""
    held, begun = b"", False
    for starts, data in chunks:
        pieces = [(False, data[1 : 1 + data[0]]), (True, data[1 + data[0] :])] if starts and data else [(False, data)]
        for anew, piece in pieces:
            begun = begun or anew
            held = piece if anew else held + piece if begun else b""
            while len(held) >= 3 and held[0] != 0xFF and len(held) >= (n := 3 + ((held[1] & 15) << 8 | held[2])):
                yield held[:n]
                held = held[n:]


def read_stream(media: bytes) -> Stream:
    """Parse a transport stream; bytes before the first sync and a last partial packet are skipped."""
    out = Stream()
    start = next((i for i in range(min(PACKET, len(media))) if media[i] == SYNC and (i + PACKET >= len(media) or media[i + PACKET] == SYNC)), None)
    if start is None:
        return out
    n = (len(media) - start) // PACKET
    p = np.frombuffer(media, np.uint8, n * PACKET, start).reshape(n, PACKET)
    good = (p[:, 0] == SYNC) & (p[:, 1] & 0x80 == 0)
    out.packets, out.transport_errors = n, int(n - good.sum())
    p = p[good]
    pid = (p[:, 1].astype(np.int32) & 31) << 8 | p[:, 2]
    out.pids = len(np.unique(pid[pid != NULL_PID]))
    has_field, has_data, starts = p[:, 3] & 0x20 > 0, p[:, 3] & 0x10 > 0, p[:, 1] & 0x40 > 0
    length = np.where(has_field, p[:, 4], 0)
    flags = np.where(has_field & (length > 0), p[:, 5], 0)
    offset = np.where(has_field, 5 + length.astype(np.int32), 4)
    offset[~has_data | (offset > PACKET)] = PACKET
    counter = p[:, 3] & 15

    def chunks(which: np.ndarray) -> list[tuple[bool, bytes]]:
        return [(bool(starts[i]), p[i, offset[i] :].tobytes()) for i in which]

    for section in _sections(chunks(np.flatnonzero((pid == PAT_PID) & has_data))):
        if section_crc(section):
            out.crc_errors += 1
        elif section[0] == 0:
            for i in range(8, len(section) - 4, 4):
                if number := section[i] << 8 | section[i + 1]:
                    out.programmes[number] = (section[i + 2] & 31) << 8 | section[i + 3]
    for table in sorted(set(out.programmes.values())):
        for section in _sections(chunks(np.flatnonzero((pid == table) & has_data))):
            if section_crc(section):
                out.crc_errors += 1
            elif section[0] == 2:
                i = 12 + ((section[10] & 15) << 8 | section[11])
                while i + 5 <= len(section) - 4:
                    out.stream_types[(section[i + 1] & 31) << 8 | section[i + 2]] = section[i]
                    i += 5 + ((section[i + 3] & 15) << 8 | section[i + 4])
    for one in np.unique(pid[(pid != NULL_PID) & has_data]):
        at = np.flatnonzero((pid == one) & has_data)
        step, announced = np.diff(counter[at].astype(np.int16)) & 15, flags[at[1:]] & 0x80 > 0
        out.continuity_errors += int(((step != 1) & (step != 0) & ~announced).sum())
        if one in out.stream_types:
            repeats = np.concatenate([[False], (step == 0) & ~announced])  # a packet may be sent twice
            out.payloads[int(one)] = _reassemble(out, p, at[~repeats], offset, starts, flags)
    out.payload = b"".join(out.payloads.values())
    return out


def _reassemble(out: Stream, p: np.ndarray, at: np.ndarray, offset: np.ndarray, starts: np.ndarray, flags: np.ndarray) -> bytes:
    """The payload of one elementary stream; its stamps and random-access points are appended to out."""
    rows, places = p[at], np.arange(PACKET)
    data = rows[places >= offset[at][:, None]].tobytes()
    ends = np.cumsum(PACKET - offset[at])
    first = np.flatnonzero(starts[at])
    begins = (ends[first] - (PACKET - offset[at][first])).tolist()
    entries = (flags[at][first] & 0x40 > 0).tolist()
    parts = []
    for begin, end, entry in zip(begins, [*begins[1:], len(data)], entries, strict=True):
        head = data[begin : begin + 19]
        if len(head) < 9 or head[:3] != b"\0\0\1":
            out.truncated_units += 1
            continue
        if head[3] == PADDING_STREAM:
            continue
        declared, marks, extra = head[4] << 8 | head[5], head[7], head[8]
        if head[3] in BARE_STREAMS:  # their payload follows the length, with no header that has stamps
            marks, extra = 0, -3
        if declared and begin + 6 + declared > end:
            out.truncated_units += 1
        if entry:
            out.random_access.append(len(out.stamps))
        stamp = _ticks(head[9:14]) if marks & 0x80 else None
        out.stamps.append(stamp)
        out.decode_stamps.append(_ticks(head[14:19]) if marks & 0xC0 == 0xC0 else stamp)
        parts.append(data[begin + 9 + extra : min(end, begin + 6 + declared) if declared else end])
    return b"".join(parts)


def padded(text: str, multiple: int = 192) -> bytes:
    """A text's UTF-8 bytes, with spaces up to a positive multiple."""
    data = text.encode()
    return data.ljust(max(multiple, -(-len(data) // multiple) * multiple), b" ")


def store_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes and media: each text's padded payload as a transport stream."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_bytes": pa.array([len(t.encode()) for t in texts], pa.int64()), "media": pa.array([write_stream(padded(t)) for t in texts], pa.binary())})

    return docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def read_media(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media's other columns and what its streams hold: payload, timestamps (array<bigint>), random_access (array<int>, places in timestamps), continuity_errors, feature. A null stream is an empty one; a column of media with one of these names is replaced."""
    others = [c for c in media.columns if c not in (media_col, "payload", "timestamps", "random_access", "continuity_errors", "feature")]
    schema = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in others)
    schema += (", " if others else "") + "payload binary, timestamps array<bigint>, random_access array<int>, continuity_errors int, feature string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read_stream(m or b"") for m in batch.column(len(others)).to_pylist()]
            yield pa.RecordBatch.from_pydict({c: batch.column(i) for i, c in enumerate(others)} | {
                "payload": pa.array([s.payload for s in found], pa.binary()), "timestamps": pa.array([s.stamps for s in found], pa.list_(pa.int64())),
                "random_access": pa.array([s.random_access for s in found], pa.list_(pa.int32())), "continuity_errors": pa.array([s.continuity_errors for s in found], pa.int32()),
                "feature": pa.array([s.feature() for s in found], pa.string()),
            })

    return media.select(*others, media_col).mapInArrow(run, schema)


def digest_media(media: DataFrame) -> DataFrame:
    """From store_texts(): digests of the stored form and of what is read back from it, with its timestamps and random-access points (places in these)."""
    kind = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2).to_pylist()
            found = [read_stream(m) for m in stored]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "n_bytes": batch.column(1), "payload_bytes": pa.array([len(s.payload) for s in found], pa.int64()),
                "payload_sha256": pa.array([hashlib.sha256(s.payload).hexdigest() for s in found]), "tail_crc32": pa.array([zlib.crc32(s.payload[-16:]) for s in found], pa.int64()),
                "media_bytes": pa.array([len(m) for m in stored], pa.int64()), "media_sha256": pa.array([hashlib.sha256(m).hexdigest() for m in stored]), "feature": pa.array([s.feature() for s in found], pa.string()),
                "timestamps": pa.array([s.stamps for s in found], pa.list_(pa.int64())), "random_access": pa.array([s.random_access for s in found], pa.list_(pa.int32())),
            })

    return media.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, timestamps array<bigint>, random_access array<int>")
