"""Keccak-256 (the pre-standard padding) and the content-addressed ids built on it."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = (1 << 64) - 1


def _constants() -> tuple[list[int], list[list[int]]]:
    """Round constants from the degree-8 shift register and rotation offsets from the lane walk, as the public specification derives them."""
    rounds, r = [], 1
    for _ in range(24):
        c = 0
        for j in range(7):
            if r & 1:
                c |= 1 << ((1 << j) - 1)
            r = (r << 1) ^ (0x171 if r & 0x80 else 0)
        rounds.append(c)
    turns = [[0] * 5 for _ in range(5)]
    x, y = 1, 0
    for t in range(24):
        turns[x][y] = (t + 1) * (t + 2) // 2 % 64
        x, y = y, (2 * x + 3 * y) % 5
    return rounds, turns


_ROUNDS, _TURNS = _constants()


def _turn(v: int, n: int) -> int:
    return (v << n | v >> 64 - n) & _MASK if n else v


def keccak256(data: bytes) -> bytes:
    rate = 136
    data += b"\x01" + bytes(-(len(data) + 2) % rate) + b"\x80" if (len(data) + 1) % rate else b"\x81"
    a = [[0] * 5 for _ in range(5)]
    for block in range(0, len(data), rate):
        for i in range(rate // 8):
            a[i % 5][i // 5] ^= int.from_bytes(data[block + 8 * i : block + 8 * i + 8], "little")
        for constant in _ROUNDS:
            c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
            d = [c[x - 1] ^ _turn(c[(x + 1) % 5], 1) for x in range(5)]
            b = [[0] * 5 for _ in range(5)]
            for x in range(5):
                for y in range(5):
                    b[y][(2 * x + 3 * y) % 5] = _turn(a[x][y] ^ d[x], _TURNS[x][y])
            a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) & _MASK for y in range(5)] for x in range(5)]
            a[0][0] ^= constant
    return b"".join(a[i % 5][i // 5].to_bytes(8, "little") for i in range(4))


_TERM_ID = re.compile(r"0x[0-9a-fA-F]{64}\Z")
ATOM_SALT, TRIPLE_SALT = keccak256(b"ATOM_SALT"), keccak256(b"TRIPLE_SALT")


def normalize_term_id(value: str) -> str | None:
    """A term id without its atom: or triple: prefix, or None if it is none."""
    value = value.strip()
    if value.startswith(("atom:", "triple:")):
        value = value.split(":", 1)[1]
    return value if _TERM_ID.match(value) else None


def atom_id(data: str) -> str:
    """The id of atom data; 0x-hex is taken as bytes, other text as UTF-8."""
    return "0x" + keccak256(ATOM_SALT + keccak256(_atom_bytes(data))).hex()


def triple_id(subject: str, predicate: str, object_: str) -> str | None:
    """The id of a triple of term ids, or None if one of them is none."""
    parts = [normalize_term_id(x) for x in (subject, predicate, object_)]
    return None if None in parts else "0x" + keccak256(TRIPLE_SALT + b"".join(bytes.fromhex(p[2:]) for p in parts)).hex()


def checksum_address(address: str) -> str:
    """The mixed-case checksum form of a 0x address."""
    low = address[2:].lower()
    digest = keccak256(low.encode()).hex()
    return "0x" + "".join(c.upper() if int(h, 16) > 7 else c for c, h in zip(low, digest, strict=False))


def keccak256_many(messages: list[bytes]) -> list[bytes]:
    """The digests of many messages at once: lanes are arrays over messages, those of equally many blocks together."""
    rate = 136
    out: list[bytes] = [b""] * len(messages)
    by_blocks: dict[int, list[int]] = {}
    for i, m in enumerate(messages):
        by_blocks.setdefault(len(m) // rate + 1, []).append(i)
    turn = lambda v, n: v << np.uint64(n) | v >> np.uint64(64 - n) if n else v
    for blocks, rows in by_blocks.items():
        data = np.zeros((len(rows), blocks * rate), np.uint8)
        for k, i in enumerate(rows):
            data[k, : len(messages[i])] = np.frombuffer(messages[i], np.uint8)
            data[k, len(messages[i])] ^= 0x01
        data[:, -1] ^= 0x80
        lanes = data.view("<u8").reshape(len(rows), blocks, rate // 8)
        a = [[np.zeros(len(rows), np.uint64) for _ in range(5)] for _ in range(5)]
        for block in range(blocks):
            for i in range(rate // 8):
                a[i % 5][i // 5] = a[i % 5][i // 5] ^ lanes[:, block, i]
            for constant in _ROUNDS:
                c = [a[x][0] ^ a[x][1] ^ a[x][2] ^ a[x][3] ^ a[x][4] for x in range(5)]
                d = [c[x - 1] ^ turn(c[(x + 1) % 5], 1) for x in range(5)]
                b = [[None] * 5 for _ in range(5)]
                for x in range(5):
                    for y in range(5):
                        b[y][(2 * x + 3 * y) % 5] = turn(a[x][y] ^ d[x], _TURNS[x][y])
                a = [[b[x][y] ^ (~b[(x + 1) % 5][y] & b[(x + 2) % 5][y]) for y in range(5)] for x in range(5)]
                a[0][0] = a[0][0] ^ np.uint64(constant)
        digests = np.stack([a[i % 5][i // 5] for i in range(4)], axis=1).astype("<u8").tobytes()
        for k, i in enumerate(rows):
            out[i] = digests[32 * k : 32 * k + 32]
    return out


def _where_some(values: list, digest_of) -> pd.Series:
    """digest_of the values that aren't None, nulls elsewhere."""
    some = [i for i, v in enumerate(values) if v is not None]
    out: list[str | None] = [None] * len(values)
    for i, d in zip(some, digest_of([values[i] for i in some]), strict=True):
        out[i] = d
    return pd.Series(out, dtype=object)


def _atom_bytes(data: str) -> bytes:
    return bytes.fromhex(data[2:]) if re.fullmatch(r"0x(?:[0-9a-fA-F]{2})*", data) else data.encode()


@F.pandas_udf(T.StringType())
def _atom_ids(s: pd.Series) -> pd.Series:
    return _where_some([None if pd.isna(x) else x for x in s], lambda v: ["0x" + d.hex() for d in keccak256_many([ATOM_SALT + h for h in keccak256_many([_atom_bytes(x) for x in v])])])


@F.pandas_udf(T.StringType())
def _triple_ids(s: pd.Series, p: pd.Series, o: pd.Series) -> pd.Series:
    terms = [[None if pd.isna(x) else normalize_term_id(x) for x in row] for row in zip(s, p, o, strict=True)]
    packed = [None if None in t else TRIPLE_SALT + b"".join(bytes.fromhex(x[2:]) for x in t) for t in terms]
    return _where_some(packed, lambda v: ["0x" + d.hex() for d in keccak256_many(v)])


@F.pandas_udf(T.StringType())
def _checksums(s: pd.Series) -> pd.Series:
    def mixed(v: list[str]) -> list[str]:
        low = [x[2:].lower() for x in v]
        return ["0x" + "".join(c.upper() if int(h, 16) > 7 else c for c, h in zip(x, d.hex(), strict=False)) for x, d in zip(low, keccak256_many([x.encode() for x in low]), strict=True)]

    return _where_some([None if pd.isna(x) else x for x in s], mixed)


def atom_id_of(data: Column) -> Column:
    return _atom_ids(data)


def triple_id_of(subject: Column, predicate: Column, object_: Column) -> Column:
    return _triple_ids(subject, predicate, object_)


def checksum_of(address: Column) -> Column:
    return _checksums(address)
