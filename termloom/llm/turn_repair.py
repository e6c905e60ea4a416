"""Conversation structure repair (operator 13) by recursive DuckDB queries inside hash-partitioned batches.

The turns of a conversation are kept, given another role, deleted or joined by inserted
ones, at the least cost that leaves the role initials (s?(ua)+)? . Turns are put into one
total order, range by range, so that no conversation has to fit a task, and fall into
segments of at most SEGMENT turns of a conversation. Segments are hash-partitioned and
gathered into batches; in a batch one recursive query advances a turn in every segment at a
time and keeps, for each grammar state that a segment may be entered with and each state it
may be left with, the least cost and the audit (the initials of the edits). A second
recursion of the same kind advances a segment of every conversation at a time. Of two
audits of equal cost for the same turns and state neither begins with the other, so the
least one of a part is the least one of the whole.

What a task holds is a batch, or of a single conversation 16 audits, a letter a turn each.
Texts are not part of the recursions; they pass once more, ordered by conversation, to be
hashed as they come. A digest is one hash over all of a conversation, so that last pass is a task a
conversation, whatever its length, with one turn in memory at a time.

Defined results for odd input: null roles and texts are one blank (so a null text is blank,
a null role is none of the known ones and can't be kept); an empty role can't be kept
either; turns without a number come first; turns with equal numbers are ordered by role,
then text, so that repeated rows lie side by side and all but the first are duplicates;
rows without a conversation are one conversation, named null; conversations of which no
turn is left have zeros, an empty audit and the hash of the empty string; texts and
conversations of any length are repaired whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize, salted_join, spread

#: Turns of a segment, and rows that a batch should have.
SEGMENT, BATCH_ROWS = 512, 20_000
#: Costs of the edits, and of leaving a truncated turn.
RENAME, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Grammar states: nothing yet, after s, after u, after a; an answer may end in the first and the last.
STATES, ENDS = ("0", "s", "u", "a"), ("0", "a")
#: The state that a user or assistant turn leads to.
NEXT = {"0": "u", "s": "u", "u": "a", "a": "u"}
WHITE = " \t\n\x0b\x0c\r"
DUCKDB_MEMORY = "256MB"


def _inserted(state: str) -> list[tuple[str, int, str]]:
    """(state, cost, letters) with no, one or two turns inserted; from u and a a second one only comes back."""
    once = NEXT[state]
    out = [(state, 0, ""), (once, INSERT, "I")]
    return out + ([(NEXT[once], 2 * INSERT, "II")] if state in "0s" else [])


def _moves() -> list[tuple]:
    """(state, initial, bad, truncated, next state, cost, letters) of a turn's edits with the turns inserted after it."""
    out = []
    for state in STATES:
        for initial in ("s", "u", "a", "-"):
            for bad in (False, True):
                for truncated in (False, True):
                    edits = [(state, DELETE, "D")]
                    if not bad:
                        left = TRUNCATED * truncated
                        edits.append((NEXT[state], RENAME + left, "R"))
                        if initial == NEXT[state] or (initial, state) == ("s", "0"):
                            edits.append((initial, left, "K"))
                    out += [(state, initial, bad, truncated, after, cost + more, letter + letters) for at, cost, letter in edits for after, more, letters in _inserted(at)]
    return out


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v).upper() for v in r) + ")" for r in rows)


SEGMENT_SQL = f"""
WITH RECURSIVE
moves(state, initial, bad, truncated, after, cost, letters) AS (VALUES {_values(_moves())}),
reached(part, entry, state, place, best) USING KEY (part, entry, state) AS (
  SELECT part, entry, entry, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM (SELECT DISTINCT part FROM turns), (VALUES {_values([(s,) for s in STATES])}) e(entry)
  UNION
  SELECT r.part, r.entry, m.after, r.place + 1, min({{'cost': r.best.cost + m.cost, 'audit': r.best.audit || m.letters}})
  FROM reached r JOIN turns t ON t.part = r.part AND t.place = r.place + 1
  JOIN moves m ON m.state = r.state AND m.initial = t.initial AND m.bad = t.bad AND m.truncated = t.truncated
  GROUP BY ALL)
SELECT part, entry, state, best.cost, best.audit FROM reached ORDER BY part, entry, state
"""
CONVERSATION_SQL = f"""
WITH RECURSIVE
reached(conv, state, place, best) USING KEY (conv, state) AS (
  SELECT conv, state, 0, {{'cost': cost::BIGINT, 'audit': letters}} FROM (SELECT DISTINCT conv FROM parts), (VALUES {_values(_inserted("0"))}) s(state, cost, letters)
  UNION
  SELECT r.conv, p.state, r.place + 1, min({{'cost': r.best.cost + p.cost, 'audit': r.best.audit || p.audit}})
  FROM reached r JOIN parts p ON p.conv = r.conv AND p.place = r.place + 1 AND p.entry = r.state
  GROUP BY ALL)
SELECT conv, min(best).cost, min(best).audit FROM reached WHERE state IN {ENDS} GROUP BY conv ORDER BY conv
"""


def _database():
    import duckdb

    db = duckdb.connect()
    db.execute(f"SET threads = 1; SET memory_limit = '{DUCKDB_MEMORY}'; SET temp_directory = ''")
    return db


def _load(db, name: str, rows: pa.Table) -> None:
    """rows as a table of the database's own: a recursion reads it once a step."""
    db.register("given", rows)
    db.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS FROM given")


def _whole_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups with about BATCH_ROWS rows, and the number of each row's group in it; rows come ordered by their first n_keys columns."""
    held: list[pa.RecordBatch] = []

    def numbered(table: pa.Table) -> np.ndarray:
        keys = list(zip(*(table.column(k).to_pylist() for k in range(n_keys)), strict=True))
        return np.cumsum([k > 0 and keys[k] != keys[k - 1] for k in range(len(keys))])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BATCH_ROWS:
            table = pa.Table.from_batches(held)
            group = numbered(table)
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield table.slice(0, cut).combine_chunks(), group[:cut]
            held = table.slice(cut).to_batches()
    if held and (table := pa.Table.from_batches(held)).num_rows:
        yield table.combine_chunks(), numbered(table)


def _places(group: np.ndarray) -> np.ndarray:
    """1-based place of each row in its group."""
    return np.arange(len(group)) - np.searchsorted(group, group) + 1


def _partitions(df: DataFrame) -> int:
    """Named, so that small rows with much to do for each aren't put together."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _ordered(turns: DataFrame) -> DataFrame:
    """turns with g, their place in the order of conv, turn (null first), role and text; written range by range."""
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "text")]
    ranged = turns.repartitionByRange(_partitions(turns), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumns({"part": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "turns", outlives_scope=True)
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select("conv", "turn", "role", "text", (F.col("before") + F.col("place")).alias("g"))  # a row a partition


def _faults(ordered: DataFrame) -> DataFrame:
    """conv, g, turn, initial (- if none of s, u, a), blank, duplicate and truncated of each turn; of its faults the first counts."""
    end = F.right(F.rtrim("text", F.lit(WHITE)), F.lit(1))
    named = F.struct(F.col("conv").isNull(), "conv", F.octet_length("role"), "role", "text")
    light = ordered.select("conv", "g", "turn", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~end.isin("", ".", "!", "?")).alias("open"), F.xxhash64(named).alias("k1"), F.xxhash64(F.lit("turn"), named).alias("k2"))
    light = materialize(light, "turn-marks")
    seen = materialize(light.groupBy("k1", "k2").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "repeated-turns")
    marked = salted_join(light, seen, ["k1", "k2"], "n", F.col("g"), "left")
    duplicate = ~F.col("blank") & (F.col("g") > F.coalesce(F.col("first"), F.col("g")))
    return materialize(marked.select("conv", "g", "turn", "initial", "blank", duplicate.alias("duplicate"), (F.col("open") & ~duplicate).alias("truncated")), "turn-faults", outlives_scope=True)


def _segments(faults: DataFrame, kind: str) -> DataFrame:
    """One row per segment: conv, block, its first and last initial, illegal pairs inside, and entry, state, cost and audit of every way through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database()
        for table, group in _whole_groups(batches, 2):
            shown = np.array(table.column("initial").to_pylist(), object)
            known = np.isin(shown, STATES[1:])
            _load(db, "turns", pa.table({"part": group, "place": _places(group), "initial": pa.array(np.where(known, shown, "-"), pa.string()), "bad": table.column("bad"), "truncated": table.column("truncated")}))
            ways: list[list] = [[] for _ in range(int(group[-1]) + 1)]
            for part, *way in db.execute(SEGMENT_SQL).fetchall():
                ways[part].append(dict(zip(("entry", "state", "cost", "audit"), way, strict=True)))
            starts = np.searchsorted(group, np.arange(len(ways)))
            ends = np.append(starts[1:], len(group)) - 1
            pairs = np.append(False, (group[1:] == group[:-1]) & np.array([not legal(a, b) for a, b in zip(shown[:-1], shown[1:], strict=True)], bool))
            yield pa.RecordBatch.from_pydict({
                "conv": table.column("conv").take(pa.array(starts)).combine_chunks(), "block": table.column("block").take(pa.array(starts)).combine_chunks(),
                "first": pa.array(shown[starts], pa.string()), "last": pa.array(shown[ends], pa.string()), "illegal": pa.array(np.add.reduceat(pairs.astype(np.int64), starts)),
                "ways": pa.array(ways, pa.list_(pa.struct([("entry", pa.string()), ("state", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
            })

    block = F.floor(F.col("g") / F.lit(SEGMENT)).alias("block")
    rows = faults.select("conv", block, "g", "initial", (F.col("blank") | F.col("duplicate")).alias("bad"), "truncated")
    dealt = rows.repartition(_partitions(faults), "conv", "block").sortWithinPartitions("conv", "block", "g")
    return dealt.mapInArrow(run, f"conv {kind}, block long, first string, last string, illegal long, ways array<struct<entry string, state string, cost bigint, audit string>>")


def legal(one: str, other: str) -> bool:
    return one + other in ("su", "ua", "au")


def _audits(segments: DataFrame, kind: str) -> DataFrame:
    """One row per conversation: conv, cost, audit, illegal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = _database()
        for table, group in _whole_groups(batches, 1):
            ways = table.column("ways").combine_chunks()
            owner = np.repeat(np.arange(len(group)), np.asarray(ways.value_lengths()))
            flat = ways.flatten()
            place = _places(group)
            _load(db, "parts", pa.table({"conv": group[owner], "place": place[owner]} | {c: flat.field(c) for c in ("entry", "state", "cost", "audit")}))
            _, costs, audits = zip(*db.execute(CONVERSATION_SQL).fetchall(), strict=True)
            starts = np.searchsorted(group, np.arange(len(costs)))
            first, last = table.column("first").to_pylist(), table.column("last").to_pylist()
            between = np.array([place[k] > 1 and not legal(last[k - 1], first[k]) for k in range(len(group))], np.int64)
            illegal = np.add.reduceat(between + table.column("illegal").to_numpy(), starts)
            yield pa.RecordBatch.from_pydict({"conv": table.column("conv").take(pa.array(starts)).combine_chunks(), "cost": pa.array(costs, pa.int64()), "audit": pa.array(audits, pa.string()), "illegal": pa.array(illegal)})

    return segments.repartition(_partitions(segments), "conv").sortWithinPartitions("conv", "block").mapInArrow(run, f"conv {kind}, cost long, audit string, illegal long")


class Repair:
    """Applies an audit to a conversation's turns as they come and hashes what is left."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state, self.hash, self.begun = audit, 0, "0", hashlib.sha256(), False

    def _put(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.begun else "") + role + ":" + text).encode())
        self.begun, self.state = True, role[:1]

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self._put(ROLES[NEXT[self.state]], "")

    def turn(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            self._put(role if edit == "K" else ROLES[NEXT[self.state]], text)

    def end(self) -> str:
        self._insert()
        return self.hash.hexdigest()


ROLES = {"u": "user", "a": "assistant"}


def _digests(ordered: DataFrame, audits: DataFrame, kind: str) -> DataFrame:
    """conv, cost, audit, illegal, repaired_sha256: each conversation's audit comes before its turns, which are hashed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        head: list = []
        names = ("conv", "cost", "audit", "illegal")
        kinds = None
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in names]
            done = []
            for k in range(batch.num_rows):
                value = lambda c, k=k, b=batch: b.column(c)[k].as_py()
                if value("g") < 0:
                    if now is not None:
                        done.append([*head, now.end()])
                    head = [value(c) for c in names]
                    now = Repair(head[2])
                else:
                    now.turn(value("role"), value("text"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [*kinds, pa.string()], strict=True)], [*names, "repaired_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*head, now.end()], [*kinds, pa.string()], strict=True)], [*names, "repaired_sha256"])

    heads = audits.select("conv", F.lit(-1).cast("long").alias("g"), "cost", "audit", "illegal", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    rows = ordered.select("conv", "g", F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"), F.lit(None).cast("long").alias("illegal"), "role", "text")
    together = heads.unionByName(rows).repartition(_partitions(ordered), "conv").sortWithinPartitions("conv", "g")
    return together.mapInArrow(run, f"conv {kind}, cost long, audit string, illegal long, repaired_sha256 string")


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """turns with faults put in by crc32(conversation:turn) % 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it the user's; nulls are one blank."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv_col), F.lit(":"), shown(turn_col))) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(shown(role_col))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(shown(text_col), ".!?", "")).otherwise(shown(text_col))
    times = F.array_repeat(F.lit(1), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))
    return turns.select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), F.explode(times).alias("_copy")).drop("_copy")


def repair(turns: DataFrame, conversations: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation (of conversations as well, where given): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Two shuffles move the texts: the one that orders them, and the one that brings them to
    their audits; everything between works on a row of marks a turn.
    """
    spark = turns.sparkSession
    kind = turns.schema[conv_col].dataType.simpleString()
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = spread(turns).select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), shown(role_col).alias("role"), shown(text_col).alias("text"))
    with dropped_after(spark):
        ordered = _ordered(rows)
        faults = _faults(ordered)
        audits = materialize(_audits(_segments(faults, kind), kind), "audits", outlives_scope=True)
    fixed, zero = _digests(ordered, audits, kind), F.lit(0).cast("long")
    marks = faults.select("conv", "turn", *[F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")])
    if conversations is not None:
        none = [F.lit(None).cast("long").alias("turn"), *[F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]]
        marks = marks.unionByName(conversations.select(F.col(conv_col).alias("conv"), *none))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0))
    sums = marks.groupBy("conv").agg(gaps.cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    return sums.alias("s").join(fixed.alias("f"), F.col("s.conv").eqNullSafe(F.col("f.conv")), "left").select(
        F.col("s.conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", *[F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in (("illegal", zero), ("cost", zero), ("audit", F.lit("")), ("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))],
    )
