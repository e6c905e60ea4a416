"""Suffix-array dedup (operator 1): bucket-pointer refinement over all texts.

Finds every byte covered by a string of WINDOW bytes that starts at two or more places.
Suffixes only have to be told apart to that depth, and only those that share a bucket are
ever refined:

1. Initial q-gram buckets. In every window the smallest hash of its q-grams (leftmost on
   ties) is its anchor; equal windows have equal anchors at equal offsets, so one q-gram
   in about (WINDOW - Q) / 2 stands for the suffixes near it. Buckets of one are done.
2. The consecutive starts that share an anchor are a run; the run's whole context (its
   first byte to the last byte of its last window) is an identifier at once. Contexts
   that occur twice settle all their starts; only the ragged ends of repeats are left.
3. Those contexts are gathered by bucket and their suffixes are refined in blocks of
   bounded size: buckets of short prefixes are split by sorting on the pair of their own
   bucket identifier and the one at a later offset, the new identifiers serve the next,
   twice as deep refinement, and suffixes alone in a bucket drop out.
   A bucket with more contexts than a block holds is refined by the same step on the whole
   table first: its starts are halved by their distance to the anchor, and each half is
   split by the identifier of the longer string that all its windows then have in common,
   until the parts fit (a part with one start a context holds equal windows only).

Defined results for odd input: null is the empty text; texts under WINDOW bytes and empty
ones lose nothing; long texts are treated whole (in overlapping segments); matches never
cross documents; repeated rows are documents of their own, so from WINDOW bytes on each
loses everything; rows with a null doc_id take part like others; an empty table gives an
empty result; other columns are ignored by scan() and passed through by remove().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize, salted_join, text_of, whole_row
from termloom.llm.rolling import Hashes, mixed

WINDOW, Q = 200, 64
#: Positions hashed at a time, bytes of contexts a block should have, and bytes up to which per-document lists are broadcast (their size is summed first).
CHUNK, BLOCK_BYTES, MOST_BROADCAST_BYTES = 1 << 19, 1 << 19, 48 << 20
#: A bucket with more contexts than this is four blocks by itself; it is refined further before it is put in one.
MOST_CONTEXTS = 4 * BLOCK_BYTES // (WINDOW + (WINDOW - Q) // 2)

_PLACE = np.uint64((1 << 21) - 1)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: text number, first start, number of starts, hash of the anchor, hash of the context, distance from the first start to the anchor."""
    found: list[tuple[np.ndarray, ...]] = []
    pending: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for begin in range(0, len(text) - WINDOW + 1, CHUNK):
            part = text[begin : begin + CHUNK + WINDOW - 1]
            if size and size + len(part) > CHUNK:
                found.append(_anchors_of(pending))
                pending, size = [], 0
            pending.append((number, begin, part))
            size += len(part)
    if pending:
        found.append(_anchors_of(pending))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) if found else np.zeros(0, kinds[i]) for i in range(6))


def _anchors_of(parts: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    lengths = np.array([len(p[2]) for p in parts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    hashes = Hashes(data)
    grams = hashes.of(np.arange(len(data) - Q + 1), Q)
    low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, WINDOW - Q + 1  # the smallest of each span q-grams, by doubling
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    at = (low & _PLACE).astype(np.int64)
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begins, 1)
    np.add.at(inside, begins + lengths - WINDOW + 1, -1)
    starts = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    anchor = at[starts]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin, place = starts[first], anchor[first]
    context = mixed(hashes.of(begin, count + WINDOW - 1) ^ ((place - begin) * 1024 + count).astype(np.uint64))
    owner = np.searchsorted(begins, begin, "right") - 1
    numbers, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return numbers[owner], begin - begins[owner] + offsets[owner], count, grams[place], context, place - begin


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context, which of its starts (all with WINDOW bytes to go) begin a string that begins elsewhere in these contexts too.

    Bucket-pointer refinement on one block: pointer[p] is the bucket of the suffix at p. A
    round sorts the suffixes that still share a bucket by (pointer[p], pointer[p + depth])
    and doubles the depth; the last round takes the offset that makes WINDOW exactly.
    """
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contexts) + bytes(WINDOW + 8), np.uint8)
    n = int(ends[-1]) if len(ends) else 0
    grams = np.zeros(n, np.uint64)
    for k in range(8):  # the initial buckets: 8-grams
        grams = grams << np.uint64(8) | data[k : n + k].astype(np.uint64)
    whole = np.zeros(n, bool)
    for e, s in zip(ends, sizes, strict=True):
        whole[e - s : e - WINDOW + 1] = True
    pointer = np.unique(grams, return_inverse=True)[1].astype(np.uint64)
    shared = np.bincount(pointer.astype(np.int64), minlength=1)[pointer.astype(np.int64)] > 1
    depth = 8
    while depth < WINDOW:
        offset = min(depth, WINDOW - depth)
        later = np.concatenate([pointer[offset:], np.zeros(offset, np.uint64)])
        if depth + offset == WINDOW:  # windows across the seam of two contexts are none
            shared &= whole
        active = np.flatnonzero(shared)
        key = pointer[active] << np.uint64(32) | later[active]
        bucket, size = np.unique(key, return_inverse=True, return_counts=True)[1:]
        pointer = np.arange(n, dtype=np.uint64)  # a suffix that is alone points at itself
        pointer[active] = bucket.astype(np.uint64) + np.uint64(n)
        shared = np.zeros(n, bool)
        shared[active] = size[bucket] > 1
        depth += offset
    return [shared[e - s : e - WINDOW + 1] for s, e in zip(sizes, ends, strict=True)] if len(sizes) else []


def split_starts(context: bytes, begin: int, anchor: int, near: int, far: int) -> list[tuple[int, int, int, bytes, int, int, int]]:
    """The starts of a context whose distance to the anchor is from near to far, in two halves: (first start, number of starts, distance of the first, bytes, identifier, near, far).

    All windows of a half share a longer stretch around the anchor, which holds the anchor,
    so its hash (with the half it stands for) is a finer bucket than that of the context.
    """
    middle, out = (near + far) // 2, []
    for low, high in ((near, middle), (middle + 1, far)):
        first, last = max(0, anchor - high), min(len(context) - WINDOW, anchor - low)
        if low <= high and first <= last:
            common = context[anchor - low : anchor - high + WINDOW]
            identifier = int.from_bytes(hashlib.blake2b(bytes((low, high)) + common, digest_size=8).digest(), "little", signed=True)
            out.append((begin + first, last - first + 1, anchor - first, context[first : last + WINDOW], identifier, low, high))
    return out


def _runs(doc: pa.Array, tie: pa.Array, rows: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    take = pa.array(rows.astype(np.int64))
    return pa.RecordBatch.from_pydict({"doc_id": doc.take(take), "k1": tie.take(take), "run": pa.array((starts * 256 + counts).astype(np.int64))})


def _pieces(flags: np.ndarray, begin: int) -> list[int]:
    """Maximal stretches of set flags, each packed as start * 256 + count."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [int((begin + a) * 256 + (b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _keyed(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), text.alias("text"))


def repeated_runs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, k1, run): runs of repeated window starts, packed as first start * 256 + number of starts; k1 is xxhash64 of the text.

    Shuffled are one hash per anchor to count them, the anchors themselves to keep the
    repeated ones, and contexts of ragged ends only; texts are never shuffled for that
    unless the list of wanted contexts is too large to broadcast. Joins are plain
    equi-joins of two shuffled tables, so adaptive execution splits frequent keys.
    """
    keyed = _keyed(docs, text_col, id_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def bucket_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                h = anchors([t.encode() for t in b.column(0).slice(k, 512).to_pylist()])[3]
                yield pa.RecordBatch.from_pydict({"h": pa.array(h.view(np.int64))})

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                number, begin, count, h, context, _ = anchors([t.encode() for t in part.column(2).to_pylist()])
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "k1", "run"), _runs(part.column(0), part.column(1), number, begin, count).columns, strict=True)) | {"h": pa.array(h.view(np.int64)), "context": pa.array(context.view(np.int64))})

    buckets = keyed.select("text").mapInArrow(bucket_hashes, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")
    buckets = materialize(buckets, "suffix-buckets")
    found = keyed.mapInArrow(occurrences, f"doc_id {kind}, k1 long, run long, h long, context long")
    place = F.xxhash64("doc_id", "run")
    shared = materialize(salted_join(found, buckets, ["h"], "uses", place).drop("uses"), "suffix-shared")
    groups = shared.groupBy("h", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "k1", "run")).alias("one"))
    groups = materialize(groups, "suffix-contexts")
    settled = salted_join(shared, groups.where("n > 1").select("h", "context", "n"), ["h", "context"], "n", place).select("doc_id", "k1", "run")
    # what is left: contexts that occur once in buckets of several; one of each settled context stands for its equals
    open_buckets = materialize(groups.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("least = 1 AND contexts > 1").select("h", "contexts"), "suffix-open")
    flags = F.when(F.col("n") == 1, 2).otherwise(0) + F.when(F.col("contexts") > MOST_CONTEXTS, 1).otherwise(0)
    wanted = groups.join(open_buckets, "h").select("one.doc_id", "one.k1", (F.col("one.run") * 4 + flags).alias("run"))
    by_doc = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("k1").alias("w_k1")).agg(F.collect_list("run").alias("wanted"))
    by_doc = materialize(by_doc, "suffix-wanted")
    size, total = by_doc.agg(F.coalesce(F.sum(F.size("wanted") * 8 + 48), F.lit(0)), F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()
    joined = keyed.join(F.broadcast(by_doc) if size <= MOST_BROADCAST_BYTES else by_doc, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k1") == F.col("w_k1")))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows, runs, pieces = [], [], []
                for i, (text, wanted) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    data = text.encode()
                    for w in wanted:
                        begin, count = divmod(w >> 2, 256)
                        rows.append(i), runs.append(w), pieces.append(data[begin : begin + count + WINDOW - 1])
                if rows:
                    take, packed = pa.array(rows, pa.int64()), np.array(runs, np.int64)
                    *_, h, _, anchor = anchors(pieces)  # all starts of a context have one anchor
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column(0).take(take), "k1": part.column(1).take(take), "run": pa.array(packed >> 2), "h": pa.array(h.view(np.int64)), "open": pa.array(packed & 2 > 0), "large": pa.array(packed & 1 > 0),
                        "anchor": pa.array(anchor.astype(np.int32)), "near": pa.array(np.zeros(len(rows), np.int32)), "far": pa.array(np.full(len(rows), WINDOW - Q, np.int32)), "bytes": pa.array(pieces, pa.binary()),
                    })

    pieces = f"doc_id {kind}, k1 long, run long, h long, open boolean, large boolean, anchor int, near int, far int, bytes binary"
    cut = materialize(joined.select("doc_id", "k1", "text", "wanted").mapInArrow(contexts, pieces), "suffix-cut")
    blocks = max(64, -(-total * (WINDOW + 70) // BLOCK_BYTES))

    def refine(block: pd.DataFrame) -> pd.DataFrame:
        keep, rows = [], []
        opens, runs = block.open.tolist(), block.run.tolist()
        for i, flags in enumerate(repeated_starts(block.bytes.tolist())):
            if opens[i] and flags.any():
                found = _pieces(flags, runs[i] // 256)
                keep += found
                rows += [i] * len(found)
        out = block.iloc[rows][["doc_id", "k1"]].reset_index(drop=True)
        out["run"] = np.array(keep, np.int64)
        return out

    def in_blocks(rows: DataFrame) -> DataFrame:
        return rows.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks))).select("block", "doc_id", "k1", "run", "open", "bytes").groupBy("block").applyInPandas(refine, f"doc_id {kind}, k1 long, run long")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                row, run, h, anchor, near, far, pieces = [], [], [], [], [], [], []
                for i, r in enumerate(part.to_pylist()):
                    for begin, count, to_anchor, data, identifier, low, high in split_starts(r["bytes"], r["run"] // 256, r["anchor"], r["near"], r["far"]):
                        row.append(i), run.append(begin * 256 + count), h.append(identifier), anchor.append(to_anchor), near.append(low), far.append(high), pieces.append(data)
                if row:
                    take = pa.array(row, pa.int64())
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": part.column(0).take(take), "k1": part.column(1).take(take), "run": pa.array(run, pa.int64()), "h": pa.array(h, pa.int64()), "open": part.column(4).take(take), "large": part.column(5).take(take),
                        "anchor": pa.array(anchor, pa.int32()), "near": pa.array(near, pa.int32()), "far": pa.array(far, pa.int32()), "bytes": pa.array(pieces, pa.binary()),
                    })

    found = settled.unionByName(in_blocks(cut.where("NOT large")))
    large = cut.where("large")
    while large.limit(1).count():  # at most log2(WINDOW - Q) + 1 rounds: then a part has one start a context, and all its windows are equal
        split = materialize(large.mapInArrow(halves, pieces).withColumn("same", F.xxhash64("bytes", "anchor")), "suffix-split")
        equal = materialize(split.groupBy("h", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "k1", "run")).alias("one")), "suffix-split-groups")
        settled = salted_join(split.select("doc_id", "k1", "run", "open", "h", "same"), equal.where("n > 1").select("h", "same", "n"), ["h", "same"], "n", place).where("open").select("doc_id", "k1", "run")
        sizes = equal.groupBy("h").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("uses")).where("contexts > 1")
        sizes = materialize(sizes, "suffix-split-sizes")
        # one of each set of equal parts stands for it; it is settled, so it is no longer open
        kept = equal.select("h", F.col("one.doc_id").alias("doc_id"), F.col("one.k1").alias("k1"), F.col("one.run").alias("run"), (F.col("n") == 1).alias("alone"))
        left = salted_join(split.drop("same"), sizes, ["h"], "uses", place)
        left = left.join(kept, left.doc_id.eqNullSafe(kept.doc_id) & (left.h == kept.h) & (left.k1 == kept.k1) & (left.run == kept.run)).select(
            left.doc_id, left.k1, left.run, left.h, (left.open & kept.alone).alias("open"), (left.contexts > MOST_CONTEXTS).alias("large"), "anchor", "near", "far", "bytes")
        cut = materialize(left, "suffix-cut")
        found = found.unionByName(settled).unionByName(in_blocks(cut.where("NOT large")))
        large = cut.where("large")
    return found


def _merged(by_doc: DataFrame, kind: str) -> DataFrame:
    """Runs of each document as maximal covered stretches: [begin, end, begin, end, ...]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            merged = []
            for runs in b.column(2).to_pylist():
                begin, count = np.divmod(np.sort(np.array(runs, np.int64)), 256)
                end = np.maximum.accumulate(begin + count + WINDOW - 1)
                new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
                merged.append(np.column_stack([begin[new], end[np.concatenate([new[1:] - 1, [len(end) - 1]])]]).ravel().tolist())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "k1": b.column(1), "runs": pa.array(merged, pa.list_(pa.int64()))})

    return by_doc.mapInArrow(run, f"doc_id {kind}, k1 long, runs array<bigint>")


def _with_runs(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(row, runs): each row of docs, whole, and its covered stretches (null: none)."""
    with dropped_after(docs.sparkSession):
        by_doc = repeated_runs(docs, text_col, id_col).groupBy("doc_id", "k1").agg(F.collect_set("run").alias("runs"))  # one text's runs
        by_doc = materialize(_merged(by_doc, docs.schema[id_col].dataType.simpleString()), "suffix-runs", outlives_scope=True)
    size = by_doc.agg(F.coalesce(F.sum(F.size("runs") * 8 + 48), F.lit(0))).first()[0]
    keyed = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text_of(text_col)).alias("d_k1"), whole_row(docs).alias("row"))
    same = F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_k1") == F.col("k1"))
    return keyed.join(F.broadcast(by_doc) if size <= MOST_BROADCAST_BYTES else by_doc, same, "left").select("row", "runs")


def covered(n_bytes: int, stretches: list[int]) -> np.ndarray:
    """Which bytes of a text lie in a repeated window."""
    out = np.zeros(n_bytes, bool)
    for begin, end in zip(stretches[::2], stretches[1::2], strict=True):
        out[begin:end] = True
    return out


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, removed, spans, digests = [], [], [], []
            for text, runs in zip(b.column(1), b.column(2), strict=True):
                data, gone = text.as_py().encode(), None
                if runs := runs.as_py():
                    gone = covered(len(data), runs)
                sizes.append(len(data))
                removed.append(int(gone.sum()) if runs else 0)
                spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()) if runs else 0)
                digests.append(hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes() if runs else data).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string())})

    rows = _with_runs(docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")), "text", "doc_id")
    return rows.select("row.doc_id", "row.text", "runs").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length_col: str | None = "n_chars") -> DataFrame:
    """docs with the covered bytes taken out of their texts (a character goes if any byte of it does); length_col, where there is one, follows."""
    columns, schema = docs.columns, docs.schema
    place = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept, own = [], b.column(0).flatten()
            for text, runs in zip(own[place].to_pylist(), b.column(1).to_pylist(), strict=True):
                if runs:
                    data = np.frombuffer(text.encode(), np.uint8)
                    leads = (data & 0xC0) != 0x80
                    gone = np.logical_or.reduceat(covered(len(data), runs), np.flatnonzero(leads))
                    text = data[~gone[np.cumsum(leads) - 1]].tobytes().decode()
                kept.append(text)
            own[place] = pa.array(kept, own[place].type)
            yield pa.RecordBatch.from_arrays(own, names=columns)

    kept = _with_runs(docs, text_col, id_col).mapInArrow(run, schema)
    if length_col in columns:
        kept = kept.withColumn(length_col, F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.length(text_col).cast(schema[length_col].dataType)))
    return kept
