"""N-gram Jaccard join (operator 4): MinHash LSH forest with exact verification.

A document's set holds its five-word shingles (a word is a run of letters, digits and
non-ASCII characters, lower case; a shorter document is one shingle). Equal sets are one
representative with a multiplicity. Every representative has a signature of MAX_DEPTH
min-hashes, a byte each, in every one of TREES trees; a signature is a number, so sorted signatures are
a prefix trie, and a prefix of some depth is a node.

Matched prefixes are shortened from MAX_DEPTH on until the recall of a pair at the
threshold, 1 - product(1 - t**depth) over the trees, reaches the target. The first pass
shortens all alike, which is one depth for all, and gathers what shares a node into
components. Components that fit one block, or have half of their members in one node, are
verified as they are. In larger ones, where dissimilar documents hang together through others, every document shortens its own
prefixes: a tree whose next node is crowded is left at its depth, and others are shortened
by one more, until the target is reached (crowded ones last, the least crowded first). Within the nodes so chosen whole signatures are compared,
and only pairs that agree in nearly as many places as a pair at the threshold does
stay connected. What is connected then is cut into blocks of bounded size, and each pair
of blocks is verified exactly, all its pairs at once, on the shingle sets themselves.

A pair exactly at the threshold is missed with a probability of at most 1 - target in the
first pass and again in large components (together below 0.002 at the defaults), higher
similarities less.

Defined results for odd input: null and empty texts and those without words have no set
and link with nothing; long texts are compared whole; rows that agree in doc_id and text
are copies that link with each other like any others, and keep_one() keeps one row of
them; a row with a null doc_id takes part, comes after all others and gives a class its id
only if it has no other (null then); an empty table gives an empty result; other columns
are ignored by classes() and passed through by keep_one(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import dropped_after, materialize, text_of, whole_row
from termloom.llm.components import block_labels, connected_components, forest_labels
from termloom.llm.rolling import Hashes, mixed

SHINGLE_WORDS, THRESHOLD = 5, 0.8
TREES, MAX_DEPTH, TARGET_RECALL = 18, 8, 0.999
#: Trees whose nodes every document joins; the others' are joined by what hangs together after them.
FIRST_TREES = 4
#: A node with more members than ROOMY is crowded; comparing signatures, a task takes at most NODE_MEMBERS of a node on either side.
ROOMY, NODE_MEMBERS = 256, 2048
#: Bytes hashed at a time; members and shingles of a block; shingles that a call with small components should have; bytes up to which lists of documents are broadcast (summed first).
CHUNK, BLOCK_MEMBERS, BLOCK_SHINGLES, CALL_SHINGLES, MOST_BROADCAST_BYTES = 1 << 19, 512, 1 << 20, 1 << 21, 48 << 20

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 0x100)]] = True
_draws = np.random.default_rng(7041).integers(0, 1 << 63, (2, TREES * MAX_DEPTH), dtype=np.uint64)
_XOR, _TIMES = _draws[0], _draws[1] * np.uint64(2) + np.uint64(1)


def shortened_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """The longest prefix whose matches find a pair at the threshold with the target probability; an error if even one value finds it too rarely."""
    for depth in range(MAX_DEPTH, 0, -1):
        if 1 - (1 - threshold**depth) ** TREES >= target:
            return depth
    raise ValueError(f"{TREES} trees miss recall {target} at threshold {threshold} even at depth 1")


def _shingles_of(parts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for begin, end in _chunks(parts):
        data = np.frombuffer(b"\n".join(parts[begin:end]) + b"\n", np.uint8)
        inside = _WORD_BYTE[data]
        edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        words = Hashes(data).of(first, last - first)
        at = np.searchsorted(first, np.cumsum([0, *(len(p) + 1 for p in parts[begin:end])]))
        n = len(words)
        runs = np.zeros(n, np.uint64)
        for k in range(SHINGLE_WORDS):
            runs[: n - k] = mixed(runs[: n - k] + words[k:])
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if j - i >= SHINGLE_WORDS:
                out.append(np.unique(runs[i : j - SHINGLE_WORDS + 1]))
            elif j > i:
                h = np.array([j - i], np.uint64)
                for k in range(i, j):
                    h = mixed(h + words[k])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def _chunks(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, p in enumerate(parts):
        if size and size + len(p) > CHUNK:
            yield begin, i
            begin, size = i, 0
        size += len(p) + 1
    if begin < len(parts):
        yield begin, len(parts)


def shingles(texts: list[str]) -> list[np.ndarray]:
    return _shingles_of([t.lower().encode() for t in texts])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """For each non-empty set its signature in each tree: MAX_DEPTH min-hashes of a byte, the first one highest."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    out = np.zeros((len(sets), TREES), np.uint64)
    for t in range(TREES):
        for d in range(MAX_DEPTH):
            k = t * MAX_DEPTH + d
            out[:, t] = out[:, t] << np.uint64(8) | mixed(np.minimum.reduceat((flat ^ _XOR[k]) * _TIMES[k], at)) >> np.uint64(56)
    return out


def nodes_of(signed: np.ndarray, depth: int) -> np.ndarray:
    """The trie node of each signature at a depth: its prefix, hashed with the tree and the depth."""
    prefix = signed >> np.uint64(8 * (MAX_DEPTH - depth))
    return mixed(mixed(prefix + np.uint64(1)) + np.arange(1, TREES + 1, dtype=np.uint64) * np.uint64(MAX_DEPTH + 1) + np.uint64(depth)).view(np.int64)


def own_depths(members: np.ndarray, threshold: float, target: float, levels: tuple[int, ...], roomy: int) -> np.ndarray:
    """The level (a place in levels, depths in ascending order) down to which each document's prefix is shortened in each tree.

    members[i, t, k] is how many documents are in its node of tree t at depth levels[k]. A
    step takes one prefix of a document down a level: the longest whose next node is not
    crowded, else the one with the fewest members in its next node; it goes on until the
    recall at the threshold reaches the target or every prefix is at the lowest level.
    """
    miss = np.log1p(-(threshold ** np.array(levels, float)))  # of a tree, by level
    level = np.full(members.shape[:2], len(levels) - 1)
    rows, trees = np.arange(len(members)), np.arange(TREES)
    for _ in range(TREES * (len(levels) - 1)):
        short = miss[level].sum(axis=1) > np.log1p(-target)
        if not short.any():
            break
        following = members[rows[:, None], trees, np.maximum(level - 1, 0)]
        # the order of preference: roomy ones by depth, then crowded ones by members; none at the lowest level
        cost = np.where(following <= roomy, -1.0 - level, following)
        cost[level == 0] = np.inf
        best = cost.argmin(axis=1)
        take = short & np.isfinite(cost[rows, best])
        level[rows[take], best[take]] -= 1
    return level


def least_agreement(threshold: float) -> int:
    """In how many places signatures have to agree: five standard deviations below what a pair at the threshold is expected to have."""
    n = TREES * MAX_DEPTH
    return max(1, int(n * (threshold - 5 * (threshold * (1 - threshold) / n) ** 0.5)))


def _agree(a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Which pairs of signatures (as bytes) agree in at least that many places."""
    out = np.zeros((len(a), len(b)), np.int16)
    for k in range(a.shape[1]):
        out += a[:, k, None] == b[None, :, k]
    return out >= least


def _connected(node: pd.DataFrame, least: int) -> pd.DataFrame:
    """(rid, label) for the documents of a node, or of two parts of one, that agree with others of it: a document is compared only with those it is not connected with yet."""
    node = node.drop_duplicates(["rid", "side"])
    rid, right = node.rid.to_numpy(), node.side.to_numpy() == 1
    signed = np.frombuffer(b"".join(node["keys"]), np.uint8).reshape(len(node), -1)
    label, left_over = rid.copy(), np.arange(len(rid))
    while len(left_over):
        group, left_over = left_over[:1], left_over[1:]
        new = group
        while len(new) and len(left_over):
            close = np.zeros(len(left_over), bool)
            for k in range(0, len(new), 64):
                some = new[k : k + 64]
                match = _agree(signed[some], signed[left_over], least)
                if right.any():
                    match &= right[some][:, None] != right[left_over]
                close |= match.any(axis=0)
            new, left_over = left_over[close], left_over[~close]
            group = np.concatenate([group, new])
        label[group] = rid[group].min()
    return pd.DataFrame({"rid": rid, "label": label})[label != rid]


def _similar(sets_a: list[np.ndarray], sets_b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which pairs have a Jaccard similarity of at least threshold: intersections by products of 0/1 matrices over the shared shingles."""
    a = len(sets_a)
    sets = sets_a if sets_b is None else [*sets_a, *sets_b]
    sizes = np.array([len(s) for s in sets])
    column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    rows = np.repeat(np.arange(len(sets)), sizes)
    shared = count[column] > 1
    rank = np.cumsum(count > 1) - 1
    rows, column = rows[shared], rank[column[shared]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    n_columns, step = int(column[-1]) + 1 if len(column) else 0, 4096
    common = np.zeros((a, len(sets) - a if sets_b is not None else a), np.float32)
    for begin in range(0, n_columns, step):
        i, j = np.searchsorted(column, [begin, begin + step])
        m = np.zeros((len(sets), step), np.float32)
        m[rows[i:j], column[i:j] - begin] = 1
        common += m[:a] @ (m[a:] if sets_b is not None else m).T
    common = common.astype(np.float64)
    either = sizes[:a, None] + (sizes[a:] if sets_b is not None else sizes)[None, :] - common
    return common / np.maximum(either, 1) >= threshold


def _verified(block: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """rid, links (by multiplicity) and smallest linked rid, within the components of a small call or between two parts of a large one."""
    out = []
    block = block.drop_duplicates(["component", "rid", "side"])
    for _, x in block.groupby("component", sort=False):
        sets = [np.frombuffer(b, np.uint64) for b in x.shingles]
        rid, n, right = x.rid.to_numpy(), x.n.to_numpy(), x.side.to_numpy() == 1
        left = np.flatnonzero(~right)
        if not right.any():
            if len(left) < 2:
                continue
            close = _similar(sets, None, threshold)
            np.fill_diagonal(close, False)
            label, _ = block_labels(close, rid, None)
            out.append(pd.DataFrame({"rid": rid, "links": close @ n, "label": label}))
            continue
        right = np.flatnonzero(right)
        signed = np.frombuffer(b"".join(x["keys"]), np.uint8).reshape(len(x), -1)
        agree = _agree(signed[left], signed[right], least_agreement(threshold))
        left, right = left[agree.any(axis=1)], right[agree.any(axis=0)]
        if not len(left):
            continue
        close = _similar([sets[i] for i in left], [sets[i] for i in right], threshold)
        a, b = block_labels(close, rid[left], rid[right])
        out += [pd.DataFrame({"rid": rid[left], "links": close @ n[right], "label": a}), pd.DataFrame({"rid": rid[right], "links": close.T @ n[left], "label": b})]
    if not out:
        return pd.DataFrame({"rid": [], "links": [], "label": []}).astype("int64")
    found = pd.concat(out)
    return found[found.links > 0].astype("int64")


def _sets(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """One row per document: doc_id, k1 (hash of its text), s1 and s2 (hashes of its set, null without one), n_shingles, keys (signatures)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                sets = shingles(part.column(2).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                s1, s2, keys = [None] * len(sets), [None] * len(sets), [None] * len(sets)
                if some:
                    signed = signatures([sets[i] for i in some])
                    for i, row in zip(some, signed, strict=True):
                        s = sets[i]
                        s1[i] = int(mixed(np.array([mixed(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])
                        s2[i] = int(mixed(np.array([mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum()], np.uint64)).view(np.int64)[0])
                        keys[i] = row.astype(">u8").tobytes()
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "k1": part.column(1), "s1": pa.array(s1, pa.int64()), "s2": pa.array(s2, pa.int64()), "n_shingles": pa.array([len(s) for s in sets], pa.int64()), "keys": pa.array(keys, pa.binary())})

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), text.alias("text")).mapInArrow(run, f"doc_id {kind}, k1 long, s1 long, s2 long, n_shingles long, keys binary")


def _signed(keys: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(keys.to_pylist()), ">u8").astype(np.uint64).reshape(len(keys), TREES)


def _nodes(reps: DataFrame, depths: tuple[int, ...]) -> DataFrame:
    """(rid, place, node): the trie nodes of each representative at some depths; place is tree * MAX_DEPTH + depth - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                signed, rid = _signed(b.column(1)), np.repeat(b.column(0).to_numpy(), TREES)
                for d in depths:
                    place = np.tile(np.arange(TREES) * MAX_DEPTH + d - 1, b.num_rows)
                    yield pa.RecordBatch.from_pydict({"rid": pa.array(rid), "place": pa.array(place.astype(np.int16)), "node": pa.array(nodes_of(signed, d).ravel())})

    return reps.select("rid", "keys").mapInArrow(run, "rid long, place short, node long")


def _in_parts(rows: DataFrame, group: str) -> DataFrame:
    """rows of groups that are cut into parts (column parts), once for every pair of parts that they belong to: part p meets itself (side 0 only) and every other part q, the lower one on side 0; call names the pair."""
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    met = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return met.withColumn("side", F.when(F.col("part") <= F.col("other"), 0).otherwise(1)).withColumn("call", F.concat_ws(".", group, F.least("part", "other"), F.greatest("part", "other")))


def _hung(met: DataFrame) -> DataFrame:
    """(rid, dst, roots): what each rid hangs on, the smallest root of its nodes, and all of their roots; met has a row (rid, root) for each of its nodes."""
    return met.groupBy("rid").agg(F.min("root").alias("dst"), F.collect_set("root").alias("roots"))


def _star(hung: DataFrame) -> DataFrame:
    """(src, dst): a document hangs on the smallest root of its nodes, and so do their other roots: of the many links of a group a few are left."""
    return hung.select(F.explode(F.array_union(F.array("rid"), F.col("roots"))).alias("src"), "dst").where("src <> dst")


def _parted(reps: DataFrame, threshold: float, target: float, depth: int) -> DataFrame:
    """(rid, component) of the members of large components that stay connected when each document shortens its own prefixes and signatures are compared."""
    levels, roomy = tuple(sorted({max(1, depth - 1), depth, MAX_DEPTH})), ROOMY
    level_at = np.searchsorted(levels, np.arange(MAX_DEPTH + 1))
    nodes = _nodes(reps, levels)
    sizes = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "forest-populations")
    # the choice tells crowded nodes apart by their members and takes all others alike, and never asks for those of the deepest level: only crowded ones above it go back to their documents
    crowded = _nodes(reps, levels[:-1]).join(sizes.where(F.col("members") > roomy), "node").groupBy("rid").agg(F.collect_list(F.struct("place", "members")).alias("crowded"))
    by_document = reps.select("rid", "keys").join(crowded, "rid", "left").select("keys", F.coalesce("crowded", F.array().cast(crowded.schema["crowded"].dataType)).alias("crowded"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The nodes in which a document looks for others."""
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                signed, listed = _signed(part.column(0)), part.column(1)
                row = np.repeat(np.arange(len(listed)), np.asarray(listed.value_lengths()))
                place, members = (np.asarray(x) for x in listed.flatten().flatten())
                known = np.ones((len(listed), TREES, len(levels)), np.int64)
                known[row, place // MAX_DEPTH, level_at[place % MAX_DEPTH + 1]] = members
                named = np.stack([nodes_of(signed, d) for d in levels], axis=2)
                chosen = own_depths(known, threshold, target, levels, roomy)
                yield pa.RecordBatch.from_pydict({"node": pa.array(named[np.arange(len(listed))[:, None], np.arange(TREES), chosen].ravel())})

    chosen = by_document.mapInArrow(choose, "node long").distinct().join(sizes, "node")
    parts = F.ceil(F.col("members") / F.lit(NODE_MEMBERS)).cast("int")
    chosen = materialize(chosen.select("node", parts.alias("parts")), "forest-chosen")
    met = _in_parts(nodes.join(chosen, "node").join(reps.select("rid", "keys"), "rid").select("rid", "keys", "node", "parts"), "node")
    least = least_agreement(threshold)
    edges = met.select("call", "rid", "keys", "side").groupBy("call").applyInPandas(lambda x: _connected(x[["rid", "keys", "side"]], least), "rid long, label long")
    return connected_components(edges.select(F.col("rid").alias("src"), F.col("label").alias("dst"))).withColumnRenamed("node", "rid")


def _classes(docs: DataFrame, text_col: str, id_col: str, threshold: float, target_recall: float) -> DataFrame:
    with dropped_after(docs.sparkSession):
        return _found(docs, text_col, id_col, threshold, target_recall)


def _found(docs: DataFrame, text_col: str, id_col: str, threshold: float, target_recall: float) -> DataFrame:
    """One row per document: doc_id, k1, class_id, n_links, first (struct of the class's first document), copies (rows with its doc_id and text)."""
    depth = shortened_depth(threshold, target_recall)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(_sets(docs, text_col, id_col), "forest-sets", outlives_scope=True)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1")
    reps = rows.where("s1 IS NOT NULL").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"))
    reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()), "forest-reps")
    nodes = _nodes(reps, (depth,))
    roots = materialize(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("shared_by"), F.min("rid").alias("root")).where("shared_by > 1"), "forest-nodes")
    # the first trees gather most of a group; in the others a document stands for all that hang on the same root, and only nodes of several roots link anything
    first = materialize(_hung(nodes.where(F.col("place") < FIRST_TREES * MAX_DEPTH).join(roots.select("node", "root"), "node")), "forest-first")
    hung = reps.join(first.select("rid", "dst"), "rid", "left").select(F.coalesce("dst", "rid").alias("rid"), "keys")
    later = _nodes(hung, (depth,)).where(F.col("place") >= FIRST_TREES * MAX_DEPTH).select("rid", "node").distinct()
    mixed_nodes = later.groupBy("node").agg(F.min("rid").alias("root"), F.max("rid").alias("last")).where("root < last").select("node", "root")
    star = _star(first).unionByName(_star(_hung(later.join(mixed_nodes, "node")))).distinct()
    candidates = connected_components(star).withColumnRenamed("node", "rid")
    detail = ("rid", "component", "n", "first", "n_shingles", "keys")
    sizes = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    # half of a component in one node means documents about as similar as the threshold asks: nothing to part there, and its pairs are at most four times the node's own
    crowds = roots.join(candidates, F.col("root") == F.col("rid")).groupBy("component").agg(F.max("shared_by").alias("crowd"))
    large = materialize(sizes.where(F.col("members") > BLOCK_MEMBERS).join(crowds, "component").where("2 * crowd < members").select("component"), "forest-large")
    members = candidates.join(reps, "rid").select(*detail)
    if large.limit(1).count():
        suspects = materialize(members.join(large, "component"), "forest-suspects")
        parted = _parted(suspects, threshold, target_recall, depth)
        members = members.join(large, "component", "left_anti").unionByName(parted.join(suspects.drop("component"), "rid").select(*detail))
    members = materialize(members, "forest-candidates")
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("members"), F.sum("n_shingles").alias("total"))
    parts = F.greatest(F.ceil(F.col("members") / F.lit(BLOCK_MEMBERS)), F.ceil(F.col("total") / F.lit(BLOCK_SHINGLES)), F.lit(1)).cast("int")
    sizes = materialize(sizes.select("component", parts.alias("parts"), "total"), "forest-sizes")
    calls = max(64, (sizes.where("parts = 1").agg(F.sum("total")).first()[0] or 0) // CALL_SHINGLES)
    placed = members.join(sizes.select("component", "parts"), "component")
    large = _in_parts(placed.where("parts > 1"), "component")
    small = placed.where("parts = 1").withColumn("side", F.lit(0)).withColumn("call", F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(calls))))
    columns = ("rid", "component", "n", "first", "keys", "call", "side")
    wanted = small.select(*columns).unionByName(large.select(*columns))
    wanted = wanted.groupBy(F.col("first.doc_id").alias("w_id"), F.col("first.k1").alias("w_k1"), "rid", "component", "n", "keys").agg(F.collect_list(F.struct("call", "side")).alias("calls"))
    wanted = materialize(wanted, "forest-wanted")
    size = wanted.agg(F.coalesce(F.sum(F.size("calls") * 40 + 8 * TREES + 64), F.lit(0))).first()[0]
    text = text_of(text_col)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("k1"), text.alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("k1") == F.col("w_k1"))
    joined = keyed.join(F.broadcast(wanted) if size <= MOST_BROADCAST_BYTES else wanted, same).select("rid", "component", "n", "keys", "text", "calls")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                sets = [s.tobytes() for s in shingles(part.column(4).to_pylist())]
                for i, calls in enumerate(part.column(5).to_pylist()):
                    take = pa.array(np.full(len(calls), i))
                    yield pa.RecordBatch.from_pydict({c: part.column(j).take(take) for j, c in enumerate(("rid", "component", "n", "keys"))} | {"call": pa.array([c["call"] for c in calls]), "side": pa.array([c["side"] for c in calls], pa.int32()), "shingles": pa.array([sets[i]] * len(calls), pa.binary())})

    blocks = joined.mapInArrow(spread, "rid long, component long, n long, keys binary, call string, side int, shingles binary")
    found = materialize(blocks.groupBy("call").applyInPandas(lambda x: _verified(x, threshold), "rid long, links long, label long"), "forest-links")
    links = found.groupBy("rid").agg(F.sum("links").alias("links"))
    component = connected_components(found.where("label <> rid").select(F.col("rid").alias("src"), F.col("label").alias("dst"))).withColumnRenamed("node", "rid")
    known = reps.select("rid", "n", "s1", "s2", "first").join(links, "rid", "left").join(component, "rid", "left").withColumn("component", F.coalesce("component", "rid"))
    firsts = known.groupBy("component").agg(F.min("first").alias("class_first"))
    known = known.join(firsts, "component").select("s1", "s2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "class_first")
    known = materialize(known, "forest-classes", outlives_scope=True)
    alone = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1")
    return rows.select("doc_id", "k1", "s1", "s2").join(known, ["s1", "s2"], "left").select(
        F.col("doc_id").cast(kind), "k1", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class_first", alone).alias("first"),
    )


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), n_links (other documents at or above the threshold), kept (it is its class's first)."""
    found = _classes(docs, text_col, id_col, threshold, target_recall)
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1"))
    return found.select("doc_id", F.col("first.doc_id").alias("class_id"), "n_links", kept.alias("kept"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """docs with only the first document of each class (all columns stay); of rows that agree in doc_id and text one stays."""
    found = materialize(_classes(docs, text_col, id_col, threshold, target_recall), "forest-result")
    kept = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("k1") == F.col("first.k1"))
    dropped = found.where(~kept).select("doc_id", "k1").distinct()
    twice = found.where(kept).groupBy("doc_id", "k1").count().where("count > 1").select("doc_id", "k1")
    marked = materialize(dropped.withColumn("twice", F.lit(False)).unionByName(twice.withColumn("twice", F.lit(True))), "forest-marked")
    small = marked.count() * 64 <= MOST_BROADCAST_BYTES
    keyed = docs.select(F.col(id_col).alias("d_id"), F.xxhash64(text_of(text_col)).alias("d_k1"), whole_row(docs).alias("row"))
    rows = keyed.join(F.broadcast(marked) if small else marked, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_k1") == F.col("k1")), "left")
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    single = rows.where(F.col("twice").isNull()).select(*own)
    if not marked.where("twice").limit(1).count():
        return single
    return single.unionByName(rows.where("twice").dropDuplicates(["d_id", "d_k1"]).select(*own))
