"""Each text operator on odd rows against a brute-force version, and on an empty table."""

import functools
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import odd_texts, sentences

tokenizers = pytest.importorskip("tokenizers")
paths = pytest.importorskip("public_tokenizers")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def same_rows(got, expected):
    assert Counter(map(repr, got)) == Counter(map(repr, expected))


# --- 1: suffix arrays -------------------------------------------------------


def brute_suffix(rows, window=200):
    data = [(t or "").encode() for _, t, _ in rows]
    count = Counter(b[p : p + window] for b in data for p in range(len(b) - window + 1))
    out = []
    for (i, _, _), b in zip(rows, data, strict=True):
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            if count[b[p : p + window]] > 1:
                gone[p : p + window] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


@pytest.mark.parametrize("most", [None, 1])
def test_suffix_dedup(odd, monkeypatch, most):
    from termloom.llm import suffix_dedup

    if most:  # every bucket is refined by halves
        monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
        monkeypatch.setattr(suffix_dedup, "MOST_BROADCAST_BYTES", 0)
    same_rows([tuple(r) for r in suffix_dedup.scan(odd).collect()], brute_suffix(odd_texts()))


def test_suffix_remove(odd, empty):
    from termloom.llm import suffix_dedup

    out = suffix_dedup.remove(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert {r.text for r in out.where("doc_id BETWEEN 20 AND 23").collect()} == {""}
    assert out.where("doc_id = 5").first().text == odd.where("doc_id = 5").first().text
    assert out.where("doc_id = 60").first().text is None
    assert suffix_dedup.scan(empty).count() == 0 and suffix_dedup.remove(empty).count() == 0


def test_refinement_on_small_alphabets():
    import random

    from termloom.llm.suffix_dedup import repeated_starts

    for seed in range(60):
        rng = random.Random(seed)
        base = bytes(rng.choices(b"ab", k=900))
        contexts = []
        for _ in range(rng.randint(0, 6)):
            a = rng.randint(0, 600)
            s = bytearray(base[a : a + rng.randint(200, 300)])
            if rng.random() < 0.5:
                s[rng.randrange(len(s))] ^= 3
            contexts.append(bytes(s))
        count = Counter(c[p : p + 200] for c in contexts for p in range(len(c) - 199))
        assert [x.tolist() for x in repeated_starts(contexts)] == [[count[c[p : p + 200]] > 1 for p in range(len(c) - 199)] for c in contexts]


# --- 2: sentence spans ------------------------------------------------------


def brute_spans(rows):
    from termloom.llm.sentence_spans import SENTENCES, WORDS, split

    import zlib

    documents = {(i is None, i or 0, zlib.crc32((t or "").encode())): t or "" for i, t, _ in rows}
    seen = defaultdict(set)
    for key, t in documents.items():
        parts, n, _ = split(t)
        at = [i for i, k in enumerate(n) if k]
        for a in range(len(at)):
            total = 0
            for b in range(a, len(at)):
                total += n[at[b]]
                if b - a + 1 >= SENTENCES and total >= WORDS:
                    seen[tuple(" ".join(parts[i].lower().split()) for i in at[a : b + 1])].add((*key, at[a], at[b] - at[a] + 1))
                    break
    gone, repeated = defaultdict(set), defaultdict(set)
    for places in seen.values():
        for k, (*key, first, n) in enumerate(sorted(places)):
            if len(places) > 1:
                repeated[tuple(key)] |= set(range(first, first + n))
            if k:
                gone[tuple(key)] |= set(range(first, first + n))
    out = []
    for i, t, _ in rows:
        parts = split(t or "")[0]
        key = (i is None, i or 0, zlib.crc32((t or "").encode()))
        kept = "".join(p for k, p in enumerate(parts) if k not in gone[key])
        out.append((i, len(parts), len(repeated[key]), len(gone[key]), len((t or "").encode()) - len(kept.encode()), sha(kept)))
    return out


def test_sentence_spans(odd, empty):
    from termloom.llm import sentence_spans

    same_rows([tuple(r) for r in sentence_spans.scan(odd).collect()], brute_spans(odd_texts()))
    out = sentence_spans.remove(odd)
    assert out.schema == odd.schema and out.count() == odd.count()
    assert sentence_spans.scan(empty).count() == 0 and sentence_spans.remove(empty).count() == 0


def test_passages_of_fifty_words_are_found_anywhere(spark):
    """Passages cut out at random places, with and without punctuation, in texts of their own."""
    import random

    from termloom.llm import sentence_spans
    from tests.llm.conftest import sentences, words

    rng = random.Random(3)
    rows = []
    for k in range(40):
        source = (sentences(rng, 30) if k % 2 else words(rng, 200)).split(" ")
        at = rng.randrange(len(source) - 55)
        passage = " ".join(source[at : at + 54])
        rows += [(10 * k, f"{words(rng, 30)} {passage} {sentences(rng, 6)}"), (10 * k + 1, f"{sentences(rng, 5)} {passage} {words(rng, 25)}"), (10 * k + 2, f"{sentences(rng, 9)} {words(rng, 40)}")]
    got = {r.doc_id: r for r in sentence_spans.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[10 * k].n_repeated and got[10 * k + 1].n_removed for k in range(40))
    assert not any(got[10 * k + 2].n_repeated or got[10 * k].n_removed for k in range(40))


def test_unpunctuated_passages_always_hold_a_span():
    """Passages without marks, of few distinct words, of many, and in scripts without spaces, each in two texts of their own."""
    import random

    from termloom.llm.sentence_spans import CUT_WINDOW, WORDS, spans, split
    from tests.llm.conftest import words

    rng = random.Random(5)
    kanji = "".join(map(chr, range(0x4E00, 0x4F00)))

    def shared(a, b):
        return set(spans(a)[0].tolist()) & set(spans(b)[0].tolist())

    for k in range(600):
        known = words(rng, 1 + k % 12).split() if k % 2 else words(rng, 60).split()
        passage = " ".join(rng.choices(known, k=4 * CUT_WINDOW + WORDS - 3))
        assert shared(f"{words(rng, 30)} {passage} {words(rng, 9)}", f"{words(rng, k % 7)} {passage} {words(rng, 25)}"), passage
        pool, n = (kanji, 90) if k % 2 else ("กขคงจฉชซญดตถทธนบปผพฟมยรลวสหอ"[: 2 + k % 30], 220)
        text = lambda n, pool=pool: "".join(rng.choices(pool, k=n))
        passage = text(n)
        assert shared(f"{text(70)}{passage}{text(30)}", f"{text(40)}{passage}{text(50)}"), passage
        assert not shared(words(rng, 90), words(rng, 90)) and not shared(*("".join(rng.choices(kanji, k=90)) for _ in range(2)))
    for marked in ("今日は学校に行きます。明日も行きますか？", "一二三，四五六！七八九；"):
        assert len(split(marked)[0]) > 1 and "".join(split(marked)[0]) == marked


def test_sentences_join_to_the_text():
    from termloom.llm.sentence_spans import split

    for t in [*(t for _, t, _ in odd_texts()), *STRANGE, "a\x1cb\x85c\u2003d " * 30, "İ" * 9 + " \x1f " * 40]:
        parts, words, _ = split(t or "")
        assert "".join(parts) == (t or "") and words == [len(p.split()) for p in parts]


# --- 4: Jaccard join --------------------------------------------------------


def shingle_set(text):
    w = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_classes(rows, threshold=0.8):
    sets = [shingle_set(t) for _, t, _ in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(n)]
    label = list(range(n))
    for _ in range(n):
        for i in range(n):
            low = min([label[i], *(label[j] for j in links[i])])
            for j in (i, *links[i]):
                label[j] = min(label[j], low)
    first = {}
    for i, (doc, _, _) in enumerate(rows):
        key = (doc is None, doc or 0)
        first[label[i]] = min(first.get(label[i], key), key)
    return [(doc, None if first[label[i]][0] else first[label[i]][1], len(links[i])) for i, (doc, _, _) in enumerate(rows)]


@pytest.mark.parametrize("members", [None, 2])
def test_jaccard_classes(odd, monkeypatch, members):
    from termloom.llm import lsh_forest

    if members:  # components are cut into many blocks
        monkeypatch.setattr(lsh_forest, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(lsh_forest, "MOST_BROADCAST_BYTES", 0)
    same_rows([(r.doc_id, r.class_id, r.n_links) for r in lsh_forest.classes(odd).collect()], brute_classes(odd_texts()))


def test_keep_one(odd, empty):
    from termloom.llm import lsh_forest

    out = lsh_forest.keep_one(odd)
    assert out.schema == odd.schema
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[0] == 1 and not any(ids[i] for i in range(20, 24)) and ids[1] == 1 and not any(ids[i] for i in range(30, 35))
    assert ids[4] == 1 and ids[70] == 0  # 70 is a repeated row and a copy of 4
    assert ids[67] == 1 and ids[68] == 0 and ids[60] == ids[61] == ids[62] == 1
    twice = odd.where("doc_id = 70").unionByName(odd.where("doc_id = 5"))
    assert Counter(r.doc_id for r in lsh_forest.keep_one(twice).collect()) == {70: 1, 5: 1}
    assert lsh_forest.classes(empty).count() == 0 and lsh_forest.keep_one(empty).count() == 0


def test_depth_reaches_the_target_recall():
    from termloom.llm.lsh_forest import TREES, nodes_of, shortened_depth, signatures

    d = shortened_depth(0.8, 0.999)
    assert 1 - (1 - 0.8**d) ** TREES >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** TREES
    rng = np.random.default_rng(8)
    values = rng.integers(0, 1 << 63, (4000, 100), dtype=np.uint64)
    a, b = signatures(list(values[:, :90])), signatures(list(values[:, 10:]))  # 80 of 100 shared
    found = (nodes_of(a, d) == nodes_of(b, d)).any(axis=1).mean()
    assert found > 0.9975, found  # 0.9992 expected, 4000 pairs
    assert not (nodes_of(a[1:], d) == nodes_of(b[:-1], d)).any()


def test_a_group_of_near_copies_is_joined_by_few_trees(spark, monkeypatch):
    from termloom.llm import lsh_forest

    met, hung = [], lsh_forest._hung
    monkeypatch.setattr(lsh_forest, "_hung", lambda rows: met.append(rows.count()) or hung(rows))
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:k] + [f"other{k}"] + words[k + 1 :]) for k in range(100)]
    found = lsh_forest.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in found} == {0} and {r.n_links for r in found} == {99}
    assert sum(met) <= 100 * lsh_forest.TREES / 3  # every tree's nodes were met by every document before


def test_own_depths_reach_the_target_recall():
    from termloom.llm.lsh_forest import MAX_DEPTH, TREES, own_depths, shortened_depth

    rng = np.random.default_rng(1)
    d = shortened_depth()
    levels = (d - 1, d, MAX_DEPTH)
    members = np.sort(rng.integers(1, 500, (300, TREES, 3)), axis=2)[:, :, ::-1]
    members[:100] = np.minimum(members[:100], 256)  # no node is crowded
    depth = np.array(levels)[own_depths(members, 0.8, 0.999, levels, 256)]
    recall = 1 - np.prod(1 - 0.8**depth, axis=1)
    assert (recall >= 0.999).all() and (depth[:100].min(axis=1) == d).all()
    crowded = np.full((1, TREES, 3), 10)
    crowded[0, :6] = 1000
    depth = np.array(levels)[own_depths(crowded, 0.8, 0.999, levels, 256)[0]]
    assert (depth[6:] <= d).all() and (depth[6:] == d - 1).any() and (depth[:6] == MAX_DEPTH).all() and 1 - np.prod(1 - 0.8**depth) >= 0.999


def chained_texts(rng):
    """Pairs at a similarity just above or below the threshold, and clusters, all on one of a few templates, so that candidates hang together."""
    def edited(w, n):
        w = list(w)
        for k in rng.sample(range(len(w)), n):
            w[k] = f"x{rng.randrange(10**9)}"
        return w

    texts, templates = [], [[f"t{j}w{i}" for i in range(240)] for j in range(3)]
    for _ in range(90):
        base = edited(rng.choice(templates), 14)
        texts += [base, edited(base, rng.choice([2, 4, 5, 6]))]
    texts += [edited(templates[0], rng.choice([1, 2])) for _ in range(40)]
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("members, roomy, in_node", [(16, 256, 2048), (16, 8, 30), (500, 256, 2048)])
def test_large_components_lose_no_links(spark, monkeypatch, members, roomy, in_node):
    from termloom.llm import lsh_forest

    for name, value in (("BLOCK_MEMBERS", members), ("ROOMY", roomy), ("NODE_MEMBERS", in_node)):
        monkeypatch.setattr(lsh_forest, name, value)
    rows = [(i, t, None) for i, t in enumerate(chained_texts(random.Random(2)))]
    got = lsh_forest.classes(spark.createDataFrame(rows, "doc_id int, text string, x string")).collect()
    expected = brute_classes(rows)
    found, all_links = sum(r.n_links for r in got), sum(n for *_, n in expected)
    assert all_links > 500 and all_links - found <= 0.002 * all_links and {r.doc_id: r.n_links for r in got}.items() >= {i: 0 for i, _, n in expected if not n}.items()


def test_depth_that_misses_the_target_is_an_error():
    from termloom.llm.lsh_forest import shortened_depth

    assert shortened_depth(0.4, 0.999) == 1
    with pytest.raises(ValueError, match="recall"):
        shortened_depth(0.2, 0.999)


# --- 5: mixing --------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), cap=3):
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        left, share = total - sum(fixed.values()), sum(w[n] for n in free)
        over = [n for n in free if left * w[n] / share > cap * sizes[n] * (1 + 1e-12)]
        if not over:
            return fixed | {n: left * w[n] / share for n in free}
        fixed |= {n: cap * sizes[n] for n in over}


def size_of(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.mark.parametrize("per_range", [2, 5000])
def test_mix(odd, per_range):
    from termloom.llm import mixing

    sizes = Counter()
    for _, t, s in odd_texts():
        sizes[s] += size_of(t)
    targets = brute_targets(dict(sizes))
    rows = mixing.mix(odd, rows_per_range=per_range).collect()
    again = mixing.mix(odd.repartition(5), rows_per_range=7).collect()
    same_rows(map(tuple, rows), map(tuple, again))
    by_source = {s: [] for s in targets}
    source_of = {(i, size_of(t)): s for i, t, s in odd_texts()}
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        s = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        by_source[s].append(r.taken)
    assert {s: sum(v) for s, v in by_source.items()} == {s: round(t) for s, t in targets.items()}


def test_draw(odd, empty):
    from termloom.llm import mixing

    taken = Counter()
    for r in mixing.mix(odd).collect():
        taken[r.doc_id] += r.taken
    out = mixing.draw(odd)
    assert out.schema == odd.schema
    drawn = Counter()
    for r in out.collect():
        drawn[r.doc_id] += size_of(r.text)
        assert r["size"] == "x" and r.k1 == 7
    assert {k: v for k, v in drawn.items() if v} == {k: v for k, v in taken.items() if v}
    assert mixing.mix(empty).count() == 0 and mixing.draw(empty).count() == 0


# --- 6 and 10: tokenizers ---------------------------------------------------

STRANGE = [" a\x1cb ΑΣ ΣΑΣ. İI ﬁ é x<|endoftext|>y <|startoftext|>", "don't WE'LL 123 4½ ½²　 z\u0085q 你好 😀👍🏽 ::--!! <| a​b", "a\n \nb  c \n d ", "\n\n a\n", "<|endoftext|><|endoftext|>", " a ", "a  b", "́x ẛ̣", "q" * 5000]


@pytest.fixture(scope="module")
def strange(spark, odd):
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(STRANGE)], "doc_id long, text string")
    return odd.select("doc_id", "text").unionByName(extra).cache()


def test_bpe_equals_the_library(strange, empty):
    from termloom.llm import bpe

    path = paths.path("word_bpe_49k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    tok.no_truncation(), tok.no_padding()
    expected = []
    for r in strange.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        expected.append((r.doc_id, len(ids), " ".join(map(str, ids)), sha(tok.decode(ids, skip_special_tokens=False))))
    got = bpe.encode_decode(strange, path, outputs=("n_tokens", "ids", "decoded_sha256"))
    same_rows(map(tuple, got.collect()), expected)
    assert bpe.encode_decode(empty, path).count() == 0


def test_every_code_point(spark):
    """BPE and token counts equal the library's around every code point."""
    from termloom.llm import bpe, token_counts

    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000 and c not in range(0x40000, 0xDFF00)]
    shapes = ("{0}", "x{0}y", "{0}T", "7{0}7", "{0}\u0301", "e\u0301{0}\u0323", "!{0} {0}{0}", "\u209d{0}")
    texts = [" a ".join(shape.format(c) for c in points[k : k + 500]) for shape in shapes for k in range(0, len(points), 500)]
    rng = random.Random(6)
    texts += ["".join(rng.choices(points, k=40)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(8)
    models = [paths.path("word_bpe_49k.json"), paths.path("byte_bpe_50k.json")]
    for path, got in zip(models, (bpe.encode_decode(docs, models[0], outputs=("ids",)), token_counts.count_tokens(docs, models[1]).select("doc_id", "n_tokens")), strict=True):
        tok = tokenizers.Tokenizer.from_file(path)
        tok.no_truncation(), tok.no_padding()
        expected = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        wrong = [i for i, x in got.collect() if x != (" ".join(map(str, expected[i])) if path == models[0] else len(expected[i]))]
        assert not wrong, (path, len(wrong), repr(texts[wrong[0]][:300]))


@pytest.mark.parametrize("head", [None, 0, 40])
def test_token_counts_equal_the_library(strange, empty, monkeypatch, head):
    from termloom.llm import token_counts

    if head is not None:
        monkeypatch.setattr(token_counts, "HEAD_ENTRIES", head)
    path = paths.path("byte_bpe_50k.json")
    tok = tokenizers.Tokenizer.from_file(path)
    expected = []
    for r in strange.collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        expected.append((r.doc_id, len((r.text or "").encode()), n, n > 512))
    same_rows(map(tuple, token_counts.count_tokens(strange, path).collect()), expected)
    assert token_counts.count_tokens(empty, path).count() == 0


# --- 7: transport streams ---------------------------------------------------


def test_transport_streams(odd, empty):
    import zlib

    from termloom.llm import transport_stream as ts

    got = {}
    for r in ts.digest_media(ts.store_texts(odd)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, _ in odd_texts():
        data = (t or "").encode()
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        assert any((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), sha(payload), zlib.crc32(payload[-16:])) for r in got[i])
        assert all(r.media_bytes % 188 == 0 and "continuity_errors=0;crc_errors=0;truncated=0" in r.feature for r in got[i])
    read = ts.read_media(ts.store_texts(odd)).where("doc_id = 50").first()
    assert len(read.timestamps) > 8 and read.random_access[:2] == [0, 8] and read.timestamps[1] - read.timestamps[0] == ts.TICKS
    assert ts.digest_media(ts.store_texts(empty)).count() == 0


def demultiplexed(stream):
    """Payload and timestamps of a one-programme stream, read by the standard's byte layout alone."""
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    assert all(p[0] == 0x47 for p in packets)

    def pid(p):
        return int.from_bytes(p[1:3], "big") & 0x1FFF

    def body(p):
        assert p[3] & 0x10 or p[3] & 0x20
        return p[4 + (1 + p[4] if p[3] & 0x20 else 0) :] if p[3] & 0x10 else b""

    pat = next(body(p) for p in packets if pid(p) == 0)
    pat = pat[1 + pat[0] :]
    pmt_pid = int.from_bytes(pat[10:12], "big") & 0x1FFF
    pmt = next(body(p) for p in packets if pid(p) == pmt_pid)
    pmt = pmt[1 + pmt[0] :]
    information = int.from_bytes(pmt[10:12], "big") & 0xFFF
    media_pid = int.from_bytes(pmt[13 + information : 15 + information], "big") & 0x1FFF
    units, counter = [], None
    for p in packets:
        if pid(p) == media_pid:
            if p[3] & 0x10:
                assert counter is None or p[3] & 15 == (counter + 1) % 16
                counter = p[3] & 15
            units += [b""] if p[1] & 0x40 else []
            units[-1] += body(p)
    payload, stamps = b"", []
    for u in units:
        assert u[:3] == b"\0\0\1" and u[7] & 0x80
        a = u[9:14]
        stamps.append((a[0] >> 1 & 7) << 30 | a[1] << 22 | a[2] >> 1 << 15 | a[3] << 7 | a[4] >> 1)
        length = int.from_bytes(u[4:6], "big")
        payload += u[9 + u[8] : 6 + length if length else None]
    return payload, stamps


def test_streams_read_by_another_demultiplexer(odd):
    from termloom.llm import transport_stream as ts

    rows = ts.store_texts(odd).collect()
    read = {r.media: r for r in ts.read_media(ts.store_texts(odd.withColumn("payload", F.lit("clash")))).join(ts.store_texts(odd).select("doc_id", "media").distinct(), "doc_id").collect()}
    texts = Counter(ts.padded(t or "") for _, t, _ in odd_texts())
    assert Counter(demultiplexed(bytes(r.media))[0] for r in rows) == texts
    for media, r in read.items():
        if r.doc_id not in (70, 71):
            assert (bytes(r.payload), r.timestamps) == demultiplexed(bytes(media))


def test_damaged_streams():
    from termloom.llm.transport_stream import PACKET, padded, read_stream, write_stream

    whole = write_stream(padded("some words " * 2000))
    for gone in (3, 9, 40):
        s = read_stream(whole[: gone * PACKET] + whole[(gone + 1) * PACKET :])
        assert s.continuity_errors == 1
    assert read_stream(whole[: 5 * PACKET] + whole[4 * PACKET :]).payload == read_stream(whole).payload  # a packet sent twice
    assert read_stream(b"junk" + whole).payload == padded("some words " * 2000)
    broken = bytearray(whole)
    broken[20] ^= 1
    assert read_stream(bytes(broken)).crc_errors == 1
    assert read_stream(b"").packets == 0 and read_stream(b"\x00" * 1000).packets == 0


def table_packets(pid, data, starts):
    """Packets of a table PID that carry data, with a pointer field in each packet in which a section starts (places in data)."""
    out, at, counter = [], 0, 0
    while at < len(data):
        first = next((s for s in starts if at <= s < at + 183), None)
        room = 184 if first is None else 183
        chunk = data[at : at + room]
        head = bytes([0x47, (0x40 if first is not None else 0) | pid >> 8, pid & 255, 0x10 | counter]) + (b"" if first is None else bytes([first - at]))
        out.append((head + chunk).ljust(188, b"\xff"))
        at, counter = at + room, counter + 1 & 15
    return out


def one_stream(pid, stream_id, data):
    """A PES packet of one packet each: with the optional header, or bare."""
    body = data if stream_id == 0xBF else bytes([0x80, 0, 0]) + data
    pes = b"\0\0\1" + bytes([stream_id, len(body) >> 8, len(body) & 255]) + body
    stuffing = 184 - len(pes)
    return bytes([0x47, 0x40 | pid >> 8, pid & 255, 0x30, stuffing - 1]) + (b"\0" + b"\xff" * (stuffing - 2)) + pes


def test_tables_that_span_packets_and_several_programmes():
    from termloom.llm import transport_stream as ts

    pat = ts._section(0, 1, b"".join(bytes([0, n, 0xE0 | 0x200 + n >> 8, n]) for n in range(1, 61)))  # 252 bytes: 60 programmes
    again = ts._section(0, 1, bytes([0, 77, 0xE2, 77]))
    packets = table_packets(0, pat + again, [0, len(pat)])  # the first section ends in the packet that the second one starts in
    assert len(packets) == 2
    for n in (1, 2):
        packets += table_packets(0x200 + n, ts._section(2, n, bytes([0xE3, n, 0xF0, 0, 6, 0xE3, n, 0xF0, 0])), [0])
    packets += [one_stream(0x302, 0xBD, b"second"), one_stream(0x301, 0xBF, b"a bare one"), one_stream(0x302, 0xBE, b"padding")]
    found = ts.read_stream(b"".join(packets))
    assert len(found.programmes) == 61 and found.programmes[60] == 0x200 + 60 and found.programmes[77] == 0x24D and found.crc_errors == 0
    assert found.payloads == {0x301: b"a bare one", 0x302: b"second"} and found.payload == b"a bare onesecond"
    assert found.stamps == [None, None]


# --- 8: toxicity ------------------------------------------------------------


def test_folding_of_a_word_depends_on_the_word_alone():
    from termloom.llm.toxicity import fold

    for word in ("id!ot", "idi|ot", "fa99ot", "1d!0t", "idi0t", "m0r0n", "$tup!d"):
        for around in ("{}", "a {} b", "7 {} @ 5!", "what? {}, 100 | 20"):
            assert fold(word) in fold(around.format(word)).replace(",", " ").split(" "), (word, around)
    assert fold("id!ot") == fold("id|ot") == fold("idiot") and fold("fa99ot") == fold("faggot")


def test_null_and_empty_texts_are_never_rejected(spark):
    from termloom.llm.toxicity import Lexicon, reject

    df = spark.createDataFrame([(1, None), (2, ""), (3, "an idiot"), (4, "fine")], "doc_id long, text string")
    assert {r.doc_id for r in reject(df, Lexicon({"idiot": 5.0}, bias=3.0)).collect()} == {1, 2}


def test_toxicity_folding_and_exceptions():
    from termloom.llm.toxicity import EXCEPTIONS, Lexicon, fold

    m = Lexicon({fold("idiot"): 5.0, fold("trash"): 4.0, fold("loser"): 4.0}, tuple(fold(x) for x in EXCEPTIONS)).matcher()
    for t in ("an idiot", "an 1d10t!", "an ІDІОТ", "ｉｄｉｏｔ", "idíöt", "idiots", "what a l0ser", "1oser", "i.d.i.o.t", "idiooot!", "1d\u200biot", "tr@sh", "TRA$H", "$o, 7rash"):
        assert m.score(t)[0] > 0.5, t
    for t in ("", "a trash can", "the trash bins", "Antidiotic", "10 100 1000", None or " "):
        assert m.score(t)[0] < 0.3 or t == "the trash bins", t
    assert m.score("trash, in a trash can")[1] == 1
    assert m.score("idiot " + "fine words " * 500)[0] < m.score("idiot fine words")[0]
    assert m.hits("trash can trash bin idiot " * 3000) == {"idiot".replace("l", "i"): 3000}


def brute_toxicity(text, lexicon):
    """The same score from a look at every entry at every place of the folded text."""
    import math

    from termloom.llm.toxicity import fold, kind

    folded = fold(text)
    unspaced = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u4e00-\u9fff]")
    letter = [c.isalpha() and not unspaced.match(c) for c in folded] + [False]
    spared = set()
    for x in lexicon.exceptions:
        for m in re.finditer(f"(?={re.escape(x)})", folded):
            a, b = m.start(), m.start() + len(x)
            if not (a and letter[a - 1]) and not letter[b]:
                spared.update(range(a, b))
    total = hits = 0
    for s, w in sorted(lexicon.weights.items()):
        n = 0
        for m in re.finditer(f"(?={re.escape(s)})", folded):
            a, b = m.start(), m.start() + len(s)
            whole = kind(s) == "word"
            n += a not in spared and (kind(s) == "run" or not (a and letter[a - 1])) and not (whole and letter[b])
        hits += n
        total += w * (1 + math.log(n)) if n else 0
    total /= 1 + lexicon.length_power * math.log1p(len(text) / 1000)
    return 1 / (1 + math.exp(-max(-30, min(30, lexicon.slope * total + lexicon.bias)))), hits


def test_toxicity_against_brute_force(spark, sf_dir):
    from termloom.llm import toxicity

    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lexicon = toxicity.learn(docs, labels)
    few = docs.join(labels.where("toxic = 1").select("doc_id").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")).distinct(), "doc_id")
    got = {r.doc_id: r for r in toxicity.score(few, lexicon).collect()}
    texts = {r.doc_id: r.text for r in few.collect()}
    assert len(got) == len(texts) > 200
    for i, t in texts.items():
        score, hits = brute_toxicity(t or "", lexicon)
        assert abs(got[i].score - score) < 1e-9 and got[i].n_hits == hits and got[i].predicted == int(score >= 0.3)


def test_short_words_and_other_scripts_are_learned(spark):
    from termloom.llm import toxicity

    rng = random.Random(4)
    bad = ["zog", "чушня", "恥辱者", "สารเลว", "blorkwit"]
    rows = []
    for i in range(1200):
        words = [rng.choice(["alpha", "beta", "слово", "вещь", "日本語文", "ดีมาก", "zo", "gamma"]) for _ in range(12)]
        if i % 4 == 0:
            words[rng.randrange(12)] = bad[i // 4 % 5]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id int, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id int, toxic int"))
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, lexicon).collect()}
    assert all(got[i] == y for i, _, y in rows)
    m = lexicon.matcher()
    assert m.score("alpha Zog!")[0] > 0.5 and m.score("alpha zogs")[0] < 0.3 and m.score("彼は恥辱者です")[0] > 0.5


def test_toxicity_held_out(spark, odd, empty):
    from termloom.llm import toxicity

    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, lexicon).join(labels, "doc_id").where("held_out")
    right, wrong = scored.where("predicted = toxic").count(), scored.where("predicted <> toxic").count()
    assert wrong / (right + wrong) < 0.03
    hit = scored.where("toxic = 1").agg(F.avg("predicted")).first()[0]
    assert hit > 0.85
    assert toxicity.score(odd, lexicon).count() == odd.count()
    assert toxicity.learn(odd, labels.where(F.lit(False))).weights and toxicity.score(empty, lexicon).count() == 0
    kept = toxicity.reject(odd, lexicon)
    assert kept.schema == odd.schema and kept.count() == odd.count()


def test_labels_do_not_leak(spark):
    from termloom.llm import toxicity

    rows = [(i, f"plain words here number {i} " + ("zzqix" if i % 3 == 0 else "other")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0).alias("toxic"), toxicity.held_out("doc_id").alias("out"))
    flipped = labels.select("doc_id", F.when(F.col("out"), 1 - F.col("toxic")).otherwise(F.col("toxic")).alias("toxic"))
    assert toxicity.learn(docs, labels) == toxicity.learn(docs, flipped)


# --- 9: licences ------------------------------------------------------------


LICENCE_TEXTS = {
    "gpl-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "gpl-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU General Public License for more details.",
    "gpl-2.0-only-notice": "Foo is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl-2.1-or-later-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.\n\nThis library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-text": 'Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n\nTERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n1. Definitions.\n\n"License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.\n\n"Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License.\n\n2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.\n\n4. Redistribution. You may reproduce and distribute copies of the Work or Derivative Works thereof in any medium, with or without modifications, and in Source or Object form, provided that You meet the following conditions:',
    "gpl-3.0-text": "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\nCopyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\nEveryone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.\n\nPreamble\n\nThe GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "mit-titled-text": 'MIT License\n\nCopyright (c) 2020 Some One\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS.',
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-text": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "gpl-2.0-reference": "This software is licensed under the GNU General Public License version 2.",
    "gpl-3.0-or-later-reference": "You may use it under the terms of the GNU GPL, version 3 or later, if you like.",
    "mit-reference": "This project is licensed under the MIT License - see the LICENSE file for details.",
    "bsd-2-clause-reference": "It is made available under a simplified BSD license.",
}
LICENCE_LINES = {
    "SPDX-License-Identifier: MIT": ["MIT"], "SPDX-License-Identifier: GPL-3.0-or-later": ["GPL-3.0-or-later"], "SPDX-License-Identifier: GPL-2.0+": ["GPL-2.0-or-later"],
    "SPDX-License-Identifier: (Apache-2.0 OR MIT) */": ["Apache-2.0", "MIT"], "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0": ["GPL-2.0-only"],
    "License: Apache-2.0": ["Apache-2.0"], '  "license": "ISC",': ["ISC"], 'license = "BSD-3-Clause"': ["BSD-3-Clause"], "License :: OSI Approved :: MIT License": ["MIT"], "License: see below": [],
}


def test_license_rules(odd, empty):
    from termloom.llm.licenses import SENTENCES, scan, scan_licenses

    assert [m[0] for m in scan("Some text. Licensed under the Apache License, Version 2.0.")] == ["Apache-2.0"]
    assert [m[0] for m in scan("words\nThis work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.")] == ["GPL-3.0", "MIT"]
    assert [m[0] for m in scan("Licensed under CC BY-NC 4.0.")] == ["CC-BY-NC-4.0"]
    text = ". ".join(SENTENCES[k].capitalize() for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")) + "."
    assert [m[1] for m in scan("Copyright 2020 Me. " + text)] == ["mit-text"]
    assert [m[1] for m in scan(text + " " + text)] == ["mit-text", "mit-text"]
    header = "# " + ".\n# ".join(SENTENCES[k].capitalize() for k in ("apache-header", "apache-use")) + ".\n"
    assert [m[1] for m in scan(header)] == ["apache-2.0-header"]
    swapped = ". ".join(SENTENCES[k].capitalize() for k in ("mit-notice", "mit-grant")) + "."
    assert [m[1] for m in scan(swapped)] == ["mit-grant"]
    for clean in ("", "A licence to kill is not a licence.", "We were under the bridge. License plates.", "She studied under MIT professors. Permission is granted.", "The term license: a long word.", "We fell under.\n\nMIT\n\nThe end"):
        assert scan(clean) == [], clean
    got = scan_licenses(odd).collect()
    assert len(got) == odd.count() and not any(r.n_licenses for r in got) and scan_licenses(empty).count() == 0


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", ";; "])
@pytest.mark.parametrize("width", [20, 48, 63, 72, 79, 10_000])
def test_standard_licence_texts(width, mark):
    import textwrap

    from termloom.llm.licenses import scan

    def wrapped(text):
        lines = [line for p in text.split("\n\n") for line in (*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), "")]
        return "".join(f"{mark}{line}".rstrip() + "\n" for line in lines)

    for rule, text in LICENCE_TEXTS.items():
        found = scan(wrapped("Copyright (C) 2020 Some One\n\n" + text))
        assert [m[1] for m in found] == [rule], (rule, found)
    for line, expected in LICENCE_LINES.items():
        found = scan(wrapped("Some words.") + mark + line + "\n" + wrapped("Copyright 2020"))
        assert [m[0] for m in found] == expected, (line, found)


def test_every_licence_rule_can_match():
    from termloom.llm.licenses import RULES, SENTENCES, known_places, known_sentences, licence_names, text_sentences

    known = dict(known_sentences())
    made = {s: [i for _, i in known_places(s)] for s in [*known][::37] + [*text_sentences()]}
    assert all(found == [known[s]] for s, found in made.items())
    made = {*known.values()}
    assert made == {*SENTENCES, "gpl-details", *(f"ref:{n}" for n in licence_names().values()), *(i for i in made if i.startswith("free:"))}
    assert all(made.issuperset((*r.sequence, *r.also)) for r in RULES)
    assert {*SENTENCES} == {*SENTENCES} & {i for r in RULES for i in (*r.sequence, *r.also)}, "every sentence serves a rule"


@functools.lru_cache(1)
def licence_sentences_by_word():
    from termloom.llm.licenses import known_sentences

    first = {}
    for words, i in sorted(((s.split(), i) for s, i in known_sentences()), key=lambda x: -len(x[0])):
        first.setdefault(words[0], []).append((words, i))
    return first


def brute_licences(text):
    """The same definition in loops: words of a sentence against every known sentence, then rules tried at every place."""
    from termloom.llm.licenses import RULES, normalise, sentences

    first = licence_sentences_by_word()
    places = []
    for number, (sentence, licences) in enumerate(sentences(text)):
        if licences is not None:
            places += [(number, f"ref:{x}") for x in licences]
            continue
        words, at = normalise(sentence).split(), 0
        while at < len(words):
            hit = next(((w, i) for w, i in first.get(words[at], []) if words[at : at + len(w)] == w), None)
            if hit:
                places.append((number, hit[1]))
            at += len(hit[0]) if hit else 1
    out, free = [], [True] * len(places)
    for rule in RULES:
        start = 0
        while start < len(places):
            run, i = [], start
            wanted = list(rule.sequence)
            while free[start] and i < len(places) and (not run or places[i][0] - places[run[-1]][0] <= rule.gap + 1):
                name = places[i][1]
                if free[i]:
                    if wanted and name == wanted[0]:
                        run.append(i)
                        wanted.pop(0)
                    elif not wanted and name in rule.also:
                        run.append(i)
                    elif not run or name == rule.sequence[0]:
                        break
                i += 1
            if not wanted:
                out.append((rule.licence, rule.name, places[run[0]][0]))
                for i in run:
                    free[i] = False
            start += 1
    out += [(n[4:], n[4:].lower() + "-reference", p) for (p, n), f in zip(places, free, strict=True) if f and n.startswith("ref:")]
    return sorted(out, key=lambda m: (m[2], m[1]))


def test_license_scan_against_brute_force(spark, sf_dir):
    from termloom.llm.licenses import scan_licenses

    rng = random.Random(9)
    pieces = [*LICENCE_TEXTS.values(), *LICENCE_LINES, *(t.split(". ")[0] + "." for t in LICENCE_TEXTS.values())]
    texts = ["\n\n".join(sentences(rng, 3) if rng.random() < 0.4 else rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(150)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        expected = brute_licences(t or "")
        assert (got[i].rules, got[i].places, got[i].licenses) == ([m[1] for m in expected], [m[2] for m in expected], sorted({m[0] for m in expected})), t
