"""Operator 11 against the library: ids, decoding, odd rows, tables with and without a head."""

import hashlib
import random

import pytest

from tests.llm.conftest import frame, odd_texts

sentencepiece = pytest.importorskip("sentencepiece")
paths = pytest.importorskip("public_tokenizers")

FILE = paths.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "a", "the", "ing", "▁", "é", "日", "😀", "\x00", "\t", "\r\n", "1", "23", ".", ",", "<s>", "</s>", "<unk>", "<0x41>", "́", "st", " on", "　", "�", "_", "²", "Ⅷ", "-", "ü", "١", "ª", "क", "ि"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, rows):
    out = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("apart", [True, False])
def test_segments_and_decodes_as_the_library(library, apart):
    from termloom.llm.sentencepiece_table import Chunks, read_model

    model = read_model(FILE)
    assert model.numerals is not None
    if not apart:
        model.numerals = None
    cut, rng = Chunks(model).of, random.Random(3)
    for _ in range(2500):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([2, 9, 30, 90])))
        ids = library.encode(text)
        assert ",".join(model.ids(c) for c in cut(text)) == ",".join(map(str, ids)), text
        assert model.decode(",".join(map(str, ids))) == library.decode(ids)


def test_decodes_any_ids(library):
    from termloom.llm.sentencepiece_table import read_model

    model, rng = read_model(FILE), random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32000), 35, 29871]) for _ in range(rng.randint(0, 8))]
        assert model.decode(",".join(map(str, ids))) == library.decode(ids), ids


@pytest.mark.parametrize("head_bytes, bits", [(None, 27), (0, 27), (4000, 27), (4000, 7)])
def test_documents(spark, odd, library, monkeypatch, head_bytes, bits):
    from termloom.llm import sentencepiece_table

    monkeypatch.setattr(sentencepiece_table, "BITS", bits)  # few bits: single chunks come by the join too
    if head_bytes is not None:  # all chunks, or most, come by the join
        monkeypatch.setattr(sentencepiece_table, "HEAD_BYTES", head_bytes)
    out = sentencepiece_table.encode_decode(odd, FILE, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(library, odd_texts())


def test_long_texts_and_chunks(spark, library):
    from termloom.llm import sentencepiece_table

    rng = random.Random(5)
    blob = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=300_000))
    rows = [(1, "".join(rng.choices(PARTS, k=400_000)), ""), (2, blob, ""), (3, " " * 100_000, ""), (4, "x " + blob + "\n" + blob, ""), (5, blob, "")]
    out = sentencepiece_table.encode_decode(frame(spark, rows), FILE, outputs=("n_tokens", "ids_sha256", "decoded_sha256"))
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(library, rows)


def test_outputs_and_empty(spark, empty, library):
    from termloom.llm import sentencepiece_table

    out = sentencepiece_table.encode_decode(frame(spark, [(1, "the end", "")]), FILE).first()
    assert (out.ids, out.decoded) == (",".join(map(str, library.encode("the end"))), "the end")
    assert sentencepiece_table.encode_decode(empty, FILE).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    from termloom.llm.sentencepiece_table import read_model

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(FILE, "rb").read())
    proto.pieces[5000].piece = "a▁b"
    (tmp_path / "crossing.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        read_model(str(tmp_path / "crossing.model"))
