"""Operators 6 and 10 on texts of very many long runs without blanks: right, and nothing long is remembered."""

import random

import pytest

from tests.llm.conftest import frame

tokenizers = pytest.importorskip("tokenizers")
paths = pytest.importorskip("public_tokenizers")


def runs(n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=length)) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    long = runs(300, 2000, 1)
    rule = "-" * 3000
    texts = [" ".join(long[:150]), "\n".join(long[150:]), f"{rule} x {rule}", rule * 40, " " * 5000 + rule, "<|endoftext|>" + long[3]] + [f"{i} {rule}" for i in range(30)]
    return [(i, t, "s") for i, t in enumerate(texts)]


def test_bpe_remembers_short_pieces_only(spark, rows):
    from termloom.llm import bpe
    from termloom.llm.unicode_classes import library_classes

    path = paths.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    got = {r.doc_id: r.ids for r in bpe.encode_decode(frame(spark, rows), path).collect()}
    assert got == {i: " ".join(map(str, library.encode(t, add_special_tokens=False).ids)) for i, t, _ in rows}
    coder = bpe.WordBpe(open(path, encoding="utf-8").read(), library_classes())
    for _, t, _ in rows:
        coder.encode(t)
    assert max(map(len, [*coder.pieces, *coder.chunks])) <= bpe.REMEMBERED_LENGTH


@pytest.mark.parametrize("held", [400_000, 10])
def test_counts_of_long_runs(spark, rows, monkeypatch, held):
    from termloom.llm import token_counts

    monkeypatch.setattr(token_counts, "HEAD_ENTRIES", held)
    path = paths.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation(), library.no_padding()
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, rows), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t, _ in rows}
