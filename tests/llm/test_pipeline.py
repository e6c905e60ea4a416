"""Every stage of the pipeline against a brute-force version of it on the rows it was given."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_text_operators import brute_classes, brute_suffix, brute_targets, sha, size_of  # noqa: E402


def test_stages(spark, sf_dir):
    from tokenizers import Tokenizer

    from termloom.llm import toxicity
    from termloom.llm.common import materialize
    from termloom.llm.queries import tokenizer_file

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        out = materialize(stage(spark, docs, sf_dir), name)
        if name != "bpe":
            assert out.columns == docs.columns
            docs = out
    last = out.collect()

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lexicon = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)
    matcher = lexicon.matcher()
    assert Counter(i for i, t, _ in inputs["toxicity"] if matcher.score(t)[0] < 0.3) == Counter(i for i, _, _ in inputs["near_duplicates"])
    classes = brute_classes(inputs["near_duplicates"])
    assert {i for i, c, _ in classes if i == c} == {i for i, _, _ in inputs["suffix_dedup"]}
    removed = {i: (n, gone) for i, n, gone, _, _ in brute_suffix(inputs["suffix_dedup"])}
    before = {i: t for i, t, _ in inputs["suffix_dedup"]}
    for i, t, _ in inputs["mix"]:
        n, gone = removed[i]
        assert n - gone - 6 <= len(t.encode()) <= n - gone and (gone or t == before[i])
    sizes = Counter()
    for _, t, s in inputs["mix"]:
        sizes[s] += size_of(t)
    taken = Counter()
    for _, t, s in inputs["bpe"]:
        taken[s] += size_of(t)
    assert {s: round(v) for s, v in brute_targets(dict(sizes)).items() if round(v)} == {s: n for s, n in taken.items() if n}
    tok = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    tok.no_truncation(), tok.no_padding()
    expected = Counter()
    for i, t, _ in inputs["bpe"]:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        expected[(i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))] += 1
    assert expected == Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in last)


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = corpus_pipeline.run(spark, sf_dir)
    assert set(got.columns) >= {"doc_id", "n_tokens", "ids"} and 0 < got.select("doc_id").distinct().count() <= docs.count()
    assert got.where(F.col("n_tokens").isNull()).count() == 0


def test_stages_on_odd_and_empty_rows(spark, odd, empty, sf_dir):
    """Every stage takes nulls, empty texts, repeated rows and clashing columns, and keeps the columns it is given; on empty tables it returns none."""
    for docs, least in ((odd, 20), (empty, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "bpe":
                assert out.where("n_tokens IS NULL").count() == 0
            else:
                assert out.schema.simpleString() == docs.schema.simpleString(), name
            assert out.count() >= least, name
            if not least:
                assert out.count() == 0
