"""Candidates of an input by hand: stable ties, signatures, provenance."""

from pyspark.sql import functions as F

from termloom.operators import resolution as R

SHAPE = "k int, resolver_order int, resolver string, confidence double, canonical string, same_as array<string>, schema_type string, title string"


def test_ties_go_by_priority_then_registration(spark):
    rows = [(1, "a", 0.5, 1, 0), (1, "b", 0.9, 9, 1), (1, "c", 0.9, 2, 3), (1, "d", 0.9, 2, 2), (2, "x", 0.1, 1, 1)]
    got = {r.k: [c["class"] for c in r.classes] for r in R.best_first(spark.createDataFrame(rows, "k int, class string, confidence double, priority int, registered int"), ["k"]).collect()}
    assert got == {1: ["d", "c", "b", "a"], 2: ["x"]}


def test_ranking_signatures_and_sources(spark):
    rows = [
        (1, 1, "late", 0.99, "B", None, "Book", "one"),
        (1, 0, "early", 0.5, "b:2", ["X", "y"], "Book", ""),
        (1, 0, "early", 0.5, "A:1", [], "Book", "Zero"),
        (1, 1, "late", 0.2, "B:2", ["Y", "x"], "BOOK", ""),  # the same as the second, whatever case and order
        (1, 0, "early", 0.5, "b:2", ["x"], "Book", ""),  # other ids: another atom
        (2, 0, "early", 0.1, None, None, "Thing", None),
    ]
    ranked = R.ranked_atoms(spark.createDataFrame(rows, SHAPE), ["k"])
    got = [(r.k, r.place, r.canonical, r.resolver) for r in ranked.orderBy("k", "place").collect()]
    assert [g[:3] for g in got if g[0] == 1] == [(1, 1, "A:1"), (1, 2, "b:2"), (1, 3, "b:2"), (1, 4, "B")] and got[-1] == (2, 1, None, "early")
    merged = {(r.k, r.field): (r.value, r.source) for r in R.merged_fields(ranked, ["k"], {"title": F.col("title"), "canonical": F.col("canonical")}, "resolver").collect()}
    assert merged == {(1, "title"): ("Zero", "early"), (1, "canonical"): ("A:1", "early")}
    assert R.ranked_atoms(spark.createDataFrame([], SHAPE), ["k"]).count() == 0
