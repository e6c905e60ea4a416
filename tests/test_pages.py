"""Meta tags and linked data of pages by hand-written values."""

import json

from pyspark.sql import functions as F

from termloom.operators import atoms as A
from termloom.operators import pages as P


def block(x, attributes='type="application/ld+json"'):
    return f"<script {attributes}>{x if isinstance(x, str) else json.dumps(x)}</script>"


def nested(depth, leaf):
    for k in range(depth):
        leaf = {"@graph": [leaf, {"@type": f"S{k}"}]}
    return leaf


def names(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    return [json.loads(n) for n in df.select(P.json_ld_nodes(F.col("html")).alias("n")).first().n]


def in_order(parsed):
    """What a queue gives: front to back, lists under @graph put at its end."""
    queue, out = list(parsed) if isinstance(parsed, list) else [parsed], []
    while queue:
        x = queue.pop(0)
        if isinstance(x, dict):
            if isinstance(x.get("@graph"), list):
                queue += x["@graph"]
                if "@type" not in x:
                    continue
            out.append(x)
    return out


def test_linked_data_of_any_depth(spark):
    deep = nested(25, {"@type": "Leaf", "name": "at the bottom"})
    assert names(spark, block(deep)) == in_order(deep) and len(in_order(deep)) == 26
    both = [{"@type": "A", "@graph": [{"@type": "C", "@graph": [{"@type": "E"}]}, 7, None, ["x"]]}, {"@graph": [{"@type": "D"}]}, "text", {"@type": "B", "@graph": {"@type": "not a list"}}]
    assert names(spark, block(both) + "between" + block({"@type": "Second"})) == in_order(both) + [{"@type": "Second"}]


def test_blocks_of_linked_data(spark):
    one = {"@type": "T", "name": "a > b </ c"}
    for attributes in ("type='application/ld+json'", 'data-x="1 > 0" TYPE = "application/ld+json" async', 'type="application/ld+json"'):
        assert names(spark, block(one, attributes)) == [one]
    assert names(spark, block(one, 'type="text/javascript"') + block("{broken") + block("") + "<script" + block("/* <![CDATA[ */ " + json.dumps({"n": "x &amp; y"}) + " /* ]]> */")) == [{"n": "x & y"}]
    assert names(spark, "no scripts") == [] and names(spark, "") == []
    assert spark.sql("SELECT CAST(NULL AS STRING) AS html").select(P.json_ld_nodes(F.col("html")).alias("n")).first().n in (None, [])


def test_meta_tags(spark):
    html = """<meta property="og:title" content="First"><META content='It is "new"' PROPERTY='og:title'><meta name="og:description" content="It's a day > night">
      <meta property="og:image" content=""><meta name="og:type" property="og:locale" content="de"><meta property="og:audio:type" content="audio/mpeg"><meta content="x">
      <meta name="og:site_name" content="one" content="two"><metadata property="og:url" content="no"><title> T </title>"""
    got = A.open_graph(spark.createDataFrame([(html, "https://u.example/")], "html string, url string")).first()
    assert (got.title, got.description, got.image, got.type, got.locale, got.audio_type, got.site_name, got.og_url) == ('It is "new"', "It's a day > night", None, None, "de", "audio/mpeg", "two", "https://u.example/")
    empty = A.open_graph(spark.createDataFrame([("", "u"), (None, "v")], "html string, url string")).collect()
    assert [r.title for r in empty] == [None, None] and [r.audio for r in empty] == [None, None]


def test_published_hash_values(spark):
    df = spark.createDataFrame([("", "811c9dc5"), ("a", "e40c292c"), ("foobar", "bf9cf968")], "text string, hash string")
    assert df.where(A.fnv1a32(F.col("text")) != F.col("hash")).count() == 0


def test_dropped_partitions(spark, tmp_path):
    from termloom.sources import sinks

    root = str(tmp_path / "t")
    spark.range(40).select("id", F.concat(F.lit("2024-01-1"), (F.col("id") % 4).cast("string")).alias("day")).write.partitionBy("day").parquet(root)
    kept = {p.name for p in (tmp_path / "t" / "day=2024-01-13").iterdir()}
    assert sinks.drop_partitions(spark, root, "day", "2024-01-12") == ["2024-01-10", "2024-01-11"]
    assert spark.read.parquet(root).count() == 20 and {p.name for p in (tmp_path / "t" / "day=2024-01-13").iterdir()} == kept
    assert sinks.drop_partitions(spark, root, "day", "2024-01-12") == []


def test_types_of_a_page_are_read_once(spark):
    df = spark.createDataFrame([(['{"@type": "Person"}', '{"@type": ["Thing", "Book"]}'],)], "nodes array<string>").select(P.primary_type(F.col("nodes")).alias("t"))
    assert df.first().t == "Book"
    assert "array_contains(flatten(" not in df._jdf.queryExecution().optimizedPlan().toString()  # else the nodes are made anew for each known type
