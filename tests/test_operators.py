"""Boundary facts of projections, funnels, parsing and streams."""

import pytest
from pyspark.sql import functions as F

from termloom.operators import atoms as A
from termloom.operators import pages as P
from termloom.operators import sites as S
from termloom.operators import behavior as B
from termloom.operators import market as M


def events(spark, rows):
    df = spark.createDataFrame(rows, "account long, at string, seq long")
    return df.select("account", F.col("at").cast("timestamp_ntz").alias("ts"), "seq")


def test_funnel_windows(spark):
    start = B.first_by(events(spark, [(1, "2024-01-01 00:00:00", 2), (1, "2024-01-01 00:00:00", 1), (2, "2024-01-05 00:00:00", 3)]))
    assert {r.account: r.event_id for r in start.collect()} == {1: 1, 2: 3}
    later = events(spark, [(1, "2024-01-01 00:00:00", 10), (1, "2024-01-08 00:00:00", 11), (1, "2024-01-08 00:00:01", 12), (2, "2024-01-04 23:59:59", 13), (3, "2024-01-06 00:00:00", 14)])
    inside = lambda strict: sorted(r.seq for r in B.within(later, start, 7, strict).collect())
    assert inside(False) == [10, 11] and inside(True) == [11]
    assert [r.event_id for r in B.nth_by(later, 3).collect()] == [12]


def changes(spark, rows):
    df = spark.createDataFrame(rows, "seq long, account long, term long, curve long, shares_delta long, assets_in long, assets_out long")
    return df.withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, seq)"))


def test_cost_basis_moves_with_deposits_only(spark):
    rows = changes(spark, [(1, 1, 1, 0, 100, 200, 0), (2, 1, 1, 0, -50, 0, 150), (3, 1, 1, 0, 100, 400, 0), (4, 1, 1, 0, -150, 0, 600), (5, 2, 1, 0, -10, 0, 30)])
    got = {r.seq: (r.cost_basis, r.realized, r.shares_after) for r in M.fold_positions(rows).collect()}
    assert got[2] == (2.0, 50.0, 50) and got[4] == (3.0, 150.0, 0)
    assert got[5] == (0.0, 30.0, -10)  # before any deposit all of it is profit


def test_leaderboard_hours_are_whole(spark):
    rows = changes(spark, [(10, 1, 1, 0, 10, 100, 0), (3600 * 5 + 1800, 1, 1, 0, 10, 100, 0), (3600 * 8 + 59, 1, 1, 0, -5, 0, 80)])
    ticks = spark.createDataFrame([(1, 1, 0, 9, 9, 9)], "seq long, term long, curve long, share_price long, total_assets long, total_shares long").withColumn("ts", F.expr("TIMESTAMP_NTZ'2024-01-01 07:00:00'"))
    board = M.leaderboard(rows, ticks, "2024-01-01 05:10:00", "2024-01-01 08:00:00", scale=1.0).first()
    assert (board.deposits, board.redemptions, board.positions) == (0, 80, 1)  # the start hour is part of the start snapshot, the end hour of the end
    assert board.equity == 15 * 9 and board.realized_pnl == 80 - 5 * 10
    assert M.leaderboard(rows, ticks, "2024-01-01 05:10:00", "2024-01-01 08:00:00", min_positions=2).count() == 0
    assert M.leaderboard(rows, ticks, "2024-01-01 05:10:00", "2024-01-01 08:00:00", excluded_accounts=rows.select("account").distinct()).count() == 0


def test_as_of_with_forward_fallback(spark):
    rows = spark.createDataFrame([("a", 1, 10), ("a", 5, 50), ("b", 7, 70), ("b", 9, 90)], "k string, t int, v int")
    got = {r.k: r.v for r in M.as_of_forward(rows, ("k",), "t", F.lit(4), "v").collect()}
    assert got == {"a": 10, "b": 70}
    assert {r.k: r.v for r in M.as_of(rows, ("k",), "t", F.lit(4), ["v"]).collect()} == {"a": 10}


def test_small_populations_score_three(spark):
    profile = spark.createDataFrame([(1, 5, 10, True), (2, 1, 0, False)], "account long, frequency long, volume long, is_active boolean").withColumn("last_day", F.expr("TIMESTAMP_NTZ'2024-01-30 00:00:00'"))
    got = {r.account: (r.r, r.f, r.m) for r in B.rfm(profile, "2024-01-31 00:00:00").collect()}
    assert got == {1: (3, 3, 3), 2: (None, None, None)}


def test_parse_kinds(spark):
    cases = {
        "ipfs://bafybeigdyrzt5rj6uqb6t5x3r7b6g6j4gh7f6wzsp4r4i2l3x6jt6s5z3e/metadata/item.json": ("ipfs", "ipfs://bafybeigdyrzt5rj6uqb6t5x3r7b6g6j4gh7f6wzsp4r4i2l3x6jt6s5z3e/metadata/item.json"),
        "0xd8da6bf26964af9d7eed9e03e53415d37aa96045": ("ethereum_address", "0xd8da6bf26964af9d7eed9e03e53415d37aa96045"), "Vitalik.ETH": ("ens_name", "vitalik.eth"), '{"url":"https://example.com"}': ("json", '{"url":"https://example.com"}'), "17": ("plain_string", "17"),
        "http://Example.com:80/path/doc.json?download=1": ("url", "http://example.com/path/doc.json?download=1"), "https://example.com?q": ("url", "https://example.com/?q"), "978-0-306-40615-7": ("isbn", "9780306406157"), "978-0-306-40615-8": ("plain_string", "978-0-306-40615-8"), "0-306-40615-2": ("isbn", "0306406152"),
        "  hello world  ": ("plain_string", "hello world"), "": (None, None), "  ": (None, None), None: (None, None), "x" * 20000: (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "input string")
    got = {r.input: (r.kind, r.canonical) for r in A.parse(df, "input").collect()}
    assert got == cases


def test_classify(spark):
    cases = {
        "https://github.com/a/b/pull/7": "github:pull", "https://www.github.com/a": "web:website", "https://github.com/a/b": "github:repo", "https://github.com/pricing": "web:website", "https://youtu.be/abc": "web:website", "https://youtu.be/dQw4w9WgXcQ": "youtube:video",
        "https://twitter.com/me/status/12": "x:post", "https://de.wikipedia.org/wiki/Apfel": "wikipedia:article", "https://example.com/x": "web:website", "hello": "plain-text:word", "many words are in this text": "plain-text:phrase", "ISBN 9780306406157": "isbn:isbn-13", "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "input string")
    rows = {r.input: r for r in S.classify(df, "input").collect()}
    assert {k: r["class"] for k, r in rows.items()} == cases
    article = spark.createDataFrame([("https://en.wikipedia.org/wiki/Go_(software)",)], "input string")
    r = S.classify(article, "input").first()
    assert (r.schema_type, r.category, r.title, r.canonical_id) == ("SoftwareApplication", "software", "Go (software)", "wikipedia:go-software")


def test_plugin_order():
    plugins = [("c", 1, ("a",)), ("a", 9, ()), ("b", 5, ()), ("d", 1, ("b", "c"))]
    assert S.plugin_order(plugins) == ["b", "a", "c", "d"]
    for wrong in ([("a", 1, ("b",)), ("b", 1, ("a",))], [("a", 1, ("none",))]):
        with pytest.raises(ValueError):
            S.plugin_order(wrong)


def test_page_metadata(spark):
    html = """<html><head><title> Fallback &amp; more </title><meta property="og:title" content="A title"><meta content='Said' property='og:description'/><META NAME="og:image" CONTENT="https://i/x.png">
    <meta property="twitter:player:stream" content="https://a/b.mp3"><script type="application/ld+json">{"@graph": [{"@type": "Person", "name": "Ann"}, {"@type": "Book"}]}</script><script type="application/ld+json">{"@type": "Movie", "name": "M"}</script></head></html>"""
    df = spark.createDataFrame([(1, "https://h/p", html), (2, "https://h/q", "<title>Only</title>"), (3, "https://h/r", None)], "id int, url string, html string")
    got = {r.id: r for r in A.open_graph(df).collect()}
    assert (got[1].title, got[1].description, got[1].image, got[1].audio) == ("A title", "Said", "https://i/x.png", "https://a/b.mp3")
    assert (got[2].title, got[2].description, got[2].og_url) == ("Only", None, "https://h/q") and got[3].title is None
    node = F.explode(P.json_ld_nodes(F.col("html")))
    items = {(r.id, r.t, r.n) for r in df.select("id", node.alias("x")).select("id", F.concat_ws("+", P.node_types(F.col("x"))).alias("t"), F.get_json_object("x", "$.name").alias("n")).collect()}
    assert items == {(1, "Person", "Ann"), (1, "Book", None), (1, "Movie", "M")}


def test_sniffing(spark):
    heads = {b"\x89PNG\r\n": "image", b"%PDF-1.7": "generic_file", b"  <!DOCTYPE html><p>": "webpage", b'[1, {"a": 2}]': "json_document", b"plain": "generic_file", b"": "unknown_remote", b"ID3\x03": "audio"}
    df = spark.createDataFrame([(bytearray(k),) for k in heads], "head binary")
    assert {bytes(r.head): r.kind for r in df.select("head", P.sniff(F.col("head")).alias("kind")).collect()} == heads


def test_stream_restarts_where_it_ended(spark, sf_dir):
    from termloom.streaming import jobs as S

    folder = f"{S.shared_folder(spark)}/restart-test"
    stream = S.event_stream(spark, sf_dir).select("account", F.lit(1).cast("long").alias("n"))
    fold = S.merge_sums(f"{folder}/sums", ["account"], ["n"])
    S.run_to_end(stream, fold, "append", folder)
    first = S.merged(spark, f"{folder}/sums", ["account"], ["n"]).agg(F.sum("n")).first()[0]
    S.run_to_end(S.event_stream(spark, sf_dir).select("account", F.lit(1).cast("long").alias("n")), fold, "append", folder)
    assert S.merged(spark, f"{folder}/sums", ["account"], ["n"]).agg(F.sum("n")).first()[0] == first == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_plans_push_down(spark, sf_dir):
    """Filters and columns reach the scan, and the wide rollup shuffles once."""
    from termloom.plans import behavior, market
    from termloom.sources import ledger

    explain = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    day = explain(behavior.n1(spark, sf_dir))
    assert "GreaterThanOrEqual(ts" in day and "LessThan(ts" in day
    seen = explain(ledger.event_store(spark, sf_dir).where("event_type <> 'click'").groupBy("account").agg(F.min("ts"), F.max("ts")))
    assert "ReadSchema" in seen and "props" not in seen and seen.count("Exchange hashpartitioning") <= 1
    board = explain(market.m6(spark, sf_dir))
    assert "LessThan(ts" in board


def test_positions_and_tiles_equal_windows(spark):
    from pyspark.sql import Window as W

    from termloom.operators.ranking import tile_of, with_position

    for n in (0, 3, 7, 203):
        df = spark.range(n).select("id", (F.col("id") * 7919 % 13).alias("v"))
        got = with_position(df, ["v", "id"], partitions=5).withColumn("tile", tile_of(F.col("position"), F.lit(n), 5))
        w = W.orderBy("v", "id")
        want = df.select("id", F.row_number().over(w).alias("position"), F.ntile(5).over(w).alias("tile"))
        assert {tuple(r) for r in got.select("id", "position", "tile").collect()} == {tuple(r) for r in want.collect()}


def test_versions_flip_whole(spark, tmp_path):
    from termloom.sources import sinks

    root = f"file://{tmp_path}/board"
    assert [sinks.write_version(spark.range(n), root) for n in (3, 4, 5)] == [1, 2, 3]
    assert sinks.read_current(spark, root).count() == 5 and sinks.numbered(spark, root) == [2, 3]
    (tmp_path / "board" / "version=9").mkdir()  # a job that never committed
    assert sinks.read_current(spark, root).count() == 5


def test_quarantine_loses_nothing(spark):
    from termloom.sources import sinks

    df = spark.createDataFrame([(1, "5"), (2, "x"), (3, None)], "id int, v string")
    good, bad = sinks.quarantine(df, F.expr("try_cast(v AS INT) IS NOT NULL AND length(v) > 0"))
    assert {r.id for r in good.collect()} == {1} and {r.id for r in bad.collect()} == {2, 3}
    sinks.discard(df)


def test_event_stream_reads_a_folder_of_part_files(spark, sf_dir, tmp_path):
    from termloom.streaming import jobs as S

    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    read = lambda d: {tuple(r) for r in spark.read.parquet(S.run_to_end(S.event_stream(spark, d, 2).select("seq", "account", "amount"))).collect()}
    assert read(str(tmp_path)) == read(sf_dir) != set()


def test_sniffing_reads_the_whole_page(spark):
    pages = [" " * 100 + "<html><p>", "\n" * 70 + "<!DOCTYPE html>", "[not json", "{a page of braces}", '{"a": "' + "x" * 200 + '"}', "[" + "1, " * 99 + "1]", " " * 90 + "plain"]
    got = {r.k: r.kind for r in spark.createDataFrame(list(enumerate(pages)), "k long, html string").select("k", P.sniff(F.col("html").cast("binary")).alias("kind")).collect()}
    assert [got[i] for i in range(len(pages))] == ["webpage", "webpage", "generic_file", "generic_file", "json_document", "json_document", "generic_file"]
