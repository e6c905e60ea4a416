"""Queries of atom parsing, classification, page metadata, identity and decisions.

Inputs are made from the pages: page_id picks one of the shapes below and fills it in
("#n#" becomes the id). What each shape must give stands next to it, written by hand, so
the oracles share no table with the operators.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.keccak import checksum_of
from termloom.operators import atoms as A
from termloom.operators import decisions as D
from termloom.operators import pages as P
from termloom.operators import resolution as R
from termloom.operators import sites as S
from termloom.plans.base import query, table

_CID = "QmYwAPJzv5CZsnA625s3Xf2nemtYgPpHdWEz79ojWKPbdG"
_HEX = "5aAeb6053F3E94C9b9A09f33669435E7Ef1BeAed"
#: Input, its kind and canonical form as an atom, its class with confidence, and the canonical form of the class.
SHAPES = (
    (f"ipfs://{_CID}", "ipfs", f"ipfs://{_CID}", None, None, None),
    (f" /ipfs/{_CID}//metadata/#n#.json/ ", "ipfs", f"ipfs://{_CID}/metadata/#n#.json", "plain-text:word", 0.64, None),
    (f"0x{_HEX}", "ethereum_address", f"0x{_HEX.lower()}", "ethereum:account", 0.99, f"0x{_HEX.lower()}"),
    (f"erc20:eip155:137:0x{_HEX}", "url", f"erc20:eip155:137:0x{_HEX}", "ethereum:erc20", 0.99, f"0x{_HEX.lower()}"),
    (f"contract:0x{_HEX}", "url", f"contract:0x{_HEX}", "ethereum:smart-contract", 0.99, f"0x{_HEX.lower()}"),
    ("Name#n#.ETH", "ens_name", "name#n#.eth", "ethereum:ens-name", 0.94, "name#n#.eth"),
    ('{"url": "https://example.com/#n#"}', "json", '{"url": "https://example.com/#n#"}', None, None, None),
    ("[1, 2, #n#]", "json", "[1, 2, #n#]", None, None, None),
    ("{not json #n#", "plain_string", "{not json #n#", None, None, None),
    ("HTTPS://Example.COM:443", "url", "https://example.com/", "web:website", 0.72, "https://example.com"),
    ("http://example.com:8080/a//b/?q=#n##part", "url", "http://example.com:8080/a//b/?q=#n##part", "web:website", 0.72, "http://example.com:8080/a//b/?q=#n#"),
    ("mailto:someone#n#@example.com", "url", "mailto:someone#n#@example.com", "plain-text:word", 0.64, None),
    ("FTP://files.example.org/#n#", "url", "ftp://files.example.org/#n#", None, None, None),
    ("example#n#.org/path).", "plain_string", "example#n#.org/path).", "web:website", 0.72, "https://example#n#.org/path"),
    ("read me.md", "plain_string", "read me.md", "plain-text:phrase", 0.61, None),
    ("notes#n#.json", "plain_string", "notes#n#.json", "plain-text:word", 0.64, None),
    ("  hello   world #n# ", "plain_string", "hello   world #n#", "plain-text:phrase", 0.61, None),
    ("word#n#", "plain_string", "word#n#", "plain-text:word", 0.64, None),
    ("978-0-306-40615-7", "isbn", "9780306406157", "isbn:isbn-13", 0.98, "https://www.worldcat.org/isbn/9780306406157"),
    ("0-306-40615-2", "isbn", "0306406152", "isbn:isbn-10", 0.97, "https://www.worldcat.org/isbn/0306406152"),
    ("0-306-40615-3", "plain_string", "0-306-40615-3", "isbn:isbn-10", 0.97, "https://www.worldcat.org/isbn/0306406153"),
    ("https://github.com/owner#n#", "url", "https://github.com/owner#n#", "github:profile", 0.92, "https://github.com/owner#n#"),
    ("https://github.com/owner/repo#n#/tree/main/src", "url", "https://github.com/owner/repo#n#/tree/main/src", "github:repo", 0.97, "https://github.com/owner/repo#n#"),
    ("https://github.com/owner/repo/issues/#n#", "url", "https://github.com/owner/repo/issues/#n#", "github:issue", 0.98, "https://github.com/owner/repo/issues/#n#"),
    ("https://github.com/owner/repo/pull/#n#/files", "url", "https://github.com/owner/repo/pull/#n#/files", "github:pull", 0.98, "https://github.com/owner/repo/pull/#n#"),
    ("https://github.com/owner/repo/commit/abc#n#", "url", "https://github.com/owner/repo/commit/abc#n#", "github:commit", 0.98, "https://github.com/owner/repo/commit/abc#n#"),
    ("https://github.com/Settings/repo", "url", "https://github.com/Settings/repo", "web:website", 0.72, "https://github.com/Settings/repo"),
    ("https://www.github.com/owner", "url", "https://www.github.com/owner", "web:website", 0.72, "https://www.github.com/owner"),
    ("https://www.npmjs.com/package/@scope/name#n#", "url", "https://www.npmjs.com/package/@scope/name#n#", "npm:package", 0.99, "https://www.npmjs.com/package/@scope/name#n#"),
    ("https://youtu.be/dQw4w9WgXcQ?t=#n#", "url", "https://youtu.be/dQw4w9WgXcQ?t=#n#", "youtube:video", 0.99, "https://www.youtube.com/watch?v=dQw4w9WgXcQ"),
    ("https://m.youtube.com/watch?t=#n#&v=dQw4w9WgXcQ", "url", "https://m.youtube.com/watch?t=#n#&v=dQw4w9WgXcQ", "youtube:video", 0.99, "https://www.youtube.com/watch?v=dQw4w9WgXcQ"),
    ("https://www.youtube.com/shorts/dQw4w9WgXcQ", "url", "https://www.youtube.com/shorts/dQw4w9WgXcQ", "youtube:video", 0.99, "https://www.youtube.com/watch?v=dQw4w9WgXcQ"),
    ("https://www.youtube.com/@channel#n#", "url", "https://www.youtube.com/@channel#n#", "web:website", 0.72, "https://www.youtube.com/@channel#n#"),
    ("https://open.spotify.com/track/T#n#", "url", "https://open.spotify.com/track/T#n#", "spotify:track", 0.99, "https://open.spotify.com/track/T#n#"),
    ("https://open.spotify.com/show/S#n#?si=1", "url", "https://open.spotify.com/show/S#n#?si=1", "spotify:show", 0.99, "https://open.spotify.com/show/S#n#"),
    ("https://open.spotify.com/episode/E#n#", "url", "https://open.spotify.com/episode/E#n#", "spotify:episode", 0.99, "https://open.spotify.com/episode/E#n#"),
    ("https://open.spotify.com/playlist/P#n#", "url", "https://open.spotify.com/playlist/P#n#", "web:website", 0.72, "https://open.spotify.com/playlist/P#n#"),
    ("https://twitter.com/@User#n#/status/99", "url", "https://twitter.com/@User#n#/status/99", "x:post", 0.98, "https://x.com/User#n#/status/99"),
    ("https://mobile.x.com/User#n#", "url", "https://mobile.x.com/User#n#", "x:profile", 0.92, "https://x.com/User#n#"),
    ("https://x.com/Explore/tabs", "url", "https://x.com/Explore/tabs", "web:website", 0.72, "https://x.com/Explore/tabs"),
    ("https://www.instagram.com/p/C#n#/", "url", "https://www.instagram.com/p/C#n#/", "instagram:post", 0.97, "https://www.instagram.com/p/C#n#"),
    ("https://www.instagram.com/reel/R#n#", "url", "https://www.instagram.com/reel/R#n#", "instagram:video", 0.97, "https://www.instagram.com/reel/R#n#"),
    ("https://www.instagram.com/user#n#/", "url", "https://www.instagram.com/user#n#/", "instagram:profile", 0.9, "https://www.instagram.com/user#n#"),
    ("https://www.tiktok.com/@user/video/#n#", "url", "https://www.tiktok.com/@user/video/#n#", "tiktok:video", 0.98, "https://www.tiktok.com/@user/video/#n#"),
    ("https://www.tiktok.com/@user#n#", "url", "https://www.tiktok.com/@user#n#", "tiktok:profile", 0.91, "https://www.tiktok.com/@user#n#"),
    ("https://en.wikipedia.org/wiki/Page_#n#", "url", "https://en.wikipedia.org/wiki/Page_#n#", "wikipedia:article", 0.95, "https://en.wikipedia.org/wiki/Page_#n#"),
    ("https://www.imdb.com/title/tt00#n#/", "url", "https://www.imdb.com/title/tt00#n#/", "imdb:title", 0.98, "https://www.imdb.com/title/tt00#n#/"),
    ("https://www.imdb.com/name/nm00#n#", "url", "https://www.imdb.com/name/nm00#n#", "imdb:person", 0.97, "https://www.imdb.com/name/nm00#n#/"),
    ("https://www.themoviedb.org/movie/#n#-a-film", "url", "https://www.themoviedb.org/movie/#n#-a-film", "tmdb:movie", 0.99, "https://www.themoviedb.org/movie/#n#"),
    ("https://www.themoviedb.org/tv/#n#", "url", "https://www.themoviedb.org/tv/#n#", "tmdb:tv", 0.99, "https://www.themoviedb.org/tv/#n#"),
    ("https://www.amazon.co.uk/thing/dp/b00example?ref=#n#", "url", "https://www.amazon.co.uk/thing/dp/b00example?ref=#n#", "amazon:product", 0.96, "https://www.amazon.co.uk/dp/B00EXAMPLE"),
    ("https://www.amazon.com/stores/page/#n#", "url", "https://www.amazon.com/stores/page/#n#", "amazon:store", 0.9, "https://www.amazon.com/stores/page/#n#"),
    ("https://a.co/d/#n#", "url", "https://a.co/d/#n#", "web:website", 0.72, "https://a.co/d/#n#"),
    (f"https://etherscan.io/address/0x{_HEX}", "url", f"https://etherscan.io/address/0x{_HEX}", "web:website", 0.72, f"https://etherscan.io/address/0x{_HEX}"),
)


def sql_of(value: str | float | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def shaped(values: list) -> str:
    """SQL of both engines: the value for a page's shape, with its id filled in."""
    case = f"CASE page_id % {len(values)} " + " ".join(f"WHEN {i} THEN {sql_of(v)}" for i, v in enumerate(values)) + " END"
    return f"replace({case}, '#n#', CAST(page_id AS STRING))" if any(isinstance(v, str) for v in values) else case


_INPUT = shaped([s[0] for s in SHAPES])


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.expr(_INPUT).alias("input"))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return A.parse(_inputs(spark, d), "input")


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return S.classify(_inputs(spark, d), "input")


@query("t1_parse_atoms", f"SELECT page_id, {shaped([s[1] for s in SHAPES])} AS kind, {shaped([s[0].strip() for s in SHAPES])} AS normalized, {shaped([s[2] for s in SHAPES])} AS canonical FROM pages")
def t1(spark, d):
    return _parsed(spark, d).select("page_id", "kind", "normalized", "canonical")


@query("t3_ipfs_gateways", f"SELECT page_id, {shaped([s[2].replace('ipfs://', A.GATEWAY) if s[1] == 'ipfs' else None for s in SHAPES])} AS gateway_url FROM pages")
def t3(spark, d):
    return _parsed(spark, d).select("page_id", "gateway_url")


@query("t4_checksum_addresses", f"SELECT page_id, '0x{_HEX.lower()}' AS canonical, '0x{_HEX}' AS checksum FROM pages WHERE page_id % {len(SHAPES)} = 2")
def t4(spark, d):
    """The shape's address is a published example of the checksum form."""
    return _parsed(spark, d).where("kind = 'ethereum_address'").select("page_id", "canonical", checksum_of(F.col("canonical")).alias("checksum"))


@query("t6_json_shape", f"SELECT page_id, {shaped(['object' if s[0][0] == '{' else 'array' if s[1] == 'json' else None for s in SHAPES])} AS shape, CAST({shaped([1 if s[0][0] == '{' else 3 for s in SHAPES])} AS BIGINT) AS size FROM pages WHERE {shaped([s[1] for s in SHAPES])} = 'json'")
def t6(spark, d):
    s = F.col("normalized")
    is_object = s.startswith("{")
    return _parsed(spark, d).where("kind = 'json'").select("page_id", F.when(is_object, "object").otherwise("array").alias("shape"), F.when(is_object, F.size(F.json_object_keys(s))).otherwise(F.json_array_length(s)).cast("long").alias("size"))


#: Addresses with what a browser's parser says of them: href, scheme, host, path, has a query.
ADDRESSES = (
    ("https://Example.com", "https://example.com/", "https", "example.com", "/", False),
    ("HTTP://user:pw@Example.com:80/a?b=#n#", "http://user:pw@example.com/a?b=#n#", "http", "example.com", "/a", True),
    ("https:example.com/#n#", "https://example.com/#n#", "https", "example.com", "/#n#", False),
    ("https://example.com?", "https://example.com/?", "https", "example.com", "/", False),
    ("mailto:a#n#@b.org?subject=hi", "mailto:a#n#@b.org?subject=hi", "mailto", None, "a#n#@b.org", True),
    ("urn:isbn:#n#", "urn:isbn:#n#", "urn", None, "isbn:#n#", False),
    ("git+ssh://host/path/#n#", "git+ssh://host/path/#n#", "git+ssh", "host", "/path/#n#", False),
    ("wss://example.com:443/s#n#", "wss://example.com/s#n#", "wss", "example.com", "/s#n#", False),
    ("https://", None, None, None, None, None),
    ("no address #n#", None, None, None, None, None),
)


@query("t7_addresses", "SELECT page_id, " + ", ".join(f"{shaped([a[i] for a in ADDRESSES])} AS {c}" for i, c in enumerate(("href", "scheme", "host", "path"), 1)) + f", CASE page_id % {len(ADDRESSES)} " + " ".join(f"WHEN {i} THEN {str(a[5]).lower()}" for i, a in enumerate(ADDRESSES) if a[5] is not None) + " END AS has_query FROM pages")
def t7(spark, d):
    u = S.address(F.expr(shaped([a[0] for a in ADDRESSES])))
    return table(spark, d, "pages").select("page_id", u.alias("u")).select("page_id", *[F.col(f"u.{c}").alias(c) for c in ("href", "scheme", "host", "path", "has_query")])


@query("t8_isbn_counts", f"SELECT CAST(length({shaped([s[2] for s in SHAPES])}) AS BIGINT) AS digits, count(*) AS n FROM pages WHERE {shaped([s[1] for s in SHAPES])} = 'isbn' GROUP BY 1")
def t8(spark, d):
    return _parsed(spark, d).where("kind = 'isbn'").groupBy(F.length("canonical").cast("long").alias("digits")).agg(F.count(F.lit(1)).alias("n"))


#: Documents with their top level, format, type and addresses (field and address).
DOCUMENTS = (
    ('{"@context": "https://schema.org", "@type": ["", "Person"], "name": "N#n#", "url": "https://a.example/#n#", "image": "https://a.example/#n#", "sameAs": ["https://b.example", "x", "mailto:c"]}', "object", "jsonld", "Person", "url https://a.example/#n#,sameAs https://b.example/"),
    ('{"@type": " Book ", "homepage": "HTTP://Books.example", "audio": 5, "sameAs": "https://no.list"}', "object", "json", "Book", "homepage http://books.example/"),
    ("[1, {}]", "array", "json", None, ""),
    ("{broken", None, None, None, ""),
    ("text #n#", None, None, None, ""),
)


@query("t9_structured_documents", "SELECT page_id, " + ", ".join(f"{shaped([x[i] for x in DOCUMENTS])} AS {c}" for i, c in enumerate(("top_level", "format", "schema_type", "addresses"), 1)) + " FROM pages")
def t9(spark, d):
    found = P.structured(table(spark, d, "pages").select("page_id", F.expr(shaped([x[0] for x in DOCUMENTS])).alias("doc")), "doc")
    return found.select("page_id", "top_level", "format", "schema_type", F.concat_ws(",", F.transform("urls", lambda u: F.concat_ws(" ", u["field"], u["url"]))).alias("addresses"))


#: Bodies in hex, their content types and kinds; "" stands for the page itself.
BODIES = (
    ("", None, "webpage"), ("", "application/ld+json; charset=utf-8", "json_document"), ("89504e470d0a1a0a", None, "image"), ("ffd8ffe000", "application/octet-stream", "image"), ("474946383961", None, "image"), ("52494646aa", None, "audio"), ("494433aa", None, "audio"),
    ("0000001866747970" + "69736f6d00", None, "video"), ("7b226b223a20317d", "text/plain", "json_document"), ("7b226b223a20", None, "generic_file"), ("ffff", "video/mp4", "video"), ("ffff", "font/woff2", "generic_file"), ("20", None, "generic_file"), ("ffff", "Text/HTML", "webpage"),
)


@query("t10_sniff", f"SELECT page_id, {shaped([b[2] for b in BODIES])} AS kind FROM pages")
def t10(spark, d):
    pages = table(spark, d, "pages")
    code = F.expr(shaped([b[0] for b in BODIES]))
    body = F.when(code == "", F.col("html").cast("binary")).otherwise(F.unhex(code))
    return pages.select("page_id", P.sniff(body, F.expr(shaped([b[1] for b in BODIES]))).alias("kind"))


@query("t11_resolve", f"""SELECT page_id, {shaped(['WebSite' if s[3] == 'web:website' else None for s in SHAPES])} AS website, {shaped([None if s[3] is None else f'{s[3]}' for s in SHAPES])} AS class FROM pages""")
def t11(spark, d):
    """The type of the entity that follows from an input's class; a class is an entity of a known type."""
    return _classified(spark, d).select("page_id", F.when(F.col("schema_type") == "WebSite", F.col("schema_type")).alias("website"), "class")


#: Plugins of a registry with their priorities and dependencies.
PLUGINS = (("default-url", 30, ("type-profiles",)), ("ethereum", 20, ("type-profiles",)), ("github", 10, ("type-profiles",)), ("plain-text", 60, ("type-profiles", "isbn")), ("isbn", 70, ("type-profiles",)), ("type-profiles", 1, ()), ("x", 10, ("type-profiles",)))


@query("t12_plugin_order", "SELECT CAST(p AS BIGINT) AS place, name AS plugin, o.n AS orders FROM (VALUES (1, 'type-profiles'), (2, 'github'), (3, 'x'), (4, 'ethereum'), (5, 'default-url'), (6, 'isbn'), (7, 'plain-text')) t(p, name), (SELECT count(*) AS n FROM orders) o")
def t12(spark, d):
    order = spark.createDataFrame(list(enumerate(S.plugin_order(list(PLUGINS)), 1)), "place long, plugin string")
    return order.crossJoin(table(spark, d, "orders").agg(F.count(F.lit(1)).alias("orders")))


@query("t13_classify", f"SELECT page_id, {shaped([s[3] for s in SHAPES])} AS class, CAST({shaped([s[4] for s in SHAPES])} AS DOUBLE) AS confidence, {shaped([s[5] for s in SHAPES])} AS canonical FROM pages")
def t13(spark, d):
    found = _classified(spark, d)
    plain = F.col("class").startswith("plain-text:") | F.col("canonical").startswith("ipfs:")
    return found.select("page_id", "class", "confidence", F.when(~plain, F.col("canonical")).alias("canonical"))


#: Inputs that may be a website, and its address.
WEBSITES = (
    ("https://Example.com/", "https://example.com"), ("http://example.com/a/#n#/#top", "http://example.com/a/#n#"), ("example.com", "https://example.com"), ("localhost:3000/x?y=#n#", "https://localhost:3000/x?y=#n#"), ("10.0.0.7:8080", "https://10.0.0.7:8080"),
    ("See-example.org!", "https://see-example.org"), ("me@example.com", None), ("two words.com", None), ("package.json", None), ("ftp://example.com", None), ("example", None),
)


@query("t14_websites", f"SELECT page_id, {shaped([w[1] for w in WEBSITES])} AS website FROM pages")
def t14(spark, d):
    return table(spark, d, "pages").select("page_id", S.website(F.expr(shaped([w[0] for w in WEBSITES]))).alias("website"))


@query("t14_page_sites", r"SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') AS canonical FROM pages")
def t14b(spark, d):
    return table(spark, d, "pages").select("page_id", S.website(F.col("url")).alias("canonical"))


@query("t16_type_profiles", """SELECT t AS schema_type, c AS profile_category, r AS recommended, i AS identity, n.n FROM (VALUES ('Book', 'thing', 'isbn,sameAs', 'isbn'), ('Product', 'product', 'brand,offers,sameAs', 'gtin,sku'), ('PodcastEpisode', 'podcast', 'description,partOfSeries,datePublished,url,sameAs', 'url,sameAs'),
 ('Unheard', 'thing', 'description,sameAs', 'identifier,sameAs'), ('Organization', 'company', 'url,sameAs', 'identifier,sameAs')) v(t, c, r, i), (SELECT count(*) AS n FROM pages) n""")
def t16(spark, d):
    kinds = spark.createDataFrame([(t,) for t in ("Book", "Product", "PodcastEpisode", "Unheard", "Organization")], "schema_type string").crossJoin(table(spark, d, "pages").agg(F.count(F.lit(1)).alias("n")))
    return S.with_profile(kinds).select("schema_type", "profile_category", F.concat_ws(",", "recommended").alias("recommended"), F.concat_ws(",", "identity").alias("identity"), "n")


#: Atoms of hosts, from pages: one resolver knows their titles, another their addresses only; pages of a host with the same title and language are the same atom to the first.
_ATOMS = r"""p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '/(en|fr|de|es)/', 1) AS lang, url, trim(regexp_extract(html, '(?is)<title[^>]*>([^<]*)', 1)) AS title, length(html) AS size FROM pages),
a AS (SELECT host, 0 AS resolver_order, 'titles' AS resolver, (size % 100) / 100.0 AS confidence, CAST(NULL AS VARCHAR) AS canonical, [lang, host] AS same_as, 'WebPage' AS schema_type, title, url FROM p WHERE title <> ''
  UNION ALL SELECT host, 1, 'addresses', (size % 7) / 7.0, url, [], 'WebPage', '', url FROM p),
o AS (SELECT *, lower(coalesce(canonical, '')) || '::' || array_to_string(list_sort(list_transform(same_as, lambda x: lower(x))), '|') || '::webpage::' || lower(title) AS signature FROM a),
f AS (SELECT *, row_number() OVER (PARTITION BY host, signature ORDER BY resolver_order, confidence DESC, lower(coalesce(canonical, '')), title, url) AS k FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY resolver_order, confidence DESC, lower(coalesce(canonical, '')), title, signature) AS place FROM f WHERE k = 1)"""


def _atoms(spark: SparkSession, d: str) -> DataFrame:
    url, size, none = F.col("url"), F.length("html"), F.array().cast("array<string>")
    host, lang = F.regexp_extract(url, "^[a-z]+://([^/]+)", 1), F.regexp_extract(url, "/(en|fr|de|es)/", 1)
    title = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>([^<]*)", 1))
    atom = lambda order, name, sure, canonical, same, text: F.struct(F.lit(order).alias("resolver_order"), F.lit(name).alias("resolver"), sure.alias("confidence"), canonical.alias("canonical"), same.alias("same_as"), F.lit("WebPage").alias("schema_type"), text.alias("title"), url.alias("url"))
    both = F.array(atom(0, "titles", (size % 100) / 100.0, F.lit(None).cast("string"), F.array(lang, host), title), atom(1, "addresses", (size % 7) / 7.0, url, none, F.lit("")))
    return table(spark, d, "pages").select(host.alias("host"), F.explode(both).alias("atom")).select("host", "atom.*").where("resolver = 'addresses' OR title <> ''")


@query("t17_rank_and_dedupe", f"{_ATOMS} SELECT host, place, resolver, title, canonical, round(confidence, 6) AS confidence FROM r")
def t17(spark, d):
    """The atoms of each host, those that are the same once, in order of resolver, confidence and canonical id."""
    return R.ranked_atoms(_atoms(spark, d), ["host"]).select("host", "place", "resolver", "title", "canonical", F.round("confidence", 6).alias("confidence"))


@query("t11_merged_fields", f"""{_ATOMS}, v AS (SELECT host, place, resolver, unnest([{{'field': 'title', 'value': nullif(title, '')}}, {{'field': 'canonical', 'value': nullif(canonical, '')}}]) AS x FROM r)
SELECT host, x.field AS field, arg_min(x.value, place) AS value, arg_min(resolver, place) AS source FROM v WHERE x.value IS NOT NULL GROUP BY host, x.field""")
def t11_merged(spark, d):
    """One entity a host: each field from the first atom that has it, with the resolver that it comes from."""
    ranked = R.ranked_atoms(_atoms(spark, d), ["host"])
    return R.merged_fields(ranked, ["host"], {"title": F.col("title"), "canonical": F.col("canonical")}, "resolver")


@query("t11_candidates", r"""c AS (SELECT page_id, 'web:secure' AS class, 0.8 AS confidence, 1 AS priority, 0 AS registered FROM pages WHERE starts_with(url, 'https://')
  UNION ALL SELECT page_id, 'web:blog', 0.8, 0, 1 FROM pages WHERE url LIKE '%://blog.%' UNION ALL SELECT page_id, 'web:mobile', 0.9, 5, 2 FROM pages WHERE url LIKE '%://m.%' UNION ALL SELECT page_id, 'web:page', 0.5, 9, 3 FROM pages)
SELECT page_id, string_agg(class, ',' ORDER BY confidence DESC, priority, registered) AS classes, first(class ORDER BY confidence DESC, priority, registered) AS winner FROM c GROUP BY page_id""")
def t11_candidates(spark, d):
    """Every class that a page's address suggests, the winner first: by confidence, then priority, then registration."""
    u = F.col("url")
    rules = ((u.startswith("https://"), "web:secure", 0.8, 1), (u.contains("://blog."), "web:blog", 0.8, 0), (u.contains("://m."), "web:mobile", 0.9, 5), (F.lit(True), "web:page", 0.5, 9))
    made = F.array(*[F.when(fits, F.struct(F.lit(name).alias("class"), F.lit(sure).alias("confidence"), F.lit(priority).alias("priority"), F.lit(k).alias("registered"))) for k, (fits, name, sure, priority) in enumerate(rules)])
    found = R.best_first(table(spark, d, "pages").select("page_id", F.explode(F.array_compact(made)).alias("c")).select("page_id", "c.*"), ["page_id"])
    return found.select("page_id", F.array_join(F.transform("classes", lambda c: c["class"]), ",").alias("classes"), F.col("classes")[0]["class"].alias("winner"))


@query("t18_slugs", r"SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def t18(spark, d):
    return table(spark, d, "pages").select("page_id", S.slugify(F.col("url")).alias("slug"))


@query("t18_fnv1a", "SELECT page_id, lower(lpad(to_hex(list_reduce(list_prepend(2166136261, list_transform(range(1, length(url) + 1), lambda i: CAST(unicode(substr(url, i, 1)) AS BIGINT))), lambda h, c: (xor(h, c) * 16777619) % 4294967296)), 8, '0')) AS hash FROM pages")
def t18b(spark, d):
    """The hash of every address (ASCII, so characters are bytes)."""
    return table(spark, d, "pages").select("page_id", A.fnv1a32(F.col("url")).alias("hash"))


@query("t18_stable_json", """SELECT page_id, '{"a":"1","b":"' || page_id || '"}' AS stable, CASE page_id % 3 WHEN 0 THEN 0.0 WHEN 1 THEN 0.25 ELSE 1.0 END AS clamped FROM pages""")
def t18c(spark, d):
    pages = table(spark, d, "pages")
    text = F.concat(F.lit('{"b": '), F.col("page_id").cast("string"), F.lit(', "a": 1, "c": null}'))
    return pages.select("page_id", A.stable_json(text).alias("stable"), A.clamp(F.expr("CASE page_id % 3 WHEN 0 THEN -2.0 WHEN 1 THEN 0.25 ELSE 7.5 END")).alias("clamped"))


#: Heads put before a page, and its title, description, image, site name and audio.
HEADS = (
    ('<meta property="og:title" content="Title #n#"><meta name="og:description" content="Text"><meta content="https://i.example/#n#.png" property="og:image"><meta property="og:audio:url" content="a.mp3"><meta property="og:audio:secure_url" content="s.mp3">', "Title #n#", "Text", "https://i.example/#n#.png", None, "s.mp3"),
    ("<title> A &amp; B </title><META PROPERTY='og:site_name' CONTENT='Site'><meta name=\"twitter:player:stream\" content=\"p.mp3\">", "A & B", None, None, "Site", "p.mp3"),
    ('<meta property="og:title" content=""><title>Plain #n#</title><meta name="description" content="not this">', "Plain #n#", None, None, None, None),
)


@query("t21_open_graph", "SELECT page_id, " + ", ".join(f"{shaped([h[i] for h in HEADS])} AS {c}" for i, c in enumerate(("title", "description", "image", "site_name", "audio"), 1)) + ", url AS og_url FROM pages")
def t21(spark, d):
    headed = table(spark, d, "pages").select("page_id", "url", F.concat(F.expr(shaped([h[0] for h in HEADS])), "html").alias("html"))
    return A.open_graph(headed).select("page_id", "title", "description", "image", "site_name", "audio", "og_url")


@query("t21_page_tags", r"""SELECT page_id, nullif(trim(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&')), '') AS title, url AS og_url,
 nullif(list_extract(regexp_extract_all(html, '(?i)<meta\s+[^>]*(?:property|name)\s*=\s*["'']og:description["''][^>]*content\s*=\s*["'']([^"'']*)["'']', 1), -1), '') AS description FROM pages""")
def t21b(spark, d):
    return A.open_graph(table(spark, d, "pages")).select("page_id", "title", "og_url", "description")


_LD = '<script type="application/ld+json">{}</script>'
#: Linked data put into a page, its items (types and names in order), its main type and its image.
LINKED = (
    (_LD.format('{"@type": "Book", "name": "B#n#", "image": "https://i.example/b"}'), "Book:B#n#", "Book", "https://i.example/b"),
    (_LD.format('/* <![CDATA[ */ {"@type": "Movie", "name": "Tom &amp; Jerry #n#"} /* ]]> */'), "Movie:Tom & Jerry #n#", "Movie", None),
    (_LD.format('{"@context": "x", "@graph": [{"@type": "Person", "name": "P", "image": {"url": " https://i.example/p "}}, 5, {"@graph": [{"@type": "Event", "name": "E#n#"}]}]}'), "Person:P,Event:E#n#", "Event", "https://i.example/p"),
    (_LD.format('[{"@type": ["Thing", "Product"], "name": "L"}, {"name": "untyped", "image": ["no", {"url": "https://i.example/l"}]}]') + _LD.format("{broken"), "Thing+Product:L,:untyped", "Product", "https://i.example/l"),
    ("<script type='text/javascript'>{}</script>", "", None, None),
)


def _linked(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.expr(shaped([x[0] for x in LINKED])), "html")
    return table(spark, d, "pages").select("page_id", "url", P.json_ld_nodes(html, F.lit("https://shop.example/")).alias("nodes"))


@query("t22_json_ld", "SELECT page_id, " + ", ".join(f"{shaped([x[i] for x in LINKED])} AS {c}" for i, c in enumerate(("items", "main_type", "image"), 1)) + " FROM pages")
def t22(spark, d):
    item = lambda n: F.concat(F.concat_ws("+", P.node_types(n)), F.lit(":"), F.coalesce(F.get_json_object(n, "$.name"), F.lit("")))
    return _linked(spark, d).select("page_id", F.concat_ws(",", F.transform("nodes", item)).alias("items"), P.primary_type(F.col("nodes")).alias("main_type"), P.primary_image(F.col("nodes")).alias("image"))


@query("t22_any_depth", "SELECT page_id, array_to_string(list_transform(range(0, length(html) % 12 + 1), lambda i: 'L' || i), ',') || ',Leaf:' || url || ',After' AS items FROM pages")
def t22_deep(spark, d):
    """Two blocks a page; the first nests as deep as the page's length says, each level with a type of its own, and ends in a node named by the address."""
    pages = table(spark, d, "pages").withColumn("depth", F.length("html") % 12)
    leaf = F.concat(F.lit('{"@type": "Leaf", "name": '), F.to_json(F.array("url")).substr(F.lit(2), F.length(F.to_json(F.array("url"))) - 2), F.lit("}"))
    nested = F.aggregate(F.sequence(F.lit(0), F.col("depth")), leaf, lambda inner, i: F.concat(F.lit('{"@type": "L'), (F.col("depth") - i).cast("string"), F.lit('", "@graph": ['), inner, F.lit("]}")))
    block = lambda x: F.concat(F.lit('<script id="a > b" type="application/ld+json">'), x, F.lit("</script>"))
    nodes = P.json_ld_nodes(F.concat("html", block(nested), block(F.lit('{"@type": "After"}'))), F.lit("https://shop.example/"))
    item = lambda n: F.concat_ws(":", F.concat_ws("+", P.node_types(n)), F.get_json_object(n, "$.name"))
    return pages.select("page_id", F.array_join(F.transform(nodes, item), ",").alias("items"))


@query("t22_skipped_hosts", "SELECT page_id, CASE page_id % 4 WHEN 3 THEN 1 ELSE 0 END AS n FROM pages")
def t22b(spark, d):
    url = F.expr(shaped(["https://open.spotify.com/track/#n#", "https://www.google.com/maps/place/#n#", "no address", "https://google.example/maps"]))
    return table(spark, d, "pages").select("page_id", F.size(P.json_ld_nodes(F.lit(LINKED[0][0]), url)).alias("n"))


@query("t23_favicon", r"SELECT page_id, 'https://www.google.com/s2/favicons?domain=' || regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '^www\.', '') || '&sz=128' AS favicon FROM pages")
def t23(spark, d):
    return table(spark, d, "pages").select("page_id", P.favicon(F.col("url")).alias("favicon"))


_WANTED = (("name", "string", True), ("url", "url", True), ("datePublished", "date", False), ("price", "number", True))


def _tiers(spark: SparkSession, d: str) -> DataFrame:
    """Candidate values of pages: from their linked data, their tags and their address, some of them unusable."""
    pages = table(spark, d, "pages")
    c = lambda field, value, source, tier, place: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(source).alias("source"), F.lit(P.CONFIDENCE[source]).alias("confidence"), F.lit(tier).alias("tier"), F.lit(place).alias("place"))
    n = F.col("page_id")
    rows = F.array(
        c("name", F.when(n % 2 == 0, F.concat(F.lit(" N"), n)).otherwise(" "), "page", 1, 1), c("name", F.concat(F.lit("T"), n), "tags", 2, 1), c("url", F.lit("not an address"), "page", 1, 1), c("url", F.col("url"), "input", 2, 1),
        c("datePublished", F.lit("2024-02-30"), "page", 1, 1), c("datePublished", F.lit("2024-02-29T10:00"), "page", 1, 2), c("price", F.when(n % 3 == 0, "9.50").otherwise("free"), "page", 1, 1), c("colour", F.lit("red"), "page", 1, 1),
    )
    return pages.select("page_id", F.explode(rows).alias("x")).select("page_id", "x.*")


@query("t26_fields", """SELECT page_id, 'name' AS field, CASE WHEN page_id % 2 = 0 THEN 'N' ELSE 'T' END || page_id AS value, CASE WHEN page_id % 2 = 0 THEN 'page' ELSE 'tags' END AS source, CAST(CASE WHEN page_id % 2 = 0 THEN 0.9 ELSE 0.7 END AS DOUBLE) AS confidence FROM pages
UNION ALL SELECT page_id, 'url', url, 'input', 1.0 FROM pages UNION ALL SELECT page_id, 'datePublished', '2024-02-29T10:00', 'page', 0.9 FROM pages UNION ALL SELECT page_id, 'price', '9.50', 'page', 0.9 FROM pages WHERE page_id % 3 = 0""")
def t26(spark, d):
    return P.fields(_tiers(spark, d), ["page_id"], spark.createDataFrame(list(_WANTED), "field string, kind string, required boolean"))


@query("t26_missing_fields", "SELECT page_id, 'price' AS field FROM pages WHERE page_id % 3 <> 0")
def t26b(spark, d):
    wanted = spark.createDataFrame(list(_WANTED), "field string, kind string, required boolean")
    return P.missing_fields(table(spark, d, "pages"), P.fields(_tiers(spark, d), ["page_id"], wanted), ["page_id"], wanted)


@query("t27_page_native", "SELECT page_id, " + shaped([None if not x[1] else x[1].split(",")[0].split(":")[1] for x in LINKED]) + " AS name FROM pages")
def t27(spark, d):
    """The name that a page's own data gives for its entity."""
    return _linked(spark, d).select("page_id", F.get_json_object(F.get("nodes", F.lit(0)), "$.name").alias("name"))


_READERS = {"wikipedia": (("$.wikibaseItem", "wikidata", "entityId"),), "wikidata": (("$.tmdb", "tmdb", "tmdbId"), ("$.youtube", "youtube", "channelId"), ("$.spotify", "spotify", "artistId"))}


@query("t28_identifiers", "SELECT page_id, 'wikidata' AS plugin, 'entityId' AS name, 'Q' || page_id AS value FROM pages WHERE page_id % 2 = 0 UNION ALL SELECT page_id, 'tmdb', 'tmdbId', CAST(page_id + 1 AS VARCHAR) FROM pages WHERE page_id % 2 = 1 UNION ALL SELECT page_id, 'youtube', 'channelId', 'UC' || page_id FROM pages WHERE page_id % 2 = 1 AND page_id % 3 <> 0")
def t28(spark, d):
    n = F.col("page_id").cast("string")
    even = F.col("page_id") % 2 == 0
    main = F.struct(F.when(even, "wikipedia").otherwise("wikidata").alias("kind"), F.when(even, F.concat(F.lit('{"wikibaseItem": "Q'), n, F.lit('"}'))).otherwise(F.concat(F.lit('{"tmdb": '), (F.col("page_id") + 1).cast("string"), F.lit(', "spotify": " ", "youtube": "UC'), n, F.lit('"}'))).alias("data"))
    video = F.when(F.col("page_id") % 3 == 0, F.struct(F.lit("youtube").alias("kind"), F.lit("{}").alias("data")))
    artifacts = table(spark, d, "pages").select("page_id", F.explode(F.array_compact(F.array(main, video))).alias("a")).select("page_id", "a.*")
    return P.identifiers(artifacts, _READERS, "page_id")


#: Addresses, instance-of claims (by commas) and the classes that they suggest together with the linked data above.
SUGGESTED = (
    ("https://open.spotify.com/track/#n#", "", ("music-recording",)), ("https://github.com/o/r#n#", "q7397", ("software", "software-application")), ("https://www.google.com/maps/place/#n#", "Q515", ("local-business", "location")), ("https://x.com/user#n#", "", ("social-media-account", "person")),
    ("https://www.amazon.de/x/dp/B00EXAMPLE", "Q1,Q571", ("product", "book")), ("https://nowhere.example/#n#", "", ()), ("no address", "Q5", ("person",)),
)


@query("t29_suggestions", "SELECT page_id, " + shaped([",".join(s[2]) for s in SUGGESTED]) + " AS classes, " + shaped([{"Book": "book", "Movie": "movie", "Event": "event", "Product": "product", None: ""}[x[2]] for x in LINKED]) + " AS by_page FROM pages")
def t29(spark, d):
    none = F.array().cast("array<string>")
    ids = F.filter(F.split(F.expr(shaped([s[1] for s in SUGGESTED])), ","), lambda x: x != "")
    return _linked(spark, d).select("page_id", F.concat_ws(",", P.suggest(F.expr(shaped([s[0] for s in SUGGESTED])), ids, none)).alias("classes"), F.concat_ws(",", P.suggest(F.lit(None).cast("string"), none, F.col("nodes"))).alias("by_page"))


_CLAIM = lambda value, rank="normal": {"rank": rank, "mainsnak": {"datavalue": {"value": value}}}
#: Claims of an entity: ids, texts, an amount, a place and a day, of different ranks.
CLAIMS = json.dumps({
    "P31": [_CLAIM({"id": "Q1"}, "deprecated"), _CLAIM({"id": "Q5"}), _CLAIM({"id": "Q#n#"}, "preferred"), _CLAIM({"id": "Q7"}, "preferred")], "P856": [_CLAIM("https://a.example/#n# "), _CLAIM(" "), {"rank": "normal"}, _CLAIM("https://b.example")],
    "P1082": [_CLAIM({"amount": "many"}), _CLAIM({"amount": "+#n#.5"})], "P625": [_CLAIM({"latitude": 1.5}), _CLAIM({"latitude": 52.25, "longitude": -1.5})],
    "P577": [_CLAIM({"time": "+1999-00-00T00:00:00Z", "precision": 9}), _CLAIM({"time": "+2001-02-03T00:00:00Z", "precision": 11})],
})


@query("t30_claims", "SELECT page_id, 'Q' || page_id || ',Q7' AS instance_of, 'https://a.example/' || page_id || ',https://b.example' AS sites, CAST(page_id + 0.5 AS DOUBLE) AS population, CAST(52.25 AS DOUBLE) AS latitude, CAST(-1.5 AS DOUBLE) AS longitude, '2001-02-03' AS published FROM pages")
def t30(spark, d):
    c = F.expr(shaped([CLAIMS]))
    rows = table(spark, d, "pages").select("page_id", c.alias("claims"))
    c, place = F.col("claims"), P.claim_coordinate(F.col("claims"), "P625")
    return rows.select("page_id", F.concat_ws(",", P.claim_ids(c, "P31")).alias("instance_of"), F.concat_ws(",", P.claim_strings(c, "P856")).alias("sites"), P.claim_quantity(c, "P1082").alias("population"), place["latitude"].alias("latitude"), place["longitude"].alias("longitude"), P.claim_day(c, "P577").alias("published"))


#: Input, category, type, canonical id and sameAs of a class, whether addresses may be looked up, and which one.
HANDOFFS = (
    ("plain words #n#", "thing", "Thing", None, (), False, None), ("plain words #n#", "person", "Person", "https://a.example/#n#", ("https://b.example",), True, "https://a.example/#n#"), ("words", "thing", "Book", "isbn:#n#", ("isbn:1", "https://b.example/#n#"), True, "https://b.example/#n#"),
    ("https://a.example/Page#n#", "thing", "WebSite", None, ("https://b.example", "https://a.example/other"), True, "https://a.example/other"), ("https://a.example/Page#n#", "thing", "WebSite", None, ("https://a.example/page#n#",), True, "https://a.example/Page#n#"), ("https://a.example/#n#", "thing", "Thing", None, (), True, "https://a.example/#n#"),
)


@query("t31_handoff", f"SELECT page_id, {shaped(['url' if h[0].startswith('https') else 'plain-text' for h in HANDOFFS])} AS input_kind, CASE page_id % {len(HANDOFFS)} WHEN 0 THEN false ELSE true END AS allow_url_providers, {shaped([h[6] for h in HANDOFFS])} AS preferred_url FROM pages")
def t31(spark, d):
    of = lambda i: F.expr(shaped([h[i] for h in HANDOFFS]))
    same = F.filter(F.split(F.expr(shaped([" ".join(h[4]) for h in HANDOFFS])), " "), lambda x: x != "")
    rows = table(spark, d, "pages").select("page_id", of(0).alias("raw_input"), of(1).alias("category"), of(2).alias("schema_type"), of(3).alias("canonical_id"), same.alias("same_as"))
    return D.handoff(rows).select("page_id", "input_kind", "allow_url_providers", "preferred_url")


#: Address, type, category and canonical id of an identity, artifacts ("slug type" by commas), the rule that decides, and the artifact shown first.
CASES = (
    ("https://x.com/user#n#", "SocialMediaAccount", "person", "x:user:u", "", "x-profile", None), ("https://x.com/u/status/#n#", "SocialMediaPosting", None, None, "twitter-profile ", "x-post", None), ("https://a.example", "Thing", None, None, "twitter-profile ,x-profile ", "x-profile", "x-profile"),
    ("https://music.apple.com/song/#n#", None, None, None, "", "apple-music-song", None), ("https://a.example", None, None, None, "apple-music album", "generic", None), ("https://open.spotify.com/track/#n#", "MusicRecording", "song", None, "", "spotify-track", None),
    (None, "MusicRecording", "song", "spotify:track:#n#", "", "spotify-track", None), ("https://a.example", None, None, None, "spotify artist", "spotify-artist", "spotify"), ("https://a.example", None, None, None, "spotify album", "spotify-album", "spotify"), ("https://a.example", None, None, None, "spotify playlist", "spotify-playlist", "spotify"),
    ("https://open.spotify.com/show/#n#", "PodcastSeries", "podcast", None, "", "spotify-podcast-show", None), ("https://open.spotify.com/episode/#n#", "PodcastEpisode", "podcast", None, "", "spotify-podcast-episode", None), ("https://github.com/a/b", "SoftwareSourceCode", "software", None, "github-repo ", "github-repo", "github-repo"),
    ("https://github.com/a/b", "SoftwareSourceCode", "software", None, "", "generic", None), ("https://www.amazon.de/dp/#n#", "Product", "product", None, "", "amazon-product", None), ("https://youtu.be/dQw4w9WgXcQ", "VideoObject", None, None, "oembed ", "youtube-video", None),
    ("https://de.wikipedia.org/wiki/#n#", None, None, None, "wikidata ,wikipedia ", "wikipedia-article", "wikipedia"), ("https://etherscan.io/address/#n#", "WebSite", None, None, "", "etherscan-contract", None), ("https://a.example/#n#", "WebSite", None, None, "token-metadata ", "website", None),
    (None, None, None, None, "token-metadata ", "coingecko-token", "token-metadata"), ("https://www.themoviedb.org/movie/#n#", None, None, None, "", "tmdb-movie", None), ("https://www.themoviedb.org/tv/#n#", None, None, None, "tmdb tv", "generic", None), (None, None, None, None, "company-profile ", "brand-company", "company-profile"),
    (None, None, None, None, "github-user ", "github-profile", "github-user"), ("https://www.npmjs.com/package/#n#", None, None, None, "", "npm-package", None), ("words #n#", None, None, None, "", "generic", None),
)
#: Priorities of the rules above, as the source states them.
PRIORITIES = {
    "x-profile": 980, "apple-music-song": 960, "spotify-track": 955, "spotify-artist": 954, "spotify-album": 953, "spotify-playlist": 952, "spotify-podcast-show": 951, "spotify-podcast-episode": 950, "github-repo": 950, "amazon-product": 930, "youtube-video": 920, "wikipedia-article": 910,
    "etherscan-contract": 900, "x-post": 890, "website": 880, "coingecko-token": 860, "tmdb-movie": 850, "brand-company": 840, "github-profile": 830, "npm-package": 820, "generic": 10,
}


def _cases(spark: SparkSession, d: str) -> DataFrame:
    of = lambda i: F.expr(shaped([c[i] for c in CASES])).cast("string")
    listed = F.transform(F.filter(F.split(of(4), ","), lambda x: x != ""), lambda x: F.struct(F.split_part(x, F.lit(" "), F.lit(1)).alias("slug"), F.split_part(x, F.lit(" "), F.lit(2)).alias("type")))
    return table(spark, d, "pages").select("page_id", of(0).alias("id_url"), of(1).alias("id_type"), of(2).alias("id_category"), of(3).alias("id_canonical"), F.array().cast("array<string>").alias("id_same_as"), listed.alias("artifacts"))


@query("t32_decide", f"SELECT page_id, {shaped([c[5] for c in CASES])} AS rule, CAST({shaped([PRIORITIES[c[5]] for c in CASES])} AS BIGINT) AS priority FROM pages")
def t32(spark, d):
    return D.decide(_cases(spark, d)).select("page_id", "rule", F.col("priority").cast("long").alias("priority"))


@query("t34_primary_artifact", f"SELECT page_id, {shaped([c[6] for c in CASES])} AS slug FROM pages")
def t34(spark, d):
    return D.decide(_cases(spark, d)).select("page_id", F.col("primary").alias("slug"))


#: What is known of an entity, and its identity: category, type, canonical id, title, description, family.
KNOWN = (
    (dict(resolved_type="MusicAlbum", resolved_title=" Title #n# ", resolved_id="id#n#", class_url="https://c.example/#n#", structured='{"name": "other"}'), ("song", "MusicAlbum", "id#n#", "Title #n#", None, "song", "https://c.example/#n#")),
    (dict(class_category="thing", structured='{"@type": "VideoObject", "title": "T#n#", "url": "https://s.example/#n#", "description": "D"}', parsed='{"name": "N"}'), ("thing", "VideoObject", "https://s.example/#n#", "T#n#", "D", "video", "https://s.example/#n#")),
    (dict(parsed='{"@type": "PodcastSeries", "name": "N#n#", "url": " "}', data="https://d.example/#n#"), ("podcast", "PodcastSeries", "https://d.example/#n#", "N#n#", None, "generic", "https://d.example/#n#")),
    (dict(data="plain #n#", raw_input="https://r.example/#n#", artifact_url="https://a.example"), (None, None, "https://a.example", "plain #n#", None, "generic", "https://r.example/#n#")),
    (dict(class_type="WebSite", class_category="thing", data='{"x": 1}', artifact_url="https://youtu.be/#n#"), ("thing", "WebSite", "https://youtu.be/#n#", None, None, "website", "https://youtu.be/#n#")),
)


@query("t33_identity", "SELECT page_id, " + ", ".join(f"{shaped([k[1][i] for k in KNOWN])} AS {c}" for i, c in enumerate(("id_category", "id_type", "id_canonical", "id_title", "id_description", "id_family", "id_url"))) + " FROM pages")
def t33(spark, d):
    names = ("resolved_category", "resolved_type", "resolved_title", "resolved_description", "resolved_id", "class_category", "class_type", "class_url", "structured", "parsed", "raw_input", "data", "artifact_url")

    def of(c: str) -> Column:
        return F.expr(shaped([k[0].get(c) for k in KNOWN])).cast("string").alias(c)

    rows = table(spark, d, "pages").select("page_id", F.lit(None).cast("array<string>").alias("resolved_same_as"), *map(of, names))
    return D.identity(rows).select("page_id", "id_category", "id_type", "id_canonical", "id_title", "id_description", "id_family", "id_url")


#: Class address, input, type and category of an entity; what it targets, whether a music scope takes it, and what is fetched without and with that scope.
PLANS = (
    ("https://open.spotify.com/track/#n#", "x", "MusicRecording", "song", "https://open.spotify.com/track/#n#", True, "opengraph,favicon,brand,spotify,wikipedia,wikidata", "opengraph,spotify,musicbrainz,apple-music,wikipedia,wikidata"),
    (None, "https://a.example/#n#", "WebSite", "thing", "https://a.example/#n#", False, "opengraph,favicon,brand", ""), (None, "words", "Thing", "album", None, True, "", "opengraph,spotify,musicbrainz,apple-music,wikipedia,wikidata"), (None, "words", "PodcastEpisode", None, None, False, "", ""),
)


@query("t35_lookup_plan", f"SELECT page_id, {shaped([p[4] for p in PLANS])} AS target_url, CASE page_id % {len(PLANS)} WHEN 0 THEN true WHEN 2 THEN true ELSE false END AS looked_up, {shaped([p[6] for p in PLANS])} AS usual, {shaped([p[7] for p in PLANS])} AS scoped FROM pages")
def t35(spark, d):
    of = lambda i: F.expr(shaped([p[i] for p in PLANS])).cast("string")
    rows = table(spark, d, "pages").select("page_id", of(0).alias("class_url"), F.lit(None).cast("string").alias("document_url"), of(1).alias("raw_input"), of(2).alias("class_type"), of(3).alias("class_category"))
    usual = D.lookup_plan(rows).select("page_id", "target_url", "class_url", "document_url", "raw_input", "class_type", "class_category", F.concat_ws(",", "allowed").alias("usual"))
    return D.lookup_plan(usual.drop("target_url"), ("music",)).select("page_id", "target_url", "looked_up", "usual", F.concat_ws(",", "allowed").alias("scoped"))
