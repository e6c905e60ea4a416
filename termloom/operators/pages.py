"""What a page or document says of itself: kind, tags, linked data, fields, suggestions, claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.columns import let
from termloom.operators.sites import address

#: Fields of a document that may hold an address, in order.
ADDRESS_FIELDS = ("url", "contentUrl", "homepage", "externalUrl", "downloadUrl", "codeRepository", "logoUrl", "iconUrl", "image", "imageUrl", "audio", "audioUrl")
#: Hosts whose pages say nothing of an entity.
SHELL_HOSTS = ("goo.gl", "maps.app.goo.gl", "maps.google.com", "open.spotify.com", "wikidata.org")
#: Types in the order in which one stands for a page, with the class that each suggests.
PAGE_TYPES = (
    ("JobPosting", "job-posting"), ("Event", "event"), ("MusicEvent", "event"), ("Festival", "event"), ("Product", "product"), ("Movie", "movie"), ("TVSeries", "tv-series"), ("Book", "book"),
    ("MusicRecording", "music-recording"), ("MusicAlbum", "music-album"), ("PodcastEpisode", "podcast-episode"), ("PodcastSeries", "podcast-series"), ("Dataset", "dataset"), ("Review", "review"),
    ("NewsArticle", "news-article"), ("BlogPosting", "article"), ("Article", "article"), ("VideoObject", "video-object"), ("LocalBusiness", "local-business"), ("Restaurant", "local-business"),
    ("SoftwareApplication", "software-application"), ("MobileApplication", "mobile-application"), ("Person", "person"), ("Place", "location"), ("TouristAttraction", "location"),
)
#: What an instance-of claim suggests.
INSTANCE_OF = (
    ("Q5", "person"), ("Q515", "location"), ("Q571", "book"), ("Q7366", "music-recording"), ("Q7397", "software-application"), ("Q11424", "movie"), ("Q41176", "location"), ("Q43229", "company"),
    ("Q132241", "event"), ("Q134556", "music-recording"), ("Q215380", "music-group"), ("Q482994", "music-album"), ("Q486972", "location"), ("Q570116", "location"), ("Q783794", "company"), ("Q1656682", "event"),
    ("Q4830453", "company"), ("Q5398426", "tv-series"), ("Q6881511", "company"), ("Q7725634", "book"),
)
#: What an address suggests, as (host, path or query, classes); the first host that fits decides.
URL_SUGGESTIONS = (
    (r"(^|\.)google\.com$", r"^/maps", ("local-business", "location")),
    (r"(^|\.)amazon\.[a-z.]+$", r"/(dp|gp/product)/", ("product",)),
    (r"(^|\.)open\.spotify\.com$", r"/track/", ("music-recording",)), (r"(^|\.)open\.spotify\.com$", r"/album/", ("music-album",)), (r"(^|\.)open\.spotify\.com$", r"/artist/", ("music-group",)),
    (r"(^|\.)open\.spotify\.com$", r"/show/", ("podcast-series",)), (r"(^|\.)open\.spotify\.com$", r"/episode/", ("podcast-episode",)),
    (r"(^|\.)music\.apple\.com$", r"/song/|[?&]i=", ("music-recording",)), (r"(^|\.)music\.apple\.com$", r"/album/", ("music-album",)), (r"(^|\.)music\.apple\.com$", r"/artist/", ("music-group",)),
    (r"(^|\.)github\.com$", r"^/+[^/?]+/+[^/?]+", ("software",)), (r"(^|\.)github\.com$", r"^/+[^/?]+", ("social-media-account",)),
    (r"(^|\.)npmjs\.com$", r"", ("software-application",)),
    (r"(^|\.)(youtube\.com|youtu\.be)$", r"^/@", ("social-media-account",)), (r"(^|\.)(youtube\.com|youtu\.be)$", r"", ("video-object",)),
    (r"(^|\.)(x|twitter)\.com$", r"/status(/|\?|$)", ("social-media-posting",)), (r"(^|\.)(x|twitter)\.com$", r"^/+[^/?]+/*(\?|$)", ("social-media-account", "person")),
    (r"(^|\.)(maps\.app\.goo\.gl|maps\.google\.com)$", r"", ("local-business", "location")),
    (r"(^|\.)(etherscan\.io|basescan\.org|arbiscan\.io|polygonscan\.com)$", r"^/token/", ("ethereum-erc20",)), (r"(^|\.)(etherscan\.io|basescan\.org|arbiscan\.io|polygonscan\.com)$", r"^/address/", ("ethereum-account",)),
    (r"(^|\.)themoviedb\.org$", r"^/tv/", ("tv-series",)), (r"(^|\.)themoviedb\.org$", r"^/movie/", ("movie",)),
)
#: How sure a source's value is.
CONFIDENCE = {"input": 1.0, "page": 0.9, "tags": 0.7}


def bare_host(u: Column) -> Column:
    return F.regexp_replace(u["host"], r"^www\.", "")


def sniff(body: Column, content_type: Column | None = None) -> Column:
    """The kind of a fetched body: by its content type, where that says enough; else HTML by its beginning, JSON by parsing the whole, then magic numbers."""
    text = F.regexp_replace(body.cast("string"), r"^[\s\p{Z}﻿]+", "")
    head, magic = F.lower(F.substring(text, 1, 16)), F.hex(F.substring(body, 1, 4))
    found = (
        F.when(head.startswith("<!doctype html") | head.startswith("<html"), "webpage").when(text.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "json_document")
        .when(magic.startswith("89504E47") | magic.startswith("FFD8FF") | magic.startswith("47494638"), "image").when(magic.startswith("52494646") | magic.startswith("494433"), "audio")
        .when(F.contains(F.hex(body), F.lit("6674797069736F6D")), "video").when(F.length(body) == 0, "unknown_remote").otherwise("generic_file")
    )
    if content_type is None:
        return found
    c = F.lower(content_type)
    return (
        F.when(c.isNull() | (c == ""), found).when(c.startswith("text/html"), "webpage").when(c.startswith("application/json") | c.contains("+json") | c.endswith("/json"), "json_document")
        .when(c.startswith("image/"), "image").when(c.startswith("video/"), "video").when(c.startswith("audio/"), "audio").when(c.startswith("text/plain") | (c == "application/octet-stream"), found).otherwise("generic_file")
    )


def structured(df: DataFrame, text: str) -> DataFrame:
    """df with top_level ("object", "array" or null), format, context, schema_type and urls (array of struct(field, url), each address once) of the JSON in a column."""
    t = F.trim(text)
    valid = F.try_parse_json(t).isNotNull()
    is_object = valid & t.startswith("{")
    one = lambda path: F.nullif(F.trim(F.when(is_object, F.get_json_object(t, path))), F.lit(""))
    kinds = F.from_json(F.get_json_object(t, "$['@type']"), "array<string>")
    first = F.get(F.filter(kinds, lambda x: F.trim(x) != ""), F.lit(0))
    listed = [F.struct(F.lit(f).alias("field"), F.get_json_object(t, f"$.{f}").alias("value")) for f in ADDRESS_FIELDS]
    same = F.transform(F.coalesce(F.from_json(F.get_json_object(t, "$.sameAs"), "array<string>"), F.array().cast("array<string>")), lambda x: F.struct(F.lit("sameAs").alias("field"), x.alias("value")))
    found = F.transform(F.concat(F.array(*listed), same), lambda x: F.struct(x["field"].alias("field"), let(address(x["value"]), lambda u: F.when(u["scheme"].isin("http", "https"), u["href"])).alias("url")))
    found = F.filter(found, lambda x: x["url"].isNotNull())
    once = F.transform(F.array_distinct(F.transform(found, lambda x: x["url"])), lambda a: F.get(F.filter(found, lambda x: x["url"] == a), F.lit(0)))
    return df.withColumns({
        "top_level": F.when(is_object, "object").when(valid & t.startswith("["), "array"), "context": one("$['@context']"),
        "format": F.when(is_object & one("$['@context']").isNotNull(), "jsonld").when(valid & t.rlike(r"^[\[{]"), "json"),
        "schema_type": F.when(is_object, F.coalesce(F.trim(first), F.when(~F.get_json_object(t, "$['@type']").startswith("["), one("$['@type']")))),
        "urls": F.when(is_object, once).otherwise(F.array().cast("array<struct<field:string,url:string>>")),
    })


#: What follows a tag's name: its attributes, whose values may hold brackets, and what stands after the tag.
TAG_REST = r"(?s)^((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>(.*)"
#: Blanks around a block, and the comment guard that may stand at either end of it.
WHITE = " \t\n\r\f"
COMMENT_GUARD = r"^/\*\s*<!\[CDATA\[\s*\*/|/\*\s*\]\]>\s*\*/$"


def _unwrapped(block: Column) -> Column:
    """The objects of a JSON text, level by level: a list is its items, a list under @graph joins the next level, and what holds one counts itself only if it has a type. There are no more levels than opening braces."""
    listed = lambda x: F.coalesce(F.from_json(x, "array<string>"), F.array().cast("array<string>"))
    graph = lambda x: F.when(F.get_json_object(x, "$['@graph']").startswith("["), F.get_json_object(x, "$['@graph']"))
    objects = lambda items: F.filter(items, lambda x: x.startswith("{"))
    below = lambda level: objects(F.flatten(F.transform(level, lambda x: listed(graph(x)))))
    own = lambda level: F.filter(level, lambda x: graph(x).isNull() | F.get_json_object(x, "$['@type']").isNotNull())
    start = F.struct(objects(F.when(block.startswith("["), listed(block)).otherwise(F.array(block))).alias("level"), F.array().cast("array<string>").alias("found")).cast("struct<level:array<string>,found:array<string>>")
    step = lambda s, _: F.struct(below(s["level"]).alias("level"), F.concat(s["found"], own(s["level"])).alias("found")).cast("struct<level:array<string>,found:array<string>>")
    levels = F.sequence(F.lit(0), F.regexp_count(block, F.lit(r"\{")))
    return F.aggregate(levels, start, step, lambda s: s["found"])


def json_ld_nodes(html: Column, url: Column | None = None) -> Column:
    """The entity nodes of a page's JSON-LD blocks, as JSON texts: comment guards and escaped ampersands undone, broken blocks left out, lists and @graph unwrapped, block by block, to any depth, nodes further out first; none for shells of platforms."""
    none = F.array().cast("array<string>")
    after = F.filter(F.slice(F.split(html, r"(?i)<script\b"), 2, 1 << 30), lambda s: s.rlike("(?i)</script"))
    ours = F.filter(after, lambda s: F.regexp_extract(s, TAG_REST, 1).rlike(r"(?i)\btype\s*=\s*[\"']application/ld\+json[\"']"))
    inside = F.transform(ours, lambda s: F.split(F.regexp_extract(s, TAG_REST, 2), "(?i)</script")[0])
    texts = F.transform(inside, lambda b: F.replace(F.btrim(F.regexp_replace(F.btrim(b, F.lit(WHITE)), COMMENT_GUARD, ""), F.lit(WHITE)), F.lit("&amp;"), F.lit("&")))
    blocks = F.filter(texts, lambda b: F.try_parse_json(b).isNotNull())
    nodes = F.flatten(F.transform(blocks, _unwrapped))
    if url is None:
        return nodes
    shell = let(address(url), lambda u: u.isNull() | bare_host(u).rlike(r"(^|\.)(?:" + "|".join(h.replace(".", r"\.") for h in SHELL_HOSTS) + ")$") | (bare_host(u).rlike(r"(^|\.)google\.com$") & u["path"].startswith("/maps")))
    return F.when(F.coalesce(shell, F.lit(True)), none).otherwise(nodes)


def node_types(node: Column) -> Column:
    """The types of a node, one or a list."""
    t = F.get_json_object(node, "$['@type']")
    return F.when(t.startswith("["), F.coalesce(F.from_json(t, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array_compact(F.array(t)))


def primary_image(nodes: Column) -> Column:
    """The first image of an http(s) address among nodes: a text, an object's url, or the first such of a list."""
    def of(node: Column) -> Column:
        image = F.get_json_object(node, "$.image")
        entries = F.when(image.startswith("["), F.from_json(image, "array<string>")).otherwise(F.array_compact(F.array(image)))
        urls = F.transform(entries, lambda e: F.trim(F.when(e.startswith("{"), F.get_json_object(e, "$.url")).otherwise(e)))
        return F.get(F.filter(urls, lambda x: x.rlike("^https?://")), F.lit(0))

    return F.get(F.filter(F.transform(nodes, of), lambda x: x.isNotNull()), F.lit(0))


def primary_type(nodes: Column) -> Column:
    """The type of the page's nodes that comes first in PAGE_TYPES."""
    first = lambda present: F.get(F.filter(F.array(*[F.lit(t) for t, _ in PAGE_TYPES]), lambda t: F.array_contains(present, t)), F.lit(0))
    return let(F.flatten(F.transform(nodes, node_types)), first)  # read once, not for each type


def favicon(url: Column, size: int = 128) -> Column:
    """The address of an icon of the host, from a public icon service; null where there is no host."""
    return let(address(url), lambda u: F.when(u["host"].isNotNull(), F.concat(F.lit("https://www.google.com/s2/favicons?domain="), F.url_encode(bare_host(u)), F.lit(f"&sz={size}"))))


def suggest(url: Column, instance_of: Column, nodes: Column) -> Column:
    """Classes that an address, instance-of claims (array of ids) and a page's own data suggest, in that order, each once."""
    none = F.array().cast("array<string>")

    def of_url(u: Column) -> Column:
        rest, pick = F.concat(u["path"], F.coalesce(u["query"], F.lit(""))), F
        for host in dict.fromkeys(h for h, _, _ in URL_SUGGESTIONS):
            inner = F
            for h, pattern, classes in URL_SUGGESTIONS:
                if h == host:
                    inner = inner.when(rest.rlike(pattern or "^"), F.array(*map(F.lit, classes)))
            fits = bare_host(u).rlike(host)
            if "google" in host and "maps" not in host or "amazon" in host:
                fits &= rest.rlike(next(p for h, p, _ in URL_SUGGESTIONS if h == host))  # elsewhere on these hosts others may still fit
            pick = pick.when(fits, inner.otherwise(none))
        return pick.otherwise(none)

    claims = F.transform(F.coalesce(instance_of, none), lambda q: F.element_at(F.create_map(*[F.lit(x) for kv in INSTANCE_OF for x in kv]), F.upper(q)))
    page = F.element_at(F.create_map(*[F.lit(x) for kv in PAGE_TYPES for x in kv]), primary_type(nodes))
    return F.array_distinct(F.array_compact(F.concat(F.coalesce(let(address(url), of_url), none), claims, F.array(page))))


def claim_values(claims: Column, property_id: str) -> Column:
    """The values of a property in an entity's claims (JSON), as JSON texts: preferred ones if there are any, never deprecated ones, in their order."""
    listed = F.coalesce(F.from_json(F.get_json_object(claims, f"$.{property_id}"), "array<string>"), F.array().cast("array<string>"))
    rank = lambda c: F.coalesce(F.get_json_object(c, "$.rank"), F.lit(""))
    usable = F.filter(listed, lambda c: rank(c) != "deprecated")
    preferred = F.filter(usable, lambda c: rank(c) == "preferred")
    return F.array_compact(F.transform(F.when(F.size(preferred) > 0, preferred).otherwise(usable), lambda c: F.get_json_object(c, "$.mainsnak.datavalue.value")))


def claim_ids(claims: Column, property_id: str) -> Column:
    return F.array_compact(F.transform(claim_values(claims, property_id), lambda v: F.get_json_object(v, "$.id")))


def claim_strings(claims: Column, property_id: str) -> Column:
    return F.filter(F.transform(claim_values(claims, property_id), lambda v: F.trim(v)), lambda v: (v != "") & ~v.startswith("{"))


def _first(values: Column, of) -> Column:
    return F.get(F.filter(F.transform(values, of), lambda x: x.isNotNull()), F.lit(0))


def claim_quantity(claims: Column, property_id: str) -> Column:
    return _first(claim_values(claims, property_id), lambda v: F.get_json_object(v, "$.amount").try_cast("double"))


def claim_coordinate(claims: Column, property_id: str) -> Column:
    number = lambda v, k: F.get_json_object(v, f"$.{k}").try_cast("double")
    return _first(claim_values(claims, property_id), lambda v: F.when(number(v, "latitude").isNotNull() & number(v, "longitude").isNotNull(), F.struct(number(v, "latitude").alias("latitude"), number(v, "longitude").alias("longitude"))))


def claim_day(claims: Column, property_id: str) -> Column:
    """The first time that is exact to the day, as text."""
    return _first(claim_values(claims, property_id), lambda v: F.when(F.get_json_object(v, "$.precision").try_cast("int") >= 11, F.nullif(F.regexp_extract(F.get_json_object(v, "$.time"), r"^\+(\d{4}-\d{2}-\d{2})T", 1), F.lit(""))))


def fields(tiers: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """For each entity (keys) the fields wanted (field, kind, required), as (keys, field, value, source, confidence): the first value in order of tier, place that its kind allows.

    tiers has keys, field, value, source, confidence, tier and place. Kinds: "string",
    "url" (http or https), "number", "date" (yyyy-mm-dd). Values are trimmed; empty or
    invalid ones are dropped and the next takes their place.
    """
    value = F.trim("value")
    fits = (
        F.when(F.col("kind") == "url", value.rlike(r"^https?://[^\s/]+")).when(F.col("kind") == "number", value.try_cast("double").isNotNull())
        .when(F.col("kind") == "date", value.rlike(r"^\d{4}-\d{2}-\d{2}") & F.substring(value, 1, 10).try_cast("date").isNotNull()).otherwise(value != "")
    )
    rows = tiers.join(F.broadcast(wanted.select("field", "kind")), "field").where(F.coalesce(fits, F.lit(False)))
    best = rows.groupBy(*keys, "field").agg(F.min(F.struct("tier", "place", value.alias("value"), "source", "confidence")).alias("x"))
    return best.select(*keys, "field", "x.value", "x.source", "x.confidence")


def missing_fields(entities: DataFrame, found: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """(keys, field): required fields that an entity has no value for."""
    required = wanted.where("required").select("field")
    return entities.select(*keys).distinct().crossJoin(F.broadcast(required)).join(found, [*keys, "field"], "left_anti").select(*keys, "field")


def identifiers(artifacts: DataFrame, readers: dict[str, tuple[tuple[str, str, str], ...]], key: str) -> DataFrame:
    """(key, plugin, name, value): identifiers found in artifacts (key, kind, data as JSON) that let other plugins look further, without plugins that have an artifact already.

    readers: for a kind of artifact, (JSON path, plugin, name of the identifier). The
    smallest value of a name counts.
    """
    rows = [artifacts.where(F.col("kind") == kind).select(key, F.lit(plugin).alias("plugin"), F.lit(name).alias("name"), F.trim(F.get_json_object("data", path)).alias("value")) for kind, found in readers.items() for path, plugin, name in found]
    found = reduce(DataFrame.unionByName, rows).where("value <> ''")
    return found.join(artifacts.select(key, F.col("kind").alias("plugin")).distinct(), [key, "plugin"], "left_anti").groupBy(key, "plugin", "name").agg(F.min("value").alias("value"))
