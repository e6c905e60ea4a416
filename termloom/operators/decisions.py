"""Which view an entity gets: identity from several sources, rules by priority, the artifact shown first, what to look up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.columns import let
from termloom.operators.sites import address

#: The category that a type stands for.
CATEGORIES = (
    ("MusicAlbum", "song"), ("MusicRecording", "song"), ("Organization", "company"), ("Person", "person"), ("PodcastEpisode", "podcast"), ("PodcastSeries", "podcast"), ("Product", "product"),
    ("SocialMediaAccount", "person"), ("SoftwareApplication", "software"), ("SoftwareSourceCode", "software"),
)
#: Rules by priority (ties as listed), and the artifacts that each shows first.
RULES = (
    ("x-profile", 980, ("x-profile", "twitter-profile")), ("apple-music-song", 960, ("apple-music",)), ("spotify-track", 955, ("spotify",)), ("spotify-artist", 954, ("spotify",)), ("spotify-album", 953, ("spotify",)),
    ("spotify-playlist", 952, ("spotify",)), ("spotify-podcast-show", 951, ("spotify",)), ("spotify-podcast-episode", 950, ("spotify",)), ("github-repo", 950, ("github-repo",)), ("amazon-product", 930, ("product-listing",)),
    ("youtube-video", 920, ("youtube",)), ("wikipedia-article", 910, ("wikipedia",)), ("etherscan-contract", 900, ("etherscan",)), ("x-post", 890, ()), ("website", 880, ()), ("coingecko-token", 860, ("token-metadata",)),
    ("tmdb-movie", 850, ("tmdb",)), ("brand-company", 840, ("brand", "company-profile")), ("github-profile", 830, ("github-user",)), ("npm-package", 820, ("npm-package",)), ("generic", 10, ()),
)
#: Artifacts that are worth fetching for a plain website, for one kind of track, and within a scope; what puts an entity into a scope.
WEBSITE_ARTIFACTS = ("opengraph", "favicon", "brand")
TRACK_ARTIFACTS = ("opengraph", "favicon", "brand", "spotify", "wikipedia", "wikidata")
SCOPES = {
    "music": (("opengraph", "spotify", "musicbrainz", "apple-music", "wikipedia", "wikidata"), ("musicalbum", "musicgroup", "musicrecording"), ("album", "artist", "music", "playlist", "song", "track")),
    "podcast": (("opengraph", "spotify", "apple-music", "podcast-index", "wikipedia", "wikidata"), ("podcastepisode", "podcastseries"), ("episode", "podcast", "show")),
}


def _text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", F.trim(c))


def _http(c: str) -> Column:
    return F.when(let(address(F.col(c)), lambda u: F.coalesce(u["scheme"].isin("http", "https"), F.lit(False))), F.col(c))


def identity(df: DataFrame) -> DataFrame:
    """df with id_category, id_type, id_canonical, id_url, id_same_as, id_title, id_description and id_family.

    df has what is known of an entity, nullable: resolved_category, resolved_type,
    resolved_title, resolved_description, resolved_id, resolved_same_as (array),
    class_category, class_type, class_url, the documents structured and parsed (JSON),
    raw_input, data, and artifact_url. The first of the sources that says something counts.
    """
    at = lambda doc, k: _text(F.get_json_object(doc, f"$['{k}']"))
    schema = F.coalesce(_text("resolved_type"), _text("class_type"), at("structured", "@type"), at("parsed", "@type"))
    by_type = F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES for x in kv]), schema)
    category = F.coalesce(_text("resolved_category"), _text("class_category"), by_type)
    own = F.coalesce(_text("class_url"), at("structured", "url"), at("parsed", "url"))
    url = F.coalesce(own, _http("raw_input"), _http("data"), F.col("artifact_url"))
    same = F.array_distinct(F.filter(F.concat(F.coalesce("resolved_same_as", F.array().cast("array<string>")), F.array(at("structured", "url"), at("parsed", "url"))), lambda x: x.isNotNull() & (x != "")))
    title = F.coalesce(_text("resolved_title"), at("structured", "name"), at("structured", "title"), at("parsed", "name"), at("parsed", "title"), F.when(~F.startswith(F.col("data"), F.lit("{")), F.col("data")))
    tube = let(address(url), lambda u: F.coalesce(u["host"].rlike(r"youtube\.com|youtu\.be"), F.lit(False)))
    family = (
        F.when(schema == "WebSite", "website").when(category.isin("product", "software", "person", "company", "song"), category).when(category == "podcast", "generic")
        .when(tube | (schema == "VideoObject"), "video").otherwise("generic")
    )
    return df.withColumns({
        "id_category": category, "id_type": schema, "id_canonical": F.coalesce(_text("resolved_id"), own, _http("data"), F.col("artifact_url")), "id_url": url, "id_same_as": same,
        "id_title": title, "id_description": F.coalesce(_text("resolved_description"), at("structured", "description"), at("parsed", "description")), "id_family": family,
    })


def decide(df: DataFrame) -> DataFrame:
    """df with rule, priority and primary (the first artifact of the rule's list that is there).

    df has id_category, id_type, id_canonical, id_url, id_same_as (see identity()) and
    artifacts, an array of struct(slug, type). The highest rule that matches decides.
    """
    has = lambda slug: F.exists("artifacts", lambda a: a["slug"] == slug)
    kind_of = lambda slug: F.get(F.filter("artifacts", lambda a: a["slug"] == slug), F.lit(0))["type"]
    url, named = F.coalesce("id_url", F.lit("")), F.coalesce("id_canonical", F.lit(""))
    schema, category = F.coalesce("id_type", F.lit("")), F.coalesce("id_category", F.lit(""))

    def spotify(kind: str, schema_type: str | None = None) -> Column:
        """By the artifact's type; without one, for some types, by an identity on the platform."""
        by_artifact = has("spotify") & (F.coalesce(kind_of("spotify"), F.lit("")) == kind)
        if schema_type is None:
            return by_artifact
        names = F.concat(F.array("id_url", "id_canonical"), F.coalesce("id_same_as", F.array().cast("array<string>")))
        refers = F.exists(names, lambda x: F.coalesce(x.startswith(f"spotify:{kind}:") | let(address(x), lambda u: u["host"].contains("spotify.") & u["path"].contains(f"/{kind}/")), F.lit(False)))
        return by_artifact | (~has("spotify") & (schema == schema_type) & refers)

    def of(host: Column) -> Column:
        on = lambda *parts: reduce(lambda a, b: a | b, [host.contains(p) for p in parts])
        post = named.startswith("x:post:") | (schema == "SocialMediaPosting")
        matches = {
            "x-profile": ~post & (has("x-profile") | has("twitter-profile") | on("x.com", "twitter.com")) & ~url.contains("/status/"),
            "apple-music-song": F.when(has("apple-music"), F.coalesce(kind_of("apple-music"), F.lit("")) == "song").otherwise(on("music.apple.com")),
            "spotify-track": spotify("track", "MusicRecording"), "spotify-artist": spotify("artist"), "spotify-album": spotify("album"), "spotify-playlist": spotify("playlist"),
            "spotify-podcast-show": spotify("show", "PodcastSeries"), "spotify-podcast-episode": spotify("episode", "PodcastEpisode"),
            "github-repo": has("github-repo"), "amazon-product": has("product-listing") | ((category == "product") & on("amazon.")),
            "youtube-video": has("youtube") | has("oembed") | on("youtube.com", "youtu.be"), "wikipedia-article": has("wikipedia") | has("wikidata") | on("wikipedia.org"),
            "etherscan-contract": has("etherscan") | on("etherscan.io"), "x-post": (on("x.com", "twitter.com") & url.contains("/status/")) | post, "website": schema == "WebSite",
            "coingecko-token": has("token-metadata"), "tmdb-movie": F.when(has("tmdb"), F.coalesce(kind_of("tmdb"), F.lit("")) == "movie").otherwise(on("themoviedb.org")),
            "brand-company": has("brand") | has("company-profile"), "github-profile": has("github-user"), "npm-package": has("npm-package") | on("npmjs.com"), "generic": F.lit(True),
        }
        pick = F
        for rule, priority, slugs in RULES:
            first = F.get(F.filter(F.array(*map(F.lit, slugs)).cast("array<string>"), lambda s: F.exists("artifacts", lambda a: a["slug"] == s)), F.lit(0))
            pick = pick.when(matches[rule], F.struct(F.lit(rule).alias("rule"), F.lit(priority).alias("priority"), first.alias("primary")))
        return pick

    found = df.withColumn("_decided", let(F.coalesce(let(address(url), lambda u: u["host"]), F.lit("")), of))
    return found.select(*df.columns, "_decided.*")


def handoff(df: DataFrame) -> DataFrame:
    """df with input_kind, allow_url_providers and preferred_url, from raw_input, category, schema_type, canonical_id and same_as (array).

    Plain text that is but a thing is not looked up by address. An address of the input
    wins, unless same_as has one on its host that differs by more than the case of the path.
    """
    host = lambda c: let(address(c), lambda u: F.when(u["scheme"].isin("http", "https"), u["host"]))
    raw = _http("raw_input")
    urls = F.filter(F.coalesce("same_as", F.array().cast("array<string>")), lambda x: host(x).isNotNull())
    on_host = F.get(F.filter(urls, lambda x: host(x) == host(F.col("raw_input"))), F.lit(0))
    cased = (F.lower(on_host) == F.lower("raw_input")) & (on_host != F.col("raw_input"))
    kind = F.when(raw.isNotNull(), "url").otherwise("plain-text")
    allow = ~((kind == "plain-text") & (F.coalesce("category", F.lit("")) == "thing") & (F.lower(F.trim("schema_type")) == "thing"))
    best = F.when(raw.isNull(), F.coalesce(_http("canonical_id"), F.get(urls, F.lit(0)))).when(on_host.isNull() | cased, raw).otherwise(on_host)
    return df.withColumns({"input_kind": kind, "allow_url_providers": F.coalesce(allow, F.lit(True)), "preferred_url": F.when(F.coalesce(allow, F.lit(True)), best)})


def lookup_plan(df: DataFrame, scope: tuple[str, ...] | None = None) -> DataFrame:
    """df with target_url, domains, looked_up and allowed (artifacts worth fetching, null: all), from class_url, document_url, raw_input, class_type and class_category.

    Without a scope everything is looked up; with one, only what lies in one of its domains,
    and then only the artifacts of those.
    """
    target = F.coalesce(_text("class_url"), _text("document_url"), _http("raw_input"))
    track = let(address(target), lambda u: F.coalesce((u["host"] == "open.spotify.com") & u["path"].startswith("/track/"), F.lit(False)))
    kind, category = F.lower(F.coalesce("class_type", F.lit(""))), F.lower(F.coalesce("class_category", F.lit("")))
    domains = F.array_compact(F.array(*[F.when(kind.isin(*types) | category.isin(*categories), d) for d, (_, types, categories) in SCOPES.items()]))
    usual = F.when(F.col("class_type") == "WebSite", F.array(*map(F.lit, WEBSITE_ARTIFACTS))).when((F.col("class_type") == "MusicRecording") & track, F.array(*map(F.lit, TRACK_ARTIFACTS)))
    if scope is None:
        return df.withColumns({"target_url": target, "domains": domains, "looked_up": F.lit(True), "allowed": usual})
    within = F.array_intersect(domains, F.array(*map(F.lit, scope)))
    artifacts = F.create_map(*[x for d, (a, _, _) in SCOPES.items() for x in (F.lit(d), F.array(*map(F.lit, a)))])
    allowed = F.array_distinct(F.flatten(F.transform(within, lambda d: F.element_at(artifacts, d))))
    return df.withColumns({"target_url": target, "domains": within, "looked_up": F.size(within) > 0, "allowed": F.when(F.size(within) > 0, allowed)})
