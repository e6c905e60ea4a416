"""What an input names: the parts of an address, its class, and the entity that follows from the class alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.columns import let

#: Schemes with an authority, and their ports.
SPECIAL = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_AUTHORITY = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)(?::(\d*))?"


def address(raw: Column) -> Column:
    """The parts of an absolute address of any scheme: struct(href, scheme, host, path, query, has_query), null if raw is none.

    Schemes of the web need a host, take backslashes and missing slashes, and lose their
    default port; their path is "/" at least. Other schemes keep what follows the colon.
    """

    def parts(s: Column) -> Column:
        scheme = F.lower(F.regexp_extract(s, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
        special = scheme.isin(*SPECIAL)
        split = F.regexp_extract(s, r"^[^?#]*", 0)
        slashed = F.concat(F.regexp_replace(F.translate(split, "\\", "/"), r"^([^:]*):/*", "$1://"), F.substr(s, F.length(split) + 1))
        t = F.when(special, slashed).otherwise(s)

        def of(t: Column) -> Column:
            host, port = F.lower(F.regexp_extract(t, _AUTHORITY, 2)), F.regexp_extract(t, _AUTHORITY, 3)
            default = F.element_at(F.create_map(*[F.lit(x) for kv in SPECIAL.items() for x in kv]), scheme)
            rest = F.when(t.rlike(r"^[^:/?#]+://"), F.regexp_replace(t, r"^[^:]*://[^/?#]*", "")).otherwise(F.regexp_replace(t, r"^[^:]*:", ""))
            path = F.regexp_extract(rest, r"^[^?#]*", 0)
            path = F.when(special & (path == ""), "/").otherwise(path)
            tail = F.regexp_extract(rest, r"[?#].*$", 0)
            query = F.regexp_extract(rest, r"^[^?#]*(\?[^#]*)", 1)
            user = F.regexp_extract(t, r"^[^:]*://([^/?#]*@)", 1)
            number = F.when((port == "") | (special & (port == default)), "").otherwise(F.concat(F.lit(":"), port))
            with_host = F.concat(scheme, F.lit("://"), user, host, number, path, tail)
            href = F.when(t.rlike(r"^[^:/?#]+://"), with_host).otherwise(F.concat(scheme, F.lit(":"), path, tail))
            valid = (scheme != "") & ~(special & ((host == "") | host.rlike(r"[\s<>^|%]")))
            return F.when(valid, F.struct(href.alias("href"), scheme.alias("scheme"), F.nullif(host, F.lit("")).alias("host"), path.alias("path"), query.alias("query"), (F.length(query) > 1).alias("has_query")))

        return let(t, of)

    return let(F.regexp_replace(F.trim(raw), r"[\t\r\n]", ""), parts)


@dataclass(frozen=True)
class Site:
    """A class of address: patterns of its host and of its path (slashes collapsed, none at the end) or query, and what the groups of the latter give."""

    name: str
    host: str
    pattern: str
    confidence: float
    canonical: str
    schema_type: str
    category: str
    canonical_id: str
    title: str
    of: str = "path"


def _reserved(*words: str) -> str:
    return rf"(?!(?i:{'|'.join(words)})(?:/|$))"


#: First path segments that are no profile.
_GITHUB = _reserved("about", "collections", "contact", "events", "explore", "features", "issues", "login", "marketplace", "new", "notifications", "orgs", "pricing", "pulls", "search", "sessions", "settings", "signup", "site", "topics")
_X = "@*" + _reserved("explore", "hashtag", "home", "i", "intent", "login", "messages", "notifications", "privacy", "search", "settings", "share", "tos")
#: Markets of one shop, and its short hosts.
_AMAZON = r"(?:^|\.)amazon\.(?:ae|ca|cn|co\.jp|co\.uk|com|com\.au|com\.be|com\.br|com\.mx|com\.tr|de|eg|es|fr|in|it|nl|pl|sa|se|sg)$"
_ASIN = r"(?i)/(?:dp|gp/product|gp/aw/d|exec/obidos/asin)/([A-Z0-9]{10})(?![A-Z0-9])"
_TUBE = r"^(?:www\.)?(?:m\.youtube|youtube|youtube-nocookie)\.com$"
_VIDEO = "https://www.youtube.com/watch?v=$1"
_SPOTIFY = (("track", "MusicRecording", "song"), ("album", "MusicAlbum", "song"), ("artist", "MusicGroup", "song"), ("show", "PodcastSeries", "podcast"), ("episode", "PodcastEpisode", "podcast"))
#: Classes of addresses; in templates $1 to $3 are the pattern's groups and $host is the host.
SITES = (
    Site("github:issue", r"^github\.com$", rf"^/{_GITHUB}([^/]+)/([^/]+)/issues/(\d+)(?:/|$)", 0.98, "https://github.com/$1/$2/issues/$3", "CreativeWork", "thing", "github:issue:$1/$2#$3", "GitHub $1/$2 #$3"),
    Site("github:pull", r"^github\.com$", rf"^/{_GITHUB}([^/]+)/([^/]+)/pull/(\d+)(?:/|$)", 0.98, "https://github.com/$1/$2/pull/$3", "CreativeWork", "thing", "github:pull:$1/$2#$3", "GitHub $1/$2 #$3"),
    Site("github:commit", r"^github\.com$", rf"^/{_GITHUB}([^/]+)/([^/]+)/commit/([^/]+)", 0.98, "https://github.com/$1/$2/commit/$3", "SoftwareSourceCode", "software", "github:commit:$1/$2@$3", "GitHub $1/$2@$3"),
    Site("github:repo", r"^github\.com$", rf"^/{_GITHUB}([^/]+)/([^/]+)(?:/(?:blob|tree)(?:/.*)?)?$", 0.97, "https://github.com/$1/$2", "SoftwareSourceCode", "software", "github:repo:$1/$2", "$1/$2"),
    Site("github:profile", r"^github\.com$", rf"^/{_GITHUB}([^/]+)$", 0.92, "https://github.com/$1", "SocialMediaAccount", "person", "github:user:$1", "GitHub @$1"),
    Site("npm:package", r"^(?:www\.)?npmjs\.(?:com|org)$", r"^/package/((?:@|%40)[^/]+/[^/]+|[^@%/][^/]*)", 0.99, "https://www.npmjs.com/package/$1", "SoftwareSourceCode", "software", "npm:package:$1", "$1 on npm"),
    Site("youtube:video", r"^(?:www\.)?youtu\.be$", r"^/([A-Za-z0-9_-]{11})(?:/|$)", 0.99, _VIDEO, "VideoObject", "thing", "youtube:video:$1", "YouTube Video $1"),
    Site("youtube:video", _TUBE, r"^\?(?:(?!v=)[^&]*&)*v=([A-Za-z0-9_-]{11})(?:&|$)", 0.99, _VIDEO, "VideoObject", "thing", "youtube:video:$1", "YouTube Video $1", "query"),
    Site("youtube:video", _TUBE, r"^/(?:shorts|embed)/([A-Za-z0-9_-]{11})(?:/|$)", 0.99, _VIDEO, "VideoObject", "thing", "youtube:video:$1", "YouTube Video $1"),
    *(Site(f"spotify:{kind}", r"spotify\.com$", rf"^/{kind}/([^/]+)", 0.99, f"https://open.spotify.com/{kind}/$1", schema, category, f"spotify:{kind}:$1", f"Spotify {kind.capitalize()} $1") for kind, schema, category in _SPOTIFY),
    Site("x:post", r"(?:^|\.)(?:x|twitter)\.com$", rf"^/{_X}([^/@][^/]*)/status/([^/]+)", 0.98, "https://x.com/$1/status/$2", "SocialMediaPosting", "thing", "x:post:$2", "Post by @$1"),
    Site("x:profile", r"(?:^|\.)(?:x|twitter)\.com$", rf"^/{_X}([^/@][^/]*)", 0.92, "https://x.com/$1", "SocialMediaAccount", "person", "x:user:$1", "X @$1"),
    Site("instagram:post", r"instagram\.com", r"^/p/([^/]+)", 0.97, "https://www.instagram.com/p/$1", "ImageObject", "thing", "instagram:post:$1", "Instagram Post $1"),
    Site("instagram:video", r"instagram\.com", r"^/(reel|tv)/([^/]+)", 0.97, "https://www.instagram.com/$1/$2", "VideoObject", "thing", "instagram:video:$2", "Instagram Video $2"),
    Site("instagram:profile", r"instagram\.com", r"^/(?!(?:explore|stories)(?:/|$))([^/]+)", 0.9, "https://www.instagram.com/$1", "SocialMediaAccount", "person", "instagram:user:$1", "Instagram @$1"),
    Site("tiktok:video", r"tiktok\.com", r"^/@([^/]*)/video/([^/]+)", 0.98, "https://www.tiktok.com/@$1/video/$2", "VideoObject", "thing", "tiktok:video:$2", "TikTok Video $2"),
    Site("tiktok:profile", r"tiktok\.com", r"^/@([^/]*)", 0.91, "https://www.tiktok.com/@$1", "SocialMediaAccount", "person", "tiktok:user:$1", "TikTok @$1"),
    Site("wikipedia:article", r"wikipedia\.org", r"^/wiki/(.+)$", 0.95, "https://$host/wiki/$1", "Thing", "thing", "wikipedia:$1", "$1"),
    Site("imdb:title", r"imdb\.com", r"^/title/(tt\d+)(?:/|$)", 0.98, "https://www.imdb.com/title/$1/", "Movie", "thing", "imdb:title:$1", "IMDb Title $1"),
    Site("imdb:person", r"imdb\.com", r"^/name/(nm\d+)(?:/|$)", 0.97, "https://www.imdb.com/name/$1/", "SocialMediaAccount", "person", "imdb:name:$1", "IMDb Person $1"),
    Site("tmdb:movie", r"^(?:www\.)?themoviedb\.org$", r"^/movie/(\d+)", 0.99, "https://www.themoviedb.org/movie/$1", "Movie", "thing", "tmdb:movie:$1", "TMDB Movie $1"),
    Site("tmdb:tv", r"^(?:www\.)?themoviedb\.org$", r"^/tv/(\d+)", 0.99, "https://www.themoviedb.org/tv/$1", "TVSeries", "thing", "tmdb:tv:$1", "TMDB TV Series $1"),
    Site("amazon:product", _AMAZON, _ASIN, 0.96, "https://$host/dp/$1", "Product", "product", "asin:$1", "Amazon Product $1"),
    Site("amazon:product", _AMAZON, r"(?i)[?&]asin=([A-Z0-9]{10})(?:&|$)", 0.96, "https://$host/dp/$1", "Product", "product", "asin:$1", "Amazon Product $1", "query"),
    Site("amazon:store", _AMAZON, r"^(.*/stores/.*)$", 0.9, "https://$host$1", "Organization", "company", "amazon:store:$1", "Amazon Storefront"),
    Site("amazon:product", r"^(?:www\.)?(?:a\.co|amzn\.(?:asia|eu|in|to))$", r"^(.*)$", 0.7, "https://$host$1", "Product", "product", "asin:$1", "Amazon Product"),
)
DEFAULT_CONFIDENCE = 0.72
#: Endings of file names that are no domains.
FILE_ENDINGS = "cjs|conf|config|css|csv|env|html|ini|js|json|jsx|lock|log|md|mdx|mjs|scss|toml|ts|tsx|txt|xml|yaml|yml"
#: What a title of an encyclopedia says of its subject.
TOPICS = ((r"\(software\)", "SoftwareApplication", "software"), (r"\((?:company|organization)\)", "Organization", "company"), (r"\((?:city|country|place)\)", "Place", "place"), (r"\(person\)", "Person", "person"))
_KIND = "struct<class:string,confidence:double,canonical:string,schema_type:string,category:string,canonical_id:string,title:string>"


def entity(name: str | Column, confidence: float, canonical: Column, schema_type: str | Column, category: str | Column, canonical_id: Column, title: Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(*map(lit, (name, confidence, canonical, schema_type, category, canonical_id, title))).cast(_KIND)


def _filled(template: str, subject: Column, pattern: str, host: Column, change: Callable[[Column], Column] = lambda c: c) -> Column:
    """A template with its groups filled in."""
    out, at = [], 0
    for begin, end, name in [(i, i + (5 if template.startswith("$host", i) else 2), template[i + 1 : i + (5 if template.startswith("$host", i) else 2)]) for i in range(len(template)) if template[i] == "$"]:
        out += [F.lit(template[at:begin])] if begin > at else []
        out.append(host if name == "host" else change(F.regexp_extract(subject, pattern, int(name))))
        at = end
    return F.concat(*out, F.lit(template[at:]))


def _site(u: Column, default: Column) -> Column:
    """The entity of an address: of the classes that match, the surest."""
    subject = {"path": F.regexp_replace(F.regexp_replace(u["path"], "/+", "/"), "/$", ""), "query": u["query"]}

    def of(s: Column) -> Column:
        pick = F
        for p in sorted(SITES, key=lambda p: -p.confidence):
            if p.confidence < DEFAULT_CONFIDENCE:
                continue  # an address is at least a website
            text = s[p.of]
            upper = F.upper if p.name == "amazon:product" else lambda c: c
            lower = F.lower if p.name in ("github:profile", "npm:package", "x:profile", "instagram:profile", "tiktok:profile") else upper
            schema, category = F.lit(p.schema_type), F.lit(p.category)
            title = _filled(p.title, text, p.pattern, u["host"], upper)
            if p.name == "wikipedia:article":
                title = F.translate(F.coalesce(F.try_url_decode(F.replace(title, F.lit("+"), F.lit("%2B"))), title), "_", " ")
                for pattern, topic, of_kind in reversed(TOPICS):
                    schema, category = (F.when(F.lower(title).rlike(pattern), x).otherwise(y) for x, y in ((topic, schema), (of_kind, category)))
                named = F.concat(F.lit("wikipedia:"), slugify(title))
            else:
                named = _filled(p.canonical_id, text, p.pattern, u["host"], lower)
            pick = pick.when(u["host"].rlike(p.host) & text.rlike(p.pattern), entity(p.name, p.confidence, _filled(p.canonical, text, p.pattern, u["host"], upper), schema, category, named, title))
        return pick.otherwise(default)

    return let(F.struct(subject["path"].alias("path"), subject["query"].alias("query")), of)


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def website(raw: Column) -> Column:
    """The canonical address of an http(s) address or a bare host name: sentence marks at its end, the fragment and a slash at the end go; null for anything else."""
    marks = F.regexp_replace(F.trim(raw), r"[.,!?;:]+$", "")
    trimmed = F.when(marks.rlike(r"[(\[{]"), marks).otherwise(F.regexp_replace(marks, r"[)\]}.,!?;:]+$", ""))
    host = r"(?:localhost|\d{1,3}(?:\.\d{1,3}){3}|(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,63})(?::\d+)?(?:[/?#].*)?"

    def of(s: Column) -> Column:
        bare = s.rlike(rf"^{host}$") & ~s.rlike(r"[\s@]|://") & ~F.regexp_extract(s, r"^[^/?#:]*", 0).rlike(rf"(?i)\.(?:{FILE_ENDINGS})$")
        full = F.when(s.rlike(r"(?i)^https?:"), s).when(bare, F.concat(F.lit("https://"), s))
        return let(address(F.regexp_replace(full, "#.*$", "")), lambda u: F.regexp_replace(u["href"], "/$", ""))

    return let(trimmed, of)


def classify(df: DataFrame, value: str) -> DataFrame:
    """df with class, confidence, canonical, schema_type, category, canonical_id and title of the input in a column; all null where nothing takes it.

    Of all classifiers that take an input the surest one wins: known platforms, then book
    numbers and chain addresses, websites, single words and phrases. Everything follows
    from the input itself.
    """
    raw = F.trim(F.regexp_replace(value, r"\s+", " "))

    def of(s: Column) -> Column:
        chain = F.regexp_replace(F.lower(s), "^ethereum:", "")
        subtype = F.when(chain.startswith("erc20:"), "erc20").when(chain.startswith("contract:"), "smart-contract").otherwise("account")
        bare = F.regexp_replace(chain, "^(?:erc20|contract|account):", "")
        on_chain = r"^(?:eip155:([1-9]\d*):)?(0x[0-9a-f]{40})$"
        schema = F.when(subtype == "erc20", "EthereumERC20").when(subtype == "smart-contract", "EthereumSmartContract").otherwise("EthereumAccount")
        number = F.upper(F.regexp_replace(F.regexp_replace(s, r"(?i)^isbn(?::|\s)+", ""), r"[-\s]", ""))
        book = lambda digits, c: entity(f"isbn:isbn-{digits}", c, F.concat(F.lit("https://www.worldcat.org/isbn/"), number), "Book", "thing", F.concat(F.lit("isbn:"), number), F.concat(F.lit("Book (ISBN "), number, F.lit(")")))
        holder = F.regexp_extract(bare, on_chain, 2)
        words = F.size(F.split(s, " "))
        text = ~s.rlike(r"^[{\[]") & ~s.contains("://") & (s != "")
        phrase = lambda name, c: entity(name, c, F.lit(None), "Thing", "thing", F.lit(None), s)
        site = let(website(s), lambda w: F.when(w.isNotNull(), entity("web:website", DEFAULT_CONFIDENCE, w, "WebSite", "thing", w, F.concat(F.lit("Website "), F.regexp_replace(F.regexp_extract(w, _AUTHORITY, 2), r"^www\.", "")))))
        others = (
            F.when(bare.rlike(on_chain), entity(F.concat(F.lit("ethereum:"), subtype), 0.99, holder, schema, "thing", F.concat(F.lit("eip155:"), F.coalesce(F.nullif(F.regexp_extract(bare, on_chain, 1), F.lit("")), F.lit("1")), F.lit(":"), holder), holder))
            .when(number.rlike(r"^97[89]\d{10}$"), book(13, 0.98)).when(number.rlike(r"^\d{9}[\dX]$"), book(10, 0.97))
            .when(s.rlike(r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.eth$"), entity("ethereum:ens-name", 0.94, F.lower(s), "EthereumAccount", "thing", F.lower(s), F.lower(s)))
            .otherwise(F.coalesce(site, F.when(text & (words <= 1), phrase("plain-text:word", 0.64)).when(text, phrase("plain-text:phrase", 0.61))))
        )
        return let(address(s), lambda u: F.when(u["host"].isNotNull() & u["scheme"].isin(*SPECIAL), _site(u, others)).otherwise(others))

    out = df.withColumn("_found", let(raw, of))
    return out.select(*df.columns, "_found.*")


#: Types with their category, required, recommended and identifying fields.
TYPES = (
    ("Book", "thing", ("name",), ("isbn", "sameAs"), ("isbn",)),
    ("DefinedTerm", "thing", ("name",), ("description", "sameAs"), ("termCode", "sameAs")),
    ("ImageObject", "thing", ("name",), ("contentUrl", "sameAs"), ("sameAs",)),
    ("Movie", "thing", ("name",), ("datePublished", "sameAs"), ("sameAs",)),
    ("MusicAlbum", "song", ("name",), ("byArtist", "sameAs"), ("sameAs",)),
    ("MusicGroup", "song", ("name",), ("sameAs",), ("sameAs",)),
    ("MusicRecording", "song", ("name",), ("byArtist", "inAlbum"), ("sameAs",)),
    ("Organization", "company", ("name",), ("url", "sameAs"), ("identifier", "sameAs")),
    ("Person", "person", ("name",), ("description", "sameAs"), ("sameAs",)),
    ("Place", "place", ("name",), ("address", "sameAs"), ("sameAs",)),
    ("PodcastEpisode", "podcast", ("name",), ("description", "partOfSeries", "datePublished", "url", "sameAs"), ("url", "sameAs")),
    ("PodcastSeries", "podcast", ("name",), ("description", "publisher", "url", "sameAs"), ("url", "sameAs")),
    ("Product", "product", ("name",), ("brand", "offers", "sameAs"), ("gtin", "sku")),
    ("SocialMediaPosting", "thing", ("name",), ("datePublished", "author", "sameAs"), ("sameAs",)),
    ("SoftwareApplication", "software", ("name",), ("applicationCategory", "operatingSystem", "sameAs"), ("sameAs",)),
    ("SoftwareSourceCode", "software", ("name",), ("codeRepository", "sameAs"), ("sameAs",)),
    ("TVSeries", "thing", ("name",), ("sameAs",), ("sameAs",)),
    ("Thing", "thing", ("name",), ("description", "sameAs"), ("identifier", "sameAs")),
    ("VideoObject", "thing", ("name",), ("contentUrl", "sameAs"), ("sameAs",)),
    ("WebSite", "thing", ("name",), ("url", "sameAs"), ("url", "sameAs")),
)


def with_profile(df: DataFrame, schema_type: str = "schema_type") -> DataFrame:
    """df with profile_category, required, recommended and identity of a type; unknown types get Thing's."""
    rows = df.sparkSession.createDataFrame([(t, c, list(r), list(m), list(i)) for t, c, r, m, i in TYPES], "_type string, profile_category string, required array<string>, recommended array<string>, identity array<string>")
    known = F.when(F.col(schema_type).isin(*[t[0] for t in TYPES]), F.col(schema_type)).otherwise("Thing")
    return df.withColumn("_known", known).join(F.broadcast(rows), F.col("_known") == F.col("_type"), "left").drop("_known", "_type")


def plugin_order(plugins: list[tuple[str, int, tuple[str, ...]]]) -> list[str]:
    """Names of (name, priority, dependencies), a small registry, in running order: of those whose dependencies have run, the lowest priority, then name, comes next."""
    waiting = {name: set(needs) for name, _, needs in plugins}
    if unknown := {x for needs in waiting.values() for x in needs} - waiting.keys():
        raise ValueError(f"unknown dependencies: {sorted(unknown)}")
    ready = sorted((priority, name) for name, priority, needs in plugins if not needs)
    priorities, order = {name: priority for name, priority, _ in plugins}, []
    while ready:
        _, name = ready.pop(0)
        order.append(name)
        freed = [x for x, needs in waiting.items() if name in needs and needs.issubset(order)]
        ready = sorted([*ready, *((priorities[x], x) for x in freed)])
    if len(order) < len(plugins):
        raise ValueError(f"dependency cycle: {sorted(waiting.keys() - set(order))}")
    return order
