"""Atom intelligence as column expressions: parse, classify, extract page metadata, decide."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.columns import let
from termloom.operators.sites import address

MAX_INPUT = 16_384
#: Fixed patterns of the detectors, in the order in which they are tried.
IPFS = r"^(?:ipfs://|/ipfs/)(Qm[1-9A-HJ-NP-Za-km-z]{44}|b[a-z2-7]{58,})(/.*)?$"
ADDRESS = r"^0x[0-9a-fA-F]{40}$"
ENS = r"^(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+eth$"
GATEWAY = "https://ipfs.io/ipfs/"


def isbn10_ok(s: Column) -> Column:
    """Mod-11 check of ten characters, the last of which may be X."""
    digit = lambda i: F.when(F.substring(s, i, 1).isin("X", "x"), 10).otherwise(F.expr("0") + F.substring(s, i, 1).try_cast("int"))
    total = reduce(lambda a, b: a + b, [digit(i) * (11 - i) for i in range(1, 11)])
    return s.rlike("^[0-9]{9}[0-9Xx]$") & (total % 11 == 0)


def isbn13_ok(s: Column) -> Column:
    total = reduce(lambda a, b: a + b, [F.substring(s, i, 1).try_cast("int") * (1 if i % 2 else 3) for i in range(1, 14)])
    return s.rlike("^97[89][0-9]{10}$") & (total % 10 == 0)


def is_json(s: Column) -> Column:
    """Objects and arrays only; scalars are not JSON here."""
    return s.rlike(r"^\s*[\[{]") & F.try_parse_json(s).isNotNull()


def parse(df: DataFrame, column: str) -> DataFrame:
    """df with kind, normalized, canonical, gateway_url, url (see sites.address) and error of the atom input in column.

    Kinds are tried in a fixed order; the first that holds wins. Empty or over-long input
    has an error instead. Everything stays in the JVM; the checksum form of addresses is
    functions.keccak.checksum_of().
    """
    raw = F.col(column)
    error = F.when(raw.isNull() | (F.trim(F.regexp_replace(raw, r"\s+", " ")) == ""), "empty").when(F.length(raw) > MAX_INPUT, "too_long")

    def kind_of(s: Column, bare: Column, url: Column) -> Column:
        return (
            F.when(s.rlike(IPFS), "ipfs").when(s.rlike(ADDRESS), "ethereum_address").when(F.lower(s).rlike(ENS), "ens_name").when(is_json(s), "json")
            .when(url.isNotNull(), "url").when(isbn10_ok(bare) | isbn13_ok(bare), "isbn").otherwise("plain_string")
        )

    def form_of(p: Column) -> Column:
        kind, s = p["kind"], p["normalized"]
        place = F.concat(F.regexp_extract(s, IPFS, 1), F.regexp_replace(F.regexp_replace(F.regexp_extract(s, IPFS, 2), "^/+", "/"), "/+$", ""))
        canonical = F.when(kind == "ipfs", F.concat(F.lit("ipfs://"), place)).when(kind.isin("ethereum_address", "ens_name"), F.lower(s)).when(kind == "url", p["url"]["href"]).when(kind == "isbn", F.upper(F.regexp_replace(s, "[- ]", ""))).otherwise(s)
        return F.struct(kind.alias("kind"), s.alias("normalized"), canonical.alias("canonical"), F.when(kind == "ipfs", F.concat(F.lit(GATEWAY), place)).alias("gateway_url"), F.when(kind == "url", p["url"]).alias("url"))

    def parsed(s: Column) -> Column:
        return let(F.struct(F.regexp_replace(s, "[- ]", "").alias("bare"), address(s).alias("url")), lambda x: F.struct(kind_of(s, x["bare"], x["url"]).alias("kind"), s.alias("normalized"), x["url"].alias("url")))

    whole = let(let(F.regexp_replace(raw, r"^\s+|\s+$", ""), parsed), form_of)
    out = df.withColumn("_e", error).withColumn("_p", F.when(F.col("_e").isNull(), whole))
    return out.select(*df.columns, "_p.*", F.col("_e").alias("error"))


def decode_entities(c: Column) -> Column:
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(text))
    return c


def meta_tags(html: Column) -> Column:
    """The meta tags of a page that have a key (property, else name, in lower case) and content, in their order: array of struct(key, content). Values stand in either kind of quotes and may hold the other."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>"), F.lit(0))
    pair = r"([:\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"

    def read(tag: Column) -> Column:
        names, double, single = (F.regexp_extract_all(tag, F.lit(pair), F.lit(k)) for k in (1, 2, 3))
        attributes = F.arrays_zip(F.transform(names, F.lower).alias("name"), double.alias("a"), single.alias("b"))
        last = lambda all_of, name: F.try_element_at(F.transform(F.filter(all_of, lambda x: x["name"] == name), lambda x: F.concat(F.coalesce(x["a"], F.lit("")), F.coalesce(x["b"], F.lit("")))), F.lit(-1))
        return let(attributes, lambda t: F.struct(F.lower(F.coalesce(last(t, "property"), last(t, "name"))).alias("key"), last(t, "content").alias("content")))

    return F.filter(F.transform(tags, read), lambda t: (t["key"] != "") & (t["content"] != ""))


def meta_content(tags: Column, key: str) -> Column:
    """The content of the last of meta_tags() with a key; null if there is none."""
    return F.try_element_at(F.filter(tags, lambda t: t["key"] == key), F.lit(-1))["content"]


def title_tag(html: Column) -> Column:
    return F.nullif(F.trim(decode_entities(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def open_graph(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df with title, description, image, og_url, site_name, type, locale, audio and audio_type of a page; of several tags of a key the last counts."""
    tags = F.col("_tags")
    first = lambda *keys: F.coalesce(*[meta_content(tags, k) for k in keys])
    found = {
        "title": F.coalesce(meta_content(tags, "og:title"), title_tag(F.col(html))), "description": meta_content(tags, "og:description"), "image": meta_content(tags, "og:image"), "og_url": F.coalesce(meta_content(tags, "og:url"), F.col(url)),
        "site_name": meta_content(tags, "og:site_name"), "type": meta_content(tags, "og:type"), "locale": meta_content(tags, "og:locale"),
        "audio": first("og:audio:secure_url", "og:audio:url", "og:audio", "twitter:player:stream", "music:preview_url:url", "music:preview_url"),
        "audio_type": first("og:audio:type", "twitter:player:stream:content_type", "music:preview_url:type"),
    }
    return df.withColumn("_tags", meta_tags(F.col(html))).withColumns(found).drop("_tags")


def fnv1a32(c: Column) -> Column:
    """32-bit FNV-1a over a string's UTF-8 bytes, in eight hex digits."""
    codes = F.transform(F.filter(F.split(F.regexp_replace(F.hex(c.cast("binary")), "(..)", "$1,"), ","), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    # 16777619 = 2^24 + 403; the product is taken modulo 2^32, which stays below 2^63
    total = F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, x: h.bitwiseXOR(x) * 16777619 % 4294967296)
    return F.lower(F.lpad(F.hex(total), 8, "0"))


def stable_json(c: Column) -> Column:
    """A JSON object of one level as text with its keys in order, nulls left out; null for anything else."""
    pairs = F.from_json(c, "map<string,string>")
    keys = F.array_sort(F.map_keys(F.map_filter(pairs, lambda k, v: v.isNotNull())))
    return F.when(F.trim(c).startswith("{"), F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(pairs, k)))))


def clamp(c: Column) -> Column:
    """c within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
