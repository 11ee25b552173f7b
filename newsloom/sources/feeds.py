"""Feed documents (RSS and Atom), web listings, registries and seed files as tables.

A feed document is a row with its whole text: `spark.read.text(path, wholetext=True)`, or a landing table. Parsing is
regular expressions in the JVM; only numeric character references need a small pandas function.
"""

from __future__ import annotations

import html as html_lib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import canonical_url, collapse, distinct_ignoring_case, seed_slug, text
from newsloom.operators.rank import top_k
from newsloom.operators.relational import first_of

# Named character references of feeds.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "#39": "'", "nbsp": " "}
DATE_FORMATS = ["d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mmXXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd"]


@F.pandas_udf(T.StringType())
def decode_references(values: pd.Series) -> pd.Series:
    """Decimal and hexadecimal character references; anything else stays."""
    return values.str.replace(r"&#(?:x[0-9a-fA-F]+|\d+);", lambda m: html_lib.unescape(m.group(0)), regex=True)


def clean(c: Column, numeric: bool = True) -> Column:
    """Without CDATA marks and tags; references decoded; white space collapsed."""
    out = F.regexp_replace(text(c), r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    for name, value in NAMED.items():
        out = F.regexp_replace(out, f"&{name};", value)
    return collapse(decode_references(out) if numeric else out)


def tag(block: Column, *names: str) -> Column:
    """The raw content of the first element of these names, in their order; null if there is none."""
    found = [F.nullif(F.regexp_extract(block, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), F.lit("")) for n in names]
    return F.coalesce(*found)


def parse_date(c: Column) -> Column:
    """The first format that fits; null otherwise. The day of the week isn't looked at."""
    value = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9}\.?,?\s+(?=\d)", ""), r"\b(GMT|UTC|UT|Z)$", "+0000")
    value = F.when(F.contains(value, F.lit("T")), F.regexp_replace(value, r"([+-]\d\d):?(\d\d)$", "$1:$2")).otherwise(value)
    return F.coalesce(*[F.try_to_timestamp(value, F.lit(f)) for f in DATE_FORMATS])


def feed_items(documents: DataFrame, feed: str = "feed", content: str = "content", numeric: bool = True) -> DataFrame:
    """A row for each item of each document: feed, ordinal, title, url, published_at, source, summary, tags.

    A document with both <feed and <entry is Atom, else RSS; if it has no block of its kind, those of the other count.
    Items without a title are dropped; a missing date is null.
    """
    body = text(F.col(content))
    blocks = lambda n: F.regexp_extract_all(body, F.lit(rf"(?is)(<{n}\b.*?</{n}>)"), F.lit(1))
    atom = body.rlike("(?i)<feed") & body.rlike("(?i)<entry")
    first, second = F.when(atom, blocks("entry")).otherwise(blocks("item")), F.when(atom, blocks("item")).otherwise(blocks("entry"))
    rows = documents.select(F.col(feed).alias("feed"), F.posexplode(F.when(F.size(first) > 0, first).otherwise(second)).alias("ordinal", "block"))
    b = F.col("block")
    attribute = lambda pattern: F.nullif(F.regexp_extract(b, pattern, 1), F.lit(""))
    guid = F.when(~b.rlike(r"(?i)isPermaLink\s*=\s*[\"']false"), tag(b, "guid"))
    link = F.coalesce(
        attribute(r"(?is)<link\b(?=[^>]*rel=[\"']alternate[\"'])[^>]*href=[\"']([^\"']+)"), attribute(r"(?is)<link\b[^>]*href=[\"']([^\"']+)"), tag(b, "link"), guid
    )
    dates = [parse_date(clean(tag(b, n), False)) for n in ("pubDate", "published", "updated", "issued")]
    labels = lambda p: F.regexp_extract_all(b, F.lit(p), F.lit(1))
    raw = F.concat(
        labels(r"(?is)<category\b[^>]*?term=[\"']([^\"']*)"), labels(r"(?is)<category\b[^>]*?label=[\"']([^\"']*)"), labels(r"(?is)<category\b[^>]*>([^<].*?)</category>"),
        labels(r"(?is)<dc:subject\b[^>]*>(.*?)</dc:subject>"), F.split(F.coalesce(tag(b, "media:keywords"), F.lit("")), ","),
    )
    summary = F.array_distinct(F.filter(F.array(*[clean(tag(b, n), numeric) for n in ("description", "summary", "content:encoded", "content", "media:description")]), lambda s: s != ""))
    out = rows.select(
        "feed", "ordinal", clean(tag(b, "title"), numeric).alias("title"), clean(link, False).alias("url"), F.coalesce(*dates).alias("published_at"),
        F.nullif(clean(F.coalesce(tag(b, "source"), tag(tag(b, "author"), "name")), numeric), F.lit("")).alias("source"), F.nullif(F.array_join(summary, " "), F.lit("")).alias("summary"),
        distinct_ignoring_case(F.transform(raw, lambda x: clean(x, False))).alias("tags"),
    )
    return out.where(F.col("title") != "")


def listing_links(pages: DataFrame, url: str = "url", html: str = "html", hosts: list[str] | None = None, slug_pattern: str | None = None, junk_pattern: str | None = None, limit: int = 60) -> DataFrame:
    """page, ordinal, link, title: the links of listing pages, absolute, of the wanted hosts, the first of each url, up to the limit of a page."""
    anchors = F.regexp_extract_all(text(F.col(html)), F.lit(r"(?is)(<a\b[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>)"), F.lit(1))
    rows = pages.select(F.col(url).alias("page"), F.posexplode(anchors).alias("ordinal", "a"))
    href = F.regexp_extract("a", r"(?is)href=[\"']([^\"']*)", 1)
    origin = F.regexp_extract("page", "^([a-z]+://[^/?#]+)", 1)
    absolute = F.when(href.rlike("^[a-z]+://"), href).when(F.startswith(href, F.lit("//")), F.concat(F.lit("https:"), href)).when(F.startswith(href, F.lit("/")), F.concat(origin, href)).otherwise(F.concat(origin, F.lit("/"), href))
    out = rows.select("page", "ordinal", absolute.alias("link"), clean(F.col("a"), False).alias("title")).where("title <> ''")
    if hosts is not None:
        out = out.where(F.lower(F.regexp_extract("link", "^[a-z]+://([^/?#:]+)", 1)).isin(hosts))
    if slug_pattern:
        out = out.where(F.col("link").rlike(slug_pattern))
    if junk_pattern:
        out = out.where(~F.lower("title").rlike(junk_pattern))
    once = first_of(out, ["page", "link"], F.col("ordinal"))
    return top_k(once, ["page"], limit, F.col("ordinal")).drop("position")


def with_fallback(primary: DataFrame, broad: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """The primary rows, and for a page with fewer than `least` of them the broad ones too, each key once."""
    few = broad.join(primary.groupBy("page").agg(F.count(F.lit(1)).alias("_n")), "page", "left").where(F.coalesce("_n", F.lit(0)) < least).drop("_n")
    return first_of(primary.withColumn("_part", F.lit(0)).unionByName(few.withColumn("_part", F.lit(1))), keys, F.col("_part"), F.col("ordinal")).drop("_part")


def listing_date(html: Column) -> Column:
    """A datetime attribute, else a date in the text at noon; null without either."""
    attribute = F.regexp_extract(html, r"datetime=[\"']([^\"']+)", 1)
    day = F.regexp_extract(html, r"\b(20\d\d-\d\d-\d\d)\b", 1)
    return F.coalesce(parse_date(F.nullif(attribute, F.lit(""))), F.try_to_timestamp(F.concat(F.nullif(day, F.lit("")), F.lit(" 12:00:00")), F.lit("yyyy-MM-dd HH:mm:ss")))


def feed_registry(curated: DataFrame, discovered: DataFrame, blocked_hosts: list[str], weight: int = 3) -> DataFrame:
    """Feeds of both tables (sport, name, url, type) of type rss and not of a blocked host; of one sport and url the curated one."""
    both = curated.withColumn("_part", F.lit(0)).unionByName(discovered.withColumn("_part", F.lit(1)), allowMissingColumns=True)
    host = F.regexp_replace(F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1)), "^www\\.", "")
    usable = both.where((F.col("type") == "rss") & ~host.isin(blocked_hosts)).withColumn("_url", canonical_url(F.regexp_replace("url", "^https?://(www\\.)?", "")))
    return first_of(usable, ["sport", "_url"], F.col("_part"), F.col("name")).withColumn("weight", F.lit(weight)).drop("_part", "_url")


def seed_entities(spark: SparkSession, path: str, sport: str = "sport", kind: str = "type", name: str = "name", aliases: str = "aliases") -> DataFrame:
    """Entities of a header CSV: sport, type, name, slug, alias_of; the first of a slug, and a row for each further alias."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    raw = raw.select([F.col(c).alias(c.lower()) for c in raw.columns])
    missing = {sport, kind, name} - set(raw.columns)
    if missing:
        raise ValueError(f"the file has no column {', '.join(sorted(missing))}")
    base = raw.withColumn("ordinal", F.monotonically_increasing_id()).select(F.col(sport).alias("sport"), F.col(kind).alias("type"), F.col(name).alias("name"), seed_slug(F.col(name)).alias("slug"), "ordinal", (F.col(aliases) if aliases in raw.columns else F.lit(None).cast("string")).alias("aliases"))
    base = first_of(base, ["sport", "type", "slug"], F.col("ordinal"))
    listed = distinct_ignoring_case(F.split(F.coalesce("aliases", F.lit("")), "\\|"))
    more = base.withColumn("alias_of", F.col("slug")).withColumn("name", F.explode(F.filter(listed, lambda a: F.length(a) >= 2))).withColumn("slug", seed_slug(F.col("name")))
    return base.withColumn("alias_of", F.lit(None).cast("string")).unionByName(more).drop("aliases", "ordinal").dropDuplicates(["sport", "type", "slug"])


def feed_health(items: DataFrame, now: Column, unrelated: str, days: int = 7) -> DataFrame:
    """feed, items, valid (title and url), fresh (up to `days` old), unrelated (title matches the pattern)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros("published_at")
    return items.groupBy("feed").agg(
        F.count(F.lit(1)).alias("items"), F.count_if((F.col("title") != "") & (text(F.col("url")) != "")).alias("valid"),
        F.count_if(age <= days * 86_400_000_000).alias("fresh"), F.count_if(F.lower("title").rlike(unrelated)).alias("unrelated"),
    )

