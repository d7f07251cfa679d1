"""Column expressions over post fields: dates, links, ids, term lists."""

from pyspark.sql import Column, functions as F

EXCERPT_CHARS = 200   # fixed value

_ZONE = r"(Z|z|[+-]\d{2}:?\d{2})$"


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def pipe_join(names: Column) -> Column:
    """``|a|b|``, or '' for no names."""
    return F.when(F.size(names) > 0, F.concat(F.lit("|"), F.array_join(names, "|"), F.lit("|"))).otherwise("")


def pipe_split(text: Column) -> Column:
    """The names of a pipe list; NULL and '' give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda name: name != "")


def embedded_terms(embedded: Column, taxonomy: str) -> Column:
    """Names of the embedded terms of one taxonomy, in order, duplicates kept; NULL-safe."""
    terms = F.flatten(F.filter(embedded["wp:term"], lambda group: group.isNotNull()))
    named = F.filter(terms, lambda t: (t["taxonomy"] == taxonomy) & (t["name"] != ""))
    return F.coalesce(F.transform(named, lambda t: t["name"]), F.array().cast("array<string>"))


def first_author(embedded: Column) -> Column:
    return F.coalesce(F.try_element_at(embedded["author"], F.lit(1))["name"], F.lit(""))


def absolutize(link: Column, base_url: Column) -> Column:
    """A link starting with ``/`` gets the scheme and authority of the site, not its path."""
    host = F.concat(F.parse_url(base_url, F.lit("PROTOCOL")), F.lit("://"),
                    F.parse_url(base_url, F.lit("AUTHORITY")))
    link = F.coalesce(link, F.lit(""))
    return F.when(link.startswith("/") & (base_url != ""), F.concat(host, link)).otherwise(link)


def parse_utc(text: Column) -> Column:
    """ISO 8601 text to a UTC wall clock. Text without a zone is taken as UTC; bad text gives NULL."""
    text = F.trim(text)
    zone = F.regexp_extract(text, _ZONE, 1)
    local = F.regexp_replace(text, _ZONE, "").try_cast("timestamp_ntz")
    minutes = (F.regexp_extract(zone, r"(\d{2}):?(\d{2})", 1).try_cast("int") * 60
               + F.regexp_extract(zone, r"(\d{2}):?(\d{2})", 2).try_cast("int"))
    shift = F.when(zone.startswith("-"), minutes).otherwise(-minutes)
    return local + F.make_dt_interval(mins=F.coalesce(shift, F.lit(0)))


def first_date(gmt: Column, local: Column) -> Column:
    """The GMT field, or else the local one; blank counts as missing."""
    return F.coalesce(blank_to_null(gmt), blank_to_null(local))


def url_post_id(url: Column) -> Column:
    """A positive 60-bit id from the url: the first 15 hex digits of its md5."""
    return F.conv(F.substring(F.md5(url.cast("binary")), 1, 15), 16, 10).cast("bigint")


def normalize_article_url(href: Column) -> Column:
    """Exactly one trailing slash."""
    return F.concat(F.regexp_replace(href, "/+$", ""), F.lit("/"))


def strip_trailing_slashes(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def excerpt(text: Column, chars: int = EXCERPT_CHARS) -> Column:
    return F.substring(text, 1, chars)
