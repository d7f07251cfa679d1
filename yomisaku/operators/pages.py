"""Jobs over the page table: articles, dates, archive links, widget text."""

from pyspark.sql import Column, DataFrame, functions as F

from yomisaku import schemas
from yomisaku.functions.markup import page_fields
from yomisaku.functions.posts import (
    blank_to_null, excerpt, normalize_article_url, parse_utc, url_post_id)

WIDGET_LABEL = ("ウィジット (", ")")  # fixed value: around the site name


def read_fields(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by the fields of ``PAGE_FIELDS``; the HTML is read once."""
    kept = [c for c in pages.columns if c != "html"]
    return pages.select(*kept, page_fields(F.col("html")).alias("page")).select(*kept, "page.*")


def extract_articles(fields: DataFrame) -> DataFrame:
    kept = [c for c in fields.columns if c not in ("widget_text", "json_ld", "hrefs", "meta_published",
                                                   "meta_modified", "time_published")]
    published, modified = article_dates()
    return fields.select(*kept, published.alias("published"), modified.alias("modified"))


def _linked_data_dates(json_text: Column) -> Column:
    """Dates of one JSON-LD text: first filled datePublished and dateModified among its items."""
    data = F.try_parse_json(json_text)
    # A list counts item by item, an object by its @graph list if it has one. The path is a fixed value.
    items = F.coalesce(F.try_variant_get(data, "$", "array<variant>"),
                       F.try_variant_get(data, "$['@graph']", "array<variant>"),
                       F.when(data.isNotNull(), F.array(data)))

    def first(name):
        values = F.transform(items, lambda i: blank_to_null(F.try_variant_get(i, f"$.{name}", "string")))
        return F.try_element_at(F.filter(values, lambda v: v.isNotNull()), F.lit(1))
    return F.struct(first("datePublished").alias("published"), first("dateModified").alias("modified"))


def article_dates() -> tuple[Column, Column]:
    """Published and modified date texts: JSON-LD, then meta tags, then the first time tag."""
    dated = F.filter(F.transform("json_ld", _linked_data_dates),
                     lambda d: d["published"].isNotNull() | d["modified"].isNotNull())
    linked = F.try_element_at(dated, F.lit(1))
    return (F.coalesce(linked["published"], blank_to_null(F.col("meta_published")),
                       F.col("time_published")),
            F.coalesce(linked["modified"], blank_to_null(F.col("meta_modified"))))


def extract_dates(fields: DataFrame) -> DataFrame:
    published, modified = article_dates()
    kept = [c for c in fields.columns if c in ("page_id", "doc_id", "site_id", "url")]
    return fields.select(*kept, published.alias("published"), modified.alias("modified"))


def scraped_posts(articles: DataFrame, now: Column) -> DataFrame:
    """Post rows of scraped articles; pages without a title give none. ``now`` dates the undated."""
    published = F.coalesce(parse_utc(blank_to_null(F.col("published"))), now)
    return articles.filter(F.col("title") != "").select(
        "site_id",
        url_post_id(F.col("url")).alias("post_id"),
        "url",
        "title",
        excerpt(F.col("content")).alias("excerpt"),
        "content",
        F.lit("").alias("author"),
        published.alias("published_at"),
        F.coalesce(parse_utc(blank_to_null(F.col("modified"))), published).alias("modified_at"),
        F.lit("").alias("categories"),
        F.lit("").alias("tags"),
    )


def archive_links(archives: DataFrame, rules: DataFrame) -> DataFrame:
    """Article urls listed by each site's archive pages.

    ``archives`` has ``site_id`` and ``hrefs``, ``rules`` has ``site_id`` and ``link_re``, which must match
    from the start of the raw href.
    """
    links = archives.select("site_id", F.explode("hrefs").alias("href"))
    matched = links.join(rules, "site_id").filter(
        F.expr("regexp_like(href, concat('^(?:', link_re, ')'))"))
    return matched.select("site_id", normalize_article_url(F.col("href")).alias("url")).distinct()


def widget_text(fields: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Text around the article, whole unless ``max_chars`` is given; blank unless the page was a fetched HTML page."""
    usable = (F.col("status") == 200) & F.lower("content_type").contains("html")
    kept = F.col("widget_text") if max_chars is None else excerpt(F.col("widget_text"), max_chars)
    text = F.when(usable, kept).otherwise("")
    return fields.select("url", F.coalesce(text, F.lit("")).alias("widget_text"))


def widget_rows(sites: DataFrame, sources: DataFrame, texts: DataFrame, now: Column) -> DataFrame:
    """One row per site with widget text.

    ``sources`` has the page each site's text comes from (``site_id``, ``url``); sites without one use
    their own url. ``texts`` has ``url`` and ``widget_text``.
    """
    source = sites.join(sources.withColumnRenamed("site_id", "id").withColumnRenamed("url", "source"),
                        "id", "left")
    source = source.select("id", "name", F.coalesce("source", "url").alias("url"))
    label = F.concat(F.lit(WIDGET_LABEL[0]), F.col("name"), F.lit(WIDGET_LABEL[1]))
    return source.join(texts, "url").filter(F.col("widget_text") != "").select(
        F.col("id").alias("site_id"),
        F.lit(schemas.WIDGET_POST_ID).cast("bigint").alias("post_id"),
        "url",
        label.alias("title"),
        excerpt(F.col("widget_text")).alias("excerpt"),
        F.col("widget_text").alias("content"),
        F.lit("").alias("author"),
        now.alias("published_at"),
        now.alias("modified_at"),
        F.lit("").alias("categories"),
        F.lit("").alias("tags"),
    )
