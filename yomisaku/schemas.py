"""Schemas of the stored tables and of the landed files.

Every timestamp is a zone-less UTC wall clock (``TIMESTAMP_NTZ``), so results do not depend on the
session time zone.
"""

from pyspark.sql import types as T

SITES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("name", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("group_id", T.StringType(), False),
    T.StructField("last_crawled_at", T.TimestampNTZType()),
    T.StructField("last_modified", T.TimestampNTZType()),
])

POSTS = T.StructType([
    T.StructField("site_id", T.StringType(), False),
    T.StructField("post_id", T.LongType(), False),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("excerpt", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("published_at", T.TimestampNTZType()),
    T.StructField("modified_at", T.TimestampNTZType()),
    T.StructField("categories", T.StringType()),
    T.StructField("tags", T.StringType()),
])

_RENDERED = T.StructType([T.StructField("rendered", T.StringType())])

# One element of a posts API body.
POST_JSON = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("link", T.StringType()),
    T.StructField("title", _RENDERED),
    T.StructField("content", _RENDERED),
    T.StructField("excerpt", _RENDERED),
    T.StructField("date", T.StringType()),
    T.StructField("date_gmt", T.StringType()),
    T.StructField("modified", T.StringType()),
    T.StructField("modified_gmt", T.StringType()),
    T.StructField("_embedded", T.StructType([
        T.StructField("author", T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))),
        T.StructField("wp:term", T.ArrayType(T.ArrayType(T.StructType([
            T.StructField("taxonomy", T.StringType()),
            T.StructField("name", T.StringType()),
        ])))),
    ])),
])

# One landed line: the post, the site it came from and its place in the crawl.
LANDED_POST = T.StructType(
    [T.StructField("site_id", T.StringType()), T.StructField("seq", T.LongType())]
    + POST_JSON.fields
)

SITE_CFG = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("post_type", T.StringType()),
    T.StructField("extra_params", T.MapType(T.StringType(), T.StringType())),
    T.StructField("scrape", T.StructType([
        T.StructField("archive_url", T.StringType()),
        T.StructField("link_re", T.StringType()),
    ])),
])

RESPONSE = T.StructType([
    T.StructField("site_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("total_pages", T.StringType()),
    T.StructField("total", T.StringType()),
    T.StructField("body", T.StringType()),
])

PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("content_type", T.StringType()),
    T.StructField("html", T.StringType()),
])

SEARCH = T.StructType([
    T.StructField("query_id", T.LongType(), False),
    T.StructField("q", T.StringType()),
    T.StructField("site_ids", T.ArrayType(T.StringType())),
    T.StructField("group_id", T.StringType()),
    T.StructField("categories", T.ArrayType(T.StringType())),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("widgets_only", T.BooleanType()),
    T.StructField("sort", T.StringType()),
    T.StructField("lim", T.IntegerType()),
    T.StructField("off", T.IntegerType()),
])

WIDGET_POST_ID = -1  # fixed value: the row of a site's text around its articles
