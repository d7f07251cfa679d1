"""Reading landed files: posts API bodies, pages, response logs, run history."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from yomisaku import schemas
from yomisaku.functions.posts import blank_to_null, strip_trailing_slashes

DEFAULT_GROUP = "backlink"  # fixed value
_POSTS = T.ArrayType(schemas.POST_JSON)


_BLANKS = r"^[ \t\r\n]+"  # what JSON takes for white space
_REST = "_unreadable"


def _lines(read, path: str) -> DataFrame:
    schema = T.StructType([*schemas.LANDED_POST.fields, T.StructField(_REST, T.StringType())])
    return read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _REST).json(path)


def read_posts_json(spark: SparkSession, path: str) -> DataFrame:
    """Landed posts, one JSON object per line, with their site and arrival sequence."""
    return _lines(spark.read, path).filter(F.col(_REST).isNull()).drop(_REST)


def unreadable_posts(spark: SparkSession, path: str) -> DataFrame:
    """The landed lines that are no posts: their text as ``body``, what is known of the site, and the file they are in."""
    rest = _lines(spark.read, path).select("site_id", F.col(_REST).alias("body"), F.input_file_name().alias("file"))
    return rest.filter("body is not null")


def _parsed(bodies: DataFrame, body: str) -> DataFrame:
    text = F.regexp_replace(body, _BLANKS, "")
    wrapped = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]")))
    return bodies.withColumn("_posts", F.when(text != "", F.from_json(wrapped, _POSTS)))


def _is_post(p: Column) -> Column:
    return p.isNotNull() & p["id"].isNotNull()


def parse_posts(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Parse a column of posts API bodies (one object or an array of them): one row per post.

    What is no post gives no row here, but one in ``rejected_bodies``.
    """
    posts = _parsed(bodies, body).withColumn("post", F.explode(F.filter("_posts", _is_post)))
    return posts.drop(body, "_posts").select("*", "post.*").drop("post")


def rejected_bodies(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The bodies that hold something else than posts, with ``reason``: ``missing``, ``malformed`` or ``no_post``.

    ``no_post`` is valid JSON with an element that is no object with an id; Spark reads no post of an array that holds
    anything but objects. An empty array holds nothing and is no reject.
    """
    whole = F.size(F.filter("_posts", _is_post)) == F.size("_posts")
    text = F.regexp_replace(body, _BLANKS, "")
    # An array that does not end, or text around the JSON, is parsed in part or not at all.
    valid = F.expr(f"try_parse_json({'`' + body + '`'}) is not null")
    reason = (F.when(F.col(body).isNull() | (text == ""), "missing").when(~valid, "malformed")
              .when(F.coalesce(whole, F.lit(False)), None).otherwise("no_post"))
    return _parsed(bodies, body).withColumn("reason", reason).filter("reason is not null").drop("_posts")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed article and archive pages."""
    return spark.read.schema(schemas.PAGE).parquet(path)


def normalize_sites(configured: DataFrame) -> DataFrame:
    """Registry rows to site rows: blank ids take the name, urls lose trailing slashes."""
    return configured.select(
        F.coalesce(blank_to_null(F.col("id")), F.col("name")).alias("id"),
        "name",
        strip_trailing_slashes(F.col("url")).alias("url"),
        F.coalesce(blank_to_null(F.col("group")), F.lit(DEFAULT_GROUP)).alias("group_id"),
    )


def response_class(status: Column, content_type: Column, is_fallback: Column | None = None) -> Column:
    """What a landed response means for the page walk; after a fallback there is no other to fall back to."""
    is_json = F.coalesce(F.lower(content_type).contains("json"), F.lit(False))
    redirect = status.between(300, 399)
    first = (F.when(status == 403, "blocked")
             .when((status == 404) | redirect | ~is_json, "fallback")
             .when(status == 400, "end")
             .when(status >= 400, "error")
             .otherwise("ok"))
    if is_fallback is None:
        return first
    second = F.when(status == 403, "blocked").when(status == 400, "end").when((status >= 300) | ~is_json, "error").otherwise("ok")
    return F.when(F.coalesce(is_fallback, F.lit(False)), second).otherwise(first)


def classify_responses(responses: DataFrame) -> DataFrame:
    """Add ``outcome`` and the page counters, which default to one page and no total.

    A column ``is_fallback``, where there is one, marks responses to the second way of asking.
    """
    def header(name, default):
        return F.coalesce(F.col(name).try_cast("int"), F.lit(default)).alias(name)
    counters = [header(n, d) for n, d in (("total_pages", 1), ("total", 0)) if n in responses.columns]
    others = [c for c in responses.columns if c not in ("total_pages", "total")]
    second = F.col("is_fallback") if "is_fallback" in responses.columns else None
    return responses.select(
        *others, *counters, response_class(F.col("status"), F.col("content_type"), second).alias("outcome"))


def parse_run_ledger(lines: DataFrame, line: str = "line") -> DataFrame:
    """Run history text to typed rows; JST times become UTC, unknown post counts NULL."""
    def part(pattern):
        return F.regexp_extract(line, pattern, 1)
    local = part(r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) JST").try_cast("timestamp_ntz")
    return lines.select(
        *[c for c in lines.columns if c != line],
        F.convert_timezone(F.lit("Asia/Tokyo"), F.lit("UTC"), local).alias("ts"),
        part(r"status=(\w+)").alias("status"),
        part(r"sites=(\d+)").try_cast("int").alias("sites"),
        part(r"posts=(\d+)").try_cast("int").alias("posts"),
    )


def read_run_ledger(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_ledger(spark.read.text(path).withColumnRenamed("value", "line"))
