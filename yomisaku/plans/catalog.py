"""Registered queries: every operator over whole tables, each next to the SQL that checks it.

``QUERIES`` maps a name to a function of (session, table folder), ``ORACLES`` to DuckDB SQL over the same tables. The SQL
states each result in another way than the operator does: padded text instead of positions, regular expressions instead
of a parser, known parts instead of compiled ones.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from yomisaku.functions import cards, markup, posts as post_fn, text
from yomisaku.operators import facets, index as ix, ingest, pages, query, search, search_sql as search_sql_function
from yomisaku.plans.fixtures import load, with_views
from yomisaku.session import held, materialize, scratch_path, shuffles_dropped
from yomisaku.sources import landing, store
from yomisaku.streaming import crawl

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW = "2024-12-01 00:00:00"


def register(sql: str | None = None):
    """Register a query under its function's name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps and lists as text, so that both engines print them alike."""
    def shown(f):
        if isinstance(f.dataType, T.TimestampNTZType):
            return F.substring(F.col(f.name).cast("string"), 1, 19).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.array_join(f.name, "|").alias(f.name)
        return F.col(f.name)
    return df.select(*[shown(f) for f in df.schema.fields])


def _ts(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') as {name or column.split('.')[-1]}"


_written: dict[tuple[str, str], tuple] = {}


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, ix.Index]:
    """Posts, sites and index, written once per session as an ingest would leave them."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _written:
        path = scratch_path(spark, "store")
        store.write_posts(load(spark, sf_dir, "posts"), path, slices=4)
        posts = store.read_posts(spark, path)
        _written[key] = (posts, materialize(load(spark, sf_dir, "sites"), "sites"),
                         ix.write_index(posts, scratch_path(spark, "index")))
    return _written[key]


# ---- SQL pieces -------------------------------------------------------------------------------------------------

CJK_SQL = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi in text.CJK_RANGES)


def stage1_sql(column: str, kept: str = r"\p{L}\p{N}") -> str:
    spaced = f"regexp_replace({column}, '([{CJK_SQL}])', ' \\1 ', 'g')"
    return f"trim(lower(regexp_replace({spaced}, '[^{kept}_.@/{CJK_SQL}-]+', ' ', 'g')))"


def terms_sql(column: str) -> str:
    """Text of the terms of a field. The given texts hold no CJK, so one pass does."""
    return f"trim(regexp_replace(strip_accents(lower({column})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


# Per post: each field's terms between single spaces, and with the spaces doubled so that neighbours do not overlap.
PADDED = f"""padded as (
  select site_id, post_id, t, e, c, replace(t, ' ', '  ') as t2, replace(e, ' ', '  ') as e2, replace(c, ' ', '  ') as c2,
    (case when t = '  ' then 0 else length(t) - length(replace(t, ' ', '')) - 1 end
     + case when e = '  ' then 0 else length(e) - length(replace(e, ' ', '')) - 1 end
     + case when c = '  ' then 0 else length(c) - length(replace(c, ' ', '')) - 1 end) as doc_len
  from (select site_id, post_id, ' ' || {terms_sql('title')} || ' ' as t, ' ' || {terms_sql('excerpt')} || ' ' as e,
          ' ' || {terms_sql('content')} || ' ' as c from posts) x)"""


def has_sql(needle: str) -> str:
    """Some field holds the padded needle, an SQL expression."""
    return f"(contains(t, {needle}) or contains(e, {needle}) or contains(c, {needle}))"


def times_sql(column: str, needle: str) -> str:
    return f"((length({column}) - length(replace({column}, {needle}, ''))) // length({needle}))"


def tf_sql(needle: str, doubled: bool = True) -> str:
    fields = ("t2", "e2", "c2") if doubled else ("t", "e", "c")
    return " + ".join(times_sql(f, needle) for f in fields)


# ---- sources and runs -------------------------------------------------------------------------------------------

@register(with_views("registry") + """
select case when id is null or id = '' then name else id end as id, name, rtrim(url, '/') as url,
  case when site_group is null or site_group = '' then 'backlink' else site_group end as group_id from registry""")
def sites_normalize(spark, sf_dir):
    return landing.normalize_sites(load(spark, sf_dir, "registry").withColumnRenamed("site_group", "group"))


def landed_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as posts API bodies: relative links, missing GMT dates, missing ``_embedded``, marked-up text."""
    articles = load(spark, sf_dir, "articles")
    escaped = F.regexp_replace(F.regexp_replace("content", "&", "&amp;"), "<", "&lt;")
    post_id = F.col("post_id")

    def rendered(value):
        return F.struct(value.alias("rendered"))

    def terms(column, taxonomy):
        return F.transform(post_fn.pipe_split(F.col(column)), lambda n: F.struct(
            F.lit(taxonomy).alias("taxonomy"), n.alias("name")))

    def iso(column):
        return F.translate(F.substring(F.col(column).cast("string"), 1, 19), " ", "T")
    body = F.to_json(F.struct(
        post_id.alias("id"),
        F.when(post_id % 4 == 0, F.concat(F.lit("/"), post_id.cast("string"), F.lit("/"))).otherwise(F.col("url"))
        .alias("link"),
        rendered(F.concat(F.lit("<b>T</b>"), post_id.cast("string"))).alias("title"),
        rendered(F.concat(F.lit("<script>x</script><p>"), escaped, F.lit("</p><!-- c -->"))).alias("content"),
        rendered(F.lit("")).alias("excerpt"),
        iso("published_at").alias("date"),
        F.when(post_id % 3 == 1, "").when(post_id % 3 == 2, iso("published_at")).alias("date_gmt"),
        F.concat(iso("modified_at"), F.when(post_id % 5 == 0, "+00:00").otherwise("")).alias("modified_gmt"),
        F.when(post_id % 6 != 0, F.struct(
            F.array(F.struct(F.col("author").alias("name"))).alias("author"),
            F.array(terms("categories", "category"), terms("tags", "post_tag")).alias("wp:term"))).alias("_embedded")))
    return articles.select("site_id", post_id.alias("seq"), body.alias("body"))


@register(with_views("articles") + """
select site_id, post_id as seq, post_id as id, case when post_id % 4 = 0 then '/' || post_id || '/' else url end as link,
  '<b>T</b>' || post_id as title,
  '<script>x</script><p>' || replace(replace(content, '&', '&amp;'), '<', '&lt;') || '</p><!-- c -->' as content,
  strftime(published_at, '%Y-%m-%dT%H:%M:%S') as date,
  strftime(modified_at, '%Y-%m-%dT%H:%M:%S') || case when post_id % 5 = 0 then '+00:00' else '' end as modified_gmt,
  case when post_id % 6 = 0 then null when tags = '' then 2 else 4 end as terms from articles""")
def rest_parse(spark, sf_dir):
    parsed = landing.parse_posts(landed_bodies(spark, sf_dir))
    n_terms = F.size(F.flatten(F.col("_embedded")["wp:term"]))
    return parsed.select("site_id", "seq", "id", "link", F.col("title.rendered").alias("title"),
                         F.col("content.rendered").alias("content"), "date", "modified_gmt",
                         F.when(F.col("_embedded").isNotNull(), n_terms).alias("terms"))


@register(with_views("articles") + """
select post_id as id, case when post_id % 6 = 0 then '' else trim(categories, '|') end as categories,
  case when post_id % 6 = 0 then '' else trim(tags, '|') end as tags from articles""")
def rest_terms(spark, sf_dir):
    parsed = landing.parse_posts(landed_bodies(spark, sf_dir))
    embedded = F.col("_embedded")
    return _plain(parsed.select("id", post_fn.embedded_terms(embedded, "category").alias("categories"),
                                post_fn.embedded_terms(embedded, "post_tag").alias("tags")))


@register(with_views("articles", "sites") + f"""
select a.site_id, post_id, a.url, 'T ' || post_id as title, '' as excerpt,
  trim(regexp_replace(content, '\\s+', ' ', 'g')) as content,
  case when post_id % 6 = 0 then '' else author end as author,
  {_ts('published_at')}, {_ts('modified_at')},
  case when post_id % 6 = 0 then '' else categories end as categories,
  case when post_id % 6 = 0 then '' else tags end as tags, post_id as seq
from articles a join sites s on s.id = a.site_id""")
def rest_normalize(spark, sf_dir):
    parsed = landing.parse_posts(landed_bodies(spark, sf_dir))
    return _plain(ingest.normalize_posts(parsed, load(spark, sf_dir, "sites")))


def damaged_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed bodies of which some begin with line ends, hold no post, break off, are empty or missing."""
    kind, body = F.col("seq") % 7, F.col("body")
    damaged = (F.when(kind == 1, F.concat(F.lit("\n\t["), body, F.lit("]"))).when(kind == 2, F.concat(F.lit("["), body))
               .when(kind == 3, " \r\n").when(kind == 4, None).when(kind == 5, '{"code": "no_route"}').otherwise(body))
    return landed_bodies(spark, sf_dir).withColumn("body", damaged)


@register(with_views("articles") + """
select site_id, post_id as seq, case post_id % 7 when 2 then 'malformed' when 5 then 'no_post' else 'missing' end as reason
from articles where post_id % 7 in (2, 3, 4, 5)""")
def rest_rejects(spark, sf_dir):
    return landing.rejected_bodies(damaged_bodies(spark, sf_dir)).select("site_id", "seq", "reason")


@register(with_views("articles") + "select site_id, post_id as seq, post_id as id from articles where post_id % 7 in (0, 1, 6)")
def rest_damaged(spark, sf_dir):
    return landing.parse_posts(damaged_bodies(spark, sf_dir)).select("site_id", "seq", "id")


@register(with_views("responses") + """
select event_id, site_id, status, content_type, coalesce(try_cast(total_pages as int), 1) as total_pages,
  case when status = 403 then 'blocked'
       when status in (301, 404) or content_type ilike 'text/html%' then 'fallback'
       when status = 400 then 'end' when status = 500 then 'error' else 'ok' end as outcome from responses""")
def response_classes(spark, sf_dir):
    return landing.classify_responses(load(spark, sf_dir, "responses"))


@register(f"""
select event_id, strftime(date_trunc('second', ts) - interval '9' hour, '%Y-%m-%d %H:%M:%S') as ts,
  case when event_id % 10 = 0 then 'failure' else 'success' end as status, cast(user_id as int) as sites,
  cast(case when event_id % 2 = 0 then null else event_id end as int) as posts from events""")
def run_ledger(spark, sf_dir):
    return _plain(landing.parse_run_ledger(load(spark, sf_dir, "ledger")))


@register(with_views("attempts") + """
select site_id, cast(case when bool_or(coalesce(failure, '') = 'exception') then -1
  else coalesce(max(posts) filter (where failure is null), 0) end as bigint) as result from attempts group by site_id""")
def run_summary(spark, sf_dir):
    return ingest.run_summary(load(spark, sf_dir, "attempts"))


# ---- scalar functions -------------------------------------------------------------------------------------------

def strip_markup_sql(html: str) -> str:
    bare = (f"regexp_replace(regexp_replace({html}, "
            "'<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'gs'), "
            "'<!--.*?-->|<!?/?[a-zA-Z][^>]*>', ' ', 'gs')")
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        bare = f"replace({bare}, '{entity}', '{char}')"
    return f"trim(regexp_replace({bare}, '\\s+', ' ', 'g'))"


@register(f"select page_id, {strip_markup_sql('html')} as text from pages")
def html_text(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", markup.html_to_text(F.col("html")).alias("text"))


@register(with_views("articles", "registry") + """
select post_id, case when post_id % 2 = 0 then 'https://' || site_id || '.example.com:8080/a/' || post_id
  else url end as url from articles""")
def absolutize_links(spark, sf_dir):
    base = F.concat(F.lit("https://"), F.col("site_id"), F.lit(".example.com:8080/blog/en"))
    link = F.when(F.col("post_id") % 2 == 0, F.concat(F.lit("/a/"), F.col("post_id").cast("string"))).otherwise(
        F.col("url"))
    return load(spark, sf_dir, "articles").select("post_id", post_fn.absolutize(link, base).alias("url"))


@register(with_views("articles") + """
select post_id, case when tags = '' then 0 else len(tags) - len(replace(tags, '|', '')) - 1 end as n,
  tags as joined from articles""")
def pipe_roundtrip(spark, sf_dir):
    names = post_fn.pipe_split(F.col("tags"))
    return load(spark, sf_dir, "articles").select(
        "post_id", F.size(names).alias("n"), post_fn.pipe_join(names).alias("joined"))


@register(with_views("posts") + """
select url, cast('0x' || substr(md5(url), 1, 15) as bigint) as post_id from posts""")
def url_post_id(spark, sf_dir):
    return load(spark, sf_dir, "posts").select("url", post_fn.url_post_id(F.col("url")).alias("post_id"))


@register(with_views("posts") + f"""
select site_id, post_id, {stage1_sql('title')} as title_idx, {stage1_sql('excerpt')} as excerpt_idx,
  {stage1_sql('content')} as content_idx from posts""")
def index_text(spark, sf_dir):
    return text.with_index_text(load(spark, sf_dir, "posts")).select(
        "site_id", "post_id", "title_idx", "excerpt_idx", "content_idx")


@register(with_views("texts_ja") + f"select post_id, {stage1_sql('content')} as content_idx from texts_ja")
def index_text_ja(spark, sf_dir):
    return load(spark, sf_dir, "texts_ja").select(
        "post_id", text.prepare_index_text(F.col("content")).alias("content_idx"))


@register(with_views("texts_full") + f"select post_id, {stage1_sql('content')} as content_idx from texts_full")
def index_text_half_width(spark, sf_dir):
    return load(spark, sf_dir, "texts_half").select(
        "post_id", text.prepare_index_text(F.col("content")).alias("content_idx"))


@register(f"select doc_id, {stage1_sql('text', 'a-zA-Z0-9')} as prepared from documents")
def query_text_ascii(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(
        "doc_id", text.prepare_query_text(F.col("text"), "hosted").alias("prepared"))


@register(with_views("typed", "articles") + """
select post_id, regexp_replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
  '(?i)(' || case shape when 0 then w1 when 1 then w1 || ' ' || w2 when 2 then w2 || '  ' || w3 || '|' || w1 || '|' || w3
    when 3 then '"|' || regexp_replace(w1, '(.)', '\\1|', 'g') || w2
    when 4 then '%|%|%|\\(|' || regexp_replace(w1, '(.)', '\\1|', 'g') || '\\)|\\*|' || regexp_replace(w2 || '-' || w3 || ':', '(.)', '\\1|', 'g') || ':'
    else regexp_replace(w1 || '東京' || w2, '(.)', '\\1|', 'g') || '駅|\\*|\\*|\\*' end || ')', '<mark>\\1</mark>', 'g') as marked
from articles join typed on query_id = post_id""")
def highlight(spark, sf_dir):
    typed = load(spark, sf_dir, "typed").select(F.col("query_id").alias("post_id"), "q")
    return load(spark, sf_dir, "articles").join(typed, "post_id").select(
        "post_id", cards.highlight(F.col("content"), F.col("q")).alias("marked"))


# ---- pages ------------------------------------------------------------------------------------------------------

HOST_SQL = "regexp_extract(url, '://([^/?#]+)', 1)"


def _site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]+)", 1)
    return load(spark, sf_dir, "pages").withColumn("site_id", host)


@register(f"""
with x as (select {HOST_SQL} as site_id, url, {strip_markup_sql("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")} as title,
  {strip_markup_sql("regexp_extract(html, '<article>(.*?)</article>', 1, 's')")} as content from pages)
select site_id, cast('0x' || substr(md5(url), 1, 15) as bigint) as post_id, url, title, substr(content, 1, 200) as excerpt,
  content, '' as author, '{NOW}' as published_at, '{NOW}' as modified_at, '' as categories, '' as tags
from x where title <> ''""")
def article_rows(spark, sf_dir):
    articles = pages.extract_articles(pages.read_fields(_site_pages(spark, sf_dir)))
    return _plain(pages.scraped_posts(articles, _now()))


@register("""
select doc_id, case doc_id % 7 when 0 then '2024-02-0' || (1 + doc_id % 9) || 'T00:00:00Z'
    when 1 then '2024-03-0' || (1 + doc_id % 9) when 2 then '2024-04-0' || (1 + doc_id % 9)
    when 3 then '2024-06-01T09:00:00+09:00' when 4 then '2024-07-0' || (1 + doc_id % 9)
    when 5 then '2024-04-0' || (1 + doc_id % 9) end as published,
  case doc_id % 7 when 3 then '2024-05-0' || (1 + doc_id % 9) when 4 then '2024-08-01' when 5 then '2024-10-01' end as modified
from documents""")
def article_dates(spark, sf_dir):
    fields = pages.read_fields(load(spark, sf_dir, "dated_pages"))
    return pages.extract_dates(fields).select("doc_id", "published", "modified")


LINK_RE = r"https://src[0-9]+\.example\.com/read-[0-9]+/*$"


@register(with_views("archive_pages") + f"""
select distinct site_id, rtrim(href, '/') || '/' as url
from (select site_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as href from archive_pages) x
where regexp_matches(href, '^{LINK_RE}')""")
def archive_links(spark, sf_dir):
    archives = load(spark, sf_dir, "archive_pages")
    rules = load(spark, sf_dir, "sites").select(F.col("id").alias("site_id"), F.lit(LINK_RE).alias("link_re"))
    return pages.archive_links(pages.read_fields(archives).select("site_id", "hrefs"), rules)


@register(f"""
with x as (select {HOST_SQL} as site_id, page_id, url, html from pages),
w as (select site_id, url, {strip_markup_sql("regexp_replace(html, '<article>.*?</article>', ' ', 's')")} as t
  from x qualify row_number() over (partition by site_id order by page_id) = 1)
select site_id, cast(-1 as bigint) as post_id, url, 'ウィジット (' || site_id || ')' as title, substr(t, 1, 200) as excerpt,
  t as content, '' as author, '{NOW}' as published_at, '{NOW}' as modified_at, '' as categories, '' as tags from w where t <> ''""")
def widget_rows(spark, sf_dir):
    site_pages = _site_pages(spark, sf_dir)
    sites = site_pages.select(F.col("site_id").alias("id"), F.col("site_id").alias("name"),
                              F.concat(F.lit("https://"), "site_id").alias("url")).distinct()
    sources = ingest.sample_urls(site_pages.withColumnRenamed("page_id", "seq"))
    wanted = site_pages.join(sources.select("url"), "url", "left_semi")
    fetched = pages.read_fields(wanted.select(
        "url", F.lit(200).alias("status"), F.lit("text/HTML; charset=utf-8").alias("content_type"), "html"))
    return _plain(pages.widget_rows(sites, sources, pages.widget_text(fetched).distinct(), _now()))


# ---- ingest -----------------------------------------------------------------------------------------------------

def _store_and_batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    arrivals = load(spark, sf_dir, "arrivals")
    return arrivals.filter("seq = 0").drop("seq"), arrivals.filter("seq > 0")


@register(with_views("arrivals") + f"""
select site_id, post_id, title, {_ts('modified_at')} from arrivals
qualify row_number() over (partition by site_id, post_id order by seq desc) = 1""")
def upsert_posts(spark, sf_dir):
    return _plain(ingest.upsert_posts(*_store_and_batch(spark, sf_dir)))


@register(with_views("arrivals") + f"""
select site_id, post_id, title, {_ts('modified_at')} from arrivals
qualify row_number() over (partition by site_id, post_id order by modified_at desc, seq desc) = 1""")
def upsert_newest_wins(spark, sf_dir):
    return _plain(ingest.upsert_posts(*_store_and_batch(spark, sf_dir), newest_wins=True))


@register(with_views("sites", "registry") + f"""
, r as (select case when id = '' then name else id end as id, name, rtrim(url, '/') as url,
  coalesce(nullif(site_group, ''), 'backlink') as group_id from registry)
select id, name, url, group_id, null as last_crawled_at, {_ts('last_modified')} from (
  select r.id, r.name, r.url, r.group_id, s.last_modified from r left join sites s on s.id = r.id
  union all select id, name, url, group_id, last_modified from sites where id not in (select id from r)) x""")
def upsert_sites(spark, sf_dir):
    return _plain(ingest.upsert_sites(load(spark, sf_dir, "sites"), sites_normalize(spark, sf_dir)))


@register(with_views("arrivals", "sites") + f"""
select seq, site_id, post_id, title, {_ts('modified_at')} from arrivals a
where seq > 0 and exists (select 1 from sites s where s.id = a.site_id
  and (s.last_modified is null or a.modified_at > s.last_modified))""")
def incremental_filter(spark, sf_dir):
    _, batch = _store_and_batch(spark, sf_dir)
    return _plain(ingest.incremental_filter(batch, load(spark, sf_dir, "sites")))


@register(with_views("arrivals", "sites") + f"""
, m as (select site_id, max(modified_at) as newest from arrivals where seq > 0 group by site_id)
select id, name, url, group_id, case when newest is not null then '{NOW}' end as last_crawled_at,
  strftime(case when newest is null then last_modified when last_modified is null or newest > last_modified then newest
    else last_modified end, '%Y-%m-%d %H:%M:%S') as last_modified
from sites left join m on m.site_id = id""")
def advance_marks(spark, sf_dir):
    _, batch = _store_and_batch(spark, sf_dir)
    return _plain(ingest.advance_marks(load(spark, sf_dir, "sites"), batch, _now()))


@register(with_views("sites") + f"""
select id, name, url, group_id, null as last_crawled_at,
  case when id in ('src1', 'src2', 'src3') then null else strftime(last_modified, '%Y-%m-%d %H:%M:%S') end as last_modified from sites""")
def reset_marks(spark, sf_dir):
    return _plain(ingest.reset_marks(load(spark, sf_dir, "sites"), ["src1", "src2", "src3"]))


def _purge_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store, what a full run found (the labelled documents), and the sites that ran (the corporate ones)."""
    posts = load(spark, sf_dir, "posts").select("site_id", "post_id", "title")
    labels = load(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"))
    ran = load(spark, sf_dir, "sites").filter("group_id = 'corporate'").select(F.col("id").alias("site_id"))
    return posts, posts.join(labels, "post_id", "left_semi"), ran


STALE_SQL = with_views("posts", "sites") + """
, stale as (select site_id, post_id from posts p where post_id not in (select doc_id from labels)
  and site_id in (select id from sites where group_id = 'corporate'))
"""


@register(STALE_SQL + """
select p.site_id, p.post_id, p.title from posts p left join stale s on s.site_id = p.site_id and s.post_id = p.post_id
where s.post_id is null""")
def purge_stale(spark, sf_dir):
    return ingest.purge_stale(*_purge_inputs(spark, sf_dir))


@register(STALE_SQL + "select site_id, post_id from stale")
def stale_ids(spark, sf_dir):
    return ingest.stale_posts(*_purge_inputs(spark, sf_dir))


@register(STALE_SQL + """
select site_id, post_id from stale where site_id in (
  select site_id from posts left join stale using (site_id, post_id) group by site_id
  having count(*) filter (where (site_id, post_id) in (select (site_id, post_id) from stale)) <= 0.6 * count(*))""")
def purge_guard(spark, sf_dir):
    posts, fetched, ran = _purge_inputs(spark, sf_dir)
    return ingest.purge_guard(ingest.stale_posts(posts, fetched, ran), posts, 0.6)


@register(with_views("sites") + """
select id, name, url, group_id from sites where id = 'src2' or id = 'src5' or id = 'src11'""")
def restrict_sites(spark, sf_dir):
    return ingest.restrict_sites(load(spark, sf_dir, "sites"), " src2, src5,,src11 ,nosuch").select(
        "id", "name", "url", "group_id")


@register(with_views("arrivals", "posts") + """
select t.site_id, cast(coalesce(fetched, 0) as bigint) as fetched, t.total
from (select site_id, count(*) as total from posts group by site_id) t
left join (select site_id, count(*) as fetched from arrivals where seq = 1 group by site_id) a on a.site_id = t.site_id
where coalesce(fetched, 0) < t.total""")
def crawl_completeness(spark, sf_dir):
    batch = load(spark, sf_dir, "arrivals").filter("seq = 1")
    totals = load(spark, sf_dir, "posts").groupBy("site_id").agg(F.count("*").alias("total"))
    return ingest.crawl_completeness(batch, totals)


@register(with_views("articles") + """
select site_id, url from articles where published_at is not null
qualify row_number() over (partition by site_id order by post_id) = 1""")
def sample_urls(spark, sf_dir):
    url = F.when(F.col("published_at").isNotNull(), F.col("url")).otherwise("")
    batch = load(spark, sf_dir, "articles").select("site_id", url.alias("url"), F.col("post_id").alias("seq"))
    return ingest.sample_urls(batch)


@register(with_views("posts", "sites") + """
select site_id, post_id from posts where site_id in (select id from sites where group_id = 'backlink')
  and post_id not in (select doc_id from labels)""")
def cascade_delete(spark, sf_dir):
    posts, fetched, _ = _purge_inputs(spark, sf_dir)
    left = load(spark, sf_dir, "sites").filter("group_id = 'backlink'")
    return ingest.cascade_delete(ingest.delete_posts(posts, fetched), left).select("site_id", "post_id")


@register(with_views("sites") + "select id, name, url, group_id from sites order by name, id")
def list_sites(spark, sf_dir):
    return ingest.list_sites(load(spark, sf_dir, "sites")).select("id", "name", "url", "group_id")


# ---- index ------------------------------------------------------------------------------------------------------

TOKENS = f"""tokens as (
  select site_id, post_id, field, weight_class, cast(generate_subscripts(terms, 1) - 1 as int) as pos, unnest(terms) as term
  from (select site_id, post_id, 'title' as field, 'A' as weight_class, string_split({terms_sql('title')}, ' ') as terms from posts
    union all select site_id, post_id, 'excerpt', 'B', string_split({terms_sql('excerpt')}, ' ') from posts
    union all select site_id, post_id, 'content', 'C', string_split({terms_sql('content')}, ' ') from posts) x
  where terms <> [''])"""


@register(with_views("posts") + f", {TOKENS} select site_id, post_id, field, weight_class, pos, term from tokens")
def postings(spark, sf_dir):
    return ix.postings(load(spark, sf_dir, "posts"))


@register(with_views("posts") + f""", {TOKENS}
select term, count(distinct (site_id, post_id)) as docs, count(*) as total from tokens group by term""")
def vocabulary(spark, sf_dir):
    return ix.vocabulary(ix.document_terms(load(spark, sf_dir, "posts")))


@register(with_views("posts") + f""", {PADDED}
select site_id, post_id, cast(doc_len as int) as doc_len, (select count(*) from padded) as n_docs,
  round((select avg(doc_len) from padded), 6) as avg_len from padded""")
def doc_stats(spark, sf_dir):
    docs = ix.doc_stats(load(spark, sf_dir, "posts"))
    totals = ix.corpus_stats(docs)
    return docs.withColumns({"n_docs": totals.select("n_docs").scalar(),
                             "avg_len": F.round(totals.select("avg_len").scalar(), 6)})


@register(with_views("posts") + f""", {TOKENS}, kept as (
  select site_id, post_id, term from tokens where post_id not in (select doc_id from labels where toxic = 1)
    and post_id not in (select doc_id from labels where quality = 1)
  union all
  select site_id, post_id, unnest(['changed', 'content', 'changed']) from posts
  where post_id in (select doc_id from labels where quality = 1 and toxic = 0))
select term, site_id, post_id, count(*) as tf from kept group by all""")
def index_refresh(spark, sf_dir):
    """Toxic posts are deleted, good ones rewritten; the appended generations must read like a rebuild."""
    posts = load(spark, sf_dir, "posts")
    labels = load(spark, sf_dir, "labels").withColumnRenamed("doc_id", "post_id")
    labelled = posts.select("site_id", "post_id").join(labels, "post_id")
    changed = posts.join(labels.filter("quality = 1 and toxic = 0"), "post_id", "left_semi").select(
        "site_id", "post_id", F.lit("changed").alias("title"), F.lit("").alias("excerpt"),
        F.lit("Content: CHANGED!").alias("content"))
    path = scratch_path(spark, "refreshed")
    ix.write_index(posts, path)
    index = ix.append_index(changed, labelled.filter("toxic = 1").select("site_id", "post_id"), path, 1)
    return index.terms.select("term", "site_id", "post_id", F.size("positions").cast("bigint").alias("tf"))


# ---- queries and matching ---------------------------------------------------------------------------------------

@register(with_views("typed") + """
, t as (select query_id, shape, lower(w1) as a, lower(w2) as b, lower(w3) as c from typed)
select query_id, n as clause_no, cast(max(n) over (partition by query_id) + 1 as int) as n_clauses, kind, terms from (
  select query_id, 0 as n, 'prefix' as kind, a as terms from t where shape in (0, 2, 3, 4, 5)
  union all select query_id, 0, 'phrase', a || '|' || b from t where shape = 1
  union all select query_id, 1, 'phrase', b || '|' || c from t where shape = 2
  union all select query_id, 2, 'prefix', c from t where shape = 2
  union all select query_id, 1, 'prefix', b from t where shape = 3
  union all select query_id, 1, 'phrase_prefix', b || '|' || c from t where shape = 4
  union all select query_id, 1, 'exact', '東' from t where shape = 5
  union all select query_id, 2, 'exact', '京' from t where shape = 5
  union all select query_id, 3, 'prefix', b from t where shape = 5
  union all select query_id, 4, 'exact', '駅' from t where shape = 5) x""")
def compile_queries(spark, sf_dir):
    return _plain(query.compile_queries(load(spark, sf_dir, "typed")))


def _hits(spark: SparkSession, sf_dir: str, q) -> DataFrame:
    """Clause hits of one search per benchmark passage."""
    _, _, index = corpus(spark, sf_dir)
    searches = load(spark, sf_dir, "saved").select("query_id", q.alias("q"))
    return search.clause_hits(query.compile_queries(searches), index)


def _quoted(*words):
    return F.concat(F.lit('"'), F.concat_ws(" ", *words), F.lit('"'))


HIT_SQL = with_views("saved", "posts") + f", {PADDED} select query_id, site_id, post_id, "


@register(HIT_SQL + f"""{tf_sql("' ' || w1 || ' '")} as tf
from saved join padded on {has_sql("' ' || w1 || ' '")}""")
def match_exact(spark, sf_dir):
    hits = _hits(spark, sf_dir, _quoted("w1"))
    return hits.select("query_id", "site_id", "post_id", "tf")


@register(HIT_SQL + f"""{tf_sql("' ' || w2", doubled=False)} as tf
from saved join padded on {has_sql("' ' || w2")}""")
def match_prefix(spark, sf_dir):
    hits = _hits(spark, sf_dir, F.col("w2"))
    return hits.select("query_id", "site_id", "post_id", "tf")


@register(HIT_SQL + f"""{tf_sql("' ' || w1 || '  ' || w2 || ' '")} as tf
from saved join padded on {has_sql("' ' || w1 || ' ' || w2 || ' '")}""")
def match_phrase(spark, sf_dir):
    hits = _hits(spark, sf_dir, _quoted("w1", "w2"))
    return hits.select("query_id", "site_id", "post_id", "tf")


@register(with_views("saved", "posts") + f""", {PADDED} select query_id, site_id, post_id from saved join padded
on {has_sql("' ' || w1 || ' '")} and {has_sql("' ' || w2")}""")
def match_all(spark, sf_dir):
    hits = _hits(spark, sf_dir, F.concat_ws(" ", _quoted("w1"), "w2"))
    return search.match_all(hits)


# ---- single searches --------------------------------------------------------------------------------------------

RESULT_SQL = f"site_id, post_id, url, title, excerpt, author, {_ts('published_at')}, trim(categories, '|') as categories, trim(tags, '|') as tags"
NEWEST = "published_at desc nulls last, site_id, post_id"
OLDEST = "published_at asc nulls last, site_id, post_id"


def search_sql(where: str, order: str = NEWEST, limit: int = 30, offset: int = 0, columns: str = RESULT_SQL) -> str:
    return with_views("posts", "sites") + f""", {PADDED},
found as (select p.*, s.group_id, s.name from posts p join padded using (site_id, post_id) join sites s on s.id = p.site_id
  where {where}),
numbered as (select *, count(*) over () as total_count, row_number() over (order by {order}) as rn from found)
select {columns}, total_count, rn from numbered where rn > {offset} and rn <= {offset + limit}"""


def _search(spark: SparkSession, sf_dir: str, q: str, **options) -> DataFrame:
    found = search.search_posts(*corpus(spark, sf_dir), q, **options)
    return _plain(found.drop("score"))


FLAGSHIP = 'thha "of the"'
FLAGSHIP_SQL = f"""{has_sql("' thha'")} and {has_sql("' of the '")}"""
ARTICLE = "post_id <> -1"


@register(search_sql(f"{FLAGSHIP_SQL} and {ARTICLE} and s.group_id = 'corporate'"))
def search_posts(spark, sf_dir):
    return _search(spark, sf_dir, FLAGSHIP, group_id="corporate", sort="newest")


@register(search_sql(f"{FLAGSHIP_SQL} and {ARTICLE} and s.group_id = 'corporate'"))
def search_posts_sql(spark, sf_dir):
    search_sql_function.register_search(*corpus(spark, sf_dir))
    asked = search_sql_function.text_query(spark, FLAGSHIP)
    found = spark.sql("select * from search_posts(:q, p_group_id => 'corporate', p_sort => 'newest')", {"q": asked})
    lists = {c: post_fn.pipe_split(F.col(c)) for c in ("categories", "tags")}
    return _plain(found.drop("rank").withColumns(lists))


@register(search_sql(ARTICLE))
def search_blank(spark, sf_dir):
    return _search(spark, sf_dir, "%%% ***")


@register(search_sql(f"""{has_sql("' the of'")} and {ARTICLE}"""))
def search_punctuated(spark, sf_dir):
    return _search(spark, sf_dir, "the-of", sort="newest")


@register(search_sql(f"""{has_sql("' the '")} and {ARTICLE} and site_id in ('src1', 'src2')"""))
def search_site_filter(spark, sf_dir):
    return _search(spark, sf_dir, '"the"', sort="newest", site_ids=["src1", "src2"])


@register(search_sql(f"""{has_sql("' de'")} and {ARTICLE} and group_id = 'backlink'""", limit=100))
def search_group_filter(spark, sf_dir):
    return _search(spark, sf_dir, "de", sort="newest", group_id="backlink", limit=100)


@register(search_sql(f"""{has_sql("' de'")} and {ARTICLE} and (categories ilike '%|fr|%' or categories ilike '%|long|%')
  and tags ilike '%|quality_1|%'"""))
def search_term_filters(spark, sf_dir):
    return _search(spark, sf_dir, "de", sort="newest", categories=["FR", "long"], tags=["quality_1"])


@register(search_sql(f"""{has_sql("' e'")} and post_id = -1"""))
def search_widgets(spark, sf_dir):
    return _search(spark, sf_dir, "e", sort="newest", widgets_only=True)


@register(search_sql(f"{FLAGSHIP_SQL} and {ARTICLE}"))
def search_newest(spark, sf_dir):
    return _search(spark, sf_dir, FLAGSHIP, sort="newest")


@register(search_sql(f"{FLAGSHIP_SQL} and {ARTICLE}", OLDEST))
def search_oldest(spark, sf_dir):
    return _search(spark, sf_dir, FLAGSHIP, sort="oldest")


@register(search_sql(f"""{has_sql("' ean '")} and {ARTICLE}""", OLDEST, limit=20, offset=20))
def search_page(spark, sf_dir):
    return _search(spark, sf_dir, "éan", sort="oldest", limit=20, offset=20)


def idf_sql(df: str) -> str:
    return f"(case when ln(((select count(*) from padded) - {df} + 0.5) / ({df} + 0.5)) > 0 then ln(((select count(*) from padded) - {df} + 0.5) / ({df} + 0.5)) else 1e-6 end)"


def bm25_sql(tf: str, df: str) -> str:
    return f"{idf_sql(df)} * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * doc_len / (select avg(doc_len) from padded)))"


SCORED = f""", {PADDED},
counted as (select site_id, post_id, doc_len, {tf_sql("' thha'", doubled=False)} as f1, {tf_sql("' of  the '")} as f2 from padded),
dfs as (select count(*) filter (where f1 > 0) as d1, count(*) filter (where f2 > 0) as d2 from counted),
scored as (select site_id, post_id, round({bm25_sql('f1', 'd1')} + {bm25_sql('f2', 'd2')}, 6) as score
  from counted, dfs where f1 > 0 and f2 > 0)
"""


@register(with_views("posts") + SCORED + "select site_id, post_id, score from scored")
def rank_bm25(spark, sf_dir):
    _, _, index = corpus(spark, sf_dir)
    clauses = query.compile_queries(search.single_search(spark, FLAGSHIP))
    ranked = search.rank_bm25(search.clause_hits(clauses, index), index.corpus)
    return ranked.select("site_id", "post_id", "score")


def damped_sql(needle: str, doubled: bool) -> str:
    suffix = "2" if doubled else ""
    return " + ".join(f"{w} * {times_sql(f + suffix, needle)} / ({times_sql(f + suffix, needle)} + 1)"
                      for f, w in zip("tec", search.CLASS_WEIGHTS))


@register(with_views("posts") + f""", {PADDED} select site_id, post_id,
round({damped_sql("' thha'", False)} + {damped_sql("' of  the '", True)}, 6) as score from padded where {FLAGSHIP_SQL}""")
def rank_weighted(spark, sf_dir):
    _, _, index = corpus(spark, sf_dir)
    clauses = query.compile_queries(search.single_search(spark, FLAGSHIP))
    return search.rank_weighted(search.clause_hits(clauses, index)).select("site_id", "post_id", "score")


@register(with_views("posts", "sites") + SCORED + f""", numbered as (select p.*, score, count(*) over () as total_count,
  row_number() over (order by score desc, {NEWEST}) as rn from posts p join scored using (site_id, post_id)
  join sites s on s.id = p.site_id where post_id <> -1)
select {RESULT_SQL}, total_count, score, rn from numbered where rn <= 30""")
def search_relevance(spark, sf_dir):
    return _plain(search.search_posts(*corpus(spark, sf_dir), FLAGSHIP))


@register(with_views("posts") + f""", {PADDED} select count(*) as total_count from padded
where {has_sql("' the'")} and post_id <> -1""")
def search_total(spark, sf_dir):
    found, _ = search.matches(*corpus(spark, sf_dir), "the", rank=None)
    return found.agg(F.count("*").alias("total_count"))


@register(with_views("posts") + f""", {PADDED}, n as (select url, row_number() over (order by {NEWEST}) as rn
  from posts join padded using (site_id, post_id) where {has_sql("' the'")} and post_id <> -1)
select rn, url from n where url <> ''""")
def export_urls(spark, sf_dir):
    return search.export_urls(*corpus(spark, sf_dir), "the", sort="newest")


@register(search_sql(f"""{has_sql("' the'")} and {ARTICLE}""", limit=1 << 40, columns="site_id, post_id"))
def search_numbered(spark, sf_dir):
    """Every result with its place, by the distributed sort that deep pages are cut from."""
    found, has_text = search.matches(*corpus(spark, sf_dir), "the", rank=None)
    placed = search.numbered(found, search.result_order("newest", has_text))
    total = placed.agg(F.count("*").alias("total_count"))
    return placed.select("site_id", "post_id", "rn").join(F.broadcast(total))


@register(search_sql(f"""{has_sql("' the '")} and {ARTICLE} and site_id in ('src1', 'src2')""", columns="""site_id, post_id,
  url, regexp_replace(replace(replace(replace(replace(coalesce(nullif(title, ''), '(無題)'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
    '(?i)(the)', '<mark>\\1</mark>', 'g') as title_html, name as site_name,
  coalesce(strftime(published_at + interval '9' hour, '%Y/%m/%d'), '') as shown_date,
  regexp_replace(replace(replace(replace(replace(excerpt, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
    '(?i)(the)', '<mark>\\1</mark>', 'g') as excerpt_html""").replace(", total_count, rn from", ", rn from"))
def result_cards(spark, sf_dir):
    posts, sites, index = corpus(spark, sf_dir)
    page = search.search_posts(posts, sites, index, '"the"', sort="newest", site_ids=["src1", "src2"])
    return search.result_cards(page, sites, F.lit('"the"'))


@register(with_views("posts") + f""", {PADDED}, n as (select published_at, row_number() over (order by {NEWEST}) as rn,
  count(*) over () as total from posts join padded using (site_id, post_id) where {has_sql("' the'")} and post_id <> -1),
p as (select * from n where rn > 60 and rn <= 80)
select max(total) as total, cast(61 as bigint) as shown_from, 60 + count(*) as shown_to, cast(ceil(max(total) / 20.0) as bigint) as pages,
  cast(2 as bigint) as first_button, cast(least(ceil(max(total) / 20.0), 6) as bigint) as last_button,
  strftime(max(published_at), '%Y-%m-%d %H:%M:%S') as newest from p having count(*) > 0""")
def page_info(spark, sf_dir):
    page = search.search_posts(*corpus(spark, sf_dir), "the", sort="newest", limit=20, offset=60)
    return _plain(search.page_info(page, 3, 20))


# ---- many searches ----------------------------------------------------------------------------------------------

def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(column):
        return F.when(F.col(column) != "", F.array(column))
    return load(spark, sf_dir, "saved").select(
        "query_id", "q", one("site").alias("site_ids"), "group_id", one("category").alias("categories"),
        one("tag").alias("tags"), "widgets_only", "sort", "lim", "off")


@register(with_views("saved", "posts", "sites") + f""", {PADDED},
counted as (select query_id, kind, site_id, post_id, doc_len,
  case kind when 0 then {tf_sql("' ' || w1 || '  ' || w2 || ' '")} when 2 then {tf_sql("' ' || w1 || ' '")}
    when 3 then 1 else {tf_sql("' ' || w1", doubled=False)} end as f1,
  case kind when 1 then {tf_sql("' ' || w2", doubled=False)} else 1 end as f2 from saved, padded),
dfs as (select query_id, count(*) filter (where f1 > 0) as d1, count(*) filter (where f2 > 0) as d2 from counted group by query_id),
scored as (select c.query_id, site_id, post_id, case when kind = 3 then 0 else round({bm25_sql('f1', 'd1')}
    + case when kind = 1 then {bm25_sql('f2', 'd2')} else 0 end, 6) end as score
  from counted c join dfs d on d.query_id = c.query_id where f1 > 0 and f2 > 0),
found as (select p.*, q.query_id, q.lim, q.off, q.kind, q.sort, score from scored c join saved q on q.query_id = c.query_id
  join posts p on p.site_id = c.site_id and p.post_id = c.post_id join sites s on s.id = p.site_id
  where (q.group_id is null or q.group_id = s.group_id) and (q.site = '' or q.site = p.site_id)
    and (q.category = '' or p.categories ilike '%|' || q.category || '|%') and (q.tag = '' or p.tags ilike '%|' || q.tag || '|%')
    and (p.post_id = -1) = q.widgets_only),
numbered as (select *, count(*) over (partition by query_id) as total_count, row_number() over (partition by query_id order by
  case when sort = 'relevance' and kind <> 3 then score end desc,
  case when sort = 'oldest' then published_at end asc nulls last,
  case when sort <> 'oldest' then published_at end desc nulls last, site_id, post_id) as rn from found)
select query_id, rn, total_count, score, site_id, post_id, url, title, excerpt, author, {_ts('published_at')},
  trim(categories, '|') as categories, trim(tags, '|') as tags
from numbered where rn > off and rn <= off + lim""")
def search_many(spark, sf_dir):
    return _plain(search.search_many(*corpus(spark, sf_dir), saved_searches(spark, sf_dir)))


# ---- facets -----------------------------------------------------------------------------------------------------

SITE_COUNTS_SQL = """(select s.id, s.name, s.group_id, s.url, count(p.post_id) as count
from sites s left join posts p on p.site_id = s.id and p.post_id <> -1 group by all)"""
NAMES_SQL = """(select unnest(string_split(trim({c}, '|'), '|')) as name from posts where coalesce({c}, '') <> '')"""


@register(with_views("posts", "sites") + f"select * from {SITE_COUNTS_SQL} x")
def facet_sites(spark, sf_dir):
    return facets.site_counts(load(spark, sf_dir, "sites"), load(spark, sf_dir, "posts"))


@register(with_views("posts", "sites") + f"select * from {SITE_COUNTS_SQL} x")
def facet_sites_sql(spark, sf_dir):
    facets.register_site_counts(load(spark, sf_dir, "sites"), load(spark, sf_dir, "posts"))
    return spark.sql("select * from list_sites_with_counts()")


@register(with_views("posts") + f"select name, count(*) as count from {NAMES_SQL.format(c='categories')} x group by name")
def facet_categories(spark, sf_dir):
    return facets.category_counts(load(spark, sf_dir, "posts"))


@register(with_views("posts") + f"select name, count(*) as count from {NAMES_SQL.format(c='tags')} x group by name")
def facet_tags(spark, sf_dir):
    return facets.tag_counts(load(spark, sf_dir, "posts"))


@register("select count(*) as total from documents")
def stats_total(spark, sf_dir):
    return facets.post_total(load(spark, sf_dir, "posts"))


@register("select source as site_id, count(*) + 1 as count from documents group by source")
def stats_by_site(spark, sf_dir):
    return facets.posts_by_site(load(spark, sf_dir, "posts"), include_widgets=True)


@register(with_views("posts", "sites") + f"select count(*) as sites, cast(sum(count) as bigint) as posts from {SITE_COUNTS_SQL} x")
def stats_overview(spark, sf_dir):
    return facets.overview(facets.site_counts(load(spark, sf_dir, "sites"), load(spark, sf_dir, "posts")))


@register(with_views("registry") + """
select case when site_group = 'corporate' then 'corporate' else 'backlink' end as group_id, id, name from registry""")
def sites_by_group(spark, sf_dir):
    return facets.sites_by_group(load(spark, sf_dir, "registry").withColumnRenamed("site_group", "group_id"))


@register(with_views("posts", "sites") + f"""
select 'site' as facet, id as name, count from {SITE_COUNTS_SQL} x
union all select 'category', name, count(*) from {NAMES_SQL.format(c='categories')} x group by name
union all select 'tag', name, count(*) from {NAMES_SQL.format(c='tags')} x group by name""")
def facets_all(spark, sf_dir):
    return facets.facets(load(spark, sf_dir, "sites"), load(spark, sf_dir, "posts"))


# ---- streaming --------------------------------------------------------------------------------------------------

LANDED_FILES = 8  # dealt by post, so that one large site does not fill a file


PACKED_FILES = 64  # a packed file is read by one task


def land_posts(spark: SparkSession, sf_dir: str, files: int = LANDED_FILES, packed: bool = False) -> str:
    """Write the API bodies as landed files and return their folder."""
    folder = scratch_path(spark, "landing")
    posts = landing.parse_posts(landed_bodies(spark, sf_dir)).repartition(files, "site_id", "id")
    with shuffles_dropped(spark):
        posts.write.json(folder, compression="gzip" if packed else "none")
    return folder


@register(ORACLES["rest_normalize"])
def stream_posts(spark, sf_dir):
    """The flattened landed posts, through a stream into Parquet."""
    sink, checkpoint = scratch_path(spark, "streamed"), scratch_path(spark, "checkpoint")
    stream = ingest.normalize_posts(crawl.stream_posts(spark, land_posts(spark, sf_dir), 2), load(spark, sf_dir, "sites"))
    (stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return _plain(spark.read.schema(stream.schema).parquet(sink))


@register(with_views("articles", "sites") + f"""
select a.site_id, post_id, 'T ' || post_id as title, trim(regexp_replace(content, '\\s+', ' ', 'g')) as content,
  {_ts('modified_at')}, strftime(greatest(s.last_modified, max(modified_at) over (partition by a.site_id)), '%Y-%m-%d %H:%M:%S') as mark
from articles a join sites s on s.id = a.site_id""")
def stream_upsert(spark, sf_dir):
    """Landed posts merged into a store that holds older versions of all articles; marks moved."""
    folder = land_posts(spark, sf_dir, PACKED_FILES, packed=True)
    store_path, sites_path = scratch_path(spark, "store"), scratch_path(spark, "sites")
    older = load(spark, sf_dir, "articles").withColumn("title", F.lit("old"))
    with held(older, "older") as older:  # so that its join and the store's shuffle are not on disk together
        store.write_posts(older, store_path, slices=2)
    store.write_sites(load(spark, sf_dir, "sites"), sites_path)
    run = crawl.stream_upsert(spark, folder, scratch_path(spark, "checkpoint"), store=store_path, sites=sites_path,
                              now=_now(), slices=2)
    run.awaitTermination()
    marks = store.read_sites(spark, sites_path).select(F.col("id").alias("site_id"), F.col("last_modified").alias("mark"))
    return _plain(store.read_posts(spark, store_path).join(marks, "site_id").select(
        "site_id", "post_id", "title", "content", "modified_at", "mark"))


@register(with_views("articles") + """
select site_id, strftime(max(modified_at), '%Y-%m-%d %H:%M:%S') as newest from articles group by site_id""")
def stream_marks(spark, sf_dir):
    sink = scratch_path(spark, "marks")
    landed = crawl.stream_posts(spark, land_posts(spark, sf_dir), 2)
    posts = landed.select("site_id", post_fn.parse_utc(post_fn.first_date(
        F.col("modified_gmt"), F.col("modified"))).alias("modified_at"))
    crawl.stream_marks(posts, scratch_path(spark, "checkpoint"), sink).awaitTermination()
    return _plain(spark.read.parquet(sink))
