"""Tables of the search engine derived from the given star-schema tables.

The derivations are plain SQL that both Spark and DuckDB run: ``{name}`` is an input, ``{ts}`` the keyword of a
zone-less timestamp literal. Every derivation covers its whole input, whole texts included.
"""

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

# Articles: a title from the first line, NULL dates, blank tags, two categories each.
VIEWS["articles"] = (("documents", "labels"), """
select d.source as site_id, d.doc_id as post_id,
  concat('https://', d.source, '.example.com/', cast(d.doc_id as varchar(20)), '/') as url,
  substr(split_part(d.text, chr(10), 1), 1, 80) as title,
  substr(d.text, 1, 200) as excerpt,
  d.text as content,
  concat('author_', cast(d.doc_id % 7 as varchar(20))) as author,
  case when d.doc_id % 11 = 0 then null
       else {ts} '2024-01-01 00:00:00' + d.doc_id * interval '1' hour end as published_at,
  {ts} '2024-01-01 00:00:00' + d.doc_id * interval '1' hour
       + (d.doc_id % 30) * interval '1' day as modified_at,
  concat('|', d.lang, '|', case when d.n_chars > 2000 then 'long' else 'short' end, '|') as categories,
  case when l.doc_id is null then ''
       else concat('|Quality_', cast(l.quality as varchar(20)), '|toxic_', cast(l.toxic as varchar(20)), '|') end as tags
from {documents} d left join {labels} l on l.doc_id = d.doc_id
""")

# Articles and one widget row per site.
VIEWS["posts"] = (("articles", "documents"), """
select site_id, post_id, url, title, excerpt, content, author, published_at, modified_at, categories, tags
from {articles}
union all
select source, cast(-1 as bigint), concat('https://', source, '.example.com'), concat('widget ', source),
  substr(min(text), 1, 200), min(text), '', {ts} '2024-06-01 00:00:00', {ts} '2024-06-01 00:00:00', '', ''
from {documents} group by source
""")

# Sites: every document source, and one site per supplier, most of them without posts.
VIEWS["sites"] = (("documents", "supplier"), """
select id, concat('site ', substr(id, 4)) as name, concat('https://', id, '.example.com') as url,
  case when cast(substr(id, 4) as int) % 2 = 0 then 'corporate' else 'backlink' end as group_id,
  cast(null as timestamp) as last_crawled_at,
  case when cast(substr(id, 4) as int) % 4 = 0 then null
       else {ts} '2024-01-10 00:00:00' + cast(substr(id, 4) as int) * interval '1' hour end as last_modified
from (select source as id from {documents}
      union select concat('src', cast(s_suppkey as varchar(20))) from {supplier}) x
""")

# Site registry: blank ids and groups, trailing slashes.
VIEWS["registry"] = (("supplier",), """
select case when s_suppkey % 3 = 0 then '' else concat('src', cast(s_suppkey as varchar(20))) end as id,
  s_name as name,
  concat('https://src', cast(s_suppkey as varchar(20)), '.example.com', case when s_suppkey % 2 = 0 then '//' else '' end) as url,
  case when s_suppkey % 5 = 0 then null when s_suppkey % 7 = 0 then '' else 'corporate' end as site_group
from {supplier}
""")

# Store and arrivals: 0 the store, 1 the first batch, 2 and 3 the second batch, overlapping by language and label.
VIEWS["arrivals"] = (("articles", "documents", "labels"), """
select cast(0 as bigint) as seq, a.site_id, a.post_id, a.title, a.modified_at
from {articles} a join {documents} d on d.doc_id = a.post_id where d.lang <> 'de'
union all
select cast(1 as bigint), a.site_id, a.post_id, concat('v1 ', a.title), a.modified_at
from {articles} a join {labels} l on l.doc_id = a.post_id
union all
select cast(2 as bigint), a.site_id, a.post_id, concat('v2 ', a.title), a.modified_at - interval '40' day
from {articles} a join {documents} d on d.doc_id = a.post_id where d.n_chars > 1000
union all
select cast(3 as bigint), a.site_id, a.post_id, concat('v3 ', a.title), a.modified_at
from {articles} a join {documents} d on d.doc_id = a.post_id where d.n_chars > 3000
""")

# Landed API responses.
VIEWS["responses"] = (("events",), """
select event_id, concat('src', cast(user_id as varchar(20))) as site_id,
  cast(case event_id % 7 when 0 then 400 when 1 then 403 when 2 then 404 when 3 then 301 when 4 then 500
       else 200 end as int) as status,
  case when event_id % 14 = 5 then 'text/html; charset=UTF-8' else 'Application/JSON; charset=UTF-8' end as content_type,
  case when event_id % 3 = 0 then null when event_id % 3 = 1 then '' else cast(event_id % 9 as varchar(10)) end as total_pages
from {events}
""")

# Attempts of crawl runs, one per event: some fail.
VIEWS["attempts"] = (("events",), """
select concat('src', cast(user_id as varchar(20)), '-', event_type) as site_id,
  cast(event_id % 97 as bigint) as posts,
  case event_id % 5 when 0 then 'http' when 1 then 'timeout' when 2 then
       case when event_id % 3 = 0 then 'exception' else 'timeout' end else null end as failure
from {events}
""")

# Run history lines.
VIEWS["ledger"] = (("events",), """
select event_id, concat(substr(cast(ts as varchar(40)), 1, 19), ' JST | status=',
  case when event_id % 10 = 0 then 'failure' else 'success' end, ' | sites=', cast(user_id as varchar(20)), ' | posts=',
  case when event_id % 2 = 0 then '?' else cast(event_id as varchar(20)) end) as line
from {events}
""")

# One page per document with one of several ways of stating its date.
VIEWS["dated_pages"] = (("documents",), """
select doc_id, concat('https://', source, '.example.com/read-', cast(doc_id as varchar(20)), '/') as url,
  concat('<html><head><title>D', cast(doc_id as varchar(20)), '</title>',
    case doc_id % 7
      when 0 then concat('<script type="application/ld+json">{{"@graph":[{{"@type":"X"}},{{"datePublished":"2024-02-0', cast(1 + doc_id % 9 as varchar(20)), 'T00:00:00Z"}}]}}</script>')
      when 1 then concat('<meta property="article:published_time" content="2024-03-0', cast(1 + doc_id % 9 as varchar(20)), '"><script type="application/ld+json">{{bad</script>')
      when 3 then concat('<script type="application/ld+json">[{{"datePublished":""}},{{"dateModified":"2024-05-0', cast(1 + doc_id % 9 as varchar(20)), '"}}]</script><meta property="article:published_time" content="2024-06-01T09:00:00+09:00">')
      when 4 then concat('<script type="application/ld+json">{{"headline":"x"}}</script><script type="application/ld+json">{{"datePublished":"2024-07-0', cast(1 + doc_id % 9 as varchar(20)), '","dateModified":"2024-08-01"}}</script><meta property="article:modified_time" content="2024-09-01">')
      when 5 then '<meta property="article:modified_time" content="2024-10-01">'
      else '' end,
    '</head><body><nav>N</nav><article>', case when doc_id % 13 = 0 then '<h1> </h1>' else concat('<h1>H', cast(doc_id as varchar(20)), '</h1>') end,
    case when doc_id % 7 = 2 or doc_id % 7 = 5 then concat('<time datetime="2024-04-0', cast(1 + doc_id % 9 as varchar(20)), '">t</time>') else '' end,
    '<p>', replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '</p></article><footer>F</footer></body></html>') as html
from {documents}
""")

# Archive pages: one per document, listing itself twice, a relative link and a link of another section.
VIEWS["archive_pages"] = (("documents",), """
select source as site_id, concat('<ul><li><a href="https://', source, '.example.com/read-', cast(doc_id as varchar(20)), '">a</a><li>',
  '<a class=x href="https://', source, '.example.com/read-', cast(doc_id as varchar(20)), '///">b</a>',
  '<a name=y>c</a><a href="/read-', cast(doc_id as varchar(20)), '/">d</a>',
  '<a href="https://', source, '.example.com/read-', cast(doc_id as varchar(20)), '/more">e</a>',
  '<a href="see https://', source, '.example.com/read-', cast(doc_id as varchar(20)), '">f</a></ul>') as html
from {documents}
""")

# Japanese-like texts: letters translated to CJK, to half-width and to full-width characters.
VIEWS["texts_ja"] = (("documents",),
    "select doc_id as post_id, translate(text, 'aeiourst.', '東京駅周辺カー・。') as content from {documents}")
VIEWS["texts_half"] = (("documents",),
    "select doc_id as post_id, translate(text, 'aeiourst', 'ｱｲｳｴｵｶｷＡ') as content from {documents}")
VIEWS["texts_full"] = (("documents",),
    "select doc_id as post_id, translate(text, 'aeiourst', 'アイウエオカキA') as content from {documents}")

# Search strings of every shape, from the first words of each document.
VIEWS["typed"] = (("documents",), """
select doc_id as query_id, doc_id % 6 as shape, w1, w2, w3,
  case doc_id % 6
    when 0 then w1
    when 1 then concat('"', w1, ' ', w2, '"')
    when 2 then concat(w1, ' "', w2, '  ', w3, '" ', w3)
    when 3 then concat('"', w1, ' ', w2)
    when 4 then concat('%%% (', w1, ') * ', w2, '-', w3, ':')
    else concat(w1, '東京', w2, ' 駅 *** ') end as q
from (select doc_id,
  coalesce(nullif(regexp_extract(split_part(text, ' ', 1), '[a-zA-Z]+', 0), ''), 'the') as w1,
  coalesce(nullif(regexp_extract(split_part(text, ' ', 2), '[a-zA-Z]+', 0), ''), 'the') as w2,
  coalesce(nullif(regexp_extract(split_part(text, ' ', 3), '[a-zA-Z]+', 0), ''), 'the') as w3 from {documents}) w
""")

# Saved searches: one per benchmark passage, with varying kinds, filters, sorts and pages.
VIEWS["saved"] = (("benchmark",), """
select cast(item_id as bigint) as query_id, kind, w1, w2,
  case kind when 0 then concat('"', w1, ' ', w2, '"') when 1 then concat(w1, ' ', w2)
       when 2 then concat('"', w1, '"') when 3 then '%%%' else w1 end as q,
  case when item_id % 4 = 1 then 'corporate' else null end as group_id,
  case when item_id % 5 = 2 then 'src3' when item_id % 10 = 9 then 'src4' else '' end as site,
  case when item_id % 6 = 3 then 'EN' else '' end as category,
  case when item_id % 8 = 5 then 'quality_1' else '' end as tag,
  (item_id % 11 = 10) as widgets_only,
  case item_id % 3 when 0 then 'relevance' when 1 then 'newest' else 'oldest' end as sort,
  cast(5 + item_id % 20 as int) as lim, cast(item_id % 4 as int) as off
from (select item_id, item_id % 6 as kind,
  coalesce(nullif(lower(regexp_extract(split_part(text, ' ', 1), '[a-zA-Z]+', 0)), ''), 'the') as w1,
  coalesce(nullif(lower(regexp_extract(split_part(text, ' ', 2), '[a-zA-Z]+', 0)), ''), 'the') as w2 from {benchmark}) w
""")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, or a given one, as a Spark plan."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    inputs, sql = VIEWS[name]
    df = spark.sql(sql.replace("{ts}", "timestamp_ntz"), **{i: load(spark, sf_dir, i) for i in inputs})
    return df.withColumn("last_crawled_at", df["last_crawled_at"].cast("timestamp_ntz")) if name == "sites" else df


def with_views(*names: str) -> str:
    """The WITH list that defines the derived tables in DuckDB."""
    ordered: list[str] = []

    def add(name):
        if name in VIEWS and name not in ordered:
            for i in VIEWS[name][0]:
                add(i)
            ordered.append(name)
    for name in names:
        add(name)
    parts = [f"{n} as ({VIEWS[n][1].format(ts='timestamp', **{i: i for i in VIEWS[n][0]})})" for n in ordered]
    return "with " + ",\n".join(parts)
