"""Search as the SQL table function ``search_posts``, for a single call or a lateral join with a table of searches."""

from pyspark.sql import DataFrame, functions as F

from yomisaku.operators.index import BUCKETS, FIELDS, Index, bucket_sql
from yomisaku.operators.query import compile_queries
from yomisaku.operators.search import BM25_B, BM25_K1, BM25_MIN_IDF, DEFAULT_LIMIT, single_search

_TF = " + ".join(f"t.tf_{f}" for f, _ in FIELDS)
_RESULT = "site_id, post_id, url, title, excerpt, author, published_at, categories, tags"

_BODY = f"""
with clauses as (
  select pos as clause_no, size(split(fts_query, ' & ')) as n_clauses, split(col, ' <-> ') as lexemes
  from (select posexplode(split(fts_query, ' & ')) as (pos, col)) a where length(fts_query) > 0),
places as (
  select clause_no, n_clauses, size(lexemes) as n_slots, slot, if(endswith(lexeme, ':*'), substr(lexeme, 1, length(lexeme) - 2), lexeme) as stem,
    endswith(lexeme, ':*') as open
  from clauses lateral view posexplode(lexemes) z as slot, lexeme),
slots as (
  select clause_no, n_clauses, n_slots, slot, stem, open, bucket
  from places lateral view explode(if(open and length(stem) < 2, sequence(0, {BUCKETS - 1}), array({bucket_sql("stem")}))) b as bucket),
met as (
  select clause_no, n_clauses, n_slots, t.site_id, t.post_id, t.doc_len, sum({_TF}) as n,
    sort_array(flatten(collect_list(if(n_slots > 1, transform(t.positions, p -> p - slot), null)))) as starts
  from slots s join search_terms t on t.bucket = s.bucket and if(s.open, startswith(t.term, s.stem), t.term = s.stem)
  group by clause_no, n_clauses, n_slots, t.site_id, t.post_id, t.doc_len),
hits as (
  select clause_no, n_clauses, site_id, post_id, doc_len,
    if(n_slots = 1, n, cast(size(filter(starts, (p, i) -> get(starts, i + n_slots - 1) = p)) as bigint)) as tf from met),
rated as (
  select *, count(*) over (partition by clause_no) as df from hits where tf > 0),
scored as (
  select site_id, post_id, round(sum(
      greatest({BM25_MIN_IDF}, ln(((select n_docs from search_corpus) - df + 0.5D) / (df + 0.5D)))
      * (tf * {BM25_K1 + 1}D / (tf + {BM25_K1}D * ({1 - BM25_B}D + {BM25_B}D * doc_len / (select avg_len from search_corpus))))), 6) as score
  from rated group by site_id, post_id, n_clauses having count(*) = n_clauses),
found as (
  select p.*, s.score, true as has_text from scored s join searchable p on p.site_id = s.site_id and p.post_id = s.post_id
  union all
  select p.*, 0.0D as score, false as has_text from searchable p where length(coalesce(fts_query, '')) = 0),
numbered as (
  select {_RESULT}, score, count(*) over () as total_count, row_number() over (order by
      case when p_sort = 'newest' then published_at end desc nulls last,
      case when p_sort = 'oldest' then published_at end asc nulls last,
      case when p_sort not in ('newest', 'oldest') and has_text then score end desc nulls last,
      case when p_sort <> 'oldest' then published_at end desc nulls last, site_id, post_id) as rn
  from found
  where (p_site_ids is null or array_contains(p_site_ids, site_id)) and (p_group_id is null or group_id = p_group_id)
    and (post_id = -1) = p_widgets_only)
select {_RESULT}, total_count, score as rank, cast(rn as bigint) as rn from numbered where rn > p_offset and rn <= p_offset + p_limit"""


def text_queries(searches: DataFrame, profile: str = "local") -> DataFrame:
    """``query_id, q`` to ``query_id, fts_query``: clauses joined by `` & ``, the terms of a phrase by `` <-> ``, an open end
    as ``:*``; empty for a search without text. A clause without terms is ``!``, which no term is."""
    clauses = compile_queries(searches, profile)
    text = F.concat(F.when(F.size("terms") > 0, F.array_join("terms", " <-> ")).otherwise("!"), F.when(F.col("kind").isin("prefix", "phrase_prefix"), ":*").otherwise(""))
    parts = clauses.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("clause_no", text.alias("t")))).alias("c"))
    named = parts.select("query_id", F.array_join(F.col("c.t"), " & ").alias("fts_query"))
    return searches.select("query_id").join(named, "query_id", "left").select("query_id", F.coalesce("fts_query", F.lit("")).alias("fts_query"))


def text_query(spark, q: str, profile: str = "local") -> str:
    """The compiled form of one search text."""
    return text_queries(single_search(spark, q), profile).first().fts_query


def register_search(posts: DataFrame, sites: DataFrame, index: Index) -> None:
    """Make the search callable in SQL as the table function ``search_posts``.

    Arguments, all with defaults: fts_query (of ``text_queries``), p_site_ids, p_group_id, p_sort (relevance, newest
    or oldest), p_limit, p_offset and p_widgets_only. Rows hold the result columns, total_count, rank (BM25) and rn, the place in the
    whole result. It may stand after ``lateral`` with columns of a table of searches as arguments; many searches at
    once are the work of ``search_many``. Posts of unknown sites are not found.

    The few places of a search are joined with the terms by folder, not the many terms that begin with them.
    """
    spark = posts.sparkSession
    known = sites.select(F.col("id").alias("site_id"), "group_id")
    posts.select(*_RESULT.split(", ")).join(known, "site_id").createOrReplaceTempView("searchable")
    index.terms.createOrReplaceTempView("search_terms")
    index.corpus.createOrReplaceTempView("search_corpus")
    spark.sql(f"""
        create or replace temporary function search_posts(
          fts_query string default '', p_site_ids array<string> default null, p_group_id string default null,
          p_sort string default 'relevance', p_limit int default {DEFAULT_LIMIT}, p_offset int default 0, p_widgets_only boolean default false)
        returns table (site_id string, post_id bigint, url string, title string, excerpt string, author string,
          published_at timestamp_ntz, categories string, tags string, total_count bigint, rank double, rn bigint)
        return {_BODY}""")
