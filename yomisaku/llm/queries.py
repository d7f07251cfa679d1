"""The numbered queries: each applies one operator to its whole table; ``ORACLES`` has DuckDB SQL where it can say it."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from yomisaku.llm import (bpe, chunk_dedup, decontaminate as dc, fill_middle, langid, lexical, licenses, line_dedup, ngram_join, pii, quality,
                          url_filter, warc)
from yomisaku.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    """Register a query under its function's name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


DECONTAMINATE_SQL = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w,
    generate_subscripts(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), 1) as i
  from documents),
item_words as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
windows as (
  select distinct item_id, least(13, len(ws)) as size,
    list_aggregate(ws[k:k + least(13, len(ws)) - 1], 'string_agg', ' ') as win
  from (select item_id, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as k from item_words where len(ws) > 0)),
sizes as (select distinct size from windows),
hits as (
  select d.doc_id, d.i, d.size, x.item_id
  from (select distinct doc_id, i, s.size, list_aggregate(ws[1:s.size], 'string_agg', ' ') as win
        from (select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and 12 following) as ws from words), sizes s
        where len(ws) >= s.size) d
  join windows x on x.size = d.size and x.win = d.win),
hit_words as (select doc_id, count(distinct i + o) as n_hit from (select doc_id, i, unnest(range(0, size)) as o from hits) group by 1),
hit_items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1),
counts as (select doc_id, count(*) as n_words from words group by 1)
select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(n_words, 0) as contaminated
from documents d left join counts using (doc_id) left join hit_words using (doc_id) left join hit_items using (doc_id)
"""


@register(DECONTAMINATE_SQL)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dc.report(dc.benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUALITY_SQL = r"""
with base as (
  select doc_id, lang, source, coalesce(text, '') as text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from documents),
windows as (
  select doc_id, k, list_aggregate(ws[k:k + 4], 'string_agg', ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as k from base where len(ws) >= 5)),
found as (select doc_id, k, count(*) over (partition by doc_id, win) as n from windows),
repeats as (select doc_id, count(distinct k + o) as n_repeat_words
  from (select doc_id, k, unnest(range(0, 5)) as o from found where n > 1) group by 1),
signals as (
  select b.doc_id, lang, source, len(ws) as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(ls) as n_lines, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from base b left join repeats using (doc_id)),
rated as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
    n_symbols / greatest(word_chars, 1) as symbol_rate, n_dup_lines / greatest(n_lines, 1) as dup_line_rate,
    n_repeat_words / greatest(n_words, 1) as repeat_rate, word_chars / greatest(n_words, 1) as word_length
  from signals),
quartiles as (
  select lang, source, grouping_id(lang, source) as g, count(*)::double as n,
    quantile_disc(symbol_rate, 0.25) as s1, quantile_disc(symbol_rate, 0.75) as s3,
    quantile_disc(dup_line_rate, 0.25) as d1, quantile_disc(dup_line_rate, 0.75) as d3,
    quantile_disc(repeat_rate, 0.25) as r1, quantile_disc(repeat_rate, 0.75) as r3,
    quantile_disc(word_length, 0.25) as l1, quantile_disc(word_length, 0.75) as l3
  from rated where not base_failed group by grouping sets ((lang, source), (lang), ())),
own as (
  select lang, source, g, n, greatest(0.05, s3 + 3.0 * (s3 - s1)) as most_s, greatest(0.3, d3 + 3.0 * (d3 - d1)) as most_d,
    greatest(0.1, r3 + 3.0 * (r3 - r1)) as most_r, l1 - (6.0 * (l3 - l1) + 2.0) as least_l, l3 + (6.0 * (l3 - l1) + 2.0) as most_l
  from quartiles),
languages as (
  select o.lang, (o.n * o.most_s + 5.0 * c.most_s) / (o.n + 5.0) as most_s, (o.n * o.most_d + 5.0 * c.most_d) / (o.n + 5.0) as most_d,
    (o.n * o.most_r + 5.0 * c.most_r) / (o.n + 5.0) as most_r, (o.n * o.least_l + 5.0 * c.least_l) / (o.n + 5.0) as least_l,
    (o.n * o.most_l + 5.0 * c.most_l) / (o.n + 5.0) as most_l
  from own o, own c where o.g = 1 and c.g = 3),
fences as (
  select o.lang as g_lang, o.source as g_source, (o.n * o.most_s + 5.0 * c.most_s) / (o.n + 5.0) as most_s,
    (o.n * o.most_d + 5.0 * c.most_d) / (o.n + 5.0) as most_d, (o.n * o.most_r + 5.0 * c.most_r) / (o.n + 5.0) as most_r,
    (o.n * o.least_l + 5.0 * c.least_l) / (o.n + 5.0) as least_l, (o.n * o.most_l + 5.0 * c.most_l) / (o.n + 5.0) as most_l
  from own o join languages c on o.lang is not distinct from c.lang where o.g = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(symbol_rate <= most_s and dup_line_rate <= most_d and repeat_rate <= most_r
    and word_length between least_l and most_l, false) as kept
from rated left join fences on lang is not distinct from g_lang and source is not distinct from g_source
"""


@register(QUALITY_SQL)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


LINES_SQL = r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as s, generate_subscripts(string_split(text, chr(10)), 1) as i
  from documents),
full_lines as (
  select doc_id, i, t, row_number() over (partition by doc_id order by i) as k
  from (select doc_id, i, trim(translate(s, chr(9) || chr(13) || chr(11) || chr(12), '    ')) as t from lines) where t <> ''),
windows as (
  select a.doc_id, a.k, a.t || chr(10) || b.t || chr(10) || c.t as win
  from full_lines a join full_lines b on a.doc_id = b.doc_id and b.k = a.k + 1
  join full_lines c on a.doc_id = c.doc_id and c.k = a.k + 2),
ranked as (
  select doc_id, k, first_value(doc_id) over w as first_doc, first_value(k) over w as first_k
  from windows window w as (partition by win order by doc_id, k rows between unbounded preceding and unbounded following)),
gone as (
  select distinct r.doc_id, l.i from (select doc_id, k, unnest(range(0, 3)) as o, first_doc, first_k from ranked
    where not (doc_id = first_doc and k = first_k)) r
  join full_lines l on l.doc_id = r.doc_id and l.k = r.k + r.o
  where not (r.doc_id = r.first_doc and l.k < r.first_k + 3))
select d.doc_id, case when n_cut > 0 then coalesce(kept, '') else d.text end as text, coalesce(n_cut, 0) as n_cut
from documents d
left join (select doc_id, count(*) as n_cut from gone group by 1) using (doc_id)
left join (select doc_id, string_agg(s, chr(10) order by i) as kept from lines anti join gone using (doc_id, i) group by 1) using (doc_id)
"""


@register(LINES_SQL)
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_cut")


PAGES_SQL = r"""
with base as (select page_id, encode(coalesce(html, '')) as body from pages),
digests as (select page_id, octet_length(body) as payload_bytes, sha1(body) as sha from base),
firsts as (select sha, min(page_id) as first from digests group by 1),
coded as (
  select sha, list_aggregate(list_transform(range(0, 32), lambda g:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
      ((instr('0123456789abcdef', substr(sha, (g * 5) // 4 + 1, 1)) - 1) * 16
       + greatest(instr('0123456789abcdef', substr(sha || '0', (g * 5) // 4 + 2, 1)) - 1, 0))
      >> (3 - (g * 5) % 4)) % 32, 1)), 'string_agg', '') as payload_digest
  from firsts)
select page_id, payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from digests join firsts using (sha) join coded using (sha)
"""


@register(PAGES_SQL)
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_report(table(spark, sf_dir, "pages"))


#: The vocabulary file; every executor has the public tokenizers installed.
def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@register()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path())


SHINGLES_SQL = r"""
with recursive ws as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda w: w <> '') as ws from documents),
shingles as (
  select distinct doc_id, list_aggregate(ws[k:k + 3], 'string_agg', ' ') as s
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) as k from ws where len(ws) > 0)),
sizes as (select doc_id, count(*) as n from shingles group by 1),
common as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
links as (
  select x, y from common join sizes sx on sx.doc_id = x join sizes sy on sy.doc_id = y
  where 100 * c >= 85 * (sx.n + sy.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, e.y from reach r join edges e on e.x = r.other)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id
from documents d left join sizes using (doc_id)
join (select doc_id, min(other) as component_id from reach group by 1) using (doc_id)
"""


@register(SHINGLES_SQL)
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.filter(~langid.held_out()).filter("doc_id is not null"))
    return langid.identify(docs, model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


@register()
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.dedup_chunks(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_cut_bytes")


def _templates_sql() -> str:
    rows = ", ".join(f"({i}, '{name}', '{' '.join(licenses.normal_words(text))}')" for i, (name, text) in enumerate(licenses.TEMPLATES))
    return f"select * from (values {rows}) as t(k, name, words)"


LICENSE_SQL = r"""
with templates as (""" + _templates_sql() + r"""),
template_grams as (
  select k, name, ws[i] || ' ' || ws[i + 1] as g from (select k, name, string_split(words, ' ') as ws from templates) t,
    range(1, 400) r(i) where i < len(ws)),
template_counts as (select k, name, g, count(*) as c from template_grams group by all),
template_sizes as (select k, count(*) as size from template_grams group by 1),
pieces as (
  select distinct doc_id, unnest(list_concat(string_split(text, chr(10)),
    list_filter(string_split_regex(text, '\n[ \t\r]*\n'), lambda p: contains(p, chr(10))),
    case when contains(text, chr(10)) then [text] else [] end)) as p
  from documents),
units as (
  select row_number() over () as u, doc_id,
    list_filter(string_split(regexp_replace(lower(p), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '') as ws from pieces),
unit_grams as (
  select u, doc_id, len(ws) - 1 as size, ws[i] || ' ' || ws[i + 1] as g
  from (select u, doc_id, ws, unnest(range(1, len(ws))) as i from units where len(ws) between 2 and 400)),
unit_counts as (select u, doc_id, size, g, count(*) as c from unit_grams group by all),
matches as (
  select u, doc_id, name, 2.0::double * sum(least(a.c, b.c)) / (any_value(a.size) + any_value(s.size)) as dice
  from unit_counts a join template_counts b using (g) join template_sizes s using (k)
  group by u, doc_id, k, name having 2.0::double * sum(least(a.c, b.c)) / (any_value(a.size) + any_value(s.size)) >= 0.8),
best as (
  select doc_id, arg_min(name, (-dice, name)) as license, max(dice) as dice, count(distinct u) as n_units from matches group by 1),
names as (select doc_id, string_agg(name, ',' order by name) as licenses from (select distinct doc_id, name from matches) group by 1)
select d.doc_id, license, dice, coalesce(licenses, '') as licenses, coalesce(n_units, 0) as n_units
from documents d left join best using (doc_id) left join names using (doc_id)
"""


@register(LICENSE_SQL)
def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


#: The key of the registered query; real data takes a secret one.
PSEUDONYM_KEY = "example key"


@register()
def op10_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents"), PSEUDONYM_KEY).select("doc_id", "text", "n_replaced")


SEARCH_SQL = r"""
with words as (
  select doc_id, rid, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from (select *, row_number() over () as rid from documents)),
counts as (select rid, doc_id, t, count(*) as tf from words group by all),
sizes as (select rid, sum(tf)::bigint as n from counts group by 1),
corpus as (select count(*) as n_docs, sum(n)::bigint as n_terms from sizes),
item_terms as (
  select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
asked as (select item_id, t, count(*) as times from item_terms group by all),
weights as (
  select t, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w
  from counts, corpus where t in (select t from asked) group by t),
scores as (
  select item_id, c.rid, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::bigint as score
  from asked join weights using (t) join counts c using (t) join sizes using (rid), corpus group by all),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank
  from scores where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


@register(SEARCH_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(lexical.index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


MIDDLE_SQL = r"""
with base as (select doc_id, coalesce(text, '') as text, length(coalesce(text, '')) as n, sha256('1:' || doc_id) as sha from documents),
hashed as (select *, ('0x' || sha[1:8])::bigint % (n + 1) as x, ('0x' || sha[9:16])::bigint % (n + 1) as y,
  ('0x' || sha[17:24])::bigint % 100 as h3, ('0x' || sha[25:32])::bigint % 100 as h4 from base),
formed as (select *, least(x, y) as p, greatest(x, y) - least(x, y) as m,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 >= 90 then 'plain'
    when h4 < 20 then 'spm' else 'psm' end as form from hashed),
cut as (select *, substr(text, 1, p) as pre, substr(text, p + 1, m) as mid, substr(text, p + m + 1) as suf from formed)
select doc_id, n, form, case when form <> 'plain' then p end as prefix_chars, case when form <> 'plain' then m end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid
    else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(text) as restored_sha256
from cut
"""


@register(MIDDLE_SQL)
def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.report(table(spark, sf_dir, "documents"))


# The rules that the query judges by.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]

URLS_SQL = r"""
with rules(rule_host, rule_path, said) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
parts as (select row_number() over () as r, page_id, 
  coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages),
fits as (
  select r, arg_max(rule_host || rule_path, length(rule_host) * 1000 + length(rule_path)) as rule,
    arg_max(said, length(rule_host) * 1000 + length(rule_path)) as said
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by r)
select page_id, host, path, rule, coalesce(said, 'allow') as verdict from parts left join fits using (r)
"""


@register(URLS_SQL)
def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_of(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")
