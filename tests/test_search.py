import datetime as dt
import math
import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import Row, functions as F

from yomisaku import schemas
from yomisaku.functions.text import with_index_text
from yomisaku.operators import index as ix, query, search, search_sql
from yomisaku.session import scratch_path

WORDS = ["the", "of", "then", "theory", "a", "東", "京", "駅", "x", "caffè", "foo-bar", "end."]
QUERIES = ["the", '"of the"', '"the the"', "a the", '"東京"', "東京駅", "caffe", "caffè", "foo-bar", '"foo bar"', "th",
           "東the", "zzz", "・", "・ the", '"end a"', "x of", "%%%", "of-the"]


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(7)

    def some(n):
        return " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, n)))
    rows = []
    for i in range(120):
        # One site holds a third of the posts, plus one widget row per site.
        site = "s0" if i % 3 == 0 else f"s{1 + i % 4}"
        rows.append((site, i, f"https://{site}/{i}", some(4), some(6), some(30), "", None if i % 7 == 0 else day(i % 20),
                     day(i), "|News|A_b|" if i % 2 else "", "|t1|" if i % 5 else "|t2|"))
    for k in range(5):
        rows.append((f"s{k}", -1, f"https://s{k}", f"ウィジット (s{k})", "the", "the of side", "", day(50), day(50), "", ""))
    posts = spark.createDataFrame(rows, schemas.POSTS)
    sites = spark.createDataFrame(
        [(f"s{k}", f"Site {k}", f"https://s{k}", "corporate" if k % 2 else "backlink", None, None) for k in range(7)],
        schemas.SITES)
    index = ix.write_index(posts, scratch_path(spark, "test-index"))
    return posts, sites, index, rows


def fields_of(spark, posts):
    """Terms of each field per post, by the column functions only."""
    return {(r.site_id, r.post_id): [r.title, r.excerpt, r.content] for r in ix._with_terms(posts).collect()}


def times(clause, field):
    kind, terms = clause
    n = len(terms)
    if n == 0:
        return 0

    def fits(at):
        for i, t in enumerate(terms):
            open_end = i == n - 1 and kind in ("prefix", "phrase_prefix")
            if not (field[at + i].startswith(t) if open_end else field[at + i] == t):
                return False
        return True
    return sum(fits(at) for at in range(len(field) - n + 1))


def test_matches_and_scores_like_brute_force(spark, tables):
    posts, sites, index, _ = tables
    searches = spark.createDataFrame(list(enumerate(QUERIES)), "query_id bigint, q string")
    compiled = query.compile_queries(searches)
    got = {}
    for r in search.rank_bm25(search.clause_hits(compiled, index), index.corpus).collect():
        got.setdefault(r.query_id, {})[r.site_id, r.post_id] = r.score
    docs = fields_of(spark, posts)
    lengths = {d: sum(map(len, fields)) for d, fields in docs.items()}
    average = sum(lengths.values()) / len(lengths)
    by_query = {}
    for r in compiled.orderBy("clause_no").collect():
        by_query.setdefault(r.query_id, []).append((r.kind, r.terms))
    for i, q in enumerate(QUERIES):
        clauses = by_query.get(i, [])
        tf = {d: [sum(times(c, f) for f in fields) for c in clauses] for d, fields in docs.items()}
        idf = []
        for k in range(len(clauses)):
            df = sum(t[k] > 0 for t in tf.values())
            idf.append(max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6))
        want = {d: sum(w * t * 2.2 / (t + 1.2 * (0.25 + 0.75 * lengths[d] / average)) for w, t in zip(idf, ts))
                for d, ts in tf.items() if clauses and all(ts)}
        assert got.get(i, {}).keys() == want.keys(), q
        assert all(abs(got[i][d] - want[d]) < 1e-5 for d in want), q


def test_deep_pages_equal_shallow_ones(spark, tables, monkeypatch):
    posts, sites, index, _ = tables
    options = {"limit": 25, "offset": 10}
    want = sorted(map(str, search.search_posts(posts, sites, index, "th", **options).collect()))
    urls = sorted(map(str, search.export_urls(posts, sites, index, "th", limit=30).collect()))
    monkeypatch.setattr(search, "HEAP_ROWS", 0)
    assert sorted(map(str, search.search_posts(posts, sites, index, "th", **options).collect())) == want
    assert sorted(map(str, search.export_urls(posts, sites, index, "th", limit=30).collect())) == urls
    whole = search.export_urls(posts, sites, index, "th").orderBy("rn").collect()
    assert sorted(map(str, whole[:len(urls)])) == urls and want


def test_export_has_no_last_row(spark):
    found = spark.range(25000, numPartitions=7).select(F.lit("s").alias("site_id"), F.col("id").alias("post_id"), F.lit(0.0).alias("score"),
                                                       (F.lit("2024-01-01").cast("timestamp_ntz")).alias("published_at"))
    got = search.numbered(found, search.result_order("newest", False))
    assert got.filter(F.col("rn") != F.col("post_id") + 1).count() == 0 and got.count() == 25000


def test_any_number_of_terms_prunes_the_scan(spark, tables, tmp_path):
    posts, sites, _, _ = tables
    index = ix.write_index(posts, str(tmp_path / "index"))
    q = " ".join(f'"{w}"' for w in ["the", *[f"zq{i}" for i in range(80)]])
    hits = search.clause_hits(query.compile_queries(search.single_search(spark, q)), index)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(term" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(map(str, hits.select("post_id", "tf").collect())) == sorted(map(str, search.clause_hits(
        query.compile_queries(search.single_search(spark, '"the"')), index).select("post_id", "tf").collect()))


def many(spark):
    rows = []
    for i, q in enumerate(QUERIES):
        rows.append((i, q, ["s0", "s1", "s1"] if i % 4 == 1 else None, "corporate" if i % 4 == 2 else None,
                     ["news"] if i % 5 == 3 else None, ["T1", "t9"] if i % 6 == 4 else None, False,
                     ["relevance", "newest", "oldest", "odd"][i % 4], 3 + i, i % 3))
    rows.append((100, "", None, None, None, None, True, "newest", 30, 0))
    rows.append((101, None, None, None, None, None, None, None, None, None))
    rows.append((102, "", ["s2"], None, None, None, False, "oldest", 500, -4))
    rows.append((103, "", None, "backlink", None, None, False, "relevance", 30, 5))
    rows.append((104, "the", [], "", [], [], False, "relevance", 0, 0))
    return spark.createDataFrame(rows, schemas.SEARCH)


def test_many_equals_single_searches(spark, tables):
    posts, sites, index, _ = tables
    searches = many(spark)
    columns = ["rn", "total_count", "score", "site_id", "post_id", "url", "categories"]
    got = {}
    for r in search.search_many(posts, sites, index, searches).collect():
        got.setdefault(r.query_id, []).append(tuple(r[c] for c in columns))
    for s in searches.collect()[::2]:
        page = search.search_posts(
            posts, sites, index, s.q or "", sort=s.sort or "relevance", limit=30 if s.lim is None else s.lim,
            offset=s.off or 0, site_ids=s.site_ids, group_id=s.group_id, categories=s.categories, tags=s.tags,
            widgets_only=bool(s.widgets_only))
        want = sorted(tuple(r[c] for c in columns) for r in page.collect())
        assert sorted(got.get(s.query_id, [])) == want, s.q


def test_many_searches_by_place_and_name_like_brute_force(spark, tables):
    """Searches without text: every place with no name, one name, several, of one taxonomy or both, repeated, NULL."""
    posts, sites, index, rows = tables
    names = [(None, None), (["NEWS"], None), (["news", "News", None], None), (["news", "event"], None), (None, ["t1", "T2"]),
             (["news"], ["t1", "t2", "t1"]), (["a_b"], ["T2"]), ([None], None), ([None], ["t1"]), (["none"], None), (None, ["t2"])]
    places = [(None, None), (["s0", "s2", "s0", "gone"], None), (["s0", "s1", "s2"], "corporate"), ([None], None), (None, "backlink")]
    asked = [(i, "" if i % 2 else None, site_ids, group, categories, tags, i % 7 == 0, ["newest", "oldest", "relevance"][i % 3], 4 + i % 90, i % 4)
             for i, ((categories, tags), (site_ids, group)) in enumerate((n, p) for n in names for p in places)]
    got = {}
    for r in search.search_many(posts, sites, index, spark.createDataFrame(asked, schemas.SEARCH)).collect():
        got.setdefault(r.query_id, []).append((r.rn, r.total_count, r.site_id, r.post_id))

    def has_any(wanted, names):
        return not wanted or bool({n.lower() for n in wanted if n} & set(names.lower().strip("|").split("|")))
    for i, _, site_ids, group, categories, tags, widgets, sort, lim, off in asked:
        found = [(r[7], r[0], r[1]) for r in rows if (not site_ids or r[0] in site_ids)
                 and (group is None or group == ("corporate" if int(r[0][1]) % 2 else "backlink"))
                 and has_any(categories, r[9]) and has_any(tags, r[10]) and (r[1] == -1) == widgets]
        sign = 1 if sort == "oldest" else -1
        found.sort(key=lambda f: (f[0] is None, sign * f[0].toordinal() if f[0] else 0, f[1], f[2]))
        want = [(n + 1, len(found), f[1], f[2]) for n, f in enumerate(found)][off:off + lim]
        assert sorted(got.get(i, [])) == want, asked[i]
    assert len(got) >= 20


def test_pages_partition_the_result(spark, tables):
    posts, sites, index, _ = tables
    whole = search.search_posts(posts, sites, index, "the", limit=100).orderBy("rn").collect()
    parts = [r for off in range(0, 100, 40)
             for r in search.search_posts(posts, sites, index, "the", limit=40, offset=off).orderBy("rn").collect()]
    assert [(r.rn, r.site_id, r.post_id) for r in parts][:len(whole)] == [(r.rn, r.site_id, r.post_id) for r in whole]
    assert [r.rn for r in whole] == list(range(1, len(whole) + 1))


@pytest.mark.parametrize("sort", ["newest", "oldest"])
def test_missing_dates_come_last(spark, tables, sort):
    posts, sites, index, _ = tables
    dates = [r.published_at for r in search.search_posts(
        posts, sites, index, "", sort=sort, limit=100, site_ids=["s1", "s2"]).orderBy("rn").collect()]
    known = [d for d in dates if d is not None]
    assert dates == known + [None] * (len(dates) - len(known)) and len(known) < len(dates)
    assert known == sorted(known, reverse=sort == "newest")


PHRASES = ['"the of"', '"the the the"', '"of the then a x"', '"東京駅"', '"東京"', "東京駅", '"駅 the"', '"the rare of the"', '"rare of"',
           '"of rare"', '"the zzz of the"', "the-of-th", "foo-bar", '"caffe the foo bar the"', '"the of" "of the"']


def phrase_posts(spark):
    rng = random.Random(11)
    rows = []
    for i in range(90):
        words = [rng.choice(WORDS) for _ in range(rng.randint(0, 60))]
        if i % 30 == 0:
            words[5:5] = ["the", "rare", "of", "the"]
        # Pairs must not reach over the end of a field.
        rows.append((f"s{i % 3}", i, "the" if i % 2 else "", "of" if i % 4 else None, " ".join(words)))
    return spark.createDataFrame(rows, "site_id string, post_id bigint, title string, excerpt string, content string")


def phrase_hits(spark, index):
    searches = spark.createDataFrame([(str(i), q) for i, q in enumerate(PHRASES)], "query_id string, q string")
    return sorted(map(str, search.clause_hits(query.compile_queries(searches), index).collect()))


def test_pairs_of_hot_terms_give_the_hits_of_whole_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "HOT_SHARE", 16)  # in few posts even rare terms are in one of 128
    posts, path = phrase_posts(spark), str(tmp_path / "index")
    index = ix.write_index(posts, path)
    hot = {r.term for r in index.hot.collect()}
    assert {"the", "of", "東", "京", "駅"} <= hot and not {"rare", "zzz"} & hot
    assert all(set(r.term.split(" ")) <= hot for r in index.pairs.collect())
    want = phrase_hits(spark, ix.build_index(posts))
    assert phrase_hits(spark, index) == want and phrase_hits(spark, index._replace(hot=None, pairs=None)) == want
    found = {r.term: r.positions for r in index.pairs.filter("site_id = 's0' and post_id = 0").collect()}
    fields = ix._with_terms(posts).filter("post_id = 0").first()
    start = 2 << ix.FIELD_SHIFT
    assert found["of the"] == [start + i for i, two in enumerate(zip(fields.content, fields.content[1:])) if two == ("of", "the")]

    # A later generation keeps the hot terms of its version, whatever the corpus becomes.
    changed = spark.createDataFrame([("s0", 0, "the rare", "rare of the", "of rare 東京駅"), ("s9", 1, None, "", "the the the of")], posts.schema)
    deleted = spark.createDataFrame([("s1", 1)], "site_id string, post_id bigint")
    now = posts.filter("not (post_id = 0 or post_id = 1)").unionByName(changed)
    want = phrase_hits(spark, ix.build_index(now))
    assert phrase_hits(spark, ix.refresh_index(index, changed, deleted)) == want
    assert phrase_hits(spark, ix.append_index(changed, deleted, path, 1)) == want
    assert phrase_hits(spark, ix.write_index(now, path)) == want


def test_a_phrase_of_hot_terms_reads_pairs_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "HOT_SHARE", 16)  # in few posts even rare terms are in one of 128
    index = ix.write_index(phrase_posts(spark), str(tmp_path / "index"))

    def units(q):
        slots = query.clause_slots(query.compile_queries(search.single_search(spark, q)))
        return [(r.unit, r.slot, r.term, r.n_slots) for r in search._phrase_units(slots, index.hot).orderBy("clause_no", "slot").collect()]
    assert units('"the of the"') == [("pair", 0, "the of", 2), ("pair", 1, "of the", 2)]
    assert units('"the rare of the"') == [("place", 0, "the", 3), ("place", 1, "rare", 3), ("pair", 2, "of the", 3)]
    assert units("the-of-th") == [("pair", 0, "the of", 2), ("place", 2, "th", 2)]
    assert units('"the" rare') == [("word", 0, "the", 1), ("word", 0, "rare", 1)]
    empty = ix.write_index(phrase_posts(spark).limit(0), str(tmp_path / "empty"))
    assert empty.hot.count() == empty.pairs.count() == 0 and phrase_hits(spark, empty) == []


def test_phrase_stays_in_its_field_and_prefix_covers_exact(spark, tables):
    posts, sites, index, _ = tables
    split = spark.createDataFrame([("s", 1, "alpha", "beta", "x alpha beta"), ("s", 2, "alpha", "beta", "x")],
                                  "site_id string, post_id bigint, title string, excerpt string, content string")
    small = ix.build_index(split)
    hits = search.clause_hits(query.compile_queries(search.single_search(spark, '"alpha beta"')), small).collect()
    assert [(h.post_id, h.tf, h.tf_content) for h in hits] == [(1, 1, 1)]

    def keys(q):
        return {(r.site_id, r.post_id) for r in search.matches(posts, sites, index, q, rank=None)[0].collect()}
    assert keys('"the"') < keys("the")
    assert keys('"of the"') <= keys('"of" "the"')


def test_class_weights_order_the_fields(spark, tables):
    docs = spark.createDataFrame([("s", 1, "word", "", ""), ("s", 2, "", "word", ""), ("s", 3, "", "", "word word word")],
                                 "site_id string, post_id bigint, title string, excerpt string, content string")
    hits = search.clause_hits(query.compile_queries(search.single_search(spark, "word")), ix.build_index(docs))
    ranked = search.rank_weighted(hits).orderBy(F.desc("score")).collect()
    assert [r.post_id for r in ranked] == [1, 2, 3]


def test_export_and_page_numbers(spark, tables):
    posts, sites, index, _ = tables
    urls = search.export_urls(posts, sites, index, "", sort="oldest").orderBy("rn").collect()
    assert len(urls) == 120 and len({u.url for u in urls}) == 120
    page = search.search_posts(posts, sites, index, "", sort="newest", limit=20, offset=40)
    info = search.page_info(page, 2, 20).first()
    assert (info.total, info.shown_from, info.shown_to, info.pages, info.first_button, info.last_button) == (
        120, 41, 60, 6, 1, 5)
    assert search.page_info(page.filter("false"), 2, 20).count() == 0


def test_term_filter_ignores_case_and_takes_wildcards_literally(spark, tables):
    posts, *_ = tables
    assert search.filter_terms(posts, ["a_B"]).count() == 60
    assert search.filter_terms(posts, ["a%"]).count() == 0
    assert search.filter_terms(posts, ["news"], ["t1", "t2"]).count() == 60


def test_no_search_plan_has_a_nested_loop_or_product(spark, tables):
    posts, sites, index, _ = tables
    for df in (search.search_posts(posts, sites, index, 'th "of the"', group_id="corporate"),
               search.search_many(posts, sites, index, many(spark))):
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def asked(spark, rows):
    """A table of searches with their compiled text."""
    table = spark.createDataFrame(rows, schemas.SEARCH)
    return table, table.join(search_sql.text_queries(table.select("query_id", "q")), "query_id")


def test_sql_function_in_a_lateral_join(spark, tables):
    posts, sites, index, _ = tables
    search_sql.register_search(posts, sites, index)
    rows = [(i, q, None, None, None, None, False, "relevance", 200, 0) for i, q in enumerate(QUERIES)]
    rows += [(100, "the", ["s0", "s2"], None, None, None, False, "newest", 5, 3), (101, "th", None, "corporate", None, None, False, "oldest", 7, 0),
             (102, "", None, "backlink", None, None, False, "relevance", 9, 4), (103, "of", None, None, None, None, True, "newest", 50, 0),
             (104, "", [], None, None, None, False, "newest", 5, 0), (105, "the", None, None, None, None, False, "relevance", 4, 10_000)]
    table, compiled = asked(spark, rows)
    compiled.createOrReplaceTempView("asked")
    got = spark.sql("""select query_id, rn, site_id, post_id, total_count, rank from asked, lateral search_posts(
        fts_query, nullif(site_ids, array()), group_id, sort, lim, off, widgets_only)""").collect()
    want = search.search_many(posts, sites, index, table).select("query_id", "rn", "site_id", "post_id", "total_count", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len({r.query_id for r in got}) > 15


def test_sql_function_by_itself(spark, tables):
    posts, sites, index, _ = tables
    search_sql.register_search(posts, sites, index)
    for q, options, arguments in [("of", {"limit": 6, "offset": 2}, "p_limit => 6, p_offset => 2"), ("", {"sort": "oldest"}, "p_sort => 'oldest'"),
                                  ('"of the"', {"site_ids": ["s0"]}, "p_site_ids => array('s0')"), ("・", {}, "p_limit => 30")]:
        text = search_sql.text_query(spark, q)
        got = spark.sql(f"select rn, site_id, post_id, title, total_count, rank from search_posts(:q, {arguments})", {"q": text}).collect()
        page = search.search_posts(posts, sites, index, q, **options)
        assert sorted(map(tuple, got)) == sorted(map(tuple, page.select("rn", "site_id", "post_id", "title", "total_count", "score").collect()))
    assert search_sql.text_query(spark, 'th "of the" ・') == "th:* & of <-> the & !"
    assert spark.sql("select count(*) from search_posts()").first()[0] == 30


def test_an_index_is_written_from_texts_prepared_once(spark, tmp_path, monkeypatch):
    """Terms, lengths and pairs are read from one written preparation, and equal those made by plain steps."""
    rows = [("s", 1, "Of the", "the", "a of the of  the é-b"), ("s", 1, "", "", ""), (None, 2, "東京 the", "", "of the_of"), ("t", None, "x", "x x", "")]
    posts = spark.createDataFrame(rows, "site_id string, post_id bigint, title string, excerpt string, content string")
    prepared, real = [], ix.index_terms_text
    monkeypatch.setattr(ix, "index_terms_text", lambda text: prepared.append(1) or real(text))
    index = ix.write_index(posts, str(tmp_path / "index"))
    assert len(prepared) <= 3 * 3  # three fields: the posts, and two plans of no rows
    want = []
    for r in ix._with_terms(posts).collect():
        fields = [r.title, r.excerpt, r.content]
        at = {}
        for n, terms in enumerate(fields):
            for i, t in enumerate(terms):
                at.setdefault(t, []).append((n << ix.FIELD_SHIFT) + i)
        size = sum(map(len, fields))
        want += [(t, r.site_id, r.post_id, size, *[sum(p >> ix.FIELD_SHIFT == n for p in ps) for n in range(3)], ps) for t, ps in at.items()]
    got = [tuple(r)[:8] for r in index.terms.select(*ix.document_terms(posts).columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    lengths = sorted(tuple(r) for r in index.docs.select("doc_len").collect())
    assert lengths == sorted((sum(len(f) for f in (r.title, r.excerpt, r.content)),) for r in ix._with_terms(posts).collect())


def test_a_worker_holds_blocks_of_bounded_text(monkeypatch):
    monkeypatch.setattr(ix, "BLOCK_BYTES", 10)
    batch = pa.RecordBatch.from_pydict({"a": ["1234", "12", "123456789012", "", "1"], "b": ["1", "123", "1", "", "2"]})
    assert [b.num_rows for b in ix._blocks(batch, ["a", "b"])] == [2, 1, 2]


def test_pruning_of_many_folders_is_one_short_test(spark):
    terms = spark.createDataFrame([(b, t) for b in range(64) for t in ("a", "m", "z")], "bucket int, term string")
    bounds = [Row(bucket=b, low="b" if b % 2 else "a", high="n" if b % 3 else "a") for b in range(64) if b != 7]
    kept = search._only_wanted(terms, bounds)
    want = {(b.bucket, t) for b in bounds for t in ("a", "m", "z") if b.low <= t <= b.high}
    assert {tuple(r) for r in kept.collect()} == want
    assert kept._jdf.queryExecution().analyzed().toString().upper().count(" OR ") < 10


def test_latin_texts_are_split_as_they_are(spark):
    """The JVM only reads whether a Latin text is one; its terms are split and folded in Arrow like those of plain steps."""
    texts = ["A.b É-c_d  Straße/x@y", "ÅÇ ÿ é", "½ x² ×÷ ªµ", "İstanbul İ", "東京・the ｶﾅ", "Ωmega naïve", "é ễ Ǆ", "", None, "...", "plain words"]
    rows = [("s", i, t, texts[-i], " ".join(filter(None, texts[:i]))) for i, t in enumerate(texts)]
    posts = spark.createDataFrame(rows, "site_id string, post_id bigint, title string, excerpt string, content string").coalesce(1)
    prepared = {r.post_id: r.title for r in ix._term_texts(posts).collect()}
    assert prepared[0] == "a.b é-c_d straße/x@y" and prepared[10] == "plain words"
    want = {}
    for r in ix._with_terms(posts).collect():
        for n, terms in enumerate((r.title, r.excerpt, r.content)):
            for i, t in enumerate(terms):
                want.setdefault((r.post_id, t), []).append((n << ix.FIELD_SHIFT) + i)
    assert {(r.post_id, r.term): r.positions for r in ix.document_terms(posts).collect()} == want
    lengths = {r.post_id: r.doc_len for r in ix.doc_stats(posts).collect()}
    assert lengths == {i: sum(len(ps) for (d, _), ps in want.items() if d == i) for i in range(len(texts))}


def test_terms_and_pairs_are_written_in_parts_of_the_documents(spark, tmp_path, monkeypatch):
    """Parts, of texts prepared by the store or only here, give the tables that a single part gives, and hold no copy of the texts."""
    monkeypatch.setattr(ix, "HOT_SHARE", 16)
    posts = phrase_posts(spark)
    whole = ix.write_index(posts, str(tmp_path / "whole"))
    parts, real, root = [], ix._clustered, scratch_path(spark, "x").rsplit("/", 1)[0]
    monkeypatch.setattr(ix, "_clustered", lambda rows: parts.append(1) or real(rows))
    monkeypatch.setattr(ix, "PART_TERMS", 1)
    before = set(os.listdir(root))
    for name, given in (("plain", posts), ("prepared", with_index_text(posts))):
        parts.clear()
        index = ix.write_index(given, str(tmp_path / name))
        assert len(parts) == 2 * ix.PARTS
        for found, want in zip(index, whole):
            assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect()))
    assert not [f for f in set(os.listdir(root)) - before if f.startswith("term-texts")]


def test_prefixes_meet_the_index_without_its_vocabulary(spark, tables):
    """A prefix that begins many terms stays one row; the terms table is neither shuffled nor joined with a long list."""
    posts, sites, index, _ = tables
    searches = spark.createDataFrame([(1, "t"), (2, "th"), (3, '"th"'), (4, "the-o"), (5, "t th o"), (6, "東"), (7, "zzzz")], "query_id bigint, q string")
    hits = search.clause_hits(query.compile_queries(searches), index._replace(vocab=None))
    texts = {(r.site_id, r.post_id): [r.title, r.excerpt, r.content] for r in ix._with_terms(posts).collect()}
    want = set()
    for q, clause, words in [(1, 0, ["t"]), (2, 0, ["th"]), (4, 0, ["the", "o"]), (5, 0, ["t"]), (5, 1, ["th"]), (5, 2, ["o"])]:
        for key, fields in texts.items():
            n = sum(f[i:i + len(words) - 1] == words[:-1] and f[i + len(words) - 1].startswith(words[-1])
                    for f in fields for i in range(len(f) - len(words) + 1))
            if n:
                want.add((q, clause, *key, n))
    got = {(r.query_id, r.clause_no, r.site_id, r.post_id, r.tf) for r in hits.filter("query_id not in (3, 6, 7)").collect()}
    assert got == want and len({w[0] for w in want}) > 2
    plan = search.clause_hits(query.compile_queries(searches.filter("query_id < 3")), index)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_sql_function_joins_terms_with_the_places_of_a_search(spark, tables):
    posts, sites, index, _ = tables
    search_sql.register_search(posts, sites, index._replace(vocab=None))
    for q in ("t", "th", "o", '"of the"', "the-o", "東"):
        text = search_sql.text_query(spark, q)
        found = spark.sql("select rn, site_id, post_id, total_count, rank from search_posts(:q, p_limit => 100)", {"q": text})
        page = search.search_posts(posts, sites, index, q, limit=100)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, page.select("rn", "site_id", "post_id", "total_count", "score").collect()))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin[^\n]*\[bucket", plan) and not re.search(r"SortMergeJoin[^\n]*\[bucket", plan)
