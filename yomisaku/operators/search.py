"""Matching, ranking, filtering and paging of searches over the index.

Everything works on a table of searches (``SEARCH``); a single search is a one-row table. There is one plan for any
number of searches and terms: tables of terms are written to the shared folder and joined, and Spark picks the join by
their size. What is fetched to prune a scan is bounded by the number of index folders and of prefix lengths.
"""

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F

from yomisaku import schemas
from yomisaku.functions.cards import (
    format_date, highlight, title_or_default, truncate_ellipsis)
from yomisaku.functions.posts import pipe_split
from yomisaku.operators.index import BUCKETS, FIELD_SHIFT, FIELDS, Index, term_bucket
from yomisaku.operators.query import clause_slots, compile_queries
from yomisaku.session import materialize

DOC = ["site_id", "post_id"]
FIELD_NAMES = [name for name, _ in FIELDS]
HIT = ["query_id", *DOC]

# Fixed values of the ranking formulas.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6
CLASS_WEIGHTS = (1.0, 0.4, 0.2)

# Fixed values of the search interface.
DEFAULT_LIMIT = 30
CARD_EXCERPT_CHARS = 200
PAGE_WINDOW = 5

HEAP_ROWS = 10000     # a page that ends later in the result is cut from a distributed sort, not from a heap per task
FEW_FOLDERS = 8       # so many folders are pruned by a range of terms each, which also reaches row groups
_LAST = "\U0010ffff"  # sorts after every letter of a term

RESULT_COLUMNS = ["site_id", "post_id", "url", "title", "excerpt", "author", "published_at", "categories", "tags"]


# ---- matching ---------------------------------------------------------------------------------------------------

def _any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def _only_wanted(terms: DataFrame, bounds: list[Row]) -> DataFrame:
    """Terms between the first and the last wanted one of each index folder; other folders are not read."""
    if not bounds:
        return terms.filter(F.lit(False))
    in_folders = terms.filter(F.col("bucket").isin([b.bucket for b in bounds]))
    if len(bounds) <= FEW_FOLDERS:
        return in_folders.filter(_any_of(
            [(F.col("bucket") == b.bucket) & F.col("term").between(b.low, b.high) for b in bounds]))
    # A test per folder would be too long to compile and run on each row: the folder's bounds are looked up.
    of = {b.bucket: b for b in bounds}
    low, high = (F.array(*[F.lit(getattr(of.get(k), side, None)) for k in range(max(of) + 1)]) for side in ("low", "high"))
    return in_folders.filter(F.col("term").between(min(b.low for b in bounds), max(b.high for b in bounds))
                             & F.col("term").between(F.get(low, F.col("bucket")), F.get(high, F.col("bucket"))))


def _wanted_ranges(slots: DataFrame) -> list[Row]:
    """For each unit and index folder: the first and the last term that slots ask for there, and ``lengths`` of their
    beginnings, 0 for whole terms. A beginning of one letter may be in any folder.
    """
    folders = F.when(F.col("is_prefix") & (F.length("term") < 2), F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(
        F.array(term_bucket()))
    wanted = slots.filter("term is not null").select(
        "unit", "term", F.explode(folders).alias("bucket"), "length",
        F.when(F.col("is_prefix"), F.concat("term", F.lit(_LAST))).otherwise(F.col("term")).alias("last"))
    return wanted.groupBy("unit", "bucket").agg(
        F.min("term").alias("low"), F.max("last").alias("high"), F.collect_set("length").alias("lengths")).collect()


def expand_prefixes(slots: DataFrame, rows: DataFrame, ranges: list[Row]) -> DataFrame:
    """Index rows with the slots whose term they are or begin with.

    An equi join: each row offers its term and its beginnings of the lengths that occur among the prefixes of its folder. The
    few slots are joined as they are, not the many terms that begin with them.
    """
    lengths = {r.bucket: sorted(r.lengths) for r in ranges}
    if any(found != [0] for found in lengths.values()):
        offered = F.array(*[F.array(*[F.lit(n) for n in lengths.get(k, [])]).cast("array<int>") for k in range(BUCKETS)])
        rows = rows.withColumn("length", F.explode(F.get(offered, F.col("bucket")))).filter(F.col("length") <= F.length("term"))
        rows = rows.withColumn("sought", F.when(F.col("length") == 0, F.col("term")).otherwise(
            F.substring("term", F.lit(1), F.col("length"))))
    else:
        rows = rows.withColumns({"length": F.lit(0), "sought": F.col("term")})
    return rows.drop("term").join(slots.withColumnRenamed("term", "sought"), ["length", "sought"])


def clause_hits(clauses: DataFrame, index: Index) -> DataFrame:
    """Documents matching each clause, with its occurrences per field."""
    return _slot_hits(materialize(clause_slots(clauses), "slots"), index)


def _slot_hits(slots: DataFrame, index: Index) -> DataFrame:
    """A clause of one term adds up its terms' counts, in each task before the shuffle. A phrase keeps the start
    positions its terms agree on: each term's positions are shifted back by its place, and a start found for all places is
    an occurrence. Neighbouring hot terms of a phrase are read as one pair.
    """
    length = F.when(F.col("is_prefix"), F.length("term")).otherwise(0).alias("length")
    units = materialize(_phrase_units(slots, index.hot).select("*", length), "units")
    clause, counts = [*HIT, "clause_no", "n_clauses", "doc_len"], [f"tf_{f}" for f in FIELD_NAMES]
    # Clustering by document alone serves these groupings and the later one per search: one shuffle.
    ranges = _wanted_ranges(units)

    def found(rows, unit):
        mine = [r for r in ranges if r.unit == unit]
        return expand_prefixes(units.filter(F.col("unit") == unit), _only_wanted(rows, mine), mine)
    words = found(index.terms, "word").groupBy(*clause).agg(
        *[F.sum(c).alias(c) for c in counts])
    starts = [*clause, "n_slots", "transform(positions, p -> p - slot) as starts"]
    places = found(index.terms, "place").selectExpr(*starts)
    if index.pairs is not None:
        places = places.unionByName(found(index.pairs, "pair").selectExpr(*starts))
    grouped = places.repartition(*HIT).groupBy(*clause, "n_slots").agg(
        F.expr("sort_array(flatten(collect_list(starts)))").alias("starts"))
    # In sorted starts one found n times is followed by itself n - 1 places on.
    agreed = grouped.selectExpr(*clause, "filter(starts, (p, i) -> get(starts, i + n_slots - 1) = p) as starts")
    phrases = agreed.selectExpr(*clause, *[
        f"cast(size(filter(starts, p -> shiftright(p, {FIELD_SHIFT}) = {i})) as bigint) as tf_{f}"
        for i, f in enumerate(FIELD_NAMES)])
    hits = words.unionByName(phrases)
    return hits.selectExpr("*", f"{' + '.join(counts)} as tf").filter("tf > 0")


def _phrase_units(slots: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Slots with ``unit``: a word by itself, a place in a phrase, or a pair of neighbouring hot terms of a phrase.

    Every two hot neighbours become a pair, so a hot term next to another needs no list of its own. ``n_slots`` counts the
    units of the phrase that are left. The open end of a phrase is never part of a pair.
    """
    words = slots.filter("n_slots = 1").withColumn("unit", F.lit("word"))
    phrases = slots.filter("n_slots > 1")
    if hot is None:
        return words.unionByName(phrases.withColumn("unit", F.lit("place")))
    marked = phrases.join(hot.select("term", F.lit(True).alias("hot")), "term", "left")
    marked = marked.withColumn("hot", F.coalesce(F.col("hot"), F.lit(False)) & ~F.col("is_prefix"))
    clause = Window.partitionBy("query_id", "clause_no")
    order = clause.orderBy("slot")
    marked = marked.select(
        "*", F.lead("term").over(order).alias("following"),
        (F.col("hot") & F.lead("hot", 1, False).over(order)).alias("opens"),
        (F.col("hot") & F.lag("hot", 1, False).over(order)).alias("closes"))
    units = marked.filter("opens or not closes").withColumns({
        "term": F.expr("if(opens, concat(term, ' ', following), term)"),
        "unit": F.expr("if(opens, 'pair', 'place')"),
        "n_slots": F.count("*").over(clause).cast(slots.schema["n_slots"].dataType)})
    return words.unionByName(units.select(words.columns))


def match_all(hits: DataFrame, *scores: Column) -> DataFrame:
    """Documents that match every clause of their search, with aggregates over their clauses."""
    found = hits.groupBy(*HIT).agg(F.count("*").alias("n_found"), F.max("n_clauses").alias("n_clauses"), *scores)
    return found.filter(F.col("n_found") == F.col("n_clauses")).drop("n_found", "n_clauses")


# ---- ranking ----------------------------------------------------------------------------------------------------

def clause_idf(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Weight of each clause by how few documents match it, over the whole corpus."""
    n_docs = corpus.select("n_docs").scalar()
    df = F.col("df")
    idf = F.log((n_docs - df + 0.5) / (df + 0.5))
    return (hits.groupBy("query_id", "clause_no").agg(F.count("*").alias("df"))
            .select("query_id", "clause_no", F.when(idf > 0, idf).otherwise(BM25_MIN_IDF).alias("idf")))


def rank_bm25(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Documents matching all clauses with their BM25 score, higher is better. A clause counts as one unit.

    ``hits`` is read twice, once to count each clause's documents; give it written if it is costly.
    """
    idf = clause_idf(hits, corpus)
    average = corpus.select("avg_len").scalar()
    tf = F.col("tf")
    saturated = tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("doc_len") / average))
    scored = hits.join(idf, ["query_id", "clause_no"])
    return match_all(scored, F.round(F.sum(F.col("idf") * saturated), 6).alias("score"))


def rank_weighted(hits: DataFrame, weights=CLASS_WEIGHTS) -> DataFrame:
    """Documents matching all clauses, scored by the weight classes of the fields they match in.

    Counts are damped as ``tf / (tf + 1)``, so a hit in a higher class outweighs repetition in a lower one.
    """
    score = sum(F.col(f"tf_{f}") / (F.col(f"tf_{f}") + 1) * w for f, w in zip(FIELD_NAMES, weights))
    return match_all(hits, F.round(F.sum(score), 6).alias("score"))


def _ranked(slots: DataFrame, index: Index, rank: str | None) -> DataFrame:
    """Matching documents, with a score unless ``rank`` is None."""
    hits = _slot_hits(slots, index)
    if rank is None:
        return match_all(hits)
    if rank == "weighted":
        return rank_weighted(hits)
    # Written once, then read to count and to score.
    return rank_bm25(materialize(hits, "hits"), index.corpus)


# ---- filters ----------------------------------------------------------------------------------------------------

def filter_sites(posts: DataFrame, site_ids: list[str] | None) -> DataFrame:
    return posts.filter(F.col("site_id").isin(list(site_ids))) if site_ids else posts


def filter_group(posts: DataFrame, sites: DataFrame, group_id: str | None) -> DataFrame:
    if not group_id:
        return posts
    members = sites.filter(F.col("group_id") == group_id).select(F.col("id").alias("site_id"))
    return posts.join(members, "site_id", "left_semi")


def _has_any(column: str, names: list[str]) -> Column:
    wanted = F.array(*[F.lower(F.lit(n)) for n in names])
    return F.arrays_overlap(pipe_split(F.lower(column)), wanted)


def filter_terms(posts: DataFrame, categories: list[str] | None = None,
                 tags: list[str] | None = None) -> DataFrame:
    """Any of the categories and any of the tags, ignoring case."""
    for column, names in (("categories", categories), ("tags", tags)):
        if names:
            posts = posts.filter(_has_any(column, names))
    return posts


def filter_widgets(posts: DataFrame, widgets_only: bool = False) -> DataFrame:
    """Only widget rows, or everything but them."""
    is_widget = F.col("post_id") == schemas.WIDGET_POST_ID
    return posts.filter(is_widget if widgets_only else ~is_widget)


# ---- one search -------------------------------------------------------------------------------------------------

def single_search(spark: SparkSession, q: str) -> DataFrame:
    return spark.createDataFrame(pa.table({"query_id": [0], "q": [q]}))


def result_order(sort: str, has_text: bool) -> list[Column]:
    """Sort keys; NULL dates come last either way, unknown sorts mean relevance."""
    tie = [F.col("site_id"), F.col("post_id")]
    if sort == "oldest":
        return [F.col("published_at").asc_nulls_last(), *tie]
    newest = F.col("published_at").desc_nulls_last()
    if sort == "newest" or not has_text:
        return [newest, *tie]
    return [F.col("score").desc(), newest, *tie]


def matches(posts: DataFrame, sites: DataFrame, index: Index, q: str = "", *, site_ids=None, group_id=None,
            categories=None, tags=None, widgets_only: bool | None = False, rank: str | None = "bm25",
            profile: str = "local") -> tuple[DataFrame, bool]:
    """All posts a search finds, unordered, and whether it had a text part.

    Only the columns that order a result are carried: ``site_id``, ``post_id``, ``published_at`` and, unless
    ``rank`` is None, ``score``. ``widgets_only=None`` searches articles and widget rows alike. Posts of unknown sites
    are not found.
    """
    found = posts if widgets_only is None else filter_widgets(posts, widgets_only)
    found = filter_terms(filter_group(filter_sites(found, site_ids), sites, group_id), categories, tags)
    found = found.join(sites.select(F.col("id").alias("site_id")), "site_id", "left_semi")
    found = found.select(*DOC, "published_at")
    searches = single_search(posts.sparkSession, q)
    slots = materialize(clause_slots(compile_queries(searches, profile)), "slots")
    if slots.isEmpty():
        return (found if rank is None else found.withColumn("score", F.lit(0.0))), False
    return found.join(_ranked(slots, index, rank).drop("query_id"), DOC), True


def search_posts(posts: DataFrame, sites: DataFrame, index: Index, q: str = "", *, sort: str = "relevance",
                 limit: int = DEFAULT_LIMIT, offset: int = 0, rank: str = "bm25", max_limit: int | None = None,
                 **filters) -> DataFrame:
    """One page of a search: result columns, ``total_count``, ``score`` and ``rn``, the place in the whole result.

    Every row has its score, however the result is sorted, as in ``search_many``. ``max_limit`` bounds the page for
    callers that serve others.
    """
    limit, offset = clamp_page(limit, offset, max_limit)
    found, has_text = matches(posts, sites, index, q, rank=rank, **filters)
    page = _numbered(found, result_order(sort, has_text), limit, offset)
    page = page.withColumn("total_count", found.agg(F.count("*")).scalar())
    return _with_result_columns(page.drop("published_at"), posts)


def _with_result_columns(page: DataFrame, posts: DataFrame) -> DataFrame:
    """Fetch the wide columns of the chosen rows only."""
    lists = {c: pipe_split(F.col(c)) for c in ("categories", "tags")}
    rows = posts.select(*RESULT_COLUMNS).join(page, DOC).withColumns(lists)
    first = [c for c in page.columns if c not in DOC]
    return rows.select(*first, *RESULT_COLUMNS)


def clamp_page(limit: int, offset: int, max_limit: int | None = None) -> tuple[int, int]:
    return max(1, limit if max_limit is None else min(limit, max_limit)), max(0, offset)


def numbered(found: DataFrame, order: list[Column]) -> DataFrame:
    """All rows with their place ``rn`` in the order, from a distributed sort.

    A row's place is its place in its sorted partition after the rows of the partitions before; only the partitions'
    sizes meet in one task.
    """
    done = materialize(found.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("at", 33).alias("part")
    sizes = done.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return done.withColumn("part", part).join(before, "part").withColumn("rn", place).drop("part", "at", "before")


def _numbered(found: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page with its row numbers; a shallow one from the first rows of each task."""
    if offset + limit > HEAP_ROWS:
        return numbered(found, order).filter((F.col("rn") > offset) & (F.col("rn") <= offset + limit))
    page = found.orderBy(*order).offset(offset).limit(limit)
    place = F.row_number().over(Window.orderBy(*order)).cast("bigint")
    return page.withColumn("rn", place + offset)


def export_urls(posts: DataFrame, sites: DataFrame, index: Index, q: str = "", *, sort: str = "relevance",
                rank: str = "bm25", limit: int | None = None, **filters) -> DataFrame:
    """Non-blank urls of all results of a search, or of the first ``limit``, with their places."""
    by_date = sort in ("newest", "oldest")
    found, has_text = matches(posts, sites, index, q, rank=None if by_date else rank, **filters)
    order = result_order(sort, has_text)
    placed = numbered(found, order) if limit is None else _numbered(found, order, limit, 0)
    urls = posts.select(*DOC, "url").join(placed.select(*DOC, "rn"), DOC)
    return urls.filter(F.col("url") != "").select("rn", "url")


# ---- many searches ----------------------------------------------------------------------------------------------

def search_many(posts: DataFrame, sites: DataFrame, index: Index, searches: DataFrame,
                rank: str = "bm25", profile: str = "local", max_limit: int | None = None) -> DataFrame:
    """The requested page of every search: ``query_id``, ``rn``, ``total_count``, ``score``, result columns.

    Posts of unknown sites are not found. A search with text is joined by document. One without text and with one name
    at most reads the tops of its scopes, one with several names meets the posts by their names; a search that matches
    everything is ranked in salted parts before its top rows meet.
    """
    searches = materialize(searches, "searches")
    slots = materialize(clause_slots(compile_queries(searches, profile)), "slots")
    request = _requests(searches, max_limit)
    known = sites.select(F.col("id").alias("site_id"), F.col("group_id").alias("site_group"))
    meta = posts.select(*DOC, "published_at", "categories", "tags")
    deepest = request.agg(F.coalesce(F.max("last"), F.lit(0))).first()[0]

    with_text = _ranked(slots, index, rank).join(request, "query_id").join(known, "site_id").join(meta, DOC)
    with_text = with_text.filter(_place_fits() & _names_fit()).withColumn("has_text", F.lit(True))
    blank = request.join(slots.select("query_id").distinct(), "query_id", "left_anti")
    n_names = F.size("names")
    named = _posts_by_names(blank.filter(n_names > 1), meta, known).join(
        request, "query_id").withColumn("score", F.lit(0.0)).withColumn("has_text", F.lit(False))
    columns = ["query_id", *DOC, "published_at", "score", "has_text", "sort", "off", "last"]
    found = materialize(with_text.select(columns).unionByName(named.select(columns)), "found")  # read to count and to cut

    scopes = _request_scopes(blank.filter(n_names <= 1), known)
    tops = _scope_tops(scopes, meta, known, deepest).join(request, "query_id").withColumn(
        "score", F.lit(0.0)).withColumn("has_text", F.lit(False))
    totals = found.groupBy("query_id").agg(F.count("*").alias("total_count")).unionByName(
        _scope_totals(scopes, meta, known))
    return _with_result_columns(_top_pages(found.unionByName(tops.select(columns)), totals, deepest), posts)


def _parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _requests(searches: DataFrame, max_limit: int | None) -> DataFrame:
    none = F.array().cast("array<string>")
    lim = F.coalesce("lim", F.lit(DEFAULT_LIMIT))
    requests = searches.select(
        "query_id",
        F.coalesce("sort", F.lit("relevance")).alias("sort"),
        F.coalesce("site_ids", none).alias("want_sites"),
        F.coalesce("group_id", F.lit("")).alias("want_group"),
        F.transform(F.coalesce("categories", none), F.lower).alias("want_categories"),
        F.transform(F.coalesce("tags", none), F.lower).alias("want_tags"),
        F.coalesce("widgets_only", F.lit(False)).alias("widgets_only"),
        F.least(F.greatest(lim, F.lit(1)), F.lit(max_limit)).cast("bigint").alias("lim"),
        F.greatest(F.coalesce("off", F.lit(0)), F.lit(0)).cast("bigint").alias("off"))
    return requests.withColumn("last", F.col("lim") + F.col("off")).withColumn(
        "names", _names_of(F.col("want_categories"), F.col("want_tags")))


def _names_of(categories: Column, tags: Column) -> Column:
    """Distinct names with their taxonomy, 1 for categories and 2 for tags."""
    def marked(taxonomy, names):
        return F.transform(F.array_distinct(names), lambda n: F.struct(F.lit(taxonomy).alias("taxonomy"), n.alias("name")))
    return F.concat(marked(1, categories), marked(2, tags))


def _post_names() -> Column:
    return _names_of(pipe_split(F.lower("categories")), pipe_split(F.lower("tags")))


def _place_fits() -> Column:
    """Whether a request takes posts of this site and group, and widget rows or articles."""
    sites_match = (F.size("want_sites") == 0) | F.array_contains("want_sites", F.col("site_id"))
    group_matches = (F.col("want_group") == "") | (F.col("want_group") == F.col("site_group"))
    return sites_match & group_matches & ((F.col("post_id") == schemas.WIDGET_POST_ID) == F.col("widgets_only"))


def _names_fit() -> Column:
    def match(column):
        wanted = F.col(f"want_{column}")
        return (F.size(wanted) == 0) | F.arrays_overlap(pipe_split(F.lower(column)), wanted)
    return match("categories") & match("tags")


def _posts_by_names(requests: DataFrame, meta: DataFrame, known: DataFrame) -> DataFrame:
    """Posts that have any wanted name of each taxonomy a request names, by an equi join of single names.

    A post is found once for each name it shares with a request; the taxonomies found are counted as bits.
    """
    needs = F.when(F.size("want_categories") > 0, 1).otherwise(0) + F.when(F.size("want_tags") > 0, 2).otherwise(0)
    wanted = requests.select("query_id", "want_sites", "want_group", "widgets_only", needs.alias("needs"), F.inline("names"))
    offered = meta.join(known, "site_id").select(*DOC, "site_group", "published_at", F.inline(_post_names()))
    shared = offered.join(wanted, ["taxonomy", "name"]).filter(_place_fits())
    return (shared.groupBy(*HIT).agg(F.bit_or("taxonomy").alias("has"), F.max("needs").alias("needs"),
                                     F.max("published_at").alias("published_at"))
            .filter(F.col("has") == F.col("needs")).select(*HIT, "published_at"))


SCOPE = ["level", "place", "taxonomy", "name", "widgets_only"]


def _with_scopes(rows: DataFrame) -> DataFrame:
    """Each row (``site_id``, ``site_group``) under its site, its group and the whole: ``level``, ``place``."""
    def at(level, place):
        return F.struct(F.lit(level).alias("level"), place.alias("place"))
    levels = F.array(at("site", F.col("site_id")), at("group", F.col("site_group")), at("all", F.lit("")))
    return rows.select("*", F.inline(levels))


def _offered_names(meta: DataFrame, known: DataFrame) -> DataFrame:
    """A row for each post and each of its names, and one without a name (taxonomy 0)."""
    unnamed = F.array(F.struct(F.lit(0).alias("taxonomy"), F.lit("").alias("name")))
    widget = (F.col("post_id") == schemas.WIDGET_POST_ID).alias("widgets_only")
    return meta.join(known, "site_id").select(
        *DOC, "site_group", "published_at", widget, F.inline(F.concat(unnamed, _post_names())))


def _request_scopes(requests: DataFrame, known: DataFrame) -> DataFrame:
    """The scopes whose posts together are what a request without text and with one name at most finds.

    No post is in two scopes of one request, so their counts add up. ``oldest`` tells the order.
    """
    one = requests.select("query_id", "want_sites", "want_group", "widgets_only", "last", (F.col("sort") == "oldest").alias("oldest"),
                          F.coalesce(F.get("names", F.lit(0))["taxonomy"], F.lit(0)).alias("taxonomy"),
                          F.when(F.size("names") == 0, "").otherwise(F.get("names", F.lit(0))["name"]).alias("name"))
    listed = one.filter(F.size("want_sites") > 0).withColumn("site_id", F.explode(F.array_distinct("want_sites")))
    listed = listed.join(known, "site_id").filter((F.col("want_group") == "") | (F.col("want_group") == F.col("site_group")))
    free = one.filter(F.size("want_sites") == 0)
    grouped = F.col("want_group") != ""
    placed = listed.withColumn("level", F.lit("site")).withColumn("place", F.col("site_id")).unionByName(
        free.withColumn("level", F.when(grouped, "group").otherwise("all")).withColumn("place", F.col("want_group")),
        allowMissingColumns=True)
    return placed.select("query_id", *SCOPE, "oldest", "last")


def _scope_tops(scopes: DataFrame, meta: DataFrame, known: DataFrame, deepest: int) -> DataFrame:
    """For each request the first posts of each of its scopes by date, as many as its page needs.

    The posts meet the distinct scopes, not the requests; a scope keeps as many rows as the deepest request of it takes.
    """
    distinct = scopes.groupBy(*SCOPE, "oldest").agg(F.max("last").alias("depth"))
    rows = _with_scopes(_offered_names(meta, known)).join(distinct, SCOPE)
    order = [F.when(F.col("oldest"), F.col("published_at")).asc_nulls_last(),
             F.when(~F.col("oldest"), F.col("published_at")).desc_nulls_last(), F.col("site_id"), F.col("post_id")]
    rows = rows.select(*DOC, "published_at", *SCOPE, "oldest", F.col("depth").alias("last"))
    tops = _first_in_parts(rows, [*SCOPE, "oldest"], order, deepest).withColumnRenamed("last", "depth")
    return tops.join(scopes, [*SCOPE, "oldest"]).filter(F.col("rn") <= F.col("last")).select(*HIT, "published_at")


def _scope_totals(scopes: DataFrame, meta: DataFrame, known: DataFrame) -> DataFrame:
    """How many posts each request finds in all its scopes; posts are counted by site and name first."""
    by_site = _offered_names(meta, known).groupBy("site_id", "site_group", "taxonomy", "name", "widgets_only").agg(
        F.count("*").alias("n"))
    by_scope = _with_scopes(by_site).join(scopes.select(SCOPE).distinct(), SCOPE).groupBy(*SCOPE).agg(F.sum("n").alias("n"))
    return scopes.join(by_scope, SCOPE).groupBy("query_id").agg(F.sum("n").alias("total_count"))


def _first_in_parts(rows: DataFrame, keys: list[str], order: list[Column], deepest: int) -> DataFrame:
    """The rows of each key up to its place ``last`` in the order, ``rn``. ``deepest`` is the greatest ``last``.

    A row among the first of its key is among the first of its part, so the parts can be cut separately.
    """
    def first_rows(some, *by):
        some = some.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
        some = some.filter(F.col("rn") <= deepest)  # a literal: Spark cuts the groups before the shuffle too
        return some.filter(F.col("rn") <= F.col("last"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*DOC), F.lit(_parts(rows.sparkSession))))
    return first_rows(first_rows(salted, *keys, "salt").drop("rn", "salt"), *keys)


def _top_pages(found: DataFrame, totals: DataFrame, deepest: int) -> DataFrame:
    """The page of each search with its total. ``deepest`` is the last row any of them asks for."""
    by_score = ~F.col("sort").isin("newest", "oldest") & F.col("has_text")
    order = [F.when(by_score, F.col("score")).desc(),
             F.when(F.col("sort") == "oldest", F.col("published_at")).asc_nulls_last(),
             F.when(F.col("sort") != "oldest", F.col("published_at")).desc_nulls_last(),
             F.col("site_id"), F.col("post_id")]
    page = _first_in_parts(found, ["query_id"], order, deepest).filter(F.col("rn") > F.col("off"))
    return page.join(totals, "query_id").select(
        "query_id", F.col("rn").cast("bigint").alias("rn"), "total_count", "score", *DOC)


# ---- presentation -----------------------------------------------------------------------------------------------

def result_cards(page: DataFrame, sites: DataFrame, query: Column) -> DataFrame:
    """What a reader sees of each result row."""
    names = sites.select(F.col("id").alias("site_id"), F.col("name").alias("name"))
    shown = truncate_ellipsis(F.col("excerpt"), CARD_EXCERPT_CHARS)
    return page.join(names, "site_id", "left").select(
        *[c for c in ("query_id", "rn") if c in page.columns], "site_id", "post_id", "url",
        highlight(title_or_default(F.col("title")), query).alias("title_html"),
        F.coalesce("name", "site_id").alias("site_name"),
        format_date(F.col("published_at")).alias("shown_date"),
        highlight(shown, query).alias("excerpt_html"))


def page_info(page: DataFrame, page_no: int, page_size: int) -> DataFrame:
    """Numbers around a page of results: shown range, page count, page buttons, newest date. Empty: no row."""
    info = page.agg(F.max("total_count").alias("total"), F.count("*").alias("shown"),
                    F.max("published_at").alias("newest"))
    first = max(0, page_no - PAGE_WINDOW // 2)
    pages = F.ceil(F.col("total") / page_size)
    offset = page_no * page_size
    return info.filter("total > 0").select(
        "total",
        F.lit(offset + 1).cast("bigint").alias("shown_from"),
        F.least(F.col("shown") + offset, F.col("total")).alias("shown_to"),
        pages.alias("pages"),
        F.when(pages > 1, F.lit(first + 1)).cast("bigint").alias("first_button"),
        F.when(pages > 1, F.least(pages, F.lit(first + PAGE_WINDOW))).alias("last_button"),
        "newest")
