import datetime as dt
import json
import time

import pytest
from pyspark.sql import functions as F, types as T

from yomisaku import schemas
from yomisaku.operators import facets, index as ix, ingest
from yomisaku.plans import catalog
from yomisaku.session import held, materialize, scratch_path, write_table
from yomisaku.sources import landing, store
from yomisaku.streaming import crawl



def now():
    return F.lit("2024-12-01 00:00:00").cast("timestamp_ntz")

BATCH = "site_id string, post_id bigint, title string, modified_at timestamp_ntz, seq bigint"


def at(day):
    return dt.datetime(2024, 1, day)


def keyed(df, *columns):
    return {(r.site_id, r.post_id): tuple(r[c] for c in columns) for r in df.collect()}


def make_posts(spark, rows):
    """(site, id, title, content, day) to full post rows."""
    return spark.createDataFrame(
        [(s, i, f"https://{s}/{i}", t, c[:200], c, "", at(d), at(d), "", "") for s, i, t, c, d in rows], schemas.POSTS)


def test_last_arrival_wins_and_repeating_changes_nothing(spark):
    posts = spark.createDataFrame([("s", 1, "old", at(9)), ("s", 2, "keep", at(1))], BATCH.rsplit(",", 1)[0])
    # One key holds nearly all arrivals.
    batch = spark.createDataFrame([("s", 1, f"v{i}", at(1 + i % 5), i) for i in range(3000)] + [("t", 1, "new", at(1), 0)], BATCH)
    once = ingest.upsert_posts(posts, batch)
    want = {("s", 1): ("v2999",), ("s", 2): ("keep",), ("t", 1): ("new",)}
    assert keyed(once, "title") == want
    assert keyed(ingest.upsert_posts(once, batch), "title") == want
    newest = ingest.upsert_posts(posts, batch, newest_wins=True)
    assert keyed(newest, "title") == {("s", 1): ("old",), ("s", 2): ("keep",), ("t", 1): ("new",)}


def test_marks(spark):
    sites = spark.createDataFrame([("a", "A", "u", "g", None, at(9)), ("b", "B", "u", "g", None, None),
                                   ("c", "C", "u", "g", at(1), at(2))], schemas.SITES)
    batch = spark.createDataFrame([("a", 1, "", at(5), 0), ("b", 1, "", at(3), 0), ("b", 2, "", None, 0)], BATCH)
    def marks(df):
        return {r.id: (r.last_modified, r.last_crawled_at) for r in df.collect()}
    then = dt.datetime(2024, 12, 1)
    assert marks(ingest.advance_marks(sites, batch, now())) == {"a": (at(9), then), "b": (at(3), then), "c": (at(2), at(1))}
    ran = spark.createDataFrame([("a",), ("c",)], "site_id string")
    assert marks(ingest.advance_marks(sites, batch, now(), "replace", ran)) == {
        "a": (at(5), then), "b": (at(3), None), "c": (at(2), then)}
    assert marks(ingest.reset_marks(sites))["a"][0] is None
    assert keyed(ingest.incremental_filter(batch, sites), "seq").keys() == {("b", 1), ("b", 2)}
    assert ingest.incremental_filter(batch, sites, purge=True).count() == 3


def test_purge_takes_widget_row_and_spares_other_sites(spark):
    posts = spark.createDataFrame([("a", -1), ("a", 1), ("a", 2), ("b", 1)], "site_id string, post_id bigint")
    fetched = spark.createDataFrame([("a", 2)], "site_id string, post_id bigint")
    ran = spark.createDataFrame([("a",)], "site_id string")
    assert set(keyed(ingest.purge_stale(posts, fetched, ran))) == {("a", 2), ("b", 1)}
    assert set(keyed(ingest.purge_stale(posts, fetched.limit(0), ran))) == {("b", 1)}
    assert set(keyed(ingest.purge_stale(posts, fetched, ran, max_fraction=0.5))) == set(keyed(posts))


def test_sites_and_runs(spark):
    cfg = spark.createDataFrame([("", "N", "https://x//", None), ("i", "M", "https://y", "")],
                                "id string, name string, url string, `group` string")
    rows = [tuple(r) for r in landing.normalize_sites(cfg).orderBy("name").collect()]
    assert rows == [("i", "M", "https://y", "backlink"), ("N", "N", "https://x", "backlink")]
    assert ingest.restrict_sites(landing.normalize_sites(cfg), " , ").count() == 2
    lines = spark.createDataFrame([("2026-05-25 03:43:32 JST | status=success | sites=130 | posts=?",),
                                   ("2026-05-25 13:43:32 JST | status=failure | sites=1 | posts=7",), ("junk",)], "line string")
    rows = [tuple(r) for r in landing.parse_run_ledger(lines).collect()]
    assert rows == [(dt.datetime(2026, 5, 24, 18, 43, 32), "success", 130, None),
                    (dt.datetime(2026, 5, 25, 4, 43, 32), "failure", 1, 7), (None, "", None, None)]
    counts = facets.site_counts(landing.normalize_sites(cfg).withColumn("last_modified", F.lit(None)),
                                spark.createDataFrame([("i", 1), ("i", -1)], "site_id string, post_id bigint"))
    assert [(r.id, r["count"]) for r in counts.collect()] == [("i", 1), ("N", 0)]


def test_store_merges_and_removes(spark):
    path = scratch_path(spark, "test-store")
    store.write_posts(make_posts(spark, [("007", i, f"t{i}", "x", 1) for i in range(20)] + [("b", 1, "b", "y", 1)]), path, 4)
    batch = make_posts(spark, [("007", 3, "new 3", "Ａ東", 2), ("c", 1, "c", "z", 2)]).withColumn("seq", F.lit(1))
    for _ in range(2):
        store.merge_posts(spark, path, batch, slices=4)
    got = keyed(store.read_posts(spark, path), "title", "content_idx")
    assert len(got) == 22 and got["007", 3] == ("new 3", "a 東") and got["c", 1] == ("c", "z")
    keys = spark.createDataFrame([("007", i) for i in range(10)] + [("b", 1)], "site_id string, post_id bigint")
    for _ in range(2):
        store.remove_posts(spark, path, keys, slices=4)
    assert set(keyed(store.read_posts(spark, path))) == {("007", i) for i in range(10, 20)} | {("c", 1)}
    store.merge_posts(spark, path, make_posts(spark, [("b", 1, "back", "y", 3)]).withColumn("seq", F.lit(1)), slices=4)
    assert keyed(store.read_posts(spark, path), "title")["b", 1] == ("back",)


def index_rows(index):
    return sorted((r.term, r.site_id, r.post_id, r.doc_len, tuple(r.positions)) for r in index.terms.collect())


def test_appended_index_equals_rebuild(spark):
    path = scratch_path(spark, "test-index")
    first = make_posts(spark, [("s", 1, "a b", "a c", 1), ("s", 2, "d", "e", 1), ("t", 3, "f", "a", 1)])
    changed = make_posts(spark, [("s", 1, "new", "a", 2), ("u", 4, "g", "a a", 2)])
    deleted = spark.createDataFrame([("s", 2)], "site_id string, post_id bigint")
    old = ix.write_index(first, path)
    refreshed = ix.refresh_index(old, changed, deleted)
    after = make_posts(spark, [("s", 1, "new", "a", 2), ("u", 4, "g", "a a", 2), ("t", 3, "f", "a", 1)])
    want = ix.build_index(after)
    assert index_rows(refreshed) == index_rows(want)
    for _ in range(2):
        appended = ix.append_index(changed, deleted, path, 1)
        assert index_rows(appended) == index_rows(want)
        assert appended.corpus.first() == want.corpus.first()
        assert sorted(map(tuple, appended.vocab.collect())) == sorted(map(tuple, want.vocab.collect()))
    again = ix.append_index(make_posts(spark, [("s", 2, "d", "back", 3)]), deleted.limit(0), path, 2)
    assert ("back", "s", 2) in {r[:3] for r in index_rows(again)} and again.corpus.first().n_docs == 4
    # Two streams may name their batches alike in number, not in name; nothing of the other's is lost.
    both = ix.append_index(make_posts(spark, [("t", 3, "moved", "", 4)]), deleted.limit(0), path, "other 1", make_posts(spark, [("t", 3, "f", "a", 1)]))
    now = make_posts(spark, [("s", 1, "new", "a", 2), ("u", 4, "g", "a a", 2), ("s", 2, "d", "back", 3), ("t", 3, "moved", "", 4)])
    folded = ix.write_index(now, path)
    fresh = ix.build_index(now)
    for index in (both, folded, ix.read_index(spark, path)):
        assert index_rows(index) == index_rows(fresh) and index.corpus.first() == fresh.corpus.first()
        assert sorted(map(tuple, index.vocab.collect())) == sorted(map(tuple, fresh.vocab.collect()))


def land(folder, name, rows):
    with open(f"{folder}/{name}.json", "w") as f:
        for site, seq, post_id, title, day in rows:
            f.write(json.dumps({"site_id": site, "seq": seq, "id": post_id, "link": f"/{post_id}", "title": {"rendered": title},
                                "content": {"rendered": f"<p>{title}</p>"}, "modified_gmt": f"2024-01-{day:02d}T00:00:00"}) + "\n")


def test_stream_takes_new_files_once_and_replays_safely(spark, tmp_path):
    landing_dir = tmp_path / "landing"
    landing_dir.mkdir()
    paths = {k: scratch_path(spark, f"test-{k}") for k in ("store", "sites", "index")}
    first = make_posts(spark, [("a", 1, "old", "old", 1), ("a", 9, "stays", "stays", 1)])
    store.write_posts(first, paths["store"], 2)
    ix.write_index(first, paths["index"])
    store.write_sites(spark.createDataFrame([("a", "A", "https://a", "g", None, at(2))], schemas.SITES), paths["sites"])

    def run(checkpoint):
        crawl.stream_upsert(spark, str(landing_dir), str(tmp_path / checkpoint), now=now(), slices=2, **paths).awaitTermination()

    def state():
        terms = {(r.term, r.post_id) for r in ix.read_index(spark, paths["index"]).terms.collect()}
        mark = store.read_sites(spark, paths["sites"]).first().last_modified
        return keyed(store.read_posts(spark, paths["store"]), "title", "url"), terms, mark
    land(landing_dir, "one", [("a", 1, 1, "first", 5), ("a", 2, 1, "second", 3)])
    run("c1")
    want = {("a", 1): ("second", "https://a/1"), ("a", 9): ("stays", "https://a/9")}
    assert state() == (want, {("second", 1), ("stays", 9)}, at(5))
    land(landing_dir, "two", [("a", 3, 2, "third", 4)])
    run("c1")
    want["a", 2] = ("third", "https://a/2")
    after = (want, {("second", 1), ("stays", 9), ("third", 2)}, at(5))
    assert state() == after
    run("c2")  # a lost checkpoint replays everything
    assert state() == after


def test_store_keeps_its_slice_count_and_one_row_a_key(spark, tmp_path):
    path = str(tmp_path / "store")
    first = make_posts(spark, [("a", i, f"t{i}", "x", 1) for i in range(20)])
    store.write_posts(first.withColumn("seq", F.lit(1)).unionByName(first.withColumns({"title": F.lit("later"), "seq": F.lit(2)})), path, slices=7)
    assert {r.title for r in store.read_posts(spark, path).collect()} == {"later"} and store.read_posts(spark, path).count() == 20
    store.merge_posts(spark, path, first.withColumn("seq", F.lit(None).cast("bigint")))
    assert sorted(r.title for r in store.read_posts(spark, path).collect()) == sorted(f"t{i}" for i in range(20))
    with pytest.raises(ValueError, match="7 slices"):
        store.merge_posts(spark, path, first.withColumn("seq", F.lit(3)), slices=64)


def test_a_merge_that_breaks_off_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    store.write_posts(make_posts(spark, [("a", i, f"t{i}", "x", 1) for i in range(12)]), path, slices=3)
    batch = make_posts(spark, [("a", 1, "new", "x", 2), ("b", 5, "other", "x", 2)]).withColumn("seq", F.lit(1))
    with monkeypatch.context() as m:
        calls = []
        m.setattr(store, "_finish", lambda *a: calls.append(a) or (len(calls) > 1 and (_ for _ in ()).throw(RuntimeError("lost"))))
        with pytest.raises(RuntimeError):
            store.merge_posts(spark, path, batch)
    titles = sorted(r.title for r in store.read_posts(spark, path).collect())
    assert titles == sorted(["new", "other", *[f"t{i}" for i in range(12) if i != 1]])
    store.merge_posts(spark, path, make_posts(spark, [("b", 6, "third", "x", 2)]).withColumn("seq", F.lit(1)))
    assert store.read_posts(spark, path).count() == 14
    store.merge_posts(spark, path, batch)
    assert sorted(r.title for r in store.read_posts(spark, path).collect()) == sorted([*titles, "third"])


def test_a_merge_reads_touched_slices_only(spark, tmp_path):
    path = str(tmp_path / "store")
    store.write_posts(make_posts(spark, [(s, i, "t", "x", 1) for s in "abc" for i in range(12)]), path, slices=4)
    keys = store._sliced(spark.createDataFrame([("b", 3)], "site_id string, post_id long"), 4)
    plan = store._touched_slices(spark, path, keys)._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_bodies_with_something_else_are_told(spark):
    bodies = spark.createDataFrame([
        (1, '\n\t[{"id": 1}, {"id": 2}]'), (2, ' {"id": 3}'), (3, '[{"id": 4}, 5]'), (4, "<html>down</html>"), (5, '[{"id": 6}'),
        (6, ""), (7, None), (8, "[]"), (9, '{"code": "rest_no_route"}')], "n int, body string")
    posts = landing.parse_posts(bodies)
    assert sorted((r.n, r.id) for r in posts.collect()) == [(1, 1), (1, 2), (2, 3)]
    rejects = {r.n: r.reason for r in landing.rejected_bodies(bodies).collect()}
    assert rejects == {3: "no_post", 4: "malformed", 5: "malformed", 6: "missing", 7: "missing", 9: "no_post"}


def test_lines_that_are_no_posts_are_told(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"site_id": "a", "seq": 1, "id": 7}\n{"site_id": "a", "seq"\n')
    assert [r.id for r in landing.read_posts_json(spark, str(tmp_path)).collect()] == [7]
    assert [r.body for r in landing.unreadable_posts(spark, str(tmp_path)).collect()] == ['{"site_id": "a", "seq"']


def test_posts_of_unknown_sites_stay(spark):
    landed = landing.parse_posts(spark.createDataFrame([("x", '{"id": 1, "link": "/p"}')], "site_id string, body string"))
    sites = spark.createDataFrame([("a", "A", "https://a", "g", None, at(9))], schemas.SITES)
    got = ingest.normalize_posts(landed, sites).collect()
    assert [(r.post_id, r.url) for r in got] == [(1, "/p")]
    assert ingest.incremental_filter(ingest.normalize_posts(landed, sites), sites).count() == 1


def test_second_response_has_no_fallback(spark):
    rows = spark.createDataFrame([(200, "text/html", True), (200, "application/json", True), (404, "application/json", True),
                                  (400, "text/html", True), (403, None, True), (200, "text/html", False), (301, None, None)],
                                 "status int, content_type string, is_fallback boolean")
    assert [r.outcome for r in landing.classify_responses(rows).collect()] == ["error", "ok", "error", "end", "blocked", "fallback", "fallback"]


def test_removed_posts_leave_store_and_index(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("store", "index")}
    posts = make_posts(spark, [("a", i, f"t{i} same", "x", 1) for i in range(6)])
    store.write_posts(posts, paths["store"], slices=2)
    ix.write_index(posts, paths["index"])
    keys = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1)], "site_id string, post_id bigint")
    for _ in range(2):
        crawl.remove_batch(spark, keys, "purge 1", **paths)
    left = posts.filter("post_id not in (2, 3)")
    want, got = ix.build_index(left), ix.read_index(spark, paths["index"])
    assert index_rows(got) == index_rows(want) and got.corpus.first() == want.corpus.first()
    assert sorted(map(tuple, got.vocab.collect())) == sorted(map(tuple, want.vocab.collect()))
    assert keyed(store.read_posts(spark, paths["store"]), "title") == keyed(left, "title")


def test_landed_pages_are_read_and_scraped(spark, tmp_path):
    article = "<html><head><title>T</title></head><body><article><h1>Head</h1><p>Body text</p></article><p>side</p></body></html>"
    rows = [("https://s/a/1", 200, "text/html", article), ("https://s/a/2", 404, "text/html", None), (None, None, None, "")]
    spark.createDataFrame(rows, schemas.PAGE).withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "one"))
    spark.createDataFrame([], schemas.PAGE).write.parquet(str(tmp_path / "none"))
    got = landing.read_pages(spark, str(tmp_path / "one"))
    assert got.schema == schemas.PAGE and sorted(map(tuple, got.collect()), key=repr) == sorted(rows, key=repr)
    assert landing.read_pages(spark, str(tmp_path / "none")).count() == 0
    outcomes = {r.url: r.outcome for r in landing.classify_responses(got).collect()}
    assert outcomes["https://s/a/2"] == "fallback"


def test_run_history_is_read_from_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("2026-05-25 03:43:32 JST | status=success | sites=130 | posts=?\n\n")
    (tmp_path / "b.log").write_text("2026-05-26 00:00:00 JST | status=failure | sites=2 | posts=9\n")
    rows = sorted((tuple(r) for r in landing.read_run_ledger(spark, str(tmp_path)).collect()), key=repr)
    assert rows == sorted([(dt.datetime(2026, 5, 24, 18, 43, 32), "success", 130, None), (dt.datetime(2026, 5, 25, 15, 0), "failure", 2, 9),
                           (None, "", None, None)], key=repr)


def test_one_site_and_its_posts(spark):
    sites = spark.createDataFrame([("a", "B"), ("b", "A"), ("c", "A")], "id string, name string")
    posts = spark.createDataFrame([("a", 1), ("a", 1), ("a", -1), ("b", 2), (None, 3)], "site_id string, post_id bigint")
    assert [r.name for r in ingest.lookup_site(sites, "a").collect()] == ["B"] and ingest.lookup_site(sites, "zz").collect() == []
    assert [r.id for r in ingest.list_sites(sites).collect()] == ["b", "c", "a"]
    assert sorted(r.post_id for r in ingest.post_ids(posts, "a").collect()) == [-1, 1] and ingest.post_ids(posts, "c").collect() == []


def test_landed_posts_of_one_site_spread_over_the_files(spark, tmp_path):
    rows = [(n, f"word{n} text", "en", "src1", 10) for n in range(200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    landed = spark.read.text(catalog.land_posts(spark, str(tmp_path)))
    files = [r["count"] for r in landed.groupBy(F.input_file_name().alias("file")).count().collect()]
    assert sum(files) == 200 and max(files) < 50


def test_no_shuffle_files_stay_after_a_table_is_written(spark, tmp_path):
    """Shuffles of the steps before would lie on disk beside those of the later ones."""
    def shuffle_files():
        folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (folders.apply(i).getName() for i in range(folders.size())) if f.startswith("shuffle_")}
    posts = make_posts(spark, [("a", i, f"t{i}", "x y", 1) for i in range(50)])
    before = shuffle_files()
    write_table(posts.groupBy("site_id", "post_id").agg(F.max("title").alias("title")).hint("rebalance", "post_id"), str(tmp_path / "table"))
    materialize(posts.repartition(3, "post_id"), "test")
    with held(posts.orderBy("title"), "test") as table:
        place = table.inputFiles()[0].rsplit("/", 1)[0]
        assert table.columns == posts.columns
    for _ in range(100):
        if not shuffle_files() - before:
            break
        time.sleep(0.1)
    assert not shuffle_files() - before
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(place)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_only_repeated_keys_are_shuffled_whole(spark, tmp_path, monkeypatch):
    """Keys that come once, with NULLs among them, keep their rows as they are; of the others the last arrival counts."""
    rows = [("a", 1, "old", "x", 1), ("a", 1, "new", "x", 2), ("a", 2, "one", "x", 1), (None, 3, "left", "x", 1), (None, 3, "kept", "x", 1),
            (None, 4, "alone", "x", 1), ("b", None, "none", "x", 1), ("b", 5, "b", "x", 1)]
    fields = [T.StructField(f.name, f.dataType) for f in schemas.POSTS]
    posts = spark.createDataFrame([(s, i, "u", t, c, c, "", at(d), at(d), "", "") for s, i, t, c, d in rows], T.StructType(fields))
    posts = posts.withColumn("seq", F.when(F.col("title") == "left", F.lit(1)).otherwise(F.lit(2)).cast("bigint"))
    want = {("a", 1): "new", ("a", 2): "one", (None, 3): "kept", (None, 4): "alone", ("b", 5): "b"}
    wanted = sorted(map(str, ingest.last_arrivals(posts).collect()))
    assert sorted(map(str, store._one_per_key(posts).collect())) == wanted
    store.write_posts(posts, str(tmp_path / "store"), slices=2)
    assert {(r.site_id, r.post_id): r.title for r in store.read_posts(spark, str(tmp_path / "store")).collect()} == want
    single = posts.filter("post_id in (2, 4, 5)")
    monkeypatch.setattr(store, "last_arrivals", lambda *a: 1 / 0)
    assert store._one_per_key(single) is single
    monkeypatch.undo()
    monkeypatch.setattr(store, "REPEATED_KEYS", 1)
    assert sorted(map(str, store._one_per_key(posts).collect())) == wanted


def test_slices_are_replaced_in_shares(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "SHARE_ROWS", 4)
    path = str(tmp_path / "store")
    store.write_posts(make_posts(spark, [(s, i, "old", "x", 1) for s in ("a", "b c", "d%e") for i in range(12)]), path, slices=3)
    batch = make_posts(spark, [(s, i, "new", "Ａ東", 2) for s in ("a", "b c", "d%e", "f") for i in range(0, 14, 2)]).withColumn("seq", F.lit(1))
    writes, real = [], store.write_table
    monkeypatch.setattr(store, "write_table", lambda df, *a, **b: writes.append(a) or real(df, *a, **b))
    store.merge_posts(spark, path, batch)
    assert 4 < len(writes) <= store.SHARES
    got = keyed(store.read_posts(spark, path), "title", "content_idx")
    want = {(s, i): ("old", "x") for s in ("a", "b c", "d%e") for i in range(12)}
    want |= {(s, i): ("new", "a 東") for s in ("a", "b c", "d%e", "f") for i in range(0, 14, 2)}
    assert got == want
    store.remove_posts(spark, path, batch)
    assert set(keyed(store.read_posts(spark, path))) == {(s, i) for s in ("a", "b c", "d%e") for i in range(1, 12, 2)}
