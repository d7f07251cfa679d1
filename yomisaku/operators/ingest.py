"""Incremental ingest as joins: flatten, upsert, high-water marks, removal of vanished posts.

No side is broadcast by hint: Spark broadcasts what its own size estimates allow and shuffles the rest.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from yomisaku.functions.markup import html_to_text
from yomisaku.functions.posts import (
    absolutize, embedded_terms, first_author, first_date, parse_utc, pipe_join)

KEY = ["site_id", "post_id"]


def normalize_posts(landed: DataFrame, sites: DataFrame) -> DataFrame:
    """Landed posts to flat post rows; an arrival ``seq`` is kept. Links of posts of unknown sites stay as they are."""
    base = sites.select(F.col("id").alias("site_id"), F.col("url").alias("base_url"))
    embedded = F.col("_embedded")
    kept = ["seq"] if "seq" in landed.columns else []
    return landed.join(base, "site_id", "left").select(
        "site_id",
        F.col("id").alias("post_id"),
        absolutize(F.col("link"), F.col("base_url")).alias("url"),
        html_to_text(F.col("title.rendered")).alias("title"),
        html_to_text(F.col("excerpt.rendered")).alias("excerpt"),
        html_to_text(F.col("content.rendered")).alias("content"),
        first_author(embedded).alias("author"),
        parse_utc(first_date(F.col("date_gmt"), F.col("date"))).alias("published_at"),
        parse_utc(first_date(F.col("modified_gmt"), F.col("modified"))).alias("modified_at"),
        pipe_join(embedded_terms(embedded, "category")).alias("categories"),
        pipe_join(embedded_terms(embedded, "post_tag")).alias("tags"),
        *kept,
    )


def last_arrivals(batch: DataFrame, newest_wins: bool = False) -> DataFrame:
    """One row per key: the last arrival by ``seq``, or the newest by ``modified_at`` then ``seq``.

    A missing ``seq`` comes before all others; among several the newest counts. Aggregated map-side, so a key repeated
    any number of times leaves each task as one row.
    """
    values = [c for c in batch.columns if c not in KEY]
    seq = F.coalesce("seq", F.lit(-1).cast("bigint")) if "seq" in batch.columns else F.lit(-1).cast("bigint")
    # A struct is never NULL, so no row is lost to a NULL order.
    order = F.struct("modified_at", seq) if newest_wins else F.struct(seq, "modified_at")
    latest = batch.groupBy(*KEY).agg(F.max_by(F.struct(*values), order).alias("row"))
    return latest.select(*KEY, "row.*").select(*batch.columns)


def upsert_posts(store: DataFrame, batch: DataFrame, newest_wins: bool = False) -> DataFrame:
    """The store after a batch. The last arrival replaces every other column of its key.

    ``batch`` has the store's columns and an arrival ``seq`` unique per key. With ``newest_wins`` a stored
    row that is newer by ``modified_at`` stays.
    """
    arrived = last_arrivals(batch, newest_wins)
    if newest_wins:
        stored = store.select(*KEY, F.col("modified_at").alias("stored_at"))
        arrived = (arrived.join(stored, KEY, "left")
                   .filter(F.col("stored_at").isNull() | (F.col("modified_at") >= F.col("stored_at")))
                   .drop("stored_at"))
    kept = store.join(arrived.select(*KEY), KEY, "left_anti")
    return kept.unionByName(arrived.select(*store.columns))


def upsert_sites(sites: DataFrame, configured: DataFrame) -> DataFrame:
    """Overwrite name, url and group of configured sites; crawl state stays."""
    new = configured.select("id", *[F.col(c).alias(f"new_{c}") for c in ("name", "url", "group_id")])
    return sites.join(new, "id", "full").select(*[
        F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if f"new_{c}" in new.columns else F.col(c)
        for c in sites.columns])


def incremental_filter(batch: DataFrame, sites: DataFrame, purge: bool = False) -> DataFrame:
    """Posts modified strictly after their site's mark; all of them without a mark or site, or in a purge run."""
    if purge:
        return batch
    marks = sites.select(F.col("id").alias("site_id"), F.col("last_modified").alias("mark"))
    return (batch.join(marks, "site_id", "left")
            .filter(F.col("mark").isNull() | (F.col("modified_at") > F.col("mark"))).drop("mark"))


def newest_marks(batch: DataFrame) -> DataFrame:
    return batch.groupBy("site_id").agg(F.max("modified_at").alias("newest"))


def advance_marks(sites: DataFrame, batch: DataFrame, now: Column, mode: str = "greatest",
                  crawled: DataFrame | None = None) -> DataFrame:
    """Site rows after a crawl: marks move to the newest ``modified_at``, a missing one changes nothing.

    ``mode='replace'`` lets the mark move back, as scraped sites do. ``crawled`` (``site_id``) lists the
    sites that ran; without it those with posts in the batch did.
    """
    newest = newest_marks(batch).withColumnRenamed("site_id", "id")
    ran = (newest.select("id") if crawled is None else crawled.select(F.col("site_id").alias("id")).distinct())
    joined = (sites.join(newest, "id", "left")
              .join(ran.withColumn("ran", F.lit(True)), "id", "left"))
    mark = (F.coalesce("newest", "last_modified") if mode == "replace"
            else F.greatest("newest", "last_modified"))
    changed = {"last_modified": mark, "last_crawled_at": F.when(F.col("ran"), now).otherwise(
        F.col("last_crawled_at"))}
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in sites.columns])


def reset_marks(sites: DataFrame, ids: Iterable[str] | None = None) -> DataFrame:
    """Clear the marks of the given sites, or of all of them."""
    column = F.col("last_modified")
    cleared = F.lit(None).cast(sites.schema["last_modified"].dataType)
    if ids is not None:
        cleared = F.when(~F.col("id").isin(list(ids)), column)
    return sites.withColumn("last_modified", cleared)


def stale_posts(store: DataFrame, fetched: DataFrame, ran: DataFrame) -> DataFrame:
    """Keys of stored posts that a full run of their site no longer found.

    ``fetched`` has the keys seen (listed urls count, widget rows too if fetched), ``ran`` the ``site_id`` of
    each successful full run.
    """
    stored = store.select(*KEY).join(ran.select("site_id").distinct(), "site_id", "left_semi")
    return stored.join(fetched.select(*KEY), KEY, "left_anti")


def purge_guard(stale: DataFrame, store: DataFrame, max_fraction: float | None = None) -> DataFrame:
    """Drop the stale keys of sites that would lose more than ``max_fraction`` of their posts."""
    if max_fraction is None:
        return stale
    share = (store.groupBy("site_id").agg(F.count("*").alias("stored"))
             .join(stale.groupBy("site_id").agg(F.count("*").alias("gone")), "site_id"))
    safe = share.filter(F.col("gone") <= max_fraction * F.col("stored")).select("site_id")
    return stale.join(safe, "site_id", "left_semi")


def delete_posts(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select(*KEY), KEY, "left_anti")


def purge_stale(store: DataFrame, fetched: DataFrame, ran: DataFrame,
                max_fraction: float | None = None) -> DataFrame:
    """The store without the posts that vanished from their sites."""
    return delete_posts(store, purge_guard(stale_posts(store, fetched, ran), store, max_fraction))


def cascade_delete(store: DataFrame, sites: DataFrame) -> DataFrame:
    """Posts whose site still exists."""
    return store.join(sites.select(F.col("id").alias("site_id")), "site_id", "left_semi")


def restrict_sites(sites: DataFrame, wanted: str | None) -> DataFrame:
    """Sites of a comma list (trimmed, blanks dropped); all sites for an empty list."""
    ids = [part.strip() for part in (wanted or "").split(",") if part.strip()]
    return sites.filter(F.col("id").isin(ids)) if ids else sites


def crawl_completeness(batch: DataFrame, totals: DataFrame) -> DataFrame:
    """Sites that delivered fewer posts than their server reported (``site_id``, ``total``)."""
    got = batch.groupBy("site_id").agg(F.count("*").alias("fetched"))
    return (totals.join(got, "site_id", "left")
            .select("site_id", F.coalesce("fetched", F.lit(0)).alias("fetched"), "total")
            .filter((F.col("total") > 0) & (F.col("fetched") < F.col("total"))))


def sample_urls(batch: DataFrame) -> DataFrame:
    """The first non-blank article url of each site in arrival order."""
    return (batch.filter(F.col("url") != "").groupBy("site_id")
            .agg(F.min_by("url", "seq").alias("url")))


def lookup_site(sites: DataFrame, site_id: str) -> DataFrame:
    return sites.filter(F.col("id") == site_id)


def list_sites(sites: DataFrame) -> DataFrame:
    return sites.orderBy("name", "id")


def post_ids(store: DataFrame, site_id: str) -> DataFrame:
    return store.filter(F.col("site_id") == site_id).select("post_id").distinct()


def run_summary(results: DataFrame) -> DataFrame:
    """Per site: posts delivered, 0 after an http failure or only timeouts, -1 after an exception.

    ``results`` has one row per attempt: ``site_id``, ``posts`` and ``failure`` (NULL, ``http``, ``timeout`` or
    ``exception``). An attempt without failure gives its count, the largest if there are several.
    """
    done = F.max(F.when(F.col("failure").isNull(), F.col("posts")))
    crashed = F.max(F.when(F.col("failure") == "exception", F.lit(1)))
    return results.groupBy("site_id").agg(
        F.when(crashed == 1, F.lit(-1)).otherwise(F.coalesce(done, F.lit(0))).cast("bigint").alias("result"))
