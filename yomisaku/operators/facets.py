"""Facet counts and store statistics."""

from pyspark.sql import DataFrame, functions as F

from yomisaku.functions.posts import blank_to_null, pipe_split
from yomisaku.operators.search import filter_widgets
from yomisaku.sources.landing import DEFAULT_GROUP


def _counted(posts: DataFrame, include_widgets: bool) -> DataFrame:
    return posts if include_widgets else filter_widgets(posts)


def posts_by_site(posts: DataFrame, include_widgets: bool = False) -> DataFrame:
    """Posts per site, only sites that have some."""
    return _counted(posts, include_widgets).groupBy("site_id").agg(F.count("*").alias("count"))


def post_total(posts: DataFrame, include_widgets: bool = False) -> DataFrame:
    return _counted(posts, include_widgets).agg(F.count("*").alias("total"))


def site_counts(sites: DataFrame, posts: DataFrame, include_widgets: bool = False) -> DataFrame:
    """All sites with their post counts, zero included; counted before the join."""
    counts = posts_by_site(posts, include_widgets).withColumnRenamed("site_id", "id")
    return (sites.join(counts, "id", "left")
            .select("id", "name", "group_id", "url", F.coalesce("count", F.lit(0)).alias("count"))
            .orderBy("group_id", "name", "id"))


def register_site_counts(sites: DataFrame, posts: DataFrame) -> None:
    """Make ``site_counts`` callable in SQL as the table function ``list_sites_with_counts()``."""
    site_counts(sites, posts).createOrReplaceTempView("site_counts")
    sites.sparkSession.sql("""
        create or replace temporary function list_sites_with_counts()
        returns table (id string, name string, group_id string, url string, count bigint)
        return select id, name, group_id, url, count from site_counts""")


def _name_counts(posts: DataFrame, column: str) -> DataFrame:
    names = posts.select(F.explode(pipe_split(F.col(column))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("count"))


def category_counts(posts: DataFrame) -> DataFrame:
    return _name_counts(posts, "categories").orderBy(F.desc("count"), "name")


def tag_counts(posts: DataFrame) -> DataFrame:
    return _name_counts(posts, "tags").orderBy(F.desc("count"), "name")


def overview(counts: DataFrame) -> DataFrame:
    """Number of sites and sum of their counts."""
    return counts.agg(F.count("*").alias("sites"), F.coalesce(F.sum("count"), F.lit(0)).alias("posts"))


def sites_by_group(sites: DataFrame, group_id: str | None = None) -> DataFrame:
    """Sites with their group, blank groups being the default one; optionally one whole group."""
    group = F.coalesce(blank_to_null(F.col("group_id")), F.lit(DEFAULT_GROUP))
    grouped = sites.select(group.alias("group_id"), "id", "name")
    if group_id is not None:
        grouped = grouped.filter(F.col("group_id") == group_id)
    return grouped.orderBy("group_id", "name", "id")


def facets(sites: DataFrame, posts: DataFrame, include_widgets: bool = False) -> DataFrame:
    """Sites, categories and tags with their counts in one table; one pass over the term lists."""
    counts = posts_by_site(posts, include_widgets).withColumnRenamed("site_id", "id")
    by_site = sites.join(counts, "id", "left").select(
        F.lit("site").alias("facet"), F.col("id").alias("name"), F.coalesce("count", F.lit(0)).alias("count"))
    names = posts.select(F.explode(F.concat(*[
        F.transform(pipe_split(F.col(column)), _labelled(facet))
        for facet, column in (("category", "categories"), ("tag", "tags"))])).alias("n"))
    by_name = names.groupBy("n.facet", "n.name").agg(F.count("*").alias("count"))
    return by_site.unionByName(by_name)


def _labelled(facet: str):
    return lambda name: F.struct(F.lit(facet).alias("facet"), name.alias("name"))
