"""The periodic crawl as a stream over a landing folder.

Each run takes what has landed since the last one (``availableNow``) in micro-batches. A batch is merged into the store
by key and its index generation is known by the stream and the batch, so a replayed batch changes nothing. No watermark: late and older
posts overwrite like any other, unless ``newest_wins``.
"""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from yomisaku import schemas
from yomisaku.functions.text import with_index_text
from yomisaku.operators.index import append_index
from yomisaku.operators.ingest import advance_marks, normalize_posts, upsert_posts
from yomisaku.session import held
from yomisaku.sources.store import merge_posts, read_sites, remove_posts, stored_posts, write_sites


def stream_posts(spark: SparkSession, landing: str, max_files: int = 1000) -> DataFrame:
    """New landed posts, one JSON object per line."""
    return spark.readStream.schema(schemas.LANDED_POST).option("maxFilesPerTrigger", max_files).json(landing)


def ingest_batch(spark: SparkSession, landed: DataFrame, batch: str | int, *, store: str, sites: str,
                 now: Column, index: str | None = None, newest_wins: bool = False, slices: int | None = None) -> None:
    """One micro-batch: index the changed posts, merge them, move the marks.

    The index comes first, as it needs the posts that the merge replaces. ``batch`` names the batch among all that write
    to this index; a replayed one is not indexed again.
    """
    known = read_sites(spark, sites)
    with held(normalize_posts(landed, known), "batch") as posts:  # read by every step below
        if index is not None:
            with held(stored_posts(spark, store, posts), "before") as before:
                prepared = with_index_text(posts)
                after = upsert_posts(before.select(*prepared.drop("seq").columns), prepared, newest_wins)
                with held(after, "after") as after:
                    append_index(after, posts.select("site_id", "post_id").limit(0), index, batch, before)
        merge_posts(spark, store, posts, newest_wins, slices)
        write_sites(advance_marks(known, posts, now), sites)


def remove_batch(spark: SparkSession, keys: DataFrame, batch: str | int, *, store: str, index: str | None = None) -> None:
    """Delete posts by key from the index and then from the store; a repeated batch changes nothing."""
    if index is not None:
        with held(stored_posts(spark, store, keys), "removed") as before:
            append_index(before.limit(0), keys, index, batch, before)
    remove_posts(spark, store, keys)


def stream_upsert(spark: SparkSession, landing: str, checkpoint: str, *, store: str, sites: str, now: Column,
                  index: str | None = None, newest_wins: bool = False, max_files: int = 1000,
                  slices: int | None = None) -> StreamingQuery:
    """Start the ingest of everything that has landed; stops by itself."""
    def take(landed: DataFrame, batch_id: int) -> None:
        ingest_batch(landed.sparkSession, landed, f"{checkpoint} {batch_id}", store=store, sites=sites, now=now, index=index,
                     newest_wins=newest_wins, slices=slices)
    return (stream_posts(spark, landing, max_files).writeStream.foreachBatch(take)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def stream_marks(posts: DataFrame, checkpoint: str, sink: str) -> StreamingQuery:
    """Running newest ``modified_at`` per site. Every batch replaces the table at ``sink``."""
    def replace(marks: DataFrame, batch_id: int) -> None:
        marks.write.mode("overwrite").parquet(sink)
    marks = posts.groupBy("site_id").agg(F.max("modified_at").alias("newest"))
    return (marks.writeStream.outputMode("complete").foreachBatch(replace)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
