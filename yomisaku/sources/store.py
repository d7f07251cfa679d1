"""The article store: Parquet partitioned by site and by a hash of the post id.

The second level splits large sites, so a batch rewrites only the slices its posts fall into, and a scan of one
large site still spreads over many tasks. The number of slices is written with the store and always read from there.

A batch's new slices are written in full to ``_pending`` and marked as ready before they are moved to the place of the old ones. Readers
take ready slices instead of stored ones, and the next writer finishes a replacement that was broken off, so no row is
lost in between. A store has one writer at a time.
"""

import heapq
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from yomisaku import schemas
from yomisaku.functions.text import prepare_index_text, with_index_text
from yomisaku.operators.ingest import KEY, delete_posts, last_arrivals, upsert_posts
from yomisaku.session import held, materialize, shared_files, write_table
from yomisaku.sources.landing import DEFAULT_GROUP

SLICES = 64
#: Slices are replaced in shares: one for so many rows, and no more shares than that.
SHARE_ROWS = 10_000
SHARES = 16
#: Up to so many repeated keys, only their rows are shuffled to find the last arrivals.
REPEATED_KEYS = 10_000

_TEXTS = ("title", "excerpt", "content")
_STORED = T.StructType(
    [T.StructField(f.name, f.dataType) for f in schemas.POSTS]
    + [T.StructField(f"{name}_idx", T.StringType()) for name in _TEXTS]
    + [T.StructField("slice", T.IntegerType())])


def _sliced(posts: DataFrame, slices: int) -> DataFrame:
    return posts.withColumn("slice", F.pmod(F.xxhash64("post_id"), F.lit(slices)).cast("int"))


def _slice_of(posts: DataFrame) -> DataFrame:
    return posts.select("site_id", "slice").distinct()


def _by_slice(sliced: DataFrame) -> DataFrame:
    """Rows of a slice together, so that it makes few files; a slice too large for one task is split."""
    return sliced.hint("rebalance", "site_id", "slice")


def _pending(path: str) -> str:
    return f"{path}/_pending"


def _ready(spark: SparkSession, path: str) -> DataFrame | None:
    """The slices of a batch that are complete beside the store but may not have replaced the old ones yet."""
    files, make = shared_files(spark, path)
    return spark.read.schema(_STORED).parquet(_pending(path)) if files.exists(make(_pending(path) + "/_SUCCESS")) else None


def _finish(spark: SparkSession, path: str) -> None:
    """Put the slices that a complete batch left ready in the place of the old ones. For writers only, of which there is one at a time.

    Folders are moved, not copied: until its move is done a slice is ready, after it is stored.
    """
    files, make = shared_files(spark, path)
    if files.exists(make(_pending(path) + "/_SUCCESS")):
        for site in _folders(files, make, _pending(path), "site_id="):
            files.mkdirs(make(f"{path}/{site}"))
            for part in _folders(files, make, f"{_pending(path)}/{site}", "slice="):
                files.delete(make(f"{path}/{site}/{part}"), True)
                if not files.rename(make(f"{_pending(path)}/{site}/{part}"), make(f"{path}/{site}/{part}")):
                    raise OSError(f"{path}/{site}/{part} could not be replaced")
    files.delete(make(_pending(path)), True)


def _folders(files, make, path: str, begin: str) -> list[str]:
    found = [f.getPath().getName() for f in files.listStatus(make(path)) if f.isDirectory()]
    return sorted(name for name in found if name.startswith(begin))


def _shares(rows: DataFrame) -> list[Column]:
    """Tests that deal the slices of some rows out to shares of about equal size. Fetched are a hash and a count per slice."""
    slice_hash = F.xxhash64("site_id", "slice")
    sizes = sorted(((r.n, r.at) for r in rows.groupBy(slice_hash.alias("at")).agg(F.count("*").alias("n")).collect()), reverse=True)
    shares = [(0, k, []) for k in range(min(SHARES, len(sizes), 1 + sum(n for n, _ in sizes) // SHARE_ROWS))]
    for n, at in sizes:
        held_rows, k, some = heapq.heappop(shares)
        heapq.heappush(shares, (held_rows + n, k, [*some, at]))
    return [slice_hash.isin(some) for _, _, some in shares]


def _replace_slices(merged: Callable[[Column], DataFrame], shares: list[Column], path: str, spark: SparkSession) -> None:
    """The new slices first as a whole beside the store; the copy is marked when all of it is there.

    ``merged`` gives the rows of the slices that fulfil a test. One share of the slices is merged at a time, so that only what
    is shuffled for it is on disk.
    """
    files, make = shared_files(spark, path)
    for k, share in enumerate(shares):
        rows = _by_slice(merged(share).select(*_STORED.names))
        write_table(_prepared(rows), _pending(path), "site_id", "slice", mode="append" if k else "overwrite",
                    **{"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"})
    if shares:
        files.create(make(_pending(path) + "/_SUCCESS")).close()
    _finish(spark, path)


def _unprepared(posts: DataFrame) -> DataFrame:
    """Posts without prepared texts, which ``_prepared`` makes after the shuffle."""
    return posts.withColumns({f"{name}_idx": F.lit(None).cast("string") for name in _TEXTS})


def _prepared(rows: DataFrame) -> DataFrame:
    """The prepared text of each text that has none yet; a stored one is never NULL."""
    def of(name):
        stored = F.col(f"{name}_idx")
        return F.when(F.col("post_id").isNotNull(), F.coalesce(stored, prepare_index_text(F.when(stored.isNull(), F.col(name)))))
    return rows.withColumns({f"{name}_idx": of(name) for name in _TEXTS})


def _slice_count(spark: SparkSession, path: str, slices: int | None) -> int:
    stored = spark.read.schema("slices int").json(f"{path}/_slices").first().slices
    if slices not in (None, stored):
        raise ValueError(f"the store has {stored} slices a site, not {slices}")
    return stored


def _one_per_key(posts: DataFrame) -> DataFrame:
    """``last_arrivals``, but texts are not shuffled for keys that come once: keys are counted by themselves first."""
    repeated = materialize(posts.groupBy(*KEY).agg(F.count("*").alias("n")).filter("n > 1").select(
        *[F.col(c).alias(f"again_{c}") for c in KEY]), "repeated")
    found = repeated.limit(REPEATED_KEYS + 1).count()
    if found == 0:
        return posts
    if found > REPEATED_KEYS:
        return last_arrivals(posts)
    again = F.lit(True)
    for c in KEY:
        again = again & F.col(c).eqNullSafe(F.col(f"again_{c}"))
    return posts.join(repeated, again, "left_anti").unionByName(last_arrivals(posts.join(repeated, again, "left_semi")))


def write_posts(posts: DataFrame, path: str, slices: int = SLICES) -> None:
    """Write a whole store, with the prepared text columns, which are made after the shuffle.

    ``slices`` bounds what a batch rewrites: choose it so that a slice of a large site fits in a few files. Of rows
    with one key the last arrival is kept.
    """
    sliced = _by_slice(_sliced(_one_per_key(posts), slices))
    if "content_idx" not in posts.columns:
        sliced = with_index_text(sliced)
    sliced = sliced.drop("seq")
    write_table(sliced, path, "site_id", "slice")
    posts.sparkSession.range(1).selectExpr(f"{slices} as slices").coalesce(1).write.mode("overwrite").json(f"{path}/_slices")


def _read_slices(spark: SparkSession, path: str) -> DataFrame:
    # With its own schema Spark does not guess the type of site ids from folder names.
    stored = spark.read.schema(_STORED).parquet(path).select(*_STORED.names)
    ready = _ready(spark, path)
    if ready is None:
        return stored
    return stored.join(_slice_of(ready), ["site_id", "slice"], "left_anti").unionByName(ready.select(*_STORED.names))


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return _read_slices(spark, path).filter(F.col("post_id").isNotNull()).drop("slice")


def _touched_slices(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The stored rows of the slices that some keys fall into; other slices are not read.

    The filter on folders is fetched: a batch touches at most sites * slices of them.
    """
    wanted: dict[str, list[int]] = {}
    for r in _slice_of(keys).collect():
        wanted.setdefault(r.site_id, []).append(r.slice)
    stored = _read_slices(spark, path)
    if not wanted:
        return stored.filter(F.lit(False))
    by_slices: dict[tuple[int, ...], list[str]] = {}
    for site, found in wanted.items():
        by_slices.setdefault(tuple(sorted(found)), []).append(site)
    test = F.lit(False)
    for found, sites in by_slices.items():
        test = test | (F.col("site_id").isin(sites) & F.col("slice").isin(list(found)))
    return stored.filter(test)


def stored_posts(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The stored posts of some keys; only the slices of these keys are read."""
    wanted = _sliced(keys.select(*KEY).distinct(), _slice_count(spark, path, None))
    return _touched_slices(spark, path, wanted).join(wanted, [*KEY, "slice"], "left_semi").drop("slice")


def merge_posts(spark: SparkSession, path: str, batch: DataFrame, newest_wins: bool = False,
                slices: int | None = None) -> None:
    """Upsert a batch (post columns and ``seq``) into the store, reading and rewriting only the slices it touches.

    Repeating the batch gives the same store. ``slices``, if given, must be the store's.
    """
    _finish(spark, path)
    incoming = _sliced(_unprepared(batch), _slice_count(spark, path, slices))
    touched = _touched_slices(spark, path, incoming)
    stored = touched.filter(F.col("post_id").isNotNull()).select(*incoming.drop("seq").columns)

    def merged(chosen):
        return upsert_posts(stored.filter(chosen), incoming.filter(chosen), newest_wins)
    _replace_slices(merged, _shares(stored.select("site_id", "slice").unionByName(incoming.select("site_id", "slice"))), path, spark)


def remove_posts(spark: SparkSession, path: str, keys: DataFrame, slices: int | None = None) -> None:
    """Delete posts by key. A slice left empty keeps one row without a post id, which readers skip."""
    _finish(spark, path)
    gone = _sliced(keys.select(*KEY), _slice_count(spark, path, slices))
    touched = _touched_slices(spark, path, gone)
    with held(delete_posts(touched, gone), "delete") as left:
        empty = _slice_of(gone).join(_slice_of(left), ["site_id", "slice"], "left_anti")
        rest = left.unionByName(empty, allowMissingColumns=True)
        _replace_slices(rest.filter, _shares(rest), path, spark)


def write_urls(urls: DataFrame, path: str) -> None:
    """Export urls as text, one per line, in order of ``rn``."""
    urls.orderBy("rn").select("url").write.mode("overwrite").text(path)


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site rows; a table written before groups existed gets the default one."""
    sites = spark.read.schema(schemas.SITES).parquet(path)
    return sites.withColumn("group_id", F.coalesce("group_id", F.lit(DEFAULT_GROUP)))


def write_sites(sites: DataFrame, path: str) -> None:
    """Replace the site table; ``sites`` may have been read from it."""
    materialize(sites, "sites").write.mode("overwrite").parquet(path)
