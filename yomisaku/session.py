"""Session helpers: local sessions for tests and bench, and tables in the shared scratch folder."""

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

ZSTD_LEVEL = 9
_own_roots: dict[str, str] = {}
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: str = "8", app: str = "yomisaku", memory: str = "12g") -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting (tests, the bench) gets a temporary folder of its own; executors on
    other machines would not see it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = tempfile.mkdtemp(prefix="yomisaku-")
    return _own_roots[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path no other run uses."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Inside it the shuffle files of a query go when it ends, instead of whenever the driver collects its garbage."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def write_table(df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite", **options: str) -> None:
    """Write ``df`` as densely packed Parquet; its shuffle files are gone afterwards."""
    writer = df.write.mode(mode).options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": ZSTD_LEVEL}, **options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(df.sparkSession):
        writer.parquet(path)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the plan, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    write_table(df, path, *partition_by)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``materialize`` for the time of a block: the table is deleted when it ends."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    try:
        write_table(df, path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        files, make = shared_files(spark, path)
        files.delete(make(path), True)


def shared_files(spark: SparkSession, path: str):
    """The Hadoop file system that holds a path, and what makes its path objects."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make
