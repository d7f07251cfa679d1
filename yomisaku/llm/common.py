"""What several operators share: tables, the shared scratch folder, and Arrow batches of bounded text size."""

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from yomisaku import session

#: Bytes of text that a worker holds as arrays at once; one longer text is taken alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which all executors share.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return os.path.join(session.scratch_root(spark), f"llm-{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(rows: DataFrame, most: int, most_bytes: int) -> list[DataFrame]:
    """``rows``, a written table, in parts of about ``most`` rows and ``most_bytes`` bytes of text, for the driver to take
    one after the other; rows alike share a part."""
    texts = [F.octet_length(c) for c, kind in rows.dtypes if kind == "string"]
    size = sum((F.coalesce(t, F.lit(0)) for t in texts), F.lit(0)).cast("long")
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    parts = max(1, -(-count // most), -(-total // most_bytes))
    if parts == 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(parts)) == k) for k in range(parts)]


def row_digest(*columns: str) -> F.Column:
    """128 bits of some columns as two longs; NULL and the empty text differ."""
    marked = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    return F.struct(F.xxhash64(*marked).alias("a"), F.xxhash64(F.lit("second"), *marked).alias("b"))


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold ``limit`` bytes of text at most, or a single longer text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(np.diff(text_bytes(batch.column(batch.schema.get_field_index(column)))[1]))
        start, done = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start, done = end, int(sizes[end - 1])


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow text column in one array, and where each text starts; NULL is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]
