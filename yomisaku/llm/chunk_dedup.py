"""Substring dedup by content-defined chunking with a gear rolling hash.

A chunk ends after a blank (or, where a script has none, after a character) if some bits of the gear hash of the last 16 bytes
are zero, so its limits depend on these bytes alone and inserting text moves no others. Chunks are compared by a
128-bit digest. An occurrence is a repeat if the same chunk occurs earlier, by (doc_id, hash of the text, place). Runs of
repeats of ``min_bytes`` or more are cut; chunks shorter than ``small`` bytes are too common to tell anything and join
the run around them.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from yomisaku.llm.bitmaps import bitmap, in_bitmap
from yomisaku.llm.common import free_name, text_blocks, text_bytes, written
from yomisaku.llm.words import mix, segment_hashes

#: Bits of the hash that are zero after a blank where a chunk ends, and after any other character.
BLANK_BITS, ANY_BITS = 2, 10
SMALL = 16
MIN_BYTES = 100
WINDOW = 16

#: The gear: a 16-bit number per byte value, from a fixed rule.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.uint16)


def gear_hash(raw: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: the sum of the gear of the last 16 bytes, each shifted by its distance."""
    total = GEAR[raw]
    reach = 1
    while reach < WINDOW:  # twice the reach with each step
        moved = np.zeros_like(total)
        moved[reach:] = total[:-reach] << np.uint16(reach) if len(total) > reach else 0
        total = total + moved
        reach *= 2
    return total


def chunk_ends(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where the chunks of some texts end: after these bytes; ``texts`` are the texts' limits in ``raw``."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    hashed = gear_hash(raw)
    follows = np.zeros(n, np.uint8)
    follows[:-1] = raw[1:]
    whole = (follows & 0xC0) != 0x80  # no cut inside a character
    place = (raw == 0x20) | (raw == 0x0A) | (follows >= 0xE0)
    top = np.uint16(16)
    ends = whole & (place & (hashed >> (top - np.uint16(BLANK_BITS)) == 0) | (hashed >> (top - np.uint16(ANY_BITS)) == 0))
    starts = texts[:-1][texts[:-1] < texts[1:]]
    # The window must not reach into the text before.
    near = (starts[:, None] + np.arange(WINDOW - 1)[None, :]).ravel()
    ends[near[near < n]] = False
    ends[texts[1:][texts[1:] > texts[:-1]] - 1] = True
    return np.flatnonzero(ends) + 1


class Chunks:
    """The chunks of a column of texts: bytes ``starts`` to ``ends``, their two digests; text d has first[d] to first[d + 1]."""

    def __init__(self, texts: pa.Array):
        self.raw, self.texts = text_bytes(texts)
        self.ends = chunk_ends(self.raw, self.texts)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if len(self.ends) else self.ends
        self.first = np.searchsorted(self.starts, self.texts)
        self.size = self.ends - self.starts

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        return segment_hashes(self.raw, self.starts, self.ends), segment_hashes(self.raw, self.starts, self.ends, 1)


def repeated(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, t (hash of the text) and starts (sorted first bytes) of the chunks of each text that occur earlier."""
    source = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches):
            chunks = Chunks(part.column(1))
            values = chunks.digests()[0][chunks.size >= small] & np.uint64((1 << 31) - 1)
            found, n = np.unique(values, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(np.minimum(n, 2).astype(np.int8))], names=["w", "n"])

    counted = source.mapInArrow(count, "w int, n byte").groupBy("w").agg(F.sum("n").alias("n")).filter("n > 1")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(counted.select(F.col("w").cast("long").alias("w")), "w"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches):
            chunks = Chunks(part.column(1))
            a, b = chunks.digests()
            keep = np.flatnonzero((chunks.size >= small) & in_bitmap(bits.value, a & np.uint64((1 << 31) - 1)))
            text_of = np.searchsorted(chunks.first, keep, side="right") - 1
            rows = pa.array(text_of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[keep].view(np.int64)), pa.array(b[keep].view(np.int64)), part.column(0).take(rows),
                 part.column(2).take(rows), pa.array((chunks.starts[keep] - chunks.texts[text_of]).astype(np.int64))],
                names=["a", "b", "doc_id", "t", "start"])

    found = written(source.mapInArrow(emit, "a long, b long, doc_id long, t long, start long"), "chunks")
    place = F.struct("doc_id", "t", "start")
    # Written, so that the join has shuffles of its own, whose hot partitions Spark splits.
    first = written(found.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .filter("not (first <=> last)").select("a", "b", "first"), "first-chunks")
    later = found.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("start")).alias("starts"))


def runs_of_repeats(chunks: Chunks, text: int, starts: np.ndarray, small: int, min_bytes: int) -> list[tuple[int, int]]:
    """The byte spans of a text to cut: runs of repeats, with small chunks between them, of ``min_bytes`` or more."""
    a, b = int(chunks.first[text]), int(chunks.first[text + 1])
    begin, end = chunks.starts[a:b] - chunks.texts[text], chunks.ends[a:b] - chunks.texts[text]
    again = np.isin(begin, starts)
    bridge = again | (chunks.size[a:b] < small)
    change = np.diff(np.concatenate([[0], bridge.astype(np.int8), [0]]))
    spans = []
    for lo, hi in zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()):
        inside = np.flatnonzero(again[lo:hi])
        if len(inside):
            s, e = int(begin[lo + inside[0]]), int(end[lo + inside[-1]])
            if e - s >= min_bytes:
                spans.append((s, e))
    return spans


def dedup_chunks(docs: DataFrame, small: int = SMALL, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``docs`` with runs of repeated chunks cut from the texts, and the bytes cut as n_cut_bytes.

    The first occurrence stays; so does each row with all its columns (n_chars, where there is one, follows a cut
    text): an exact copy becomes empty. Rows repeated whole count as one place and are cut alike. NULL and empty
    texts have no chunks. Rows without doc_id come before all others.
    """
    names = docs.columns
    t, key, cut = (free_name(docs, n) for n in ("chunk_t", "chunk_id", "chunk_starts"))
    gone = repeated(docs, small).select(F.col("doc_id").alias(key), F.col("t").alias(t + "_r"), F.col("starts").alias(cut))

    @F.pandas_udf(T.StringType())
    def shorter(texts: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else _shorter(x, s, small, min_bytes) for x, s in zip(texts, starts)], dtype=object)

    joined = docs.withColumn(t, F.xxhash64("text")).join(
        gone, F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(t) == F.col(t + "_r")), "left")
    # Texts without repeats don't go to Python: the function gets NULL for them.
    some = F.col(cut).isNotNull()
    joined = joined.withColumn(t, shorter(F.when(some, F.col("text")), F.col(cut)))
    left = F.coalesce(F.col(t), F.col("text"))

    def column(c):
        if c.lower() == "text":
            return left.alias(c)
        if c.lower() == "n_chars":
            return F.when(some, F.length(t).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(c)
    size = F.coalesce(F.octet_length("text") - F.octet_length(left), F.lit(0)).cast("long")
    return joined.select(*[column(c) for c in names], size.alias(free_name(docs, "n_cut_bytes")))


def _shorter(text: str, starts: np.ndarray, small: int, min_bytes: int) -> str:
    raw = text.encode()
    at, left = 0, []
    for s, e in runs_of_repeats(Chunks(pa.array([text], pa.large_string())), 0, starts, small, min_bytes):
        left.append(raw[at:s])
        at = e
    return b"".join([*left, raw[at:]]).decode()
