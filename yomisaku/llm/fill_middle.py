"""Fill-in-middle: cut texts at two ranks, found by an indexable skip list, and put the middle last.

The bytes of a block of texts are the bottom of a skip list. Its lowest express lane has a link over every ``SPAN``
bytes, each lane above one over every ``FAN`` links of the lane below. Each link carries its width in units and in code points. A
rank is reached from the top: as long as the link ahead is not too wide it is taken and its widths are added up, else
the search goes down a lane. All ranks of a block descend together.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from yomisaku.llm.common import free_name, text_blocks, text_bytes

SPAN, FAN = 128, 16
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def unit_starts(raw: np.ndarray, firsts: np.ndarray, unit: str) -> np.ndarray:
    """Marks the bytes at which a unit begins: each code point, each word after blanks, or each line.

    A text begins with a unit, so units tile it; blanks before a text's first word are a unit of their own.
    """
    if unit == "char":
        return (raw & 0xC0) != 0x80
    starts = np.zeros(len(raw), bool)
    if unit == "word":
        starts[1:] = ~_BLANK[raw[1:]] & _BLANK[raw[:-1]]
    elif unit == "line":
        starts[1:] = raw[:-1] == 0x0A
    else:
        raise ValueError(f"units are char, word or line, not {unit}")
    starts[firsts] = True
    return starts


class SkipList:
    """Lanes of links over the bytes of some texts laid end to end; ``units`` marks where units begin."""

    def __init__(self, raw: np.ndarray, units: np.ndarray):
        self.size = len(raw)
        self.units, self.chars = units, (raw & 0xC0) != 0x80
        self.lanes = [tuple(self._widths(x, SPAN) for x in (self.units, self.chars))]
        while len(self.lanes[-1][0]) > FAN:
            self.lanes.append(tuple(self._widths(x, FAN) for x in self.lanes[-1]))
        self.total_units, self.total_chars = (int(x.sum()) for x in self.lanes[-1])

    @staticmethod
    def _widths(below: np.ndarray, step: int) -> np.ndarray:
        if not len(below):
            return np.zeros(0, np.int64)
        return np.add.reduceat(below, np.arange(0, len(below), step), dtype=np.int64)

    def seek(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte at which the unit of each rank begins, and the code points before it; beyond the last unit the end."""
        byte, before = np.full(len(ranks), self.size), np.full(len(ranks), self.total_chars)
        inside = ranks < self.total_units
        left = ranks[inside].astype(np.int64)
        at, chars = np.zeros(len(left), np.int64), np.zeros(len(left), np.int64)
        for lane, (units, points) in enumerate(reversed(self.lanes)):
            at *= FAN if lane else 1
            while len(at):
                width = units[at]
                go = left >= width
                if not go.any():
                    break
                left -= np.where(go, width, 0)
                chars += np.where(go, points[at], 0)
                at += go
        for a in range(0, len(at), 4096):  # the last steps, over the bytes below one link
            part = slice(a, a + 4096)
            place = at[part, None] * SPAN + np.arange(SPAN)
            real = place < self.size
            place = np.minimum(place, self.size - 1)
            passed = np.cumsum(self.units[place] & real, axis=1)
            step = (passed > left[part, None]).argmax(axis=1)
            points = np.cumsum(self.chars[place] & real, axis=1)
            at[part] = at[part] * SPAN + step
            chars[part] += points[np.arange(len(step)), step] - 1
        byte[inside], before[inside] = at, chars
        return byte, before


def _counts(marks: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """How many marks lie in each text."""
    out, some = np.zeros(len(texts) - 1, np.int64), texts[:-1] < texts[1:]
    if some.any():
        out[some] = np.add.reduceat(marks, texts[:-1][some], dtype=np.int64)
    return out


def cut(texts: pa.Array, first: np.ndarray, second: np.ndarray, unit: str = "char") -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Per text its number of units n, the code points of the prefix and of the middle, and the three pieces one after the other.

    The prefix ends after the smaller, the middle after the larger of ``first`` and ``second`` modulo n + 1.
    """
    raw, at = text_bytes(texts)
    units = unit_starts(raw, at[:-1][at[:-1] < at[1:]], unit)
    lanes = SkipList(raw, units)
    n, points = _counts(lanes.units, at), _counts(lanes.chars, at)
    x, y = first % (n + 1), second % (n + 1)
    base, points_before = np.cumsum(n) - n, np.cumsum(points) - points
    byte, chars = lanes.seek(np.concatenate([base + np.minimum(x, y), base + np.maximum(x, y)]))
    (low, high), (c, d) = np.split(byte, 2), np.split(chars, 2)
    offsets = np.append(np.stack([at[:-1], low, high], axis=1).ravel(), at[-1])
    pieces = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    return n, c - points_before, d - c, pieces.cast(pa.string())


def restored(output: Column, form: Column) -> Column:
    """The text that ``transform`` made an output of: the marks stand in a known order and in no text that was cut."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1])))


def transform(docs: DataFrame, seed: str = "1", plain: int = 10, spm: int = 20, unit: str = "char") -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output.

    Four numbers come from the SHA-256 of ``seed``, a colon and doc_id: two choose the cuts, the third leaves ``plain`` of a hundred
    texts as they are, the fourth gives ``spm`` of a hundred of the others the form spm (suffix, prefix, middle) in
    place of psm. Texts that are empty or hold one of the marks are plain as well; their chars are NULL. A NULL text
    is an empty one; a NULL doc_id is hashed as an empty one; repeated rows give equal rows. Other columns stay, and
    where ``docs`` already has a name the new one gets underscores.
    """
    digest = F.sha2(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long") for i in range(4)]
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("row")
    text = F.coalesce("text", F.lit("")).alias("text")
    source = docs.select(row, text, *[x.alias(f"h{i + 1}") for i, x in enumerate(h)])
    schema = T.StructType([*source.schema.fields, *[T.StructField(c, T.LongType()) for c in ("n", "p", "m")],
                           *[T.StructField(c, T.StringType()) for c in ("prefix", "middle", "suffix")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches):
            h1, h2 = part.column(2).to_numpy(), part.column(3).to_numpy()
            n, p, m, pieces = cut(part.column(1), h1, h2, unit)
            third = [pieces.take(pa.array(np.arange(i, len(pieces), 3))) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(x, pa.int64()) for x in (n, p, m)], *third], names=schema.names)

    made = source.mapInArrow(run, schema)
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = (F.when((F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain), "plain")
            .when(F.col("h4") % 100 < spm, "spm").otherwise("psm"))
    made = made.withColumn("form", form)
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
              .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")))
    new = {"n": F.col("n"), "form": F.col("form"), "prefix_chars": F.when(F.col("form") != "plain", F.col("p")),
           "middle_chars": F.when(F.col("form") != "plain", F.col("m")), "output": output}
    return made.select(*[F.col("row")[c].alias(c) for c in docs.columns],
                       *[column.alias(free_name(docs, name)) for name, column in new.items()])


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, the chars, and digests of the output and of the text rebuilt from it."""
    made = transform(docs.select(F.col("doc_id").cast("long"), "text"), **options)
    digest = [F.sha2(x, 256).alias(name) for x, name in
              [(F.col("output"), "output_sha256"), (restored(F.col("output"), F.col("form")), "restored_sha256")]]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digest)
