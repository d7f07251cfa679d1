"""Benchmark decontamination with a generalised suffix automaton of the benchmark's words.

The automaton of a block of items goes to the executors, and each text is streamed through it: it tracks the longest
run of words ending at the current word that occurs in an item. Where that reaches the window length, the words of the
run are hit. Only stretches whose neighbouring word pairs all occur in the block are streamed, which is a necessary
condition for a window and costs a look-up on arrays for the rest.

A block holds a bounded number of words, so what is broadcast does not grow with the benchmark; a larger benchmark is
matched block by block, each over all documents.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from yomisaku.llm.common import text_blocks, written
from yomisaku.llm.words import ALNUM, Words, runs

WINDOW = 13
BLOCK_WORDS = 200_000

MATCHED = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType()))])


class Automaton:
    """Suffix automaton of several word sequences.

    ``window`` is the run length that counts; an item with fewer words, but not none, counts as a whole.
    """

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.next, self.link, self.size = [{}], [-1], [0]
        self.items: dict[int, set[str]] = {}
        ends = []
        for _, words in items:
            last = 0
            for w in words.tolist():
                last = self._add(last, w)
            ends.append(last)
        self.short: dict[int, list[str]] = {}
        for (item, words), end in zip(items, ends):
            if 0 < len(words) < window:
                self.short.setdefault(end, []).append(item)
        # For each state the nearest one on its suffix path that is a whole short item.
        self.up = [0] * len(self.next)
        for s in sorted(range(1, len(self.next)), key=self.size.__getitem__):
            self.up[s] = s if s in self.short else self.up[self.link[s]]
        for item, words in items:
            if len(words) >= window:
                for _, state, length in self.walk(words.tolist()):
                    if length >= window:
                        self.items.setdefault(self.window_state(state), set()).add(item)
        sizes = [len(w) for _, w in items if len(w)]
        self.least = min([window, *sizes])
        known = [w for _, w in items if len(w)]
        self.vocabulary = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.pairs = np.unique(np.concatenate([runs(w, 2) for w in known])) if known else np.zeros(0, np.uint64)

    def _add(self, last: int, w: int) -> int:
        seen = self.next[last].get(w)
        if seen is not None:
            if self.size[seen] == self.size[last] + 1:
                return seen
            return self._split(last, w, seen)
        new = self._state(self.size[last] + 1, {}, 0)
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._split(p, w, q)
        return new

    def _split(self, p: int, w: int, q: int) -> int:
        copy = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _state(self, size: int, follow: dict, link: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.size.append(size)
        return len(self.next) - 1

    def walk(self, words: list[int]) -> Iterator[tuple[int, int, int]]:
        """Position, state and length of the longest known run that ends at each word."""
        state, length = 0, 0
        for i, w in enumerate(words):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            yield i, state, length

    def window_state(self, state: int) -> int:
        """The state of the last ``window`` words of a match."""
        while self.size[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def matches(self, words: np.ndarray) -> tuple[np.ndarray, set[str]]:
        """Which words are inside a window's occurrence, and the items whose windows occur."""
        edges, found = np.zeros(len(words) + 1, np.int32), set()
        for start, end in self._stretches(words):
            for i, state, length in self.walk(words[start:end].tolist()):
                if length >= self.window:
                    top = self.window_state(state)
                    edges[start + i + 1 - self.window] += 1
                    edges[start + i + 1] -= 1
                    found |= self.items.get(top, set())
                # The state may stand for longer runs than the match; what is whole in the match has its full length.
                s = self.up[state]
                while s:
                    if self.size[s] <= length:
                        edges[start + i + 1 - self.size[s]] += 1
                        edges[start + i + 1] -= 1
                        found.update(self.short[s])
                    s = self.up[self.link[s]]
        return np.cumsum(edges[:-1]) > 0, found

    def _stretches(self, words: np.ndarray) -> list[tuple[int, int]]:
        if not len(words) or not len(self.vocabulary):
            return []
        if self.least == 1:
            hit = among(words, self.vocabulary)
            extra = 0
        else:
            hit = among(runs(words, 2), self.pairs)
            extra = 1
        change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = ends - starts + extra >= self.least
        return list(zip(starts[long].tolist(), (ends[long] + extra).tolist()))


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array ``known``."""
    if not len(known) or not len(values):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def _item_blocks(benchmark: DataFrame, block_words: int) -> list[DataFrame]:
    """The benchmark in parts of about ``block_words`` words, none of which goes whole through the driver otherwise."""
    items = written(benchmark.select(F.col("item_id").cast("string").alias("item"), "text")
                    .filter("item is not null and text is not null").distinct(), "items")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-chars // (4 * block_words)))
    if parts == 1:
        return [items]
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k) for k in range(parts)]


def _automaton(block: DataFrame, window: int) -> Automaton:
    got = block.toArrow().combine_chunks()
    if not got.num_rows:
        return Automaton([], window)
    texts = got.column("text").combine_chunks()
    words = Words(texts, ALNUM)
    hashes = words.hashes()
    return Automaton([(item, hashes[words.first[i]:words.first[i + 1]])
                      for i, item in enumerate(got.column("item").to_pylist())], window)


def benchmark_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs`` its words inside benchmark windows, as spans of words and of bytes, and the items found.

    Returns doc_id, text, n_words, spans (first and last word, start and end byte of the UTF-8 text) and items (sorted
    item ids as strings). A NULL or empty text has no words and no spans; items with NULL id or text are left out,
    repeated items count once; repeated document rows each give a row; other columns are dropped. An empty benchmark
    finds nothing.
    """
    return _matched(docs.select("doc_id", "text"), benchmark, window, block_words)


def _matched(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int) -> DataFrame:
    """``docs``, which has a column text, with n_words, spans and items added."""
    spark = docs.sparkSession
    blocks = _item_blocks(benchmark, block_words)
    schema = T.StructType(docs.schema.fields + MATCHED.fields)
    out = docs
    for k, block in enumerate(blocks):
        shared = spark.sparkContext.broadcast(_automaton(block, window))

        def scan(batches, shared=shared, again=k > 0):
            for part in text_blocks(batches):
                yield _scan(part, shared.value, again)

        out = out.mapInArrow(scan, schema)
        if k + 1 < len(blocks):  # one automaton at a time in memory
            out = written(out, "spans")
    return out


def _scan(part: pa.RecordBatch, automaton: Automaton, again: bool) -> pa.RecordBatch:
    texts = part.column(part.schema.get_field_index("text"))
    words = Words(texts, ALNUM)
    hashes = words.hashes()
    before = part.column(part.num_columns - 2).to_pylist() if again else None
    earlier = part.column(part.num_columns - 1).to_pylist() if again else None
    spans, items = [], []
    for d in range(part.num_rows):
        a, b = words.first[d], words.first[d + 1]
        hit, found = automaton.matches(hashes[a:b])
        if again:
            for s in before[d]:
                hit[s["first"]:s["last"] + 1] = True
            found = found | set(earlier[d])
        change = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])) if hit.any() else np.zeros(0, np.int8)
        spans.append([{"first": f, "last": t, "start": int(words.starts[a + f] - words.texts[d]),
                       "end": int(words.ends[a + t] - words.texts[d])}
                      for f, t in zip(np.flatnonzero(change == 1).tolist(), (np.flatnonzero(change == -1) - 1).tolist())])
        items.append(sorted(found))
    fields = list(part.schema)[:part.num_columns - 3 * again]
    kinds = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])),
             pa.list_(pa.string())]
    added = [np.diff(words.first), spans, items]
    return pa.RecordBatch.from_arrays(
        part.columns[:len(fields)] + [pa.array(v, kind) for v, kind in zip(added, kinds)],
        schema=pa.schema(fields + [pa.field(f.name, kind) for f, kind in zip(MATCHED.fields, kinds)]))


def n_hit() -> F.Column:
    return F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0).cast("long"))


def report(spans: DataFrame, coverage: int = 20) -> DataFrame:
    """The figures of ``benchmark_spans``: contaminated where a ``coverage``-th of the words or more are hit."""
    hit = spans.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return hit.withColumn("contaminated", F.expr(f"n_hit > 0 and {coverage} * n_hit >= n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: int = 20,
                  max_span: int | None = None, drop: bool = False) -> DataFrame:
    """``docs`` without the benchmark spans that exceed the limits.

    A row is over the coverage limit where a ``coverage``-th of its words or more are hit: all its spans are cut, or
    with ``drop`` the row goes. In other rows spans of more than ``max_span`` words are cut (None: none). The row keeps
    its other columns, whatever their names; NULL and empty texts stay as they are; n_chars, where there is one,
    follows a cut text.
    """
    packed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text"))
    found = _matched(packed, benchmark, window, BLOCK_WORDS)
    over = F.expr("hit > 0 and {0} * hit >= n_words".format(coverage))
    long = F.filter("spans", lambda s: s["last"] - s["first"] >= max_span) if max_span is not None else F.slice("spans", 1, 0)
    judged = found.withColumn("hit", n_hit()).withColumn("over", over)
    if drop:
        judged = judged.filter("not over")
    judged = judged.withColumn("go", F.when(F.col("over"), F.col("spans")).otherwise(long))
    cut = F.size("go") > 0
    # Spans end where words do, so each piece between them is whole UTF-8. No second Python worker is needed for a task.
    begin = "if(i = 0, 0L, go[i - 1].`end`)"
    shorter = F.when(cut, F.expr(
        f"array_join(transform(sequence(0, size(go)), i -> cast(substring(cast(text as binary), cast({begin} + 1 as int),"
        f" cast(if(i = size(go), octet_length(text), go[i].`start`) - {begin} as int)) as string)), '')"))
    done = judged.select("row", "text", cut.alias("cut"), shorter.alias("shorter"))

    def column(c):
        if c.lower() == "text":
            return F.when(F.col("cut"), F.col("shorter")).otherwise(F.col("text")).alias(c)
        if c.lower() == "n_chars":
            kind = docs.schema[c].dataType
            return F.when(F.col("cut"), F.length("shorter").cast(kind)).otherwise(F.col("row")[c]).alias(c)
        return F.col("row")[c].alias(c)
    return done.select(*[column(c) for c in docs.columns])
