"""Ranked lexical search: hashed max-sketches bound every score, exact scores follow in descending order of the bounds.

``index`` counts the terms of each text once. A search folds the impacts of a document's terms into a sketch, one
maximum for each of ``CELLS`` cells that terms are hashed to, so the impact of any term is at most that of its cell.
Queries look up their cells for a block of documents at once; the weighted sum is an upper bound of the score. Each
task then scores documents exactly in descending order of their bounds until the next bound is below the lowest score
among the best found so far. What the tasks found is merged by windows.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from yomisaku.llm.common import text_blocks, written
from yomisaku.llm.words import ALNUM, Words

CELLS = 1 << 13
#: Documents, and terms of documents, in one block of sketches; a longer document is a block alone.
BLOCK_DOCS, BLOCK_TERMS = 1024, 1 << 19
#: Terms of queries that are broadcast at once; more queries take more passes over the index.
QUERY_TERMS = 500_000

_LONG = T.LongType()
INDEX = T.StructType([T.StructField("doc_id", _LONG), T.StructField("n", _LONG),
                      T.StructField("terms", T.ArrayType(_LONG)), T.StructField("tfs", T.ArrayType(T.IntegerType()))])


def term_counts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """n of each text, where its terms start, and its distinct terms in ascending order of their hashes with their counts."""
    words = Words(texts, ALNUM)
    hashes, n = words.hashes(), np.diff(words.first)
    whose = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, whose))
    hashes, whose = hashes[order], whose[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (whose[1:] != whose[:-1])
    at = np.flatnonzero(new)
    starts = np.searchsorted(whose[at], np.arange(len(n) + 1))
    return n, starts, hashes[at], np.diff(np.append(at, len(hashes)))


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n (terms with repeats), terms (hashes, ascending) and tfs of every row of ``docs``, written as a table.

    A NULL or empty text has no terms. Repeated rows stay; rows may lack a doc_id; other columns are dropped.
    """
    return written(_counted(docs.select(F.col("doc_id").cast("long"), "text"), INDEX), "lexical-index")


def _counted(rows: DataFrame, schema: T.StructType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches):
            n, starts, terms, tfs = term_counts(part.column(1))
            at = pa.array(starts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms.view(np.int64))),
                 pa.ListArray.from_arrays(at, pa.array(tfs.astype(np.int32)))], names=schema.names)

    return rows.mapInArrow(run, schema)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]], at - at[0]


class Queries:
    """Queries as arrays: the sorted terms of all, and per query the places of its own among them with their weights."""

    def __init__(self, block: pa.Table, df: dict[int, int], n_docs: int):
        terms, at = _flat(block.column("terms").combine_chunks())
        tfs = _flat(block.column("tfs").combine_chunks())[0]
        self.numbers = block.column("query").to_pylist()
        self.terms = np.unique(terms.view(np.uint64))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(int(t), 0) + 1)))
                            for t in self.terms.view(np.int64)], np.int64)
        place = np.searchsorted(self.terms, terms.view(np.uint64))
        self.places = np.split(place, at[1:-1])
        self.weights = np.split(weights[place] * tfs, at[1:-1])
        self.cells, cell = np.unique(_cell(self.terms), return_inverse=True)
        self.slots = [cell[p] for p in self.places]


def _cell(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(17)).astype(np.int64) & (CELLS - 1)


class Best:
    """The k best documents that one task has found for a query; the floor is what a score must reach to matter."""

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], 1

    def add(self, scores: np.ndarray, ids: list[int | None]) -> None:
        self.rows += [(-s, d is None, d) for s, d in zip(scores.tolist(), ids) if s >= self.floor]
        self.rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        del self.rows[self.k:]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def _impacts(tfs: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * m)


class Block:
    """Some documents: their sketches over the cells of the queries, and the impacts of the terms that queries have."""

    def __init__(self, queries: Queries, ids: list[int | None], m: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        self.ids, self.width = ids, len(queries.terms)
        whose = np.repeat(np.arange(len(ids)), np.diff(at))
        impacts = _impacts(tfs.astype(np.int64), m[whose])
        cells = _cell(terms)
        slot = np.searchsorted(queries.cells, cells)
        slot[slot == len(queries.cells)] = 0
        asked = queries.cells[slot] == cells
        self.sketch = np.zeros((len(queries.cells), len(ids)))
        np.maximum.at(self.sketch.ravel(), slot[asked] * len(ids) + whose[asked], impacts[asked].astype(float))
        place = np.searchsorted(queries.terms, terms)
        place[place == self.width] = 0
        own = queries.terms[place] == terms
        self.keys, self.impacts = whose[own] * self.width + place[own], impacts[own]

    def bounds(self, slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of all documents' scores; sums stay far below 2**53, so they are exact."""
        return weights.astype(float) @ self.sketch[slots]

    def scores(self, docs: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
        keys = docs[:, None] * self.width + places
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.impacts[at] * weights, 0).sum(axis=1)

    def rescore(self, slots: np.ndarray, places: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Exact scores in descending order of the bounds until a bound is below the floor; how many were made."""
        if not len(self.keys):
            return 0
        bounds = self.bounds(slots, weights)
        docs = np.flatnonzero(bounds >= best.floor)
        docs = docs[np.argsort(-bounds[docs], kind="stable")]
        done, size = 0, 16
        while done < len(docs) and bounds[docs[done]] >= best.floor:
            some = docs[done:done + size]
            best.add(self.scores(some, places, weights), [self.ids[d] for d in some.tolist()])
            done, size = done + len(some), min(2 * size, 256)
        return done


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of some documents each, and of some terms."""
    for batch in batches:
        at = batch.column(2).offsets.to_numpy()
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + BLOCK_TERMS, side="right")) - 1
            end = min(max(end, start + 1), start + BLOCK_DOCS, batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


def _frequencies(indexed: DataFrame, block: DataFrame) -> dict[int, int]:
    """How many documents hold each term of a block of queries."""
    wanted = np.unique(_flat(block.select("terms").toArrow().column(0).combine_chunks())[0].view(np.uint64))
    shared = indexed.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        counts = np.zeros(len(known), np.int64)
        for batch in batches:
            terms = _flat(batch.column(0))[0].view(np.uint64)
            at = np.searchsorted(known, terms)
            at[at == len(known)] = 0
            counts += np.bincount(at[known[at] == terms], minlength=len(known))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(known[some].view(np.int64)), pa.array(counts[some])], names=["term", "df"])

    if not len(wanted):
        return {}
    counted = indexed.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in counted.collect()}


def _candidates(indexed: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    shared = indexed.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best = [Best(k) for _ in asked.numbers]
        for part in _parts(batches):
            terms, at = _flat(part.column(2))
            m = 25 + 75 * part.column(1).to_numpy() * n_docs // n_terms
            block = Block(asked, part.column(0).to_pylist(), m, at, terms.view(np.uint64), _flat(part.column(3))[0])
            for q, found in enumerate(best):
                block.rescore(asked.slots[q], asked.places[q], asked.weights[q], found)
        rows = [(number, -s, d) for number, found in zip(asked.numbers, best) for s, _, d in found.rows]
        for at in range(0, len(rows), 10_000):
            columns = zip(*rows[at:at + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "score", "doc_id"])

    return indexed.mapInArrow(run, "query long, score long, doc_id long")


def _top(rows: DataFrame, k: int, *keys) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(indexed: DataFrame, items: DataFrame, k: int = 10, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of ``index``'s form for each row of ``items`` (item_id, text).

    The score sums over the item's terms, repeats included, a weight that falls with the share of documents holding
    the term, times an impact that grows with its count and falls with the document's length. Documents
    score above 0 or are left out, so an item of NULL or empty text, or without a term that documents have, gives no
    row. Equal scores are in ascending order of doc_id, rows without doc_id last; repeated rows of documents take a
    rank each; rows repeated in ``items`` are answered each. Without documents there are no rows. Other columns are dropped.
    """
    n_docs, n_terms = indexed.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    numbered = written(items.select("item_id", "text", F.monotonically_increasing_id().alias("query")), "items")
    asked = written(_counted(numbered.select("query", "text"), T.StructType([T.StructField("query", _LONG), *INDEX.fields[1:]]))
                    .filter("n > 0"), "queries")
    found, total = None, asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    parts = max(1, -(-total // query_terms))
    for part in range(parts):
        block = asked.filter(F.pmod(F.xxhash64("query"), F.lit(parts)) == part) if parts > 1 else asked
        got = block.toArrow()
        if not got.num_rows or not n_terms:
            continue
        queries = Queries(got, _frequencies(indexed, block), n_docs)
        some = written(_candidates(indexed, queries, n_docs, n_terms, k), "found")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = numbered.select("query", F.lit(0).cast("long").alias("score"), F.lit(0).cast("long").alias("doc_id")).filter("false")
    # The tasks' best are reduced in salted parts first, so that no task takes all of one query.
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    best = _top(_top(found, k, "query", part).drop("rank"), k, "query")
    return best.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")
