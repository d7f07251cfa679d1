"""The text index as tables.

``postings`` is the flat view, one row per token. The stored form groups it by term and document:

``terms``   term, site_id, post_id, doc_len, tf_title, tf_excerpt, tf_content, positions, bucket
``vocab``   term, docs, total
``docs``    site_id, post_id, doc_len
``corpus``  n_docs, avg_len (one row)
``hot``     term: terms that many documents hold
``pairs``   as ``terms``, but of two neighbouring hot terms with a blank between them, and without counts

A phrase of hot terms reads its pairs, which are much rarer than either term. Which terms are hot is settled when a version
is written and holds for all its generations, so the pairs are complete for every document whatever the corpus becomes;
writing the index anew settles it again.

On disk an index has a folder per version, and in it each table one per generation. A batch of changes is appended as a
generation, never merged into old files: terms and documents leave out older rows of touched documents when read, vocabulary
and corpus figures hold what a generation adds to the sums. Writing the index anew makes a version of one generation;
readers take the newest complete version.

A position is ``field number * 2**28 + place in the field``: neighbours are in one field, and one array
serves all three. The terms table has a folder per bucket of leading letters and is sorted by term in each file, so a
search reads only the folders and row groups of its terms; a term found in every document spreads over the many files of
its folder.
"""

import hashlib
import time
from collections.abc import Iterator
from contextlib import nullcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from yomisaku.functions.text import index_terms, index_terms_text, latin_table, simple_index_text, with_index_text
from yomisaku.session import held, shared_files, write_table

FIELDS = (("title", "A"), ("excerpt", "B"), ("content", "C"))  # fixed values: fields and weight classes
FIELD_SHIFT = 28
BUCKETS = 64
DOC = ["site_id", "post_id"]
#: A term is hot from one document in so many on. At most so many times the mean number of distinct terms in a document are.
HOT_SHARE = 128
#: Bytes of text whose terms a worker holds as arrays at once; one longer document is taken alone.
BLOCK_BYTES = 4 << 20
#: A generation's terms and pairs are written in parts of its documents, so that the shuffle of one part is on disk at a time: one part
#: for so many terms, and no more parts than that, as each reads the texts.
PART_TERMS = 8_000_000
PARTS = 8
#: Bytes of terms: ASCII letters and digits, and those of other characters. All others separate terms.
_IN_TERM = np.array([b > 127 or chr(b).isalnum() for b in range(256)])
_SPACED = np.where(_IN_TERM, np.arange(256), ord(" ")).astype(np.uint8)

_KEY = "site_id string, post_id bigint"
_SCHEMAS = {
    "terms": f"term string, {_KEY}, doc_len int, tf_title int, tf_excerpt int, tf_content int, "
             "positions array<int>, gen int, bucket int",
    "vocab": "term string, docs bigint, total bigint, gen int",
    "docs": f"{_KEY}, doc_len int, gen int",
    "hot": "term string",
    "pairs": f"term string, {_KEY}, doc_len int, positions array<int>, gen int, bucket int",
    "corpus": "n_docs bigint, sum_len bigint, gen int",
    "touched": f"{_KEY}, gen int",
}


class Index(NamedTuple):
    terms: DataFrame
    vocab: DataFrame
    docs: DataFrame
    corpus: DataFrame
    hot: DataFrame | None = None      # without hot terms and pairs, phrases read whole position lists
    pairs: DataFrame | None = None


def _per_field(posts: DataFrame, prepared) -> DataFrame:
    """``prepared`` of the stored ``*_idx`` column of each field, or else of the computed one."""
    if "content_idx" not in posts.columns:
        posts = with_index_text(posts)
    idx = posts.select(*DOC, *[f"{f}_idx" for f, _ in FIELDS])
    return idx.select(*DOC, *[prepared(F.col(f"{f}_idx")).alias(f) for f, _ in FIELDS])


def _with_terms(posts: DataFrame) -> DataFrame:
    """Stage 2 term arrays per field."""
    return _per_field(posts, index_terms)


def _term_texts(posts: DataFrame) -> DataFrame:
    """Texts per field whose terms are runs of ASCII letters, digits and other characters, Latin marks not folded yet.

    That is true of most prepared texts as they are; of the others it is the stage 2 text.
    """
    return _per_field(posts, lambda text: F.when(simple_index_text(text), text).otherwise(index_terms_text(text)))


def postings(posts: DataFrame) -> DataFrame:
    """One row per token: document, field, weight class, position, term."""
    fields = F.array(*[
        F.struct(F.lit(f).alias("field"), F.lit(w).alias("weight_class"), F.col(f).alias("terms"))
        for f, w in FIELDS])
    rows = _with_terms(posts).select(*DOC, F.explode(fields).alias("f"))
    return rows.select(*DOC, "f.field", "f.weight_class", F.posexplode("f.terms").alias("pos", "term"))


def doc_stats(posts: DataFrame) -> DataFrame:
    """Length of each document in terms, over all fields. Needs no shuffle."""
    return _text_lengths(_term_texts(posts))


def _text_lengths(texts: DataFrame) -> DataFrame:
    types = dict(texts.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = [_term_counts(batch.column(f)) for f, _ in FIELDS]
            total = pc.add(pc.add(lengths[0], lengths[1]), lengths[2])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in DOC], total], names=[*DOC, "doc_len"])
    return texts.mapInArrow(rows, ", ".join([*[f"{c} {types[c]}" for c in DOC], "doc_len int"]))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The offsets and the bytes of an array of strings."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def _term_counts(texts: pa.Array) -> pa.Array:
    """How many runs of term bytes each text has; NULL for NULL."""
    if not len(texts):
        return pa.array([], pa.int32())
    missing = texts.is_null().to_numpy(zero_copy_only=False)
    offsets, data = _bytes_of(texts)
    inside = _IN_TERM[data[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    begins[first] = inside[first]
    before = np.append(0, np.cumsum(begins))
    return pa.array((before[offsets[1:]] - before[offsets[:-1]]).astype(np.int32), mask=missing)


def corpus_stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def bucket_sql(term: str) -> str:
    """The folder of a term: terms with the same two first letters lie together."""
    return f"cast(pmod(xxhash64(substring({term}, 1, 2)), {BUCKETS}) as int)"


def term_bucket() -> Column:
    return F.expr(bucket_sql("term"))


def document_terms(posts: DataFrame) -> DataFrame:
    """One row per term and document.

    The terms of some documents at a time are sorted by term, document and place; each run of one term in a document becomes
    a row. Nothing is shuffled.
    """
    return _text_terms(_term_texts(posts))


def _text_terms(texts: DataFrame) -> DataFrame:
    counts = ", ".join(f"tf_{f} int" for f, _ in FIELDS)
    return _located(texts, f"doc_len int, {counts}, positions array<int>", None).withColumn("bucket", term_bucket())


def document_pairs(posts: DataFrame, hot: DataFrame) -> DataFrame:
    """One row per pair of neighbouring hot terms and document, with the places of the first one.

    The hot terms are fetched and broadcast; by ``HOT_SHARE`` their number is bounded whatever the corpus.
    """
    return _text_pairs(_term_texts(posts), hot)


def _text_pairs(texts: DataFrame, hot: DataFrame) -> DataFrame:
    known = texts.sparkSession.sparkContext.broadcast([r.term for r in hot.select("term").collect()])
    return _located(texts, "doc_len int, positions array<int>", known).withColumn("bucket", term_bucket())


def _located(texts: DataFrame, columns: str, hot) -> DataFrame:
    """Rows of terms, or with ``hot`` of pairs of these terms, of the documents whose fields are all known."""
    fields = [f for f, _ in FIELDS]
    types, fold = dict(texts.dtypes), latin_table()
    schema = f"term string, {', '.join(f'{c} {types[c]}' for c in DOC)}, {columns}"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if hot is None else pa.array(hot.value, pa.string())
        for batch in batches:
            for f in fields:
                if batch.column(f).null_count:
                    batch = batch.filter(pc.is_valid(batch.column(f)))
            for block in _blocks(batch, fields):
                yield _runs(block, fields, fold, wanted)
    return texts.mapInArrow(rows, schema)


def _blocks(batch: pa.RecordBatch, fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Slices of ``BLOCK_BYTES`` of text at most, or of a single longer document."""
    ends = np.cumsum(sum(pc.binary_length(batch.column(f)).to_numpy(zero_copy_only=False).astype(np.int64) for f in fields))
    start = done = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, done + BLOCK_BYTES, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(ends[end - 1])


def _tokens(texts: pa.Array, fold: dict[int, int]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different terms of some texts, sorted; per term of the texts, in order, which one it is and of which text."""
    offsets, data = _bytes_of(texts)
    spaced = pa.StringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_SPACED[data]))
    split = pc.split_pattern(spaced, " ")
    tokens = split.flatten()
    text = np.repeat(np.arange(len(split)), np.diff(split.offsets.to_numpy()))
    real = pc.not_equal(tokens, "")
    tokens, text = tokens.filter(real), text[real.to_numpy(zero_copy_only=False)]
    coded = tokens.dictionary_encode()
    marked = pc.not_equal(pc.binary_length(coded.dictionary), pc.utf8_length(coded.dictionary))
    plain = [t.translate(fold) for t in coded.dictionary.filter(marked).to_pylist()]
    words = pc.replace_with_mask(coded.dictionary, marked, pa.array(plain, pa.string())).dictionary_encode()  # é is e now
    order = pc.array_sort_indices(words.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return words.dictionary.take(order), rank[words.indices.to_numpy()][coded.indices.to_numpy()], text


def _runs(block: pa.RecordBatch, fields: list[str], fold: dict[int, int], hot: pa.Array | None) -> pa.RecordBatch:
    """The terms of a block of documents to a row per term and document with its positions, in order."""
    n = block.num_rows
    terms, code, text = _tokens(pa.concat_arrays([block.column(f) for f in fields]), fold)
    before = np.append(0, np.cumsum(np.bincount(text, minlength=len(fields) * n)))
    place = np.arange(len(text)) - before[text] + ((text // max(1, n)) << FIELD_SHIFT)
    row = text % max(1, n)
    doc_len = np.bincount(row, minlength=n)
    if hot is not None:
        is_hot = pc.is_in(terms, hot).to_numpy(zero_copy_only=False)[code]
        first = np.flatnonzero(is_hot[:-1] & is_hot[1:] & (text[:-1] == text[1:]))
        pairs, code = np.unique(code[first] * max(1, len(terms)) + code[first + 1], return_inverse=True)
        sides = np.divmod(pairs, max(1, len(terms)))
        terms = pc.binary_join_element_wise(*[terms.take(pa.array(s)) for s in sides], " ")
        row, place = row[first], place[first]
    group = code * n + row
    by_group = np.argsort(group, kind="stable")
    group, place = group[by_group], place[by_group]
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    term, row = np.divmod(group[heads], max(1, n))
    columns = {"term": terms.take(pa.array(term)), **{c: block.column(c).take(pa.array(row)) for c in DOC},
               "doc_len": pa.array(doc_len[row].astype(np.int32))}
    if hot is None:
        for k, f in enumerate(fields):
            found = np.cumsum(np.append(0, place >> FIELD_SHIFT == k))
            columns[f"tf_{f}"] = pa.array((found[np.append(heads[1:], len(place))] - found[heads]).astype(np.int32)
                                          if len(heads) else np.zeros(0, np.int32))
    ends = np.append(heads, len(place)).astype(np.int32)
    columns["positions"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int32)))
    return pa.RecordBatch.from_pydict(columns)


def hot_terms(vocab: DataFrame, n_docs: Column) -> DataFrame:
    return vocab.filter(F.col("docs") * HOT_SHARE >= n_docs).select("term")


def _clustered(terms: DataFrame) -> DataFrame:
    """Sorted by folder, term and document. Rebalancing splits a folder too large for one task."""
    return terms.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", *DOC)


def vocabulary(terms: DataFrame) -> DataFrame:
    """Documents and occurrences per term."""
    times = sum(F.col(f"tf_{f}") for f, _ in FIELDS)
    return terms.groupBy("term").agg(F.count("*").alias("docs"), F.sum(times).alias("total"))


def build_index(posts: DataFrame) -> Index:
    """The index of ``posts`` as plans, for a corpus small enough to index on every search."""
    terms, docs = document_terms(posts), doc_stats(posts)
    return Index(terms, vocabulary(terms), docs, corpus_stats(docs))


def write_index(posts: DataFrame, path: str) -> Index:
    """Write the index of ``posts`` as a new version of one generation and return it as read back.

    The version takes the place of the one before when it is complete. The one before stays for its readers, older
    ones are deleted.
    """
    spark = posts.sparkSession
    files, make = shared_files(spark, path)
    old = _versions(spark, path)
    version = f"{path}/v={max([time.time_ns(), *[v + 1 for v in old]])}"
    nothing = document_terms(posts.limit(0))
    _write_generation(posts, posts.select(*DOC).limit(0), nothing, doc_stats(posts.limit(0)), version, 0)
    files.create(make(f"{version}/_READY")).close()
    for v in old[1:]:
        files.delete(make(f"{path}/v={v}"), True)
    return read_index(spark, path)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, newest first."""
    files, make = shared_files(spark, path)
    if not files.exists(make(path)):
        return []
    found = [str(f.getPath().getName()) for f in files.listStatus(make(path)) if f.isDirectory()]
    return sorted((int(n[2:]) for n in found if n.startswith("v=") and files.exists(make(f"{path}/{n}/_READY"))), reverse=True)


def _current(spark: SparkSession, path: str) -> str:
    return f"{path}/v={_versions(spark, path)[0]}"


def append_index(changed: DataFrame, deleted: DataFrame, path: str, batch: str | int,
                 replaced: DataFrame | None = None) -> Index:
    """Add changed documents as a new generation; what is written stays.

    Older rows of a changed or deleted document are left out when reading. ``batch`` names the batch: generations are
    numbered in order of their first writing, and a batch that is complete is not written again. ``replaced`` are the
    posts of the touched keys before the batch; without them their terms are looked up in the index.
    """
    spark = changed.sparkSession
    version = _current(spark, path)
    generation, done = _generation(spark, version, str(batch))
    if not done:
        touched = changed.select(*DOC).unionByName(deleted.select(*DOC)).distinct()
        if replaced is None:
            terms = _live(spark, version, "terms", generation).join(touched, DOC, "left_semi")
            docs = _live(spark, version, "docs", generation).join(touched, DOC, "left_semi")
        else:
            terms, docs = document_terms(replaced), doc_stats(replaced)
        _write_generation(changed, touched, terms, docs, version, generation)
        files, make = shared_files(spark, path)
        files.create(make(f"{version}/_batches/{generation}-{_name(batch)}.done")).close()
    return read_index(spark, path)


def _name(batch: str | int) -> str:
    return hashlib.md5(str(batch).encode()).hexdigest()


def _generation(spark: SparkSession, version: str, batch: str) -> tuple[int, bool]:
    """The number of a batch's generation, the next free one if it has none yet, and whether it is complete."""
    files, make = shared_files(spark, version)
    folder = f"{version}/_batches"
    files.mkdirs(make(folder))
    names = [str(f.getPath().getName()) for f in files.listStatus(make(folder))]
    mine = [n for n in names if f"-{_name(batch)}" in n]
    if mine:
        return int(mine[0].split("-")[0]), any(n.endswith(".done") for n in mine)
    generation = 1 + max([0, *[int(n.split("-")[0]) for n in names]])
    files.create(make(f"{folder}/{generation}-{_name(batch)}")).close()
    return generation, False


def _write_generation(posts: DataFrame, touched: DataFrame, old_terms: DataFrame, old_docs: DataFrame, version: str,
                      generation: int) -> None:
    texts = _term_texts(posts)  # read for the lengths, and for each part of the terms and the pairs
    with nullcontext(texts) if "content_idx" in posts.columns else held(texts, "term-texts") as texts:
        _write_tables(texts, touched, old_terms, old_docs, version, generation)


def _write_tables(texts: DataFrame, touched: DataFrame, old_terms: DataFrame, old_docs: DataFrame, version: str,
                  generation: int) -> None:
    spark = texts.sparkSession

    def write(df, name, *folders, mode="overwrite"):
        write_table(df, f"{version}/{name}/gen={generation}", *folders, mode=mode)

    def own(name):
        return _read(spark, version, name).filter(F.col("gen") == generation)

    def less(df, *columns):
        return df.select(*[(-F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])

    def write_parts(rows, name):
        """``rows`` of the texts of a part of the documents at a time."""
        part = F.pmod(F.xxhash64(*DOC), F.lit(parts))
        for k in range(parts):
            write(_clustered(rows(texts.filter(part == k))), name, "bucket", mode="append" if k else "overwrite")
    write(_text_lengths(texts), "docs")
    n_terms = own("docs").agg(F.coalesce(F.sum("doc_len"), F.lit(0))).first()[0]
    parts = min(PARTS, 1 + n_terms // PART_TERMS)
    write_parts(_text_terms, "terms")
    write(touched.distinct(), "touched")
    added = vocabulary(own("terms")).unionByName(less(vocabulary(old_terms), "docs", "total"))
    added = added.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("total").alias("total")).filter("docs != 0 or total != 0")
    write(added.repartitionByRange("term").sortWithinPartitions("term"), "vocab")
    sizes = own("docs").select(F.lit(1).alias("n"), "doc_len").unionByName(old_docs.select(F.lit(-1).alias("n"), (-F.col("doc_len")).alias("doc_len")))
    write(sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_docs"),
                    F.coalesce(F.sum("doc_len"), F.lit(0)).cast("bigint").alias("sum_len")), "corpus")
    if generation == 0:
        write_table(hot_terms(own("vocab"), own("corpus").select("n_docs").scalar()).coalesce(1), f"{version}/hot")
    hot = _read(spark, version, "hot")
    write_parts(lambda some: _text_pairs(some, hot), "pairs")


def _read(spark: SparkSession, version: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{version}/{name}")


def _live(spark: SparkSession, version: str, name: str, before: int | None = None) -> DataFrame:
    """Rows of the newest generation of each document, or of the newest one before some generation."""
    rows, touched = _read(spark, version, name), _read(spark, version, "touched")
    if before is not None:
        rows, touched = rows.filter(F.col("gen") < before), touched.filter(F.col("gen") < before)
    if touched.isEmpty():
        return rows.drop("gen")
    newest = touched.groupBy(*DOC).agg(F.max("gen").alias("newest"))
    return (rows.join(newest, DOC, "left")
            .filter(F.col("newest").isNull() | (F.col("gen") >= F.col("newest"))).drop("gen", "newest"))


def read_index(spark: SparkSession, path: str) -> Index:
    version = _current(spark, path)
    vocab = _read(spark, version, "vocab").groupBy("term").agg(
        F.sum("docs").alias("docs"), F.sum("total").alias("total")).filter("docs > 0")
    corpus = _read(spark, version, "corpus").agg(F.sum("n_docs").alias("n_docs"), F.sum("sum_len").alias("sum_len"))
    return Index(_live(spark, version, "terms"), vocab, _live(spark, version, "docs"),
                 corpus.select("n_docs", (F.col("sum_len") / F.col("n_docs")).alias("avg_len")),
                 _read(spark, version, "hot"), _live(spark, version, "pairs"))


def refresh_terms(terms: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    """The terms table after some documents changed or vanished; only changed ones are read again.

    ``changed`` are full post rows, ``deleted`` document keys. Equal to a rebuild over the new store.
    """
    return _untouched(terms, changed, deleted).unionByName(document_terms(changed))


def _untouched(rows: DataFrame, changed: DataFrame, deleted: DataFrame) -> DataFrame:
    touched = changed.select(*DOC).unionByName(deleted.select(*DOC)).distinct()
    return rows.join(touched, DOC, "left_anti")


def refresh_index(index: Index, changed: DataFrame, deleted: DataFrame) -> Index:
    terms = refresh_terms(index.terms, changed, deleted)
    docs = _untouched(index.docs, changed, deleted).unionByName(doc_stats(changed))
    pairs = None
    if index.pairs is not None:
        pairs = _untouched(index.pairs, changed, deleted).unionByName(document_pairs(changed, index.hot))
    return Index(terms, vocabulary(terms), docs, corpus_stats(docs), index.hot, pairs)
