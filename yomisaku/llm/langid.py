"""Language identification of mixed texts: script candidates, word scores, and Viterbi with a switching penalty.

Learning counts letter trigrams inside words and the scripts of letters per language, in one pass with one partial count per
task. The counts of a language are an array of fixed size, so the model that is broadcast grows with the
number of languages alone, 256 KB each; all of them are learned. Its script leaves a word the languages that write in it
as candidates, whose scores are the sums of its trigrams' log probabilities. Viterbi then labels the words of a text with
candidates, paying a penalty for each change of language, and neighbouring words of one label form a span.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from yomisaku.llm.common import text_blocks, text_bytes, written

BUCKETS = 1 << 16
SWITCH = 15.0
UNKNOWN = "und"
#: Least share of a language's letters for a script to be one of its own.
SCRIPT_SHARE = 0.001
#: Share of a language's probability that is spread over all trigrams, so that an unseen one costs every language the same.
_UNSEEN = 0.01
_BLOCK = 2 << 20
#: Up to so many languages texts are labelled in blocks of full size, beyond in smaller ones of as many scores.
_FULL = 256

# Unicode ranges of scripts; other letters are Latin below U+0370, else of no script named here.
SCRIPTS = [("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
           ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
           ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
           ("malayalam", 0xD00, 0xD7F), ("sinhala", 0xD80, 0xDFF), ("thai", 0xE00, 0xE7F), ("lao", 0xE80, 0xEFF),
           ("tibetan", 0xF00, 0xFFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
           ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
           ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
           ("han", 0xF900, 0xFAFF), ("han", 0x20000, 0x3FFFF)]
SCRIPT_NAMES = ["latin", "other", *dict.fromkeys(n for n, _, _ in SCRIPTS if n != "latin")]

_tables: list[np.ndarray] = []


def _char_tables() -> list[np.ndarray]:
    """Per code point: whether it is a letter, its lower case, its script."""
    if not _tables:
        letter = np.array([chr(c).isalpha() for c in range(0x110000)], bool)
        lower = np.arange(0x110000, dtype=np.uint32)
        for c in np.flatnonzero(letter).tolist():
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        script = np.full(0x110000, 1, np.uint8)
        script[:0x370] = 0
        for name, lo, hi in SCRIPTS:
            script[lo:hi + 1] = SCRIPT_NAMES.index(name)
        _tables.extend([letter, lower, script])
    return _tables


class Letters:
    """The letters of a block of texts, grouped into words of one script.

    at, bucket, script: per letter its place among all characters, trigram bucket and script; starts: index of each
    word's first letter; first: index of each text's first word; texts: place of each text's first character.
    """

    def __init__(self, column: pa.Array):
        letter, lower, scripts = _char_tables()
        raw, offsets = text_bytes(column)
        chars = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        leads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        self.texts = leads[offsets]
        is_letter, script = letter[chars], scripts[chars]
        n = len(chars)
        new = np.ones(n + 1, bool)
        new[1:n] = ~is_letter[:-1] | ~is_letter[1:] | (script[1:] != script[:-1])
        new[self.texts] = True
        small = lower[chars]
        before = np.zeros(n, np.uint32)
        after = np.zeros(n, np.uint32)
        before[1:] = np.where(new[1:n], 0, small[:-1])
        after[:-1] = np.where(new[1:n], 0, small[1:])
        self.at = np.flatnonzero(is_letter)
        mixed = (before[self.at] * np.uint32(0x9E3779B1) + small[self.at] * np.uint32(0x85EBCA77)
                 + after[self.at] * np.uint32(0xC2B2AE3D))
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        self.bucket = (mixed >> np.uint32(16)).astype(np.int64)
        self.script = script[self.at]
        self.starts = np.flatnonzero(new[self.at])
        self.first = np.searchsorted(self.at[self.starts], self.texts)


@dataclass
class Model:
    """Languages in order, log probabilities by bucket and language, and by script which languages are candidates.

    Every script has a candidate unless there is no language at all.
    """

    langs: list[str]
    logp: np.ndarray
    candidates: np.ndarray

    def __post_init__(self):
        self._columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _of_script(self, script: int) -> tuple[np.ndarray, np.ndarray]:
        """The candidates of a script and their log probabilities."""
        if script not in self._columns:
            some = np.flatnonzero(self.candidates[script])
            self._columns[script] = some, self.logp if len(some) == len(self.langs) else self.logp[:, some]
        return self._columns[script]

    def scores(self, letters: Letters) -> np.ndarray:
        """Score of each word for the candidates of its script; minus infinity for other languages."""
        out = np.full((len(letters.starts), len(self.langs)), -np.inf, np.float32)
        script_of = letters.script[letters.starts]
        sizes = np.diff(np.append(letters.starts, len(letters.bucket)))
        for script in np.unique(script_of).tolist():
            some, logp = self._of_script(script)
            words, buckets = np.flatnonzero(script_of == script), letters.bucket[letters.script == script]
            starts = np.cumsum(sizes[words]) - sizes[words]
            step = max(1, (4 << 20) // max(1, len(some)))
            a = 0
            while a < len(words):  # in parts, so that many languages take little memory
                b = max(a + 1, int(np.searchsorted(starts, starts[a] + step)))
                hi = int(starts[b]) if b < len(words) else len(buckets)
                out[np.ix_(words[a:b], some)] = np.add.reduceat(
                    logp[buckets[starts[a]:hi]], starts[a:b] - starts[a], axis=0)
                a = b
        return out


def learn(labelled: DataFrame) -> Model:
    """A model from text and lang of every row; rows with a NULL in either teach nothing. Every language is learned."""
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bucket", T.IntegerType()),
                           T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for lang, got in counts.items():
                some = np.flatnonzero(got)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()),
                                                  pa.array(got[some], pa.int64())], names=schema.names)
            counts.clear()
        for part in text_blocks(batches, limit=_BLOCK):
            letters = Letters(part.column(0))
            langs = part.column(1).to_pylist()
            ids = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            per_text = np.array([ids[x] for x in langs])
            text_of = np.searchsorted(letters.texts, letters.at, side="right") - 1
            whose = per_text[text_of]
            for lang, i in ids.items():
                mine = whose == i
                got = np.concatenate([np.bincount(letters.bucket[mine], minlength=BUCKETS),
                                      np.bincount(letters.script[mine], minlength=len(SCRIPT_NAMES))])
                counts[lang] = counts[lang] + got if lang in counts else got
            if len(counts) > _FULL:  # so that a task holds few languages' counts at once
                yield from counted()
        yield from counted()

    known = labelled.filter("text is not null and lang is not null").select("text", "lang")
    sums = known.mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # A row per language; they come to the driver one by one, and of each only its probabilities are kept.
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts")).select(
        "lang", F.col("counts.bucket").alias("bucket"), F.col("counts.n").alias("n"))
    rows = written(rows, "languages")
    langs = sorted(r.lang for r in rows.select("lang").collect())
    place = {lang: i for i, lang in enumerate(langs)}
    logp = np.zeros((BUCKETS, len(langs)), np.float32)
    by_script = np.zeros((len(langs), len(SCRIPT_NAMES)))
    for r in rows.toLocalIterator():
        counts = np.zeros(BUCKETS + len(SCRIPT_NAMES))
        counts[r.bucket] = r.n
        grams = counts[:BUCKETS]
        logp[:, place[r.lang]] = np.log((1 - _UNSEEN) * grams / max(grams.sum(), 1) + _UNSEEN / BUCKETS)
        by_script[place[r.lang]] = counts[BUCKETS:]
    share = by_script / np.maximum(by_script.sum(1, keepdims=True), 1)
    writes = (share >= SCRIPT_SHARE) & (by_script > 0)
    none = ~writes.any(0)
    if langs and none.any():  # whoever has such letters at all, else everyone
        writes[:, none] = (by_script[:, none] > 0) | ~(by_script[:, none] > 0).any(0)
    return Model(langs, logp, writes.T)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word where a change of label inside a text costs ``switch``.

    Steps through all texts at once, longest first. Ties go to the smaller label and to no change. A label whose score is
    minus infinity is not given to that word; each word needs one that is finite.
    """
    labels = np.zeros(len(scores), np.int32)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = first[:-1][order], sizes[order]
    if not len(sizes) or not sizes[0]:
        return labels
    running = np.zeros((len(sizes), scores.shape[1]), np.float32)
    came = np.zeros(len(scores), np.int32)
    stayed = np.ones(scores.shape, bool)
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")  # texts with more than t words
    running[:active[0]] = scores[starts[:active[0]]]
    for t in range(1, sizes[0]):
        rows, now = starts[:active[t]] + t, running[:active[t]]
        best = now.argmax(1)
        other = np.take_along_axis(now, best[:, None], 1) - np.float32(switch)
        stay = now >= other
        came[rows], stayed[rows] = best, stay
        np.maximum(now, other, out=now)
        now += scores[rows]
    label = running.argmax(1)
    for t in range(sizes[0] - 1, -1, -1):
        rows, now = starts[:active[t]] + t, label[:active[t]]
        labels[rows] = now
        label[:active[t]] = np.where(stayed[rows, now], now, came[rows])
    return labels


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (lang, first and end character) of every row of ``docs``.

    lang_pred has most letters in spans of its language, score is their share (ties: the language first in order).
    A text without letters (NULL, empty, digits) is ``und`` with score 0 and no spans, and so is every text if the
    model knows no language. Repeated rows are labelled alike; other columns are not looked at.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(T.StructType([
                               T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()),
                               T.StructField("end", T.LongType())])))])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in text_blocks(batches, limit=_BLOCK * _FULL // max(_FULL, len(known.langs))):
            letters = Letters(part.column(1))
            preds, shares, spans = _labelled(letters, known, switch, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(preds, pa.string()), pa.array(shares, pa.float64()),
                                              pa.array(spans, span_type)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _labelled(letters: Letters, model: Model, switch: float, texts: int):
    preds, shares, spans = [UNKNOWN] * texts, [0.0] * texts, [[] for _ in range(texts)]
    if not model.langs or not len(letters.starts):
        return preds, shares, spans
    labels = viterbi(model.scores(letters), letters.first, switch)
    ends = np.concatenate([letters.starts[1:], [len(letters.at)]])
    sizes = ends - letters.starts
    text_of = np.searchsorted(letters.first, np.arange(len(labels)), side="right") - 1
    mass = np.zeros((texts, len(model.langs)))
    np.add.at(mass, (text_of, labels), sizes)
    total, best = mass.sum(1), mass.argmax(1)
    for d in np.flatnonzero(total).tolist():
        preds[d] = model.langs[best[d]]
        shares[d] = float(mass[d, best[d]] / total[d])
    change = np.flatnonzero((np.diff(labels) != 0) | (np.diff(text_of) != 0)) + 1
    for a, b in zip(np.concatenate([[0], change]).tolist(), np.concatenate([change, [len(labels)]]).tolist()):
        d = int(text_of[a])
        spans[d].append({"lang": model.langs[labels[a]], "start": int(letters.at[letters.starts[a]] - letters.texts[d]),
                         "end": int(letters.at[ends[b - 1] - 1] + 1 - letters.texts[d])})
    return preds, shares, spans


def held_out() -> F.Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 2 by 4. Without id it is not, nor is it learned."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
