"""Byte-pair encoding and decoding with a vocabulary file of the tokenizers library, by a pair occurrence index.

A task collects the words of a block of texts that it has not met yet, lays their symbols out in one array, and maps
each pair of neighbours that has a merge rank to all its positions. The active ranks are applied in ascending order from a heap;
each merge updates the lists of the pairs it makes; long lists are worked off as arrays, short ones place by place.
Words are merged independently, so this gives each word what merging its lowest pair again and again would. Finished
words are remembered within a bound of bytes per worker process, those asked for lately longest.
"""

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Collection, Iterator, Set

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from yomisaku.llm.common import text_blocks

#: Bytes of finished pieces of text, and as many of words, that a worker process remembers. Workers stay for later stages.
REMEMBERED = 24 << 20
#: What an entry takes besides its texts; entries longer than ``LONG`` are forgotten after their block.
ENTRY, LONG = 160, 256
#: Lists of at least so many places are worked off as arrays.
MANY = 24
#: Bytes of text whose new words are merged together.
BLOCK = 2 << 20

# What the vocabulary's normaliser takes for white space.
BLANK = r"\t-\r \x85\xa0  -     　"
#: Characters at which str.split() splits although they are no white space here.
_SPLIT_TOO = regex.compile(r"[\x1c-\x1f]")
_BLANKS = regex.compile(f"[{BLANK}]+")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it is visible Latin-1, else the next from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(256 + hidden.index(b)) for b in range(256)]


class Vocabulary:
    """A BPE vocabulary file: ids of bytes, ranks of pairs, and tokens.

    Understands byte-level vocabularies with an end-of-word mark, NFC and lower-casing, a split pattern whose matches
    are the words, and no decoder; anything else is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        normal = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        known = (model["type"] == "BPE" and not model["dropout"] and not model["unk_token"] and not model["byte_fallback"]
                 and not model["ignore_merges"] and not model["continuing_subword_prefix"]
                 and normal == ["NFC", "Replace", "Lowercase"] and spec["decoder"] is None
                 and split["behavior"] == "Removed" and split["invert"] and level["type"] == "ByteLevel"
                 and not level["add_prefix_space"] and not level["use_regex"]
                 and not any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]))
        if not known:
            raise ValueError(f"{path} is no vocabulary of the kind that this encoder knows")
        ids, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"[^\s", f"[^{BLANK}"))
        letters = _byte_letters()
        self.inner = np.array([ids.get(c, -1) for c in letters], np.int64)
        self.final = np.array([ids.get(c + suffix, -1) for c in letters], np.int64)
        self.rank, self.made = {}, []
        for a, b in model["merges"]:
            self.rank.setdefault(ids[a] << 32 | ids[b], len(self.made))
            self.made.append(ids[a + b])
        self.pairs = [ids[a] << 32 | ids[b] for a, b in model["merges"]]
        self.sorted_pairs = np.array(sorted(self.rank), np.int64)
        self.sorted_ranks = np.array([self.rank[x] for x in self.sorted_pairs.tolist()], np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.tokens = pa.array([token.get(i) for i in range(max(token) + 1)], pa.string())
        self.specials = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pieces, self.words_done = Memo(REMEMBERED), Memo(REMEMBERED)

    # ---- encoding

    def _ranks(self, keys: np.ndarray) -> np.ndarray:
        """The merge rank of each pair, or -1."""
        at = np.searchsorted(self.sorted_pairs, keys)
        at[at == len(self.sorted_pairs)] = 0
        return np.where(self.sorted_pairs[at] == keys, self.sorted_ranks[at], -1)

    def _note(self, where: dict[int, list], heap: list[int], keys: np.ndarray, places: np.ndarray) -> None:
        """Enter pairs into the index: each active rank has a list of arrays of places."""
        ranks = self._ranks(keys)
        known = ranks >= 0
        ranks, places = ranks[known], places[known]
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1))
        for r, a, b in zip(ranks[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(ranks)]):
            if r in where:
                where[r].append(places[a:b])
            else:
                where[r] = [places[a:b]]
                heapq.heappush(heap, r)

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of each word as little-endian 32-bit numbers, by one pair index over all of them."""
        coded = [w.encode("utf-8") for w in words]
        raw = np.frombuffer(b"".join(coded), np.uint8)
        sizes = np.array([len(c) for c in coded], np.int64)
        ends = np.cumsum(sizes)
        symbols = self.inner[raw]
        symbols[ends[sizes > 0] - 1] = self.final[raw[ends[sizes > 0] - 1]]
        if (symbols < 0).any():  # a byte that the vocabulary lacks has no token
            ends = np.concatenate([[0], np.cumsum(symbols >= 0)])[ends]
            symbols = symbols[symbols >= 0]
        starts = np.concatenate([[0], ends])
        after, before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        some = starts[:-1] < ends
        after[ends[some] - 1], before[starts[:-1][some]] = -1, -1
        where: dict[int, list] = {}
        heap: list[int] = []
        places = np.flatnonzero(after >= 0)
        self._note(where, heap, symbols[places] << 32 | symbols[places + 1], places)
        state = memoryview(symbols), memoryview(after), memoryview(before)
        while heap:
            r = heapq.heappop(heap)
            chunks = where.pop(r)
            count = sum(map(len, chunks))
            left, right = self.pairs[r] >> 32, self.pairs[r] & 0xFFFFFFFF
            if count < MANY or left == right:
                self._apply_each(where, heap, left, right, self.made[r], sorted(x for c in chunks for x in (c if type(c) is list else c.tolist())), *state)
                continue
            p = np.unique(np.concatenate(chunks))
            q = after[p]
            ok = (symbols[p] == left) & (q >= 0)
            ok &= symbols[q] == right
            p, q = p[ok], q[ok]  # earlier merges took the others
            symbols[p], symbols[q] = self.made[r], -1
            follow = after[p] = after[q]
            more = follow >= 0
            before[follow[more]] = p[more]
            lead = before[p]
            less = lead >= 0
            x, y = np.concatenate([p[more], lead[less]]), np.concatenate([follow[more], p[less]])
            self._note(where, heap, symbols[x] << 32 | symbols[y], x)
        alive = symbols >= 0
        cuts = np.concatenate([[0], np.cumsum(alive)])[starts]
        ids = symbols[alive].astype("<u4").tobytes()
        return [ids[4 * a:4 * b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def _apply_each(self, where, heap, left, right, new, places, symbols, after, before) -> None:
        """Merge one pair at its places from left to right, and enter the pairs this makes."""
        rank = self.rank
        for p in places:
            q = after[p]
            if symbols[p] != left or q < 0 or symbols[q] != right:
                continue  # an earlier merge took one of the two
            symbols[p], symbols[q] = new, -1
            follow, lead = after[q], before[p]
            after[p] = follow
            found = []
            if follow >= 0:
                before[follow] = p
                found.append((rank.get(new << 32 | symbols[follow]), p))
            if lead >= 0:
                found.append((rank.get(symbols[lead] << 32 | new), lead))
            for r, place in found:
                if r is not None:
                    if r in where:
                        if type(where[r][-1]) is list:
                            where[r][-1].append(place)
                        else:
                            where[r].append([place])
                    else:
                        where[r] = [[place]]
                        heapq.heappush(heap, r)

    def encode_block(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; NULL is empty."""
        every: dict[str, str] = {}
        rows = []
        for t in texts:  # equal pieces of a block are one string
            parts = self._parts(t or "")
            rows.append(list(map(every.setdefault, parts, parts)))
        fresh = self.pieces.lacking(every.keys())
        if fresh:
            split = {p: self.words.findall(_normal(p)) for p in fresh if p not in self.special}
            unknown = self.words_done.lacking({w for ws in split.values() for w in ws})
            for some in _in_parts(unknown):
                self.words_done.add(some, self.merge(some))
            done = self.words_done.known
            self.pieces.add(split.keys(), [done[ws[0]] if len(ws) == 1 else b"".join([done[w] for w in ws]) for ws in split.values()])
            self.words_done.forget()
            marks = every.keys() & self.special.keys()
            self.pieces.add(marks, [self.special[s].to_bytes(4, "little") for s in marks])
        pieces = self.pieces.known
        out = [b"".join(map(pieces.__getitem__, row)) for row in rows]
        self.pieces.forget()
        return out

    def _parts(self, text: str) -> list[str]:
        """Pieces between white space, and the special tokens written out in the text."""
        if self.specials and "<" in text:
            found = self.specials.split(text)
            if len(found) > 1:
                return [x for i, s in enumerate(found) for x in ([s] if i % 2 else _split(s))]
        return _split(text)

    # ---- decoding

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The tokens of each row's ids, special ones too, joined by blanks, as the library does without a decoder."""
        if ids.null_count:
            ids = pc.fill_null(ids, pa.scalar([], ids.type))
        at = ids.offsets.to_numpy()
        flat, at = ids.values.to_numpy()[at[0]:at[-1]], at - at[0]
        known = (flat >= 0) & (flat < len(self.tokens))
        known[known] = ~np.asarray(self.tokens.is_null())[flat[known]]
        if not known.all():  # ids that the vocabulary lacks have no token
            at, flat = np.concatenate([[0], np.cumsum(known)])[at], flat[known]
        tokens = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), self.tokens.take(pa.array(flat)))
        return pc.binary_join(tokens, " ")


class Memo:
    """Texts and their ids within about ``limit`` bytes, in two generations: what a generation's time did not ask for is forgotten."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.known: dict[str, bytes] = {}
        self.earlier: dict[str, bytes] = {}
        self.long: list[str] = []

    def lacking(self, texts: Set[str]) -> list[str]:
        """Which texts are not known; the others are in ``known`` from now on. At half the limit a new generation begins."""
        if self.held >= self.limit // 2:
            self.earlier, self.known, self.held = self.known, {}, 0
        lacking = list(texts - self.known.keys())
        again = [t for t in lacking if t in self.earlier]
        if again:
            self.add(again, [self.earlier.pop(t) for t in again])
            lacking = [t for t in lacking if t not in self.known]
        return lacking

    def add(self, texts: Collection[str], ids: list[bytes]) -> None:
        self.known.update(zip(texts, ids))
        self.held += sum(map(len, ids)) + 4 * sum(map(len, texts)) + ENTRY * len(texts)
        self.long += [t for t in texts if len(t) > LONG]

    def forget(self) -> None:
        """Long texts go after their block."""
        for t in self.long:
            self.held -= len(self.known.pop(t, b"")) + 4 * len(t) + ENTRY
        self.long.clear()


def _in_parts(words: list[str], most: int = 1 << 19) -> Iterator[list[str]]:
    """The words in lists of about ``most`` letters, so that one index takes a bounded memory."""
    start, held = 0, 0
    for i, word in enumerate(words):
        held += len(word)
        if held >= most or i + 1 == len(words):
            yield words[start:i + 1]
            start, held = i + 1, 0


def _split(text: str) -> list[str]:
    return [p for p in _BLANKS.split(text) if p] if _SPLIT_TOO.search(text) else text.split()


def _normal(piece: str) -> str:
    if piece.isascii():
        return piece.lower()
    # Each letter is lower-cased by itself, so a capital sigma never becomes a final one.
    return unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per process."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4").astype(np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (list of int) of every row; a NULL or empty text has an empty list, other columns are dropped.

    ``path`` names the vocabulary file on every executor. Special tokens written out in a text become their ids, as
    the library does; no special tokens are added.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for part in text_blocks(batches, limit=BLOCK):
            ids = book.encode_block(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(ids)], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([
        T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of every row of ``encode``'s form; NULL or empty ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([*part.columns, book.decode(part.column(1))], names=["doc_id", "ids", "text"])

    source = encoded.select("doc_id", "ids")
    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("text", T.StringType())]))


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """What ``decode`` makes of ``encode``, by one worker for each task instead of two."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for part in text_blocks(batches, limit=BLOCK):
            ids = _lists(book.encode_block(part.column(1).to_pylist()))
            for at in range(0, part.num_rows, 64):
                some = ids.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(at, 64), some, book.decode(some)], names=["doc_id", "ids", "text"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([
        T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("text", T.StringType())]))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text: encodes and decodes every text in one pass.

    A NULL or empty text has no ids and decodes to the empty text; rows may repeat or lack a doc_id; other columns are
    dropped.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = vocabulary(path)
        for part in text_blocks(batches, limit=BLOCK):
            ids = book.encode_block(part.column(1).to_pylist())
            texts = book.decode(_lists(ids))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                 pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in texts], pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))
