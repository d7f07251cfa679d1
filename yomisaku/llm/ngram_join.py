"""Exact Jaccard join of word shingles with a token-group matrix.

A text's set is that of its distinct ``k``-word shingles, as 64-bit hashes. Equal sets form a class, and the join runs
over classes. It never holds a group of similar texts in one task and never makes all pairs of such a group:

1. One pass over the texts gives each row its set's size, digest, three minhashes and the tokens with the smallest hashes.
2. Tokens are put in one global order: those found in more than ``HOT`` rows last, by a bitmap of fixed size (which
   tokens share a bit matters for speed only: any one order is right), else by hash. Two sets that are similar enough share
   a token among the first of both (prefix filter).
3. Classes are partitioned into groups of similar texts: those that share a minhash are compared with the one class
   among them whose tokens are commonest, the pivot, and belong to it if they share half of their tokens. A class is then known by
   its difference to what its group has in common.
4. Between groups all candidates come from the token-group matrix, one row for each token and group however many
   texts the group has. For the query classes of the smaller group, the overlap with the other group's token union is an
   upper bound of that with each member; only groups that it lets through are opened.
5. Inside a group, and for queries that a group was opened to, two sets differ by what their differences to the pivot
   differ by. Those close to the pivot hang on one centre; the others meet over the few tokens of their differences.
6. Pairs that remain are compared by bitmap sketches of the sets, which bound the intersection from above, then exactly
   on whole sets, and components are closed over all links.

Two different shingles share a hash with a chance of about 2**-64, as do two different sets their key.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from yomisaku.llm.bitmaps import bitmap, in_bitmap
from yomisaku.llm.common import free_name, text_blocks, written
from yomisaku.llm.components import components
from yomisaku.llm.words import NOT_BLANK, Words, mix, runs

HOT = 16
_SEEDS = [np.uint64(x) for x in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xA54FF53A5F1D36F1)]

_LONGS = T.ArrayType(T.LongType())


class Rule:
    """Similar enough: ``den`` * intersection >= ``num`` * union, over shingles of ``k`` words."""

    def __init__(self, k: int = 4, num: int = 85, den: int = 100):
        self.k, self.num, self.den = k, num, den
        #: Smaller sets are similar enough to equal sets only.
        self.least = next(n for n in range(1, 10 ** 9) if den * n >= num * (n + 1)) if num < den else 1 << 62

    def prefix(self, n: int) -> int:
        return n - -(-self.num * n // self.den) + 1

    def kept(self, n: int) -> int:
        """Tokens kept per row: half as many again as the prefix, to have enough when hot ones move back."""
        return min(n, self.prefix(n) * 3 // 2 + 8)

    def sizes_fit(self, x: str, y: str) -> F.Column:
        return F.expr(f"{self.den} * least({x}, {y}) >= {self.num} * greatest({x}, {y})")

    def overlap(self, x: str, y: str) -> str:
        """SQL for the intersection that sets of these sizes need."""
        return f"ceil({self.num} * cast({x} + {y} as double) / {self.num + self.den} - 1e-9)"


def token_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``k`` are one shingle, no words none."""
    words = Words(texts, NOT_BLANK)
    hashes = words.hashes()
    every = runs(hashes, k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(every[a:b - k + 1]))
        else:
            out.append(runs(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed numbers."""
    at = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    a = mix(tokens * np.uint64(0x9FB21C651E98DF25) + at * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
    b = mix(tokens ^ mix(at + np.uint64(0x2545F4914F6CDD1D))).sum(dtype=np.uint64)
    return tuple(mix(np.array([a, b], np.uint64)).view(np.int64).tolist())


def _list_column(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _lists(column: pa.Array) -> list[np.ndarray]:
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy().view(np.uint64)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, t (hash of the text), n, a, b (digest of the set), m (minhashes), head (tokens of the smallest hashes), sketch."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *[T.StructField(c, T.LongType()) for c in ("t", "n", "a", "b")],
                           T.StructField("m", _LONGS), T.StructField("head", _LONGS), T.StructField("sketch", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches):
            sets = token_sets(part.column(1), rule.k)
            digests = [_digest(s) for s in sets]
            least = [np.array([mix(s ^ seed).min() for seed in _SEEDS], np.uint64) if len(s) else s for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 _list_column(least), _list_column([s[:rule.kept(len(s))] if len(s) >= rule.least else s[:0] for s in sets]),
                 pa.array([sketch(s) for s in sets], pa.binary())],
                names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, schema)


# ---- sketches

def sketch(tokens: np.ndarray) -> bytes:
    """A bitmap of the tokens' places, of a power of two of bits, twice as many as tokens at least."""
    bits = np.zeros(max(64, 1 << (2 * len(tokens) - 1).bit_length()), np.uint8)
    bits[(tokens >> np.uint64(8)).astype(np.int64) & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def most_common(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the intersection: each bit set for one alone is a token, or more, that the other lacks."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = np.bitwise_or.reduce(a.reshape(-1, size), 0), np.bitwise_or.reduce(b.reshape(-1, size), 0)
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def _plausible(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """The pairs x, y whose sketches do not rule them out; what remains is compared on whole sets."""
    x = classes.select(F.col("key").alias("x"), F.col("n").alias("xn"), F.col("sketch").alias("xs"))
    y = classes.select(F.col("key").alias("y"), F.col("n").alias("yn"), F.col("sketch").alias("ys"))
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            nx, ny, xs, ys = (part.column(c).to_pylist() for c in range(2, 6))
            ok = [(rule.num + rule.den) * most_common(a, b, m, n) >= rule.num * (m + n) for m, n, a, b in zip(nx, ny, xs, ys)]
            yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(x, "x").join(y, "y").select("x", "y", "xn", "yn", "xs", "ys").mapInArrow(run, schema)


# ---- prefixes

_PREFIX = T.StructType([*[T.StructField(c, T.LongType()) for c in ("a", "b", "n")], T.StructField("hot", T.DoubleType()),
                        T.StructField("enough", T.BooleanType()), T.StructField("tokens", _LONGS),
                        T.StructField("cold", T.IntegerType())])


def _ordered(tokens: np.ndarray, n: int, hot: np.ndarray, rule: Rule) -> tuple[np.ndarray, int, bool]:
    """The first tokens of the global order, how many of them are not hot, and whether ``tokens`` were enough to tell."""
    p = rule.prefix(n)
    cold = tokens[~hot][:p]
    if len(cold) == p or len(tokens) == n:
        return np.concatenate([cold, tokens[hot][:p - len(cold)]]), len(cold), True
    return tokens[:0], 0, False


def _one_row(rows: DataFrame, *others: F.Column) -> DataFrame:
    """Per class the row whose text stands for it: key, b, label and t."""
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("one")
    named = [F.col("a").alias("key"), "b", F.col("one.doc_id").alias("label"), F.col("one.t").alias("t")]
    return rows.groupBy("a", "b").agg(one, *others).select(*named, *[c for c in ("m", "sketch") if others])


def _frequent(lists: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the tokens in more than HOT of the lists."""
    counts = (lists.select(F.explode(column).alias("w")).select(F.pmod("w", F.lit(1 << 31)).cast("int").alias("w"))
              .groupBy("w").count().filter(F.col("count") > HOT))
    return bitmap(counts.select(F.col("w").cast("long").alias("w")), "w")


def _prefixes(sigs: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per class that others may be similar to: key, b, label, t, n, m, hot share, ordered tokens, how many are cold.

    Hot are the tokens that are frequent among the kept ones of all rows, and those frequent among all tokens of the
    classes that have too few others to fill their prefix, as these reach further than what was kept.
    """
    spark = sigs.sparkSession
    some = sigs.filter(F.col("n") >= rule.least)
    first = _frequent(some, "head")
    kept = spark.sparkContext.broadcast(first)

    def lacks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ns = part.column(4).to_pylist()
            made = [not _ordered(h, n, in_bitmap(kept.value, h), rule)[2] for h, n in zip(_lists(part.column(5)), ns)]
            yield part.select([0, 1, 2, 3]).filter(pa.array(made, pa.bool_()))

    rows = some.select("a", "b", "doc_id", "t", "n", "head").mapInArrow(lacks, "a long, b long, doc_id long, t long")
    heavy = written(_fetch(docs, written(_one_row(rows), "heavy"), rule), "heavy-sets")
    shared = spark.sparkContext.broadcast(first | _frequent(heavy, "tokens"))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for part in batches:
            ns = part.column(2).to_pylist()
            heads = _lists(part.column(3))
            hots = [in_bitmap(bits, h) for h in heads]
            made = [_ordered(h, n, hot, rule) for h, n, hot in zip(heads, ns, hots)]
            share = [float(hot[:rule.prefix(n)].mean()) for hot, n in zip(hots, ns)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), part.column(2), pa.array(share, pa.float64()),
                 pa.array([m[2] for m in made], pa.bool_()), _list_column([m[0] for m in made]),
                 pa.array([m[1] for m in made], pa.int32())], names=_PREFIX.names)

    # Equal sets give equal rows, so it doesn't matter which of a class is kept.
    whose = _one_row(some, F.first("m").alias("m"), F.first("sketch").alias("sketch"))
    ordered = (some.select("a", "b", "n", "head").mapInArrow(order, _PREFIX).groupBy("a", "b")
               .agg(*[F.first(c).alias(c) for c in ("n", "hot", "enough", "tokens", "cold")]).withColumnRenamed("a", "key"))
    base = written(ordered.join(whose, ["key", "b"]).select(
        "key", "b", "label", "t", "n", "m", "hot", "enough", "tokens", "cold", "sketch"), "prefixes")
    short = base.filter("not enough")

    def whole(sets: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
        return [_ordered(s, len(s), in_bitmap(shared.value, s), rule)[:2] for s in sets]

    again = _fetch(docs, short, rule, whole)
    mended = written(short.drop("tokens", "cold").join(again, ["key", "b"]), "mended")
    return base.filter("enough").unionByName(mended)


def _fetch(docs: DataFrame, need: DataFrame, rule: Rule, of=None) -> DataFrame:
    """key, b, tokens and cold of the classes ``need`` (key, b, label, t), read from the text of one row of each.

    Texts are chosen by a bitmap before they are split into words; what it lets through wrongly goes in the join. ``of`` makes tokens
    and cold from whole sets; without it they are the whole set and its size.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(need, "t"))
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("doc", "key", "b")],
                           T.StructField("tokens", _LONGS), T.StructField("cold", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_blocks(batches):
            t = part.column(2).to_numpy().view(np.uint64)
            part = part.filter(pa.array(in_bitmap(bits.value, t)))
            if not part.num_rows:
                continue
            sets = token_sets(part.column(1).combine_chunks() if isinstance(part.column(1), pa.ChunkedArray) else part.column(1), rule.k)
            digests = [_digest(s) for s in sets]
            made = of(sets) if of else [(s, len(s)) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([d[0] for d in digests], pa.int64()), pa.array([d[1] for d in digests], pa.int64()),
                 _list_column([m[0] for m in made]), pa.array([m[1] for m in made], pa.int32())], names=schema.names)

    got = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("t")).mapInArrow(run, schema)
    # Rows of one label and set are alike; the join's shuffle serves for taking one of them too.
    return (got.join(need.select("key", "b", "label"), ["key", "b"]).filter(F.col("doc").eqNullSafe(F.col("label")))
            .groupBy("key", "b").agg(F.first("tokens").alias("tokens"), F.first("cold").alias("cold")))


# ---- comparing pairs

def _verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs x, y of class keys whose whole sets are similar enough."""
    left = sets.select(F.col("key").alias("x"), F.col("tokens").alias("xs"))
    right = sets.select(F.col("key").alias("y"), F.col("tokens").alias("ys"))
    schema = T.StructType([T.StructField("x", T.LongType()), T.StructField("y", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = []
            for x, y in zip(_lists(part.column(2)), _lists(part.column(3))):
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                ok.append(rule.den * common >= rule.num * (len(x) + len(y) - common))
            yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(left, "x").join(right, "y").select("x", "y", "xs", "ys").mapInArrow(run, schema)


def _sets_of(docs: DataFrame, classes: DataFrame, keys: DataFrame, rule: Rule) -> DataFrame:
    """Whole token sets of the classes ``keys`` (key)."""
    need = classes.select("key", "b", "label", "t").join(keys.distinct(), "key", "left_semi")
    return written(_fetch(docs, need, rule), "sets")


def _differences(pairs: DataFrame, docs: DataFrame, classes: DataFrame, rule: Rule, every: bool = False) -> DataFrame:
    """x, y, n (size of x) and delta of the pairs x, y of class keys that share half of their union at least.

    ``delta`` holds the tokens of x that y lacks, then those of y that x lacks. With ``every`` the other pairs come too, with a NULL delta.
    """
    pairs = written(pairs, "compared")
    likely = pairs if every else written(_plausible(pairs, classes, Rule(rule.k, 1, 2)), "near")
    keys = likely.select(F.col("x").alias("key")).unionByName(likely.select(F.col("y").alias("key")))
    sets = _sets_of(docs, classes, keys, rule)
    left = sets.select(F.col("key").alias("x"), F.col("tokens").alias("xs"))
    right = sets.select(F.col("key").alias("y"), F.col("tokens").alias("ys"))
    schema = T.StructType([*[T.StructField(c, T.LongType()) for c in ("x", "y", "n")], T.StructField("delta", _LONGS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            sizes, deltas, near = [], [], []
            for x, y in zip(_lists(part.column(2)), _lists(part.column(3))):
                delta = np.concatenate([np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)])
                near.append(len(x) + len(y) >= 3 * len(delta))
                deltas.append(delta if near[-1] else delta[:0])
                sizes.append(len(x))
            made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), _list_column(deltas)], names=schema.names)
            if not every:
                yield made.filter(pa.array(near, pa.bool_()))
            else:
                far = pa.array(deltas and [None if not ok else d.view(np.int64) for ok, d in zip(near, deltas)], pa.list_(pa.int64()))
                yield made.set_column(3, "delta", far)

    return written(likely.join(left, "x").join(right, "y").select("x", "y", "xs", "ys").mapInArrow(run, schema), "deltas")


def _groups(classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """key, grp, n and delta: classes partitioned by the pivot that they share half of their tokens with.

    Pivots are the commonest classes of minhashes that more than HOT classes share. Of several the most shared one
    counts; if a pivot itself belongs to another's group, its members are compared with that one too. A group is
    named by its pivot, which serves as its reference and need not be a member. Classes near no pivot are left out.
    """
    shared = classes.select("key", "n", "hot", F.posexplode("m").alias("j", "w"))
    pivots = written(shared.groupBy("j", "w").agg(F.count("*").alias("c"), F.max(F.struct("hot", "key", "n")).alias("p"))
                     .filter(F.col("c") > HOT).select("j", "w", F.col("p.key").alias("y"), F.col("p.n").alias("yn"), "c"), "pivots")
    rank = pivots.groupBy("y").agg(F.max("c").alias("c"))
    pairs = (shared.join(pivots, ["j", "w"]).filter("2 * least(n, yn) >= greatest(n, yn)")
             .select(F.col("key").alias("x"), "y").distinct())
    found = _differences(pairs, docs, classes, rule)

    def chosen(found: DataFrame) -> DataFrame:
        return found.join(rank, "y").groupBy("x").agg(F.max(F.struct("c", "y", "n", "delta")).alias("one")).select(
            F.col("x").alias("key"), F.col("one.y").alias("grp"), F.col("one.n").alias("n"), F.col("one.delta").alias("delta"))

    first = written(chosen(found), "first-groups")
    above = first.filter("key != grp").select(F.col("key").alias("grp"), F.col("grp").alias("y"))
    more = (first.join(above, "grp").select(F.col("key").alias("x"), "y").distinct()
            .join(found.select("x", "y"), ["x", "y"], "left_anti"))
    return written(chosen(found.unionByName(_differences(more, docs, classes, rule))), "groups")


def _postings(classes: DataFrame) -> DataFrame:
    """key, n, grp, members, i and w: the places of those tokens in the classes' prefixes that occur more than once."""
    tokens = classes.select(F.explode("tokens").alias("w"))
    twice = (tokens.select(F.pmod("w", F.lit(1 << 31)).cast("int").alias("w")).groupBy("w").count().filter("count > 1")
             .select(F.col("w").cast("long").alias("w")))
    bits = classes.sparkSession.sparkContext.broadcast(bitmap(twice, "w"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "grp", "members", "i", "w")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = _lists(part.column(4))
            met = [np.flatnonzero(in_bitmap(bits.value, x)) for x in lists]
            take = pa.array(np.repeat(np.arange(part.num_rows), [len(m) for m in met]))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c).take(take) for c in range(4)],
                 pa.array(np.concatenate(met) if met else np.zeros(0), pa.int64()),
                 pa.array(np.concatenate([x[m] for x, m in zip(lists, met)]).view(np.int64) if met else np.zeros(0), pa.int64())],
                names=schema.names)

    return written(classes.select("key", "n", "grp", "members", "tokens").mapInArrow(run, schema), "postings")


def _query_groups(classes: DataFrame, rule: Rule) -> DataFrame:
    """The token-group matrix: query classes x and the other groups g that the matrix does not rule out.

    One row for each token and group of its texts' prefixes, however many texts the group has; the classes of the
    smaller group are the queries. Returns x, n, g, size, needed (overlap) and y, the member where the group has one.
    """
    rows = _postings(classes)
    matrix = (rows.groupBy("w", "grp").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(F.col("n") - F.col("i")).alias("room"),
                                           F.max("i").alias("yi"), F.first("members").alias("size"), F.min("key").alias("y"))
              .withColumnRenamed("grp", "g"))
    needed = rule.overlap("n", f"greatest(least, ceil({rule.num} * n / {rule.den}))")
    met = (rows.join(matrix, "w").filter("struct(members, grp) < struct(size, g)")
           .filter(f"{rule.den} * most >= {rule.num} * n and {rule.den} * n >= {rule.num} * least")
           # The first token that two texts share leaves each of them room for the overlap they need.
           .filter(f"least(n - i, room) >= {needed}")
           .groupBy(F.col("key").alias("x"), "n", "g", "size").agg(
               F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("c"), F.max("i").alias("i"), F.max("yi").alias("yi"),
               F.min("y").alias("y"))
           .withColumn("needed", F.expr(needed).cast("long"))
           # After the last token that is shared with a single class, no more than the rest of the shorter remainder is.
           .filter("size > 1 or c + least(n - i - 1, most - yi - 1) >= needed"))
    return written(met.select("x", "n", "g", "size", "needed", F.when(F.col("size") == 1, F.col("y")).alias("y")), "query-groups")


#: Bits of a group's token union, in words of 64.
_UNION_BITS = 1 << 16


def _qualifying(several: DataFrame, classes: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The rows of query classes and groups whose token unions may hold the overlap that is needed.

    A union is a bitmap, which bounds the overlap with it, and so with each member, from above.
    """
    members = classes.select("key", "grp").join(several.select(F.col("g").alias("grp")).distinct(), "grp", "left_semi")
    keys = members.select("key").unionByName(several.select(F.col("x").alias("key")))
    sets = _sets_of(docs, classes, keys, rule).select("key", "tokens")

    def union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            groups = part.column(0).to_numpy()
            lists = _lists(part.column(1))
            whose = np.repeat(groups, [len(x) for x in lists])
            bit = (np.concatenate(lists) % np.uint64(_UNION_BITS)).astype(np.int64)
            order = np.lexsort((bit >> 6, whose))
            whose, bit = whose[order], bit[order]
            at = np.flatnonzero((np.diff(whose, prepend=whose[:1] - 1) != 0) | (np.diff(bit >> 6, prepend=-1) != 0)) if len(bit) else np.zeros(0, np.int64)
            words = np.bitwise_or.reduceat(np.uint64(1) << (bit & 63).astype(np.uint64), at) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(whose[at]), pa.array((bit >> 6)[at]), pa.array(words.view(np.int64))],
                                             names=["g", "place", "word"])

    words = members.join(sets, "key").select("grp", "tokens").mapInArrow(union, "g long, place long, word long")
    unions = (words.groupBy("g", "place").agg(F.bit_or("word").alias("word")).groupBy("g")
              .agg(F.collect_list(F.struct("place", "word")).alias("bits")).select("g", "bits.place", "bits.word"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("x", "n", "g")])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = []
            for needed, x, place, word in zip(part.column(3).to_pylist(), *[_lists(part.column(c)) for c in (4, 5, 6)]):
                bits = np.zeros(_UNION_BITS // 64, np.uint64)
                bits[place.view(np.int64)] = word
                at = x % np.uint64(_UNION_BITS)
                ok.append(int(((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).sum()) >= needed)
            yield part.select(["x", "n", "g"]).filter(pa.array(ok, pa.bool_()))

    asked = several.join(sets.withColumnRenamed("key", "x"), "x").join(unions, "g")
    return written(asked.select("x", "n", "g", "needed", "tokens", "place", "word").mapInArrow(bound, schema), "qualifying")


def _inside(rows: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """Links among the classes compared with one pivot: grp, key, n and delta, their difference to it.

    Two sets differ by what their deltas differ by, also after all deltas of a group are changed alike: tokens in more than half
    of them change sides, so that deltas are those to what the group has in common, whichever class was the pivot. So with
    f = (den + num) * size of the delta - (den - num) * n, two classes are similar enough if their f sum to 0 or less, and
    all such pairs hang together by the class with the smallest f, the centre. Others must share (f + f) / 2 (den + num)
    tokens of their deltas, which a prefix filter finds, rare tokens first. Returns the links x, y, where y is a centre,
    and the other links.
    """
    up, down = rule.den + rule.num, rule.den - rule.num
    rows = written(rows, "differences")

    def counts(rows: DataFrame) -> DataFrame:
        return rows.select("grp", F.explode("delta").alias("w")).groupBy("grp", "w").agg(F.count("*").alias("c"))

    sizes = rows.groupBy("grp").agg(F.count("*").alias("size"))
    common = counts(rows).join(sizes, "grp").filter("2 * c > size").groupBy("grp").agg(F.collect_list("w").alias("common"))
    changed = F.array_union(F.array_except("delta", "common"), F.array_except("common", "delta"))
    rows = rows.join(common, "grp", "left").withColumn("delta", F.when(F.col("common").isNull(), F.col("delta")).otherwise(changed))
    rows = written(rows.drop("common").withColumn("f", F.expr(f"{up}L * size(delta) - {down}L * n")), "centred")
    centre = rows.groupBy("grp").agg(F.min(F.struct("f", "key")).alias("s")).select("grp", F.col("s.f").alias("sf"), F.col("s.key").alias("sk"))
    rows = written(rows.join(centre, "grp").withColumn("linked", F.expr("f + sf <= 0")), "inside")
    stars = rows.filter("linked and key != sk").select(F.col("key").alias("x"), F.col("sk").alias("y"))
    rest = rows.filter("not linked").groupBy("grp").agg(F.min("f").alias("zf"))

    def shared(f: str) -> F.Column:
        return F.expr(f"greatest(1L, cast(ceil(({f}) / cast({2 * up} as double) - 1e-9) as long))")

    offered = (rows.join(rest, "grp").withColumn("least", F.when(F.col("linked"), shared("f + zf")).otherwise(shared("f + sf")))
               .withColumn("d", F.size("delta").cast("long")).filter("d >= least"))
    each = offered.select("grp", "key", "n", "f", "d", "linked", "least", F.explode("delta").alias("w"))
    place = Window.partitionBy("grp", "key").orderBy("c", "w")
    tokens = (each.join(counts(offered), ["grp", "w"]).withColumn("i", F.row_number().over(place).cast("long") - 1)
              .filter("c > 1 and d - i >= least").drop("least", "c"))
    tokens = written(tokens, "delta-tokens")
    x = tokens.filter("not linked").select("grp", "w", F.col("key").alias("x"), *[F.col(c).alias("x" + c) for c in ("n", "f", "d", "i")])
    y = tokens.select("grp", "w", F.col("key").alias("y"), "linked", *[F.col(c).alias("y" + c) for c in ("n", "f", "d", "i")])
    pairs = (x.join(y, ["grp", "w"]).filter("(linked or x < y) and x != y and xf + yf > 0").filter(rule.sizes_fit("xn", "yn"))
             .withColumn("need", shared("xf + yf")).filter("least(xd - xi, yd - yi) >= need")
             .groupBy("grp", "x", "y", "need", "xd", "yd").agg(F.count("*").alias("c"), F.max("xi").alias("xi"), F.max("yi").alias("yi"))
             .filter("c + least(xd - xi - 1, yd - yi - 1) >= need").select("grp", "x", "y", "need"))
    pairs = written(pairs, "delta-pairs")
    left = rows.select("grp", F.col("key").alias("x"), F.col("delta").alias("xs"))
    right = rows.select("grp", F.col("key").alias("y"), F.col("delta").alias("ys"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("x", "y")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = [len(np.intersect1d(a, b, True)) >= need for need, a, b in
                  zip(part.column(2).to_pylist(), _lists(part.column(3)), _lists(part.column(4)))]
            yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(left, ["grp", "x"]).join(right, ["grp", "y"]).select("x", "y", "need", "xs", "ys")
    return stars, both.mapInArrow(run, schema)


def classes_of(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n, a, b) and the root (key, root) of each class that has others linked to it."""
    rule = Rule(k, num, den)
    sigs = written(signatures(docs, rule), "signatures")
    classes = _prefixes(sigs, docs, rule)
    near = _groups(classes, docs, rule)
    sizes = near.groupBy("grp").agg(F.count("*").alias("members"))
    grouped = (classes.select("key", "b", "label", "t", "n", "tokens", "sketch")
               .join(near.join(sizes, "grp").select("key", "grp", "members"), "key", "left")
               .withColumns({"grp": F.coalesce("grp", "key"), "members": F.coalesce("members", F.lit(1).cast("long"))}))
    grouped = written(grouped, "grouped")
    met = _query_groups(grouped, rule)
    single = met.filter("size = 1").select("x", "y")
    opened = _qualifying(met.filter("size > 1"), grouped, docs, rule)
    # Whoever is near a group's pivot is a guest of the group and meets its members there, the others meet them one by one.
    against = _differences(opened.select("x", F.col("g").alias("y")), docs, grouped, rule, every=True)
    guests = against.filter("delta is not null").select(F.col("x").alias("key"), F.col("y").alias("grp"), "n", "delta")
    stars, inside = _inside(near.select("key", "grp", "n", "delta").unionByName(guests), rule)
    far = against.filter("delta is null").select("x", F.col("y").alias("grp"), F.col("n").alias("xn"))
    plain = far.join(grouped.select(F.col("key").alias("y"), F.col("n").alias("yn"), "grp"), "grp").filter(rule.sizes_fit("xn", "yn")).select("x", "y")
    pairs = written(_plausible(single.unionByName(plain), grouped, rule), "pairs")
    keys = pairs.select(F.col("x").alias("key")).unionByName(pairs.select(F.col("y").alias("key")))
    links = _verified(pairs, _sets_of(docs, grouped, keys, rule), rule)
    # Each centre and what hangs on it alone is one node, so that no node has as many edges as a group has members.
    stars = written(stars, "star-links")
    centre = written(stars.groupBy("x").agg(F.min("y").alias("node")), "centres")
    edges = (links.unionByName(inside).unionByName(stars.join(centre, "x").filter("y != node").select("node", "y").toDF("x", "y")))
    for end in ("x", "y"):
        edges = edges.join(centre.select(F.col("x").alias(end), F.col("node").alias(end + "_node")), end, "left").withColumn(
            end, F.coalesce(end + "_node", end)).drop(end + "_node")
    # A centre may hang on another one itself.
    hanging = centre.select(F.col("x").alias("key"), "node")
    chain = hanging.join(hanging.select(F.col("node").alias("key")).distinct(), "key").toDF("x", "y")
    edges = edges.select("x", "y").unionByName(chain)
    among = components(edges.select(F.col("x").alias("u"), F.col("y").alias("v"))).select(F.col("node").alias("key"), "root")
    among = written(among, "nodes")
    alone = hanging.select(F.col("node").alias("key")).distinct().join(hanging.select("key"), "key", "left_anti").withColumn("node", F.col("key"))
    known = hanging.unionByName(alone)
    others = among.join(known.select("key"), "key", "left_anti")
    under = known.join(among.withColumnRenamed("key", "node"), "node", "left").select("key", F.coalesce("root", "node").alias("root"))
    return sigs.drop("m", "head", "sketch"), under.unionByName(others)


def near_duplicates(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; t is a hash of its text.

    Rows are linked if ``den`` * intersection >= ``num`` * union of their shingle sets; component_id is the smallest
    doc_id reachable by links. A NULL or empty text, or one of blanks, has the empty set and is linked with nothing:
    its component is its own doc_id. Rows of one doc_id are separate nodes. Rows without doc_id are linked like
    others but name no component: it is NULL if no row in reach has an id. Other columns are dropped.
    """
    sigs, named = _named(docs, k, num, den)
    least = named.groupBy("root", "root_b").agg(F.min("label").alias("component"))
    placed = named.join(least, ["root", "root_b"]).select("a", "b", "component")
    return sigs.join(placed, ["a", "b"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "t")


def _named(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, t, n, a, b), and per class a, b of texts with words its smallest doc_id, its first row and its root.

    A class without links is its own root; root_b tells such classes apart that share half of their digest.
    """
    sigs, roots = classes_of(docs, k, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t")).alias("first")
    classes = sigs.filter("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("label"), first)
    rooted = classes.join(roots, F.col("a") == F.col("key"), "left").select(
        "a", "b", "label", "first", F.coalesce("root", "a").alias("root"), F.when(F.col("root").isNull(), F.col("b")).otherwise(0).alias("root_b"))
    return sigs, rooted


def keep_first(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """One row of each component of ``near_duplicates``: the one with the smallest doc_id; all columns stay.

    Of rows with equal ids in a component, that with the smallest hash of its text stays; rows without an id stay only in
    components without any id. Different components keep a row each, also where they share a doc_id. Rows without words
    are kept; rows that repeat an id and its text are one.
    """
    t = free_name(docs, "text_hash")
    sigs, named = _named(docs, k, num, den)
    one = named.groupBy("root", "root_b").agg(F.min("first").alias("first")).select("first.doc_id", "first.t")
    chosen = sigs.filter("n = 0").select("doc_id", "t").unionByName(one).distinct()
    chosen = chosen.select(F.col("doc_id").alias(t + "_id"), F.col("t").alias(t + "_t"))
    marked = docs.withColumn(t, F.xxhash64("text"))
    kept = marked.join(chosen, F.col("doc_id").eqNullSafe(F.col(t + "_id")) & (F.col(t) == F.col(t + "_t")), "left_semi")
    return kept.dropDuplicates(["doc_id", t]).select(*docs.columns)
