"""Quality rules with thresholds per language and source, in DataFrame operations only.

The signals of a text are array expressions inside its row. The thresholds come from quantile sketches
(``percentile_approx``: mergeable, built per task and merged by group), so a hot source costs one sketch per task. A
group's fence is its quartile plus a multiple of the spread between quartiles, as for outliers in a box plot; it adapts
to a language's or a source's habits where a fixed cutoff would not. Sketches of the corpus, of each language and of each
language and source are made in one pass; a fence is drawn towards that of the level above as if that had been seen in
``PRIOR`` rows, so small groups follow their language and large ones themselves. The fences are joined back by
language and source.
"""

from pyspark.sql import DataFrame, functions as F

from yomisaku.llm.common import free_name, written

#: Characters that count as symbols, and the blanks between words.
SYMBOLS = "#*$%&|<>"
BLANKS = "\t\n\x0b\x0c\r"

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

#: Relative error of the sketches is 1 / ACCURACY; groups of fewer rows are exact.
ACCURACY = 10_000

#: Per signal: the least that its fence may be, so that a group without spread rejects no ordinary text, and how many
#: spreads lie between the upper quartile and the fence.
FENCES = {"symbol_rate": (0.05, 3.0), "dup_line_rate": (0.3, 3.0), "repeat_rate": (0.1, 3.0)}
WORD_LENGTH_SPREADS = 6.0
WORD_LENGTH_SLACK = 2.0
#: Rows that the fence of the level above counts for.
PRIOR = 5.0


def words(text: F.Column) -> F.Column:
    """Runs of what is not blank."""
    return F.filter(F.split(F.translate(text, BLANKS, " " * len(BLANKS)), " "), lambda w: w != "")


def with_signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and text figures of every row of ``docs``; a NULL text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    base = base.select(
        "doc_id", "lang", "source", words(F.col("text")).alias("words"),
        F.length(F.translate(F.col("text"), " " + BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda s: F.translate(s, " " + BLANKS, "") != "").alias("lines"))
    base = base.select(
        "doc_id", "lang", "source", "word_chars", "n_symbols", F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _window_hashes("words").alias("windows"))
    # Most texts repeat no window; only the others are sorted.
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    base = base.select("*", F.when(repeated, by_hash).alias("sorted")).drop("windows")
    places = F.expr(
        "array_sort(transform(filter(sorted, (x, k) -> (k > 0 and sorted[k - 1].h = x.h)"
        " or (k + 1 < size(sorted) and sorted[k + 1].h = x.h)), x -> x.i))")
    base = base.select("*", F.when(F.col("sorted").isNotNull(), places).alias("places")).drop("sorted")
    covered = F.expr(f"aggregate(places, named_struct('n', 0L, 'p', {-WINDOW}),"
                     f" (a, p) -> named_struct('n', a.n + least({WINDOW}, p - a.p), 'p', p), a -> a.n)")
    return base.select("*", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")).drop("places")


def _window_hashes(column: str) -> F.Column:
    args = ", ".join(f"{column}[i + {k}]" for k in range(WINDOW))
    return F.expr(f"if(size({column}) >= {WINDOW}, transform(sequence(0, size({column}) - {WINDOW}),"
                  f" i -> xxhash64({args})), cast(array() as array<bigint>))")


def _rates(signals: DataFrame) -> DataFrame:
    safe = F.greatest(F.col("n_words"), F.lit(1))
    return signals.withColumns({
        "symbol_rate": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / safe,
        "word_length": F.col("word_chars") / safe})


def thresholds(rated: DataFrame) -> DataFrame:
    """The fences of every group of language and source that pass the base rules; NULL forms groups of its own."""
    sketched = rated.filter("not base_failed").rollup("lang", "source").agg(
        F.grouping_id().alias("level"), F.count("*").cast("double").alias("rows"),
        *[F.percentile_approx(c, [0.25, 0.75], ACCURACY).alias(c) for c in (*FENCES, "word_length")]).filter("rows > 0")
    fences = {f"most_{c}": F.greatest(F.lit(least), F.col(c)[1] + spreads * (F.col(c)[1] - F.col(c)[0]))
              for c, (least, spreads) in FENCES.items()}
    spread = WORD_LENGTH_SPREADS * (F.col("word_length")[1] - F.col("word_length")[0]) + WORD_LENGTH_SLACK
    fences |= {"least_length": F.col("word_length")[0] - spread, "most_length": F.col("word_length")[1] + spread}
    # A few numbers for each group; the three levels are read from one small table.
    own = written(sketched.select("lang", "source", "level", "rows", *[f.alias(c) for c, f in fences.items()]), "fences")

    def drawn(here: DataFrame, above: DataFrame, on: F.Column) -> DataFrame:
        above = above.select(F.col("lang").alias("above_lang"), *[F.col(c).alias(f"above_{c}") for c in fences])
        return here.join(above, on).select("lang", "source", "rows", *[
            ((F.col("rows") * F.col(c) + F.lit(PRIOR) * F.col(f"above_{c}")) / (F.col("rows") + F.lit(PRIOR))).alias(c) for c in fences])

    same = F.col("lang").eqNullSafe(F.col("above_lang"))
    # The corpus is one row, whose lang is NULL; every language meets it.
    languages = drawn(own.filter("level = 1"), own.filter("level = 3"), F.col("above_lang").isNull())
    return drawn(own.filter("level = 0"), languages, same).drop("rows")


def judge(docs: DataFrame) -> DataFrame:
    """Figures and verdict of every row of ``docs``.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept. A NULL or empty
    text fails the base rules; NULL languages and sources are groups; repeated rows are judged alike; other columns are
    dropped.
    """
    return _judged(with_signals(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _judged(signals: DataFrame) -> DataFrame:
    failed = F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    rated = _rates(signals).withColumn("base_failed", failed)
    # Written once: the texts are read and measured a single time for thresholds and verdicts.
    rated = written(rated, "signals")
    limits = thresholds(rated).withColumnsRenamed({"lang": "group_lang", "source": "group_source"})
    joined = rated.join(limits, F.col("lang").eqNullSafe(F.col("group_lang"))
                        & F.col("source").eqNullSafe(F.col("group_source")), "left")
    fine = F.lit(True)
    for c in FENCES:
        fine = fine & (F.col(c) <= F.col(f"most_{c}"))
    fine = fine & F.col("word_length").between(F.col("least_length"), F.col("most_length"))
    # A group without fences has no row that passed the base rules.
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fine, F.lit(False)))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns.

    The verdict is joined by a digest of the whole row that was judged, so rows of one doc_id with other texts are told
    apart and repeated rows are kept or rejected together. NULL and empty texts go.
    """
    mark_a, mark_b = free_name(docs, "mark_a"), free_name(docs, "mark_b")
    marked = docs.withColumns({
        mark_a: F.xxhash64("doc_id", "lang", "source", F.col("text").isNull(), "text"),
        mark_b: F.xxhash64(F.lit("second"), "doc_id", "lang", "source", F.col("text").isNull(), "text")})
    signals = with_signals(marked.select(F.struct(mark_a, mark_b).alias("doc_id"), "lang", "source", "text"))
    good = (_judged(signals).filter("kept")
            .select(F.col(f"doc_id.{mark_a}").alias(mark_a), F.col(f"doc_id.{mark_b}").alias(mark_b)).distinct())
    return marked.join(good, [mark_a, mark_b], "left_semi").select(*docs.columns)
