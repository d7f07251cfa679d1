"""Line dedup by overlapping windows of three lines, in DataFrame operations.

Every run of three neighbouring lines is hashed; a hash found more than once in the corpus is a repeated window. All
its occurrences but the first go, and the lines that such windows cover, merged, are cut from the texts.
"""

from pyspark.sql import DataFrame, functions as F

from yomisaku.llm.common import free_name, written

LINES = 3


def windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """One row per window: row key (doc_id, digest of the text), its number in the text, places of its lines, hash.

    Lines are trimmed before they are compared. Blank lines are no lines: a window runs over the next ``lines`` lines
    with text. A text with fewer has no window.
    """
    digest = [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), F.col("text")).alias("t2")]
    rows = docs.filter("text is not null").select("doc_id", *digest, F.expr(
        "filter(transform(split(text, '\\n'), (s, i) -> named_struct('s', trim(translate(s, '\\t\\r\\u000b\\f', '    ')), 'i', i)),"
        " x -> x.s != '')").alias("ls"))
    rows = rows.filter(F.size("ls") >= lines)
    hashed = "xxhash64({0})", "xxhash64('second', {0})"
    picked = ", ".join(f"ls[k + {j}].s" for j in range(lines))
    places = ", ".join(f"ls[k + {j}].i" for j in range(lines))
    made = F.expr(f"transform(sequence(0, size(ls) - {lines}), k -> named_struct('h1', {hashed[0].format(picked)},"
                  f" 'h2', {hashed[1].format(picked)}, 'at', k, 'places', array({places})))")
    return rows.select("doc_id", "t1", "t2", F.explode(made).alias("w")).select("doc_id", "t1", "t2", "w.*")


def covered(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """doc_id, t1, t2 and the sorted places of the lines inside later occurrences of repeated windows.

    The first occurrence is the smallest (doc_id, digest, place), with NULL ids first; rows repeated whole share it and
    are cut alike. Lines that a later occurrence shares with the first one of its own text stay. A hot window is one row per task before the shuffle; its occurrences meet their first by a join that
    Spark splits where it is skewed.
    """
    every = written(windows(docs, lines), "windows")
    place = F.struct("doc_id", "t1", "t2", "at")
    # Written, so that the join has shuffles of its own, whose hot partitions Spark splits.
    first = written(every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"))
                    .filter("not (first <=> last)").select("h1", "h2", "first"), "first-windows")
    later = every.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    same = F.expr("doc_id <=> first.doc_id and t1 = first.t1 and t2 = first.t2")
    shared = F.when(same, F.greatest(F.lit(0), F.col("first.at") + lines - F.col("at"))).otherwise(F.lit(0))
    return (later.select("doc_id", "t1", "t2", F.explode(F.slice("places", shared + 1, F.lit(lines))).alias("place"))
            .groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("place")).alias("places")))


def dedup_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``docs`` without the lines of later occurrences of repeated windows, and the number of lines taken as n_cut.

    Rows keep all their columns (n_chars, where there is one, follows a cut text) and no row goes: a text that
    consists of repeats becomes empty. NULL and empty texts have no lines and stay; repeated rows are cut alike.
    """
    names = docs.columns
    t1, t2, key, cut = (free_name(docs, n) for n in ("t1", "t2", "cut_id", "cut_places"))
    marked = docs.withColumns({t1: F.xxhash64("text"), t2: F.xxhash64(F.lit("second"), F.col("text"))})
    gone = covered(docs, lines).select(F.col("doc_id").alias(key), F.col("t1").alias(t1 + "_r"), F.col("t2").alias(t2 + "_r"),
                                       F.col("places").alias(cut))
    joined = marked.join(gone, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(t1) == F.col(t1 + "_r"))
                         & (F.col(t2) == F.col(t2 + "_r")), "left")
    joined = joined.withColumn(key, F.when(F.col(cut).isNotNull(), F.split("text", "\n")))
    left = F.expr(f"array_join(transform(array_except(sequence(0, size(`{key}`) - 1), `{cut}`), i -> `{key}`[i]), '\n')")
    text = F.when(F.col(cut).isNotNull(), left).otherwise(F.col("text"))
    n_cut = F.coalesce(F.size(cut), F.lit(0)).cast("long")
    joined = joined.withColumns({t1: text, t2: F.when(F.col(cut).isNotNull(), n_cut).otherwise(F.lit(0).cast("long"))})

    def column(c):
        if c.lower() == "text":
            return F.col(t1).alias(c)
        if c.lower() == "n_chars":
            return F.when(F.col(cut).isNotNull(), F.length(t1).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(c)
    return joined.select(*[column(c) for c in names], F.col(t2).alias(free_name(docs, "n_cut")))
