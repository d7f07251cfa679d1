"""Allow and block lists for URLs: a trie over reversed host labels and path segments, the longest rule wins.

A rule has a host and the start of a path; it fits URLs of its host and of all subdomains whose path starts with its
path. Of several that fit, the one with the most host labels wins, and of those the one with the longest path. The
trie walks the labels of a host from the right; where rules of a host end, it carries a second trie over the segments
of their paths, whose last, unfinished segment may be the beginning of one.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from yomisaku.llm.common import blocks, free_name, written

#: Rules and bytes of rules in one broadcast trie; larger lists take one pass for each block of rules.
BLOCK_RULES, BLOCK_BYTES = 200_000, 16 << 20

RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("host", "path", "verdict")])
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BEST = T.StructType([T.StructField("labels", T.IntegerType()), T.StructField("length", T.IntegerType()),
                      T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, with A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_of(spark: SparkSession, entries: list[tuple[str, str]]) -> DataFrame:
    """A table of rules from pairs such as ("block", "example.com/en/"); the path begins at the first slash."""
    rows = [(host, slash + path, verdict) for verdict, entry in entries for host, slash, path in [entry.partition("/")]]
    return spark.createDataFrame(rows, RULES)


class Trie:
    """Rules by reversed host labels, then by path segments."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        # A host node is [children, path node or None]; a path node is [children, ends, lengths of the ends].
        self.root = [{}, None]
        for host, path, verdict in rules:
            labels = host.split(".")[::-1] if host else []
            node = self.root
            for label in labels:
                node = node[0].setdefault(label, [{}, None])
            if node[1] is None:
                node[1] = [{}, {}, ()]
            *whole, begun = path.split("/")
            end = node[1]
            for segment in whole:
                end = end[0].setdefault(segment, [{}, {}, ()])
            end[1][begun] = (len(labels), len(path), host + path, verdict)
            end[2] = sorted({len(x) for x in end[1]}, reverse=True)

    def longest(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """Labels, path length, text and verdict of the rule that wins, if one fits."""
        node, best, segments = self.root, None, path.split("/")
        if node[1]:
            best = _longest_path(node[1], segments)
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            if node[1]:
                best = _longest_path(node[1], segments) or best
        return best


def _longest_path(node: list, segments: list[str]) -> tuple[int, int, str, str] | None:
    best, last = None, len(segments) - 1
    for i, segment in enumerate(segments):
        best = next((node[1][segment[:n]] for n in node[2] if n <= len(segment) and segment[:n] in node[1]), best)
        node = node[0].get(segment) if i < last else None
        if node is None:
            break
    return best


def _clean(rules: DataFrame) -> DataFrame:
    """One row per host and path; where both verdicts are given, block holds."""
    host, path = F.coalesce(F.translate("host", _UPPER, _LOWER), F.lit("")), F.coalesce("path", F.lit(""))
    ok = F.when(F.col("verdict").isin("allow", "block"), F.col("verdict")).otherwise(
        F.raise_error(F.concat(F.lit("a rule must say allow or block, not "), F.coalesce("verdict", F.lit("NULL")))))
    return rules.select(host.alias("host"), path.alias("path"), ok.alias("verdict")).groupBy("host", "path").agg(
        F.max("verdict").alias("verdict"))


def judge(urls: DataFrame, rules: DataFrame, column: str = "url", default: str = "allow",
          block_rules: int = BLOCK_RULES) -> DataFrame:
    """``urls`` with four more columns: host, path, rule (host and path of the one that decides, or NULL) and verdict.

    ``rules`` has host, path and verdict (allow or block; anything else is an error). URLs that no rule fits get
    ``default``: what is on no list passes. A NULL URL or one without ``://`` has an empty host and path, which only rules
    of an empty host and path fit. Repeated rows stay; of a rule given with both verdicts block holds; NULL in a rule's
    host or path is empty. Other columns stay, and where ``urls`` already has a name the new one gets underscores.
    An empty list of rules leaves every URL to ``default``.
    """
    names = {}
    for name in ("host", "path", "rule", "verdict", "found"):
        names[name] = free_name(urls, name)
    out = urls.withColumns({names["host"]: host_of(F.col(column)), names["path"]: path_of(F.col(column)),
                            names["found"]: F.lit(None).cast(_BEST)})
    parts = blocks(written(_clean(rules), "url-rules"), block_rules, BLOCK_BYTES)
    for k, block in enumerate(parts):
        shared = urls.sparkSession.sparkContext.broadcast(Trie([tuple(r) for r in block.collect()]))

        @F.pandas_udf(_BEST)
        def longest(pieces: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
            trie = shared.value
            for hosts, paths in pieces:
                found = [trie.longest(h, p) or (None,) * 4 for h, p in zip(hosts, paths)]
                frame = pd.DataFrame(found, columns=_BEST.names, dtype=object)
                yield frame.astype({"labels": "Int32", "length": "Int32"})

        here = longest(names["host"], names["path"])
        here = F.when(here["labels"].isNotNull(), here)
        out = out.withColumn(names["found"], here if not k else F.greatest(names["found"], here))
        if k + 1 < len(parts):  # one trie at a time in memory
            out = written(out, "urls")
    found = F.col(names["found"])
    return (out.withColumns({names["rule"]: found["rule"], names["verdict"]: F.coalesce(found["verdict"], F.lit(default))})
            .drop(names["found"]))


def keep_allowed(urls: DataFrame, rules: DataFrame, column: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``urls`` that ``judge`` allows, with their own columns only."""
    judged = judge(urls, rules, column, default)
    return judged.filter(F.col(judged.columns[-1]) == "allow").select(*urls.columns)
