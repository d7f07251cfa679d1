import datetime as dt

import pytest
from pyspark.sql import functions as F

from yomisaku.functions import cards, posts


@pytest.mark.parametrize("q,text,want", [
    ("amp", "a & b", "a &<mark>amp</mark>; b"),
    ('"a b" c', "A B <c>", "<mark>A B</mark> &lt;<mark>c</mark>&gt;"),
    ("東京", "東の京", "<mark>東</mark>の<mark>京</mark>"),
    ("c++", "c+", "<mark>c</mark><mark>+</mark>"),
    ("", "a<b", "a&lt;b"),
    (None, "a", "a"),
    ("x", None, ""),
    ("$1 \\", "cost $1 \\", "cost <mark>$</mark><mark>1</mark> <mark>\\</mark>"),
])
def test_highlight(spark, q, text, want):
    df = spark.createDataFrame([(q, text)], "q string, t string")
    assert df.select(cards.highlight(F.col("t"), F.col("q"))).first()[0] == want


def test_dates_and_texts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 20, 5), "abcdef", "")], "d timestamp_ntz, s string, t string")
    row = df.select(cards.format_date(F.col("d")), cards.format_datetime(F.col("d")),
                    cards.truncate_ellipsis(F.col("s"), 5), cards.truncate_ellipsis(F.col("s"), 6),
                    cards.title_or_default(F.col("t"))).first()
    assert list(row) == ["2024/01/02", "2024/01/02 05:05", "abcde…", "abcdef", "(無題)"]


@pytest.mark.parametrize("text,want", [
    ("2024-01-01T09:00:00+09:00", dt.datetime(2024, 1, 1)),
    ("2024-01-01T00:00:00Z", dt.datetime(2024, 1, 1)),
    ("2024-01-01T00:00:00", dt.datetime(2024, 1, 1)),
    ("2024-01-01", dt.datetime(2024, 1, 1)),
    ("2024-01-01T00:00:00-0530", dt.datetime(2024, 1, 1, 5, 30)),
    ("soon", None), ("", None), (None, None),
])
def test_parse_utc(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(posts.parse_utc(F.col("t"))).first()[0] == want


def test_links_and_lists(spark):
    df = spark.createDataFrame([("/a?b", "https://h.jp:8080/blog", "|x||y|", ["p", "q"], [])],
                               "l string, b string, s string, a array<string>, e array<string>")
    row = df.select(posts.absolutize(F.col("l"), F.col("b")), posts.pipe_split(F.col("s")), posts.pipe_join(F.col("a")),
                    posts.pipe_join(F.col("e")), posts.normalize_article_url(F.lit("https://x/y//")),
                    posts.url_post_id(F.lit("https://x/y/"))).first()
    import hashlib
    assert list(row) == ["https://h.jp:8080/a?b", ["x", "y"], "|p|q|", "", "https://x/y/",
                         int(hashlib.md5(b"https://x/y/").hexdigest()[:15], 16)]
