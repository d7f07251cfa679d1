import datetime as dt

import pytest
from pyspark.sql import functions as F

from yomisaku.functions.markup import PageFields, html_to_text
from yomisaku.operators import pages


def read(markup):
    title, content, widget, ld, published, modified, time, hrefs = PageFields().read(markup).row()
    return dict(title=title, content=content, widget=widget, ld=ld, published=published, modified=modified, time=time,
                hrefs=hrefs)


@pytest.mark.parametrize("markup,title", [
    ("<title>t</title><h1>a</h1><article><h1>b</h1></article>", "b"),
    ("<h1>a</h1><h1 class='x entry-title'>b</h1><h1 class='c--entry-title'>c<i> d</i></h1>", "cd"),
    ("<title>t</title><h1>a</h1>", "a"),
    ("<title> t <b>u</title>", "tu"),
    ("<header><h1>in header</h1></header><title>t</title>", "in header"),
    ("<h1></h1><title>t</title>", ""),
    ("<p>x", ""),
    ("<h2 class=entry-title>no</h2><h1>yes", "yes"),
])
def test_title_priority(markup, title):
    assert read(markup)["title"] == title


@pytest.mark.parametrize("markup,content", [
    ("<body>a<main>m</main><article>b<nav>n</nav><p>c<script>s</script></article></body>", "b c"),
    ("<article>b</article><article class='x jinr-article'>j</article>", "j"),
    ("<div class=entry-content>e</div><main>m</main>", "m"),
    ("<div id=content>i</div><div class='entry-content'>e<div class='entry-content'>f</div></div>g", "e f"),
    ("<head><title>t</title></head><body>b<footer>f</footer></body>", "b"),
    ("t<p>u<aside><article>hidden</article></aside>", "t u"),
    ("<article>a<!-- c -->b &amp; d&eacute; &#65;&#x42; &unknown; x</article>", "a b & dé AB &unknown x"),
    ("<article>a<br>b<br/>c</br>d</article>", "a b c d"),
    ("<article>a<p>b</div>c</article>d", "a b c"),
    ("<main><noscript>n</noscript>x<style>p{}</style><template>y</template></main>", "x"),
])
def test_body_priority_and_removed_parts(markup, content):
    assert read(markup)["content"] == content


def test_widget_text_is_what_surrounds_the_article():
    page = read("<title>t</title><nav>n</nav><main>m</main><div id=main>x</div><div class='entry y'>e</div>"
                "<div class=post-content>p</div><aside>a<script>s</script></aside><footer>f</footer>")
    assert page["widget"] == "t n a f"


@pytest.mark.parametrize("markup,shown", [
    ("<article><ruby>東京<rp>(</rp><rt>とうきょう</rt><rp>)</rp></ruby>駅</article>", "東京 駅"),
    ("<article>a&#129;b&#x80;</article>", "a\x81b€"),
])
def test_annotations_and_old_references(markup, shown):
    assert read(markup)["content"] == shown


@pytest.mark.parametrize("html,text", [
    ("", ""), (None, ""), ("plain  text\n x", "plain text x"), ("<p>a</p>b", "a b"), ("a&nbsp;b &lt;i&gt;", "a b <i>"),
    ("<b>x</b><script>var a='</p>'</script>y<noscript>z</noscript>", "x y"), ("1 < 2", "1 < 2"), ("a　b", "a b"),
    ("AT&T x", "AT&T x"), ("<![CDATA[q]]>r", "q r"),
])
def test_html_to_text(spark, html, text):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text(F.col("h"))).first()[0] == text


LD = '<script type="application/ld+json">%s</script>'
DATES = [
    (LD % '{"datePublished":"a","dateModified":"b"}', "a", "b"),
    (LD % '[{"x":1},{"datePublished":"a"},{"datePublished":"z","dateModified":"b"}]', "a", "b"),
    (LD % '{"@graph":[1,{"dateModified":"b"}]}', None, "b"),
    (LD % '{"@graph":{"datePublished":"a"},"datePublished":"c"}', "c", None),
    (LD % "{bad" + LD % '{"datePublished":"a"}', "a", None),
    (LD % "" + LD % '{"dateModified":"b"}' + LD % '{"datePublished":"late"}', None, "b"),
    (LD % '{"datePublished":""}' + '<meta property="article:published_time" content="m">', "m", None),
    ('<meta property="article:published_time"><meta property="article:published_time" content="n"><time datetime="t">',
     "t", None),
    ('<meta content="m" property="article:modified_time"><time>x</time><time datetime="t">', "t", "m"),
    ("<p>none", None, None),
]


def test_dates(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DATES)], "page_id int, html string")
    rows = pages.extract_dates(pages.read_fields(df)).orderBy("page_id").collect()
    assert [(r.published, r.modified) for r in rows] == [d[1:] for d in DATES]


def test_scraped_posts_and_links(spark):
    df = spark.createDataFrame([
        ("s", "https://x/a/", "<title>T</title><article>%s</article><time datetime='2024-01-02T00:00:00+09:00'>" % ("y" * 300)),
        ("s", "https://x/b/", "<h1> </h1><p>no title"),
        ("s", "https://x/c/", "<h1>C</h1>")], "site_id string, url string, html string")
    now = F.lit("2024-12-01 00:00:00").cast("timestamp_ntz")
    rows = pages.scraped_posts(pages.extract_articles(pages.read_fields(df)), now).orderBy("url").collect()
    assert [(r.title, len(r.excerpt), r.published_at, r.modified_at) for r in rows] == [
        ("T", 200, dt.datetime(2024, 1, 1, 15), dt.datetime(2024, 1, 1, 15)),
        ("C", 1, dt.datetime(2024, 12, 1), dt.datetime(2024, 12, 1))]
    archive = spark.createDataFrame([("s", ["https://x/read-cat", "https://x/read-a", "https://x/read-a//", "/read-b",
                                            "see https://x/read-c"])], "site_id string, hrefs array<string>")
    rules = spark.createDataFrame([("s", r"^https://x/read-(?!cat)[a-z]+/*$"), ("t", ".*")], "site_id string, link_re string")
    assert [r.url for r in pages.archive_links(archive, rules).collect()] == ["https://x/read-a/"]


def test_widget_rows(spark):
    fetched = spark.createDataFrame([
        ("u1", 200, "text/HTML", "<p>side"), ("u2", 404, "text/html", "<p>x"), ("u3", 200, "application/json", "<p>x"),
        ("u4", 200, "text/html", "<main>x</main>")], "url string, status int, content_type string, html string")
    sites = spark.createDataFrame([(f"s{i}", f"N{i}", f"u{i}") for i in range(1, 5)], "id string, name string, url string")
    sources = spark.createDataFrame([("s2", "u1")], "site_id string, url string")
    now = F.lit("2024-12-01 00:00:00").cast("timestamp_ntz")
    texts = pages.widget_text(pages.read_fields(fetched))
    rows = pages.widget_rows(sites, sources, texts, now).orderBy("site_id").collect()
    assert [(r.site_id, r.post_id, r.title, r.content) for r in rows] == [
        ("s1", -1, "ウィジット (N1)", "side"), ("s2", -1, "ウィジット (N2)", "side")]
