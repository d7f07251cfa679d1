"""Lexical search, fill-in-middle and URL filters against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import clashing, docs_of, odd_docs
from yomisaku.llm import fill_middle, lexical, url_filter


# ---- search

def terms_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def best_of(docs, items, k=10):
    counted = [(doc, terms_of(text)) for doc, text in docs]
    n_docs, n_terms = sum(1 for _, t in counted if t), sum(len(t) for _, t in counted)
    df = {}
    for _, terms in counted:
        for t in set(terms):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for doc, terms in counted:
            if terms:
                m = 100 - 75 + 75 * len(terms) * n_docs // n_terms
                scores.append((sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * tf // (1000 * tf + 8 * m))
                                   for t in terms_of(text) if t in df for tf in [terms.count(t)] if tf), doc))
        scores = sorted((x for x in scores if x[0] > 0), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
        out += [(item, r, doc, s) for r, (s, doc) in enumerate(scores, 1)]
    return sorted(out, key=repr)


def library(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Straße", "東京", "x9"]

    def prose(n):
        return " ".join(words[min(int(rnd.paretovariate(.6)), len(words)) - 1] for _ in range(n))
    docs = [(i, prose(rnd.randint(1, 80))) for i in range(150)]
    docs += [(i, docs[i % 7][1].upper()) for i in range(150, 190)]  # ties
    docs += [(5, docs[5][1]), (5, docs[5][1]), (None, docs[3][1]), (190, prose(4000)), (191, ""), (192, None), (193, "!?")]
    items = [(f"i{i}", prose(rnd.randint(1, 25))) for i in range(20)]
    items += [("i1", items[0][1]), (None, prose(4)), ("rare", "東京 straße 東京"), ("none", "unheard"), ("null", None), ("blank", " ")]
    return docs, items


@pytest.mark.parametrize("seed, cells, docs_in_block, query_terms, k", [(1, 1 << 13, 1024, 10**6, 10), (2, 16, 7, 40, 3), (3, 1, 64, 10**6, 10)])
def test_search_equals_brute_force(spark, monkeypatch, seed, cells, docs_in_block, query_terms, k):
    monkeypatch.setattr(lexical, "CELLS", cells)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_in_block)
    docs, items = library(seed)
    table = spark.createDataFrame(items, "item_id string, text string").repartition(3)
    got = lexical.search(lexical.index(docs_of(spark, docs, 5)), table, k, query_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best_of(docs, items, k)


def test_bounds_hold_and_stop_the_scoring():
    docs, items = library(4)
    texts = pa.array([t for _, t in docs])
    n, starts, terms, tfs = lexical.term_counts(texts)
    m = 25 + 75 * n * 190 // n.sum()
    rows = [lexical.term_counts(pa.array([t])) for _, t in items if terms_of(t)]
    block = pa.table({"query": pa.array(range(len(rows))), "terms": pa.array([r[2].view(np.int64) for r in rows]),
                      "tfs": pa.array([r[3].astype(np.int32) for r in rows])})
    queries = lexical.Queries(block, {int(t): 3 for t in terms.view(np.int64)}, 190)
    made = lexical.Block(queries, [d for d, _ in docs], m, starts, terms, tfs)
    scored = 0
    for q in range(len(rows)):
        exact = made.scores(np.arange(len(docs)), queries.places[q], queries.weights[q])
        assert (made.bounds(queries.slots[q], queries.weights[q]) >= exact).all()
        best = lexical.Best(3)
        scored += made.rescore(queries.slots[q], queries.places[q], queries.weights[q], best)
        assert [-r[0] for r in best.rows] == sorted(exact[exact > 0].tolist(), reverse=True)[:3]
    assert scored < .5 * len(rows) * len(docs)


def test_search_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [("a", "one WORD"), ("b", "漢字かな交じり文"), ("c", None)]
    table = clashing(spark.createDataFrame(items, "item_id string, text string"))
    got = lexical.search(lexical.index(clashing(docs)), table)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best_of(rows, items)
    assert lexical.search(lexical.index(docs.filter("false")), table).collect() == []
    assert lexical.search(lexical.index(docs), table.filter("false")).collect() == []


# ---- fill in the middle

def units_of(text, unit):
    if unit == "char":
        return list(text)
    found = re.findall(r"[^\n]*\n|[^\n]+" if unit == "line" else r"[\x20\x09-\x0D]+(?=[^\x20\x09-\x0D])|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", text)
    assert "".join(found) == text
    return found


@pytest.mark.parametrize("unit", ["char", "word", "line"])
@pytest.mark.parametrize("span, fan", [(128, 16), (4, 2), (1, 3)])
def test_cuts_at_both_ranks(monkeypatch, unit, span, fan):
    monkeypatch.setattr(fill_middle, "SPAN", span)
    monkeypatch.setattr(fill_middle, "FAN", fan)
    rnd = random.Random(span)
    texts = ["".join(rnd.choice("ab é漢😀 \n\t") for _ in range(rnd.choice([0, 1, 2, 5, 40, 400]))) for _ in range(60)] + ["", "x" * 5000]
    first, second = (np.array([rnd.randrange(1 << 32) for _ in texts]) for _ in range(2))
    first[:5] = 0
    n, p, m, pieces = fill_middle.cut(pa.array(texts), first, second, unit)
    for i, text in enumerate(texts):
        parts = units_of(text, unit)
        assert n[i] == len(parts)
        low, high = sorted([int(first[i]) % (len(parts) + 1), int(second[i]) % (len(parts) + 1)])
        want = ["".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])]
        assert pieces[3 * i:3 * i + 3].to_pylist() == want
        assert (p[i], m[i]) == (len(want[0]), len(want[1]))


def middle_row(doc, text):
    text, sha = text or "", hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(sha[8 * i:8 * i + 8], 16) for i in range(4))
    n = len(text)
    a, b = sorted([h1 % (n + 1), h2 % (n + 1)])
    pre, mid, suf = text[:a], text[a:b], text[b:]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc, n, "plain", None, None, text
    form = "spm" if h4 % 100 < 20 else "psm"
    return doc, n, form, a, b - a, f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}"


def test_transform_and_restore(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice(["<", "S>", "M", "P>", "a", "é", "漢", "😀", "\n", " "]) for _ in range(rnd.randint(0, 60))) for _ in range(200)]
    docs = clashing(docs_of(spark, texts).unionByName(odd_docs(spark)))
    for name in ("n", "form", "output", "h1", "prefix", "row_"):
        docs = docs.withColumn(name, docs.doc_id)
    made = fill_middle.transform(docs)
    assert made.columns == docs.columns + ["n_", "form_", "prefix_chars", "middle_chars", "output_"]
    rows = made.withColumn("back", fill_middle.restored(made.output_, made.form_)).collect()
    got = sorted([(r.doc_id, r.n_, r.form_, r.prefix_chars, r.middle_chars, r.output_) for r in rows], key=repr)
    assert got == sorted([middle_row(r.doc_id, r.text) for r in docs.collect()], key=repr)
    assert all(r.back == (r.text or "") for r in rows)
    assert {r.form_ for r in rows} == {"plain", "psm", "spm"}
    assert fill_middle.transform(docs.filter("false")).collect() == []


# ---- URLs

def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(host):]).group()


def verdict_of(url, rules, default):
    host, path = parts_of(url)
    fit = [(len(h.split(".")) if h else 0, len(p), h + p, v) for h, p, v in rules
           if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("block_rules, default", [(10**6, "allow"), (7, "block")])
def test_urls_equal_brute_force(spark, block_rules, default):
    rnd = random.Random(block_rules)
    labels, segments = ["com", "net", "a", "b", "www"], ["", "en", "e", "english", "x.html"]

    def some(pool, least):
        return [rnd.choice(pool) for _ in range(rnd.randint(least, 3))]
    rules = {(".".join(some(labels, 0)), "".join("/" + s for s in some(segments, 0))): rnd.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = ["http" + rnd.choice(["://", "s://", ":/"]) + ".".join(some(labels, 0)).upper() + "".join("/" + s for s in some(segments, 0))
            + rnd.choice(["", "/", "?q=/en/", "#a://b", ":80/"]) for _ in range(300)]
    urls += [None, "", "://", "http://a\nb/en/\nx", "http://" + "a." * 5000 + "com/" + "en/" * 5000, urls[0]]
    table = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3))
    given = spark.createDataFrame(rules + [("both.com", "/", "allow"), ("BOTH.com", "/", "block")], url_filter.RULES)
    judged = url_filter.judge(table.withColumn("host", table.url), given, default=default, block_rules=block_rules)
    assert judged.columns == [*table.columns, "host", "host_", "path", "rule", "verdict"]
    got = {r.page_id: (r.host_, r.path, r.rule, r.verdict) for r in judged.collect()}
    assert got == {i: verdict_of(u, rules, default) for i, u in enumerate(urls)}
    both = spark.createDataFrame([(1, "x://www.both.com/")], "page_id long, url string")
    assert url_filter.judge(both, given).first().verdict == "block"


def test_urls_without_rules_or_rows(spark):
    table = spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string")
    none = url_filter.rules_of(spark, [])
    assert [r.verdict for r in url_filter.judge(table, none).collect()] == ["allow"]
    assert url_filter.judge(table.filter("false"), none).collect() == []
    kept = url_filter.keep_allowed(clashing(table), url_filter.rules_of(spark, [("block", "a.com/")]))
    assert kept.columns == clashing(table).columns and kept.collect() == []
    with pytest.raises(Exception, match="allow or block"):
        url_filter.judge(table, url_filter.rules_of(spark, [("maybe", "com/")]))
