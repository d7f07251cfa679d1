"""The other text operators on small tables: against brute force, an exact round trip, or planted cases."""

import base64
import datetime
import hashlib
import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import clashing, docs_of, odd_docs
from yomisaku.llm import bpe, chunk_dedup, decontaminate as dc, langid, licenses, line_dedup, pii, quality, warc
from yomisaku.llm.queries import vocabulary_path

RND = random.Random(5)
VOCABULARY = [f"{a}{b}" for a in ("al", "be", "co", "du", "ef", "gi") for b in ("ran", "mo", "tik", "sel", "vu")]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


# ---- decontamination

def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def contamination(text, items, size):
    words = bench_words(text)
    hit, found = set(), set()
    for item, body in items:
        ws = bench_words(body)
        m = min(size, len(ws))
        windows = {tuple(ws[i:i + m]) for i in range(len(ws) - m + 1)} if ws else set()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i:i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [200_000, 40])
def test_contamination_equals_brute_force(spark, block_words):
    rnd = random.Random(3)
    few = VOCABULARY[:4]  # so that matches overlap, nest and end early
    items = [(i, " ".join(rnd.choice(few) for _ in range(rnd.randint(1, 9)))) for i in range(30)] + [(90, ""), (91, "..."), (92, None)]
    texts = [" ".join(rnd.choice(few + ["X", "é"]) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, "", items[3][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = dc.report(dc.benchmark_spans(docs_of(spark, texts), bench, window=5, block_words=block_words)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert tuple(r)[1:] == contamination(texts[r.doc_id], items, 5)


def test_spans_are_cut_or_rows_go(spark):
    item = "Aa bb cc dd ee"
    texts = [f"one, two! {item.upper()}? three", item + " x" * 200, "clean", None]
    docs = clashing(docs_of(spark, texts))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r for r in dc.decontaminate(docs, bench, window=5).collect()}
    assert got[0].text == "one, two! ? three" and got[0].n_chars == len(got[0].text)
    assert got[1].text == texts[1] and got[2].text == "clean" and got[3].text is None and got[0].spans == "spans"
    assert got[1].n_chars == len(texts[1])
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, window=5, max_span=4).collect()}
    assert cut[1] == " x" * 200
    dropped = dc.decontaminate(docs, bench, window=5, drop=True)
    assert dropped.columns == docs.columns and sorted(r.doc_id for r in dropped.collect()) == [1, 2, 3]
    assert dc.decontaminate(docs, bench.filter("false")).count() == 4
    assert dc.benchmark_spans(docs.filter("false"), bench).count() == 0


# ---- quality

def quality_figures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [s for s in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", s)]
    windows = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for j in range(i, i + 5)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


def test_quality_figures(spark):
    few = VOCABULARY[:3]
    texts = [" ".join(RND.choice(few) for _ in range(RND.randint(0, 40))) for _ in range(40)] + [
        "a b c d\x1ce #*$%&|<>\n\n \na b c d\x1ce #*$%&|<>\nx", "é漢\U0001F600 " * 12, "a b c d e " * 3000, None, ""]
    got = quality.judge(docs_of(spark, texts)).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == quality_figures(texts[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_adapts_to_the_group(spark):
    plain = [prose(60) for _ in range(60)]
    code = [" ".join(w + ("|" if i % 2 else "") for i, w in enumerate(prose(60).split())) for _ in range(60)]
    rows = [(i, t, "en", "news", 1) for i, t in enumerate([*plain, code[0]])] + [(100 + i, t, "en", "tables", 1) for i, t in enumerate(code)]
    docs = spark.createDataFrame(rows, docs_of(spark, ["x"]).schema)
    kept = {r.doc_id for r in quality.keep_good(clashing(docs)).collect()}
    assert kept == {*range(60), *range(100, 160)}  # bars are usual in tables, not in news
    odd = odd_docs(spark)
    assert quality.judge(odd).count() == odd.count()
    assert quality.keep_good(odd.filter("false")).count() == 0


# ---- line dedup

def test_line_windows(spark):
    a, b, c, d = "first line", "second line", "third line", "fourth line"
    texts = ["\n".join([a, "", b, " " + c + "\t"]), "\n".join(["x", a, b, c, d, "y"]), "\n".join(["z", b, c, d]), "\n".join([a, b]), None, "",
             "\n".join(["same"] * 6)]
    docs = clashing(docs_of(spark, texts))
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    # Windows a-b-c and b-c-d of text 1 and 2: the later ones go, what covers them is merged.
    assert {i: r.text for i, r in got.items()} == {0: texts[0], 1: "x\nfourth line\ny", 2: "z", 3: texts[3], 4: None, 5: "", 6: "same\nsame\nsame"}
    assert got[1].n_cut_ == 3 and got[1].n_chars == len(got[1].text) and got[0].n_cut_ == 0 and got[0].n_cut == "n_cut"


def test_line_dedup_keeps_rows(spark):
    odd = clashing(odd_docs(spark))
    got = line_dedup.dedup_lines(odd)
    assert got.drop("n_cut_").exceptAll(odd).count() == 0 and got.count() == odd.count()
    assert line_dedup.dedup_lines(odd.filter("false")).count() == 0
    twice = docs_of(spark, [(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc")])
    assert sorted(r.text for r in line_dedup.dedup_lines(twice).collect()) == ["", "", "a\nb\nc"]


# ---- substring dedup

def test_repeated_passages_go(spark):
    words = [f"{RND.choice(VOCABULARY)}{RND.randint(0, 999)}" for _ in range(20_000)]
    passages = [" ".join(words[i:i + n]) for i, n in ((0, 60), (100, 80), (300, 200))]
    fresh = iter(words[1000:])

    def own(n):
        return " ".join(next(fresh) for _ in range(n))
    texts = [own(40) + "\n" + p + " " + own(37) for p in passages] + [own(RND.randint(1, 9)) + ", " + p + own(50) for p in passages for _ in range(4)]
    texts += [own(120) for _ in range(20)] + [None, "", passages[0]]
    docs = clashing(docs_of(spark, texts))
    got = {r.doc_id: r for r in chunk_dedup.dedup_chunks(docs).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        if i < 3 or 15 <= i < 37:
            assert r.text == t and r.n_cut_bytes_ == 0
        else:  # the middle of the passage is gone, what is a document's own stays
            p = passages[(i - 3) // 4] if i < 15 else passages[0]
            left = r.text.split()
            assert r.n_cut_bytes_ > 0.4 * len(p) and r.n_chars == len(r.text)
            assert " ".join(p.split()[28:32]) not in r.text
            assert set(t.split()) - set(p.split()) - set(left) <= {t.split()[k] for k in range(12)}
    odd = odd_docs(spark)
    assert chunk_dedup.dedup_chunks(odd).count() == odd.count() and chunk_dedup.dedup_chunks(odd.filter("false")).count() == 0


def test_gear_hash_is_rolling():
    raw = np.frombuffer(("shifted by any insertion, limits stay " * 9).encode(), np.uint8)
    plain = 0
    for i, h in enumerate(chunk_dedup.gear_hash(raw)):
        plain = (plain << 1) + int(chunk_dedup.GEAR[raw[i]]) & 0xFFFF
        assert int(h) == plain


# ---- byte-pair encoding

def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    letters = [chr(c) for r in ((0, 0x250), (0x300, 0x345), (0x370, 0x400), (0x1100, 0x1118), (0xAC00, 0xAC08), (0x2000, 0x2010)) for c in range(*r)]
    texts = ["".join(RND.choice(letters) for _ in range(RND.randint(0, 60))) for _ in range(400)]
    texts += ["It's WE'LL don't", "<|endoftext|> a<|startoftext|>b <|endoftext|", "aaaa " * 3000, "x" * 20_000, "ΑΣ ΣΑΣ Σ İ ﬁ", None, "", prose(500)]
    docs = clashing(docs_of(spark, texts))
    ids = {r.doc_id: r.ids for r in bpe.encode(docs, vocabulary_path()).collect()}
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path()).collect()}
    figures = {r.doc_id: r for r in bpe.round_trip(docs, vocabulary_path()).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(want, skip_special_tokens=False)
        assert ids[i] == want and back[i] == text
        assert tuple(figures[i])[1:] == (len(want), hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.encode(docs.filter("false"), vocabulary_path()).count() == 0


def test_forgetting_changes_nothing(monkeypatch):
    texts = [prose(50) for _ in range(30)]
    want = bpe.Vocabulary(vocabulary_path()).encode_block(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 700)
    book = bpe.Vocabulary(vocabulary_path())
    assert [book.encode_block([t])[0] for t in texts] == want


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 20)
    book = bpe.Vocabulary(vocabulary_path())
    rnd = random.Random(3)
    for _ in range(40):  # long pieces without a blank are forgotten, short ones go when the bound is reached
        book.encode_block(["".join(rnd.choice("漢字東京都日本語") for _ in range(3000)), " ".join(f"w{rnd.random()}" for _ in range(500))])
        for memo in (book.pieces, book.words_done):
            held = sum(4 * len(k) + len(v) + bpe.ENTRY for k, v in memo.known.items())
            assert held == memo.held < (1 << 20) + 500 * 400
            assert all(len(k) <= bpe.LONG for k in memo.known)


def test_decontamination_takes_one_worker_and_cuts_whole_letters(spark):
    item = " ".join(f"é{i}漢" for i in range(13))
    texts = [f"– vor ({item}) nach " + "wörter " * 600, item + " " + "ende " * 600, "anfang " * 600 + item, f"a {item} b… " + "mitte " * 600 + f"… {item}. z",
             "nothing here", "", None]
    want = [t if t is None else t.replace(item, "") for t in texts]
    cut = dc.decontaminate(docs_of(spark, texts, parts=1), spark.createDataFrame([("i", item)], "item_id string, text string"), max_span=12, drop=True)
    assert {r.doc_id: r.text for r in cut.collect()} == dict(enumerate(want))
    plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_a_worker_remembers_little_and_what_is_asked_for_again(monkeypatch):
    assert 2 * bpe.REMEMBERED <= 48 << 20
    monkeypatch.setattr(bpe, "REMEMBERED", 1 << 16)
    book, merged = bpe.Vocabulary(vocabulary_path()), []
    merge = book.merge
    book.merge = lambda words: merged.extend(words) or merge(words)
    for i in range(40):  # both generations together stay within the bound and a block
        book.encode_block(["common words " + " ".join(f"x{i}y{j}" for j in range(60))])
        for memo in (book.pieces, book.words_done):
            both = memo.known | memo.earlier
            assert sum(4 * len(k) + len(v) + bpe.ENTRY for k, v in both.items()) < (1 << 16) + 2 * 62 * 400
    assert merged.count("common") == 1 and merged.count("words") == 1


def test_one_worker_encodes_and_decodes(spark):
    texts = [prose(20), None, "", "aaaa " * 300, "<|endoftext|> a", *[prose(3) for _ in range(150)]]
    docs = clashing(docs_of(spark, texts, parts=1))
    apart = bpe.decode(bpe.encode(docs, vocabulary_path()), vocabulary_path())
    together = bpe.encode_decode(docs, vocabulary_path())
    assert together.schema == apart.schema and sorted(together.collect()) == sorted(apart.collect())
    plan = corpus_pipeline.tokenize(spark, docs, "")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("many, seed", [(1, 1), (10**9, 2), (24, 3)])
def test_merging_by_arrays_and_by_places(monkeypatch, many, seed):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    monkeypatch.setattr(bpe, "MANY", many)
    rnd = random.Random(seed)
    texts = [" ".join("".join(rnd.choice("aabtheringoſé") for _ in range(rnd.randint(1, 30))) for _ in range(40)) for _ in range(60)]
    ids = bpe.Vocabulary(vocabulary_path()).encode_block(texts)
    for t, got in zip(texts, ids):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


# ---- WARC

PAGE_ROWS = [(4, "http://a/1", "<p>same</p>"), (2, "http://a/2 b\n", "<p>same</p>"), (3, None, "é漢"), (9, "http://b/", None), (7, "http://c/", ""),
             (None, "http://d/", "<p>same</p>"), (None, "http://e/", "alone"), (11, "http://x/", "x" * 300_000)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGE_ROWS, "page_id long, url string, html string").withColumn("payload", F.lit("clash")).repartition(3)


def test_appending_adds_and_overwriting_replaces(spark, tmp_path):
    path = str(tmp_path / "many")

    def one(i):
        return spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>")], "page_id long, url string, html string")

    def there():
        return sorted(r.record_id for r in warc.read_warc(spark, path).collect())
    warc.write_pages(one(1), path)
    warc.write_pages(one(2), path)
    assert there() == ["urn:x-page:1", "urn:x-page:2"]
    warc.write_pages(one(3), path, mode="overwrite")
    assert there() == ["urn:x-page:3"]
    warc.write_pages(one(4), path)
    assert there() == ["urn:x-page:3", "urn:x-page:4"]


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_archives_come_back(spark, pages, tmp_path, compression):
    path = str(tmp_path / "w")
    warc.write_pages(pages, path, compression=compression)
    got = warc.read_warc(spark, path).collect()
    assert len(got) == len(PAGE_ROWS)
    by_page = {r.record_id: r for r in got}
    assert by_page["urn:x-page:2"].record_type == "response" and by_page["urn:x-page:2"].target_uri == "http://a/2%20b%0A"
    assert by_page["urn:x-page:4"].record_type == "revisit" and by_page["urn:x-page:4"].refers_to == "urn:x-page:2"
    assert by_page["urn:x-page:4"].payload is None and by_page["urn:x-page:4"].payload_bytes == 11
    assert by_page["urn:x-page:9"].refers_to == "urn:x-page:7"  # a missing page is an empty payload
    assert by_page["urn:x-page:11"].payload == b"x" * 300_000
    assert by_page["urn:x-page:3"].payload_digest == base64.b32encode(hashlib.sha1("é漢".encode()).digest()).decode()
    assert sorted(r.record_type for r in got if "x-content" in r.record_id) == ["response", "revisit"]
    assert warc.read_warc(spark, path, "none").filter("payload is not null").count() == 0
    narrow = warc.read_warc(spark, path).filter("record_type = 'revisit' and target_uri like 'http://a%'")
    assert [r.record_id for r in narrow.collect()] == ["urn:x-page:4"]
    assert "Filter" not in narrow._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0]  # decided while reading
    assert warc.read_warc(spark, path).filter("record_type in ('response') and refers_to is null and target_uri is null").count() == 1


def test_small_payloads_stay_responses(spark, pages):
    kinds = Counter(r.record_type for r in warc.as_records(pages, min_bytes=12).select("record_type").collect())
    assert kinds == {"response": len(PAGE_ROWS)}
    assert warc.archive_report(pages.filter("false")).count() == 0


def test_foreign_archives(spark, tmp_path):
    import gzip
    one = warc.record_bytes("urn:x-page:1", "response", "http://a/", "2024-01-01T00:00:00Z", None, b"one")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:i>\r\nContent-Type: application/warc-fields\r\nContent-Length: 5\r\n\r\na: b\n\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(one))
    (tmp_path / "b.warc").write_bytes(info + one)
    got = warc.read_warc(spark, str(tmp_path)).orderBy("record_id").collect()
    assert [(r.record_id, r.record_type, bytes(r.payload)) for r in got] == [
        ("urn:i", "warcinfo", b"a: b\n")] * 2 + [("urn:x-page:1", "response", b"one")] * 2
    (tmp_path / "b.warc").write_bytes(one.replace(b"\r\n\r\none", b"\r\n\r\ntwo"))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_warc(spark, str(tmp_path), "verify").collect()


# ---- language

def test_mixed_languages(spark):
    kinds = {"aa": "abcde", "bb": "fghij", "ru": "абвгд"}

    def text(lang, n, seed):
        rnd = random.Random(seed)
        return " ".join("".join(rnd.choice(kinds[lang]) for _ in range(rnd.randint(2, 7))) for _ in range(n))
    rows = [(i, text(lang, 60, i), lang, "s", 1) for i, lang in enumerate(["aa", "bb", "ru"] * 20)] + [(900, None, "aa", "s", 1), (901, "zz", None, "s", 1)]
    docs = spark.createDataFrame(rows, docs_of(spark, ["x"]).schema)
    model = langid.learn(docs)
    assert model.langs == ["aa", "bb", "ru"]
    mixed = text("aa", 40, 1) + ". " + text("ru", 12, 2) + " / " + text("bb", 9, 3)
    tests = docs_of(spark, [mixed, text("bb", 3, 4), "12 !?", "", None, text("ru", 5000, 5)])
    got = {r.doc_id: r for r in langid.identify(clashing(tests), model).collect()}
    assert [s.lang for s in got[0].spans] == ["aa", "ru", "bb"] and got[0].lang_pred == "aa" and 0.5 < got[0].score < 0.8
    assert mixed[got[0].spans[1].start:got[0].spans[1].end] == text("ru", 12, 2)
    assert [got[i].lang_pred for i in range(1, 6)] == ["bb", "und", "und", "und", "ru"] and got[5].score == 1.0
    nothing = langid.learn(docs.filter("false"))
    assert {r.lang_pred for r in langid.identify(tests, nothing).collect()} == {"und"}
    assert langid.identify(odd_docs(spark), model).count() == odd_docs(spark).count()


def test_more_languages_than_a_block(spark):
    rnd = random.Random(8)
    words = {f"l{i:03d}": ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(300)}
    rows = [(i, " ".join(w * (2 if i < 260 else 1)), lang, "s", 1) for i, (lang, w) in enumerate(words.items())]
    docs = spark.createDataFrame(rows, docs_of(spark, ["x"]).schema)
    model = langid.learn(docs)
    assert model.langs == sorted(words)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got == {i: lang for i, _, lang, _, _ in rows}


def test_scripts_choose_candidates_whatever_the_amounts(spark):
    """A language with very many letters and one with few: neither script nor amount may give a word to the wrong one."""
    much, few = "молоко река ", "the quick brown fox jumps over a lazy dog "
    docs = docs_of(spark, ["x"]).limit(0).union(spark.createDataFrame(
        [(i, much * 20_000, "ru", "s", 1) for i in range(20)] + [(50, few * 17, "en", "s", 1)], docs_of(spark, ["x"]).schema))
    model = langid.learn(docs)
    unseen = np.exp(model.logp.min(0))
    assert model.langs == ["en", "ru"] and np.allclose(unseen[0], unseen[1])
    texts = ["щупальце эхолот ёжик цыплята", "wizard hymn", "щука wizard", "молоко the ελα"]
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, texts), model).collect()}
    assert [(got[i].lang_pred, got[i].score) for i in range(2)] == [("ru", 1.0), ("en", 1.0)]
    assert [s.lang for s in got[2].spans] == ["ru", "en"] and [s.lang for s in got[3].spans][:2] == ["ru", "en"]


def test_language_by_plain_steps(spark):
    """Counting, scores, best path, share and spans, one word and one language at a time."""
    rnd = random.Random(4)
    letters = {"aa": "abcdeé", "bb": "cdefgh", "ru": "абвгд", "el": "αβγa"}

    def some(lang, n):
        return " ".join("".join(rnd.choice(letters[lang]) for _ in range(rnd.randint(1, 6))) for _ in range(n))
    known = [(lang, some(lang, 30)) for lang in letters for _ in range(3)]
    texts = [" ".join(some(rnd.choice(list(letters)), rnd.randint(1, 8)) for _ in range(rnd.randint(1, 5))) for _ in range(40)] + ["", "7", "aб"]
    names = sorted(letters)

    def words(text):  # letters with their place, script and bucket
        got = langid.Letters(pa.array([text]))
        ends = [*got.starts[1:].tolist(), len(got.at)]
        return [(got.at[a:b].tolist(), got.bucket[a:b].tolist(), int(got.script[a])) for a, b in zip(got.starts.tolist(), ends)]
    grams, scripts = {x: Counter() for x in names}, {x: Counter() for x in names}
    for lang, text in known:
        for _, buckets, script in words(text):
            grams[lang].update(buckets)
            scripts[lang][script] += len(buckets)

    def score(lang, word):
        writes = [x for x in names if scripts[x][word[2]] / sum(scripts[x].values()) >= langid.SCRIPT_SHARE] or names
        total = sum(grams[lang].values())
        return sum(np.log(0.99 * grams[lang][b] / total + 0.01 / langid.BUCKETS) for b in word[1]) if lang in writes else -np.inf

    def best_path(found):
        paths = {x: score(x, found[0]) for x in names}
        for word in found[1:]:
            paths = {x: max(s - (langid.SWITCH if x != y else 0) for y, s in paths.items()) + score(x, word) for x in names}
        return max(paths.values())
    docs = spark.createDataFrame([(i, t, x, "s", 1) for i, (x, t) in enumerate(known)], docs_of(spark, ["x"]).schema)
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, texts), langid.learn(docs)).collect()}
    for i, text in enumerate(texts):
        found = words(text)
        labels = [next(s.lang for s in got[i].spans if s.start <= at[0] and at[-1] < s.end) for at, _, _ in found]
        assert [x for x, _ in groupby(labels)] == [s.lang for s in got[i].spans]
        if found:  # of paths that tie any will do
            changes = sum(x != y for x, y in zip(labels, labels[1:]))
            assert sum(map(score, labels, found)) - langid.SWITCH * changes == pytest.approx(best_path(found), abs=1e-2), text
        mass = Counter()
        for word, x in zip(found, labels):
            mass[x] += len(word[0])
        best = min(mass, key=lambda x: (-mass[x], x)) if mass else "und"
        assert (got[i].lang_pred, got[i].score) == (best, pytest.approx(mass[best] / max(1, sum(mass.values()))))


def test_viterbi_equals_plain_programming():
    rng = np.random.default_rng(1)
    scores = rng.normal(0, 4, (300, 3)).astype(np.float32)
    first = np.array([0, 0, 5, 6, 120, 300])
    got = langid.viterbi(scores, first, 3.0)
    for a, b in zip(first[:-1], first[1:]):
        best, back = scores[a].copy() if b > a else None, []
        for t in range(a + 1, b):
            move = best[:, None] - 3.0 * (1 - np.eye(3))
            back.append(move.argmax(0))
            best = move.max(0) + scores[t]
        if b > a:
            path = [int(best.argmax())]
            for step in reversed(back):
                path.append(int(step[path[-1]]))
            assert got[a:b].tolist() == path[::-1]


# ---- licences

def test_licences(spark):
    apache = licenses.TEMPLATES[1][1]
    texts = ["prose\n" + licenses.TEMPLATES[0][1], "# " + apache.replace(". ", ".\n# "), "Released under the MIT licence.", prose(200), None, "",
             "intro\n\nThis work is licensed under\na Creative Commons Attribution 4.0\nInternational License.\n\nend"]
    got = {r.doc_id: r for r in licenses.scan(clashing(docs_of(spark, texts))).collect()}
    assert [got[i].license for i in range(7)] == ["Apache-2.0", "Apache-2.0", None, None, None, None, "CC-BY-4.0"]
    assert got[0].dice == 1.0 and got[1].dice > 0.95 and got[4].n_units == 0 and got[4].licenses == ""
    loose = {r.doc_id: r.license for r in licenses.scan(docs_of(spark, texts), dice=0.5).collect()}
    assert loose[2] == "MIT"
    assert licenses.scan(odd_docs(spark)).count() == odd_docs(spark).count()
    assert licenses.scan(docs_of(spark, texts), [("one", "word")]).filter("license is not null").count() == 0


def test_headers_of_the_gnu_family_and_short_full_texts(spark):
    gnu = ("This {} is free software{} you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\n"
           "the Free Software Foundation{} either version {} of the License, or\n(at your option) any later version.")
    headers = {"GPL-2.0": ("program", ";", "General Public License", ";", "2"), "GPL-3.0": ("program", ":", "General Public License", ",", "3"),
               "LGPL-2.0": ("library", ";", "Library General Public License", ";", "2"),
               "LGPL-2.1": ("library", ";", "Lesser General Public License", ";", "2.1"),
               "LGPL-3.0": ("library", ":", "Lesser General Public License", ",", "3"),
               "AGPL-3.0": ("program", ":", "Affero General Public License", ",", "3")}
    texts = [prose(30) + "\n\n" + gnu.format(*h) + "\n\n" + prose(30) for h in headers.values()]
    full = {name: text for name, text in licenses.TEMPLATES if len(text) > 600}
    assert set(full) == {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"}
    texts += [text.replace(". ", ".\n\n").replace(": ", ":\n\n") for text in full.values()]
    got = {r.doc_id: r for r in licenses.scan(docs_of(spark, texts)).collect()}
    assert [got[i].license for i in range(len(texts))] == [*headers, *full]
    # The SQL has units of up to 400 words, so that what a template may match must not be longer.
    assert all((len(licenses.normal_words(t)) - 1) * (2 - licenses.DICE) / licenses.DICE <= 399 for _, t in licenses.TEMPLATES)


# ---- personal data

def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def network(kind, left, right, lefts, rights, key, beside=""):
    for i in range(pii.ROUNDS):
        other = right if i % 2 == 0 else left
        text = "|".join([key, kind, beside, str(lefts), str(rights), str(i), str(other)])
        add = int(hashlib.sha256(text.encode()).hexdigest()[:15], 16)
        if i % 2 == 0:
            left = (left + add) % lefts
        else:
            right = (right + add) % rights
    return left, right


def test_pseudonyms_equal_plain_network(spark):
    card = "4012888888881881"
    texts = [f"pay {card} now, or 4012-8888 8888-1881; from 10.0.200.7 on 2024-02-29 (29.02.2024, 02/29/2024)",
             "call +1 (212) 555-0187 or 212.555.0187, ssn 078-05-1120, mail Ann.x+7@Host.example.org, DE89370400440532013000",
             "no: 4012888888881882 999-99-9999 256.1.1.1 2023-02-29 a4012888888881881 555-0187 token4012888888881881x", None, ""]
    got = {r.doc_id: r for r in pii.pseudonymize(clashing(docs_of(spark, texts)), "k").collect()}
    l, r = network("card", int(card[1:8]), int(card[8:15]), 10 ** 7, 10 ** 7, "k")
    body = card[0] + f"{l:07d}{r:07d}"
    made = next(body + d for d in "0123456789" if luhn(body + d))
    day = (datetime.date(2024, 2, 29) - datetime.date(1900, 1, 1)).days
    l, r = network("date", day // pii.DAYS_RIGHT, day % pii.DAYS_RIGHT, pii.DAYS_LEFT, pii.DAYS_RIGHT, "k")
    date = datetime.date(1900, 1, 1) + datetime.timedelta(l * pii.DAYS_RIGHT + r)
    l, r = network("ip", 10 * 256, 200 * 256 + 7, 65536, 65536, "k")
    assert got[0].text == (f"pay {made} now, or {made[:4]}-{made[4:8]} {made[8:12]}-{made[12:]}; from {l // 256}.{l % 256}.{r // 256}.{r % 256}"
                           f" on {date} ({date:%d.%m.%Y}, {date:%m/%d/%Y})")
    assert got[0].n_replaced_ == 6 and got[0].n_chars == len(got[0].text)
    found = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3}).(\d{3}).(\d{4}), ssn (\d{3}-\d\d-\d{4}),"
                         r" mail ([a-z]{3}\.[a-z]\+\d)@Host.example.org, (DE\d{20})", got[1].text).groups()
    assert found[:3] == found[3:6] and found[6] != "078-05-1120" and got[1].n_replaced_ == 5
    iban = found[8]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    l, r = network("mail digits", 0, 7, 1, 10, "k")
    assert found[7].endswith(f"+{r}")
    assert got[2].text == texts[2] and got[2].n_replaced_ == 0 and got[3].text is None and got[4].text == ""


def test_blanks_in_ibans_and_written_forms_of_dates(spark):
    plain = ["DE89370400440532013000", "NL91ABNA0417164300", "AT611904300234573201", "GB82WEST12345698765432", "MT84MALT011000012345MTLCAST001S"]
    blanked = [" ".join(i[k:k + 4] for k in range(0, len(i), 4)) for i in plain]
    wrong = "DE12 4012 8888 8888 1881 ABCD EF"  # no IBAN, yet a card
    dates = ["2024-01-02", "2024-01-02T10:00:00Z", "2024-01-02t1000", "2.1.2024", "02.01.2024", "1/2/2024", "01/02/2024", "2.01.2024", "30.2.2024"]
    left = ["2024-01-02Tea", "1.2.2024.5", "DE88 3704 0044 0532 0130 00", "x2.1.2024"]
    texts = [f"to {i} EUR 5" for i in [*plain, *blanked]] + [wrong] + [f"on {d}, so" for d in dates] + left
    got = {r.doc_id: r for r in pii.pseudonymize(docs_of(spark, texts), "k").collect()}
    ibans = [got[i].text[3:-6] for i in range(10)]
    for i, b in enumerate(blanked):
        new = ibans[i]
        assert new != plain[i] and int("".join(str(int(c, 36)) for c in new[4:] + new[:4])) % 97 == 1
        assert ibans[5 + i] == " ".join(new[k:k + 4] for k in range(0, len(new), 4)) and len(ibans[5 + i]) == len(b)
    card = got[10].text[5:24]
    assert got[10].text == f"DE12 {card} ABCD EF" and card != "4012 8888 8888 1881" and luhn(card.replace(" ", ""))
    day = datetime.date.fromisoformat(got[11].text[3:13])
    assert day != datetime.date(2024, 1, 2)
    short, us = f"{day.day}.{day.month}.{day.year}", f"{day.month}/{day.day}/{day.year}"
    want = [f"{day}", f"{day}T10:00:00Z", f"{day}t1000", short, f"{day:%d.%m.%Y}", us, f"{day:%m/%d/%Y}", short, "30.2.2024"]
    assert [got[11 + i].text for i in range(9)] == [f"on {d}, so" for d in want]
    assert [got[i].n_replaced for i in range(20)] == [1] * 19 + [0]
    assert [got[20 + i].text for i in range(4)] == left and all(got[20 + i].n_replaced == 0 for i in range(4))


def test_long_mail_names_are_permuted_whole(spark):
    letters = "maximilianaalexandrinawilhelminehohenloheschilling"  # 50: blocks of 24, 24 and 2
    digits = "".join(str(i * 7 % 10) for i in range(30))

    def plain(kind, s, base, alphabet, beside):
        out = ""
        for i in range(0, len(s), 24):
            part = s[i:i + 24]
            half = len(part) // 2
            value = [int("0" + p, base) for p in (part[:half], part[half:])]
            sizes = [base ** half, base ** (len(part) - half)]
            for v, k, n in zip(network(kind, *value, *sizes, "k", beside + (f"/{s[:i]}" if i else "")), (half, len(part) - half), sizes):
                out += "".join(alphabet[v // base ** e % base] for e in range(k - 1, -1, -1))
        return out
    base26 = "0123456789abcdefghijklmnop"
    coded = letters.translate(str.maketrans("abcdefghijklmnopqrstuvwxyz", base26))
    shown = plain("mail letters", coded, 26, "abcdefghijklmnopqrstuvwxyz", "")
    mails = [f"{letters[:20]}.{letters[20:]}@a.org", f"{digits}@a.org"] + [f"{letters}{a}{b}@a.org" for a in base26[10:] for b in base26[10:]]
    got = {r.doc_id: r.text for r in pii.pseudonymize(docs_of(spark, mails), "k").collect()}
    assert got[0] == f"{shown[:20]}.{shown[20:]}@a.org"
    assert got[1] == plain("mail digits", digits, 10, "0123456789", "") + "@a.org"
    assert len(set(got.values())) == len(mails) and all(len(got[i]) == len(m) for i, m in enumerate(mails))
    tails = [got[i].split("@")[0][24:] for i in range(2, len(mails))]
    assert all(t[:26] != letters[24:50] for t in tails)


def test_pseudonyms_are_permutations(spark):
    dates = [str(datetime.date(1900, 1, 1) + datetime.timedelta(i * 9)) for i in range(8000)]
    cards = []
    for i in range(3000):
        body = f"4{i * 7919:014d}"
        cards.append(next(body + d for d in "0123456789" if luhn(body + d)))
    got = pii.pseudonymize(docs_of(spark, [*dates, *cards]), "k").collect()
    assert all(r.n_replaced == 1 for r in got)
    out = [r.text for r in got]
    assert len(set(out)) == len(out) and all(luhn(t) for t in out if "-" not in t)
    assert all(datetime.date.fromisoformat(t) for t in out if "-" in t)
    other = {r.doc_id: r.text for r in pii.pseudonymize(docs_of(spark, dates[:50]), "another").collect()}
    assert sum(other[r.doc_id] == r.text for r in got if r.doc_id < 50) < 5
    odd = odd_docs(spark)
    assert pii.pseudonymize(clashing(odd), "k").drop("n_replaced_").exceptAll(clashing(odd)).count() == 0


def test_dates_fill_their_range():
    assert pii.DAYS_LEFT * pii.DAYS_RIGHT == (datetime.date(2099, 12, 31) - datetime.date(1900, 1, 1)).days
