"""The pipeline against brute force on a small corpus."""

import itertools
import math
import random
import re

import pytest

import corpus_pipeline
from tests.llm.helpers import DOCS, clashing, odd_docs
from tests.llm.test_join import brute
from tests.llm.test_text_operators import bench_words, quality_figures
from yomisaku.llm.queries import vocabulary_path


def fences(rates):
    """Per signal the least and the most that a group of rated texts allows by itself."""
    out = {}
    for name, least, spreads in (("symbols", .05, 3), ("lines", .3, 3), ("repeats", .1, 3), ("length", None, 6)):
        values = sorted(r[name] for r in rates)
        low, high = (values[max(0, math.ceil(p * len(values)) - 1)] for p in (.25, .75))
        if least is None:
            out[name] = (low - (spreads * (high - low) + 2), high + (spreads * (high - low) + 2))
        else:
            out[name] = (-1, max(least, high + spreads * (high - low)))
    return out


def drawn(own, n, above):
    return {k: tuple((n * x + 5 * y) / (n + 5) for x, y in zip(own[k], above[k])) for k in own}


def good(rows):
    """The rows (doc, text, lang, source) that the base rules and the fences of language and source keep."""
    rated = []
    for row in rows:
        text = row[1] or ""
        n, chars, symbols, dup_lines, repeats, failed = quality_figures(text)
        if not failed:
            lines = [s for s in text.split("\n") if s.strip(" \t\r\x0b\x0c")]
            rated.append((row, {"symbols": symbols / max(chars, 1), "lines": dup_lines / max(len(lines), 1), "repeats": repeats / n, "length": chars / n}))
    kept = []
    corpus = fences([r for _, r in rated])
    for row, rate in rated:
        language = [r for x, r in rated if x[2] == row[2]]
        group = [r for x, r in rated if x[2:] == row[2:]]
        limits = drawn(fences(group), len(group), drawn(fences(language), len(language), corpus))
        if all(low <= rate[k] <= high for k, (low, high) in limits.items()):
            kept.append(row[:2])
    return kept


def without_passages(text, items):
    """The text without runs of 13 words or more that lie in benchmark windows, or None if a twentieth of it does."""
    found = list(re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)})))
    words, hit = [m.group() for m in found], set()
    for item in items:
        ws = bench_words(item)
        m = min(13, len(ws))
        windows = {tuple(ws[i:i + m]) for i in range(len(ws) - m + 1)}
        for i in range(len(words) - m + 1):
            if tuple(words[i:i + m]) in windows:
                hit |= set(range(i, i + m))
    if hit and 20 * len(hit) >= len(words):
        return None
    runs = [list(g) for _, g in itertools.groupby(sorted(hit), key=lambda x, c=itertools.count(): x - next(c))]
    for run in reversed(runs):
        if len(run) >= 13:
            text = text[:found[run[0]].start()] + text[found[run[-1]].end():]
    return text


def without_repeated_lines(rows):
    seen, out = {}, []
    for doc, text in sorted(rows):
        lines = [(i, s.strip(" \t\r\x0b\x0c")) for i, s in enumerate(text.split("\n"))]
        lines = [x for x in lines if x[1]]
        cut = set()
        for k in range(len(lines) - 2):
            window = tuple(s for _, s in lines[k:k + 3])
            first = seen.setdefault(window, (doc, k))
            if first != (doc, k):
                cut |= {i for j, (i, _) in enumerate(lines[k:k + 3]) if first[0] != doc or k + j >= first[1] + 3}
        left = "\n".join(s for i, s in enumerate(text.split("\n")) if i not in cut)
        if left.strip() or not cut:
            out.append((doc, left))
    return out


def corpus():
    rnd = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("al", "be", "co", "du") for b in ("ran", "mo", "tik") for c in ("", "s", "en", "ly", "a")]

    def line(n=9):
        return " ".join(rnd.choice(vocabulary) for _ in range(n))

    def page(lines):
        return "\n".join(line() for _ in range(lines))
    items = [line(20), line(13), line(6)]
    texts = [page(rnd.randint(1, 8)) for _ in range(45)] + [page(3) + " #" * i for i in range(1, 7)]
    texts += [texts[3], texts[4], texts[5].replace(" ", "  "), "few words", None, "", "#*$ " * 30, (line(7) + "\n") * 9]
    block = page(4)
    texts += [page(3) + "\n" + block + "\n" + page(2) for _ in range(4)]
    near = line(120).split()
    for _ in range(6):
        edited = list(near)
        edited[rnd.randrange(120)] = "other"
        texts.append(" ".join(edited))
    texts += [line(30) + " " + items[0] + " " + line(30), line(400) + " " + items[0], line(200) + " " + items[0].upper() + "!\n" + line(290), items[1], items[2].upper() + "? " + line(20)]
    return texts, items


def place(i):
    """A large group, a small one, and two of no source or language."""
    return [("en", "s0"), ("en", "s0"), ("en", "s0"), ("en", "s1"), ("en", None), (None, "s0")][i % 6]


@pytest.fixture
def folder(spark, tmp_path):
    texts, items = corpus()
    rows = [(i, t, *place(i), None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_pipeline_equals_brute_force(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(vocabulary_path())
    texts, items = corpus()
    rows = good([(i, t, *place(i)) for i, t in enumerate(texts)])
    rows = without_repeated_lines(rows)
    root = {doc: component for doc, _, component in brute(rows, 5, 80, 100)}
    rows = [(d, t) for d, t in rows if root[d] == d]
    before = rows
    rows = [(d, left) for d, t in rows for left in [without_passages(t, items)] if left is not None]
    assert len(rows) < len(before) and set(rows) - set(before)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert 30 < len(rows) < len(texts) - 12
    assert sorted(got) == [d for d, _ in rows]
    for d, t in rows:
        want = library.encode(t, add_special_tokens=False).ids
        assert got[d].ids == want and got[d].n_tokens == len(want)
        assert got[d].decoded == library.decode(want, skip_special_tokens=False)
        assert re.sub(r"\s", "", t) != "" or not want


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, docs.filter("false"), folder).count() == 0, name
        odd = clashing(odd_docs(spark)).unionByName(clashing(odd_docs(spark)))
        kept = stage(spark, odd, folder)
        assert kept.columns == odd.columns and kept.count() <= odd.count(), name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "decontamination", "tokens"]
