"""The n-gram join against comparing every pair, and components against a union-find."""

import random
import re

import pytest

from tests.llm.helpers import clashing, docs_of, odd_docs
from yomisaku.llm import ngram_join
from yomisaku.llm.components import components


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k, num, den):
    sets = [sets_of(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def crowd(seed, copies):
    """Chains of near copies, a large group of them, a passage that many texts share, exact copies and short texts."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]

    def prose(n):
        return [rnd.choice(vocabulary) for _ in range(n)]

    def edited(words, edits):
        words = list(words)
        for _ in range(edits):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary) + "x"
        return words
    texts = [prose(rnd.randint(1, 120)) for _ in range(60)]
    base = prose(110)
    texts += [edited(base, rnd.randint(0, 4)) for _ in range(copies)]
    chain = prose(90)
    for _ in range(12):
        chain = edited(chain, 1)
        texts.append(chain)
    passage = prose(50)
    texts += [passage + prose(rnd.randint(0, 12)) for _ in range(copies)]
    texts += [prose(30) + passage + prose(30) for _ in range(copies)]
    texts += [rnd.choice(texts) for _ in range(40)]
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return [(i, " ".join(t).title() if rnd.random() < .2 else "\n".join([" ".join(t), ""])) for i, t in zip(ids, texts)]


@pytest.mark.parametrize("seed, copies, hot, k, num", [(1, 60, 16, 4, 85), (2, 40, 2, 4, 85), (3, 50, 4, 5, 80), (4, 30, 1000, 4, 85)])
def test_equals_all_pairs(spark, monkeypatch, seed, copies, hot, k, num):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = crowd(seed, copies)
    got = ngram_join.near_duplicates(docs_of(spark, rows, 5), k, num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, num, 100)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = ngram_join.near_duplicates(clashing(docs)).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, 4, 85, 100)
    kept = ngram_join.keep_first(clashing(docs))
    assert kept.columns == clashing(docs).columns
    # Whole repetitions are one row; unrelated texts of one id both stay.
    assert sorted((repr(r.doc_id) for r in kept.collect() if r.text and r.text.strip())) == ["4", "5", "5", "6", "None"]


def test_one_row_of_each_component_stays(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, a + " more"), (None, "no id here"), (None, "no id here"), (7, None), (7, " ")]
    kept = ngram_join.keep_first(docs_of(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted([(1, a), (1, b), (None, "no id here"), (7, None), (7, " ")], key=repr)


def test_texts_that_a_polynomial_cannot_tell_apart(spark):
    """A Thue-Morse word and its complement differ everywhere, yet agree under any polynomial modulo a power of two."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba")))]
    got = ngram_join.near_duplicates(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2)]


@pytest.mark.parametrize("k, num, copies", [(4, 85, 150), (5, 80, 150)])
def test_large_group_beyond_the_threshold(spark, k, num, copies):
    """Copies with so many edits that most are not similar to the common text, some to each other, with a passage in all."""
    rnd = random.Random(k)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(copies):
        text = list(words)
        for at in rnd.sample(range(0, 120, 9), rnd.randint(0, 7)):
            text[at] = rnd.choice("xyz") if i % 3 else f"x{rnd.random()}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(words[40:80] + [f"v{rnd.randrange(300)}" for _ in range(rnd.randint(0, 40))])) for i in range(copies)]
    got = ngram_join.near_duplicates(docs_of(spark, rows, 4), k, num).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows, k, num, 100)


def test_empty_table(spark):
    empty = docs_of(spark, [(1, "a")]).filter("false")
    assert ngram_join.near_duplicates(empty).collect() == []
    assert ngram_join.keep_first(empty).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 100), (7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long").repartition(4)).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 90, 90: 90, 95: 90, 200: 200, 201: 200}
    assert components(spark.createDataFrame([(3, 3)], "u long, v long")).collect() == []
