import itertools
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from yomisaku.functions import text

CASES = [
    ("東京駅周辺", "東 京 駅 周 辺", "東 京 駅 周 辺"),
    ("WordPress、foo-bar", "wordpress foo-bar", "wordpress foo bar"),
    ("ﾃｽﾄ①Ａ", "テ ス ト 1a", "テ ス ト 1a"),
    ("コーヒー・豆", "コ ー ヒ ー ・ 豆", "コ ー ヒ ー 豆"),
    ("人々", "人 々", "人 々"),
    ("Éan de… end.", "éan de... end.", "ean de end"),
    ("ｶﾞ x！y　z", "ガ x y z", "ガ x y z"),
    ("ＡＢＣ＠ｅｘ．ｊｐ", "abc@ex.jp", "abc ex jp"),
    ("が", "が", "が"),
    (None, "", ""),
    ("", "", ""),
]


def test_both_stages(spark):
    df = spark.createDataFrame([(c[0],) for c in CASES], "t string")
    rows = (df.select("t", text.prepare_index_text(F.col("t")).alias("one"))
            .select("t", "one", text.index_terms_text(F.col("one")).alias("two")).collect())
    assert [(r.t, r.one, r.two) for r in rows] == CASES


def plain_stage1(value):
    """The rule by kinds of characters: ideographs and kana stand alone, runs of kept ones are words, others part them."""
    def kind(c):
        if any(ord(c) in range(lo, hi + 1) for lo, hi in text.CJK_RANGES):
            return "alone"
        return "word" if unicodedata.category(c)[0] in "LN" or c in "_-.@/" else "gap"
    words = []
    for name, run in itertools.groupby(unicodedata.normalize("NFKC", value), kind):
        words += {"alone": list, "word": lambda r: ["".join(r).lower()], "gap": lambda r: []}[name](run)
    return " ".join(words)


def test_every_character_of_the_basic_plane_like_the_rule(spark):
    # With neighbours on either side, so that a character joining or splitting them shows. Left out: characters one of
    # the two Unicode versions does not know, and the capital sigma, whose lower form depends on its place.
    codes = [c for c in range(0x20, 0x10000) if not 0xD800 <= c <= 0xDFFF and c != 0x3A3
             and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    df = spark.createDataFrame([(f"a{chr(c)}b {chr(c)}",) for c in codes], "t string")
    rows = df.filter(~F.col("t").rlike(r"\p{Cn}")).select("t", text.prepare_index_text(F.col("t")).alias("p")).collect()
    wrong = [(r.t, r.p, plain_stage1(r.t)) for r in rows if r.p != plain_stage1(r.t)]
    assert len(rows) > 50000 and not wrong, (len(wrong), wrong[:20])


def test_safe_ranges_need_no_normalization():
    seconds = {int(parts[1], 16) for c in range(0x110000)
               if (parts := unicodedata.decomposition(chr(c)).split()) and len(parts) == 2 and parts[0][0] != "<"}

    def kept(s):
        return any(ch.isalnum() or ch in "_-.@/" for ch in s)
    for lo, hi in text.NFKC_SAFE_RANGES:
        for c in range(lo, hi + 1):
            form = unicodedata.normalize("NFKC", chr(c))
            assert form == chr(c) or not (kept(form) or kept(chr(c))), hex(c)
            assert not unicodedata.combining(chr(c)) and c not in seconds, hex(c)


def test_text_without_need_stays_out_of_python(spark):
    df = spark.createDataFrame([("plain ascii",), ("été 東京。",), ("１２",)], "t string")
    sent = df.select(F.col("t").rlike(text._NEEDS_NFKC)).collect()
    assert [r[0] for r in sent] == [False, False, True]


@pytest.mark.parametrize("profile,want", [("local", "éa 東 b"), ("hosted", "a 東 b")])
def test_query_profiles(spark, profile, want):
    df = spark.createDataFrame([("Éa東B",)], "t string")
    assert df.select(text.prepare_query_text(F.col("t"), profile)).first()[0] == want


def test_few_texts_of_a_batch_are_strings_at_a_time(monkeypatch):
    """Texts go back to Arrow after each HELD_CHARS, whatever the size of the batch."""
    monkeypatch.setattr(text, "HELD_CHARS", 10)
    sizes, real = [], pa.array
    monkeypatch.setattr(text.pa, "array", lambda values, kind: sizes.append(len(values)) or real(values, kind))
    texts = real(["1234567890", "12345", None, "", "1234", "123456", "x"], pa.string())
    assert text.map_texts(texts, str.upper).to_pylist() == ["1234567890", "12345", None, "", "1234", "123456", "X"]
    assert sizes == [1, 5, 1]
    assert text.map_texts(texts.slice(0, 0), str.upper).to_pylist() == [] and text.map_texts(texts.slice(2, 1), str.upper).to_pylist() == [None]
