import pytest

from yomisaku.operators.query import clause_slots, compile_queries

CASES = {
    "the": [("prefix", ["the"])],
    '"of the"': [("phrase", ["of", "the"])],
    'thha "of the"': [("prefix", ["thha"]), ("phrase", ["of", "the"])],
    "éan": [("exact", ["ean"])],
    '"de la': [("prefix", ["de"]), ("prefix", ["la"])],
    "%%% ***": [],
    "": [],
    None: [],
    "foo-bar": [("phrase_prefix", ["foo", "bar"])],
    "東京駅": [("phrase", ["東", "京", "駅"])],
    "WordPress入門": [("prefix", ["wordpress"]), ("exact", ["入"]), ("exact", ["門"])],
    "ﾃｽﾄ": [("phrase", ["テ", "ス", "ト"])],
    "テスト": [("phrase", ["テ", "ス", "ト"])],
    "・": [("exact", [])],
    "-": [("prefix", [])],
    "foo(bar)": [("prefix", ["foo"]), ("prefix", ["bar"])],
    "東(京": [("exact", ["東"]), ("exact", ["京"])],
    '"a" b "c d': [("exact", ["a"]), ("prefix", ["b"]), ("prefix", ["c"]), ("prefix", ["d"])],
    'x "" y': [("prefix", ["x"]), ("prefix", ["y"])],
    "a　b": [("prefix", ["a"]), ("prefix", ["b"])],
    '"東京 Tower"': [("phrase", ["東", "京", "tower"])],
    "x.y入": [("phrase_prefix", ["x", "y"]), ("exact", ["入"])],
}


def test_compile(spark):
    searches = spark.createDataFrame(list(enumerate(CASES)), "query_id bigint, q string")
    got = {i: [] for i in range(len(CASES))}
    for r in compile_queries(searches).orderBy("query_id", "clause_no").collect():
        assert r.clause_no == len(got[r.query_id])
        got[r.query_id].append((r.kind, r.terms))
        assert r.n_clauses == len(list(CASES.values())[r.query_id])
    assert {q: got[i] for i, q in enumerate(CASES)} == CASES


@pytest.mark.parametrize("q,want", [
    ("a|b", [("prefix", ["a"]), ("prefix", ["b"])]),
    ("東|京", [("exact", ["東"]), ("exact", ["京"])]),
    ("caféx", [("prefix", ["caf"]), ("prefix", ["x"])]),
])
def test_hosted_profile(spark, q, want):
    searches = spark.createDataFrame([(1, q)], "query_id bigint, q string")
    rows = compile_queries(searches, "hosted").orderBy("clause_no").collect()
    assert [(r.kind, r.terms) for r in rows] == want


def test_slots(spark):
    searches = spark.createDataFrame([(1, "x.y ・")], "query_id bigint, q string")
    rows = clause_slots(compile_queries(searches)).orderBy("clause_no", "slot").collect()
    assert [(r.clause_no, r.n_slots, r.slot, r.term, r.is_prefix) for r in rows] == [
        (0, 2, 0, "x", False), (0, 2, 1, "y", True), (1, 0, None, None, False)]
