"""Search strings to clauses, for a whole table of searches."""

from pyspark.sql import DataFrame, functions as F

from yomisaku.functions.text import ASCII_WORD, index_terms, nfkc, separate_query_text_sql

# Characters blanked before words are split.
SPECIAL = {"local": r'["()*:]', "hosted": r'["()*:&|!<>]'}
_SPACES = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]+"
_QUOTED = "(i % 2 = 1 and (i < size(parts) - 1 or size(parts) % 2 = 1))"
_IS_ASCII = f"rlike(t, r'^{ASCII_WORD}$')"


def compile_queries(searches: DataFrame, profile: str = "local") -> DataFrame:
    """``query_id, q`` to ``query_id, clause_no, n_clauses, kind, terms``; every clause of a search must match.

    Kinds: ``exact`` one term, ``prefix`` a term's beginning, ``phrase`` terms side by side, ``phrase_prefix`` the
    same with only the beginning of the last one. Searches that compile to nothing give no row; a clause without
    terms matches nothing. Each search is compiled within its own row.
    """
    prepared = separate_query_text_sql("word", profile)
    # Splitting at the quotes leaves the quoted parts at odd places. With an odd number of quotes the last part
    # was never closed and is read as words.
    parts = searches.select("query_id", F.split(nfkc(F.col("q")), '"').alias("parts"))
    words = parts.selectExpr("query_id", f"""
        flatten(transform(parts, (part, i) -> transform(
            if({_QUOTED}, array(regexp_replace(part, r'{SPECIAL[profile]}', ' ')),
               split(regexp_replace(part, r'{SPECIAL[profile]}', ' '), r'{_SPACES}')),
            word -> struct({_QUOTED} as quoted, {prepared} as text)))) as words""")
    # A quoted part, or a word without ASCII tokens, is one clause; any other word gives one per token.
    units = words.selectExpr("query_id", f"""
        flatten(transform(filter(words, w -> w.text <> ''), w -> transform(
            if(w.quoted or not exists(split(w.text, ' '), t -> {_IS_ASCII}), array(w.text), split(w.text, ' ')),
            t -> struct(t as text, not w.quoted and {_IS_ASCII} as open)))) as units""")
    units = units.selectExpr("query_id", "size(units) as n_clauses", "posexplode(units) as (clause_no, unit)")
    clauses = units.select("query_id", "clause_no", "n_clauses", "unit.open",
                           index_terms(F.col("unit.text")).alias("terms"))
    return clauses.selectExpr("query_id", "clause_no", "n_clauses", """
        case when size(terms) > 1 then if(open, 'phrase_prefix', 'phrase') when open then 'prefix' else 'exact' end as kind""",
                              "terms")


def clause_slots(clauses: DataFrame) -> DataFrame:
    """One row per term of each clause: its place, and whether only its beginning must match.

    A clause without terms keeps one row with a NULL term.
    """
    slots = clauses.selectExpr("query_id", "clause_no", "n_clauses", "kind", "size(terms) as n_slots",
                               "posexplode_outer(terms) as (slot, term)")
    return slots.selectExpr("query_id", "clause_no", "n_clauses", "n_slots", "slot", "term", """
        coalesce(kind in ('prefix', 'phrase_prefix') and slot = n_slots - 1, false) as is_prefix""")
