"""Preparation of text for the index and for queries.

Stage 1 (``prepare_index_text``) is what the store keeps: NFKC, every CJK character a token of its own,
other letters and digits and ``_-.@/`` kept and lowercased, everything else a space. Stage 2
(``index_terms_text``) is what the index sees: Latin diacritics folded, split at everything that is not a
letter or a digit.
"""

import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

# The code points that count as CJK.
CJK_RANGES = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F))
CJK = "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in CJK_RANGES)

# Fixed value: what is_ascii_word accepts.
ASCII_WORD = r"[A-Za-z0-9_\-.@/]+"

# Text in these ranges is either its own NFKC form in any context, or (full-width punctuation, the
# ideographic space) has an NFKC form that separates tokens just as it does itself. Only text with other
# characters is sent to the Arrow function. Checked against unicodedata in the tests. Grouped by how common they are:
# Java tests a nested class as one step, so the groups keep the regex short for most characters.
_SAFE_JAPANESE = ((0x3000, 0x3029), (0x3041, 0x3096), (0x30A0, 0x30FE), (0x3400, 0x4DBF), (0x4E00, 0x9FFF))
_SAFE_LATIN = ((0x0000, 0x009F), (0x00A1, 0x00A7), (0x00A9, 0x00A9), (0x00AB, 0x00AE), (0x00B0, 0x00B1),
               (0x00B6, 0x00B7), (0x00BB, 0x00BB), (0x00BF, 0x0131), (0x0134, 0x013E), (0x0141, 0x0148),
               (0x014A, 0x017E))
_SAFE_SIGNS = ((0x2010, 0x2010), (0x2012, 0x2016), (0x2018, 0x2023), (0xFF01, 0xFF0C), (0xFF1A, 0xFF1F),
               (0xFF3B, 0xFF3E))
NFKC_SAFE_RANGES = _SAFE_JAPANESE + _SAFE_LATIN + _SAFE_SIGNS


def _group(ranges) -> str:
    return "[" + "".join(f"\\x{{{lo:x}}}-\\x{{{hi:x}}}" for lo, hi in ranges) + "]"


_NEEDS_NFKC = (r"[\x{80}-\x{10ffff}&&[^" + _group(_SAFE_JAPANESE) + _group(_SAFE_LATIN) + _group(_SAFE_SIGNS) + "]]")
_CJK_CHAR = rf"[\x{{3040}}-\x{{ff9f}}&&[{CJK}]]"

_NOT_INDEXED = rf"[^[a-zA-Z0-9_\-.@/][{CJK}][\p{{L}}\p{{N}}]]+"
_NOT_INDEXED_ASCII = rf"[^[a-zA-Z0-9_\-.@/][{CJK}]]+"
_NOT_A_TERM = r"[^[a-zA-Z0-9][\p{L}\p{N}]]+"

_LATIN_RANGES = ((0x00C0, 0x024F), (0x1E00, 0x1EFF))
_HAS_LATIN_MARKS = "[" + "".join(f"{chr(lo)}-{chr(hi)}" for lo, hi in _LATIN_RANGES) + "]"


#: Characters of text that a worker holds as Python strings at once; one longer text is taken alone.
HELD_CHARS = 1 << 20


def map_texts(texts: pa.Array, made: Callable[[str], str]) -> pa.Array:
    """``made`` of each text; NULL stays. Of a batch only ``HELD_CHARS`` are strings at a time, the rest is Arrow."""
    parts, held, size = [], [], 0
    for text in texts:
        text = text.as_py()
        held.append(None if text is None else made(text))
        size += len(text or "")
        if size >= HELD_CHARS:
            parts, held, size = [*parts, pa.array(held, pa.string())], [], 0
    return pa.concat_arrays([*parts, pa.array(held, pa.string())])


@arrow_udf(StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return map_texts(texts, lambda text: unicodedata.normalize("NFKC", text))


def nfkc_for_index(text: Column) -> Column:
    """NFKC up to characters that separate tokens anyway; NULL becomes ''.

    Rows that need no normalization reach the Arrow function as NULL and never leave the JVM.
    """
    return F.coalesce(_nfkc(F.when(text.rlike(_NEEDS_NFKC), text)), text, F.lit(""))


def nfkc(text: Column) -> Column:
    """Full NFKC; pure ASCII stays in the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text, F.lit(""))


def _separate_sql(normalized: str, dropped: str) -> str:
    """Stage 1 after NFKC, as an SQL expression over another one."""
    return (f"trim(lower(regexp_replace(regexp_replace({normalized}, r'{_CJK_CHAR}', ' $0 '), r'{dropped}', ' ')))")


def _separate(normalized: Column, dropped: str) -> Column:
    spaced = F.regexp_replace(normalized, _CJK_CHAR, " $0 ")
    return F.trim(F.lower(F.regexp_replace(spaced, dropped, " ")))


def prepare_index_text(text: Column) -> Column:
    """Stage 1 text of a stored field."""
    return _separate(nfkc_for_index(text), _NOT_INDEXED)


def prepare_query_text(text: Column, profile: str = "local") -> Column:
    """Stage 1 text of a query. ``profile='hosted'`` keeps only ASCII letters besides CJK."""
    return _separate(nfkc_for_index(text), _query_separators(profile))


def separate_query_text_sql(normalized: str, profile: str = "local") -> str:
    """Stage 1 text of a query part that is NFKC already, as an SQL expression."""
    return _separate_sql(normalized, _query_separators(profile))


def _query_separators(profile: str) -> str:
    return _NOT_INDEXED_ASCII if profile == "hosted" else _NOT_INDEXED


def is_ascii_word(token: Column) -> Column:
    return token.rlike(f"^{ASCII_WORD}$")


@lru_cache(maxsize=1)
def latin_folding() -> tuple[str, str]:
    """Marked Latin letters and the plain letters they fold to, derived from their decompositions."""
    marked, plain = [], []
    for lo, hi in _LATIN_RANGES:
        for code in range(lo, hi + 1):
            base = unicodedata.normalize("NFD", chr(code))[0]
            if base != chr(code) and base.isascii() and base.isalpha():
                marked.append(chr(code))
                plain.append(base)
    return "".join(marked), "".join(plain)


def fold_latin(text: Column) -> Column:
    """Drop the diacritics of Latin letters. Kana voicing marks stay."""
    marked, plain = latin_folding()
    folded = F.translate(F.regexp_replace(text, "[̀-ͯ]+", ""), marked, plain)
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(text)


# Characters besides ASCII and Latin letters. The first range ends the test of an ASCII character, as in _NEEDS_NFKC.
_NOT_SIMPLE = r"[\x{80}-\x{10ffff}&&[^\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{24f}\x{1e00}-\x{1eff}]]"


def simple_index_text(index_text: Column) -> Column:
    """Whether a prepared text holds ASCII and Latin letters only: its terms are runs of ASCII letters, digits and other
    characters, folded by ``latin_table``."""
    return ~index_text.rlike(_NOT_SIMPLE)


def latin_table() -> dict[int, int]:
    """``latin_folding`` for ``str.translate``."""
    return str.maketrans(*latin_folding())


def index_terms_text(index_text: Column) -> Column:
    """Stage 2 text of a prepared field: its terms, separated by single spaces."""
    return F.trim(F.regexp_replace(fold_latin(index_text), _NOT_A_TERM, " "))


def index_terms(index_text: Column) -> Column:
    """Stage 2 terms of a prepared field, in order."""
    return F.filter(F.split(index_terms_text(index_text), " "), lambda t: t != "")


def with_index_text(posts: DataFrame) -> DataFrame:
    """Add the prepared ``title_idx``, ``excerpt_idx`` and ``content_idx``."""
    return posts.withColumns({
        f"{field}_idx": prepare_index_text(F.col(field)) for field in ("title", "excerpt", "content")
    })
