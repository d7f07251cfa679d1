"""Column expressions for the rows a reader sees."""

from pyspark.sql import Column, functions as F

from yomisaku.functions.posts import blank_to_null

ZONE = "Asia/Tokyo"
UNTITLED = "(無題)"       # fixed value
ELLIPSIS = "…"            # fixed value
MARK = "<mark>$1</mark>"  # fixed value
_SPACES = r"[\s\p{Z}]+"
_PLAIN_WORD = r"^[A-Za-z0-9_\-.]+$"  # fixed value: words highlighted as a whole


def escape_html(text: Column) -> Column:
    escaped = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        escaped = F.replace(escaped, F.lit(char), F.lit(entity))
    return escaped


def truncate_ellipsis(text: Column, chars: int) -> Column:
    return (F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(ELLIPSIS)))
            .otherwise(F.coalesce(text, F.lit(""))))


def highlight_pattern(query: Column) -> Column:
    """The regex of everything a query highlights; NULL if it highlights nothing.

    Quoted phrases first, then each remaining word: plain ASCII words whole, others by character.
    """
    phrases = F.regexp_extract_all(query, F.lit('"([^"]+)"'), F.lit(1))
    words = F.filter(F.split(F.regexp_replace(query, '"[^"]+"', " "), _SPACES), lambda w: w != "")
    pieces = F.flatten(F.transform(
        words, lambda w: F.when(w.rlike(_PLAIN_WORD), F.array(w)).otherwise(F.split(w, ""))))
    quoted = F.transform(F.concat(phrases, pieces),
                         lambda t: F.regexp_replace(t, r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    return F.when(F.size(quoted) > 0, F.concat(F.lit("(?iu)("), F.array_join(quoted, "|"), F.lit(")")))


def highlight(text: Column, query: Column) -> Column:
    """Escaped text with the query's terms marked. Terms also hit inside entities, as specified."""
    pattern = F.when(F.coalesce(text, F.lit("")) != "", highlight_pattern(query))
    escaped = escape_html(text)
    return F.when(pattern.isNull(), escaped).otherwise(F.regexp_replace(escaped, pattern, F.lit(MARK)))


def _local_text(ts: Column, chars: int) -> Column:
    # From the text of the wall clock: date_format would pass through the session time zone.
    local = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), ts).cast("string")
    return F.coalesce(F.translate(F.substring(local, 1, chars), "-", "/"), F.lit(""))


def format_date(ts: Column) -> Column:
    """``yyyy/MM/dd`` in the readers' zone; NULL gives ''."""
    return _local_text(ts, 10)


def format_datetime(ts: Column) -> Column:
    """``yyyy/MM/dd HH:mm`` in the readers' zone; NULL gives ''."""
    return _local_text(ts, 16)


def title_or_default(title: Column) -> Column:
    return F.coalesce(blank_to_null(title), F.lit(UNTITLED))
