"""Format-preserving pseudonyms for personal data, in DataFrame operations only.

Validated numbers (payment cards, US social security numbers, North American phone numbers, IPv4 addresses, IBANs),
dates and the local parts of e-mail addresses are replaced by others of the same format. Each kind's values are numbered, split into two
parts, and put through a keyed Feistel network of ``ROUNDS`` rounds that adds to one part, modulo its size, a hash of the other: a permutation
of the kind's values. So equal values stay equal in all documents, different ones different, and whoever has the key can undo it. Check digits are made anew.
Whatever fails its validation stays as it is.
"""

from pyspark.sql import Column, DataFrame, functions as F

from yomisaku.llm.common import free_name

ROUNDS = 8
#: Letters or digits of a mail name that one network permutes.
BLOCK = 24
_LETTERS, _BASE26 = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdefghijklmnop"

_ISO = r"\d{4}-\d{2}-\d{2}"
_DOTTED = r"\d{1,2}\.\d{1,2}\.\d{4}"
_SLASHED = r"\d{1,2}/\d{1,2}/\d{4}"
_SSN = r"\d{3}-\d{2}-\d{4}"
_IP = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_PHONE = r"(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}"
_CARD = r"\d(?:[ -]?\d){12,18}"

# Length of the IBANs of a country. It tells where one written with blanks ends.
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
                22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
                25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
                28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
                31: "MT SC", 32: "LC", 33: "RU"}
_BLANKED = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
_IBAN = rf"(?=[A-Z]{{2}}\d{{2}})(?:{_BLANKED}|[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}})"
_MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"

#: No letter, digit or joining sign around a value, so that parts of longer codes are left alone.
_ALONE = r"(?<![\p{L}\p{N}_.+%-])"
_CLOSED = r"(?![\p{L}\p{N}_])(?![-./]\d)"
#: A date may be followed by its time.
_TIME = r"(?=[Tt](?:[01]\d|2[0-4])(?::?[0-5]\d|(?![\p{L}\p{N}_])))"
PATTERN = (f"(?:{_ALONE}(?:(?:{_ISO}|{_DOTTED}|{_SLASHED}|{_SSN}|{_IP}|{_PHONE}|{_IBAN}|{_CARD}){_CLOSED}|{_ISO}{_TIME}"
           f"|{_MAIL})|(?<![\\p{{L}}\\p{{N}}_])\\([2-9]\\d{{2}}\\) ?[2-9]\\d{{2}}[ .-]\\d{{4}}{_CLOSED}"
           f"|(?<![\\p{{L}}\\p{{N}}_])\\+1[ .-]?(?:\\([2-9]\\d{{2}}\\) ?|[2-9]\\d{{2}}[ .-])[2-9]\\d{{2}}[ .-]\\d{{4}}{_CLOSED})")

#: What may stand inside an IBAN with blanks that turns out to be none.
NUMBERS = f"{_ALONE}(?:{_PHONE}|{_CARD}){_CLOSED}"

#: Dates from the first day to 2099-12-30 are permuted among themselves: 73,048 days = 184 * 397.
FIRST_DAY, DAYS_LEFT, DAYS_RIGHT = "1900-01-01", 184, 397


def _number(c: Column) -> Column:
    return F.coalesce(c.try_cast("long"), F.lit(0).cast("long"))


def feistel(kind: str, left: Column, right: Column, lefts: Column, rights: Column, key: str,
            beside: Column | None = None) -> Column:
    """The pair (l, r) after a keyed permutation of all pairs below (lefts, rights); another for each ``beside``."""
    def added(value: Column, i: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit("") if beside is None else beside, lefts.cast("string"), rights.cast("string"), i.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        return (F.when(i % 2 == 0, F.struct(((s["l"] + added(s["r"], i) % lefts) % lefts).alias("l"), s["r"].alias("r")))
                .otherwise(F.struct(s["l"].alias("l"), ((s["r"] + added(s["l"], i) % rights) % rights).alias("r"))))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _written(kind: str, s: Column, base: int, key: str, beside: Column | None = None) -> Column:
    """Up to 24 digits of a base (36 of base 10) permuted among those of their length; another permutation for each ``beside``."""
    n = F.length(s)
    half = F.floor(n / 2).cast("int")

    def power(k: Column) -> Column:
        return F.conv(F.rpad(F.lit("1"), k + 1, "0"), base, 10).cast("long")

    def value(part: Column) -> Column:
        return F.conv(F.concat(F.lit("0"), part), base, 10).cast("long")

    def shown(v: Column, k: Column) -> Column:
        return F.lpad(F.lower(F.conv(v.cast("string"), 10, base)), k, "0")
    pair = feistel(kind, value(F.substr(s, F.lit(1), half)), value(F.substr(s, half + 1)), power(half), power(n - half), key, beside)
    return _with(pair, lambda p: F.concat(shown(p["l"], half), shown(p["r"], n - half)))


def _blocks(kind: str, s: Column, base: int, key: str, beside: Column) -> Column:
    """Any number of digits of a base permuted in blocks of ``BLOCK``; a block's permutation depends on the digits before it."""
    def block(i: Column) -> Column:
        before = F.when(i == 0, beside).otherwise(F.concat(beside, F.lit("/"), F.substr(s, F.lit(1), i)))
        return _written(kind, F.substr(s, i + 1, F.lit(BLOCK)), base, key, before)
    last = F.greatest(F.length(s) - 1, F.lit(0))
    return F.array_join(F.transform(F.sequence(F.lit(0), last, F.lit(BLOCK)), block), "")


def _with(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _only(s: Column, kept: str) -> Column:
    return F.regexp_replace(s, f"[^{kept}]", "")


def _put_back(shape: Column, letters: Column, kept: str) -> Column:
    """``shape`` with its characters among ``kept`` replaced in turn by those of ``letters``."""
    def one(c: Column, i: Column) -> Column:
        rank = F.length(_only(F.substr(shape, F.lit(1), i + 1), kept))
        return F.when(c.rlike(f"[{kept}]"), F.substr(letters, rank, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _luhn(s: Column) -> Column:
    """The Luhn sum of a string of digits modulo 10; 0 is valid."""
    n = F.length(s)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(s, n - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10


def _card(m: Column, key: str) -> tuple[Column, Column]:
    """First digit kept, the others permuted, check digit anew."""
    d = _only(m, "0-9")
    n = F.length(d)
    body = F.concat(F.substr(d, F.lit(1), F.lit(1)), _written("card", F.substr(d, F.lit(2), n - 2), 10, key))
    made = _with(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0")))) % 10).cast("string")))
    return _luhn(d) == 0, _with(made, lambda p: _put_back(m, p, "0-9"))


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, middle, serial = (_number(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (middle > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel("ssn", place, (middle - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key)

    def shown(p: Column) -> Column:
        a = p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((F.floor(p["r"] / 9999) + 1).cast("string"), 2, "0"),
                        F.lit("-"), F.lpad((p["r"] % 9999 + 1).cast("string"), 4, "0"))
    return valid, _with(pair, shown)


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    """The ten digits of a number with area and exchange from 200 up; a leading country code stays."""
    all_digits = _only(m, "0-9")
    ten = F.right(all_digits, F.lit(10))
    area, exchange, line = (_number(F.substr(ten, F.lit(a), F.lit(n))) for a, n in ((1, 3), (4, 3), (7, 4)))
    pair = feistel("phone", area - 200, (exchange - 200) * 10000 + line, F.lit(800), F.lit(800 * 10000), key)

    def shown(p: Column) -> Column:
        made = F.concat((p["l"] + 200).cast("string"), (F.floor(p["r"] / 10000) + 200).cast("string"),
                        F.lpad((p["r"] % 10000).cast("string"), 4, "0"))
        return _put_back(m, F.concat(F.substr(all_digits, F.lit(1), F.length(all_digits) - 10), made), "0-9")
    return (area >= 200) & (exchange >= 200), _with(pair, shown)


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    """Four numbers up to 255 without leading zeros."""
    part = [_number(F.split_part(m, F.lit("."), F.lit(i))) for i in range(1, 5)]
    valid = ~m.rlike(r"(^|\.)0\d")
    for p in part:
        valid = valid & (p < 256)
    pair = feistel("ip", part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key)

    def shown(p: Column) -> Column:
        return F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)])
    return valid, _with(pair, shown)


def _date(iso: Column, key: str) -> tuple[Column, Column]:
    """Validity and permuted date, as yyyy-mm-dd, of such a text."""
    day = iso.try_cast("date")
    index = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    pair = feistel("date", F.floor(index / DAYS_RIGHT), index % DAYS_RIGHT, F.lit(DAYS_LEFT), F.lit(DAYS_RIGHT), key)
    moved = _with(pair, lambda p: F.date_add(F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS_RIGHT + p["r"]).cast("int")).cast("string"))
    return F.coalesce((index >= 0) & (index < DAYS_LEFT * DAYS_RIGHT), F.lit(False)), moved


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    """The digits of the account part permuted, check digits anew; blanks stay in their places and count for nothing."""
    def remainder(s: Column) -> Column:
        turned = F.concat(F.substr(s, F.lit(5)), F.substr(s, F.lit(1), F.lit(4)))

        def add(total: Column, c: Column) -> Column:
            v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
            return (F.when(v < 0, total).when(v < 10, total * 10 + v).otherwise(total * 100 + v)) % 97
        return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add)

    plain = F.translate(m, " ", "")
    account = F.substr(plain, F.lit(5))
    moved = _put_back(account, _written("iban", _only(account, "0-9"), 10, key), "0-9")

    def shown(a: Column) -> Column:
        open_ = F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lit("00"), a)
        return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad((98 - remainder(open_)).cast("string"), 2, "0"), a)
    return remainder(plain) == 1, _with(_with(moved, shown), lambda p: _put_back(m, p, "A-Z0-9"))


def _mail(m: Column, key: str) -> tuple[Column, Column]:
    """The digits of the local part permuted among digits, its letters among letters; the domain stays."""
    local = F.lower(F.substring_index(m, "@", 1))
    digits, letters = _only(local, "0-9"), _only(local, "a-z")
    moved = F.translate(_blocks("mail letters", F.translate(letters, _LETTERS, _BASE26), 26, key, digits), _BASE26, _LETTERS)
    made = _put_back(local, _blocks("mail digits", digits, 10, key, F.lit("")), "0-9")
    made = _with(made, lambda x: _with(moved, lambda y: _put_back(x, y, "a-z")))
    return F.length(digits) + F.length(letters) > 0, F.concat(made, F.substr(m, F.length(local) + 1))


def _spliced(text: Column, pattern: str, made: Column) -> Column:
    """``text`` with its matches, m in ``made``, replaced by the value of p where there is one."""
    shown = F.zip_with(F.split(text, pattern, -1), made, lambda a, b: F.concat(a, F.coalesce(b["p"]["value"], b["m"], F.lit(""))))
    return F.array_join(shown, "")


def _count(made: Column) -> Column:
    """How many values were replaced in ``made``."""
    return F.aggregate(made, F.lit(0), lambda n, x: n + F.coalesce(x["p"]["n"], F.lit(0)))


def _first_of(m: Column, cases: list[tuple[str, str, tuple[Column, Column]]], otherwise: dict[str, Column] = {}) -> Column:
    """kind, value and number of replaced values by the first pattern that ``m`` matches as a whole; NULL if it is not valid."""
    none = F.lit(None).cast("struct<kind:string,value:string,n:int>")
    out = none
    for kind, pattern, (valid, made) in reversed(cases):
        right = F.struct(F.lit(kind).alias("kind"), made.alias("value"), F.lit(1).alias("n"))
        out = F.when(m.rlike(f"^(?:{pattern})$"), F.when(valid, right).otherwise(otherwise.get(kind, none))).otherwise(out)
    return out


def pseudonym(m: Column, key: str) -> Column:
    """kind, pseudonym and number of values of one match; all NULL if it is not valid."""
    day, month, year = (F.lpad(F.split_part(F.translate(m, "/", "."), F.lit("."), F.lit(i)), n, "0") for i, n in ((1, 2), (2, 2), (3, 4)))
    iso = _date(m, key)
    dotted = _date(F.concat_ws("-", year, month, day), key)
    slashed = _date(F.concat_ws("-", year, day, month), key)

    def shuffled(moved: Column, order: str) -> Column:
        parts = {"y": (1, 4), "m": (6, 2), "d": (9, 2)}
        made = _with(moved, lambda s: F.concat_ws(order[0], *[F.substring(s, *parts[c]) for c in order[1:]]))
        # Where a day or month has one digit, leading zeros are not written.
        return F.when(m.rlike(r"\b\d[./]"), F.regexp_replace(made, r"\b0", "")).otherwise(made)
    cases = [("date", _ISO, iso), ("date", _DOTTED, (dotted[0], shuffled(dotted[1], ".dmy"))),
             ("date", _SLASHED, (slashed[0], shuffled(slashed[1], "/mdy"))), ("ssn", _SSN, _ssn(m, key)), ("ip", _IP, _ip(m, key)),
             ("phone", _PHONE, _phone(m, key)), ("card", _CARD, _card(m, key)), ("iban", _IBAN, _iban(m, key)), ("mail", _MAIL, _mail(m, key))]
    inside = F.transform(F.regexp_extract_all(m, F.lit(NUMBERS), F.lit(0)), lambda x: F.struct(
        x.alias("m"), _first_of(x, [("phone", _PHONE, _phone(x, key)), ("card", _CARD, _card(x, key))]).alias("p")))
    numbers = _with(inside, lambda hits: F.struct(
        F.lit("numbers").alias("kind"), _spliced(m, NUMBERS, hits).alias("value"), _count(hits).alias("n")))
    return _first_of(m, cases, {"iban": F.when(m.rlike(NUMBERS), numbers)})


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal data in the texts replaced, and n_replaced, the number of values replaced.

    Texts without a value, NULL and empty ones among them, stay with 0; rows keep their other columns (n_chars, where there is one,
    follows the text), and repeated rows are treated alike. Nothing is shuffled.
    """
    hits, parts, made = (free_name(docs, n) for n in ("pii_hits", "pii_parts", "pii_made"))
    found = docs.withColumn(hits, F.when(F.col("text").rlike(PATTERN), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))))
    found = found.withColumns({
        made: F.when(F.col(hits).isNotNull(), F.transform(hits, lambda m: F.struct(m.alias("m"), pseudonym(m, key).alias("p"))))})
    found = found.withColumn(parts, F.when(F.col(hits).isNotNull(), _spliced(F.col("text"), PATTERN, F.col(made))))
    count = F.coalesce(_count(F.col(made)), F.lit(0)).cast("long")
    text = F.coalesce(F.col(parts), F.col("text"))
    n = F.when(F.col(hits).isNull(), F.lit(0).cast("long")).otherwise(count)

    def column(c):
        if c.lower() == "text":
            return text.alias(c)
        if c.lower() == "n_chars":
            return F.when(F.col(parts).isNotNull(), F.length(parts).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(c)
    return found.select(*[column(c) for c in docs.columns], n.alias(free_name(docs, "n_replaced")))
