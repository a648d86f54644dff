"""Format-preserving pseudonyms of personal numbers and dates, with DataFrame operations only.

Candidates are found by one pattern and validated; each is then permuted within its own format
by a keyed Feistel network: digits stay digits, separators stay, card numbers keep a right check
digit, social security numbers stay assignable, telephone numbers keep their country and a
possible area, addresses stay addresses and dates stay dates.  A permutation maps equal values
to equal pseudonyms and different ones to different ones, in all documents.

The network works on Z_m x Z_n for any m and n: rounds add a keyed hash of one half to the
other by turns, modulo that half's size.  Each format is numbered densely as such a product, so
no value leaves it and none needs to be drawn again.

The pattern is linear in the text: a run of characters is entered once, nothing in it is
repeated without a bound but single characters, and those possessively.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 17 * 4,297.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)

_LOCAL = r"[A-Za-z0-9._%+\-]"
#: A run before the @ is entered at its start, or where the last match ended; at most 126 labels of 63 characters follow.
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@(?:[A-Za-z0-9\-]{{1,63}}\.){{1,126}}[A-Za-z]{{2,63}}"
ISO_DATE = r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])"
DAY_DATE = r"(?<![\d./])\d{2}[./]\d{2}[./]\d{4}(?!\d)"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
#: North American numbers, those with blanks only where area and exchange are possible, and +country numbers.
_NATIONAL = r"(?<![\d+])(?:\+?1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[ .\-]\d{4}(?!\d)|(?<![\d+] )(?<![\d+.\-])(?:\+?1 )?[2-9]\d{2} [2-9]\d{2} \d{4}(?! ?\d)"
_ABROAD = r"(?<![\d+])\+\d{1,3}(?:[ .\-]\d{2,4}){2,5}(?!\d)"
PHONE = f"{_NATIONAL}|{_ABROAD}"
CARD = r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)"
KINDS = {"email": EMAIL, "iso_date": ISO_DATE, "day_date": DAY_DATE, "address": ADDRESS, "social": SOCIAL, "phone": PHONE, "card": CARD}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())


def _hash(key: str, kind: Column, turn: Column, half: Column) -> Column:
    """60 bits of SHA-256 over key, kind, round and half."""
    text = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), half.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, m: Column, n: Column, key: str, kind: Column) -> Column:
    """The pair (a, b) of Z_m x Z_n permuted under ``key``; a struct of a and b."""

    def step(pair: Column, turn: Column) -> Column:
        left = F.pmod(pair["a"] + F.pmod(_hash(key, kind, turn, pair["b"]), m), m)
        right = F.pmod(pair["b"] + F.pmod(_hash(key, kind, turn, pair["a"]), n), n)
        odd = turn % 2 == 1
        return F.struct(F.when(odd, left).otherwise(pair["a"]).alias("a"), F.when(odd, pair["b"]).otherwise(right).alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _permuted(digits: Column, key: str, kind: Column) -> Column:
    """A string of 2 to 20 digits as another of the same length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = (n - u).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")  # noqa: E731  10 to the power k
    pair = feistel(digits.substr(F.lit(1), u).cast("long"), digits.substr(u + 1, v).cast("long"), size(u), size(v), key, F.concat_ws(":", kind, n.cast("string")))
    return F.concat(F.lpad(pair["a"].cast("string"), u, "0"), F.lpad(pair["b"].cast("string"), v, "0"))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one by one."""

    def put(c: Column, i: Column) -> Column:
        place = F.length(_digits(F.substr(shape, F.lit(1), i + 1)))
        return F.when(c.rlike("^[0-9]$"), F.substr(digits, place, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), put), "")


def _luhn(digits: Column) -> Column:
    """Sum whose last digit is 0 for valid numbers."""
    terms = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(terms, F.lit(0), lambda s, x: s + x)


def _card(s: Column, key: str) -> Column:
    digits = _digits(s)
    body = _permuted(digits.substr(F.lit(1), F.length(digits) - 1), key, F.lit("card"))
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    return F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, _refilled(s, F.concat(body, check.cast("string"))))


def _social(s: Column, key: str) -> Column:
    """Area 001-899 but 666, group 01-99 and serial 0001-9999 as 898 x 989,901 numbers; null for others."""
    area, group, serial = (s.substr(at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    assigned = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    pair = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("social"))
    a = pair["a"] + F.when(pair["a"] >= 665, 2).otherwise(1)
    b, c = F.floor(pair["b"] / 9999) + 1, pair["b"] % 9999 + 1
    digits = F.concat(F.lpad(a.cast("string"), 3, "0"), F.lpad(b.cast("string"), 2, "0"), F.lpad(c.cast("string"), 4, "0"))
    return F.when(assigned, _refilled(s, digits))


def _national(digits: Column, key: str) -> Column:
    """Ten digits as ten others.  Those of a possible area and exchange, 200-999 each, stay such; so do the two kinds of others."""
    area, rest = digits.substr(1, 3).cast("long"), digits.substr(4, 7).cast("long")
    low, odd = area < 200, rest < 2_000_000
    base_a, base_b = F.when(low, 0).otherwise(200), F.when(low | odd, 0).otherwise(2_000_000)
    m = F.when(low, 200).otherwise(800)
    n = F.when(low, 10_000_000).when(odd, 2_000_000).otherwise(8_000_000)
    kind = F.when(low, "phone:low").when(odd, "phone:odd").otherwise("phone")
    pair = feistel(area - base_a, rest - base_b, m, n, key, kind)
    return F.concat(F.lpad((pair["a"] + base_a).cast("string"), 3, "0"), F.lpad((pair["b"] + base_b).cast("string"), 7, "0"))


def _phone(s: Column, key: str) -> Column:
    """The country code stays; a national number is permuted as such with or without one."""
    digits = _digits(s)
    n = F.length(digits)
    country = F.regexp_extract(s, r"^\+(\d+)", 1)
    rest = digits.substr(F.length(country) + 1, n)
    ten = digits.substr(n - 9, F.lit(10))
    new = F.when(s.rlike(f"^(?:{_NATIONAL})$"), F.concat(digits.substr(F.lit(1), n - 10), _national(ten, key))).otherwise(F.concat(country, _permuted(rest, key, F.concat(F.lit("phone:"), country))))
    return _refilled(s, new)


def _date(s: Column, year: Column, month: Column, day: Column, key: str, shape: str) -> Column:
    when = F.try_to_date(F.concat_ws("-", year, month, day), "yyyy-MM-dd")
    number = F.datediff(when, F.lit(FIRST_DAY).cast("date"))
    pair = feistel(F.floor(number / DAYS[1]), number % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), key, F.lit("date"))
    other = F.date_add(F.lit(FIRST_DAY).cast("date"), (pair["a"] * DAYS[1] + pair["b"]).cast("int"))
    part = {"d": F.date_format(other, "dd"), "m": F.date_format(other, "MM")}
    if shape == "iso":
        text = F.date_format(other, "yyyy-MM-dd")
    else:
        text = F.concat(part[shape[0]], s.substr(3, 1), part[shape[1]], s.substr(6, 1), F.date_format(other, "yyyy"))
    return F.when((number >= 0) & (number < DAYS[0] * DAYS[1]), text)


def _address(s: Column, key: str) -> Column:
    part = F.transform(F.split(s, r"\."), lambda x: x.cast("long"))
    pair = feistel(part[0] * 256 + part[1], part[2] * 256 + part[3], F.lit(65536), F.lit(65536), key, F.lit("address"))
    byte = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.when(F.forall(part, lambda x: x < 256), F.concat_ws(".", *byte(pair["a"]), *byte(pair["b"])))


def _email(s: Column, key: str) -> Column:
    """u, 12 hex digits of a keyed hash of the address in lower case, and the reserved domain example.invalid.

    Addresses are no numbers, so this is no permutation: two of n addresses get one pseudonym with
    a chance of about n * n / 2**49.  The length and shape of the address do not stay.
    """
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s)), 256), 1, 12), F.lit("@example.invalid"))


def pseudonym(s: Column, key: str) -> Column:
    """A struct of kind and value; kind is null and the value unchanged where ``s`` doesn't validate."""
    is_ = lambda kind: s.rlike(f"^(?:{KINDS[kind]})$")
    year, one, two = s.substr(7, 4), s.substr(1, 2), s.substr(4, 2)
    found = [
        ("email", is_("email"), _email(s, key)),
        ("date", is_("iso_date"), _date(s, s.substr(1, 4), s.substr(6, 2), s.substr(9, 2), key, "iso")),
        ("date", is_("day_date"), F.coalesce(_date(s, year, two, one, key, "dm"), _date(s, year, one, two, key, "md"))),
        ("address", is_("address"), _address(s, key)),
        ("social", is_("social"), _social(s, key)),
        ("phone", is_("phone"), _phone(s, key)),
        ("card", is_("card"), _card(s, key)),
    ]
    none = F.struct(F.lit(None).cast("string").alias("kind"), s.alias("value"))
    out = none
    for kind, valid, value in reversed(found):
        named = F.struct(F.when(value.isNotNull(), F.lit(kind)).alias("kind"), F.coalesce(value, s).alias("value"))
        out = F.when(valid, named).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, column: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the text with its personal numbers, dates and addresses replaced, and how many there were of each kind.

    Columns: ``column``, emails, dates, addresses, socials, phones, cards, pseudonyms (their sum).
    Whoever has ``key`` can undo the permutations; it stands in the query plan, so plans and event
    logs must be kept like it.

    Cards (13 to 19 digits, with blanks or hyphens) need a right check digit, dates (yyyy-mm-dd,
    dd.mm.yyyy, dd/mm/yyyy, and mm/dd/yyyy where that is no day in the other order) a real day of
    1900-2099, IPv4 parts below 256, social security numbers an assigned area, group and serial; what
    fails stays as it is.  Telephone numbers: (555) 123-4567, 555-123-4567, 555.123.4567, each also
    after 1 or +1, 555 123 4567 where area and exchange are possible, and +country with two to
    five groups.  Not covered: numbers without separators, IPv6, names, postal addresses, dates in words or
    with years of two digits.

    Texts of any length are read whole, in time linear in it.  A null text stays null with counts of
    0, an empty one empty; repeated rows give repeated rows; other columns are dropped unless kept;
    every row gives a row, without a shuffle; an empty table gives none.
    """
    text = F.col(column)
    may = text.rlike("[0-9@]")
    found = F.when(may, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.select(*keep, text.alias("_text"), F.coalesce(found, F.array().cast("array<string>")).alias("_found"))
    marked = marked.withColumn("_new", F.transform("_found", lambda s: pseudonym(s, key)))
    pieces = F.zip_with(F.split("_text", ANY, -1), "_new", lambda piece, new: F.concat(F.coalesce(piece, F.lit("")), F.coalesce(new["value"], F.lit(""))))
    count = lambda kind: F.size(F.filter("_new", lambda x: x["kind"] == kind)).cast("long")
    names = {"emails": "email", "dates": "date", "addresses": "address", "socials": "social", "phones": "phone", "cards": "card"}
    return marked.select(
        *keep, F.when(F.size("_found") > 0, F.array_join(pieces, "")).otherwise(F.col("_text")).alias(column),
        *[count(kind).alias(name) for name, kind in names.items()],
        F.size(F.filter("_new", lambda x: x["kind"].isNotNull())).cast("long").alias("pseudonyms"),
    )
