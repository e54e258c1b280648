"""Personal data as format-preserving pseudonyms: keyed Feistel permutations, in DataFrame functions only.

A value is cut in two halves; in each round one half is shifted by a keyed hash of the other. That is a permutation of
all values of a format, whatever the hash: equal values get equal pseudonyms in every document, different values stay
different, and who has the key can turn them back. What makes a number valid is kept: a card number's last digit is
worked out anew, so is an IBAN's check, an address has octets below 256, a nine-digit number has parts that are issued.

A date becomes a date of the same 400 years, which have 146097 days whatever the year they start in. Year-month-day,
day.month.year and day/month/year have one permutation, so that a day stays linked however it is written. What can only be
read as month/day/year (day 13 to 31) has one of its own, within the days from 13 on: its pseudonym is read in the same
order again.

Found and validated: e-mail addresses, IBANs (mod 97), IPv4 and IPv6 addresses, dates of the years 200 to 9799, telephone
numbers (ten digits in a row only after a word for telephone), nine-digit numbers as 3-2-4, card numbers (13 to 19 digits,
Luhn). A number that fails its check is left as it is. Cards are looked for in whole runs of digits, spaces and hyphens:
first those written in fours or at once, then any groups that pass the check, from left to right. IBANs may be written in
groups of four, where the register has their country's length. Domains of e-mail addresses stay. Out of scope: small-letter
IBANs, year/month/day, day-month-year, IPv6 addresses that begin or end with two colons, nine-digit numbers parted by
spaces, cards parted by dots or no-break spaces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths of the IBAN register.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR PS QA UA", 30: "JO KW MU", 31: "MT SC",
}
GROUPED = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: [A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" [A-Z0-9]{{{n % 4}}}" if n % 4 else "") for n, c in IBAN_LENGTHS.items())

#: Fixed formats, tried in this order at each place of a text.
FORMATS = {
    "email": r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]{0,63}@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "iban": r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|" + GROUPED + ")(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?!\.?\d)",
    "ipv6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./])\d{1,2}\1\d{4})(?![./-]?\d)",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d.(-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![.-]?\d)|(?<=\b(?i:tel|telephone|phone|call|mobile|cell|fax)[.:]{0,2} {0,2})\d{10}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    # a run of digits, spaces and hyphens: cards are looked for in the whole of it, and what else it may hold
    "card": r"(?<!\d)\d[\d -]{11,}\d(?![\w@/]|[.:]\d)",
}
#: What may stand in a run beside cards.
BESIDE = "|".join(f"(?:{FORMATS[k]})" for k in ("date", "phone", "ssn")).replace(r"([./])", r"(?:[./])").replace(r"\1", "[./]")
ANY = "|".join(f"(?:{p})" for p in FORMATS.values()).replace(r"([./])", r"(?:[./])").replace(r"\1", "[./]")
ROUNDS = 10
#: Any 400 years of the Gregorian calendar have 146097 = 189 * 773 days, and 88497 = 9 * 9833 that are not a month's first 12.
FIRST_YEAR, LAST_YEAR, DAYS_A, DAYS_B, LATE_A, LATE_B = 200, 9799, 189, 773, 9, 9833
#: Letters beyond ASCII that are shifted among each other: first code point and number.
ALPHABETS = ((0xDF, 24), (0xF8, 8), (0xC0, 23), (0xD8, 7), (0x391, 17), (0x3B1, 25), (0x410, 32), (0x430, 32), (0x4E00, 20902), (0xAC00, 11172))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hash(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), half.cast("string")).cast("binary"), 512)


def _number(hex_: Column) -> Column:
    return F.conv(F.substring(hex_, 1, 15), 16, 10).cast("bigint")


def permute_pair(key: str, kind: str, left: Column, right: Column, size_left: Column, size_right: Column) -> Column:
    """Struct (l, r): a keyed permutation of the pairs of numbers below ``size_left`` and ``size_right``."""

    def step(s: Column, i: Column) -> Column:
        return F.when(
            i % 2 == 0, F.struct(F.pmod(s["l"] + F.pmod(_number(_hash(key, kind, i, s["r"])), size_left), size_left).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), F.pmod(s["r"] + F.pmod(_number(_hash(key, kind, i, s["l"])), size_right), size_right).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")), step)


def permute_digits(key: str, kind: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of one length, up to 30."""

    def body(d: Column) -> Column:
        n = F.length(d)
        half = F.floor(n / 2).cast("int")
        size = lambda m: F.pow(F.lit(10), m).cast("decimal(20,0)").cast("bigint")
        pair = permute_pair(key, kind, F.concat(F.lit("0"), F.substring(d, F.lit(1), half)).cast("bigint"), F.substring(d, half + 1, n - half).cast("bigint"), size(half), size(n - half))
        return let(pair, lambda p: F.concat(F.when(half > 0, F.lpad(p["l"].cast("string"), half, "0")).otherwise(F.lit("")), F.lpad(p["r"].cast("string"), n - half, "0")))

    return let(digits, body)


def _of_code(code: Column) -> Column:
    """The character of a code point below 65536."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def permute_text(key: str, kind: str, text: Column) -> Column:
    """A keyed permutation of the strings whose characters are of the same classes (a-z, A-Z, 0-9, ``ALPHABETS``; others stay)."""

    def shifted(part: Column, stream: Column) -> Column:
        def char(c: Column, at: Column) -> Column:
            by = F.conv(F.substring(stream, 2 * F.pmod(at, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            turn = lambda first, n: F.char(F.lit(first) + F.pmod(code - first + by, F.lit(n)))
            other = F.lit(None)
            for first, n in ALPHABETS:  # wide alphabets are turned further than one byte can
                other = F.when(code.between(first, first + n - 1), _of_code(first + F.pmod(code - first + by * max(n // 256, 1), F.lit(n)))).otherwise(other)
            ascii_ = F.when(code.between(97, 122), turn(97, 26)).when(code.between(65, 90), turn(65, 26)).when(code.between(48, 57), turn(48, 10))
            return F.when(code < 128, F.coalesce(ascii_, c)).otherwise(F.coalesce(other, c))

        return F.array_join(F.transform(F.split(part, ""), char), "")

    def body(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")

        def step(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(shifted(s["l"], _hash(key, kind, i, s["r"])).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], _hash(key, kind, i, s["l"])).alias("r")))

        start = F.struct(F.substring(t, F.lit(1), half).alias("l"), F.substring(t, half + 1, F.length(t)).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["l"], s["r"]))

    return let(text, body)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def refill(form: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """``form`` with its digits (what ``kind`` matches) replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        number = c.rlike(f"^{kind}$")
        return F.struct(F.concat(s["out"], F.when(number, F.substring(digits, s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + number.cast("int")).alias("i"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s["out"])


def luhn_sum(payload: Column) -> Column:
    """Luhn's sum of a number without its check digit."""

    def digit(c: Column, at: Column) -> Column:
        d = c.cast("int")
        twice = at % 2 == 0
        return F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(payload), ""), digit), F.lit(0), lambda s, x: s + x)


def luhn_digit(payload: Column) -> Column:
    return F.pmod(10 - luhn_sum(payload) % 10, F.lit(10)).cast("string")


def is_card(digits: Column) -> Column:
    n = F.length(digits)
    return F.substring(digits, n, F.lit(1)) == luhn_digit(F.substring(digits, F.lit(1), n - 1))


#: How cards are mostly written, and the most groups of digits that one has.
CARD_FORM, GROUPS = r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}|\d{4}([ -])\d{6}\2\d{4,5})[ -]*$", 19
PIECES = "array<struct<card:boolean,text:string>>"


def _joined(groups: Column, first: Column, last: Column) -> Column:
    """Groups from ``first`` to ``last`` (from 0), nothing if there are none."""
    return F.when(first <= last, F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.get(groups, i)), "")).otherwise("")


def _cut(value: Column, mostly: bool) -> Column:
    """``PIECES`` of a run: cards from left to right, apart from each other, and what is between them.

    Of cards that start at one group of digits that with most groups is taken. ``mostly``: only those written as cards mostly
    are. A group has what follows it up to the next digit.
    """

    def cards(groups: Column) -> Column:
        n = F.size(groups)

        def first(i: Column) -> Column:
            texts = F.transform(F.sequence(F.least(i + GROUPS - 1, n - 1), i), lambda j: F.struct(i.alias("i"), j.alias("j"), _joined(groups, i, j).alias("text")))
            formed = (lambda t: t.rlike(CARD_FORM)) if mostly else (lambda t: F.length(digits_of(t)).between(13, 19))
            return F.get(F.filter(texts, lambda s: formed(s["text"]) & let(digits_of(s["text"]), is_card)), 0)

        found = F.filter(F.transform(F.sequence(F.lit(0), n - 1), first), lambda s: s.isNotNull())
        start = F.struct(F.array().cast(PIECES).alias("out"), F.lit(0).alias("next"))

        def step(a: Column, s: Column) -> Column:
            pair = F.array(F.struct(F.lit(False).alias("card"), _joined(groups, a["next"], s["i"] - 1).alias("text")), F.struct(F.lit(True).alias("card"), s["text"].alias("text")))
            return F.when(s["i"] >= a["next"], F.struct(F.concat(a["out"], pair).alias("out"), (s["j"] + 1).alias("next"))).otherwise(a)

        return F.aggregate(found, start, step, lambda a: F.array_append(a["out"], F.struct(F.lit(False).alias("card"), _joined(groups, a["next"], n - 1).alias("text"))))

    return let(F.split(value, r"(?<=[ -])(?=\d)"), cards)


def card_pieces(value: Column) -> Column:
    """``PIECES`` that put together are the run ``value``: first cards as they mostly are written, then any between these."""
    return F.flatten(F.transform(_cut(value, True), lambda p: F.when(p["card"] | (F.length(p["text"]) < 13), F.array(p)).otherwise(_cut(p["text"], False))))


def iban_remainder(iban: Column) -> Column:
    """An IBAN's remainder by 97: first four characters last, letters as 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code >= 65, (r * 100 + code - 55) % 97).otherwise((r * 10 + code - 48) % 97)

    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def compact(iban: Column) -> Column:
    return F.regexp_replace(iban, " ", "")


def _date(text: Column) -> Column:
    """Struct (day, order) of a written date: order ymd, dmy or mdy; a null day where there is no such day."""
    part = lambda p, i: F.regexp_extract(text, p, i)
    ymd, other = r"^(\d{4})-(\d{2})-(\d{2})$", r"^(\d{1,2})[./](\d{1,2})[./](\d{4})$"
    made = lambda y, m, d: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    known = lambda d: F.when(F.year(d).between(FIRST_YEAR, LAST_YEAR), d)
    day = lambda value, order: F.struct(known(value).alias("day"), F.lit(order).alias("order"))
    a, b, c = (part(other, i) for i in (1, 2, 3))
    return (
        F.when(text.rlike(ymd), day(made(part(ymd, 1), part(ymd, 2), part(ymd, 3)), "ymd"))
        .when(made(c, b, a).isNotNull(), day(made(c, b, a), "dmy"))
        .when(text.contains("/"), day(made(c, a, b), "mdy"))
    )


def _permuted_day(key: str, first: Column, day: Column) -> Column:
    """A day of the 400 years from ``first`` on."""
    n = F.datediff(day, first)
    pair = permute_pair(key, "date", F.floor(n / DAYS_B), n % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B))
    return let(pair, lambda p: F.date_add(first, (p["l"] * DAYS_B + p["r"]).cast("int")))


def _permuted_late_day(key: str, first: Column, day: Column) -> Column:
    """A day from the 13th on for one from the 13th on, within the 400 years from ``first`` on.

    Such days are numbered over all months; the month of a number is one of the few around its share of the 4800.
    """
    months = (F.year(day) - F.year(first)) * 12 + F.month(day) - 1
    before = lambda m: F.datediff(F.add_months(first, m), first) - 12 * m
    n = before(months) + F.dayofmonth(day) - 13
    pair = permute_pair(key, "late-date", F.floor(n / LATE_B), n % LATE_B, F.lit(LATE_A), F.lit(LATE_B))

    def found(number: Column) -> Column:
        near = F.floor(number * 4800 / (LATE_A * LATE_B)).cast("int")
        month = F.array_max(F.filter(F.sequence(near - 2, near + 2), lambda m: before(m) <= number))
        return let(month, lambda m: F.date_add(F.add_months(first, m), (number - before(m) + 12).cast("int")))

    return let(pair, lambda p: let(p["l"] * LATE_B + p["r"], found))


def _date_pseudonym(key: str, text: Column) -> Column:
    """A date of the same 400 years, written alike; ``text`` itself where it is none."""

    def body(found: Column) -> Column:
        first = F.make_date(F.lit(FIRST_YEAR) + (F.floor((F.year(found["day"]) - FIRST_YEAR) / 400) * 400).cast("int"), F.lit(1), F.lit(1))
        new = let(first, lambda f: F.when(found["order"] == "mdy", _permuted_late_day(key, f, found["day"])).otherwise(_permuted_day(key, f, found["day"])))

        def write(d: Column) -> Column:
            sep = F.regexp_extract(text, r"\d([./-])", 1)
            wide = lambda v, at: F.when(F.length(F.regexp_extract(text, r"^(\d+)[./](\d+)", at)) > 1, F.lpad(v.cast("string"), 2, "0")).otherwise(v.cast("string"))
            first, second = F.when(found["order"] == "dmy", F.dayofmonth(d)).otherwise(F.month(d)), F.when(found["order"] == "dmy", F.month(d)).otherwise(F.dayofmonth(d))
            return F.when(found["order"] == "ymd", F.date_format(d, "yyyy-MM-dd")).otherwise(F.concat(wide(first, 1), sep, wide(second, 2), sep, F.lpad(F.year(d).cast("string"), 4, "0")))

        return F.when(found["day"].isNotNull(), let(new, write)).otherwise(text)

    return let(_date(text), body)


#: Nine-digit numbers that are issued: no 000, 666 or 900 to 999 (kept apart: taxpayers' numbers) in front, no zero parts.
SSN = r"^(?!000|666)(\d{3})-(?!00)(\d{2})-(?!0000)(\d{4})$"


def _ssn_pseudonym(key: str, text: Column) -> Column:
    """An issued number for an issued number; one from 900 on for one from 900 on."""
    area, group, serial = (F.regexp_extract(text, SSN, i).cast("int") for i in (1, 2, 3))

    def body(area: Column) -> Column:
        late = area >= 900
        number = F.when(late, area - 900).otherwise(area - 1 - (area > 666).cast("int"))
        pair = permute_pair(key, "ssn", number * 99 + group - 1, serial - 1, F.when(late, F.lit(100 * 99)).otherwise(F.lit(898 * 99)), F.lit(9999))

        def write(p: Column) -> Column:
            n = F.floor(p["l"] / 99)
            new = F.when(late, n + 900).otherwise(n + 1 + (n >= 665).cast("int"))
            pad = lambda v, size: F.lpad(v.cast("string"), size, "0")
            return F.concat_ws("-", pad(new, 3), pad(p["l"] % 99 + 1, 2), pad(p["r"] + 1, 4))

        return let(pair, write)

    return let(area, body)


def _ipv6_pseudonym(key: str, text: Column) -> Column:
    """Its hexadecimal digits permuted, those of each number of them by itself; written alike, in small letters."""
    digits = F.regexp_replace(F.lower(text), ":", "")

    def body(d: Column) -> Column:
        half = F.floor(F.length(d) / 2).cast("int")

        def shifted(part: Column, stream: Column) -> Column:
            value = lambda c: F.conv(c, 16, 10).cast("int")
            turned = F.transform(F.split(part, ""), lambda c, i: F.lower(F.hex(F.pmod(value(c) + value(F.substring(stream, i + 1, F.lit(1))), F.lit(16)))))
            return F.when(part == "", part).otherwise(F.array_join(turned, ""))

        def step(s: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(shifted(s["l"], _hash(key, "ipv6", i, s["r"])).alias("l"), s["r"].alias("r"))).otherwise(F.struct(s["l"].alias("l"), shifted(s["r"], _hash(key, "ipv6", i, s["l"])).alias("r")))

        start = F.struct(F.substring(d, F.lit(1), half).alias("l"), F.substring(d, half + 1, F.length(d)).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step), lambda s: F.concat(s["l"], s["r"]))

    return refill(text, let(digits, body), "[0-9A-Fa-f]")


def kind_of(value: Column) -> Column:
    """Which format ``value``, found by ``ANY``, has; null where a check fails."""
    whole = lambda k: value.rlike("^(?:" + FORMATS[k] + ")$")
    return (
        F.when(value.contains("@"), F.lit("email"))
        .when(whole("iban") & (iban_remainder(compact(value)) == 1), F.lit("iban"))
        .when(whole("ip"), F.lit("ip"))
        .when(value.rlike(r"^[0-9A-Fa-f:]*\d[0-9A-Fa-f:]*$") & value.contains(":"), F.lit("ipv6"))
        .when(whole("date"), F.when(let(_date(value), lambda d: d["day"].isNotNull()), F.lit("date")))
        .when(whole("phone") | value.rlike(r"^\d{10}$"), F.lit("phone"))
        .when(whole("ssn"), F.when(value.rlike(SSN), F.lit("ssn")))
        .when(value.rlike(r"^\d[\d -]{11,}\d$"), F.lit("run"))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a value of ``kind``; the value itself where that is null."""
    at = F.instr(value, "@")
    email = F.concat(permute_text(key, "email", F.substring(value, F.lit(1), at - 1)), F.substring(value, at, F.length(value)))
    octet = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("int")
    ip = let(
        permute_pair(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65536), F.lit(65536)),
        lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]),
    )
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    phone = let(F.substring(value, F.length(code) + 1, F.length(value)), lambda rest: F.concat(code, refill(rest, permute_digits(key, "phone", digits_of(rest)))))
    plain = let(permute_text(key, "iban", F.substring(compact(value), F.lit(5), F.length(value))), lambda b: F.concat(F.substring(value, 1, 2), F.lpad((98 - iban_remainder(F.concat(F.substring(value, 1, 2), F.lit("00"), b))).cast("string"), 2, "0"), b))
    body = F.when(value.contains(" "), F.regexp_replace(plain, "(.{4})(?=.)", "$1 ")).otherwise(plain)
    return (
        F.when(kind == "email", email)
        .when(kind == "iban", body)
        .when(kind == "ip", ip)
        .when(kind == "ipv6", _ipv6_pseudonym(key, value))
        .when(kind == "date", _date_pseudonym(key, value))
        .when(kind == "phone", phone)
        .when(kind == "ssn", _ssn_pseudonym(key, value))
        .otherwise(value)
    )


def card_pseudonym(text: Column, key: str) -> Column:
    own = let(digits_of(text), lambda d: let(permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1)), lambda p: refill(text, F.concat(p, luhn_digit(p)))))
    return F.array(F.struct(F.lit("card").alias("kind"), own.alias("new")))


def _beside(text: Column, key: str) -> Column:
    """(kind, new) of what a run holds beside cards: dates, phone and nine-digit numbers, and the rest as it is."""
    kind = lambda v: (
        F.when(v.rlike(SSN), F.lit("ssn"))
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.when(let(_date(v), lambda d: d["day"].isNotNull()), F.lit("date")))
        .when(v.rlike(r"^\d{3}[ -]\d{3}[ -]\d{4}$"), F.lit("phone"))
    )
    new = lambda v, k: F.when(k == "ssn", _ssn_pseudonym(key, v)).when(k == "date", _date_pseudonym(key, v)).when(k == "phone", refill(v, permute_digits(key, "phone", digits_of(v)))).otherwise(v)
    found = F.transform(F.regexp_extract_all(text, F.lit(BESIDE), 0), lambda v: let(kind(v), lambda k: F.struct(k.alias("kind"), new(v, k).alias("new"))))
    plain = lambda t: F.struct(F.lit(None).cast("string").alias("kind"), t.alias("new"))
    return F.flatten(F.zip_with(F.split(text, BESIDE, -1), found, lambda g, x: F.filter(F.array(plain(g), x), lambda y: y.isNotNull())))


def run_pseudonyms(run: Column, key: str) -> Column:
    """(kind, new) of the pieces of a run of digits, in order; a null kind: left as it is."""
    return F.flatten(F.transform(card_pieces(run), lambda p: F.when(p["card"], card_pseudonym(p["text"], key)).otherwise(_beside(p["text"], key))))


def _free(name: str, taken: list[str]) -> str:
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def pseudonymise(docs: DataFrame, key: str, column: str = "text", kinds: str | None = "pii_kinds") -> DataFrame:
    """``docs`` with personal data in ``column`` replaced, and ``kinds``, the kinds replaced in order of their places.

    A null text stays null and has no kinds; empty texts stay empty; repeated rows get equal texts. All other columns stay;
    an input column named as ``kinds`` is replaced; without ``kinds`` no column is added. Works row by row, without a shuffle.
    """
    text, found = F.col(column), _free("_found", docs.columns)
    one = lambda v, k: F.array(F.struct(k.alias("kind"), pseudonym(v, k, key).alias("new")))
    new = F.transform(F.regexp_extract_all(text, F.lit(ANY), 0), lambda v: let(kind_of(v), lambda k: F.when(k == "run", run_pseudonyms(v, key)).otherwise(one(v, k))))
    none = F.array().cast("array<array<struct<kind:string,new:string>>>")
    some = F.when(text.rlike("[0-9@]"), new).otherwise(none)  # every format has a digit or an @
    out = docs.withColumn(found, some)
    gaps = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(gaps, found, lambda g, n: F.concat(g, F.coalesce(F.array_join(F.transform(n, lambda x: x["new"]), ""), F.lit("")))), "")
    out = out.withColumn(column, F.when(F.size(found) > 0, joined).otherwise(text))
    if kinds is not None:
        out = out.withColumn(kinds, F.when(F.col(column).isNull(), F.array().cast("array<string>")).otherwise(F.filter(F.transform(F.flatten(found), lambda x: x["kind"]), lambda k: k.isNotNull())))
    return out.drop(found)
