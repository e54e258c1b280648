"""Pseudonyms turned back with the key by plain Python, and every format one-to-one."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from eventide.llm.pii import ROUNDS, pseudonymise

KEY = "k"


def shift(kind: str, i: int, half) -> str:
    return hashlib.sha512(f"{KEY}|{kind}|{i}|{half}".encode()).hexdigest()


def back(kind: str, left: int, right: int, size_left: int, size_right: int) -> tuple[int, int]:
    """The pair that the Feistel rounds turn into this one."""
    for i in reversed(range(ROUNDS)):
        if i % 2 == 0:
            left = (left - int(shift(kind, i, right)[:15], 16)) % size_left
        else:
            right = (right - int(shift(kind, i, left)[:15], 16)) % size_right
    return left, right


def digits_back(kind: str, digits: str) -> str:
    half = len(digits) // 2
    a, b = back(kind, int("0" + digits[:half]), int(digits[half:]), 10**half, 10 ** (len(digits) - half))
    return (f"{a:0{half}}" if half else "") + f"{b:0{len(digits) - half}}"


def letters_back(kind: str, text: str) -> str:
    half = len(text) // 2
    left, right = text[:half], text[half:]

    def turned(part: str, stream: str) -> str:
        out = ""
        for at, c in enumerate(part):
            by = int(stream[2 * (at % 64) : 2 * (at % 64) + 2], 16)
            for first, n in ((97, 26), (65, 26), (48, 10)):
                if first <= ord(c) < first + n:
                    c = chr(first + (ord(c) - first - by) % n)
                    break
            out += c
        return out

    for i in reversed(range(ROUNDS)):
        left, right = (turned(left, shift(kind, i, right)), right) if i % 2 == 0 else (left, turned(right, shift(kind, i, left)))
    return left + right


def fill(form: str, digits: str) -> str:
    own = iter(digits)
    return re.sub(r"\d", lambda _: next(own), form)


def luhn_digit(payload: str) -> str:
    d = [int(c) for c in reversed(payload)]
    return str(-sum(x if i % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(d)) % 10)


def iban(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02}{body}"


def restored(kind: str, text: str) -> str:
    plain = re.sub(r"\D", "", text)
    if kind == "card":
        own = digits_back(kind, plain[:-1])
        return fill(text, own + luhn_digit(own))
    if kind == "phone":
        code = re.match(r"(?:\+\d{1,3}(?=[ .(-]))?", text)[0]
        return code + fill(text[len(code) :], digits_back(kind, re.sub(r"\D", "", text[len(code) :])))
    if kind == "ip":
        a, b, c, d = map(int, text.split("."))
        left, right = back(kind, a * 256 + b, c * 256 + d, 65536, 65536)
        return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
    if kind == "email":
        return letters_back(kind, text.split("@")[0]) + "@" + text.split("@")[1]
    if kind == "iban":
        own = text.replace(" ", "")
        whole = iban(own[:2], letters_back(kind, own[4:]))
        return " ".join(re.findall(".{1,4}", whole)) if " " in text else whole
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        late = area >= 900
        n = area - 900 if late else area - 1 - (area > 666)
        left, right = back(kind, n * 99 + group - 1, serial - 1, (100 if late else 898) * 99, 9999)
        n = left // 99
        return f"{n + 900 if late else n + 1 + (n >= 665):03}-{left % 99 + 1:02}-{right + 1:04}"
    a, b, c = (int(x) for x in re.findall(r"\d+", text))
    first = lambda y: datetime.date(200 + (y - 200) // 400 * 400, 1, 1)
    sep = re.search(r"\D", text)[0]
    if sep == "-" or b <= 12:
        day = datetime.date(a, b, c) if sep == "-" else datetime.date(c, b, a)
        n = (day - first(day.year)).days
        left, right = back("date", n // 773, n % 773, 189, 773)
        day = first(day.year) + datetime.timedelta(left * 773 + right)
        return f"{day:%Y-%m-%d}" if sep == "-" else f"{day.day:02}{sep}{day.month:02}{sep}{day.year:04}"
    late = [d for d in (first(c) + datetime.timedelta(i) for i in range(146_097)) if d.day > 12]
    n = late.index(datetime.date(c, a, b))
    left, right = back("late-date", n // 9833, n % 9833, 9, 9833)
    day = late[left * 9833 + right]
    return f"{day.month:02}/{day.day:02}/{day.year:04}"


def values() -> list[tuple[str, str]]:
    r = random.Random(8)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    out = []
    for _ in range(12):
        for n in (13, 15, 16, 19):
            own = number(n - 1)
            out.append(("card", own + luhn_digit(own)))
        own = number(15)
        out.append(("card", fill("0000 0000 0000 0000", own + luhn_digit(own))))
        out += [("phone", f"+49 {number(2)} {number(4)}"), ("phone", f"({number(3)}) {number(3)}-{number(4)}"), ("phone", f"+1 ({number(3)}) {number(3)}-{number(4)}")]
        out.append(("ip", ".".join(str(r.randrange(256)) for _ in range(4))))
        out.append(("email", f"{r.choice(['ann', 'Bo.Lee', 'x', 'k_9+a', 'jo-anne.of.the.hill77'])}{number(2)}@mail.example.com"))
        german = iban("DE", number(18))
        out += [("iban", german), ("iban", " ".join(re.findall(".{1,4}", german))), ("iban", iban("GB", "WEST" + number(14)))]
        out.append(("ssn", f"{r.choice([1, 665, 667, 899, 900, 999, 123]):03}-{r.randrange(1, 100):02}-{r.randrange(1, 10000):04}"))
        day = datetime.date(1800, 1, 1) + datetime.timedelta(r.randrange(146_097))
        out += [("date", f"{day:%Y-%m-%d}"), ("date", f"{day:%d.%m.%Y}"), ("date", f"{day:%d/%m/%Y}"), ("date", f"{day.month:02}/{r.randrange(13, 29)}/{day.year}")]
    return out


def test_pseudonyms_turn_back_with_the_key(spark):
    own = values()
    docs = spark.createDataFrame([(i, f"so {v} it is") for i, (_, v) in enumerate(own)], "doc_id long, text string")
    for r in pseudonymise(docs, KEY).collect():
        kind, value = own[r["doc_id"]]
        assert list(r["pii_kinds"]) == [kind], (value, r)
        assert restored(kind, r["text"].removeprefix("so ").removesuffix(" it is")) == value, (kind, value, r["text"])


@pytest.mark.parametrize("form, late, n", [("yyyy-MM-dd", False, 146_097), ("dd.MM.yyyy", False, 146_097), ("dd/MM/yyyy", False, 146_097), ("MM/dd/yyyy", True, 88_497), ("d.M.yyyy", False, 146_097)])
def test_dates_are_one_to_one_in_every_form(spark, form, late, n):
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    docs = days.where(F.dayofmonth("day") > 12) if late else days
    found = pseudonymise(docs.select("day", F.date_format("day", form).alias("text")), KEY)
    new = F.to_date("text", "dd/MM/yyyy" if form == "dd/MM/yyyy" else form.replace("dd", "d").replace("MM", "M") if "-" not in form else form)
    got = found.select("day", "text", new.alias("new")).agg(F.count("*"), F.count_distinct("text"), F.count_distinct("new"), F.min(F.dayofmonth("new")), F.min(F.year("new")), F.max(F.year("new")), F.sum((F.col("day") == F.col("new")).cast("int"))).first()
    assert tuple(got)[:3] == (n, n, n) and got[3] == (13 if late else 1)
    assert 1800 <= got[4] and got[5] <= 2199 and got[6] < 20


def test_slash_dates_never_meet(spark):
    """All that a date with slashes can be read as: day first, or month first where the second number can't be a month."""
    days = spark.range(146_097).select(F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    docs = days.select(F.date_format("day", "dd/MM/yyyy").alias("text")).union(days.where(F.dayofmonth("day") > 12).select(F.date_format("day", "MM/dd/yyyy").alias("text")))
    assert pseudonymise(docs, KEY).agg(F.count_distinct("text")).first()[0] == docs.count() == 234_594


def test_days_stay_linked_however_they_are_written(spark):
    docs = spark.createDataFrame([(0, "1984-02-29"), (1, "29.02.1984"), (2, "29/2/1984")], "doc_id long, text string")
    out = [sorted(map(int, re.findall(r"\d+", r["text"]))) for r in pseudonymise(docs, KEY).collect()]
    assert out[0] == out[1] == out[2] and "1984" not in str(out)


def test_what_is_no_valid_value_stays(spark):
    own = ["000-00-0000", "666-12-1234", "123-00-1234", "v1.2.3.4", "2023-02-30", "0150-01-01", "12:30:45", "a::b", "order 5550100200", "4111 1111 1111 1112"]
    docs = spark.createDataFrame(list(enumerate(own)), "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in pseudonymise(docs, KEY).collect()} == dict(enumerate(own))


def test_further_forms(spark):
    own = ["jürgen.meyer@bücher.example", "иван@пример.рф", "2001:db8::1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "tel. 5550100200"]
    forms = [r"[^\W\d]{6}\.[a-z]{5}@bücher\.example", r"[а-я]{4}@пример\.рф", r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]", r"[0-9a-f]{4}(:[0-9a-f]{4}){7}", r"tel\. \d{10}"]
    for r in pseudonymise(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), KEY).collect():
        assert re.fullmatch(forms[r["doc_id"]], r["text"]) and r["text"] != own[r["doc_id"]]
        assert not r["text"].startswith("jü")


def test_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([("10.0.0.1", "mine", "too")], "text string, PII_KINDS string, _found string")
    (r,) = pseudonymise(docs, KEY, kinds=None).collect()
    assert r["PII_KINDS"] == "mine" and r["_found"] == "too" and r["text"] != "10.0.0.1"
    (r,) = pseudonymise(docs.drop("PII_KINDS").withColumn("pii_kinds", F.lit("mine")), KEY).collect()
    assert r["pii_kinds"] == ["ip"]


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + at % 2), 10)) for at, c in enumerate(reversed(digits))) % 10 == 0


def cards_of(run):
    """(start, end) of the cards in a run of digits, spaces and hyphens: those written in fours or at once first, then any."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"\d+", run)]
    formed = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}|\d{4}([ -])\d{6}\2\d{4,5}"
    taken = []
    for mostly in (True, False):
        gaps, at = [], 0
        for a, b in [*sorted(taken), (len(run), len(run))]:
            gaps.append((at, a))
            at = b
        for low, high in gaps:
            end = low
            for start, _ in spans:
                if start < end or start >= high:
                    continue
                texts = [(start, b) for a, b in spans if a >= start and b <= high][:19]
                good = [x for x in texts if 13 <= len(re.sub(r"\D", "", run[x[0] : x[1]])) <= 19 and luhn(re.sub(r"\D", "", run[x[0] : x[1]])) and (not mostly or re.fullmatch(formed, run[x[0] : x[1]]))]
                if good:
                    taken.append(good[-1])
                    end = good[-1][1]
    return sorted(taken)


def test_cards_beside_any_numbers(spark):
    """Runs of digit groups against a search by hand: all cards are replaced and turn back, nothing else changes."""
    rng = random.Random(12)

    def card():
        own = "".join(rng.choice("0123456789") for _ in range(rng.choice([12, 14, 15, 15, 15, 18])))
        own += next(c for c in "0123456789" if luhn(own + c))
        return own if len(own) != 16 or rng.random() < 0.3 else rng.choice(" -").join(own[i : i + 4] for i in range(0, 16, 4))

    texts = ["Order 12345 4111 1111 1111 1111", "zip 90210 4111-1111-1111-1111", "12 34 4111 1111 1111 1111", "4111 1111 1111 1111 90210 and more", "4111  1111 1111 1111 5500 0000 0000 0004"]
    while len(texts) < 1500:
        parts = [card() if rng.random() < 0.4 else "".join(rng.choice("0123456789") for _ in range(rng.choice([1, 2, 5, 6, 7, 8]))) for _ in range(rng.randint(1, 6))]
        text = parts[0]
        for p in parts[1:]:
            text += rng.choice([" ", " ", "-", "  "]) + p
        if not re.search(r"(?<!\d)(\d{4}-\d{2}-\d{2}|\d{3}-\d{2}-\d{4}|\d{3}[ -]\d{3}[ -]\d{4})(?!\d)", text):
            texts.append(rng.choice(["", "no. ", "x"]) + text + rng.choice(["", ".", " a"]))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = 0
    for r in pseudonymise(rows, KEY).collect():
        old, new = texts[r["doc_id"]], r["text"]
        assert len(old) == len(new)
        run = re.search(r"(?<!\d)\d[\d -]{11,}\d(?![\w@/]|[.:]\d)", old)
        found = [(run.start() + a, run.start() + b) for a, b in cards_of(run[0])] if run else []
        assert r["pii_kinds"] == ["card"] * len(found), old
        at = 0
        for a, b in [*found, (len(old), len(old))]:
            assert old[at:a] == new[at:a]
            at = b
            if a < b:
                was, now = (re.sub(r"\D", "", t[a:b]) for t in (old, new))
                assert luhn(now) and digits_back("card", now[:-1]) == was[:-1] and re.sub(r"\d", "", old[a:b]) == re.sub(r"\d", "", new[a:b])
        some += len(found)
    assert some > 800


def test_what_stands_beside_cards_in_a_run(spark):
    rows = spark.createDataFrame([(1, "4111 1111 1111 1111 2024-01-13 555-123-4567 7"), (2, "4111111111111111 7 123-45-6789"), (3, "1 2 " * 50_000)], "doc_id long, text string")
    found = {r["doc_id"]: r for r in pseudonymise(rows, KEY).collect()}
    assert found[1]["pii_kinds"] == ["card", "date", "phone"] and found[1]["text"].endswith(" 7") and "2024-01-13" not in found[1]["text"] and "555-123-4567" not in found[1]["text"]
    assert found[2]["pii_kinds"] == ["card", "ssn"] and len(found[3]["text"]) == 200_000
