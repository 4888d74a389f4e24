"""Pseudonyms: formats, checks, links, and the permutations themselves."""

import datetime
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from loomql.llm import op5_pseudonyms as op


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text):
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def replaced(spark, texts, key=op.KEY):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    return [r["text"] for r in op.pseudonymise(df, key).orderBy("row.doc_id").collect()]


def shape(text):
    return re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", text)))


VALUES = ["mail ab.19@mail5.example.com ok", "call +1 (743) 555-3824 now", "card 4381893557741609.", "card 4111 1111 1111 1111", "ip 8.196.197.208", "iban DE89370400440532013000", "iban GB82 WEST 1234 5698 7654 32", "born 1990-02-03", "born 31.12.1999", "born 12/25/2001", "ssn 123-45-6789", "call 213-555-0198 home"]


def test_formats_are_kept_and_values_change(spark):
    for before, after in zip(VALUES, replaced(spark, VALUES)):
        if "ip " in before:
            assert re.fullmatch(r"ip \d+\.\d+\.\d+\.\d+", after) and all(int(x) < 256 for x in after[3:].split("."))
        else:
            assert shape(before) == shape(after) and len(before) == len(after)
        assert before != after and before.split()[0] == after.split()[0]


def test_checks_hold_afterwards(spark):
    cards = ["4381893557741609", "4111111111111111", "5500000000000004", "340000000000009", "6011000000000004"]
    got = replaced(spark, cards)
    assert all(luhn(x) for x in got) and len(set(got)) == len(cards)
    assert all(iban(x) for x in replaced(spark, ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"]))
    for x in replaced(spark, ["1990-02-03", "2000-02-29", "1900-01-01", "2099-12-31"]):
        assert datetime.date(1900, 1, 1) <= datetime.date.fromisoformat(x) <= datetime.date(2099, 12, 31)


@pytest.mark.parametrize("text", ["n 2123465659789240 no card", "999.1.1.1", "2001-02-30", "31.02.1999", "DE89370400440532013001", "version 4.0.", "3. section 12", "no digits at all", "", None, "000-45-6789", "1.2.3", "a@b", "50% of 2024"])
def test_what_fails_its_check_stays(spark, text):
    assert replaced(spark, [text]) == [text]


def test_equal_values_stay_linked_and_keys_differ(spark):
    a = replaced(spark, ["x ab.19@mail5.example.com y", "ab.19@mail5.example.com, ab.19@mail5.example.com!"])
    assert len({m for t in a for m in re.findall(r"[\w.]+@[\w.]+\w", t)}) == 1
    assert replaced(spark, VALUES) == replaced(spark, VALUES) != replaced(spark, VALUES, "another key")
    day = replaced(spark, ["1990-02-03", "03.02.1990", "02/03/1990"])
    assert day[0].split("-") == day[1].split(".")[::-1] == [day[2].split("/")[2], *day[2].split("/")[:2]]


def test_secrets(spark):
    lower, upper = replaced(spark, ['token = "1eb9c654e721b4f812088970e66a6345cee33dd6"###', 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!!'])
    assert re.fullmatch(r'token = "[0-9a-f]{40}"###', lower) and re.fullmatch(r'TOKEN = "[0-9A-F]{40}"!!', upper)
    assert "1eb9c654" not in lower and "9233A8EC" not in upper


JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P"


def test_secrets_of_any_length_and_shape(spark):
    values = ["gh12cd34ef", "hunter2", JWT, "1234567890123456", "AK12ABCDEFGHIJKLMNOP", "2024-01-02", "+14155552671", "aB3" * 43, "0f" * 300, "Zx9-" * 5000]
    for value, after in zip(values, replaced(spark, [f"api_key={v}. end" for v in values])):
        assert after.startswith("api_key=") and after.endswith(". end") and len(after) == len(value) + 13
        new = after[8:-5]
        assert new != value and (re.fullmatch("[0-9a-f]+", new) if re.fullmatch("[0-9a-f]+", value) else shape(new) == shape(value))
        assert not set(re.findall("[A-Za-z0-9_]{12,}", value)) & set(re.findall("[A-Za-z0-9_]{12,}", new))
    df = spark.createDataFrame([(0, "token=1234567890123456 card 4111111111111111")], "doc_id int, text string")
    assert [f["kind"] for f in op.pseudonymise(df).first()["found"]] == ["secret", "card"]


def test_ibans_beside_other_words(spark):
    value = "BE68 5390 0754 7034"
    (alone,) = replaced(spark, [value])
    assert iban(alone) and alone != value
    around = ["PAY {} NOW", "{} THEN", "{} NOWHERE TO", "AC12 {}", "AB12 CD34 {} OK", "{} {}", "to {}, or {} A1"]
    assert replaced(spark, [t.replace("{}", value) for t in around]) == [t.replace("{}", alone) for t in around]
    card, together = replaced(spark, ["4111 1111 1111 1111", f"{value} 4111 1111 1111 1111"])
    assert together == f"{alone} {card}"
    assert replaced(spark, ["AB12 4111 1111 1111 1111"]) == [f"AB12 {card}"]
    assert replaced(spark, ["AB12 CDEF GHIJ KLMN"]) == ["AB12 CDEF GHIJ KLMN"]


def test_permutations_are_permutations(spark):
    """Every value of a small domain has its own image in the domain."""
    digits = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("v"))
    got = {r[0] for r in digits.select(F.expr(op.feistel_text("v", "k", "t"))).collect()}
    assert got == {f"{i:03d}" for i in range(1000)}
    letters = spark.range(2600).select(F.concat(F.chr((F.col("id") / 100).cast("int") + 97), F.lit("-"), F.lpad((F.col("id") % 100).cast("string"), 2, "0")).alias("v"))
    assert letters.select(F.expr(op.feistel_text("v", "k", "t")).alias("x")).distinct().where("x RLIKE '^[a-z]-[0-9]{2}$'").count() == 2600
    days = spark.range(73049).select(F.expr(op.feistel_pair("id", 4297, 17, "k", "d")).alias("x"))
    assert days.agg(F.countDistinct("x"), F.min("x"), F.max("x")).first()[:] == (73049, 0, 73048)
    hexes = spark.range(256).select(F.lpad(F.lower(F.hex("id")), 2, "0").alias("v"))
    assert hexes.select(F.expr(op.feistel_text("v", "k", "t", hexadecimal=True)).alias("x")).distinct().count() == 256


def test_many_values_in_one_text(spark):
    rng = random.Random(0)
    text = " ".join(rng.choice(VALUES) for _ in range(300))
    (after,) = replaced(spark, [text])
    assert len(after.split(" ")) == len(text.split(" ")) and "ab.19@" not in after and "8.196.197.208" not in after


def test_awkward_rows(spark, odd, empty, docs):
    done = op.pseudonymise(odd)
    assert done.count() == odd.count()
    same = done.where(~F.col("text").eqNullSafe(F.col("row.text"))).count()
    assert same == 0  # nothing personal in them
    assert done.select("row.*").columns == odd.columns
    assert op.pseudonymise(empty).count() == 0
    long = "9" * 100_000 + " " + "a" * 100_000 + "@" + "1 " * 1000
    assert replaced(spark, [long]) == [long]


def test_social_security_numbers_stay_valid_and_reversible(spark):
    """Every pseudonym has a valid area, group and serial number; different numbers have different ones."""
    rng = random.Random(9)
    edge = ["001-01-0001", "899-99-9999", "665-99-9999", "667-01-0001"]
    numbers = edge + [f"{rng.choice([a for a in range(1, 900) if a != 666]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(1500)]
    made = replaced(spark, [f"ssn {n}." for n in numbers])
    assert all(re.fullmatch(r"ssn (?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\.", m) for m in made)
    assert len(set(made)) == len(set(numbers)) and sum(a == b for a, b in zip(numbers, made)) == 0


def plain_shift(key, tag, turn, other, at):
    digest = hashlib.sha512(f"{key}|{tag}|{turn}|{','.join(map(str, other))}".encode()).hexdigest()
    return int(digest[4 * (at % 32) : 4 * (at % 32) + 4], 16)


def plain_text(value, key, tag):
    """The Feistel network over characters in plain Python."""
    sets = (("0", 10), ("a", 26), ("A", 26))
    cells = [next(((ord(c) - ord(a), r, a) for a, r in sets if 0 <= ord(c) - ord(a) < r), None) for c in value]
    moved = [c for c in cells if c]
    half = len(moved) // 2
    left, right = [c[0] for c in moved[:half]], [c[0] for c in moved[half:]]
    for k in range(1, op.ROUNDS + 1):
        if k % 2:
            left = [(x + plain_shift(key, tag, k, right, i)) % moved[i][1] for i, x in enumerate(left)]
        else:
            right = [(x + plain_shift(key, tag, k, left, i)) % moved[half + i][1] for i, x in enumerate(right)]
    new = iter([chr(ord(c[2]) + v) for c, v in zip(moved, left + right)])
    return "".join(next(new) if c else v for c, v in zip(cells, value))


def plain_pair(number, low, high, key, tag):
    left, right = divmod(number, low)
    for k in range(1, op.ROUNDS + 3):
        if k % 2:
            left = (left + plain_shift(key, tag, k, [right], 0)) % high
        else:
            right = (right + plain_shift(key, tag, k, [left], 0)) % low
    return left * low + right


def test_permutations_equal_plain_python(spark):
    phones = ["213-555-0198", "(743) 555-3824"]
    cards = ["4381893557741609", "4111 1111 1111 1111"]
    ips = ["8.196.197.208", "255.0.0.1"]
    numbers = ["123-45-6789", "899-99-9999"]
    got = replaced(spark, [f"x {v} y" for v in phones + cards + ips + numbers])
    want = [plain_text(p, op.KEY, "phone") for p in phones]
    for c in cards:
        body = plain_text(c[:-1], op.KEY, "card")
        want.append(body + next(d for d in "0123456789" if luhn(re.sub("[^0-9]", "", body + d))))
    for i in ips:
        a = [int(x) for x in i.split(".")]
        n = plain_pair(((a[0] * 256 + a[1]) * 256 + a[2]) * 256 + a[3], 65536, 65536, op.KEY, "ip")
        want.append(".".join(str(n >> s & 255) for s in (24, 16, 8, 0)))
    for s in numbers:
        a, g, r = map(int, s.split("-"))
        n = plain_pair(((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + r - 1, 29997, 29634, op.KEY, "ssn")
        area = n // 989901 + 1
        want.append(f"{area + (area >= 666):03}-{n // 9999 % 99 + 1:02}-{n % 9999 + 1:04}")
    assert got == [f"x {w} y" for w in want]


def test_query_and_key(spark, small, docs):
    """The query's findings are where its texts differ; another key gives other pseudonyms."""
    rows = {r["doc_id"]: r for r in op.op5_pseudonyms(spark, small).collect()}
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all((rows[i]["text"] != t) == (rows[i]["n_found"] > 0) and (rows[i]["n_found"] > 0) == (rows[i]["kinds"] != "") for i, t in before.items())
    spark.conf.set(op.KEY_SETTING, "another")
    try:
        other = {r["doc_id"]: r for r in op.op5_pseudonyms(spark, small).collect()}
    finally:
        spark.conf.unset(op.KEY_SETTING)
    assert all((rows[i]["n_found"], rows[i]["kinds"]) == (other[i]["n_found"], other[i]["kinds"]) for i in rows) and any(rows[i]["text"] != other[i]["text"] for i in rows)
    assert "Python" not in op.pseudonymise(docs)._jdf.queryExecution().executedPlan().toString()
