"""Feistel pseudonyms: formats, validity, permutation, linking."""

import datetime
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from funnelyard.llm import pii as P
from funnelyard.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def luhn(s):
    digits = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def clean(spark, texts, key="k"):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return [(r.clean_text, [x.kind for x in r.replaced]) for r in P.pseudonymise(df, "text", key).collect()]


def network(x, a, b, key, kind):
    """The number permutation in plain Python."""
    left, right = divmod(x, b)
    for i in range(P.ROUNDS):
        own = right if i % 2 == 0 else left
        shift = int(hashlib.sha512(f"{key}|{kind}|{i}|{own}".encode()).hexdigest()[:14], 16)
        if i % 2 == 0:
            left = (left + shift) % a
        else:
            right = (right + shift) % b
    return left * b + right


def test_query_changes_valid_data_only(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op5_feistel_pseudonyms"](spark, SF).collect()
    assert len(rows) == len(text)
    shapes = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]+@[a-z0-9.]+\.com|\+1 \(\d{3}\) \d{3}-\d{4}|(?<!\d)\d{16}(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])|\"[0-9a-f]{40}\"")
    links, found = {}, 0
    for r in rows:
        before, after = shapes.findall(text[r.doc_id]), shapes.findall(r.text)
        assert shapes.sub("#", text[r.doc_id]) == shapes.sub("#", r.text)  # nothing else changed
        for a, b in zip(before, after, strict=True):
            if re.fullmatch(r"\d{16}", a) and not luhn(a):
                assert a == b
            else:
                assert a != b and links.setdefault(a, b) == b
                assert not re.fullmatch(r"\d{16}", a) or luhn(b)
                found += 1
        assert r.n_replaced == sum(a != b for a, b in zip(before, after))
    assert found > 40 and len(set(links.values())) == len(links)


KEPT = [
    ("4111 1111-1111 1111", "card", r"\d{4} \d{4}-\d{4} \d{4}"), ("2024-02-29", "date", r"\d{4}-\d\d-\d\d"), ("12/31/1999", "date", r"\d\d/\d\d/\d{4}"),
    ("31.12.1999", "date", r"\d\d\.\d\d\.\d{4}"), ("10.0.0.255", "ipv4", r"\d+\.\d+\.\d+\.\d+"), ("(212) 555-0100", "nanp", r"\([2-9]\d\d\) [2-9]\d\d-\d{4}"),
    ("+49 30 1234567", "phone", r"\+49 \d\d \d{7}"), ("123-45-6789", "ssn", r"\d{3}-\d\d-\d{4}"), ("Ab.c9@x.example.com", "email", r"[A-Z][a-z]\.[a-z]\d@x\.example\.com"),
    ('token = "24be64439e3e49cf"', "secret", r'token = "[0-9a-f]{16}"')]
FAILING = ["4111111111111112", "2023-02-29", "13/13/2020", "1.2.3.256", "01.2.3.4", "(112) 555-0100", "000-12-3456", "+12 3456",
           "version 1.2.3", "12345", "a@b", "x1.2.3.4.5", "1799-12-31"]


def test_formats_are_kept_and_what_fails_its_check_stays(spark):
    texts = [f"see {t}, twice {t}." for t, _, _ in KEPT] + [t for t, _, _ in KEPT] + FAILING
    got, others = clean(spark, texts), clean(spark, [t for t, _, _ in KEPT], "other key")
    n = len(KEPT)
    for (text, kind, shape), (new, kinds), (again, _), (other, _) in zip(KEPT, got, got[n:], others):
        assert kinds == [kind, kind] and re.fullmatch(shape, again) and again != text and new == f"see {again}, twice {again}." and other != again, text
    assert got[2 * n:] == [(t, []) for t in FAILING]


def test_number_permutation_is_one_and_equals_the_plain_network(spark):
    rows = spark.range(189 * 773).select("id", P.permute_number(F.col("id"), P.CYCLE, F.lit("k"), "date").alias("y")).collect()
    assert sorted(r.y for r in rows) == list(range(189 * 773))
    assert all(r.y == network(r.id, 189, 773, "k", "date") for r in rows[::5000])


@pytest.mark.parametrize("width", [1, 2, 3])
def test_string_permutation_is_one(spark, width):
    rows = spark.range(10 ** width).select(P.permute_chars(F.lpad(F.col("id").cast("string"), width, "0"), ("0123456789",), F.lit("k"), "t").alias("y")).collect()
    assert sorted(r.y for r in rows) == [str(i).zfill(width) for i in range(10 ** width)]


def test_all_cards_of_a_prefix_stay_apart_and_valid(spark):
    df = spark.range(500).select(F.concat(F.lit("400000000000"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("b"))
    digits = [r.b for r in df.collect()]
    cards = [next(d + str(c) for c in range(10) if luhn(d + str(c))) for d in digits]
    new = [t for t, _ in clean(spark, cards)]
    assert len(set(new)) == 500 and all(luhn(t) for t in new)


def test_dates_stay_in_the_calendar(spark):
    for t, _ in clean(spark, ["1800-01-01", "2199-12-31", "2000/02/29"]):
        datetime.date.fromisoformat(t.replace("/", "-"))


def test_nulls_empty_long_texts_clashing_columns_and_empty_table(spark):
    long = "word " * 200_000 + "10.0.0.1 " + "9" * 50_000 + " " + "a" * 50_000 + "@"
    got = clean(spark, [None, "", long, "10.0.0.1", "10.0.0.1"])
    assert got[:2] == [(None, []), ("", [])] and got[2][1] == ["ipv4"] and got[3] == got[4]
    assert got[2][0] == long.replace("10.0.0.1", got[3][0])
    df = spark.createDataFrame([("10.0.0.1", 1, 2)], "text string, Replaced int, clean_text int")
    assert P.pseudonymise(df, "text", "k").columns == ["text", "clean_text", "replaced"]
    assert P.pseudonymise(df.limit(0), "text", "k").count() == 0
