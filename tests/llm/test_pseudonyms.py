"""Pseudonyms: every format is permuted one to one within itself, and can be undone where it is a plain network."""

import datetime
import itertools
import re

import pytest
from pyspark.sql import functions as F

from shotloom.llm import pseudonyms as P


def moved(spark, values, key="k"):
    """{value: pseudonym} of texts that are one value each."""
    rows = spark.createDataFrame([(v,) for v in values], "text string")
    out = P.pseudonymize(rows.withColumn("was", F.col("text")), key).collect()
    return {r.was: r.text for r in out}


def test_small_domains_are_permuted_whole(spark):
    for symbols, n in ((P._DIGITS, 3), (P._SMALL, 2), (P._HEX, 2), (P._DIGITS, 1)):
        values = ["".join(v) for v in itertools.product(symbols, repeat=n)]
        rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", P.permute(F.col("v"), "k", symbols == P._HEX).alias("p"))
        got = {r.v: r.p for r in rows.collect()}
        assert set(got.values()) == set(values)
        assert n == 1 or sum(a == b for a, b in got.items()) < 12
    values = [a + d + b for a in "abc" for d in P._DIGITS for b in P._LARGE]
    got = [r.p for r in spark.createDataFrame([(v,) for v in values], "v string").select(P.permute(F.col("v"), "k").alias("p")).collect()]
    assert len(set(got)) == len(values) and all(re.fullmatch("[a-z][0-9][A-Z]", v) for v in got)


def test_strings_of_any_length_come_back(spark):
    values = ["7", "0" * 19, "1" * 26, "5" * 27, "12" * 40, "9" * 500, ""]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    for r in rows.select("v", P.permute_digits(F.col("v"), "k").alias("p")).withColumn("b", P.permute_digits(F.col("p"), "k", True)).collect():
        assert r.b == r.v and len(r.p) == len(r.v) and (len(r.v) < 2 or r.p != r.v)
    near = [r.p for r in rows.limit(0).unionByName(spark.createDataFrame([("1" * 60,), ("1" * 59 + "2",), ("2" + "1" * 59,)], "v string")).select(P.permute_digits(F.col("v"), "k").alias("p")).collect()]
    for a, b in itertools.combinations(near, 2):  # one digit anywhere changes the rest
        assert sum(x != y for x, y in zip(a, b, strict=True)) > 35


def layouts():
    day = datetime.date(1900, 1, 1)
    while day.year < 2100:
        yield f"{day:%Y-%m-%d}", f"{day:%d/%m/%Y}", f"{day.day}/{day.month}/{day.year}", f"{day.day}.{day:%m}.{day.year}", f"{day:%d}.{day.month}.{day.year}", f"{day:%m/%d/%Y}" if day.day > 12 else None, f"{day.month}/{day.day}/{day.year}" if day.day > 12 else None
        day += datetime.timedelta(1)


def test_dates_keep_their_layout_and_stay_apart(spark):
    step = 97
    every = list(layouts())
    assert len(every) == P.DAYS
    values = {v for row in every[::step] for v in row if v}
    got = moved(spark, sorted(values))
    assert len(set(got.values())) == len(values)
    shape = lambda v: re.sub("[0-9]+", lambda m: str(len(m[0])), v)
    for a, b in got.items():
        parts = [int(x) for x in re.split("[-/.]", b)]
        assert shape(a) == shape(b), (a, b)
        y, m, d = parts if "-" in b else (parts[2], parts[1], parts[0])
        if "-" not in a and int(re.split("[/.]", a)[1]) > 12:
            m, d = d, m
            assert d > 12
        datetime.date(y, m, d)
    small = [f"{d}/{m}/{y}" for d in range(1, 10) for m in range(1, 10) for y in range(1900, 2100)]
    assert set(moved(spark, small).values()) == set(small)  # the whole layout of one-digit days and months
    odd = ["31/02/2020", "30.02.1999", "99/99/2000", "0/0/1990"]
    new = moved(spark, odd)
    assert all(new[v] != v and shape(new[v]) == shape(v) for v in odd)


def iban(country, body):
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - number % 97:02}{body}"


def test_ibans_stay_valid(spark):
    def rest(v):
        v = v.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97

    good = [iban("DE", f"{370400440532013000 + k}") for k in range(300)] + [iban("GB", f"WEST{12345698765400 + k}") for k in range(50)]
    bad = ["DE00370400440532013000", "GB82WEST12345698765499"]
    spaced = " ".join(re.findall(".{1,4}", good[0]))
    got = moved(spark, [*good, *bad, spaced])
    assert len(set(got.values())) == len(got) and all(got[v] != v and got[v][:2] == v[:2] for v in got)
    assert all(rest(got[v]) == 1 for v in good) and all(rest(got[v]) != 1 for v in bad)
    assert got[spaced].replace(" ", "") == got[good[0]] and [len(x) for x in got[spaced].split()] == [len(x) for x in spaced.split()]


def test_cards_stay_valid_and_others_invalid(spark):
    def luhn(v):
        return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(v[::-1])) % 10

    values = [str(4111111111111100 + k) for k in range(300)]
    got = moved(spark, values)
    assert len(set(got.values())) == 300
    assert all((luhn(a) == 0) == (luhn(b) == 0) and a != b for a, b in got.items())


def test_secrets_without_a_digit(spark):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJ"
    values = ["ghp_" + letters, "sk-" + letters[:24], "AKIA" + "QWERTYUIOPASDFGH", "abcdefabcdefabcdefabcdefabcdefab", "f" * 40]
    got = moved(spark, values)
    assert all(got[v] != v and len(got[v]) == len(v) for v in values)
    assert got[values[0]].startswith("ghp_") and got[values[1]].startswith("sk-") and got[values[2]].startswith("AKIA")
    assert re.fullmatch("[0-9a-f]{32}", got[values[3]]) and re.fullmatch("[0-9a-f]{40}", got[values[4]])


def test_values_are_linked_and_the_key_counts(spark):
    rows = [(1, "mail Ann.Lee@example.com or 10.1.2.3"), (2, "10.1.2.3 Ann.Lee@example.com"), (2, None), (None, "no value"), (None, ""), (5, "x" * 300_000 + " 0123456789 ab" * 3 + "a." * 20_000 + " " + "0a" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_replaced", "2 as key")
    a, b = (P.pseudonymize(docs, k).collect() for k in ("k", "other"))
    assert len(a) == len(rows) and a[0].text.split()[1] == a[1].text.split()[1] and a[0].text.split()[3] == a[1].text.split()[0]
    assert a[0].text != b[0].text and re.fullmatch(r"mail [A-Z][a-z]{2}\.[A-Z][a-z]{2}@[a-z]{7}\.com or [\d.]+", a[0].text)
    assert a[5].n_replaced == 4 and len(a[5].text) == len(rows[5][1]) and [x.n_found for x in a] == [2, 2, 0, 0, 0, 4]
    with pytest.raises(ValueError):
        P.pseudonymize(docs, "")


def test_helper_names_do_not_clash(spark):
    docs = spark.createDataFrame([(1, "call +1 202 555 0143 or a@example.org", "mine", "too")], "doc_id long, text string, p string, P_ string")
    row = P.pseudonymize(docs, "k").collect()[0]
    assert (row["p"], row["P_"]) == ("mine", "too") and row["n_found"] > 0
