"""Format-preserving Feistel pseudonyms for personal data (operator 4). DataFrame functions only.

Numbers, dates, addresses and secrets are found by pattern and validated. Each value is permuted
within its own format by a keyed Feistel network, so a card number stays a card number that passes
its check digit, an IBAN keeps valid check digits, a date stays a date in its layout, and equal values get equal
pseudonyms in every document without a table. Different values get different ones.

A network over symbols reads each half as a number in mixed radix (10 for a digit, 26 for a letter
of either case, 16 for a hex digit), adds SHA-256 of key, round and the other half, and writes it
back with each symbol in its class. A block has up to 26 symbols; longer strings go through two
sweeps of blocks, one from either end, in which each block is keyed with those before it. Values
that must stay valid, or must stay invalid, are walked on until they are in their format again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .quality_rules import let

#: Key of the query over the supplied tables; pseudonymize has no default.
QUERY_KEY = "shotloom-demo-key"
ROUNDS = 8
#: Symbols of a block; 26 ** 13 and 16 ** 13 are numbers of 63 bits.
BLOCK = 26

# found from its first symbol only and without going back, so a long run of letters is read once
EMAIL = r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++"
PREFIX = r"AKIA|gh[pousr]_|sk-"
SECRET = r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9]{20,}|[0-9a-fA-F]{32,})\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
DATE = r"\b(?:19|20)[0-9]{2}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])\b"
DAY_FIRST = r"(?<![0-9./])[0-9]{1,2}(?:/[0-9]{1,2}/|\.[0-9]{1,2}\.)(?:19|20)[0-9]{2}(?![0-9])"
IPV4 = r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?:[0-9]{7,}|[0-9]{4}(?:[ \-][0-9]{4}){2}[ \-][0-9]{1,7})(?![0-9A-Za-z])"
NUMBER = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)[ .\-]?)?[0-9]{2,6}(?:[ .\-][0-9]{2,6}){0,4}(?![0-9A-Za-z])"
#: Tried in this order at each place.
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IBAN, DATE, DAY_FIRST, IPV4, CARD, NUMBER))
#: What every found value holds; texts without it are passed through unread.
HINT = rf"[0-9@]|{PREFIX}|[a-fA-F]{{32}}"
#: Fewest digits of a number that is taken for a phone, card, account or identity number.
MIN_DIGITS = 7


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def _round_value(key, i, half, modulus):
    """A keyed function of one half: SHA-256 over key, round and half, as a number of 60 bits."""
    digest = F.sha2(F.concat_ws("|", key if not isinstance(key, str) else F.lit(key), i.cast("string"), half.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def _rounds(a, b, low, high, key, rounds: int, back: bool):
    """The halves a and b (moduli low and high) after all rounds, or before them."""

    def step(acc, i):
        sign = -1 if back else 1
        even = F.pmod(acc["a"] + sign * _round_value(key, i, acc["b"], low), low)
        odd = F.pmod(acc["b"] + sign * _round_value(key, i, acc["a"], high), high)
        return F.struct(F.when(i % 2 == 0, even).otherwise(acc["a"]).alias("a"), F.when(i % 2 == 1, odd).otherwise(acc["b"]).alias("b"))

    order = F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(F.reverse(order) if back else order, F.struct(a.alias("a"), b.alias("b")), step)


def feistel(value, low, high, key, rounds: int = ROUNDS, back: bool = False):
    """A keyed permutation of 0 .. low * high - 1 (both moduli are columns or numbers under 2**31), or its inverse."""
    low, high = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (low, high))
    halves = lambda v: _rounds(F.floor(v["v"] / v["h"]).cast("long"), F.pmod(v["v"], v["h"]).cast("long"), v["l"], v["h"], key, rounds, back)
    return let(F.struct(value.cast("long").alias("v"), low.alias("l"), high.alias("h")), lambda v: let(halves(v), lambda h: h["a"] * v["h"] + h["b"]))


def unfeistel(value, low, high, key, rounds: int = ROUNDS):
    """The inverse of feistel."""
    return feistel(value, low, high, key, rounds, True)


_DIGITS, _SMALL, _LARGE, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: All symbols; a hex digit's place among them is its value, with lower-case letters before capitals.
_ALL = _DIGITS + _SMALL + _LARGE


def _permuted_block(symbols, hexes, key, back: bool):
    """A string of an array of at most BLOCK letters and digits, permuted among those of the same classes; where hexes holds, digits and a to f are one class."""
    long = lambda x: F.lit(x).cast("long")
    # a symbol as (first place of its class, size of the class, its place)
    at = lambda ch: (F.instr(F.lit(_ALL), ch) - 1).cast("long")
    first = lambda p: F.when(hexes | (p < 10), long(0)).when(p < 36, long(10)).otherwise(long(36))
    size = lambda p: F.when(hexes, long(16)).when(p < 10, long(10)).otherwise(long(26))
    known = F.transform(symbols, lambda ch: let(at(ch), lambda p: F.struct((p - first(p)).alias("v"), size(p).alias("m"), first(p).alias("f"))))

    def number(half):
        return F.aggregate(half, F.struct(long(0).alias("v"), long(1).alias("m")), lambda acc, x: F.struct((acc["v"] * x["m"] + x["v"]).alias("v"), (acc["m"] * x["m"]).alias("m")))

    def written(half, v):
        """The symbols of v, the last one first."""
        div = lambda x, r: F.call_function("div", x, r)
        step = lambda acc, x: F.struct(div(acc["v"], x["m"]).alias("v"), F.concat(F.substring(F.lit(_ALL), (x["f"] + F.pmod(acc["v"], x["m"]) + 1).cast("int"), 1), acc["s"]).alias("s"))
        return F.aggregate(F.reverse(half), F.struct(v.alias("v"), F.lit("").alias("s")), step)["s"]

    def halves(x):
        middle = F.floor(F.size(x) / 2).cast("int")
        return F.array(F.slice(x, F.lit(1), middle), F.slice(x, middle + 1, F.size(x)))

    def moved(h):
        return let(F.transform(h, number), lambda n: _rounds(n[0]["v"], n[1]["v"], n[0]["m"], n[1]["m"], key, ROUNDS, back))

    return let(known, lambda x: let(halves(x), lambda h: let(moved(h), lambda new: F.array_join(F.transform(h, lambda half, i: written(half, F.when(i == 0, new["a"]).otherwise(new["b"]))), ""))))


def permute(text, key, hexes=False, back: bool = False):
    """A string of letters and digits, of any length, permuted among those with the same class (digit, small, capital; with hexes: hex digit) at each place; back undoes it. key is a string or a column."""
    key = F.lit(key) if isinstance(key, str) else key
    hexes = F.lit(hexes) if isinstance(hexes, bool) else hexes

    def sweep(s, salt):
        """Blocks in order; the key of each is a running hash of the pseudonym up to it, which back knows too."""
        symbols = F.filter(F.split(s, ""), lambda c: c != "")

        def step(x, acc, i):
            own = F.slice(x, i + 1, F.lit(BLOCK))
            told = lambda done: F.sha2(F.concat_ws("|", acc["state"], done).cast("binary"), 256)
            return let(_permuted_block(own, hexes, acc["state"], back), lambda new: F.struct(F.concat(acc["out"], F.array(new)).alias("out"), told(F.array_join(own, "") if back else new).alias("state")))

        start = F.struct(F.array().cast("array<string>").alias("out"), F.concat_ws("|", key, salt).alias("state"))
        blocks = lambda x: F.sequence(F.lit(0), F.size(x) - 1, F.lit(BLOCK))
        return let(symbols, lambda x: F.array_join(F.aggregate(blocks(x), start, lambda acc, i: step(x, acc, i))["out"], ""))

    def turned(s, salt):
        return F.when(salt == "right", F.reverse(s)).otherwise(s)

    salts = F.when(F.length(text) <= BLOCK, F.array(F.lit("left"))).otherwise(F.array(*map(F.lit, ("right", "left") if back else ("left", "right"))))
    return F.when(F.length(text) == 0, text).otherwise(F.aggregate(salts, text, lambda s, salt: let(sweep(turned(s, salt), salt), lambda new: turned(new, salt))))


def permute_digits(digits, key: str, back: bool = False):
    """A string of any number of decimal digits, permuted among those of its length."""
    return permute(digits, key, back=back)


def _refill(template, digits, mark: str = "[0-9]"):
    """The template with its marked symbols replaced in order by those of digits."""
    parts = F.split(template, mark)
    return let(F.split(digits, ""), lambda d: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(d, i), F.lit("")))), ""))


def luhn_sum(digits):
    """Luhn sum modulo 10 of a digit string, check digit last."""
    n = F.length(digits)
    one = lambda i: F.substring(digits, i, 1).cast("int")
    return F.pmod(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda a, i: a + F.when(F.pmod(n - i, F.lit(2)) == 1, F.when(one(i) > 4, 2 * one(i) - 9).otherwise(2 * one(i))).otherwise(one(i))), F.lit(10))


def _walk(start, good, step, most):
    """Applies step once, and again until good holds, which a permutation of more than the format needs to stay in it; most is a number or a column."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(most) if isinstance(most, int) else most), start, lambda a, i: F.when((i > 0) & good(a), a).otherwise(step(a)))


#: Days from 1900-01-01 to 2099-12-31, within 271 * 271.
DAYS = 73_049


def _days(text, layout: str):
    return F.datediff(F.try_to_timestamp(text, F.lit(layout)).cast("date"), F.lit("1900-01-01").cast("date")).cast("long")


def _dated(day):
    return F.date_add(F.lit("1900-01-01").cast("date"), day.cast("int"))


def _date_layout(m, key: str):
    """How a found date is written, null for what only looks like one: the order of day (df) and month (mf) or iso, whether their fields have two digits, the sign between, and the key of the layout."""
    slashes = F.translate(m, ".", "/")
    field = lambda i: F.length(F.substring_index(F.substring_index(slashes, "/", i), "/", -1))
    found = F.struct(_days(m, "yyyy-MM-dd").alias("iso"), _days(slashes, "d/M/yyyy").alias("df"), _days(slashes, "M/d/yyyy").alias("mf"), field(1).alias("one"), field(2).alias("two"), F.when(F.contains(m, F.lit("/")), "/").otherwise(".").alias("sign"))

    def told(p):
        order = F.when(p["iso"].isNotNull(), "iso").when(p["df"].isNotNull(), "day").otherwise("month")
        day = F.coalesce(p["iso"], p["df"], p["mf"])
        short = (order == "day") & (p["one"] == 1)
        # days of one digit: 200 years of 9 or 12 months with 9 days each are a network's size exactly
        months = F.when(p["two"] == 2, 12).otherwise(9).cast("long")
        at = let(_dated(day), lambda x: ((F.year(x) - 1900) * months + F.month(x) - 1) * 9 + F.dayofmonth(x) - 1)
        side = lambda wide, narrow: F.when(~short, 271).when(p["two"] == 2, wide).otherwise(narrow).cast("long")
        narrow = F.when(order == "day", p["two"] == 1).when(order == "month", p["one"] == 1).otherwise(False)
        return F.when(day.isNotNull(), F.struct(
            F.when(short, at).otherwise(day).cast("long").alias("v"), side(144, 120).alias("low"), side(150, 135).alias("high"), short.alias("short"), months.alias("months"), narrow.alias("narrow"),
            order.alias("order"), p["one"].alias("one"), p["two"].alias("two"), p["sign"].alias("sign"), F.concat_ws("|", F.lit(key), order, p["one"].cast("string"), p["two"].cast("string"), p["sign"]).alias("key"),
            F.when(short, 0).when((order == "month") | narrow, 48).otherwise(12).alias("walks"),
        ))

    return let(found, told)


def _date(p):
    """The date of layout p, permuted among the dates that are written alike."""

    def good(x):
        # days over 12 only, where the month comes first, else the date would be read day first
        return let(_dated(x), lambda d: (x < DAYS) & (~p["narrow"] | (F.month(d) < 10)) & ((p["order"] != "month") | (F.dayofmonth(d) > 12)))

    def fields(x):
        part = lambda by: F.floor(x / by).cast("long")
        short = F.struct((F.pmod(x, F.lit(9)) + 1).cast("int").alias("d"), (F.pmod(part(F.lit(9)), p["months"]) + 1).cast("int").alias("m"), (part(p["months"] * 9) + 1900).cast("int").alias("y"))
        return F.when(p["short"], short).otherwise(let(_dated(x), lambda d: F.struct(F.dayofmonth(d).alias("d"), F.month(d).alias("m"), F.year(d).alias("y"))))

    def written(f):
        wide = lambda v, n: F.lpad(v.cast("string"), n, "0")
        iso = F.concat_ws("-", f["y"].cast("string"), wide(f["m"], F.lit(2)), wide(f["d"], F.lit(2)))
        one, two = F.when(p["order"] == "day", f["d"]).otherwise(f["m"]), F.when(p["order"] == "day", f["m"]).otherwise(f["d"])
        return F.when(p["order"] == "iso", iso).otherwise(F.concat(wide(one, p["one"]), p["sign"], wide(two, p["two"]), p["sign"], f["y"].cast("string")))

    moved = _walk(p["v"], good, lambda x: feistel(x, p["low"], p["high"], p["key"]), p["walks"])
    return let(moved, lambda x: let(fields(x), written))


def _ip(m, key: str):
    """The 32 bits of the address."""
    value = F.aggregate(F.split(m, "[.]"), F.lit(0).cast("long"), lambda a, x: a * 256 + x.cast("long"))
    moved = feistel(value, 65536, 65536, key + "ip")
    return let(moved, lambda v: F.array_join(F.transform(F.array(F.lit(24), F.lit(16), F.lit(8), F.lit(0)), lambda s: F.pmod(F.floor(v / F.pow(F.lit(2.0), s)).cast("long"), F.lit(256)).cast("string")), "."))


def iban_rest(symbols):
    """The IBAN's number modulo 97, which is 1 if it is valid; symbols without blanks."""
    moved = F.concat(F.substr(symbols, F.lit(5)), F.left(symbols, F.lit(4)))
    step = lambda a, at: F.pmod(a * F.when(at > 9, 100).otherwise(10) + at, F.lit(97))
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda a, c: step(a, F.instr(F.lit(_DIGITS + _LARGE), c) - 1))


def _kind(m):
    """What was found: email, hex, secret, iban (valid), account (an invalid one), date, ip, card (valid), long (13 to 19 digits, invalid), number or none."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    iban = let(F.replace(m, F.lit(" "), F.lit("")), iban_rest)
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(_whole(SECRET)), F.when(m.rlike(r"\A[0-9a-f]+\z"), "hex").otherwise("secret"))
        .when(m.rlike(_whole(IBAN)), F.when(iban == 1, "iban").otherwise("account"))
        .when(m.rlike(_whole(DATE)) | m.rlike(_whole(DAY_FIRST)), "date")
        .when(m.rlike(_whole(IPV4)), "ip")
        .when(n < MIN_DIGITS, "none")
        .when(n.between(13, 19), F.when(let(digits, luhn_sum) == 0, "card").otherwise("long"))
        .otherwise("number")
    )


def pseudonym(m, key: str):
    """The pseudonym of one found value.

    Emails change before the at sign and in the domain's labels but the last; secrets after a known
    prefix; IBANs keep country and layout, numbers and cards their layout. Valid cards and IBANs get
    new check digits, invalid ones stay invalid, and what only looks like a date does too. Numbers
    of fewer than MIN_DIGITS digits stay.
    """
    plain = F.regexp_replace(m, "[^A-Za-z0-9]", "")
    letters = lambda x: F.regexp_replace(x, "[^A-Za-z0-9]", "")
    domain = F.substring_index(m, "@", -1)
    top = F.length(F.substring_index(domain, ".", -1))
    head = F.substr(domain, F.lit(1), F.length(domain) - top)
    prefix = F.regexp_extract(m, rf"\A(?:{PREFIX})", 0)
    digits = F.regexp_replace(m, "[^0-9]", "")

    def parts(kind):
        """The strings to permute."""
        return (
            F.when(kind == "email", F.array(letters(F.substring_index(m, "@", 1)), letters(head)))
            .when(kind == "hex", F.array(m)).when(kind == "secret", F.array(letters(F.substr(m, F.length(prefix) + 1))))
            .when(kind == "iban", F.array(F.substr(plain, F.lit(5)))).when(kind == "account", F.array(F.substr(plain, F.lit(3))))
            .when(kind == "card", F.array(F.substr(digits, F.lit(1), F.length(digits) - 1))).otherwise(F.array(digits))
        )

    def good(kind, x):
        """Whether a permuted string is of the kind again."""
        again = _refill(m, x)
        return F.when(kind == "long", luhn_sum(x) != 0).when(kind == "account", iban_rest(F.concat(F.left(m, F.lit(2)), x)) != 1).when(kind == "date", _date_layout(again, key).isNull()).otherwise(True)

    def whole(kind, new):
        """The value put together from the permuted strings."""
        marked = "[A-Za-z0-9]"
        country = F.left(m, F.lit(2))
        check = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), new[0]))).cast("string"), 2, "0")
        symbols = (
            F.when(kind == "email", F.concat(new[0], F.get(new, F.lit(1)), letters(F.substring_index(domain, ".", -1))))
            .when(kind == "secret", F.concat(letters(prefix), new[0])).when(kind == "iban", F.concat(country, check, new[0])).when(kind == "account", F.concat(country, new[0]))
            .when(kind == "card", F.concat(new[0], F.pmod(10 - luhn_sum(F.concat(new[0], F.lit("0"))), F.lit(10)).cast("string"))).otherwise(new[0])
        )
        return _refill(m, symbols, marked)

    def permuted(kind):
        own = lambda i: F.concat_ws("|", F.lit(key), kind, i.cast("string"))
        walks = F.when(kind.isin("long", "account", "date"), 24).otherwise(0)
        new = F.transform(parts(kind), lambda x, i: _walk(x, lambda a: good(kind, a), lambda a: permute(a, own(i), kind == "hex"), walks))
        return let(new, lambda n: whole(kind, n))

    def changed(k):
        kind, layout = k["kind"], k["layout"]
        return F.when(kind == "none", m).when(kind == "ip", _ip(m, key)).when(layout.isNotNull(), let(layout, _date)).otherwise(permuted(kind))

    kind = let(_kind(m), lambda k: F.struct(k.alias("kind"), F.when(k == "date", _date_layout(m, key)).alias("layout")))
    return let(kind, changed)


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """docs (with text) plus n_found and n_replaced, text replaced.

    Texts are split at the found values and put together again with the pseudonyms between, so no
    pseudonym is looked at twice. Null texts stay null with counts 0; texts without anything that a
    value must hold are passed through unread. Equal values have equal pseudonyms in all documents
    under one key. Rows, order of columns and extra columns stay; n_found and n_replaced are
    replaced if they clash.
    """
    text = F.col("text")
    if not key:
        raise ValueError("a key is needed; whoever has it can undo the pseudonyms")
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))

    def change(values):
        new = F.transform(values, lambda m: pseudonym(m, key))
        pieces = F.split(text, PATTERN)
        return let(new, lambda n: F.struct(
            F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(n, i), F.lit("")))), "").alias("text"),
            F.size(values).cast("long").alias("n_found"),
            F.size(F.filter(F.arrays_zip(values.alias("v"), n.alias("n")), lambda x: x["v"] != x["n"])).cast("long").alias("n_replaced"),
        ))

    changed = F.when(text.rlike(HINT), let(found, lambda v: F.when(F.size(v) > 0, change(v))))
    own = C.fresh(docs, "p")
    out = docs.withColumn(own, changed)
    return out.withColumns({"text": F.coalesce(f"{own}.text", "text"), "n_found": F.coalesce(f"{own}.n_found", F.lit(0)), "n_replaced": F.coalesce(f"{own}.n_replaced", F.lit(0))}).drop(own)


def op4_feistel_pseudonyms(spark, sf_dir):
    return pseudonymize(C.table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
