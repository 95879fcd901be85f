"""Scalar text functions as column expressions; Arrow UDFs where Spark has no builtin."""

from __future__ import annotations

import unicodedata
import uuid

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def _nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def canonical_text(text: Column) -> Column:
    """CR LF and CR become LF, then Unicode NFC. Only texts beyond ASCII are sent to Python."""
    own = F.regexp_replace(text, "\r\n?", "\n")
    return F.coalesce(_nfc(F.when(own.rlike(r"[^\x00-\x7F]"), own)), own)


def camel_case(name: Column) -> Column:
    """snake_case to camelCase: the first part stays, the others are capitalised."""
    parts = F.split(name, "_")
    rest = F.transform(F.slice(parts, 2, F.size(parts)), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2)))))
    return F.concat(F.get(parts, F.lit(0)), F.array_join(rest, ""))


def padded_id(prefix: Column, number: Column, digits: int = 4) -> Column:
    """prefix:number with leading zeros; longer numbers keep all digits."""
    text = number.cast("string")
    return F.concat(prefix, F.lit(":"), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def cache_key(*parts: Column) -> Column:
    """Parts without outer colons, joined by colons; null if a part is empty."""
    own = F.array(*(F.btrim(p, F.lit(":")) for p in parts))
    return F.when(F.forall(own, lambda p: p != ""), F.array_join(own, ":"))


def point_key(logical: Column, prefix: str = "shotloom:point:") -> Column:
    """A canonical UUID as it is, in lower case; otherwise the name-based one (SHA-1, URL namespace) of prefix and logical id. Stores that already hold points need the prefix they were written with."""
    space = uuid.NAMESPACE_URL.hex
    digest = F.sha1(F.concat(F.unhex(F.lit(space)), F.concat(F.lit(prefix), logical).cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    made = F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
    return F.when(logical.rlike(r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"), F.lower(logical)).otherwise(made)


def basename(path: Column, default: str) -> Column:
    return F.coalesce(F.nullif(F.element_at(F.split(path, "/"), -1), F.lit("")), F.lit(default))


def safe_path(text: Column) -> Column:
    return F.coalesce(F.nullif(F.left(F.regexp_replace(text, r"[^\p{L}\p{N}_-]", "_"), F.lit(128)), F.lit("")), F.lit("job"))


def setting_list(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def redact_url(url: Column) -> Column:
    """Credentials of a URL become ***."""
    return F.regexp_replace(url, r"\A([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1***@")


def seconds_literal(text: Column) -> Column:
    """4, 4s, 4.5 sec(s), 4 second(s); otherwise null."""
    own = F.lower(F.trim(text))
    return F.regexp_extract(own, r"\A(\d+(?:\.\d+)?)\s*(?:s|sec|secs|second|seconds)?\z", 1).try_cast("double")


@F.pandas_udf(T.StringType())
def format_seconds(seconds: pd.Series) -> pd.Series:
    """Six significant digits and an s."""
    return seconds.map(lambda x: None if pd.isna(x) else f"{round(x, 3):g}s")


def iso_utc(time: Column) -> Column:
    """ISO text with a Z, to the second."""
    return F.concat(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def parsed_iso(text: Column) -> Column:
    """The instant of ISO text with Z or an offset; null for text without one or that is no date."""
    return F.when(text.rlike(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d(?::\d\d(?:\.\d{1,6})?)?(?:Z|[+-]\d\d:\d\d)\z"), text.try_cast("timestamp"))
