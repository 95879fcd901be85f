"""Content-addressed reuse of embeddings: one computation a distinct key, results back to their positions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import canonical_text, sha256_hex

#: Values over this size bypass the cache. Fixed value.
MAX_BYTES = 1 << 20
#: Header of a stored vector: magic, version, dimension, two 32-byte identities; then big-endian float32. Fixed values.
HEADER, VERSION = ">4sBI32s32s", 1
#: Four bytes that name the kind of vector; callers with stored vectors pass theirs.
MAGIC = b"SLV1"


def hashed(texts: DataFrame) -> DataFrame:
    """(pos, text, text_hash) of non-blank texts."""
    return texts.where(F.trim(F.regexp_replace("text", r"(?U)[\s\x1c-\x1f]+", " ")) != "").withColumn("text_hash", sha256_hex(canonical_text(F.col("text"))))


def distinct_texts(texts: DataFrame) -> DataFrame:
    """(text_hash, first_pos, n): what has to be encoded, each text once. Sums and minima alone, so a text in a third of all rows is no burden."""
    return hashed(texts).groupBy("text_hash").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def text_groups(texts: DataFrame) -> DataFrame:
    """distinct_texts() with the positions of each, for requests of bounded size."""
    return hashed(texts).groupBy("text_hash").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.min("pos").alias("first_pos"), F.count("*").alias("n"))


def expand(texts: DataFrame, results: DataFrame) -> DataFrame:
    """Results by text_hash back to every position of texts (pos, text)."""
    return hashed(texts).select("text_hash", "pos").join(results, "text_hash", "left")


def lookup(requests: DataFrame, current: DataFrame, legacy: DataFrame) -> DataFrame:
    """outcome of each request by key: hit, corrupt, legacy (promoted to the new key) or miss. Corrupt entries aren't retried on the legacy key."""
    found = requests.join(current.select("key", F.col("valid").alias("current_valid")), "key", "left").join(legacy.select(F.col("key").alias("legacy_key"), F.col("valid").alias("legacy_valid")), "legacy_key", "left")
    outcome = F.when(F.col("current_valid"), "hit").when(~F.col("current_valid"), "corrupt").when(F.col("legacy_valid"), "legacy").otherwise("miss")
    return found.withColumn("outcome", outcome)


def live(entries: DataFrame, now: Column) -> DataFrame:
    return entries.where(F.col("expires_at") > now)


def put(entries: DataFrame, new: DataFrame) -> DataFrame:
    """Entries after a bulk write; oversize values are left out, later rows of a key win by seq."""
    last = new.where(F.octet_length("value") <= MAX_BYTES).groupBy("key").agg(F.max_by(F.struct("value", "expires_at"), "seq").alias("v")).select("key", "v.*")
    return entries.join(last.select("key"), "key", "left_anti").unionByName(last)


def bulk_get(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Values at the positions that asked for them; null where nothing is stored."""
    return keys.join(entries.select("key", "value"), "key", "left").select("pos", "key", "value")


def encode_vector(config: bytes, content: bytes, vector: np.ndarray, magic: bytes = MAGIC) -> bytes:
    return struct.pack(HEADER, magic, VERSION, len(vector), config, content) + np.asarray(vector, ">f4").tobytes()


def decode_vector(data: bytes, config: bytes, content: bytes, dimension: int, magic: bytes = MAGIC) -> tuple[str, list[float] | None]:
    """(state, vector); checks run in a fixed order, and the first that fails names the state."""
    size = struct.calcsize(HEADER)
    if data is None or len(data) < size:
        return "corrupt", None
    kind, version, dim, own_config, own_content = struct.unpack(HEADER, data[:size])
    if kind != magic:
        return "corrupt", None
    if version != VERSION:
        return "schema", None
    if len(data) != size + 4 * dim:
        return "corrupt", None
    if (own_config, own_content) != (config, content):
        return "identity", None
    if dim != dimension:
        return "dimension", None
    vector = np.frombuffer(data, ">f4", offset=size)
    if not np.isfinite(vector).all():
        return "non-finite", None
    return "ok", vector.astype(float).tolist()


def packed(vector: Column, text_hash: Column, config: bytes, magic: bytes = MAGIC) -> Column:
    @F.pandas_udf("binary")
    def pack(vectors: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series([encode_vector(config, bytes.fromhex(h), v, magic) for v, h in zip(vectors, hashes, strict=True)])

    return pack(vector, text_hash)


def unpacked(data: Column, text_hash: Column, config: bytes, dimension: int, magic: bytes = MAGIC) -> Column:
    @F.pandas_udf("state string, vector array<double>")
    def unpack(values: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        rows = [decode_vector(None if v is None else bytes(v), config, bytes.fromhex(h), dimension, magic) for v, h in zip(values, hashes, strict=True)]
        return pd.DataFrame(rows, columns=["state", "vector"])

    return unpack(data, text_hash)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def stand_in_encoder(text: pd.Series) -> pd.Series:
    """A deterministic unit vector of dimension 8 from the text's hash. It stands in for a model and means nothing."""
    import hashlib

    def one(x: str):
        v = np.frombuffer(hashlib.sha256(x.encode()).digest(), ">i4").astype(np.float64)
        return (v / np.linalg.norm(v)).astype(np.float32).tolist()

    return text.map(one)


def result_cacheable(scope: Column, media_ids: Column, query: Column, modalities: Column) -> Column:
    return scope.rlike(r"\A[0-9a-f]{64}\z") & (F.size(media_ids) > 0) & (F.trim(query) != "") & (F.size(F.array_intersect(F.array(F.lit("transcript"), F.lit("ocr")), modalities)) > 0)


def within_scope(ids: Column, trusted: Column) -> Column:
    low = lambda a: F.transform(a, lambda x: F.lower(F.trim(x)))
    return F.size(F.array_except(low(ids), low(trusted))) == 0


def envelope(payload: Column, created: Column) -> Column:
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), created.alias("created_at_utc"), payload.alias("payload")), {"ignoreNullFields": "false"})


def open_envelope(value: Column) -> Column:
    """The payload text of a valid envelope; null for bad JSON, version or date."""
    e = F.from_json(value, "schema_version INT, created_at_utc STRING, payload STRING")
    good = (e["schema_version"] == 1) & F.try_to_timestamp(e["created_at_utc"]).isNotNull()
    return F.when(good, e["payload"])
