"""Token counts by offset-mapped attribution (operator 2).

A document is encoded once, as a whole. The tokens' byte spans, which a byte-level vocabulary gives
without loss, are joined with the sections' spans; a token that crosses a boundary is allocated by
a rule:

start          the section that holds the token's first byte
majority       the section that holds most of its bytes; the earlier one if equal
proportional   each section gets the share of the token's bytes that it holds

Whole counts under each rule sum to the document's number of tokens.
"""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

RULES = ("start", "majority", "proportional")
#: Long runs of white space, by Unicode's property.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{512,}")
#: Sections that a task holds before it passes them on.
HELD = 50_000


def default_vocabulary() -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoding(path: str):
    """(encoding, bytes of each token id) of a tiktoken rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    widths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        widths[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), widths


def section_edges(data: np.ndarray) -> np.ndarray:
    """Edges of a text's lines; a line holds its line feed. An empty text has one empty section."""
    ends = np.flatnonzero(data == 0x0A) + 1
    return np.unique(np.concatenate([[0], ends, [len(data)]])) if len(data) else np.zeros(2, np.int64)


def allocate(widths: np.ndarray, edges: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of every section. widths: bytes of the tokens in order, which cover the text; edges: of the sections, which cover it too."""
    n = len(edges) - 1
    ends = np.cumsum(widths)
    starts = ends - widths
    first = np.clip(np.searchsorted(edges, starts, "right") - 1, 0, n - 1)
    if rule == "start":
        return np.bincount(first, minlength=n).astype(np.float64)
    last = np.clip(np.searchsorted(edges, ends, "left") - 1, 0, n - 1)
    inner = first == last
    out = np.bincount(first[inner], minlength=n).astype(np.float64)
    for i in np.flatnonzero(~inner):  # tokens over a boundary
        own = np.arange(first[i], last[i] + 1)
        held = np.minimum(edges[own + 1], ends[i]) - np.maximum(edges[own], starts[i])
        if rule == "proportional":
            out[own] += held / widths[i]
        else:
            out[own[np.argmax(held)]] += 1
    return out


def _encode(encoding, text: str) -> np.ndarray:
    """Token ids of the whole text, 4 bytes each, so any text that a row holds.

    The vocabulary's pattern backtracks over blank runs, which fails on very long ones. Such a run is
    one match of the pattern without its last character, or whole at the end of the text, and no
    match goes over its start; so it is encoded as the one piece it is, with the same tokens.
    """
    parts, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        parts.append(encoding.encode_to_numpy(text[at : run.start()], disallowed_special=()))
        parts.append(np.array(encoding._encode_single_piece(text[run.start() : end]), np.uint32))
        at = end
    parts.append(encoding.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate(parts)


_OUT = "doc_id long, section int, start_char long, end_char long, n_tokens double, doc_tokens long"


def _attributed(rows: DataFrame, rule: str, vocabulary: str | None, sections) -> DataFrame:
    """rows (doc_id, something), which sections turns into a text and the rising byte edges of its sections."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    path = vocabulary or default_vocabulary()

    def make(batches):
        import pyarrow as pa

        encoding, width = load_encoding(path)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        names = ["doc_id", "section", "start_char", "end_char", "n_tokens", "doc_tokens"]
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in names)
            held = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text, edges = sections(value.as_py())
                tokens = _encode(encoding, text)
                counts = allocate(width[tokens], edges, rule)
                data = np.frombuffer(text.encode(), np.uint8)
                chars = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
                spans = chars[edges]
                n = len(counts)
                for c, v in zip(out, ([doc] * n, range(n), spans[:-1], spans[1:], counts, [len(tokens)] * n), strict=True):
                    c.extend(v)
                held += n
                if held > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
                    out, held = tuple([] for _ in names), 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return rows.mapInArrow(make, _OUT)


def attribute_tokens(docs: DataFrame, rule: str = "start", vocabulary: str | None = None, sections=section_edges) -> DataFrame:
    """(doc_id, section, start_char, end_char, n_tokens, doc_tokens) for every section of every row of docs (doc_id, text).

    Sections count from 0; spans are code points, end exclusive. sections maps a text's bytes to
    rising edges from 0 to its length. Null and empty texts have one empty section of 0 tokens. A
    text of any length is encoded once, as a whole. Repeated rows, rows that share a doc_id and rows
    without one each give their sections; extra columns are ignored. vocabulary is a path that every
    executor can open.
    """
    return _attributed(docs.select("doc_id", "text"), rule, vocabulary, lambda text: (text or "", sections(np.frombuffer((text or "").encode(), np.uint8))))


def attribute_fields(docs: DataFrame, fields: list[str], rule: str = "start", vocabulary: str | None = None, separator: str = "\n") -> DataFrame:
    """The same for documents of several text columns, with the section's field name.

    The fields are joined by the separator and encoded once; the separator belongs to the field
    before it. A null field is an empty section, so every row gives len(fields) sections.
    """
    gap = len(separator.encode())

    def sections(values):
        values = [v or "" for v in values]
        sizes = np.array([len(v.encode()) + gap for v in values])
        sizes[-1] -= gap
        return separator.join(values), np.concatenate([[0], np.cumsum(sizes)])

    rows = docs.select("doc_id", F.array(*(F.col(f).cast("string") for f in fields)).alias("values"))
    names = F.array(*(F.lit(f) for f in fields))
    return _attributed(rows, rule, vocabulary, sections).withColumn("field", F.get(names, F.col("section")))


def op2_token_counts(spark, sf_dir):
    return attribute_tokens(C.table(spark, sf_dir, "documents"))
