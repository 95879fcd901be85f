"""Language ID by multilingual mixture inference (operator 6).

Training counts hashed byte trigrams of every language over all training documents. A word's
log-likelihood in a language is the sum over its trigrams; a document is a mixture of languages
from which each word is drawn. Expectation-maximisation estimates the proportions, then the
language set is chosen among the nested sets of the most likely languages by penalised likelihood.
The sets grow until the penalty exceeds what any larger set could gain, so nothing else ends them.
All labels of the training rows are learnt; the model takes 4 bytes * CLASSES for each.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Hash classes of trigrams.
CLASSES = 1 << 15
#: Languages whose counts a task holds before it passes them on.
HELD = 256
#: Word scores (words * languages) that are held at once; a document of more is read piece by piece in each round.
SCORES = 1 << 23
#: Added to each count.
SMOOTH = 0.5
ROUNDS = 8
#: Log-likelihood that one more language must gain, times log(words).
PENALTY = 3.0
#: Bytes that belong to a word.
_LETTERS = ~C.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def _trigrams(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Class of the trigram centred at each of bytes a to b, with anything but letters as one boundary symbol."""
    own = data[max(0, a - 1) : b + 1]
    d = np.where(_LETTERS[own], C.LOWER[own], 0x20).astype(np.int64)
    d = np.concatenate([[0x20] * (a == 0), d, [0x20] * (b >= len(data))]).astype(np.int64)
    return ((d[:-2] * 0x9E3B1 + d[1:-1] * 0x85EB) ^ (d[2:] * 0xC2B2AE35 >> 7)) & (CLASSES - 1)


def word_scores(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """Log-likelihood of every word in every language, in pieces of bounded size."""
    out = np.zeros((len(starts), logs.shape[1]), np.float32)
    piece = max(4096, (1 << 21) // max(1, logs.shape[1]))
    i = 0
    while i < len(starts):
        a = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, a + piece, "right")))
        b = int(ends[j - 1])
        sums = np.zeros((b - a + 1, logs.shape[1]))
        np.cumsum(logs[_trigrams(data, a, b)], axis=0, out=sums[1:])
        out[i:j] = sums[ends[i:j] - a] - sums[starts[i:j] - a]
        i = j
    return out


def _pieces(column):
    import pyarrow.compute as pc

    for batch_first, rows, data, off in C.text_buffers(pc.utf8_lower(column)):
        starts, ends = C.spans(data, off, _LETTERS[data])
        yield batch_first, rows, data, off, starts, ends


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (CLASSES x languages) from rows (text, lang); every row is counted."""

    def packed(total):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1) for x in total.values()], pa.binary())], ["lang", "counts"])

    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if len(total) > HELD:
                yield packed(total)
                total = {}
            langs = batch.column(1).to_pylist()
            for first, rows, data, off, starts, ends in _pieces(batch.column(0)):
                if not len(starts):
                    continue
                for r in range(rows):
                    for a in range(int(off[r]), int(off[r + 1]), C.PIECE):
                        b = min(a + C.PIECE, int(off[r + 1]))
                        own = _trigrams(data, a, b)[_LETTERS[data[a:b]]]
                        lang = langs[first + r]
                        total[lang] = total.get(lang, 0) + np.bincount(own, minlength=CLASSES)
        if total:
            yield packed(total)

    def add(batches):  # sorted by language
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if total and lang not in total:
                    yield packed(total)
                    total = {}
                total[lang] = total.get(lang, 0) + np.frombuffer(zlib.decompress(counts), np.int64)
        if total:
            yield packed(total)

    rows = docs.where("lang is not null and text is not null").select("text", "lang")
    schema = "lang string, counts binary"
    found = rows.mapInArrow(count, schema).repartition("lang").sortWithinPartitions("lang").mapInArrow(add, schema).collect()  # a row for each language
    found = sorted(found, key=lambda r: r[0])
    table = np.zeros((CLASSES, len(found)), np.float32)
    for k, (_, counts) in enumerate(found):
        own = np.frombuffer(zlib.decompress(counts), np.int64).astype(np.float64) + SMOOTH
        table[:, k] = np.log(own / own.sum())
    return [r[0] for r in found], table


def _sums(values: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Sum of the rows of values between neighbouring edges; 0 for empty ranges."""
    out = np.zeros((len(edge) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(edge[1:] > edge[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, edge[full], axis=0)
    return out


def _em(like: np.ndarray, edge: np.ndarray, share: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions after some rounds, their log-likelihood, and the most that any proportions of these languages could add to it."""
    n_words = np.diff(edge)
    row = np.repeat(np.arange(len(n_words)), n_words)
    share = np.maximum(share, 1e-4)
    share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
    for _ in range(times):
        part = share[row] * like
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
        share = _sums(part, edge) / np.maximum(n_words, 1)[:, None]
    mix = np.maximum((share[row] * like).sum(1), 1e-300)
    # the log is concave: fit(other) - fit <= words * log(mean ratio of the mixtures), and the ratio is an average over languages
    gain = _sums(like / mix[:, None], edge).max(1) / np.maximum(n_words, 1)
    return share, _sums(np.log(mix), edge), n_words * np.log(np.maximum(gain, 1))


def infer(words: np.ndarray, edge: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """Proportions (documents x languages) from word log-likelihoods (words x languages) and document edges; rows of documents without words are 0."""
    n_docs, n_langs = len(edge) - 1, words.shape[1]
    if not n_langs or not len(words):
        return np.zeros((n_docs, n_langs))
    n_words = np.diff(edge)
    like = np.exp(words - words.max(1, keepdims=True))
    share, fit, gain = _em(like, edge, np.full((n_docs, n_langs), 1.0 / n_langs), rounds)
    bound = np.minimum(fit + gain, 0) + 1e-6 * (n_words + 1)  # of every set's log-likelihood; no word exceeds likelihood 1
    order = np.argsort(-share, axis=1, kind="stable")
    cost = penalty * np.log(np.maximum(n_words, 2))
    best, best_fit = np.zeros((n_docs, n_langs)), np.full(n_docs, -np.inf)
    docs = np.flatnonzero(n_words > 0)  # those that a larger set could still improve
    for k in range(1, n_langs + 1):
        docs = docs[bound[docs] - (k - 1) * cost[docs] > best_fit[docs]]
        if not len(docs):
            break
        top = order[docs, :k]
        held = np.zeros(n_docs, bool)
        held[docs] = True
        at = np.flatnonzero(np.repeat(held, n_words))
        own_edge = np.concatenate([[0], np.cumsum(n_words[docs])])
        picked = like[at[:, None], np.repeat(top, n_words[docs], axis=0)]
        own, fit, _ = _em(picked, own_edge, np.take_along_axis(share[docs], top, 1), 1 if k == 1 else 3)
        fit = fit - (k - 1) * cost[docs]
        better = fit > best_fit[docs]
        won = docs[better]
        best[won] = 0
        best[won[:, None], top[better]] = own[better]
        best_fit[won] = fit[better]
    return best


def _em_pieces(pieces, share: np.ndarray, times: int, picked) -> tuple[np.ndarray, float, float]:
    """_em of one document whose word log-likelihoods come piece by piece, anew on each call of pieces."""
    share = np.maximum(share, 1e-4)
    share /= share.sum()

    def likes():
        for words in pieces():
            yield np.exp(words - words.max(1, keepdims=True))[:, picked]

    for _ in range(times):
        total, n = 0.0, 0
        for like in likes():
            part = share * like
            total, n = total + (part / np.maximum(part.sum(1, keepdims=True), 1e-300)).sum(0), n + len(like)
        share = total / n
    fit, ratio, n = 0.0, 0.0, 0
    for like in likes():
        mix = np.maximum((share * like).sum(1), 1e-300)
        fit, ratio, n = fit + np.log(mix).sum(), ratio + (like / mix[:, None]).sum(0), n + len(like)
    return share, fit, n * np.log(max(ratio.max() / n, 1))


def infer_long(pieces, n_words: int, n_langs: int, rounds: int = ROUNDS, penalty: float = PENALTY) -> np.ndarray:
    """infer for one document of any length: pieces() yields its word log-likelihoods in parts of bounded size."""
    every = np.arange(n_langs)
    share, fit, gain = _em_pieces(pieces, np.full(n_langs, 1.0 / n_langs), rounds, every)
    bound = min(fit + gain, 0) + 1e-6 * (n_words + 1)
    order, cost = np.argsort(-share, kind="stable"), penalty * np.log(max(n_words, 2))
    best, best_fit = np.zeros(n_langs), -np.inf
    for k in range(1, n_langs + 1):
        if bound - (k - 1) * cost <= best_fit:
            break
        top = order[:k]
        own, fit, _ = _em_pieces(pieces, share[top], 1 if k == 1 else 3, top)
        if fit - (k - 1) * cost > best_fit:
            best, best_fit = np.zeros(n_langs), fit - (k - 1) * cost
            best[top] = own
    return best


_OUT = "lang_pred string, score double, langs array<string>, shares array<double>"


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, keep: list[str]) -> DataFrame:
    """docs (text and the columns of keep) with lang_pred, score, and the language set with its shares.

    A null text, one without a letter, or a model without a language gives und, score 0 and empty
    arrays. The whole text counts, whatever its length. Ties go to the first language by name.
    """
    model = docs.sparkSession.sparkContext.broadcast(table)
    letter = docs.select(*keep, F.when(F.col("text").rlike(r"\p{L}"), F.col("text")).alias("text"))
    fields = [f for f in letter.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + _OUT

    def shares(data, starts, ends, edge, logs):
        """The proportions of each row, for as many rows at once as SCORES allows."""
        a = 0
        while a < len(edge) - 1:
            b = max(a + 1, int(np.searchsorted(edge, edge[a] + SCORES // max(1, logs.shape[1]), "right")) - 1)
            i, j = edge[a], edge[b]
            most = max(1, SCORES // max(1, logs.shape[1]))
            if j - i > most:  # one document
                yield infer_long(lambda i=i, j=j: (word_scores(data, starts[x : min(j, x + most)], ends[x : min(j, x + most)], logs) for x in range(i, j, most)), j - i, logs.shape[1])
                a = b
                continue
            yield from infer(word_scores(data, starts[i:j], ends[i:j], logs), edge[a : b + 1] - i)
            a = b

    def make(batches):
        import pyarrow as pa

        logs = model.value
        for batch in batches:
            names, score, sets, parts = [], [], [], []
            for _, rows, data, off, starts, ends in _pieces(batch.column(len(keep))):
                edge = np.searchsorted(starts, off)
                for own in shares(data, starts, ends, edge, logs):
                    if not own.any():
                        names.append("und"), score.append(0.0), sets.append([]), parts.append([])
                        continue
                    order = [i for i in np.argsort(-own, kind="stable") if own[i] > 0]
                    names.append(langs[order[0]]), score.append(min(1.0, float(own[order[0]])))
                    sets.append([langs[i] for i in order]), parts.append([float(own[i]) for i in order])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(parts, pa.list_(pa.float64()))], [*keep, "lang_pred", "score", "langs", "shares"])

    return letter.mapInArrow(make, schema)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, langs, shares) for every row of docs (doc_id, text, lang).

    The model learns from rows that are not held out and have a text and a lang. Rows with a null
    doc_id are never held out. Repeated rows count as often as they occur. Empty tables give an
    empty result; extra columns are ignored.
    """
    rows = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    langs, table = train(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), langs, table, ["doc_id", "held_out"])


def op6_language_mixture(spark, sf_dir):
    return identify_languages(C.table(spark, sf_dir, "documents"))
