"""Benchmark decontamination by template canonicalisation (operator 1).

Texts become sequences of canonical tokens: numbers, names and units turn into typed placeholders,
other words are lower-cased. Windows of canonical tokens are hashed and joined with those of the
benchmark, so a question with other numbers or names still matches. The values behind the
placeholders are then compared: along one alignment, each value of the benchmark must always be
replaced by the same value (slot consistency). Coverage and consistency come from one alignment:
matching windows whose diagonals (place in the document minus place in the item) lie close together.
Pieces of an item in another order, or scattered over a text, are other alignments.

Items that no document could tell apart, with equal windows and equal places of equal values, are
one class with one row a document, so a family of re-parameterised items doesn't multiply the result.

A window with too few plain words would match almost anything as a template, so it is hashed with its
values instead of placeholders and matches its verbatim copies only.

A name is a capitalised word inside a sentence, so lost punctuation or capitals would change the
tokens. Every text is therefore read twice, with names as placeholders and with names as plain
words, and the reading that covers more of an item counts.

A fixed-size bit map of the benchmark's window hashes lets a task drop windows that can't match
before they are shuffled; it only saves work, the join decides.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WINDOW = 8
#: Fewest plain words of a window that is matched as a template; one of fewer words needs all of them plain.
LITERALS = 4
#: Least share of an item's tokens that matching windows cover, and least slot consistency.
COVERAGE, CONSISTENCY = 0.5, 0.7
#: Most tokens put in or left out between neighbouring windows of one alignment.
GAP = 8
FILTER_BITS = 1 << 22
#: Benchmark windows are broadcast up to this number (about 20 MB); beyond it the join shuffles.
BROADCAST_WINDOWS = 200_000

#: Words taken for units and for numbers, in English, German, French and Spanish. Fixed values.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds
ml liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years
percent dollar dollars euro euros cent cents degree degrees meter meters metre metres kilometer kilometers
gramm kilogramm tonne tonnen sekunde sekunden minuten stunde stunden tag tage woche wochen monat monate jahr jahre prozent grad meile meilen
gramme grammes kilogramme kilogrammes tonnes seconde secondes heure heures jour jours semaine semaines mois an ans mètre mètres kilomètre kilomètres
gramo gramos kilogramo kilogramos litro litros segundo segundos minuto minutos hora horas semana semanas mes meses metro metros kilómetro kilómetros
""".split()
NUMBERS = """
zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen
twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend
deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante cent mille
cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince veinte treinta cuarenta cincuenta sesenta setenta ochenta noventa cien mil
""".split()

NUM, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
_DIGIT = C.byte_class((0x30, 0x39))
_ALNUM = C.byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_POINT = C.byte_class(0x2E, 0x2C)
_UPPER = C.byte_class((0x41, 0x5A))
_SMALL = C.byte_class((0x61, 0x7A), (0x80, 0xFF))
_STOP = C.byte_class(0x2E, 0x21, 0x3F, 0x3A, 0x0A, 0x0D, 0x22)


def _hashes_of(words) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return np.sort(C.span_hashes(data, *C.spans(data, np.array([0, len(data)]), C.WORD_BYTES[data])))


_UNIT_HASHES, _NUMBER_HASHES = _hashes_of(UNITS), _hashes_of(NUMBERS)


def canonical(data: np.ndarray, off: np.ndarray, names: bool = True):
    """Canonical tokens of rows of text: (hash, is a slot, start byte, end byte, row edges into the tokens, hash of the words themselves). names: whether names are placeholders."""
    digit = _DIGIT[data]
    inside = _ALNUM[data]
    if len(data) > 2:
        inside[1:-1] |= _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    starts, ends = C.spans(data, off, inside)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, bool), starts, ends, np.zeros(len(off), np.int64), np.zeros(0, np.uint64)
    small = C.LOWER[data]
    hashes = C.span_hashes(small, starts, ends)
    edge = np.searchsorted(starts, off)
    n_digits = np.zeros(len(data) + 1, np.int64)
    np.cumsum(digit | _POINT[data], out=n_digits[1:])
    stops = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_STOP[data], out=stops[1:])
    number = (n_digits[ends] - n_digits[starts] == ends - starts) | np.isin(hashes, _NUMBER_HASHES)
    unit = np.isin(hashes, _UNIT_HASHES)
    second = np.minimum(starts + 1, len(data) - 1)
    # an upper-case letter of two bytes: Latin C3 80 to C3 9E, Greek CE 91 to CE A9, Cyrillic D0 80 to D0 AF
    wide = np.zeros(len(starts), bool)
    for lead, least, most in ((0xC3, 0x80, 0x9E), (0xCE, 0x91, 0xA9), (0xD0, 0x80, 0xAF)):
        wide |= (data[starts] == lead) & (data[second] >= least) & (data[second] <= most)
    third = np.minimum(starts + 2, len(data) - 1)
    capital = (_UPPER[data[starts]] & _SMALL[data[second]] & (ends - starts > 1)) | (wide & _SMALL[data[third]] & (ends - starts > 2))
    first = np.zeros(len(starts), bool)
    first[edge[:-1][edge[:-1] < len(starts)]] = True
    after_stop = np.ones(len(starts), bool)
    after_stop[1:] = stops[starts[1:]] - stops[ends[:-1]] > 0
    name = capital & ~first & ~after_stop & ~number & ~unit if names else np.zeros(len(starts), bool)
    own = hashes
    hashes = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, hashes)))
    keep = np.ones(len(starts), bool)
    keep[1:] = ~(name[1:] & name[:-1] & ~first[1:])  # a name of several words is one slot
    at = np.flatnonzero(keep)
    slot = (number | unit | name)[at]
    last = np.append(at[1:], len(starts)) - 1
    if len(at) < len(own):  # the words of a name count in their order
        own = np.add.reduceat(own * (2 * (np.arange(len(own)) - np.repeat(at, last - at + 1)) + 1).astype(np.uint64), at)
    return hashes[at], slot, starts[at], ends[last], np.searchsorted(at, edge), own


_WINDOWS = "t long, reading int, length int, gram long, place int, exact boolean, shape long, slots array<string>"


def _shape(hashes: np.ndarray, slot: np.ndarray, words: np.ndarray) -> int:
    """Hash of a text's canonical tokens and of which of its slots hold equal values."""
    _, first, back = np.unique(words[slot], return_index=True, return_inverse=True)
    values = np.concatenate([hashes, first[back].astype(np.uint64), [np.uint64(len(hashes))]])
    return int(C.rolling(values, len(values))[0].astype(np.int64))


def _exact_grams(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of k words from each of the places at."""
    out = np.full(len(at), ~np.uint64(k), np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + words[at + j]
    return C.mix(out)


def _windows(rows: DataFrame, lengths, allowed, whole: bool) -> DataFrame:
    """rows (id, t, text) to windows of the given lengths. allowed: a broadcast bit map or None; whole: an item shorter than WINDOW is one window, and its shape is told."""

    def make(batches):
        import pyarrow as pa

        bits = allowed.value if allowed is not None else None
        names = ["id", "t", "reading", "length", "gram", "place", "exact", "shape", "slots"]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.list_(pa.string()))
        for batch in batches:
            own = batch.schema.field(0).type
            ids, marks = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for (first, _, data, off), reading in ((x, y) for x in C.text_buffers(batch.column(2)) for y in (0, 1)):
                hashes, slot, starts, ends, edge, words = canonical(data, off, reading == 0)
                row = np.repeat(np.arange(len(off) - 1), np.diff(edge))
                size = np.diff(edge)
                shapes = [_shape(hashes[a:b], slot[a:b], words[a:b]) if whole and b > a else 0 for a, b in zip(edge[:-1], edge[1:], strict=True)]
                plain = np.zeros(len(hashes) + 1, np.int64)
                np.cumsum(~slot, out=plain[1:])
                out: tuple[list, ...] = tuple([] for _ in names)
                for k in lengths:
                    grams = C.rolling(hashes, k)
                    if not len(grams):
                        continue
                    good = row[: len(grams)] == row[k - 1 :]
                    exact = plain[k : k + len(grams)] - plain[: len(grams)] < min(LITERALS, k)
                    at = np.flatnonzero(good & exact)
                    grams[at] = _exact_grams(words, at, k)
                    if whole and k < WINDOW:
                        good &= size[row[: len(grams)]] == k
                    if bits is not None:
                        h = grams & np.uint64(FILTER_BITS - 1)
                        good &= (bits[(h >> np.uint64(3)).astype(np.int64)] >> (h & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    for i in np.flatnonzero(good):
                        held = [j for j in range(k) if slot[i + j]]
                        r = int(row[i])
                        values = [bytes(C.LOWER[data[starts[i + j] : ends[i + j]]]).decode("utf-8", "replace") for j in held]
                        for c, v in zip(out, (ids[first + r], marks[first + r], reading, k, int(grams[i].astype(np.int64)), int(i - edge[r]), bool(exact[i]), shapes[r], values), strict=True):
                            c.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (own, *kinds), strict=True)], names)

    return rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, {_WINDOWS}")


def _bit_map(windows: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, at most FILTER_BITS / 64 rows on the driver."""
    at = F.pmod("gram", F.lit(FILTER_BITS))
    rows = windows.select(F.floor(at / 32).cast("int").alias("word"), F.pow(F.lit(2.0), F.pmod(at, F.lit(32))).cast("long").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    for word, bits in rows:
        out[word] = bits
    return out.view(np.uint8)


def _lengths(items: DataFrame):
    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for _, _, data, off in C.text_buffers(batch.column(0)):
                for names in (True, False):
                    edge = canonical(data, off, names)[4]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.diff(edge), WINDOW), pa.int64())], ["n"])

    return sorted(r[0] for r in items.select("text").mapInArrow(count, "n long").where("n > 0").distinct().collect())  # at most WINDOW values


def _benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows of the items that stand for a variant, and the names of all items' variants and classes.

    Items of one class have the same canonical tokens and the same slots with equal values; those of one variant
    also have equal windows of few plain words, which hold the values. Windows have the class, its
    least item id, and first for the variant that stands for the class.
    """
    items = benchmark.select(F.col("item_id").alias("id"), F.xxhash64("text").alias("t"), "text").where("id is not null")
    found = C.cut(_windows(items, _lengths(items) or [WINDOW], None, True).dropDuplicates(["id", "t", "reading", "length", "gram", "place"]))
    digest = lambda *c: F.md5(F.to_json(F.array_sort(F.collect_set(F.struct(*c)))))
    keys = found.groupBy("id", "t").agg(digest("reading", "shape").alias("template"), digest("reading", "length", "place", "gram", "exact", "shape").alias("variant"))
    one = F.struct("id", "t")
    classes = keys.groupBy("template").agg(F.min("id").alias("class"), F.min(one).alias("first_one"))
    variants = keys.groupBy("variant").agg(F.min(one).alias("one"))
    named = C.cut(keys.join(classes, "template").join(variants, "variant").select("id", "t", "class", F.col("one.id").alias("variant_id"), (one == F.col("one")).alias("leads"), (one == F.col("first_one")).alias("first")))
    return C.cut(found.join(named.where("leads").select("id", "t", "class", "first"), ["id", "t"])), named


def item_classes(benchmark: DataFrame) -> DataFrame:
    """(item_id, class_id, variant_id) of every item with a token: the items of a class have the same canonical tokens and the same slots with equal values; class_id is the least of them. Those of a variant can't be told apart by their windows of few plain words either."""
    return _benchmark_windows(benchmark)[1].select(F.col("id").alias("item_id"), F.col("class").alias("class_id"), "variant_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistency: float = CONSISTENCY, gap: int = GAP) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, n_slots, n_changed) for every document and class of benchmark items that it contains.

    item_id is the class's least item; item_classes lists the others. All figures are of the best
    alignment: coverage is the share of the item's tokens in its matching windows; consistency the
    share of the item's slot values that keep one counterpart (1 without slots); n_changed counts
    those with another value than that item's, so above 0 means a re-parameterised copy or another
    item of the class. Null and empty texts on either side match nothing; items under 8 tokens are
    one window of their own length. Windows with too few plain words match only with equal values;
    coverage is taken without such windows and with them, and the larger counts. Repeated rows, and
    rows that share a doc_id (a null one too), are judged text by text and give one result, the best.
    Items that share an item_id are matched text by text too. Items without an id and extra columns
    are ignored.
    """
    spark = docs.sparkSession
    known, _ = _benchmark_windows(benchmark)
    lengths = sorted(r[0] for r in known.select("length").distinct().collect())  # at most WINDOW values
    # all members of a class have equally many tokens
    tokens = known.groupBy("class", "reading").agg(F.max(F.col("place") + F.col("length")).alias("all"), F.max(F.when(~F.col("exact"), F.col("place") + F.col("length"))).alias("plain"))
    side = C.cut(known.where("first OR exact").join(tokens, ["class", "reading"]).select(F.col("class").alias("item_id"), F.col("t").alias("item"), "reading", "length", "gram", "exact", "all", "plain", F.col("place").alias("at"), F.col("slots").alias("own")))
    few = side.count() <= BROADCAST_WINDOWS
    allowed = spark.sparkContext.broadcast(_bit_map(side))
    found = _windows(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("t"), "text"), lengths or [WINDOW], allowed, False).drop("shape")
    hits = C.cut(found.join(F.broadcast(side) if few else side, ["reading", "length", "gram", "exact"]).withColumnRenamed("id", "doc_id"))
    # readings 0 and 1 count the template windows of the class; 2 and 3 are the same readings with the exact windows of one
    # variant, asked only where the text has some of them
    template = hits.where("NOT exact").withColumn("tokens", F.col("plain"))
    exact = hits.where("exact").withColumn("tokens", F.col("all"))
    asked = exact.select(F.col("doc_id").alias("d"), F.col("t").alias("dt"), F.col("item_id").alias("class"), F.col("item").alias("variant"), F.col("reading").alias("r")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")) & (F.col("item_id") == F.col("class")) & (F.col("reading") == F.col("r"))
    rest = template.drop("own", "item", "tokens").join(asked, same).drop("d", "dt", "class", "r").withColumnRenamed("variant", "item")
    values = known.where("NOT exact").select(F.col("class").alias("item_id"), F.col("t").alias("item"), "reading", "length", F.col("place").alias("at"), F.col("slots").alias("own"))
    rest = rest.join(F.broadcast(values) if few and values.count() <= BROADCAST_WINDOWS else values, ["item_id", "item", "reading", "length", "at"]).withColumn("tokens", F.col("all"))
    hits = template.unionByName(exact.unionByName(rest).withColumn("reading", F.col("reading") + 2))
    hits = hits.select("doc_id", "t", "item_id", "item", "reading", "tokens", F.struct("at", "length").alias("window"), (F.col("place") - F.col("at")).alias("diagonal"), F.arrays_zip("own", "slots").alias("pairs"))
    # what one diagonal or one alignment gathers is bounded by the item's length
    place = ["doc_id", "t", "item_id", "item", "reading", "tokens"]
    lines = hits.groupBy(*place, "diagonal").agg(F.collect_set("window").alias("windows"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    by = Window.partitionBy(*place).orderBy("diagonal")
    lines = lines.withColumn("new", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > gap, F.lit(True)).cast("int")).withColumn("chain", F.sum("new").over(by))
    # a chain that drifts further than the item is long is cut, so it can't grow over a text of copies
    drift = F.floor((F.col("diagonal") - F.min("diagonal").over(Window.partitionBy(*place, "chain"))) / F.col("tokens"))
    lines = lines.withColumn("drift", drift).groupBy(*place, "chain", "drift").agg(F.flatten(F.collect_list("windows")).alias("windows"), F.array_distinct(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct("windows"), lambda w: F.sequence(w["at"], w["at"] + w["length"] - 1)))))
    slots = F.array_distinct(F.transform("pairs", lambda p: p["own"]))
    kept = F.size(F.filter(slots, lambda s: F.size(F.filter("pairs", lambda p: p["own"] == s)) == 1))
    changed = F.size(F.filter(slots, lambda s: F.exists("pairs", lambda p: (p["own"] == s) & (p["slots"] != s))))
    n_slots = F.size(slots)
    out = lines.select("doc_id", "item_id", "reading", (covered / F.col("tokens")).alias("coverage"), F.when(n_slots == 0, 1.0).otherwise(kept / n_slots).alias("consistency"), n_slots.cast("long").alias("n_slots"), changed.cast("long").alias("n_changed"))
    out = out.where((F.col("coverage") >= coverage) & (F.col("consistency") >= consistency))
    best = F.max_by(F.struct("coverage", "consistency", "n_slots", "n_changed"), F.struct("coverage", "consistency", -F.col("n_changed"), -F.col("reading")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")


def op1_decontaminate(spark, sf_dir):
    return contaminated(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
