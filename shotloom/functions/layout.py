"""Text layout over a table of advance widths: greedy lines, long tokens split, as folds of column expressions.

A width table is a map from a character to its advance; other characters take the default. A text's width is the
sum of its characters' advances, which is what a font without kerning gives.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters at which a text falls into paragraphs, and those between words. Fixed values.
PARAGRAPHS = "\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def width_of(text: Column, advances: Column, default: float) -> Column:
    return F.aggregate(_characters(text), F.lit(0.0), lambda w, c: w + F.coalesce(F.try_element_at(advances, c), F.lit(float(default))))


def split_token(token: Column, advances: Column, default: float, width: Column) -> Column:
    """A token's pieces (text, width) that are no wider than width each; a character that is wider alone is a piece of its own."""
    start = F.struct(F.array().cast("array<struct<text:string,width:double>>").alias("done"), F.lit("").alias("text"), F.lit(0.0).alias("width"))
    one = lambda s: F.struct(s["text"].alias("text"), s["width"].alias("width"))

    def step(s, c):
        def placed(w):
            full = (s["text"] != "") & (s["width"] + w > width)
            return F.struct(
                F.when(full, F.concat(s["done"], F.array(one(s)))).otherwise(s["done"]).alias("done"),
                F.when(full, c).otherwise(F.concat(s["text"], c)).alias("text"),
                F.when(full, w).otherwise(s["width"] + w).alias("width"),
            )

        return _let(F.coalesce(F.try_element_at(advances, c), F.lit(float(default))), placed)

    return F.aggregate(_characters(token), start, step, lambda s: F.concat(s["done"], F.array(one(s))))


def wrapped(text: Column, advances: Column, width: Column | float, default: float = 1.0) -> Column:
    """The lines of a text no wider than width, as an array.

    Paragraphs are kept apart; blanks between words become one space; a paragraph without words is an
    empty line. A word that doesn't fit the width begins on a new line, is split, and its last piece takes what follows, as
    long as a further word and a space fit. A null text is one empty line.
    """
    width = width if isinstance(width, Column) else F.lit(float(width))
    space = F.coalesce(F.try_element_at(advances, F.lit(" ")), F.lit(float(default)))
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("text"), F.lit(0.0).alias("width"))

    def step(s, pieces):
        last = F.element_at(pieces, -1)
        many, empty = F.size(pieces) > 1, s["text"] == ""
        joined = s["width"] + space + last["width"]
        fits = ~many & ~empty & (joined <= width)
        closed = F.when(fits | (~many & empty), s["lines"]).otherwise(F.concat(s["lines"], F.when(empty, F.array().cast("array<string>")).otherwise(F.array(s["text"])), F.when(many, F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: p["text"])).otherwise(F.array().cast("array<string>"))))
        return F.struct(closed.alias("lines"), F.when(fits, F.concat(s["text"], F.lit(" "), last["text"])).otherwise(last["text"]).alias("text"), F.when(fits, joined).otherwise(last["width"]).alias("width"))

    def paragraph(p):
        words = F.filter(F.split(F.regexp_replace(p, SPACES, " "), " "), lambda w: w != "")
        pieces = F.transform(words, lambda w: split_token(w, advances, default, width))
        return F.aggregate(pieces, start, step, lambda s: F.concat(s["lines"], F.array(s["text"])))

    own = F.coalesce(text, F.lit(""))
    # a break at the end begins no further paragraph
    parts = F.split(F.regexp_replace(own, f"(?:{PARAGRAPHS})\\z", ""), PARAGRAPHS)
    return F.flatten(F.transform(parts, paragraph))
