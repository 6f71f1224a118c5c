"""What a text, or a group of texts of any size, says: sentences chosen by the words they are the first to hold.

Each word weighs the bit length of its number of occurrences and counts once, for the first sentence that holds it. So a
sentence is worth what it adds to those before it, a repeated one adds nothing, and a word that only the last text holds
still speaks for its sentence. The sentences worth most are kept, as many as fit, and shown in their order; where all
fit, all are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A sentence: up to 200 characters without an end mark or line break, and its end marks; longer ones are cut at spaces, else anywhere.
SENTENCE = r"[^.!?\n]{1,200}(?:[.!?]{1,20}|[ \n]|\z)|[^.!?\n]{1,200}"
#: End marks after which a line break is set first: a class with them would slow down every character of every text.
WIDE_ENDS = "[。！？]+"
WORD = r"\p{L}{2,}"
BLANK = " \t\r\n"
#: Bits of a sentence's key: its length, its number in its text, and above them the number of the text.
_LENGTH, _NUMBER = 8, 24


def sentences(text) -> Column:
    """All sentences of a text, stripped; blank ones are left out."""
    whole = F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit(""))
    found = F.regexp_extract_all(F.regexp_replace(whole, WIDE_ENDS, "$0\n"), F.lit(SENTENCE), F.lit(0))
    return F.filter(F.transform(found, lambda s: F.btrim(s, F.lit(BLANK))), lambda s: s != "")


def sentence_rows(texts: DataFrame, keys: list[str], place, said: str) -> DataFrame:
    """One row (keys, key, sentence) per sentence of column ``said``, a row's ``place`` numbering it in its group.

    ``key`` orders the sentences of a group and holds their length.
    """
    each = texts.select(*keys, F.lit(place).alias("_place") if isinstance(place, int) else F.col(place).alias("_place"), F.posexplode(said).alias("_n", "_s"))
    key = (F.shiftleft(F.col("_place").cast("long"), _LENGTH + _NUMBER)
           + F.shiftleft(F.col("_n").cast("long"), _LENGTH) + F.length("_s"))
    return each.select(*keys, key.alias("key"), F.col("_s").alias("sentence"))


def word_rows(texts: DataFrame, keys: list[str], place, said: str, marks: bool = True) -> DataFrame:
    """One row (keys, word, key) per occurrence of a word in the sentences of column ``said``.

    With ``marks`` every sentence also has a mark of its own, which is no word and weighs nothing, so that one that adds no word is
    there to fill what room is left.
    """
    found = F.regexp_extract_all(F.lower("sentence"), F.lit(WORD), F.lit(0))
    if marks:
        found = F.array_append(found, F.concat(F.lit(" "), F.col("key").cast("string")))
    return sentence_rows(texts, keys, place, said).select(*keys, "key", F.explode(found).alias("word"))


def least_room(text: str) -> Column:
    """At least so many characters do the sentences of a text hold: whatever is neither blank nor an end mark is in one.

    Only the beginning is looked at; what follows can but add to it.
    """
    begin = F.substring(F.coalesce(F.col(text), F.lit("")), 1, 256)
    return F.length(F.translate(begin, ".!?" + BLANK, ""))


def is_word() -> Column:
    return ~F.col("word").startswith(" ")


def counted_words(words: DataFrame, keys: list[str]) -> DataFrame:
    """Each word of a group with its occurrences ``n`` and the ``key`` of its first sentence; added up before the shuffle."""
    return words.groupBy(*keys, "word").agg(F.count("*").alias("n"), F.min("key").alias("key"))


def weight() -> Column:
    """What a word speaks for its sentence: the bit length of its occurrences."""
    return F.when(is_word(), F.length(F.bin("n"))).otherwise(0)


def best_first() -> list[Column]:
    return [F.desc("score"), F.asc("key")]


def room(key="key") -> Column:
    """Characters a sentence takes, with one to join it."""
    return F.col(key).bitwiseAND(F.lit((1 << _LENGTH) - 1)) + 1


def place_of(key="key") -> Column:
    return F.shiftright(key, _LENGTH + _NUMBER)


def number_of(key: Column) -> Column:
    return F.shiftright(key, _LENGTH).bitwiseAND(F.lit((1 << _NUMBER) - 1)).cast("int")
