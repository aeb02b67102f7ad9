"""How a cell becomes text, a comparable key or a short stand-in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.schema import keeps_own_equality

# A text up to this many characters travels through a shuffle as it is; a longer one as its digest and its length.
RAW_TEXT_CHARS = 64


# Integers are kept as bits of words of so many.
WORD = 64


def word_of(key: Column) -> Column:
    """The word of neighbours that an integer is in."""
    return F.shiftright(key, WORD.bit_length() - 1)


def bit_of(key: Column) -> Column:
    """The integer's bit of its word."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), key.bitwiseAND(F.lit(WORD - 1)).cast("int"))


def cell(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_text(column: Column, dt: T.DataType) -> Column:
    """The value as text. A string is left alone, so a filter on it reaches the scan and a collation survives."""
    return column if isinstance(dt, T.StringType) else column.cast("string")


def compact(text: Column) -> Column:
    """
    A stand-in equal exactly where the texts are equal: the text itself, or SHA-256 and length of a long one.

    The two never collide, a digest being longer than any text kept as it is. So a grouping on long texts shuffles
    some 70 bytes a row and not the texts.
    """
    length = F.char_length(text)
    return F.when(length <= RAW_TEXT_CHARS, text).when(length > RAW_TEXT_CHARS, F.concat(F.sha2(text.cast("binary"), 256), F.lit(":"), length.cast("string")))


def compact_length(compacted: Column) -> Column:
    """The character length of the text ``compact`` stands for."""
    length = F.char_length(compacted)
    return F.when(length <= RAW_TEXT_CHARS, length).otherwise(F.substring_index(compacted, ":", -1).cast("int"))


def canonical(text: Column) -> Column:
    """Spaces off both ends and lower case: the form two spellings of one value share."""
    return F.lower(F.trim(text))


def match_key(column: Column, dt: T.DataType, common: T.DataType | None) -> Column:
    """The value as both sides of a join compare it: in the common type, or as text when there is none."""
    if common is None:
        return compact(column.cast("string"))
    if keeps_own_equality(common):
        return column
    if isinstance(common, T.StringType):
        return compact(column)
    return column if dt == common else column.cast(common)


def group_key(column: Column, dt: T.DataType) -> Column:
    """The value as a set operation groups it: a long text by its stand-in, a map by its sorted entries."""
    if keeps_own_equality(dt):
        return column
    if isinstance(dt, T.StringType):
        return compact(column)
    if isinstance(dt, T.VariantType):
        return compact(column.cast("string"))
    if isinstance(dt, T.MapType):
        return F.array_sort(F.map_entries(column))
    return column

