"""Numbers and findings as text, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100))


def number(value: Column) -> Column:
    """A number in its shortest decimal form: 1, not 1.0; 0.875; never an exponent."""
    text = value.cast("double").cast("decimal(38,18)").cast("string")
    return F.regexp_replace(text, r"\.?0+$", "")


def whole(value: Column) -> Column:
    return value.cast("string")


def plural(count: Column, noun: str) -> Column:
    return F.when(count == 1, F.lit(noun)).otherwise(F.lit(noun + "s"))


# What an escape string writes for a character that would not stay on the line, or would be read as an escape.
_ESCAPES = {"\\": "\\\\", "\n": "\\n", "\r": "\\r"}


def sql_literal(text: Column) -> Column:
    """The text as a quoted SQL string. One that holds line breaks is an escape string, so that it takes a single line."""
    plain = F.regexp_replace(text, "(')", "$1$1")
    escaped = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), _ESCAPES.items(), plain)
    return F.when(text.rlike("[\r\n]"), F.concat(F.lit("E'"), escaped, F.lit("'"))).otherwise(F.concat(F.lit("'"), plain, F.lit("'")))


def filled(template: str, parts: dict[str, Column]) -> Column:
    """The template with the text of each part in place of its name in braces."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[(parts[piece] if i % 2 else F.lit(piece)) for i, piece in enumerate(pieces) if piece])


def listed(parts: Column) -> Column:
    """An array of phrases as English lists them: a, b, and c."""
    last = F.element_at(parts, -1)
    head = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return (
        F.when(F.size(parts) == 0, F.lit(""))
        .when(F.size(parts) == 1, last)
        .when(F.size(parts) == 2, F.concat(F.element_at(parts, 1), F.lit(" and "), last))
        .otherwise(F.concat(F.array_join(head, ", "), F.lit(", and "), last))
    )


def or_blank(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
