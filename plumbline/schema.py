"""Type families, how two columns compare, and the schemas of every input and output table."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, TIME, OTHER = "text", "time", "other"


def _is_text(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType, T.BinaryType, T.VariantType))


def family(dt: T.DataType) -> str:
    """By declared type only, never by column name."""
    if _is_text(dt):
        return TEXT
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TIME
    return OTHER


def is_integer(dt: T.DataType) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def keeps_own_equality(dt: T.DataType) -> bool:
    """A string column whose collation, not its bytes, decides which values are equal."""
    return isinstance(dt, T.StringType) and dt.collation != "UTF8_BINARY"


def comparison_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type two columns are compared in as they are, or None when they only compare as text."""
    if is_integer(a) and is_integer(b):
        return T.LongType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return _numeric(a, b)
    if family(a) == TIME and family(b) == TIME:
        if isinstance(a, T.DateType) and isinstance(b, T.DateType):
            return T.DateType()
        zoned = isinstance(a, T.TimestampType) or isinstance(b, T.TimestampType)
        return T.TimestampType() if zoned else T.TimestampNTZType()
    if keeps_own_equality(a) or keeps_own_equality(b):
        return a if a == b else None
    if isinstance(a, (T.StringType, T.CharType, T.VarcharType)) and isinstance(b, (T.StringType, T.CharType, T.VarcharType)):
        return T.StringType()
    if a == b and isinstance(a, (T.BooleanType, T.BinaryType, T.ArrayType, T.StructType)):
        return a
    return None


def _numeric(a: T.DataType, b: T.DataType) -> T.DataType:
    if not all(is_integer(t) or isinstance(t, T.DecimalType) for t in (a, b)):
        return T.DoubleType()
    (pa, sa), (pb, sb) = (((t.precision, t.scale) if isinstance(t, T.DecimalType) else (19, 0)) for t in (a, b))
    scale = max(sa, sb)
    digits = max(pa - sa, pb - sb) + scale
    return T.DecimalType(digits, scale) if digits <= 38 else T.DoubleType()


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<string>": T.ArrayType(T.StringType()),
    "map<string:double>": T.MapType(T.StringType(), T.DoubleType()),
}


def fields(text: str) -> T.StructType:
    """A schema from "name type, name type", without a session to ask."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


# Inputs.
KEYS = fields("table string, kind string, ordinal int, column string, ref_table string, ref_column string")
RELATIONSHIPS = fields(
    "from_table string, from_column string, to_table string, to_column string, when_column string, when_equals string,"
    " basis string, confidence double, reason string"
)
SUSPICIONS = fields("kind string, tables array<string>, column string, detail string")

# What the catalog knows.
RELATIONS = fields(
    "position int, name string, schema string, kind string, definition string, partitions bigint, populated boolean, comment string"
)
COLUMNS = fields(
    "table string, ordinal int, column string, type string, nullable boolean, family string, is_integer boolean, comment string"
)

# The numbers of a measurement, in the order findings text lists them.
NUMBERS = {
    "total": "bigint",
    "hits": "bigint",
    "orphans": "bigint",
    "hit": "double",
    "nulls": "bigint",
    "orphans_above": "bigint",
    "orphans_below": "bigint",
    "candidates": "bigint",
    "also_fits": "bigint",
    "exact": "int",
    "row_count": "bigint",
    "age_days": "bigint",
    "populated": "int",
    "distinct_values": "bigint",
    "canonical_forms": "bigint",
    "collisions": "bigint",
    "matched": "bigint",
    "shared_columns": "int",
    "overlap": "double",
    "total_reverse": "bigint",
    "matched_reverse": "bigint",
    "overlap_reverse": "double",
    "same_definition": "int",
    "has_primary_key": "int",
}
# The same numbers as findings text and snapshots name them, where the name differs.
NUMBER_NAMES = {
    "orphans_above": "orphansAbove",
    "orphans_below": "orphansBelow",
    "also_fits": "alsoFits",
    "row_count": "count",
    "age_days": "ageDays",
    "distinct_values": "distinctValues",
    "canonical_forms": "canonicalForms",
    "shared_columns": "sharedColumns",
    "total_reverse": "totalReverse",
    "matched_reverse": "matchedReverse",
    "overlap_reverse": "overlapReverse",
    "same_definition": "sameDefinition",
    "has_primary_key": "hasPrimaryKey",
}
MEASUREMENT_HEAD = {"claim_id": "string", "position": "int", "kind": "string", "over": "string"}
MEASUREMENT_TAIL = {"skipped": "string", "empty": "boolean"}
MEASUREMENT_TYPES = {**MEASUREMENT_HEAD, **NUMBERS, **MEASUREMENT_TAIL}
MEASUREMENTS = fields(", ".join(f"{name} {kind}" for name, kind in MEASUREMENT_TYPES.items()))

# Fixed values.
STATUSES = ["confirmed", "broken", "rejected", "unverifiable", "empty"]
CHANGE_CLASSES = ["regression", "stale", "drift", "improved", "changed", "not measured", "unchanged"]
NO_SOURCE_ROWS = "no non-null rows to test"
NO_TARGET_ROWS = "no rows to match against"
NEVER_REFRESHED = "a materialized view that has never been refreshed cannot be read"
HIDDEN = "[hidden]"
