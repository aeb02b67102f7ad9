"""The rules that turn numbers into flags, statuses and change classes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.settings import Settings

_EPSILON = 2.220446049250313e-16  # one step of a double above 1


def is_categorical(distinct: Column, non_null: Column, max_length: Column, s: Settings) -> Column:
    """Few distinct values, none long, at least one that repeats, and enough rows per value on average."""
    return (
        (distinct >= 1)
        & (distinct <= s.categorical_max_distinct)
        & (F.coalesce(max_length, F.lit(0)) <= s.categorical_max_value_length)
        & (distinct < non_null)
        & (non_null >= distinct * F.lit(s.categorical_min_rows_per_value))
    )


def status(s: Settings) -> Column:
    """The verdict on a measurement. A skipped one is unverifiable or empty, whatever its numbers say."""
    return F.expr(f"""CASE
        WHEN skipped IS NOT NULL THEN if(empty, 'empty', 'unverifiable')
        WHEN kind = 'relationship' THEN CASE
            WHEN hit IS NULL THEN 'unverifiable'
            WHEN hit >= {s.join_confirmed}D THEN 'confirmed'
            WHEN hit >= {s.join_broken}D THEN 'broken'
            ELSE 'rejected' END
        WHEN kind = 'dead_table' THEN CASE
            WHEN populated = 0 THEN 'confirmed'
            WHEN row_count IS NULL AND age_days IS NULL THEN 'unverifiable'
            WHEN row_count = 0 OR age_days > {s.stale_after_days}D THEN 'confirmed'
            ELSE 'rejected' END
        WHEN kind = 'inconsistent_values' THEN CASE
            WHEN collisions IS NULL THEN 'unverifiable'
            WHEN collisions > 0 THEN 'confirmed'
            ELSE 'rejected' END
        WHEN kind = 'duplicate_entity' THEN CASE
            WHEN same_definition IS NOT NULL THEN if(same_definition = 1, 'confirmed', 'rejected')
            WHEN overlap IS NULL THEN 'unverifiable'
            WHEN greatest(overlap, overlap_reverse) >= {s.duplicate_overlap}D THEN 'confirmed'
            ELSE 'rejected' END
        WHEN kind = 'missing_key' THEN CASE
            WHEN has_primary_key IS NULL THEN 'unverifiable'
            WHEN has_primary_key = 0 THEN 'confirmed'
            ELSE 'rejected' END
        ELSE 'unverifiable' END""")


# How bad a status is, where a claim's statuses can be compared at all.
JOIN_RANKS = {"confirmed": 0, "broken": 1, "rejected": 2}
SUSPICION_RANKS = {"rejected": 0, "confirmed": 1}


def _rank(status: Column, ranks: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in ranks.items() for x in pair])[status]


def change_class(
    is_relationship: Column,
    before: Column,
    after: Column,
    hit_before: Column,
    hit_after: Column,
    missing: Column,
    tolerance: float,
) -> Column:
    """
    What happened to a claim between two runs.

    A status of a higher rank than before is a regression. Only a fall from rank 1 to 0 is an improvement: a rejected join
    that holds now was another claim then. Statuses without a rank are changed or, where nothing was measured, not compared.
    """
    old, new = (F.when(is_relationship, _rank(s, JOIN_RANKS)).otherwise(_rank(s, SUSPICION_RANKS)) for s in (before, after))
    step = F.abs(hit_after - hit_before)
    drifts = F.coalesce((step > 0) & (step + F.lit(_EPSILON) >= tolerance), F.lit(False))
    unmeasured = F.lit("unverifiable").isin(before, after)
    compared = F.when(new > old, "regression").when((old == 1) & (new == 0), "improved")
    moved = F.coalesce(compared, F.when(unmeasured, "not measured").otherwise("changed"))
    stayed = F.when(drifts, "drift").otherwise("unchanged")
    return F.when(missing.isNotNull(), "stale").otherwise(F.when(before == after, stayed).otherwise(moved))
