"""Suspected data problems measured on the data: dead tables, inconsistent values, duplicate tables, missing keys."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schema as S
from plumbline.functions.values import as_text, canonical, cell, compact, group_key
from plumbline.operators.profile import listed_columns, table_profile
from plumbline.operators.sampling import Scan
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog, Relation, _union
from plumbline.sources.sizes import extents, row_counts
from plumbline.sources.small import small_table

_MICROS_PER_DAY = 86_400_000_000


@dataclass(frozen=True)
class Suspicion:
    kind: str
    tables: tuple[str, ...]
    column: str | None = None
    detail: str = ""

    @property
    def claim_id(self) -> str:
        return f"suspicion:{self.kind}:{'+'.join(self.tables)}{'.' + self.column if self.column else ''}"


def suspicions_of(suspicions: DataFrame) -> list[Suspicion]:
    """The rows of a suspicions table as plans are built from them, by id."""
    rows = suspicions.select(*S.SUSPICIONS.names).collect()
    return sorted((Suspicion(r["kind"], tuple(r["tables"]), r["column"], r["detail"]) for r in rows), key=lambda s: s.claim_id)


# ---- dead table ----


def _micros(name: str, dt: T.DataType) -> Column:
    """Microseconds since 1970, a time without zone read as UTC whatever the session's zone."""
    column = cell(name)
    if isinstance(dt, T.DateType):
        return F.unix_date(column).cast("bigint") * F.lit(_MICROS_PER_DAY)
    if isinstance(dt, T.TimestampType):
        return F.unix_micros(column)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


def _as_of(settings: Settings) -> int:
    at = settings.as_of or datetime.now(UTC)
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    since = at - datetime(1970, 1, 1, tzinfo=UTC)
    return (since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds


def _newest(relation: Relation, as_of: int) -> Column:
    """The newest of a row's dates and times that is not after ``as_of``; null where there is none."""
    nothing = F.lit(None).cast("bigint")
    times = [_micros(f.name, f.dataType) for f in relation.struct.fields if S.family(f.dataType) == S.TIME]
    return F.greatest(*[F.when(t <= as_of, t) for t in times], nothing, nothing)


def dead_table(catalog: Catalog, tables: list[str], settings: Settings) -> DataFrame:
    """(table, row_count, age_days): every table aggregated whole, reading its time columns alone, one row per task shuffled."""
    as_of = _as_of(settings)
    rows = _union([catalog[t].df.select(F.lit(t).alias("table"), _newest(catalog[t], as_of).alias("newest")) for t in tables])
    counted = rows.groupBy("table").agg(F.count(F.lit(1)).alias("row_count"), F.max("newest").alias("newest"))
    listed = small_table(catalog.spark, [(t,) for t in tables], "table string")
    return listed.join(F.broadcast(counted), "table", "left").selectExpr(
        "table",
        "coalesce(row_count, 0) AS row_count",
        f"cast(ceil(({as_of} - newest) / cast({_MICROS_PER_DAY} AS decimal(20, 0))) AS bigint) AS age_days",
    )


# ---- inconsistent values ----


def _spellings(scan: Scan, columns: list[tuple[int, str, str]], told: bool = False) -> DataFrame:
    """
    Distinct (i, canonical, value) of the numbered columns, both as short stand-ins unless they are ``told``.

    One shuffle for all columns; a column whose collation decides equality is deduplicated by itself first.
    """
    frames = []
    short = (lambda text: text) if told else compact
    for i, table, column in columns:
        relation = scan.catalog[table]
        text = as_text(cell(column), relation.type_of(column)).alias("v")
        values = scan(relation).select(text)
        if S.keeps_own_equality(relation.type_of(column)):
            values = values.distinct().select(F.col("v").cast("string").alias("v"))
        frames.append(values.where("v IS NOT NULL").select(F.lit(i).alias("i"), short(canonical(F.col("v"))).alias("form"), short(F.col("v")).alias("v")))
    return _union(frames).distinct()


def inconsistent_values(scan: Scan, columns: list[tuple[int, str, str]]) -> DataFrame:
    """(i, distinct_values, canonical_forms, collisions) of the numbered columns."""
    forms = _spellings(scan, columns).groupBy("i", "form").agg(F.count(F.lit(1)).alias("n"))
    counted = forms.groupBy("i").agg(F.sum("n").alias("distinct_values"), F.count(F.lit(1)).alias("canonical_forms"))
    return counted.selectExpr("i", "distinct_values", "canonical_forms", "distinct_values - canonical_forms AS collisions")


def inconsistent_groups(catalog: Catalog, columns: list[tuple[str, str]], settings: Settings) -> DataFrame:
    """
    The spellings behind each collision, sorted. For categorical columns alone, whose values may be shown and are few: any
    other column asked for gives no rows.
    """
    scan = Scan.of(catalog, settings, [t for t, _ in columns])
    out = "table string, column string, canonical string, spellings array<string>"
    columns = listed_columns(table_profile(catalog, settings, columns, scan), "categorical") if columns else []
    if not columns:
        return small_table(catalog.spark, [], out)
    listed = small_table(catalog.spark, [(i, *c) for i, c in enumerate(columns)], "i int, table string, column string")
    groups = _spellings(scan, [(i, *c) for i, c in enumerate(columns)], told=True).groupBy("i", "form").agg(F.sort_array(F.collect_list("v")).alias("spellings"))
    return groups.where(F.size("spellings") > 1).join(F.broadcast(listed), "i").selectExpr("table", "column", "form AS canonical", "spellings")


# ---- duplicate tables ----


def duplicate_overlap(scan: Scan, a: Relation, b: Relation, shared: list[str]) -> DataFrame:
    """
    One row: how many of each table's distinct rows, on the columns they share, the other holds too. Nulls are equal.

    Both tables meet in one grouping by the shared columns, so each is read and shuffled once for both directions, rows
    repeated within a table collapse before the shuffle, and long texts travel as their stand-ins. Of a sampled table the
    sample's rows are counted, against all of the other.
    """
    types = [S.comparison_type(a.type_of(c), b.type_of(c)) for c in shared]
    as_they_are = all(t is not None for t in types)

    def keys(r: Relation) -> list[Column]:
        out = []
        for i, (c, t) in enumerate(zip(shared, types, strict=True)):
            dt = r.type_of(c)
            key = group_key(cell(c) if dt == t else cell(c).cast(t), t) if as_they_are else compact(cell(c).cast("string"))
            out.append(key.alias(f"c{i}"))
        return out

    sides = []
    for r, side in ((a, "a"), (b, "b")):
        whole = r.df.select(*keys(r), *[F.lit(side == s).alias(s) for s in ("a", "b")])
        if scan.is_sampled(r):
            sides.append(whole.select("*", F.lit(False).alias("of_a"), F.lit(False).alias("of_b")))
            sides.append(scan(r).select(*keys(r), F.lit(False).alias("a"), F.lit(False).alias("b"), *[F.lit(side == s).alias(f"of_{s}") for s in ("a", "b")]))
        else:
            sides.append(whole.selectExpr("*", "a AS of_a", "b AS of_b"))
    flags = ("a", "b", "of_a", "of_b")
    rows = _union(sides).groupBy(*[f"c{i}" for i in range(len(shared))]).agg(*[F.max(f).alias(f) for f in flags])
    counts = rows.selectExpr(*flags).agg(
        F.expr("count_if(of_a) AS total"), F.expr("count_if(of_a AND b) AS matched"),
        F.expr("count_if(of_b) AS total_reverse"), F.expr("count_if(of_b AND a) AS matched_reverse"),
    )
    some = "total > 0"
    return counts.selectExpr(
        "total", "matched", f"{len(shared)} AS shared_columns",
        f"if({some}, matched / total, null) AS overlap",
        f"if({some}, total_reverse, null) AS total_reverse",
        f"if({some}, matched_reverse, null) AS matched_reverse",
        f"if({some}, if(total_reverse = 0, 0.0D, matched_reverse / total_reverse), null) AS overlap_reverse",
    )


def same_definition(relations: DataFrame) -> DataFrame:
    """Pairs of views whose definitions are the same text."""
    views = relations.where("kind <> 'table' AND definition IS NOT NULL").select("name", "definition")
    a, b = views.alias("a"), views.alias("b")
    return a.join(b, F.expr("a.definition = b.definition AND a.name < b.name")).selectExpr("a.name AS name", "b.name AS same_as")


def missing_key(catalog: Catalog) -> DataFrame:
    """The relations that declare no primary key."""
    keyed = catalog.keys_df().where("kind = 'p'").selectExpr("table AS name")
    return catalog.relations_df().join(F.broadcast(keyed), "name", "left_anti").select("name", "kind")


# ---- a table of suspicions ----

_DEAD = ("row_count", "age_days")
_VALUES = ("distinct_values", "canonical_forms", "collisions")
_OVERLAP = ("total", "matched", "shared_columns", "overlap", "total_reverse", "matched_reverse", "overlap_reverse")


def _shared(a: Relation, b: Relation) -> list[str]:
    return [c for c in a.struct.names if b.has(c)]


def _why_not(catalog: Catalog, s: Suspicion) -> str | None:
    """Why a suspicion cannot be measured, decided from the catalog alone."""
    first = catalog.find(s.tables[0])
    if s.kind in ("dead_table", "missing_key", "inconsistent_values") and first is None:
        return f"unknown table {s.tables[0]}"
    if s.kind == "inconsistent_values":
        if not s.column:
            return "no column named"
        if first.unread is None and not first.has(s.column):
            return f"unknown column {first.name}.{s.column}"
        return first.unread
    if s.kind == "dead_table":
        return first.unread
    if s.kind == "duplicate_entity":
        second = catalog.find(s.tables[1]) if len(s.tables) > 1 else None
        if first is None or second is None:
            return f"needs two known tables, got {', '.join(s.tables)}"
        if _both_views(first, second):
            return None
        if first.unread or second.unread:
            return first.unread or second.unread
        return None if _shared(first, second) else "no shared column names"
    return None if s.kind == "missing_key" else "no measurement exists for this kind of suspicion"


def _both_views(a: Relation, b: Relation) -> bool:
    return a.kind != "table" and b.kind != "table"


def measure_suspicions(catalog: Catalog, suspicions: list[Suspicion], settings: Settings) -> DataFrame:
    """A measurement per suspicion, in the order given, in one lazy plan."""
    spark = catalog.spark
    named = [
        (i, Suspicion(s.kind, tuple(r.name if (r := catalog.find(t)) else t for t in s.tables), s.column, s.detail))
        for i, s in enumerate(suspicions)
    ]
    rows, dead, values, pairs, needing = [], set(), [], [], set()
    for i, s in named:
        why = _why_not(catalog, s)
        a, b = catalog.find(s.tables[0]), catalog.find(s.tables[1]) if len(s.tables) > 1 else None
        populated = same = has_key = None
        never_first, never_second, needs_rows = False, False, False
        if why is None and s.kind == "dead_table":
            populated = None if a.populated else 0
            if a.populated:
                dead.add(a.name)
        elif why is None and s.kind == "missing_key":
            has_key = int(a.name in catalog.primary)
        elif why is None and s.kind == "duplicate_entity" and _both_views(a, b):
            same = int(a.definition is not None and a.definition == b.definition)
        elif why is None and s.kind in ("inconsistent_values", "duplicate_entity"):
            measured = [a] if s.kind == "inconsistent_values" else [a, b]
            never_first, never_second, needs_rows = not a.populated, not measured[-1].populated, True
            needing |= {r.name for r in measured}
            if not (never_first or never_second):
                values += [(i, a.name, s.column)] if s.kind == "inconsistent_values" else []
                pairs += [(i, a, b)] if s.kind == "duplicate_entity" else []
        over = s.tables[0] if len(s.tables) > 1 else None
        second = s.tables[1] if s.kind == "duplicate_entity" and len(s.tables) > 1 else None
        rows.append((i, s.claim_id, s.kind, over, s.tables[0], second, why, never_first, never_second, needs_rows, populated, same, has_key))

    # Rows come from the footers where a relation is files, else they are counted in the plan.
    sized = extents(catalog, {t: () for t in sorted(needing)})
    rows = [(*row, *[sized[t].rows if t in sized else None for t in row[4:6]]) for row in rows]
    asked = small_table(
        spark, rows,
        "position int, claim_id string, kind string, over string, table string, second string, reason string, never_first boolean,"
        " never_second boolean, needs_rows boolean, populated int, same_definition int, has_primary_key int, known_first bigint, known_second bigint",
    )
    involved = sorted(dead | {t for _, t, _ in values} | {r.name for _, a, b in pairs for r in (a, b)})
    scan = Scan.of(catalog, settings, involved)
    counted = _dead_numbers(catalog, sorted(dead), scan, settings)
    checked = inconsistent_values(scan, values) if values else small_table(spark, [], "i int, distinct_values bigint, canonical_forms bigint, collisions bigint")
    asked_values = small_table(spark, [(i,) for i, *_ in values], "i int").join(F.broadcast(checked), "i", "left")
    checked = asked_values.selectExpr("i AS position", *[f"coalesce({c}, 0) AS {c}" for c in _VALUES])
    if pairs:
        overlaps = _union([duplicate_overlap(scan, a, b, _shared(a, b)).select(F.lit(i).alias("position"), "*") for i, a, b in pairs])
    else:
        overlaps = small_table(spark, [], "position int, " + ", ".join(f"{c} {S.NUMBERS[c]}" for c in _OVERLAP))
    joined = asked.join(F.broadcast(counted), "table", "left").join(F.broadcast(checked), "position", "left").join(F.broadcast(overlaps), "position", "left")
    unsized = sorted(t for t in needing if t not in sized and catalog[t].df is not None)
    for place, name in (("first", "table"), ("second", "second")):
        here = [t for t in unsized if any(row[4 if place == "first" else 5] == t for row in rows)]
        if here:
            found = row_counts(catalog, here).selectExpr(f"table AS {name}", f"rows AS counted_{place}")
            joined = joined.join(F.broadcast(found), name, "left").withColumn(f"{place}_rows", F.coalesce(f"known_{place}", f"counted_{place}"))
        else:
            joined = joined.withColumn(f"{place}_rows", F.col(f"known_{place}"))
    no_rows = "needs_rows AND (coalesce(first_rows = 0, false) OR coalesce(second_rows = 0, false))"
    nothing_found = "(kind = 'inconsistent_values' AND coalesce(distinct_values = 0, false)) OR (kind = 'duplicate_entity' AND coalesce(total = 0, false))"
    many = f"kind = 'inconsistent_values' AND distinct_values > {settings.categorical_max_distinct}"
    flagged = joined.selectExpr(
        "*",
        f"""CASE WHEN reason IS NOT NULL THEN reason
                 WHEN never_first THEN '{S.NEVER_REFRESHED}'
                 WHEN needs_rows AND first_rows = 0 THEN '{S.NO_SOURCE_ROWS}'
                 WHEN never_second THEN '{S.NEVER_REFRESHED}'
                 WHEN needs_rows AND second_rows = 0 THEN '{S.NO_TARGET_ROWS}'
                 WHEN {nothing_found} THEN '{S.NO_SOURCE_ROWS}'
                 WHEN {many} THEN concat('not categorical: ', distinct_values, ' distinct values') END AS skipped""",
        f"reason IS NULL AND (never_first OR never_second OR ({no_rows}) OR {nothing_found}) AS empty",
        f"NOT ({no_rows}) AS told",
    )
    by_kind = {**dict.fromkeys(("exact", *_DEAD), "dead_table"), **dict.fromkeys(_VALUES, "inconsistent_values"), **dict.fromkeys(_OVERLAP, "duplicate_entity")}
    known = {*by_kind, "populated", "same_definition", "has_primary_key", "claim_id", "position", "kind", "over", "skipped", "empty"}
    numbers = {c: f"if(told AND reason IS NULL AND kind = '{k}', {c}, null)" for c, k in by_kind.items()}
    any_number = ", ".join(f"cast({numbers.get(c, c)} AS double)" for c in S.NUMBERS if c in known)
    told = {**{c: c for c in known}, **numbers, "over": f"if(coalesce({any_number}) IS NOT NULL, over, null)"}
    return flagged.selectExpr(*[f"cast({told.get(c, 'null')} AS {t}) AS {c}" for c, t in S.MEASUREMENT_TYPES.items()])


def _dead_numbers(catalog: Catalog, tables: list[str], scan: Scan, settings: Settings) -> DataFrame:
    """Counted where the table is measured whole; of a sampled table the estimate stands in, and its age is still exact."""
    if not tables:
        return small_table(catalog.spark, [], "table string, exact int, row_count bigint, age_days bigint")
    estimates = small_table(
        catalog.spark,
        [(t, scan.rows[t] if scan.is_sampled(catalog[t]) else None) for t in tables],
        "table string, estimate bigint",
    )
    return dead_table(catalog, tables, settings).join(F.broadcast(estimates), "table").selectExpr(
        "table", "if(estimate IS NULL, 1, 0) AS exact", "coalesce(estimate, row_count) AS row_count", "age_days"
    )
