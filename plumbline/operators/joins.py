"""Claimed joins measured on the data: hit rates, orphans, conditions, and whether other keys would match as well."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schema as S
from plumbline.functions.values import RAW_TEXT_CHARS, WORD, as_text, bit_of, cell, match_key, word_of
from plumbline.operators.profile import table_profile
from plumbline.operators.sampling import Scan
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog, Relation, _union
from plumbline.sources.sizes import bytes_setting, extents, row_counts
from plumbline.sources.small import small_table

# A from-value on more than one in this many rows is hot; its orphan rows are spread over this many buckets.
HOT_SHARE = 1000
HOT_SPREAD = 100_000

# So many targets are looked up at once: their number has room beside a word in 64 bits.
TARGETS = 64

# Memory of a broadcast row beside a text, and the longest text a key can be.
ROW_BYTES = 96
TEXT_BYTES = 4 * RAW_TEXT_CHARS

# Up to so many orphan values are broadcast to where their rows are read.
FEW_ORPHANS = 10_000


@dataclass(frozen=True)
class Relationship:
    """A claim that from-values are found in the target column, on all rows or where a column reads a value."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    when_column: str | None = None
    when_equals: str | None = None
    basis: str = "inferred"
    confidence: float = 1.0
    reason: str = ""

    @property
    def claim_id(self) -> str:
        when = f"[{self.when_column}={self.when_equals}]" if self.when_column is not None else ""
        return f"relationship:{self.from_table}.{self.from_column}->{self.to_table}.{self.to_column}{when}"

    @property
    def source(self) -> tuple:
        return self.from_table, self.from_column, self.when_column, self.when_equals


def relationships_of(claims: DataFrame) -> list[Relationship]:
    """
    The rows of a claims table as plans are built from them, strongest first.

    Claims are what is asked, one row per join, and never the data; like the text of a query they are read to plan it.
    """
    rows = claims.select(*S.RELATIONSHIPS.names).collect()
    return sorted((Relationship(**r.asDict()) for r in rows), key=lambda r: (-r.confidence, r.claim_id))


# ---- counting ----


def comparison(catalog: Catalog, r: Relationship) -> T.DataType | None:
    """The type a claim's columns compare in, from the schema alone; None is the text fallback."""
    return S.comparison_type(catalog[r.from_table].type_of(r.from_column), catalog[r.to_table].type_of(r.to_column))


def places_orphans(catalog: Catalog, r: Relationship) -> bool:
    """Orphans are placed where both columns are integers and the target leads its table's key."""
    return (
        catalog[r.from_table].is_integer(r.from_column)
        and catalog[r.to_table].is_integer(r.to_column)
        and catalog.leads_key(r.to_table, r.to_column)
    )


def _key(relation: Relation, column: str, common: T.DataType | None) -> Column:
    return match_key(cell(column), relation.type_of(column), common)


def _condition(relation: Relation, r: Relationship) -> Column | None:
    """A condition compares as text; a string column is compared as it is, so the filter reaches the scan."""
    if r.when_column is None:
        return None
    return as_text(cell(r.when_column), relation.type_of(r.when_column)) == F.lit(r.when_equals)


def _target(catalog: Catalog, r: Relationship) -> DataFrame:
    return catalog[r.to_table].df.select(_key(catalog[r.to_table], r.to_column, comparison(catalog, r)).alias("t"))


# A claim as plans see it: its number and what is claimed.
Asked = list[tuple[int, Relationship]]
Target = tuple[str, str]


def _words(catalog: Catalog, targets: Iterable[Target]) -> dict[str, set[str]]:
    """The columns whose extent tells how large the target side can be and where its orphans lie."""
    out: dict[str, set[str]] = {}
    for table, column in targets:
        out.setdefault(table, set()).update([column] if catalog[table].is_integer(column) else [])
    return out


def _ends(catalog: Catalog, claims: Asked) -> dict[Target, tuple[int | None, int | None]]:
    """The lowest and highest key of every target whose orphans are placed, as constants any plan can use."""
    placed = {(r.to_table, r.to_column) for _, r in claims if places_orphans(catalog, r)}
    found = extents(catalog, _words(catalog, placed), views=True)
    return {(table, column): found[table].ends[column] for table, column in placed}


def side_bytes(catalog: Catalog, target: Target, common: T.DataType | None) -> int | None:
    """
    The most memory a target's keys can take on the other side of a join, from counts that its files keep; None where
    nothing bounds it, as for a view, or for a type whose values can be of any length.

    Distinct integers are WORD to a row where they lie close, so both the rows and the range bound them.
    """
    if common is not None and not isinstance(common, (T.StringType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return None
    if common is not None and S.keeps_own_equality(common):
        return None
    extent = extents(catalog, _words(catalog, [target])).get(target[0])
    if extent is None:
        return None
    if isinstance(common, T.LongType):
        lo, hi = extent.ends[target[1]]
        return 0 if lo is None else min(extent.rows, hi // WORD - lo // WORD + 1) * ROW_BYTES
    return extent.rows * (ROW_BYTES + (TEXT_BYTES if common is None or isinstance(common, T.StringType) else 0))


def broadcast_targets(catalog: Catalog, targets: dict[Target, T.DataType | None]) -> set[Target]:
    """The targets, smallest first, that certainly stay within the session's broadcast threshold together."""
    room = bytes_setting(catalog.spark, "spark.sql.autoBroadcastJoinThreshold")
    extents(catalog, _words(catalog, targets))  # of all at once
    known = [(size, t) for t, common in targets.items() if (size := side_bytes(catalog, t, common)) is not None]
    out = set()
    for size, target in sorted(known):
        room -= size
        if room >= 0:
            out.add(target)
    return out


def _stacked(relation: Relation, df: DataFrame, rows: list[tuple[list[Column], Column | None]]) -> DataFrame:
    """The rows of cells wanted of each row, from one read; a conditioned one only where its condition holds."""
    conditions = [on for _, on in rows if on is not None]
    if len(conditions) == len(rows):
        df = df.where(reduce(lambda a, b: a | b, conditions))  # reaches the scan
    if len(rows) == 1:
        return df.select(*rows[0][0])
    stack = F.array(*[F.struct(*cells) if on is None else F.when(on, F.struct(*cells)) for cells, on in rows])
    return df.select(F.inline(F.array_compact(stack) if conditions else stack))


def _keys_of(catalog: Catalog, common: T.DataType | None, targets: dict[Target, int]) -> DataFrame:
    """
    The distinct keys of at most TARGETS targets as one relation, every table read once: (to, t), or for integers (slot, bits).

    An integer is a bit of a word of WORD neighbours, so close keys are one row and one shuffled record for each WORD of
    them, and scattered ones no more than a row each. Word and target share one number, the slot.
    """
    columns: dict[str, list[tuple[list[Column], None]]] = {}
    for (table, column), i in targets.items():
        columns.setdefault(table, []).append(([F.lit(i).alias("to"), _key(catalog[table], column, common).alias("t")], None))
    keys = _union([_stacked(catalog[t], catalog[t].df, rows) for t, rows in columns.items()]).where("t IS NOT NULL")
    if not isinstance(common, T.LongType):
        return keys.distinct()
    return keys.select(_slot("t", "to").alias("slot"), bit_of(F.col("t")).alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))


def _slot(key: str, target: str) -> Column:
    return F.shiftleft(word_of(F.col(key)), TARGETS.bit_length() - 1).bitwiseOR(F.col(target).cast("bigint"))


def _looked_up(rows: DataFrame, keys: DataFrame, common: T.DataType | None, how: str = "left") -> DataFrame:
    """Rows with (target, key) and whether the target holds the key, as ``hit``; with ``how`` left_anti those it does not hold."""
    if isinstance(common, T.LongType):
        same, found = _slot("key", "target") == F.col("slot"), F.col("bits").bitwiseAND(bit_of(F.col("key"))) != 0
    else:
        same, found = (F.col("target") == F.col("to")) & (F.col("key") == F.col("t")), F.col("t").isNotNull()
    if how == "left_anti":
        return rows.join(keys, same & found, how)
    return rows.join(keys, same, how).withColumn("hit", F.coalesce(found, F.lit(False)))


def _counts(scan: Scan, claims: Asked, spread: bool | None = None) -> DataFrame:
    """
    One row of counts per claim: total, nulls, hits, orphans above and below where placed, lowest and highest value.

    All claims of one kind of comparison are one join for each TARGETS targets: the claimed columns of each from-table, read once and stacked as
    (claim, target, key), are looked up in the distinct keys of all targets. Keys that certainly fit are broadcast and
    nothing is shuffled but a row of counts per task. The others meet the from-values by key, after equal values of one
    source have been counted, so that a value on a third of all rows crosses as one row per task. ``spread`` forces one
    of the two ways on all targets.
    """
    catalog, ends = scan.catalog, _ends(scan.catalog, claims)
    kinds: dict[T.DataType | None, Asked] = {}
    for i, r in claims:
        kinds.setdefault(comparison(catalog, r), []).append((i, r))
    targets = {(r.to_table, r.to_column): common for common, group in kinds.items() for _, r in group}
    fits = broadcast_targets(catalog, targets) if spread is None else set() if spread else set(targets)
    frames = []
    for common, group in kinds.items():
        for way, wanted in ((_read_claims, True), (_counted_sources, False)):
            some = [(i, r) for i, r in group if ((r.to_table, r.to_column) in fits) == wanted]
            asked = list(dict.fromkeys((r.to_table, r.to_column) for _, r in some))
            for first in range(0, len(asked), TARGETS):
                numbers = {t: n for n, t in enumerate(asked[first : first + TARGETS])}
                some_of = [(i, r) for i, r in some if (r.to_table, r.to_column) in numbers]
                keys = _keys_of(catalog, common, numbers)
                met = _looked_up(way(scan, common, some_of, numbers, ends), F.broadcast(keys) if wanted else keys, common)
                frames.append(_as_counts(met, common))
    # No row of a claim counts anything here, but every claim has one.
    none = small_table(catalog.spark, [(i, (r.to_table, r.to_column) in ends) for i, r in claims], "claim int, placed boolean")
    frames.append(none.selectExpr("claim", "false AS present", "0L AS n", "false AS hit", "0L AS above", "0L AS below", "cast(null AS bigint) AS value", "placed"))
    return _union(frames).groupBy("claim").agg(
        F.expr("sum(if(present, n, 0)) AS total"), F.expr("sum(if(present, 0, n)) AS nulls"), F.expr("sum(if(hit, n, 0)) AS hits"),
        F.expr("if(any(placed), sum(above), null) AS orphans_above"), F.expr("if(any(placed), sum(below), null) AS orphans_below"),
        F.expr("min(value) AS lo"), F.expr("max(value) AS hi"),
    )


def _as_counts(met: DataFrame, common: T.DataType | None) -> DataFrame:
    """(claim, present, n, hit, above, below, value, placed) as all kinds of comparison have it."""
    whole = "key" if isinstance(common, T.LongType) else "try_cast(key AS bigint)" if common is None or isinstance(common, (T.NumericType, T.StringType)) else "cast(null AS bigint)"
    beyond = ["if(key > high, n, 0L) AS above", "if(key < low, n, 0L) AS below"] if isinstance(common, T.LongType) else ["0L AS above", "0L AS below"]
    return met.selectExpr("claim", "key IS NOT NULL AS present", "n", "hit", *beyond, f"{whole} AS value", "cast(null AS boolean) AS placed")


def _placing(ends: dict, r: Relationship) -> list[Column]:
    lo, hi = ends.get((r.to_table, r.to_column), (None, None))
    return [F.lit(lo).cast("bigint").alias("low"), F.lit(hi).cast("bigint").alias("high")]


def _read_claims(scan: Scan, common: T.DataType | None, claims: Asked, targets: dict[Target, int], ends: dict) -> DataFrame:
    """(claim, target, key, low, high, n): a row for each row and claim of a from-table, in one read of it."""
    tables: dict[str, list[tuple[list[Column], Column | None]]] = {}
    for i, r in claims:
        frm = scan.catalog[r.from_table]
        cells = [F.lit(i).alias("claim"), F.lit(targets[r.to_table, r.to_column]).alias("target"), _key(frm, r.from_column, common).alias("key"), *_placing(ends, r)]
        tables.setdefault(r.from_table, []).append((cells, _condition(frm, r)))
    rows = _union([_stacked(scan.catalog[t], scan(scan.catalog[t]), wanted) for t, wanted in tables.items()])
    return rows.withColumn("n", F.lit(1).cast("bigint"))


def _counted_sources(scan: Scan, common: T.DataType | None, claims: Asked, targets: dict[Target, int], ends: dict) -> DataFrame:
    """(claim, target, key, low, high, n): n rows of a claim's source hold the key. The claims say which source meets which target."""
    sources = {s: i for i, s in enumerate(dict.fromkeys(r.source for _, r in claims))}
    tables: dict[str, dict[int, tuple[list[Column], Column | None]]] = {}
    for _, r in claims:
        frm, i = scan.catalog[r.from_table], sources[r.source]
        tables.setdefault(r.from_table, {})[i] = ([F.lit(i).alias("id"), _key(frm, r.from_column, common).alias("key")], _condition(frm, r))
    rows = _union([_stacked(scan.catalog[t], scan(scan.catalog[t]), list(wanted.values())) for t, wanted in tables.items()])
    asked = [(sources[r.source], i, targets[r.to_table, r.to_column], *ends.get((r.to_table, r.to_column), (None, None))) for i, r in claims]
    asked = small_table(scan.catalog.spark, asked, "id int, claim int, target int, low bigint, high bigint")
    return rows.groupBy("id", "key").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(asked), "id").drop("id")


_NUMBERS = (
    "total", "nulls",
    "if(total > 0, hits, null) AS hits",
    "if(total > 0, total - hits, null) AS orphans",
    "if(total > 0, hits / total, null) AS hit",
    "if(total > 0, orphans_above, null) AS orphans_above",
    "if(total > 0, orphans_below, null) AS orphans_below",
)


def join_hit_rate(catalog: Catalog, r: Relationship, settings: Settings | None = None) -> DataFrame:
    """One row: total, nulls, hits, orphans, hit rate, and orphans above and below the key where they are counted."""
    return _counts(Scan.of(catalog, settings or Settings(), [r.from_table]), [(0, r)]).selectExpr(*_NUMBERS)


def orphan_placement(catalog: Catalog, r: Relationship, settings: Settings | None = None) -> DataFrame:
    """One row: a join's orphans above the highest key, below the lowest, and inside the range."""
    return join_hit_rate(catalog, r, settings).selectExpr(
        "orphans", "orphans_above", "orphans_below", "orphans - orphans_above - orphans_below AS orphans_inside"
    )


def orphan_rows(catalog: Catalog, r: Relationship, spread: bool | None = None) -> DataFrame:
    """
    The from-rows without a match, whole, for the caller alone.

    A target that certainly fits is broadcast and nothing is shuffled. Against another the keys are met first and alone:
    distinct from-values and target keys, a value on a third of all rows being one. If those without a match are at most
    FEW_ORPHANS, counted up to that bound when the plan is made, the rows are then fetched where they are read by a
    broadcast of these values, and no row crosses a shuffle. Of more the rows are dealt by value, those of hot ones
    spread over all partitions. ``spread`` forces one of the first two ways.
    """
    frm, on, common = catalog[r.from_table], _condition(catalog[r.from_table], r), comparison(catalog, r)
    df = frm.df if on is None else frm.df.where(on)
    target = (r.to_table, r.to_column)
    # The row travels as one value, so its columns may be called anything.
    row = F.struct(*[cell(c).alias(c) for c in frm.struct.names]).alias("row")
    rows = df.where(cell(r.from_column).isNotNull()).select(row, _key(frm, r.from_column, common).alias("key"), F.lit(0).alias("target"))
    keys = _keys_of(catalog, common, {target: 0})
    if target in broadcast_targets(catalog, {target: common}) if spread is None else not spread:
        return _looked_up(rows, F.broadcast(keys), common, "left_anti").select("row.*")
    orphans = _looked_up(rows.select("key", "target").distinct(), keys, common, "left_anti").selectExpr("key AS orphan")
    if _bounded(common) and orphans.limit(FEW_ORPHANS + 1).count() <= FEW_ORPHANS:
        return rows.join(F.broadcast(orphans), F.col("key") == F.col("orphan"), "left_semi").select("row.*")
    return _dealt_orphans(frm, rows, orphans).select("row.*")


def _bounded(common: T.DataType | None) -> bool:
    """Whether a key of this kind is of bounded length."""
    return common is None or isinstance(common, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)) or (isinstance(common, T.StringType) and not S.keeps_own_equality(common))


def _dealt_orphans(frm: Relation, rows: DataFrame, orphans: DataFrame) -> DataFrame:
    """
    The rows of very many orphan values, dealt by value.

    The few values that each hold a share of 1 / HOT_SHARE of the rows are counted first; there are at most HOT_SHARE of
    them, so which of them are orphans is broadcast and their rows are spread over all partitions. Of the other values
    none is large.
    """
    n = rows.agg(F.count(F.lit(1))).scalar()
    hot = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE >= n)
    answer = hot.join(orphans, F.col("key") == F.col("orphan"), "left").selectExpr("key AS hot", "orphan IS NOT NULL AS lost")
    known = rows.join(F.broadcast(answer), F.col("key") == F.col("hot"), "left").where("coalesce(lost, true)")
    spread = F.pmod(F.xxhash64(*[F.col("row").getField(c) for c in frm.struct.names if _hashable(frm.type_of(c))]), F.lit(HOT_SPREAD))
    placed = known.withColumns({
        "at": F.when(F.col("hot").isNull(), F.lit(0).cast("bigint")).otherwise(spread),
        "cold": F.when(F.col("hot").isNull(), F.col("key")),
    })
    # Always 0, but not a constant: the planner would drop a constant from the keys the rows are partitioned by.
    found = orphans.selectExpr("orphan", "pmod(xxhash64(orphan), 1L) AS place")
    return placed.join(found, F.expr("cold = orphan AND at = place"), "left").where("hot IS NOT NULL OR orphan IS NOT NULL")


def _hashable(dt: T.DataType) -> bool:
    return "map<" not in dt.simpleString() and not isinstance(dt, T.VariantType)


def _may_condition(settings: Settings) -> str:
    """Which rows of a profile are columns that conditions may name."""
    return f"visible AND distinct <= {settings.categorical_max_distinct} AND max_length <= {settings.categorical_max_value_length}"


BRANCHES = "branch string, to_table string, total bigint, nulls bigint, hits bigint, orphans bigint, hit double, orphans_above bigint, orphans_below bigint"


def join_hit_rate_by_branch(
    catalog: Catalog, r: Relationship, discriminator: str, settings: Settings | None = None, targets: Mapping[str, Target] | None = None
) -> DataFrame:
    """
    A join's numbers for every value of a discriminator in one plan, the values as text: a polymorphic reference.

    Without ``targets`` all branches go to the claim's target. With them each branch named there goes to its own (table,
    column), and others are not told. Equal values of a branch are counted first, from one read of the from-table; the
    targets of all branches are one relation of keys for each kind of comparison. Orphans are placed as for any join.

    For a visible categorical column alone, whose few values multiply the distinct keys and not the rows. Of any other
    column no value may be told, so there are no rows.
    """
    settings = settings or Settings()
    scan = Scan.of(catalog, settings, [r.from_table])
    frm = catalog[r.from_table]
    if table_profile(catalog, settings, [(r.from_table, discriminator)], scan).where(_may_condition(settings)).isEmpty():
        return small_table(catalog.spark, [], BRANCHES)
    branch = as_text(cell(discriminator), frm.type_of(discriminator)).alias("branch")
    named = targets or {None: (r.to_table, r.to_column)}
    claims = {b: replace(r, to_table=t, to_column=c) for b, (t, c) in named.items()}
    ends = _ends(catalog, [(0, claim) for claim in claims.values()])
    kinds: dict[T.DataType | None, list[tuple[str | None, Relationship]]] = {}
    for b, claim in claims.items():
        kinds.setdefault(comparison(catalog, claim), []).append((b, claim))
    frames = []
    for common, some in kinds.items():
        numbers = {t: n for n, t in enumerate(dict.fromkeys((c.to_table, c.to_column) for _, c in some))}
        rows = [(b, numbers[c.to_table, c.to_column], c.to_table, (c.to_table, c.to_column) in ends, *ends.get((c.to_table, c.to_column), (None, None))) for b, c in some]
        asked = small_table(catalog.spark, rows, "of string, target int, to_table string, placed boolean, low bigint, high bigint")
        source = scan(frm).select(branch, _key(frm, r.from_column, common).alias("key")).groupBy("branch", "key").agg(F.count(F.lit(1)).alias("n"))
        here = source.join(F.broadcast(asked), F.col("branch") == F.col("of") if targets else F.lit(True))
        met = _looked_up(here, _keys_of(catalog, common, numbers), common).withColumn("claim", F.struct("branch", "to_table", F.col("placed").alias("sided")))
        frames.append(_as_counts(met, common))
    counted = _union(frames).groupBy("claim.branch", "claim.to_table", "claim.sided").agg(
        F.expr("sum(if(present, n, 0)) AS total"), F.expr("sum(if(present, 0, n)) AS nulls"), F.expr("sum(if(hit, n, 0)) AS hits"),
        F.expr("if(sided, sum(above), null) AS orphans_above"), F.expr("if(sided, sum(below), null) AS orphans_below"),
    )
    return counted.selectExpr("branch", "to_table", *_NUMBERS)


# ---- a table of claims ----


def _unknown(catalog: Catalog, r: Relationship) -> str | None:
    """Why a claim cannot be planned: a name the catalog does not have, or a relation that could not be opened."""
    for table, columns in ((r.from_table, [r.from_column]), (r.to_table, [r.to_column])):
        if catalog.find(table) is None:
            return f"unknown table {table}"
    for table, column in ((r.from_table, r.from_column), (r.to_table, r.to_column), (r.from_table, r.when_column)):
        if column is not None and not catalog.find(table).has(column) and catalog.find(table).unread is None:
            return f"unknown column {table}.{column}"
    return None


def _unread(catalog: Catalog, r: Relationship) -> str | None:
    return catalog[r.from_table].unread or catalog[r.to_table].unread


def measure_relationships(catalog: Catalog, claims: list[Relationship], settings: Settings, conditions: bool = True, spread: bool | None = None) -> DataFrame:
    """
    A measurement per claim, in the order given, in one lazy plan; what is found beforehand are the extents of the relations,
    from the footers of their files.

    ``conditions`` off leaves every conditioned claim unverifiable. ``spread`` forces one way of joining on all targets.
    """
    spark = catalog.spark
    named = [(i, _spelled(catalog, r)) for i, r in enumerate(claims)]
    reasons = {i: _unknown(catalog, r) or _unread(catalog, r) for i, r in named}
    known = [(i, r) for i, r in named if reasons[i] is None]
    filled = [(i, r) for i, r in known if catalog[r.from_table].populated and catalog[r.to_table].populated]
    run = [(i, r) for i, r in filled if conditions or r.when_column is None]
    scan = Scan.of(catalog, settings, [r.from_table for _, r in run])
    worth = {i for i, r in run if _worth_weighing(catalog, r)}
    dense = dense_keys(catalog, settings) if worth else None

    # All extents that this plan asks for, in one job.
    columns = _words(catalog, {(r.to_table, r.to_column) for _, r in run})
    sized = extents(catalog, {t: columns.get(t, ()) for _, r in known for t in (r.from_table, r.to_table)})
    # Rows of a view need no count of their own where a claim is measured on all of them.
    told = {i for i, r in run if r.when_column is None and not scan.is_sampled(catalog[r.from_table])}
    asked_of = [r.to_table for _, r in known] + [r.from_table for i, r in known if i not in told]
    counted = sorted({t for t in asked_of if catalog[t].df is not None and t not in sized})

    rows = []
    for i, r in named:
        never = [reasons[i] is None and not catalog[t].populated for t in (r.from_table, r.to_table)]
        have = [sized[t].rows if t in sized else None for t in (r.from_table, r.to_table)]
        rows.append((i, r.claim_id, r.from_table, r.to_table, r.from_column, r.when_column, reasons[i], *never, i in worth, *have))
    asked = small_table(
        spark, rows,
        "position int, claim_id string, from_table string, to_table string, from_column string, when_column string, reason string,"
        " never_from boolean, never_to boolean, worth boolean, known_from bigint, known_to bigint",
    )
    if run:
        counts = _counts(scan, run, spread).selectExpr("claim", *_NUMBERS, "lo", "hi")
        asked = asked.join(F.broadcast(counts), F.col("position") == F.col("claim"), "left")
    else:
        asked = asked.selectExpr("*", *[f"cast(null AS bigint) AS {c}" for c in ("claim", "total", "nulls", "hits", "orphans", "orphans_above", "orphans_below", "lo", "hi")], "cast(null AS double) AS hit")
    if counted:
        sizes = row_counts(catalog, counted)
        for side in ("from", "to"):
            asked = asked.join(F.broadcast(sizes.selectExpr(f"table AS {side}_table", f"rows AS counted_{side}")), f"{side}_table", "left")
    else:
        asked = asked.selectExpr("*", "cast(null AS bigint) AS counted_from", "cast(null AS bigint) AS counted_to")
    sampled = [t for t in {r.from_table for _, r in run} if scan.is_sampled(catalog[t])]
    whole = F.col("when_column").isNull() & ~F.col("from_table").isin(*sampled) if sampled else F.col("when_column").isNull()
    joined = asked.withColumns({
        "from_rows": F.coalesce("known_from", "counted_from", F.when(whole, F.col("total") + F.col("nulls"))),
        "to_rows": F.coalesce("known_to", "counted_to"),
    })
    discriminators = {(r.from_table, r.when_column) for _, r in run if r.when_column is not None}
    if discriminators:
        seen = table_profile(catalog, settings, discriminators, scan)
        allowed = seen.selectExpr(
            "table AS from_table", "column AS when_column",
            f"{_may_condition(settings)} AS allowed",
        )
        joined = joined.join(F.broadcast(allowed), ["from_table", "when_column"], "left")
    else:
        joined = joined.withColumn("allowed", F.lit(False))

    free = "(when_column IS NULL OR coalesce(allowed, false))"
    no_rows = "(coalesce(from_rows = 0, false) OR coalesce(to_rows = 0, false))"
    numbers = ("total", "nulls", "hits", "orphans", "hit", "orphans_above", "orphans_below")
    measured = joined.selectExpr(
        "claim_id", "position", "'relationship' AS kind", "from_table", "from_column", "to_table", "lo", "hi", "worth",
        *[f"if(reason IS NULL AND {free} AND NOT {no_rows}, {c}, null) AS {c}" for c in numbers],
        f"""CASE WHEN reason IS NOT NULL THEN reason
                 WHEN never_from THEN '{S.NEVER_REFRESHED}'
                 WHEN from_rows = 0 THEN '{S.NO_SOURCE_ROWS}'
                 WHEN never_to THEN '{S.NEVER_REFRESHED}'
                 WHEN to_rows = 0 THEN '{S.NO_TARGET_ROWS}'
                 WHEN NOT {free} THEN concat(from_table, '.', when_column, ' is not categorical, so no condition on it is measured')
                 WHEN total = 0 THEN '{S.NO_SOURCE_ROWS}' END AS skipped""",
        f"reason IS NULL AND (never_from OR never_to OR {no_rows} OR ({free} AND coalesce(total = 0, false))) AS empty",
    )
    if dense is not None:
        weighed = weak_evidence(measured, dense)
        judged = f"worth AND skipped IS NULL AND hit >= {settings.join_confirmed}D"
        weights = [f"if({judged}, {c}, null) AS {c}" for c in ("candidates", "also_fits")]
    else:
        weighed, weights = measured, ["cast(null AS bigint) AS candidates", "cast(null AS bigint) AS also_fits"]
    known_columns = ("claim_id", "position", "kind", *numbers, "skipped", "empty")
    complete = weighed.selectExpr(*known_columns, *weights)
    return complete.selectExpr(*[c if c in known_columns or c in ("candidates", "also_fits") else f"cast(null AS {t}) AS {c}" for c, t in S.MEASUREMENT_TYPES.items()])


def _worth_weighing(catalog: Catalog, r: Relationship) -> bool:
    """Whether integers of another range would tell: not for a claim that a key or its author vouches for."""
    vouched = r.basis != "inferred" or (r.from_table, r.from_column, r.to_table, r.to_column) in catalog.foreign
    return not vouched and catalog[r.from_table].is_integer(r.from_column)


def _spelled(catalog: Catalog, r: Relationship) -> Relationship:
    """The claim with its tables spelled as the catalog spells them; a name it does not have stays as it is."""
    frm, to = catalog.find(r.from_table), catalog.find(r.to_table)
    return Relationship(frm.name if frm else r.from_table, r.from_column, to.name if to else r.to_table, *[getattr(r, f) for f in ("to_column", "when_column", "when_equals", "basis", "confidence", "reason")])


# ---- weighing ----


def dense_keys(catalog: Catalog, settings: Settings) -> DataFrame:
    """
    Integer single-column keys whose rows fill enough of their range, as (position, table, column, rows, lo, hi).

    Every key that holds rows is judged, or the first ``weak_evidence_max_candidates`` in catalog order where that is set.
    Counts and ends of Parquet relations come from the footers, when the plan is made; of others from one scan then.
    """
    keys = [
        (i, r.name, catalog.primary[r.name][0])
        for i, r in enumerate(catalog.relations)
        if r.df is not None and len(catalog.primary.get(r.name, ())) == 1 and r.has(catalog.primary[r.name][0]) and r.is_integer(catalog.primary[r.name][0])
    ]
    out = "position int, table string, column string, rows bigint, lo bigint, hi bigint"
    if not keys or settings.weak_evidence_max_candidates == 0:
        return small_table(catalog.spark, [], out)
    found = extents(catalog, {table: [column] for _, table, column in keys}, views=True)
    held = [(i, table, column, found[table].rows, *found[table].ends[column]) for i, table, column in keys if found[table].ends[column][0] is not None]
    judged = held[: settings.weak_evidence_max_candidates]
    return small_table(catalog.spark, [k for k in judged if k[3] >= settings.dense_key_share * (k[5] - k[4] + 1)], out)


def weak_evidence(measured: DataFrame, dense: DataFrame) -> DataFrame:
    """
    Adds two numbers to rows with (from_table, from_column, to_table, lo, hi): with how many dense keys each was compared,
    and how many of those have lo and hi within their range. Both are null where no key was there to compare.

    The keys, at most one per table, reach every row as one array, so ranges are compared without a join.
    """
    fields = "struct(table AS t, column AS c, lo AS lo, hi AS hi)"
    keys = dense.selectExpr(f"{fields} AS k").agg(F.collect_list("k")).scalar()
    other = "k.t <> to_table AND NOT (k.t = from_table AND k.c = from_column)"
    compared = measured.withColumn("__keys", keys).selectExpr("*", f"filter(__keys, k -> {other}) AS __others")
    return compared.selectExpr(
        "*",
        "cast(nullif(size(__others), 0) AS bigint) AS candidates",
        "if(size(__others) > 0, cast(size(filter(__others, k -> k.lo <= lo AND k.hi >= hi)) AS bigint), null) AS also_fits",
    ).drop("__keys", "__others")
