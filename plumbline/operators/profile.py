"""Column profiles: null rate, distinct values, longest value, years, and which columns may be shown."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schema as S
from plumbline.functions.rules import is_categorical
from plumbline.functions.values import RAW_TEXT_CHARS, WORD, as_text, bit_of, cell, compact, compact_length, word_of
from plumbline.operators.sampling import Scan, row_hash, row_place
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog, Relation, _union
from plumbline.sources.sizes import bytes_setting, estimated_bytes, from_files, is_bare_scan
from plumbline.sources.small import small_table

# A file scan below this size is read in one go whatever the number of cores.
SPLIT_FROM_BYTES = 1 << 20

COLUMNS_LISTED = S.fields(
    "cid int, table string, ordinal int, column string, type string, nullable boolean, family string, shown boolean, unmeasured string"
)


def null_rate(non_null: Column, rows: Column) -> Column:
    return F.when(rows == 0, 0.0).otherwise(1 - non_null / rows)


def _cells(scan: Scan, relation: Relation, columns: list[tuple[int, str]], told: bool) -> list[DataFrame]:
    """
    The cells of a relation's columns before the shuffle, as (cid, l, d, v, bit, y): the column, the value and its year.

    An integer is a ``bit`` of its word ``l``, so that close integers are one record for each WORD of them. A double travels
    as ``d`` and anything else as text ``v``, a long text as its stand-in unless the values are ``told``, so that numbers
    are turned into text once per distinct value and not once per row. A large table is read once for all columns; one too
    small to fill the cluster with a task per split is read by column, each column's bytes still once. A column whose
    collation decides equality is always read by itself.
    """
    df = scan(relation)
    no_long, no_double, no_text = (F.lit(None).cast(t) for t in ("bigint", "double", "string"))

    def one(cid: int, name: str) -> list[Column]:
        dt, c = relation.type_of(name), cell(name)
        year = F.year(c) if S.family(dt) == S.TIME else F.lit(None).cast("int")
        if S.is_integer(dt):
            value = word_of(c.cast("bigint")), no_double, no_text, bit_of(c.cast("bigint"))
        elif isinstance(dt, T.DoubleType):
            # Grouping takes -0.0 for 0.0, which read differently.
            value = F.when(c == 0, F.when(c.cast("string") == "-0.0", F.lit(1).cast("bigint"))), c, no_text, no_long
        else:
            text = as_text(c, dt)
            value = no_long, no_double, text if told or S.keeps_own_equality(dt) else compact(text), no_long
        return [x.alias(a) for x, a in zip((F.lit(cid), *value, year), ("cid", "l", "d", "v", "bit", "y"), strict=True)]

    plain = [one(cid, c) for cid, c in columns if not S.keeps_own_equality(relation.type_of(c))]
    own = [one(cid, c) for cid, c in columns if S.keeps_own_equality(relation.type_of(c))]
    if len(plain) > 1 and _worth_splitting(df):
        frames = [df.select(*p) for p in plain]
    else:
        frames = [df.select(F.inline(F.array(*[F.struct(*p) for p in plain])))] if plain else []
    return frames + [_counted(df.select(*p)).withColumn("v", F.col("v").cast("string")) for p in own]


def _worth_splitting(df: DataFrame) -> bool:
    """Whether a scan is more than a moment's work and yet has fewer splits than the cluster has cores."""
    size = estimated_bytes(df)
    if size is None or not is_bare_scan(df):  # a view would be computed once for each column
        return False
    spark = df.sparkSession
    full = bytes_setting(spark, "spark.sql.files.maxPartitionBytes") * spark.sparkContext.defaultParallelism
    return SPLIT_FROM_BYTES <= size < full


def _counted(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cid", "l", "d", "v").agg(F.count(F.lit(1)).alias("n"), F.bit_or("bit").alias("bits"), F.max("y").alias("y"))


def _distinct_values(scan: Scan, wanted: dict[str, list[tuple[int, str]]], told: bool = False) -> DataFrame:
    """
    (cid, v, length, word, bits, n, y) of every wanted column of every table, in one shuffle: repeated values collapse before it.

    An integer column has a row for each word of its values, or one without for its nulls, and ``v`` null. Of others ``v`` is
    the value itself where values are ``told``, else a stand-in of a long text, which only counts may come from.
    """
    raw, grouped = [], []
    for table, columns in wanted.items():
        for frame in _cells(scan, scan.catalog[table], columns, told):
            (grouped if "n" in frame.columns else raw).append(frame)
    number = F.expr("if(l IS NULL, cast(d AS string), if(d IS NULL, null, '-0.0'))")

    def read(groups: DataFrame, length) -> DataFrame:
        text = F.coalesce("v", number)
        return groups.select("cid", text.alias("v"), length(text).alias("length"), F.when(F.col("bits").isNotNull(), F.col("l")).alias("word"), "bits", "n", "y")

    frames = [read(_counted(_union(raw)), F.char_length if told else compact_length)] if raw else []
    return _union(frames + [read(groups, F.char_length) for groups in grouped])


def _ends_of_word(word: Column, bits: Column) -> list[Column]:
    """The lowest and the highest integer whose bit is set."""
    digits = F.bin(bits)
    first = F.length(digits) - F.length(F.rtrim(digits, F.lit("0")))
    return [F.shiftleft(word, WORD.bit_length() - 1) + at for at in (first, F.length(digits) - 1)]


def _profile(counted: DataFrame) -> DataFrame:
    """(cid, rows, non_null, distinct, max_length, year_min, year_max) from distinct values. Of integers close to each other the longest is the
    lowest or the highest."""
    held = F.col("v").isNotNull() | F.col("bits").isNotNull()
    longest = F.greatest(*[F.length(end.cast("string")) for end in _ends_of_word(F.col("word"), F.col("bits"))])
    return counted.groupBy("cid").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(held, F.col("n"))).alias("non_null"),
        F.coalesce(F.sum(F.coalesce(F.bit_count("bits"), F.when(held, 1))), F.lit(0)).cast("bigint").alias("distinct"),
        F.max(F.coalesce(longest, F.col("length"))).alias("max_length"),
        F.min("y").alias("year_min"),
        F.max("y").alias("year_max"),
    )


def _lists(counted: DataFrame, cids: DataFrame) -> DataFrame:
    """(cid, values): all values of the columns named by number, sorted. Each has as many as a categorical column may."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda at: F.getbit("bits", at) == 1)
    whole = F.transform(places, lambda at: (F.shiftleft("word", WORD.bit_length() - 1) + at).cast("string"))
    values = F.when(F.col("bits").isNotNull(), whole).when(F.col("v").isNotNull(), F.array("v"))
    # True of every group. It needs the columns that the profile needs, so that both read one exchange.
    counted = counted.where("n > 0 AND coalesce(y, 0) < 1000000000")
    return counted.join(F.broadcast(cids), "cid", "left_semi").select("cid", F.explode(values).alias("v")).groupBy("cid").agg(F.sort_array(F.collect_list("v")).alias("values"))


def _listed(catalog: Catalog, only: set[tuple[str, str]] | None) -> list[tuple]:
    """One row per wanted column, numbered; the columns of a relation that cannot be read say why."""
    rows = []
    for r in catalog.relations:
        why = r.unread or (None if r.populated else S.NEVER_REFRESHED)
        for ordinal, f in enumerate(r.struct.fields):
            if only is None or (r.name, f.name) in only:
                shown = catalog.shown_regardless(r, f.name)
                rows.append((len(rows), r.name, ordinal, f.name, f.dataType.simpleString(), f.nullable, S.family(f.dataType), shown, why))
    return rows


def table_profile(
    catalog: Catalog, settings: Settings, only: Iterable[tuple[str, str]] | None = None, scan: Scan | None = None, values: bool = False
) -> DataFrame:
    """
    One row per column of every relation, or of the (table, column) pairs asked for; with ``values`` also all values of each
    categorical column, as text and sorted.

    Every relation is scanned once and all columns are counted in one two-level aggregation: equal values of a column
    meet in one group, and the groups are then counted. A value that fills a third of a table is one group of one
    partial row per task. The values come from the same groups, of the few columns that the counts say are categorical.
    """
    scan = scan or Scan.of(catalog, settings)
    rows = _listed(catalog, None if only is None else set(only))
    listed = small_table(catalog.spark, rows, COLUMNS_LISTED)
    wanted: dict[str, list[tuple[int, str]]] = {}
    for cid, table, _, column, *_, unmeasured in rows:
        if unmeasured is None:
            wanted.setdefault(table, []).append((cid, column))
    if wanted:
        groups = _distinct_values(scan, wanted, told=values and settings.categorical_max_value_length > RAW_TEXT_CHARS)
        counted = _profile(groups)
    else:
        counted = small_table(catalog.spark, [], "cid int, rows bigint, non_null bigint, distinct bigint, max_length int, year_min int, year_max int")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("rows", "non_null", "distinct", "max_length")}
    categorical = is_categorical(zero["distinct"], zero["non_null"], zero["max_length"], settings)
    joined = listed.join(F.broadcast(counted), "cid", "left").withColumns({**zero, "categorical": categorical})
    if values:
        # Again what the profile needs, and true of every column.
        whole = joined.where("categorical AND rows >= non_null AND coalesce(year_min, 0) <= coalesce(year_max, 0)")
        lists = _lists(groups, whole.select("cid")) if wanted else small_table(catalog.spark, [], "cid int, values array<string>")
        joined = joined.join(F.broadcast(lists), "cid", "left")
    visible = F.col("categorical") | F.col("shown")
    return joined.withColumn("visible", visible).select(
        "table", "ordinal", "column", "type", "nullable", "family", "rows", "non_null",
        null_rate(F.col("non_null"), F.col("rows")).alias("null_rate"),
        "distinct", "max_length", "categorical", "visible",
        F.when(~F.col("visible"), F.col("year_min")).alias("year_min"),
        F.when(~F.col("visible"), F.col("year_max")).alias("year_max"),
        "unmeasured", *(["values"] if values else []),
    )


def describe_table(catalog: Catalog, table: str, settings: Settings) -> DataFrame:
    """
    A row per column of one table, with what may be told of it: the table's kind, size and keys, the column's type, nulls,
    distinct values, and the values of a categorical one. No longest value, no years, and no value of any other column.
    """
    some = catalog.only([table])
    scan = Scan.of(some, settings)
    profile = table_profile(some, settings, scan=scan, values=True)
    sizes = scan.sizes_told()
    facts = some.relations_df().select("name", "kind", "populated", "partitions").join(sizes.withColumnRenamed("table", "name"), "name", "left")
    foreign = ", ".join(f"{c} -> {rt}.{rc}" for t, c, rt, rc in sorted(catalog.foreign) if t == table)
    facts = facts.select("kind", "populated", "partitions", F.col("rows").alias("row_estimate"), F.col("source").alias("estimate_source"))
    columns = profile.drop("rows", "non_null", "family", "max_length", "categorical", "visible", "year_min", "year_max", "table")
    measured = F.col("unmeasured").isNull()
    told = columns.withColumns({c: F.when(measured, F.col(c)) for c in ("null_rate", "distinct")})
    keys = {"primary_key": ", ".join(catalog.primary.get(table, ())), "foreign_keys": foreign}
    placed = told.withColumn("table", F.lit(table)).join(F.broadcast(facts.withColumn("table", F.lit(table))), "table")
    return placed.select(
        "table", *facts.columns, *[F.lit(v).alias(k) for k, v in keys.items()], "ordinal", "column", "type", "nullable", "null_rate", "distinct", "values", "unmeasured"
    )


def listed_columns(profile: DataFrame, flag: str) -> list[tuple[str, str]]:
    """
    The (table, column) pairs a profile flags: one row per column of the schema, never of the data.

    They decide which columns later operators may read at all, so they are fetched before those are planned.
    """
    return [(r["table"], r["column"]) for r in profile.where(flag).select("table", "ordinal", "column").orderBy("table", "ordinal").collect()]


def value_lists(catalog: Catalog, settings: Settings, columns: list[tuple[str, str]], scan: Scan | None = None) -> DataFrame:
    """
    All distinct values of categorical columns, sorted. Only these columns are read.

    ``columns`` is what ``listed_columns(profile, "categorical")`` gives, so a list holds at most
    ``categorical_max_distinct`` values of at most ``categorical_max_value_length`` characters.
    """
    scan = scan or Scan.of(catalog, settings)
    if not columns:
        return small_table(catalog.spark, [], "table string, column string, values array<string>")
    wanted: dict[str, list[tuple[int, str]]] = {}
    for cid, (table, column) in enumerate(columns):
        wanted.setdefault(table, []).append((cid, column))
    listed = small_table(catalog.spark, [(i, t, c) for i, (t, c) in enumerate(columns)], "cid int, table string, column string")
    lists = _lists(_distinct_values(scan, wanted, told=True), listed.select("cid"))
    return lists.join(F.broadcast(listed), "cid").select("table", "column", "values")


def redacted_sample(catalog: Catalog, table: str, settings: Settings, visible: set[str], scan: Scan | None = None) -> DataFrame:
    """
    A few rows of a table as text, the same ones every time; a hidden column reads ``[hidden]`` and is never scanned.

    Of files the rows are picked by their place, so no column is read but of the files that hold the few rows shown.
    Rows from elsewhere are picked by what they show.
    """
    scan = scan or Scan.of(catalog, settings)
    relation = catalog[table]
    shown = [c for c in relation.struct.names if c in visible]
    df, place = scan(relation), row_place(scan(relation))
    texts = [as_text(cell(c), relation.type_of(c)).alias(c) for c in shown]
    if place is None:
        order = row_hash([F.coalesce(cell(c), F.lit("\x00")) for c in shown], settings.sample_seed)
        few = df.select(*texts).orderBy(order, *[cell(c) for c in shown]).limit(settings.sample_rows_shown)
    else:
        few = df.where(_at(_picked(df, settings))).select(*texts)
    return few.select(*[cell(c) if c in visible else F.lit(S.HIDDEN).alias(c) for c in relation.struct.names])


def _picked(df: DataFrame, settings: Settings) -> DataFrame:
    """(file, row) of the rows of lowest hash by their place: as few as are shown."""
    file, row = row_place(df)
    order = row_hash([F.col("_metadata.file_name"), row.cast("string")], settings.sample_seed)
    return df.select(order.alias("h"), file.alias("file"), row.alias("row")).orderBy("h", "file", "row").limit(settings.sample_rows_shown).select("file", "row")


def _at(places: DataFrame) -> Column:
    """Whether a row lies at one of a few places. Files without any are not opened."""
    found = [(r["file"], r["row"]) for r in places.collect()]
    return from_files(sorted({file for file, _ in found})) & F.concat_ws("|", "_metadata.file_path", F.col("_metadata.row_index").cast("string")).isin([f"{file}|{row}" for file, row in found])
