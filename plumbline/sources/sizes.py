"""How many rows a relation holds: counted, summed over its partitions, or estimated from a few of its files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.values import cell
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog, Relation, _union
from plumbline.sources.small import small_table


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate; None where there is no plan to ask, as in a remote session."""
    if not hasattr(df, "_jdf"):
        return None
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def is_bare_scan(df: DataFrame) -> bool:
    """Whether the rows come as they lie in files or memory: only then is the size estimate that of what is read."""
    if not hasattr(df, "_jdf"):
        return False
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "LocalRelation") or plan.nodeName().startswith("Relation")


def bytes_setting(spark: SparkSession, name: str) -> int:
    """A session setting such as 10MB, in bytes; below 0 where it is switched off."""
    value = spark.conf.get(name)
    if value.startswith("-"):
        return -1
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


@dataclass(frozen=True)
class Extent:
    """How many rows a relation has, and the lowest and highest value of the integer columns asked for (None where all are null)."""

    rows: int
    ends: dict[str, tuple[int | None, int | None]] = field(default_factory=dict)


# Reads Parquet through the reader that answers counts and extremes from the footers.
_FROM_FOOTERS = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def extent_rows(wanted: list[tuple[Relation, list[str]]], footers: bool) -> DataFrame:
    """
    (i, rows, ends) of numbered relations, ``ends`` an array of (lo, hi), one for each of its integer columns.

    From footers no column is read: the counts and extremes are those the files keep of each row group. Otherwise one
    row per task and relation is shuffled.
    """
    if footers:
        side = wanted[0][0].df.sparkSession.newSession()
        for name, value in _FROM_FOOTERS.items():
            side.conf.set(name, value)
    frames = []
    for i, (r, columns) in enumerate(wanted):
        df = side.read.schema(r.df.schema).parquet(r.files) if footers else r.df
        ends = [F.struct(F.min(cell(c)).cast("bigint").alias("lo"), F.max(cell(c)).cast("bigint").alias("hi")) for c in columns]
        none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")
        frames.append(df.agg(F.count(F.lit(1)).alias("rows"), (F.array(*ends) if ends else none).alias("ends")).select(F.lit(i).alias("i"), "rows", "ends"))
    return _union(frames)


def extents(catalog: Catalog, wanted: dict[str, Iterable[str]], views: bool = False) -> dict[str, Extent]:
    """
    The extent of named relations with the integer columns asked for, found once per catalog.

    Of plain Parquet relations it comes from the footers, in one job for all that are not known yet. Others are left out
    unless ``views`` asks for them to be scanned. A row of a few numbers per relation is all that reaches the driver.
    """
    known = catalog.extents
    asked = []
    for name, columns in wanted.items():
        r, have = catalog[name], known.get(name)
        if r.df is not None and (r.files is not None or views) and (have is None or not set(columns) <= have.ends.keys()):
            asked.append((r, sorted({*columns, *(have.ends if have else ())})))
    for footers in (True, False):
        some = [(r, columns) for r, columns in asked if (r.files is not None) == footers]
        if some:
            for (r, columns), row in zip(some, _extents_of(some, footers), strict=True):
                # Of files without a row group the pushed count is null.
                known[r.name] = Extent(row["rows"] or 0, {c: (e["lo"], e["hi"]) for c, e in zip(columns, row["ends"], strict=True)})
    return {name: known[name] for name in wanted if name in known}


def _extents_of(some: list[tuple[Relation, list[str]]], footers: bool) -> list:
    try:
        return sorted(extent_rows(some, footers).collect())
    except Exception:  # files written without statistics
        if not footers:
            raise
        return sorted(extent_rows(some, False).collect())


def row_counts(catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """
    Exact rows per relation that can be read, an empty one included.

    No column is read, so a Parquet count comes from the footers. Each relation is counted where its scan runs; one row
    each crosses the single shuffle.
    """
    wanted = [r for r in catalog.relations if r.df is not None and (names is None or r.name in names)]
    listed = small_table(catalog.spark, [(r.name,) for r in wanted], "table string")
    if not wanted:
        return listed.withColumn("rows", F.lit(0).cast("bigint"))
    counted = _union([r.df.select(F.lit(r.name).alias("table")) for r in wanted]).groupBy("table").agg(F.count(F.lit(1)).alias("rows"))
    return listed.join(F.broadcast(counted), "table", "left").select("table", F.coalesce("rows", F.lit(0)).alias("rows"))


def partition_estimate(parts: DataFrame) -> DataFrame:
    """
    Rows per table from its partitions' (table, rows, bytes), ``rows`` null where unknown.

    All known: their sum. Some known: the rest at the known rows per byte. None known: no estimate (-1), and a pilot
    decides.
    """
    known = F.col("rows").isNotNull()
    agg = parts.groupBy("table").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(known).alias("n_known"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("known_rows"),
        F.coalesce(F.sum(F.when(known, F.col("bytes"))), F.lit(0)).alias("known_bytes"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("all_bytes"),
    )
    all_known = F.col("n") == F.col("n_known")
    rate = F.col("known_rows") / F.nullif("known_bytes", F.lit(0))
    scaled = F.round(F.col("known_rows") + (F.col("all_bytes") - F.col("known_bytes")) * rate).cast("bigint")
    rows = F.when(all_known, F.col("known_rows")).when(F.col("known_bytes") > 0, scaled).otherwise(F.lit(-1))
    return agg.select("table", rows.cast("bigint").alias("rows"), F.when(rows >= 0, "partitions").alias("source"))


def _files(relation: Relation) -> DataFrame:
    """(path, bytes, part) of a relation's data files, listed and not opened; ``part`` is the folder of a partition, or the file itself."""
    spark = relation.df.sparkSession
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(relation.files)
    path = F.col("_metadata.file_path")
    return listing.select(path.alias("path"), F.col("_metadata.file_size").alias("bytes"), _part(relation, path).alias("part"))


def _part(relation: Relation, path: Column) -> Column:
    return F.substring_index(path, "/", -1) if not relation.partition_columns else F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _seeded(name: str, settings: Settings) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(settings.sample_seed)), name))


def parts_of(relation: Relation, settings: Settings) -> DataFrame:
    """
    (table, rows, bytes) of each part of a Parquet relation: a partition, or a file of one that has none.

    ``rows`` is known of a seeded pick of at most ``pilot_files`` parts, which are counted without reading a column, and
    null of the others, which are listed alone. The picked parts' names, so many at most, reach the driver.
    """
    files = _files(relation)
    parts = files.groupBy("part").agg(F.sum("bytes").alias("bytes"))
    picked = [r["part"] for r in parts.orderBy(_seeded("part", settings), "part").limit(settings.pilot_files).collect()]
    at = _part(relation, F.col("_metadata.file_path"))
    known = relation.df.where(at.isin(picked)).groupBy(at.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    rows = F.when(F.col("part").isin(picked), F.coalesce("rows", F.lit(0)))
    return parts.join(known, "part", "left").select(F.lit(relation.name).alias("table"), rows.alias("rows"), "bytes")


def pilot_files(relation: Relation, settings: Settings) -> tuple[list[str], int, int, int]:
    """
    A seeded pick of at most ``pilot_files`` of a relation's data files: (paths, their bytes, all bytes, all files).

    The files are listed, not opened. Only the picked paths and two totals reach the driver.
    """
    listing = _files(relation)
    picked = listing.orderBy(_seeded("path", settings), "path").limit(settings.pilot_files).collect()
    totals = listing.agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files")).first()
    return [r["path"] for r in picked], sum(r["bytes"] for r in picked), totals["bytes"] or 0, totals["files"]


def from_files(paths: list[str]) -> Column:
    """Rows of these files alone: a filter on the file, so Spark never opens the others."""
    return F.col("_metadata.file_path").isin(paths)


def pilot_row_estimate(relation: Relation, settings: Settings) -> DataFrame:
    """One row (table, rows, source): the rows of the picked files, scaled by bytes to all files; a count without files."""
    if relation.files is None:
        return relation.df.agg(F.lit(relation.name).alias("table"), F.count(F.lit(1)).alias("rows"), F.lit("catalog").alias("source"))
    paths, read_bytes, all_bytes, _ = pilot_files(relation, settings)
    scale = all_bytes / read_bytes if read_bytes else 0.0
    rows = F.round(F.count(F.lit(1)) * F.lit(scale)).cast("bigint")
    return relation.df.where(from_files(paths)).agg(
        F.lit(relation.name).alias("table"), rows.alias("rows"), F.lit("pilot").alias("source")
    )


def row_estimate(relation: Relation, settings: Settings) -> DataFrame:
    """One row (table, rows, source): of a partitioned dataset by its partitions, else by a pilot."""
    if relation.files is not None and relation.partition_columns:
        return partition_estimate(parts_of(relation, settings))
    return pilot_row_estimate(relation, settings)


def sizes(catalog: Catalog, settings: Settings, names: list[str] | None = None) -> dict[str, int]:
    """Rows per relation as sampling needs them at plan time: one number per table, estimated where files allow, -1 if unknown."""
    wanted = [r for r in catalog.relations if r.df is not None and (names is None or r.name in names)]
    if not wanted:
        return {}
    return {r["table"]: r["rows"] for r in _union([row_estimate(r, settings) for r in wanted]).collect()}
