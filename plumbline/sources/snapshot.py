"""A run kept for later: its settings, schema, claims and verdicts. No time of writing and no cell value is in it."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schema as S
from plumbline.settings import MEASURED_WITH, RANGES
from plumbline.sources.small import small_table

# Raised whenever a reader of an older format would misread a snapshot.
FORMAT = 1

_ID = T.StructField("claim_id", T.StringType())
PARTS = {
    "meta": S.fields("format int, fingerprint string"),
    "settings": S.fields("name string, value double"),
    "relations": S.RELATIONS,
    "columns": S.COLUMNS,
    "keys": S.KEYS,
    "relationships": T.StructType([_ID, *S.RELATIONSHIPS.fields]),
    "suspicions": T.StructType([_ID, *S.SUSPICIONS.fields]),
    "verdicts": S.fields(
        "claim_id string, kind string, over string, status string, skipped string, numbers map<string:double>"
    ),
}
_ORDER = {
    "meta": ["format"], "settings": ["name"], "relations": ["name"], "columns": ["table", "ordinal"],
    "keys": ["table", "kind", "ordinal", "column"], "relationships": ["claim_id"], "suspicions": ["claim_id"], "verdicts": ["claim_id"],
}


@dataclass(frozen=True)
class Snapshot:
    settings: DataFrame
    relations: DataFrame
    columns: DataFrame
    keys: DataFrame
    relationships: DataFrame
    suspicions: DataFrame
    verdicts: DataFrame  # wide, as ``decide`` gives them
    fingerprint: str | None = None


def _told() -> dict[str, str]:
    return {S.NUMBER_NAMES.get(n, n): n for n in S.NUMBERS}


def numbers_map() -> Column:
    """A verdict's numbers as a map of those it has, sorted by name."""
    entries = [F.struct(F.lit(told).alias("key"), F.col(n).cast("double").alias("value")) for told, n in sorted(_told().items())]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def write_snapshot(snapshot: Snapshot, path: str) -> None:
    """One JSON-lines file per part, rows and keys in a fixed order: claims and schema, never rows of a table."""
    spark = snapshot.verdicts.sparkSession
    parts = {
        "meta": small_table(spark, [(FORMAT, snapshot.fingerprint)], PARTS["meta"]),
        "settings": snapshot.settings,
        "relations": snapshot.relations,
        "columns": snapshot.columns,
        "keys": snapshot.keys,
        "relationships": snapshot.relationships,
        "suspicions": snapshot.suspicions,
        "verdicts": snapshot.verdicts.withColumn("numbers", numbers_map()),
    }
    for name, df in parts.items():
        ordered = df.select(*PARTS[name].names).orderBy(*_ORDER[name]).coalesce(1)
        ordered.write.mode("overwrite").json(os.path.join(path, name))


def read_snapshot(spark: SparkSession, path: str) -> Snapshot:
    """The snapshot at a path; raises for a newer format, a row that is not of its schema, or a setting out of range."""

    def part(name: str) -> DataFrame:
        return spark.read.schema(PARTS[name]).option("mode", "FAILFAST").json(os.path.join(path, name))

    meta = part("meta").first()
    if meta is None or meta["format"] is None:
        raise ValueError("not a snapshot: no format")
    if meta["format"] > FORMAT:
        raise ValueError(f"written by a newer version (snapshot format {meta['format']})")
    settings = part("settings")
    wrong = invalid_settings(settings).select("name").orderBy("name").take(1)
    if wrong:
        raise ValueError(f"not a snapshot: setting {wrong[0]['name']} is out of its range")
    # What comes back of an earlier verdict is what a comparison reads: status, reason and numbers.
    verdicts = part("verdicts").select(
        "claim_id", F.lit(None).cast("int").alias("position"), "kind", "over",
        *[F.col("numbers")[told].cast(S.NUMBERS[n]).alias(n) for told, n in _told().items()],
        "skipped", (F.col("status") == "empty").alias("empty"), "status",
    )
    return Snapshot(settings, part("relations"), part("columns"), part("keys"), part("relationships"), part("suspicions"), verdicts, meta["fingerprint"])


def invalid_settings(settings: DataFrame) -> DataFrame:
    """The settings rows outside their ranges, and those whose bounds cross."""
    ok = F.when(F.col("name") == "sampled", F.col("value").isin(0.0, 1.0))
    for name in MEASURED_WITH:
        low, high, whole = RANGES[name]
        fits = (F.col("value") >= F.lit(low)) & (F.col("value") <= F.lit(high)) & ~F.isnan("value")
        ok = ok.when(F.col("name") == name, fits & (F.col("value") == F.floor("value")) if whole else fits)
    outside = settings.where(~F.coalesce(ok.otherwise(True), F.lit(False)))
    bands = settings.groupBy().pivot("name", ["join_broken", "join_confirmed"]).agg(F.max("value"))
    crossed = bands.where("join_broken > join_confirmed").select(F.lit("join_broken").alias("name"), F.col("join_broken").alias("value"))
    return outside.select("name", "value").unionAll(crossed)


def write_table_reports(reports: DataFrame, path: str) -> None:
    """Each relation's findings as text in a directory of its own, ``table=<name>``."""
    reports.select("table", F.col("report").alias("value")).repartition("table").write.mode("overwrite").partitionBy("table").text(path)
