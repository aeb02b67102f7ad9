"""Claims before they are measured: from declared keys, spelled as the catalog spells them, one row per identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# A claim's columns that the catalog's spelling replaces.
_TABLE_COLUMNS = ("from_table", "to_table")


def claims_from_keys(keys: DataFrame) -> DataFrame:
    """Every declared foreign key as a stated claim."""
    return keys.where("kind = 'f'").selectExpr(
        "table AS from_table", "column AS from_column", "ref_table AS to_table", "ref_column AS to_column",
        "cast(null AS string) AS when_column", "cast(null AS string) AS when_equals",
        "'stated' AS basis", "1.0D AS confidence", "'declared foreign key' AS reason",
    )


def claims_from_values(values: DataFrame, from_table: str, from_column: str, to_table: str, to_column: str, confidence: float = 0.5) -> DataFrame:
    """One conditioned claim per value of each listed discriminator (table, column, values) of the from-table."""
    return values.where(F.col("table") == from_table).select(F.explode("values").alias("v"), "column").select(
        F.lit(from_table).alias("from_table"), F.lit(from_column).alias("from_column"),
        F.lit(to_table).alias("to_table"), F.lit(to_column).alias("to_column"),
        F.col("column").alias("when_column"), F.col("v").alias("when_equals"),
        F.lit("inferred").alias("basis"), F.lit(float(confidence)).alias("confidence"), F.lit("one branch per value").alias("reason"),
    )


def resolve_names(names: DataFrame, relations: DataFrame) -> DataFrame:
    """
    (name, resolved) for every distinct ``name``: the relation with that name or schema-qualified name, exactly first, then
    regardless of case; null where there is none. Two equi-joins on the spelling.
    """
    qualified = F.when(F.col("name").startswith(F.concat("schema", F.lit("."))), F.col("name")).otherwise(F.concat_ws(".", "schema", "name"))
    spelled = relations.select("position", F.col("name").alias("resolved"), F.explode(F.array_distinct(F.array("name", qualified))).alias("spelling"))
    asked = names.select("name").distinct().withColumn("wanted", F.trim("name"))
    found = None
    for rank, form in enumerate((lambda c: F.col(c), lambda c: F.lower(c))):
        candidates = spelled.select(form("spelling").alias("key"), "position", "resolved")
        hits = asked.join(candidates, form("wanted") == F.col("key")).select("name", F.lit(rank).alias("rank"), "position", "resolved")
        found = hits if found is None else found.unionAll(hits)
    best = found.groupBy("name").agg(F.min_by("resolved", F.struct("rank", "position")).alias("resolved"))
    return names.select("name").distinct().join(best, "name", "left")


def spell_claims(claims: DataFrame, relations: DataFrame) -> DataFrame:
    """Relationship claims with their tables spelled as the relations are; an unknown name stays as written."""
    names = claims.select(F.explode(F.array(*_TABLE_COLUMNS)).alias("name"))
    resolved = resolve_names(names, relations)
    out = claims
    for column in _TABLE_COLUMNS:
        spelled = resolved.select(F.col("name").alias(column), F.col("resolved").alias(f"{column}_spelled"))
        out = out.join(spelled, column, "left").withColumn(column, F.coalesce(f"{column}_spelled", column)).drop(f"{column}_spelled")
    return out.select(*claims.columns)


def spell_suspicions(suspicions: DataFrame, relations: DataFrame) -> DataFrame:
    """Suspicions with their tables spelled as the relations are, in the order they name them."""
    numbered = suspicions.withColumn("__id", F.monotonically_increasing_id())
    exploded = numbered.select("__id", F.posexplode("tables").alias("at", "name"))
    resolved = resolve_names(exploded.select("name"), relations)
    spelled = exploded.join(resolved, "name", "left").groupBy("__id").agg(
        F.sort_array(F.collect_list(F.struct("at", F.coalesce("resolved", "name").alias("t")))).alias("ts")
    )
    return numbered.join(spelled, "__id").withColumn("tables", F.transform("ts", lambda t: t["t"])).select(*suspicions.columns)


def relationship_id() -> Column:
    """The id of a row of relationship claims; a condition is part of it, so each branch is a claim."""
    when = F.when(F.col("when_column").isNotNull(), F.concat(F.lit("["), "when_column", F.lit("="), "when_equals", F.lit("]"))).otherwise("")
    return F.concat(F.lit("relationship:"), "from_table", F.lit("."), "from_column", F.lit("->"), "to_table", F.lit("."), "to_column", when)


def suspicion_id() -> Column:
    """The id of a row of suspicions."""
    column = F.when(F.coalesce(F.col("column"), F.lit("")) != "", F.concat(F.lit("."), "column")).otherwise("")
    return F.concat(F.lit("suspicion:"), "kind", F.lit(":"), F.concat_ws("+", "tables"), column)


def dedupe_relationships(claims: DataFrame) -> DataFrame:
    """One row per id: a stated copy over an inferred one, and of two with one basis the one whose text sorts first."""
    order = F.struct(F.col("basis") != "stated", F.to_json(F.struct("confidence", "reason")))
    kept = claims.groupBy(relationship_id().alias("claim_id")).agg(F.min_by(F.struct(*claims.columns), order).alias("kept"))
    return kept.select("claim_id", "kept.*")


def dedupe_suspicions(suspicions: DataFrame) -> DataFrame:
    """One row per id, its details each once, in order."""
    return (
        suspicions.withColumn("claim_id", suspicion_id())
        .groupBy("claim_id")
        .agg(
            F.first("kind").alias("kind"), F.first("tables").alias("tables"), F.first("column").alias("column"),
            F.concat_ws("; ", F.sort_array(F.collect_set("detail"))).alias("detail"),
        )
    )
