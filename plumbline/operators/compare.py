"""Two runs side by side: what moved, what is gone, and whether that fails a build."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import schema as S
from plumbline.functions.rules import change_class
from plumbline.operators.claims import resolve_names
from plumbline.settings import Settings

# Which classes fail a build under each gate.
FAILING = {
    "regression": ["regression", "stale"],
    "change": ["regression", "stale", "drift", "improved", "changed"],
    "never": [],
}


def class_order(column: str = "class") -> Column:
    """Most serious first."""
    return F.array_position(F.array(*[F.lit(c) for c in S.CHANGE_CLASSES]), F.col(column))


def schema_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, found_in) of relations in only one of two runs: ``now`` for one added, ``before`` for one dropped."""
    b, n = before.select("name", F.lit(1).alias("b")), now.select("name", F.lit(1).alias("n"))
    return b.join(n, "name", "full_outer").where("b IS NULL OR n IS NULL").selectExpr("name", "if(b IS NULL, 'now', 'before') AS found_in")


def schema_fingerprint(relations: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """
    One row: a hash over names, kinds, definitions, comments, columns and keys, which no row count moves.

    Lines are hashed per relation and the relations' hashes together, so no row holds a whole schema.
    """
    none = F.lit("")
    lines = [
        relations.select("name", F.to_json(F.struct(F.lit("r").alias("a"), "kind", F.coalesce("definition", none).alias("d"), "populated", F.col("partitions").isNotNull().alias("partitioned"), "comment")).alias("line")),
        columns.select(F.col("table").alias("name"), F.to_json(F.struct(F.lit("c").alias("a"), "ordinal", "column", "type", "nullable", "comment")).alias("line")),
        keys.select(F.col("table").alias("name"), F.to_json(F.struct(F.lit("k").alias("a"), "kind", "ordinal", "column", F.coalesce("ref_table", none).alias("t"), F.coalesce("ref_column", none).alias("c"))).alias("line")),
    ]
    every = lines[0].unionAll(lines[1]).unionAll(lines[2])

    def digest(items: Column) -> Column:
        return F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(items))), 256)

    by_relation = every.groupBy("name").agg(digest(F.col("line")).alias("h"))
    return by_relation.agg(F.concat(F.lit("sha256:"), digest(F.concat("name", F.lit("="), "h"))).alias("fingerprint"))


def relationship_names(claims: DataFrame) -> DataFrame:
    """(claim_id, ordinal, name, column): the columns a relationship uses, in the order they are looked for."""
    uses = [("from_table", "from_column"), ("to_table", "to_column"), ("from_table", "when_column")]
    return claims.select(
        "claim_id", F.posexplode(F.array(*[F.struct(F.col(t).alias("name"), F.col(c).alias("column")) for t, c in uses])).alias("ordinal", "u")
    ).select("claim_id", "ordinal", "u.name", "u.column").where("column IS NOT NULL")


def suspicion_names(suspicions: DataFrame) -> DataFrame:
    """(claim_id, ordinal, name, column): the tables a suspicion names, the first with its column."""
    return suspicions.select("claim_id", F.posexplode("tables").alias("ordinal", "name"), F.expr("nullif(column, '')").alias("c")).selectExpr(
        "claim_id", "ordinal", "name", "if(ordinal = 0, c, null) AS column"
    )


def _missing(names: DataFrame, relations: DataFrame, columns: DataFrame) -> DataFrame:
    """(claim_id, missing): the first name of each claim that a schema does not have; claims with all names are left out."""
    resolved = names.join(resolve_names(names, relations), "name", "left")
    known = columns.select(F.col("table").alias("resolved"), F.col("column"), F.lit(True).alias("there"))
    looked_up = resolved.join(known, ["resolved", "column"], "left")
    gone = F.when(F.col("resolved").isNull(), F.col("name")).when(
        F.col("column").isNotNull() & F.col("there").isNull(), F.concat("name", F.lit("."), "column")
    )
    found = looked_up.select("claim_id", "ordinal", gone.alias("missing")).where("missing IS NOT NULL")
    return found.groupBy("claim_id").agg(F.min_by("missing", "ordinal").alias("missing"))


def missing_names(names: DataFrame, before: tuple[DataFrame, DataFrame], now: tuple[DataFrame, DataFrame], unmeasured: DataFrame) -> DataFrame:
    """
    (claim_id, missing): the first table or column each claim lost since. Runs are (relations, columns).

    A claim in ``unmeasured`` (claim_id) that lacked a name before too had nothing to lose, and is left out.
    """
    invented = _missing(names.join(unmeasured, "claim_id", "left_semi"), *before).select("claim_id")
    return _missing(names, *now).join(invented, "claim_id", "left_anti")


def classify_changes(before: DataFrame, after: DataFrame, missing: DataFrame, settings: Settings) -> DataFrame:
    """
    (claim_id, class, before, hit_before, after, hit_after, skipped, missing) of every claim measured again.

    ``before`` and ``after`` are verdicts; a claim without one before was unverifiable then.
    """
    b = before.select("claim_id", F.col("status").alias("before"), F.col("hit").alias("hit_before"))
    joined = after.join(b, "claim_id", "left").join(missing, "claim_id", "left").withColumn("before", F.coalesce("before", F.lit("unverifiable")))
    cls = change_class(
        F.col("claim_id").startswith("relationship:"), F.col("before"), F.col("status"), F.col("hit_before"), F.col("hit"),
        F.col("missing"), settings.check_hit_rate_tolerance,
    )
    return joined.select(
        "claim_id", cls.alias("class"), "before", "hit_before", F.col("status").alias("after"), F.col("hit").alias("hit_after"), "skipped",
        F.when(cls == "stale", F.col("missing")).alias("missing"),
    )


def settings_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """(name, before, now) of the settings that differ between two runs of (name, value)."""
    b, n = before.select("name", F.col("value").alias("before")), now.select("name", F.col("value").alias("now"))
    return b.join(n, "name").where(~F.col("before").eqNullSafe(F.col("now")))


def _items(changes: DataFrame, relations: DataFrame) -> DataFrame:
    return changes.select("class").unionAll(relations.select(F.lit("stale").alias("class")))


def change_tally(changes: DataFrame, relations: DataFrame) -> DataFrame:
    """(position, class, items): how many items of each class; a relation added or dropped is a stale one."""
    return _items(changes, relations).groupBy("class").agg(F.count(F.lit(1)).alias("items")).select(
        class_order().cast("int").alias("position"), "class", "items"
    )


def gate(changes: DataFrame, relations: DataFrame, fail_on: str = "regression") -> DataFrame:
    """One row: does the run fail under ``regression``, ``change`` or ``never``."""
    failing = F.col("class").isin(FAILING[fail_on]) if FAILING[fail_on] else F.lit(False)
    return _items(changes, relations).agg(F.coalesce(F.max(failing), F.lit(False)).alias("fails"))
