"""Measurements to verdicts, and what a run's verdicts add up to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.rules import status
from plumbline.settings import Settings


def decide(measurements: DataFrame, settings: Settings) -> DataFrame:
    """The measurements with a status."""
    return measurements.withColumn("status", status(settings))


def claim_type(column: str = "kind"):
    return F.when(F.col(column) == "relationship", "relationship").otherwise("suspicion")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    """Claims by type and status; a join confirmed on values that fit other keys too is counted on weak evidence."""
    weak = (F.col("kind") == "relationship") & (F.col("status") == "confirmed") & (F.coalesce("also_fits", F.lit(0)) > 0)
    return (
        verdicts.select(claim_type().alias("type"), F.when(weak, "on weak evidence").otherwise(F.col("status")).alias("status"))
        .groupBy("type", "status")
        .agg(F.count(F.lit(1)).alias("claims"))
    )


def broken_joins(verdicts: DataFrame) -> DataFrame:
    """(rank, claim_id, hit, orphans) of every broken join, the worst first."""
    broken = verdicts.where("kind = 'relationship' AND status = 'broken'")
    return broken.select(F.row_number().over(Window.orderBy("hit", "claim_id")).alias("rank"), "claim_id", "hit", "orphans")


def empty_reasons(verdicts: DataFrame) -> DataFrame:
    """(rank, reason, claims): why claims were empty, the most frequent reason first. All reasons are told; there are few."""
    counted = verdicts.where("status = 'empty'").groupBy(F.coalesce("skipped", F.lit("no reason given")).alias("reason")).agg(F.count(F.lit(1)).alias("claims"))
    return counted.select(F.row_number().over(Window.orderBy(F.desc("claims"), "reason")).alias("rank"), "reason", "claims")


def relation_kinds(relations: DataFrame) -> DataFrame:
    """Relations by kind, and how many of them are partitioned."""
    return relations.groupBy("kind").agg(
        F.count(F.lit(1)).alias("relations"), F.count_if(F.col("partitions").isNotNull()).alias("partitioned")
    )


def has_findings(verdicts: DataFrame) -> DataFrame:
    """One row: whether a join is broken or a suspicion confirmed."""
    found = F.when(F.col("kind") == "relationship", F.col("status") == "broken").otherwise(F.col("status") == "confirmed")
    return verdicts.agg(F.coalesce(F.max(found), F.lit(False)).alias("has_findings"))
