"""A later run: a snapshot's claims measured again, and what moved since."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.compare import (
    classify_changes,
    missing_names,
    relationship_names,
    schema_diff,
    schema_fingerprint,
    settings_diff,
    suspicion_names,
)
from plumbline.operators.joins import relationships_of
from plumbline.operators.problems import suspicions_of
from plumbline.operators.verdicts import decide
from plumbline.plans.run import measure
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog
from plumbline.sources.small import kept, small_table, together
from plumbline.sources.snapshot import Snapshot


@dataclass(frozen=True)
class CheckReport:
    changes: DataFrame  # one row per claim
    relations: DataFrame  # added or dropped
    settings: DataFrame  # those that differ
    schema_changed: bool


# Settings that decide which columns are categorical, and the direction in which more columns are.
_SHOWS_MORE = {"categorical_max_distinct": 1, "categorical_max_value_length": 1, "categorical_min_rows_per_value": -1}


def shows_more(kept: Settings, own: Settings) -> bool:
    """Whether columns may be categorical under a snapshot's settings that are not under this run's."""
    steps = {name: direction * (getattr(kept, name) - getattr(own, name)) for name, direction in _SHOWS_MORE.items()}
    # Fewer rows can make a column look categorical; a whole table is as many rows as there are.
    rows = [s.sample_rows if s.sampled else float("inf") for s in (kept, own)]
    return rows[0] < rows[1] or max(steps.values()) > 0


def remeasure(catalog: Catalog, snapshot: Snapshot, settings: Settings) -> DataFrame:
    """
    The verdicts on a snapshot's claims now, measured with the snapshot's settings and only on the tables they name.

    A snapshot can be edited by anyone, so with settings wider than this run's no condition is measured.
    """
    then = settings.with_measured({r["name"]: r["value"] for r in snapshot.settings.collect()})
    rels, sus = relationships_of(snapshot.relationships), suspicions_of(snapshot.suspicions)
    return decide(measure(catalog, rels, sus, then, conditions=not shows_more(then, settings)), then)


def check(catalog: Catalog, snapshot: Snapshot, settings: Settings) -> CheckReport:
    """A snapshot against the catalog now, measured once here."""
    after = remeasure(catalog, snapshot, settings)
    relations, columns, keys = catalog.relations_df(), catalog.columns_df(), catalog.keys_df()
    names = relationship_names(snapshot.relationships).unionByName(suspicion_names(snapshot.suspicions))
    measured_before = snapshot.verdicts.where("status <> 'unverifiable'").select("claim_id")
    unmeasured = names.select("claim_id").distinct().join(measured_before, "claim_id", "left_anti")
    missing = missing_names(names, (snapshot.relations, snapshot.columns), (relations, columns), unmeasured)
    own = small_table(catalog.spark, settings.measured_with(), "name string, value double")
    changes, fingerprint = together(
        lambda: kept(classify_changes(snapshot.verdicts, after, missing, settings)), schema_fingerprint(relations, columns, keys).first
    )
    return CheckReport(
        changes=changes,
        relations=schema_diff(snapshot.relations, relations),
        settings=settings_diff(snapshot.settings, own),
        schema_changed=fingerprint["fingerprint"] != snapshot.fingerprint,
    )


def notes(report: CheckReport) -> DataFrame:
    """(note, name, before, now): what a reader of the changes should know, a row per setting that differs and one if the schema does."""
    schema = small_table(report.settings.sparkSession, [("schema changed",)] if report.schema_changed else [], "note string")
    nothing = {"name": F.lit(None).cast("string"), **{c: F.lit(None).cast("double") for c in ("before", "now")}}
    return report.settings.select(F.lit("setting differs").alias("note"), "name", "before", "now").unionByName(schema.withColumns(nothing))
