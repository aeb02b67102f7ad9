"""A full run: claims measured on a catalog, decided, reported and kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline import schema as S
from plumbline.operators.claims import dedupe_relationships, dedupe_suspicions, spell_claims, spell_suspicions
from plumbline.operators.compare import schema_fingerprint
from plumbline.operators.joins import Relationship, measure_relationships, relationships_of
from plumbline.operators.problems import Suspicion, measure_suspicions, suspicions_of
from plumbline.operators.profile import table_profile
from plumbline.operators.report import join_sentence, table_reports
from plumbline.operators.sampling import Scan
from plumbline.operators.verdicts import decide
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog
from plumbline.sources.small import kept, small_table, together
from plumbline.sources.snapshot import Snapshot


def relationships_df(catalog: Catalog, claims: list[Relationship]) -> DataFrame:
    rows = [tuple(getattr(c, f) for f in S.RELATIONSHIPS.names) for c in claims]
    return small_table(catalog.spark, rows, S.RELATIONSHIPS)


def suspicions_df(catalog: Catalog, suspicions: list[Suspicion]) -> DataFrame:
    rows = [(s.kind, list(s.tables), s.column, s.detail) for s in suspicions]
    return small_table(catalog.spark, rows, S.SUSPICIONS)


def prepared(catalog: Catalog, relationships: DataFrame, suspicions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The claims spelled as the catalog spells them, one row per id."""
    relations = catalog.relations_df()
    return dedupe_relationships(spell_claims(relationships, relations)), dedupe_suspicions(spell_suspicions(suspicions, relations))


def measure(
    catalog: Catalog, relationships: list[Relationship], suspicions: list[Suspicion], settings: Settings, conditions: bool = True
) -> DataFrame:
    """A measurement per claim: relationships first, in the order given, then suspicions."""
    frames = []
    if relationships:
        frames.append(measure_relationships(catalog, relationships, settings, conditions))
    if suspicions:
        measured = measure_suspicions(catalog, suspicions, settings)
        frames.append(measured.withColumn("position", F.col("position") + len(relationships)))
    if not frames:
        return small_table(catalog.spark, [], S.MEASUREMENTS)
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def verify(catalog: Catalog, relationships: DataFrame, suspicions: DataFrame, settings: Settings) -> DataFrame:
    """The verdicts on two tables of claims: spelled, deduplicated, measured and decided."""
    rels, sus = prepared(catalog, relationships, suspicions)
    return decide(measure(catalog, relationships_of(rels), suspicions_of(sus), settings), settings)


def measure_join(catalog: Catalog, from_table: str, from_column: str, to_table: str, to_column: str, settings: Settings, when: tuple[str, str] | None = None) -> DataFrame:
    """One join asked for directly: stated if a key declares it, else inferred; its verdict and its sentence."""
    frm, to = catalog.find(from_table), catalog.find(to_table)
    names = (frm.name if frm else from_table, from_column, to.name if to else to_table, to_column)
    basis = "stated" if names in catalog.foreign else "inferred"
    claim = Relationship(*names, *(when or (None, None)), basis)
    verdict = decide(measure_relationships(catalog, [claim], settings), settings)
    known = {f: F.lit(getattr(claim, f)).cast("string") for f in ("from_table", "from_column", "to_table", "to_column", "when_column", "when_equals", "basis")}
    return verdict.withColumns(known).withColumn("line", join_sentence(settings.sampled))


def snapshot_of(catalog: Catalog, relationships: DataFrame, suspicions: DataFrame, verdicts: DataFrame, settings: Settings) -> Snapshot:
    """What a run leaves for a later one to compare with, measured once here. The claims are those of ``prepared``."""
    relations, columns, keys = catalog.relations_df(), catalog.columns_df(), catalog.keys_df()
    found = together(lambda: kept(verdicts), lambda: kept(relationships), lambda: kept(suspicions), schema_fingerprint(relations, columns, keys).first)
    return Snapshot(
        settings=small_table(catalog.spark, settings.measured_with(), "name string, value double"),
        relations=relations,
        columns=columns,
        keys=keys,
        relationships=found[1],
        suspicions=found[2],
        verdicts=found[0],
        fingerprint=found[3]["fingerprint"],
    )


def reports(catalog: Catalog, relationships: DataFrame, suspicions: DataFrame, verdicts: DataFrame, settings: Settings) -> DataFrame:
    """(table, report) of every relation of the catalog. The verdicts are measured once, for joins and problems alike."""
    scan = Scan.of(catalog, settings)
    lists = table_profile(catalog, settings, scan=scan, values=True).where("values IS NOT NULL").select("table", "column", "values")
    relationships, suspicions, verdicts, lists = together(*[lambda df=df: kept(df) for df in (relationships, suspicions, verdicts, lists)])
    return table_reports(catalog.relations_df(), scan.sizes_told(), catalog.keys_df(), relationships, suspicions, verdicts, lists, settings.sampled)
