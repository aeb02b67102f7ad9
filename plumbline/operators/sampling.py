"""Repeatable samples: the same rows for one seed, however the data is partitioned."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.values import as_text, cell
from plumbline.settings import Settings
from plumbline.sources.catalog import Catalog, Relation
from plumbline.sources.sizes import row_counts, sizes
from plumbline.sources.small import small_table

_BUCKETS = 16**8
SLOT_DIGITS = 3


def row_hash(identity: list[Column], seed: int) -> Column:
    """Eight hex digits of an MD5 over the seed and the row's identity: uniform, and the same in any SQL engine."""
    return F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *identity)), 1, 8)


def row_place(df: DataFrame) -> tuple[Column, Column] | None:
    """The file a row lies in and its number there, which no column has to be read for; None where rows come from elsewhere."""
    place = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    try:
        df.select(*place).schema  # noqa: B018 - resolves the names, reads nothing
        return place
    except AnalysisException:
        return None


def _identity(df: DataFrame, key: list[str] | None) -> list[Column]:
    """What tells a row apart: its key, else its place in its file, else its whole content."""
    if key:
        return [as_text(cell(c), df.schema[c].dataType) for c in key]
    place = row_place(df)
    if place is not None:
        return [place[0], place[1].cast("string")]
    return [F.coalesce(as_text(cell(f.name), f.dataType), F.lit("\x00")) for f in df.schema.fields]


def repeatable_sample(df: DataFrame, share: float, seed: int, key: list[str] | None = None) -> DataFrame:
    """About ``share`` of the rows from all of the data. A filter: no shuffle, and the columns read stay pruned."""
    if share >= 1:
        return df
    return df.where(row_hash(_identity(df, key), seed) < f"{int(share * _BUCKETS):08x}")


def _below(hashed: DataFrame, threshold: str | None) -> DataFrame:
    return (hashed if threshold is None else hashed.where(F.col("__h") < threshold)).drop("__h")


def lowest(df: DataFrame, most: int, seed: int, key: list[str] | None = None, share: float = 1) -> tuple[DataFrame, int]:
    """
    Of about ``share`` of the rows those of lowest hash, at most ``most`` of them, and how many they are.

    The rows are counted by the first digits of their hash, 16 ** SLOT_DIGITS numbers at most. If there are too many, the
    hashes of the one slot in which row number ``most`` falls are put in order to find the hash at which to stop. The
    sample itself stays a filter, so it moves no row and the columns read stay pruned. Rows that share the hash at which
    it would have to stop are left out together.
    """
    hashed = df.withColumn("__h", row_hash(_identity(df, key), seed))
    if share < 1:
        hashed = hashed.where(F.col("__h") < f"{int(share * _BUCKETS):08x}")
    slot = F.substring("__h", 1, SLOT_DIGITS)
    counted = sorted(tuple(r) for r in hashed.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect())
    found = sum(n for _, n in counted)
    if found <= most:
        return hashed.drop("__h"), found
    before = 0
    for digits, n in counted:  # noqa: B007
        if before + n > most:
            break
        before += n
    few = [r[0] for r in hashed.where(slot == digits).select("__h").orderBy("__h").limit(most - before + 1).collect()]
    return _below(hashed, few[-1]), before + sum(h < few[-1] for h in few)


def sample_cap(df: DataFrame, cap: int, seed: int, key: list[str] | None = None) -> DataFrame:
    """At most ``cap`` rows, the ones of lowest hash, for a sample sized from an estimate that was far too low."""
    return lowest(df, cap, seed, key)[0]


@dataclass(frozen=True)
class Sample:
    """
    The rows read of a relation: all of them or the first (``random`` off), or rows picked by hash; ``read`` is their
    number where it was counted.
    """

    df: DataFrame
    random: bool = False
    read: int | None = None

    def size(self, estimate: int | None, settings: Settings) -> tuple[int, bool]:
        """
        How many rows the relation has, -1 if unknown, and whether that is a count.

        Rows read at random say nothing of the size. Rows read from the start count the relation if they end before the
        limit; if they do not, it has at least as many, and an estimate of fewer is none.
        """
        guess = -1 if estimate is None else estimate
        if self.random or self.read is None:
            return guess, False
        if self.read < settings.sample_rows:
            return self.read, True
        return (guess if self.read <= guess else -1), False


def first_rows(df: DataFrame, settings: Settings) -> Sample:
    """The first ``sample_rows`` rows, counted."""
    first = df.limit(settings.sample_rows)
    return Sample(first, False, first.count())


def bounded_scan(relation: Relation, rows: int, settings: Settings, key: list[str] | None = None) -> Sample:
    """
    The whole relation when it has at most ``sample_rows`` rows, else a repeatable sample of about that many from all its files.

    The sample is counted once. It never has more than ``sample_rows * sample_oversample`` rows, those of lowest hash, where
    the size was estimated too low; where it is empty the first rows of the relation stand in.
    """
    if 0 <= rows <= settings.sample_rows:
        return Sample(relation.df)
    if rows < 0:  # unknown
        return first_rows(relation.df, settings)
    cap = int(settings.sample_rows * settings.sample_oversample)
    sample, found = lowest(relation.df, cap, settings.sample_seed, key, settings.sample_rows / rows)
    return Sample(sample, True, found) if found else first_rows(relation.df, settings)


@dataclass(frozen=True)
class Scan:
    """How the measured side of every operator is read: whole, or through one sample per relation, made once."""

    catalog: Catalog
    settings: Settings
    rows: dict[str, int] | None = None
    samples: dict[str, Sample] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, catalog: Catalog, settings: Settings, names: list[str] | None = None) -> Scan:
        return cls(catalog, settings, sizes(catalog, settings, names) if settings.sampled else None)

    def is_sampled(self, relation: Relation) -> bool:
        rows = 0 if self.rows is None else self.rows.get(relation.name, 0)
        return not 0 <= rows <= self.settings.sample_rows

    def sample(self, relation: Relation) -> Sample:
        if not self.is_sampled(relation):
            return Sample(relation.df)
        if relation.name not in self.samples:
            key = list(self.catalog.primary.get(relation.name, ()))
            self.samples[relation.name] = bounded_scan(relation, self.rows[relation.name], self.settings, key or None)
        return self.samples[relation.name]

    def __call__(self, relation: Relation) -> DataFrame:
        return self.sample(relation).df

    def sizes_told(self) -> DataFrame:
        """
        (table, rows, source) as findings tell them: counted where a relation was read whole, else the size after its sample
        was read, -1 if unknown; ``source`` is count or pilot, and null of what is neither.
        """
        sampled = [r for r in self.catalog.relations if r.df is not None and self.is_sampled(r)]
        after = [(r.name, *self.sample(r).size(self.rows[r.name], self.settings)) for r in sampled]
        told = [(name, rows, "count" if counted else "pilot" if rows >= 0 else None) for name, rows, counted in after]
        whole = [r.name for r in self.catalog.relations if r.df is not None and not self.is_sampled(r)]
        counts = row_counts(self.catalog, whole).withColumn("source", F.lit("count"))
        return counts.unionAll(small_table(self.catalog.spark, told, "table string, rows bigint, source string")) if told else counts
