"""Named relations, their columns and their declared keys: all metadata, no table is read here."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import cached_property
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import schema as S
from plumbline.functions.values import cell
from plumbline.sources.small import small_table

HOME_SCHEMA = "default"


@dataclass(frozen=True, eq=False)
class Relation:
    """
    A named DataFrame. A partitioned dataset is one relation, with the columns it is partitioned by.

    ``df`` is None for a materialized view that was never filled; ``columns`` then gives its schema, if known.
    ``unread`` says why a relation could not be opened.
    """

    name: str
    df: DataFrame | None
    schema: str = HOME_SCHEMA
    kind: str = "table"
    definition: str | None = None
    partition_columns: tuple[str, ...] = ()
    columns: T.StructType = field(default_factory=T.StructType)
    files: str | None = None
    unread: str | None = None
    comment: str | None = None

    @cached_property
    def struct(self) -> T.StructType:
        return self.df.schema if self.df is not None else self.columns

    @property
    def populated(self) -> bool:
        return self.df is not None or self.unread is not None

    @property
    def names(self) -> list[str]:
        """How a claim may call it: bare, or after its schema."""
        return [self.name] if self.name.startswith(self.schema + ".") else [self.name, f"{self.schema}.{self.name}"]

    def has(self, column: str | None) -> bool:
        return column in self.struct.names

    def type_of(self, column: str) -> T.DataType:
        return self.struct[column].dataType

    def is_integer(self, column: str) -> bool:
        return S.is_integer(self.type_of(column))

    def only(self, *columns: str) -> DataFrame:
        return self.df.select(*[cell(c) for c in columns])


class Catalog:
    """Relations in order of schema and name, the keys declared on them, and the columns shown whatever they hold."""

    def __init__(
        self,
        spark: SparkSession,
        relations: Iterable[Relation],
        keys: Iterable[tuple] = (),
        reveal: Iterable[str] = (),
    ) -> None:
        self.spark = spark
        self.relations = sorted(relations, key=lambda r: (r.schema, r.name))
        self._by_name = {r.name: r for r in self.relations}
        # Of two relations with one name the first in order has it.
        called = [(name, r) for r in reversed(self.relations) for name in r.names]
        self._called = dict(called)
        self._called_in_any_case = {name.lower(): r for name, r in called}
        self.keys = [tuple(k) for k in keys]
        self.reveal = frozenset(reveal)
        self.extents: dict = {}  # what sizes.extents() has found of each relation

    @classmethod
    def from_parquet(
        cls, spark: SparkSession, directory: str, names: Iterable[str], keys: Iterable[tuple] = (), reveal: Iterable[str] = ()
    ) -> Catalog:
        """One relation per ``<name>.parquet`` file or dataset in a directory; one that cannot be opened keeps its name."""
        return cls(spark, [_open_parquet(spark, os.path.join(directory, f"{n}.parquet"), n) for n in names], keys, reveal)

    @classmethod
    def from_tables(
        cls, spark: SparkSession, databases: Iterable[str] = (HOME_SCHEMA,), keys: Iterable[tuple] = (), reveal: Iterable[str] = ()
    ) -> Catalog:
        """Every table and view of the session catalog's databases."""
        return cls(spark, [_open_table(spark, db, t) for db in databases for t in spark.catalog.listTables(db) if not t.isTemporary], keys, reveal)

    def replace(self, **frames: DataFrame | None) -> Catalog:
        """The catalog with other data under some names; None drops a relation, a new name adds a table."""
        kept = [replace(r, df=frames.get(r.name, r.df), files=None if r.name in frames else r.files) for r in self.relations if frames.get(r.name, r) is not None]
        added = [Relation(n, df) for n, df in frames.items() if df is not None and n not in self._by_name]
        other = Catalog(self.spark, kept + added, self.keys, self.reveal)
        other.extents = {name: extent for name, extent in self.extents.items() if name not in frames}
        return other

    def only(self, names: Iterable[str]) -> Catalog:
        """The same keys over the named relations alone."""
        wanted = set(names)
        some = Catalog(self.spark, [r for r in self.relations if r.name in wanted], self.keys, self.reveal)
        some.extents = self.extents
        return some

    def __getitem__(self, name: str) -> Relation:
        return self._by_name[name]

    def find(self, name: str | None) -> Relation | None:
        """The relation that a claim calls by this name; the case of letters counts only between two that differ in it alone."""
        asked = (name or "").strip()
        return self._called.get(asked) or self._called_in_any_case.get(asked.lower())

    # ---- declared keys ----

    @cached_property
    def primary(self) -> dict[str, tuple[str, ...]]:
        ordered = sorted((k for k in self.keys if k[1] == "p"), key=lambda k: (k[0], k[2]))
        out: dict[str, tuple[str, ...]] = {}
        for table, _, _, column, *_ in ordered:
            out[table] = (*out.get(table, ()), column)
        return out

    @cached_property
    def foreign(self) -> set[tuple[str, str, str, str]]:
        return {(k[0], k[3], k[4], k[5]) for k in self.keys if k[1] == "f"}

    def leads_key(self, table: str, column: str) -> bool:
        return self.primary.get(table, (None,))[0] == column

    def shown_regardless(self, relation: Relation, column: str) -> bool:
        """A declared key column that is not text, or one revealed by name."""
        key = column in self.primary.get(relation.name, ()) or any(f[:2] == (relation.name, column) for f in self.foreign)
        revealed = any(f"{called}.{column}" in self.reveal for called in relation.names)
        return revealed or (key and S.family(relation.type_of(column)) != S.TEXT)

    def unknown_reveals(self) -> list[str]:
        """The names to be revealed that are no column's: a slip in one would leave its column hidden without a word."""
        known = {f"{called}.{column}" for r in self.relations for called in r.names for column in r.struct.names}
        return sorted(self.reveal - known)

    # ---- as DataFrames ----

    def keys_df(self) -> DataFrame:
        return small_table(self.spark, self.keys, S.KEYS)

    def relations_df(self) -> DataFrame:
        """One row per relation, with the number of partitions of a partitioned one."""
        rows = [(i, r.name, r.schema, r.kind, r.definition, r.populated, r.comment) for i, r in enumerate(self.relations)]
        listed = small_table(self.spark, rows, "position int, name string, schema string, kind string, definition string, populated boolean, comment string")
        counted = [
            r.only(*r.partition_columns).distinct().agg(F.lit(r.name).alias("name"), F.count(F.lit(1)).alias("partitions"))
            for r in self.relations
            if r.partition_columns and r.df is not None
        ]
        partitions = _union(counted) if counted else small_table(self.spark, [], "name string, partitions bigint")
        return listed.join(F.broadcast(partitions), "name", "left").select(*S.RELATIONS.names)

    def columns_df(self) -> DataFrame:
        """One row per column, in the relation's order, with the comment that a table or a file's schema keeps of it."""
        rows = [
            (r.name, i, f.name, f.dataType.simpleString(), f.nullable, S.family(f.dataType), S.is_integer(f.dataType), f.metadata.get("comment"))
            for r in self.relations
            for i, f in enumerate(r.struct.fields)
        ]
        return small_table(self.spark, rows, S.COLUMNS)


def declared_keys(keys: DataFrame) -> DataFrame:
    """One row per table with a declared key: its primary key in key order, and how many foreign key columns it has."""
    ordered = F.sort_array(F.collect_list(F.when(F.col("kind") == "p", F.struct("ordinal", "column"))))
    return keys.groupBy("table").agg(
        F.array_join(F.transform(ordered, lambda k: k["column"]), ", ").alias("primary_key"),
        F.count_if(F.col("kind") == "f").alias("foreign_keys"),
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    """All rows, put together by halves: each step analyses its plan anew, so one by one the cost would grow with the square."""
    while len(frames) > 1:
        frames = [a.unionAll(b) for a, b in zip(frames[::2], frames[1::2], strict=False)] + frames[len(frames) // 2 * 2 :]
    return frames[0]


def _open_parquet(spark: SparkSession, path: str, name: str) -> Relation:
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # the words of the error can hold a value or a path, so only its kind is kept
        return Relation(name, None, unread=f"could not be read ({type(e).__name__})")
    return Relation(name, df, partition_columns=_partition_columns(df), files=path)


def _partition_columns(df: DataFrame) -> tuple[str, ...]:
    """The columns that a dataset's folders are named by, read off the place of one file."""
    folders = next(iter(df.inputFiles()), "").split("/")[:-1]
    named = [unquote(folder.partition("=")[0]) for folder in folders if "=" in folder]
    return tuple(c for c in named if c in df.columns)


def _open_table(spark: SparkSession, database: str, table) -> Relation:
    full = f"`{database}`.`{table.name}`"
    name = table.name if database == HOME_SCHEMA else f"{database}.{table.name}"
    view = table.tableType == "VIEW"
    try:
        df = spark.table(full)
        definition = spark.sql(f"SHOW CREATE TABLE {full}").first()[0].split(" AS ", 1)[-1].strip() if view else None
        parts = () if view else tuple(c.name for c in spark.catalog.listColumns(full) if c.isPartition)
    except Exception as e:
        return Relation(name, None, database, unread=f"could not be read ({type(e).__name__})")
    return Relation(name, df, database, "view" if view else "table", definition, parts, comment=table.description)
