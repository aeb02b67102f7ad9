"""Metadata as a DataFrame: relations, columns, claims and settings, never rows of a table."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.schema import fields


def small_table(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """
    A DataFrame of a few rows the driver already holds.

    Through Arrow, so that the optimizer sees a local relation of known size and not a scan of pickled objects.
    """
    struct = fields(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(struct)
    columns = [pa.array([row[i] for row in rows], type=f.type) for i, f in enumerate(arrow)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow), struct)


def kept(df: DataFrame) -> DataFrame:
    """
    What a run found about its claims, taken once: one row per claim, as a snapshot or a report holds them.

    Never for rows of a table. Later steps read the result and do not measure it again.
    """
    return small_table(df.sparkSession, [tuple(row) for row in df.collect()], df.schema)


def together(*asked: Callable[[], Any]) -> list[Any]:
    """
    The answers of several independent jobs, run at the same time.

    Each is a few rows about claims or a schema, and most of its time is planning and waiting for its last tasks.
    """
    with ThreadPoolExecutor(len(asked)) as pool:
        return [answer.result() for answer in [pool.submit(ask) for ask in asked]]
