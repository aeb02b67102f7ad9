"""Exact top-k search by inner product in three phases with a uniform threshold.

The dimensions are dealt into SLICES; a score is the sum of a vector's scores in the slices. Each task holds a block of queries and a block of
vectors. Phase one gathers, for each query and slice, the k best of every block with their whole scores; the k-th best of these is a cutoff
that no true top-k score is below. Phase two gives every task the cutoffs of its queries. A score at or above the cutoff has a slice at or
above cutoff / SLICES, so only such entries are collected. Phase three resolves their other slices and keeps those that reach the cutoff.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep

K = 20
SLICES = 2
VECTOR_BLOCK = 4096
QUERY_BLOCK = 1024


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", factor: int = 64) -> DataFrame:
    """id, v: each component x as floor(factor * x), x as double. Rows whose id or vector is null or empty, or whose vector holds null or
    non-finite components, are left out. Rows with one id all stay."""
    x = F.col("x")
    good = F.col("id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(good)
    return rows.select("id", F.transform("x", lambda y: F.floor(y * factor)).alias("v"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(-1, width)


def _slices(q: np.ndarray, v: np.ndarray, slices: int) -> list[np.ndarray]:
    """Queries x vectors inner products of each slice, exact: in floats while the numbers are small enough, else in 64-bit integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    parts = np.array_split(np.arange(q.shape[1]), min(slices, q.shape[1]))
    return [(q[:, p].astype(kind) @ v[:, p].astype(kind).T).astype(np.float64 if kind == np.float32 else kind) for p in parts]


def _paired(vectors: DataFrame, queries: DataFrame, join: Callable, schema: str) -> DataFrame:
    """join over each pair of a vector block and a query block; both sides come from one table, so the queries' columns get names of their own."""
    asks = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    return vectors.groupBy("dim", "vb", "qb").cogroup(asks.groupBy("q_dim", "q_vb", "q_qb")).applyInArrow(join, schema)


def _local_lists(k: int, slices: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """query, score: whole scores of the entries that are among the k best of the block in some slice."""

    def of(v: pa.Table, q: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(v) and len(q):
            width = v.column("dim")[0].as_py()
            ids, asks = v.column("row").to_numpy(), q.column("q_row").to_numpy()
            scores = _slices(_matrix(q.column("q_v"), width), _matrix(v.column("v"), width), slices)
            own = asks[:, None] == ids[None]
            chosen = np.zeros(own.shape, bool)
            for part in scores:
                part = np.where(own, part.min() - 1, part)
                best = np.argpartition(-part, min(k, len(ids)) - 1, axis=1)[:, :k]
                np.put_along_axis(chosen, best, True, axis=1)
            row, at = np.nonzero(chosen & ~own)
            out = [asks[row]], [sum(scores)[row, at].astype(np.int64)]
        return pa.table({"query": np.concatenate(out[0]), "score": np.concatenate(out[1])})

    return of


def _sufficient(slices: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """query, query_id, id, score: entries that reach the uniform threshold in some slice and, resolved, the cutoff."""

    def of(v: pa.Table, q: pa.Table) -> pa.Table:
        empty = np.zeros(0, np.int64)
        if not (len(v) and len(q)):
            return pa.table({"query": empty, "query_id": empty, "id": empty, "score": empty})
        width = v.column("dim")[0].as_py()
        rows, asks = v.column("row").to_numpy(), q.column("q_row").to_numpy()
        ids, query_ids = v.column("id").to_numpy(), q.column("q_id").to_numpy()
        cutoff = q.column("q_cutoff").combine_chunks()
        known = cutoff.is_valid().to_numpy(zero_copy_only=False)
        least = cutoff.fill_null(0).to_numpy()[:, None]
        scores = _slices(_matrix(q.column("q_v"), width), _matrix(v.column("v"), width), slices)
        enough = np.zeros(scores[0].shape, bool)
        for part in scores:
            enough |= part * len(scores) >= least
        enough[~known] = True  # fewer than k scores in all
        row, at = np.nonzero(enough & (asks[:, None] != rows[None]))
        total = sum(part[row, at] for part in scores).astype(np.int64)
        reach = (total >= least[row, 0]) | ~known[row]
        return pa.table({"query": asks[row][reach], "query_id": query_ids[row][reach], "id": ids[at][reach], "score": total[reach]})

    return of


def top_k(vectors: DataFrame, is_query: Column, k: int = K, slices: int = SLICES, vector_block: int = VECTOR_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query the k largest inner products with other rows, ties to the smaller id.

    vectors is id, v as integer_vectors() gives them; is_query, over id, picks the queries. Every row is compared with every query but itself: of
    rows with one id each is a vector, and each is a query if it is picked, with its own ranks. Vectors are compared with those of equal length
    only. A query has fewer rows where there are fewer others. An empty table gives no rows. Scores must fit 64-bit integers.
    """
    # The rows' numbers are written with them, so they hold for all that follows.
    rows = keep(vectors.withColumn("dim", F.size("v")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("q")).first()
    blocks, asks = 1 + sizes["n"] // vector_block, 1 + sizes["q"] // query_block
    block = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    held = rows.withColumn("vb", block(blocks, 1)).withColumn("qb", each(asks)).select("dim", "vb", "qb", "row", "id", "v")
    queries = rows.where(is_query).withColumn("qb", block(asks, 2))
    local = _paired(held, queries.withColumn("vb", each(blocks)).select("dim", "vb", "qb", "row", "id", "v"), _local_lists(k, slices), "query long, score long")
    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    cutoffs = keep(local.withColumn("n", nth).where(F.col("n") <= k).where(F.col("n") == k).select("query", F.col("score").alias("cutoff")), "cutoffs")

    cut = queries.join(cutoffs, queries["row"] == cutoffs["query"], "left").withColumn("vb", each(blocks)).select("dim", "vb", "qb", "row", "id", "v", "cutoff")
    found = _paired(held, cut, _sufficient(slices), "query long, query_id long, id long, score long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
