import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import topk


def slow(rows, k):
    """Every row against every query but itself."""
    good = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for place, (q, mine) in enumerate(good):
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(mine, v)), i) for other, (i, v) in enumerate(good) if other != place and len(v) == len(mine))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "blocks", "scale"), [(20, (4096, 1024), 1.0), (3, (16, 3), 1.0), (5, (30, 2), 3e6), (4, (50, 5), 1e7)])
def test_equals_brute_force(spark, k, blocks, scale):
    rng = random.Random(k)
    rows = [(i, [scale * round(rng.uniform(-1, 1), 1) for _ in range(rng.choice([6, 6, 6, 3]))]) for i in range(160)]
    rows += [(160, None), (180, [1.0, None, 1.0]), (200, [float("nan")] * 6), (220, [float("inf")] * 6), (None, [1.0] * 6), (240, []), rows[20], (40, [-9.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(topk.integer_vectors(df), F.col("id") % 20 == 0, k, vector_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted(tuple(r) for r in got) == slow(rows, k)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(topk.integer_vectors(df), F.col("id") == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.top_k(topk.integer_vectors(df.limit(0)), F.col("id") == 0).count() == 0


def test_repeated_ids_are_rows_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])] + [(7, [0.5, 0.5])] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(topk.integer_vectors(df), F.col("id") % 20 == 0, 4, vector_block=8, query_block=2).collect()
    assert sorted(tuple(r) for r in got) == slow(rows, 4)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0][:2] == [1, 1]
