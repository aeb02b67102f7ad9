import random
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import periods, queries


def slow(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Every lag by itself; of runs over the same words the one of the smallest lag."""
    n, best = len(words), {}
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, times * q):
                best.setdefault((start, i - start), q)
    return sorted(((s, m, q) for (s, m), q in best.items()), key=lambda r: (r[0], r[2]))


def slow_kept(words: list, runs: list) -> list:
    return [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]


def numbers(words: list) -> np.ndarray:
    known: dict = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def periodic(rng: random.Random) -> list[str]:
    """Repeated blocks of few and many words, broken here and there, with blocks that repeat within a block."""
    out: list[str] = []
    for _ in range(rng.randint(1, 5)):
        block = [rng.choice("abcdef"[: rng.randint(1, 6)]) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.4:
            block = block[:3] * rng.randint(1, 12) + block
        out += (block * rng.randint(1, 9))[: rng.randint(1, 300)]
        if rng.random() < 0.5 and out:
            out[rng.randrange(len(out))] = "x"
    return out


def test_runs_are_those_of_every_lag_by_itself():
    rng = random.Random(1)
    for _ in range(400):
        words = periodic(rng)
        assert periods.runs_of(numbers(words)) == slow(words), words


@pytest.mark.parametrize(("least", "times"), [(3, 3), (1, 4), (10, 3), (100, 5)])
def test_other_bounds(least, times):
    rng = random.Random(least)
    for _ in range(100):
        words = periodic(rng)
        assert periods.runs_of(numbers(words), least, times) == slow(words, least, times)


def test_two_periods_are_refused():
    with pytest.raises(ValueError):
        periods.runs_of(np.zeros(9, np.int64), 4, 2)


def test_very_long_texts_take_no_square():
    n = 300_000
    assert periods.runs_of(np.zeros(n, np.int64)) == [(0, n, 1)]
    block = np.tile(np.r_[np.arange(9), 100, np.arange(9), 101], n // 20)  # words that repeat within the period too
    assert periods.runs_of(block) == [(0, n, 20)]


def test_rows(spark):
    texts = [None, "", " \n ", "a " * 30, "x y z", "a " * 30, "b c d " * 12 + "e"]
    docs = spark.createDataFrame([(i // 2, t, "clash") for i, t in enumerate(texts)], "doc_id int, text string, runs string")
    got = sorted(map(tuple, periods.find_runs(docs).collect()), key=str)
    want = []
    for i, t in enumerate(texts):
        words = (t or "").replace(" ", "").split()
        runs = slow(words)
        want.append((i // 2, len(words), [tuple(r) for r in runs], " ".join(slow_kept(words, runs)).replace("", " ")))
    assert [(a, b, [tuple(r) for r in c], d) for a, b, c, d in got] == sorted(want, key=str)
    assert periods.find_runs(docs.where("false")).count() == 0
    dotted = docs.selectExpr("doc_id AS `a.b`", "text AS `the text`")
    assert periods.find_runs(dotted, "a.b", "the text").count() == len(texts)


def test_query_against_every_lag_by_itself(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got.keys() == docs.keys()
    some = 0
    for d, text in docs.items():
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        if len(words) > 3000:  # the slow way takes the square
            continue
        runs = slow(words)
        some += bool(runs)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        r = got[d]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(runs), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == sha256(b" ".join(slow_kept(words, runs))).hexdigest()
    assert some > 5


def test_planting_keeps_null_ids_and_texts(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (1, None)], "doc_id long, text string")
    assert docs.select(queries.planted_text(F.col("doc_id"), F.col("text"))).collect() == docs.select("text").collect()
