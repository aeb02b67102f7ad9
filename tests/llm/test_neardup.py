import random

import pytest
from xxhash import xxh64_intdigest

from plumbline.llm import neardup

SCHEMA = "text string, doc_id long, t1 string, fp int"


def slow_fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids: list[int], fps: list[int], radius: int) -> list[int]:
    group = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(d for d, h in zip(ids, group) if h == g) for g in set(group)}
    return [least[g] for g in group]


def near_copies(rng: random.Random) -> list[str]:
    word = lambda: "".join(rng.choice("aeistnÉ") for _ in range(rng.randint(1, 6)))
    out = []
    for _ in range(12):
        words = [word() for _ in range(rng.randint(1, 150))]
        for _ in range(rng.randint(1, 6)):
            copy = list(words)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = word()
            out.append(rng.choice([" ", "\n", " \t"]).join(copy))
    return out


@pytest.mark.parametrize("shard_rows", [2, 2000])
def test_components_equal_brute_force(spark, shard_rows):
    rng = random.Random(3)
    texts = [*near_copies(rng), None, "", " \x0b ", "one", "One", "one two", "x " * 3000]
    texts += texts[:5]
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(t, d, "clash", 1) for t, d in zip(texts, ids)], SCHEMA)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs, shard_rows=shard_rows).collect()}
    fps = [slow_fingerprint(t) for t in texts]
    assert [got[d]["fp"] & 0xFFFFFFFFFFFFFFFF for d in ids] == fps
    assert [got[d]["component_id"] for d in ids] == slow_components(ids, fps, 3)


def test_links_are_lost_by_no_split(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 3))) for b in base for _ in range(15)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = neardup.components(neardup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), shard_rows=3), "fp", "to")
    root = {r["node"]: r["root"] for r in found.collect()}
    ours = [root.get(f, f) for f in signed]
    slow = slow_components(list(range(len(fps))), fps, 3)
    assert len(set(zip(ours, slow))) == len(set(ours)) == len(set(slow))


def test_one_of_each_keeps_columns_and_survives_nulls(spark):
    docs = spark.createDataFrame([("a b c d", 2, "x", 1), ("a b c d", 1, "y", None), ("a b c d", 1, "y", None), (None, None, None, None), ("", 9, None, 2)], SCHEMA)
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a b c d"), (9, "")]
    nobody = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(nobody).count() == 0 and neardup.one_of_each(nobody).count() == 0
