import hashlib
import random
from collections import Counter

import pytest

from plumbline.llm import substrings


def slow(texts, window):
    words = [(t or "").encode().split() for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for w in words:
        gone = {k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(i, i + window)}
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest(), b" ".join(kept).decode()))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER} == set(range(substrings.PERIOD))


@pytest.mark.parametrize("chunk_words", [150, 10**6])
def test_equals_brute_force(spark, chunk_words):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(3))
    passage = [[word() for _ in range(n)] for n in (34, 35, 36, 60, 120)]
    texts = []
    for _ in range(60):
        parts = [[word() for _ in range(rng.randint(0, 50))] for _ in range(4)]
        for p in rng.sample(passage, rng.randint(0, 3)):
            parts.insert(rng.randrange(4), p[: rng.choice([34, 35, 200])])
        texts.append(rng.choice([" ", "\n", " \t"]).join(w for p in parts for w in p))
    texts += [None, "", "one", "a " * 400, "a b " * 40, *texts[:3], " ".join(passage[4]), " ".join(passage[4])]
    docs = spark.createDataFrame([(1, t, i % 50, "x") for i, t in enumerate(texts)], "n_words int, text string, doc_id int, at string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in substrings.remove_repeats(docs, with_text=True, chunk_words=chunk_words).collect())
    assert got == Counter((i % 50, *row) for i, row in enumerate(slow(texts, 35)))


def test_empty_table(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
