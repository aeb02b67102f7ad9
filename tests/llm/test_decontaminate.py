import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    out = []
    for _, text in docs:
        w, hit, got = words(text), set(), set()
        for item, item_text in items:
            v = words(item_text)
            n = min(13, len(v))
            for k in range(len(v) - n + 1 if v else 0):
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[k : k + n]:
                        hit |= set(range(i, i + n))
                        got.add("null" if item is None else str(item))
        out.append((len(w), len(hit), tuple(sorted(got))))
    return out


def case(rng):
    word = lambda: rng.choice(["the", "of", "Der", "É", "7", "x"]) if rng.random() < 0.4 else "".join(rng.choice("abcdeß") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 12, 13, 14, 30])))) for i in range(20)] + [(None, None), (21, ""), (22, "The the THE"), (22, "of the")]
    docs = []
    for i in range(80):
        parts = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            stolen = rng.choice(items)[1] or ""
            at = rng.randint(0, len(parts))
            cut = stolen.split()
            parts[at:at] = cut[: rng.choice([len(cut), 13, 12])]
        docs.append((i % 70, rng.choice([" ", ", ", "\n"]).join(parts).upper() if i % 3 else "-".join(parts)))
    return [*docs, (500, None), (501, ""), docs[3], docs[4]], items


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    docs, items = case(random.Random(seed))
    d = spark.createDataFrame([(i, t, "w", 0) for i, t in docs], "doc_id int, text string, word string, n int")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_hit int")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in decontaminate.contamination(d, b).collect())
    assert got == Counter((i, *row) for (i, _), row in zip(docs, slow(docs, items)))


def test_clean_rows_stay_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c", "x"), (None, None, None), (2, "q " * 300, "y"), (2, "q " * 300, "y")], "doc_id long, text string, source string")
    items = spark.createDataFrame([(1, "B, c")], "item_id long, text string")
    left = decontaminate.without_contaminated(docs, items)
    assert left.columns == docs.columns and left.count() == 3 and left.where(F.col("doc_id") == 1).count() == 0
    assert decontaminate.without_contaminated(docs, items.limit(0)).count() == 4
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
