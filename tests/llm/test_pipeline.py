"""Each stage of the pipeline on what the stage before kept, beside brute force."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from plumbline.llm import packing
from plumbline.llm.queries import tokenizer_files
from test_decontaminate import slow as slow_hits
from test_lines import slow as slow_lines
from test_neardup import slow_components, slow_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = {"en": "the and of with house river stone light".split(), "de": "der und die straße über schön haus licht".split()}
    made = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", rng.choice("abcdefgh")]) for _ in range(n))
    items = [(i, made("en", n)) for i, n in enumerate((5, 13, 20, 30))]
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        text = "\n".join(made(lang, rng.randint(1, 40)) for _ in range(rng.randint(1, 8)))
        if i % 9 == 0:
            text += "\n" + rng.choice(items)[1]
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1] + rng.choice(["", " x", "\nend"])
        rows.append((i, text, lang if i % 4 else None, "s", len(text)))
    rows += [(200, None, "en", None, None), (201, "", "en", "s", 0), (202, "12 34 !", None, "s", 7), (203, made("de", 3000), "de", "s", 1), rows[5]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select(COLUMNS).collect()]
        docs = corpus_pipeline.keep(stage(spark, docs, tables), name)
        rows = [tuple(r) for r in docs.collect()]
        if name == "best_fit_packing":
            ids = packing.tokenizer(*tokenizer_files()).encode_ordinary
            assert Counter({d: sum(r[3] for r in rows if r[0] == d) for d in {r[0] for r in rows}}) == Counter({d: len(ids(t or "")) + 1 for d, t, *_ in before})
            assert len({r[5] for r in rows}) == packing.least_sequences(Counter(r[3] for r in rows))
            continue
        assert docs.columns == COLUMNS
        if name == "language_id":
            assert Counter(rows) == Counter(r for r in before if r[1] and any(c.isalpha() for c in r[1]))
        elif name == "line_dedup":
            assert Counter((r[0], r[1]) for r in rows) == Counter((d, t) for d, t, _, _ in slow_lines([(0, r[1], r[0]) for r in before]).elements())
            assert all(r[4] == len(r[1]) for r in rows)
        elif name == "simhash_neardup":
            groups = slow_components([r[0] for r in before], [slow_fingerprint(r[1]) for r in before], 3)
            assert sorted(r[0] for r in rows) == sorted(set(groups)) and set(rows) <= set(before)
        else:
            bad = [h and 20 * h >= n for n, h, _ in slow_hits([(r[0], r[1]) for r in before], items)]
            assert any(bad) and Counter(rows) == Counter(r for r, b in zip(before, bad) if not b)


def test_run_is_the_stages_in_turn(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert rows and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert corpus_pipeline.ORACLE_SQL is None
