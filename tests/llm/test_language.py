import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import language
from plumbline.llm.queries import op2_language_id

SCHEMA = "doc_id int, text string, lang string, score string"


@pytest.mark.parametrize("n", [2, 3, 4, 7, 12, 40])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    assert all((code[i] != code[j]).sum() >= (1 if n == 2 else 2) for i in range(n) for j in range(i))
    assert (np.abs(code.sum(axis=0)) < n).all()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = {r["held_out"]: r["p"] for r in found.groupBy("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("p")).collect()}
    assert right[True] >= 0.97 and right[False] >= 0.97
    assert found.where("score < 0 or score > 1").count() == 0


def test_decoding_corrects_a_wrong_bit():
    code = language.codewords(4)
    margins = 3.0 * code[2:3].astype(float)
    margins[0, 1] *= -1
    pred, score, apart = language.decode(margins, code, np.full(code.shape, 1 / code.shape[1]))
    assert pred[0] == 2 and 0 < score[0] < 1 and apart[0] > language.AMBIGUOUS_MARGIN
    _, _, unclear = language.decode(np.zeros((1, code.shape[1])), code, np.full(code.shape, 1 / code.shape[1]))
    assert unclear[0] < language.AMBIGUOUS_MARGIN


def test_a_text_scores_alike_alone_and_among_others(monkeypatch):
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], rng.integers(1, 9, (2, 1 << language.BUCKET_BITS)))
    texts = ["", "x", "some words", "é" * 500, "word " * 300]
    together = model.margins(pa.array(texts))
    alone = np.concatenate([model.margins(pa.array([t])) for t in texts])
    assert np.abs(together - alone)[2:].max() < 0.15
    monkeypatch.setattr(language, "STEP", 400)
    assert np.abs(model.margins(pa.array(texts)) - alone)[2:].max() < 0.15


def test_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", None), (3, None, "en", None), (4, "", None, None), (5, "123 !", "de", None), (5, "123 !", "de", None), (6, "the dog", None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"], r["lang_pred"]) for r in language.identify(docs, F.lit(True)).collect())
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (5, "und"), (6, "en")]
    assert {r["lang_pred"] for r in language.identify(docs, F.lit(False)).collect()} == {"und"}
    assert {r["lang_pred"] for r in language.identify(docs, F.col("lang") == "en").where("doc_id < 3").collect()} == {"en"}
    assert language.identify(docs.limit(0), F.lit(True)).count() == 0


def test_a_score_is_made_from_its_text_alone(monkeypatch):
    rng = np.random.default_rng(1)
    model = language.Model(["a", "b", "c"], rng.integers(0, 9, (3, 1 << language.BUCKET_BITS)))
    texts = ["", "x", "ab", "é", "abc", "ab", "", "日本", "a b", None, "hello there", "ab", "word " * 300, "x"]
    texts += ["".join(rng.choice(list("abcé "), rng.integers(0, 13))) for _ in range(300)]
    alone = np.concatenate([model.margins(pa.array([t], pa.string())) for t in texts])
    plain = {t: sum((model.bits[b].sum(axis=0, dtype=float) for b in language.buckets_of(np.frombuffer(f" {t}".encode(), np.uint8))), np.zeros(3)) for t in texts[1:9]}
    lengths = {t: sum(max(0, len(f" {t}".encode()) - order + 1) for order in language.ORDERS) for t in plain}
    for i in range(1, 9):
        assert np.allclose(alone[i], plain[texts[i]] / max(1, lengths[texts[i]]))
    for step in (language.STEP, 400, 5):
        monkeypatch.setattr(language, "STEP", step)
        whole = np.concatenate([model.margins(pa.array([t], pa.string())) for t in texts])
        assert np.allclose(whole, alone)
        for order in (range(len(texts)), rng.permutation(len(texts))):
            together = model.margins(pa.array([texts[i] for i in order], pa.string()))
            assert np.array_equal(together, whole[list(order)])


def test_training_counts_do_not_depend_on_order_or_batches(spark):
    rng = np.random.default_rng(2)
    rows = [("".join(rng.choice(list("abcé "), rng.integers(0, 13))), "ab"[i % 2]) for i in range(400)]

    def counted(docs):
        return {r["lang"]: np.frombuffer(r["counts"], np.int64).tolist() for r in language.count_ngrams(docs, "text", "lang").collect()}

    one = counted(spark.createDataFrame(rows, "text string, lang string").coalesce(1))
    many = counted(spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "text string, lang string").repartition(7))
    assert one == many
    for lang in "ab":
        assert sum(one[lang]) == sum(max(0, len(f" {t}".encode()) - order + 1) for t, name in rows if name == lang for order in language.ORDERS)
