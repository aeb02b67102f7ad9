import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import queries, toxicity


def corpus(spark, n=400):
    rng = np.random.default_rng(1)
    plain = ["".join(rng.choice(list("aeinrst"), 4)) for _ in range(300)]
    bad = [f"vile{x}" for x in "abcdefgh"]
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        words = list(rng.choice(plain, 40)) + list(rng.choice(bad, 4)) * toxic
        rng.shuffle(words)
        rows.append((i, " ".join(words), "en"))
        if i % 2 or toxic and i % 3:
            labels.append((i, int(toxic), 1))
    return spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, score int")


def test_held_out_texts(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, labels, F.col("doc_id") % 4 != 2, prior=0.2).collect()}
    held = [i for i in got if i % 4 == 2]
    assert np.mean([got[i]["predicted"] for i in held if i % 5 == 0]) > 0.9
    assert np.mean([got[i]["predicted"] for i in held if i % 5]) < 0.05
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())


def test_risk_does_not_fall_below_zero():
    rng = np.random.default_rng(2)
    positive = np.arange(300) < 60
    rows = [np.flatnonzero(rng.random(40) < (0.4 if p or i % 4 == 0 else 0.05)) for i, p in enumerate(positive)]
    w, b = toxicity.fit(rows, positive, 40, 0.25)
    z = np.array([w[r].sum() for r in rows]) + b
    risk = np.logaddexp(0, z)[~positive].mean() - 0.25 * np.logaddexp(0, z)[positive].mean()
    assert risk > -0.05 and z[positive].mean() > z[~positive].mean()


def test_edge_cases(spark):
    docs, labels = corpus(spark, 60)
    odd = docs.unionByName(spark.createDataFrame([(None, None, None), (7, "", "x"), (8, "y " * 20_000, None)], docs.schema))
    rows = toxicity.score(odd, labels.unionByName(spark.createDataFrame([(None, 1, 1), (3, None, 1)], labels.schema)), F.lit(True), prior=0.1).collect()
    assert len(rows) == 63
    assert all(r["predicted"] == 0 for r in rows if r["doc_id"] is None)
    nothing = toxicity.score(odd, labels.limit(0), F.lit(True)).collect()
    assert {(r["score"], r["predicted"]) for r in nothing} == {(0.0, 0)}
    assert toxicity.score(docs.limit(0), labels, F.lit(True)).count() == 0


def test_few_positives_leave_clean_texts_alone(spark):
    """The smallest tables but one hold some 40 confirmed texts."""
    sf = "/root/testdata/sf0.01"
    found = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out AND toxic IS NOT NULL").toPandas()
    by = found.groupby("toxic")["predicted"].mean()
    assert by[0] <= 0.05 and by[1] >= 0.6
    toxic, clean = (found.loc[found["toxic"] == t, "score"].to_numpy() for t in (1, 0))
    assert (toxic[:, None] > clean[None]).mean() + (toxic[:, None] == clean[None]).mean() / 2 >= 0.8


def test_the_mean_score_of_unlabelled_texts_is_the_prior():
    rng = np.random.default_rng(3)
    z = rng.normal(size=500)
    for prior in (0.01, 0.12, 0.5):
        assert abs((1 / (1 + np.exp(-z - toxicity.calibrated(z, prior)))).mean() - prior) < 1e-9


def test_chance_buckets_are_left_out():
    rng = np.random.default_rng(4)
    texts, positives, width = 1000, 40, 3000
    held = rng.random((texts, width)) < 0.003
    held[:positives, :10] |= rng.random((positives, 10)) < 0.4
    counts = [np.append(held[:n].sum(axis=0), n) for n in (texts, positives)]
    chosen = set(toxicity.select(*counts, 0.1).tolist())
    assert set(range(10)) <= chosen and len(chosen) < 10 + 2 * toxicity.CHANCE_BUCKETS


def test_gradient_steps_lower_the_risk():
    """The fitted weights against the risk at the weights around them, written out anew."""
    rng = np.random.default_rng(5)
    positive = np.arange(200) < 50
    rows = [np.flatnonzero(rng.random(12) < (0.5 if p else 0.15)) for p in positive]
    w, _ = toxicity.fit(rows, positive, 12, 0.2, steps=4000)

    def risk(w: np.ndarray, b: float) -> float:
        z = np.array([w[r].sum() for r in rows]) + b
        of = lambda values: float(np.mean(values))
        plus, minus = np.logaddexp(0, -z), np.logaddexp(0, z)
        return 0.2 * of(plus[positive]) + max(0.0, of(minus[~positive]) - 0.2 * of(minus[positive])) + toxicity.DECAY * 0.2 / 2 * float((w**2).sum())

    best = min(risk(w, b) for b in np.linspace(-6, 3, 181))
    for _ in range(30):
        other = w + rng.normal(scale=0.5, size=12)
        assert best <= min(risk(other, b) for b in np.linspace(-6, 3, 91)) + 1e-3
