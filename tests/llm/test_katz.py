import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import katz, queries


class Slow:
    """The model from dictionaries, by recursion over the history of each token."""

    def __init__(self, texts: list[str], order: int):
        self.order, self.counts = order, [Counter() for _ in range(order + 1)]
        for text in texts:
            tokens = self.tokens(text)
            for i in range(1, len(tokens)):
                for m in range(1, order + 1):
                    if i - m + 1 >= 0:
                        self.counts[m][tuple(tokens[i - m + 1 : i + 1])] += 1
        self.n, self.v = sum(self.counts[1].values()), len(self.counts[1])
        self.d = [None]
        for m in range(1, order + 1):
            of = Counter(self.counts[m].values())
            self.d.append(katz.discounts([of[r] for r in range(1, katz.MOST_DISCOUNTED + 2)]))
        self.after: dict[tuple, list] = {}
        for m in range(1, order + 1):
            for gram in self.counts[m]:
                self.after.setdefault(gram[:-1], []).append(gram[-1])
        self.memo: dict = {}

    @staticmethod
    def tokens(text: str | None) -> list[str]:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            lower = lower.replace(c, " ")
        return ["<", *(w for w in lower.split(" ") if w), ">"]

    def kept(self, gram: tuple) -> float:
        c, d = self.counts[len(gram)][gram], self.d[len(gram)]
        return c * (d[c - 1] if c <= len(d) else 1.0)

    def history(self, h: tuple) -> tuple[float, float]:
        """How often it counts, and its backoff weight (for no history: the probability of an unknown word)."""
        if h not in self.memo:
            seen = self.after.get(h, [])
            times = sum(self.counts[len(h) + 1][(*h, w)] for w in seen)
            left = times - sum(self.kept((*h, w)) for w in seen)
            if not any(self.counts[len(h) + 1][(*h, w)] <= len(self.d[len(h) + 1]) for w in seen):
                times, left = times + 1, 1.0
            self.memo[h] = times, left / times / (1 - sum(self.p(h[1:], w) for w in seen)) if h else left / times
        return self.memo[h]

    def p(self, h: tuple, w: str) -> float:
        if h and h not in self.after:
            return self.p(h[1:], w)
        times, backoff = self.history(h)
        if self.counts[len(h) + 1][(*h, w)]:
            return self.kept((*h, w)) / times
        return backoff * self.p(h[1:], w) if h else backoff

    def row(self, text: str | None) -> tuple:
        tokens = self.tokens(text)
        known = [self.counts[1][(w,)] for w in tokens[1:]]
        score = sum(math.log10(self.p(tuple(tokens[max(0, i - self.order + 1) : i]), tokens[i])) for i in range(1, len(tokens)))
        return len(known), sum(c > 0 for c in known), self.n, sum(math.log10((c + 1) / (self.n + self.v + 1)) for c in known), score


def some_texts(rng: random.Random, n: int) -> list[str | None]:
    words = [rng.choice("abcdefgÉ") * rng.randint(1, 3) for _ in range(60)]
    pick = lambda: words[min(int(rng.expovariate(0.08)), 59)]
    out: list[str | None] = [rng.choice([" ", "\n", "\t "]).join(pick() for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*out, None, "", "  ", "New york " * 9, "new York", "new x", out[0], "long " * 3000 + "text"]


@pytest.mark.parametrize(("order", "tokens", "buckets"), [(1, 100, 3), (2, 1 << 21, 32), (2, 50, 7), (3, 200, 5), (4, 90, 2)])
def test_scores_are_those_of_dictionaries(spark, monkeypatch, order, tokens, buckets):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(katz, "LEAST_BUCKETS", buckets)
    texts = some_texts(random.Random(order), 80)
    rows = [(i // 2 if i % 9 else None, t, i % 4 > 0, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learned boolean, block int")
    got = katz.score(docs, docs["learned"], order=order).collect()
    model = Slow([t for _, t, learned, _ in rows if learned], order)
    want = sorted(((str(i), learned, *model.row(t)) for i, t, learned, _ in rows), key=str)
    have = sorted(((str(r["doc_id"]), r["train"], *(r[c] for c in ("n_tokens", "n_known", "train_tokens", "base_score", "score"))) for r in got), key=str)
    assert [w[:5] for w in want] == [h[:5] for h in have]
    assert np.allclose(np.array([w[5:] for w in want]), np.array([h[5:] for h in have]), rtol=1e-9)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(order):
    model = Slow(some_texts(random.Random(7), 60), order)
    words = [w for (w,) in model.counts[1]] + ["never seen"]
    for h in [h for h in model.after if len(h) == order - 1][:200]:
        assert math.isclose(sum(model.p(h, w) for w in words), 1, rel_tol=1e-9)


def test_discounts():
    assert np.allclose(katz.discounts([100, 40, 20, 12, 8, 6]), [(2 * 40 / 100 - 0.36) / 0.64, (60 / 80 - 0.36) / 0.64, (48 / 60 - 0.36) / 0.64, (40 / 48 - 0.36) / 0.64, (36 / 40 - 0.36) / 0.64])
    assert len(katz.discounts([100, 40, 20, 0, 8, 6])) == 2
    assert katz.discounts([0, 0, 0, 0, 0, 0]).tolist() == [0.5]


def test_nothing_to_learn_from_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "`a.b` int, text string")
    got = katz.score(docs, docs["text"] == "no such", id="a.b").collect()
    assert sorted(tuple(r)[:5] for r in got) == [(1, False, 3, 0, 0), (2, False, 1, 0, 0)]
    assert all(r["score"] == r["base_score"] == 0 for r in got)
    assert katz.score(docs.where("false"), docs["text"].isNull(), id="a.b").count() == 0


def test_query_against_dictionaries(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {d for d in docs if zlib.crc32(str(d).encode()) % 7 == 2}
    model = Slow([t for d, t in docs.items() if d not in out], katz.ORDER)
    for r in queries.op12_katz_scoring(spark, sf).collect():
        want = model.row(docs[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in out, *want[:3])
        assert math.isclose(r["base_score"], want[3], rel_tol=1e-9) and math.isclose(r["score"], want[4], rel_tol=1e-9)
