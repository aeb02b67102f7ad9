"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic texts are labelled examples; all texts together are the unlabelled ones, toxic texts among them. A linear classifier over
hashed words and word beginnings minimises the risk estimate that the class prior corrects, and turns back where the estimated risk of the
clean texts would fall below zero. Which words tell the two apart is counted over all texts in Spark, at most POSITIVES of them as confirmed;
the weights are fitted with numpy on those and about UNLABELLED texts, and the bias so that the mean score of the latter is the class prior.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from plumbline.llm.common import MOST_CACHED_WORDS, slices, texts_of
from plumbline.llm.decontaminate import words_of

FEATURE_BITS = 18
SELECTED = 2048
LEAST_PURITY = 0.35
CHANCE_BUCKETS = 5  # that say nothing and may yet be taken, as expected
POSITIVES = 10_000
UNLABELLED = 20_000
STEPS = 400
RATE = 0.05
DECAY = 3e-3
THRESHOLD = 0.3
PREFIXES = (3, 4, 5)


class Features:
    """The buckets of a text's distinct words and of their beginnings. A word's buckets are kept while the cache lasts."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((1 << 12, len(PREFIXES) + 1), np.int32)

    def of(self, text: bytes) -> np.ndarray:
        words = set(words_of(text))
        if not words:
            return np.zeros(0, np.int32)
        new = [w for w in words if w not in self.place]
        if new and len(self.place) + len(new) > MOST_CACHED_WORDS:
            self.__init__()
            new = list(words)
        for word in new:
            parts = [b"=" + word, *[b"^" + word[:n] for n in PREFIXES if len(word) >= n]]
            parts += parts[:1] * (len(PREFIXES) + 1 - len(parts))
            if len(self.place) == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[len(self.place)] = [xxh32_intdigest(p) >> (32 - FEATURE_BITS) for p in parts]
            self.place[word] = len(self.place)
        return np.unique(self.table[[self.place[w] for w in words]])


def _document_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How many texts, and how many texts of positives, hold each bucket; the last entry is the number of texts."""
    width = (1 << FEATURE_BITS) + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, counts = Features(), np.zeros((2, width), np.int64)
        for part in slices(batches):
            for text, positive in zip(texts_of(part.column(0)), part.column(1).to_pylist(), strict=True):
                held = features.of(text)
                for mine in counts[: 1 + positive]:
                    mine[held] += 1
                    mine[-1] += 1
        yield pa.RecordBatch.from_pydict({"counts": pa.array([counts.tobytes()], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"counts": pa.array([sums.tobytes()], pa.binary())})

    parts = docs.select("text", "positive").mapInArrow(of, "counts binary").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(16)))
    # Two steps, so that no group gathers a table from every task.
    sums = parts.groupBy("part").applyInArrow(summed, "counts binary").withColumn("part", F.lit(0)).groupBy("part").applyInArrow(summed, "counts binary").first()
    both = np.frombuffer(sums["counts"], np.int64).reshape(2, width) if sums else np.zeros((2, width), np.int64)
    return both[0], both[1]


def select(all_: np.ndarray, positive: np.ndarray, prior: float, most: int = SELECTED) -> np.ndarray:
    """Buckets of which, by the class prior, LEAST_PURITY of the texts that hold them are toxic; strongest evidence first. Words that only tell
    languages or topics apart stay below that. Where positives are few many buckets reach it by chance, so a bucket must also stand in more
    positives than, by Chernoff's bound, CHANCE_BUCKETS of all would if they said nothing."""
    n, n_positive = max(1, all_[-1]), max(1, positive[-1])
    held = positive[:-1].astype(np.float64)
    ratio = np.log((held + 0.5) / (n_positive + 1)) - np.log((all_[:-1] + 0.5) / (n + 1))
    expected = np.maximum(all_[:-1] * (n_positive / n), 1e-9)
    surprise = np.where(held > expected, held * np.log(np.maximum(held, 1) / expected) - held + expected, 0)
    enough = surprise >= np.log(max(1, np.count_nonzero(held)) / CHANCE_BUCKETS)
    gain = np.where(enough & (np.exp(ratio) * prior >= LEAST_PURITY), positive[:-1] * ratio, 0)
    best = np.argsort(-gain, kind="stable")[:most]
    return best[gain[best] > 0]


def fit(rows: list[np.ndarray], positive: np.ndarray, columns: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise prior * R+(positives) + max(0, R-(all) - prior * R-(positives)) for the logistic loss.

    rows: the selected features of each text; positive: whether it is a confirmed positive, else it is unlabelled.
    """
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)
    share = np.where(positive, 1 / max(1, positive.sum()), 1 / max(1, (~positive).sum()))
    w, first, second = np.zeros(columns + 1), np.zeros(columns + 1), np.zeros(columns + 1)
    w[-1] = np.log(prior / (1 - prior))
    for step in range(1, steps + 1):
        z = np.bincount(row, w[column], len(rows)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        negative_risk = (np.logaddexp(0, z) * share * np.where(positive, -prior, 1)).sum()
        g = p * share * np.where(positive, -prior, 1)
        if negative_risk >= 0:
            g = g + np.where(positive, prior * (p - 1) * share, 0)
        else:
            g = -g
        gradient = np.append(np.bincount(column, g[row], columns), g.sum())
        gradient[:-1] += DECAY * prior * w[:-1]
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        w = w - RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def calibrated(z: np.ndarray, prior: float) -> float:
    """The bias at which the mean probability of unlabelled texts is the class prior."""
    low, high = -60.0, 60.0
    for _ in range(80):
        bias = (low + high) / 2
        mean = (1 / (1 + np.exp(-np.clip(z + bias, -60, 60)))).mean() if len(z) else prior
        low, high = (bias, high) if mean < prior else (low, bias)
    return (low + high) / 2


def score(docs: DataFrame, labels: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from threshold on) for every row of docs, repeated rows included.

    labels has doc_id and label; train, over its columns, picks the rows whose label is learned. prior is the share of toxic texts; by default
    the share among the learned labels. Ids that are labelled twice are positive if one label is. A null or empty text has the score of no
    words. Without a learned positive all scores are 0. Other columns are not read. An empty table gives no rows.
    """
    known = labels.where(train & F.col(label).isNotNull() & F.col(doc_id).isNotNull())
    share = known.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    prior = share if prior is None else prior
    # At most POSITIVES ids, so the broadcast is bounded.
    ids = known.where(F.col(label) == 1).select(F.col(doc_id).alias("id")).distinct().orderBy(F.xxhash64("id"), "id").limit(POSITIVES)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = rows.join(F.broadcast(ids), rows["doc_id"] == ids["id"], "left").select("text", F.col("id").isNotNull().alias("positive"), F.xxhash64(F.lit(3), "doc_id", "text").alias("h"))
    weights, bias = _learned(marked, min(max(prior or 0.0, 1e-4), 0.9))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in slices(batches):
            z = np.array([weights[features.of(t)].sum() for t in texts_of(part.column(1))]) + bias
            p = np.where(z < -700, 0.0, 1 / (1 + np.exp(-np.clip(z, -700, 700))))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(scored, f"doc_id {kind}, score double, predicted int")


def _learned(marked: DataFrame, prior: float) -> tuple[np.ndarray, float]:
    """A weight for each bucket, 0 for most, and the bias."""
    weights = np.zeros(1 << FEATURE_BITS)
    all_, positive = _document_counts(marked)
    chosen = np.sort(select(all_, positive, prior))
    if not len(chosen):
        return weights, -np.inf
    picked = F.pmod("h", F.lit(1 << 30)) < int((1 << 30) * min(1.0, UNLABELLED / max(1, int(all_[-1]))))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for part in slices(batches):
            at = [np.flatnonzero(np.isin(chosen, features.of(t))) for t in texts_of(part.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int32())), part.column(1), part.column(2), part.column(3)], ["at", "positive", "picked", "h"])

    # Rows of one id and text have one hash, however many they are, so the numbers are bounded once more.
    found = marked.where(F.col("positive") | picked).select("text", "positive", picked.alias("picked"), "h").mapInArrow(held, "at array<int>, positive boolean, picked boolean, h long")
    one = found.where("positive").orderBy("h").limit(POSITIVES).withColumn("picked", F.lit(False))
    got = one.unionAll(found.where("picked").orderBy("h").limit(2 * UNLABELLED).withColumn("positive", F.lit(False))).toArrow()
    at = [np.array(x, np.int64) for x in got.column("at").to_pylist()]
    positives, unlabelled = (np.flatnonzero(got.column(c).to_numpy()) for c in ("positive", "picked"))
    rows = [at[i] for i in positives] + [at[i] for i in unlabelled]
    fitted, _ = fit(rows, np.arange(len(rows)) < len(positives), len(chosen), prior)
    weights[chosen] = fitted
    return weights, calibrated(np.array([fitted[at[i]].sum() for i in unlabelled]), prior)
