"""Language identification with error-correcting output codes.

Each language gets a codeword. For each bit of the codewords a naive Bayes classifier over hashed byte n-grams tells the languages whose bit
is 1 from those whose bit is 0. All training texts are counted, in Spark, into a table of buckets x languages, whose size does not grow with
the data. A text's bits are decoded by the loss of each codeword, each bit weighted by how well its classifier does on that language's
training texts; the nearest codeword wins, and a text whose two nearest are too close is flagged as ambiguous.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices

ORDERS = (2, 3, 4)
BUCKET_BITS = 16
SMOOTHING = 0.5
EXHAUSTIVE_UP_TO = 7
AMBIGUOUS_MARGIN = 0.05
LETTER = r"\p{L}"
UNKNOWN = "und"
STEP = 400_000  # bytes scored at once
CONFIDENT = 0.5  # nats per n-gram at which a bit counts as sure

_KEPT = np.array([c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)], np.uint8)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def codewords(languages: int) -> np.ndarray:
    """languages x bits of +1 and -1. Up to EXHAUSTIVE_UP_TO languages every split of them is a bit; beyond, the 10 log2(languages) random
    splits, of 200 draws, whose codewords are farthest apart."""
    if languages < 2:
        return np.ones((languages, 0), np.int8)
    if languages <= EXHAUSTIVE_UP_TO:
        bits = [(1, *rest) for rest in product((1, -1), repeat=languages - 1) if -1 in rest]
        return np.array(bits, np.int8).T
    rng, best, apart = np.random.default_rng(0), None, -1
    n = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        code = rng.choice(np.array([1, -1], np.int8), (languages, n))
        code = code[:, np.abs(code.sum(axis=0)) < languages]
        least = min(int((code[i] != code[j]).sum()) for i in range(languages) for j in range(i))
        if least > apart:
            best, apart = code, least
    return best


def buckets_of(text: np.ndarray) -> list[np.ndarray]:
    """For each order the bucket of the n-gram that starts at each byte."""
    codes = _KEPT[text].astype(np.uint32)
    out = []
    for order in ORDERS:
        if len(codes) < order:
            continue
        h = np.full(len(codes) - order + 1, order, np.uint32)
        for k in range(order):
            h += codes[k : len(codes) - order + 1 + k] * _MIX[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        out.append(h >> np.uint32(32 - BUCKET_BITS))
    return out


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts after one another, a space before each, and where each starts. Null is empty."""
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    lower = pc.binary_join_element_wise(space, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), nothing)), nothing)
    if isinstance(lower, pa.ChunkedArray):
        lower = lower.combine_chunks()
    offsets = np.frombuffer(lower.buffers()[1], np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.frombuffer(lower.buffers()[2], np.uint8) if lower.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _steps(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of about STEP bytes; a longer text is a run of its own."""
    first = 0
    while first < len(at) - 1:
        last = first + 1
        if at[last] - at[first] < STEP:
            last = max(last, int(np.searchsorted(at, at[first] + STEP, "right")) - 1)
        yield first, last
        first = last


def ngrams(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """first, last, buckets, numbers: the buckets of one order of the texts from first to last, text after text, and how many each text has.
    Every n-gram lies within one text. A text of more than STEP bytes comes in parts."""
    for first, last in _steps(at):
        ends = at[first + 1 : last + 1] - at[first]
        for a in range(at[first], at[last], STEP):
            for order, b in zip(ORDERS, buckets_of(data[a : min(a + STEP + ORDERS[-1] - 1, at[last])]), strict=False):
                b = b[:STEP]
                if last == first + 1:
                    yield first, last, b, np.array([len(b)])
                    continue
                over = (ends[:-1, None] - np.arange(1, order)).ravel()  # these reach into the next text
                b = np.delete(b, over[(over >= 0) & (over < len(b))])
                yield first, last, b, np.maximum(np.diff(at[first : last + 1]) - order + 1, 0)


def count_ngrams(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, counts: how often each bucket occurs in the texts of a language, as an array of longs; a row per language and task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in slices(batches):
            names = np.array(part.column(1).to_pylist(), object)
            data, at = _bytes(part.column(0))
            for name in set(names):
                mine = counts.setdefault(name, np.zeros(1 << BUCKET_BITS, np.int64))
                of_name = np.flatnonzero(names == name)
                own = np.concatenate([data[at[i] : at[i + 1]] for i in of_name])
                own_at = np.append(0, np.cumsum(np.diff(at)[of_name]))
                for _, _, b, _ in ngrams(own, own_at):
                    mine += np.bincount(b, minlength=1 << BUCKET_BITS)
        names = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([c.tobytes() for c in counts.values()], pa.binary())], ["lang", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("counts"))
        return pa.table({"lang": table.column("lang")[:1], "counts": pa.array([sums.tobytes()], pa.binary())})

    parts = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(of, "lang string, counts binary")
    # Two steps, so that no group gathers a table from every task.
    some = parts.groupBy("lang", F.pmod(F.spark_partition_id(), F.lit(16)).alias("part")).applyInArrow(summed, "lang string, counts binary")
    return some.groupBy("lang").applyInArrow(summed, "lang string, counts binary")


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages, self.code = languages, codewords(len(languages))
        shares = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        floor = SMOOTHING / max(1, int(counts.sum()))
        ones = [shares[self.code[:, b] > 0].mean(axis=0) for b in range(self.code.shape[1])]
        zeros = [shares[self.code[:, b] < 0].mean(axis=0) for b in range(self.code.shape[1])]
        bits = [np.log(one + floor) - np.log(zero + floor) for one, zero in zip(ones, zeros, strict=True)]
        self.bits = np.array(bits, np.float32).T.copy() if bits else np.zeros((1 << BUCKET_BITS, 0), np.float32)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Texts x bits: the mean log-odds of an n-gram."""
        data, at = _bytes(texts)
        sums, total = np.zeros((len(texts), self.bits.shape[1])), np.zeros(len(texts))
        for first, last, b, n in ngrams(data, at):
            some = np.flatnonzero(n)
            if len(some):
                sums[first + some] += np.add.reduceat(self.bits[b], (np.cumsum(n) - n)[some], axis=0, dtype=np.float64)
            total[first:last] += n
        return sums / np.maximum(total, 1)[:, None]


def bit_weights(margins: DataFrame, model: Model, lang: str = "lang") -> np.ndarray:
    """languages x bits: how much better than chance a bit's classifier does on the training texts of a language; rows add up to 1."""
    n_bits = model.code.shape[1]
    weights = np.full(model.code.shape, 1.0)
    right = [F.avg((F.col("margins")[b] > 0).cast("double")).alias(f"p{b}") for b in range(n_bits)]
    for row in margins.where(F.col(lang).isNotNull()).groupBy(lang).agg(*right).collect() if n_bits else []:
        i = model.languages.index(row[lang])
        for b in range(n_bits):
            weights[i, b] = max(1e-3, 2 * (row[f"p{b}"] if model.code[i, b] > 0 else 1 - row[f"p{b}"]) - 1)
    return weights / np.maximum(weights.sum(axis=1, keepdims=True), 1e-9)


def decode(margins: np.ndarray, code: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest language, its score from 0 to 1, and by how much of the loss the second is farther. The loss is logistic."""
    if code.shape[0] == 1:
        return np.zeros(len(margins), np.int64), np.ones(len(margins)), np.ones(len(margins))
    agree = np.clip(margins / CONFIDENT, -1, 1)[:, None, :] * code[None]
    loss = (np.log1p(np.exp(-4 * agree)) * weights[None]).sum(axis=2)
    order = np.argsort(loss, axis=1, kind="stable")
    first, second = (np.take_along_axis(loss, order[:, k : k + 1], axis=1)[:, 0] for k in (0, 1))
    likely = np.exp(-4 * loss)
    score = np.take_along_axis(likely, order[:, :1], axis=1)[:, 0] / likely.sum(axis=1)
    return order[:, 0], score, (second - first) / np.maximum(second, 1e-12)


def identify(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", margin: float = AMBIGUOUS_MARGIN) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, and t1, t2 (hashes of the text) for every row, repeated rows included.

    train picks the rows whose text and non-null lang are learned from; nothing else of a row but its text is an input of its prediction. A
    null text or one without a letter is UNKNOWN with score 0 and not ambiguous. With no language to learn all are UNKNOWN; with one, all
    other texts have that one. Other columns are not read. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.when(train & F.col(text).isNotNull(), F.col(lang)).alias("lang"),
        F.xxhash64(F.lit(1), F.col(text)).alias("t1"), F.xxhash64(F.lit(2), F.col(text)).alias("t2"),
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    learned = count_ngrams(rows.where(F.col("lang").isNotNull()), "text", "lang").orderBy("lang").collect()
    counts = np.array([np.frombuffer(r["counts"], np.int64) for r in learned]).reshape(len(learned), 1 << BUCKET_BITS)
    model = Model([r["lang"] for r in learned], counts)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = part.column(4)
            margins = model.margins(texts)
            has = pc.fill_null(pc.match_substring_regex(texts, LETTER), False)
            flat = pa.array(margins.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * margins.shape[1], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], has, lists], ["doc_id", "lang", "t1", "t2", "has_letter", "margins"])

    scored = rows.select("doc_id", "lang", "t1", "t2", "text").mapInArrow(score, f"doc_id {kind}, lang string, t1 long, t2 long, has_letter boolean, margins array<double>")
    scored = keep(scored, "language-margins")
    code, languages, weights = model.code, np.array([*model.languages, UNKNOWN], object), bit_weights(scored, model)

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(4).to_numpy(zero_copy_only=False) & (len(code) > 0)
            pred, sure, apart = np.full(len(has), len(code)), np.zeros(len(has)), np.ones(len(has))
            if has.any():
                margins = batch.column(5).flatten().to_numpy(zero_copy_only=False).reshape(len(has), code.shape[1])
                pred[has], sure[has], apart[has] = decode(margins[has], code, weights)
            columns = [batch.column(0), batch.column(2), batch.column(3), pa.array(languages[pred], pa.string()), pa.array(sure), pa.array(apart < margin)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "t1", "t2", "lang_pred", "score", "ambiguous"])

    return scored.mapInArrow(decided, f"doc_id {kind}, t1 long, t2 long, lang_pred string, score double, ambiguous boolean")
