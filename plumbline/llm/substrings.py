"""Removing passages of words that repeat anywhere in the corpus, found by difference-cover anchors.

D is a difference cover of the period v: any two numbers have a shift below v that brings both onto D modulo v. So two equal passages of
`window` words share an anchor, a run of window - v + 1 words that starts on a cover position in both documents, and only anchors at cover
positions need be compared. Passages around repeated anchors are then extended to whole windows and compared as such, by 128-bit hashes.
No pairs are made: equal hashes meet in a bucket, where each learns only whether it is alone. A task tells each repeated hash of its own once
per CHUNK_WORDS words, so a passage in a third of all documents is a few entries of its bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

from plumbline.llm.common import MOST_CACHED_WORDS, keep, slices, texts_of, total, with_text_key

WINDOW = 35
PERIOD = 21
COVER = (3, 6, 7, 12, 14)  # its differences modulo 21 are 0 to 20
CHUNK_WORDS = 2_000_000
BUCKET_BYTES = 16_000_000
LEAST_BUCKETS = 12
BASE = 0x9E3779B97F4A7C15

ENTRIES = "bucket int, hash binary, pos binary, doc binary, alone binary, texts binary"
FOUND = "part int, t1 binary, t2 binary, pos binary"


class WordHashes:
    """Two 64-bit hashes of each word, computed once per word while the cache lasts. The table doubles when it is full."""

    def __init__(self):
        self.place: dict[bytes, int] = {}
        self.table = np.zeros((2, 1 << 12), np.uint64)

    def of(self, words: list[bytes]) -> np.ndarray:
        new = set(words).difference(self.place)
        if new and len(self.place) + len(new) > MOST_CACHED_WORDS:
            self.__init__()
            new = set(words)
        for w in new:
            at = self.place[w] = len(self.place)
            if at == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
            h = xxh3_128_intdigest(w)
            self.table[0, at], self.table[1, at] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
        return self.table[:, [self.place[w] for w in words]]


class Rolling:
    """Hashes of runs of words: a polynomial modulo 2 ** 64 over word hashes, mixed at the end."""

    def __init__(self):
        self.powers = self.inverses = np.ones(1, np.uint64)

    def of(self, hashes: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        n = len(hashes) + 1
        if n > len(self.powers):
            self.powers, self.inverses = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.powers[: n - 1])])
        x = (sums[at + length] - sums[at]) * self.inverses[at]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def _groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each run of equal ones starts."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        s = key[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


class _Chunk:
    """Collects hashes with their texts and positions, and gives them out by bucket once there are enough."""

    def __init__(self, buckets: int, width: int):
        self.buckets, self.width = buckets, width
        self.clear()

    def clear(self) -> None:
        self.texts: list[tuple[int, int]] = []
        self.known: set[tuple[int, int]] = set()
        self.hashes: list[list[np.ndarray]] = [[] for _ in range(self.width)]
        self.pos: list[np.ndarray] = []
        self.doc: list[np.ndarray] = []
        self.words = 0

    def add(self, text: tuple[int, int], hashes: list[np.ndarray], pos: np.ndarray, words: int) -> None:
        for mine, new in zip(self.hashes, hashes, strict=True):
            mine.append(new)
        self.pos.append(pos.astype(np.uint32))
        self.doc.append(np.full(len(pos), len(self.texts), np.uint32))
        self.texts.append(text)
        self.words += words

    def entries(self) -> Iterator[pa.RecordBatch]:
        """For each bucket: one entry for a hash that is alone in the chunk; of others the first, marked as not alone, and every place of
        a text that did not have the same text before it in the chunk."""
        if not self.words:
            return
        keys = [np.concatenate(h) for h in self.hashes]
        pos, doc = np.concatenate(self.pos), np.concatenate(self.doc)
        texts = np.array(self.texts, np.int64).reshape(-1, 2)
        first_of_text = np.zeros(len(texts), bool)
        first_of_text[np.unique(texts, axis=0, return_index=True)[1]] = True
        order, starts = _groups(keys)
        sizes = np.diff(np.append(starts, len(order)))
        alone = np.repeat(sizes == 1, sizes)
        first = np.zeros(len(order), bool)
        first[starts] = True
        use = order[alone | first | first_of_text[doc[order]]]
        is_alone = np.zeros(len(order), bool)
        is_alone[order] = alone
        bucket = ((keys[0][use] >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        by_bucket = np.argsort(bucket, kind="stable")
        use, bucket = use[by_bucket], bucket[by_bucket]
        bounds = np.searchsorted(bucket, np.arange(self.buckets + 1))
        for b in range(self.buckets):
            part = use[bounds[b] : bounds[b + 1]]
            if len(part):
                part = part[np.argsort(doc[part], kind="stable")]
                there, docs = np.unique(doc[part], return_inverse=True)
                fields = [np.concatenate([k[part] for k in keys]), pos[part], docs.astype(np.uint32), is_alone[part], texts[there].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), *[pa.array([f.tobytes()], pa.binary()) for f in fields]], ["bucket", "hash", "pos", "doc", "alone", "texts"])
        self.clear()


def _distinct(t1: np.ndarray, t2: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each place once, ordered by text and position."""
    order, starts = _groups([t1, t2, pos])
    return tuple(x[order[starts]] for x in (t1, t2, pos))


def _repeated(width: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Of a bucket's entries, the places whose hash another entry has or that were not alone in their chunk, once for each text. They leave
    in a row for each part of the texts."""

    def of(table: pa.Table) -> pa.Table:
        keys, pos, text, alone = [[] for _ in range(width)], [], [], []
        for row in table.select(["hash", "pos", "doc", "alone", "texts"]).to_batches():
            for h, p, d, a, t in zip(*[c.to_pylist() for c in row.columns], strict=True):
                h = np.frombuffer(h, np.uint64).reshape(width, -1)
                for mine, new in zip(keys, h, strict=True):
                    mine.append(new)
                pos.append(np.frombuffer(p, np.uint32))
                alone.append(np.frombuffer(a, bool))
                text.append(np.frombuffer(t, np.int64).reshape(-1, 2)[np.frombuffer(d, np.uint32)])
        keys, pos, text, alone = [np.concatenate(k) for k in keys], np.concatenate(pos), np.concatenate(text), np.concatenate(alone)
        order, starts = _groups(keys)
        sizes = np.diff(np.append(starts, len(order)))
        use = order[np.repeat(sizes > 1, sizes) | ~alone[order]]
        t1, t2, pos = _distinct(text[use, 0], text[use, 1], pos[use])
        part = (t1 % parts).astype(np.int32)
        by_part = np.argsort(part, kind="stable")
        bounds = np.searchsorted(part[by_part], np.arange(parts + 1))
        out = [(i, *[x[by_part[bounds[i] : bounds[i + 1]]].tobytes() for x in (t1, t2, pos)]) for i in range(parts) if bounds[i] < bounds[i + 1]]
        return pa.table({name: pa.array([r[i] for r in out], kind) for i, (name, kind) in enumerate([("part", pa.int32()), ("t1", pa.binary()), ("t2", pa.binary()), ("pos", pa.binary())])})

    return of


def _merged(table: pa.Table) -> pa.Table:
    """t1, t2, at: all places of each text."""
    t1, t2, pos = (np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()]) for name, kind in (("t1", np.int64), ("t2", np.int64), ("pos", np.uint32)))
    t1, t2, pos = _distinct(t1, t2, pos)
    new = np.ones(len(pos), bool)
    new[1:] = (t1[1:] != t1[:-1]) | (t2[1:] != t2[:-1])
    heads = np.flatnonzero(new)
    at = pa.ListArray.from_arrays(pa.array(np.append(heads, len(pos)).astype(np.int32)), pa.array(pos.astype(np.int32)))
    return pa.Table.from_arrays([pa.array(t1[heads]), pa.array(t2[heads]), at], ["t1", "t2", "at"])


def _by_text(entries: DataFrame, width: int, parts: int) -> DataFrame:
    """t1, t2, at: all repeated places of a text. Buckets answer to as many parts of the texts as there are buckets."""
    found = entries.groupBy("bucket").applyInArrow(_repeated(width, parts), FOUND)
    return found.groupBy("part").applyInArrow(_merged, "t1 long, t2 long, at array<int>")


def _anchor_entries(texts: DataFrame, window: int, buckets: int, chunk_words: int) -> DataFrame:
    run = window - PERIOD + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, hashes, rolling, cover = _Chunk(buckets, 1), WordHashes(), Rolling(), np.array(COVER)
        for part in slices(batches):
            for t1, t2, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2)), strict=True):
                words = text.split()
                if len(words) < window:
                    continue
                at = (np.arange(0, len(words), PERIOD)[:, None] + cover).ravel()
                at = at[at + run <= len(words)]
                chunk.add((t1, t2), [rolling.of(hashes.of(words)[0], at, run)], at, len(words))
                if chunk.words >= chunk_words:
                    yield from chunk.entries()
        yield from chunk.entries()

    return texts.select("t1", "t2", "text").mapInArrow(of, ENTRIES)


def _window_entries(texts: DataFrame, window: int, buckets: int, chunk_words: int) -> DataFrame:
    """The windows that hold one of the anchors at the places in `at`."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, hashes, rolling = _Chunk(buckets, 2), WordHashes(), Rolling()
        for part in slices(batches):
            for t1, t2, text, anchors in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts_of(part.column(2)), part.column(3), strict=True):
                words = text.split()
                edges = np.zeros(len(words) + 2, np.int64)
                anchors = anchors.values.to_numpy()
                np.add.at(edges, np.maximum(anchors - PERIOD + 1, 0), 1)
                np.add.at(edges, anchors + 1, -1)
                at = np.flatnonzero(np.cumsum(edges)[: len(words) - window + 1] > 0)
                chunk.add((t1, t2), [rolling.of(h, at, window) for h in hashes.of(words)], at, len(words))
                if chunk.words >= chunk_words:
                    yield from chunk.entries()
        yield from chunk.entries()

    return texts.select("t1", "t2", "text", "at").mapInArrow(of, ENTRIES)


def _kept(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, n_removed, kept_hash, kept_text = [], [], [], []
            for text, starts in zip(texts_of(part.column(2)), part.column(3), strict=True):
                words = text.split()
                if starts.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    at = starts.values.to_numpy()
                    np.add.at(edges, at, 1)
                    np.add.at(edges, at + window, -1)
                    keep_ = np.cumsum(edges)[: len(words)] == 0
                    left = [w for w, k in zip(words, keep_.tolist(), strict=True) if k]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                joined = b" ".join(left)
                kept_hash.append(hashlib.sha256(joined).hexdigest())
                kept_text.append(joined.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:2], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_hash), pa.array(kept_text)],
                ["t1", "t2", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    return of


def _bucket_count(entries: float, width: int) -> int:
    return max(LEAST_BUCKETS, round(entries * (8 * width + 9) / BUCKET_BYTES))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) for every row, repeated rows included.

    A word goes if a window of `window` words around it starts at a second place, in the same or another row; rows of equal text count as
    other rows, whatever their doc_id. Words are split at ASCII white space and joined by one space. Null and empty texts have no words. A
    text of fewer words than a window stays whole. Other columns are not read. An empty table gives no rows.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    rows = with_text_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    words = total(rows, _words("text"))
    buckets = _bucket_count(words * len(COVER) / PERIOD, 1)
    near = keep(_by_text(_anchor_entries(rows, window, buckets, chunk_words), 1, buckets), "repeated-anchors")
    # Rows of one text stay rows of their own here, because each is a second place for the windows of the others.
    near_rows = keep(rows.join(near, ["t1", "t2"]).select("t1", "t2", "text", "at"), "texts-with-repeats")
    buckets = _bucket_count(total(near_rows, F.size("at").cast("long")) * PERIOD / len(COVER), 2)
    starts = _by_text(_window_entries(near_rows, window, buckets, chunk_words), 2, buckets).withColumnRenamed("at", "starts")
    finished = near_rows.drop("at").join(starts, ["t1", "t2"]).select("t1", "t2", "text", "starts")
    changed = finished.mapInArrow(_kept(window), "t1 long, t2 long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    whole = rows.withColumn("starts", F.lit(None).cast("array<int>"))
    plain = whole.select("t1", "t2", "text", "starts", "doc_id")
    extra = ["kept_text"] if with_text else []
    changed = keep(changed.select("t1", "t2", "n_removed", "kept_sha256", *extra).dropDuplicates(["t1", "t2"]), "changed-texts")
    return _with_changes(plain, changed, window, extra)


def _with_changes(rows: DataFrame, changed: DataFrame, window: int, extra: list[str]) -> DataFrame:
    """Every row as it is, with what changed in its text put in place."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for done in _kept(window)(iter([part])):
                yield pa.RecordBatch.from_arrays([part.column(4), *done.columns[:3], *[done.column(n) for n in ["kept_sha256", *extra]]], ["doc_id", "t1", "t2", "n_words", "kept_sha256", *extra])

    kind = rows.schema["doc_id"].dataType.simpleString()
    plain = rows.mapInArrow(of, f"doc_id {kind}, t1 long, t2 long, n_words long, kept_sha256 string" + ", kept_text string" * bool(extra))
    new = changed.select(F.col("t1"), F.col("t2"), "n_removed", *[F.col(n).alias(f"new_{n}") for n in ["kept_sha256", *extra]])
    both = plain.join(new, ["t1", "t2"], "left")
    return both.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), *[F.coalesce(f"new_{n}", n).alias(n) for n in ["kept_sha256", *extra]])


def _words(text: str) -> Column:
    """About as many as the text has words: one in six bytes. It sets only how many buckets there are."""
    return F.coalesce(F.octet_length(text), F.lit(0)) / 6
