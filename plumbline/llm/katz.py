"""Scoring texts with a Katz backoff model of their own corpus.

Counts up to MOST_DISCOUNTED are discounted by Good and Turing's estimate, larger ones are not. What a history's discounts leave goes to the
words not seen after it, in proportion to the model one word shorter: its backoff weight is that rest over what the shorter model gives to
those words, so each history's probabilities sum to one. A history all of whose counts are larger is counted once more, to leave something. At
the lowest order the rest is the probability of any word not seen at all.

The corpus is cut into blocks of BLOCK_TOKENS tokens, each written once as word hashes and places in them. Of each order a block tells its
different n-grams, sorted by a 64-bit hash and packed, to buckets by hash, where the counts of all blocks meet; the answer comes back in
the order of the question, so it needs no keys. Counts and then, order by order, backoff weights are tables partitioned by order and bucket.
Each n-gram belongs to the first block that asks for it, which adds its share to its history; so a history's sums are made of one packed
row per block, however many words follow it. A block then has all that the recursion asks for its tokens. No table goes to the driver but
the counts of counts, a few numbers for each order. Two n-grams of one 64-bit hash would be taken for one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from plumbline.llm.common import keep, slices, texts_of, total

ORDER = 2
MOST_DISCOUNTED = 5
BLOCK_TOKENS = 3 << 19
BUCKET_BYTES = 1 << 21  # of packed tokens, for each bucket
LEAST_BUCKETS = 32

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
# No word holds a blank.
BEGIN, END = (np.uint64(xxh3_64_intdigest(mark)) for mark in (b" <", b" >"))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

COUNTS, WEIGHTS = "counts", "weights"
ASKED = "level int, bucket int, block bigint, keys binary, x binary, y binary, z binary"
TOLD = "what string, level int, bucket int, block bigint, x binary, y binary, stats array<bigint>"


# ---- packing ----


def pack(a: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return len(a).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def unpack(b: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(b[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Best where the numbers are in order; any are given back."""
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


# ---- the model ----


def discounts(counts_of_counts: list[int], most: int = MOST_DISCOUNTED) -> np.ndarray:
    """Good and Turing's discounts of the counts 1, 2, ..., from how many n-grams have each.

    The largest bound up to ``most`` is taken for which all discounts lie between 0 and 1. Where there is none, as in a small corpus, half of
    each single count is left.
    """
    n = [0, *counts_of_counts]
    for k in range(most, 0, -1):
        if any(x <= 0 for x in n[1 : k + 2]):
            continue
        rest = (k + 1) * n[k + 1] / n[1]
        d = np.array([((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) if rest < 1 else 0.0 for r in range(1, k + 1)])
        if ((d > 0) & (d < 1)).all():
            return d
    return np.array([0.5])


class Order:
    """What is known of all n-grams of one order: sums over the corpus and the discounts."""

    def __init__(self, stats: list[int]):
        self.tokens, self.types = stats[:2]
        self.discounts = discounts(stats[2:])
        left = sum(r * n * (1 - d) for r, (n, d) in enumerate(zip(stats[2:], self.discounts, strict=False), 1))
        self.left = float(left) if self.tokens else 0.0

    def left_of(self, counts: np.ndarray) -> np.ndarray:
        """What the discount takes from each count."""
        out, some = np.zeros(len(counts)), (counts > 0) & (counts <= len(self.discounts))
        out[some] = counts[some] * (1 - self.discounts[counts[some] - 1])
        return out


class Grams:
    """The different n-grams of a block by order: where each token's is, what comes before its last word and after its first, and its hash."""

    def __init__(self, block: dict, order: int):
        words, tokens, lengths = unpack_sorted(block["words"]), unpack(block["tokens"], np.int32).astype(np.int64), unpack(block["lengths"], np.int32).astype(np.int64)
        self.train = np.repeat(np.frombuffer(block["train"], np.bool_), lengths + 1)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        stream = np.insert(tokens, starts - np.arange(len(starts)), len(words))  # each text begins with a mark
        self.place = np.arange(len(stream)) - np.repeat(starts, lengths + 1)
        self.lengths = lengths
        self.of, self.history, self.shorter, self.keys, self.counts = [None, stream], [None, None], [None, None], [None, np.append(words, BEGIN)], [None]
        self.counts.append(np.bincount(stream[self.train], minlength=len(words) + 1))
        for m in range(2, order + 1):
            at = np.flatnonzero(self.place >= m - 1)
            before, last = self.of[m - 1][at - 1], self.of[m - 1][at]
            pairs, first, codes = np.unique(before * len(self.keys[m - 1]) + last, return_index=True, return_inverse=True)
            self.history.append(pairs // len(self.keys[m - 1]))
            self.shorter.append(pairs % len(self.keys[m - 1]))
            h = (self.keys[m - 1][self.history[m]] ^ _MIX[0]) * _MIX[1] + self.keys[1][stream[at[first]]]
            h ^= h >> np.uint64(30)
            h *= _MIX[2]
            self.keys.append(h ^ (h >> np.uint64(31)))
            whole = np.full(len(stream), -1, np.int64)
            whole[at] = codes
            self.of.append(whole)
            self.counts.append(np.bincount(codes[self.train[at]], minlength=len(pairs)))

    def orders(self) -> range:
        return range(1, len(self.of))


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys, and where in it each bucket begins: buckets are ranges of hashes."""
    order = np.argsort(keys, kind="stable")
    edges = [np.uint64(min((b << 64) // buckets, (1 << 64) - 1)) for b in range(1, buckets)]
    return order, np.concatenate([[0], np.searchsorted(keys[order], np.array(edges, np.uint64)), [len(keys)]])


def questions(level: int, block: int, keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[dict]:
    """A row for each bucket: its keys in order, with up to three values of each."""
    order, edges = by_bucket(keys, buckets)
    for b in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        some = order[edges[b] : edges[b + 1]]
        yield {"level": level, "bucket": b, "block": block, "keys": pack_sorted(keys[some])} | {c: pack(v[some]) for c, v in zip("xyz", values, strict=False)}


def answered(told: list[dict], what: str, level: int, column: str, kind: type) -> np.ndarray:
    """What the buckets say to a block, in the order of the hashes asked for."""
    rows = sorted((r for r in told if (r["what"], r["level"]) == (what, level)), key=lambda r: r["bucket"])
    return np.concatenate([np.empty(0, kind), *(unpack(r[column], kind) for r in rows)])


def counted(rows: list[dict]) -> list[dict]:
    """Of one bucket and order: the count of each n-gram over all blocks, and whether the asking block was the first."""
    rows = sorted(rows, key=lambda r: r["block"])
    keys, counts = [unpack_sorted(r["keys"]) for r in rows], [unpack(r["x"], np.int64) for r in rows]
    whole = np.concatenate(keys)
    different, first, at = np.unique(whole, return_index=True, return_inverse=True)
    sums = np.bincount(at, np.concatenate(counts).astype(np.float64), len(different)).astype(np.int64)  # exact below 2 ** 53
    owned = np.zeros(len(whole), np.bool_)
    owned[first] = True
    events = sums[(sums > 0) & (different != BEGIN)]
    stats = [int(events.sum()), len(events), *np.bincount(events[events <= MOST_DISCOUNTED + 1], minlength=MOST_DISCOUNTED + 2)[1:].tolist()]
    edges = np.cumsum([0, *map(len, keys)])
    each = [(r, slice(edges[i], edges[i + 1])) for i, r in enumerate(rows)]
    return [_answer(COUNTS, r, sums[at[own]], owned[own], stats if own.start == 0 else None) for r, own in each]


def weighed(rows: list[dict]) -> list[dict]:
    """Of one bucket of histories: whether nothing was left of each, so that one is set aside; and where the asking block needs it, what is left
    over what the shorter model gives to the words not seen after it."""
    rows = sorted(rows, key=lambda r: r["block"])
    keys, needed = [unpack_sorted(r["keys"]) for r in rows], [unpack(r["z"], np.bool_) for r in rows]
    different, at = np.unique(np.concatenate(keys), return_inverse=True)
    left, lower = (np.bincount(at, np.concatenate([unpack(r[c], np.float64) for r in rows]), len(different)) for c in "xy")
    weight = np.where(left > 0, left, 1.0) / np.maximum(1 - lower, 1e-300)
    edges = np.cumsum([0, *map(len, keys)])
    each = [(r, at[edges[i] : edges[i + 1]], need) for i, (r, need) in enumerate(zip(rows, needed, strict=True))]
    return [_answer(WEIGHTS, r, left[own] <= 0, weight[own[need]], None) for r, own, need in each]


def _answer(what: str, asked: dict, x: np.ndarray, y: np.ndarray, stats: list[int] | None) -> dict:
    return {"what": what, "level": asked["level"], "bucket": asked["bucket"], "block": asked["block"], "x": pack(x), "y": pack(y), "stats": stats}


class Block:
    """A block's n-grams with all that the buckets have said so far, its probabilities as far as that goes."""

    def __init__(self, block: dict, told: list[dict], orders: list[Order]):
        self.number, self.grams = block["block"], Grams(block, len(orders))
        self.orders, self.told = orders, told
        g, first = self.grams, orders[0]
        self.counts, self.owned = [None], [None]
        for m in g.orders():
            order = np.argsort(g.keys[m], kind="stable")
            counts, owned = np.empty(len(order), np.int64), np.empty(len(order), np.bool_)
            counts[order], owned[order] = answered(told, COUNTS, m, "x", np.int64), answered(told, COUNTS, m, "y", np.bool_)
            self.counts.append(counts)
            self.owned.append(owned)
        c, times = self.counts[1], first.tokens + (first.left <= 0)
        self.p = [None, np.where(c > 0, c - first.left_of(c), first.left if first.left > 0 else 1.0) / times]

    def histories(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """The (m - 1)-grams that are histories of order m, by their hashes, and of which the block needs the weight: a word follows that the
        corpus does not have there."""
        g = self.grams
        which = np.unique(g.history[m])
        which = which[np.argsort(g.keys[m - 1][which], kind="stable")]
        need = np.zeros(len(g.keys[m - 1]), np.bool_)
        need[g.history[m][self.counts[m] == 0]] = True
        return which, need[which]

    def shares(self, m: int) -> tuple[np.ndarray, ...]:
        """For each history of order m: its hash, what its discounts leave, and what the shorter model gives to the words seen after it, both
        over the n-grams that belong to this block; whether its weight is needed."""
        g, own = self.grams, self.owned[m] & (self.counts[m] > 0)
        (which, need), n = self.histories(m), len(g.keys[m - 1])
        left = np.bincount(g.history[m][own], self.orders[m - 1].left_of(self.counts[m][own]), n)
        lower = np.bincount(g.history[m][own], self.p[m - 1][g.shorter[m][own]], n)
        return g.keys[m - 1][which], left[which], lower[which], need

    def extend(self, m: int) -> None:
        """The probabilities of order m, from the weights of its histories."""
        g, (which, need), n = self.grams, self.histories(m), len(self.grams.keys[m - 1])
        aside, weight = np.zeros(n, np.bool_), np.ones(n)
        aside[which], weight[which[need]] = answered(self.told, WEIGHTS, m, "x", np.bool_), answered(self.told, WEIGHTS, m, "y", np.float64)
        seen = self.counts[m - 1]
        times = np.maximum(seen + aside, 1).astype(np.float64)
        backoff = np.where(seen > 0, weight / times, 1.0)
        c, h = self.counts[m], g.history[m]
        direct = (c - self.orders[m - 1].left_of(c)) / times[h]
        self.p.append(np.where(c > 0, direct, backoff[h] * self.p[m - 1][g.shorter[m]]))

    def scores(self) -> tuple[np.ndarray, ...]:
        """Of each text: tokens, known tokens, log10 of the base model and of this one."""
        g, first = self.grams, self.orders[0]
        p = self.p[1][g.of[1]]
        for m in range(2, len(g.of)):
            at = g.of[m] >= 0
            p[at] = self.p[m][g.of[m][at]]
        token = g.place > 0
        text = np.repeat(np.arange(len(g.lengths)), g.lengths)
        c = self.counts[1][g.of[1][token]]
        each = lambda w: np.bincount(text, w, len(g.lengths))
        base = np.log10((c + 1) / (first.tokens + first.types + 1))
        return g.lengths, each(c > 0).astype(np.int64), each(base), each(np.log10(p[token]))


# ---- tables ----


def _blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def fresh() -> None:
        nonlocal known, ids, train, lengths, tokens, size
        known = defaultdict(count().__next__)
        ids, train, lengths, tokens, size = [], [], [], [], 0

    known = ids = train = lengths = tokens = size = None
    fresh()
    block = TaskContext.get().partitionId() << 24

    def written() -> pa.RecordBatch:
        codes, n = np.concatenate(tokens), len(known)
        rank = np.empty(n, np.int32)  # frequent words get small numbers, which pack well
        hashes = np.fromiter((END if w is None else xxh3_64_intdigest(w) for w in known), np.uint64, n)
        order = np.lexsort((hashes, -np.bincount(codes, minlength=n)))  # equally frequent ones by hash
        rank[order] = np.arange(n, dtype=np.int32)
        row = {"block": block, "ids": ids, "train": np.array(train, np.bool_).tobytes(), "lengths": pack(np.array(lengths, np.int32)), "tokens": pack(rank[codes]), "words": pack_sorted(hashes[order])}
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in slices(batches):
        for id, text, learned in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            words = text.translate(LOWER).split()
            codes = np.fromiter(map(known.__getitem__, (*words, None)), np.int32, len(words) + 1)
            ids.append(id)
            train.append(learned)
            lengths.append(len(codes))
            tokens.append(codes)
            size += len(codes)
            if size >= BLOCK_TOKENS:
                yield written()
                fresh()
                block += 1
    if ids:
        yield written()


def _each(rows: DataFrame, schema: str, of_rows) -> DataFrame:
    """of_rows over the rows of each order and bucket."""
    arrow = _arrow(rows.sparkSession, schema)
    return rows.groupBy("level", "bucket").applyInArrow(lambda table: pa.Table.from_pylist(of_rows(table.to_pylist()), arrow), schema)


def _met(blocks: DataFrame, told: DataFrame, schema: str, orders: list[Order], of_block) -> DataFrame:
    """of_block over each block with what the buckets have said to it."""
    arrow = _arrow(blocks.sparkSession, schema)

    def task(block: pa.Table, said: pa.Table) -> pa.Table:
        rows = block.to_pylist()
        return pa.Table.from_pylist([x for b in rows for x in of_block(Block(b, said.to_pylist(), orders), b)], arrow)

    return blocks.groupBy("block").cogroup(told.drop("stats").groupBy("block")).applyInArrow(task, schema)


def score(docs: DataFrame, train: Column, id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """A row for each row of docs: id, train, n_tokens, n_known, train_tokens, base_score, score. train says which rows are learned from.

    Words are separated by ASCII white space, A to Z in lower case; each text ends with one more token. n_known counts tokens that stand in the
    texts learned from, train_tokens all of theirs. base_score adds one to each count; score is the log10 probability by the model of the
    given order. A null text counts as empty, and has the end alone; nothing to learn from leaves every token unknown with probability one;
    a null in train counts as false. Repeated rows and ids are each counted and answered; an empty table gives no rows; other columns are not
    read. A text is held whole in its block, so a block is as large as its longest text at least. Scores do not depend on the partitioning but
    for the last digits.
    """
    cells = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind, spark = cells.schema["id"].dataType.simpleString(), docs.sparkSession
    spec = f"block bigint, ids array<{kind}>, train binary, lengths binary, tokens binary, words binary"
    written, asked = _arrow(spark, spec), _arrow(spark, ASKED)
    blocks = keep(cells.mapInArrow(lambda batches: _blocks(batches, written), spec), "blocks")
    buckets = LEAST_BUCKETS + total(blocks, F.length("tokens")) // BUCKET_BYTES

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for block in batch.to_pylist():
                g = Grams(block, order)
                for m in g.orders():
                    yield pa.RecordBatch.from_pylist(list(questions(m, block["block"], g.keys[m], buckets, g.counts[m].astype(np.int64))), asked)

    told = keep(_each(blocks.mapInArrow(ask, ASKED), TOLD, counted), "counts")
    sums = told.where("stats IS NOT NULL").select("level", F.posexplode("stats").alias("i", "n")).groupBy("level", "i").agg(F.sum("n").alias("n")).collect()
    stats = {(r["level"], r["i"]): r["n"] for r in sums}
    orders = [Order([stats.get((m, i), 0) for i in range(MOST_DISCOUNTED + 3)]) for m in range(1, order + 1)]

    for m in range(2, order + 1):

        def shared(block: Block, _: dict, m: int = m) -> Iterator[dict]:
            for shorter in range(2, m):
                block.extend(shorter)
            keys, *values = block.shares(m)
            yield from questions(m, block.number, keys, buckets, *values)

        shares = _met(blocks, told, ASKED, orders, shared)
        told = told.unionByName(keep(_each(shares, TOLD, weighed), "weights"))

    def scored(block: Block, row: dict) -> Iterator[dict]:
        for m in range(2, order + 1):
            block.extend(m)
        names = ("id", "train", "n_tokens", "n_known", "base_score", "score")
        columns = row["ids"], np.frombuffer(row["train"], np.bool_).tolist(), *(a.tolist() for a in block.scores())
        yield from (dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True))

    out = _met(blocks, told, f"id {kind}, train boolean, n_tokens bigint, n_known bigint, base_score double, score double", orders, scored)
    return out.select(F.col("id").alias(id), "train", "n_tokens", "n_known", F.lit(orders[0].tokens).cast("bigint").alias("train_tokens"), "base_score", "score")


def _arrow(spark, spec: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(spec))
