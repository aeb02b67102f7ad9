"""Near-duplicate documents by SimHash fingerprints, linked within a Hamming radius by BK-trees.

Two fingerprints within radius r agree on one of r + 1 blocks of their bits, so trees are built for shards of fingerprints that agree on a
block, and every link is inside at least one shard. A shard of more than SHARD_ROWS fingerprints is split again by blocks of its other bits.
After SPLITS splits the fingerprints of a shard can differ in at most 20 bits, which bounds it. The tree of a shard goes to the task that
searches it by shuffle; a broadcast of all trees would grow with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from plumbline.llm.common import keep, slices, texts_of, with_text_key

SEED = 42
SHARD_ROWS = 2000
SPLITS = 4
BITS = 64


def _bits_in_majority(hashes: list[int]) -> int:
    """Bit i is 1 if set in over half of the hashes; as a signed 64-bit number."""
    if not hashes:
        return 0
    counts = np.zeros(BITS, np.int64)
    values = np.array(hashes, np.uint64)
    for at in range(0, len(values), 1 << 16):
        part = values[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(values), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Words are split at ASCII white space, A-Z lower-cased. Fewer words than a shingle are one shingle; none give 0."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return _bits_in_majority([xxh64_intdigest(joined, SEED)])
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: -shingle]]]
    return _bits_in_majority([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :], strict=True)])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), fp (signed 64-bit fingerprint) for every row, repeated rows included."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [fingerprint(t, shingle) for t in texts_of(part.column(3))]
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fps, pa.int64())], ["doc_id", "t1", "t2", "fp"])

    rows = with_text_key(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")))
    return rows.select("doc_id", "t1", "t2", "text").mapInArrow(of, "doc_id long, t1 long, t2 long, fp long")


class BKTree:
    """Children keyed by their Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                below = self.children[at].get(d)
                if below is None:
                    self.children[at][d] = new
                    return
                at = below

    def within(self, value: int, radius: int) -> list[int]:
        """Places of all values at most radius away: only edges whose distance to the parent's differs by at most radius are followed."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            open_ += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]
        return found


def _roots(values: list[int], radius: int) -> list[int]:
    """For each value the smallest place of its component inside the shard."""
    tree, root = BKTree(), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, value in enumerate(values):
        for j in tree.within(value, radius):
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
        tree.add(value)
    return [top(i) for i in range(len(values))]


def _blocks(rest: Column, width: int, blocks: int) -> list[tuple[Column, Column]]:
    """The value of each block of the low `width` bits, and the other bits closed up."""
    out, low = [], 0
    for b in range(blocks):
        size = width // blocks + (b < width % blocks)
        value = F.shiftrightunsigned(rest, low).bitwiseAND(F.lit((1 << size) - 1))
        under = rest.bitwiseAND(F.lit((1 << low) - 1))
        over = F.shiftleft(F.shiftrightunsigned(rest, low + size), low) if low + size < BITS else F.lit(0).cast("long")
        out.append((value, over.bitwiseOR(under)))
        low += size
    return out


def shards(fps: DataFrame, radius: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, shard: every two fingerprints within radius share a shard."""
    blocks, width = radius + 1, BITS
    rows = fps.select("fp", F.col("fp").alias("rest"), F.lit(0).cast("long").alias("shard"))
    done = None
    for level in range(SPLITS):
        parts = _blocks(F.col("rest"), width, blocks)
        rows = rows.select(
            "fp", F.explode(F.array(*[F.struct(F.xxhash64(F.col("shard"), F.lit(i), value).alias("shard"), rest.alias("rest")) for i, (value, rest) in enumerate(parts)])).alias("b")
        ).select("fp", "b.rest", "b.shard")
        width -= width // blocks
        if level == SPLITS - 1:
            break
        rows = keep(rows, "shards")
        large = keep(rows.groupBy("shard").count().where(F.col("count") > shard_rows).select("shard"), "large-shards")
        if large.isEmpty():
            break
        fits = rows.join(large, "shard", "left_anti").select("fp", "shard")
        done = fits if done is None else done.unionByName(fits)
        rows = rows.join(large, "shard", "left_semi")
    last = rows.select("fp", "shard")
    return last if done is None else done.unionByName(last)


def links(fps: DataFrame, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """fp, to: for each shard a link from a fingerprint to the first of its component there; at most one for each row of a shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, values = None, []

        def found() -> pa.RecordBatch | None:
            if len(values) < 2:
                return None
            root = _roots([v & 0xFFFFFFFFFFFFFFFF for v in values], radius)
            pairs = [(values[i], values[r]) for i, r in enumerate(root) if r != i]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["fp", "to"]) if pairs else None

        for batch in batches:
            for key, fp in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key != shard:
                    if (out := found()) is not None:
                        yield out
                    shard, values = key, []
                values.append(fp)
        if (out := found()) is not None:
            yield out

    keyed = shards(fps, radius, shard_rows).select("shard", "fp")
    return keyed.repartition("shard").sortWithinPartitions("shard", "fp").mapInArrow(search, "fp long, to long")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root: the smallest node that each node of an edge reaches. Alternates large and small stars until no edge changes."""
    edges = keep(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi <> lo").distinct(), "edges")
    before = None
    while True:
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or seen["n"] == 0:
            return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
        before = seen
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = keep(both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct(), "large-star")
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
        edges = keep(small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 3, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, t1, t2, fp, root, component_id for every row of docs.

    root is one fingerprint of the component, component_id the smallest doc_id in it. Null and empty texts have fingerprint 0 and are linked
    like others. Repeated rows stay, each with its component. A null doc_id takes part and is never the smallest, unless all are null. Other
    columns are not read. An empty table gives no rows.
    """
    rows = keep(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    firsts = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = components(links(firsts, radius, shard_rows), "fp", "to").withColumnRenamed("node", "fp")
    rooted = keep(firsts.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = keep(rooted.join(least, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(classes, "fp").select("doc_id", "t1", "t2", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without all but one row of each component: the one with the smallest doc_id stays, nulls last, then the smallest text hash.
    Rows equal in doc_id and text count as one."""
    found = near_duplicates(docs, doc_id, text, **how)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "t1", "t2")).alias("k")).select("k.doc_id", "k.t1", "k.t2")
    first = keep(first.select(F.col("doc_id").alias("__d"), F.col("t1").alias("__a"), F.col("t2").alias("__b")), "first-of-each")
    keyed = with_text_key(docs, text, "__t1", "__t2").withColumn("__k", F.col(doc_id).cast("long"))
    kept = keyed.join(first, (keyed["__k"].eqNullSafe(first["__d"])) & (keyed["__t1"] == first["__a"]) & (keyed["__t2"] == first["__b"]), "left_semi")
    return kept.dropDuplicates(["__k", "__t1", "__t2"]).select(*docs.columns)
