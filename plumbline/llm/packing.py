"""Packing documents into sequences of a fixed number of tokens by bin completion.

All that the search needs to know of the corpus is how many pieces have each length, at most `capacity` numbers at any corpus size. It takes
the largest piece left, looks at the undominated fillings of the room beside it, least waste first, and uses the filling for as many
sequences as the counts allow at once. The waste so far bounds the branches; best-fit decreasing gives the incumbent. The pieces then find
their places by their rank among the pieces of their length, which is counted in groups of bounded size.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import keep, slices, texts_of

CAPACITY = 2048
END_ID = 0
FILLINGS = 4
TRIES_PER_FILLING = 8
LONG_FILLING = 16  # pieces beyond which a filling is not compared with others
SEARCH_NODES = 6_000
RANK_GROUP_ROWS = 2_000

Pattern = tuple[int, dict[int, int]]  # sequences that look so, pieces of each length in one


def tokenizer(ranks_path: str, pattern: str, special: dict[str, int] | None = None):
    """The byte-level BPE whose ranks are in the file, and the strings that become one id wherever they stand in a text."""
    import tiktoken

    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special or {})


def pieces(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, special: dict[str, int] | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token ids of each row's text with end_id, cut where longer than capacity; only the first
    piece of a cut document may be shorter. A null or empty text is end_id alone. Strings of special become one id each; without it they are
    ordinary text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(tokenizer(ranks_path, pattern, special).encode, allowed_special="all")
        for part in slices(batches):
            out = []
            for doc, text_ in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                ids = np.array([*encode(text_.decode("utf-8", "replace")), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                starts = [0, *range(first, len(ids), capacity)]
                for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                    out.append((doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            columns = list(zip(*out, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def least_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """No packing has fewer: the sum of lengths, and for each a the pieces that cannot share a sequence with pieces of length a or more."""
    have = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        have[length] = n
    sizes = np.arange(capacity + 1)
    number, sums = np.cumsum(have), np.cumsum(have * sizes)
    best = -(-int(sums[-1]) // capacity)
    for a in range(0, capacity // 2 + 1):
        alone = int(number[capacity] - number[capacity - a])
        large, large_sum = int(number[capacity - a] - number[capacity // 2]), int(sums[capacity - a] - sums[capacity // 2])
        small_sum = int(sums[capacity // 2] - (sums[a - 1] if a else 0))
        best = max(best, alone + large + max(0, -(-(small_sum - (large * capacity - large_sum)) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Best-fit decreasing over counts: equal sequences are filled together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_ if r >= length):
            if not left:
                break
            each, groups = room // length, open_.pop(room)
            for k, (n, pattern) in enumerate(groups):
                full = min(n, left // each)
                some = left - full * each if full < n and left - full * each else 0
                if full:
                    open_.setdefault(room - each * length, []).append((full, {**pattern, length: each}))
                if some:
                    open_.setdefault(room - some * length, []).append((1, {**pattern, length: some}))
                if rest := n - full - bool(some):
                    open_.setdefault(room, []).append((rest, pattern))
                left -= full * each + some
                if not left:
                    open_.setdefault(room, []).extend(groups[k + 1 :])
                    break
        each = capacity // length
        if left // each:
            open_.setdefault(capacity - each * length, []).append((left // each, {length: each}))
        if left % each:
            open_.setdefault(capacity - left % each * length, []).append((1, {length: left % each}))
    return [group for groups in open_.values() for group in groups]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of b fit into the single pieces of a: then a can take b's place. Tries larger pieces first, each where it fits best."""
    rooms = list(a)
    for piece in b:
        fit = min((r for r in rooms if r >= piece), default=None)
        if fit is None:
            return False
        rooms[rooms.index(fit)] = fit - piece
    return True


def fillings(counts: dict[int, int], room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated fillings of the room, least waste first; larger pieces first among equals."""
    lengths = sorted((x for x, n in counts.items() if n and x <= room), reverse=True)
    smaller = [-x for x in lengths]
    within = (1 << (room + 1)) - 1
    sums = [1] * (len(lengths) + 1)  # bit s of sums[i]: lengths[i:] can add up to s
    for i in range(len(lengths) - 1, -1, -1):
        reach, left, step = sums[i + 1], min(counts[lengths[i]], room // lengths[i]), 1
        while left:
            take = min(step, left)
            reach |= reach << (take * lengths[i])
            left, step = left - take, step * 2
        sums[i] = reach & within
    found: list[tuple[int, ...]] = []

    def add(i: int, target: int, chosen: tuple[int, ...]) -> None:
        if target == 0:
            if len(chosen) > LONG_FILLING or not any(_dominates(a, chosen) for a in found):
                found.append(chosen)
            return
        i = max(i, bisect_left(smaller, -target))
        while i < len(lengths) and len(found) < wanted:
            if sums[i] >> target & 1:
                for k in range(min(counts[lengths[i]], target // lengths[i]), 0, -1):
                    if sums[i + 1] >> (target - k * lengths[i]) & 1:
                        add(i + 1, target - k * lengths[i], chosen + (lengths[i],) * k)
                        if len(found) >= wanted or tries() <= 0:
                            return
            if not sums[i + 1] >> target & 1:
                return
            i += 1

    budget = [TRIES_PER_FILLING * most]

    def tries() -> int:
        budget[0] -= 1
        return budget[0]

    reach = sums[0]
    for _ in range(most):  # that many different wastes at most
        if not reach or len(found) >= most:
            break
        best = reach.bit_length() - 1
        wanted = min(most, len(found) + max(1, most // 2))
        budget[0] = TRIES_PER_FILLING * most
        add(0, best, ())
        reach ^= 1 << best
        if best == room and found and len(found[0]) == 1:
            break  # one piece that fills the room dominates all
    return found or [()]


def complete(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = SEARCH_NODES) -> list[Pattern]:
    """Bin completion over counts: depth first, at most `nodes` fillings are tried; the result is never worse than best_fit."""
    best = best_fit(counts, capacity)
    used, least = sum(n for n, _ in best), least_sequences(counts, capacity)
    total = sum(x * n for x, n in counts.items())
    if used == least:
        return best
    path: list[Pattern] = []
    left = dict(counts)

    def choices() -> Iterator[tuple[int, ...]]:
        largest = max(left)
        left[largest] -= 1
        options = fillings(left, capacity - largest)
        left[largest] += 1
        return iter([(largest, *x) for x in options])

    def waste(n: int, pattern: dict[int, int]) -> int:
        return n * (capacity - sum(x * k for x, k in pattern.items()))

    stack, wasted = [choices()], 0
    while stack and nodes > 0 and used > least:
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if path:
                n, pattern = path.pop()
                wasted -= waste(n, pattern)
                for x, k in pattern.items():
                    left[x] = left.get(x, 0) + n * k
            continue
        nodes -= 1
        pattern = dict(Counter(option))
        n = min(left[x] // k for x, k in pattern.items())
        path.append((n, pattern))
        wasted += waste(n, pattern)
        for x, k in pattern.items():
            left[x] -= n * k
            if not left[x]:
                del left[x]
        if wasted > (used - 1) * capacity - total:
            stack.append(iter(()))
        elif left:
            stack.append(choices())
        else:
            best, used = list(path), sum(n for n, _ in path)
            stack.append(iter(()))
    return best


def _places(patterns: list[Pattern]) -> dict[str, np.ndarray]:
    """Ranges of ranks within a length, and where a piece of such a rank goes. At most one row for each length of a pattern."""
    rows, taken, sequence = [], Counter(), 0
    for n, pattern in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            each = pattern[length]
            rows.append((length, taken[length], each, sequence, offset))
            taken[length] += n * each
            offset += each * length
        sequence += n
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "from", "each", "sequence", "offset"))}


def pack(cut: DataFrame, capacity: int = CAPACITY, nodes: int = SEARCH_NODES, rank_group_rows: int = RANK_GROUP_ROWS) -> DataFrame:
    """cut (a frame of pieces()) with sequence_id and offset. Each row is a piece of its own, repeated rows too. Sequences are filled from
    0 without gaps; no piece is dropped or cut again. An empty table gives no rows."""
    rows = keep(cut.withColumn("__id", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    places = _places(complete(counts, capacity, nodes))
    span = max(counts.values(), default=0) + 1
    starts = places["length"] * span + places["from"]

    groups = 1 + sum(counts.values()) // rank_group_rows
    rows = rows.withColumn("__group", F.pmod(F.xxhash64("__id"), F.lit(groups)))
    sizes = rows.groupBy(F.col("length").alias("__length"), F.col("__group").alias("__of")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__length").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__length", "__of", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__group").orderBy("__id"))
    ranked = rows.withColumn("__rank", rank).join(sizes, (F.col("length") == F.col("__length")) & (F.col("__group") == F.col("__of")))
    ranked = ranked.select(*cut.columns, (F.col("__before") + F.col("__rank") - 1).alias("__rank"))
    names = cut.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            ranks = batch.column(len(names)).to_numpy()
            at = np.searchsorted(starts, length * span + ranks, "right") - 1
            index = ranks - places["from"][at]
            sequence = places["sequence"][at] + index // places["each"][at]
            offset = places["offset"][at] + index % places["each"][at] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, special: dict[str, int] | None = None
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Other columns of docs are not read."""
    return pack(pieces(docs, ranks_path, pattern, doc_id, text, capacity, special=special), capacity)
