"""Periodic runs in a text, found online by a sparse dynamic programme over diagonals.

The words of a text are compared with the same text moved by a lag. On the diagonal of one lag the match length at a word is that at the word
before plus one if the two words are equal, else nothing. Read from left to right, a word lengthens the diagonals of the lags at which it has
occurred, and a diagonal that ends with enough matches is a run and is told at once.

The programme is sparse: of a word's earlier occurrences only those are visited that can carry a run. A run has at least LEAST_PERIODS
periods, so its diagonal of lag d matches at least 2 d words. For the lags d from c / 2 to c, a power of two, a word therefore counts as
occurring only where the c words up to it are the same, and of these occurrences only the latest matters: were a nearer one on the same run,
then by Fine and Wilf's theorem the run would repeat with the greatest common divisor of both lags, and d would not be its smallest period.
So a word visits at most one lag per c, the active diagonal of each c is one number, and the smallest period comes without a second check.
The time is in proportion to the words times their logarithm, also where a text is one word a million times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import slices, texts_of

LEAST_WORDS = 24
LEAST_PERIODS = 3

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def first_context(least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> int:
    """The largest power of two such that a run of any lag up to it matches at least so many words."""
    c = 1
    while all(max(least_words - d, (least_periods - 1) * d) >= 2 * c for d in range(1, 2 * c + 1)):
        c *= 2
    return c


def _may_repeat(words: np.ndarray, context: int) -> bool:
    """Whether any `context` words may occur twice: equal ones have equal hashes."""
    h, c = words.astype(np.uint64) + np.uint64(1), 1
    while c < context:
        h = (h[:-c] * _MIX + h[c:]) * _MIX
        h ^= h >> np.uint64(29)
        c *= 2
    return len(np.unique(h)) < len(h)


def _latest(grams: np.ndarray) -> np.ndarray:
    """How far back the same value last stood; 0 where it stands for the first time."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    lags = np.zeros(len(grams), np.int64)
    lags[order[1:]] = np.where(s[1:] == s[:-1], order[1:] - order[:-1], 0)
    return lags


def runs_of(words: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start and period. words are numbers, equal for equal words.

    A run is a stretch of at least least_words words and least_periods periods that no neighbouring word extends. least_periods is 3 or more.
    """
    if least_periods < 3:
        raise ValueError("a run has at least three periods")
    first = first_context(least_words, least_periods)
    if len(words) < max(least_words, first + 1) or not _may_repeat(words, first):
        return []
    out: list[tuple[int, int, int]] = []

    def end(start: int, matched: int, lag: int) -> None:
        if matched + lag >= max(least_words, least_periods * lag):
            out.append((start - lag, matched + lag, lag))

    grams, c = np.unique(words, return_inverse=True)[1], 1  # grams[i]: the c words from word i
    while True:
        if c >= first:
            lags = _latest(grams)
            if not lags.any():  # nor do longer contexts occur twice
                break
            near = np.flatnonzero((lags <= c) & (lags > (c // 2 if c > first else 0)))
            # The word at i + c - 1 stood `lag` words before, after the same c - 1 words. start: first word that matches on the active diagonal.
            start = active = last = -1
            for i, lag in zip(near.tolist(), lags[near].tolist(), strict=True):
                if lag != active or i != last + 1:
                    if active > 0:
                        end(start, last - start + c, active)
                    start, active = i, lag
                last = i
            if active > 0:
                end(start, last - start + c, active)
        if c >= first and least_periods * (c + 1) > len(words):
            break
        grams = np.unique(grams[:-c] * (len(words) + 1) + grams[c:], return_inverse=True)[1]
        c *= 2
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """A row for each row of docs: id, n_words, runs (array of start, length, period in words, by start and period), kept_text.

    Words are separated by ASCII white space. kept_text holds the words that stay when of each run only its first period is kept, joined by one
    space. Overlapping runs are all told, and a word goes if any of them drops it. A null, empty or blank text has no words, no runs and an
    empty kept_text; an empty table gives no rows; repeated rows and ids are each answered for. Other columns are not read. A text is read
    whole by the task that has its row, in memory in proportion to its length; nothing is shuffled.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, found, kept = [], [], []
            for text in texts_of(batch.column(1)):
                words = text.split()
                counts.append(len(words))
                numbers: dict[bytes, int] = {}
                runs = runs_of(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)), least_words, least_periods)
                if runs:
                    words = [w for w, stays in zip(words, collapsed(len(words), runs).tolist(), strict=True) if stays]
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                kept.append(b" ".join(words))
            kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(kept, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "kept_text"])

    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, n_words bigint, runs {RUNS}, kept_text string")
    return out.withColumnRenamed("id", id)
