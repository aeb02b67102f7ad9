"""What the operators of this package share: written tables, row keys, ASCII words and Bloom filters of bounded size."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_intdigest

TEXT_SLICE = 512
MOST_FILTER_BITS = 1 << 27
MOST_CACHED_WORDS = 1 << 19
CLEANING_SECONDS = 0.5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where it is unset (tests) a temporary one is made."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        known = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back, so that a lost executor costs a reread and not a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Ends a step: deletes tables that keep() wrote and nothing that is still to run reads, and lets Spark remove the shuffle files of
    finished jobs, which otherwise stay until the driver happens to collect its garbage."""
    own = f"/{spark.sparkContext.applicationId}/"
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            if own in folder:
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    for _ in range(2):  # what the first turn frees lets go of more
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(CLEANING_SECONDS)


def with_text_key(docs: DataFrame, text: str = "text", first: str = "t1", second: str = "t2") -> DataFrame:
    """Two independent 64-bit hashes of the text. Rows of equal text share them; they are never null."""
    return docs.withColumns({first: F.xxhash64(F.lit(1), F.col(text)), second: F.xxhash64(F.lit(2), F.col(text))})


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = TEXT_SLICE) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def total(df: DataFrame, column: Column) -> int:
    """One sum over all rows; 0 for none."""
    return int(df.agg(F.sum(column).alias("s")).first()["s"] or 0)


class WordFilter:
    """A Bloom filter over words: bits grow with the words up to MOST_FILTER_BITS. It may let words through that are not in the set, and
    never holds one back that is."""

    HASHES = 3

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.seen: dict[bytes, bool] = {}

    @staticmethod
    def of(words: DataFrame, column: str) -> WordFilter:
        """Positions are hashed in Spark and joined to 64-bit cells there; at most MOST_FILTER_BITS / 64 cells come to the driver."""
        n = max(1024, words.count())
        size = min(MOST_FILTER_BITS, 1 << (16 * n - 1).bit_length())

        def places(batches):
            for batch in batches:
                at = [x for w in batch.column(0).cast(pa.binary()).to_pylist() if w is not None for x in WordFilter._places(w, size)]
                yield pa.RecordBatch.from_pydict({"p": pa.array(at, pa.int64())})

        cells = (
            words.select(column).mapInArrow(places, "p long")
            .groupBy((F.col("p") / 64).cast("long").alias("cell"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
        )
        bits = np.zeros(size // 64, np.int64)
        for batch in cells.toArrow().to_batches():
            bits[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
        return WordFilter(bits)

    @staticmethod
    def _places(word: bytes, size: int) -> list[int]:
        h = xxh3_128_intdigest(word)
        a, b = h & 0xFFFFFFFF, h >> 64 & 0xFFFFFFFF
        return [(a + i * b) % size for i in range(WordFilter.HASHES)]

    def __contains__(self, word: bytes) -> bool:
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) >= MOST_CACHED_WORDS:
                self.seen.clear()
            size = len(self.bits) * 64
            known = self.seen[word] = all(int(self.bits[p >> 6]) >> (p & 63) & 1 for p in self._places(word, size))
        return known
