"""Words of documents that benchmark items hold too, by a prefix-filtered set join.

A window of an item is a set of words that a document must hold whole, so the prefix that has to be joined is one word: the rarest of the
window by its count in the documents. Documents look their words up in a Bloom filter of these prefix words and send only the places that
pass, each with the words around it. The join on the prefix word then checks the window's place (enough words before and after) and its exact
words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WordFilter, keep, slices, texts_of, with_text_key

WINDOW = 13
# A-Z become lower case; what is no digit, letter a-z or byte of a non-ASCII character becomes a space.
_TABLE = bytes(c if c >= 0x80 or chr(c).isdigit() else ord(chr(c).lower()) if chr(c).isalpha() else 0x20 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def item_windows(items: DataFrame, window: int, item_id: str, text: str) -> DataFrame:
    """item, i, words: runs of `window` words of each item; all words of a shorter one. Items without words have none."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            out = [], []
            for item, text_ in zip(part.column(0).to_pylist(), texts_of(part.column(1)), strict=True):
                words = words_of(text_.decode("utf-8", "replace").encode())
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    out[0].append(item)
                    out[1].append([w.decode("utf-8", "replace") for w in words[i : i + window]])
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.string()))], ["item", "words"])

    rows = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return rows.mapInArrow(of, "item string, words array<string>")


def _word_counts(docs: DataFrame, known: WordFilter) -> DataFrame:
    """word, n: how often the documents hold each word that passes the filter."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for part in slices(batches):
            for text in texts_of(part.column(0)):
                for word, n in Counter(words_of(text)).items():
                    if word in known:
                        counts[word] += n
            if len(counts) > 1 << 17:
                yield told()
                counts.clear()
        yield told()

    return docs.select("text").mapInArrow(of, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, prefixes: WordFilter, window: int) -> DataFrame:
    """doc_id, t1, t2, n_words and for each place whose word passes: the word, its place, the words before and those from it on."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            n_words, hits = [], []
            for text in texts_of(part.column(3)):
                words = words_of(text)
                passing = {w for w in set(words) if w in prefixes}
                n_words.append(len(words))
                found = []
                if passing:
                    for i, w in enumerate(words):
                        if w in passing:
                            before, after = (b" ".join(x).decode("utf-8", "replace") for x in (words[max(0, i - window + 1) : i], words[i : i + window]))
                            found.append({"word": w.decode("utf-8", "replace"), "at": i, "before": f" {before}", "after": f"{after} "})
                hits.append(found)
            kind_ = pa.list_(pa.struct([("word", pa.string()), ("at", pa.int64()), ("before", pa.string()), ("after", pa.string())]))
            yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n_words, pa.int64()), pa.array(hits, kind_)], ["doc_id", "t1", "t2", "n_words", "hits"])

    return docs.select("doc_id", "t1", "t2", "text").mapInArrow(of, f"doc_id {kind}, t1 long, t2 long, n_words long, hits array<struct<word string, at long, before string, after string>>")


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, t1, t2 (hashes of the text), n_words, n_hit, items (sorted ids as strings) for every row of docs, repeated rows included.

    A word is hit inside any occurrence of a window of an item. Null and empty texts have no words. Null item texts have no windows; a null
    item id is the string "null". Repeated items count once. Other columns are not read. Empty tables give no rows or no hits.
    """
    rows = with_text_key(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    windows = item_windows(items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("item"), F.col(item_text).alias("text")), window, "item", "text")
    windows = keep(windows.select("item", "words", F.xxhash64("words").alias("w1"), F.xxhash64(F.lit(1), "words").alias("w2")), "item-windows")
    sets = windows.dropDuplicates(["w1", "w2"]).select("w1", "w2", "words")
    vocabulary = sets.select(F.explode("words").alias("word")).distinct()
    counts = _word_counts(rows, WordFilter.of(vocabulary, "word"))

    ranked = sets.select("w1", "w2", "words", F.posexplode("words").alias("i", "word")).join(counts, "word")
    # A window with a word that no document holds occurs nowhere: the inner join leaves it with fewer words than it has.
    rarest = ranked.groupBy("w1", "w2").agg(F.min(F.struct("n", "word", "i")).alias("r"), F.count("*").alias("held"), F.first("words").alias("words"))
    rarest = rarest.where(F.col("held") == F.size("words"))
    before = F.concat(F.lit(" "), F.array_join(F.slice("words", 1, F.col("r.i")), " "))
    after = F.concat(F.array_join(F.slice("words", F.col("r.i") + 1, window), " "), F.lit(" "))
    prefixes = keep(rarest.select("w1", "w2", F.col("r.word").alias("word"), F.col("r.i").alias("i"), F.size("words").alias("n"), before.alias("before"), after.alias("after")), "prefixes")

    found = keep(_places(rows, WordFilter.of(prefixes.select("word").distinct(), "word"), window), "places")
    places = found.select("t1", "t2", "n_words", F.explode("hits").alias("h")).select("t1", "t2", "n_words", "h.*")
    p, w = places.alias("p"), prefixes.alias("w")
    fits = (F.col("p.at") >= F.col("w.i")) & (F.col("p.at") - F.col("w.i") + F.col("w.n") <= F.col("p.n_words"))
    same = F.col("p.after").startswith(F.col("w.after")) & ((F.col("w.i") == 0) | F.col("p.before").endswith(F.col("w.before")))
    start = F.col("p.at") - F.col("w.i")
    matches = p.join(w, (F.col("p.word") == F.col("w.word")) & fits & same).select("t1", "t2", start.alias("start"), (start + F.col("w.n")).alias("end"), "w1", "w2")
    matches = keep(matches.distinct(), "matches")

    spans = matches.groupBy("t1", "t2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to")),
        lambda a: a["n"],
    )
    hit_items = matches.select("t1", "t2", "w1", "w2").distinct().join(windows.select("w1", "w2", "item").distinct(), ["w1", "w2"])
    hit_items = hit_items.groupBy("t1", "t2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = keep(spans.select("t1", "t2", covered.alias("n_hit")).join(hit_items, ["t1", "t2"]), "hits")
    joined = found.select("doc_id", "t1", "t2", "n_words").join(hits, ["t1", "t2"], "left")
    return joined.select("doc_id", "t1", "t2", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def is_contaminated(share: int = 20):
    """At least one hit word, and at least one in `share`."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))


def without_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs without contaminated rows; rows and columns of the others stay as they are."""
    bad = contamination(docs, items, doc_id, text, **how).where(is_contaminated()).select(F.col("t1").alias("__a"), F.col("t2").alias("__b")).distinct()
    keyed = with_text_key(docs, text, "__t1", "__t2")
    bad = keep(bad, "contaminated")
    return keyed.join(bad, (keyed["__t1"] == bad["__a"]) & (keyed["__t2"] == bad["__b"]), "left_anti").select(*docs.columns)
